"""python -m kikiwake.cli batch | harvest | evaluate | repl: the queries of the engine as commands.

Tokenizers: ``char``, ``words``, or a lexicon file of surface<TAB>reading lines. Recognition comes from a file of
text<TAB>hypothesis lines (a double for an engine, as no engine is installed here); a text that isn't listed is heard as it is.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from typing import IO

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks
from .functions.text import lines, strip_punct
from .operators import collect, evaluate, harvest, pipeline, state, tokens
from .session import broadcast_if_small, local_session, persisted
from .sources import articles as sources
from .sources import logs
from .types import LOOSE, STRICT, ExtractOptions, NormalizeOptions, VoiceSpec

Tokenizer = Callable[[Column], Column]


def tokenizer(kind: str) -> Tokenizer:
    if kind == "char":
        return tokens.char_tokens
    if kind == "words":
        return tokens.word_tokens
    with open(kind, encoding="utf-8") as f:
        lexicon = [tuple(x.rstrip("\n").split("\t")[:2]) for x in f if "\t" in x]
    return lambda c: tokens.lexicon_tokens(c, lexicon)


def options(strict: bool) -> NormalizeOptions:
    return STRICT if strict else LOOSE


def diff_text(spark: SparkSession, reference: str, hypothesis: str, tokenize: Tokenizer, opts: NormalizeOptions = LOOSE) -> DataFrame:
    """Rows of two texts compared line by line."""
    df = spark.createDataFrame([("t", reference, hypothesis)], "k string, r string, h string")
    pairs = pipeline.paired_lines(logs.numbered_lines(df, "k", "r"), logs.numbered_lines(df, "k", "h"), "k")
    return pipeline.process_rows(pairs.select("line_no", tokenize(F.col("reference")).alias("reference"), tokenize(F.col("hypothesis")).alias("hypothesis")), opts=opts).orderBy("line_no", "block_idx")


def whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.lit("f").alias("k"), "value")


def batch(spark: SparkSession, reference: str, hypothesis: str, tokenize: Tokenizer, opts: NormalizeOptions = LOOSE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(dictionary, rejects, summary) of two files of aligned lines."""
    r, h = whole(spark, reference), whole(spark, hypothesis)
    pairs = pipeline.paired_lines(logs.numbered_lines(r, "k", "value"), logs.numbered_lines(h, "k", "value"), "k")
    out = persisted(pipeline.process(pairs.select("line_no", tokenize(F.col("reference")).alias("reference"), tokenize(F.col("hypothesis")).alias("hypothesis")), opts=opts), "batch")
    danger = collect.danger(out, ["line_no", "block_idx"])
    n = r.select(F.size(lines(F.col("value"))).alias("reference_lines"), "k").join(h.select(F.size(lines(F.col("value"))).alias("hypothesis_lines"), "k"), "k").drop("k")
    return danger, collect.rejects(out.orderBy("line_no", "block_idx")), n


def mapping(spark: SparkSession, path: str | None) -> DataFrame:
    if not path:
        return spark.createDataFrame([], "text string, hypothesis string")
    f = F.split("value", "\t", 2)
    return spark.read.text(path).where(F.size(f) == 2).select(f[0].alias("text"), f[1].alias("hypothesis"))


def repl(spark: SparkSession, stdin: IO[str], tokenize: Tokenizer, save: Callable[[DataFrame, DataFrame], None], opts: NormalizeOptions = LOOSE) -> int:
    """Alternating lines of both sides; a blank first side or the end stops. The dictionary so far is saved after every pair."""
    rows: list[tuple[int, str, str]] = []
    while (r := stdin.readline()) and r.strip() and (h := stdin.readline()):
        rows.append((len(rows), r.rstrip("\n"), h.rstrip("\n")))
        df = spark.createDataFrame(rows, "seq int, r string, h string")
        out = pipeline.process(df.select("seq", tokenize(F.col("r")).alias("reference"), tokenize(F.col("h")).alias("hypothesis")), opts=opts)
        save(collect.danger(out, ["seq", "block_idx"]), collect.rejects(out))
    return len(rows)


def sweep(spark: SparkSession, words: DataFrame, refs: DataFrame, recognize: Callable[[DataFrame], DataFrame], tokenize: Tokenizer, step: int, max_words: int, min_delta: float, patience: int, opts: NormalizeOptions = LOOSE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(curve, recommended, pruned). recognize adds ``hypothesis`` to (n, words, audio, text), null where a run failed."""
    pts = persisted(evaluate.bias_words(evaluate.schedule(spark, words.count(), max_words, step), words), "points")
    n_refs = refs.count()
    if not n_refs:
        raise ValueError("no references")
    steps = F.array(*[F.lit(r["n"]) for r in pts.select("n").collect()])  # the points of a user's sweep
    cells = refs.withColumn("n", F.explode(steps)).join(broadcast_if_small(pts, 1_000), "n")
    heard = recognize(cells).where("hypothesis is not null")
    pairs = heard.select("n", "audio", tokenize(strip_punct(F.col("text"))).alias("reference"), tokenize(strip_punct(F.col("hypothesis"))).alias("hypothesis"))
    out = persisted(pipeline.process(pairs, opts=opts), "sweep")
    curve = persisted(evaluate.curve(pts.select("n"), out, n_refs), "curve")
    recommended = evaluate.plateau(curve, min_delta, patience)
    last = evaluate.final_n(curve, recommended).first()["final_n"]
    hit = out.where("is_homophone").select("n", F.col("reference_surface").alias("word"))
    return curve, recommended, evaluate.pruned(words, hit.where("n = 0"), hit.where(F.col("n") == last), last)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="kikiwake")
    p.add_argument("--tokenizer", default="char")
    p.add_argument("--strict", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("batch", "repl", "harvest"):
        s = sub.add_parser(name)
        s.add_argument("--output")
        s.add_argument("--reject")
        s.add_argument("--format", choices=["txt", "counts", "json"])
        s.add_argument("--counts", action="store_true")
        s.add_argument("--field", default="general")
        if name == "batch":
            s.add_argument("reference")
            s.add_argument("hypothesis")
        if name == "harvest":
            s.add_argument("files")
            s.add_argument("--voice", action="append", default=None)
            s.add_argument("--rate", type=float, action="append", default=None)
            s.add_argument("--engine", default="tts")
            s.add_argument("--model", default="model")
            s.add_argument("--asr")
            s.add_argument("--seen")
            s.add_argument("--cache")
            s.add_argument("--min-votes", type=int)
            s.add_argument("--max-per-article", type=int, default=20)
            s.add_argument("--dry-run", action="store_true")
    s = sub.add_parser("evaluate")
    s.add_argument("--input", required=True)
    s.add_argument("--refs", required=True)
    s.add_argument("--asr")
    s.add_argument("--step", type=int, default=25)
    s.add_argument("--max-words", type=int, default=400)
    s.add_argument("--min-delta", type=float, default=0.01)
    s.add_argument("--patience", type=int, default=2)
    s.add_argument("--output")
    s.add_argument("--prune")
    a = p.parse_args(argv)
    spark = SparkSession.getActiveSession() or local_session()
    tokenize, opts = tokenizer(a.tokenizer), options(a.strict)

    def save(danger: DataFrame, rejects: DataFrame) -> None:
        with open(a.output, "w", encoding="utf-8") if a.output else _stdout() as f:
            sinks.write_dictionary(danger, f, a.format, a.counts, field=a.field)
        if a.reject:
            with open(a.reject, "w", encoding="utf-8") as f:
                sinks.write_lines(sinks.reject_lines(rejects), f)

    if a.command == "batch":
        danger, rejects, n = batch(spark, a.reference, a.hypothesis, tokenize, opts)
        save(danger, rejects)
        r = n.first()
        if r and r["reference_lines"] != r["hypothesis_lines"]:
            print(f"line counts differ: {r['reference_lines']} and {r['hypothesis_lines']}", file=sys.stderr)
        print(f"words {danger.count()}, rejected {rejects.count()}", file=sys.stderr)
    elif a.command == "repl":
        repl(spark, sys.stdin, tokenize, save, opts)
    elif a.command == "harvest":
        arts = sources.files(spark, a.files).withColumn("article_idx", F.monotonically_increasing_id())
        seen = logs.seen(spark, a.seen) if a.seen else spark.createDataFrame([], "article string, sentence string")
        opts_x = ExtractOptions(max_per_article=a.max_per_article)
        if a.dry_run:
            sinks.write_lines(harvest.pending(arts, seen, opts_x).orderBy("article_idx", "sent_idx").select(F.col("text").alias("value")), sys.stdout)
            return 0
        voices = [VoiceSpec(a.engine, v, r) for v in a.voice or ["1"] for r in a.rate or [1.0]]
        votes = a.min_votes or (2 if len({v.voice for v in voices}) >= 2 else 1)
        engines = (harvest.text_payload, harvest.mapped(mapping(spark, a.asr)), tokenize, opts_x, votes, opts)
        if a.cache:
            run = harvest.run_cached(arts, seen, voices, a.model, a.cache, *engines)
        else:
            none = [spark.createDataFrame([], x) for x in (harvest.AUDIO, harvest.ASR)]
            run = harvest.run(arts, seen, voices, a.model, *none, *engines)
        save(run.danger, run.rejects)
        print(run.metrics.first().asDict(), file=sys.stderr)
        for r in collect.dropped(run.votes, votes).orderBy("reference_surface", "hypothesis_surface").toLocalIterator():
            print(f"[voted out] {r['reference_surface']} {r['hypothesis_surface']} {r['speakers']}", file=sys.stderr)
        if a.seen:
            state.append_seen(run.seen, seen, a.seen)
    else:
        words = logs.dictionary(spark, a.input)
        curve, rec, pruned = sweep(spark, words, logs.refs(spark, a.refs).select("audio", "text"), harvest.mapped(mapping(spark, a.asr)), tokenize, a.step, a.max_words, a.min_delta, a.patience, opts)
        with open(a.output, "w", encoding="utf-8") if a.output else _stdout() as f:
            sinks.write_lines(sinks.curve_lines(curve), f)
        if a.prune:
            with open(a.prune, "w", encoding="utf-8") as f:
                sinks.write_lines(sinks.prune_lines(pruned), f)
        print(f"recommended {rec.first()['recommended_n']}", file=sys.stderr)
    return 0


class _stdout:
    def __enter__(self) -> IO[str]:
        return sys.stdout

    def __exit__(self, *_: object) -> None:
        sys.stdout.flush()


__all__ = ["batch", "diff_text", "main", "repl", "sweep"]

if __name__ == "__main__":
    sys.exit(main())
