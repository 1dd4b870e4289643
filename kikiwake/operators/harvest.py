"""Articles to homophones over a matrix of voices. Engines come in as functions on DataFrames; doubles stand in for them offline."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions.text import strip_punct
from ..session import persisted
from ..types import LOOSE, ExtractOptions, NormalizeOptions, VoiceSpec
from . import collect, extract, pipeline, state

Engine = Callable[[DataFrame], DataFrame]


def voice_matrix(df: DataFrame, voices: list[str], rates: list[float], engine: str) -> DataFrame:
    """Every row with every voice and rate. The matrix is an array literal of the call, so the product needs no join."""
    cells = F.array(*[F.struct(F.lit(engine).alias("engine"), F.lit(v).alias("voice"), F.lit(r).cast("float").alias("rate")) for v in voices for r in rates])
    return df.withColumn("v", F.explode(cells)).select(*df.columns, "v.engine", "v.voice", "v.rate")


def with_audio_key(cells: DataFrame) -> DataFrame:
    return cells.withColumn("audio_key", K.audio_key(F.col("text"), F.col("engine"), F.col("voice"), F.col("rate"))).withColumn("speaker", K.speaker_key(F.col("engine"), F.col("voice")))


def pending(articles: DataFrame, seen: DataFrame, options: ExtractOptions = ExtractOptions()) -> DataFrame:
    """Sentences to work on: unseen articles, extracted, unseen sentences, the first of equal ones in the run."""
    a = articles.withColumn("article", K.article_key(F.col("source"), F.col("id")))
    fresh = state.unseen(a, seen, "article", "dedup")
    rows = extract.extract_by_trust(fresh, options).withColumn("sentence", K.sentence_hash(F.col("text")))
    return state.first_in_run(state.unseen(rows, seen, "sentence", "dedup"), "sentence", ["article_idx", "sent_idx"])


@dataclass
class Harvest:
    """The results of a run, as DataFrames: dictionary words, rejects, votes, counters, and what may now be marked as seen."""

    danger: DataFrame
    rejects: DataFrame
    votes: DataFrame
    metrics: DataFrame
    seen: DataFrame
    refs: DataFrame
    cells: DataFrame = field(repr=False)

    def keep(self, audio_path: str, asr_path: str) -> None:
        """Append what this run made to the caches of audio and recognitions; the next run finds it there."""
        state.append_absent(self.cells.where("not audio_hit and payload is not null").select("audio_key", "payload"), audio_path, "audio_key")
        state.append_absent(self.cells.where("not asr_hit and hypothesis is not null").select("asr_key", "hypothesis"), asr_path, "asr_key")


def run(
    articles: DataFrame, seen: DataFrame, voices: list[VoiceSpec], model: str, audio: DataFrame, asr: DataFrame,
    synthesize: Engine, recognize: Engine, tokenize: Callable, options: ExtractOptions = ExtractOptions(), min_votes: int = 1, opts: NormalizeOptions = LOOSE,
) -> Harvest:
    """audio(audio_key, payload) and asr(asr_key, hypothesis) are caches; synthesize adds ``payload`` and recognize ``hypothesis``
    to the rows that miss them, null where an engine failed - such a cell is dropped and its sentence isn't marked as seen."""
    rows = pending(articles, seen, options)
    cells = F.array(*[F.struct(F.lit(v.engine).alias("engine"), F.lit(v.voice).alias("voice"), F.lit(v.rate).cast("float").alias("rate")) for v in voices])
    keyed = with_audio_key(rows.withColumn("v", F.explode(cells)).select(*rows.columns, "v.engine", "v.voice", "v.rate")).withColumn("asr_key", K.asr_key(F.col("audio_key"), F.lit(model)))
    a = state.cached(keyed, audio, "audio_key", "payload").withColumnRenamed("hit", "audio_hit")
    a = a.where("audio_hit").unionByName(synthesize(a.where("not audio_hit").drop("payload")), allowMissingColumns=True)
    h = state.cached(a, asr, "asr_key", "hypothesis").withColumnRenamed("hit", "asr_hit")
    done = h.where("asr_hit")
    todo = recognize(h.where("not asr_hit and payload is not null").drop("hypothesis"))
    failed = h.where("not asr_hit and payload is null")
    cells_df = persisted(done.unionByName(todo, allowMissingColumns=True).unionByName(failed, allowMissingColumns=True), "cells")

    ok = cells_df.where("hypothesis is not null")
    pairs = ok.select("article_idx", "sent_idx", "speaker", tokenize(strip_punct(F.col("text"))).alias("reference"), tokenize(strip_punct(F.col("hypothesis"))).alias("hypothesis"))
    outcomes = persisted(pipeline.process(pairs, opts=opts), "outcomes")
    votes = collect.pair_votes(outcomes)
    kept = collect.passed(outcomes, min_votes)
    by_sentence = cells_df.groupBy("article", "article_idx", "sentence", "dedup").agg(F.bool_and(F.col("hypothesis").isNotNull()).alias("complete"))
    marks = by_sentence.where("complete and dedup").select(F.lit(None).cast("string").alias("article"), "sentence").distinct()
    whole = completeness(articles.withColumn("article", K.article_key(F.col("source"), F.col("id"))), by_sentence, seen)
    metrics = cells_df.agg(
        F.count_distinct("article_idx", "sent_idx").alias("sentences"), F.count(F.lit(1)).alias("cells"), F.count_if("audio_hit").alias("audio_hits"),
        F.count_if(F.col("asr_hit")).alias("asr_hits"), F.count_if(F.col("hypothesis").isNull()).alias("failures"),
    )
    order = ["hypothesis_surface", "article_idx", "sent_idx", "block_idx"]
    return Harvest(collect.danger(kept, order), collect.rejects(kept), votes, metrics, marks.unionByName(whole), cells_df.select("audio_key", "text").distinct(), cells_df)


def completeness(articles: DataFrame, by_sentence: DataFrame, seen: DataFrame) -> DataFrame:
    """Articles all of whose sentences are complete; those without any are, too."""
    state_of = by_sentence.groupBy("article").agg(F.bool_and("complete").alias("complete"))
    fresh = state.unseen(articles.where("dedup").select("article").distinct(), seen, "article")
    return fresh.join(state_of, "article", "left").where("coalesce(complete, true)").select("article", F.lit(None).cast("string").alias("sentence"))


AUDIO, ASR = "audio_key string, payload binary", "asr_key string, hypothesis string"


def caches(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The caches of earlier runs, empty before the first."""
    return state.stored(spark, f"{folder}/audio", AUDIO), state.stored(spark, f"{folder}/asr", ASR)


def run_cached(articles: DataFrame, seen: DataFrame, voices: list[VoiceSpec], model: str, folder: str, *rest: object, **options: object) -> Harvest:
    """``run`` with the caches of a folder, read before and added to behind."""
    out = run(articles, seen, voices, model, *caches(articles.sparkSession, folder), *rest, **options)
    out.keep(f"{folder}/audio", f"{folder}/asr")
    return out


def echo(df: DataFrame) -> DataFrame:
    """A recognizer double: hears what was said."""
    return df.withColumn("hypothesis", F.col("text"))


def mapped(table: DataFrame) -> Engine:
    """A recognizer double: table(text, hypothesis), the text itself where it isn't listed."""
    t = table.select("text", F.col("hypothesis").alias("__h"))
    return lambda df: df.join(t, "text", "left").withColumn("hypothesis", F.coalesce("__h", "text")).drop("__h")


def text_payload(df: DataFrame) -> DataFrame:
    """A synthesizer double: the payload is the text."""
    return df.withColumn("payload", F.encode("text", "UTF-8"))


def per_partition(make: Callable[[], Callable[[dict], object]], out: str, ddl: str) -> Engine:
    """An engine in Python: ``make`` builds it once per task; a failing call gives null, not a failed job."""

    def engine(df: DataFrame) -> DataFrame:
        def work(parts):  # noqa: ANN001, ANN202
            call = None
            for pdf in parts:
                values = []
                for row in pdf.to_dict("records"):
                    try:
                        call = call or make()
                        values.append(call(row))
                    except Exception:
                        values.append(None)
                yield pdf.assign(**{out: values})

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        return df.mapInPandas(work, f"{schema}, {out} {ddl}")

    return engine
