"""Queries by name, over whole tables, with their SQL."""

from __future__ import annotations

import io
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import sinks, streaming
from ..functions import keys as K
from ..functions import reading as R
from ..functions import text as X
from ..operators import collect, diff, evaluate, extract, harvest, lattice, pipeline, state, tokens
from ..session import broadcast_if_small, new_path, persisted, small_side, table
from ..sources import articles as A
from ..sources import logs
from ..types import LENIENT, LOOSE, SEEN, STRICT, TOKENS, ExtractOptions, NormalizeOptions, VoiceSpec
from . import sqltext as S

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle() -> dict[str, str]:
    return dict(_SQL)


def columns(name: str, source: str, keep: list[str], spark_cols: Callable[[], dict], sql_cols: dict[str, str], where: str | None = None) -> None:
    """Register a projection of one table."""

    def f(spark: SparkSession, d: str) -> DataFrame:
        df = table(spark, d, source)
        return (df.where(where) if where else df).select(*keep, *[c.alias(n) for n, c in spark_cols().items()])

    query(name, f"SELECT {', '.join([*keep, *(f'{e} AS {n}' for n, e in sql_cols.items())])} FROM {source}" + (f" WHERE {where}" if where else ""))(f)


c = F.col
PARTIAL = NormalizeOptions(dakuten=True, prolonged=True, sokuon=False, small=False)

# ---------------------------------------------------------------- scalar functions

columns("m01_katakana", "tokens", ["token_id"], lambda: {"kana": R.to_katakana(c("surface"))}, {"kana": S.katakana("surface")})
columns("m02_dakuten", "tokens", ["token_id"], lambda: {"plain": R.strip_dakuten(c("reading"))}, {"plain": f"translate(reading, '{S.MARKED}', '{S.UNMARKED}')"})
columns("m03_small", "tokens", ["token_id"], lambda: {"full_size": R.enlarge_small(c("reading"))}, {"full_size": f"translate(reading, '{S.LITTLE}', '{S.LARGE}')"})
columns("m07_normalize_loose", "tokens", ["token_id"], lambda: {"norm": R.normalize(c("reading"), LOOSE)}, {"norm": S.normalize("reading", LOOSE)})
columns("m07_normalize_strict", "tokens", ["token_id"], lambda: {"norm": R.normalize(c("reading"), STRICT)}, {"norm": S.normalize("reading", STRICT)})
columns("m08_normalize_partial", "candidates", ["cand_id"], lambda: {"norm": R.normalize(c("hypothesis_reading"), PARTIAL)}, {"norm": S.normalize("hypothesis_reading", PARTIAL)})
columns("m09_char_ratio", "documents", ["doc_id"], lambda: {"japanese": X.japanese_ratio(c("text")), "kanji": X.kanji_ratio(c("text"))}, {"japanese": S.ratio("text", S.JAPANESE), "kanji": S.ratio("text", S.KANJI)})
columns("m10_normalize_sentence", "documents", ["doc_id"], lambda: {"norm": X.without_space(c("text"))}, {"norm": S.without_space("text")})
columns("m11_content_key", "documents", ["doc_id"], lambda: {"key": K.content_key(F.coalesce("source", F.lit("")), c("text"))}, {"key": S.content_key("coalesce(source, '')", "text")})
columns("m12_sentence_hash", "documents", ["doc_id"], lambda: {"key": K.sentence_hash(c("text"))}, {"key": S.sentence_hash("text")})
columns("m17_trim", "danger", ["entry_id"], lambda: {"trimmed": X.trim(c("word"))}, {"trimmed": S.trim("word")})
columns("m18_lines", "articles", ["article_idx"], lambda: {"lines": X.lines(c("body"))}, {"lines": S.lines("body")})
columns("t13_strip_punct", "documents", ["doc_id"], lambda: {"stripped": X.strip_punct(c("text"))}, {"stripped": "translate(text, '、。，．', '')"})


@query("m04_vowels", f"SELECT lex_id, i - 1 AS pos, {S.vowel('ch')} AS vowel, contains('{S.LONE}', ch) AS alone FROM (SELECT lex_id, unnest(string_split(reading, '')) AS ch, generate_subscripts(string_split(reading, ''), 1) AS i FROM lexicon)")
def m04(spark: SparkSession, d: str) -> DataFrame:
    chars = table(spark, d, "lexicon").select("lex_id", F.posexplode(F.filter(F.split("reading", ""), lambda x: x != "")).alias("pos", "ch"))
    return chars.select("lex_id", c("pos").cast("bigint").alias("pos"), R.vowel_of(c("ch")).alias("vowel"), F.lit(R.ALONE).contains(c("ch")).alias("alone"))


@query(
    "m06_long_pairs",
    f"WITH ch AS (SELECT lex_id, unnest(string_split(reading, '')) AS x, generate_subscripts(string_split(reading, ''), 1) AS i FROM lexicon), v AS (SELECT lex_id, i, {S.vowel('x')} AS now, lag({S.vowel('x')}) OVER (PARTITION BY lex_id ORDER BY i) AS before FROM ch) "
    "SELECT lex_id, count(*) FILTER (now = before OR (before = 'E' AND now = 'I') OR (before = 'O' AND now = 'U')) AS long_pairs FROM v GROUP BY lex_id",
)
def m06(spark: SparkSession, d: str) -> DataFrame:
    chars = table(spark, d, "lexicon").select("lex_id", F.posexplode(F.filter(F.split("reading", ""), lambda x: x != "")).alias("pos", "ch"))
    v = chars.withColumn("now", R.vowel_of(c("ch"))).withColumn("before", F.lag("now").over(W.partitionBy("lex_id").orderBy("pos")))
    return v.groupBy("lex_id").agg(F.count_if(R.is_long_pair(c("before"), c("now"))).alias("long_pairs"))


@query("m20_bias_prompt", "SELECT dict_id, string_agg(word, ' ' ORDER BY pos, word) AS prompt FROM (SELECT DISTINCT dict_id, pos, word FROM amical_terms WHERE word IS NOT NULL) GROUP BY dict_id")
def m20(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "amical_terms").where("word is not null").select("dict_id", "pos", "word").distinct()
    words = F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"])
    return rows.groupBy("dict_id").agg(K.bias_prompt(words).alias("prompt"))


# ---------------------------------------------------------------- extraction

columns("x01_plain", "articles", ["article_idx"], lambda: {"plain": X.plain_text(c("body_kind"), c("body"))}, {"plain": S.plain("body_kind", "body")})
columns("x02_fence", "articles", ["article_idx"], lambda: {"kept": X.strip_fences(c("body"))}, {"kept": S.fences("body")})
columns("x03_tables", "articles", ["article_idx"], lambda: {"kept": X.strip_tables(c("body"))}, {"kept": S.tables("body")})
columns("x04_markers", "articles", ["article_idx"], lambda: {"kept": X.strip_markers(c("body"))}, {"kept": S.markers("body")})
columns("x05_links", "articles", ["article_idx"], lambda: {"kept": X.strip_links(c("body"))}, {"kept": S.links("body")})
columns("x06_urls", "articles", ["article_idx"], lambda: {"kept": X.strip_urls(c("body"))}, {"kept": S.addresses("body")})
columns("x07_emphasis", "articles", ["article_idx"], lambda: {"kept": X.strip_emphasis(c("body"))}, {"kept": "translate(body, '`*', '')"})
columns("x08_html", "articles", ["article_idx"], lambda: {"kept": X.strip_tags(c("body"))}, {"kept": S.tags("body")})
columns("x09_entities", "articles", ["article_idx"], lambda: {"kept": X.decode_entities(c("body"))}, {"kept": S.entities("body")})

_SENT = f"SELECT article_idx, source, dedup, trusted, batch_no, unnest(s) AS text, generate_subscripts(s, 1) - 1 AS sent_idx FROM (SELECT *, {S.sentences(S.plain('body_kind', 'body'))} AS s FROM articles)"


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    rows = extract.sentences(table(spark, d, "articles").select("article_idx", "source", "dedup", "trusted", "batch_no", "body_kind", "body"))
    return rows.withColumn("sent_idx", c("sent_idx").cast("bigint"))


@query("x10_sentences", f"SELECT article_idx, sent_idx, text FROM ({_SENT})")
def x10(spark: SparkSession, d: str) -> DataFrame:
    return _sentences(spark, d).select("article_idx", "sent_idx", "text")


def _extract_sql(o: ExtractOptions, base: str = _SENT) -> str:
    ok = f"length(text) BETWEEN {o.min_len} AND {o.max_len}"
    if o.min_japanese_ratio > 0:
        ok += f" AND {S.ratio('text', S.JAPANESE)} >= {o.min_japanese_ratio}"
    if o.check_residue:
        ok += f" AND NOT {S.residue('text')}"
    first = f"SELECT * FROM ({base}) WHERE {ok} QUALIFY row_number() OVER (PARTITION BY article_idx, {S.without_space('text')} ORDER BY sent_idx) = 1"
    return f"SELECT article_idx, sent_idx, text, {S.ratio('text', S.KANJI)} AS kanji_ratio FROM ({first}) QUALIFY row_number() OVER (PARTITION BY article_idx ORDER BY kanji_ratio DESC, sent_idx) <= {o.max_per_article}"


_OPTIONS = ExtractOptions(max_per_article=3)


@query("x11_extract", _extract_sql(ExtractOptions()))
def x11(spark: SparkSession, d: str) -> DataFrame:
    out = extract.extract(table(spark, d, "articles").select("article_idx", "body_kind", "body"))
    return out.select("article_idx", c("sent_idx").cast("bigint").alias("sent_idx"), "text", "kanji_ratio")


@query("x11_extract_lenient", _extract_sql(LENIENT))
def x11l(spark: SparkSession, d: str) -> DataFrame:
    out = extract.extract(table(spark, d, "articles").select("article_idx", "body_kind", "body"), LENIENT)
    return out.select("article_idx", c("sent_idx").cast("bigint").alias("sent_idx"), "text", "kanji_ratio")


# ---------------------------------------------------------------- filters


def on_sentences(name: str, keep: Callable[[], F.Column], sql: str) -> None:
    query(name, f"SELECT article_idx, sent_idx FROM ({_SENT}) WHERE {sql}")(lambda spark, d: _sentences(spark, d).where(keep()).select("article_idx", "sent_idx"))


on_sentences("f01_passes", lambda: extract.passes(c("text"), ExtractOptions()), f"length(text) BETWEEN 20 AND 80 AND {S.ratio('text', S.JAPANESE)} >= 0.5 AND NOT {S.residue('text')}")
on_sentences("f02_length", lambda: extract.long_enough(c("text"), ExtractOptions()), "length(text) BETWEEN 20 AND 80")
on_sentences("f03_japanese", lambda: X.japanese_ratio(c("text")) >= 0.5, f"{S.ratio('text', S.JAPANESE)} >= 0.5")
on_sentences("f04_residue", lambda: X.has_residue(c("text")), S.residue("text"))
on_sentences("f05_brackets", lambda: X.unbalanced(c("text")), f"NOT {S.balanced('text')}")

_HEARD = f"SELECT *, {S.normalize('reference_reading')} AS r, {S.normalize('hypothesis_reading')} AS h FROM (SELECT DISTINCT * FROM candidates)"
_OUTCOMES = f"SELECT * EXCLUDE (is_homophone), coalesce(r <> '' AND r = h, false) AS is_homophone FROM ({_HEARD})"


def outcomes(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    """Candidates, delivered once or more, classified by their normalized readings; ``keep`` are the columns wanted beside cand_id and
    the readings. A row delivered again is the same row, so what is compared is what is wanted."""
    wanted = keep or ("article_key", "speaker", "reference_surface", "hypothesis_surface", "heard_at")
    once = table(spark, d, "candidates").select("cand_id", "reference_reading", "hypothesis_reading", *wanted).distinct()
    # each distinct reading is normalized once; there are far fewer of them than outcomes
    distinct = once.select(F.explode(F.array("reference_reading", "hypothesis_reading")).alias("reading")).where("reading is not null").distinct()
    forms = persisted(distinct.withColumn("norm", R.normalize(c("reading"))), "readings")
    hint = F.broadcast if small_side(forms, 100_000) else (lambda df: df)
    read = once
    for side in ("reference_reading", "hypothesis_reading"):
        read = read.join(hint(forms.select(c("reading").alias(side), c("norm").alias(f"{side}_norm"))), side, "left").drop(side).withColumnRenamed(f"{side}_norm", side)
    return read.withColumn("is_homophone", pipeline.homophone(c("reference_reading"), c("hypothesis_reading")))


@query("f08_homophones", f"SELECT cand_id, r AS reference_reading, h AS hypothesis_reading, is_homophone FROM ({_OUTCOMES})")
def f08(spark: SparkSession, d: str) -> DataFrame:
    return outcomes(spark, d, "reference_surface").select("cand_id", "reference_reading", "hypothesis_reading", "is_homophone")


@query("f12_row_skips", f"SELECT article_idx FROM articles WHERE id <> '' AND {S.trim('body')} <> ''")
def f12(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles").where((c("id") != "") & ~X.is_blank(c("body"))).select("article_idx")


# ---------------------------------------------------------------- dedup and ranking


@query("d01_article_dedup", f"SELECT article_idx, sent_idx, text FROM ({_SENT}) QUALIFY row_number() OVER (PARTITION BY article_idx, {S.without_space('text')} ORDER BY sent_idx) = 1")
def d01(spark: SparkSession, d: str) -> DataFrame:
    return extract.first_per_article(_sentences(spark, d)).select("article_idx", "sent_idx", "text")


@query("d02_run_dedup", f"SELECT article_idx, sent_idx, {S.sentence_hash('text')} AS sentence FROM ({_SENT}) QUALIFY row_number() OVER (PARTITION BY {S.sentence_hash('text')} ORDER BY article_idx, sent_idx) = 1")
def d02(spark: SparkSession, d: str) -> DataFrame:
    rows = _sentences(spark, d).withColumn("sentence", K.sentence_hash(c("text")))
    return state.first_in_run(rows, "sentence", ["article_idx", "sent_idx"]).select("article_idx", "sent_idx", "sentence")


@query("d03_first_refs", "SELECT source || '/' || id AS audio, arg_min(title, article_idx) AS text FROM articles WHERE title IS NOT NULL GROUP BY ALL")
def d03(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "articles").where("title is not null").withColumn("audio", K.article_key(c("source"), c("id")))
    return state.first_by(rows, "audio", "article_idx").select("audio", c("title").alias("text"))


@query("r01_topk", f"SELECT article_idx, sent_idx, {S.ratio('text', S.KANJI)} AS kanji_ratio FROM ({_SENT}) QUALIFY row_number() OVER (PARTITION BY article_idx ORDER BY kanji_ratio DESC, sent_idx) <= 3")
def r01(spark: SparkSession, d: str) -> DataFrame:
    return extract.top_per_article(_sentences(spark, d), 3).select("article_idx", "sent_idx", "kanji_ratio")


# ---------------------------------------------------------------- joins

_PLINES = f"SELECT article_idx, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS line_no FROM (SELECT article_idx, {S.lines('body')} AS l FROM articles)"
_PENDING = "SELECT article_idx, article_key, batch_no, unnest(sentences) AS text, generate_subscripts(sentences, 1) - 1 AS sent_idx FROM pending"


def _pending(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pending").select("article_idx", "article_key", "batch_no", F.posexplode("sentences").alias("sent_idx", "text")).withColumn("sent_idx", c("sent_idx").cast("bigint"))


@query("j01_line_pairs", f"SELECT p.article_idx, p.line_no, p.text AS reference, q.text AS hypothesis FROM (SELECT article_idx, sent_idx AS line_no, text FROM ({_PENDING})) p JOIN ({_PLINES}) q USING (article_idx, line_no) WHERE NOT ({S.trim('p.text')} = '' AND {S.trim('q.text')} = '')")
def j01(spark: SparkSession, d: str) -> DataFrame:
    ref = _pending(spark, d).select("article_idx", c("sent_idx").alias("line_no"), "text")
    hyp = logs.numbered_lines(table(spark, d, "articles"), "article_idx", "body").withColumn("line_no", c("line_no").cast("bigint"))
    return pipeline.paired_lines(ref, hyp, "article_idx")


VOICES, RATES, ENGINE, MODEL = ["1", "3"], [1.0, 0.9], "tts", "m1"
_VOICES = "(SELECT unnest(['1', '3']) AS voice), (SELECT unnest([1.0, 0.9])::FLOAT AS rate)"
_CELLS = f"SELECT *, {S.audio_key('text', S.lit(ENGINE), 'voice', 'rate')} AS audio_key FROM ({_PENDING}), {_VOICES} WHERE text IS NOT NULL"


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return harvest.with_audio_key(harvest.voice_matrix(_pending(spark, d).where("text is not null"), VOICES, RATES, ENGINE))


@query("j02_voice_matrix", f"SELECT article_idx, sent_idx, 'tts:' || voice AS speaker, {S.rate_key('rate')} AS rate_key, audio_key, {S.content_key('audio_key', S.lit(MODEL))} AS asr_key FROM ({_CELLS})")
def j02(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d).select("article_idx", "sent_idx", "speaker", K.rate_key(c("rate")).alias("rate_key"), "audio_key", K.asr_key(c("audio_key"), F.lit(MODEL)).alias("asr_key"))


_SEEN = "SELECT DISTINCT source || '/' || id AS article FROM articles WHERE batch_no < 6"


@query("j05_seen_articles", f"SELECT article_idx, source || '/' || id AS article FROM articles WHERE NOT coalesce(dedup, false) OR source || '/' || id NOT IN ({_SEEN})")
def j05(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "articles").withColumn("article", K.article_key(c("source"), c("id"))).withColumn("dedup", F.coalesce("dedup", F.lit(False)))
    return state.unseen(a, a.where("batch_no < 6").select("article"), "article", "dedup").select("article_idx", "article")


@query("j06_seen_sentences", f"WITH s AS (SELECT *, {S.sentence_hash('text')} AS sentence FROM ({_SENT})) SELECT article_idx, sent_idx FROM s WHERE batch_no >= 6 AND sentence NOT IN (SELECT sentence FROM s WHERE batch_no < 6)")
def j06(spark: SparkSession, d: str) -> DataFrame:
    s = _sentences(spark, d).withColumn("sentence", K.sentence_hash(c("text")))
    return state.unseen(s.where("batch_no >= 6"), s.where("batch_no < 6"), "sentence").select("article_idx", "sent_idx")


@query("j07_audio_cache", f"WITH k AS ({_CELLS}), a AS (SELECT DISTINCT audio_key FROM k WHERE batch_no < 6) SELECT article_idx, sent_idx, k.audio_key, a.audio_key IS NOT NULL AS hit FROM k LEFT JOIN a USING (audio_key)")
def j07(spark: SparkSession, d: str) -> DataFrame:
    k = _cells(spark, d)
    cache = k.where("batch_no < 6").select("audio_key", c("text").alias("payload"))
    return state.cached(k, cache, "audio_key", "payload").select("article_idx", "sent_idx", "audio_key", "hit")


@query("j08_asr_cache", f"WITH m AS (SELECT text, min(hypothesis) AS hypothesis FROM (SELECT reference_surface AS text, hypothesis_surface AS hypothesis FROM candidates) GROUP BY text) SELECT lex_id, surface, coalesce(hypothesis, surface) AS hypothesis FROM lexicon LEFT JOIN m ON text = surface")
def j08(spark: SparkSession, d: str) -> DataFrame:
    heard = table(spark, d, "candidates").groupBy(c("reference_surface").alias("text")).agg(F.min("hypothesis_surface").alias("hypothesis"))
    return harvest.mapped(heard)(table(spark, d, "lexicon").withColumnRenamed("surface", "text")).select("lex_id", c("text").alias("surface"), "hypothesis")


@query("j09_missing_audio", "SELECT count(*) AS refs, count(*) FILTER (article_idx IS NULL) AS failures FROM (SELECT DISTINCT article_key FROM candidates) c LEFT JOIN (SELECT source || '/' || id AS article_key, min(article_idx) AS article_idx FROM articles WHERE batch_no < 9 GROUP BY 1) USING (article_key)")
def j09(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "candidates").select("article_key").distinct()
    have = table(spark, d, "articles").where("batch_no < 9").select(K.article_key(c("source"), c("id")).alias("article_key"), "article_idx").groupBy("article_key").agg(F.min("article_idx").alias("article_idx"))
    return refs.join(have, "article_key", "left").agg(F.count(F.lit(1)).alias("refs"), F.count_if(c("article_idx").isNull()).alias("failures"))


@query("j13_readings", "SELECT token_id, CASE WHEN t.reading IS NULL OR t.reading IN ('', '*') THEN coalesce(l.reading, " + S.katakana("t.surface") + ") ELSE t.reading END AS reading FROM tokens t LEFT JOIN lexicon l USING (surface)")
def j13(spark: SparkSession, d: str) -> DataFrame:
    lex = broadcast_if_small(table(spark, d, "lexicon").select("surface", c("reading").alias("known")))
    t = table(spark, d, "tokens").join(lex, "surface", "left")
    own = F.when(c("reading").isin("", "*"), None).otherwise(c("reading"))
    return t.select("token_id", F.coalesce(own, "known", R.to_katakana(c("surface"))).alias("reading"))


# ---------------------------------------------------------------- tokens and diff

_FIRSTS = "SELECT article_idx, sent_idx, surface, min(tok_idx::BIGINT * 1000000000 + token_id) AS spot, arg_min(coalesce(reading, ''), tok_idx::BIGINT * 1000000000 + token_id) AS reading FROM (SELECT DISTINCT token_id, article_idx, sent_idx, tok_idx, surface, reading FROM tokens WHERE surface IS NOT NULL) GROUP BY ALL"
_LINED = f"SELECT *, row_number() OVER (PARTITION BY article_idx, sent_idx ORDER BY spot) - 1 AS pos FROM ({_FIRSTS})"


def token_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of distinct surfaces, and the same with two of every seven tokens misheard; every other time with another reading."""
    once = table(spark, d, "tokens").where("surface is not null").select("token_id", "article_idx", "sent_idx", "tok_idx", "surface", "reading").distinct()
    at = c("tok_idx") * F.lit(1_000_000_000).cast("bigint") + c("token_id")
    firsts = once.withColumn("at", at).groupBy("article_idx", "sent_idx", "surface").agg(F.min("at").alias("at"), F.min_by(F.coalesce("reading", F.lit("")), "at").alias("reading"))
    rows = F.array_sort(F.collect_list(F.struct("at", "surface", "reading")))
    lists = firsts.groupBy("article_idx", "sent_idx").agg(rows.alias("rows"))

    def wrong(x: F.Column, i: F.Column) -> F.Column:
        hit = F.pmod(i, F.lit(7)).isin(2, 3)
        return tokens.token(F.when(hit, F.concat(x["surface"], F.lit("#"))).otherwise(x["surface"]), F.when(hit & (F.pmod(i, F.lit(14)) > 6), F.concat(x["reading"], F.lit("ア"))).otherwise(x["reading"]), F.lit(tokens.NOUN))

    right = F.transform("rows", lambda x: tokens.token(x["surface"], x["reading"], F.lit(tokens.NOUN)))
    return lists.select("article_idx", "sent_idx", right.alias("reference"), F.transform("rows", wrong).alias("hypothesis"))


_GAPS = f"""SELECT article_idx, sent_idx, pos // 7 AS block, string_agg(surface, '' ORDER BY pos) AS reference_surface, string_agg(surface || '#', '' ORDER BY pos) AS hypothesis_surface,
 string_agg({S.normalize("coalesce(reading, '')")}, '' ORDER BY pos) AS r,
 string_agg({S.normalize("coalesce(reading, '') || CASE WHEN pos % 14 > 6 THEN 'ア' ELSE '' END")}, '' ORDER BY pos) AS h
 FROM ({_LINED}) WHERE pos % 7 IN (2, 3) GROUP BY ALL"""


@query("t06_replacements", f"SELECT article_idx, sent_idx, row_number() OVER (PARTITION BY article_idx, sent_idx ORDER BY block) - 1 AS block_idx, reference_surface, hypothesis_surface FROM ({_GAPS})")
def t06(spark: SparkSession, d: str) -> DataFrame:
    p = token_pairs(spark, d)
    blocks = p.select("article_idx", "sent_idx", F.posexplode(diff.replacements(c("reference"), c("hypothesis"))).alias("i", "b"))
    return blocks.select("article_idx", "sent_idx", c("i").cast("bigint").alias("block_idx"), pipeline.join_surface(c("b.reference")).alias("reference_surface"), pipeline.join_surface(c("b.hypothesis")).alias("hypothesis_surface"))


@query("t07_rows", f"SELECT article_idx, sent_idx, string_agg(surface, '' ORDER BY pos) AS surface, CASE WHEN bool_or(hit) THEN 'replace' ELSE 'equal' END AS tag FROM (SELECT *, pos % 7 IN (2, 3) AS hit, CASE WHEN pos % 7 < 2 THEN 0 WHEN pos % 7 < 4 THEN 1 ELSE 2 END + 3 * (pos // 7) AS part FROM ({_LINED})) GROUP BY article_idx, sent_idx, CASE WHEN part % 3 = 0 AND part > 0 THEN part - 1 ELSE part END")
def t07(spark: SparkSession, d: str) -> DataFrame:
    p = token_pairs(spark, d)
    blocks = p.select("article_idx", "sent_idx", F.explode(diff.diff_rows(c("reference"), c("hypothesis"))).alias("b"))
    return blocks.select("article_idx", "sent_idx", pipeline.join_surface(c("b.reference")).alias("surface"), c("b.tag").alias("tag"))


@query("t10_classify", f"SELECT article_idx, sent_idx, row_number() OVER (PARTITION BY article_idx, sent_idx ORDER BY block) - 1 AS block_idx, reference_surface, hypothesis_surface, r AS reference_reading, h AS hypothesis_reading, r <> '' AND r = h AS is_homophone FROM ({_GAPS})")
def t10(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.process(token_pairs(spark, d)).withColumn("block_idx", c("block_idx").cast("bigint"))


@query("t12_process_rows", f"SELECT kind, count(*) AS n FROM (SELECT CASE WHEN r <> '' AND r = h THEN 'homophone' ELSE 'non-homophone' END AS kind FROM ({_GAPS}) UNION ALL SELECT 'equal' FROM ({_SQL['t07_rows']}) WHERE tag = 'equal') GROUP BY kind")
def t12(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.process_rows(token_pairs(spark, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("t03_char_tokens", "SELECT lex_id, i - 1 AS pos, ch AS surface, CASE ch WHEN '機' THEN 'キ' WHEN '械' THEN 'カイ' ELSE ch END AS reading FROM (SELECT lex_id, unnest(string_split(surface, '')) AS ch, generate_subscripts(string_split(surface, ''), 1) AS i FROM lexicon)")
def t03(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lexicon").select("lex_id", F.posexplode(tokens.char_tokens(c("surface"), {"機": "キ", "械": "カイ"})).alias("pos", "t"))
    return t.select("lex_id", c("pos").cast("bigint").alias("pos"), c("t.surface").alias("surface"), c("t.reading").alias("reading"))


@query("t05_word_tokens", f"SELECT doc_id, i - 1 AS pos, w AS surface, {S.katakana('w')} AS reading FROM (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^ \\t-\\r]+') AS l FROM documents))")
def t05(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", F.posexplode(tokens.word_tokens(c("text"))).alias("pos", "t"))
    return t.select("doc_id", c("pos").cast("bigint").alias("pos"), c("t.surface").alias("surface"), c("t.reading").alias("reading"))


# ---------------------------------------------------------------- aggregation

_DANGER = f"SELECT reference_surface AS word, arg_min(r, cand_id) AS reading, count(*) AS count FROM ({_OUTCOMES}) WHERE is_homophone GROUP BY 1"


def danger(spark: SparkSession, d: str) -> DataFrame:
    return collect.danger(outcomes(spark, d, "reference_surface"), ["cand_id"])


query("a01_danger", _DANGER)(danger)
query("a03_danger_len", f"SELECT count(DISTINCT reference_surface) AS words FROM ({_OUTCOMES}) WHERE is_homophone")(lambda s, d: outcomes(s, d, "reference_surface").where("is_homophone").agg(F.count_distinct("reference_surface").alias("words")))
query("a04_rejects", f"SELECT reference_surface, hypothesis_surface, r AS reference_reading, h AS hypothesis_reading FROM ({_OUTCOMES}) WHERE NOT is_homophone")(lambda s, d: collect.rejects(outcomes(s, d, "reference_surface", "hypothesis_surface")))
_VOTES = f"SELECT reference_surface, hypothesis_surface, count(DISTINCT speaker) AS speakers, CAST(count(*) AS BIGINT) AS outcomes FROM ({_OUTCOMES}) WHERE is_homophone GROUP BY 1, 2"
query("a05_votes", _VOTES)(lambda s, d: collect.pair_votes(outcomes(s, d, "speaker", "reference_surface", "hypothesis_surface")))
query("a06_vote_summary", f"SELECT count(*) FILTER (speakers >= 3) AS passed_pairs, count(*) FILTER (speakers < 3) AS dropped_pairs FROM ({_VOTES})")(lambda s, d: collect.vote_summary(collect.pair_votes(outcomes(s, d, "speaker", "reference_surface", "hypothesis_surface")), 3))
query("a06_dropped", f"SELECT reference_surface, hypothesis_surface, speakers FROM ({_VOTES}) WHERE speakers < 3")(lambda s, d: collect.dropped(collect.pair_votes(outcomes(s, d, "speaker", "reference_surface", "hypothesis_surface")), 3))
query("a07_min_votes", "SELECT article_key, CASE WHEN count(DISTINCT speaker) >= 2 THEN 2 ELSE 1 END AS min_votes FROM candidates GROUP BY article_key")(
    lambda s, d: table(s, d, "candidates").groupBy("article_key").agg(F.when(F.count_distinct("speaker") >= 2, 2).otherwise(1).alias("min_votes"))
)


@query("j10_passed_pairs", f"WITH o AS ({_OUTCOMES}), v AS ({_VOTES}) SELECT cand_id FROM o WHERE NOT is_homophone UNION ALL SELECT cand_id FROM o JOIN v ON o.reference_surface IS NOT DISTINCT FROM v.reference_surface AND o.hypothesis_surface = v.hypothesis_surface WHERE is_homophone AND speakers >= 3")
def j10(spark: SparkSession, d: str) -> DataFrame:
    return collect.passed(outcomes(spark, d, "speaker", "reference_surface", "hypothesis_surface"), 3).select("cand_id")


@query("e2e_danger", f"WITH o AS ({_OUTCOMES}), v AS ({_VOTES}) SELECT reference_surface AS word, arg_min(r, cand_id) AS reading, count(*) AS count FROM o SEMI JOIN (SELECT * FROM v WHERE speakers >= 2) USING (reference_surface, hypothesis_surface) WHERE is_homophone GROUP BY 1")
def e2e(spark: SparkSession, d: str) -> DataFrame:
    """Classified, voted, tallied: the dictionary."""
    heard = outcomes(spark, d, "speaker", "reference_surface", "hypothesis_surface").drop("hypothesis_reading")
    return collect.danger(collect.passed(persisted(heard.where("is_homophone"), "outcomes"), 2), ["cand_id"])


@query(
    "a08_metrics",
    f"WITH k AS (SELECT *, {S.content_key('audio_key', S.lit(MODEL))} AS asr_key FROM ({_CELLS})), a AS (SELECT DISTINCT audio_key FROM k WHERE batch_no < 6), r AS (SELECT DISTINCT asr_key FROM k WHERE batch_no < 3) "
    "SELECT count(DISTINCT (article_idx, sent_idx)) AS sentences, count(*) AS cells, count(a.audio_key) AS audio_hits, count(r.asr_key) AS asr_hits FROM k LEFT JOIN a USING (audio_key) LEFT JOIN r USING (asr_key)",
)
def a08(spark: SparkSession, d: str) -> DataFrame:
    k = _cells(spark, d).withColumn("asr_key", K.asr_key(c("audio_key"), F.lit(MODEL)))
    a = state.cached(k, k.where("batch_no < 6").select("audio_key", c("text").alias("payload")), "audio_key", "payload").withColumnRenamed("hit", "audio_hit")
    r = state.cached(a, k.where("batch_no < 3").select("asr_key", c("text").alias("heard")), "asr_key", "heard").withColumnRenamed("hit", "asr_hit")
    return r.agg(F.count_distinct("article_idx", "sent_idx").alias("sentences"), F.count(F.lit(1)).alias("cells"), F.count_if("audio_hit").alias("audio_hits"), F.count_if("asr_hit").alias("asr_hits"))


@query("a11_merge", f"WITH t AS (SELECT {S.trim('word')} AS word, count FROM danger WHERE word IS NOT NULL UNION ALL SELECT {S.trim('word')}, count FROM amical_terms WHERE word IS NOT NULL) SELECT word, CAST(sum(count) AS BIGINT) AS count FROM t WHERE word <> '' GROUP BY word")
def a11(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t).select(X.trim(c("word")).alias("word"), "count").where("word <> ''") for t in ("danger", "amical_terms")]
    return collect.merged(*parts)


@query("a12_completeness", f"WITH s AS (SELECT article_idx, sent_idx, {S.sentence_hash('text')} AS sentence FROM ({_SENT})), f AS (SELECT DISTINCT article_idx FROM tokens WHERE reading = '*'), p AS (SELECT s.article_idx, count(*) AS n, f.article_idx IS NULL AS ok FROM s LEFT JOIN f USING (article_idx) GROUP BY ALL) SELECT article_idx, coalesce(n, 0) AS sentences, coalesce(ok, true) AS complete FROM articles LEFT JOIN p USING (article_idx)")
def a12(spark: SparkSession, d: str) -> DataFrame:
    failed = table(spark, d, "tokens").where("reading = '*'").select("article_idx").distinct().withColumn("failed", F.lit(True))
    by = _sentences(spark, d).join(failed, "article_idx", "left").groupBy("article_idx").agg(F.count(F.lit(1)).alias("sentences"), F.bool_and(c("failed").isNull()).alias("complete"))
    return table(spark, d, "articles").select("article_idx").join(by, "article_idx", "left").select("article_idx", F.coalesce("sentences", F.lit(0)).alias("sentences"), F.coalesce("complete", F.lit(True)).alias("complete"))


# ---------------------------------------------------------------- sweep

_DICT = f"SELECT word, count, row_number() OVER (ORDER BY count DESC, word) - 1 AS pos FROM ({_DANGER})"
STEP, CAP = 25, 400
_POINTS = f"SELECT DISTINCT n FROM (SELECT unnest(range(0, least((SELECT count(*) FROM ({_DANGER})), {CAP}), {STEP})) AS n UNION ALL SELECT least((SELECT count(*) FROM ({_DANGER})), {CAP}))"
_CURVE = f"WITH dict AS ({_DICT}), p AS ({_POINTS}) SELECT n, CAST(coalesce(sum(count) FILTER (pos >= n), 0) AS BIGINT) AS collisions, coalesce(sum(count) FILTER (pos >= n), 0)::DOUBLE / (SELECT count(DISTINCT cand_id) FROM candidates) AS rate FROM p, dict GROUP BY n"


def dictionary(spark: SparkSession, d: str) -> DataFrame:
    """(pos, word, count) in dictionary order."""
    return collect.positions(danger(spark, d))


def ranked_once(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """The dictionary, worked out once for all that a sweep asks of it, and its length."""
    words = persisted(dictionary(spark, d), "dictionary")
    return words, words.count()


def points(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.schedule(spark, danger(spark, d).count(), CAP, STEP)


def the_curve(spark: SparkSession, d: str) -> DataFrame:
    """The sweep: every reference is heard at every point of the schedule, with the first n words as a bias; a word of the bias is heard
    as it was said, all others as they were heard without one. Then the outcomes are counted by point."""
    words, n_words = ranked_once(spark, d)
    pts = persisted(evaluate.schedule(spark, n_words, CAP, STEP), "points")
    at = F.explode(F.array(*[F.lit(r["n"]) for r in pts.collect()]))  # at most CAP / STEP + 2
    heard = outcomes(spark, d, "reference_surface")
    known = broadcast_if_small(words.select(c("word").alias("reference_surface"), "pos"))
    cells = heard.join(known, "reference_surface", "left").select(at.alias("n"), "cand_id", "pos", "is_homophone")
    biased = cells.withColumn("is_homophone", c("is_homophone") & (c("pos") >= c("n")))
    return evaluate.curve(pts, biased, heard.select("cand_id").distinct().count())


query("o06_schedule", f"SELECT CAST(n AS INT) AS n FROM ({_POINTS})")(points)
query("a09_curve", f"SELECT CAST(n AS INT) AS n, collisions, rate FROM ({_CURVE})")(the_curve)
query("o01_ranked", f"SELECT pos, word, count FROM ({_DICT})")(dictionary)
_PLATEAU = f"SELECT min(prev) FILTER (run) AS recommended_n FROM (SELECT *, sum(flat) OVER w = 2 AND count(*) OVER w = 2 AS run FROM (SELECT n, lag(n) OVER (ORDER BY n) AS prev, coalesce(CAST(lag(rate) OVER (ORDER BY n) - rate < 0.005 AS INT), 0) AS flat FROM ({_CURVE})) WINDOW w AS (ORDER BY n ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING))"
query("w02_plateau", f"SELECT CAST(recommended_n AS INT) AS recommended_n FROM ({_PLATEAU})")(lambda s, d: evaluate.plateau(the_curve(s, d), 0.005, 2))
query("w03_final_n", f"SELECT CAST(coalesce((SELECT recommended_n FROM ({_PLATEAU})), max(n)) AS INT) AS final_n FROM ({_POINTS})")(lambda s, d: (lambda p: evaluate.final_n(p, evaluate.plateau(p, 0.005, 2)))(the_curve(s, d)))


@query("j11_prune", f"WITH dict AS ({_DICT}), c0 AS (SELECT DISTINCT reference_surface AS word FROM ({_OUTCOMES}) WHERE is_homophone), cf AS (SELECT DISTINCT reference_surface AS word FROM ({_OUTCOMES}) WHERE is_homophone AND speaker IS NULL) SELECT pos, word FROM dict WHERE pos < 100 AND word IN (SELECT word FROM c0) AND word NOT IN (SELECT word FROM cf)")
def j11(spark: SparkSession, d: str) -> DataFrame:
    o = outcomes(spark, d, "reference_surface", "speaker").where("is_homophone")
    return evaluate.pruned(dictionary(spark, d), o.select(c("reference_surface").alias("word")), o.where("speaker is null").select(c("reference_surface").alias("word")), 100)


# ---------------------------------------------------------------- sinks, logs, streams

query("k01_txt", f"SELECT word AS value FROM ({_DANGER})")(lambda s, d: sinks.txt_lines(danger(s, d)))
query("k02_counts", f"SELECT word || chr(9) || count AS value FROM ({_DANGER})")(lambda s, d: sinks.count_lines(danger(s, d)))
query("k04_reject_log", f"SELECT concat_ws(chr(9), reference_surface, hypothesis_surface, r, h) AS value FROM ({_OUTCOMES}) WHERE NOT is_homophone")(lambda s, d: sinks.reject_lines(collect.rejects(outcomes(s, d, "reference_surface", "hypothesis_surface"))))
query("k06_curve_tsv", f"SELECT printf('%d\t%d\t%.6f', n, collisions, rate) AS value FROM ({_CURVE})")(lambda s, d: sinks.curve_lines(the_curve(s, d)))
query("k08_refs_append", "WITH r AS (SELECT source || '/' || id AS audio, min(article_idx) AS i FROM articles WHERE batch_no >= 6 GROUP BY 1) SELECT audio FROM r WHERE audio NOT IN (SELECT source || '/' || id FROM articles WHERE batch_no < 6)")(
    lambda s, d: (lambda a: state.absent(a.where("batch_no >= 6").select("audio"), a.where("batch_no < 6"), "audio"))(table(s, d, "articles").select("batch_no", K.article_key(c("source"), c("id")).alias("audio")))
)


@query("s11_dictionary", f"SELECT dict_id, i - 1 AS pos, w AS word FROM (SELECT dict_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT dict_id, list_filter(list({S.trim('word')} ORDER BY pos, word, count), lambda w: w <> '') AS l FROM (SELECT DISTINCT dict_id, pos, word, count FROM amical_terms WHERE word IS NOT NULL) GROUP BY dict_id))")
def s11(spark: SparkSession, d: str) -> DataFrame:
    """Dictionaries as the texts they are kept in, a word and its count a line, read again."""
    rows = table(spark, d, "amical_terms").where("word is not null").select("dict_id", "pos", "word", "count").distinct()
    line = F.transform(F.array_sort(F.collect_list(F.struct("pos", "word", "count"))), lambda x: F.concat(x["word"], F.lit("\t"), F.coalesce(x["count"].cast("string"), F.lit(""))))
    texts = rows.groupBy("dict_id").agg(F.concat(F.array_join(line, "\n"), F.lit("\n")).alias("content"))
    return texts.select("dict_id", F.posexplode(logs.dictionary_words(c("content"))).alias("pos", "word")).withColumn("pos", c("pos").cast("bigint"))


@query("s03_markdown_items", "SELECT id, coalesce(title, '') AS title, greatest(coalesce(popularity, 0), 7) AS popularity FROM articles WHERE id <> '' QUALIFY row_number() OVER (ORDER BY article_idx) <= 100")
def s03(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "articles")
    items = a.select(c("article_idx").alias("seq"), F.to_json(F.struct("id", "title", "url", c("popularity").alias("stocks_count"), F.lit(7).alias("likes_count"), "body")).alias("payload"))
    return A.markdown_items(items, 1000).select("id", "title", "popularity")


@query("s04_html_items", f"SELECT article_idx AS seq, id, 'https://example.invalid/p/' || id AS url FROM articles WHERE id <> '' AND body_kind = 'Html' AND {S.trim('body')} <> ''")
def s04(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "articles").withColumn("slug", F.concat("id", F.lit("|"), c("article_idx").cast("string")))
    listing = a.select(c("article_idx").alias("seq"), F.to_json(F.struct("slug", "title", F.concat(F.lit("/p/"), "id").alias("path"), c("popularity").alias("liked_count"))).alias("payload"))
    details = a.where("body_kind = 'Html'").select("slug", F.to_json(F.struct(F.struct(c("body").alias("body_html")).alias("article"))).alias("payload"))
    rows = A.html_items(listing, details, 2**31 - 1, "https://example.invalid")
    return rows.select("seq", F.split_part("id", F.lit("|"), F.lit(1)).alias("id"), "url")


@query("st1_stream_dedup", f"SELECT DISTINCT {S.sentence_hash('text')} AS sentence FROM documents")
def st1(spark: SparkSession, d: str) -> DataFrame:
    """Distinct sentences of a stream over the documents, whatever arrives first."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    stream = _stream(spark, d, "documents", docs)
    out = new_path(spark, "st1")
    first = streaming.first_sentences(stream).select("sentence")
    q = first.writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("sentence string").parquet(f"{out}/rows")


def _is_dir(spark: SparkSession, d: str, name: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()


# ---------------------------------------------------------------- formats read back, keys, streams

columns("m13_speaker_key", "candidates", ["cand_id"], lambda: {"key": K.speaker_key(c("speaker"), F.coalesce("article_key", F.lit("")))}, {"key": "speaker || ':' || coalesce(article_key, '')"})
columns("m14_rate_key", "orders", ["o_orderkey"], lambda: {"key": K.rate_key(c("o_totalprice") / 100_000)}, {"key": S.rate_key("o_totalprice / 100000")})
columns("m19_words_per_minute", "orders", ["o_orderkey"], lambda: {"wpm": K.words_per_minute(c("o_totalprice") / 100_000)}, {"wpm": "CASE WHEN (o_totalprice / 100000)::FLOAT = 1 THEN NULL ELSE CAST(round(180 * (o_totalprice / 100000)::FLOAT::DOUBLE) AS INT) END"})
columns("m21_json", "lexicon", ["lex_id"], lambda: {"json": F.to_json(F.struct("surface", "reading"))}, {"json": "'{\"surface\":\"' || surface || '\",\"reading\":\"' || reading || '\"}'"})


_DICT_WORDS = "SELECT dict_id, list(word ORDER BY pos, word) AS words FROM (SELECT DISTINCT dict_id, pos, word FROM amical_terms WHERE word IS NOT NULL) GROUP BY dict_id"


@query("m16_biased_keys", f"SELECT dict_id, {S.content_key(S.lit('audio'), S.lit(MODEL), 'array_to_string(words, chr(31))')} AS key FROM ({_DICT_WORDS})")
def m16(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "amical_terms").where("word is not null").select("dict_id", "pos", "word").distinct()
    words = F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"])
    return rows.groupBy("dict_id").agg(words.alias("words")).select("dict_id", K.biased_key(F.lit("audio"), F.lit(MODEL), c("words")).alias("key"))


@query("s05_json_fields", "SELECT article_idx, coalesce(title, '') AS title, coalesce(popularity, 0) AS popularity FROM articles")
def s05(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "articles").select("article_idx", F.to_json(F.struct("title", "popularity")).alias("p"))
    return p.select("article_idx", A.text_or_empty(c("p"), "$.title").alias("title"), A.count_or_zero(c("p"), "$.popularity").alias("popularity"))


@query("s05_odd_counts", "SELECT article_idx, x AS form, CASE x WHEN 'string' THEN 0 WHEN 'negative' THEN 0 WHEN 'large' THEN popularity + 705032704 ELSE 0 END AS popularity FROM articles, (SELECT unnest(['string', 'negative', 'large', 'fraction', 'none', 'flag']) AS x) WHERE popularity < 1000000")
def s05_odd(spark: SparkSession, d: str) -> DataFrame:
    """Counts that are strings, negative, beyond 32 bits, fractions, missing or truth values."""
    n = c("popularity").cast("string")
    forms = {"string": F.concat(F.lit('{"n":"'), n, F.lit('"}')), "negative": F.concat(F.lit('{"n":-'), (c("popularity") + 1).cast("string"), F.lit("}")), "large": F.concat(F.lit('{"n":'), (c("popularity") + 5_000_000_000).cast("string"), F.lit("}")), "fraction": F.concat(F.lit('{"n":'), n, F.lit(".5}")), "none": F.lit("{}"), "flag": F.lit('{"n":true}')}
    rows = table(spark, d, "articles").where("popularity < 1000000").select("article_idx", "popularity", F.explode(F.array(*[F.struct(F.lit(k).alias("form"), v.alias("p")) for k, v in forms.items()])).alias("x"))
    return rows.select("article_idx", "x.form", A.count_or_zero(c("x.p"), "$.n").alias("popularity"))


@query("s11_json_dictionary", f"SELECT dict_id, i - 1 AS pos, w AS word FROM (SELECT dict_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT dict_id, list(word ORDER BY pos, word, count) AS l FROM (SELECT DISTINCT dict_id, pos, word, count FROM amical_terms WHERE word IS NOT NULL) GROUP BY dict_id))")
def s11_json(spark: SparkSession, d: str) -> DataFrame:
    """Dictionaries as JSON documents, every second term followed by one whose word is a number, a null or missing."""
    rows = table(spark, d, "amical_terms").where("word is not null").select("dict_id", "pos", "word", "count").distinct()
    odd = F.element_at(F.array(F.lit('{"word":5}'), F.lit('{"word":null,"count":1}'), F.lit('{"count":2}')), (F.pmod(c("x.pos"), F.lit(3)) + 1).cast("int"))
    listed = rows.groupBy("dict_id").agg(F.array_sort(F.collect_list(F.struct("pos", "word", "count"))).alias("xs")).select("dict_id", F.posexplode("xs").alias("i", "x"))
    term = F.concat(F.to_json(F.struct("x.word", "x.count")), F.when(c("i") % 2 == 1, F.concat(F.lit(","), odd)).otherwise(F.lit("")))
    texts = listed.select("dict_id", "i", term.alias("t")).groupBy("dict_id").agg(F.concat(F.lit('{"schema":"terms","terms":['), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda x: x["t"]), ","), F.lit("]}")).alias("content"))
    return texts.select("dict_id", F.posexplode(logs.dictionary_words(c("content"))).alias("pos", "word")).withColumn("pos", c("pos").cast("bigint"))


@query("s14_counts", "SELECT str_split(line, chr(9))[1] AS word, TRY_CAST(str_split(line, chr(9))[2] AS BIGINT) AS count FROM (SELECT coalesce(word, '') || chr(9) || coalesce(CAST(count AS VARCHAR), '') AS line FROM danger) WHERE len(str_split(line, chr(9))) = 2")
def s14(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.coalesce("word", F.lit("")), F.lit("\t"), F.coalesce(c("count").cast("string"), F.lit("")))
    return logs.two_fields(table(spark, d, "danger").select(line.alias("value")))


@query("s10_seen", "SELECT source || '/' || id AS article, NULL AS sentence FROM articles GROUP BY ALL")
def s10(spark: SparkSession, d: str) -> DataFrame:
    """The log of seen articles written as JSON lines and read again."""
    path = new_path(spark, "seen")
    table(spark, d, "articles").select(K.article_key(c("source"), c("id")).alias("article")).write.mode("overwrite").json(path)
    return logs.seen(spark, path)


@query("j04_schedule_refs", f"SELECT CAST(n AS INT) AS n, count(*) AS refs FROM ({_POINTS}), (SELECT DISTINCT article_key FROM candidates) GROUP BY n")
def j04(spark: SparkSession, d: str) -> DataFrame:
    pts = [r["n"] for r in points(spark, d).collect()]
    refs = table(spark, d, "candidates").select("article_key").distinct()
    return refs.withColumn("n", F.explode(F.array(*[F.lit(p) for p in pts]))).groupBy("n").agg(F.count(F.lit(1)).alias("refs"))


@query("o03_bias_words", f"SELECT CAST(n AS INT) AS n, count(*) FILTER (pos < n) AS words, string_agg(word, ' ' ORDER BY pos) FILTER (pos < n) AS prompt FROM ({_POINTS}), ({_DICT}) GROUP BY n")
def o03(spark: SparkSession, d: str) -> DataFrame:
    words, n = ranked_once(spark, d)
    rows = evaluate.bias_words(evaluate.schedule(spark, n, CAP, STEP), words)
    return rows.select("n", F.size("words").cast("bigint").alias("words"), K.bias_prompt(c("words")).alias("prompt"))


query("k07_prune_list", f"SELECT word AS value FROM ({_SQL['j11_prune']})")(lambda s, d: sinks.prune_lines(j11(s, d)))


@query("st2_running_dictionary", "SELECT reference_surface AS word, count(*) AS count FROM candidates WHERE is_homophone GROUP BY 1")
def st2(spark: SparkSession, d: str) -> DataFrame:
    """The dictionary kept while outcomes arrive; every batch replaces what was saved before."""
    rows = table(spark, d, "candidates").select("reference_surface", "is_homophone")
    out = new_path(spark, "st2")
    stream = _stream(spark, d, "candidates", rows)
    q = streaming.catch_up(streaming.running_dictionary(stream), lambda df, n: df.write.mode("overwrite").parquet(f"{out}/dictionary"), f"{out}/state", "complete")
    q.awaitTermination()
    return spark.read.schema("word string, count bigint").parquet(f"{out}/dictionary")


def _stream(spark: SparkSession, d: str, name: str, like: DataFrame) -> DataFrame:
    if _is_dir(spark, d, name):
        return spark.readStream.schema(like.schema).parquet(f"{d}/{name}.parquet")
    return spark.readStream.schema(like.schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


# ---------------------------------------------------------------- whole runs, caches, engines, orders


def _flat(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "articles").select("article_idx", "id", "source", "body_kind", "body", "dedup", "trusted")
    return a.withColumn("dedup", F.coalesce("dedup", F.lit(False))).withColumn("trusted", F.coalesce("trusted", F.lit(False)))


_TRUSTED = _SENT.replace("FROM articles)", "FROM articles WHERE coalesce(trusted, false))")
_OPEN = _SENT.replace("FROM articles)", "FROM articles WHERE NOT coalesce(trusted, false))")
_BY_TRUST = f"SELECT * FROM ({_extract_sql(LENIENT, _TRUSTED)}) UNION ALL SELECT * FROM ({_extract_sql(ExtractOptions(), _OPEN)})"
_PENDING_RUN = f"SELECT article_idx, sent_idx, {S.sentence_hash('text')} AS sentence FROM ({_BY_TRUST}) QUALIFY row_number() OVER (PARTITION BY {S.sentence_hash('text')} ORDER BY article_idx, sent_idx) = 1"


@query("x11_by_trust", f"SELECT article_idx, sent_idx FROM ({_BY_TRUST})")
def x11t(spark: SparkSession, d: str) -> DataFrame:
    return extract.extract_by_trust(_flat(spark, d)).select("article_idx", c("sent_idx").cast("bigint").alias("sent_idx"))


@query("s08_dry_run", f"SELECT article_idx, sent_idx FROM ({_PENDING_RUN})")
def s08(spark: SparkSession, d: str) -> DataFrame:
    """What a run would work on, were nothing seen before."""
    nothing = spark.createDataFrame([], "article string, sentence string")
    return harvest.pending(_flat(spark, d), nothing).select("article_idx", c("sent_idx").cast("bigint").alias("sent_idx"))


@query("h01_second_run", f"SELECT count(*) AS sentences, 2 * count(*) AS cells, 2 * count(*) AS audio_hits, 2 * count(*) AS asr_hits, 0 AS failures FROM ({_PENDING_RUN})")
def h01(spark: SparkSession, d: str) -> DataFrame:
    """Two runs through one folder of caches; the counters of the second, which finds all it needs there."""
    folder, voices = new_path(spark, "caches"), [VoiceSpec(ENGINE, v) for v in VOICES]
    nothing = spark.createDataFrame([], "article string, sentence string")
    for _ in range(2):
        out = harvest.run_cached(_flat(spark, d), nothing, voices, MODEL, folder, harvest.text_payload, harvest.echo, tokens.word_tokens)
    return out.metrics.withColumn("failures", c("failures").cast("int"))


@query("k09_seen_again", "SELECT DISTINCT source || '/' || id AS article, NULL AS sentence FROM articles")
def k09(spark: SparkSession, d: str) -> DataFrame:
    """The log of seen articles, written in two overlapping halves: each article once."""
    path = new_path(spark, "seen")
    a = table(spark, d, "articles").select("batch_no", K.article_key(c("source"), c("id")).alias("article"), F.lit(None).cast("string").alias("sentence"))
    for part in (a.where("batch_no < 8"), a.where("batch_no >= 4")):
        state.append_seen(part.select("article", "sentence"), logs.seen(spark, path), path)
    return logs.json_lines(spark, path, SEEN)


@query("k11_archive", "SELECT id AS slug, count(DISTINCT body) > 0 AS kept FROM articles WHERE body_kind = 'Html' AND body IS NOT NULL AND id IS NOT NULL GROUP BY 1")
def k11(spark: SparkSession, d: str) -> DataFrame:
    """Payloads kept twice over: one row an item."""
    path = new_path(spark, "archive")
    items = table(spark, d, "articles").where("body_kind = 'Html'").select(c("id").alias("slug"), c("body").alias("payload"))
    for _ in range(2):
        A.archived(items, path)
    return state.stored(spark, path, "slug string, payload string").groupBy("slug").agg((F.count("payload") == 1).alias("kept"))


query("o05_merged_order", f"SELECT row_number() OVER (ORDER BY count DESC, word) - 1 AS pos, word, count FROM ({_SQL['a11_merge']}) WHERE count IS NOT NULL")(lambda s, d: collect.positions(a11(s, d).where("count is not null")))


@query("s09_refs", _SQL["d03_first_refs"])
def s09(spark: SparkSession, d: str) -> DataFrame:
    """References written as JSON lines in their order and read again, the first of each audio."""
    path = new_path(spark, "refs")
    rows = table(spark, d, "articles").where("title is not null").select("article_idx", K.article_key(c("source"), c("id")).alias("audio"), c("title").alias("text"))
    rows.coalesce(1).sortWithinPartitions("article_idx").select("audio", "text").write.json(path)
    return logs.refs(spark, path).select("audio", "text")


@query("k03_term_document", f"SELECT pos, word, count FROM ({_DICT})")
def k03(spark: SparkSession, d: str) -> DataFrame:
    """The JSON document of all terms, written and read again."""
    out = io.StringIO()
    sinks.term_document(danger(spark, d), "terms", "general", "test", out)
    doc = spark.createDataFrame([(out.getvalue(),)], "content string")
    terms = F.from_json("content", "terms array<struct<word string, count bigint>>")["terms"]
    return doc.select(F.posexplode(terms).alias("pos", "t")).select(c("pos").cast("bigint").alias("pos"), "t.word", "t.count")


@query("s02_files", "SELECT 'file' AS source, 'Plain' AS body_kind, false AS dedup, true AS trusted, count(*) AS lines FROM lexicon")
def s02(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "files")
    table(spark, d, "lexicon").select("surface").coalesce(1).write.text(path)
    return A.files(spark, path).select("source", "body_kind", "dedup", "trusted", F.size(X.lines(c("body"))).cast("bigint").alias("lines"))


@query("e03_engine", "SELECT lex_id, surface, CASE WHEN length(surface) = 1 THEN NULL ELSE reverse(surface) END AS heard FROM lexicon")
def e03(spark: SparkSession, d: str) -> DataFrame:
    """An engine in Python that fails on texts of one character."""

    def make() -> Callable[[dict], object]:
        def call(row: dict) -> str:
            if len(row["surface"]) == 1:
                raise ValueError("too short")
            return row["surface"][::-1]

        return call

    return harvest.per_partition(make, "heard", "string")(table(spark, d, "lexicon").select("lex_id", "surface"))


@query("t04_table_tokens", "SELECT cand_id, reference_surface, l.reading FROM (SELECT DISTINCT cand_id, reference_surface FROM candidates) LEFT JOIN lexicon l ON surface = reference_surface")
def t04(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of whole sentences from a table; none for unknown ones."""
    known = table(spark, d, "lexicon").select(c("surface").alias("sentence"), F.array(tokens.token(c("surface"), c("reading"), F.lit(tokens.NOUN))).alias("tokens"))
    rows = table(spark, d, "candidates").select("cand_id", "reference_surface").distinct()
    return tokens.table_tokens(rows, "reference_surface", known).select("cand_id", "reference_surface", F.expr("try_element_at(tokens, 1)")["reading"].alias("reading"))


@query("t02_stored_tokens", "SELECT article_idx, sent_idx, count(*) AS tokens, string_agg(coalesce(surface, ''), '' ORDER BY tok_idx, token_id) AS surface FROM (SELECT DISTINCT token_id, article_idx, sent_idx, tok_idx, surface FROM tokens) GROUP BY ALL")
def t02(spark: SparkSession, d: str) -> DataFrame:
    t = tokens.stored_tokens(table(spark, d, "tokens"))
    return t.select("article_idx", "sent_idx", F.size("tokens").cast("bigint").alias("tokens"), F.array_join(F.transform("tokens", lambda x: F.coalesce(x["surface"], F.lit(""))), "").alias("surface"))


@query("t02_lattice")
def t02_lattice(spark: SparkSession, d: str) -> DataFrame:
    """All documents cut by least cost over the lexicon; a word costs less the longer it is, as long words are rarely chance."""
    lex = [(r["surface"], r["reading"], 12.0 - min(len(r["surface"]), 6)) for r in table(spark, d, "lexicon").toLocalIterator()]  # a word list
    t = table(spark, d, "documents").select("doc_id", F.explode(lattice.lattice_tokens(c("text"), lex)).alias("t"))
    return t.groupBy("doc_id").agg(F.count(F.lit(1)).alias("tokens"), F.count_if(c("t.pos") == "名詞").alias("known"), F.sum(F.char_length("t.surface")).alias("chars"))


@query("t06_whole_sentences")
def t06_whole(spark: SparkSession, d: str) -> DataFrame:
    """Whole sentences, repeated tokens and all, against misheard ones: every fifth token is lost, every seventh comes twice, every
    ninth is heard as another. Blocks of all kinds, by the diff; brute force in the tests."""
    p = tokens.stored_tokens(table(spark, d, "tokens")).withColumnRenamed("tokens", "reference")
    other = lambda t: tokens.token(F.concat(t["surface"], F.lit("#")), t["reading"], t["pos"])
    heard = F.flatten(F.transform("reference", lambda t, i: F.when(F.pmod(i, F.lit(5)) == 4, F.array().cast(TOKENS)).when(F.pmod(i, F.lit(7)) == 3, F.array(t, t)).when(F.pmod(i, F.lit(9)) == 5, F.array(other(t))).otherwise(F.array(t))))
    blocks = p.select("article_idx", "sent_idx", F.explode(diff.diff_rows(c("reference"), heard)).alias("b"))
    return blocks.groupBy("article_idx", "sent_idx").agg(F.sum(F.when(c("b.tag") == "equal", F.size("b.reference")).otherwise(0)).alias("equal_tokens"), F.count_if(c("b.tag") == "replace").alias("replaced"))
