"""Queries of the training-data problems; oracle() has SQL where SQL can say the same over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import persisted, table
from . import blocks, history, lookalike, mixing, packing, sentences, sizes, spans, terms


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = table(spark, sf_dir, "articles").where("body_kind = 'Plain'")
    return sentences.sentences(plain.select("article_idx", F.col("body").alias("text")), "article_idx")


def p2_ledger(spark: SparkSession, sf_dir: str) -> tuple[terms.TermLedger, int]:
    """The danger and dictionary words as facts, taken in as two batches: the rows loaded in the first half of the time, then the rest."""
    danger, dicts = table(spark, sf_dir, "danger"), table(spark, sf_dir, "amical_terms")
    d = danger.select(
        F.concat(F.lit("e:"), F.col("entry_id").cast("string")).alias("fact_id"), F.concat(F.lit("a:"), "article_key").alias("record"),
        F.col("word").alias("term"), F.col("count").alias("amount"), F.col("loaded_at").alias("version"), F.lit(False).alias("deleted"),
    )
    m = dicts.select(
        F.concat(F.lit("d:"), "dict_id", F.lit(":"), F.col("pos").cast("string")).alias("fact_id"), F.concat(F.lit("d:"), "dict_id").alias("record"),
        F.col("word").alias("term"), F.col("count").alias("amount"), F.lit(None).cast("timestamp").alias("version"), F.lit(False).alias("deleted"),
    )
    half = danger.agg((F.min(F.col("loaded_at").cast("double")) / 2 + F.max(F.col("loaded_at").cast("double")) / 2).alias("t")).first()["t"]
    early = F.coalesce(F.col("version").cast("double") <= F.lit(half), F.lit(True))
    ledger = terms.TermLedger(spark)
    ledger.apply(d.where(early).unionByName(m))
    ledger.apply(d.where(~early))
    return ledger, ledger.n_records(d.select("record").unionByName(m.select("record")))


def p2_withdrawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts after a third batch that takes back every entry that came without a count."""
    ledger, _ = p2_ledger(spark, sf_dir)
    gone = table(spark, sf_dir, "danger").where("count is null and entry_id is not null").select("entry_id").distinct()
    none = F.lit(None)
    ledger.apply(gone.select(
        F.concat(F.lit("e:"), F.col("entry_id").cast("string")).alias("fact_id"), none.cast("string").alias("record"), none.cast("string").alias("term"),
        none.cast("bigint").alias("amount"), F.lit("9999-01-01").cast("timestamp").alias("version"), F.lit(True).alias("deleted"),
    ))
    return ledger.counts()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger, n = p2_ledger(spark, sf_dir)
    return terms.marks(ledger.counts(), n)


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_ledger(spark, sf_dir)[0].counts()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending = table(spark, sf_dir, "pending").select(F.col("article_idx").alias("idx"), F.col("article_key").alias("key"), "sentences", "batch_no")
    batches = [r["batch_no"] for r in pending.select("batch_no").distinct().orderBy("batch_no").collect()]  # one value per delivery
    past, out = history.History(spark), None
    for b in batches:
        repeats = past.add(pending.where(F.col("batch_no").eqNullSafe(F.lit(b))))
        out = repeats if out is None else out.unionByName(repeats)
    return out if out is not None else spark.createDataFrame([], "idx_a bigint, idx_b bigint")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens, cands, lex = table(spark, sf_dir, "tokens"), table(spark, sf_dir, "candidates"), table(spark, sf_dir, "lexicon")

    def rows(df: DataFrame, key: str, column: str, kind: str) -> DataFrame:
        return df.select(F.lit(column).alias("field"), F.col(key).alias("row_id"), F.col(column).alias("value"), F.lit(kind).alias("kind"))

    values = rows(tokens, "token_id", "surface", "surface").unionByName(rows(tokens, "token_id", "reading", "reading")).unionByName(rows(cands, "cand_id", "hypothesis_surface", "surface"))
    forms = lex.select(F.lit("surface").alias("kind"), F.col("surface").alias("lex_form")).unionByName(lex.select(F.lit("reading").alias("kind"), F.col("reading").alias("lex_form")))
    return lookalike.lookalikes(values, forms)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = table(spark, sf_dir, "articles").where("body_kind is null or body_kind <> 'Plain'")
    return blocks.blocks(marked.select("article_idx", "body"), "article_idx")


def doc_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return persisted(table(spark, sf_dir, "documents").select("doc_id", "source", sizes.n_tokens(F.col("text")).alias("size")), "sizes")


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(doc_sizes(spark, sf_dir).withColumnRenamed("doc_id", "item_id"))
    return packed.withColumnRenamed("item_id", "doc_id")


def p6_steered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed with the weights of mix_targets as the wanted proportions of every window, as long as the queues last."""
    packed = packing.pack(doc_sizes(spark, sf_dir).withColumnRenamed("doc_id", "item_id"), targets=table(spark, sf_dir, "mix_targets"))
    return packed.withColumnRenamed("item_id", "doc_id")


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(p6_pack(spark, sf_dir))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(doc_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(doc_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets"))[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_spans(table(spark, sf_dir, "documents"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return spans.shared_share(docs, spans.shared_spans(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p2_found": p2_found, "p2_counts": p2_counts, "p2_withdrawn": p2_withdrawn, "p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found, "p6_pack": p6_pack, "p6_fill": p6_fill, "p6_steered": p6_steered, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_shares": p8_shares}


_WS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_P2 = rf"""
WITH e AS (SELECT * FROM danger QUALIFY entry_id IS NULL OR row_number() OVER (PARTITION BY entry_id ORDER BY loaded_at DESC NULLS LAST, count DESC NULLS LAST, article_key DESC, word DESC) = 1),
m AS (SELECT * FROM amical_terms QUALIFY row_number() OVER (PARTITION BY dict_id, pos ORDER BY count DESC NULLS LAST, word DESC) = 1),
f AS (SELECT 'a:' || article_key AS record, word, count FROM e UNION ALL SELECT 'd:' || dict_id, word, count FROM m),
n AS (SELECT (SELECT count(DISTINCT article_key) FROM danger) + (SELECT count(DISTINCT dict_id) FROM amical_terms) AS n),
t AS (SELECT regexp_replace(word, '^{_WS}+|{_WS}+$', '', 'g') AS word, record, count FROM f),
c AS (SELECT word, CAST(coalesce(sum(count), 0) AS BIGINT) AS occurrences, count(DISTINCT record) AS records FROM t WHERE word <> '' GROUP BY word)
"""


def oracle() -> dict[str, str]:
    return {
        "p2_found": _P2 + "SELECT word, 'rare' AS mark FROM c WHERE occurrences < 5 UNION ALL SELECT word, 'common' FROM c, n WHERE records > n.n / 10.0",
        "p2_withdrawn": _P2.replace("UNION ALL SELECT 'd:'", "WHERE entry_id IS NULL OR entry_id NOT IN (SELECT entry_id FROM danger WHERE count IS NULL AND entry_id IS NOT NULL) UNION ALL SELECT 'd:'") + "SELECT word AS term, occurrences, records FROM c",
        "p2_counts": _P2 + "SELECT word AS term, occurrences, records FROM c",
    }
