"""Articles to filtered, deduplicated, capped sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..types import LENIENT, ExtractOptions


def sentences(articles: DataFrame) -> DataFrame:
    """One row per sentence: the columns of articles but body, and (sent_idx, text)."""
    keep = [c for c in articles.columns if c not in ("body", "body_kind")]
    parts = X.split_sentences(X.plain_text(F.col("body_kind"), F.col("body")))
    return articles.select(*keep, F.posexplode(parts).alias("sent_idx", "text"))


def long_enough(c: Column, o: ExtractOptions) -> Column:
    return F.char_length(c).between(o.min_len, o.max_len)


def passes(c: Column, o: ExtractOptions) -> Column:
    ok = long_enough(c, o)
    if o.min_japanese_ratio > 0:
        ok = ok & (X.japanese_ratio(c) >= o.min_japanese_ratio)
    return ok & ~X.has_residue(c) if o.check_residue else ok


def first_per_article(df: DataFrame, key: str = "article_idx") -> DataFrame:
    """Keep the first of sentences of one article that differ in white space only."""
    w = W.partitionBy(key, X.without_space(F.col("text"))).orderBy("sent_idx")
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def top_per_article(df: DataFrame, cap: int, key: str = "article_idx") -> DataFrame:
    """The sentences of the highest share of kanji, at most cap per article."""
    scored = df.withColumn("kanji_ratio", X.kanji_ratio(F.col("text")))
    w = W.partitionBy(key).orderBy(F.desc("kanji_ratio"), F.asc("sent_idx"))
    return scored.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= cap).drop("__n")


def extract(articles: DataFrame, options: ExtractOptions = ExtractOptions(), key: str = "article_idx") -> DataFrame:
    """(…, sent_idx, text, kanji_ratio). Sentences keep their order in sent_idx."""
    return top_per_article(first_per_article(sentences(articles).where(passes(F.col("text"), options)), key), options.max_per_article, key)


def extract_by_trust(articles: DataFrame, options: ExtractOptions = ExtractOptions()) -> DataFrame:
    """The strict profile for open sources, the lenient one for trusted input; one pass over the articles."""
    rows = sentences(articles)
    kept = first_per_article(rows.where(F.when(F.col("trusted"), passes(F.col("text"), LENIENT)).otherwise(passes(F.col("text"), options))))
    scored = kept.withColumn("kanji_ratio", X.kanji_ratio(F.col("text")))
    w = W.partitionBy("article_idx").orderBy(F.desc("kanji_ratio"), F.asc("sent_idx"))
    return scored.withColumn("__n", F.row_number().over(w)).where(F.col("trusted") | (F.col("__n") <= options.max_per_article)).drop("__n")
