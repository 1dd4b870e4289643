"""Tokenizers as column builders: text column in, array of (surface, reading, pos) out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.reading import to_katakana
from ..session import broadcast_if_small
from ..types import TOKENS

NOUN = "名詞"


def token(surface: Column, reading: Column, pos: Column) -> Column:
    return F.struct(surface.alias("surface"), reading.alias("reading"), pos.alias("pos"))


def reading_or_kana(surface: Column, reading: Column) -> Column:
    """The analyzer's reading, or the surface in katakana where it has none."""
    return F.when(reading.isNull() | reading.isin("", "*"), to_katakana(surface)).otherwise(reading)


def char_tokens(c: Column, readings: dict[str, str] | None = None) -> Column:
    """One token per character, with a reading from the table or the character itself."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    if not readings:
        return F.transform(chars, lambda x: token(x, x, F.lit(NOUN)))
    known = F.create_map(*[F.lit(x) for kv in sorted(readings.items()) for x in kv])
    return F.transform(chars, lambda x: token(x, F.coalesce(F.try_element_at(known, x), x), F.lit(NOUN)))


def word_tokens(c: Column) -> Column:
    """White-space words, read by the fallback rule."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"(\S+)")), lambda x: token(x, to_katakana(x), F.lit("*")))


def table_tokens(df: DataFrame, column: str, table: DataFrame, out: str = "tokens") -> DataFrame:
    """Tokens looked up by whole sentence in table(sentence, tokens); none for unknown sentences."""
    t = broadcast_if_small(table.select(F.col("sentence").alias(column), F.col("tokens").alias(out)))
    return df.join(t, column, "left").withColumn(out, F.coalesce(out, F.array().cast(TOKENS)))


def stored_tokens(rows: DataFrame) -> DataFrame:
    """Token rows (article_idx, sent_idx, tok_idx, token_id, …), delivered once or more, as one array per sentence."""
    once = rows.dropDuplicates(["token_id"])
    t = F.struct("tok_idx", "token_id", token(F.col("surface"), reading_or_kana(F.col("surface"), F.col("reading")), F.col("pos")).alias("t"))
    return once.groupBy("article_idx", "sent_idx").agg(F.transform(F.array_sort(F.collect_list(t)), lambda x: x["t"]).alias("tokens"))


def lexicon_tokens(c: Column, lexicon: list[tuple[str, str]]) -> Column:
    """Greedy longest match over a bounded word list; what no word covers comes character by character."""
    words = dict(lexicon)
    longest = max(map(len, words), default=1)

    @F.pandas_udf(TOKENS)
    def cut(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda v: None if v is None else list(_longest(v, words, longest)))

    return cut(c)


def _longest(s: str, words: dict[str, str], longest: int) -> Iterator[dict[str, str]]:
    k = 0
    while k < len(s):
        n = next((n for n in range(min(longest, len(s) - k), 0, -1) if s[k : k + n] in words), 1)
        w = s[k : k + n]
        k += n
        if not w.isspace():
            yield {"surface": w, "reading": words.get(w, "".join(chr(ord(x) + 0x60) if 0x3041 <= ord(x) <= 0x3096 else x for x in w)), "pos": NOUN if w in words else "*"}
