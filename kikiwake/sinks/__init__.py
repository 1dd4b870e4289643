"""Sinks: dictionary formats, reject log, curve, prune list. Lines are made by Spark; only the one JSON document is put together on
the driver, from rows streamed in order."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import IO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.collect import ranked


def txt_lines(danger: DataFrame) -> DataFrame:
    return ranked(danger).select(F.col("word").alias("value"))


def count_lines(danger: DataFrame) -> DataFrame:
    return ranked(danger).select(F.concat_ws("\t", "word", F.col("count").cast("string")).alias("value"))


def reject_lines(rejects: DataFrame, order: list[str] | None = None) -> DataFrame:
    rows = rejects.orderBy(*order) if order else rejects
    return rows.select(F.concat_ws("\t", "reference_surface", "hypothesis_surface", "reference_reading", "hypothesis_reading").alias("value"))


def curve_lines(points: DataFrame) -> DataFrame:
    return points.orderBy("n").select(F.format_string("%d\t%d\t%.6f", F.col("n").cast("int"), F.col("collisions").cast("bigint"), F.col("rate")).alias("value"))


def prune_lines(words: DataFrame) -> DataFrame:
    return words.orderBy("pos").select(F.col("word").alias("value"))


def term_document(danger: DataFrame, schema: str, field: str, generator: str, out: IO[str]) -> None:
    """A JSON document of terms, indented by two spaces, raw UTF-8, one line break at its end."""
    head = {"schema": schema, "version": 1, "field": field, "generator": generator}
    text = json.dumps({**head, "terms": []}, indent=2, ensure_ascii=False)
    rows = ({"word": r["word"], "count": r["count"]} for r in ranked(danger).toLocalIterator())
    first = next(rows, None)
    if first is None:
        out.write(text + "\n")
        return
    out.write(text[: text.rindex("[]")] + "[")
    item = first
    sep = "\n"
    while item is not None:
        body = json.dumps(item, indent=2, ensure_ascii=False).replace("\n", "\n    ")
        out.write(f"{sep}    {body}")
        sep, item = ",\n", next(rows, None)
    out.write("\n  ]\n}\n")


def write_dictionary(danger: DataFrame, out: IO[str], format: str | None = None, counts: bool = False, **document: str) -> None:
    """``format`` wins; else ``counts`` asks for counts; else plain words."""
    kind = format or ("counts" if counts else "txt")
    if kind == "json":
        term_document(danger, document.get("schema", "terms"), document.get("field", "general"), document.get("generator", "kikiwake"), out)
        return
    write_lines(txt_lines(danger) if kind == "txt" else count_lines(danger), out)


def write_lines(df: DataFrame, out: IO[str]) -> None:
    for v in _values(df):
        out.write(v + "\n")


def _values(df: DataFrame) -> Iterator[str]:
    return (r["value"] for r in df.toLocalIterator())


def write_text(df: DataFrame, path: str) -> None:
    """Distributed form of any of the line tables: sorted part files under path."""
    df.write.mode("overwrite").text(path)
