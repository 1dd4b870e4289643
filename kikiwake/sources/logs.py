"""JSON-lines logs, dictionaries, counts and line pairs. Broken rows are skipped, missing files are empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import lines, trim
from ..types import REFS, SEEN


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def refs(spark: SparkSession, path: str) -> DataFrame:
    """(audio, text), the first row of each audio in the order of the file."""
    rows = json_lines(spark, path, REFS).where("audio is not null and text is not null").withColumn("seq", F.monotonically_increasing_id())
    return rows.groupBy("audio").agg(F.min_by("text", "seq").alias("text"), F.min("seq").alias("seq"))


def seen(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, SEEN).where("article is not null or sentence is not null").distinct()


def dictionary_words(content: Column) -> Column:
    """Words of a dictionary text in order, repeats kept: a JSON document's terms, or the first tab-separated field of each line.
    Terms whose word is no string are skipped; a document without a list of terms is an error."""
    terms = F.variant_get(F.try_parse_json(content), "$.terms", "array<variant>")
    word = F.transform(terms, lambda t: F.struct(F.schema_of_variant(F.variant_get(t, "$.word", "variant")).alias("kind"), F.try_variant_get(t, "$.word", "string").alias("word")))
    strings = F.transform(F.filter(word, lambda w: w["kind"] == "STRING"), lambda w: w["word"])
    flat = F.transform(lines(content), lambda x: trim(F.split_part(trim(x), F.lit("\t"), F.lit(1))))
    document = F.coalesce(strings, F.raise_error(F.lit("a dictionary document without terms")).cast("array<string>"))
    return F.when(trim(content).startswith("{"), document).otherwise(F.filter(flat, lambda w: w != ""))


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(pos, word)."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(dictionary_words(F.col("value"))).alias("pos", "word"))


def counts(spark: SparkSession, path: str) -> DataFrame:
    """(word, count) of tab-separated lines with exactly two fields."""
    return two_fields(spark.read.text(path))


def two_fields(rows: DataFrame) -> DataFrame:
    """(word, count) of lines (value) with exactly two fields."""
    f = F.split(F.col("value"), "\t", -1)
    return rows.where(F.size(f) == 2).select(f[0].alias("word"), f[1].try_cast("bigint").alias("count"))


def numbered_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, text) of a column of whole texts."""
    return df.select(key, F.posexplode(lines(F.col(text))).alias("line_no", "text"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, text) of whole text files."""
    return numbered_lines(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value"), "file", "value")
