"""Aligned sentences to classified replacements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.reading import normalize
from ..functions.text import is_blank
from ..types import LOOSE, NormalizeOptions
from . import diff


def join_surface(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: t["surface"]), "")


def join_reading(tokens: Column, opts: NormalizeOptions = LOOSE) -> Column:
    """Each token is normalized by itself: a long vowel doesn't reach over a token's edge."""
    return F.array_join(F.transform(tokens, lambda t: normalize(t["reading"], opts)), "")


def homophone(reference_reading: Column, hypothesis_reading: Column) -> Column:
    return F.coalesce((reference_reading != "") & (reference_reading == hypothesis_reading), F.lit(False))


def classify(df: DataFrame, block: str = "block", opts: NormalizeOptions = LOOSE) -> DataFrame:
    """Adds (reference_surface, hypothesis_surface, reference_reading, hypothesis_reading, is_homophone) for a replace block."""
    b = F.col(block)
    return (
        df.withColumn("reference_surface", join_surface(b["reference"]))
        .withColumn("hypothesis_surface", join_surface(b["hypothesis"]))
        .withColumn("reference_reading", join_reading(b["reference"], opts))
        .withColumn("hypothesis_reading", join_reading(b["hypothesis"], opts))
        .withColumn("is_homophone", homophone(F.col("reference_reading"), F.col("hypothesis_reading")))
    )


def process(pairs: DataFrame, reference: str = "reference", hypothesis: str = "hypothesis", opts: NormalizeOptions = LOOSE) -> DataFrame:
    """Token arrays of both sides to classified replacements; block_idx is their order within a pair."""
    keep = [c for c in pairs.columns if c not in (reference, hypothesis)]
    blocks = pairs.select(*keep, F.posexplode(diff.replacements(F.col(reference), F.col(hypothesis))).alias("block_idx", "block"))
    return classify(blocks, "block", opts).drop("block")


def process_rows(pairs: DataFrame, reference: str = "reference", hypothesis: str = "hypothesis", opts: NormalizeOptions = LOOSE) -> DataFrame:
    """As process, with equal stretches: kind is equal, homophone or non-homophone."""
    keep = [c for c in pairs.columns if c not in (reference, hypothesis)]
    rows = classify(pairs.select(*keep, F.posexplode(diff.diff_rows(F.col(reference), F.col(hypothesis))).alias("block_idx", "block")), "block", opts)
    kind = F.when(F.col("block.tag") == "equal", "equal").when(F.col("is_homophone"), "homophone").otherwise("non-homophone")
    shown = [F.when(F.col("kind") != "equal", F.col(c)).alias(c) for c in ("hypothesis_surface", "reference_reading", "hypothesis_reading")]
    return rows.withColumn("kind", kind).select(*keep, "block_idx", "kind", F.col("reference_surface").alias("surface"), *shown)


def paired_lines(reference: DataFrame, hypothesis: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Lines (key, line_no, text) of both sides by position; the longer side's rest and pairs of blanks are left out."""
    both = reference.select(key, "line_no", F.col(text).alias("reference")).join(hypothesis.select(key, "line_no", F.col(text).alias("hypothesis")), [key, "line_no"])
    return both.where(~(is_blank(F.col("reference")) & is_blank(F.col("hypothesis"))))
