"""Tallies of classified replacements: the dictionary, the rejects, and the vote by distinct speakers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def danger(outcomes: DataFrame, order: list[str | Column]) -> DataFrame:
    """(word, reading, count) of the homophones; the reading is the first in ``order``. One shuffle, combined before it."""
    first = F.min_by("reference_reading", F.struct(*order))
    return outcomes.where("is_homophone").groupBy(F.col("reference_surface").alias("word")).agg(first.alias("reading"), F.count(F.lit(1)).alias("count"))


def rejects(outcomes: DataFrame) -> DataFrame:
    return outcomes.where("not is_homophone").select("reference_surface", "hypothesis_surface", "reference_reading", "hypothesis_reading")


def ranked(words: DataFrame) -> DataFrame:
    return words.orderBy(F.desc("count"), F.asc("word"))


def positions(words: DataFrame) -> DataFrame:
    """(pos, word, count) in the order of ``ranked``. Words are ranked within their count, so that no task holds them all; one row per
    distinct count meets in one place."""
    rows = words.withColumn("neg", -F.col("count"))
    per = rows.groupBy("neg").agg(F.count(F.lit(1)).alias("n"))
    before = per.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("neg").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(W.partitionBy("neg").orderBy("word")) - 1
    return rows.withColumn("rank", rank).join(before, "neg").select((F.col("rank") + F.col("before")).cast("bigint").alias("pos"), "word", "count")


def pair_votes(outcomes: DataFrame, speaker: str = "speaker") -> DataFrame:
    """(reference_surface, hypothesis_surface, speakers, outcomes) of the homophones. Distinct speakers are reduced before they are
    counted, so that a hot pair holds a row per speaker, not per outcome."""
    by_speaker = outcomes.where("is_homophone").groupBy("reference_surface", "hypothesis_surface", speaker).agg(F.count(F.lit(1)).alias("n"))
    return by_speaker.groupBy("reference_surface", "hypothesis_surface").agg(F.count(speaker).alias("speakers"), F.sum("n").alias("outcomes"))


def passed(outcomes: DataFrame, min_votes: int, speaker: str = "speaker") -> DataFrame:
    """Outcomes of pairs that enough speakers agree on, and all non-homophones."""
    ok = pair_votes(outcomes, speaker).where(F.col("speakers") >= min_votes).select("reference_surface", "hypothesis_surface")
    kept = outcomes.where("is_homophone").join(ok, ["reference_surface", "hypothesis_surface"], "left_semi")
    return kept.unionByName(outcomes.where("not is_homophone"))


def vote_summary(votes: DataFrame, min_votes: int) -> DataFrame:
    return votes.agg(F.count_if(F.col("speakers") >= min_votes).alias("passed_pairs"), F.count_if(F.col("speakers") < min_votes).alias("dropped_pairs"))


def dropped(votes: DataFrame, min_votes: int) -> DataFrame:
    return votes.where(F.col("speakers") < min_votes).select("reference_surface", "hypothesis_surface", "speakers")


def min_votes(voices: DataFrame) -> DataFrame:
    """2 where there are two or more speakers, else 1."""
    return voices.agg(F.when(F.count_distinct("speaker") >= 2, 2).otherwise(1).alias("min_votes"))


def merged(*counts: DataFrame) -> DataFrame:
    """(word, count) tables of several runs as one."""
    out = counts[0].select("word", "count")
    for c in counts[1:]:
        out = out.unionByName(c.select("word", "count"))
    return out.groupBy("word").agg(F.sum("count").alias("count"))
