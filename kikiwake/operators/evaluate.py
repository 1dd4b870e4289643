"""Sweep over dictionary sizes: collision curve, plateau, pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def schedule(spark: SparkSession, dict_len: int, max_words: int, step: int) -> DataFrame:
    """(n): 0, step, 2 step, … below the cap, then the cap. A row per point of a user's sweep."""
    cap, step = min(dict_len, max_words), max(1, step)
    return spark.range(0, max(cap, 1), step).union(spark.range(cap, cap + 1)).select(F.col("id").cast("int").alias("n")).distinct()


def bias_words(points: DataFrame, words: DataFrame) -> DataFrame:
    """(n, words): the first n words of words(pos, word), for every point."""
    hit = points.join(words, F.col("pos") < F.col("n"), "left")
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("pos", "word")))), lambda x: x["word"])
    return hit.groupBy("n").agg(listed.alias("words"))


def curve(points: DataFrame, outcomes: DataFrame, n_refs: int) -> DataFrame:
    """(n, collisions, rate) of outcomes(n, is_homophone); points without outcomes stay, the rate's base is all references."""
    hits = outcomes.where("is_homophone").groupBy("n").agg(F.count(F.lit(1)).alias("c"))
    c = F.coalesce("c", F.lit(0))
    return points.join(hits, "n", "left").select("n", c.alias("collisions"), (c / F.lit(float(n_refs))).alias("rate") if n_refs else F.lit(0.0).alias("rate"))


def plateau(points: DataFrame, min_delta: float, patience: int, group: list[str] | None = None) -> DataFrame:
    """(recommended_n) by group: the point before the first run of ``patience`` steps that each improve by less than min_delta; null
    where there is none. A curve has a row per point of its schedule, so its window is small."""
    group = group or []
    w = W.partitionBy(*group).orderBy("n")
    flat = points.withColumn("prev_n", F.lag("n").over(w)).withColumn("flat", F.coalesce((F.lag("rate").over(w) - F.col("rate") < min_delta).cast("int"), F.lit(0)))
    ahead = w.rowsBetween(0, max(patience, 1) - 1)
    run = flat.withColumn("run", (F.sum("flat").over(ahead) == patience) & (F.count(F.lit(1)).over(ahead) == patience) & F.lit(patience > 0))
    return run.groupBy(*group).agg(F.min(F.when(F.col("run"), F.col("prev_n"))).alias("recommended_n"))


def final_n(points: DataFrame, recommended: DataFrame, group: list[str] | None = None) -> DataFrame:
    """The recommended n, else the last point's."""
    group = group or []
    last = points.select(*group, F.col("n").cast("int").alias("last_n"), F.lit(None).cast("int").alias("recommended_n"))
    both = last.unionByName(recommended.select(*group, F.lit(None).cast("int").alias("last_n"), F.col("recommended_n").cast("int").alias("recommended_n")))
    return both.groupBy(*group).agg(F.coalesce(F.max("recommended_n"), F.max("last_n"), F.lit(0)).alias("final_n"))


def pruned(words: DataFrame, collided_first: DataFrame, collided_final: DataFrame, n: int) -> DataFrame:
    """(pos, word): the first n words that collided without a bias and no longer do, in dictionary order."""
    top = words.where(F.col("pos") < n)
    return top.join(collided_first.select("word").distinct(), "word", "left_semi").join(collided_final.select("word").distinct(), "word", "left_anti").select("pos", "word")
