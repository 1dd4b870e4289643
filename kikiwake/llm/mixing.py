"""Problem 7: sources mixed to target weights.

Method: a low-discrepancy schedule. The records of each source are shuffled by hash and cut into blocks of equal tokens; slot i of
the mixture takes the source at which the golden-ratio point frac((i + 1) * 0.618...) falls in the cumulative weights; the r-th slot
of a source is joined with its r-th block. So every stretch of the mixture is close to the weights, not only its whole.

Total size: the largest at which every source reaches its weight within ``max_repeats`` uses of a record. Sources without any
tokens, and those so scarce that the total would fall below ``min_fraction`` of all tokens there are, are used up to their cap
instead, and the others keep their proportions; the report shows each source's wanted and real share.

Edge cases: a source that isn't listed, or null, isn't mixed; a listed source without records gets share 0; weight or max_repeats
null or <= 0 means not used; null or empty texts have size 0 and are never chosen; repeated rows are records of their own; an
empty table gives an empty mixture and a report of zeros; other columns aren't read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, persisted, running_total

GOLDEN = 0.6180339887498949
BLOCK_TOKENS = 2_048
BUCKET_ROWS = 50_000


def quotas(have: dict[str, int], weights: dict[str, float], repeats: dict[str, int], total: int | None = None, min_fraction: float = 0.02) -> dict[str, float]:
    """Tokens each source gives. have: tokens by source."""
    cap = {s: have.get(s, 0) * repeats[s] for s in weights}
    out = {s: 0.0 for s in weights}
    open_ = {s for s in weights if cap[s] > 0}
    floor = min_fraction * sum(have.get(s, 0) for s in weights)
    while open_:
        w = sum(weights[s] for s in open_)
        spent = sum(out.values())
        reach = {s: cap[s] / (weights[s] / w) for s in open_}
        want = total - spent if total is not None else min(reach.values())
        scarce = {s for s in open_ if reach[s] < (want if total is not None else floor)}
        if not scarce:
            for s in open_:
                out[s] = max(0.0, want) * weights[s] / w
            break
        s = min(scarce, key=lambda x: (reach[x], x))
        out[s] = float(cap[s])
        open_.discard(s)
    return out


def mix(sizes: DataFrame, targets: DataFrame, total: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 7, min_fraction: float = 0.02) -> tuple[DataFrame, DataFrame]:
    """sizes(doc_id, source, size), targets(source, weight, max_repeats) -> the mixture (slot, source, block, repeat, doc_id, size,
    position) in which ``slot`` orders blocks and ``position`` the uses of a source, and the report by source."""
    spark = sizes.sparkSession
    t = targets.where("source is not null and weight > 0 and max_repeats > 0").groupBy("source").agg(F.sum("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    rows = t.collect()  # one row per listed source, as everything below that reaches the driver
    listed = broadcast_if_small(t)
    docs = persisted(sizes.where("size > 0").join(listed.select("source"), "source", "left_semi").select("doc_id", "source", "size").withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size")), "mix-docs")
    stats = {r["source"]: (r["n"], r["rows"]) for r in docs.groupBy("source").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows")).collect()}
    have = {s: n for s, (n, _) in stats.items()}
    weights, repeats = {r["source"]: r["weight"] for r in rows}, {r["source"]: r["max_repeats"] for r in rows}
    quota = quotas(have, weights, repeats, total, min_fraction)

    plan = [(s, float(have.get(s, 0)), int(min(repeats[s], quota[s] // have[s])) if have.get(s) else 0) for s in weights]
    plan = [(s, int(n), k, float(quota[s] - k * n) if k < repeats[s] else 0.0) for s, n, k in plan]
    plan_df = broadcast_if_small(spark.createDataFrame(plan, "source string, tokens bigint, whole int, rest double"))

    buckets = max(1, math.ceil(sum(r for _, r in stats.values()) / BUCKET_ROWS))
    spread = docs.withColumn("bucket", F.floor((F.col("h") / F.lit(2.0**64) + F.lit(0.5)) * buckets).cast("int"))
    ordered = running_total(spread, ["source"], ["h", "doc_id"], "size", "before", "bucket").join(plan_df, "source")
    uses = F.col("whole") + (F.col("before") + F.col("size") / 2 <= F.col("rest")).cast("int")
    used = ordered.withColumn("uses", uses).where("uses > 0").select("source", "doc_id", "size", "before", "tokens", F.explode(F.sequence(F.lit(0), F.col("uses") - 1)).alias("repeat"))
    placed = used.withColumn("position", F.col("repeat") * F.col("tokens") + F.col("before")).withColumn("block", F.floor(F.col("position") / block_tokens))
    placed = persisted(placed.select("source", "doc_id", "size", "repeat", "position", "block"), "mix-uses")

    last = {r["source"]: r["n"] for r in placed.groupBy("source").agg((F.max("block") + 1).alias("n")).collect()}
    n_slots = sum(last.values())
    slots = persisted(schedule(spark, {s: last[s] for s in sorted(last)}, n_slots), "mix-slots")
    # blocks that found no slot (a source's slots may lack a few) are numbered behind the schedule, source by source
    given = {r["source"]: r["n"] for r in slots.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    end, late = n_slots + slack(last), []
    for s in sorted(last):
        late.append((s, end - given.get(s, 0)))
        end += max(0, last[s] - given.get(s, 0))
    behind = broadcast_if_small(spark.createDataFrame(late, "source string, behind bigint"))
    mixed = placed.join(slots, ["source", "block"], "left").join(behind, "source").withColumn("slot", F.coalesce("slot", F.col("behind") + F.col("block")))
    mixture = mixed.select("slot", "source", "block", "repeat", "doc_id", "size", "position")

    got = {r["source"]: r for r in placed.groupBy("source").agg(F.sum("size").alias("used"), F.count(F.lit(1)).alias("uses"), (F.max("repeat") + 1).alias("most")).collect()}
    all_used = sum(r["used"] for r in got.values())
    rows = [
        (s, float(weights[s]), int(repeats[s]), int(have.get(s, 0)), float(quota[s]), *((got[s]["used"], got[s]["uses"], got[s]["most"], got[s]["used"] / all_used) if s in got else (0, 0, 0, 0.0)))
        for s in sorted(weights)
    ]
    return mixture, spark.createDataFrame(rows, "source string, weight double, max_repeats int, tokens bigint, quota double, used_tokens bigint, uses bigint, most_uses int, share double")


def slack(blocks: dict[str, int]) -> int:
    """Slots beside those that are needed: a source's slots keep within a few of its share; slots without a block stay empty."""
    return 4 * len(blocks) + 16


def schedule(spark, blocks: dict[str, int], n_slots: int, chunk: int = 1 << 16) -> DataFrame:  # noqa: ANN001
    """(slot, source, block): slot i takes the source of the i-th golden-ratio point; block is the slot's rank among its source's."""
    if not n_slots:
        return spark.createDataFrame([], "slot bigint, source string, block bigint")
    edges, upto = [], 0
    for s, n in blocks.items():
        upto += n
        edges.append((upto / n_slots, s))
    bounds, names = np.array([e for e, _ in edges[:-1]]), np.array([s for _, s in edges], object)

    @F.pandas_udf("string")
    def source_at(point: pd.Series) -> pd.Series:
        return pd.Series(names[np.searchsorted(bounds, point.to_numpy(), side="right")])

    point = (F.col("id") + 1) * F.lit(GOLDEN)
    base = spark.range(n_slots + slack(blocks)).select(F.col("id").alias("slot"), source_at(point - F.floor(point)).alias("source"), F.lit(1).alias("step"))
    ranked = running_total(base.withColumn("part", F.floor(F.col("slot") / chunk).cast("int")), ["source"], ["slot"], "step", "block", "part")
    return ranked.select("slot", "source", "block")
