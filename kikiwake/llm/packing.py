"""Problem 6: items into containers of a fixed capacity.

Method: mixture-controlled packing by deficit round-robin. Items wait in one queue per source. In each container (window) the queues
are visited in turn, beginning where the window before left off: a visit adds the quantum, ``share x capacity``, to the queue's
deficit, and the queue gives its largest items that fit into the window and of which its deficit pays at least a half. What room is
left then is lent: the queue with the greatest deficit that has a fitting item gives its largest one, so that windows are full. What a queue
gives beyond its deficit is paid with the quanta to come, since below zero it gives nothing in its turn. (To give only items that the
deficit pays for in full would use up the small ones, which later windows need to be filled.) Deficits go on from window to window, and from partition to
partition: whatever the windows of the partitions before do, they leave a queue its share of all tokens there less its own tokens
there, up to the room left unused; that sum, from one row per (partition, source), is where a partition starts.

Items are spread over lanes by hash, so neither a source nor a key can fill one task: a lane holds about ``lane_tokens`` tokens and
at most ``lane_items`` items on average, at any size of the collection. Items above the capacity are cut into full pieces and one
rest; nothing else is split.

Edge cases: a null or empty text has size 0 and lies in a container too; a null source is a source of its own; repeated rows are
packed as often as they come; an empty table gives an empty result; ties go by (size, id); other columns aren't read.
"""

from __future__ import annotations

import math
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import persisted, running_total

CAPACITY = 2048
LANE_TOKENS, LANE_ITEMS, LANES_A_BUCKET = 2_000_000, 20_000, 4_096


def pieces(items: DataFrame, capacity: int) -> DataFrame:
    """items(item_id, source, size) -> (item_id, source, piece, start, size): full pieces of an oversized item and its rest."""
    n = F.greatest(F.ceil(F.col("size") / capacity), F.lit(1)).cast("int")
    cut = items.select("item_id", "source", F.col("size").alias("whole"), F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    start = F.col("piece").cast("bigint") * capacity
    return cut.select("item_id", "source", "piece", start.alias("start"), F.least(F.lit(capacity), F.col("whole") - start).cast("int").alias("size"))


def fill(sizes: list[int], sources: list[int], shares: np.ndarray, owed: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Container number and offset of every item of one lane, and the deficits left over.

    Per source the items stand in buckets by size; a table of the largest occupied size up to any bound makes each step cheap."""
    n = len(sizes)
    container, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    stacks: list[dict[int, list[int]]] = [{} for _ in shares]
    for i in range(n - 1, -1, -1):
        stacks[sources[i]].setdefault(sizes[i], []).append(i)
    ladder = [sorted(s) for s in stacks]
    quantum, deficit, left, k, turn = (shares * capacity).tolist(), owed.astype(float).tolist(), n, 0, 0

    def give(s: int, most: float) -> int:
        """The largest item of queue s of at most that size goes into the window; its size, -1 if there is none."""
        nonlocal room, left
        at = bisect_right(ladder[s], most) - 1
        if at < 0:
            return -1
        size = ladder[s][at]
        i = stacks[s][size].pop()
        if not stacks[s][size]:
            del stacks[s][size], ladder[s][at]
        container[i], offset[i] = k, capacity - room
        room -= size
        deficit[s] -= size
        left -= 1
        return size

    while left:
        room = capacity
        for j in range(len(ladder)):
            s = (turn + j) % len(ladder)
            deficit[s] += quantum[s]
            while ladder[s] and deficit[s] > 0 and give(s, min(room, 2 * deficit[s])) >= 0:
                pass
        turn = (turn + 1) % len(ladder)
        while left:
            s = max((s for s, sz in enumerate(ladder) if sz and sz[0] <= room), key=deficit.__getitem__, default=-1)
            if s < 0:
                break
            give(s, room)
        k += 1
    deficit = np.array(deficit)
    return container, offset, deficit


def pack(items: DataFrame, capacity: int = CAPACITY, targets: DataFrame | None = None, lane_tokens: int = LANE_TOKENS) -> DataFrame:
    """items(item_id, source, size) -> (container, item_id, source, piece, start, size, offset).

    ``targets`` (source, weight) are the wanted proportions of a window; without them, those of the collection, so that all
    queues run dry together. Every item is packed either way."""
    parts = persisted(pieces(items.select("item_id", "source", F.coalesce("size", F.lit(0)).alias("size")), capacity), "pack-pieces")
    full = parts.where(F.col("size") == capacity)
    rest = parts.where(F.col("size") < capacity)
    total = rest.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("t"), F.count(F.lit(1)).alias("n")).first()
    lanes = max(1, math.ceil(total["t"] / lane_tokens), math.ceil(total["n"] / LANE_ITEMS))
    h = F.xxhash64("item_id", "piece", "size")
    laned = rest.withColumn("lane", F.pmod(h, F.lit(lanes)).cast("bigint"))

    # a null source is a source of its own
    laned = laned.withColumn("queue", F.coalesce("source", F.lit("\u0000")))
    by = persisted(laned.groupBy("queue", "lane").agg(F.sum("size").alias("have")).withColumn("bucket", F.floor(F.col("lane") / LANES_A_BUCKET).cast("int")), "pack-lanes")
    share = by.groupBy("queue").agg(F.sum("have").alias("tokens"))
    if targets is None:
        share = share.select("queue", (F.col("tokens") / F.lit(max(total["t"], 1))).alias("share"))
    else:
        t = targets.select(F.coalesce("source", F.lit("\u0000")).alias("queue"), "weight")
        share = share.join(t, "queue", "left").select("queue", F.coalesce("weight", F.lit(0.0)).alias("share"))
    # what a source is owed when a lane starts: its share of all tokens in the lanes before, less its own there
    before = running_total(by.groupBy("lane", "bucket").agg(F.sum("have").alias("all")).withColumn("every", F.lit(0)), ["every"], ["lane"], "all", "all_before", "bucket").select("lane", "all_before")
    owed = running_total(by, ["queue"], ["lane"], "have", "own_before", "bucket").join(before, "lane").join(share, "queue")
    owed = owed.select("lane", F.struct("queue", "share", (F.col("share") * F.col("all_before") - F.col("own_before")).alias("owed")).alias("x"))
    plan = owed.groupBy("lane").agg(F.array_sort(F.collect_list("x")).alias("plan")).withColumnRenamed("lane", "plan_lane")

    def one(pdf: pd.DataFrame, plans: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "item_id", "piece"], kind="stable").reset_index(drop=True)
        plan = plans["plan"].iloc[0]
        number = {x["queue"]: k for k, x in enumerate(plan)}
        src = [number[x] for x in pdf["queue"]]
        c, o, _ = fill(pdf["size"].tolist(), src, np.array([x["share"] for x in plan]), np.array([x["owed"] for x in plan]), capacity)
        out = pdf[["item_id", "source", "piece", "start", "size"]].copy()
        out.insert(0, "container", [f"{lane}-{k}" for lane, k in zip(pdf["lane"], c)])
        return out.assign(offset=o)

    item_type = items.schema["item_id"].dataType.simpleString()
    schema = f"container string, item_id {item_type}, source string, piece int, start bigint, size int, offset bigint"
    packed = laned.withColumn("h", h).groupBy("lane").cogroup(plan.groupBy("plan_lane")).applyInPandas(one, schema)
    # repeated rows are told apart by their number, not by where a task ran
    copies = full.groupBy("item_id", "source", "piece", "start", "size").agg(F.count(F.lit(1)).alias("n")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    name = F.concat_ws("-", F.lit("full"), F.col("item_id").cast("string"), F.coalesce("source", F.lit("")), F.col("piece").cast("string"), F.col("copy").cast("string"))
    alone = copies.select(name.alias("container"), "item_id", "source", "piece", "start", "size", F.lit(0).cast("bigint").alias("offset"))
    return packed.unionByName(alone)


def report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per container: (container, used, items, fill)."""
    return packed.groupBy("container").agg(F.sum("size").alias("used"), F.count(F.lit(1)).alias("items")).withColumn("fill", F.col("used") / F.lit(capacity))
