"""Problem 8: stretches of a text that stand word for word in other records.

Method: fixed-block anchors. With ``min_len`` = 120 and blocks of 60 characters, any span of 120 holds one whole block of the grid
of the record it also stands in. The index has the non-overlapping blocks of all records; every rolling window of every record
probes it; hits are extended to maximal exact repeats.

1. Records with equal texts are folded to one representative first; a text with two or more ids is shared as a whole.
2. A Bloom filter (it holds no fingerprint that can be read back) is made of all blocks, so that only windows that may meet a block
   are shuffled. It has 16 bits a block; blocks of more than ``2**MAX_BLOOM_BITS`` bits (128 MB, 67 million blocks or 4 billion
   characters) are divided by ranges of their hashes, with a filter and a pass over the texts for each, so a filter never fills up.
3. Windows and blocks meet by hash. No pairs are made: each block keeps the least and greatest record that holds it, which tells
   for every window whether *another* record has it, at any number of holders.
4. Around the hits all spans of 120 are hashed with 128 bits; those whose hash occurs in two records are shared. Their union,
   joined where they overlap or touch, are the maximal stretches.

Edge cases: null and short texts share nothing (no rows); an id that comes twice is one record; ties don't arise (results are sets
of positions); an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import persisted

MAX_BLOOM_BITS = 30
UNION = 64  # partial filters that one task joins at most
SLICES = 64
_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _inverse(b: np.uint64) -> np.uint64:
    return np.uint64(pow(int(b), -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of a base and of its inverse modulo 2**64, grown as longer texts come."""

    def __init__(self, base: np.uint64):
        self.base, self.inv, self.n = base, _inverse(base), 0
        self.grow(4096)

    def grow(self, n: int) -> None:
        if n > self.n:
            n = max(n, 2 * self.n)
            with np.errstate(over="ignore"):
                for name, b in (("up", self.base), ("down", self.inv)):
                    a = np.full(n, b, np.uint64)
                    a[0] = 1
                    setattr(self, name, np.multiply.accumulate(a))
            self.n = n


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def rolling(codes: np.ndarray, width: int, powers: Powers) -> np.ndarray:
    """Hashes of all windows of that width."""
    n = len(codes)
    if n < width:
        return np.empty(0, np.uint64)
    powers.grow(n + 1)
    with np.errstate(over="ignore"):
        v = _mix(codes.astype(np.uint64) + powers.base) * powers.up[:n]
        p = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(v)])
        return _mix((p[width:] - p[:-width]) * powers.down[: n - width + 1])


def _slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    m = np.uint64((1 << bits) - 1)
    return (h & m).astype(np.int64), ((h >> np.uint64(32)) & m).astype(np.int64)


def _in_range(h: np.ndarray, k: int, ranges: int) -> np.ndarray:
    return (h >> np.uint64(20)) % np.uint64(ranges) == np.uint64(k) if ranges > 1 else np.ones(len(h), bool)


def bloom(docs: DataFrame, block: int, bits: int, k: int = 0, ranges: int = 1) -> np.ndarray:
    """The bits of all blocks of a range: made within partitions, joined slice by slice in rounds of UNION; what reaches the driver
    has a fixed size."""

    def local(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        powers, mine = Powers(_B1), np.zeros((1 << bits) // 8, np.uint8)
        for pdf in parts:
            for text in pdf["text"]:
                h = rolling(code_points(text), block, powers)[::block]
                for i in _slots(h[_in_range(h, k, ranges)], bits):
                    np.bitwise_or.at(mine, i >> 3, (128 >> (i & 7)).astype(np.uint8))
        part = TaskContext.get().partitionId()
        for n, s in enumerate(np.split(mine, SLICES)):
            if s.any():
                yield pd.DataFrame({"slice": [n], "part": [part], "packed": [zlib.compress(s.tobytes(), 1)]})

    def union(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((1 << bits) // SLICES // 8, np.uint8)
        for x in pdf["packed"]:
            out |= np.frombuffer(zlib.decompress(x), np.uint8)
        return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "part": [pdf["part"].iloc[0] // UNION], "packed": [zlib.compress(out.tobytes(), 1)]})

    schema = "slice int, part int, packed binary"
    parts, n = docs.select("text").mapInPandas(local, schema), docs.rdd.getNumPartitions()
    while True:
        parts = parts.groupBy("slice", F.floor(F.col("part") / UNION).alias("group")).applyInPandas(union, schema)
        n = -(-n // UNION)
        if n <= 1:
            break
    whole = np.zeros((1 << bits) // 8, np.uint8).reshape(SLICES, -1)
    for r in parts.toLocalIterator():  # SLICES rows
        whole[r["slice"]] |= np.frombuffer(zlib.decompress(r["packed"]), np.uint8)
    return whole.reshape(-1)


def shared_spans(docs: DataFrame, min_len: int = 120, max_bits: int = MAX_BLOOM_BITS) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, start_pos, end_pos), the maximal stretches of exact spans of min_len that other ids hold too."""
    spark = docs.sparkSession
    block = min_len // 2
    long = docs.select("doc_id", "text").where(F.char_length("text") >= min_len)
    keyed = persisted(long.select("doc_id", F.sha2("text", 256).alias("tid"), F.char_length("text").alias("n")), "spans-ids")
    groups = keyed.groupBy("tid").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.max("n").alias("n"))
    whole = keyed.join(groups.where("lo <> hi").select("tid"), "tid", "left_semi").select("doc_id", F.lit(0).alias("start_pos"), F.col("n").alias("end_pos")).distinct()
    reps = persisted(long.join(groups.select(F.col("lo").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]), "spans-reps")

    n_blocks = reps.agg(F.coalesce(F.sum(F.floor(F.char_length("text") / block)), F.lit(0)).alias("n")).first()["n"]
    ranges = max(1, math.ceil(16 * n_blocks / 2**max_bits))
    bits = min(max_bits, max(12, int(16 * n_blocks / ranges).bit_length()))

    def probe(k: int) -> DataFrame:
        held = spark.sparkContext.broadcast(bloom(reps, block, bits, k, ranges).tobytes())

        def near(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            powers, table = Powers(_B1), np.frombuffer(held.value, np.uint8)

            def has(i: np.ndarray) -> np.ndarray:
                return (table[i >> 3] >> (7 - (i & 7)).astype(np.uint8)) & 1 == 1

            for pdf in parts:
                ids, hs, ps = [], [], []
                for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                    h = rolling(code_points(text), block, powers)
                    at = np.flatnonzero(_in_range(h, k, ranges))
                    for i in (0, 1):
                        at = at[has(_slots(h[at], bits)[i])]
                    ids.append(np.full(len(at), doc_id, np.int64))
                    hs.append(h[at].view(np.int64))
                    ps.append(at.astype(np.int32))
                if ids:
                    yield pd.DataFrame({"h": np.concatenate(hs), "doc_id": np.concatenate(ids), "pos": np.concatenate(ps)})

        return persisted(reps.mapInPandas(near, "h bigint, doc_id bigint, pos int"), "spans-windows")

    # rows of one representative with two texts under one id stay one record: ids are compared, not rows
    windows = reduce(DataFrame.unionByName, [probe(k) for k in range(ranges)])
    on_grid = F.col("pos") % block == 0
    met = (
        windows.groupBy("h")
        .agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min(F.when(on_grid, F.col("doc_id"))).alias("b_lo"), F.max(F.when(on_grid, F.col("doc_id"))).alias("b_hi"))
        .where("lo <> hi and b_lo is not null")
    )
    hit = (F.col("b_lo") != F.col("doc_id")) | (F.col("b_hi") != F.col("doc_id"))
    hits = windows.join(met, "h").select("doc_id", "pos", hit.alias("hit"), on_grid.alias("own")).where("hit or own")
    # one bit a position, 64 to a number: what is collected of a record stays far below its text
    masks = hits.groupBy("doc_id", F.expr("pos >> 6").alias("chunk")).agg(*[F.coalesce(F.expr(f"bit_or(case when {c} then shiftleft(1L, pos & 63) end)"), F.lit(0).cast("bigint")).alias(c) for c in ("hit", "own")])
    by_doc = masks.groupBy("doc_id").agg(F.collect_list(F.struct("chunk", "hit", "own")).alias("masks"))

    def positions(masks: list, n: int) -> tuple[np.ndarray, np.ndarray]:
        chunks = np.array([m["chunk"] for m in masks], np.int64)
        words = np.array([(m["hit"], m["own"]) for m in masks], np.int64).reshape(-1, 2)
        bits = np.unpackbits(np.ascontiguousarray(words.T).view(np.uint8).reshape(2, len(chunks), 8), axis=2, bitorder="little").astype(bool)
        at = chunks[:, None] * 64 + np.arange(64)
        return at[bits[0]], at[bits[1]]

    def near(at: np.ndarray, n: int) -> np.ndarray:
        """Starts of spans that hold a window at one of these positions."""
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, np.maximum(at - (min_len - block), 0).clip(max=n), 1)
        np.add.at(edge, np.minimum(at + 1, n), -1)
        return np.cumsum(edge[:-1]) > 0

    def spans(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one, two = Powers(_B1), Powers(_B2)
        for pdf in parts:
            out = [], [], [], []
            for doc_id, text, masks_ in zip(pdf["doc_id"], pdf["text"], pdf["masks"]):
                codes = code_points(text)
                n = len(codes) - min_len + 1
                hit_, own = positions(masks_, n)
                at = np.flatnonzero(near(hit_, n) & near(own, n)) if n > 0 else ()
                if len(at):
                    for o, x in zip(out, (np.full(len(at), doc_id, np.int64), at.astype(np.int32), rolling(codes, min_len, one)[at].view(np.int64), rolling(codes, min_len, two)[at].view(np.int64))):
                        o.append(x)
            if out[0]:
                yield pd.DataFrame({k: np.concatenate(x) for k, x in zip(("doc_id", "start", "h1", "h2"), out)})

    cands = persisted(reps.join(by_doc, "doc_id").mapInPandas(spans, "doc_id bigint, start int, h1 bigint, h2 bigint"), "spans-candidates")
    twice = cands.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").select("h1", "h2")
    starts = cands.join(twice, ["h1", "h2"], "left_semi").select("doc_id", "start").distinct()
    w = W.partitionBy("doc_id").orderBy("start")
    fresh = F.coalesce(F.col("start") - F.lag("start").over(w) > min_len, F.lit(True)).cast("int")
    stretches = (
        starts.withColumn("fresh", fresh)
        .withColumn("island", F.sum("fresh").over(w))
        .groupBy("doc_id", "island")
        .agg(F.min("start").alias("start_pos"), (F.max("start") + min_len).cast("int").alias("end_pos"))
        .select("doc_id", "start_pos", "end_pos")
    )
    return whole.unionByName(stretches.join(whole.select("doc_id"), "doc_id", "left_anti"))


def shared_share(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, n_chars, shared_chars, shared) of every record, records without shared text included."""
    covered = spans.groupBy("doc_id").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("shared_chars"))
    n = F.char_length(F.coalesce("text", F.lit("")))
    out = docs.select("doc_id", n.alias("n_chars")).join(covered, "doc_id", "left").withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0)).cast("bigint"))
    return out.withColumn("shared", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(F.lit(0.0)))
