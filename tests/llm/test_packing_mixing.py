from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kikiwake.llm import mixing as M
from kikiwake.llm import packing as P
from kikiwake.llm import sizes


def items(spark, n, seed=0):
    rnd = random.Random(seed)
    rows = [(k, "hot" if rnd.random() < 0.5 else rnd.choice(["a", "b", None]), rnd.choice([0, 1, rnd.randrange(100), rnd.randrange(100), 100, 250])) for k in range(n)]
    return rows, spark.createDataFrame(rows, "item_id bigint, source string, size int")


@pytest.mark.parametrize("lane_tokens", [2_000, 10**9])
def test_pack(spark, lane_tokens):
    rows, df = items(spark, 600)
    got = P.pack(df.withColumn("container", F.lit(1)), 100, lane_tokens=lane_tokens).collect()
    held, spans = defaultdict(list), defaultdict(list)
    for r in got:
        held[r["container"]].append((r["offset"], r["size"]))
        spans[r["item_id"]].append((r["start"], r["size"]))
    for xs in held.values():
        xs.sort()
        assert sum(s for _, s in xs) <= 100 and all(a + s == b for (a, s), (b, _) in zip(xs, xs[1:]))
    for k, _, size in rows:
        xs = sorted(spans[k])
        assert sum(s for _, s in xs) == size and (len(xs) == 1 or size > 100)
        assert all(s == 100 for _, s in xs[:-1])
    total = sum(s for *_, s in rows)
    assert total / (100 * len(held)) > 0.9


def test_windows_keep_the_mixture(spark):
    rnd = random.Random(1)
    rows = [(k, "a" if k % 4 else "b", rnd.randrange(1, 30)) for k in range(4000)]
    got = P.pack(spark.createDataFrame(rows, "item_id bigint, source string, size int"), 500, lane_tokens=20_000).collect()
    share = Counter()
    window = defaultdict(Counter)
    for r in got:
        share[r["source"]] += r["size"]
        window[r["container"]][r["source"]] += r["size"]
    want = share["a"] / sum(share.values())
    off = [abs(w["a"] / sum(w.values()) - want) for w in window.values() if sum(w.values()) > 400]
    assert sum(off) / len(off) < 0.03


def test_turns_and_deficits():
    """Queues pay for what they give: none gets further from its share than one window and one item, while all of them last."""
    rnd = random.Random(3)
    share = np.array([0.6, 0.3, 0.1])
    sizes, src = [], []
    for s, n in enumerate((6000, 3000, 1000)):
        got = 0
        while got < 10 * n:
            sizes.append(rnd.randrange(1, 40))
            src.append(s)
            got += sizes[-1]
    order = list(range(len(sizes)))
    rnd.shuffle(order)
    sizes, src = [sizes[i] for i in order], [src[i] for i in order]
    c, o, deficit = P.fill(sizes, src, share, np.zeros(3), 100)
    used = np.zeros((c.max() + 1, 3))
    np.add.at(used, (c, src), sizes)
    assert used.sum(1)[:-5].mean() > 99
    off = np.abs(np.cumsum(used, 0) - np.arange(1, len(used) + 1)[:, None] * 100 * share)
    assert off[: int(0.9 * len(off))].max() <= 140
    assert np.allclose(deficit, len(used) * 100 * share - used.sum(0))
    _, _, again = P.fill(sizes, src, share, np.array([500.0, -400.0, -100.0]), 100)
    assert np.allclose(again, deficit + np.array([500.0, -400.0, -100.0]), atol=200)


def test_repeated_full_pieces(spark):
    df = spark.createDataFrame([(1, "a", 250), (1, "a", 250), (1, None, 100)], "item_id bigint, source string, size int")
    got = P.pack(df, 100).collect()
    assert len(got) == 7 and len({r["container"] for r in got if r["size"] == 100}) == 5


def test_slots_are_numbered_once(spark):
    """Blocks beyond a source's slots come behind the schedule, and no two blocks have one slot."""
    rows = [(k, f"s{k % 37}", 10 + k % 7) for k in range(3000)]
    targets = spark.createDataFrame([(f"s{k}", 1.0 + (k % 5), 3) for k in range(37)], "source string, weight double, max_repeats int")
    m = M.mix(spark.createDataFrame(rows, "doc_id bigint, source string, size int"), targets, block_tokens=16)[0].select("slot", "source", "block").distinct().collect()
    assert len({r["slot"] for r in m}) == len(m) and all(r["slot"] is not None for r in m)


def test_pack_edges(spark):
    df = spark.createDataFrame([(1, None, None), (1, None, None), (2, "a", 0)], "item_id bigint, source string, size int")
    assert P.pack(df, 10).count() == 3
    assert P.pack(df.where("false"), 10).count() == 0


def test_mix(spark):
    rnd = random.Random(2)
    rows = [(k, rnd.choice(["big"] * 8 + ["mid", "small"]), rnd.randrange(1, 50)) for k in range(3000)] + [(5000, None, 9), (5001, "other", 9), (5002, "big", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, size int")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.15, 4), ("none", 0.05, 3)], "source string, weight double, max_repeats int")
    mixture, report = M.mix(df.withColumn("slot", F.lit(0)), targets, block_tokens=200)
    m, rep = mixture.collect(), {r["source"]: r for r in report.collect()}
    uses = Counter(r["doc_id"] for r in m)
    source = {k: s for k, s, _ in rows}
    caps = {"big": 1, "mid": 2, "small": 4}
    assert all(n <= caps[source[k]] for k, n in uses.items())
    total = sum(r["size"] for r in m)
    for s, w in (("big", 0.5), ("mid", 0.3), ("small", 0.15)):
        assert abs(rep[s]["share"] - w / 0.95) < 0.01
        assert rep[s]["used_tokens"] == sum(r["size"] for r in m if r["source"] == s)
    assert rep["none"]["share"] == 0 and abs(sum(r["share"] for r in rep.values()) - 1) < 1e-9
    slots = {(r["source"], r["block"]): r["slot"] for r in m}
    assert len(set(slots.values())) == len(slots)  # a slot has one block
    order = [s for (s, _), _ in sorted(slots.items(), key=lambda kv: kv[1])]
    for n in range(40, len(order), 40):  # every stretch is mixed
        assert abs(order[:n].count("big") / n - 0.5 / 0.95) < 0.08
    assert total > 0


def test_mix_edges(spark):
    df = spark.createDataFrame([(1, "a", 5)], "doc_id bigint, source string, size int")
    t = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1), (None, 1.0, 1), ("c", None, 1)], "source string, weight double, max_repeats int")
    mixture, report = M.mix(df, t)
    assert [r["repeat"] for r in mixture.orderBy("repeat").collect()] == [0, 1]
    assert {r["source"]: r["share"] for r in report.collect()} == {"a": 1.0, "b": 0.0}
    mixture, report = M.mix(df.where("false"), t)
    assert mixture.count() == 0 and report.count() == 2


def test_quotas():
    q = M.quotas({"a": 100, "b": 100}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 3})
    assert q == {"a": 100, "b": 100}
    q = M.quotas({"a": 10_000, "b": 1}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 2})
    assert q == {"a": 10_000.0, "b": 2.0}


def test_tokens(spark):
    df = spark.createDataFrame([("hello world",), ("",), (None,), ("辞書" * 50_000,)], "t string")
    n = [r["n"] for r in df.select(sizes.n_tokens(F.col("t")).alias("n")).collect()]
    assert 0 < n[0] <= 4 and n[1:3] == [0, 0] and n[3] > 50_000
