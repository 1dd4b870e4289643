from __future__ import annotations

import random
from collections import defaultdict

from kikiwake.llm import spans as S


def brute(rows, n):
    holders = defaultdict(set)
    for d, t in rows:
        for i in range(len(t or "") - n + 1):
            holders[t[i : i + n]].add(d)
    out = set()
    for d, t in rows:
        at = [i for i in range(len(t or "") - n + 1) if len(holders[t[i : i + n]]) > 1]
        while at:
            a = b = at.pop(0)
            while at and at[0] <= b + n:
                b = at.pop(0)
            out.add((d, a, b + n))
    return out


def test_against_brute_force(spark):
    rnd = random.Random(0)
    parts = ["".join(rnd.choices("あいうえおkaki 🎧", k=rnd.randrange(5, 60))) for _ in range(12)]
    rows = [(k, "".join(rnd.choices(parts, k=rnd.randrange(6)))) for k in range(120)]
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, None), (203, ""), (204, "x" * 300), (205, "ab" * 2000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for n in (20, 21):
        got = S.shared_spans(df.withColumn("start", df["doc_id"]), n)
        assert {tuple(r) for r in got.collect()} == brute(rows, n)
    share = {r["doc_id"]: r["shared"] for r in S.shared_share(df, S.shared_spans(df, 20)).collect()}
    assert len(share) == len(rows) and share[204] == 0.0 and share[202] == 0.0
    assert S.shared_spans(df.where("false"), 20).count() == 0


def test_tiny_filters_and_a_block_in_half_of_all(spark):
    """A range of hashes for each tiny filter; a passage that half of the records hold at any place; the union of many filters."""
    rnd = random.Random(4)
    note = "".join(rnd.choices("あいうえおかきくけこ", k=70))
    rows = []
    for k in range(160):
        t = "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randrange(80)))
        rows.append((k, t + (note[rnd.randrange(20) :] if k % 2 else "") + "".join(rnd.choices("ABCDEFGH", k=30))))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(70)
    assert 16 * sum(len(t) // 10 for _, t in rows) > 4 * 2**12
    got = S.shared_spans(df, 20, max_bits=12)
    assert {tuple(r) for r in got.collect()} == brute(rows, 20)
