from __future__ import annotations

import random
from collections import defaultdict

from kikiwake.llm.terms import FACT, TermLedger, marks


def brute(batches):
    now, nameless = {}, []
    for b in batches:
        newest = {}
        for f in b:
            if f[0] is None:
                nameless.append(f)
            elif f[0] not in newest or key(f) > key(newest[f[0]]):
                newest[f[0]] = f
        for k, f in newest.items():
            if k not in now or key(f) > key(now[k]):
                now[k] = f
    occ, rec, facts = defaultdict(int), defaultdict(set), set()
    for f in [*now.values(), *nameless]:
        t = (f[2] or "").strip()
        if t and not f[5]:
            facts.add(t)
            occ[t] += f[3] or 0
            if f[1] is not None:
                rec[t].add(f[1])
    return {(t, occ[t], len(rec[t])) for t in facts}


def key(f):
    return (f[4] is not None, f[4] or 0, f[3] or 0, f[1] is not None, f[1] or "", (f[2] or "").strip() != "", (f[2] or "").strip(), bool(f[5]))


def test_deltas_against_recount(spark):
    from datetime import datetime, timedelta

    rnd = random.Random(2)
    day = datetime(2025, 1, 1)
    batches = []
    for b in range(3):
        rows = []
        for k in range(60):
            v = day + timedelta(days=10 * b, seconds=rnd.randrange(9))
            rows.append((rnd.choice([f"f{rnd.randrange(30)}", None]) if k % 9 == 0 else f"f{rnd.randrange(30)}", rnd.choice(["r1", "r2", "r3", None]), rnd.choice(["x", " x", "y　", "z", "", None, "hot", "hot"]), rnd.choice([1, 2, None]), v, rnd.random() < 0.1))
        batches.append(rows)
    ledger = TermLedger(spark, bucket_rows=7)  # several buckets a segment
    for n, rows in enumerate(batches, 1):
        ledger.apply(spark.createDataFrame(rows, FACT))
    assert {tuple(r) for r in ledger.counts().collect()} == brute(batches)
    assert any(s["buckets"] > 1 for s in ledger.segments("pairs"))
    ledger.compact()
    assert len(ledger.segments("facts")) == len(ledger.segments("pairs")) == len(ledger.segments("terms")) == 1
    assert {tuple(r) for r in ledger.counts().collect()} == brute(batches)
    ledger.apply(spark.createDataFrame([], FACT))
    assert {tuple(r) for r in ledger.counts().collect()} == brute(batches)


def test_marks(spark):
    df = spark.createDataFrame([("a", 4, 3), ("b", 5, 1), ("c", 9, 2)], "term string, occurrences bigint, records bigint")
    assert {tuple(r) for r in marks(df, 10).collect()} == {("a", "rare"), ("a", "common"), ("c", "common")}
    assert marks(df.where("false"), 0).count() == 0


def test_empty_ledger(spark):
    assert TermLedger(spark).counts().count() == 0


def test_reopened_folded_and_pruned(spark):
    """One fact a batch: levels fold, a killed batch leaves nothing, another session goes on, and only touched buckets are read."""
    from kikiwake.session import names_in, new_path

    path = new_path(spark, "ledger")
    batches = [[(f"f{k % 3}", f"r{k}", "x" if k < 4 else "y", k, None, k == 5)] for k in range(6)]
    for k, rows in enumerate(batches):
        ledger = TermLedger(spark if k % 2 else spark.newSession(), path, bucket_rows=1)
        ledger.apply(spark.createDataFrame(rows, FACT))
        if k == 2:
            spark.range(2).write.parquet(f"{path}/s00000004-killed/facts")
    assert {tuple(r) for r in TermLedger(spark, path).counts().collect()} == brute(batches)
    assert max(s["level"] for s in ledger.segments("terms")) == 1 and len(ledger.segments("terms")) < 4
    assert "s00000004-killed" not in names_in(spark, path)

    many = TermLedger(spark, bucket_rows=2)
    many.apply(spark.createDataFrame([(f"g{k}", "r", f"t{k}", 1, None, False) for k in range(20)], FACT))
    one = many._log("facts", ["fact_id"], spark.createDataFrame([("g3",)], "fact_id string"))
    assert len(one.inputFiles()) == 1 and len(many._log("facts").inputFiles()) > 3 and one.where("fact_id = 'g3'").count() == 1
