"""Problem 2: how often, and in how many records, every term occurs - kept up to date by signed deltas.

Method: a ledger of three logs in the shared folder, each in hash buckets of its key: ``facts`` (versions of every fact), ``pairs``
(signed number of facts by term and record) and ``terms`` (signed changes of occurrences and of records by term). A batch is reduced to
the newest version of each fact in it; of the logs it reads the buckets its facts, and then its pairs, fall into, and of those only the
rows of these very facts and pairs. It turns into signed changes (-1 for what it replaces or deletes, +1 for what it brings), is summed
up by (term, record) and then by term, and is appended as one segment a log. Counts are sums over the log of terms. ``FAN_OUT`` segments of
one level are folded into one of the next, so a log of n batches has about log n segments.

The folder holds everything: a manifest names the segments that count, so a ledger can be opened again, by another session too; what a
killed batch left is removed then.

Edge cases: a null fact_id is a fact of its own that nothing replaces; of several versions of a fact the greatest (version, amount,
record, term, deleted) counts, in whatever batches they come, nulls being least; a null amount adds 0; a null or blank term counts
nowhere, but its record is a record; a null record is none; an empty batch changes nothing; extra columns are ignored.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import Manifest, new_path, read_bucketed, remove, write_bucketed

VERSION = "version timestamp, amount bigint, record string, term string, deleted boolean"
FACT = "fact_id string, record string, term string, amount bigint, version timestamp, deleted boolean"
SCHEMAS = {
    "facts": f"fact_id string, n struct<{', '.join(':'.join(c.split()) for c in VERSION.split(', '))}>",
    "pairs": "term string, record string, d_facts bigint",
    "terms": "term string, d_occurrences bigint, d_records bigint, d_facts bigint",
}
KEYS = {"facts": ["fact_id"], "pairs": ["term", "record"], "terms": ["term"]}
BUCKET_ROWS, FAN_OUT = 100_000, 4


def trimmed(c: Column) -> Column:
    """Without outer Unicode white space; null if nothing is left."""
    t = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.when(t != "", t)


class TermLedger:
    def __init__(self, spark: SparkSession, path: str | None = None, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.path, self.bucket_rows = spark, path or new_path(spark, "terms"), bucket_rows
        self.manifest = Manifest(spark, self.path, {"facts": [], "pairs": [], "terms": [], "folders": []})
        self.manifest.sweep(set(self.manifest.state["folders"]))

    def segments(self, name: str) -> list[dict]:
        return self.manifest.state[name]

    def _log(self, name: str, column: list[str] | None = None, wanted: DataFrame | None = None) -> DataFrame:
        df = read_bucketed(self.spark, self.segments(name), SCHEMAS[name], column, wanted)
        return self.spark.createDataFrame([], SCHEMAS[name]) if df is None else df

    def _work(self, df: DataFrame, path: str) -> tuple[DataFrame, int]:
        watch = Observation()
        df.observe(watch, F.count(F.lit(1)).alias("n")).write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), watch.get.get("n") or 0

    def apply(self, batch: DataFrame) -> DataFrame:
        """Take in a batch of facts(fact_id, record, term, amount, version, deleted); the signed changes by term that it made."""
        state = json.loads(json.dumps(self.manifest.state))
        folder = f"s{self.manifest.version + 1:08d}-{uuid.uuid4().hex[:8]}"
        path, work = f"{self.path}/{folder}", f"{self.path}/{folder}/work"
        n = F.struct("version", F.coalesce("amount", F.lit(0)).cast("bigint").alias("amount"), "record", trimmed(F.col("term")).alias("term"), F.coalesce("deleted", F.lit(False)).alias("deleted"))
        f = batch.select("fact_id", n.alias("n"))
        named = f.where("fact_id is not null").groupBy("fact_id").agg(F.max("n").alias("n"))
        if self.segments("facts"):
            named, _ = self._work(named, f"{work}/named")
            before = self._log("facts", ["fact_id"], named).join(named.select("fact_id"), "fact_id", "left_semi").groupBy("fact_id").agg(F.max("n").alias("o"))
            named = named.join(before, "fact_id", "left").where("o is null or n > o")
        else:
            named = named.withColumn("o", F.lit(None).cast(named.schema["n"].dataType))
        nameless = f.where("fact_id is null").withColumn("o", F.lit(None).cast(f.schema["n"].dataType))
        changed, rows = self._work(named.unionByName(nameless), f"{work}/changed")
        sides = F.explode(F.array(F.struct(F.lit(1).alias("sign"), F.col("n").alias("v")), F.struct(F.lit(-1).alias("sign"), F.col("o").alias("v"))))
        signed = changed.select(sides.alias("x")).where("x.v is not null and not x.v.deleted and x.v.term is not null")
        delta = signed.groupBy(F.col("x.v.term").alias("term"), F.col("x.v.record").alias("record")).agg(F.sum(F.col("x.sign") * F.col("x.v.amount")).alias("d_amount"), F.sum("x.sign").alias("d_facts"))
        delta, pairs = self._work(delta, f"{work}/delta")
        moved = delta.where("d_facts <> 0 and record is not null").select("term", "record", "d_facts")
        if self.segments("pairs"):
            before = self._log("pairs", ["term", "record"], moved).join(moved.select("term", "record"), ["term", "record"], "left_semi")
            delta = delta.join(before.groupBy("term", "record").agg(F.sum("d_facts").alias("n_before")), ["term", "record"], "left")
        else:
            delta = delta.withColumn("n_before", F.lit(0).cast("bigint"))
        n0 = F.coalesce("n_before", F.lit(0))
        step = F.when(F.col("record").isNull(), 0).otherwise((n0 + F.col("d_facts") > 0).cast("int") - (n0 > 0).cast("int"))
        by_term = delta.groupBy("term").agg(F.sum("d_amount").alias("d_occurrences"), F.sum(step).cast("bigint").alias("d_records"), F.sum("d_facts").alias("d_facts"))
        by_term, terms = self._work(by_term, f"{path}/changes")
        for name, df, size in (("facts", changed.select("fact_id", "n"), rows), ("pairs", moved, pairs), ("terms", by_term, terms)):
            if size:
                state[name].append({"level": 0, **write_bucketed(df, f"{path}/{name}", KEYS[name], size, self.bucket_rows)})
        self._fold(state, path)
        self._finish(state, folder, work)
        return by_term

    def counts(self) -> DataFrame:
        """(term, occurrences, records) of every term that some fact holds now."""
        sums = self._log("terms").groupBy("term").agg(F.sum("d_occurrences").alias("occurrences"), F.sum("d_records").alias("records"), F.sum("d_facts").alias("facts"))
        return sums.where("facts > 0").drop("facts")

    def _folded(self, name: str, segments: list[dict]) -> DataFrame:
        """One row a key; sums that came to nothing are left out."""
        df = read_bucketed(self.spark, segments, SCHEMAS[name])
        if name == "facts":
            return df.where("fact_id is not null").groupBy("fact_id").agg(F.max("n").alias("n"))
        sums = df.groupBy(*KEYS[name]).agg(*[F.sum(c).alias(c) for c in df.columns if c.startswith("d_")])
        return sums.where(" or ".join(f"{c} <> 0" for c in df.columns if c.startswith("d_")))

    def _fold(self, state: dict, path: str, every: bool = False) -> None:
        for name in SCHEMAS:
            level = 0
            while every or any(s["level"] >= level for s in state[name]):
                same = [s for s in state[name] if every or s["level"] == level]
                if every or len(same) >= FAN_OUT:
                    if len(same) > 1:
                        df, n = self._work(self._folded(name, same), f"{path}/work/{name}{level + 1}")
                        state[name] = [s for s in state[name] if s not in same]
                        if n:
                            state[name].append({"level": level + 1, **write_bucketed(df, f"{path}/{name}{level + 1}", KEYS[name], n, self.bucket_rows)})
                    if every:
                        break
                level += 1

    def compact(self) -> None:
        """Fold each log into one segment; sums and newest versions stay what they are."""
        state = json.loads(json.dumps(self.manifest.state))
        folder = f"s{self.manifest.version + 1:08d}-{uuid.uuid4().hex[:8]}"
        self._fold(state, f"{self.path}/{folder}", every=True)
        self._finish(state, folder, f"{self.path}/{folder}/work")

    def _finish(self, state: dict, folder: str, work: str) -> None:
        paths = {name: {s["path"] for s in self.segments(name)} - {s["path"] for s in state[name]} for name in SCHEMAS}
        state["folders"].append(folder)
        self.manifest.commit(state)
        remove(self.spark, work, *[p for x in paths.values() for p in x])

    def n_records(self, records: DataFrame) -> int:
        """Number of distinct non-null values of records.record; grouped before it is counted, nothing is collected."""
        return records.where("record is not null").groupBy("record").agg(F.lit(1)).count()


def marks(counts: DataFrame, n_records: int, rare_below: int = 5, common_above: float = 0.1) -> DataFrame:
    """(word, mark): ``rare`` where occurrences < rare_below, ``common`` where the word is in more than that share of the records."""
    both = F.array(F.when(F.col("occurrences") < rare_below, "rare"), F.when(F.col("records") > common_above * n_records, "common"))
    return counts.select(F.col("term").alias("word"), F.explode(F.array_compact(both)).alias("mark"))
