"""Relations that outlive a run: what was seen, which audio says what, what was recognized. Appends are insert-if-absent, so a run
that is repeated after a failure adds nothing twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def unseen(rows: DataFrame, seen: DataFrame, key: str, dedup: str | None = None) -> DataFrame:
    """Rows whose key wasn't seen; with ``dedup``, rows of sources that don't look back pass anyway."""
    s = seen.select(key).where(f"{key} is not null").distinct()
    if dedup is None:
        return rows.join(s, key, "left_anti")
    return rows.where(dedup).join(s, key, "left_anti").unionByName(rows.where(f"not {dedup}"))


def first_in_run(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in the order of the run: the least row by (order, other columns), combined before the one shuffle,
    so a hot key is a row per partition and the rows are worked out once."""
    rest = [c for c in rows.columns if c != key and c not in order]
    first = rows.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("__first"))
    return first.select(key, "__first.*").select(*rows.columns)


def absent(rows: DataFrame, log: DataFrame, key: str) -> DataFrame:
    return rows.dropDuplicates([key]).join(log.select(key), key, "left_anti")


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet log, empty where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def append_absent(rows: DataFrame, log_path: str, key: str) -> None:
    """Append the rows whose key the Parquet log doesn't hold. The commit of the write makes them appear all at once."""
    log = stored(rows.sparkSession, log_path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema))
    absent(rows, log, key).write.mode("append").parquet(log_path)


def append_seen(marks: DataFrame, seen: DataFrame, path: str) -> None:
    """Append to the JSON log the marks (article, sentence) it doesn't hold."""
    same = [marks[c].eqNullSafe(seen[c]) for c in ("article", "sentence")]
    marks.distinct().join(seen, same[0] & same[1], "left_anti").coalesce(1).write.mode("append").json(path)


def first_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key; combined before the shuffle, so a hot key is a row per partition."""
    return first_in_run(rows, key, [order])


def cached(rows: DataFrame, cache: DataFrame, key: str, value: str) -> DataFrame:
    """Rows with the cached value, null where it has to be worked out, and ``hit``."""
    c = cache.select(key, F.col(value)).dropDuplicates([key])
    return rows.join(c, key, "left").withColumn("hit", F.col(value).isNotNull())
