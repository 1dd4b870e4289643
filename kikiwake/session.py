"""Session, scan and lineage helpers shared by all operators."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's own default limit for a broadcast side; used where the setting is switched off or unreadable.
DEFAULT_BROADCAST_BYTES = 10 * 1024 * 1024


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, app: str = "kikiwake", memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _local_dir() -> str:
    path = tempfile.mkdtemp(prefix="kikiwake-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return "file://" + path


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session without that setting gets a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = _local_dir()
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def persisted(df: DataFrame, name: str = "step", partition_by: list[str] | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts the lineage and survives the loss of executors."""
    path = new_path(df.sparkSession, name)
    w = df.write
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, max_rows: int) -> bool:
    """True if df provably has at most max_rows rows; reads no more than that many."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """A broadcast hint only behind a check of the size; beyond it Spark plans a shuffled join."""
    return F.broadcast(df) if small_side(df, max_rows) else df


def running_total(df: DataFrame, group: list[str], order: list[str], value: str, out: str, bucket: str) -> DataFrame:
    """Exclusive running total of ``value`` per ``group`` in the order (bucket, *order), in two levels.

    A window over a whole group would put that group into one task. Here the rows of a group are spread over ``bucket`` (an
    integer column that is non-decreasing in the wanted order); only one row per (group, bucket) meets in the second window.
    """
    from pyspark.sql import Window as W

    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("__sum"))
    before = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inner = W.partitionBy(*group, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        df.withColumn("__inner", F.coalesce(F.sum(value).over(inner), F.lit(0)))
        .join(before.drop("__sum"), [*group, bucket])
        .withColumn(out, F.col("__inner") + F.col("__before"))
        .drop("__inner", "__before")
    )


def _file(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    fs, p = _file(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, p = _file(spark, path)
        fs.delete(p, True)


def read_json(spark: SparkSession, path: str) -> object:
    fs, p = _file(spark, path)
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, value: object) -> None:
    """A whole file or none: written under another name, then renamed. An error if the name is taken."""
    fs, p = _file(spark, path)
    _, part = _file(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(part)
    try:
        stream.write(bytearray(json.dumps(value).encode()))
    finally:
        stream.close()
    if fs.exists(p) or not fs.rename(part, p):
        fs.delete(part, False)
        raise FileExistsError(path)


class Manifest:
    """Numbered states of a folder, each one small JSON file; the last one counts. Folders beside it that the last state doesn't
    name are what killed writers left, and are removed when the folder is opened. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, first: dict):
        self.spark, self.path = spark, path
        known = [x for x in names_in(spark, f"{path}/manifest") if x.endswith(".json")]
        self.version = int(known[-1][:-5]) if known else 0
        self.state = read_json(spark, f"{path}/manifest/{known[-1]}") if known else first

    def commit(self, state: dict) -> None:
        write_json(self.spark, f"{self.path}/manifest/{self.version + 1:08d}.json", state)
        self.version, self.state = self.version + 1, state

    def sweep(self, named: set[str]) -> None:
        """Remove the folders that aren't named."""
        remove(self.spark, *[f"{self.path}/{x}" for x in names_in(self.spark, self.path) if x != "manifest" and x not in named])


def touched(column: str | list[str], n: int) -> Column:
    """The hash bucket, of n, of the columns."""
    return F.pmod(F.xxhash64(*([column] if isinstance(column, str) else column)), F.lit(n)).cast("int")


def write_bucketed(df: DataFrame, path: str, column: str | list[str], rows: int, bucket_rows: int = 100_000, most: int = 4_096) -> dict:
    """df, of about ``rows`` rows, as a table in hash buckets of its columns, and what ``read_bucketed`` must know of it."""
    n = max(1, min(most, -(-rows // bucket_rows)))
    keyed = df.withColumn("bucket", touched(column, n))
    (keyed.coalesce(1) if n == 1 else keyed.repartition(n, "bucket")).write.partitionBy("bucket").parquet(path)
    return {"path": path, "buckets": n, "rows": rows, "held": [int(x[7:]) for x in names_in(df.sparkSession, path) if x.startswith("bucket=")]}


def read_bucketed(spark: SparkSession, segments: list[dict], schema: str, column: str | list[str] | None = None, wanted: DataFrame | None = None) -> DataFrame | None:
    """Bucketed tables as one; with ``wanted``, only the buckets in which rows with its columns may lie. None if nothing is left."""
    hit: dict[int, set[int]] = {}
    for n in {s["buckets"] for s in segments}:  # a few numbers of buckets, and of each at most write_bucketed's ``most`` values
        hit[n] = set(range(n)) if wanted is None or n == 1 else {r["b"] for r in wanted.select(touched(column, n).alias("b")).distinct().collect()}
    paths = [f"{s['path']}/bucket={b}" for s in segments for b in sorted(hit[s["buckets"]] & set(s["held"]))]
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*paths) if paths else None
