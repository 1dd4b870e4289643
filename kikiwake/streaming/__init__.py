"""Incremental forms: sentences arriving over time, a running dictionary, bounded catch-up runs."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import IO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import sinks
from ..functions.keys import sentence_hash
from ..operators import collect, harvest, pipeline, state
from ..session import Manifest, new_path, remove
from ..sources import logs
from ..types import LOOSE, TOKENS, NormalizeOptions, VoiceSpec


def source(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_sentences(stream: DataFrame, text: str = "text", event_time: str | None = None, horizon: str = "30 days") -> DataFrame:
    """The first of equal sentences. Without an event time the state grows with the distinct sentences, as a log of all that was seen
    does; with one, sentences may come again after the horizon."""
    keyed = stream.withColumn("sentence", sentence_hash(F.col(text)))
    if event_time is None:
        return keyed.dropDuplicates(["sentence"])
    return keyed.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark(["sentence"])


def running_dictionary(outcomes: DataFrame) -> DataFrame:
    """(word, count) of a stream of classified replacements, for output mode complete or update."""
    return outcomes.where("is_homophone").groupBy(F.col("reference_surface").alias("word")).agg(F.count(F.lit(1)).alias("count"))


def windowed_dictionary(outcomes: DataFrame, event_time: str, window: str, lateness: str) -> DataFrame:
    """(start, end, word, count) by event-time window; windows close when the watermark passes them."""
    rows = outcomes.where("is_homophone").withWatermark(event_time, lateness)
    return rows.groupBy(F.window(event_time, window).alias("w"), F.col("reference_surface").alias("word")).agg(F.count(F.lit(1)).alias("count")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "word", "count")


def catch_up(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Work off what has arrived, then stop: the nightly run. The sink must be idempotent by key, as a batch may be repeated."""
    return df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def log_sink(path: str, key: str) -> Callable[[DataFrame, int], None]:
    return lambda batch, _: state.append_absent(batch, path, key)


class Session:
    """Pairs that come in one by one; dictionary and rejects of all of them so far can be asked for, saved and cleared. They lie in a
    folder, so a session can be taken up again."""

    def __init__(self, spark: SparkSession, path: str | None = None, opts: NormalizeOptions = LOOSE):
        self.spark, self.path, self.opts = spark, path or new_path(spark, "session"), opts
        self.manifest = Manifest(spark, self.path, {"parts": []})
        self.manifest.sweep(set(self.manifest.state["parts"]))

    def add(self, pairs: DataFrame) -> None:
        """pairs(reference, hypothesis) of token arrays; they come behind all before them."""
        name = f"pairs-{self.manifest.version + 1:08d}-{uuid.uuid4().hex[:8]}"
        rows = pairs.select(F.lit(self.manifest.version + 1).alias("turn"), F.monotonically_increasing_id().alias("seq"), "reference", "hypothesis")
        rows.write.parquet(f"{self.path}/{name}")
        self.manifest.commit({"parts": [*self.manifest.state["parts"], name]})

    def outcomes(self) -> DataFrame:
        schema = f"turn int, seq bigint, reference {TOKENS}, hypothesis {TOKENS}"
        parts = [f"{self.path}/{p}" for p in self.manifest.state["parts"]]
        return pipeline.process(self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema), opts=self.opts)

    def dictionary(self) -> DataFrame:
        return collect.danger(self.outcomes(), ["turn", "seq", "block_idx"])

    def rejects(self) -> DataFrame:
        return collect.rejects(self.outcomes().orderBy("turn", "seq", "block_idx"))

    def save(self, dictionary: IO[str], rejects: IO[str] | None = None, format: str | None = None) -> None:
        sinks.write_dictionary(self.dictionary(), dictionary, format)
        if rejects:
            sinks.write_lines(sinks.reject_lines(self.rejects()), rejects)

    def clear(self) -> None:
        gone = self.manifest.state["parts"]
        self.manifest.commit({"parts": []})
        remove(self.spark, *[f"{self.path}/{p}" for p in gone])


def nightly(articles: DataFrame, folder: str, voices: list[VoiceSpec], model: str, synthesize: Callable, recognize: Callable, tokenize: Callable, min_votes: int = 1, opts: NormalizeOptions = LOOSE) -> DataFrame:
    """Work off the articles that have arrived, through the caches, the log of what was seen and the votes, and return the merged
    counts of all nights in their order. A batch that is repeated after a failure replaces its own counts."""
    spark = articles.sparkSession

    def night(batch: DataFrame, n: int) -> None:
        rows = batch.withColumn("dedup", F.coalesce("dedup", F.lit(False))).withColumn("trusted", F.coalesce("trusted", F.lit(False)))
        seen = logs.seen(spark, f"{folder}/seen")
        out = harvest.run_cached(rows, seen, voices, model, folder, synthesize, recognize, tokenize, min_votes=min_votes, opts=opts)
        out.danger.select("word", "count").write.mode("overwrite").parquet(f"{folder}/counts/batch={n}")
        state.append_seen(out.seen, seen, f"{folder}/seen")

    catch_up(articles, night, f"{folder}/checkpoint").awaitTermination()
    return collect.positions(collect.merged(state.stored(spark, f"{folder}/counts", "word string, count bigint"))).orderBy("pos")


def to_memory(df: DataFrame, name: str, mode: str, checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what is there and read its result as a table."""
    w = df.writeStream.outputMode(mode).format("memory").queryName(name)
    if checkpoint:
        w = w.option("checkpointLocation", checkpoint)
    q = w.trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
