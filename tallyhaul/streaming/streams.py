"""Checkpointed streams: resumable copy, refreshed aggregates, at-least-once delivery."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.canonical import quoted
from ..operators.layout import write_clustered
from ..session import SETTINGS
from ..sources.storage import exists, swap_in


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1_000) -> DataFrame:
    """Files of a directory as a stream. A batch is what a stopped copy has to repeat, so it is bounded."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


_STORE = "spark.sql.streaming.stateStore.providerClass"


def _start(spark: SparkSession, start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """Start with state kept on executor disks, as it can outgrow their memory. A running query keeps
    the settings it was started with, so the session's own are put back at once."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, SETTINGS[_STORE])
    try:
        return start()
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


def copy_stream(stream: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = ()) -> int:
    """Copy what is there and not copied yet; returns the rows of this run.

    The checkpoint names the files that are done and the sink's log names the
    files that count, so a run stopped halfway and started again neither loses
    nor doubles a row. A new checkpoint and path start afresh.
    """
    writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    spark = stream.sparkSession
    before = _rows(spark, path)
    _start(spark, lambda: writer.trigger(availableNow=True).start(path)).awaitTermination()
    return _rows(spark, path) - before


def _rows(spark: SparkSession, path: str) -> int:
    """Rows of the files in the sink's log, from their footers. A query's progress only keeps its last batches."""
    return spark.read.parquet(path).count() if exists(spark, path + "/_spark_metadata") else 0


def view_stream(stream: DataFrame, aggregate: Callable[[DataFrame], DataFrame], path: str, checkpoint: str,
                cluster_by: Sequence[str] = ()) -> None:
    """Keep a saved aggregate up to date: each batch replaces it with the complete result so far."""
    def save(batch: DataFrame, number: int) -> None:
        staged = f"{path.rstrip('/')}__batch_{number}"
        if cluster_by:
            write_clustered(batch, staged, cluster_by, mode="overwrite")
        else:
            batch.write.mode("overwrite").parquet(staged)
        swap_in(batch.sparkSession, staged, path.rstrip("/"))

    writer = (aggregate(stream).writeStream.outputMode("complete").foreachBatch(save)
              .option("checkpointLocation", checkpoint).trigger(availableNow=True))
    _start(stream.sparkSession, writer.start).awaitTermination()


def dedupe_stream(stream: DataFrame, keys: Sequence[str], event_time: str | None = None,
                  delay: str | None = None) -> DataFrame:
    """First row per key of a stream that may send rows again.

    Without ``delay`` every key is remembered and the result is exact; the state
    is spread over tasks by key and lives on disk with the RocksDB store. With
    ``delay`` a key is remembered for that long only, and rows later than that
    are dropped: for endless streams whose repeats are known to come soon.
    """
    if delay is None:
        return stream.dropDuplicates(list(keys))
    timed = stream.withColumn("_event_time", quoted(event_time).cast("timestamp"))
    return timed.withWatermark("_event_time", delay).dropDuplicatesWithinWatermark(list(keys)).drop("_event_time")
