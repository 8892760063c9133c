"""Sequence marks and new keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.canonical import quoted
from ..sources.storage import scratch
from .layout import with_position


def high_water_mark(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.coalesce(F.max(quoted(column)), F.lit(0)).cast("bigint").alias("mark"))


def sequence_sync(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """``(table_name, last_value, is_called, next_value)`` per ``{name: (table, column)}``.

    A mark of 0 or less sets the sequence to 1, not yet called; else the mark
    counts as used and the next value is one above it.
    """
    marks = reduce(DataFrame.unionAll, [
        high_water_mark(df, column).select(F.lit(name).alias("table_name"), "mark")
        for name, (df, column) in tables.items()])
    used = F.col("mark") > 0
    return marks.select("table_name", F.when(used, F.col("mark")).otherwise(F.lit(1)).alias("last_value"),
                        used.alias("is_called"), F.when(used, F.col("mark") + 1).otherwise(F.lit(1)).alias("next_value"))


def assign_keys(df: DataFrame, start: int, order: Sequence[str], name: str = "new_id",
                partitions: int | None = None, position: Column | None = None) -> DataFrame:
    """Dense ids ``start, start + 1, …`` in the order given, without sorting all rows in one task.

    The range-sorted rows are written to the shared folder; each file's row
    count gives the offsets of the files after it, and a row's id is its file's
    offset plus its place in the file. What is numbered is the written table, so
    a task that is run again finds the same rows at the same places.
    """
    spark = df.sparkSession
    path = scratch(spark, "keys") + "/sorted"
    names = [quoted(c) for c in order]
    sort = [*names, F.col("_pos")]
    placed = with_position(df, position)
    ranged = placed.repartitionByRange(partitions, *sort) if partitions else placed.repartitionByRange(*sort)
    ranged.sortWithinPartitions(*sort).drop("_pos").write.option("maxRecordsPerFile", 0).parquet(path)

    stored = spark.read.schema(df.schema).parquet(path)
    counts = stored.groupBy(F.col("_metadata.file_name").alias("_file")).agg(F.expr("count(*) AS _rows"))
    part = F.regexp_extract("_file", r"^part-(\d+)", 1).cast("bigint")
    # one short row per written file goes through the window; how they join the rows is the planner's choice
    before = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(part.alias("_part"), "_rows").select("_part", F.coalesce(before, F.lit(0)).alias("_offset"))
    rows = stored.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    return rows.withColumn("_part", part).drop("_file").join(offsets, "_part").select(
        *[quoted(c) for c in df.columns], (F.col("_offset") + F.col("_index") + F.lit(start)).cast("bigint").alias(name))
