"""Saved derived tables and SQL functions."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources import storage
from .layout import write_clustered


def group_counts(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias(name))


def build_view(query: DataFrame, path: str, cluster_by: Sequence[str] = (), files: int | None = None,
               if_absent: bool = True) -> DataFrame:
    """Run the query once and keep its rows; one that is there already is kept when ``if_absent``.

    A refresh is written beside the old rows and takes their place when it is complete."""
    spark = query.sparkSession
    if not (if_absent and storage.exists(spark, path)):
        staged = f"{path.rstrip('/')}__staging_{uuid.uuid4().hex}"
        try:
            if cluster_by:
                write_clustered(query, staged, cluster_by, files)
            else:
                query.write.parquet(staged)
            storage.swap_in(spark, staged, path.rstrip("/"))
        finally:
            if storage.exists(spark, staged):
                storage.remove(spark, staged)
    return spark.read.schema(query.schema).parquet(path)


def create_sql_function(spark: SparkSession, name: str, parameters: str, returns: str, body: str) -> None:
    """A SQL function of the session. Its body is inlined, so a filter on it still reaches the scan."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")


def is_paid(status: Column, paid: str = "paid") -> Column:
    """The sample function as a column expression: NULL in gives NULL out."""
    return status == F.lit(paid)
