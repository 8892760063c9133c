"""Measured profiles: row counts, NULLs, ranges, distinct values, partitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.canonical import quoted, sql_name, sql_text, value_text

_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType, T.BinaryType)


def profile_columns(name: str, df: DataFrame, exact_distinct: bool = False) -> DataFrame:
    """``(table_name, column_name, position, type, row_count, null_count, distinct_count, min_text, max_text)``.

    One pass. Distinct counts are sketches of fixed size by default; exact ones are
    a second pass that shuffles the distinct values of every column. Nested columns have no range.
    """
    aggs, distinct, lines = ["count(*) AS row_count"], [], []
    for i, f in enumerate(df.schema.fields):
        col, flat = sql_name(f.name), not isinstance(f.dataType, _NESTED)
        aggs.append(f"count({col}) AS v{i}")
        if flat:
            aggs += [f"min({col}) AS lo{i}", f"max({col}) AS hi{i}"]
            distinct.append(f"count(DISTINCT {col}) AS d{i}" if exact_distinct else f"approx_count_distinct({col}) AS d{i}")
        count, low, high = (f"d{i}", value_text(f"lo{i}", f.dataType), value_text(f"hi{i}", f.dataType)) if flat else (
            "cast(NULL AS bigint)", "cast(NULL AS string)", "cast(NULL AS string)")
        lines.append(f"named_struct('table_name', {sql_text(name)}, 'column_name', {sql_text(f.name)}, "
                     f"'position', {i + 1}, 'type', {sql_text(f.dataType.simpleString())}, 'row_count', row_count, "
                     f"'null_count', row_count - v{i}, 'distinct_count', {count}, 'min_text', {low}, 'max_text', {high})")
    if not exact_distinct:
        return df.agg(*[F.expr(a) for a in aggs + distinct]).selectExpr(f"inline(array({', '.join(lines)}))")
    # exact distinct counts repeat each row per column; the other measures stay out of that
    counted = df.agg(*[F.expr(a) for a in distinct]).select(F.struct("*").alias("d")).scalar()
    return (df.agg(*[F.expr(a) for a in aggs]).withColumn("_d", counted).select("*", "_d.*")
            .selectExpr(f"inline(array({', '.join(lines)}))"))


def profile_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """``(table_name, row_count)``, also for empty tables. Reads row-group counts and no column."""
    return reduce(DataFrame.unionAll, [
        df.agg(F.expr("count(*) AS row_count")).selectExpr(f"{sql_text(name)} AS table_name", "row_count")
        for name, df in tables.items()])


def profile_partitions(df: DataFrame, part: Column, part_name: str, key: str, distinct: str) -> DataFrame:
    """Measured rows, key range and distinct values per partition."""
    return (df.select(part.alias(part_name), quoted(key).alias("_k"), quoted(distinct).alias("_d"))
            .groupBy(part_name).agg(F.count(F.lit(1)).alias("row_count"), F.min("_k").alias("min_key"),
                                    F.max("_k").alias("max_key"), F.count_distinct("_d").alias("distinct_values")))


def rank_largest(tables: DataFrame, rows: str = "row_count", size: str | None = None,
                 name: str = "table_name") -> DataFrame:
    """Adds ``rank``: largest first by size and rows, unknown last, ties by name."""
    from pyspark.sql import Window

    order = [F.coalesce(quoted(c), F.lit(-1)).desc() for c in ([size] if size else []) + [rows]]
    # one row per table
    return tables.withColumn("rank", F.row_number().over(Window.orderBy(*order, quoted(name))))
