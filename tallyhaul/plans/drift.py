"""Structure drift between two catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .catalog import root_tables


def _default(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def _signature(side: str) -> Column:
    return F.transform(F.col(f"{side}.columns"), lambda c: F.struct(
        c.getField("name"), c.getField("type"), c.getField("not_null"), c.getField("identity"),
        _default(c.getField("default_value"))))


def _named(tests: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))


def schema_drift(source: DataFrame, target: DataFrame) -> DataFrame:
    """``(table_name, status, compatible, structural_drift, auxiliary_drift, source_rows, target_rows)``.

    Structural drift (columns, primary key, partition layout, geometry) blocks a
    copy; auxiliary drift (indexes, foreign keys) does not. Partitions count with
    their parent. Catalogs have one row per table, so the join is small.
    """
    s, t = root_tables(source).alias("s"), root_tables(target).alias("t")

    def other(column: str) -> Column:
        return ~F.col(f"s.{column}").eqNullSafe(F.col(f"t.{column}"))

    both = F.col("s.table_name").isNotNull() & F.col("t.table_name").isNotNull()
    children = ~F.array_sort("s.children").eqNullSafe(F.array_sort("t.children"))
    structural = _named({
        "columns": both & ~_signature("s").eqNullSafe(_signature("t")),
        "primary_key": both & other("primary_key"),
        "partition_layout": both & (other("partition_key") | children),
        "geometry": both & other("has_geometry")})
    auxiliary = _named({"indexes": both & other("indexes"), "foreign_keys": both & other("foreign_keys")})
    status = (F.when(F.col("t.table_name").isNull(), "missing_in_target")
              .when(F.col("s.table_name").isNull(), "missing_in_source")
              .when((F.size(structural) > 0) | (F.size(auxiliary) > 0), "metadata_diff")
              .otherwise("metadata_match"))
    return s.join(t, F.col("s.table_name") == F.col("t.table_name"), "full").select(
        F.coalesce("s.table_name", "t.table_name").alias("table_name"), status.alias("status"),
        (F.col("s.table_name").isNotNull() & (F.size(structural) == 0)).alias("compatible"),
        structural.alias("structural_drift"), auxiliary.alias("auxiliary_drift"),
        F.col("s.row_count").alias("source_rows"), F.col("t.row_count").alias("target_rows"))


def column_drift(source: DataFrame, target: DataFrame) -> DataFrame:
    """``(table_name, column_name, drift)`` for columns of tables on both sides: added, removed, or a
    comma list of type, nullability, default, identity, position."""
    shared = source.select("table_name").join(target.select("table_name"), "table_name", "left_semi")

    def flat(catalog: DataFrame) -> DataFrame:
        rows = catalog.join(shared, "table_name", "left_semi").select("table_name", F.posexplode("columns").alias("p", "c"))
        return rows.select("table_name", F.col("c.name").alias("column_name"), "p", "c")

    s, t = flat(source).alias("s"), flat(target).alias("t")
    on = (F.col("s.table_name") == F.col("t.table_name")) & (F.col("s.column_name") == F.col("t.column_name"))

    def other(name: str) -> Column:
        return ~F.col(f"s.c.{name}").eqNullSafe(F.col(f"t.c.{name}"))

    changed = F.array_join(_named({
        "type": other("type"), "nullability": other("not_null"),
        "default": _default(F.col("s.c.default_value")) != _default(F.col("t.c.default_value")),
        "identity": other("identity"), "position": F.col("s.p") != F.col("t.p")}), ",")
    drift = (F.when(F.col("s.p").isNull(), "added").when(F.col("t.p").isNull(), "removed").otherwise(changed))
    return s.join(t, on, "full").select(F.coalesce("s.table_name", "t.table_name").alias("table_name"),
                                        F.coalesce("s.column_name", "t.column_name").alias("column_name"),
                                        drift.alias("drift")).filter("drift <> ''")


def drift_summary(drift: DataFrame) -> DataFrame:
    """One row of counts per status, and a warning when the target has tables of its own."""
    def n(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    counts = drift.agg(F.count_if(F.col("status") != "missing_in_source").alias("source_tables"),
                       F.count_if(F.col("status") != "missing_in_target").alias("target_tables"),
                       *[n(s).alias(s) for s in ("missing_in_target", "missing_in_source", "metadata_match",
                                                 "metadata_diff")])
    warning = F.when(F.col("missing_in_source") > 0, F.concat(
        F.lit("Target contains "), F.col("missing_in_source").cast("string"),
        F.lit(" table(s) not present in source.")))
    return counts.withColumn("warning", warning)


