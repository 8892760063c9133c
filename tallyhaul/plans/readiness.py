"""Advice per table: chunk column, strategy, risk, verification depth and action, all as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.verify import verification_depth
from .catalog import root_tables

# Fixed values of the rules.
TIMESTAMP_HINTS = ("created_at", "updated_at", "event_ts", "timestamp", "ts")
MODES = ("plan_only", "missing_only", "metadata_diff_only", "data_diff_only", "full_refresh", "safe_sync")
RISK_POINTS = {"large row volume": 30, "moderate row volume": 15, "missing primary key": 25,
               "structural metadata drift": 30, "index or foreign key drift": 10, "partitioned table": 10,
               "geometry columns": 10, "large table without a safe chunk column": 20}
MISSING_WARNING = "table is missing in target"
STRUCTURE_WARNING = "structural drift must be reviewed before execution"
# types a range can be cut over, as Spark and as SQL databases spell them; intervals and points are not
CHUNKABLE_TYPE = (r"^(tinyint|smallint|int|integer|bigint|int[248]|(decimal|numeric)(\(.*\))?|date|"
                  r"timestamp(_ntz|_ltz)?(\(\d\))?( (with|without) time zone)?)$")


@dataclass(frozen=True)
class Thresholds:
    chunk_rows: int = 250_000
    max_chunks: int | None = None  # a plan made elsewhere may have a bound; rows per chunk decide otherwise
    max_concurrency: int | None = None
    large_rows: int = 1_000_000
    moderate_rows: int = 100_000
    unsafe_rows: int = 500_000
    sample_rows: int = 100_000
    sample_risk: int = 60
    large_depth: str = "rowcount_and_fingerprint"


def _first(names: Column) -> Column:
    return F.try_element_at(names, F.lit(1))


def chunk_column() -> Column:
    """First match of: leading column of the partition key, a known timestamp name in hint order,
    a primary key column, a column ending in ``_id`` — each only if its type can be cut in ranges."""
    good = F.transform(F.filter("columns", lambda c: F.lower(c.getField("type")).rlike(CHUNKABLE_TYPE)),
                       lambda c: c.getField("name"))
    inside = F.regexp_extract(F.col("partition_key"), r"\(([^)]+)\)", 1)
    leading = F.replace(F.trim(F.element_at(F.split(inside, ","), 1)), F.lit('"'), F.lit(""))
    hints = F.array(*[F.lit(h) for h in TIMESTAMP_HINTS])
    return F.coalesce(
        F.when(F.array_contains(good, leading), leading),
        _first(F.filter(hints, lambda h: F.array_contains(good, h))),
        _first(F.filter("primary_key", lambda k: F.array_contains(good, k))),
        _first(F.filter(good, lambda g: g.endswith("_id"))))


def chunk_count(rows: Column, column: Column, t: Thresholds) -> Column:
    wanted = F.floor(rows / F.lit(t.chunk_rows)) + 1
    if t.max_chunks is not None:
        wanted = F.least(F.lit(t.max_chunks).cast("bigint"), wanted)
    several = F.greatest(F.lit(2).cast("bigint"), wanted)
    return F.when(column.isNull() | (rows <= t.chunk_rows), F.lit(1).cast("bigint")).otherwise(several).cast("int")


def is_partitioned() -> Column:
    return F.coalesce(F.col("partition_key"), F.lit("")) != ""


def strategy(chunks: Column) -> Column:
    return (F.when(is_partitioned() & (F.size("children") > 0), "partition_wise_copy")
            .when(chunks > 1, "chunked_copy").otherwise("full_copy"))


def risk_reasons(rows: Column, column: Column, t: Thresholds) -> Column:
    tests = {
        "large row volume": rows >= t.large_rows,
        "moderate row volume": (rows >= t.moderate_rows) & (rows < t.large_rows),
        "missing primary key": F.size("primary_key") == 0,
        "structural metadata drift": F.size("structural_drift") > 0,
        "index or foreign key drift": F.size("auxiliary_drift") > 0,
        "partitioned table": is_partitioned(),
        "geometry columns": F.col("has_geometry"),
        "large table without a safe chunk column": (rows >= t.unsafe_rows) & column.isNull() & ~is_partitioned(),
    }
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))


def risk_score(reasons: Column) -> Column:
    points = sum((F.when(F.array_contains(reasons, name), n).otherwise(0) for name, n in RISK_POINTS.items()), F.lit(0))
    return F.least(points, F.lit(100))


def risk_level(score: Column) -> Column:
    return F.when(score >= 70, "high").when(score >= 35, "medium").otherwise("low")


def recommended_action(mode: Column, status: Column, compatible: Column, auxiliary: Column) -> Column:
    missing, match = status == "missing_in_target", status == "metadata_match"
    copy_missing = F.when(missing, "copy").otherwise("skip")
    metadata_only = (F.when(match, "skip").when(missing, "copy")
                     .when(compatible & auxiliary, "sync_metadata").when(compatible, "copy")
                     .otherwise("manual_review"))
    return (F.when(status == "missing_in_source", "manual_review")
            .when((mode == "plan_only") & (status == "metadata_diff") & ~compatible, "manual_review")
            .when(mode.isin("plan_only", "missing_only"), copy_missing)
            .when(mode == "metadata_diff_only", metadata_only)
            .when(mode.isin("data_diff_only", "full_refresh", "safe_sync") & (compatible | missing), "copy")
            .otherwise("manual_review"))


def action_by_mode(drift: DataFrame, modes: Sequence[str] = MODES) -> DataFrame:
    """``(table_name, mode, action)``: every table under every mode."""
    lines = drift.select("*", F.explode(F.array(*[F.lit(m) for m in modes])).alias("mode"))
    return lines.select("table_name", "mode", recommended_action(
        F.col("mode"), F.col("status"), F.col("compatible"), F.size("auxiliary_drift") > 0).alias("action"))


def readiness(source: DataFrame, drift: DataFrame, mode: str = "safe_sync", thresholds: Thresholds = Thresholds(),
              chosen_columns: dict[str, str] | None = None) -> DataFrame:
    """One row per root table of the source. ``chosen_columns`` names the chunk column of single tables."""
    t = thresholds
    base = root_tables(source).join(drift.drop("source_rows", "target_rows"), "table_name")
    pick = chunk_column()
    for table, column in (chosen_columns or {}).items():
        pick = F.when(F.col("table_name") == table, F.lit(column)).otherwise(pick)
    rows = F.coalesce("row_count", F.lit(0))
    step = base.withColumns({"rows": rows, "chunk_column": pick})
    step = step.withColumn("chunk_count", chunk_count(F.col("rows"), F.col("chunk_column"), t))
    step = step.withColumns({
        "strategy": strategy(F.col("chunk_count")),
        "concurrency": F.col("chunk_count") if t.max_concurrency is None else F.least("chunk_count", F.lit(t.max_concurrency)),
        "reasons": risk_reasons(F.col("rows"), F.col("chunk_column"), t)})
    step = step.withColumn("risk_score", risk_score(F.col("reasons")))
    missing = F.col("status") == "missing_in_target"
    structural = F.size("structural_drift") > 0
    warnings = F.concat(F.col("reasons"), F.array_compact(F.array(
        F.when(missing, MISSING_WARNING), F.when(structural, STRUCTURE_WARNING))))
    action = recommended_action(F.lit(mode), F.col("status"), F.col("compatible"), F.size("auxiliary_drift") > 0)
    step = step.withColumns({
        "risk_level": risk_level(F.col("risk_score")),
        "depth": verification_depth(F.col("row_count"), F.col("risk_score"), t.sample_rows, t.sample_risk, t.large_depth),
        "action": action, "warnings": F.array_join(warnings, "; ")})
    rationale = F.concat_ws(", ", F.concat(F.lit("action="), "action"), F.concat(F.lit("strategy="), "strategy"),
                            F.concat(F.lit("risk="), F.col("risk_score").cast("string")),
                            F.concat(F.lit("chunk_column="), "chunk_column"))
    return step.select("table_name", "status", F.col("rows").alias("row_count"), "action", "strategy", "chunk_column",
                       "chunk_count", "concurrency", "depth", "risk_score", "risk_level", "warnings",
                       (F.col("action") == "manual_review").alias("manual_review"), rationale.alias("rationale"))


def readiness_summary(report: DataFrame) -> DataFrame:
    """One row: tables per action, and the tables whose drift blocks an overwrite."""
    def n(action: str) -> Column:
        return F.count_if(F.col("action") == action)

    blocked = F.when((F.col("status") == "metadata_diff") & F.col("manual_review"), F.col("table_name"))
    review = F.when(F.col("manual_review"), F.col("table_name"))
    return report.agg(
        n("copy").alias("to_copy"), n("sync_metadata").alias("to_sync_metadata"),
        n("manual_review").alias("to_review"), n("skip").alias("skipped"),
        F.array_join(F.array_sort(F.collect_list(review)), ",").alias("review_tables"),
        F.array_join(F.array_sort(F.collect_list(blocked)), ",").alias("blocked_overwrites"))


def approved_only(tables: DataFrame, approvals: DataFrame) -> DataFrame:
    """Tables approved for copy; a partition follows its parent. ``approvals`` is (table_name, approved)."""
    yes = approvals.filter("approved").select(F.col("table_name").alias("_root"))
    parent = tables.select(F.col("table_name").alias("_parent"), F.explode("children").alias("table_name"))
    rooted = tables.join(parent, "table_name", "left").withColumn("_root", F.coalesce("_parent", "table_name"))
    return rooted.join(yes, "_root", "left_semi").select(*tables.columns)
