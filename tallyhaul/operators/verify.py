"""Reconciliation reports: one row per table pair, built from aggregates only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.canonical import row_text_sql, sql_name, sql_text
from ..session import side_by_side
from ..sources.storage import settle
from .compare import DIFFERS, NET_AGGREGATES, both_signed, diff_rows, same_columns
from .integrity import check_pk

_FAILED = (PySparkException, Py4JJavaError)  # a failed write comes as the latter
SAMPLE_ROWS = 50  # fixed value: default sample size of a verification


@dataclass(frozen=True)
class TablePair:
    name: str
    source: DataFrame
    target: DataFrame
    keys: tuple[str, ...] = ()
    sample: bool = True
    content: bool = True
    json_columns: tuple[str, ...] = ()
    sample_rows: int = SAMPLE_ROWS


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def _sample_order(df: DataFrame, keys: Sequence[str]) -> list[str]:
    """All key columns, then the rest so that ties cannot matter."""
    return [sql_name(c) for c in [*keys, *[c for c in df.columns if c not in set(keys)]]]


def sample_rows(df: DataFrame, keys: Sequence[str] = (), rows: int = SAMPLE_ROWS) -> DataFrame:
    """First rows in key order; without a key, in the order of the whole row.

    With a key, a scan of the key columns alone finds how far the sample reaches;
    whole rows are then read only up to there, which the scan's row-group
    statistics turn into skipped blocks where files are laid out by key.
    """
    order = _sample_order(df, keys)
    if keys:
        first = order[0]
        names = order[:len(keys)]
        reach = df.select(*names).orderBy(*names).limit(rows).agg(F.expr(f"max({first}) AS reach")).scalar()
        df = df.filter((F.col(first) <= reach) | F.col(first).isNull())
    return df.orderBy(*order).limit(rows)


def sample_hash(df: DataFrame, keys: Sequence[str] = (), rows: int = SAMPLE_ROWS,
                json_columns: Sequence[str] = ()) -> DataFrame:
    """``(sample_hash)``: SHA-256 over the texts of the sampled rows, one per line, in key order.

    Only ``rows`` short texts are ever brought together, whatever the table's size.
    """
    order = ", ".join(_sample_order(df, keys))
    text = row_text_sql(df, json_columns=json_columns)
    return sample_rows(df, keys, rows).agg(F.expr(
        f"sha2(array_join(transform(array_sort(collect_list(struct(struct({order}) AS k, {text} AS t))), r -> r.t), "
        r"'\n'), 256) AS sample_hash"))


def verify_table(pair: TablePair) -> DataFrame:
    """One report row. ``ok`` wants equal counts and whatever of sample and content was asked for.

    Where the columns differ, content cannot agree: counts are still compared, ``content_ok`` is false and ``error`` says why."""
    error = None
    if pair.content or pair.sample:
        try:
            same_columns(pair.source, pair.target)
        except ValueError as e:
            error, pair = str(e), replace(pair, content=False, sample=False)
    if pair.content:
        both = both_signed(pair.source, pair.target, json_columns=pair.json_columns).agg(*[F.expr(a) for a in NET_AGGREGATES])
        content = f"NOT {DIFFERS}"
    else:
        # counts read no column at all
        sides = pair.source.selectExpr("1 AS _side").unionAll(pair.target.selectExpr("-1 AS _side"))
        both, content = sides.agg(*[F.expr(a) for a in NET_AGGREGATES[:2]]), "false" if error else "cast(NULL AS boolean)"
    hashes = (F.expr("cast(NULL AS string)"),) * 2
    if pair.sample:
        # two one-row relations, read as scalars
        hashes = tuple(sample_hash(df, pair.keys, pair.sample_rows, pair.json_columns).scalar()
                       for df in (pair.source, pair.target))
    report = both.select("*", hashes[0].alias("source_sample_hash"), hashes[1].alias("target_sample_hash"))
    sample_ok = "source_sample_hash = target_sample_hash"
    return report.selectExpr(
        f"{sql_text(pair.name)} AS table_name", "source_rows", "target_rows", "source_sample_hash", "target_sample_hash",
        "source_rows = target_rows AS count_ok", f"{sample_ok} AS sample_ok", f"{content} AS content_ok",
        f"source_rows = target_rows AND coalesce({sample_ok}, true) AND coalesce({content}, true) AS ok",
        f"{'cast(NULL AS string)' if error is None else sql_text(error)} AS error")


def pairs_of_plan(plan: DataFrame, tables: dict[str, tuple[DataFrame, DataFrame]], keys: dict[str, tuple[str, ...]] | None = None,
                  sample_rows: int = SAMPLE_ROWS) -> list[TablePair]:
    """Pairs for the tables of a readiness report (one row per table), as deep as its ``depth`` asks for.

    Every depth but a plain count compares all rows: the sample of a small or risky table comes on top of its fingerprint,
    as the first rows alone say nothing of the others."""
    return [TablePair(r["table_name"], *tables[r["table_name"]], keys=tuple((keys or {}).get(r["table_name"], ())),
                      sample=r["depth"] == "rowcount_and_sample_hash", content=r["depth"] != "rowcount",
                      sample_rows=sample_rows)
            for r in plan.select("table_name", "depth").orderBy("table_name").collect() if r["table_name"] in tables]


def verify_tables(pairs: Sequence[TablePair]) -> DataFrame:
    """The report over many tables. The branches are independent stages of one job.

    A pair whose scan fails (a file that cannot be read) is found by running the pairs one by one; it
    is reported with its error and without counts, and the others as they are."""
    report = union_all(side_by_side(verify_table, pairs))
    try:
        return settle(report, "verification", files=1)
    except _FAILED:
        return settle(union_all(side_by_side(_verified_alone, pairs)), "verification", files=1)


def _reason(e: Exception) -> str:
    """The innermost cause, in one line."""
    cause = e.java_exception if isinstance(e, Py4JJavaError) else None
    while cause is not None and cause.getCause() is not None:
        cause = cause.getCause()
    return (str(cause.getMessage()) if cause is not None else str(e)).splitlines()[0][:500]


def _verified_alone(pair: TablePair) -> DataFrame:
    report = verify_table(pair)
    try:
        return settle(report, "verified", files=1)
    except _FAILED as e:
        known = {"table_name": sql_text(pair.name), "ok": "false", "error": sql_text(_reason(e))}
        return report.sparkSession.range(1).selectExpr(*[
            f"cast({known.get(f.name, 'NULL')} AS {f.dataType.simpleString()}) AS {f.name}" for f in report.schema.fields])


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Pairwise, so that plans of hundreds of tables stay shallow."""
    frames = list(frames)
    while len(frames) > 1:
        frames = [reduce(DataFrame.unionAll, frames[i: i + 2]) for i in range(0, len(frames), 2)]
    return frames[0]


def verify_summary(report: DataFrame) -> DataFrame:
    """``(ok, tables_checked, failed_tables, failed)``."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("table_name"))))
    return report.agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("ok"),
                      F.count(F.lit(1)).alias("tables_checked"),
                      F.count_if(~F.col("ok")).alias("failed_tables"),
                      F.array_join(failed, ",").alias("failed"))


def verify_view(fresh: DataFrame, saved: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Where a saved derived table no longer equals its query: see ``diff_rows``."""
    return diff_rows(fresh, saved.select(*fresh.columns), keys)


def verify_keys(tables: dict[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """``(table_name, key, broken_keys, ok)``: keys that repeat or hold a NULL, per table."""
    def one(item: tuple[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
        name, (df, keys) = item
        return check_pk(df, keys).agg(F.expr("count(*) AS broken_keys")).selectExpr(
            f"{sql_text(name)} AS table_name", f"{sql_text(','.join(keys))} AS key", "broken_keys",
            "broken_keys = 0 AS ok")

    return union_all(side_by_side(one, tables.items()))


def verification_depth(rows: Column, risk: Column | None = None, small_table: int = 100_000,
                       high_risk: int = 60, large: str = "rowcount_and_fingerprint") -> Column:
    """Sample hashes for small or risky tables, beside the fingerprint that all of them get (``pairs_of_plan``);
    it costs one scan at any size. ``large="rowcount"`` gives plans that count large tables of low risk only."""
    deep = F.coalesce(rows, F.lit(0)) <= small_table
    if risk is not None:
        deep = deep | (risk >= high_risk)
    return F.when(deep, "rowcount_and_sample_hash").otherwise(large)
