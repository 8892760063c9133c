"""Reading and writing tables: Parquet directories, catalog tables and JDBC relations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.canonical import quoted


@dataclass(frozen=True)
class JdbcTable:
    """A relation behind a JDBC URL. ``relation`` is a table name or ``(SELECT …) q``."""

    url: str
    relation: str
    properties: dict[str, str] = field(default_factory=dict)


def read_table(spark: SparkSession, ref: str | JdbcTable, columns: Sequence[str] | None = None) -> DataFrame:
    """A path (has a ``/``) is Parquet; any other string is a catalog name."""
    if isinstance(ref, JdbcTable):
        df = spark.read.format("jdbc").options(**jdbc_options(ref)).load()
    elif "/" in ref:
        df = spark.read.parquet(ref)
    else:
        df = spark.table(ref)
    return df.select(*[quoted(c) for c in columns]) if columns else df


def jdbc_options(ref: JdbcTable, fetch_size: int = 10_000) -> dict[str, str]:
    return {"url": ref.url, "dbtable": ref.relation, "fetchsize": str(fetch_size), **ref.properties}


def jdbc_range_options(ref: JdbcTable, column: str, low, high, partitions: int) -> dict[str, str]:
    """Parallel range read. Outer ranges are open and NULL keys land in the first one."""
    return {**jdbc_options(ref), "partitionColumn": column, "lowerBound": str(low), "upperBound": str(high),
            "numPartitions": str(partitions)}


def range_predicates(column: str, bounds: Sequence) -> list[str]:
    """One SQL predicate per range between sorted inner ``bounds``: half-open, open at both
    ends, and with a home for NULL keys, so every row is read exactly once."""
    def literal(v) -> str:
        return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

    bounds = list(bounds)
    if not bounds:
        return ["1 = 1"]
    out = [f"{column} < {literal(bounds[0])} OR {column} IS NULL"]
    out += [f"{column} >= {literal(a)} AND {column} < {literal(b)}" for a, b in zip(bounds, bounds[1:])]
    out.append(f"{column} >= {literal(bounds[-1])}")
    return out


def read_jdbc_ranges(spark: SparkSession, ref: JdbcTable, column: str, bounds: Sequence) -> DataFrame:
    """One task per range; use bounds from :func:`balanced_bounds` when keys are uneven."""
    return spark.read.jdbc(ref.url, ref.relation, predicates=range_predicates(column, bounds),
                           properties={"fetchsize": "10000", **ref.properties})


def read_chunked(spark: SparkSession, ref: JdbcTable, column: str, low, high, chunks: int) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_range_options(ref, column, low, high, chunks)).load()


def write_jdbc(df: DataFrame, ref: JdbcTable, truncate: bool = False, max_connections: int = 16,
               batch_size: int = 10_000) -> None:
    """Batched insert. ``truncate`` empties the target but keeps its definition, keys and indexes."""
    (df.write.format("jdbc").options(**{k: v for k, v in jdbc_options(ref).items() if k != "fetchsize"})
       .option("batchsize", batch_size).option("numPartitions", max_connections).option("truncate", truncate)
       .mode("overwrite" if truncate else "append").save())


def balanced_bounds(df: DataFrame, column: str, chunks: int, accuracy: int = 10_000) -> list:
    """At most ``chunks - 1`` inner bounds that cut the table into parts of like row counts."""
    shares = [i / chunks for i in range(1, chunks)]
    if not shares:
        return []
    row = df.agg(F.percentile_approx(quoted(column), shares, accuracy).alias("b")).first()
    return sorted(set(row["b"] or []))


def in_range(col: Column, low, high) -> Column:
    """Half-open bound ``low <= col < high``; ``None`` leaves that end open."""
    test = F.lit(True)
    if low is not None:
        test = test & (col >= F.lit(low))
    if high is not None:
        test = test & (col < F.lit(high))
    return test


def write_report(df: DataFrame, path: str) -> None:
    """A report (one row per table) as one JSON file, fields in name order, NULL ones too."""
    df.select(*[quoted(c) for c in sorted(df.columns)]).coalesce(1).write.mode("overwrite").option(
        "ignoreNullFields", "false").json(path)
