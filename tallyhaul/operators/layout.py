"""Range partitions and clustered files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.canonical import quoted
from ..sources import storage
from ..sources.storage import settle
from ..sources.tables import in_range


def route_range(col: Column, children: Sequence[tuple[str, object, object]], default: str | None = None) -> Column:
    """Name of the child ``(name, low, high)`` whose half-open range holds the value, else ``default``.

    A bound of None is open. NULL values go to ``default``, as no range holds them.
    A search tree of comparisons inside the scan stage: no join, and about
    log2(children) tests per row.
    """
    lowest = [c for c in children if c[1] is None]
    ordered = lowest + sorted((c for c in children if c[1] is not None), key=lambda c: c[1])
    for (a, _, high), (b, low, _) in zip(ordered, ordered[1:]):
        if high is None or low is None or low < high:
            raise ValueError(f"children {a} and {b} overlap")

    def build(part: Sequence[tuple[str, object, object]]) -> Column:
        if len(part) == 1:
            name, low, high = part[0]
            return F.when(col.isNotNull() & in_range(col, low, high), F.lit(name))
        mid = len(part) // 2
        return F.when(col < F.lit(part[mid][1]), build(part[:mid])).otherwise(build(part[mid:]))

    found = build(ordered) if ordered else F.lit(None).cast("string")
    return found if default is None else F.coalesce(found, F.lit(default))


def route_list(col: Column, children: dict[str, Sequence], default: str | None = None) -> Column:
    """Name of the child whose list has the value; None in a list takes NULL values."""
    seen: dict = {}
    for name, values in children.items():
        for v in values:
            if seen.setdefault(v, name) != name:
                raise ValueError(f"children {seen[v]} and {name} both take {v!r}")
    out = F.lit(default).cast("string")
    for name, values in children.items():
        test = col.isin([v for v in values if v is not None])
        if None in values:
            test = F.coalesce(test, F.lit(False)) | col.isNull()
        out = F.when(test, F.lit(name)).otherwise(out)
    return out


def route_hash(columns: Sequence[Column], children: Sequence[str]) -> Column:
    """Name of the child by Spark's hash of the key modulo their number. A database that hashes otherwise
    spreads rows over other children; each child is then a share of the rows and not its copy."""
    number = F.pmod(F.xxhash64(*columns), F.lit(len(children)))
    return F.element_at(F.array(*[F.lit(c) for c in children]), (number + 1).cast("int"))


def routed_counts(df: DataFrame, column: str, children: Sequence[tuple[str, object, object]],
                  default: str | None = None) -> DataFrame:
    """``(child, row_count)``; rows without a child are left to :func:`unrouted`."""
    child = route_range(quoted(column), children, default)
    return (df.select(child.alias("child")).filter("child IS NOT NULL").groupBy("child")
            .agg(F.count(F.lit(1)).alias("row_count")))


def unrouted(df: DataFrame, column: str, children: Sequence[tuple[str, object, object]]) -> DataFrame:
    """Rows that no child takes; a load into the partitioned table would fail on them."""
    return df.filter(route_range(quoted(column), children).isNull())


def file_position() -> Column:
    """A row's place in its file: tells equal rows apart and is the same however often a task is run.
    Only for DataFrames that are read straight from files."""
    return F.xxhash64("_metadata.file_path", "_metadata.row_index")


def with_position(df: DataFrame, position: Column | None, name: str = "_pos") -> DataFrame:
    """Adds ``position``. Without one the rows are written to the shared folder first and take their
    place there: a counter per task would change when a task runs again on rows in another order."""
    if position is None:
        df, position = settle(df, "positions"), file_position()
    return df.select("*", position.alias(name))


def clustered(df: DataFrame, columns: Sequence[str], files: int, position: Column | None = None) -> DataFrame:
    """Sorted into ``files`` key ranges. The row's position breaks ties, so a value that
    fills a third of the table is cut over several ranges and not sorted by one task.

    Give :func:`file_position` when ``df`` is a file scan; that saves a write.
    """
    names = [quoted(c) for c in columns]
    return (with_position(df, position).repartitionByRange(files, *names, F.col("_pos"))
            .sortWithinPartitions(*names).drop("_pos"))


def write_clustered(df: DataFrame, path: str, columns: Sequence[str], files: int | None = None,
                    position: Column | None = None, mode: str = "errorifexists") -> None:
    """Without ``files`` the rows are stored first, and their size gives the number."""
    if files is None:
        folder = storage.scratch(df.sparkSession, "clustering") + "/rows"
        df.write.parquet(folder)
        files = storage.files_for(df.sparkSession, folder)
        df, position = df.sparkSession.read.schema(df.schema).parquet(folder), file_position()
    clustered(df, columns, files, position).write.mode(mode).parquet(path)
