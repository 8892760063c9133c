"""Files clustered by several columns at once, along a Hilbert curve.

A sort by (a, b) makes files narrow in a and as wide as the table in b. Here each column's values are replaced by
their rank among its quantiles, the ranks are a cell of a grid with as many columns as are clustered, and rows are range-sorted by the
cell's place on the Hilbert curve through that grid. Neighbours on the curve are neighbours in the grid, so every
file is narrow in every column and statistics of files skip most of them whichever column is filtered.

The curve is followed bit by bit with a small state table, made by Hamilton's rule for any number of columns ("Compact Hilbert
Indices", 2006). Only the quantiles (their number is a parameter) pass through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions.canonical import quoted, sql_name, sql_text
from ..sources import storage
from .layout import file_position, with_position


def curve_table(n: int) -> tuple[list[int], list[int]]:
    """``(digit, following)`` for the curve in n dimensions, both by ``state * 2**n + corner``.

    A state is the corner where the curve enters a cell and the axis along which it leaves; bit j of a corner is its half along axis j.
    """
    size = 1 << n

    def turn(x: int, by: int) -> int:
        by %= n
        return (x << by | x >> (n - by)) & (size - 1)

    def gray(i: int) -> int:
        return i ^ i >> 1

    def entry(w: int) -> int:
        return 0 if w == 0 else gray((w - 1) // 2 * 2)

    def axis(w: int) -> int:
        if w == 0:
            return 0
        ones = w if w & 1 else w - 1  # how many ones it ends in
        return ((ones ^ ones + 1).bit_length() - 1) % n

    rank = {gray(i): i for i in range(size)}
    digit, following = [], []
    for enter in range(size):
        for direction in range(n):
            for corner in range(size):
                w = rank[turn(corner ^ enter, n - direction - 1)]
                digit.append(w)
                following.append((enter ^ turn(entry(w), direction + 1)) * n + (direction + axis(w) + 1) % n)
    return digit, following


def curve_position(ranks: Sequence[str], bits: int) -> str:
    """SQL for the place on the curve (from 0) of the cell with these rank columns, each below ``2**bits``."""
    n = len(ranks)
    if n * bits > 62:
        raise ValueError("the place on the curve would not fit a bigint")
    digit, following = curve_table(n)
    corner = " + ".join(f"shiftleft(shiftright({r}, i) & 1, {j})" for j, r in enumerate(ranks))
    at = f"a.state * {1 << n} + {corner}"
    return (f"aggregate(sequence({bits - 1}, 0, -1), named_struct('state', 0, 'place', 0L), (a, i) -> named_struct("
            f"'state', array({', '.join(map(str, following))})[{at}], "
            f"'place', a.place * {1 << n} + array({', '.join(map(str, digit))})[{at}]), a -> a.place)")


def _number(df: DataFrame, name: str) -> str:
    """SQL for a double that rises with the column. Where values share one (long whole numbers, texts that begin with the same
    seven bytes), the sort by the columns themselves tells them apart."""
    dtype, col = df.schema[name].dataType, sql_name(name)
    if isinstance(dtype, T.StringType):
        head = f"rpad(hex(substring(cast({col} AS binary), 1, 7)), 14, '0')"
        return f"cast(conv({head}, 16, 10) AS double)"
    if isinstance(dtype, T.DateType):
        return f"cast(unix_date({col}) AS double)"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return f"cast(unix_micros(cast({col} AS timestamp)) AS double)"
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return f"cast({col} AS double)"
    raise ValueError(f"{name}: no clustering by {dtype.simpleString()}")


def _rank(value: str, bits: int, bounds: Sequence[float]) -> str:
    """SQL: how many of the ``2**bits - 1`` ascending bounds are below the value, by bisection; 0 for NULL."""
    listed = ", ".join(f"double('{b}')" for b in bounds)
    half = "shiftleft(1, i)"
    return (f"if({value} IS NULL, 0, aggregate(sequence({bits - 1}, 0, -1), 0, (low, i) -> "
            f"low + if(array({listed})[low + {half} - 1] < {value}, {half}, 0)))")


def with_curve(df: DataFrame, columns: Sequence[str], bits: int, name: str = "_curve") -> DataFrame:
    """Adds each row's place on the curve.

    One aggregate over the clustered columns finds approximate quantiles; ``2**bits - 1`` numbers per column come to the
    driver, whatever the size of the table. NULLs rank first; a column without values has rank 0 everywhere.
    """
    if not columns or len(set(columns)) < len(columns):
        raise ValueError("name each clustered column once")
    if name in df.columns:
        raise ValueError(f"{name} is a column of the table")
    numbers = [_number(df, c) for c in columns]
    shares = ", ".join(f"{i / (1 << bits)!r}D" for i in range(1, 1 << bits))
    bounds = df.agg(*[F.expr(f"percentile_approx({v}, array({shares}), {max(10_000, 8 << bits)}) AS b{j}")
                      for j, v in enumerate(numbers)]).first()
    ranks = [_rank(v, bits, b) if b else "0" for v, b in zip(numbers, bounds)]
    ranked = df.select("*", F.expr(f"array({', '.join(ranks)})").alias(name))
    place = curve_position([f"{sql_name(name)}[{j}]" for j in range(len(columns))], bits)
    return ranked.withColumn(name, F.expr(place))


def write_hilbert(df: DataFrame, path: str, columns: Sequence[str], files: int | None = None, position: Column | None = None,
                  bits: int | None = None, mode: str = "errorifexists") -> None:
    """Write ``df`` in about ``files`` files along the curve; ``position`` as in ``layout.clustered``.

    Without ``files`` the rows are stored first, and their size gives the number. ``bits`` defaults to sixteen cells a file or more.
    Rows of one cell are ordered by the columns, then by position: a cell or a value that holds a third of all rows is cut over several files.
    """
    spark = df.sparkSession
    if files is None:
        folder = storage.scratch(spark, "hilbert") + "/rows"
        df.write.parquet(folder)
        files = storage.files_for(spark, folder)
        df, position = spark.read.schema(df.schema).parquet(folder), file_position()
    bits = bits or min(12, max(2, ceil((log2(max(files, 1)) + 4) / len(columns))))
    placed = with_curve(with_position(df, position), columns, bits)
    order = [F.col("_curve"), *map(quoted, columns), F.col("_pos")]
    placed.repartitionByRange(files, *order).sortWithinPartitions(*order).drop("_curve", "_pos").write.mode(mode).parquet(path)


def overlaps(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column_name, row_count, files, overlapping_pairs)`` for a table read from files: how many pairs of files have ranges
    of the column that meet. Files that hold NULL only have no range. After one scan there is one row per file and column.

    Pairs are counted by a sweep over range ends, not by joining files with files.
    """
    stats = df.groupBy(F.col("_metadata.file_path").alias("_file")).agg(F.count(F.lit(1)).alias("_n"), *[
        F.expr(f"named_struct('low', min({_number(df, c)}), 'high', max({_number(df, c)})) AS _c{j}") for j, c in enumerate(columns)])
    entries = ", ".join(f"named_struct('c', {sql_text(c)}, 'r', _c{j})" for j, c in enumerate(columns))
    ranges = stats.selectExpr("_n", f"inline(array({entries}))").selectExpr("c AS column_name", "_n", "r.low", "r.high")
    # a range that begins meets those that are open; one that ends where another begins is open still
    ends = ranges.selectExpr("column_name", "_n", "stack(2, low, 0, high, 1) AS (at, closes)")
    before = W.partitionBy("column_name").orderBy("at", "closes").rowsBetween(W.unboundedPreceding, -1)
    swept = ends.withColumn("open", F.coalesce(F.sum(F.expr("if(at IS NULL, 0, 1 - 2 * closes)")).over(before), F.lit(0)))
    opens = F.expr("closes = 0")
    return swept.groupBy("column_name").agg(
        F.sum(F.when(opens, F.col("_n"))).alias("row_count"), F.count_if(opens).alias("files"),
        F.coalesce(F.sum(F.when(opens & F.col("at").isNotNull(), F.col("open"))), F.lit(0)).alias("overlapping_pairs"))
