"""Files along a Hilbert curve, and texts of doubles that other engines can write."""

import math
from itertools import product

import pytest

from tallyhaul.functions import canonical
from tallyhaul.operators import hilbert, layout


@pytest.mark.parametrize("n,bits", [(1, 4), (2, 4), (3, 2), (4, 1)])
def test_the_curve_visits_each_cell_once_and_steps_to_neighbours(spark, n, bits):
    cells = [list(c) for c in product(range(1 << bits), repeat=n)]
    df = spark.createDataFrame([(c,) for c in cells], "r array<int>")
    rows = df.selectExpr("r", f"{hilbert.curve_position([f'r[{j}]' for j in range(n)], bits)} AS at").collect()
    path = [r["r"] for r in sorted(rows, key=lambda r: r["at"])]
    assert sorted(r["at"] for r in rows) == list(range(len(cells)))
    assert all(sum(abs(a - b) for a, b in zip(x, y)) == 1 for x, y in zip(path, path[1:]))


def test_files_are_narrow_in_both_columns_and_hold_every_row(spark, tmp_path):
    base = spark.range(4000).selectExpr("cast(id % 97 AS int) AS a", "concat('k', lpad(cast(id * 7919 % 4001 AS string), 5, '0')) AS b", "id")
    base.write.parquet(f"{tmp_path}/in")
    df = spark.read.parquet(f"{tmp_path}/in")
    hilbert.write_hilbert(df, f"{tmp_path}/curve", ["a", "b"], 16, layout.file_position())
    layout.write_clustered(df, f"{tmp_path}/sorted", ["a", "b"], 16, layout.file_position())
    curve, by_sort = (spark.read.parquet(f"{tmp_path}/{x}") for x in ("curve", "sorted"))
    assert curve.exceptAll(base).isEmpty() and base.exceptAll(curve).isEmpty()
    found = [{r["column_name"]: r for r in hilbert.overlaps(x, ["a", "b"]).collect()} for x in (curve, by_sort)]
    assert found[0]["b"]["overlapping_pairs"] < found[1]["b"]["overlapping_pairs"] == 16 * 15 // 2
    assert found[0]["a"]["row_count"] == 4000 and found[0]["a"]["files"] == 16


def test_overlaps_are_those_of_all_pairs(spark, tmp_path):
    hot = spark.range(900).selectExpr("if(id % 3 = 0, 5, id * 31 % 50) AS a", "if(id % 10 = 0, NULL, id * 17 % 90) AS b")
    hilbert.write_hilbert(hot, f"{tmp_path}/t", ["a", "b"], 7)
    df = spark.read.parquet(f"{tmp_path}/t")
    files = df.groupBy("_metadata.file_path").agg({"*": "count"}).count()
    for name in "ab":
        ends = [(r[1], r[2]) for r in df.groupBy("_metadata.file_path").agg({name: "min"}).join(
            df.groupBy("_metadata.file_path").agg({name: "max"}), "file_path").collect() if r[1] is not None]
        pairs = sum(x[0] <= y[1] and y[0] <= x[1] for i, x in enumerate(ends) for y in ends[:i])
        row = hilbert.overlaps(df, [name]).first()
        assert (row["row_count"], row["files"], row["overlapping_pairs"]) == (900, files, pairs)


def test_nulls_empty_tables_and_hot_values(spark, tmp_path):
    empty = spark.createDataFrame([], "a int, b string, `x.y` double")
    hilbert.write_hilbert(empty, f"{tmp_path}/empty", ["a", "x.y"])
    assert spark.read.schema(empty.schema).parquet(f"{tmp_path}/empty").isEmpty()
    nulls = spark.range(50).selectExpr("cast(NULL AS date) AS a", "if(id = 3, double('NaN'), double(id)) AS b", "timestamp_micros(id) AS t")
    hilbert.write_hilbert(nulls, f"{tmp_path}/nulls", ["a", "b", "t"], 4)
    assert spark.read.parquet(f"{tmp_path}/nulls").count() == 50
    hot = spark.range(3000).selectExpr("if(id % 3 = 0, 7, id) AS a", "if(id % 3 = 0, 7, -id) AS b")
    hilbert.write_hilbert(hot, f"{tmp_path}/hot", ["a", "b"], 8)
    largest = spark.read.parquet(f"{tmp_path}/hot").groupBy("_metadata.file_path").count().agg({"count": "max"}).first()[0]
    assert largest < 900  # the cell of a third of all rows lies in several files
    with pytest.raises(ValueError):
        hilbert.write_hilbert(hot, f"{tmp_path}/bad", ["a", "a"])
    with pytest.raises(ValueError):
        hilbert.with_curve(spark.sql("SELECT map(1, 2) AS m"), ["m"], 2)


def test_portable_doubles(spark):
    def text(x):
        if x is None:
            return None
        if x != x or math.isinf(x):
            return "NaN" if x != x else "Infinity" if x > 0 else "-Infinity"
        if abs(x) < 1e11 and float(f"{x:.4f}") == x:
            return f"{x + 0.0:.4f}"
        mantissa, power = x.hex().split("p")
        mantissa = mantissa.rstrip("0").rstrip(".") if "." in mantissa else mantissa
        return f"{mantissa}p{int(power)}"

    values = [None, 0.0, -0.0, 1.0, -2.5, 1e7, 12345678.9, 0.00012, 1e-3, 1e22, -3e300, 1 / 3, 5e-324, 99_999_999_999.9999, 1e11,
              123456789.00005, float("nan"), float("inf"), -float("inf"), 0.1 + 0.2, 4294967296.0 * 4096]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r[0] for r in df.orderBy("i").selectExpr(canonical.portable_double("v")).collect()]
    assert got == [text(v) for v in values]
    assert [r[0] for r in spark.sql("SELECT float(1.5) AS v").selectExpr(canonical.portable_double("v")).collect()] == ["1.5000"]


def test_a_difference_behind_the_sample_of_a_risky_table_is_found(spark):
    from tallyhaul.operators import verify

    source = spark.range(200).selectExpr("id", "id * 2 AS v")
    target = source.selectExpr("id", "if(id = 51, -1, v) AS v")
    plan = spark.createDataFrame([("risky", "rowcount_and_sample_hash")], "table_name string, depth string")
    row = verify.verify_tables(verify.pairs_of_plan(plan, {"risky": (source, target)}, {"risky": ("id",)})).first()
    assert (row["count_ok"], row["sample_ok"], row["content_ok"], row["ok"]) == (True, True, False, False)
