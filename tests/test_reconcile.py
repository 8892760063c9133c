"""Sketches, stored trees, discovery of keys, views kept up to date: against plain versions on small tables."""

import random
from datetime import date
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tallyhaul.operators import compare, discovery, iblt, incremental, layout, merkle
from tallyhaul.sources import storage


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- sketches -------------------------------------------------------------------------

SCHEMA = "id bigint, day date, name string, v double"


def mixed(spark, ids, change=0):
    data = [(i, date(2020, 1, 1 + i % 28), None if i % 7 == 0 else f"näme {i}" * (i % 4), float(i + change * (i % 50 == 0))) for i in ids]
    return spark.createDataFrame(data, SCHEMA)


@pytest.mark.parametrize("keys", [["id"], ["name", "id"], ["day", "id"]])
def test_sketch_finds_what_the_row_diff_finds(spark, keys):
    source, target = mixed(spark, range(-300, 300)), mixed(spark, range(-250, 340), change=1)
    want = rows(compare.diff_rows(source, target, keys).select(*keys, "status"))
    assert rows(iblt.sketch_diff(source, target, keys, cells=600).select(*keys, "status")) == want
    if len(keys) == 1:
        assert rows(iblt.sketch_diff(source, target, keys, cells=90).select(*keys, "status")) == want  # doubled until it is enough
        with pytest.raises(iblt.UndecodedError):
            iblt.sketch_diff(source, target, keys, cells=12, most_cells=20)


def test_sketch_edges(spark):
    source = mixed(spark, range(50))
    same = iblt.sketch_diff(source, source, ["id"])
    assert same.collect() == [] and same.columns == ["id", "status", "source_rows", "target_rows"]
    none = source.limit(0)
    assert iblt.sketch_diff(none, none, ["id"]).collect() == []
    assert iblt.sketch_diff(source, none, ["id"]).count() == 50
    copies = source.filter("id < 3").unionAll(source.filter("id < 3")).unionAll(source)  # rows that repeat add up
    assert rows(iblt.sketch_diff(copies, source, ["id"])) == [(i, "missing_in_target", 2, 0) for i in range(3)]
    nulls = spark.createDataFrame([(None, "a"), (1, None), (None, None)], "k int, t string")
    assert rows(iblt.sketch_diff(nulls, nulls.limit(0), ["k", "t"])) == sorted([(*r, "missing_in_target", 1, 0) for r in map(tuple, nulls.collect())], key=str)
    with pytest.raises(Exception, match="text_bytes"):
        iblt.sketch_diff(nulls, spark.range(1).selectExpr("cast(id AS int) AS k", "repeat('x', 9) AS t"), ["t"], text_bytes=4).collect()
    with pytest.raises(ValueError, match="cannot be summed"):
        iblt.sketch_diff(source, source, ["v"])


def test_sketches_of_two_clusters(spark, tmp_path):
    """Each side is summed alone and stored; the sketch is no larger than its cells, and its exchange no larger than that per task."""
    source, target = mixed(spark, range(3000)), mixed(spark, range(10, 3000))
    for name, df in (("s", source), ("t", target)):
        iblt.sketch(df, ["id"], 90).write.parquet(f"{tmp_path}/{name}")
    stored = [spark.read.parquet(f"{tmp_path}/{n}") for n in "st"]
    assert all(s.count() <= 90 for s in stored)
    assert rows(iblt.decode(*stored, source.schema, ["id"], 90)) == sorted([(i, "missing_in_target", 1, 0) for i in range(10)], key=str)


# --- trees ------------------------------------------------------------------------------

def stored_table(spark, path, n=4000):
    df = spark.range(n).selectExpr("id AS k", "id % 7 AS v", "cast(id AS string) AS t")
    layout.write_clustered(df, path, ["k"], files=8)
    return df


def test_tree_reads_only_what_changed(spark, tmp_path):
    paths = [f"{tmp_path}/{n}" for n in "ab"]
    for p in paths:
        stored_table(spark, p)
    trees = [merkle.refresh(spark, p, f"{p}_tree", "k", leaf_width=50, fanout=4) for p in paths]
    assert [t.scanned for t in trees] == [8, 8] and trees[0].depth == 3
    assert merkle.merkle_diff(spark, *trees, ["k"]).collect() == []
    assert merkle.refresh(spark, paths[1], f"{paths[1]}_tree", "k", leaf_width=50, fanout=4) == trees[1]  # nothing was written, nothing is read

    spark.createDataFrame([(1234, 99, "new"), (-5, 0, "below")], "k bigint, v bigint, t string").coalesce(1).write.mode("append").parquet(paths[1])
    again = merkle.refresh(spark, paths[1], f"{paths[1]}_tree", "k", leaf_width=50, fanout=4)
    assert again.scanned == 1
    leaves = merkle.differing_leaves(spark, trees[0], again)
    assert sorted(r.leaf for r in leaves.collect()) == [-1, 24]
    read = merkle._rows_of(spark, again, leaves, merkle._ranges(leaves))
    assert read.count() == 52 and len(read.inputFiles()) == 2  # of 4002 rows in 9 files
    assert rows(merkle.merkle_diff(spark, trees[0], again, ["k"])) == sorted(
        [(1234, "changed", 1, 2), (-5, "missing_in_source", 0, 1)], key=str)
    assert rows(merkle._rows_of(spark, again, leaves, None)) == rows(read)  # more ranges than a filter takes

    gone = next(f for f in read.inputFiles())
    storage.remove(spark, gone)
    after = merkle.refresh(spark, paths[1], f"{paths[1]}_tree", "k", leaf_width=50, fanout=4)
    assert after.scanned == 0
    whole = [spark.read.parquet(p) for p in paths]
    assert rows(merkle.merkle_diff(spark, trees[0], after, ["k"])) == rows(compare.diff_rows(*whole, ["k"]))
    assert len(merkle._versions(spark, f"{paths[1]}_tree")) == 2


def test_tree_of_null_keys_and_no_rows(spark, tmp_path):
    for name, data in (("a", [(None, 1), (3, 1), (3, 1)]), ("b", [(None, 2), (3, 1)]), ("c", [])):
        spark.createDataFrame(data, "k int, v int").write.parquet(f"{tmp_path}/{name}")
    a, b, c = (merkle.refresh(spark, f"{tmp_path}/{n}", f"{tmp_path}/{n}_tree", "k") for n in "abc")
    assert rows(merkle.merkle_diff(spark, a, b, ["k"])) == sorted([(None, "changed", 1, 1), (3, "changed", 2, 1)], key=str)
    assert rows(merkle.merkle_diff(spark, a, c, ["k"])) == sorted([(None, "missing_in_target", 1, 0), (3, "missing_in_target", 2, 0)], key=str)
    with pytest.raises(ValueError):
        merkle.refresh(spark, f"{tmp_path}/a", f"{tmp_path}/a_tree", "k", leaf_width=9)


def test_half_a_refresh_is_done_again(spark, tmp_path, monkeypatch):
    stored_table(spark, f"{tmp_path}/a", 100)
    with monkeypatch.context() as m:
        m.setattr(storage, "write_text", lambda *_: (_ for _ in ()).throw(IOError("lost")))
        with pytest.raises(IOError):
            merkle.refresh(spark, f"{tmp_path}/a", f"{tmp_path}/tree", "k")
    assert merkle.open_tree(spark, f"{tmp_path}/tree") is None
    assert merkle.refresh(spark, f"{tmp_path}/a", f"{tmp_path}/tree", "k").scanned == 8


# --- discovery ----------------------------------------------------------------------------

def plain_keys(data, columns, most=3):
    found = []
    for size in range(1, most + 1):
        for s in combinations(range(len(columns)), size):
            if any(set(k) <= set(s) for k in found):
                continue
            values = [tuple(r[i] for i in s) for r in data]
            if len(set(values)) == len(values) and not any(v is None for row in values for v in row):
                found.append(s)
    return sorted(tuple(columns[i] for i in s) for s in found)


def test_minimal_keys(spark):
    r, columns = random.Random(8), ["a", "b", "c", "d", "e`x"]
    for n, sizes, sample in ((0, (2,) * 5, 5), (1, (2,) * 5, 5), (12, (3, 4, 4, 12, 2), 100), (200, (15, 15, 4, 200, 3), 5)):
        data = [tuple(None if i == 4 and r.random() < 0.02 else r.randrange(s) for i, s in enumerate(sizes)) for _ in range(n)]
        df = spark.createDataFrame(data, ", ".join(f"`{c.replace('`', '``')}` int" for c in columns)).withColumn("nested", F.array("a"))
        assert sorted(discovery.minimal_keys(df, sample_rows=sample)) == plain_keys(data, columns), n


def test_many_sets_take_more_passes(spark, monkeypatch):
    monkeypatch.setattr(discovery, "SETS_PER_PASS", 3)
    df = spark.range(60).selectExpr("id % 3 AS a", "id % 4 AS b", "id % 5 AS c", "id AS d")
    assert discovery.minimal_keys(df, sample_rows=10) == [("d",), ("a", "b", "c")]


def test_inclusions(spark):
    a = spark.createDataFrame([(1, "x", None, 0.0), (2, "y", None, -0.0), (None, "x", None, 1.0)], "i int, s string, n int, f double")
    b = spark.createDataFrame([(1, "x", [1]), (2, "y", [1]), (3, "z", [2])] + [(3, "z", [2])] * 50, "j bigint, s string, l array<int>")
    empty = spark.createDataFrame([], "k int")
    got = rows(discovery.inclusions({"a": a, "b": b, "none": empty}))
    assert got == [("a", "i", "b", "j", 2), ("a", "s", "b", "s", 2)]
    assert rows(discovery.inclusions({"a": a, "again": a}))[0] == ("a", "f", "again", "f", 2)


# --- views ----------------------------------------------------------------------------------

VIEW = incremental.JoinView({"k": "fk"}, {"p": "p", "g": "g"}, {"q": "q", "m": "cast(m AS decimal(9,2))"}, "p")


def tables(spark, r, n=40):
    left = [(k, r.choice(["x", "y", "z", None]), r.randrange(2)) for k in range(n)] + [(None, "x", 0)]
    right = [(r.choice([*range(n + 5), None]), r.randrange(100), r.choice([None, 1.25, 2.5])) for _ in range(3 * n)]
    return spark.createDataFrame(left, "k int, p string, g int"), spark.createDataFrame(right, "fk int, q bigint, m double")


def test_view_after_changes_is_the_view_computed_anew(spark, tmp_path):
    r = random.Random(3)
    left, right = tables(spark, r)
    path = f"{tmp_path}/view"
    VIEW.save(left, right, path)
    for step in range(3):
        dl = incremental.changes(spark.createDataFrame([(100 + step, "w", 1), (3, "y", step)], left.schema), left.filter(f"k % 9 = {step}"))
        dr = incremental.changes(spark.createDataFrame([(100 + step, 7, 1.0), (step, 1, None)], right.schema), right.filter(f"q % 8 = {step}"))
        dl, dr = (dl, None) if step == 1 else (None, dr) if step == 2 else (dl, dr)
        VIEW.update(spark, path, left, right, dl, dr)
        left, right = (storage.settle(incremental.applied(t, c), "t") if c is not None else t for t, c in ((left, dl), (right, dr)))
        saved, fresh = spark.read.parquet(path), VIEW.computed(left, right)
        assert rows(saved.select(*fresh.columns)) == rows(fresh)


def test_only_touched_partitions_are_written_and_empty_ones_go(spark, tmp_path):
    left = spark.createDataFrame([(1, "x", 0), (2, "y", 0), (3, None, 0), (4, "a/b c", 0)], "k int, p string, g int")
    right = spark.createDataFrame([(k, 10 * k, 1.0) for k in (1, 2, 3, 4)], "fk int, q bigint, m double")
    path = f"{tmp_path}/view"
    VIEW.save(left, right, path)
    before = set(spark.read.parquet(path).inputFiles())
    assert VIEW.update(spark, path, left, right, None, incremental.changes(deleted=right.filter("fk = 9"))) == []
    assert VIEW.update(spark, path, left, right, incremental.changes(deleted=left.filter("k IN (2, 3, 4)"))) == [None, "a/b c", "y"]
    after = spark.read.parquet(path)
    assert [(x.p, x.n, x.q) for x in after.collect()] == [("x", 1, 10)]
    assert set(after.inputFiles()) == {f for f in before if "p=x" in f}
    assert storage.children(spark, path) and not storage.exists(spark, f"{path}/p=y")
    with pytest.raises(Exception, match="not in the table"):
        incremental.applied(left, incremental.changes(deleted=spark.createDataFrame([(77, "q", 0)], left.schema))).collect()
