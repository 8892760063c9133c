"""Copies that keep every column and part, reports that survive a bad table, open routes, streams of many batches."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyhaul.functions import canonical
from tallyhaul.operators import compare, copy, integrity, keys, layout, verify, views
from tallyhaul.plans import catalog, readiness
from tallyhaul.sources import seed, storage, tables
from tallyhaul.streaming import streams


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- copies -------------------------------------------------------------------------

def test_layout_column_never_takes_a_source_columns_place(spark, tmp_path):
    df = spark.createDataFrame([(1, "mine"), (2, None), (None, "x")], "id bigint, chunk string")
    with pytest.raises(ValueError, match="chunk"):
        copy.copy_chunked(df, f"{tmp_path}/t", "id", 2)
    with pytest.raises(ValueError, match="CHUNK"):
        copy.copy_partition_wise(df, f"{tmp_path}/p", "CHUNK", F.col("id"))
    copy.copy_chunked(df, f"{tmp_path}/t", "id", 2, name="key_range")
    back = copy.read_copied(spark, f"{tmp_path}/t", df.schema)
    assert back.schema == df.schema and rows(back) == rows(df)
    assert verify.verify_table(verify.TablePair("t", df, back, ("id",))).first()["ok"]


def test_parts_with_odd_names_and_null(spark, tmp_path):
    path = f"{tmp_path}/t"
    df = spark.createDataFrame([(i, g) for i, g in enumerate(["a:b", "a/b", "x y", None, "%", "plain", "a:b"])], "id int, g string")
    copy.copy_partition_wise(df, path, "p", F.col("g"))
    assert rows(copy.read_copied(spark, path, df.schema)) == rows(df)
    newer = df.filter("g IS NULL OR g <> 'a:b'").withColumn("id", F.col("id") + 10)
    copy.copy_partition_wise(newer, path, "p", F.col("g"), only=["a:b", "%", None], allow_destructive=True)
    want = rows(df.filter("g NOT IN ('a:b', '%')").unionAll(newer.filter("g = '%' OR g IS NULL")))
    assert rows(copy.read_copied(spark, path, df.schema)) == want
    assert not [f for f in tmp_path.iterdir() if "staging" in f.name]


def test_chosen_parts_are_checked_before_they_are_swapped(spark, tmp_path, monkeypatch):
    path, df = f"{tmp_path}/t", spark.createDataFrame([(1, "a"), (2, None)], "id int, g string")
    copy.copy_partition_wise(df, path, "p", F.col("g"))
    write = copy._write_parts
    monkeypatch.setattr(copy, "_write_parts", lambda d, *a: write(d.withColumn("id", F.col("id") * 0), *a))
    with pytest.raises(copy.CopyMismatch, match="None.*'a'"):
        copy.copy_partition_wise(df, path, "p", F.col("g"), only=["a", None], allow_destructive=True)
    assert rows(copy.read_copied(spark, path, df.schema)) == rows(df)


@pytest.mark.parametrize("value,have,want,good", [
    ("1.239", "string", "decimal(10,2)", False), ("1.23", "string", "decimal(10,2)", True), ("1.230", "string", "decimal(10,2)", True),
    ("7", "string", "int", True), ("7.5", "string", "decimal(5,0)", False), (None, "string", "decimal(10,2)", True),
    ("2024-01-02", "string", "date", True), ("2024-01-02 03:04:05", "string", "date", False)])
def test_text_that_would_lose_something_is_refused(spark, value, have, want, good):
    df = spark.createDataFrame([(value,)], f"v {have}")
    target = spark.createDataFrame([], f"v {want}").schema
    if good:
        assert copy.conform(df, target).count() == 1 and copy.conform(df, target).collect()
    else:
        with pytest.raises(Exception, match="without loss|CAST_INVALID"):
            copy.conform(df, target).collect()
        assert copy.conform(df, target, allow_loss=True).collect()


def test_timestamps_keep_their_time(spark):
    target = spark.createDataFrame([], "v date").schema
    for text, good in (("2024-01-02 00:00:00", True), ("2024-01-02 10:00:00", False)):
        df = spark.createDataFrame([(datetime.fromisoformat(text),)], "v timestamp_ntz")
        if good:
            assert str(copy.conform(df, target).first()[0]) == "2024-01-02"
        else:
            with pytest.raises(Exception, match="without loss"):
                copy.conform(df, target).collect()


# --- reports ---------------------------------------------------------------------------

def test_one_bad_pair_stops_no_report(spark, tmp_path):
    good = spark.range(5).selectExpr("id AS k", "cast(id AS string) AS v")
    drifted = good.withColumn("v", F.col("k"))
    path = str(tmp_path / "broken")
    good.coalesce(1).write.parquet(path)
    broken = spark.read.schema(good.schema).parquet(path)
    broken.count()
    for f in (tmp_path / "broken").glob("part-*"):
        f.write_bytes(b"not parquet at all")
    for f in (tmp_path / "broken").glob(".*.crc"):
        f.unlink()
    pairs = [verify.TablePair("good", good, good, ("k",)), verify.TablePair("drifted", good, drifted, ("k",)),
             verify.TablePair("broken", good, broken, ("k",))]
    report = {r["table_name"]: r for r in verify.verify_tables(pairs).collect()}
    assert report["good"]["ok"] and report["good"]["error"] is None
    assert (report["drifted"]["ok"], report["drifted"]["count_ok"], report["drifted"]["content_ok"]) == (False, True, False)
    assert "columns differ" in report["drifted"]["error"]
    assert report["broken"]["ok"] is False and report["broken"]["error"] and report["broken"]["source_rows"] is None


def test_depth_of_a_plan_is_acted_on(spark):
    df = spark.range(3).selectExpr("id")
    plan = spark.createDataFrame([("a", "rowcount_and_sample_hash"), ("b", "rowcount_and_fingerprint"), ("c", "rowcount"), ("d", "rowcount")],
                                 "table_name string, depth string")
    pairs = verify.pairs_of_plan(plan, {n: (df, df) for n in "abc"}, {"a": ("id",)}, sample_rows=7)
    assert [(p.name, p.sample, p.content, p.keys, p.sample_rows) for p in pairs] == [
        ("a", True, True, ("id",), 7), ("b", False, True, (), 7), ("c", False, False, (), 7)]
    depth = spark.createDataFrame([(5,), (10**7,), (None,)], "n bigint").select(verify.verification_depth(F.col("n")))
    assert [r[0] for r in depth.collect()] == ["rowcount_and_sample_hash", "rowcount_and_fingerprint", "rowcount_and_sample_hash"]
    assert readiness.Thresholds().max_chunks is None


def test_declared_catalog_scans_nothing(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    spec = catalog.TableSpec("orders", df, ("o_orderkey",), measured=False, not_null=("o_orderkey",))
    found = catalog.measured_table(spec)
    assert "parquet" not in found._jdf.queryExecution().executedPlan().toString().lower()
    row = found.first()
    assert row["row_count"] is None and row["primary_key"] == ["o_orderkey"]
    assert [c["not_null"] for c in row["columns"]] == [c == "o_orderkey" for c in df.columns]


def test_include_list_of_tables(spark):
    df = spark.createDataFrame([("public", "a"), ("public", "b"), ("other", "a")], "schema string, table string")
    assert rows(catalog.scope_tables(df, include_tables=["a"])) == [("other", "a"), ("public", "a")]
    assert rows(catalog.scope_tables(df, include_tables=["public.a", "b"], exclude_tables=["b"])) == [("public", "a")]


def test_reports_keep_null_fields(spark, tmp_path):
    tables.write_report(spark.createDataFrame([(1, None)], "a int, b string"), f"{tmp_path}/r")
    text = next((tmp_path / "r").glob("part-*.json")).read_text()
    assert json.loads(text) == {"a": 1, "b": None}


# --- rows ---------------------------------------------------------------------------------

def test_dedupe_rows_with_maps(spark):
    df = spark.createDataFrame([(1, {"b": 2}, 5), (1, {"a": 1}, 5), (1, {"a": 1}, 4), (2, None, 1)], "k int, m map<string,int>, n int")
    assert sorted((r.k, r.m, r.n) for r in integrity.dedupe(df, ["k"]).collect()) == [(1, {"a": 1}, 4), (2, None, 1)]
    assert [(r.k, r.n) for r in integrity.dedupe(df, ["k"], ["n"]).orderBy("k").collect()] == [(1, 4), (2, 1)]


def test_array_hashes_see_places_of_nulls_and_need_no_text(spark):
    df = spark.createDataFrame([(1, [1.0, None]), (2, [None, 1.0]), (3, [1.0]), (4, []), (5, None), (6, [1.0, None])], "k int, a array<double>")
    hashed = df.select("k", canonical.row_hash(df, ["a"]).alias("h"))
    got = {r.k: r.h for r in hashed.collect()}
    assert got[1] == got[6] and len(set(got.values())) == 5
    assert "json" not in hashed._jdf.queryExecution().executedPlan().toString().lower()


def test_chunked_row_diff_moves_short_rows(spark):
    a = spark.range(1000).selectExpr("id AS k", "sha2(cast(id AS string), 256) AS t")
    b = a.withColumn("t", F.when(F.col("k") == 77, "x").otherwise(F.col("t"))).filter("k <> 900")
    found = compare.diff_rows(a, b, ["k"], chunk=F.expr("k div 100"))
    assert rows(found) == rows(compare.diff_rows(a, b, ["k"]))


def test_routes_with_open_ends_lists_and_hashes(spark):
    df = spark.createDataFrame([(v,) for v in (None, -5, 0, 9, 10, 50, 99)], "v int")
    route = layout.route_range(F.col("v"), [("high", 50, None), ("low", None, 0), ("mid", 0, 10)], default="rest")
    assert [r[0] for r in df.select(route).collect()] == ["rest", "low", "mid", "mid", "rest", "high", "high"]
    with pytest.raises(ValueError, match="overlap"):
        layout.route_range(F.col("v"), [("a", None, 5), ("b", None, 9)])
    with pytest.raises(ValueError, match="overlap"):
        layout.route_range(F.col("v"), [("a", 0, None), ("b", 9, 12)])
    by_list = layout.route_list(F.col("v"), {"few": [0, None], "ten": [10]})
    assert [r[0] for r in df.select(by_list).collect()] == ["few", None, "few", None, "ten", None, None]
    with pytest.raises(ValueError, match="both"):
        layout.route_list(F.col("v"), {"a": [1], "b": [1]})
    hashed = {r[0]: r[1] for r in df.unionAll(df).select("v", layout.route_hash([F.col("v")], ["x", "y"])).distinct().collect()}
    assert len(hashed) == 7 and set(hashed.values()) <= {"x", "y"}


def test_draws_reach_beyond_32_bits(spark):
    drawn = spark.range(200).select(seed.draw(F.col("id"), "wide", 1 << 50).alias("d")).agg(F.max("d")).first()[0]
    assert drawn > 1 << 45


def test_keys_need_no_forced_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = keys.assign_keys(spark.range(500).selectExpr("id * 7 % 500 AS v"), 10, ["v"], partitions=5)
        assert rows(out.select("v", "new_id")) == [(i, i + 10) for i in range(500)] or sorted(
            (r.v, r.new_id) for r in out.collect()) == [(i, i + 10) for i in range(500)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# --- views and streams ------------------------------------------------------------------------

def test_failed_refresh_leaves_the_old_view(spark, tmp_path):
    path = f"{tmp_path}/v"
    views.build_view(spark.range(4).selectExpr("id"), path)
    bad = spark.range(4).selectExpr("if(id = 3, cast(raise_error('no') AS bigint), id) AS id")
    with pytest.raises(Exception, match="no"):
        views.build_view(bad, path, if_absent=False)
    assert spark.read.parquet(path).count() == 4
    views.build_view(spark.range(9).selectExpr("id"), path, cluster_by=["id"], if_absent=False)
    assert spark.read.parquet(path).count() == 9
    assert [f.name for f in tmp_path.iterdir()] == ["v"]


def test_clustered_files_follow_the_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "files_for", lambda *a, **k: 4)
    layout.write_clustered(spark.range(1000).selectExpr("id % 10 AS g", "id"), f"{tmp_path}/t", ["g"])
    assert len(list((tmp_path / "t").glob("part-*"))) == 4


def test_rows_of_a_run_with_many_batches(spark, tmp_path):
    src = f"{tmp_path}/src"
    spark.range(0, 120, 1, 120).write.parquet(src)
    many = len(list((tmp_path / "src").glob("part-*")))
    assert many > 100
    stream = streams.file_stream(spark, src, spark.read.parquet(src).schema, 1)
    assert streams.copy_stream(stream, f"{tmp_path}/out", f"{tmp_path}/check") == 120
    assert streams.copy_stream(stream, f"{tmp_path}/out", f"{tmp_path}/check") == 0
