import glob
import random
from datetime import datetime

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallyhaul.functions import text
from tallyhaul.operators import integrity, keys, layout, profile, relational, verify, views
from tallyhaul.sources import seed


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_not_null(spark):
    df = spark.createDataFrame([(1, None), (None, None), (3, "x")], "a int, `odd name` string")
    assert rows(integrity.check_not_null(df)) == [("a", 1), ("odd name", 2)]
    assert rows(integrity.check_not_null(df.limit(0), ["a"])) == [("a", 0)]


def test_pk_and_unique(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (2, None), (None, None), (None, None), (3, 1)], "a int, b int")
    assert rows(integrity.check_pk(df, ["a", "b"])) == [(1, 1, 2), (2, None, 1), (None, None, 2)]
    assert rows(integrity.check_unique(df, ["a", "b"])) == [(1, 1, 2)]


def test_foreign_keys(spark):
    child = spark.createDataFrame([(1, 10), (2, 99), (3, None), (4, 99)], "id int, ref int")
    parent = spark.createDataFrame([(10,), (10,), (20,)], "pk int")
    assert rows(integrity.fk_orphan_keys(child, parent, {"ref": "pk"})) == [(99, 2)]
    assert rows(integrity.fk_orphans(child, parent, {"ref": "pk"})) == [(2, 99), (4, 99)]


def test_composite_foreign_key_with_a_null_part_passes(spark):
    child = spark.createDataFrame([(1, None), (1, 2), (5, 5)], "a int, b int")
    parent = spark.createDataFrame([(1, 2)], "x int, y int")
    assert rows(integrity.fk_orphans(child, parent, {"a": "x", "b": "y"})) == [(5, 5)]


def test_defaults_do_not_replace_sent_nulls(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert integrity.fill_defaults(df, {"b": F.lit("x"), "c": F.lit("y")}).first() == (1, None, "y")


def test_dedupe_equals_brute_force(spark):
    rng = random.Random(3)
    data = [(rng.choice([1, 2, None]), rng.choice([None, "a", "b"]), rng.choice([1.0, None, 3.0])) for _ in range(200)]
    df = spark.createDataFrame(data, "k int, s string, x double")
    best = {}
    order = lambda r: tuple((v is not None, v) for v in r[1:])
    for r in data:
        if r[0] not in best or order(r) < order(best[r[0]]):
            best[r[0]] = r
    assert rows(integrity.dedupe(df, ["k"])) == sorted(best.values(), key=repr)
    by_x = {r["k"]: r["x"] for r in integrity.dedupe(df.filter("x IS NOT NULL"), ["k"], order=["x"]).collect()}
    assert set(by_x.values()) == {1.0}


def test_route_range(spark):
    children = [("b", 10, 20), ("a", 0, 10), ("d", 30, 40), ("e", 40, 41)]
    df = spark.createDataFrame([(v,) for v in [None, -1, 0, 9, 10, 19, 20, 29, 30, 39, 40, 41]], "v int")
    got = {r[0]: r[1] for r in df.select("v", layout.route_range(F.col("v"), children)).collect()}
    assert got == {None: None, -1: None, 0: "a", 9: "a", 10: "b", 19: "b", 20: None, 29: None, 30: "d", 39: "d",
                   40: "e", 41: None}
    assert layout.unrouted(df, "v", children).count() == 5
    with pytest.raises(ValueError, match="overlap"):
        layout.route_range(F.col("v"), [("a", 0, 10), ("b", 9, 12)])


def test_many_children_stay_in_one_scan_stage(spark):
    children = [(f"c{i}", i * 10, i * 10 + 10) for i in range(300)]
    out = spark.range(3000).select("id", layout.route_range(F.col("id"), children).alias("c"))
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.filter("c <> concat('c', id div 10) OR c IS NULL").count() == 0


def ranges_of(path, column):
    out = []
    for f in sorted(glob.glob(f"{path}/*.parquet")):
        stats = pq.ParquetFile(f).read(columns=[column]).column(0).to_pylist()
        if stats:
            out.append((min(stats), max(stats), len(stats), stats == sorted(stats)))
    return out


def test_clustered_files_do_not_overlap(spark, sf_dir, tmp_path):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    layout.write_clustered(df, f"{tmp_path}/t", ["l_shipdate"], 6, layout.file_position())
    found = sorted(ranges_of(f"{tmp_path}/t", "l_shipdate"))
    assert len(found) == 6 and all(f[3] for f in found)
    assert all(a[1] <= b[0] for a, b in zip(found, found[1:]))  # may share the value at the cut
    assert sum(f[2] for f in found) == df.count()


@pytest.mark.parametrize("from_files", [True, False])
def test_hot_value_is_cut_over_files(spark, tmp_path, from_files):
    df = spark.range(30_000).selectExpr("if(id % 3 < 2, 5L, id) AS k")
    position = None
    if from_files:
        df.write.parquet(f"{tmp_path}/in")
        df, position = spark.read.parquet(f"{tmp_path}/in"), layout.file_position()
    layout.write_clustered(df, f"{tmp_path}/t", ["k"], 6, position)
    found = sorted(ranges_of(f"{tmp_path}/t", "k"))
    assert sum(f[2] for f in found) == 30_000 and max(f[2] for f in found) < 9_000


@pytest.mark.parametrize("data,want", [([], (1, False, 1)), ([-5], (1, False, 1)), ([0], (1, False, 1)),
                                       ([3, 14999], (14999, True, 15000)), ([None], (1, False, 1))])
def test_sequence_sync(spark, data, want):
    df = spark.createDataFrame([(v,) for v in data], "id bigint")
    assert tuple(keys.sequence_sync({"t": (df, "id")}).first()) == ("t", *want)


def test_assign_keys_is_dense_and_ordered_with_a_hot_value(spark):
    df = spark.range(5000).selectExpr("if(id % 3 = 0, 7, id % 100) AS k", "id AS v")
    out = keys.assign_keys(df, 101, ["k"], partitions=7).collect()
    assert sorted(r["new_id"] for r in out) == list(range(101, 5101))
    in_order = [r["k"] for r in sorted(out, key=lambda r: r["new_id"])]
    assert in_order == sorted(in_order)
    assert keys.assign_keys(df.limit(0), 1, ["k"]).count() == 0


def test_views(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "t string")
    view = views.build_view(views.group_counts(df, "t"), f"{tmp_path}/v", cluster_by=["t"])
    assert rows(view) == [("a", 2), ("b", 1)]
    newer = views.group_counts(df.filter("t = 'a'"), "t")
    assert rows(views.build_view(newer, f"{tmp_path}/v")) == [("a", 2), ("b", 1)]  # kept
    assert rows(verify.verify_view(newer, view, ["t"])) == [("b", "missing_in_source", 0, 1)]
    assert rows(views.build_view(newer, f"{tmp_path}/v", if_absent=False)) == [("a", 2)]


def test_sql_function_is_pushed_down(spark, sf_dir):
    views.create_sql_function(spark, "is_paid_t", "s STRING", "BOOLEAN", "s = 'F'")
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("is_paid_t(o_orderstatus)")
    assert "EqualTo(o_orderstatus,F)" in df._jdf.queryExecution().executedPlan().toString()
    got = spark.createDataFrame([("paid",), ("x",), (None,)], "s string").select(views.is_paid(F.col("s")))
    assert [r[0] for r in got.collect()] == [True, False, None]


def test_profile(spark):
    df = spark.createDataFrame([(1, "b", [1]), (None, "a", None), (1, "a", [2])], "i int, s string, a array<int>")
    got = {r["column_name"]: r for r in profile.profile_columns("t", df).collect()}
    assert (got["i"]["null_count"], got["i"]["distinct_count"], got["s"]["min_text"]) == (1, 1, "a")
    assert got["a"]["null_count"] == 1 and got["a"]["distinct_count"] is None
    ranked = profile.rank_largest(profile.profile_tables({"x": df, "e": df.limit(0), "w": df}))
    assert [tuple(r) for r in ranked.orderBy("rank").collect()] == [("w", 3, 1), ("x", 3, 2), ("e", 0, 3)]


def test_largest_first_by_size_puts_unknown_last(spark):
    t = spark.createDataFrame([("a", 5, None), ("b", None, 10), ("c", 9, 10)], "table_name string, row_count bigint, bytes bigint")
    assert [r[0] for r in profile.rank_largest(t, size="bytes").orderBy("rank").collect()] == ["c", "b", "a"]


def test_sample_hash_uses_all_keys_and_only_the_sample(spark):
    df = spark.createDataFrame([(1, i, str(i)) for i in range(100)], "a int, b int, v string")
    one = verify.sample_hash(df, ["a", "b"]).first()[0]
    assert one == verify.sample_hash(df.orderBy(F.desc("b")).repartition(4), ["a", "b"]).first()[0]
    beyond = df.withColumn("v", F.when(F.col("b") == 99, "z").otherwise(F.col("v")))
    assert one == verify.sample_hash(beyond, ["a", "b"]).first()[0]
    inside = df.withColumn("v", F.when(F.col("b") == 49, "z").otherwise(F.col("v")))
    assert one != verify.sample_hash(inside, ["a", "b"]).first()[0]


def test_sample_is_top_n(spark, sf_dir):
    plan = verify.sample_rows(spark.read.parquet(f"{sf_dir}/events.parquet"), ["event_id"])
    assert "TakeOrderedAndProject" in plan._jdf.queryExecution().executedPlan().toString()


def test_verify_report(spark):
    a = spark.createDataFrame([(i, str(i)) for i in range(200)], "k int, v string")
    late = a.withColumn("v", F.when(F.col("k") == 150, "z").otherwise(F.col("v")))
    pairs = [verify.TablePair("same", a, a, ("k",)), verify.TablePair("late", a, late, ("k",)),
             verify.TablePair("count", a, late, ("k",), sample=False, content=False),
             verify.TablePair("fewer", a, a.filter("k <> 3"), ("k",), content=False),
             verify.TablePair("empty", a.limit(0), a.limit(0), ("k",))]
    report = {r["table_name"]: r for r in verify.verify_tables(pairs).collect()}
    assert {n: r["ok"] for n, r in report.items()} == {
        "same": True, "late": False, "count": True, "fewer": False, "empty": True}
    assert report["late"]["sample_ok"] and not report["late"]["content_ok"]
    summary = verify.verify_summary(verify.verify_tables(pairs)).first()
    assert tuple(summary) == (False, 5, 2, "fewer,late")


def test_count_only_verification_reads_no_columns(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    plan = verify.verify_table(verify.TablePair("l", df, df, sample=False, content=False))
    assert "ReadSchema: struct<>" in plan._jdf.queryExecution().executedPlan().toString()


def test_text(spark):
    df = spark.createDataFrame([('demo."My.Table"',), ("plain",), ("a.b.c",)], "n string")
    schema, table = text.split_name(F.col("n"))
    assert rows(df.select(schema, table)) == [("a", "b.c"), ("demo", "My.Table"), ("public", "plain")]
    got = spark.sql("SELECT 'a\"b' n, \"nextval('s.one'::regclass) + NEXTVAL('two')\" d").select(
        text.quote_identifier(F.col("n")), text.sequence_names(F.col("d")),
        text.draws_from_sequence(F.col("d"), F.lit("NO"))).first()
    assert tuple(got) == ('"a""b"', ["s.one", "two"], True)


def test_relational_helpers(spark):
    df = spark.createDataFrame([(1, "pg_x"), (2, "demo"), (3, "information_schema"), (4, None)], "i int, s string")
    assert rows(relational.exclude_like(df, "s", "^pg_", ["information_schema"])) == [(2, "demo")]
    assert relational.project(df, ["s"]).columns == ["s"]


def test_seed_rows_are_repeatable(spark):
    ids = seed.id_range(spark, 2000)
    assert rows(seed.seed_orders(ids, 200)) == rows(seed.seed_orders(ids.repartition(7), 200))
    orders = seed.seed_orders(ids, 200).collect()
    assert {r["status"] for r in orders} == set(seed.ORDER_STATUSES)
    assert all(1 <= r["user_id"] <= 200 and 0 <= r["amount_usd"] <= 500 for r in orders)
    times = [r["event_ts"] for r in seed.seed_events(ids, 200).collect()]
    assert min(times) >= datetime(2026, 1, 1) and max(times) < datetime(2026, 2, 20)
    assert seed.seed_users(ids).select("email").distinct().count() == 2000


@pytest.mark.parametrize("limit", ["10485760", "-1"])
def test_dedupe_few_equals_dedupe(spark, limit):
    rng = random.Random(5)
    data = [(i if i % 10 else None, rng.choice([None, "a", "b"])) for i in range(200)] + [(5, "0"), (7, None), (7, None)]
    df = spark.createDataFrame(data, "k int, s string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        got = rows(integrity.dedupe_few(df, ["k"]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == rows(integrity.dedupe(df, ["k"]))
