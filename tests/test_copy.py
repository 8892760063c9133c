import glob
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F, types as T

from tallyhaul.operators import copy, integrity
from tallyhaul.sources import csvfiles, storage, tables
from tallyhaul.sources.tables import JdbcTable

EDGE = [(1, None, "a"), (2, "", "b"), (3, 'x"y\nz,', "c"), (4, "\\back", "d"), (5, " pad ", "e"), (6, "\r\n", "f"),
        (None, None, None), (7, "\\N", "g"), (8, '"', ""), (9, "a\rb", "#")]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_csv_edge_rows(spark, tmp_path):
    df = spark.createDataFrame(EDGE, "i int, s string, k string")
    csvfiles.write_csv(df.coalesce(1), f"{tmp_path}/c")
    text = open(glob.glob(f"{tmp_path}/c/part*")[0], newline="").read()
    assert text.startswith('1,,a\n2,"",b\n3,"x""y\nz,",c\n')
    assert rows(csvfiles.read_csv(spark, f"{tmp_path}/c", df.schema)) == rows(df)


def test_csv_header_and_file_size(spark, tmp_path):
    df = spark.range(10).selectExpr("id", "cast(id AS string) t").coalesce(1)
    csvfiles.write_csv(df, f"{tmp_path}/c", header=True, rows_per_file=3)
    assert len(glob.glob(f"{tmp_path}/c/part*")) == 4
    assert rows(csvfiles.read_csv(spark, f"{tmp_path}/c", df.schema, header=True)) == rows(df)


def test_csv_one_column_keeps_null_rows(spark, tmp_path):
    df = spark.createDataFrame([(None,), ("a",), ("",)], "s string")
    csvfiles.write_csv(df, f"{tmp_path}/c")
    assert rows(csvfiles.read_csv(spark, f"{tmp_path}/c", df.schema)) == rows(df)


def test_csv_refuses_what_it_cannot_hold(spark, tmp_path):
    with pytest.raises(Exception, match="marks NULL"):
        csvfiles.write_csv(spark.createDataFrame([("\\N",)], "s string"), f"{tmp_path}/a")
    with pytest.raises(Exception, match="marks NULL"):
        csvfiles.write_csv(spark.createDataFrame([("\x00", 1)], "s string, i int"), f"{tmp_path}/b")
    arrays = spark.sql("SELECT 1 AS i, array(1, 2) AS a")
    with pytest.raises(ValueError, match="no CSV form"):
        csvfiles.write_csv(arrays, f"{tmp_path}/c")
    csvfiles.write_csv(arrays, f"{tmp_path}/d", nested_as_json=True)
    assert spark.read.text(f"{tmp_path}/d").first()[0] == '1,"[1,2]"'


def test_csv_types_survive(spark, tmp_path):
    df = spark.sql("""SELECT timestamp_ntz'2024-01-01 00:00:07.179575' a, timestamp'2024-06-01 12:00:00.000001' b,
        date'2024-02-29' c, cast(1.10 AS decimal(10,2)) d, 0.1D + 0.2D e, true f, cast('NaN' AS double) g,
        cast('Infinity' AS double) h, cast(NULL AS double) i""")
    csvfiles.write_csv(df, f"{tmp_path}/c")
    assert repr(rows(csvfiles.read_csv(spark, f"{tmp_path}/c", df.schema))) == repr(rows(df))


def test_csv_bad_field_fails(spark, tmp_path):
    csvfiles.write_csv(spark.createDataFrame([("x", "y")], "a string, b string"), f"{tmp_path}/c")
    with pytest.raises(Exception):
        csvfiles.read_csv(spark, f"{tmp_path}/c", T.StructType.fromDDL("a int, b string")).collect()


def test_copy_full_needs_leave_to_replace(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert copy.copy_full(spark.range(10), path) == 10
    with pytest.raises(PermissionError):
        copy.copy_full(spark.range(3), path)
    assert spark.read.parquet(path).count() == 10
    assert copy.copy_full(spark.range(3), path, allow_destructive=True) == 3
    assert rows(spark.read.parquet(path)) == [(0,), (1,), (2,)]
    assert os.listdir(tmp_path) == ["t"]  # no staging, no retired copy


def test_copy_full_may_read_what_it_replaces(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(10).write.parquet(path)
    copy.copy_full(spark.read.parquet(path).filter("id < 4"), path, allow_destructive=True)
    assert spark.read.parquet(path).count() == 4


def test_copy_full_leaves_target_when_the_source_fails(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(10).write.parquet(path)
    broken = spark.range(10).withColumn("id", F.when(F.col("id") == 7, F.raise_error("lost").cast("bigint")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        copy.copy_full(broken, path, allow_destructive=True)
    assert spark.read.parquet(path).count() == 10 and os.listdir(tmp_path) == ["t"]


def test_copy_full_leaves_target_when_content_differs(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    spark.range(10).write.parquet(path)
    real = copy._check

    def tampered(landed, name, seen):
        return real(landed.union(landed.limit(1)), name, seen)

    monkeypatch.setattr(copy, "_check", tampered)
    with pytest.raises(copy.CopyMismatch):
        copy.copy_full(spark.range(5), path, allow_destructive=True)
    assert spark.read.parquet(path).count() == 10 and os.listdir(tmp_path) == ["t"]


def test_catalog_table_copy(spark):
    copy.ensure_schema(spark, "depot")
    assert copy.copy_full_table(spark.range(10), "depot.t") == 10
    with pytest.raises(PermissionError):
        copy.copy_full_table(spark.range(3), "depot.t")
    assert copy.copy_full_table(spark.table("depot.t").filter("id < 3"), "depot.t", allow_destructive=True) == 3
    assert rows(tables.read_table(spark, "depot.t")) == [(0,), (1,), (2,)]
    assert [t.name for t in spark.catalog.listTables("depot")] == ["t"]
    spark.sql("DROP SCHEMA depot CASCADE")


def test_swap_puts_the_old_table_back(spark, tmp_path):
    spark.range(2).write.parquet(f"{tmp_path}/t")
    with pytest.raises(Exception):
        storage.swap_in(spark, f"{tmp_path}/nothing_there", f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2


def test_chunked_copy_resumes_only_what_differs(spark, tmp_path):
    path, src = f"{tmp_path}/t", spark.range(1000).selectExpr("id AS k", "id * 2 AS v")
    assert copy.copy_chunked(src, path, "k", 8) == 8
    assert copy.copy_chunked(src, path, "k", 8) == 0
    storage.remove(spark, f"{path}/chunk=3")
    assert copy.copy_chunked(src, path, "k", 8) == 1
    changed = src.withColumn("v", F.when(F.col("k").isin(0, 999), -1).otherwise(F.col("v")))
    assert copy.copy_chunked(changed, path, "k", 8) == 2
    emptied = src.filter("k < 500 OR k >= 625")
    assert copy.copy_chunked(emptied, path, "k", 8, span=(0, 999)) == 3  # two back to normal, one now empty
    assert rows(spark.read.parquet(path).select("k", "v")) == rows(emptied)


def test_chunks_cover_every_key(spark):
    df = spark.createDataFrame([(k,) for k in [None, -5, 0, 1, 99, 100, 7_000_000_000_000_000_000]], "k bigint")
    got = {r[0]: r[1] for r in df.select("k", copy.chunk_of(F.col("k"), 0, 99, 4)).collect()}
    assert got == {None: 0, -5: 0, 0: 0, 1: 0, 99: 3, 100: 3, 7_000_000_000_000_000_000: 3}
    wide = spark.createDataFrame([(0,), (2**62,), (2**63 - 1,)], "k bigint").select(
        copy.chunk_of(F.col("k"), 0, 2**63 - 1, 16)).collect()
    assert [r[0] for r in wide] == [0, 8, 15]


def test_chunk_with_most_rows_is_split_over_tasks(spark, tmp_path):
    df = spark.range(200_000).selectExpr("if(id % 3 < 2, 5, id) AS k", "sha2(cast(id AS string), 256) AS t")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        copy.copy_chunked(df, f"{tmp_path}/t", "k", 4)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(glob.glob(f"{tmp_path}/t/chunk=0/*.parquet")) > 1
    assert spark.read.parquet(f"{tmp_path}/t").count() == 200_000


def test_partition_wise(spark, tmp_path):
    path, df = f"{tmp_path}/t", spark.range(100).selectExpr("id", "id % 4 AS g")
    copy.copy_partition_wise(df, path, "p", F.col("g"))
    with pytest.raises(PermissionError):
        copy.copy_partition_wise(df, path, "p", F.col("g"))
    newer = df.withColumn("id", F.col("id") + 1000).filter("g <> 3")
    copy.copy_partition_wise(newer, path, "p", F.col("g"), only=[1, 3], allow_destructive=True)
    got = spark.read.parquet(path).groupBy("p").agg(F.min("id"), F.count("*")).collect()
    assert sorted(map(tuple, got)) == [(0, 0, 25), (1, 1001, 25), (2, 2, 25)]  # 3 is empty now
    copy.copy_partition_wise(df.filter("g = 2"), path, "p", F.col("g"), allow_destructive=True)
    assert [r[0] for r in spark.read.parquet(path).select("p").distinct().collect()] == [2]


def test_append_and_ensure_target(spark, tmp_path):
    path, schema = f"{tmp_path}/t", T.StructType.fromDDL("id bigint, t string")
    assert copy.ensure_target(spark, path, schema) and not copy.ensure_target(spark, path, schema)
    for _ in range(2):
        copy.copy_append(spark.range(3), path)
    assert spark.read.parquet(path).count() == 6 and spark.read.parquet(path).schema.names == ["id", "t"]


def test_conform(spark):
    schema = T.StructType.fromDDL("a int, b decimal(10,2), c string")
    df = spark.createDataFrame([("1.10", 7)], "b string, a bigint")
    assert [tuple(r) for r in copy.conform(df, schema).collect()] == [(7, Decimal("1.10"), None)]
    with pytest.raises(ValueError, match="no column"):
        copy.conform(df.withColumn("z", F.lit(1)), schema)
    with pytest.raises(ValueError, match="required"):
        copy.conform(df, T.StructType([T.StructField("q", T.IntegerType(), False)]), allow_drop=True)
    with pytest.raises(Exception):
        copy.conform(spark.createDataFrame([("x",)], "a string"), schema).collect()
    fraction = spark.createDataFrame([(3.7,)], "a double")
    with pytest.raises(Exception, match="without loss"):
        copy.conform(fraction, schema).collect()
    assert copy.conform(fraction, schema, allow_loss=True).first()["a"] == 3


def test_sync_missing(spark):
    source = spark.createDataFrame([(1, "a"), (2, "b"), (2, "a"), (3, "c")], "k int, v string")
    target = spark.createDataFrame([(1, "kept")], "k int, v string")
    assert rows(copy.sync_missing(source, target, ["k"])) == [(1, "kept"), (2, "a"), (3, "c")]
    with pytest.raises(Exception, match="NULL"):
        copy.sync_missing(source.union(spark.createDataFrame([(None, "n")], "k int, v string")), target, ["k"]).collect()


def test_insert_missing_twice(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.createDataFrame([(1, "kept")], "k int, v string").write.parquet(path)
    source = spark.createDataFrame([(1, "new"), (2, "b"), (2, "a")], "k int, v string")
    for _ in range(2):
        copy.insert_missing(source, path, ["k"])
    assert rows(spark.read.parquet(path)) == [(1, "kept"), (2, "a")]


def test_stats_count_utf8_bytes(spark, tmp_path):
    df = spark.createDataFrame([("é", 1), (None, 22), ('a"b', 3)], "s string, i int")
    got = copy.copy_with_stats(df, f"{tmp_path}/t").first()
    assert tuple(got) == (3, len('é,1\n,22\n"a""b",3\n'.encode()))


def test_jdbc_options_and_predicates():
    ref = JdbcTable("jdbc:x", "s.t", {"user": "u"})
    opts = tables.jdbc_range_options(ref, "id", 0, 99, 4)
    assert opts["partitionColumn"] == "id" and opts["numPartitions"] == "4" and opts["user"] == "u"
    got = tables.range_predicates("id", [10, 20])
    assert got == ["id < 10 OR id IS NULL", "id >= 10 AND id < 20", "id >= 20"]
    assert tables.range_predicates("t", ["o'b"])[0] == "t < 'o''b' OR t IS NULL"
    assert tables.range_predicates("id", []) == ["1 = 1"]


def test_predicates_take_every_row_once(spark):
    df = spark.createDataFrame([(None,)] + [(i % 50,) for i in range(500)], "k int")
    bounds = tables.balanced_bounds(df, "k", 5)
    parts = [df.filter(p).count() for p in tables.range_predicates("k", bounds)]
    assert sum(parts) == 501 and len(parts) == 5 and max(parts) < 140


def test_report_is_one_json_file_with_sorted_keys(spark, tmp_path):
    tables.write_report(spark.sql("SELECT 'x' AS b, 1 AS a"), f"{tmp_path}/r")
    files = glob.glob(f"{tmp_path}/r/*.json")
    assert len(files) == 1 and open(files[0]).read() == '{"a":1,"b":"x"}\n'


def test_scratch_uses_the_shared_folder(spark):
    assert storage.scratch(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_size_and_files(spark, tmp_path):
    spark.range(1000).write.parquet(f"{tmp_path}/t")
    size = storage.size_in_bytes(spark, f"{tmp_path}/t")
    assert size > 0 and storage.files_for(spark, f"{tmp_path}/t", bytes_per_file=size // 3 + 1) == 3
    assert integrity.dedupe(spark.range(3).union(spark.range(3)), ["id"]).count() == 3
