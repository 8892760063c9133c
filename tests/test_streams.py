import pytest
from pyspark.sql import functions as F

from tallyhaul.operators import views
from tallyhaul.streaming import streams


def write_part(spark, path, low, high):
    spark.range(low, high).selectExpr("id", "id % 3 AS g", "timestamp_seconds(1700000000 + id) AS at").coalesce(1).write.mode("append").parquet(path)


def test_copy_resumes_without_loss_or_copies(spark, tmp_path):
    src, out, check = f"{tmp_path}/src", f"{tmp_path}/out", f"{tmp_path}/check"
    write_part(spark, src, 0, 100)
    schema = spark.read.parquet(src).schema

    def run(**kw):
        return streams.copy_stream(streams.file_stream(spark, src, schema, 1), out, check, **kw)

    assert run() == 100
    assert run() == 0
    write_part(spark, src, 100, 150)
    write_part(spark, src, 150, 180)
    assert run() == 80
    ids = [r[0] for r in spark.read.parquet(out).select("id").collect()]
    assert sorted(ids) == list(range(180))


def test_stopped_between_batches(spark, tmp_path):
    src, out, check = f"{tmp_path}/src", f"{tmp_path}/out", f"{tmp_path}/check"
    for low in (0, 10, 20):
        write_part(spark, src, low, low + 10)
    schema = spark.read.parquet(src).schema
    bad = F.when(F.col("id") == 25, F.raise_error("stopped").cast("bigint")).otherwise(F.col("id"))
    failing = streams.file_stream(spark, src, schema, 1).withColumn("id", bad)
    with pytest.raises(Exception):
        streams.copy_stream(failing, out, check)
    streams.copy_stream(streams.file_stream(spark, src, schema, 1), out, check)
    assert sorted(r[0] for r in spark.read.parquet(out).select("id").collect()) == list(range(30))


def test_view_follows_the_stream(spark, tmp_path):
    src, out, check = f"{tmp_path}/src", f"{tmp_path}/out", f"{tmp_path}/check"
    write_part(spark, src, 0, 9)
    schema = spark.read.parquet(src).schema

    def run():
        streams.view_stream(streams.file_stream(spark, src, schema, 1), lambda s: views.group_counts(s, "g"), out, check,
                            cluster_by=["g"])
        return sorted(map(tuple, spark.read.parquet(out).collect()))

    assert run() == [(0, 3), (1, 3), (2, 3)]
    write_part(spark, src, 9, 12)
    assert run() == [(0, 4), (1, 4), (2, 4)]


@pytest.mark.parametrize("delay", [None, "1 hour"])
def test_dedupe_across_batches(spark, tmp_path, delay):
    src, out, check = f"{tmp_path}/src", f"{tmp_path}/out", f"{tmp_path}/check"
    write_part(spark, src, 0, 50)
    write_part(spark, src, 30, 80)
    schema = spark.read.parquet(src).schema
    once = streams.dedupe_stream(streams.file_stream(spark, src, schema, 1), ["id"], "at", delay)
    streams.copy_stream(once, out, check)
    assert sorted(r[0] for r in spark.read.parquet(out).select("id").collect()) == list(range(80))
    assert spark.read.parquet(out).columns == ["id", "g", "at"]


def test_state_setting_is_put_back(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    write_part(spark, f"{tmp_path}/src", 0, 3)
    schema = spark.read.parquet(f"{tmp_path}/src").schema
    streams.copy_stream(streams.file_stream(spark, f"{tmp_path}/src", schema), f"{tmp_path}/o", f"{tmp_path}/c")
    assert spark.conf.get(key) == before
