import itertools

import pytest
from pyspark.sql import functions as F

from tallyhaul.plans import catalog, drift, readiness, runs

TABLES = "schema string, table string, estimated_rows bigint, estimated_bytes bigint, has_geometry boolean, partition_key string"
COLUMNS = "schema string, table string, pos int, name string, type_sql string, not_null boolean, attidentity string, default_sql string"
KEYS = "schema string, table string, pos int, column string"
PARTS = "schema string, table string, child_schema string, child_table string"


def example(spark, target: bool):
    def col(table, pos, name, kind, schema="public"):
        return (schema, table, pos, name, kind, pos == 1, None, None)

    if target:
        tables = [("public", "users", 900, None, None, None), ("public", "orders", 180_000, None, None, None),
                  ("public", "legacy", 100, None, None, None)]
        columns = [col("users", 1, "id", "integer"), col("orders", 1, "id", "integer"), col("orders", 2, "amount", "text"),
                   col("legacy", 1, "id", "integer")]
        keys = [("public", t, 1, "id") for t in ("users", "orders", "legacy")]
        parts = []
    else:
        tables = [("public", "users", 1_000, None, None, None), ("public", "orders", 200_000, None, None, None),
                  ("analytics", "events", 800_000, None, None, "RANGE (event_ts)"),
                  ("analytics", "events_2026", 800_000, None, None, None)]
        columns = [col("users", 1, "id", "integer"), col("orders", 1, "id", "integer"), col("orders", 2, "amount", "integer"),
                   col("events", 1, "id", "integer", "analytics"),
                   col("events", 2, "event_ts", "timestamp without time zone", "analytics"),
                   col("events_2026", 1, "id", "integer", "analytics")]
        keys = [("public", "users", 1, "id"), ("public", "orders", 1, "id"), ("analytics", "events", 1, "id")]
        parts = [("analytics", "events", "analytics", "events_2026")]
    make = spark.createDataFrame
    return catalog.from_relations(make(tables, TABLES), make(columns, COLUMNS), make(keys, KEYS), make(parts, PARTS))


def test_expected_numbers(spark):
    source, target = example(spark, False), example(spark, True)
    found = drift.schema_drift(source, target)
    summary = drift.drift_summary(found).first().asDict()
    assert summary == {"source_tables": 3, "target_tables": 3, "missing_in_target": 1, "missing_in_source": 1,
                       "metadata_match": 1, "metadata_diff": 1,
                       "warning": "Target contains 1 table(s) not present in source."}
    bounded = readiness.Thresholds(max_chunks=16, max_concurrency=4, large_depth="rowcount")
    report = {r["table_name"]: r for r in readiness.readiness(source, found, thresholds=bounded).collect()}
    assert set(report) == {"public.users", "public.orders", "analytics.events"}
    events, orders, users = report["analytics.events"], report["public.orders"], report["public.users"]
    assert orders["action"] == "manual_review" and orders["manual_review"]
    assert (events["strategy"], events["chunk_column"], events["chunk_count"], events["concurrency"]) == (
        "partition_wise_copy", "event_ts", 4, 4)
    assert [(r["risk_score"], r["risk_level"]) for r in (events, orders, users)] == [(25, "low"), (45, "medium"), (0, "low")]
    assert [r["depth"] for r in (events, orders, users)] == ["rowcount", "rowcount", "rowcount_and_sample_hash"]
    assert "table is missing in target" in events["warnings"]
    done = readiness.readiness_summary(readiness.readiness(source, found)).first()
    assert (done["to_copy"], done["to_review"], done["blocked_overwrites"]) == (2, 1, "public.orders")
    assert [r[0] for r in drift.column_drift(source, target).select("drift").collect()] == ["type"]


def fact_table(spark, rows):
    shape = "array<struct<name:string,type:string>>"
    df = spark.createDataFrame(rows, f"""table_name string, row_count bigint, primary_key array<string>, has_geometry boolean,
        partition_key string, children array<string>, columns {shape}, structural_drift array<string>, auxiliary_drift array<string>""")
    return df


@pytest.mark.parametrize("rows,want", [(99_999, 0), (100_000, 15), (499_999, 15), (500_000, 15), (999_999, 15), (1_000_000, 30)])
def test_risk_edges(spark, rows, want):
    t = readiness.Thresholds()
    for has_key, geometry, parted, column in itertools.product([True, False], repeat=4):
        df = fact_table(spark, [("t", rows, ["id"] if has_key else [], geometry, "RANGE (d)" if parted else None, [],
                                 [], [], [])]).withColumn("c", F.lit("id" if column else None).cast("string"))
        score = df.select(readiness.risk_score(readiness.risk_reasons(F.col("row_count"), F.col("c"), t))).first()[0]
        more = 25 * (not has_key) + 10 * geometry + 10 * parted + 20 * (rows >= 500_000 and not column and not parted)
        assert score == want + more


def test_risk_is_capped_and_levels(spark):
    t = readiness.Thresholds()
    df = fact_table(spark, [("t", 2_000_000, [], True, None, [], [], ["columns"], ["indexes"])])
    reasons = readiness.risk_reasons(F.col("row_count"), F.lit(None), t)
    assert df.select(readiness.risk_score(reasons)).first()[0] == 100
    levels = spark.createDataFrame([(0,), (34,), (35,), (69,), (70,)], "s int").select(readiness.risk_level(F.col("s")))
    assert [r[0] for r in levels.collect()] == ["low", "low", "medium", "medium", "high"]


@pytest.mark.parametrize("rows,chunks", [(250_000, 1), (250_001, 2), (500_000, 3), (4_000_000, 16), (10**12, 16), (None, 1)])
def test_chunk_counts(spark, rows, chunks):
    df = spark.createDataFrame([(rows,)], "r bigint").select(F.coalesce("r", F.lit(0)).alias("r"))
    free = df.select(readiness.chunk_count(F.col("r"), F.lit("id"), readiness.Thresholds())).first()[0]
    assert free == (1 if rows is None or rows <= 250_000 else max(2, rows // 250_000 + 1))
    t = readiness.Thresholds(max_chunks=16)
    got = df.select(readiness.chunk_count(F.col("r"), F.lit("id"), t), readiness.chunk_count(F.col("r"), F.lit(None), t)).first()
    assert tuple(got) == (chunks, 1)


def test_chunk_column_priority(spark):
    def line(name, cols, key=(), part=None):
        return (name, 1, list(key), False, part, [], cols, [], [])

    df = fact_table(spark, [
        line("part", [("ts", "timestamp"), ("d", "date")], ["ts"], 'RANGE ("d", ts)'),
        line("part_text", [("ts", "timestamp"), ("d", "text")], [], "LIST (d)"),
        line("hints", [("ts", "timestamp"), ("created_at", "timestamp_ntz"), ("id", "bigint")], ["id"]),
        line("key", [("code", "text"), ("n", "numeric(10,2)"), ("x_id", "int")], ["code", "n"]),
        line("suffix", [("a", "bigint"), ("u_id", "text"), ("v_id", "integer")]),
        line("none", [("a", "bigint"), ("span", "interval"), ("at_id", "point"), ("ts", "text")]),
        line("zoned", [("event_ts", "timestamp with time zone")])])
    got = {r[0]: r[1] for r in df.select("table_name", readiness.chunk_column()).collect()}
    assert got == {"part": "d", "part_text": "ts", "hints": "created_at", "key": "n", "suffix": "v_id", "none": None,
                   "zoned": "event_ts"}


# status, compatible, auxiliary -> action per mode, in the order of readiness.MODES
MATRIX = {
    ("missing_in_target", True, False): ["copy"] * 6,
    ("missing_in_source", False, False): ["manual_review"] * 6,
    ("metadata_match", True, False): ["skip", "skip", "skip", "copy", "copy", "copy"],
    ("metadata_diff", True, True): ["skip", "skip", "sync_metadata", "copy", "copy", "copy"],
    ("metadata_diff", False, False): ["manual_review", "skip"] + ["manual_review"] * 4,
    ("metadata_diff", False, True): ["manual_review", "skip"] + ["manual_review"] * 4,
}


def test_action_matrix(spark):
    lines = [(str(i), s, c, ["indexes"] if a else []) for i, (s, c, a) in enumerate(MATRIX)]
    df = spark.createDataFrame(lines, "table_name string, status string, compatible boolean, auxiliary_drift array<string>")
    got = {(r["table_name"], r["mode"]): r["action"] for r in readiness.action_by_mode(df).collect()}
    want = {(str(i), m): a for i, actions in enumerate(MATRIX.values()) for m, a in zip(readiness.MODES, actions)}
    assert len(got) == 36 and got == want


def test_scope(spark):
    names = [("pg_toast", "a"), ("information_schema", "b"), ("demo", "orders"), ("demo", "orders_archive"),
             ("demo", "x_table"), ("demo", "spatial_ref_sys"), ("analytics", "events")]
    df = spark.createDataFrame(names, "schema string, table string")

    def scope(**kw):
        return {r[1] for r in catalog.scope_tables(df, **kw).collect()}

    assert scope() == {"orders", "orders_archive", "x_table", "events"}
    assert scope(exclude_suffixes=["_archive", "_table"]) == {"orders", "events"}
    assert scope(include_schemas=["demo"], exclude_tables=["orders"]) == {"orders_archive", "x_table"}
    assert scope(include_schemas=["demo", "analytics"], exclude_schemas=["demo"]) == {"events"}
    assert scope(include_schemas=["demo"], system_tables=[]) == {"orders", "orders_archive", "x_table", "spatial_ref_sys"}


def test_root_tables_and_approval(spark):
    source = example(spark, False)
    assert {r[0] for r in catalog.root_tables(source).select("table_name").collect()} == {
        "public.users", "public.orders", "analytics.events"}
    approvals = spark.createDataFrame([("analytics.events", True), ("public.users", False)], "table_name string, approved boolean")
    assert {r["table_name"] for r in readiness.approved_only(source, approvals).collect()} == {
        "analytics.events", "analytics.events_2026"}  # partitions follow their parent


def test_drift_kinds(spark):
    spec = catalog.TableSpec("t", spark.range(5).selectExpr("id", "id AS v"), ("id",), "RANGE (id)", ("t1",), ("FK a",), ("IX a",))

    def found(other):
        row = drift.schema_drift(catalog.measured_catalog([spec]), catalog.measured_catalog([other])).first()
        return row["status"], row["compatible"], row["structural_drift"], row["auxiliary_drift"]

    assert found(spec) == ("metadata_match", True, [], [])
    assert found(spec.but(indexes=("IX b",), foreign_keys=()))[1:] == (True, [], ["indexes", "foreign_keys"])
    assert found(spec.but(children=("t1", "t2")))[2] == ["partition_layout"]
    assert found(spec.but(geometry=True))[2] == ["geometry"]
    assert found(spec.but(defaults={"v": " 0 "}))[2] == ["columns"]
    assert found(spec.but(df=spec.df.union(spec.df.limit(1))))[2] == ["primary_key"]  # declared, but rows repeat
    assert found(spec.but(df=spec.df.selectExpr("id", "nullif(v, 0) v")))[2] == ["columns"]
    swapped = spec.but(df=spec.df.select("v", "id"))
    kinds = drift.column_drift(catalog.measured_catalog([spec]), catalog.measured_catalog([swapped])).collect()
    assert {(r["column_name"], r["drift"]) for r in kinds} == {("id", "position"), ("v", "position")}


def test_unreadable_table_does_not_stop_the_others(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/ok")
    tables, errors = catalog.open_tables(spark, {"ok": f"{tmp_path}/ok", "gone": f"{tmp_path}/gone", "no": "no_such_table"})
    assert set(tables) == {"ok"} and set(errors) == {"gone", "no"} and all(errors.values())


LOG = "run_id int, step_id int, ok boolean, elapsed_s double, logged_at int"


def test_run_summary_and_resume(spark):
    steps = spark.createDataFrame([(1, s) for s in range(5)] + [(2, 0)], "run_id int, step_id int")
    log = spark.createDataFrame([(1, 0, True, 1.0, 1), (1, 1, False, 2.0, 2), (1, 1, True, 1.0, 3), (1, 2, False, 1.0, 4),
                                 (2, 0, True, 0.5, 1)], LOG)
    got = {r["run_id"]: r for r in runs.run_summary(steps, log).collect()}
    one = got[1]
    assert (one["total_steps"], one["ok_steps"], one["failed_steps"], one["skipped_steps"], one["elapsed_s"], one["success"]) == (
        5, 2, 1, 2, 5.0, False)
    assert got[2]["success"] and got[2]["next_action"].startswith("Migration completed cleanly")
    assert {tuple(r) for r in runs.pending_steps(steps, log).collect()} == {(1, 2), (1, 3), (1, 4)}  # failed ones run again
    verified = spark.createDataFrame([(False, 3, 1, "t")], "ok boolean, tables_checked bigint, failed_tables bigint, failed string")
    report = {r["run_id"]: r for r in runs.run_report(runs.run_summary(steps, log), verified).collect()}
    assert not report[2]["success"] and "Inspect verification mismatches" in report[2]["next_action"]
    assert report[1]["next_action"].startswith("Review failed steps") and report[1]["failed_tables"] == "t"


def test_run_steps_retries_only_what_failed(spark, tmp_path):
    from tallyhaul.operators.copy import copy_full

    log, calls = f"{tmp_path}/log", []

    def step(name, df):
        def work():
            calls.append(name)
            return copy_full(df, f"{tmp_path}/{name}", allow_destructive=True)
        return work

    bad = spark.range(5).withColumn("id", F.raise_error("lost").cast("bigint"))
    first = runs.run_steps(spark, "r", {"a": step("a", spark.range(10)), "b": step("b", bad)}, log)
    assert {(r["step_id"], r["ok"], r["row_count"]) for r in first.collect()} == {("a", True, 10), ("b", False, None)}
    second = runs.run_steps(spark, "r", {"a": step("a", spark.range(10)), "b": step("b", spark.range(7))}, log)
    assert sorted(calls) == ["a", "b", "b"] and second.count() == 3
    steps = spark.createDataFrame([("r", "a"), ("r", "b"), ("r", "c")], "run_id string, step_id string")
    total = runs.run_summary(steps, second).first()
    assert (total["ok_steps"], total["failed_steps"], total["skipped_steps"]) == (2, 0, 1)
