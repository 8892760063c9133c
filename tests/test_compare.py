import random

import pytest
from pyspark.sql import functions as F

from tallyhaul.functions.canonical import fingerprint, row_hash, row_text
from tallyhaul.operators import compare


def df_of(spark, rows, schema="k bigint, s string, x double"):
    return spark.createDataFrame(rows, schema)


def test_row_text_keeps_nulls_and_separators_apart(spark):
    rows = [(1, None, 1.5), (1, "\\N", 1.5), (1, "a|b", None), (1, "a\\|b", None), (1, "", None)]
    texts = [r[0] for r in df_of(spark, rows).select(row_text(df_of(spark, rows))).collect()]
    assert texts[0] == "1|\\N|1.5"
    assert len(set(texts)) == len(rows)


def test_row_hash_sees_null_positions(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("a", "a"), (None, None), ("", None)], "p string, q string")
    assert df.select(row_hash(df).alias("h")).distinct().count() == 5


def test_hash_of_nested_values(spark):
    df = spark.sql("""SELECT array(1, NULL) a, map('x', 1, 'y', 2) m, named_struct('p', NULL, 'q', 1) s
                      UNION ALL SELECT array(NULL, 1), map('y', 2, 'x', 1), named_struct('p', 1, 'q', NULL)""")
    one, two = [r for r in df.select(row_hash(df, ["a"]), row_hash(df, ["m"]), row_hash(df, ["s"])).collect()]
    assert one[0] != two[0] and one[2] != two[2]
    assert one[1] == two[1]  # a map has no order


def test_json_columns_ignore_key_order(spark):
    df = spark.createDataFrame([('{"a":1, "b":2}',), ('{"b":2,"a":1}',), ("not json",)], "j string")
    hashes = [r[0] for r in df.select(row_hash(df, json_columns=["j"])).collect()]
    assert hashes[0] == hashes[1] != hashes[2]


@pytest.mark.parametrize("algorithm", ["xxhash64", "md5"])
def test_fingerprint_ignores_order_but_not_copies(spark, algorithm):
    rows = [(i, f"v{i % 7}", i / 3) for i in range(500)]
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    base = fingerprint(df_of(spark, rows), algorithm=algorithm).first()
    assert base == fingerprint(df_of(spark, shuffled).repartition(5), algorithm=algorithm).first()
    doubled = fingerprint(df_of(spark, rows + rows[:2]), algorithm=algorithm).first()
    assert doubled["row_count"] == 502 and doubled["fingerprint"] != base["fingerprint"]
    # the same row twice must not cancel out
    assert (fingerprint(df_of(spark, [rows[0]] * 2), algorithm=algorithm).first()["fingerprint"]
            != fingerprint(df_of(spark, [rows[1]] * 2), algorithm=algorithm).first()["fingerprint"])


def test_fingerprint_of_empty_table(spark):
    assert tuple(fingerprint(df_of(spark, [])).first()) == (0, "0")
    assert tuple(fingerprint(df_of(spark, []), algorithm="md5").first()) == (0, "0")


def test_fingerprint_equals_exact_sum(spark):
    df = df_of(spark, [(i, str(i), None if i % 3 else float(i)) for i in range(1000)])
    exact = sum(r[0] % 2**64 for r in df.select(row_hash(df)).collect())
    assert int(fingerprint(df).first()["fingerprint"]) == exact


def brute_diff(source, target):
    out = {}
    keys = {r[0] for r in source} | {r[0] for r in target}
    for k in keys:
        s, t = sorted(map(repr, (r for r in source if r[0] == k))), sorted(map(repr, (r for r in target if r[0] == k)))
        if s != t:
            out[k] = "missing_in_target" if not t else "missing_in_source" if not s else "changed"
    return out


@pytest.mark.parametrize("seed", range(3))
def test_diff_rows_finds_planted_faults(spark, seed):
    rng = random.Random(seed)
    source = [(i, rng.choice(["a", "b", None]), rng.choice([1.0, None, 2.5])) for i in range(300)]
    target = []
    for r in source:
        roll = rng.random()
        if roll < 0.05:
            continue
        if roll < 0.1:
            r = (r[0], "changed", r[2])
        target.append(r)
        if roll > 0.97:
            target.append(r)  # a copy of a row is a difference too
    target += [(1000 + i, "new", None) for i in range(5)]
    s, t = df_of(spark, source), df_of(spark, target)
    want = brute_diff(source, target)
    for chunk in (None, F.floor(F.col("k") / 40)):
        got = {r["k"]: r["status"] for r in compare.diff_rows(s, t, ["k"], chunk=chunk).collect()}
        assert got == want


def test_diff_rows_with_null_keys_and_hot_key(spark):
    source = [(None, "x", 1.0)] + [(7, "hot", float(i)) for i in range(2000)] + [(1, "a", 1.0)]
    target = [(None, "y", 1.0)] + [(7, "hot", float(i)) for i in range(2000)] + [(1, "a", 1.0)]
    got = compare.diff_rows(df_of(spark, source), df_of(spark, target), ["k"]).collect()
    assert [(r["k"], r["status"]) for r in got] == [(None, "changed")]


def test_diff_is_one_exchange_and_no_join(spark):
    s, t = df_of(spark, [(1, "a", 1.0)]), df_of(spark, [(1, "a", 1.0)])
    plan = compare.diff_rows(s, t, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_diff_values(spark):
    s = df_of(spark, [(1, "a", 1.0), (2, None, 2.0), (3, "c", 3.0)])
    t = df_of(spark, [(1, "a", 1.5), (2, "b", None), (3, "c", 3.0)])
    got = {tuple(r) for r in compare.diff_values(s, t, ["k"]).collect()}
    assert got == {(1, "x", "1.0", "1.5"), (2, "s", None, "b"), (2, "x", "2.0", None)}


def test_types_must_agree(spark):
    with pytest.raises(ValueError, match="conform first"):
        compare.diff_rows(spark.range(3), spark.range(3).selectExpr("cast(id AS int) id"), ["id"])


def test_bag_diff_with_a_third_equal_rows(spark):
    base = [(9, "same", 0.0)] * 1000 + [(i, "u", 1.0) for i in range(2000)]
    s, t = df_of(spark, base + [(9, "same", 0.0)] * 3), df_of(spark, base + [(-1, None, None)])
    assert {tuple(r) for r in compare.bag_diff(s, t).collect()} == {
        (9, "same", 0.0, "source_only", 3), (-1, None, None, "target_only", 1)}
    assert {tuple(r) for r in compare.bag_diff_counts(s, t).collect()} == {("source_only", 3), ("target_only", 1)}


def test_column_diff_names_the_column(spark):
    s = df_of(spark, [(1, "a", 1.0), (2, "b", 2.0)])
    t = df_of(spark, [(1, "a", 1.0), (2, "b", 2.5)])
    assert {r["column_name"]: r["same"] for r in compare.column_diff(s, t).collect()} == {"k": True, "s": True, "x": False}
    empty = compare.column_diff(s.limit(0), t.limit(0)).collect()
    assert all(r["same"] and r["source_rows"] == 0 for r in empty)


def test_json_columns_in_diff_and_verify(spark):
    from tallyhaul.operators.verify import TablePair, verify_table

    s = spark.createDataFrame([(1, '{"a":1, "b":2}'), (2, '{"a":1}'), (3, None)], "k int, j string")
    t = spark.createDataFrame([(1, '{"b":2,"a":1}'), (2, '{"a":2}'), (3, None)], "k int, j string")
    assert [r["k"] for r in compare.diff_rows(s, t, ["k"]).orderBy("k").collect()] == [1, 2]
    assert [r["k"] for r in compare.diff_rows(s, t, ["k"], json_columns=["j"]).collect()] == [2]
    one = verify_table(TablePair("t", s.filter("k <> 2"), t.filter("k <> 2"), ("k",), json_columns=("j",))).first()
    assert one["ok"] and one["sample_ok"]
