import math
import random

import duckdb
import pytest

from tallyhaul.llm import queries, topk

SCHEMA = "vec_id long, embedding array<double>, ids string, v string, cells string, q long"


def plain(data, k=5, every=50, scale=256):
    own = {(i, tuple(math.floor(scale * x) for x in v)) for i, v in data
           if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, v in own:
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in own if j != i and len(v) == len(w))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def frame(spark, data):
    return spark.createDataFrame([(*r, "a", None, "b", 5) for r in data], SCHEMA)


def got(df):
    assert df.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    return sorted(map(tuple, df.collect()))


def test_query_against_all_pairs(spark, sf_dir):
    data = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert got(queries.op12_exact_topk(spark, sf_dir)) == plain(data)


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    assert sorted(con.execute(topk.ORACLE_SQL).fetchall()) == got(queries.op12_exact_topk(spark, sf_dir))


@pytest.mark.parametrize("options", [{}, {"cells": 3, "block_rows": 7}, {"pass_bytes": 8 * 6 * 3}, {"k": 1, "every": 7}])
def test_copies_ties_and_passes(spark, options):
    r = random.Random(1)
    data = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(200)]
    data += [(i, [0.5, -0.25, 0.125, 0.0, 0.0, 1.0]) for i in range(200, 330)]  # a third are equal
    data += [(i, [0.5, -0.25, 0.125, 0.0, 0.0, 1 + r.random() / 300]) for i in range(330, 420)]  # and many nearly so
    data += [(i, [0.0] * 6) for i in range(420, 500)]
    r.shuffle(data)
    search = {k: v for k, v in options.items() if k in ("k", "every")}
    assert got(topk.nearest(frame(spark, data).repartition(5), **options)) == plain(data, **search)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    data = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, []), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (None, [1.0, 1.0]),
            (50, [1.0]), (51, [-0.001]), (100, [1.0, 2.0]), (-50, [-3.0, 1e6]), (7, [3.0, -1e6]), (150, [1.0, 2.0, 3.0]), (200, None)]
    assert got(topk.nearest(frame(spark, data))) == plain(data)
    assert got(topk.nearest(frame(spark, []))) == [] == got(topk.nearest(frame(spark, [(1, [1.0])])))
    assert plain(data)[0][0] == -50 and not [x for x in plain(data) if x[0] == 150]


def test_whole_numbers_beyond_floats(spark):
    data = [(i, [float(2 ** 22 + i), float(3 * i - 7)]) for i in range(60)]
    assert got(topk.nearest(frame(spark, data))) == plain(data)
    with pytest.raises(Exception, match="64 bits"):
        topk.nearest(frame(spark, [(0, [1e12]), (1, [1e12])])).collect()


def test_bounds_hold():
    import numpy as np

    r = np.random.default_rng(2)
    x, q = r.integers(-300, 300, (500, 8)), r.integers(-300, 300, (20, 8))
    low, high = x.min(0), x.max(0)
    width = -(-(high - low + 1) // 16)
    block = topk.Block({8: (low, width)}, 8, q)
    lower, true = block.lower(((x - low) // width).astype(np.uint8)), x @ q.T
    assert (lower <= true).all() and (true <= lower + block.slack).all()
