import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyhaul.llm import exact_dedup, mixing, queries

from . import cases


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_groups_against_plain_grouping(spark):
    docs = cases.documents(spark)
    got = sorted(map(tuple, exact_dedup.exact_groups(docs, salts=3).collect()), key=repr)
    by = defaultdict(list)
    for r in cases.rows():
        by[normal(r[1])].append(r[0])
    want = []
    for r in cases.rows():
        t = normal(r[1])
        ids = [i for i in by[t] if i is not None]
        keep = min(ids) if ids else None
        want.append((r[0], keep, len(by[t]), r[0] == keep, hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert exact_dedup.exact_groups(cases.empty(spark)).count() == 0


def test_texts_with_one_digest_are_compared(spark, monkeypatch):
    """With a digest that clashes, whole texts still tell documents apart."""
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.hex(F.lit(b"\x01")))
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(docs).collect()}
    assert got == {1: (1, 2), 2: (2, 1), 3: (1, 2)}


def fill(sizes, most=3.0):
    """Water level by bisection."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, low, high = sum(sizes.values()), 0.0, 1e12
    for _ in range(200):
        mid = (low + high) / 2
        if sum(min(mid * weight[s], most * sizes[s]) for s in names) < total:
            low = mid
        else:
            high = mid
    return {s: min(high * weight[s], most * sizes[s]) for s in names}


def test_plan_meets_targets(spark):
    data = [(i, " ".join("w" * (1 + i % 3) for _ in range(i % 50)), None, [None, "tiny", "big", "big", "mid"][i % 5] if i > 5 else "tiny")
            for i in range(2000)]
    docs = spark.createDataFrame([(*d, None, *"abcde") for d in data], cases.SCHEMA)
    rows = mixing.plan(docs).collect()
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size
    want = fill(dict(sizes))
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], rel=1e-6)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.plan(docs.repartition(7)).collect()))


def test_position_inverts_the_integral(spark):
    """The words due at a position, by numeric integration of the schedule, are the words before it."""
    shares = [i / 20 for i in range(21)]
    df = spark.createDataFrame([(s, k) for s in shares for k in range(3)], "share double, rank int")
    for share, rank, t in df.select("share", "rank", mixing.due_time(F.col("share"), F.col("rank"))).collect():
        knots = mixing.SCHEDULES[rank]

        def weight(x):
            for (t0, w0), (t1, w1) in zip(knots[:-1], knots[1:]):
                if x <= t1:
                    return w0 + (w1 - w0) * (x - t0) / (t1 - t0)
            return knots[-1][1]

        steps = 4000
        area = sum(weight((i + 0.5) / steps) for i in range(steps)) / steps
        upto = sum(weight(t * (i + 0.5) / steps) for i in range(steps)) * t / steps
        assert upto / area == pytest.approx(share, abs=2e-4)


def test_mixed_rows_come_in_training_order_and_keep_columns(spark):
    docs = cases.documents(spark)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    counts = defaultdict(int)
    for r in mixing.plan(docs).collect():
        counts[r.doc_id] = max(counts[r.doc_id], r.copies)
    rows = out.collect()
    repeated = defaultdict(int)
    for r in cases.rows():
        repeated[r[0]] += 1
    for i in repeated:
        assert sum(r.doc_id == i for r in rows) == counts[i] * repeated[i]
    due = {(r.doc_id, r.copy): r.position for r in mixing.positions(mixing.plan(docs)).collect()}
    seen, order = defaultdict(int), []
    for r in rows:
        if repeated[r.doc_id] == 1:
            order.append(due[r.doc_id, seen[r.doc_id]])
            seen[r.doc_id] += 1
    assert order == sorted(order)
    assert mixing.mixed(cases.empty(spark)).count() == 0
    assert mixing.plan(docs.filter("doc_id < 3")).agg(F.sum("taken")).first()[0] == 0


def due(share, knots):
    """Time by bisection of the schedule's integral."""
    def area(t):
        return sum((min(t, t1) - t0) * (w0 + w0 + (w1 - w0) * (min(t, t1) - t0) / (t1 - t0)) / 2
                   for (t0, w0), (t1, w1) in zip(knots[:-1], knots[1:]) if t > t0)

    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if area(mid) < share * area(1.0) else (low, mid)
    return high


def test_registered_mix_stands_in_training_order(spark, sf_dir):
    """Positions again from the words before each document; the query's rows follow them, untaken documents last."""
    got = [tuple(r) for r in queries.op6_mixing(spark, sf_dir).collect()]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs}
    sizes = defaultdict(int)
    for r in docs:
        sizes[r.source] += size[r.doc_id]
    target = fill(dict(sizes))
    ranks = {s: i for i, s in enumerate(sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else []))}
    first, taken, before = {}, {}, defaultdict(int)
    for r in sorted(docs, key=lambda r: (hashlib.md5(str(r.doc_id).encode()).hexdigest(), r.doc_id)):
        middles = [before[r.source] + c * sizes[r.source] + size[r.doc_id] / 2 for c in range(3)]
        times = [due(m / target[r.source], mixing.SCHEDULES[ranks[r.source] % 3]) for m in middles
                 if m < target[r.source] * (1 - 1e-9) and size[r.doc_id]]
        before[r.source] += size[r.doc_id]
        first[r.doc_id] = min(times, default=None)
        taken[r.doc_id] = len(times) * size[r.doc_id]
    assert {r[0]: r[4] for r in got} == taken and len(got) == len(docs)
    order = [first[r[0]] for r in got]
    assert None in order and order.index(None) == len([x for x in order if x is not None])  # untaken rows are kept, at the end
    placed = [x for x in order if x is not None]
    assert all(a <= b + 1e-9 for a, b in zip(placed, placed[1:]))
    rows = {r.doc_id: r.positions for r in mixing.scheduled(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    for i, t in first.items():
        assert (rows[i] and rows[i][0]) == (None if t is None else pytest.approx(t, abs=1e-6))


def test_schedule_decides_the_order(spark):
    docs = cases.documents(spark)
    rows = mixing.scheduled(docs).collect()
    assert sorted(repr(tuple(r)[:9]) for r in rows) == sorted(repr(tuple(r)) for r in mixing.plan(docs).collect())
    copies = defaultdict(list)
    for r in mixing.positions(mixing.plan(docs)).orderBy("copy").collect():
        copies[r.doc_id, r.source, r.before].append(r.position)
    for r in rows:
        assert r.positions == (copies[r.doc_id, r.source, r.before] if r.copies else None)
    late = ((0.0, 0.0), (1.0, 2.0))
    moved = {(r.doc_id, r.before): r.positions for r in mixing.scheduled(docs, schedules=(late,)).collect()}
    assert any(r.copies and moved[r.doc_id, r.before][0] > r.positions[0] for r in rows)
    assert mixing.scheduled(cases.empty(spark)).count() == 0
