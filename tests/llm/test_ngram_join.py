import random

import numpy as np
import pytest

from tallyhaul.llm import components, hashing, ngram_join as J

from . import cases


@pytest.mark.parametrize("rule,page", [(J.Rule(4, 85, 100), 256), (J.Rule(5, 80, 100), 4)])
def test_components_against_all_pairs(spark, rule, page):
    data = cases.families()
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.join_classes(docs, rule, page_rows=page, wide_rows=3 * page).collect()}
    assert got == cases.linked(data, rule.k, rule.num, rule.den)


def test_whole_table_against_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    data = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.join_classes(docs).collect()}
    assert got == cases.linked(data, 4, 85, 100)


def test_odd_rows(spark):
    docs = cases.documents(spark)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in J.join_classes(docs).collect()]
    assert len(got) == len(cases.rows())
    plain = cases.linked([(r[0], r[1]) for r in cases.rows() if r[0] is not None], 4, 85, 100)
    for i, n, c in got:
        assert (n, c) == ((len(cases.shingles("no id", 4)), None) if i is None else plain[i])
    assert J.join_classes(cases.empty(spark)).count() == 0
    left = J.without_near_copies(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {None} | {c for _, c in cases.linked(
        [(r[0], r[1]) for r in cases.rows() if r[0] is not None], 5, 80, 100).values()}
    assert J.without_near_copies(cases.empty(spark)).count() == 0


def test_texts_of_one_id_are_tied(spark):
    """Document 2 is close to one text of document 1, document 3 to its other text; 9 has a text without words besides."""
    def text(tag, changed=()):
        return " ".join(f"{tag}{i}" if i not in changed else f"new{tag}{i}" for i in range(80))

    data = [(1, text("a")), (1, text("b")), (2, text("a", (7,))), (3, text("b", (70,))), (4, text("c")), (9, text("c", (1,))), (9, None),
            (9, text("c", (1,))), (None, text("a")), (5, "")]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in J.join_classes(docs).select("doc_id", "n_shingles", "set_id", "component_id").collect()), key=str)
    size = {t: len(cases.shingles(t, 4)) for _, t in data}
    component = {1: 1, 2: 1, 3: 1, 4: 4, 9: 4, 5: 5, None: None}
    assert got == sorted(((i, size[t], i, component[i]) for i, t in data), key=str)
    left = J.without_near_copies(docs, J.Rule(4, 85, 100))
    assert sorted({r.doc_id for r in left.collect()}, key=str) == [1, 4, 5, None]


def passages(seed):
    """Texts that consist of common passages by a tenth to all of their words, and near copies of some."""
    r = random.Random(seed)
    common = [[f"c{p}x{i}" for i in range(300)] for p in range(3)]
    data = []
    for i in range(120):
        words = list(common[i % 3][: r.choice([60, 300])])
        words += [f"d{i}x{j}" for j in range(int(len(words) * r.choice([0, 0.02, 0.1, 0.2, 0.4, 1, 9])))]
        data.append((2 * i, " ".join(words)))
        if r.random() < 0.5:
            for at in r.sample(range(len(words)), r.choice([1, len(words) // 60])):
                words[at] = f"e{i}x{at}"
            data.append((2 * i + 1, " ".join(words)))
    return data


@pytest.mark.parametrize("rule,crowd", [(J.Rule(5, 80, 100), 1024), (J.Rule(5, 80, 100), 20), (J.Rule(4, 85, 100), 20)])
def test_common_passages_against_all_pairs(spark, monkeypatch, rule, crowd):
    monkeypatch.setattr(J, "CROWD", crowd)
    data = passages(crowd)
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.join_classes(docs, rule, page_rows=16, wide_rows=32).collect()}
    assert got == cases.linked(data, rule.k, rule.num, rule.den)


def test_points_add_up():
    """A folded point is the coarser point; its summed minima are never below the overlap."""
    r = np.random.default_rng(3)
    sets = [hashing.mix(r.integers(0, 1 << 60, n).astype(np.uint64)) for n in (1, 200, 256, 1000, 5000)]
    sets.append(np.r_[sets[-1][:4000], hashing.mix(r.integers(0, 1 << 60, 900).astype(np.uint64))])
    sets.append(np.full(600, 7, np.uint64))  # one group holds more than a byte does
    own = np.array([J.groups_of(len(s)) for s in sets])
    for groups in (64, 128):
        at = np.flatnonzero(own >= groups)
        got = J.folded([J.fine_point(sets[i]) for i in at], own[at], groups)
        for i, point in zip(at, got):
            assert point.tolist() == np.bincount((sets[i] % groups).astype(int), minlength=groups).tolist()
    points = J.folded([J.fine_point(s) for s in sets[4:6]], own[4:6], int(own[4:6].min()))
    assert 4000 <= np.minimum(*points).sum() < 4500


def test_spanning_connects_what_has_room():
    """Same classes as all pairs of a cell, with fewer pairs than documents."""
    r, rule = np.random.default_rng(5), J.Rule(5, 80, 100)
    points = np.repeat(r.integers(0, 6, (9, 64)), 7, axis=0)
    points[np.arange(63), r.integers(0, 64, 63)] += 3
    n = points.sum(1)
    ties = J.spanning(rule, n, points)
    room = np.stack([np.minimum(points, p).sum(1) for p in points]) >= rule.need(n[:, None] + n[None, :])

    def classes(pairs):
        root = list(range(63))
        for i, j in pairs:
            a, b = root[i], root[j]
            root = [min(a, b) if x in (a, b) else x for x in root]
        return root

    assert len(ties) < 63 and classes(ties) == classes(zip(*np.nonzero(room)))


def test_linked_sets_share_a_cell():
    """Whatever the edits, two sets at the threshold have an equal part that both look up."""
    r = random.Random(2)
    rule = J.Rule()
    for _ in range(300):
        n = r.choice([8, 13, 20, 60, 200, 700])
        pool = np.unique(hashing.mix(np.array([r.randrange(1 << 60) for _ in range(2 * n)], np.uint64)))
        a = pool[:n]
        gone = r.randrange(n)
        b = np.unique(np.r_[r.sample(list(a), n - gone), pool[n: n + r.randrange(n)]].astype(np.uint64))
        shared = J.overlap(np.sort(a), b)
        if not len(b) or rule.den * shared < rule.num * (len(a) + len(b) - shared) or set(a) == set(b):
            continue
        keys = []
        for s in (np.sort(a), b):
            at, bounds = rule.classes(len(s))
            own = [J.parts_of(rule, s, at, bounds[at])]
            if len(s) * rule.den // rule.num > bounds[at]:
                own.append(J.parts_of(rule, s, at + 1, bounds[at + 1]))
            keys.append(set(np.concatenate(own).tolist()))
        assert keys[0] & keys[1]


def test_all_overlaps_both_ways():
    r = np.random.default_rng(3)
    for most in (30, 3000):
        sets = [np.unique(r.integers(0, most, r.integers(0, 25)).astype(np.uint64)) for _ in range(23)]
        raw, plain = [s.tobytes() for s in sets], [set(s.tolist()) for s in sets]
        off = 1 - np.eye(len(sets), dtype=int)  # of a set with itself it counts only what others have too
        assert (J.overlaps(raw, columns=7) * off).tolist() == (np.array([[len(a & b) for b in plain] for a in plain]) * off).tolist()
        assert J.overlaps(raw[:9], raw[9:], columns=7).tolist() == [[len(a & b) for b in plain[9:]] for a in plain[:9]]


def test_bound_is_never_below_the_overlap():
    r = np.random.default_rng(1)
    for _ in range(100):
        a, b = (np.unique(r.integers(0, 500, 200).astype(np.uint64)) for _ in range(2))
        points = [np.bincount((hashing.mix(s) & np.uint64(J.GROUPS - 1)).astype(np.int64), minlength=J.GROUPS) for s in (a, b)]
        assert np.minimum(*points).sum() >= J.overlap(a, b) == len(set(a.tolist()) & set(b.tolist()))


def test_marked_cells_and_small_cells():
    keys = np.array([7] * (J.SMALL + 3) + [9, 9, 9, 4], np.uint64)
    ids = np.arange(len(keys), dtype=np.int64)
    k, d, large_keys, large_ids = J.collapsed(keys, ids)
    assert sorted(zip(k.tolist(), d.tolist())) == [(4, 22), (7, 0), (7, 0), (9, 19), (9, 20), (9, 21)]
    assert set(large_ids.tolist()) == set(range(J.SMALL + 3)) and set(large_keys.tolist()) == {7}
    pairs, cells, members = J.cell_pairs(k, d)
    assert pairs.tolist() == [[19, 20], [19, 21], [20, 21]]
    assert (cells.tolist(), members.tolist()) == ([7], [0])


def test_long_chains(spark):
    n = 200
    edges = [(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
