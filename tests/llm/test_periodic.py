import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tallyhaul.llm import periodic, queries

from . import cases


def plain_runs(w):
    """{(start, length, period)}: per period the stretches of equal words so far apart; the smallest period of a stretch counts."""
    n, best = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in best.items())


def plain(data, plant=True):
    out = []
    for i, text in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(w), zlib.crc32(str(i).encode())
        if plant and i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[x] if x < a else w[a + (x - a) % p] for x in range(n)]
        found = plain_runs(w)
        gone = {x for s, length, q in found for x in range(s + q, s + length)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        out.append((i, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                    hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()).hexdigest(),
                    hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def sequences():
    r = random.Random(4)
    yield "a" * 1000
    yield "ab" * 300 + "ba" * 300
    yield "b" + "ab" * 20 + "a" + "ab" * 20 + "ab"
    yield ("a" * 30 + "b") * 12 + "a" * 100
    yield "abaababaabaababaababa" * 9
    fib = ["a", "ab"]
    while len(fib[-1]) < 1500:
        fib.append(fib[-1] + fib[-2])
    yield fib[-1]
    thue = "a"
    while len(thue) < 1024:
        thue += thue.translate(str.maketrans("ab", "ba"))
    yield thue
    for n in range(0, 40):
        yield "ab" * (n // 2) + "a" * (n % 2)
    for _ in range(150):
        size, out = r.choice((2, 2, 3, 5)), ""
        for _ in range(r.randrange(1, 9)):
            unit = "".join(chr(97 + r.randrange(size)) for _ in range(r.choice((1, 2, 3, 5, 7, 12, 14, 15, 29, 31, 60))))
            out += (unit * 12)[: r.randrange(1, 6 * len(unit) + 2)]
        yield out
    for _ in range(100):
        yield "".join(chr(97 + r.randrange(2)) for _ in range(r.randrange(1, 300)))


def test_all_runs_of_odd_sequences():
    texts = list(sequences())
    symbols = np.array([ord(c) for t in texts for c in t])
    first = np.r_[0, np.cumsum([len(t) for t in texts])]
    start, end, period = periodic.runs(symbols, first)
    doc = np.searchsorted(first, start, "right") - 1
    got = [[] for _ in texts]
    for d, s, e, q in zip(doc.tolist(), start.tolist(), end.tolist(), period.tolist()):
        got[d].append((s - int(first[d]), e - s, q))
    for t, g in zip(texts, got):
        assert g == plain_runs(t), t


def test_successor():
    r = np.random.default_rng(5)
    values = r.permutation(700)
    w = periodic.Wavelet(values)
    low, x = r.integers(0, 700, 500), r.integers(0, 1100, 500)
    high = np.minimum(700, low + r.integers(0, 60, 500))
    want = [min((v for v in values[a:b].tolist() if v >= c), default=-1) for a, b, c in zip(low, high, x)]
    assert w.successor(low, high, x, -1).tolist() == want


def test_unary_text_is_quick():
    start, end, period = periodic.runs(np.zeros(300_000, np.int64), np.array([0, 300_000]))
    assert (start.tolist(), end.tolist(), period.tolist()) == ([0], [300_000], [1])


def test_query_against_plain_search(spark, sf_dir):
    data = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    short = [d for d in data if len((d[1] or "").split()) < 1500]
    assert len(short) > len(data) // 2
    want = {r[0]: r for r in plain(short)}
    got = {r[0]: tuple(r) for r in queries.op13_periodic_runs(spark, sf_dir).collect()}
    assert len(got) == len(data) and {i: got[i] for i in want} == want


@pytest.mark.parametrize("words_at_once", [1, 1 << 17])
def test_odd_rows(spark, monkeypatch, words_at_once):
    monkeypatch.setattr(periodic, "SLICE_WORDS", words_at_once)
    rows = [r if r[1] is None or len(r[1]) < 5000 else (*r[:1], r[1][:6000], *r[2:]) for r in cases.rows()]
    rows += [(1000 + i, " ".join(t[:400]), None, None, None, *"abcde") for i, t in enumerate(sequences()) if i < 60]
    docs = cases.documents(spark, rows).coalesce(2)
    assert sorted(map(tuple, periodic.report(docs).collect()), key=str) == plain([r[:2] for r in rows])
    assert periodic.report(cases.empty(spark)).collect() == []
    for r in periodic.detected(docs).collect():
        assert hashlib.sha256(r.collapsed.encode()).hexdigest() == r.collapsed_sha256 and len(r.runs) == r.n_runs
    assert sorted((tuple(r)[:8] for r in periodic.detected(docs).collect()), key=str) == plain([r[:2] for r in rows], plant=False)
