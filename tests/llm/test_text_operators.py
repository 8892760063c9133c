import duckdb
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallyhaul.llm import decontamination as D, hashing, language, language_model, queries, toxicity

from . import cases

ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


# --- word hashes -----------------------------------------------------------------

def test_words_of_a_batch():
    texts = [r[1] for r in cases.rows()]
    for pattern, table in ((r"[^\x20\x09-\x0D]+", hashing.NOT_BLANK), (ALNUM, hashing.ALNUM)):
        found = hashing.words(pa.array(texts), table)
        seen = {}
        for t, a, b in zip(texts, found.first[:-1], found.first[1:]):
            want = cases.words(t, pattern)
            assert found.text(a, b).decode() == " ".join(want)
            for w, h in zip(want, found.hashes[a:b].tolist()):
                assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)


def test_long_words_and_blocks(monkeypatch):
    texts = ["a" * 50 + " b", "c " * 40, "d" * 9]
    whole = hashing.words(pa.array(texts), hashing.NOT_BLANK)
    monkeypatch.setattr(hashing, "BLOCK", 7)
    assert (hashing.words(pa.array(texts), hashing.NOT_BLANK).hashes == whole.hashes).all()


# --- decontamination -----------------------------------------------------------------

def leaky():
    r = random.Random(4)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 2, 5, 9, 10, 11, 25])))) for i in range(25)]
    items += [(7, "Again: An item, with  a SECOND text"), (90, None), (91, "!!"), (None, "null id text of ten words and then some more")]
    docs = []
    for i in range(60):
        w = [r.choice(vocabulary) for _ in range(r.choice([0, 3, 40, 200]))]
        for _ in range(r.randrange(3)):
            t = cases.words(r.choice(items)[1], ALNUM)
            at = r.randrange(len(w) + 1)
            w[at:at] = t[r.randrange(3):] if r.random() < 0.3 else t
        docs.append((i, (" " if i % 2 else ", ").join(w)))
    return docs + [(100, None), (101, "AGAIN an.item with a second TEXT")], items


def test_blocks_of_items_follow_each_other(spark):
    """However many blocks a benchmark has, a task runs one pass and holds one block."""
    docs = spark.createDataFrame([(i, f"x{i} " + " ".join(f"w{i}x{j}" for j in range(12))) for i in range(8)], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(11))) for i in range(0, 8, 2)], "item_id long, text string")
    found = D.contaminated(docs, items, block_words=12)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert {r.doc_id: r.leak_n_hit for r in found.collect()} == {i: 11 if i % 2 == 0 else 0 for i in range(8)}


@pytest.mark.parametrize("block_words", [2_000_000, 40])
def test_decontamination_against_plain_search(spark, block_words):
    docs, items = leaky()
    got = D.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"),
                   block_words=block_words)
    assert sorted(map(tuple, got.collect())) == sorted(D.brute_force(docs, items))


def test_decontamination_on_the_given_tables(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = {r[0]: tuple(r) for r in queries.op3_decontamination(spark, sf_dir).collect()}
    # plain search for word runs in joined texts
    windows = {}
    for i, t in items:
        w = cases.words(t, ALNUM)
        for j in range(max(len(w) - 10, 0) + 1 if w else 0):
            windows.setdefault(" ".join(w[j: j + 10]), set()).add(str(i))
    for i, t in docs:
        w = cases.words(t, ALNUM)
        hit, ids = set(), set()
        for n in {len(x.split()) for x in windows}:
            for j in range(len(w) - n + 1):
                if (own := windows.get(" ".join(w[j: j + n]))):
                    hit.update(range(j, j + n))
                    ids |= own
        assert got[i] == (i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))


def test_decontamination_of_odd_rows(spark):
    docs, items = cases.documents(spark), spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    clean = D.decontaminated(docs, items)
    assert clean.columns == docs.columns
    assert sorted(map(repr, clean.collect())) == sorted(map(repr, docs.filter("doc_id IS NULL OR doc_id NOT IN (4, 5)").collect()))
    assert D.decontaminated(docs, items.limit(0)).count() == docs.count()
    assert D.report(cases.empty(spark), items).count() == 0


# --- language --------------------------------------------------------------------------

def phrases(text, known):
    """Greedy parsing by plain substring search."""
    n = i = 0
    while i < len(text):
        size = 1
        while i + size <= len(text) and text[i: i + size] in known:
            size += 1
        i += max(size - 1, 1)
        n += 1
    return n


def test_parsing_against_substring_search():
    r = random.Random(3)
    known = "".join(r.choice("abc") for _ in range(60))
    table = language.automaton(np.array([ord(c) - 94 for c in known]), 8)
    texts = ["".join(r.choice("abcd") for _ in range(r.randrange(1, 40))) for _ in range(200)]
    grid = np.full((len(texts), 40), language.PAD, np.uint8)
    for i, t in enumerate(texts):
        grid[i, : len(t)] = [ord(c) - 94 for c in t]
    assert language.phrases(table, grid).tolist() == [phrases(t, known) for t in texts]


def test_languages_held_out(spark, sf_dir):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op5_language(spark, sf_dir).collect()
    assert {r.doc_id: r.held_out for r in rows} == {i: crc(i, 3) == 1 for i in truth}
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(spark):
    docs = cases.documents(spark)
    rows = {r.doc_id: r for r in language.report(docs).collect()}
    assert len(language.report(docs).collect()) == len(cases.rows())
    for i in (0, 1, 2, 11):
        assert (rows[i].lang_pred, rows[i].score) == ("und", 0.0)
    assert {r.lang_pred for r in rows.values()} == {"und", "en"}
    unlabelled = language.report(docs.withColumn("lang", docs["component_id"].substr(9, 1)).filter("doc_id < 0"))
    assert unlabelled.count() == 0
    assert {r.lang_pred for r in language.report(docs.selectExpr("doc_id", "text", "cast(null AS string) AS lang")).collect()} == {"und"}


# --- toxicity ---------------------------------------------------------------------------

def test_gradients_against_differences():
    r = np.random.default_rng(0)
    x = r.normal(size=(9, toxicity.FEATURES))
    x[-1] = 0
    rows = r.integers(0, 9, (6, toxicity.SPAN))
    rows[2, 10:] = rows[3] = 8
    y, weight = np.array([1, 0, 1, 0, 1, 0]), np.linspace(0.5, 1, 6)
    p = {k: v.astype(float) for k, v in toxicity.initial().items()}
    _, grad = toxicity.gradients(p, x, rows, y, weight)
    for name in p:
        at = tuple(r.integers(0, s) for s in p[name].shape)
        both = []
        for step in (1e-3, -1e-3):
            q = {k: v.copy() for k, v in p.items()}
            q[name][at] += step
            both.append(toxicity.gradients(q, x, rows, y, weight)[0])
        assert (both[0] - both[1]) / 2e-3 == pytest.approx(float(grad[name][at]), rel=2e-2, abs=2e-6)


def test_windows_cover_every_word_twice():
    b = toxicity.read(pa.array(["", " ".join(f"w{i}" for i in range(50)), "a b", None]))
    rows, doc = toxicity.windows(b)
    pad = len(b.word)
    assert doc.tolist() == [0] + [1] * 6 + [2, 3]
    inner = Counter(rows[doc == 1].ravel().tolist())
    assert all(inner[w] >= 1 for w in b.index[b.first[1]: b.first[2]])
    assert sum(n for w, n in inner.items() if w != pad) >= 2 * 50 - 2 * toxicity.STEP
    assert set(rows[0]) == set(rows[-1]) == {pad}


def test_learns_planted_words(spark):
    r = random.Random(6)
    calm = [f"word{i}" for i in range(300)]

    def text(bad):
        w = [r.choice(calm) for _ in range(r.randrange(5, 90))]
        for _ in range(r.randrange(1, 4) if bad else 0):
            w[r.randrange(len(w))] = r.choice(["vilething", "rottenly", "vilestuff"])
        return " ".join(w)

    data = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(None, 1), (5000, None)], "doc_id long, toxic int")
    rows = {q.doc_id: q for q in toxicity.report(docs, labels).collect()}
    assert len(rows) == 602 and rows[900].score == rows[901].score
    held = [(rows[i].predicted, y) for i, _, y in data if crc(i, 3) == 1]
    assert all(rows[i].held_out == (crc(i, 3) == 1) for i, _, _ in data)
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    left = toxicity.without_toxic(docs, labels)
    assert left.columns == docs.columns
    assert {q.doc_id for q in left.collect()} == {i for i, q in rows.items() if not q.predicted}


def test_long_labelled_documents_are_fitted(spark, monkeypatch):
    """Long ones up to their bound, and no place of the sample stays empty."""
    monkeypatch.setattr(toxicity, "train", lambda texts, y: (texts, y))
    monkeypatch.setattr(toxicity, "LONG_CHARS", 250)
    data = [(i, ("long " * 16 if i % 2 else "x " * 5 if i % 3 else None) if i else "huge " * 90) for i in range(120)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i // 2 % 2) for i in range(120)], "doc_id long, toxic int")
    texts, y = toxicity.fit(docs, labels, per_class=12, fit_chars=20)
    assert y.count(0) == y.count(1) == 12 and None not in texts
    texts, y = toxicity.fit(docs, labels, per_class=1000, fit_chars=20)
    assert [sum(len(t) > 20 for t, k in zip(texts, y) if k == label) for label in (0, 1)] == [3, 3]
    assert not any("huge" in t for t in texts)


def test_network_is_fitted_in_a_task(spark, monkeypatch):
    """The driver gets the fitted network, and neither the texts nor the memory of the fitting; the network is the one that the same rows give here."""
    train, r = toxicity.train, random.Random(8)
    rows = [(i, " ".join(r.choice(["vilething", "calm", "word", "other", f"w{i % 9}"] if i % 3 else ["calm", "word"]) for _ in range(30)), int(i % 3 > 0))
            for i in range(90)]
    docs = spark.createDataFrame([q[:2] for q in rows], "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame([(q[0], q[2]) for q in rows], "doc_id long, toxic int")
    fitted = toxicity.fit(docs, labels)
    monkeypatch.setattr(toxicity, "train", lambda texts, y: (os.getpid(), texts, y))
    pid, texts, y = toxicity.fit(docs, labels)
    assert pid != os.getpid()
    assert sorted(zip(texts, y)) == sorted((t, k) for i, t, k in rows if crc(i, 3) != 1)
    here, texts = train(texts, y), pa.array([q[1] for q in rows])
    assert np.allclose(here.scores(texts), fitted.scores(texts), atol=1e-6)
    assert toxicity.fit(docs.filter("doc_id < 0"), labels)[1:] == ([], [])


def test_toxicity_of_odd_rows(spark):
    docs = cases.documents(spark)
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(13)], "doc_id long, toxic int, text string")
    rows = toxicity.report(docs, labels).collect()
    assert len(rows) == len(cases.rows()) and all(0 <= r.score <= 1 for r in rows)
    none = toxicity.report(docs, labels.filter("toxic > 5")).collect()
    assert {r.predicted for r in none} == {0}
    assert toxicity.report(cases.empty(spark), labels).count() == 0
    assert toxicity.without_toxic(docs, labels.filter("toxic > 5")).columns == docs.columns


# --- language model ---------------------------------------------------------------------------

def plain_counts(data):
    tokens = {i: [*cases.words(t), None] for i, t in data}
    train = [i for i in tokens if i is None or crc(i, 7) != 2]
    words = Counter(w for i in train for w in tokens[i])
    return tokens, train, words, Counter(p for i in train for p in zip([0, *tokens[i][:-1]], tokens[i]))


@pytest.mark.parametrize("chunk", [16 << 20, 20_000])
def test_counts_against_plain_counting(spark, sf_dir, monkeypatch, chunk):
    monkeypatch.setattr(language_model, "CHUNK_BYTES", chunk)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    data = [(r.doc_id, r.text) for r in docs.collect()]
    tokens, train, words, _ = plain_counts(data)
    n, v = sum(words.values()), len(words)
    rows = language_model.scored(docs).collect()
    assert len(rows) == len(data)
    for r in rows:
        own = tokens[r.doc_id]
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in own)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (
            crc(r.doc_id, 7) == 2, len(own), sum(words[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_against_the_mixture(spark, monkeypatch):
    """Scores follow from plain counts and the learned weights, and the probabilities of all next tokens add up to one."""
    learned = []
    fit = language_model.mixture_weights
    monkeypatch.setattr(language_model, "mixture_weights", lambda *a: learned.append(fit(*a)) or learned[-1])
    data = cases.families(groups=(3, 8), words_each=40)
    tokens, train, words, pairs = plain_counts(data)
    n, v = sum(words.values()), len(words)
    rows = language_model.scored(spark.createDataFrame(data, "doc_id long, text string")).collect()
    weights = learned[0]
    assert np.allclose(weights.sum(1), 1)

    def p(h, w):
        context = len(train) if h == 0 else words[h]
        mix = weights[language_model.bucket_of(np.array([context]))[0]]
        if not context:
            mix = [0, mix[1] + mix[0] / 2, mix[2] + mix[0] / 2]
        return mix[0] * (pairs[h, w] / context if context else 0) + mix[1] * words[w] / n + mix[2] / (v + 1)

    for r in rows:
        own = tokens[r.doc_id]
        assert r.score == pytest.approx(sum(math.log10(p(h, w)) for h, w in zip([0, *own[:-1]], own)), rel=1e-9)
    for h in (0, "p3", "never seen"):
        assert sum(p(h, w) for w in words) + p(h, "unknown") == pytest.approx(1)


def test_model_on_odd_rows(spark):
    docs = cases.documents(spark)
    rows = language_model.scored(docs).collect()
    assert len(rows) == len(cases.rows())
    by = {r.doc_id: r for r in rows}
    assert by[0].n_tokens == by[1].n_tokens == by[2].n_tokens == 1 and by[None].held_out is False
    assert all(r.score <= 0 and math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert language_model.scored(cases.empty(spark)).count() == 0
    held = next(i for i in range(50) if crc(i, 7) == 2)
    only = language_model.scored(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (only.n_known, only.train_tokens, only.base_score, only.score) == (0, 0, 0.0, 0.0)


def test_registered_sql(spark, sf_dir):
    """Queries with SQL return its rows."""
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
    for name, sql in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, sf_dir)
        want = con.execute(sql)
        columns = [c[0] for c in want.description]
        assert sorted(df.columns) == sorted(columns)
        assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, want.fetchall())), name
