"""Toxicity by a small bidirectional gated recurrent network with attention pooling, in numpy.

Inputs of a word: how much the word itself, its beginnings (3 to 8 bytes) and its inner runs of
5 bytes lean to toxic documents (log-odds, learned in hashed tables and cross-fitted while the network trains).
The network reads windows of ``SPAN`` words, each word in two of them; all windows of a text are scored. A
logistic layer turns the strongest windows and their sum into the document's score.

Fitting uses at most ``PER_CLASS`` labelled documents of each label in a fixed pseudo-random order; those over ``FIT_CHARS``
characters have at most ``LONG_CHARS`` together. These are the only bounds; scoring reads whole texts, in map tasks, without a shuffle.
The network is fitted in a task, which sends its numbers (about 3 MB) to the driver; texts do not come there.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import hashing
from .common import settle, small_batches, trim_memory

SPAN, STEP, HIDDEN, BITS = 16, 8, 8, 18
PER_CLASS, FIT_CHARS, LONG_CHARS, EPOCHS = 2500, 20_000, 2_000_000, 8
PREFIXES, INNER = (3, 4, 5, 6, 7, 8), 5
FEATURES = 7
THRESHOLD = 0.7


# --- inputs ---------------------------------------------------------------------

@dataclass
class Batch:
    """Words of some texts by number of a distinct word, and the hashed keys of distinct words."""

    index: np.ndarray   # per word: distinct word
    first: np.ndarray   # per document: first word
    word: np.ndarray    # per distinct word: bucket
    starts: np.ndarray  # distinct word x prefix length: bucket, or -1
    inner: np.ndarray   # buckets of inner runs, word after word
    inner_of: np.ndarray


def _bucket(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(64 - BITS)).astype(np.int64)


def _runs_at(data: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n bytes from each position."""
    h = np.full(len(at), n, np.uint64)
    for j in range(n):
        h = hashing.chain(h, data[at + j].astype(np.uint64))
    return h


def read(texts) -> Batch:
    found = hashing.words(texts, hashing.ALNUM)
    _, one, index = np.unique(found.hashes, return_index=True, return_inverse=True)
    s, size = found.starts[one], found.ends[one] - found.starts[one]
    starts = np.full((len(one), len(PREFIXES)), -1)
    for c, n in enumerate(PREFIXES):
        some = np.flatnonzero(size >= n)
        starts[some, c] = _bucket(_runs_at(found.data, s[some], n))
    many = np.maximum(size - INNER + 1, 0)
    of = np.repeat(np.arange(len(one)), many)
    at = s[of] + np.arange(many.sum()) - np.repeat(np.r_[0, np.cumsum(many)[:-1]], many) if len(of) else of
    inner = _bucket(hashing.chain(_runs_at(found.data, at, INNER), np.uint64(77))) if len(of) else of
    return Batch(index, found.first, _bucket(hashing.mix(found.hashes[one])), starts, inner, of)


class Leanings:
    """Log-odds of hashed keys between toxic and other documents."""

    def __init__(self, batches: list[Batch], labels: np.ndarray):
        docs = np.bincount(labels, minlength=2)
        self.tables = []
        for kind in range(3):
            counts = np.zeros((2, 1 << BITS))
            k = 0
            for b in batches:
                bucket, owner = ((b.word, np.arange(len(b.word))), (b.starts.ravel(), np.repeat(np.arange(len(b.word)), len(PREFIXES))),
                                 (b.inner, b.inner_of))[kind]
                order = np.argsort(owner, kind="stable")
                bucket, owner = bucket[order], owner[order]
                low, high = (np.searchsorted(owner, np.arange(len(b.word)), side) for side in ("left", "right"))
                for d in range(len(b.first) - 1):
                    own = np.unique(b.index[b.first[d]: b.first[d + 1]])
                    keys = np.unique(np.concatenate([bucket[low[w]: high[w]] for w in own])) if len(own) else own
                    counts[labels[k], keys[keys >= 0]] += 1
                    k += 1
            odds = np.log((counts[1] + 0.5) / (docs[1] + 1)) - np.log((counts[0] + 0.5) / (docs[0] + 1))
            seen = counts.sum(0)
            self.tables.append((odds * seen / (seen + 3)).astype(np.float32))

    def features(self, b: Batch) -> np.ndarray:
        """Distinct words x FEATURES, scaled to about -1..1, and one row of zeros for padding."""
        n = len(b.word)
        out = np.zeros((n + 1, FEATURES), np.float32)
        if not n:
            return out
        out[:n, 0] = self.tables[0][b.word]
        starts = np.where(b.starts >= 0, self.tables[1][b.starts], 0)
        out[:n, 1], out[:n, 2], out[:n, 3] = starts.max(1), starts.min(1), starts.mean(1)
        if len(b.inner):
            odds = self.tables[2][b.inner]
            begin = np.flatnonzero(np.r_[True, b.inner_of[1:] != b.inner_of[:-1]])
            own = b.inner_of[begin]
            out[own, 4] = np.maximum.reduceat(odds, begin)
            out[own, 5] = np.add.reduceat(odds, begin) / np.diff(np.r_[begin, len(odds)])
        out[:n, :6] /= 4
        out[:n, 6] = 1
        return out


def windows(b: Batch) -> tuple[np.ndarray, np.ndarray]:
    """All overlapping windows (rows of distinct-word numbers, padded with the padding row) and their documents; a text without words has one empty window."""
    size = np.diff(b.first)
    many = np.maximum(-(-(size - SPAN) // STEP) + 1, 1)
    doc = np.repeat(np.arange(len(size)), many)
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    at = b.first[:-1][doc][:, None] + nth[:, None] * STEP + np.arange(SPAN)
    inside = at < b.first[1:][doc][:, None]
    padded = np.r_[b.index, len(b.word)]
    return padded[np.where(inside, at, len(b.index))], doc


# --- the network ------------------------------------------------------------------

def _sigmoid(x):
    return np.tanh(x * 0.5) * 0.5 + 0.5


def initial(seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    h = HIDDEN
    p = {}
    for way in "fb":
        p["W" + way] = r.normal(0, 0.5, (FEATURES, 3 * h))
        p["U" + way] = r.normal(0, 0.3, (h, 3 * h))
        p["c" + way] = np.zeros(3 * h)
    p |= {"att": r.normal(0, 0.3, 2 * h), "out": r.normal(0, 0.3, 2 * h), "bias": np.zeros(1)}
    return {k: v.astype(np.float32) for k, v in p.items()}


def forward(p: dict, x: np.ndarray, rows: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Logit of each window; ``rows`` index the rows of ``x``, of which the last is padding."""
    n, h = len(rows), HIDDEN
    real = (rows < len(x) - 1).astype(np.float32)
    states = np.zeros((SPAN, n, 2 * h), np.float32)
    tape = {}
    for way, order, at in (("f", range(SPAN), slice(0, h)), ("b", range(SPAN - 1, -1, -1), slice(h, 2 * h))):
        pre = x @ p["W" + way] + p["c" + way]
        state = np.zeros((n, h), np.float32)
        for t in order:
            g, u = pre[rows[:, t]], state @ p["U" + way]
            gates = _sigmoid(g[:, : 2 * h] + u[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(g[:, 2 * h:] + r * u[:, 2 * h:])
            z = 1 - (1 - z) * real[:, t: t + 1]  # padding keeps the state
            after = new + z * (state - new)
            if keep is not None:
                tape[way, t] = (state, z, r, new, u[:, 2 * h:])
            state = after
            states[t, :, at] = state
    scores = states @ p["att"] + (real.T - 1) * 1e4
    weight = np.exp(scores - scores.max(0))
    weight /= weight.sum(0)
    context = np.einsum("tn,tnk->nk", weight, states)
    context *= real.any(1)[:, None]
    if keep is not None:
        keep.append((real, states, weight, context, tape))
    return context @ p["out"] + p["bias"][0]


def gradients(p: dict, x: np.ndarray, rows: np.ndarray, y: np.ndarray, weight_of: np.ndarray) -> tuple[float, dict]:
    """Weighted logistic loss and its gradients, by backpropagation through time."""
    kept: list = []
    logit = forward(p, x, rows, kept)
    (real, states, weight, context, tape), h = kept[0], HIDDEN
    prob = _sigmoid(logit)
    loss = -np.mean(weight_of * np.where(y == 1, np.log(prob + 1e-7), np.log(1 - prob + 1e-7)))
    d = (weight_of * (prob - y) / len(y)).astype(np.float32)
    g = {"bias": np.array([d.sum()]), "out": context.T @ d}
    dc = d[:, None] * p["out"] * real.any(1)[:, None]
    dw = np.einsum("nk,tnk->tn", dc, states)
    ds = weight * (dw - (weight * dw).sum(0))
    g["att"] = np.einsum("tn,tnk->k", ds, states)
    dstates = weight[:, :, None] * dc + ds[:, :, None] * p["att"]
    for way, order, at in (("f", range(SPAN - 1, -1, -1), slice(0, h)), ("b", range(SPAN), slice(h, 2 * h))):
        U, dU, dpre = p["U" + way], np.zeros_like(p["U" + way]), np.zeros((len(x), 3 * h), np.float32)
        flow = np.zeros((len(rows), h), np.float32)
        for t in order:
            state, z, r, new, un = tape[way, t]
            flow = flow + dstates[t][:, at]
            on = real[:, t: t + 1]
            raw = 1 - (1 - z) / np.maximum(on, 1e-9) * on
            dz = flow * (state - new) * on * raw * (1 - raw)
            dn = flow * (1 - z) * (1 - new * new)
            dr = dn * un * r * (1 - r)
            du = np.concatenate([dz, dr, dn * r], 1)
            dU += state.T @ du
            np.add.at(dpre, rows[:, t], np.concatenate([dz, dr, dn], 1))
            flow = flow * z + du @ U.T
        g["W" + way], g["U" + way], g["c" + way] = x.T @ dpre, dU, dpre.sum(0)
    return float(loss), g


def document_inputs(logit: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Per document: strongest window, mean of its three strongest, log of summed window probabilities, their mean, 1."""
    order = np.lexsort((-logit, doc))
    first = np.searchsorted(doc[order], np.arange(n))
    count = np.bincount(doc, minlength=n)
    sorted_logit = logit[order]
    top = [sorted_logit[first + np.minimum(k, count - 1)] for k in range(3)]
    total = np.bincount(doc, _sigmoid(logit), n)
    return np.stack([top[0], (top[0] + top[1] + top[2]) / 3, np.log1p(total), total / count, np.ones(n)], 1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        hess = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(hess, x.T @ (p - y) + ridge * w)
    return w


@dataclass
class Model:
    leanings: Leanings
    net: dict
    final: np.ndarray

    def scores(self, texts) -> np.ndarray:
        b = read(texts)
        rows, doc = windows(b)
        x, n = self.leanings.features(b), len(b.first) - 1
        logit = np.concatenate([forward(self.net, x, rows[i: i + 16384]) for i in range(0, len(rows), 16384)]) if n else np.zeros(0)
        return _sigmoid(document_inputs(logit, doc, n) @ self.final) if n else logit


def train(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Fit on labelled texts. Leanings that the network trains on come from the other half of the documents. Without both labels the score is the share of label 1."""
    y = np.array(labels, int)
    if len(y) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Model(Leanings([], np.zeros(0, int)), initial(seed), np.array([0, 0, 0, 0, np.log(share / (1 - share))]))
    r = np.random.default_rng(seed)
    halves = [np.flatnonzero(np.arange(len(y)) % 2 == k) for k in (0, 1)]
    batches = [read(pa.array([texts[i] for i in half], pa.large_string())) for half in halves]
    parts = []
    for k in (0, 1):
        leaning = Leanings([batches[1 - k]], y[halves[1 - k]])
        rows, doc = windows(batches[k])
        parts.append((leaning.features(batches[k]), rows, doc, y[halves[k]]))
    p = initial(seed)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    steps = 0
    for epoch in range(EPOCHS):
        picked = []
        for k, (x, rows, doc, own) in enumerate(parts):
            if epoch:
                strength = np.concatenate([forward(p, x, rows[i: i + 16384]) for i in range(0, len(rows), 16384)])
            else:
                strength = (x[:, 0] + x[:, 1] + x[:, 4])[rows].max(1)
            order = np.lexsort((-strength, doc))
            first = np.searchsorted(doc[order], np.arange(len(own)))
            count = np.bincount(doc, minlength=len(own))
            for nth in range(3):
                some = np.flatnonzero(count > nth)
                picked += [(k, w, own[d], 1.0 if nth == 0 else 0.5) for d, w in zip(some, order[first[some] + nth])]
            calm = np.flatnonzero(own == 0)
            extra = first[calm] + (r.random(len(calm)) * count[calm]).astype(int)
            picked += [(k, w, 0, 1.0) for w in order[extra]]
        picked = [picked[i] for i in r.permutation(len(picked))]
        for i in range(0, len(picked), 256):
            for k in (0, 1):
                chosen = [c for c in picked[i: i + 256] if c[0] == k]
                if not chosen:
                    continue
                x, rows = parts[k][0], parts[k][1][[c[1] for c in chosen]]
                used, local = np.unique(rows, return_inverse=True)  # only the rows of x that these windows read
                used = np.r_[used[used < len(x) - 1], len(x) - 1]
                _, g = gradients(p, x[used], local.reshape(rows.shape), np.array([c[2] for c in chosen]),
                                 np.array([c[3] for c in chosen]))
                steps += 1
                rate = 0.02 / (1 + 0.3 * epoch)
                for name, grad in g.items():
                    m, v = moment[name]
                    m += 0.1 * (grad - m)
                    v += 0.01 * (grad * grad - v)
                    p[name] -= (rate * (m / (1 - 0.9 ** steps)) / (np.sqrt(v / (1 - 0.99 ** steps)) + 1e-6)).astype(np.float32)
    inputs = np.concatenate([document_inputs(np.concatenate([forward(p, x, rows[i: i + 16384]) for i in range(0, len(rows), 16384)]),
                                             doc, len(own)) for x, rows, doc, own in parts])
    final = _logistic(inputs, np.concatenate([part[3] for part in parts]))
    return Model(Leanings(batches, np.concatenate([y[h] for h in halves])), p, final)


# --- on tables ----------------------------------------------------------------------

def held_out(id_col: Column) -> Column:
    """Documents that no label is learned from."""
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "utf-8")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, fit_chars: int = FIT_CHARS,
        id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Train, in one task, on a bounded sample of the labelled rows that are not held out: ``per_class`` ids of each label, in a fixed pseudo-random order.

    Of documents over ``fit_chars`` characters those take part that have ``LONG_CHARS`` together; the next ones that fit take the places of others."""
    ids = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).filter(
        "y IN (0, 1) AND id IS NOT NULL").filter(~held_out(F.col("id"))).withColumn("h", F.xxhash64("id"))
    sizes = docs.select(F.col(id_col).alias("id"), F.length(text_col).alias("n")).groupBy("id").agg(F.max("n").alias("n"))
    ids = settle(ids.join(sizes.filter(F.col("n") <= max(fit_chars, LONG_CHARS)), "id"), "toxicity_labelled")
    sample = None
    for y in (0, 1):
        own = ids.filter(F.col("y") == y)
        long = own.filter(F.col("n") > fit_chars).orderBy("h", "id").limit(LONG_CHARS // max(fit_chars, 1) + 1)  # no more can fit
        long = long.withColumn("upto", F.sum("n").over(W.orderBy("h", "id").rowsBetween(W.unboundedPreceding, 0)))
        short = own.filter(F.col("n") <= fit_chars).orderBy("h", "id").limit(per_class)
        some = short.unionAll(long.filter(F.col("upto") <= LONG_CHARS).drop("upto")).orderBy("h", "id").limit(per_class)
        sample = some if sample is None else sample.unionAll(some)
    sample = settle(sample.dropDuplicates(["id"]), "toxicity_sample")  # 2 x per_class rows at most
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").filter(
        "text IS NOT NULL").select("id", "text", "y", "h")
    small_batches(docs.sparkSession)
    learn = train

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        rows = sorted({r["id"]: r for r in sorted(rows, key=lambda r: (r["id"], r["text"]))}.values(), key=lambda r: (r["h"], r["id"]))
        model = pickle.dumps(learn([r["text"] for r in rows], [r["y"] for r in rows]))
        del rows
        trim_memory()
        yield pa.record_batch({"model": pa.array([model], pa.binary())})

    fitted = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(fitted[0].model) if fitted else learn([], [])


def scored(docs: DataFrame, model: Model, score: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``score`` in 0..1. Null and empty texts have the score of a text without words. No rows give no rows."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array(np.clip(shared.value.scores(batch.column(text_col)), 0, 1).astype(float), pa.float64())
            yield pa.record_batch([*batch.columns, values], names=[*batch.schema.names, score])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(score, DoubleType())]))


def report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: id, held_out, score, predicted."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **options)
    found = scored(docs.select(id_col, F.col(text_col).alias("text")), model)
    return found.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score",
                        (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """``docs`` without the documents whose score reaches the threshold; columns as they are."""
    from .common import fresh

    name = fresh("toxicity_score", docs.columns)
    found = scored(docs, fit(docs, labels, **options), name)
    return found.filter(F.col(name) < threshold).select(*docs.columns)
