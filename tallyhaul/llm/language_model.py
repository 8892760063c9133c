"""Scoring by a deleted-interpolation n-gram model (words and word pairs).

log10 p(w | h) mixes the maximum-likelihood estimates c(h, w) / c(h) and c(w) / N with the uniform
1 / (V + 1). The weights depend on a bucket of c(h), its number of binary digits, and are learned by expectation-maximisation
on held-out counts: every training token is deleted from the counts it is judged by, so all training text serves.

Counting and look-up are one exchange. Documents are worked off in chunks (consecutive rows of an input
partition, about ``CHUNK_BYTES`` of text):

1. a chunk asks for its distinct words and pairs, with its own training counts: packed arrays of hashes, by bucket,
2. a bucket adds up the counts of all chunks and answers each chunk in the order it asked,
3. chunks meet their documents again and leave two counts per token in a stored table, from which
4. a fixed-size histogram gives the weights, and one more scan the scores.

So a word pair crosses the network once per chunk, whatever its frequency, and a hot word is no hot key. Hashes have
56 bits. Rows must come in the same partitions each time they are read: a stored table, as Spark reads it, does; an
answer that does not fit raises an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from . import hashing
from .common import partitions, settle, small_batches

CHUNK_BYTES, KEY_BYTES, BUCKETS, GRID, ROUNDS = 8 << 20, 7, 24, 4, 60
END = np.array([0xE17A1465], np.uint64)
BEGIN = np.uint64(0xB3C1D2E3F4A5)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "utf-8")) % 7 == 2, F.lit(False))


# --- chunks ---------------------------------------------------------------------

def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches cut where a chunk ends; depends only on the rows of the partition and their order."""
    part, seq, size = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        length = np.diff(hashing.utf8(batch.column("text"))[1])
        at = 0
        while at < batch.num_rows:
            upto = size + np.cumsum(length[at:])
            n = int(np.searchsorted(upto, CHUNK_BYTES)) + 1
            n = min(n, batch.num_rows - at)
            yield (part << 32) + seq, batch.slice(at, n)
            size = int(upto[n - 1])
            at += n
            if size >= CHUNK_BYTES:
                seq, size = seq + 1, 0


def sequences(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of all texts in a row, the hash of each token's pair with the one before, and where texts begin; each text has one end token."""
    found = hashing.words(texts, hashing.NOT_BLANK)
    n = len(found.first) - 1
    first = found.first + np.arange(n + 1)
    token = np.empty(len(found.hashes) + n, np.uint64)
    last = np.zeros(len(token), bool)
    last[first[1:] - 1] = True
    token[~last] = found.hashes
    token[last] = END
    before = np.r_[BEGIN, token[:-1]]
    before[first[:-1]] = BEGIN
    return token >> np.uint64(64 - 8 * KEY_BYTES), hashing.chain(before, token) >> np.uint64(64 - 8 * KEY_BYTES), first


def _bucket_cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in sorted keys: buckets are equal ranges of hashes."""
    width = np.uint64(1 << (8 * KEY_BYTES - 24))
    bucket = (keys // width) * np.uint64(buckets) >> np.uint64(24)
    return np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))


def _pack(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    rows = np.frombuffer(data, np.uint8).reshape(-1, KEY_BYTES)
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, :KEY_BYTES] = rows
    return out.view("<u8").ravel()


def _ask(buckets: int):
    """Rows (bucket, chunk, kind, keys, counts); kind 0: words, 1: pairs. In bucket -1: training tokens of the chunk."""
    def rows_of(chunk, parts):
        train = np.concatenate([np.full(len(t), keep) for t, _, keep in parts])
        for kind in (0, 1):
            keys = np.concatenate([p[kind] for p in parts])
            distinct = np.unique(keys)
            own, n = np.unique(keys[train], return_counts=True)
            counts = np.zeros(len(distinct), "<u4")
            counts[np.searchsorted(distinct, own)] = n
            cuts = _bucket_cuts(distinct, buckets)
            for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])):
                if y > x:
                    yield b, chunk, kind, _pack(distinct[x:y]), counts[x:y].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []

        def flush():
            for row in rows_of(now, parts):
                yield pa.record_batch([pa.array([v]) for v in row[:3]] + [pa.array([v], pa.binary()) for v in row[3:]],
                                      names=["bucket", "chunk", "kind", "keys", "counts"])

        for chunk, batch in _chunked(batches):
            if chunk != now and parts:
                yield from flush()
                parts = []
            now = chunk
            token, pair, first = sequences(batch.column("text"))
            held = np.repeat(batch.column("held").to_numpy(zero_copy_only=False), np.diff(first))
            for keep in (True, False):
                some = held != keep
                parts.append((token[some], pair[some], keep))
        if parts:
            yield from flush()
    return run


ASKED = "bucket long, chunk long, kind long, keys binary, counts binary"
ANSWERS = "chunk long, bucket long, kind long, totals binary, distinct long, tokens long"


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole buckets: totals of each chunk's keys, in its order, and (in rows without a chunk) distinct training words and training tokens."""
    held: dict[tuple[int, int], list[tuple[int, np.ndarray, bytes]]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            held.setdefault((row["bucket"], row["kind"]), []).append((row["chunk"], _unpack(row["keys"]), row["counts"]))
    for (bucket, kind), asks in held.items():
        keys = np.concatenate([a[1] for a in asks])
        counts = np.concatenate([np.frombuffer(a[2], "<u4") for a in asks])
        distinct, at = np.unique(keys, return_inverse=True)
        totals = np.bincount(at, counts, len(distinct)).astype("<u4")
        begin = 0
        for chunk, own, _ in asks:
            part = totals[at[begin: begin + len(own)]]
            begin += len(own)
            yield _answer_row(chunk, bucket, kind, part.tobytes(), 0, 0)
        if kind == 0:
            yield _answer_row(None, bucket, kind, b"", int((totals > 0).sum()), int(totals.sum(dtype=np.int64)))


def _answer_row(*row) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
    names = ("chunk", "bucket", "kind", "totals", "distinct", "tokens")
    return pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds)], names=names)


# --- counts per token -------------------------------------------------------------

def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk, batch in _chunked(batches):
        yield pa.record_batch([pa.array([chunk] * batch.num_rows, pa.int64()), *batch.columns], names=["chunk", *batch.schema.names])


def _planes(a: np.ndarray) -> bytes:
    """Byte planes of numbers below 2**32: small numbers leave planes of zeros, which compress away."""
    return np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _meet(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """Documents of a chunk and all answers to it."""
    parts, totals = [], []  # a text's beginning is a context as often as there are training texts
    for batch in docs.to_batches(max_chunksize=512):
        parts.append(sequences(batch.column("text")))
    if not parts:
        return pa.Table.from_batches([], COUNTED)
    rows = sorted(zip(answers["kind"].to_pylist(), answers["bucket"].to_pylist(), answers["totals"].to_pylist()))
    for kind in (0, 1):
        keys = np.concatenate([p[kind] for p in parts])
        distinct, at = np.unique(keys, return_inverse=True)
        answer = np.frombuffer(b"".join(r[2] for r in rows if r[0] == kind), "<u4")
        if len(answer) != len(distinct):
            raise RuntimeError("the input came in other partitions than before; store it first")
        totals.append(answer[at])
    first = np.r_[0, np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))]
    word = [_planes(totals[0][a:b]) for a, b in zip(first[:-1], first[1:])]
    pair = [_planes(totals[1][a:b]) for a, b in zip(first[:-1], first[1:])]
    return pa.table([docs["id"], docs["held"], pa.array(word, pa.binary()), pa.array(pair, pa.binary())], schema=COUNTED)


COUNTED = pa.schema([("id", pa.int64()), ("held", pa.bool_()), ("word", pa.binary()), ("pair", pa.binary())])


# --- weights ------------------------------------------------------------------------

def bucket_of(context: np.ndarray) -> np.ndarray:
    """Number of binary digits of the context's count."""
    return np.minimum(np.frexp(context.astype(float))[1] * (context > 0), BUCKETS - 1)


def _histogram(documents: int):
    """Sums over training tokens, each deleted from its counts: (cell, n). A cell has a bucket and both estimates in steps of 1 / GRID octave."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, int] = {}
        for batch in batches:
            cells = []
            for held, word, pair in zip(*(batch.column(c).to_pylist() for c in ("held", "word", "pair"))):
                if held:
                    continue
                w, hw = _numbers(word), _numbers(pair)
                h = np.r_[documents, w[:-1]]
                p2 = np.where((hw > 1) & (h > 1), (hw - 1) / np.maximum(h - 1, 1), 0)
                with np.errstate(divide="ignore"):
                    q2 = np.where(p2 > 0, np.clip(np.rint(-np.log2(p2) * GRID), 0, 254), 255).astype(np.int64)
                    q1 = np.where(w > 1, np.clip(np.rint(np.log2(np.maximum(w - 1, 1)) * GRID), 0, 254), 255).astype(np.int64)
                cells.append((bucket_of(np.maximum(h - 1, 0)) << 16) + (q2 << 8) + q1)
            if cells:
                for c, n in zip(*(x.tolist() for x in np.unique(np.concatenate(cells), return_counts=True))):
                    sums[c] = sums.get(c, 0) + n
        if sums:
            yield pa.record_batch([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.int64())], names=["cell", "n"])
    return run


def mixture_weights(cells: dict[int, int], tokens: int, vocabulary: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (pair, word, uniform) of each bucket, by expectation-maximisation on the histogram; words and uniform share evenly where a bucket has no data, and uniform takes all where none has."""
    out = np.tile([0.0, 0.5, 0.5], (BUCKETS, 1))
    key, n = np.array(list(cells), np.int64), np.array(list(cells.values()), float)
    if not len(key):
        out[:] = (0.0, 0.0, 1.0)
        return out
    q2, q1 = key >> 8 & 255, key & 255
    p = np.stack([np.where(q2 < 255, 2.0 ** (-q2 / GRID), 0), np.where(q1 < 255, 2.0 ** (q1 / GRID) / max(tokens - 1, 1), 0),
                  np.full(len(key), 1 / (vocabulary + 1))], 1)
    for b in range(BUCKETS):
        some = key >> 16 == b
        if not some.any():
            continue
        weight = np.array([1.0, 1.0, 1.0]) / 3
        for _ in range(rounds):
            share = p[some] * weight
            share /= share.sum(1, keepdims=True)
            weight = (share * n[some][:, None]).sum(0)
            weight = (weight + [0, 0, 0.1]) / (weight.sum() + 0.1)  # the uniform part never vanishes
        out[b] = weight
    return out


def _score(documents: int, tokens: int, vocabulary: int, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, known, base, score = [], [], [], []
            for word, pair in zip(batch.column("word").to_pylist(), batch.column("pair").to_pylist()):
                w, hw = _numbers(word), _numbers(pair)
                h = np.r_[documents, w[:-1]]
                n.append(len(w))
                known.append(int((w > 0).sum()))
                base.append(math.fsum(np.log10((w + 1) / (tokens + vocabulary + 1))))
                mix = weights[bucket_of(h)]
                p2 = np.where(h > 0, hw / np.maximum(h, 1), 0)
                lost = np.where(h > 0, 0, mix[:, 0])  # a context without counts gives its pair weight to words and uniform alike
                p = mix[:, 0] * p2 + (mix[:, 1] + lost / 2) * w / max(tokens, 1) + (mix[:, 2] + lost / 2) / (vocabulary + 1)
                score.append(math.fsum(np.log10(np.minimum(p, 1.0))))
            yield pa.record_batch([batch.column("id"), batch.column("held"), pa.array(n, pa.int64()), pa.array(known, pa.int64()),
                                   pa.array([tokens] * len(n), pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())],
                                  names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return run


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words of A-Z-lower-cased text and one end; null text counts as empty, so it has its end alone. ``base_score`` is
    add-one unigram, ``score`` the model's log10 probability of the text. Held-out documents are counted nowhere. Rows with a null id
    are training rows. Without training rows all counts are 0 and both scores are uniform. Other columns are not read. No rows give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("id"), held_out(F.col(id_col)).alias("held"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = partitions(spark)
    asked = base.mapInArrow(_ask(n), ASKED).repartition(n, "bucket")
    answers = settle(asked.mapInArrow(_answer, ANSWERS), "model_answers")
    sums = answers.filter("chunk IS NULL").agg(F.sum("distinct").alias("v"), F.sum("tokens").alias("n")).first()
    vocabulary, tokens = int(sums.v or 0), int(sums.n or 0)
    documents = base.filter("NOT held").count()
    kind = "id long, held boolean, word binary, pair binary"
    counted = base.mapInArrow(_mark, "chunk long, id long, held boolean, text string").groupBy("chunk").cogroup(
        answers.filter("chunk IS NOT NULL").groupBy("chunk")).applyInArrow(_meet, kind)
    counted = settle(counted, "model_counts")
    rows = counted.mapInArrow(_histogram(documents), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    weights = mixture_weights({r.cell: r.n for r in rows}, tokens, vocabulary)
    return counted.mapInArrow(_score(documents, tokens, vocabulary, weights), "id long, held_out boolean, n_tokens long, n_known long, "
                              "train_tokens long, base_score double, score double").withColumnRenamed("id", id_col)
