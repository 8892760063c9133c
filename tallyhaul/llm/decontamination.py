"""Benchmark decontamination as a prefix-filtered set join between documents and item windows.

A window is ``window`` consecutive words of an item (a shorter item is one
window). It occurs in a document exactly if all its words stand there in a row, so
its overlap must be whole and the prefix that has to be joined is one token: its
rarest run of ``shingle`` words. Runs are ordered by how often all documents
have them (ties by hash). A document run that equals a prefix token proposes one place
for the window; the place must lie inside the document (length and positional
bounds), the run hash of the whole window must agree, and at last the words
are compared as text.

Documents are never shuffled. Items are worked off in blocks of at most
``block_words`` words, each block broadcast; every block meets every document, and what
it found is stored with the documents before the next one begins. A benchmark of any size needs more passes over the texts and
not more memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from . import hashing
from .common import drop, fresh, settle, small_batches

WINDOW, SHINGLE, BLOCK_WORDS = 10, 3, 2_000_000


class Windows:
    """The distinct windows of a block of items, with runs, lengths and owners."""

    def __init__(self, items: list[tuple[str, str | None]], window: int, shingle: int):
        ids = sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(ids)}
        found = hashing.words(pa.array([t for _, t in items], pa.large_string()), hashing.ALNUM)
        seen: dict[bytes, int] = {}
        texts: list[bytes] = []
        owners: list[set[int]] = []
        for k, (item, _) in enumerate(items):
            a, b = int(found.first[k]), int(found.first[k + 1])
            for i in range(a, max(b - window, a) + 1 if b > a else a):
                text = found.text(i, min(i + window, b))
                at = seen.setdefault(text, len(texts))
                if at == len(texts):
                    texts.append(text)
                    owners.append(set())
                owners[at].add(number[item])
        self.ids, self.texts, self.owners = ids, texts, [np.array(sorted(o)) for o in owners]
        own = hashing.words(pa.array([t.decode() for t in texts], pa.large_string()), hashing.ALNUM)
        self.length = np.diff(own.first)
        by_length = hashing.runs(own.hashes, window)
        self.whole = np.array([by_length[n - 1][a] for n, a in zip(self.length, own.first)], np.uint64)
        # a window of fewer words than a run is its own run
        self.runs: list[list[tuple[int, int]]] = []  # (run length, hash) at each offset
        for n, a in zip(self.length, own.first):
            k = min(shingle, n)
            self.runs.append([(int(k), int(by_length[k - 1][a + j])) for j in range(n - k + 1)])
        self.vocabulary = {k: np.array(sorted({h for r in self.runs for m, h in r if m == k}), np.uint64)
                           for k in sorted({m for r in self.runs for m, _ in r})}

    def prefixes(self, counts: dict[tuple[int, int], int]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By run length: sorted run hashes, and for each a window and the offset of the run in it."""
        rows: dict[int, list[tuple[int, int, int]]] = {}
        for w, runs in enumerate(self.runs):
            _, k, h, j = min((counts.get((k, h), 0), k, h, j) for j, (k, h) in enumerate(runs))
            rows.setdefault(k, []).append((h, w, j))
        out = {}
        for k, r in rows.items():
            r.sort()
            out[k] = (np.array([x[0] for x in r], np.uint64), np.array([x[1] for x in r]), np.array([x[2] for x in r]))
        return out


def _count_runs(block, text_col: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = block.value.vocabulary
        sums = {k: np.zeros(len(v), np.int64) for k, v in vocabulary.items()}
        for batch in batches:
            by_length = hashing.runs(hashing.words(batch.column(text_col), hashing.ALNUM).hashes, max(sums, default=1))
            for k, v in vocabulary.items():  # runs across two texts only disturb the order, never the result
                at = np.minimum(np.searchsorted(v, by_length[k - 1]), len(v) - 1)
                sums[k] += np.bincount(at[v[at] == by_length[k - 1]], minlength=len(v))
        for k, s in sums.items():
            some = np.flatnonzero(s)
            yield pa.record_batch({"k": pa.array(np.full(len(some), k), pa.int32()),
                                   "run": pa.array(vocabulary[k][some].astype(np.int64)),
                                   "n": pa.array(s[some])})
    return count


def _match(found: hashing.Words, block: Windows, prefixes, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Arrays (document, first word, window) of true occurrences in a batch."""
    by_length = hashing.runs(found.hashes, window)
    for k, (tokens, owner, offset) in prefixes.items():
        runs = by_length[k - 1]
        low = np.searchsorted(tokens, runs, "left")
        hit = np.flatnonzero((low < len(tokens)) & (tokens[np.minimum(low, len(tokens) - 1)] == runs))
        if not len(hit):
            continue
        many = np.searchsorted(tokens, runs[hit], "right") - low[hit]
        place = np.repeat(hit, many)
        row = np.repeat(low[hit] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
        win = owner[row]
        start, length = place - offset[row], block.length[win]
        doc = np.searchsorted(found.first, place, "right") - 1
        good = (start >= found.first[doc]) & (start + length <= found.first[doc + 1])
        doc, start, win, length = doc[good], start[good], win[good], length[good]
        same = np.zeros(len(doc), bool)
        for n in np.unique(length):
            of = np.flatnonzero(length == n)
            same[of] = by_length[n - 1][start[of]] == block.whole[win[of]]
        keep = [i for i in np.flatnonzero(same) if found.text(start[i], start[i] + length[i]) == block.texts[win[i]]]
        if keep:
            yield doc[keep], start[keep], win[keep]


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE,
                 block_words: int = BLOCK_WORDS, text_col: str = "text", item_col: str = "item_id",
                 item_text: str = "text", prefix: str = "leak_") -> DataFrame:
    """The rows and columns of ``docs`` and four more, named ``prefix`` + n_words, spans, n_hit, items.

    ``spans`` are [first word, one past last word) of hit words, merged and ascending; ``items`` are the ids, as sorted
    strings, of the items with a window in the text. A null or empty text has no words and no hits; a null item text, or one
    without words, has no window. Items with one id (null is the id "") are one item. A name that ``docs`` already has
    gets a suffix. No items or no documents: no hits, no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    names = [fresh(prefix + n, docs.columns) for n in ("n_words", "spans", "n_hit", "items")]
    words, spans, hit, items = names
    out = docs.withColumn(words, F.lit(0).cast("long")).withColumn(spans, F.lit(None).cast("array<array<int>>")) \
        .withColumn(hit, F.lit(0).cast("long")).withColumn(items, F.lit(None).cast("array<string>"))
    schema = StructType([*docs.schema.fields, StructField(words, LongType()), StructField(spans, ArrayType(ArrayType(IntegerType()))),
                         StructField(hit, LongType()), StructField(items, ArrayType(StringType()))])
    blocks = _blocks(benchmark, block_words, item_col, item_text) or [[]]
    before = None
    for at, rows in enumerate(blocks):
        if at:  # what the blocks before found is stored, so that a task holds one block at a time
            out = settle(out, "decontamination")
            if before is not None:
                drop(before)
            before = out
        block = spark.sparkContext.broadcast(Windows(rows, window, shingle))
        counts = {}
        if block.value.texts:
            counted = docs.select(text_col).mapInArrow(_count_runs(block, text_col), "k int, run long, n long")
            counts = {(r.k, r.run & (1 << 64) - 1): r.n for r in counted.groupBy("k", "run").agg(F.sum("n").alias("n")).collect()}
        prefixes = spark.sparkContext.broadcast(block.value.prefixes(counts))
        out = out.mapInArrow(_hits(block, prefixes, window, text_col, names), schema)
    return out


def _blocks(benchmark: DataFrame, block_words: int, item_col: str, item_text: str) -> list[list[tuple[str, str | None]]]:
    """Items in blocks of bounded size. Blocks are cut by running length over ids; one block at a time is fetched."""
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.col(item_text).alias("t")) \
        .filter("t IS NOT NULL")
    size = rows.agg(F.sum(F.length("t") / 2 + 1).alias("n")).first().n or 0
    many = int(size // block_words) + 1
    if many == 1:
        return [[(r.i, r.t) for r in rows.collect()]]
    marked = rows.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(many)))
    return _Lazy(marked, many)


class _Lazy:
    """One block of items in the driver at a time."""

    def __init__(self, marked: DataFrame, many: int):
        self.marked, self.many = marked, many

    def __iter__(self):
        for b in range(self.many):
            yield [(r.i, r.t) for r in self.marked.filter(F.col("b") == b).select("i", "t").collect()]


def _hits(block, prefixes, window: int, text_col: str, names: list[str]):
    words, spans, hit, items = names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tokens = block.value, prefixes.value
        for batch in batches:
            found = hashing.words(batch.column(text_col), hashing.ALNUM)
            n = batch.num_rows
            old_spans, old_items = batch.column(spans), batch.column(items)
            got: dict[int, list[tuple[int, int, int]]] = {}
            for docs, starts, wins in _match(found, own, tokens, window):
                for d, s, w in zip(docs.tolist(), starts.tolist(), wins.tolist()):
                    got.setdefault(d, []).append((s - int(found.first[d]), int(own.length[w]), w))
            new_spans, new_items, n_hit = [], [], []
            for d in range(n):
                mine = [tuple(x) for x in old_spans[d].as_py() or ()]
                ids = set(old_items[d].as_py() or ())
                if d in got:
                    mine += [(s, s + length) for s, length, _ in got[d]]
                    ids.update(own.ids[o] for _, _, w in got[d] for o in own.owners[w])
                merged: list[list[int]] = []
                for s, e in sorted(mine):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                new_spans.append(merged)
                new_items.append(sorted(ids))
                n_hit.append(sum(e - s for s, e in merged))
            columns = {c: batch.column(c) for c in batch.schema.names}
            columns |= {words: pa.array(np.diff(found.first)), spans: pa.array(new_spans, pa.list_(pa.list_(pa.int32()))),
                        hit: pa.array(n_hit, pa.int64()), items: pa.array(new_items, pa.list_(pa.string()))}
            yield pa.record_batch(list(columns.values()), names=list(columns))
    return run


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items_sha256 (of the comma-joined ids), contaminated."""
    text_col = options.get("text_col", "text")
    found = contaminated(docs.select(id_col, text_col), benchmark, **options)
    words, _, hit, items = found.columns[-4:]
    return found.select(
        id_col, F.col(words).alias("n_words"), F.col(hit).alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), (F.col(hit) > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that have a window of the benchmark; columns as they are."""
    found = contaminated(docs, benchmark, **options)
    return found.filter(F.col(found.columns[-2]) == 0).select(*docs.columns)


def brute_force(docs: list[tuple], benchmark: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The same report by plain search, for tests: (id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    import re

    def tokens(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+",
                          re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    windows = []
    for item, text in benchmark:
        t = tokens(text)
        if t:
            windows += [("" if item is None else str(item), t[i: i + window]) for i in range(max(len(t) - window, 0) + 1)]
    out = []
    for doc, text in docs:
        t = tokens(text)
        hit, ids = set(), set()
        for item, w in windows:
            for i in range(len(t) - len(w) + 1):
                if t[i: i + len(w)] == w:
                    hit.update(range(i, i + len(w)))
                    ids.add(item)
        joined = ",".join(sorted(ids)).encode()
        out.append((doc, len(t), len(hit), len(ids), hashlib.sha256(joined).hexdigest(), bool(hit)))
    return out
