"""Exact search for the largest inner products, with vector-approximation files.

Vectors of whole numbers are stored twice: quantised (each component's cell, one byte) and exact. From cells alone an inner product has
a lower and an upper bound. A query set of bounded size is sent to all tasks at a time, and each goes through its
share of the table twice:

1. Cells only. Per query the k-th largest lower bound of the task; the largest of these over all tasks bounds the k-th result from below.
2. Cells again, with that bound. Vectors whose upper bound reaches it are read exactly, in the order of their bounds, until the
   next bound is below the k-th result found; what a task found moves on, at most k rows per query.

Equal vectors are one row with its k smallest ids, equal queries are one query, and pairs never leave a task, so that groups of equal
or nearly equal vectors cost no more rows than others. More queries need more passes and not more memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import settle, small_batches

CELLS, SCALE, EVERY, K = 64, 256, 50, 5
BLOCK_ROWS, BLOCK_QUERIES, PASS_BYTES = 4096, 1024, 8 << 20
EXACT = 1 << 53
NONE = np.iinfo(np.int64).min


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component, as an array of longs. Rows with a null id, without components, or with a component that
    is null or not finite take no part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("raw"))
    v = F.transform("raw", lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    finite = F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & (F.size("raw") > 0) & F.coalesce(finite, F.lit(False))).select("vec_id", v.alias("v"))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """(v, ids): each vector once, with its ``keep`` smallest ids. A task passes on ``keep`` ids of a vector at most."""
    order = W.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= keep)
    return few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


# --- cells ------------------------------------------------------------------------

def _limits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Smallest and largest value of each component, per length of vector."""
    found: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for n, _, x in _by_length(batch.column("v")):
            low, high = x.min(0), x.max(0)
            if n in found:
                low, high = np.minimum(low, found[n][0]), np.maximum(high, found[n][1])
            found[n] = [low, high]
    for n, (low, high) in found.items():
        yield pa.record_batch({"n": pa.array(np.full(n, n)), "at": pa.array(np.arange(n)), "low": pa.array(low), "high": pa.array(high)})


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, matrix) of the lists."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    at = np.r_[0, np.cumsum(sizes)]
    for n in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == n)
        yield n, rows, flat[(at[rows][:, None] + np.arange(n)).ravel()].reshape(len(rows), n)


Grid = dict[int, tuple[np.ndarray, np.ndarray]]  # by length: lowest value and cell width of each component


def grid(rows: DataFrame, cells: int = CELLS) -> Grid:
    """Equal cells between the smallest and the largest value of each component: as many numbers as vectors have components."""
    spans = rows.select("v").mapInArrow(_limits, "n long, at long, low long, high long").groupBy("n", "at").agg(
        F.min("low").alias("low"), F.max("high").alias("high")).collect()
    out: dict[int, list] = {}
    for r in sorted(spans):
        out.setdefault(r.n, []).append((r.low, max(1, -(-(r.high - r.low + 1) // cells))))
    return {n: (np.array([x[0] for x in v], np.int64), np.array([x[1] for x in v], np.int64)) for n, v in out.items()}


def _cells(grid: Grid):
    """Adds the cell column: a byte for each component."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = [b""] * batch.num_rows
            for n, rows, x in _by_length(batch.column("v")):
                low, width = grid[n]
                c = ((x - low) // width).astype(np.uint8)
                for r, row in zip(rows.tolist(), c):
                    out[r] = row.tobytes()
            yield pa.record_batch([batch.column("ids"), pa.array(out, pa.binary()), batch.column("v")], names=["ids", "cells", "v"])
    return run


# --- bounds and exact values -------------------------------------------------------

class Block:
    """Products of a few thousand vectors of one length with a set of queries. Whole numbers throughout: floats hold them as long as they stay
    below 2**53, else 64-bit integers are multiplied."""

    def __init__(self, grid: Grid, n: int, queries: np.ndarray):
        self.low, self.width = grid[n]
        self.q = queries
        slack = np.abs(queries) @ (self.width - 1)
        reach = int(np.abs(queries).max(initial=0)) * int((np.abs(self.low) + self.width * 256).max(initial=0)) * n
        if reach >= 1 << 63:
            raise ArithmeticError("products of these vectors do not fit into 64 bits")
        self.kind = np.float64 if reach < EXACT else np.int64
        self.scaled = (queries * self.width).astype(self.kind).T
        self.base = queries @ self.low + np.minimum(queries, 0) @ (self.width - 1)
        self.slack = slack

    def lower(self, cells: np.ndarray) -> np.ndarray:
        """(vectors, queries). The upper bound is ``slack`` more."""
        return (cells.astype(self.kind) @ self.scaled).astype(np.int64) + self.base

    def exact(self, q: int, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.q[q]


def _blocks(queries: dict[int, tuple[np.ndarray, np.ndarray]], grid: Grid, size: int) -> list[tuple[int, np.ndarray, Block]]:
    """(length, query numbers, block), of ``size`` queries at most, so that a matrix of bounds stays small."""
    return [(n, ids[i: i + size], Block(grid, n, v[i: i + size])) for n, (ids, v) in queries.items() if n in grid for i in range(0, len(ids), size)]


def _gathered(batches: Iterator[pa.RecordBatch], block_rows: int) -> Iterator[pa.RecordBatch]:
    """Short batches put together."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= block_rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _matrix(column: pa.Array, rows: np.ndarray, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.take(pa.array(rows)).to_pylist()), np.uint8).reshape(len(rows), n)


def _bounds(sent, grid: Grid, k: int, block_rows: int):
    """First pass: per query the k-th largest lower bound among the rows of a task. A row with several ids counts as often."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _blocks(sent.value, grid, BLOCK_QUERIES)
        best = [np.full((k, len(ids)), NONE) for _, ids, _ in blocks]
        for batch in _gathered(batches, block_rows):
            copies = np.array([min(len(x), k) for x in batch.column("ids").to_pylist()])
            sizes = np.array([len(c) for c in batch.column("cells").to_pylist()])
            for i, (n, _, block) in enumerate(blocks):
                rows = np.flatnonzero(sizes == n)
                if len(rows):
                    lower = np.repeat(block.lower(_matrix(batch.column("cells"), rows, n)), copies[rows], axis=0)
                    if len(lower) > k:
                        lower = np.partition(lower, len(lower) - k, axis=0)[-k:]
                    best[i] = np.partition(np.concatenate([best[i], lower]), len(lower), axis=0)[-k:]
        for (_, ids, _), b in zip(blocks, best):
            at = b.min(0)
            yield pa.record_batch({"q": pa.array(ids[at > NONE]), "at_least": pa.array(at[at > NONE])})
    return run


FOUND = "q long, vec_id long, score long"


def _results(sent, bounds, grid: Grid, k: int, block_rows: int):
    """Second pass: results of a task that can be among the k of all, at most k ids per query (ties to smaller ids)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _blocks(sent.value, grid, BLOCK_QUERIES)
        floors = [np.array([bounds.value.get(q, NONE) for q in ids.tolist()], np.int64) for _, ids, _ in blocks]
        found: dict[int, list[tuple[int, int]]] = {}
        for batch in _gathered(batches, block_rows):
            sizes = np.array([len(c) for c in batch.column("cells").to_pylist()])
            ids, exact = batch.column("ids"), batch.column("v")
            offsets, flat = exact.offsets.to_numpy(), exact.values.to_numpy()
            for (n, numbers, block), floor in zip(blocks, floors):
                rows = np.flatnonzero(sizes == n)
                if not len(rows):
                    continue
                upper = block.lower(_matrix(batch.column("cells"), rows, n)) + block.slack
                asked = np.flatnonzero((upper >= floor).any(0))
                for j in asked.tolist():
                    q = int(numbers[j])
                    mine = found.setdefault(q, [])
                    some = np.flatnonzero(upper[:, j] >= floor[j])
                    some = some[np.argsort(-upper[some, j], kind="stable")]
                    step, i = max(16, k), 0
                    while i < len(some) and upper[some[i], j] >= floor[j]:
                        part = rows[some[i: i + step]]
                        scores = block.exact(j, flat[(offsets[part][:, None] + np.arange(n)).ravel()].reshape(len(part), n))
                        for r, s in zip(part[scores >= floor[j]].tolist(), scores[scores >= floor[j]].tolist()):
                            mine += [(-s, x) for x in ids[r].as_py()]
                        mine.sort()
                        del mine[k:]
                        if len(mine) == k:
                            floor[j] = max(floor[j], -mine[-1][0])
                        i, step = i + step, min(2 * step, 1024)
        rows = [(q, x, -s) for q, mine in found.items() for s, x in mine]
        for i in range(0, len(rows), 10_000):
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows[i: i + 10_000])], names=["q", "vec_id", "score"])
    return run


# --- the search ---------------------------------------------------------------------

def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE,
            cells: int = CELLS, block_rows: int = BLOCK_ROWS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` its ``k`` largest inner products with other rows, ties to
    smaller ids; all others if they are fewer.

    Components count as floor(scale * x). Rows that take no part: see ``whole_vectors``. Vectors of another length than the
    query's are no candidates. Rows with one id and one vector count once; ids are taken to be unique otherwise, and of an id with
    several vectors each is a row (and a query) of its own, of which the query's own id is left out. Other columns are not
    read. No rows give no rows.
    """
    if cells > 256:
        raise ValueError("a cell is a byte")
    spark = vectors.sparkSession
    small_batches(spark)
    rows = whole_vectors(vectors, id_col, vector_col, scale).distinct()
    several = distinct_vectors(rows, k + 1)
    once = settle(several, "vectors")
    sizes = grid(once, cells)
    table = settle(once.mapInArrow(_cells(sizes), "ids array<long>, cells binary, v array<long>"), "cells")
    asked = rows.filter(F.pmod("vec_id", F.lit(every)) == 0)
    # numbers of distinct queries: blocks of whole hash ranges, so that a pass takes a bounded number of them
    distinct = settle(asked.groupBy("v").agg(F.min("vec_id").alias("q")), "queries")
    shape = distinct.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    if not shape.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    per_pass = max(1, pass_bytes // (8 * shape.d))
    n_passes = -(-shape.n // per_pass)
    edges = [None, *distinct.approxQuantile("q", [i / n_passes for i in range(1, n_passes)], 0.0), None] if n_passes > 1 else [None, None]
    found = None
    for low, high in zip(edges[:-1], edges[1:]):
        part = distinct.filter((F.lit(True) if low is None else F.col("q") > low) & (F.lit(True) if high is None else F.col("q") <= high))
        queries: dict[int, tuple[list, list]] = {}
        for r in part.collect():  # at most about PASS_BYTES of them
            own = queries.setdefault(len(r.v), ([], []))
            own[0].append(r.q)
            own[1].append(r.v)
        sent = spark.sparkContext.broadcast({n: (np.array(a), np.array(b)) for n, (a, b) in queries.items()})
        bounds = table.select("ids", "cells").mapInArrow(_bounds(sent, sizes, k + 1, block_rows), "q long, at_least long").groupBy("q").agg(
            F.max("at_least").alias("at_least")).collect()
        least = spark.sparkContext.broadcast({r.q: r.at_least for r in bounds})
        more = settle(table.mapInArrow(_results(sent, least, sizes, k + 1, block_rows), FOUND), "found")
        sent.unpersist()
        least.unpersist()
        found = more if found is None else found.unionAll(more)
    best = W.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k + 1)
    lists = top.groupBy("q").agg(F.collect_list(F.struct(F.negate("score").alias("s"), "vec_id")).alias("top"))
    own = asked.join(distinct, "v").select(F.col("vec_id").alias("query_id"), "q")
    ranked = own.join(lists, "q").select("query_id", F.slice(F.array_sort(F.filter("top", lambda x: x.vec_id != F.col("query_id"))), 1, k).alias("top"))
    return ranked.select("query_id", F.posexplode("top").alias("at", "x")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.negate(F.col("x.s")).alias("score"))


ORACLE_SQL = """
WITH sound AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM sound q JOIN sound c ON q.vec_id <> c.vec_id AND q.vec_id % 50 = 0 AND len(q.v) = len(c.v)),
ranked AS (
    SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
