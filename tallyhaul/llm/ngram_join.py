"""N-gram Jaccard self-join over count vectors, bulk-loaded into R-tree pages.

A document is its set of word runs, as 64-bit hashes. Hashed into ``GROUPS`` groups the set
becomes a point of counts, and the sum of coordinate minima of two points bounds their overlap.

1. Points: one scan gives each document its set size, set key (128 bits) and point. Equal sets are one class from
   here on, by their smallest document. Long documents have finer points, whose groups add up to coarser ones: about four elements or less
   are in a group, as the minima of fuller groups would leave room for a link between any two texts of that length.
2. Cells: the space of sets is cut into parts by hash range. Two sets that link differ in at most H places (a bound
   from their size class), so of H + 1 + e + g parts at least 1 + e + g are equal in both. A part is a point of its own, and equal
   parts are found by an exact lookup, in cells. Empty parts are looked up only by documents with more than e of them. All pairs of a
   small cell meet once and stay tied if the summed minima of their points leave room for a link. Cells of more than ``SMALL``
   documents come from common passages or from large groups of near copies. A pair that meets in no small cell shares more than g large
   ones of a size class, so a document may leave its g most crowded ones out (they are in one order for all), and mostly has none left.
   Where documents are left in a cell, those tie whose summed minima leave room for a link; more than ``CROWD`` are all tied to the
   smallest. A task with a large cell passes on one document for it. Ties make blocks that hold every link.
3. Pages: documents of blocks are range-sorted by (block, size, point) and cut into leaf pages by rank, so a block of any size
   is spread over tasks. Pages have bounding boxes. Pages meet only where the summed minima of their upper corners leave room for a link.
4. Links: in a page the summed minima bound all pairs of documents at once, and pairs that survive are
   verified on their sets in whole numbers. Pairs that are connected already are skipped, as classes of
   reachable documents are asked for. A block of several pages has a pivot, a central document: all its documents are verified against it and from there on
   stand for their difference from it, a few elements in a group of near copies (two sets differ where these differences do). Only documents
   outside the block's largest class go on to meet all its pages.
5. Components of the links, with stored rounds.

Everything is exact but for collisions of 64-bit run hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from . import hashing
from .common import drop, free_shuffles, lean, partitions, return_memory, settle
from .components import components

GROUPS, PAGE_ROWS, WIDE_ROWS, FLUSH_ROWS, SMALL, CROWD = 64, 256, 2048, 400_000, 16, 1024
#: Rows of numbers, and bytes of pivots, that are sent to all tasks at most.
BESIDE_ROWS, BESIDE_BYTES = 1_000_000, 16 << 20


@dataclass(frozen=True)
class Rule:
    """Two sets link if den * intersection >= num * union; sets are runs of ``k`` words."""

    k: int = 4
    num: int = 85
    den: int = 100

    def need(self, total):
        """Least overlap of two sets with ``total`` elements together."""
        return -(-self.num * total // (self.num + self.den))

    def differ(self, upper: int) -> int:
        """Most elements that two linked sets of at most ``upper`` each have in only one of them."""
        return 2 * upper * (self.den - self.num) // (self.den + self.num)

    def classes(self, size: int) -> tuple[int, list[int]]:
        """Upper bounds of size classes as far as the class after that of ``size``, and the class of ``size``."""
        bounds = [1]
        while bounds[-1] < size:
            bounds.append(max(bounds[-1] + 1, bounds[-1] * self.den // self.num))
        at = len(bounds) - 1
        bounds.append(max(bounds[-1] + 1, bounds[-1] * self.den // self.num))
        return at, bounds


# --- points -------------------------------------------------------------------------

def groups_of(n: int) -> int:
    """Groups of the point of a set of ``n`` elements: a power of two."""
    return max(GROUPS, 1 << (int(n) // 4).bit_length())


def fine_point(mixed: np.ndarray) -> bytes:
    """Counts of the groups of a set, a byte each if they fit."""
    groups = groups_of(len(mixed))
    counts = np.bincount((mixed & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    return counts.astype("u1" if counts.max() < 256 else "<i4").tobytes()


def folded(points: list[bytes], own: np.ndarray, groups: int) -> np.ndarray:
    """Points of ``own`` groups each, added up to ``groups``."""
    out, length = np.zeros((len(points), groups), np.int32), np.array([len(p) for p in points])
    for g, size in set(zip(own.tolist(), length.tolist())):
        at = np.flatnonzero((own == g) & (length == size))
        raw = np.frombuffer(b"".join([points[i] for i in at]), "u1" if size == g else "<i4")
        out[at] = raw.reshape(len(at), g // groups, groups).sum(1)
    return out


def _id_column(values) -> pa.Array:
    return values.cast(pa.int64())


def _points(rule: Rule, with_sets: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return_memory()
        for batch in batches:
            found = hashing.words(batch.column("text"), hashing.NOT_BLANK)
            n, k1, k2, points, sets, budgets = [], [], [], [], [], []
            for s in hashing.shingle_sets(found, rule.k):
                n.append(len(s))
                mixed = hashing.mix(s)
                k1.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                k2.append(int(mixed.sum(dtype=np.uint64).view(np.int64)))
                at, bounds = rule.classes(len(s))
                own, later = (spare(rule.differ(b))[1] for b in bounds[at:at + 2])
                budgets.append((later, own) if at & 1 else (own, later))
                if with_sets:
                    points.append(np.bincount((mixed & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS).astype("<i4").tobytes())
                    sets.append(s.tobytes())
                else:
                    points.append(fine_point(mixed))
            columns = {"id": _id_column(batch.column("id")), "n": pa.array(n, pa.int64()), "k1": pa.array(k1, pa.int64()),
                       "k2": pa.array(k2, pa.int64()), "even": pa.array([b[0] for b in budgets], pa.int64()), "odd": pa.array([b[1] for b in budgets], pa.int64()), "point": pa.array(points, pa.binary())}
            if with_sets:
                columns["elements"] = pa.array(sets, pa.binary())
            yield pa.record_batch(columns)
    return run


#: even, odd: how many large cells a document may lie in, for its size class and the next one, by the last bit of the class and of the cell's key.
POINTS = "id long, n long, k1 long, k2 long, even long, odd long, point binary"


# --- cells ----------------------------------------------------------------------------

def spare(most: int) -> tuple[int, int]:
    """Parts beyond most + 1: as many may be empty, and as many may lie in large cells, before a document has to look them up."""
    return (most + 1) // 24, max(1, (most + 1) // 8)


def parts_of(rule: Rule, s: np.ndarray, class_no: int, upper: int) -> np.ndarray:
    """Lookup keys of the parts of the sorted set ``s``, for pairs whose larger set is in that size class; its last bit is theirs."""
    most = rule.differ(upper)
    if not most:
        return s[:0]  # only equal sets link here, and those are one class already
    empties, large = spare(most)
    many = most + 1 + empties + large
    part = ((s >> np.uint64(32)) * np.uint64(many)) >> np.uint64(32)
    begins = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    sizes = np.diff(np.r_[begins, len(s)])
    sums = np.add.reduceat(hashing.mix(s ^ np.uint64(0x5851F42D4C957F2D)), begins)
    name = part[begins] + np.uint64(class_no << 40)
    with np.errstate(over="ignore"):
        keys = hashing.mix(sums + hashing.mix(name * np.uint64(0x9FB21C651E98DF25) + sizes.astype(np.uint64)))
        if many - len(begins) > empties:  # empty parts may be all that it shares
            empty = np.setdiff1d(np.arange(many, dtype=np.uint64), part[begins]) + np.uint64(class_no << 40)
            keys = np.r_[keys, hashing.mix(hashing.mix(empty * np.uint64(0x9FB21C651E98DF25)))]
    return keys & ~np.uint64(1) | np.uint64(class_no & 1)


def _sorted_runs(keys: np.ndarray, ids: np.ndarray):
    """Rows sorted by key and id, where each key begins and how many rows it has."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    begins = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys, ids, begins, np.diff(np.r_[begins, len(keys)])


def collapsed(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows to pass on, and members of large cells: a cell of more than ``SMALL`` rows passes on its smallest id, twice as a mark."""
    keys, ids, begins, size = _sorted_runs(keys, ids)
    large = np.repeat(size > SMALL, size)
    mark = begins[size > SMALL]
    return np.r_[keys[~large], np.repeat(keys[mark], 2)], np.r_[ids[~large], np.repeat(ids[mark], 2)], keys[large], ids[large]


def cell_pairs(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of small cells, and members (keys, ids) of large or marked ones."""
    keys, ids, begins, size = _sorted_runs(keys, ids)
    again = np.r_[False, (keys[1:] == keys[:-1]) & (ids[1:] == ids[:-1])] if len(keys) else np.zeros(0, bool)
    marked = np.add.reduceat(again, begins, dtype=np.int64) > 0 if len(begins) else np.zeros(0, bool)
    wide = marked | (size > SMALL)
    large = np.repeat(wide, size) & ~again
    pairs = [np.zeros((0, 2), np.int64)]
    for m in range(2, SMALL + 1):
        at = begins[(size == m) & ~wide]
        if len(at):
            x, y = np.triu_indices(m, 1)
            pairs.append(_distinct_pairs(ids[at[:, None] + x].ravel(), ids[at[:, None] + y].ravel()))
    return np.unique(np.concatenate(pairs), axis=0), keys[large], ids[large]


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    pairs = np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b]
    return np.unique(pairs, axis=0) if len(pairs) else pairs.reshape(0, 2).astype(np.int64)


def _cells(rule: Rule, buckets: int):
    """Rows (bucket, keys, ids): lookups of a bucket; in bucket -1 equal sets as two lists of ids, in -2 members of large cells."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return_memory()
        seen: dict[tuple[int, int], int] = {}  # sets of this task
        keys: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        twins: list[tuple[int, int]] = []
        held = 0

        def flush():
            k, d, large_keys, large_ids = collapsed(np.concatenate(keys), np.concatenate(ids))
            order = np.argsort(k, kind="stable")
            k, d = k[order], d[order]
            bucket = ((k >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            cut = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
            rows = [(i, k[x:y].tobytes(), d[x:y].tobytes()) for i, (x, y) in enumerate(zip(cut[:-1], cut[1:])) if y > x]
            rows.append((-1, np.array([t[0] for t in twins], np.int64).tobytes(), np.array([t[1] for t in twins], np.int64).tobytes()))
            rows.append((-2, large_keys.tobytes(), large_ids.tobytes()))
            for row in rows:
                yield pa.record_batch({"bucket": pa.array([row[0]], pa.int32()), "keys": pa.array([row[1]], pa.binary()),
                                       "ids": pa.array([row[2]], pa.binary())})

        for batch in batches:
            found = hashing.words(batch.column("text"), hashing.NOT_BLANK)
            for doc, s in zip(batch.column("id").to_pylist(), hashing.shingle_sets(found, rule.k)):
                if doc is None or not len(s):
                    continue
                key = (int(s.sum(dtype=np.uint64)), int(hashing.mix(s).sum(dtype=np.uint64)))
                if seen.setdefault(key, doc) != doc:
                    twins.append((seen[key], doc))
                    continue
                at, bounds = rule.classes(len(s))
                own = [parts_of(rule, s, at, bounds[at])]
                if len(s) * rule.den // rule.num > bounds[at]:
                    own.append(parts_of(rule, s, at + 1, bounds[at + 1]))
                for p in own:
                    keys.append(p)
                    ids.append(np.full(len(p), doc, np.int64))
                    held += len(p)
                if held >= FLUSH_ROWS:
                    yield from flush()
                    keys, ids, twins, held = [], [], [], 0
        if keys or twins:
            keys, ids = keys or [np.zeros(0, np.uint64)], ids or [np.zeros(0, np.int64)]
            yield from flush()
    return run


TWINS, PAIR, MEMBER = 0, 1, 2


def _ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, a, b) from whole buckets: equal sets, pairs of small cells, and (cell, document) of large ones."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def rows(kind, a, b):
        return pa.record_batch({"kind": pa.array(np.full(len(a), kind, np.int32)), "a": pa.array(a.view(np.int64)),
                                "b": pa.array(b, pa.int64())})

    for batch in batches:
        for bucket, keys, ids in zip(*(batch.column(c).to_pylist() for c in ("bucket", "keys", "ids"))):
            keys, ids = np.frombuffer(keys, np.uint64), np.frombuffer(ids, np.int64)
            if bucket >= 0:
                held.setdefault(bucket, []).append((keys, ids))
            elif len(ids):
                yield rows(TWINS if bucket == -1 else MEMBER, keys, ids)
    while held:
        _, parts = held.popitem()
        pairs, keys, ids = cell_pairs(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        yield rows(PAIR, np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]))
        yield rows(MEMBER, keys, ids)


def _near(rule: Rule):
    """Pairs whose summed coordinate minima reach the overlap that a link needs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q, n, m = batch.column("p").to_pylist(), batch.column("q").to_pylist(), batch.column("n").to_numpy(), batch.column("m").to_numpy()
            own, other = (np.array([groups_of(x) for x in sizes], np.int64) for sizes in (n, m))
            common, bound = np.minimum(own, other), np.zeros(len(n), np.int64)
            for groups in np.unique(common).tolist():
                at = np.flatnonzero(common == groups)
                bound[at] = np.minimum(folded([p[i] for i in at], own[at], groups), folded([q[i] for i in at], other[at], groups)).sum(1)
            yield batch.select(["a", "b"]).filter(pa.array(bound >= rule.need(n + m)))
    return run


def spanning(rule: Rule, n: np.ndarray, points: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of places that connect all documents of a cell whose summed minima leave room for a link."""
    out, left = [], np.arange(len(n))
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            i = front.pop()
            room = np.minimum(points[left], points[i]).sum(1) >= rule.need(n[left] + n[i])
            out += [(i, int(j)) for j in left[room]]
            front += left[room].tolist()
            left = left[~room]
    return out


def _crowds(rule: Rule):
    """Ties of documents that are left in large cells, from rows in order of cells; a cell is at most ``CROWD`` rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def ties(rows: pa.Table):
            cell, ids, n = (rows.column(c).to_numpy() for c in ("cell", "id", "n"))
            points, own = rows.column("point").to_pylist(), np.array([groups_of(x) for x in n], np.int64)
            begins, found = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]), []
            for x, y in zip(begins, np.r_[begins[1:], len(cell)]):
                pairs = spanning(rule, n[x:y], folded(points[x:y], own[x:y], int(own[x:y].min())))
                found += [(ids[x + i], ids[x + j]) for i, j in pairs]
            found = np.array(found, np.int64).reshape(-1, 2)
            return pa.record_batch({"a": pa.array(found[:, 0]), "b": pa.array(found[:, 1])})

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            cell = batch.column("cell").to_numpy()
            cut = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on in the next batch
            if cut or held[0].column("cell")[0].as_py() != cell[-1]:
                yield ties(pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]))
                held = [batch.slice(cut)]
        if held:
            yield ties(pa.Table.from_batches(held))
    return run


# --- pages and links ---------------------------------------------------------------------

def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Range-sorted rows with their partition and their place in it; points as arrays."""
    part, place = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        points = np.frombuffer(b"".join(batch.column("point").to_pylist()), "<i4")
        yield pa.record_batch([batch.column("block"), batch.column("id"), batch.column("n"),
                               pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * GROUPS, pa.int32()), pa.array(points)),
                               pa.array(np.full(n, part, np.int32)), pa.array(np.arange(place, place + n))],
                              names=["block", "id", "n", "point", "part", "place"])
        place += n


def _paged(rows: DataFrame, page_rows: int, label: str) -> tuple[DataFrame, DataFrame]:
    """(block, id, n, point, page), and the stored table it reads: ``page_rows`` rows in order of block, size and point are a page, or several where blocks end.

    A row's rank is its place behind the rows of the partitions before, so pages do not depend on how the sort was cut."""
    keys = ["block", "n", "point", "id"]
    ordered = rows.select(*keys).repartitionByRange(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    placed = settle(ordered.mapInArrow(_placed, "block long, id long, n long, point array<int>, part int, place long"), label)
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    offsets = placed.groupBy("part").agg(F.count("*").alias("c")).select("part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    rank = F.floor((F.col("offset") + F.col("place")) / page_rows)
    return placed.join(offsets, "part").select("block", "id", "n", "point", F.xxhash64("block", rank).alias("page")), placed


def _boxes(pages: DataFrame) -> DataFrame:
    """(block, page, least, upper): smallest size and upper corner of each page."""
    corner = [F.max(F.element_at("point", i + 1)).alias(f"c{i}") for i in range(GROUPS)]
    return pages.groupBy("block", "page").agg(F.min("n").alias("least"), *corner).select(
        "block", "page", "least", F.array(*[f"c{i}" for i in range(GROUPS)]).alias("upper"))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if not len(a) or not len(b):
        return 0
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    return int(np.count_nonzero(a[at] == b))


def overlaps(left: list[bytes], right: list[bytes] | None = None, columns: int = 1024, kind=np.int64) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, as a product of incidence matrices: dense, some columns at a
    time, or sparse, where few sets share an element."""
    rows = len(left)
    sets = [np.frombuffer(e, np.uint64) for e in (left if right is None else [*left, *right])]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(many > 1) - 1  # elements of one set are in no intersection
    owner, at = owner[many[at] > 1], column[at[many[at] > 1]]
    order = np.lexsort((owner, at))
    owner, at = owner[order], at[order]
    width = int(at[-1]) + 1 if len(at) else 0
    begin = np.searchsorted(at, np.arange(width + 1))
    mine = owner < rows if right is not None else np.ones(len(owner), bool)
    split = begin[:-1] + np.add.reduceat(mine, begin[:-1], dtype=np.int64) if width else begin[:-1]
    first, second = (split - begin[:-1], begin[1:] - split) if right is not None else (np.diff(begin), np.diff(begin))
    n, m = rows, len(sets) - rows if right is not None else rows
    out = np.zeros((n, m), np.float32)
    if (first * second).sum() < n * m * width / 16:
        flat, product = out.ravel(), first * second
        start, shift = (split, rows) if right is not None else (begin[:-1], 0)
        for k in np.flatnonzero(product > 1 << 14):  # an element of many sets: one block of the product
            out[np.ix_(owner[begin[k]: begin[k] + first[k]], owner[start[k]: start[k] + second[k]] - shift)] += 1
        light = np.flatnonzero((product > 0) & (product <= 1 << 14))
        steps = np.cumsum(product[light]) >> 19  # pieces of at most about half a million pairs
        for some in np.split(light, np.flatnonzero(np.diff(steps)) + 1):
            if not len(some):
                continue
            # each row of an element on the left meets each one on the right
            f, g = first[some], second[some]
            at_left = np.repeat(begin[some] - np.r_[0, np.cumsum(f)[:-1]], f) + np.arange(f.sum())
            many_of = np.repeat(g, f)
            within = np.arange(many_of.sum()) - np.repeat(np.cumsum(many_of) - many_of, many_of)
            i = np.repeat(owner[at_left], many_of)
            j = owner[np.repeat(np.repeat(start[some], f), many_of) + within] - shift
            np.add.at(flat, i * m + j, 1)
        return out.astype(kind)
    for low in range(0, width, columns):
        x, y = begin[low], begin[min(low + columns, width)]
        block = np.zeros((len(sets), columns), np.float32)
        block[owner[x:y], at[x:y] - low] = 1
        out += block[:rows] @ (block if right is None else block[rows:]).T
    return out.astype(kind)


def links_within(rule: Rule, ids, n, points, elements, known) -> list[tuple[int, int]]:
    """Links that connect everything connected among the given documents; ``known`` are their classes so far.

    The summed minima of all pairs come first. Where few pairs of different classes survive, their sets are compared one by one, most similar
    first, until they are connected; where many do (large groups of near copies), all overlaps are computed at once."""
    root, out = np.array(known), []
    total = n[:, None] + n[None, :]
    need = rule.need(total)
    bound = np.stack([np.minimum(points, p).sum(1) for p in points])
    open_pairs = np.tril((bound >= need) & (root[:, None] != root[None, :]), -1)
    left, right = np.nonzero(open_pairs)

    def connect(i, j):
        out.append((int(ids[j]), int(ids[i])))
        root[root == root[j]] = root[i]

    if len(left) > 4 * len(ids) and int(n.sum()) <= 4_000_000:
        shared = overlaps(elements)
        linked = open_pairs & (rule.den * shared >= rule.num * (total - shared))
        for i in range(1, len(ids)):
            for j in np.flatnonzero(linked[i]).tolist():
                if root[i] != root[j]:
                    connect(i, j)
        return out
    for k in np.argsort(-(bound[left, right] / total[left, right]), kind="stable").tolist():
        i, j = int(left[k]), int(right[k])
        if root[i] != root[j]:
            shared = overlap(np.frombuffer(elements[i], np.uint64), np.frombuffer(elements[j], np.uint64))
            if rule.den * shared >= rule.num * (int(total[i, j]) - shared):
                connect(i, j)
    return out


def _join_pages(rule: Rule):
    """Links within a page, and its most central document as a loop."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return_memory()
        frame = frame.drop_duplicates("id").sort_values("id")
        ids, n = frame["id"].to_numpy(), frame["n"].to_numpy()
        points = np.stack([np.frombuffer(p, "<i4") for p in frame["point"]])
        found = links_within(rule, ids, n, points, frame["elements"].tolist(), ids)
        central = max(range(len(ids)), key=lambda i: (np.minimum(points, points[i]).sum(1) / (n + n[i])).sum())
        return pd.DataFrame([*found, (int(ids[central]),) * 2], columns=["a", "b"], dtype="int64")
    return run


def _deltas(rule: Rule):
    """What each document has apart from its block's pivot, and whether it links with it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            deltas, linked = [], []
            for own, other in zip(batch.column("elements").to_pylist(), batch.column("pivot_elements").to_pylist()):
                x, y = np.frombuffer(own, np.uint64), np.frombuffer(other, np.uint64)
                apart = np.setxor1d(x, y, assume_unique=True)
                deltas.append(apart.tobytes())
                shared = (len(x) + len(y) - len(apart)) // 2
                linked.append(rule.den * shared >= rule.num * (len(x) + len(y) - shared))
            yield pa.record_batch([*(batch.column(c) for c in ("block", "id", "n", "point", "pivot")),
                                   pa.array(deltas, pa.binary()), pa.array(linked)],
                                  names=["block", "id", "n", "point", "pivot", "delta", "linked"])
    return run


def _join_deltas(rule: Rule):
    """Links between loose documents and all others of two pages. Two sets differ where their deltas differ."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return_memory()
        loose, other = (frame[frame["loose"] == side].drop_duplicates("id").sort_values("id") for side in (True, False))
        out = []
        if len(loose) and len(other):
            n = [f["n"].to_numpy() for f in (loose, other)]
            kind = np.int32 if rule.den * (int(n[0].max()) + int(n[1].max())) < 1 << 31 else np.int64
            n = [x.astype(kind) for x in n]
            size = [np.array([len(d) // 8 for d in f["delta"]], kind) for f in (loose, other)]
            shared = ((n[0] - size[0])[:, None] + (n[1] - size[1])[None, :]) // 2  # two sets differ where their deltas do
            shared += overlaps(loose["delta"].tolist(), other["delta"].tolist(), kind=kind)
            linked = rule.den * shared >= rule.num * (n[0][:, None] + n[1][None, :] - shared)
            a, b = loose["known"].to_numpy(), other["known"].to_numpy()
            linked &= a[:, None] != b[None, :]
            seen = set()
            for i, j in zip(*np.nonzero(linked)):
                if (pair := (a[i], b[j])) not in seen:  # one link ties two classes
                    seen.add(pair)
                    out.append((int(loose["id"].iat[i]), int(other["id"].iat[j])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")
    return run


def _box_rule(rule: Rule) -> str:
    """Whether two pages can hold a link: summed minima of upper corners against the overlap that their smallest documents need."""
    summed = "aggregate(zip_with(p.upper, q.upper, (x, y) -> least(x, y)), 0L, (s, x) -> s + x)"
    return f"{summed} * {rule.num + rule.den} >= {rule.num} * (p.least + q.least)"


def _beside(ids: DataFrame) -> DataFrame:
    """A table of a few numbers a row, to be joined with whole sets: sent to all tasks as long as it is small, so that sets are not
    shuffled for it. Beyond that the planner shuffles both."""
    return F.broadcast(ids) if ids.limit(BESIDE_ROWS + 1).count() <= BESIDE_ROWS else ids


def links(docs: DataFrame, rule: Rule, blocks: DataFrame, page_rows: int = PAGE_ROWS, wide_rows: int = WIDE_ROWS) -> DataFrame:
    """(a, b): true links that connect all that links connect, and loops. ``docs`` (id, text) are class representatives of ``blocks`` (id, block)."""
    members = docs.join(blocks.select("id"), "id", "left_semi")
    rows = settle(members.mapInArrow(_points(rule, True), POINTS + ", elements binary"), "ngram_sets")
    pages, placed = _paged(rows.select("id", "n", "point").join(blocks, "id"), page_rows, "ngram_pages")
    pages = settle(pages.select("block", "page", "id"), "ngram_page_ids")
    own = _beside(pages.select("page", "id")).join(rows.select("id", "n", "point", "elements"), "id")
    found = settle(own.groupBy("page").applyInPandas(_join_pages(rule), "a long, b long"), "ngram_links")
    sizes = pages.groupBy("block").agg(F.countDistinct("page").alias("pages")).filter("pages > 1")
    wide = settle(pages.join(sizes.select("block"), "block", "left_semi").select("block", "page", "id"), "ngram_wide")
    drop(placed)
    free_shuffles(docs.sparkSession)
    if not wide.limit(1).count():
        drop(rows)
        return found

    central = found.filter("a = b").select(F.col("a").alias("id")).join(wide, "id")
    pivots = central.groupBy("block").agg(F.min_by("id", F.struct("page", "id")).alias("pivot"))
    pivots = settle(_beside(pivots).join(rows.select(F.col("id").alias("pivot"), F.col("elements").alias("pivot_elements")), "pivot"), "ngram_pivots")
    weight = pivots.agg(F.sum(F.octet_length("pivot_elements"))).first()[0] or 0
    apart = _beside(wide.select("block", "id")).join(rows.select("id", "n", "point", "elements"), "id").join(
        F.broadcast(pivots) if weight <= BESIDE_BYTES else pivots, "block")
    apart = settle(apart.mapInArrow(_deltas(rule), "block long, id long, n long, point binary, pivot long, delta binary, linked boolean"),
                   "ngram_deltas")
    drop(rows)
    free_shuffles(docs.sparkSession)
    found = found.unionAll(settle(apart.filter("linked").select("pivot", "id"), "ngram_pivot_links"))

    labels = components(found, "ngram_so_far").withColumnRenamed("node", "id")
    state = settle(apart.drop("linked", "pivot", "delta").join(labels, "id", "left").withColumn("known", F.coalesce("component", "id")).drop(
        "component"), "ngram_state")
    largest = state.groupBy("block", "known").agg(F.count("*").alias("c")).groupBy("block").agg(
        F.max_by("known", F.struct("c", "known")).alias("largest"))
    loose = settle(state.join(largest, "block").filter("known <> largest").drop("largest"), "ngram_loose")
    if not loose.limit(1).count():
        drop(state, apart)
        return found
    lone = _paged(loose, wide_rows, "ngram_loose_pages")[0]
    every = _paged(state.join(loose.select("block").distinct(), "block", "left_semi"), wide_rows, "ngram_all_pages")[0]
    pairs = settle(_boxes(lone).alias("p").join(_boxes(every).alias("q"), "block").filter(F.expr(_box_rule(rule))).select(
        F.col("p.page").alias("p"), F.col("q.page").alias("q"), F.xxhash64("p.page", "q.page").alias("unit")), "ngram_pairs")
    units = pairs.join(lone.select(F.col("page").alias("p"), "id"), "p").select("unit", "id", F.lit(True).alias("loose")).unionAll(
        pairs.join(every.select(F.col("page").alias("q"), "id"), "q").select("unit", "id", F.lit(False)))
    units = settle(units.join(state.select("id", "known"), "id"), "ngram_units")
    free_shuffles(docs.sparkSession)
    more = _beside(units).join(apart.select("id", "n", "delta"), "id").groupBy("unit").applyInPandas(_join_deltas(rule), "a long, b long")
    more = settle(more, "ngram_loose_links")
    drop(state, loose, apart)
    return found.unionAll(more)


# --- the operator -----------------------------------------------------------------------

def join_classes(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text",
                 page_rows: int = PAGE_ROWS, wide_rows: int = WIDE_ROWS) -> DataFrame:
    """Per row of ``docs``: id, n_shingles, set_id (smallest document with an equal set), component_id.

    Words are runs of characters that are not ASCII white space, with A-Z lower-cased. A document with fewer words than ``rule.k`` has its whole sequence
    as its only run. Without words (or with null text) the set is empty, links with nothing, and the document is a component of its own.
    Rows that share an id are tied: each has the id's component, also where their texts differ. A null id takes no part and has a null
    component. Other columns are not read. No rows give no rows.
    """
    spark = docs.sparkSession
    lean(spark)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    stored = settle(base.mapInArrow(_points(rule, False), POINTS), "ngram_points")
    points = stored.select("id", "n", "k1", "k2")
    sides = points.filter("id IS NOT NULL").groupBy("id").agg(F.min(F.struct("k1", "k2")).alias("a"), F.max(F.struct("k1", "k2")).alias("b"))
    if sides.filter("a <> b").limit(1).count():
        drop(stored)
        return _join_texts(base, rule, page_rows, wide_rows).withColumnRenamed("id", id_col)
    equal = points.filter("n > 0 AND id IS NOT NULL").groupBy("k1", "k2").agg(F.min("id").alias("set_id"))
    sets = settle(points.join(equal, ["k1", "k2"], "left").select("id", "n", F.coalesce("set_id", "id").alias("set_id")), "ngram_classes")

    buckets = 4 * partitions(spark)
    cells = base.mapInArrow(_cells(rule, buckets), "bucket int, keys binary, ids binary")
    ties = cells.repartition(partitions(spark), F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(F.xxhash64("ids"))) \
        .mapInArrow(_ties, "kind int, a long, b long")
    ties = ties_stored = settle(ties.distinct(), "ngram_ties")
    near = ties.filter(F.col("kind") == PAIR).join(stored.select(F.col("id").alias("a"), "n", F.col("point").alias("p")), "a") \
        .join(stored.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("point").alias("q")), "b") \
        .mapInArrow(_near(rule), "a long, b long")
    members = ties.filter(F.col("kind") == MEMBER).select(F.col("a").alias("cell"), F.col("b").alias("id"))
    crowd = members.groupBy("cell").agg(F.count("*").alias("crowd"))
    budgets = stored.filter("n > 0 AND id IS NOT NULL").select("id", "even", "odd").distinct()
    odd = F.col("cell").bitwiseAND(1)
    most_crowded = W.partitionBy("id", odd).orderBy(F.desc("crowd"), "cell")
    members = members.join(crowd, "cell").withColumn("place", F.row_number().over(most_crowded)).join(budgets, "id").filter(
        F.col("place") > F.when(odd == 1, F.col("odd")).otherwise(F.col("even"))).select("cell", "id")
    members = settle(members, "ngram_large")
    left = members.groupBy("cell").agg(F.count("*").alias("left"), F.min("id").alias("a"))
    members = members.join(left.filter("left > 1"), "cell")
    some = members.filter(F.col("left") <= CROWD).select("cell", "id").join(
        stored.filter("id IS NOT NULL").select("id", "n", "point").distinct(), "id")
    crowds = some.repartition(partitions(spark), "cell").sortWithinPartitions("cell", "id").select("cell", "id", "n", "point").mapInArrow(
        _crowds(rule), "a long, b long")
    large = members.filter(F.col("left") > CROWD).select("a", F.col("id").alias("b"))
    ties = ties.filter(F.col("kind") == TWINS).select("a", "b").unionAll(near).unionAll(crowds).unionAll(large)
    twins = sets.filter("id <> set_id").select(F.col("id"), F.col("set_id"))
    tied = components(ties.unionAll(twins.select(F.col("set_id").alias("a"), F.col("id").alias("b"))), "ngram_blocks")
    first = tied.join(sets.filter("id = set_id").select(F.col("id").alias("node")).distinct(), "node", "left_semi")
    counted = first.groupBy("component").agg(F.count("*").alias("c")).filter("c > 1")
    blocks = settle(first.join(counted.select("component"), "component", "left_semi").select(
        F.col("node").alias("id"), F.col("component").alias("block")), "ngram_members")
    drop(stored, ties_stored, members)
    free_shuffles(spark)
    if blocks.limit(1).count():
        found = links(base.filter("id IS NOT NULL"), rule, blocks, page_rows, wide_rows)
        reach = components(found.unionAll(twins.select(F.col("set_id").alias("a"), F.col("id").alias("b"))), "ngram_reach")
    else:
        reach = components(twins.select(F.col("set_id").alias("a"), F.col("id").alias("b")), "ngram_reach")
    return sets.join(reach.withColumnRenamed("node", "id"), "id", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "set_id", F.coalesce("component", "id").alias("component_id"))


def _join_texts(base: DataFrame, rule: Rule, page_rows: int, wide_rows: int) -> DataFrame:
    """The same where some id has several texts: texts of an id are nodes of their own (by hash) in the join, and are tied after it."""
    coded = base.select("id", "text", F.when(F.col("id").isNotNull(), F.xxhash64("id", "text", F.col("text").isNull())).alias("node"))
    nodes = settle(coded.filter("node IS NOT NULL").select("id", "node").distinct(), "ngram_nodes")
    found = settle(join_classes(coded.select("node", "text"), rule, "node", "text", page_rows, wide_rows), "ngram_texts")
    labelled = nodes.join(found.select("node", "set_id", "component_id").distinct(), "node")
    tied = labelled.groupBy("id").agg(F.min("component_id").alias("least")).join(labelled.select("id", "component_id"), "id")
    reach = components(tied.select(F.col("least").alias("a"), F.col("component_id").alias("b")), "ngram_tied").select(
        F.col("node").alias("component_id"), F.col("component").alias("joined"))
    named = labelled.join(reach, "component_id", "left").withColumn("joined", F.coalesce("joined", "component_id"))
    named = settle(named.select("id", "node", "set_id", "joined"), "ngram_named")
    first = named.groupBy("joined").agg(F.min("id").alias("component_id"))
    equal = named.groupBy("set_id").agg(F.min("id").alias("equal_id"))
    names = named.join(first, "joined").join(equal, "set_id").select("node", "id", F.col("equal_id").alias("set_id"), "component_id")
    return found.select("node", "n_shingles").join(names, "node", "left").select("id", "n_shingles", "set_id", "component_id")


def without_near_copies(docs: DataFrame, rule: Rule = Rule(5, 80, 100), id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id; rows with null ids stay."""
    classes = join_classes(docs, rule, id_col).select(F.col(id_col).alias("__id"), "component_id")
    gone = settle(classes.filter("__id <> component_id").select("__id").distinct(), "ngram_gone")
    return docs.join(gone, F.col(id_col) == F.col("__id"), "left_anti")
