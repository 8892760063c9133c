"""Periodic runs of words by internal pattern matching.

A run is a stretch of at least max(12, 2 * q) words with smallest period q that cannot be made longer. All texts of a slice of an Arrow
batch are worked on at once, laid end to end, with arrays:

1. Suffix array by prefix doubling. The doubling gives, per power of two, names: equal for equal stretches of so many words of a text.
2. Wavelet matrix over the suffix array. A stretch is a range of the suffix array, and the next occurrence of the stretch at or after a
   place is that range's successor of the place.
3. Dyadic blocks. A run of period q holds, in its first q words, a block that begins at a multiple of a power of two, and a copy
   of it q words on. So each block asks for its occurrences in the neighbouring window. Occurrences closer than half a block form an arithmetic
   progression, which is stepped over at once: it can only give its own period, the periods that align the ends of both periodic
   stretches, or, where these touch, each of its members.
4. Each candidate period is extended to both sides by the names; what is long enough is a run, and of periods of
   one stretch the smallest is its period.

Nothing is shuffled: rows are independent, and a slice has a bounded number of words unless one text has more.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .alignment import spread
from .common import small_batches
from .hashing import NOT_BLANK, Words, words

LEAST, SLICE_WORDS = 12, 1 << 17


# --- suffix array, names, wavelet matrix ------------------------------------------------

class Names:
    """Suffix array of sequences laid end to end, and names of their stretches. ``level[k][i]`` names the 2**k symbols from i on (within a
    sequence; a shorter rest has a name of its own): it is the first place of its range in the suffix array."""

    def __init__(self, symbols: np.ndarray, first: np.ndarray):
        n = len(symbols)
        self.n, self.first = n, first
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.end = first[1:][owner]
        self.begin = first[:-1][owner]
        _, code = np.unique(symbols, return_inverse=True)
        key = owner * (int(code.max(initial=0)) + 1) + code  # sequences never compare equal
        order = np.argsort(key, kind="stable")
        name = np.empty(n, np.int64)
        name[order] = _starts(key[order])
        self.level, size = [name.astype(np.int32)], 1
        again = _repeated(order, name)
        while len(again):  # places in suffix order whose name another place has
            follow = again + size
            inside = follow < self.end[again]
            second = np.where(inside, name[np.minimum(follow, n - 1)] + 1, 0)
            key = name[again] * (n + 1) + second
            by = np.argsort(key, kind="stable")
            again, key = again[by], key[by]
            group = name[again]
            rank = np.arange(len(again)) - _starts(group)  # place within the range of the old name
            name = name.copy()
            name[again] = group + rank[_starts(key)]  # the range of the new name begins there
            self.level.append(name.astype(np.int32))
            again = _repeated(again, name)
            size *= 2
        self.suffixes = np.empty(n, np.int64)
        self.suffixes[name] = np.arange(n)
        self._sizes: dict[int, np.ndarray] = {}

    def count(self, k: int) -> np.ndarray:
        """How many places have each name of level k."""
        if k not in self._sizes:
            self._sizes[k] = np.bincount(self.level[k], minlength=self.n)
        return self._sizes[k]

    def same_after(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols are equal from i and from j on, within one sequence; i < j."""
        i, j = i.copy(), j.copy()
        out, end = np.zeros(len(i), np.int64), self.end[j] if len(j) else j
        for k in range(len(self.level) - 1, -1, -1):
            step = 1 << k
            some = np.flatnonzero(j + step <= end)
            some = some[self.level[k][i[some]] == self.level[k][j[some]]]
            out[some] += step
            i[some] += step
            j[some] += step
        return out

    def same_before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols are equal before i and before j."""
        i, j = i.copy(), j.copy()
        out, begin = np.zeros(len(i), np.int64), self.begin[i] if len(i) else i
        for k in range(len(self.level) - 1, -1, -1):
            step = 1 << k
            some = np.flatnonzero(i - step >= begin)
            some = some[self.level[k][i[some] - step] == self.level[k][j[some] - step]]
            out[some] += step
            i[some] -= step
            j[some] -= step
        return out


def _starts(sorted_: np.ndarray) -> np.ndarray:
    """For each place of a sorted array the first place with its value."""
    new = np.ones(len(sorted_), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(sorted_)), 0))


def _repeated(order: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Of places in suffix order those whose name is not theirs alone."""
    own = name[order]
    same = np.zeros(len(own), bool)
    same[1:] = own[1:] == own[:-1]
    same[:-1] |= same[1:]
    return order[same]


class Wavelet:
    """Wavelet matrix over numbers below 2**width: successor of a value within a range of places."""

    def __init__(self, values: np.ndarray):
        self.width = max(1, int(values.max(initial=0)).bit_length())
        self.ranks, self.zeros = [], []
        current = values
        for b in range(self.width - 1, -1, -1):
            bit = (current >> b) & 1
            ones = np.zeros(len(bit) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ranks.append(ones)
            self.zeros.append(len(bit) - int(ones[-1]))
            up = bit.astype(bool)
            current = np.concatenate([current[~up], current[up]])

    def smaller(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values at places low to high are below x."""
        low, high, out = low.copy(), high.copy(), np.zeros(len(low), np.int64)
        for level, (ones, zeros) in enumerate(zip(self.ranks, self.zeros)):
            a, b = ones[low], ones[high]
            up = (x >> (self.width - 1 - level)) & 1 == 1
            out += np.where(up, (high - b) - (low - a), 0)
            low, high = np.where(up, zeros + a, low - a), np.where(up, zeros + b, high - b)
        return np.where(x >> self.width > 0, out + high - low, out)

    def nth(self, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The value with n smaller ones at places low to high."""
        low, high, n, out = low.copy(), high.copy(), n.copy(), np.zeros(len(low), np.int64)
        for level, (ones, zeros) in enumerate(zip(self.ranks, self.zeros)):
            a, b = ones[low], ones[high]
            below = (high - b) - (low - a)
            up = n >= below
            n = np.where(up, n - below, n)
            out += np.where(up, 1 << (self.width - 1 - level), 0)
            low, high = np.where(up, zeros + a, low - a), np.where(up, zeros + b, high - b)
        return out

    def successor(self, low: np.ndarray, high: np.ndarray, x: np.ndarray, none: int) -> np.ndarray:
        """The least value that is x or more at places low to high; ``none`` where there is none."""
        out = np.full(len(low), none, np.int64)
        before = np.where(x >> self.width > 0, high - low, self.smaller(low, high, np.minimum(x, (1 << self.width) - 1)))
        some = np.flatnonzero(before < high - low)
        out[some] = self.nth(low[some], high[some], before[some])
        return out


# --- runs -------------------------------------------------------------------------------

def _levels(longest: int) -> list[tuple[int, int, int, int]]:
    """(level of a block, its step, least and greatest period): a run of such a period (of ``LEAST`` words at least) holds, before its last
    q words, a block of 2**level words that begins at a multiple of the step."""
    out, step, level, q = [], 4, 1, 1
    top = LEAST - (step + (1 << level) - 1)  # of short periods the whole rest of the run counts: LEAST - q words
    out.append((level, step, 1, top))
    q, level = top + 1, 2
    while q <= longest // 2:
        out.append((level, 1 << level, q, (4 << level) - 2))
        q, level = (4 << level) - 1, level + 1
    return out


def runs(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of all sequences, by start, then period. Places are those of the sequences laid end to end."""
    empty = (np.zeros(0, np.int64),) * 3
    longest = int(np.diff(first).max(initial=0))
    if longest < LEAST:
        return empty
    names = Names(symbols, first)
    if len(names.level) < 2:
        return empty
    kept = np.flatnonzero(names.count(1)[names.level[1][names.suffixes]] > 1)  # suffixes whose first two symbols recur
    wavelet, place = Wavelet(names.suffixes[kept]), np.r_[0, np.cumsum(np.bincount(kept, minlength=names.n))]
    found = [np.zeros((0, 3), np.int64)]
    for level, step, q_low, q_high in _levels(longest):
        if level >= len(names.level):
            break  # no stretch of this length recurs
        block = 1 << level
        sizes = np.diff(first) // step
        at = spread_steps(first[:-1], np.maximum(sizes + 1, 0), step)
        at = at[at < names.n]
        at = at[at + block <= names.end[at]]
        name = names.level[level][at]
        many = names.count(level)[name] > 1
        at, name = at[many], name[many].astype(np.int64)
        found.append(_of_blocks(names, wavelet, at, place[name], place[name + names.count(level)[name]], block, q_low, q_high))
    all_ = np.concatenate(found)
    if not len(all_):
        return empty
    order = np.lexsort((all_[:, 2], all_[:, 1], all_[:, 0]))
    all_ = all_[order]
    new = np.ones(len(all_), bool)
    new[1:] = (all_[1:, :2] != all_[:-1, :2]).any(1)  # a stretch with several periods has the smallest
    all_ = all_[new]
    all_ = all_[np.lexsort((all_[:, 2], all_[:, 0]))]
    return all_[:, 0], all_[:, 1], all_[:, 2]


def spread_steps(start: np.ndarray, n: np.ndarray, step: int) -> np.ndarray:
    """start[0], start[0] + step, ... (n[0] of them), start[1], ..."""
    return np.repeat(start, n) + step * spread(np.zeros(len(n), np.int64), n)


def _of_blocks(names: Names, wavelet: Wavelet, at, low, high, block: int, q_low: int, q_high: int) -> np.ndarray:
    """Runs (start, end, period) that the occurrences of blocks in their windows give."""
    found = [np.zeros((0, 3), np.int64)]
    if not len(at):
        return found[0]
    last = np.minimum(at + q_high, names.end[at] - block)
    ask = at + q_low
    while True:
        some = ask <= last
        at, low, high, last, ask = at[some], low[some], high[some], last[some], ask[some]
        if not len(at):
            break
        one = wavelet.successor(low, high, ask, names.n)
        some = one <= last
        at, low, high, last, one = at[some], low[some], high[some], last[some], one[some]
        if not len(at):
            break
        two = wavelet.successor(low, high, one + 1, names.n)
        gap = two - one
        series = (two <= last) & (2 * gap <= block)
        found.append(_extended(names, at[~series], one[~series] - at[~series]))
        ask = np.where(series, one, two)
        s = np.flatnonzero(series)
        if len(s):
            b, f, d = at[s], one[s], gap[s]
            x, y = b - names.same_before(b, b + d), b + d + names.same_after(b, b + d)  # both stretches of period d
            u, v = f - names.same_before(f, f + d), f + d + names.same_after(f, f + d)
            n = (np.minimum(v - block, last[s]) - f) // d + 1  # members of the progression in the window
            ask[s] = f + n * d - d + 1
            apart = u != x
            found.append(_extended(names, b[~apart], d[~apart]))  # one stretch: its own period
            for q in (u - x, v - y):
                ok = apart & (q > 0) & (b + q <= last[s])
                found.append(_extended(names, b[ok], q[ok]))
            touch = apart & (y >= u)
            if touch.any():
                reach = np.minimum(np.minimum(u - x, v - y), f + (n - 1) * d - b)[touch]
                count = np.clip((reach - (f - b)[touch]) // d[touch] + 1, 0, None)
                q = np.repeat((f - b)[touch], count) + np.repeat(d[touch], count) * spread(np.zeros(len(count), np.int64), count)
                found.append(_extended(names, np.repeat(b[touch], count), q))
    return np.unique(np.concatenate(found), axis=0)


def _extended(names: Names, at: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Stretches of period q around ``at`` that are long enough."""
    after = names.same_after(at, at + q)
    may = after > 0
    at, q, after = at[may], q[may], after[may]
    before = names.same_before(at, at + q)
    start, end = at - before, at + q + after
    long = end - start >= np.maximum(LEAST, 2 * q)
    return np.stack([start[long], end[long], q[long]], 1)


# --- documents ----------------------------------------------------------------------------

def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p) where words from a on repeat with period p, for a tenth of all ids; a null id has none."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _slices(first: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Documents i to j with at most ``most`` words together, unless one has more."""
    i = 0
    while i < len(first) - 1:
        j = max(i + 1, int(np.searchsorted(first, first[i] + most, "right")) - 1)
        yield i, j
        i = j


def _joined(found: Words, which: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Words ``which``, one space between, cut into texts at ``ends`` (numbers of words)."""
    size = found.ends[which] - found.starts[which] + 1
    data = found.data[np.minimum(spread(found.starts[which], size), max(len(found.data) - 1, 0))] if len(which) else np.zeros(0, np.uint8)
    stop = np.cumsum(size)
    data[stop - 1] = 32
    flat, at = data.tobytes(), np.r_[0, stop][np.r_[0, ends]].tolist()
    return [flat[x: max(x, y - 1)] for x, y in zip(at[:-1], at[1:])]


REPORT = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, "
          "runs array<struct<start long, length long, period long>>, collapsed string")


def _detect(texts_too: bool, plant: bool):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = batch.column(0).to_pylist(), words(batch.column(1), NOT_BLANK, lower=False)
            for i, j in _slices(found.first, SLICE_WORDS):
                base, stop = found.first[i], found.first[j]
                first = found.first[i: j + 1] - base
                source = np.arange(base, stop)
                if plant:
                    for d in range(i, j):
                        n = int(found.first[d + 1] - found.first[d])
                        if ap := planted(ids[d], n):
                            a, p = ap
                            own = source[first[d - i] + a: first[d - i] + n]
                            own[:] = found.first[d] + a + np.arange(n - a) % p
                start, end, period = runs(found.hashes[source], first)
                drop = np.zeros(len(source) + 1, np.int64)
                np.add.at(drop, start + period, 1)
                np.add.at(drop, end, -1)
                keep = np.cumsum(drop[:-1]) == 0
                kept = _joined(found, source[keep], np.r_[0, np.cumsum(keep)][first[1:]])
                doc = np.searchsorted(first, start, "right") - 1
                cut = np.searchsorted(doc, np.arange(j - i + 1))
                rows = []
                for d in range(j - i):
                    own = slice(cut[d], cut[d + 1])
                    s, q, n = (start[own] - first[d]).tolist(), period[own].tolist(), (end[own] - start[own]).tolist()
                    best = min(zip(s, n, q), key=lambda r: (-r[1], r[0], r[2])) if s else None
                    text = "".join(f"{x},{y},{z}\n" for x, y, z in zip(s, n, q))
                    row = [ids[i + d], len(s), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                           hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(kept[d]).hexdigest()]
                    if texts_too:
                        row += [[{"start": x, "length": y, "period": z} for x, y, z in zip(s, n, q)], kept[d].decode()]
                    rows.append(row)
                kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [kind, pa.string()] * texts_too
                names = [c.split()[0] for c in REPORT.split(", ")[: 8]] + ["runs", "collapsed"] * texts_too
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
    return run


def detected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False) -> DataFrame:
    """Per row: id, n_runs, start, length, period and exponent_milli of the longest run (ties: smallest start, then period; nulls without
    runs), runs_sha256, collapsed_sha256, and the runs and the collapsed text themselves.

    Words are ``[^\\x20\\x09-\\x0D]+``, compared by 64-bit hashes of their bytes. The collapsed text is all words, one space between, without those that any run
    holds after its first period. Null, empty and blank texts have no words and no runs. Rows that repeat, and rows with null ids, each count.
    Other columns are not read. ``plant`` makes the words of a tenth of all ids periodic first, see ``planted``. No rows give no rows.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return base.mapInArrow(_detect(True, plant), REPORT).withColumnRenamed("doc_id", id_col)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = True) -> DataFrame:
    """As ``detected``, without runs and texts."""
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return base.mapInArrow(_detect(False, plant), ", ".join(REPORT.split(", ")[:8])).withColumnRenamed("doc_id", id_col)
