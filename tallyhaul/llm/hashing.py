"""Words and word runs of whole Arrow batches as 64-bit hashes, by numpy on the UTF-8 bytes.

Nothing here looks at single words in Python. A word's hash is a polynomial in
its bytes modulo 2**64, taken from running sums, and then mixed; equal words
have equal hashes wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of ``[^\x20\x09-\x0D]+``.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[9, 10, 11, 12, 13, 32]] = False

#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, n of each."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, BLOCK + 1)
        for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
            with np.errstate(over="ignore"):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                _POWERS[name] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


@dataclass
class Words:
    """All words of a batch. Document i has words first[i] to first[i + 1]."""

    data: np.ndarray  # bytes of all texts, lower-cased if asked for
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def text(self, i: int, j: int) -> bytes:
        """Words i to j, one space between."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[i:j], self.ends[i:j]))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    data = data[offsets[0]: offsets[-1]] if len(texts) else data[:0]
    return data, (offsets - offsets[0] if len(texts) else np.zeros(1, np.int64))


def words(texts: pa.Array, word_bytes: np.ndarray, lower: bool = True) -> Words:
    """``word_bytes`` tells for each (lower-cased) byte whether it belongs to a word."""
    raw, offsets = utf8(texts)
    data = LOWER[raw] if lower else raw
    n = len(data)
    inside = word_bytes[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    opens[edge] = inside[edge]
    closes[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            low = starts[at]
            to = max(at + 1, int(np.searchsorted(ends, low + BLOCK, "right")))
            piece = data[low: ends[to - 1]]
            up, down = _powers(len(piece) + 1)
            sums = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[: len(piece)], out=sums[1:])
            s, e = starts[at:to] - low, ends[at:to] - low
            hashes[at:to] = mix((sums[e] - sums[s]) * down[s])
            at = to
    return Words(data, starts, ends, hashes, np.searchsorted(starts, offsets))


def chain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a run of words followed by one more word."""
    with np.errstate(over="ignore"):
        return mix(left * np.uint64(0xD6E8FEB86659FD93) + right)


def runs(hashes: np.ndarray, k: int) -> list[np.ndarray]:
    """Item j - 1 has the hashes of all runs of j words, for j from 1 to k."""
    out = [hashes]
    for j in range(1, k):
        out.append(chain(out[-1][:-1], hashes[j:]) if len(hashes) > j else np.zeros(0, np.uint64))
    return out


def shingle_sets(found: Words, k: int) -> Iterator[np.ndarray]:
    """Per document its distinct runs of k words, sorted; with fewer words the whole sequence as one."""
    by_length = runs(found.hashes, k)
    for a, b in zip(found.first[:-1], found.first[1:]):
        if b - a >= k:
            yield np.unique(by_length[-1][a: b - k + 1])
        elif b > a:
            yield by_length[b - a - 1][a: a + 1]
        else:
            yield np.zeros(0, np.uint64)
