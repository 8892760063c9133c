"""Alignment of two tokenizers' tokens of the same texts, by divide and conquer at shared cuts.

Byte offsets at which tokens of both tokenizers end cut a text into groups. All texts of a batch are laid end to end and the
intervals of one depth are divided together: each looks for a common end near its middle (the other tokenizer's ends are searched by
bisection, in rings of doubling width around the middle), is cut there, and both halves are divided again. An interval without
a common end inside is a group.

How often two ids overlap in the whole corpus decides which links are best. Tasks write their documents in packs of bounded text: links as
indexes into the pack's own pairs of ids. Only the distinct pairs of a pack are shuffled, by pair, added up and sent back to
their pack. The most linked pair of each id is found in a table that the second vocabulary bounds.

Tokenizing. Where both vocabularies allow it (which is tested), a text is cut before spaces behind other characters, where no
token of either can reach across, and each distinct piece is encoded once. Otherwise texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import lean, settle
from .token_files import byte_letters

PACK_BYTES, SLICE_BYTES = 2 << 20, 1 << 19
HELD_PIECES, HELD_TOKENS = 400_000, 3_000_000


# --- tokenizers -----------------------------------------------------------------

class Numbered(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Codec:
    """Both tokenizers, the bytes of their tokens, and the pieces encoded so far (a bounded number)."""

    CUT = re.compile(r"(?<=\S)(?= )")
    PROBE = " Straße,  one's\n\n  two 12 x\t y-z ... Ünï "

    def __init__(self, a_json: str, b_model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(a_json), sentencepiece.SentencePieceProcessor(model_proto=b_model)
        self.a.encode_special_tokens = True
        letters = {c: i for i, c in byte_letters().items()}
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(map(letters.__getitem__, t)) if all(c in letters for c in t) else t.encode() for t in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_len = np.array([len(x) for x in self.a_bytes])
        self.b_len = np.array([len(x) for x in self.b_bytes])
        self.space = self.b.piece_to_id("▁")
        pre = json.loads(a_json)
        own = pre.get("pre_tokenizer") or {}
        self.apart = pre.get("normalizer") is None and own.get("type") == "ByteLevel" and own.get("use_regex", True) \
            and not own.get("add_prefix_space") and all("▁" not in p.lstrip("▁") for p in pieces)
        self.forget()
        if self.apart:
            cut = self.CUT.split(" " + self.PROBE)
            a, b = self._encode(cut)
            whole = self._encode([" " + self.PROBE])
            self.apart = (sum(a, []), sum(b, [])) == (whole[0][0], whole[1][0])

    def forget(self) -> None:
        self.codes = Numbered()
        self.good = np.zeros(0, bool)
        self.ids, self.first = [np.zeros(0, np.int64)] * 2, [np.zeros(1, np.int64)] * 2

    def _encode(self, pieces: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Pieces begin with the space that stands before each text."""
        a = [e.ids for e in self.a.encode_batch_fast(pieces, add_special_tokens=False)]
        b = self.b.encode([p[1:] for p in pieces], num_threads=1)
        return a, [[self.space] if p == " " else x for p, x in zip(pieces, b)]

    def _learn(self, pieces: list[str]) -> None:
        encoded = self._encode(pieces)
        for side in (0, 1):
            sizes = np.fromiter(map(len, encoded[side]), np.int64, len(pieces))
            flat = np.fromiter(chain.from_iterable(encoded[side]), np.int64, int(sizes.sum()))
            self.first[side] = np.r_[self.first[side], self.first[side][-1] + np.cumsum(sizes)]
            self.ids[side] = np.r_[self.ids[side], flat]
        raw = [p.encode() for p in pieces]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        good = np.ones(len(pieces), bool)
        for tokens, own, length in zip(encoded, (self.a_bytes, self.b_bytes), (self.a_len, self.b_len)):
            n = np.fromiter(map(len, tokens), np.int64, len(tokens))
            ends = np.r_[0, np.cumsum(length[np.fromiter(chain.from_iterable(tokens), np.int64, int(n.sum()))])][np.cumsum(n)]
            if (np.diff(ends, prepend=0) != size).any() or b"".join(map(own.__getitem__, chain.from_iterable(tokens))) != b"".join(raw):
                good &= [b"".join(map(own.__getitem__, x)) == r for x, r in zip(tokens, raw)]
        self.good = np.r_[self.good, good]

    def tokens(self, texts: list[str | None]) -> Tokens:
        if len(self.codes) > HELD_PIECES or len(self.ids[0]) > HELD_TOKENS:
            self.forget()
        known = len(self.codes)
        cut = [[] if not text else self.CUT.split(" " + text) if self.apart else [" " + text] for text in texts]
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        codes = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(cut)), np.int64, int(sizes.sum()))
        if len(self.codes) > known:
            self._learn(list(islice(self.codes, known, None)))
        doc = np.repeat(np.arange(len(cut)), sizes)
        good = np.ones(len(cut), bool)
        good[doc[~self.good[codes]]] = False  # a piece whose bytes are not the text's: the document has no tokens
        codes, doc = codes[good[doc]], doc[good[doc]]
        sides = []
        for side, length in ((0, self.a_len), (1, self.b_len)):
            n = np.diff(self.first[side])[codes]
            ids = self.ids[side][spread(self.first[side][codes], n)]
            first = np.r_[0, np.cumsum(np.bincount(doc, n, len(cut)).astype(np.int64))]
            sides.append((ids, np.cumsum(length[ids]), first))
        (a, a_end, a_first), (b, b_end, b_first) = sides
        return Tokens(a, b, a_end, b_end, a_first, b_first)


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (n[0] of them), start[1], ..."""
    before = np.cumsum(n) - n
    return np.arange(int(n.sum())) + np.repeat(start - before, n)


@dataclass
class Tokens:
    """Tokens of all texts of a batch, with the offsets at which they end in the texts laid end to end. Text i has tokens
    a_first[i] to a_first[i + 1] of a, and so for b."""

    a: np.ndarray
    b: np.ndarray
    a_end: np.ndarray
    b_end: np.ndarray
    a_first: np.ndarray
    b_first: np.ndarray


_READY: dict[int, Codec] = {}


def _codec(models) -> Codec:
    """One per worker process, kept between its tasks."""
    a_json, b_model = models.value
    key = zlib.crc32(a_json.encode(), zlib.crc32(b_model))
    if key not in _READY:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _READY.clear()
        _READY[key] = Codec(a_json, b_model)
    return _READY[key]


def _models(spark: SparkSession, a_path: str | None, b_path: str | None):
    """Both files, some MB, as a broadcast value; executors need not have them."""
    import public_tokenizers

    with open(a_path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as a, \
            open(b_path or public_tokenizers.path("piece_bpe_32k.model"), "rb") as b:
        return spark.sparkContext.broadcast((a.read(), b.read()))


# --- groups and links -------------------------------------------------------------

def groups(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Where groups end: token numbers (one past the last) of a and of b, ascending."""
    some = np.diff(t.a_first) > 0
    a_lo, a_hi, b_lo, b_hi = t.a_first[:-1][some], t.a_first[1:][some], t.b_first[:-1][some], t.b_first[1:][some]
    ends_a, ends_b = [], []
    while len(a_lo):
        cut_a, cut_b = _cuts(t.a_end, t.b_end, a_lo, a_hi, b_lo, b_hi)
        leaf = cut_a < 0
        ends_a.append(a_hi[leaf])
        ends_b.append(b_hi[leaf])
        s = ~leaf
        a_lo, a_hi = _halves(a_lo[s], cut_a[s], a_hi[s])
        b_lo, b_hi = _halves(b_lo[s], cut_b[s], b_hi[s])
    if not ends_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.sort(np.concatenate(ends_a)), np.sort(np.concatenate(ends_b))


def _halves(lo: np.ndarray, cut: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of each interval, in the order of the text: bisection is quicker for ascending keys."""
    return np.stack([lo, cut], 1).ravel(), np.stack([cut, hi], 1).ravel()


def _cuts(a_end, b_end, a_lo, a_hi, b_lo, b_hi) -> tuple[np.ndarray, np.ndarray]:
    """Per interval the common end nearest to the middle of its a tokens, as token numbers one past it; -1 where there is none inside."""
    cut_a, cut_b = np.full(len(a_lo), -1), np.full(len(a_lo), -1)
    middle = (a_lo + a_hi) // 2 - 1
    open_ = np.flatnonzero((a_hi - a_lo > 1) & (b_hi - b_lo > 1))
    at = a_end[middle[open_]]
    j = np.searchsorted(b_end, at)
    hit = b_end[j] == at
    cut_a[open_[hit]], cut_b[open_[hit]] = middle[open_[hit]] + 1, j[hit] + 1
    open_ = open_[~hit]
    near, far = 1, 2  # distances from the middle, near <= x < far
    while len(open_):
        m, low, high = middle[open_], a_lo[open_], a_hi[open_] - 1  # the last end is shared by all intervals and no cut
        right = np.clip(np.minimum(m + far, high) - (m + near), 0, None)
        left = np.clip((m - near) - np.maximum(m - far, low - 1), 0, None)
        who = np.r_[np.repeat(open_, right), np.repeat(open_, left)]
        at = np.r_[spread(m + near, right), np.repeat(2 * m, left) - spread(m + near, left)]
        j = np.searchsorted(b_end, a_end[at])
        hit = b_end[j] == a_end[at]
        who, at, j = who[hit], at[hit], j[hit]
        order = np.argsort(np.abs(at - middle[who]), kind="stable")[::-1]
        cut_a[who[order]], cut_b[who[order]] = at[order] + 1, j[order] + 1  # the nearest is written last
        more = (cut_a[open_] < 0) & ((m + far < high) | (m - far >= low))
        open_, near, far = open_[more], far, 2 * far
    return cut_a, cut_b


def links(t: Tokens, g_a: np.ndarray, g_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a token numbers, b token numbers, links of each group): tokens whose byte ranges overlap, group by group."""
    a0, b0 = np.r_[0, g_a[:-1]], np.r_[0, g_b[:-1]]
    n_a, n_b = g_a - a0, g_b - b0
    plain = (n_a == 1) | (n_b == 1)
    n = n_a + n_b - 1  # each end inside a group begins another overlap
    before = np.cumsum(n) - n
    inside = np.arange(int(n.sum())) - np.repeat(before, n)
    la = np.repeat(a0, n) + inside * np.repeat(n_a > 1, n)
    lb = np.repeat(b0, n) + inside * np.repeat(n_b > 1, n)
    if not plain.all():
        c = ~plain
        a, b = spread(a0[c], n_a[c]), spread(b0[c], n_b[c])
        ends = np.union1d(t.a_end[a], t.b_end[b])
        at = spread(before[c], n[c])
        la[at], lb[at] = a[np.searchsorted(t.a_end[a], ends)], b[np.searchsorted(t.b_end[b], ends)]
    return la, lb, n


_DECIMALS: dict[int, np.ndarray] = {}


def _decimals(bits: int) -> np.ndarray:
    """Row i has the decimal digits of i, then zeros, and at least one zero at its end."""
    if bits not in _DECIMALS:
        _DECIMALS[bits] = np.array([str(i).encode() for i in range(1 << bits)], f"S{len(str(1 << bits)) + 1}").view(np.uint8).reshape(1 << bits, -1)
    return _DECIMALS[bits]


def written(t: Tokens, g_a: np.ndarray, g_b: np.ndarray) -> list[bytes]:
    """Per text its groups as ``a1,a2|b1;a3|b2,b3``; empty without tokens."""
    n_docs = len(t.a_first) - 1
    if not len(t.a):
        return [b""] * n_docs
    n_a, n_b = np.diff(np.r_[0, g_a]), np.diff(np.r_[0, g_b])
    at_a = np.arange(len(t.a)) + np.repeat(np.r_[0, g_b[:-1]], n_a)
    at_b = np.arange(len(t.b)) + np.repeat(g_a, n_b)
    table = _decimals(int(max(t.a.max(), t.b.max())).bit_length())
    digits = table.shape[1] - 1
    out = np.empty((len(t.a) + len(t.b), digits + 1), np.uint8)
    out[at_a], out[at_b] = table[t.a], table[t.b]
    out[:, digits] = ord(",")
    out[at_a[g_a - 1], digits] = ord("|")
    out[at_b[g_b - 1], digits] = ord(";")
    last = (t.a_first + t.b_first)[1:]
    some = np.diff(t.a_first) > 0
    out[last[some] - 1, digits] = 0
    used = out != 0
    flat = out[used].tobytes()
    ends = np.r_[0, np.cumsum(used.sum(1))][np.r_[0, last]]
    return [flat[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _batches_of(batch: pa.RecordBatch) -> Iterator[tuple[list, list]]:
    """(ids, texts), of at most about ``SLICE_BYTES`` together unless one text is longer."""
    ids, texts, held = [], [], 0
    for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        if held + len(text or "") > SLICE_BYTES and texts:
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(i)
        texts.append(text)
        held += len(text or "")
    if texts:
        yield ids, texts


# --- packs ------------------------------------------------------------------------

PACK = ("pack long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
        "groups_sha256 array<string>, pairs binary, n binary, links binary")
PER_DOC = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")


HEAD = struct.Struct("<Q")


def _planes(a: np.ndarray) -> bytes:
    """Numbers below 2**32 as compressed byte planes: rows of packs stay short wherever they go."""
    raw = np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return HEAD.pack(raw.nbytes) + pa.compress(raw.tobytes(), "zstd", asbytes=True)


def _numbers(data: bytes) -> np.ndarray:
    raw = pa.decompress(data[HEAD.size:], HEAD.unpack_from(data)[0], "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _packed(models, pack_bytes: int):
    kinds = [pa.int64(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary()]
    names = ["pack", *PER_DOC, "pairs", "n", "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, part, seq = _codec(models), TaskContext.get().partitionId(), 0
        docs: dict[str, list] = {c: [] for c in PER_DOC}
        pairs, at, held = [], [], 0

        def flush():
            own, back = np.unique(np.concatenate([np.zeros(0, np.int64), *pairs]), return_inverse=True)
            sizes = np.cumsum([len(p) for p in pairs])[:-1]
            index = np.concatenate([np.zeros(0, np.uint32), *(b[i] for b, i in zip(np.split(back.astype(np.uint32), sizes), at))])
            row = [(part << 32) + seq, *docs.values(), own.astype("<i8").tobytes(),
                   _planes(np.bincount(index, minlength=len(own))), _planes(index)]
            return pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

        for batch in batches:
            for ids, texts in _batches_of(batch):
                t = codec.tokens(texts)
                g_a, g_b = groups(t)
                la, lb, n = links(t, g_a, g_b)
                last = np.searchsorted(g_a, t.a_first, "right")  # groups that end at or before a text's start
                n_groups = np.diff(last)
                n_links = np.diff(np.r_[0, np.cumsum(n)][last])
                own, back = np.unique((t.a[la] << 32) + t.b[lb], return_inverse=True)
                pairs.append(own)
                at.append(back.astype(np.uint32))
                docs["doc_id"] += ids
                for c, values in (("n_a", np.diff(t.a_first)), ("n_b", np.diff(t.b_first)), ("n_groups", n_groups), ("n_links", n_links)):
                    docs[c] += values.tolist()
                docs["groups_sha256"] += [hashlib.sha256(s).hexdigest() if s else "" for s in written(t, g_a, g_b)]
                held += sum(len(x or "") for x in texts)
                if held >= pack_bytes:
                    yield flush()
                    docs, pairs, at, held, seq = {c: [] for c in PER_DOC}, [], [], 0, seq + 1
        if docs["doc_id"]:
            yield flush()
        codec.forget()  # the worker may idle through later stages
    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for pack, pairs, n in zip(*(batch.column(c).to_pylist() for c in ("pack", "pairs", "n"))):
            pairs = np.frombuffer(pairs, "<i8")
            n = _numbers(n)
            for i in range(0, len(pairs), 1 << 16):
                some = slice(i, i + (1 << 16))
                yield pa.record_batch({"pack": pa.array(np.full(len(pairs[some]), pack)), "pair": pa.array(pairs[some]), "n": pa.array(n[some])})


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _meet(packs: pa.Table, totals: pa.Table) -> pa.Table:
    """A pack and the corpus-wide counts of its pairs."""
    kinds = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in RESULT.split(", ")])
    if not packs.num_rows:
        return pa.table({c.name: pa.array([], c.type) for c in kinds}, schema=kinds)
    row = packs.to_pylist()[0]
    own = np.frombuffer(row["pairs"], "<i8")
    pair = totals["pair"].to_numpy()
    order = np.argsort(pair)
    if len(pair) != len(own) or (pair[order] != own).any():
        raise RuntimeError("counts of a pack do not belong to it")
    index = _numbers(row["links"])
    total = totals["total"].to_numpy()[order][index]
    best = totals["best"].to_numpy(zero_copy_only=False)[order][index]
    ends = np.r_[0, np.cumsum(row["n_links"], dtype=np.int64)]
    sums = {"n_best": np.diff(np.r_[0, np.cumsum(best)][ends]), "count_sum": np.diff(np.r_[0, np.cumsum(total)][ends])}
    return pa.table({c.name: pa.array(sums[c.name] if c.name in sums else row[c.name], c.type) for c in kinds}, schema=kinds)


def pair_totals(packs: DataFrame) -> DataFrame:
    """(pack, pair, total, best) for each distinct pair of each pack; pair is the a id times 2**32 plus the b id, total its links in the
    corpus, best whether no pair with its b id has more. A pair has a row per pack at most, so no key is hot."""
    rows = packs.select("pack", "pairs", "n").mapInArrow(_pairs, "pack long, pair long, n long")
    totals = settle(rows.select("pack", "pair", F.sum("n").over(W.partitionBy("pair")).alias("total"),
                                F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b")), "pair_totals")
    top = totals.groupBy("b").agg(F.max("total").alias("top"))  # at most a row for each id of the second vocabulary
    return totals.join(F.broadcast(top), "b").select("pack", "pair", "total", (F.col("total") == F.col("top")).alias("best"))


def report(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
           pack_bytes: int = PACK_BYTES) -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Tokenizer a (a byte-level JSON file) reads a space and the text, b (a piece model) the text, to which it adds the space. Texts that are null
    or empty, or that either set of tokens does not spell byte for byte (such as one with U+2581), have no tokens: zeros and an empty
    hash. Rows that repeat, and rows with null ids, each count. Other columns are not read. No rows give no rows.
    """
    spark = docs.sparkSession
    lean(spark)
    models = _models(spark, a_path, b_path)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    packs = settle(base.mapInArrow(_packed(models, pack_bytes), PACK), "token_packs")
    met = packs.select("pack", *PER_DOC, "pairs", "links").groupBy("pack").cogroup(pair_totals(packs).groupBy("pack")).applyInArrow(_meet, RESULT)
    return met.withColumnRenamed("doc_id", id_col)


def aligned(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, both token id lists, and per group where it ends: a_ends and b_ends (tokens) and byte_ends (in a space and the text).

    Rows without tokens (see ``report``) have empty lists."""
    spark = docs.sparkSession
    lean(spark)
    models = _models(spark, a_path, b_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(models)
        for batch in batches:
            for ids, texts in _batches_of(batch):
                t = codec.tokens(texts)
                g_a, g_b = groups(t)
                last = np.searchsorted(g_a, t.a_first, "right")
                byte = np.r_[0, t.a_end]
                out = {"doc_id": pa.array(ids, pa.int64())}
                cols = {"a_ids": [], "b_ids": [], "a_ends": [], "b_ends": [], "byte_ends": []}
                for i in range(len(ids)):
                    a, b, g = slice(*t.a_first[i: i + 2]), slice(*t.b_first[i: i + 2]), slice(*last[i: i + 2])
                    cols["a_ids"].append(t.a[a])
                    cols["b_ids"].append(t.b[b])
                    cols["a_ends"].append(g_a[g] - a.start)
                    cols["b_ends"].append(g_b[g] - b.start)
                    cols["byte_ends"].append(byte[g_a[g]] - byte[a.start])
                yield pa.record_batch(out | {c: pa.array(v, pa.list_(pa.int64())) for c, v in cols.items()})

    kind = "doc_id long, " + ", ".join(f"{c} array<long>" for c in ("a_ids", "b_ids", "a_ends", "b_ends", "byte_ends"))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return base.mapInArrow(run, kind).withColumnRenamed("doc_id", id_col)
