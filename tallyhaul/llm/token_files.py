"""Token ids of documents in shards, each one wavelet matrix.

A shard is one binary value that holds a document table and, for each bit of an id from the highest, a bit plane
with a running count of ones per 512 bits. ``Shard`` reads tokens by position, counts a token in a range
and finds its occurrences on the planes, without unpacking the ids; ``decode`` gives all ids back.

Shards are rows of a Parquet table (zstd), because that is what executors can write
to any store with Spark's commit protocol: a task that runs again leaves one result.
Documents are range-partitioned by id before they are tokenized, so ids never shuffle and shards follow each other in ascending id order.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..sources import storage
from .common import partitions, return_memory, small_batches

END_ID, SHARD_TOKENS, CACHED_WORDS = 2, 1 << 16, 600_000
#: Texts are encoded together up to this size; a longer one is encoded alone.
TOGETHER_BYTES = 4 << 20
MAGIC = b"WVM1"
HEAD = struct.Struct("<4sQQB")
#: ASCII characters that a pre-tokenizer splits from the letters before them; not the ones that contractions or special tokens use.
TAIL = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
TAIL_BYTES = TAIL.encode()
SHARD_SCHEMA = "part int, seq int, n_docs long, n_tokens long, payload binary"


# --- the succinct structure ----------------------------------------------------

def pack(ids: np.ndarray, doc_ids: list[int | None], ends: np.ndarray) -> bytes:
    """``ids`` of all documents of the shard in a row; document i ends before position ends[i]."""
    width = max(1, int(ids.max(initial=0)).bit_length())
    known = np.array([d is not None for d in doc_ids], np.uint8)
    parts = [HEAD.pack(MAGIC, len(ids), len(doc_ids), width), np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
             known.tobytes(), np.asarray(ends, "<u8").tobytes()]
    current, n_blocks = ids, -(-len(ids) // 512)
    for b in range(width - 1, -1, -1):
        bit = (current >> b) & 1 == 1
        packed = np.zeros(n_blocks * 64, np.uint8)
        packed[: -(-len(bit) // 8)] = np.packbits(bit, bitorder="little")
        ones = np.bitwise_count(packed.reshape(-1, 64)).sum(1, dtype=np.int64)
        samples = np.r_[0, np.cumsum(ones)].astype("<u4")
        parts += [packed.tobytes(), samples.tobytes()]
        current = np.concatenate([current[np.flatnonzero(~bit)], current[np.flatnonzero(bit)]])  # places, as random bits make masks slow
    return b"".join(parts)


class Shard:
    """A shard read back. Positions run over all tokens of the shard."""

    def __init__(self, data: bytes):
        magic, self.n, docs, self.width = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = HEAD.size

        def take(kind, count):
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        ids, known = take("<i8", docs), take(np.uint8, docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(ids, known)]
        self.ends = take("<u8", docs).astype(np.int64)
        self.starts = np.r_[0, self.ends[:-1]].astype(np.int64)
        blocks = -(-self.n // 512)
        self.planes = [(take("<u8", blocks * 8), take("<u4", blocks + 1)) for _ in range(self.width)]
        self.zeros = [self.n - int(s[-1]) for _, s in self.planes]

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        words, samples = self.planes[level]
        block, word = i >> 9, i >> 6
        out = samples[block].astype(np.int64)
        for j in range(8):
            at = block * 8 + j
            whole = at < word
            out[whole] += np.bitwise_count(words[at[whole]])
        rest = (i & 63) > 0
        mask = (np.uint64(1) << (i[rest] & 63).astype(np.uint64)) - np.uint64(1)
        out[rest] += np.bitwise_count(words[word[rest]] & mask)
        return out

    def access(self, positions) -> np.ndarray:
        """Token ids at positions."""
        i = np.array(positions, np.int64)
        out = np.zeros(len(i), np.int64)
        for level, (words, _) in enumerate(self.planes):
            bit = (words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1
            ones = self._ones(level, i)
            out = out * 2 + bit
            i = np.where(bit, self.zeros[level] + ones, i - ones)
        return out

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        if token >> self.width:
            return 0, 0
        for level in range(self.width):
            ones = self._ones(level, np.array([low, high]))
            if token >> (self.width - 1 - level) & 1:
                low, high = self.zeros[level] + int(ones[0]), self.zeros[level] + int(ones[1])
            else:
                low, high = low - int(ones[0]), high - int(ones[1])
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """How often ``token`` stands at positions low to high."""
        low, high = self._range(token, low, self.n if high is None else high)
        return high - low

    def occurrences(self, token: int) -> np.ndarray:
        """All positions of ``token``, ascending: select, level by level from the lowest plane up."""
        low, high = self._range(token, 0, self.n)
        at = np.arange(low, high)
        for level in range(self.width - 1, -1, -1):
            bit = token >> (self.width - 1 - level) & 1
            rank = at - self.zeros[level] if bit else at
            lo, hi = np.zeros(len(at), np.int64), np.full(len(at), self.n)
            while (lo < hi).any():  # first position after which rank + 1 such bits have come
                mid = (lo + hi) // 2
                ones = self._ones(level, np.minimum(mid + 1, self.n))
                enough = (ones if bit else mid + 1 - ones) > rank
                lo, hi = np.where(enough | (lo >= hi), lo, mid + 1), np.where(enough & (lo < hi), mid, hi)
            at = lo
        return at

    def decode(self) -> np.ndarray:
        """All ids, by undoing the stable partitions from the lowest plane up."""
        current = np.zeros(self.n, np.uint16 if self.width <= 16 else np.uint32)
        for level in range(self.width - 1, -1, -1):
            bit = np.unpackbits(self.planes[level][0].view(np.uint8), count=self.n, bitorder="little").view(bool)
            above = np.empty_like(current)
            z = self.zeros[level]
            above[np.flatnonzero(~bit)] = current[:z]
            above[np.flatnonzero(bit)] = current[z:] | current.dtype.type(1 << (self.width - 1 - level))
            current = above
        return current.astype(np.uint32)


# --- tokenizing ------------------------------------------------------------------

def byte_letters() -> dict[int, str]:
    """The printable character that byte-level models use for each byte: its own where it is printable, else the next one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds(dict):
    """Packed ids by word, at most ``CACHED_WORDS`` of them; beyond that it starts anew with those used lately.

    Where the tokenizer drops white space and cuts texts there (which a probe shows), a text's ids are its words' ids in a row.
    Latin letters and the punctuation behind them are pieces of their own, and letters go straight
    to the model where that gives the same ids. For other tokenizers texts are encoded whole.
    """

    PROBE = "Lorem ipsum, dolor!! sit-amet\n\t Äéñ's  x1 2024;"
    LETTERS = ("the", "Grüße", "déjà", "ñandú", "zzxqk")

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.model, self.bytes, self.old = tokenizer, tokenizer.model, byte_letters(), {}
        self.kind = "H" if tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.direct = all(self.straight(w) == self.whole(w) for w in self.LETTERS)
        self.by_word = self.whole(self.PROBE) == b"".join(self.whole(w) for w in self.PROBE.split())
        self.by_word &= self.whole("Äéñ,...") == self.whole("Äéñ") + self.whole(",...") and self.whole("THE") == self.whole("the")

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}{self.kind}", *ids)

    def straight(self, letters: str) -> bytes:
        """Ids of a piece of letters that have one lower-case letter each."""
        letters = letters.lower()
        if not letters.isascii():
            letters = "".join(map(self.bytes.__getitem__, letters.encode()))
        return array(self.kind, [t.id for t in self.model.tokenize(letters)]).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            text = word.decode()
            if self.direct and text.isascii() and text.isalpha():
                ids = self.straight(text)
            else:
                letters = text.rstrip(TAIL)
                if not (letters.isalpha() and (letters.isascii() or (max(letters) < "ɐ" and "İ" not in letters))):
                    ids = self.whole(text)
                elif len(letters) < len(text):
                    ids = self[letters.encode()] + self[text[len(letters):].encode()]
                else:
                    ids = self.straight(letters) if self.direct else self.whole(text)
        self._keep(word, ids)
        return ids

    def text(self, text: bytes) -> bytes:
        if not self.by_word or b"<|" in text:  # may be a special token, which is looked for before case is changed
            return self.whole(text.decode())
        return b"".join(map(self.__getitem__, text.lower().split()))

    def distinct(self, words: list[bytes]) -> list[bytes]:
        """Ids of each lower-case word. Plain letters with a tail are put together from both parts and not kept, as the parts are."""
        if not self.direct:
            return list(map(self.__getitem__, words))
        out, get, tokenize, kind, keep = [], self.get, self.model.tokenize, self.kind, self._keep
        for word in words:
            ids = get(word)
            if ids is None:
                letters = word.rstrip(TAIL_BYTES)
                if not letters.isalpha():
                    ids = self[word]
                else:
                    ids = get(letters)
                    if ids is None:
                        ids = self.old.get(letters) or array(kind, [t.id for t in tokenize(letters.decode())]).tobytes()
                        keep(letters, ids)
                    if len(letters) < len(word):
                        ids += self[word[len(letters):]]
            out.append(ids)
        return out

    def _keep(self, word: bytes, ids: bytes) -> None:
        if len(self) >= CACHED_WORDS // 2:
            self.old = dict(self)
            self.clear()
        self[word] = ids

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text ends in them; as ``text`` gives them one by one.

        Arrow finds the distinct words of all texts together, each is looked up once, and numpy gathers the ids.
        """
        kind = np.dtype("<u2" if self.kind == "H" else "<u4")
        apart = pc.match_substring(texts, "<|") if self.by_word else pa.array([True] * len(texts))
        plain = pc.if_else(apart, "", texts) if pc.any(apart, min_count=0).as_py() else texts
        lists = pc.ascii_split_whitespace(pc.ascii_lower(plain))
        words = lists.flatten().dictionary_encode()
        # words hold no line feeds, so one text of all of them is the short way to Python
        listed = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words.dictionary)], pa.int32()), words.dictionary), "\n")
        known = self.distinct(listed[0].as_buffer().to_pybytes().split(b"\n") if len(words.dictionary) else [])
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // kind.itemsize
        pool, index = np.frombuffer(b"".join(known), kind), words.indices.to_numpy()
        counts = sizes[index]
        reach = np.r_[0, np.cumsum(counts)]
        shift = (np.cumsum(sizes) - sizes)[index] - reach[:-1]
        ids = pool[np.repeat(shift.astype(np.int32), counts) + np.arange(reach[-1], dtype=np.int32)]
        offsets = lists.offsets.to_numpy()
        ends = reach[offsets[1:] - offsets[0]]
        if plain is not texts:
            parts = np.split(ids, ends[:-1])
            for i in np.flatnonzero(apart.to_numpy(zero_copy_only=False)):
                parts[i] = np.frombuffer(self.text(texts[i].as_py().encode()), kind)
            ids, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
        return ids, ends


_READY: dict[int, WordIds] = {}


def _word_ids(model) -> WordIds:
    """One per worker process, kept between its tasks."""
    key = zlib.crc32(model.value.encode())
    if key not in _READY:
        from tokenizers import Tokenizer

        _READY.clear()
        _READY[key] = WordIds(Tokenizer.from_str(model.value))
    return _READY[key]


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], pa.Array]]:
    """Ids and texts (null as empty) of documents in a row, about ``TOGETHER_BYTES`` of them at a time."""
    held, size = [], 0
    for batch in batches:
        texts = pc.fill_null(batch.column(1), "")
        reach = np.cumsum(pc.binary_length(texts).to_numpy())
        low = 0
        while low < len(texts):
            before = reach[low - 1] if low else 0
            to = max(low + 1, int(np.searchsorted(reach, before + TOGETHER_BYTES - size, "right")))
            if held and reach[to - 1] - before > TOGETHER_BYTES - size:
                to = low
            if to > low:
                held.append((batch.column(0).slice(low, to - low), texts.slice(low, to - low)))
                size, low = size + int(reach[to - 1] - before), to
            if low < len(texts) or size >= TOGETHER_BYTES:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[tuple[pa.Array, pa.Array]]) -> tuple[list[int | None], pa.Array]:
    ids, texts = zip(*held)
    return pa.concat_arrays(ids).to_pylist(), pa.concat_arrays(texts)


def _encode(model, end_id: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return_memory()
        cache = _word_ids(model)
        kind = np.dtype("<u2" if cache.kind == "H" else "<u4")
        part, seq = TaskContext.get().partitionId(), 0
        doc_ids, held, sizes, n = [], [], [], 0

        def flush():
            ids = np.concatenate(held)
            payload = pack(ids, doc_ids, np.cumsum(sizes))
            return pa.record_batch({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()),
                                    "n_docs": pa.array([len(doc_ids)], pa.int64()), "n_tokens": pa.array([len(ids)], pa.int64()),
                                    "payload": pa.array([payload], pa.binary())})

        for docs, texts in _together(batches):
            if len(texts) == 1:
                ids = np.frombuffer(cache.text(texts[0].as_py().encode()), kind)
                ends = np.array([len(ids)])
            else:
                ids, ends = cache.texts(texts)
            ids = np.insert(ids, ends, kind.type(end_id))
            ends = ends + np.arange(1, len(ends) + 1)
            low = done = 0  # documents and ids that stand in a shard
            while low < len(docs):
                # the first document with which the shard is full, or all that are left
                to = min(len(docs), int(np.searchsorted(ends, done + shard_tokens - n)) + 1)
                doc_ids += docs[low: to]
                sizes += np.diff(ends[low: to], prepend=done).tolist()
                held.append(ids[done: ends[to - 1]])
                n += int(ends[to - 1]) - done
                low, done = to, int(ends[to - 1])
                if n >= shard_tokens:
                    yield flush()
                    seq += 1
                    doc_ids, held, sizes, n = [], [], [], 0
        if doc_ids:
            yield flush()
    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = END_ID,
                 shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write all documents' ids as a table of shards at ``path``.

    Null text counts as empty: its only id is ``end_id``. Null ids come first; rows with one id stand together, in no fixed order
    unless their texts are equal. Other columns are not read. A shard closes at the first document
    with which it has ``shard_tokens`` ids (small enough that an Arrow batch of shards stays small). No rows give a table without shards.
    """
    spark = docs.sparkSession
    small_batches(spark)
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    with open(tokenizer_path, encoding="utf-8") as f:
        model = spark.sparkContext.broadcast(f.read())
    ordered = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")) \
        .repartitionByRange(partitions(spark), "id").sortWithinPartitions("id")
    shards = ordered.mapInArrow(_encode(model, end_id, shard_tokens), SHARD_SCHEMA)
    shards.write.option("compression", "zstd").parquet(path)


# --- reading ----------------------------------------------------------------------

def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return_memory()
    for batch in batches:
        for part, seq, payload in zip(*(batch.column(c) for c in ("part", "seq", "payload"))):
            shard = Shard(payload.as_py())
            raw = memoryview(np.ascontiguousarray(shard.decode(), "<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * a: 4 * b]) for a, b in zip(shard.starts.tolist(), shard.ends.tolist())]
            n = len(crc)
            yield pa.record_batch({
                "part": pa.array([part.as_py()] * n, pa.int32()), "seq": pa.array([seq.as_py()] * n, pa.int32()),
                "doc_id": pa.array(shard.doc_ids, pa.int64()), "at": pa.array(shard.starts),
                "n_tokens": pa.array(shard.ends - shard.starts), "ids_crc32": pa.array(crc, pa.int64())})


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the shards alone: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    before = W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    inside = shards.select("part", "seq", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("in_part"))
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row per written partition
    parts = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("part_start"))
    starts = inside.join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("in_part")).alias("shard_start"))
    docs = shards.select("part", "seq", "payload").mapInArrow(
        _documents, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["part", "seq"]).select(
        "doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_counts(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """How often each of a few tokens stands in each document, counted on the planes: doc_id, token, n (above 0)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0):
                shard = Shard(payload.as_py())
                for token in tokens:
                    doc, n = np.unique(np.searchsorted(shard.ends, shard.occurrences(token), "right"), return_counts=True)
                    yield pa.record_batch({"doc_id": pa.array([shard.doc_ids[d] for d in doc], pa.int64()),
                                           "token": pa.array([token] * len(doc), pa.int64()), "n": pa.array(n, pa.int64())})
    return spark.read.schema(SHARD_SCHEMA).parquet(path).select("payload").mapInArrow(run, "doc_id long, token long, n long")


def token_table(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write ``docs`` (to the shared folder where no path is given) and report what the files hold."""
    spark = docs.sparkSession
    path = path or storage.scratch(spark, "tokens") + "/shards"
    write_tokens(docs, path, **options)
    return read_report(spark, path)
