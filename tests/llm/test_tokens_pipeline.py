import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline
from tallyhaul.llm import decontamination, mixing, queries, token_files as T, toxicity
from tallyhaul.llm.common import settle

from . import cases


def test_wavelet_matrix():
    r = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 511, 512, 513, 20_000):
        ids = r.integers(0, 49_000, n).astype("<u2")
        ids[::7] = 5
        shard = T.Shard(T.pack(ids, [4, None], np.array([n // 3, n])))
        assert (shard.decode() == ids).all() and shard.doc_ids == [4, None] and shard.ends.tolist() == [n // 3, n]
        at = r.integers(0, n, 50) if n else np.zeros(0, int)
        assert (shard.access(at) == ids[at]).all()
        for token in (5, 77, 60_000):
            assert shard.count(token) == (ids == token).sum()
            assert shard.count(token, n // 4, n // 2) == (ids[n // 4: n // 2] == token).sum()
            assert (shard.occurrences(token) == np.flatnonzero(ids == token)).all()


def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_words_give_the_ids_of_the_text(monkeypatch):
    monkeypatch.setattr(T, "CACHED_WORDS", 8)
    own, plain = T.WordIds(tokenizer()), tokenizer()
    assert own.by_word and own.direct
    odd = ["Hello<|endoftext|> World", "ÅBÅ x\x1cy\x85z it's they're. 'S", "naïve’s Σας, 1234 a1b2", "don't-stop -- ...", "İstanbul ıI",
           "ſt ﬁ Ａ", "<|startoftext|", "é ́x", "", " \n"]
    for text in [*odd, *(t for r in cases.rows() if (t := r[1]))]:
        assert np.frombuffer(own.text(text.encode()), "<u2").tolist() == plain.encode(text, add_special_tokens=False).ids
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert np.frombuffer(T.WordIds(other).text(b"A  b\nc"), "<u2").tolist() == other.encode("A  b\nc", add_special_tokens=False).ids


def plain_report(data):
    own, out, start = tokenizer(), [], 0
    for i, text in sorted(data, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = own.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_shards_against_plain_encoding(spark, sf_dir):
    data = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op10_token_files(spark, sf_dir).collect())) == plain_report(data)


def test_shards_of_odd_rows(spark, tmp_path):
    docs = cases.documents(spark)
    path = str(tmp_path / "shards")
    got = sorted(map(tuple, T.token_table(docs, path, shard_tokens=50).collect()), key=repr)
    assert got == sorted(plain_report([(r[0], r[1]) for r in cases.rows()]), key=repr)
    fox = tokenizer().encode("fox", add_special_tokens=False).ids[0]
    assert sorted(map(tuple, T.token_counts(spark, path, [fox, 2]).filter(f"token = {fox}").collect())) == [(8, fox, 1), (8, fox, 1), (9, fox, 1)]
    assert T.token_table(cases.empty(spark)).count() == 0


# --- the pipeline --------------------------------------------------------------------

def test_stages_against_plain_versions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_copies", "decontamination", "mixing", "tokens"]
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = [tuple(r) for r in docs.collect()]
    score = model.scores(pa.array([r[1] for r in rows]))
    calm = [r for r, s in zip(rows, score) if s < 0.7]
    first = settle(stages["toxicity"](spark, docs, sf_dir), "t1")
    assert sorted(map(tuple, first.collect())) == sorted(calm)

    group = cases.linked([(r[0], r[1]) for r in calm], 5, 80, 100)
    single = [r for r in calm if group[r[0]][1] == r[0]]
    second = settle(stages["near_copies"](spark, first, sf_dir), "t2")
    assert sorted(map(tuple, second.collect())) == sorted(single)

    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    report = decontamination.report(second, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    few = [(r[0], r[1]) for r in single if len(r[1] or "") < 600]
    plain = {r[0]: r for r in decontamination.brute_force(few, items)}
    leaks = {r.doc_id: r.contaminated for r in report.collect()}
    assert all(leaks[i] == plain[i][5] for i in plain)
    third = settle(stages["decontamination"](spark, second, sf_dir), "t3")
    clean = [r for r in single if not leaks[r[0]]]
    assert sorted(map(tuple, third.collect())) == sorted(clean)

    fourth = settle(stages["mixing"](spark, third, sf_dir), "t4")
    copies = {r.doc_id: r.copies for r in mixing.plan(third).collect()}
    mix = [r for r in clean for _ in range(copies[r[0]])]
    assert fourth.columns == docs.columns and sorted(map(tuple, fourth.collect())) == sorted(mix)

    last = stages["tokens"](spark, fourth, sf_dir)
    assert sorted(map(tuple, last.collect())) == plain_report([(r[0], r[1]) for r in mix])
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, last.collect()))


def test_stages_on_odd_and_empty_tables(spark, sf_dir):
    for docs in (cases.documents(spark), cases.empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            before = docs.columns
            docs = settle(stage(spark, docs, sf_dir), "odd")
            assert docs.columns == before or docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_texts_encoded_together_have_the_ids_of_each_alone(monkeypatch):
    """Groups of texts of any size, long ones between short ones, special tokens inside texts, white space of all kinds."""
    plain = tokenizer()
    rnd = random.Random(3)
    parts = ["a", "Bee", "é", "İ", "ß", ",", "...", "'s", "don't", " ", "\t", "\n", "\x0b", "\x0c", "\x1c", "\x85", "　", "<|endoftext|>", "12", "中", "ﬁ", "\x00"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.choice([0, 1, 5, 40]))) for _ in range(400)] + [None, "", " ", "word, " * 300]
    table = pa.table({"id": pa.array(range(len(texts))), "text": pa.array(texts)})
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    for size in (1, 60, 500, 1 << 20):
        monkeypatch.setattr(T, "TOGETHER_BYTES", size)
        words, got, seen = T.WordIds(plain), [], []
        for docs, group in T._together(iter(table.to_batches(37))):
            assert len(group) == 1 or sum(len(t.as_py().encode()) for t in group) <= size
            ids, ends = words.texts(group)
            seen += docs
            got += [p.tolist() for p in np.split(ids, ends[:-1])]
        assert seen == list(range(len(texts))) and got == want
