import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tallyhaul.llm import alignment as A, queries
from tallyhaul.llm.token_files import byte_letters

from . import cases

ODD = ["a", " ", "  ", " a", "a ", "a  b", "\n", " \n x", "x\n  y", "foo!\x1cbar  ", "▁ x", "x▁", "<s> <unk>", "<|endoftext|> hi",
       "日本語のテキスト、長い。", "é  　 z", "🙂🙂 🙃", "\x00\x00 a\x00b", "aaaaaaaaaaaaaaaaaaaaaaaaaaa", "can't  won't\t\tx", "ﬁﬂ ſ İ",
       "x" * 3000, "  q \x85 r", "١٢٣ 123,456.78", " ".join("ab" for _ in range(500))]


def plain(data):
    """The contract, token by token: intersect all ends, then test every pair of tokens of a group."""
    a_tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = {c: i for i, c in byte_letters().items()}

    def b_bytes(i):
        piece = b_tok.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_tok.is_byte(i) else piece.replace("▁", " ").encode()

    docs, counts = [], Counter()
    for i, text in data:
        groups, found = [], []
        if text:
            raw = (" " + text).encode()
            a = [(x, bytes(letters[c] for c in a_tok.id_to_token(x))) for x in a_tok.encode(" " + text, add_special_tokens=False).ids]
            b = [(x, b_bytes(x)) for x in b_tok.encode(text)]
            if b"".join(x[1] for x in a) == raw == b"".join(x[1] for x in b):
                spans = [[], []]
                for out, tokens in zip(spans, (a, b)):
                    at = 0
                    for x, own in tokens:
                        out.append((at, at + len(own), x))
                        at += len(own)
                cuts = sorted({s[1] for s in spans[0]} & {s[1] for s in spans[1]})
                p = q = 0
                for c in cuts:
                    g = [[], []]
                    while p < len(spans[0]) and spans[0][p][1] <= c:
                        g[0].append(spans[0][p])
                        p += 1
                    while q < len(spans[1]) and spans[1][q][1] <= c:
                        g[1].append(spans[1][q])
                        q += 1
                    groups.append(g)
                    found += [(x[2], y[2]) for x in g[0] for y in g[1] if max(x[0], y[0]) < min(x[1], y[1])]
        counts.update(found)
        docs.append((i, groups, found))
    top = defaultdict(int)
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    out = []
    for i, groups, found in docs:
        line = ";".join("|".join(",".join(str(x[2]) for x in side) for side in g) for g in groups)
        out.append((i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(found),
                    sum(counts[x] == top[x[1]] for x in found), sum(counts[x] for x in found), hashlib.sha256(line.encode()).hexdigest() if line else ""))
    return sorted(out, key=str)


def test_query_against_plain_alignment(spark, sf_dir):
    data = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op11_token_alignment(spark, sf_dir).collect()), key=str) == plain(data)


def test_odd_rows_and_small_packs(spark):
    data = [*cases.rows(), *((100 + i, t, None, None, None, *"abcde") for i, t in enumerate(ODD))]
    got = A.report(cases.documents(spark, data).repartition(3), pack_bytes=50)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain([r[:2] for r in data])
    assert A.report(cases.empty(spark)).collect() == []


@pytest.mark.parametrize("apart", [True, False])
def test_pieces_give_the_ids_of_the_text(apart):
    with open(public_tokenizers.path("byte_bpe_50k.json")) as a, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as b:
        codec = A.Codec(a.read(), b.read())
    assert codec.apart
    codec.apart = apart
    for text in [t for t in ODD if "▁" not in t]:
        t = codec.tokens([text])
        assert t.a.tolist() == codec.a.encode(" " + text, add_special_tokens=False).ids and t.b.tolist() == codec.b.encode(text), text


def test_division_finds_all_common_ends():
    r = np.random.default_rng(3)
    for dense in (0.9, 0.5, 0.05):
        first, ends = [[0], [0]], [[], []]
        base = 0
        for n in (1, 2, 7, 300, 5000):
            for s in (0, 1):
                own = np.flatnonzero(r.random(n) < dense)
                ends[s] += [base + 1 + int(x) for x in own if x < n - 1] + [base + n]
                first[s].append(len(ends[s]))
            base += n
        a_end, b_end = map(np.array, ends)
        t = A.Tokens(a_end * 0 + 1, b_end * 0 + 2, a_end, b_end, np.array(first[0]), np.array(first[1]))
        g_a, g_b = A.groups(t)
        common = np.intersect1d(a_end, b_end)
        assert (a_end[g_a - 1] == common).all() and (b_end[g_b - 1] == common).all()
        la, lb, n = A.links(t, g_a, g_b)
        a0, b0 = np.r_[0, a_end[:-1]], np.r_[0, b_end[:-1]]
        want = {(i, j) for i in range(len(a_end)) for j in range(np.searchsorted(b_end, a0[i], "right"), len(b_end)) if b0[j] < a_end[i]} \
            if len(a_end) < 6000 else None
        assert set(zip(la.tolist(), lb.tolist())) == {(i, j) for i, j in want if max(a0[i], b0[j]) < min(a_end[i], b_end[j])} and len(la) == len(want) == n.sum()


def test_spans(spark):
    got = A.aligned(spark.createDataFrame([(1, "unbelievable words"), (2, None)], "doc_id long, text string")).collect()
    one, two = sorted(got)
    raw = b" unbelievable words"
    assert one.byte_ends[-1] == len(raw) and one.a_ends[-1] == len(one.a_ids) and one.b_ends[-1] == len(one.b_ids)
    assert len(one.byte_ends) == len(one.a_ends) == len(one.b_ends) and two.a_ids == two.byte_ends == []
