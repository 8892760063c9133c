"""Rows that every operator has to live with, and plain versions to compare with."""

import random
import re
from collections import defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, id string, k string, component_id string"
LONG = " ".join(f"w{i % 977} x{i % 31}," for i in range(40_000))


def rows():
    """Nulls, empty texts, a very long one, ties, repeated rows; the last columns have names that operators use themselves."""
    clash = ("a", None, "b", "c", "d")
    texts = [None, "", " \t\n", "one", "One  TWO three", "one two\nthree", LONG, LONG + " end",
             "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf today",
             "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf tonight",
             "Ünïcödé wörds äre fïne, ñandú!", "12 34 !!", "\x00 odd \x1c bytes \x85 here"]
    out = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, None, *clash) for i, t in enumerate(texts)]
    out.append(out[8])  # a row that repeats
    out.append((None, "no id", None, None, None, *clash))
    return out


def documents(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, k):
    w = words(text)
    return {tuple(w[i: i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def linked(pairs, k, num, den):
    """{id: (set size, smallest linked id)} by counting shared runs of all pairs."""
    sets = {i: shingles(t, k) for i, t in pairs}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    where = defaultdict(list)
    for i in sorted(sets):
        shared = defaultdict(int)
        for s in sets[i]:
            for j in where[s]:
                shared[j] += 1
            where[s].append(i)
        for j, n in shared.items():
            if den * n >= num * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def families(seed=5, groups=(2, 3, 9, 40), words_each=120):
    """Near copies of a few texts, and texts that only share a passage."""
    r = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(60))
    out = []
    for g, n in enumerate(groups):
        base = [f"g{g}v{r.randrange(400)}" for _ in range(words_each)]
        for _ in range(n):
            w = list(base)
            for _ in range(r.randrange(4)):
                w[r.randrange(len(w))] = f"e{r.randrange(10 ** 6)}"
            out.append((len(out), " ".join(w)))
    for i in range(60):
        own = [f"o{r.randrange(10 ** 6)}" for _ in range(60)]
        out.append((len(out), " ".join(own[:30]) + " " + passage + " " + " ".join(own[30:])))
    return out
