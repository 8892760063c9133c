"""Language identification by cross-parsing entropy.

Per language a suffix automaton of labelled text. A text is parsed against each
automaton into longest phrases that occur in that language's text; phrases per symbol, divided by
what other text of the language itself needs, measure its cross entropy. The
language that needs the fewest normalised phrases wins.

Symbols are letters in lower case; all else between letters is one break. Automata are dense transition tables, and all
texts of a batch are parsed in step, ``SEGMENT`` symbols each, by numpy. Whole texts are parsed.

Fitting reads at most ``PER_LANGUAGE`` labelled documents of each language, of at most ``FIT_CHARS`` characters, and ``SYMBOLS`` of their
symbols for the automaton and as many for its own rate.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import hashing
from .common import settle, small_batches

PER_LANGUAGE, FIT_CHARS, SYMBOLS, SEGMENT = 60, 20_000, 24_000, 256
BREAK, PAD, OTHER, FIRST, LETTERS = 0, 1, 2, 3, 250
SHARPNESS = 8.0


def symbol_table(texts: list[str]) -> np.ndarray:
    """Code point to symbol: the most frequent letters have their own, other letters share one."""
    seen = Counter(c for t in texts for c in t.lower() if c.isalpha())
    own = {c: FIRST + i for i, (c, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:LETTERS])}
    table = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            low = c.lower()
            table[point] = own.get(low if len(low) == 1 else low[0], OTHER)
    return table


def symbols(table: np.ndarray, points: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts in a row, runs of breaks as one, none at a text's start; and where each text begins."""
    out = table[points]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != BREAK) | (out[:-1] != BREAK)
    begins = first[:-1][first[:-1] < first[1:]]
    keep[begins] = out[begins] != BREAK
    return out[keep], np.r_[0, np.cumsum(keep)][first]


def automaton(sequence: np.ndarray, size: int) -> np.ndarray:
    """Transitions of the suffix automaton: state x symbol to state, 0 where there is none (no transition leads to the root, state 0)."""
    nexts: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in sequence.tolist():
        new = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    table = np.zeros((len(nexts), size), np.int32)
    for state, row in enumerate(nexts):
        for c, to in row.items():
            table[state, c] = to
    return table


def phrases(table: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Phrases of each row of ``grid`` (segments x symbols, padded at the end): greedy parsing, all rows in step."""
    flat, width = table.ravel(), table.shape[1]
    state = np.zeros(len(grid), np.int64)
    count = np.zeros(len(grid), np.int64)
    columns = np.ascontiguousarray(grid.T).astype(np.int64)
    for c in columns:
        to = flat[state * width + c]
        again = flat[c]
        ends = (to == 0) & (c != PAD)
        count += ends & (state != 0)
        count += ends & (again == 0)  # a symbol that the language does not have is a phrase of its own
        state = np.where(ends, again, np.where(c == PAD, state, to))
    return count + (state != 0)


def segments(sequence: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``SEGMENT`` symbols and the text of each."""
    size = np.diff(first)
    many = -(-size // SEGMENT)
    doc = np.repeat(np.arange(len(size)), many)
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    at = first[:-1][doc][:, None] + nth[:, None] * SEGMENT + np.arange(SEGMENT)
    inside = at < first[1:][doc][:, None]
    padded = np.r_[sequence, np.uint8(PAD)]
    return padded[np.where(inside, at, len(sequence))], doc


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    automata: list[np.ndarray]
    rates: list[float]

    def identify(self, texts) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        data, offsets = hashing.utf8(texts)
        points = np.frombuffer(bytes(data).decode("utf-8").encode("utf-32-le"), np.uint32)
        leads = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
        sequence, first = symbols(self.table, points, leads[offsets])
        n = len(first) - 1
        lettered = np.add.reduceat(np.r_[sequence != BREAK, False], first[:-1]) * (np.diff(first) > 0) > 0
        if not self.languages:
            return ["und"] * n, np.zeros(n)
        need = np.zeros((len(self.languages), n))
        grid, doc = segments(sequence, first)
        for i in range(0, len(grid), 8192):
            for k, a in enumerate(self.automata):
                need[k] += np.bincount(doc[i: i + 8192], phrases(a, grid[i: i + 8192]), n)
        need /= np.maximum(np.diff(first), 1) * np.array(self.rates)[:, None]
        best = need.argmin(0)
        odds = np.exp(-SHARPNESS * (need - need.min(0)))
        score = np.where(lettered, 1 / odds.sum(0), 0.0)
        return [self.languages[b] if ok else "und" for b, ok in zip(best, lettered)], score


def train(rows: list[tuple[str, str]], n_symbols: int = SYMBOLS) -> Model:
    """From (language, text). The first symbols of a language make its automaton, the next ones its own rate."""
    by: dict[str, list[str]] = {}
    for language, text in rows:
        by.setdefault(language, []).append(text)
    table = symbol_table([t for _, t in rows])
    size = max(int(table.max()) + 1, FIRST)
    languages, automata, rates = [], [], []
    for language in sorted(by):
        own = []
        for text in by[language]:
            s, _ = symbols(table, np.frombuffer(text.encode("utf-32-le"), np.uint32), np.array([0, len(text)]))
            own.append(np.r_[s, np.uint8(BREAK)])
        s = np.concatenate(own)
        cut = min(n_symbols, (len(s) + 1) // 2)
        if not (s != BREAK).any():
            continue
        a = automaton(s[:cut], size)
        rest = s[cut: cut + n_symbols]
        grid, _ = segments(rest, np.array([0, len(rest)]))
        languages.append(language)
        automata.append(a)
        rates.append(max(float(phrases(a, grid).sum()) / max(len(rest), 1), 1e-3) if len(rest) else 1.0)
    return Model(languages, table, automata, rates)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "utf-8")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, fit_chars: int = FIT_CHARS, id_col: str = "doc_id",
        text_col: str = "text", lang_col: str = "lang") -> Model:
    """Train on a bounded sample of the labelled documents that are not held out: the first of each language in a fixed pseudo-random order."""
    ids = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.length(text_col).alias("n")).filter(
        f"lang IS NOT NULL AND id IS NOT NULL AND n BETWEEN 1 AND {fit_chars}").filter(~held_out(F.col("id")))
    order = W.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    sample = ids.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= per_language).select("id", "lang", "k")
    sample = settle(sample, "language_sample")  # per_language rows of each language
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("l"), F.col(text_col).alias("text")).join(
        F.broadcast(sample), "id").filter(f"l = lang AND length(text) BETWEEN 1 AND {fit_chars}").collect()
    return train([(r.lang, r.text) for r in sorted(rows, key=lambda r: (r.lang, r.k, r.text))])


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: id, held_out, lang_pred, score.

    Null texts and texts without letters are ``und`` with score 0; so is every text if no labelled text was found. A text in letters that
    no language has takes the first language by name, with an even score. Ties go to the first by name.
    """
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(fit(docs, id_col=id_col, text_col=text_col, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages, score = model.value.identify(batch.column(1))
            yield pa.record_batch([batch.column(0), pa.array(languages, pa.string()), pa.array(np.clip(score, 0, 1), pa.float64())],
                                  names=[id_col, "lang_pred", "score"])

    base = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    kind = base.schema[0].dataType.simpleString()
    found = base.mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")
    return found.select(id_col, held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score")
