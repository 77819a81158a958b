"""Language identification by rank-order profiles.

A language's profile is the order of its most frequent letter n-grams (1 to 3 letters, words padded with a blank), over
every training row. Letters are what Unicode's category L has; all else parts words. An n-gram is one number, 21 bits a
code point, so that numbers sort as the n-grams do and are counted by array operations. A document gets the order of its own most frequent n-grams; its distance to a profile is the sum of
how far each of them is out of place, with the profile's length for one that is missing. The nearest language wins.

Defined cases: a text that is null or has no letter gives ``und`` with score 0; ties of counts go by n-gram, ties of
distance by language name; rows without a language are not learned from; without any training row every text is
``und``; repeated rows each have their own result; other columns are ignored.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelens.llm.common import crc32_mod, map_batches, small_batches, table

PROFILE = 300
#: Distinct n-grams of a language that a task gathers in training before it hands them on.
KEEP_GRAMS = 500_000
SALTS = 16
BITS = 21


class Grams:
    """Texts to n-gram numbers; whether a code point is a letter is looked up once a task."""

    def __init__(self):
        self.letter = np.full(0x110000, -1, np.int8)

    def of(self, text: str | None) -> np.ndarray:
        """The numbers of all n-grams of the text's words, each as often as it occurs."""
        codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        kind = self.letter[codes]
        if (kind < 0).any():
            for k in np.unique(codes[kind < 0]).tolist():
                self.letter[k] = unicodedata.category(chr(k))[0] == "L"
            kind = self.letter[codes]
        on = np.zeros(len(codes) + 2, bool)
        on[1:-1] = kind
        keep = on.copy()
        keep[1:] |= on[:-1]  # of what parts two words, the first sign stays, as a blank
        keep[:-1] |= on[1:] & ~on[:-1] & ~keep[:-1]
        where = np.flatnonzero(keep)
        # a word after several signs has its own blank in front, a word after one shares it
        c = np.full(len(where), 32, np.int64)
        letters = on[where]
        c[letters] = codes[where[letters] - 1]
        pair = letters[:-1] | letters[1:]
        high, mid = c << (2 * BITS), c << BITS
        two = high[:-1] | mid[1:]
        return np.concatenate([high[letters], two[pair], (two[:-1] | c[2:])[letters[1:-1]]])


def number(gram: str) -> int:
    return sum(ord(c) << BITS * (2 - k) for k, c in enumerate(gram))


def name(number: int) -> str:
    points = (number >> 2 * BITS, number >> BITS & (1 << BITS) - 1, number & (1 << BITS) - 1)
    return "".join(map(chr, (p for p in points if p)))


def counted(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in order, and how often each occurs."""
    x = np.sort(numbers)
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.empty(0, np.int64)
    return x[first], np.diff(np.r_[first, len(x)])


def gram_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n) over all rows with a language; gram is the n-gram's number."""
    small_batches(docs.sparkSession)

    def run(batches):
        grams = Grams()
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts):
            g, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(g, kind="stable")
            g, n = g[order], n[order]
            first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            return g[first], np.add.reduceat(n, first)

        def rows(one, g, n):
            return pa.RecordBatch.from_arrays([pa.array([one] * len(g)), pa.array(g), pa.array(n)], names=["lang", "gram", "n"])

        for b in batches:
            found: dict[str, list[np.ndarray]] = {}
            for one, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                g = grams.of(t)
                if len(g):
                    found.setdefault(one, []).append(g)
            for one, parts in found.items():
                held[one] = [merged([*held.get(one, ()), counted(np.concatenate(parts))])]
                if len(held[one][0][0]) > KEEP_GRAMS:
                    yield rows(one, *held.pop(one)[0])
        for one, parts in sorted(held.items()):
            yield rows(one, *parts[0])

    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang is not null and text is not null")
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def profiles(docs: DataFrame, size: int = PROFILE, text: str = "text", lang: str = "lang") -> dict[str, list[str]]:
    """Each language's most frequent n-grams in order: ``size`` strings a language come to the driver.

    The order is found in two steps, so that a language with most of the n-grams is spread over SALTS groups first.
    """
    order = [F.col("n").desc(), F.col("gram")]
    counts = gram_counts(docs, text, lang).withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(SALTS)))
    near = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("r") <= size)
    top = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("r") <= size)
    out: dict[str, list[str]] = {}
    for row in sorted(top.select("lang", "r", "gram").collect()):
        out.setdefault(row.lang, []).append(name(row.gram))
    return out


class Ranker:
    def __init__(self, profiles: dict[str, list[str]], size: int = PROFILE):
        self.langs, self.size, self.grams = sorted(profiles), size, Grams()
        self.known = np.unique(np.array([number(g) for one in self.langs for g in profiles[one]], np.int64))
        self.ranks = np.full((len(self.known) + 1, len(self.langs)), -1, np.int32)  # the last row: in no profile
        for k, one in enumerate(self.langs):
            self.ranks[np.searchsorted(self.known, [number(g) for g in profiles[one]]), k] = np.arange(len(profiles[one]))

    def order(self, numbers: np.ndarray) -> np.ndarray:
        """The text's most frequent n-grams, by count and then by name."""
        g, n = counted(numbers)
        if len(g) > self.size:
            near = n >= np.partition(n, len(n) - self.size)[len(n) - self.size]
            g, n = g[near], n[near]
        return g[np.argsort(-n, kind="stable")][: self.size]

    def predict(self, text: str | None) -> tuple[str, float]:
        numbers = self.grams.of(text)
        if not len(numbers) or not self.langs:
            return "und", 0.0
        own = self.order(numbers)
        at = np.searchsorted(self.known, own)
        at[at == len(self.known)] = 0
        ranks = self.ranks[np.where(self.known[at] == own, at, len(self.known))]
        d = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own), dtype=np.int32)[:, None])).sum(axis=0)
        best = int(d.argmin())
        worst = self.size * len(own)
        other = min((int(x) for k, x in enumerate(d) if k != best), default=worst)
        return self.langs[best], float((other - d[best]) / other) if other else 0.0


def identify(docs: DataFrame, learned: dict[str, list[str]], size: int = PROFILE) -> DataFrame:
    """(doc_id, lang_pred, score); the score is by how much the nearest profile is nearer than the second."""

    def make():
        r = Ranker(learned, size)

        def f(c):
            out = [r.predict(t) for t in c["text"]]
            return {"doc_id": c["doc_id"], "lang_pred": [x for x, _ in out], "score": [y for _, y in out]}

        return f

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), make, "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return crc32_mod(doc_id, 4) == 2


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learned = profiles(docs.where(~held_out(F.col("doc_id"))))
    out = identify(docs, learned)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
