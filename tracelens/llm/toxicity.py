"""Toxicity by a string-kernel support vector machine with Nystroem landmarks.

The kernel of two words is the gap-weighted subsequence kernel of order 3: every common subsequence of three characters
counts, with a decay for each character it spans, so gapped insults and insults with inserted characters stay near the
plain ones. Landmark words span the Nystroem space; a linear support vector machine learns in it from the words of
labelled documents; sentences are not formed, so nothing that spans a blank is learned. A document is labelled as a whole, so it is a bag: a bad document is stood for by the words that cover most
bad documents, a good one by all its words. The score of a text is that of its worst word.

At the kernel's order the machine's decision is a weighted sum over the character triples of a word, divided by the
word's own norm: landmarks, Nystroem root and weights are multiplied out once after training, which changes nothing in
the result and lets whole corpora be scored.

Texts of all scripts are scored; scripts without blanks between words are scored by overlapping pieces of 16 signs, as are
words longer than that.

Defined cases: null and empty texts have no words and get a score next to 0; without
labels of both kinds every score is 0; a document labelled twice counts as bad if any label says so; repeated rows have
equal scores; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelens.llm.common import crc32_mod, filter_texts, map_batches, small_batches, table

DECAY, PIECE, STEP = 0.7, 16, 8
THRESHOLD = 0.7
#: Labelled documents of either kind that the machine is trained on at most: those with the smallest hashes of their id.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1200, 2400
LEAST = 4
LANDMARKS, CLEAN_LANDMARKS, HARD_LANDMARKS = 160, 64, 64
#: Words whose scores a task keeps.
KEEP_WORDS = 300_000

# Signs: 0 is any sign that is no letter or digit, 1-26 Latin letters by their base form, 27-36 digits, 37 the start of a
# word. Letters of other scripts go by their base form's code point modulo 36, which keeps the letters of an alphabet
# apart, as these stand in a row; that they share signs with Latin letters does no harm, as words are of one script.
SIGNS, START = 38, 37
_OUTER = re.compile(r"[^\w\s]*\s[^\w]*")
_INNER = re.compile(r"(?<=\w)[^\w\s]+(?=\w)")
_SPACED = re.compile(r"(?<!\S)(?:\w[ .\-_*]){2,}\w(?!\w)")


def sign_of(point: int) -> int:
    base = unicodedata.normalize("NFD", chr(point).lower())[0]
    if "a" <= base <= "z":
        return ord(base) - 96
    if "0" <= base <= "9":
        return ord(base) - 21
    if base == "ß":
        return ord("s") - 96
    return START if base == "^" else 1 + ord(base) % 36 if base.isalnum() else 0


def words_of(text: str | None) -> list[str]:
    """Lower-case words; words with signs inside also count without these, runs of single signs ("i d i o t") as one."""
    if not text:
        return []
    low = text.lower()
    out = _OUTER.sub(" ", f" {low} ").split()
    out += [_INNER.sub("", x) for x in out if not x.isalnum() and _INNER.search(x)]
    out += [re.sub(r"[ .\-_*]", "", x) for x in _SPACED.findall(low)]
    return out


def _pieces(words: list[str]) -> tuple[list[str], list[int]]:
    """Words with a mark at their start; those of more than PIECE characters are cut into overlapping pieces."""
    parts, owner = [], []
    for k, w in enumerate(words):
        w = "^" + w.replace("^", "*")
        if len(w) <= PIECE:
            parts.append(w)
            owner.append(k)
        else:
            for at in range(0, len(w) - PIECE + STEP, STEP):
                parts.append(w[at : at + PIECE])
                owner.append(k)
    return parts, owner


class Kernel:
    def __init__(self, decay: float = DECAY):
        self.decay, self.table = decay, np.full(0x110000, -1, np.int8)  # filled as code points come up
        self.triples = {n: np.array([(i, j, k) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, n)], np.int64).reshape(-1, 3) for n in range(PIECE + 1)}

    def codes(self, words: list[str], n: int) -> np.ndarray:
        """Sign classes of words of length n."""
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        out = self.table[flat]
        if (out < 0).any():
            for point in np.unique(flat[out < 0]).tolist():
                self.table[point] = sign_of(point)
            out = self.table[flat]
        return out.astype(np.int64).reshape(len(words), n)

    def features(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Triple codes and weights of words of one length: (words, triples), (triples,)."""
        t = self.triples[codes.shape[1]]
        u = (codes[:, t[:, 0]] * SIGNS + codes[:, t[:, 1]]) * SIGNS + codes[:, t[:, 2]]
        return u, self.decay ** (t[:, 2] - t[:, 0] + 1).astype(np.float64)

    def norms(self, codes: np.ndarray) -> np.ndarray:
        """sqrt(k(x, x)) by the kernel's recursion, all words of one length at once."""
        m, n = codes.shape
        lam, same = self.decay, codes[:, :, None] == codes[:, None, :]
        prime = np.ones((m, n + 1, n + 1))
        for _ in range(2):
            nxt = np.zeros((m, n + 1, n + 1))
            for i in range(1, n + 1):
                row = np.zeros(m)
                for j in range(1, n + 1):
                    row = lam * row + lam * lam * same[:, i - 1, j - 1] * prime[:, i - 1, j - 1]
                    nxt[:, i, j] = lam * nxt[:, i - 1, j] + row
            prime = nxt
        k = lam * lam * (same * prime[:, :n, :n]).sum(axis=(1, 2))
        return np.sqrt(k)

    def by_length(self, words: list[str]):
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            groups.setdefault(len(w), []).append(i)
        for n, idx in groups.items():
            for at in range(0, len(idx), 1024):
                part = idx[at : at + 1024]
                yield np.array(part), self.codes([words[i] for i in part], n)

    def dense(self, words: list[str], cut: bool = True) -> np.ndarray:
        """Normed features, a column for each word; only for landmarks. ``cut``: words of one piece each, else pieces."""
        out = np.zeros((SIGNS**3, len(words)), np.float32)
        for idx, codes in self.by_length(_pieces(words)[0] if cut else words):
            if codes.shape[1] < 3:
                continue
            u, w = self.features(codes)
            for c, row in zip(idx, u, strict=True):
                one = np.bincount(row, w, SIGNS**3)
                out[:, c] = one / np.linalg.norm(one)
        return out

    def against(self, words: list[str], dense: np.ndarray, cut: bool = True) -> np.ndarray:
        """Normed kernel values (words, landmarks); ``cut`` as in dense."""
        out = np.zeros((len(words), dense.shape[1]), np.float32)
        for idx, codes in self.by_length(_pieces(words)[0] if cut else words):
            if codes.shape[1] < 3:
                continue
            u, w = self.features(codes)
            norm = self.norms(codes)
            w = w.astype(np.float32)
            for r, row, x in zip(idx, u, norm, strict=True):
                out[r] = (w @ dense[row]) / x
        return out


class Model:
    """Triple weights, bias, and the slope that turns a decision value into a probability."""

    def __init__(self, v: np.ndarray | None, bias: float = 0.0, slope: float = 1.0, shift: float = 0.0):
        self.v, self.bias, self.slope, self.shift = v, bias, slope, shift

    def decide(self, kernel: Kernel, words: list[str]) -> np.ndarray:
        parts, owner = _pieces(words)
        out = np.full(len(words), -np.inf)
        np.maximum.at(out, owner, self.values(kernel, parts))
        return out

    def values(self, kernel: Kernel, parts: list[str]) -> np.ndarray:
        val = np.full(len(parts), self.bias)
        for idx, codes in kernel.by_length(parts):
            if codes.shape[1] < 3:
                continue
            u, w = kernel.features(codes)
            val[idx] += (self.v[u] @ w) / kernel.norms(codes)
        return val

    def probability(self, z):
        return 1 / (1 + np.exp(-np.clip(self.slope * (z - self.shift), -40, 40)))


def _svm(x: np.ndarray, y: np.ndarray, n_good: int, c: float = 10.0, steps: int = 40) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, classes weighed alike, by Newton steps over the rows within the margin.

    ``n_good`` is the number of all good rows: those that are not in x lie beyond the margin and have no loss.
    """
    n_bad = int((y > 0).sum())
    total = n_bad + n_good
    weight = np.where(y > 0, 1 / (2 * max(1, n_bad)), 1 / (2 * max(1, n_good)))
    xb = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    reg = np.r_[np.ones(x.shape[1]), 0.01] / (2 * c * total)

    def cost(w):
        return reg @ (w * w) + weight @ np.maximum(0, 1 - y * (xb @ w)) ** 2

    w = np.zeros(xb.shape[1])
    now = cost(w)
    for _ in range(steps):
        in_margin = y * (xb @ w) < 1
        xi, wi = xb[in_margin], weight[in_margin]
        goal = np.linalg.solve(np.diag(reg) + xi.T @ (xi * wi[:, None]), xi.T @ (wi * y[in_margin]))
        t = 1.0
        while t > 1e-4 and cost(w + t * (goal - w)) > now:
            t /= 2
        nxt = w + t * (goal - w)
        new = cost(nxt)
        if new >= now * (1 - 1e-6):
            break
        w, now = nxt, new
    return w[:-1], float(w[-1])


def _cover(bad: list[list[str]], in_bad: Counter, in_good: Counter) -> list[str]:
    """Words that stand for the bad bags: again and again the word of most bags that none stands for yet.

    Only words seen in no good bag, or at most a fiftieth as often there, can stand for a bag; a word that would stand
    for fewer than LEAST bags is taken for chance, unless there are too few bags to tell.
    """
    open_, chosen, least = [set(b) for b in bad], [], LEAST if len(bad) >= 20 * LEAST else 1
    while open_:
        c = Counter(w for b in open_ for w in b if len(w) > 3 and 50 * in_good[w] <= in_bad[w])
        if not c:
            break
        best = min(c, key=lambda w: (-c[w], -in_bad[w], w))
        if c[best] < least:
            break
        chosen.append(best)
        open_ = [b for b in open_ if best not in b]
    return chosen


def inserted(piece: str) -> list[str]:
    """The piece with one sign put in between two letters, or with one letter doubled; what is then beyond PIECE goes."""
    if len(piece) < 5:
        return []
    out = [(piece[:i] + x + piece[i:])[:PIECE] for i in range(1 + (piece[0] == "^"), len(piece)) for x in ("*", piece[i])]
    return [x for x in dict.fromkeys(out) if x != piece]


def train(rows: list[tuple[str | None, int]], rounds: int = 3) -> Model:
    """From (text, label) pairs, in any order: the result depends on the set of pairs alone.

    Bags are of pieces, as these are scored; a word of fewer than PIECE characters is one piece. Good pieces beyond the
    margin have no loss, so the machine is trained on some of them, those within the margin are added, and so on until
    none is left out: the result is that of all good pieces.
    """
    bags = [(sorted(set(_pieces(words_of(t))[0])), int(y)) for t, y in sorted({(t or "", int(y)) for t, y in rows})]
    bad, good = [b for b, y in bags if y and b], [b for b, y in bags if not y]
    if not bad or not good:
        return Model(None)
    in_bad, in_good = Counter(w for b in bad for w in b), Counter(w for b in good for w in b)
    witness = _cover(bad, in_bad, in_good)
    if not witness:
        return Model(None)
    # frequent words first; words that only one bag has are mostly chance
    witness = [w for w in witness if in_bad[w] >= 2] or witness
    # words that many bad bags have next to none of the good ones stand for them too, covered or not
    witness += sorted(w for w, n in in_bad.items() if n >= 5 and 20 * n >= len(bad) and 50 * in_good[w] <= n and len(w) > 3 and w not in set(witness))
    kernel = Kernel()
    stands = set(witness)
    # pieces of fewer than three signs have no triple; those of bad bags nearly alone are not good ones
    clean = sorted((w for w in in_good if len(w) >= 3 and 50 * in_good[w] > in_bad[w] and w not in stands), key=lambda w: (-in_good[w], w))
    marks = witness[:LANDMARKS] + clean[:CLEAN_LANDMARKS]
    negatives = list(dict.fromkeys(clean[:2000] + clean[:: max(1, len(clean) // 6000)]))  # to begin with
    words = sorted(set(in_bad) | set(in_good))
    for k in range(rounds + 1):
        dense = kernel.dense(marks, cut=False)
        values, vectors = np.linalg.eigh((dense.T @ dense).astype(np.float64))
        keep = values > 1e-4 * values[-1]
        root = vectors[:, keep] / np.sqrt(values[keep])  # Nystroem: k(x, landmarks) @ root
        gapped = list(dict.fromkeys(v for w in witness for v in inserted(w) if not in_good[v]))
        xp, xn = (kernel.against(side, dense, cut=False) @ root for side in (witness + gapped, negatives))
        have = set(negatives)
        while True:
            w, bias = _svm(np.vstack([xp, xn]), np.r_[np.ones(len(xp)), -np.ones(len(xn))], len(clean))
            out = root @ w
            model = Model(np.concatenate([dense[at : at + 4096] @ out for at in range(0, len(dense), 4096)]), bias)  # not all of dense at once in 64 bits
            z = dict(zip(words, model.values(kernel, words).tolist(), strict=True))
            left = sorted((x for x in clean if z[x] > -1 and x not in have), key=lambda x: (-z[x], x))
            if not left or k < rounds:
                break
            negatives += left
            have.update(left)
            xn = np.vstack([xn, kernel.against(left, dense, cut=False) @ root])
        if k == rounds:
            break
        # open bags are stood for by their worst word, if the machine is close to taking it for one
        stood = set(witness)
        for b in bad:
            if stood.isdisjoint(b):
                x = max((x for x in b if len(x) > 3 and not in_good[x]), key=lambda x: (z[x], x), default=None)
                if x is not None and z[x] > -0.6:
                    witness.append(x)
        witness = list(dict.fromkeys(witness))
        # good words nearest to the bad side become landmarks
        negatives += left
        marks += [x for x in left if x not in set(marks)][:HARD_LANDMARKS]
    zb = [np.array([max((z[x] for x in b), default=bias) for b in side]) for side in (good, bad)]
    lo, hi = np.sort(zb[0]), np.sort(zb[1])
    cuts = np.unique(np.r_[lo, hi])
    cuts = np.r_[cuts[0] - 1, (cuts[1:] + cuts[:-1]) / 2, cuts[-1] + 1]
    # a clean document lost and a toxic one missed weigh alike, as there are so many of either
    errors = (len(lo) - np.searchsorted(lo, cuts)) + np.searchsorted(hi, cuts)
    best = cuts[errors == errors.min()]
    cut = float((best[0] + best[-1]) / 2)
    slope = 4.0 / max(0.05, float(np.median(hi) - cut))
    return Model(model.v, bias, slope, cut - math.log(THRESHOLD / (1 - THRESHOLD)) / slope)


def labelled_sample(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> DataFrame:
    """(text, label) of at most so many labelled documents of either kind.

    The ids are chosen from the labels alone; that list is within the bound, so it is broadcast to the scan of the texts.
    """
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    ids = None
    for y, n in ((1, toxic), (0, clean)):
        part = one.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        ids = part if ids is None else ids.unionByName(part)
    return docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id").select("text", "label")


def fit(docs: DataFrame, labels: DataFrame, **bounds) -> Model:
    """The machine of the labelled sample, trained in a task: the driver holds neither texts nor landmarks, only weights."""
    sample = labelled_sample(docs, labels, **bounds).repartition(1)
    small_batches(sample.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = train([row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)])
        one = [None if m.v is None else m.v.astype(np.float64).tobytes()], [float(m.bias)], [float(m.slope)], [float(m.shift)]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(one, [pa.binary()] + 3 * [pa.float64()], strict=True)], ["v", "bias", "slope", "shift"])

    for r in sample.mapInArrow(run, "v binary, bias double, slope double, shift double").collect():
        return Model(None if r.v is None else np.frombuffer(r.v), r.bias, r.slope, r.shift)
    return Model(None)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score)."""
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), _scorer(model), "doc_id long, score double")


def _scorer(model: Model):
    def make():
        kernel, known = Kernel(), {}

        def f(c):
            if model.v is None:
                return {"doc_id": c["doc_id"], "score": [0.0] * len(c["doc_id"])}
            bags = [set(words_of(t)) for t in c["text"]]
            if len(known) > KEEP_WORDS:
                known.clear()
            fresh = list(set().union(*bags).difference(known))
            known.update(zip(fresh, model.decide(kernel, fresh).tolist(), strict=True))
            z = np.array([max(map(known.__getitem__, b), default=-math.inf) for b in bags])
            return {"doc_id": c["doc_id"], "score": model.probability(z).tolist()}

        return f

    return make


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""

    def make():
        f = _scorer(model)()
        return lambda texts: [s < threshold for s in f({"doc_id": texts, "text": texts})["score"]]

    return filter_texts(docs, "text", make)


def held_out(doc_id: Column) -> Column:
    return crc32_mod(doc_id, 3) == 1


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
