"""N-gram Jaccard join by parity sketches.

A text's set of word n-grams is hashed; texts with equal sets are one class from here on. Two sets of at least the
given similarity lie in one size band, and their symmetric difference is bounded by the band's sizes. Each set becomes
a bit sketch in which every n-gram flips one bit, so that the Hamming distance of two sketches is at most the symmetric
difference.

Candidates come from blocks of a wide sketch. It is cut into more blocks than the bound: two sets within the bound agree
in more than the surplus, so by the pigeonhole principle they agree in one of the blocks that are left when each set
drops the surplus, provided all sets drop by one order of the blocks' contents. Blocks that hold few n-grams go first:
an empty block, or one n-gram of a passage that many texts share, brings nobody together. Those who meet under a key
(band, block, content) are compared with a representative of their key: first by a sketch of about a bit an n-gram,
whose Hamming distance rules most pairs out, then by their sets. Links are grouped into components. Where a key of three
members or more still joins several components, these members meet again by the rarest blocks of finer sketches, and
pairs across components are compared in the same two steps.

The texts are read once: that pass leaves a table of each document's class and of packed keys (a task sends the reducers
of a key range one row of sorted numbers). A text of thousands of copies is one class and a key with many near copies is
a run of numbers; no pair of a key's members is written out but those with its representative and those of different
components that share a rare block.

Defined cases: null, empty and blank texts have no n-grams, are linked with nothing and stand for themselves; a text of
fewer words than n has one n-gram of them all; a document is a row, so rows that share an id are one document only if
their texts are equal, and each text of an id has its own links; rows without an id link but name no component and
``keep_one`` leaves them; a text's set is held in memory as a whole (8 bytes a word); an empty table gives an empty
result; other columns are ignored, and pass ``keep_one`` whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelens.llm.common import SharedTables, even_labels, fresh_name, key_ranges, map_batches, small_batches, tidy_shuffles
from tracelens.session import ensure_checkpoint_dir

NGRAM, PERCENT = 5, 80
SEED = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text whose sets are worked on at once, and keys that a task gathers for a row of the shuffle.
PORTION, FLUSH = 1 << 20, 1_500_000
#: Surplus of a sketch's blocks over those that two similar sets can differ in, as a share; blocks of a fine sketch likewise, as a factor.
SURPLUS, FINE = 0.3, 2
#: Texts to fetch, three numbers each, that are broadcast to the scan at most: a few MB.
BROADCAST_ROWS = 100_000
#: Bits of a block of the wide sketch.
BITS = 1 << 31


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (public-domain splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sets:
    """The sets of n-grams of some texts: sorted distinct 64-bit hashes, text i's at hashes[start[i] : start[i + 1]]."""

    def __init__(self, hashes: np.ndarray, start: np.ndarray):
        self.hashes, self.start = hashes, start
        self.size = np.diff(start)
        self.of = np.repeat(np.arange(len(self.size)), self.size)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.hashes[self.start[i] : self.start[i + 1]]

    def digests(self) -> np.ndarray:
        """Each set's class: 63 bits, from two independent folds of its hashes and its size; -1 for the empty set."""
        out = np.full(len(self.size), -1, np.int64)
        full = np.flatnonzero(self.size)
        if len(full):
            at = self.start[full]
            with np.errstate(over="ignore"):
                a = np.bitwise_xor.reduceat(_mix(self.hashes + np.uint64(11)), at)
                b = np.add.reduceat(_mix(self.hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at)
                out[full] = (_mix(a * SEED + b + self.size[full].astype(np.uint64)) >> np.uint64(1)).astype(np.int64)
        return out

    def sketches(self) -> list[bytes]:
        """Parity sketches: each n-gram flips one of m bits, m the power of two from the set's size on (64 at least)."""
        m = np.int64(1) << np.maximum(6, np.ceil(np.log2(np.maximum(self.size, 1))).astype(np.int64))
        base = np.cumsum(m) - m
        bit = (_mix(self.hashes ^ np.uint64(0x5851F42D4C957F2D)) & (m - 1).astype(np.uint64)[self.of]).astype(np.int64)
        odd = np.packbits((np.bincount(base[self.of] + bit, minlength=int(m.sum())) & 1).astype(np.uint8)).tobytes()
        return [odd[a // 8 : (a + n) // 8] for a, n in zip(base.tolist(), m.tolist(), strict=True)]


_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_FOLDED = _mix((np.arange(256) + 32 * ((np.arange(256) >= 65) & (np.arange(256) <= 90)) + 1).astype(np.uint64) * SEED)  # A-Z as a-z
_BASE = np.uint64(0x9E6C63D0876A9A99)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 2**64))


class Hasher:
    """Texts to sets of n-grams, by array operations over a concatenation."""

    def __init__(self, n: int):
        self.n = n
        self.powers = self.inverse = np.ones(1, np.uint64)

    def words(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of each word: a polynomial of its bytes, by differences of prefix sums."""
        starts, hashes, at = [], [], 0
        while at < len(data):
            to = min(len(data), at + PORTION)
            while to < len(data) and not _BLANK[data[to - 1]]:  # cut after a blank: the last one here, or the next one
                last = np.flatnonzero(_BLANK[data[at:to]])
                if len(last):
                    to = at + int(last[-1]) + 1
                else:
                    to = min(len(data), to + PORTION)
            part = data[at:to]
            if len(self.powers) <= len(part):
                with np.errstate(over="ignore"):
                    self.powers = np.r_[np.uint64(1), np.cumprod(np.full(len(part), _BASE, np.uint64))]
                    self.inverse = np.r_[np.uint64(1), np.cumprod(np.full(len(part), _BASE_INV, np.uint64))]
            edge = np.flatnonzero(np.diff(_BLANK[part].astype(np.int8), prepend=1, append=1))
            lo, hi = edge[::2], edge[1::2]
            with np.errstate(over="ignore"):
                total = np.zeros(len(part) + 1, np.uint64)
                np.cumsum(_FOLDED[part] * self.powers[: len(part)], out=total[1:])
                hashes.append(_mix((total[hi] - total[lo]) * self.inverse[lo]))
            starts.append(lo + at)
            at = to
        return (np.concatenate(starts), np.concatenate(hashes)) if starts else (np.empty(0, np.int64), np.empty(0, np.uint64))

    def sets(self, texts: list[bytes | None]) -> Sets:
        n = self.n
        first = np.cumsum([0] + [len(t or b"") + 1 for t in texts])
        start, h = self.words(np.frombuffer(b"".join(x for t in texts for x in (t or b"", b" ")), np.uint8))
        cuts = np.searchsorted(start, first)
        count = np.diff(cuts)
        of = np.repeat(np.arange(len(texts)), count)
        length = np.minimum(count, n)[of]  # words of the n-gram: fewer than n where the text has fewer
        whole = np.flatnonzero(cuts[1:][of] - np.arange(len(h)) >= length)
        length = length[whole]
        out = length.astype(np.uint64)
        with np.errstate(over="ignore"):
            for i in range(n):
                if (length > i).all():
                    out = _mix(out * SEED + h[whole + i])
                else:
                    on = np.flatnonzero(length > i)
                    out[on] = _mix(out[on] * SEED + h[whole[on] + i])
        of = of[whole]
        order = np.lexsort((out, of))
        out, of = out[order], of[order]
        fresh = np.ones(len(out), bool)
        fresh[1:] = (out[1:] != out[:-1]) | (of[1:] != of[:-1])
        return Sets(out[fresh], np.searchsorted(of[fresh], np.arange(len(texts) + 1)))


def portions(texts: list[bytes | None], limit: int = PORTION):
    """(from, to) of runs of texts of about so many bytes; a longer text is a run of its own."""
    at = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t or b"") > limit:
            yield at, i
            at, held = i, 0
        held += len(t or b"")
    if at < len(texts):
        yield at, len(texts)


class Bands:
    """Size bands and their bounds for a similarity of percent / 100."""

    def __init__(self, percent: int):
        self.percent, self.ratio = percent, 100 / percent
        edges = [1]
        while edges[-1] < 2**40:
            edges.append(max(edges[-1] + 1, math.floor(edges[-1] * self.ratio) + 1))
        self.edges = np.array(edges, np.int64)
        self.bounds = np.array([self._bound(k) for k in range(len(edges) - 2)], np.int64)

    def own(self, sizes: np.ndarray) -> np.ndarray:
        """A set joins its own band and the one below (-1: none), so that two sets of near sizes share a band."""
        return np.searchsorted(self.edges, sizes, side="right") - 1

    def _bound(self, band: int) -> int:
        """The largest symmetric difference of two similar sets that share the band.

        |A ^ B| <= (|A| + |B|) (100 - p) / (100 + p). The sizes are below the end of the upper of the two ranges, and a
        set of the lower range links with none beyond 100 / p of its own size.
        """
        low, top = int(self.edges[band + 1]) - 1, int(self.edges[band + 2]) - 1
        return max((2 * low) * (100 - self.percent) // (100 + self.percent), (low + min(top, low * 100 // self.percent)) * (100 - self.percent) // (100 + self.percent))


def block_contents(sets: Sets, band: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, weight, content) of each block of each set's sketch for its band; sets of band -1 have none.

    A block has BITS bits, so that unlike n-grams hardly ever meet in one. They are kept as the XOR of a hash for each
    n-gram's bit, which stands for their content; two n-grams on one bit cancel out, as parity has it. The weight is the
    number of n-grams that fell into the block.
    """
    blocks = np.where(band < 0, 0, blocks)
    base = np.cumsum(blocks) - blocks
    on = blocks[sets.of] > 0
    s, of = sets.hashes[on], sets.of[on]
    with np.errstate(over="ignore"):
        x = _mix(s ^ (band + 1).astype(np.uint64)[of])
        block = (x >> np.uint64(32)) * blocks.astype(np.uint64)[of] >> np.uint64(32)
        sig = _mix((block << np.uint64(32)) + (x & np.uint64(BITS - 1)) + np.uint64(1))
        slot = base[of] + block.astype(np.int64)
        total = int(blocks.sum())
        weight = np.bincount(slot, minlength=total)
        acc = np.zeros(total, np.uint64)
        np.bitwise_xor.at(acc, slot, sig)
        owner = np.repeat(np.arange(len(blocks)), blocks)
        number = (np.arange(total) - base[owner] + 1).astype(np.uint64)
        content = _mix(acc + number * SEED + band.astype(np.uint64)[owner] * np.uint64(0xD6E8FEB86659FD93))
    return owner, weight, content


def block_keys(sets: Sets, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(set, key): for each of a set's bands, the bound + 1 heaviest of its blocks; equal weights go by content."""
    owners, keys = [], []
    own = bands.own(sets.size)
    for band in (np.where(sets.size > 0, own, -1), np.where(sets.size > 0, own - 1, -1)):
        need = np.where(band < 0, 0, bands.bounds[band] + 1)
        owner, weight, content = block_contents(sets, band, need + np.ceil(SURPLUS * need).astype(np.int64))
        order = np.lexsort((content, -weight, owner))
        owner, content = owner[order], content[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, np.arange(len(need)))[owner]
        first = place < need[owner]
        owners.append(owner[first])
        keys.append(content[first])
    return np.concatenate(owners), np.concatenate(keys)


#: Bytes of a key that travel: the highest seven. A chance equality costs one comparison of sketches.
KEY_BYTES = 7


def _planes(keys: np.ndarray) -> bytes:
    """Keys byte by byte, high bytes first: those of sorted keys compress."""
    return np.ascontiguousarray(keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    x = np.frombuffer(data, np.uint8).reshape(KEY_BYTES, -1)
    out = np.zeros((x.shape[1], 8), np.uint8)
    out[:, :KEY_BYTES] = x.T
    return out.reshape(-1).view(">u8").astype(np.uint64)


_READ = "doc_id long, text_hash long, cls long, n long, sketch binary, bucket int, keys binary, owners binary, classes binary"


def read_texts(docs: DataFrame, n: int, percent: int, buckets: int) -> DataFrame:
    """The pass over the texts. Rows without a bucket are documents, with the sketch where a task first meets their class;
    rows with one hold sorted keys of a key range, the number of each key's class, and the classes."""
    small_batches(docs.sparkSession)
    labels = even_labels(buckets)
    names = [x.split()[0] for x in _READ.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]

    def rows(count: int, **cols) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cols[k], t) if k in cols else pa.nulls(count, t) for k, t in zip(names, types, strict=True)], names=names)

    def run(batches):
        hasher, bands = Hasher(n), Bands(percent)
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0

        def flush():
            k, o = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((o, k))
            k, o = k[order], o[order]
            b = ((k >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            cuts = np.searchsorted(b, np.arange(buckets + 1))
            full = [i for i in range(buckets) if cuts[i] < cuts[i + 1]]
            keys, owners, classes = [], [], []
            for i in full:
                table, number = np.unique(o[cuts[i] : cuts[i + 1]], return_inverse=True)
                keys.append(_planes(k[cuts[i] : cuts[i + 1]]))
                owners.append(number.astype(np.uint16 if len(table) <= 1 << 16 else np.uint32).tobytes())
                classes.append(table.tobytes())
            return rows(len(full), bucket=[labels[i] for i in full], keys=keys, owners=owners, classes=classes)

        for batch in batches:
            ids, marks = batch.column(0), batch.column(1)
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for lo, hi in portions(texts):
                sets = hasher.sets(texts[lo:hi])
                cls = sets.digests()
                first = np.zeros(len(cls), bool)
                for i, c in enumerate(cls.tolist()):
                    if c >= 0 and c not in seen:  # a copy within the task adds nothing
                        seen.add(c)
                        first[i] = True
                sketches = [s if f else None for s, f in zip(sets.sketches(), first.tolist(), strict=True)]
                yield rows(hi - lo, doc_id=ids[lo:hi], text_hash=marks[lo:hi], cls=cls, n=sets.size, sketch=sketches)
                some = Sets(sets.hashes[first[sets.of]], np.r_[0, np.cumsum(sets.size[first])])
                owner, k = block_keys(some, bands)
                held.append((k, cls[first][owner]))
                count += len(k)
                if count > FLUSH:
                    yield flush()
                    held, count = [], 0
                if len(seen) > 1_000_000:
                    seen.clear()
        if count:
            yield flush()

    return docs.mapInArrow(run, _READ)


def meetings(packed: DataFrame, tasks: int) -> DataFrame:
    """(key, cls, rep): every class that meets another under a key, with the key's least class."""

    def run(batches):
        keys, owners = [], []
        for b in batches:
            for x, y, z in zip(*(b.column(c).to_pylist() for c in ("keys", "owners", "classes")), strict=True):
                keys.append(_from_planes(x))
                owners.append(np.frombuffer(z, np.int64)[np.frombuffer(y, np.uint16 if len(y) == 2 * len(keys[-1]) else np.uint32)])
        if not keys:
            return
        k, o = np.concatenate(keys), np.concatenate(owners)
        del keys, owners
        order = np.argsort(k)
        k = k[order]
        alike = np.zeros(len(k), bool)  # most keys are of one class and need no further order
        alike[1:] = k[1:] == k[:-1]
        alike[:-1] |= alike[1:]
        k, o = k[alike], o[order[alike]]
        if not len(k):
            return
        order = np.lexsort((o, k))
        k, o = k[order], o[order]
        fresh = np.r_[True, (k[1:] != k[:-1]) | (o[1:] != o[:-1])]  # a class once a key
        k, o = k[fresh], o[fresh]
        start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        size = np.diff(np.r_[start, len(k)])
        many = np.repeat(size >= 2, size)
        rep = np.repeat(o[start], size)
        k, o, rep = k[many], o[many], rep[many]
        for at in range(0, len(k), 100_000):
            to = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(k[to].view(np.int64)), pa.array(o[to]), pa.array(rep[to])], names=["key", "cls", "rep"])

    return packed.select("bucket", "keys", "owners", "classes").repartition(tasks, "bucket").mapInArrow(run, "key long, cls long, rep long")


def hamming(a: bytes, b: bytes) -> int:
    """The distance of two parity sketches; the longer is folded to the shorter one's size, which keeps parity."""
    while len(a) > len(b):
        a = _fold(a)
    while len(b) > len(a):
        b = _fold(b)
    return (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()


def _fold(x: bytes) -> bytes:
    """A sketch of half the bits: bit numbers lose their highest digit."""
    h = len(x) // 2
    return (int.from_bytes(x[:h]) ^ int.from_bytes(x[h:])).to_bytes(h)


def near_by_sketch(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that can be similar by their sizes and sketches; known is (cls, n, sketch)."""
    for side in ("b", "a"):  # the side with few members a key last, where large runs are split
        pairs = pairs.join(known.select(F.col("cls").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}")), side)
    sized = pairs.where(F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b"))

    def make():
        def f(c):
            # Hamming distance <= symmetric difference <= (|A| + |B|) (100 - p) / (100 + p)
            ok = [(100 + percent) * hamming(s, t) <= (100 - percent) * (m + n) for m, n, s, t in zip(c["n_a"], c["n_b"], c["s_a"], c["s_b"], strict=True)]
            return {k: [x for x, y in zip(c[k], ok, strict=True) if y] for k in ("a", "b")}

        return f

    return map_batches(sized.select("a", "b", "n_a", "n_b", "s_a", "s_b"), make, "a long, b long")


#: Words of the sketch that pairs are compared by within the join of rare blocks.
WORDS = 16


def rare_meetings(members: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that can be similar; members is (cls, text, comp).

    A fine sketch has FINE times (bound + 1) blocks, of which two similar sets differ in ``bound`` at most. So in any one
    order of all block contents, the first bound + 1 of either set have one in common. With the rarest first, sets that
    share only what a whole family of near copies shares do not meet. Those that meet are compared by a bit sketch.
    """

    def make():
        hasher, bands = Hasher(n), Bands(percent)

        def f(c):
            out = {"cls": [], "comp": [], "n": [], "band": [], "need": [], "blocks": [], "sketch": []}
            for lo, hi in portions(c["text"]):
                sets = hasher.sets(c["text"][lo:hi])
                bits = (_mix(sets.hashes ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(64 * WORDS - 1)).astype(np.int64)
                odd = (np.bincount(sets.of * 64 * WORDS + bits, minlength=(hi - lo) * 64 * WORDS) & 1).astype(np.uint8)
                sketch = np.packbits(odd).view(np.int64).reshape(hi - lo, WORDS)
                own = bands.own(sets.size)
                for band in (own, own - 1):
                    need = np.where(band < 0, 0, bands.bounds[band] + 1)
                    owner, _, content = block_contents(sets, band, FINE * need)
                    cuts = np.searchsorted(owner, np.arange(hi - lo + 1))
                    for i in np.flatnonzero(band >= 0).tolist():
                        for k, v in zip(out, (c["cls"][lo + i], c["comp"][lo + i], int(sets.size[i]), int(band[i]), int(need[i]), content[cuts[i] : cuts[i + 1]].view(np.int64), sketch[i]), strict=True):
                            out[k].append(v)
            return out

        return f

    rows = map_batches(members.select("cls", "comp", "text"), make, "cls long, comp long, n long, band int, need int, blocks array<long>, sketch array<long>", binary=("text",)).checkpoint()
    fine = rows.select("cls", "comp", "band", "need", F.explode("blocks").alias("block"))
    common = fine.groupBy("block").agg(F.count("*").alias("times"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    order = Window.partitionBy("cls", "band").orderBy("times", "block")
    first = fine.join(common, "block").withColumn("r", F.row_number().over(order)).where("r <= need and lo <> hi").select("cls", "band", "block")
    met = first.join(rows.select("cls", "band", "comp", "n", *[F.col("sketch")[k].alias(f"s{k}") for k in range(WORDS)]), ["cls", "band"])
    x = met.select("block", *[F.col(c).alias(f"a_{c}") for c in met.columns if c != "block"])
    y = met.select("block", *[F.col(c).alias(f"b_{c}") for c in met.columns if c != "block"])
    apart = sum((F.bit_count(F.col(f"a_s{k}").bitwiseXOR(F.col(f"b_s{k}"))) for k in range(WORDS)), F.lit(0))
    # Hamming distance <= symmetric difference <= (|A| + |B|) (100 - p) / (100 + p)
    near = (F.col("a_comp") < F.col("b_comp")) & (F.lit(100 + percent) * apart <= F.lit(100 - percent) * (F.col("a_n") + F.col("b_n")))
    return x.join(y, "block").where(near).select(F.least("a_cls", "b_cls").alias("a"), F.greatest("a_cls", "b_cls").alias("b")).distinct()


def verify(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar enough; texts is (cls, text), one text a class."""
    left = pairs.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("b_text")), "b")
    both = left.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("a_text")), "a")

    def make():
        hasher = Hasher(n)
        last: list = [None, None]

        def f(c):
            out = {"a": [], "b": []}
            for lo, hi in portions(c["b_text"]):
                sets = hasher.sets(c["b_text"][lo:hi])
                for i in range(lo, hi):
                    if last[0] != c["a"][i]:
                        last[:] = c["a"][i], hasher.sets([c["a_text"][i]])[0]
                    x, y = last[1], sets[i - lo]
                    both = np.sort(np.concatenate([x, y]))
                    common = int((both[1:] == both[:-1]).sum())
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        out["a"].append(c["a"][i])
                        out["b"].append(c["b"][i])
            return out

        return f

    return map_batches(both.select("a", "b", "a_text", "b_text"), make, "a long, b long", binary=("a_text", "b_text"))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(cls, comp): the least class reachable over links (a, b). Least labels with pointer jumping, cut off each round."""
    edges = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).select(F.col("a").alias("cls"), "comp").checkpoint()
    for _ in range(rounds):
        near = edges.join(labels.select(F.col("cls").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "cls"), "cls", "left").select("cls", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        up = labels.select(F.col("cls").alias("comp"), F.col("comp").alias("upper"))
        nxt = step.join(up, "comp", "left").select("cls", "old", F.least("comp", "upper").alias("comp")).checkpoint()
        moved = nxt.where("old <> comp").limit(1).count()
        labels = nxt.select("cls", "comp")
        if not moved:
            return labels
    raise RuntimeError("components did not settle")


def linked_rows(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id) for each row of docs (doc_id, text); text_hash is xxhash64 of the text."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    tables = SharedTables(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    buckets = key_ranges(docs)
    with tidy_shuffles(spark):
        read = tables.keep(read_texts(rows, n, percent, buckets), "read")
        member = read.where("bucket is null").select("doc_id", "text_hash", "cls", "n", "sketch")
        met = tables.keep(meetings(read.where("bucket is not null"), buckets), "met")

        wanted = met.select("cls").distinct()
        shared = member.where("cls >= 0").groupBy("cls").agg(F.min(F.struct("doc_id", "text_hash")).alias("row"), F.first("n").alias("n"), F.max("sketch").alias("sketch"))
        known = tables.keep(shared.join(wanted, "cls").select("cls", "row.*", "n", "sketch"), "known")
        places = known.select("cls", F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash"))
        if known.count() <= BROADCAST_ROWS:  # beyond it the texts are shuffled
            places = F.broadcast(places)
        texts = tables.keep(rows.join(places, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("text_hash") == F.col("k_hash"))).select("cls", "text").dropDuplicates(["cls"]), "texts")

        star = met.where("cls <> rep").select(F.col("rep").alias("a"), F.col("cls").alias("b")).distinct()
        near = tables.keep(near_by_sketch(star, known, percent), "near")
        links = tables.keep(verify(near, texts, n, percent), "links")
        comp = components(links)

        # classes under keys that still hold several components meet again, across these
        crowded = met.groupBy("key").agg(F.count("*").alias("members")).where("members > 2")
        owned = crowded.join(met.select("key", "cls"), "key").join(comp, "cls", "left").select("key", "cls", F.coalesce("comp", "cls").alias("comp"))
        spread = owned.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
        still = owned.join(spread, "key").select("cls", "comp").distinct()
        across = rare_meetings(texts.join(still, "cls"), n, percent).join(near, ["a", "b"], "left_anti")
        more = tables.keep(verify(near_by_sketch(across, known, percent), texts, n, percent), "more")
        if more.limit(1).count():
            comp = components(links.unionByName(more))

        least = member.where("cls >= 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
        of_class = comp.join(least, "cls")
        named = of_class.groupBy("comp").agg(F.min("least").alias("component_id"))
        of_class = of_class.join(named, "comp").select("cls", "component_id")
        alone = least.join(of_class, "cls", "left").select("cls", F.coalesce("component_id", "least").alias("component_id"))
        out = member.join(alone, "cls", "left").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")).checkpoint()
    tables.drop()
    return out


def near_duplicates(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest doc_id that is reachable over links of the given similarity."""
    return linked_rows(docs, n, percent).drop("text_hash")


def keep_one(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """The documents without those that are linked, directly or not, to one with a smaller id."""
    rest = linked_rows(docs, n, percent).where("component_id <> doc_id")
    i, h = (fresh_name(docs, x) for x in ("nd_doc", "nd_hash"))
    rest = rest.select(F.col("doc_id").alias(i), F.col("text_hash").alias(h)).distinct()
    return docs.join(rest, (docs["doc_id"].cast("long") == rest[i]) & (F.xxhash64(docs["text"].cast("string")) == rest[h]), "left_anti")


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 90)


SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + least(3, len(w)) - 1], ' ') as g from (select doc_id, w, unnest(range(1, (len(w) - least(3, len(w)) + 2)::bigint)) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from p join n x on a = x.doc_id join n y on b = y.doc_id where 100 * c >= 90 * (x.n + y.n - c)),
e as (select a, b from l union select b, a from l),
r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a),
c as (select a, min(b) as m from r group by a)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(w.doc_id, coalesce(c.m, w.doc_id)) as component_id
from w left join n using (doc_id) left join c on c.a = w.doc_id
"""
