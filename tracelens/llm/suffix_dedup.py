"""Removal of byte strings that a document with a smaller id also has, by suffix arrays.

Every byte covered by a string of 50 bytes that also starts in a document with a smaller id is removed. To bring equal
strings together without a suffix array of the whole corpus, each string of 50 bytes names its anchor: the least hash
among its 31 substrings of 20 bytes. The strings of one anchor are neighbours, so an anchor stands for its context, the
bytes that they cover together. Contexts meet under their anchor:

1. Anchors with one document end there. Equal contexts are one string of many documents; all but those of its smallest
   document are covered whole.
2. Where different contexts share an anchor, a string that two of them share starts at least 15 bytes before the anchor
   or at most as many: it has the 15 bytes before the anchor or the 15 bytes after it, and a hash of a byte for each
   side says which contexts may share one. The more texts there are, the more of them have an anchor in common by chance,
   and the sides tell these apart. Each string that is left is fetched once, and a suffix array by linear grouping
   (``suffix_sort``) puts equal strings of 50 bytes side by side; runs of them give each its smallest document. A large
   group is first cut by halves of the anchor's place within the string, each half keyed by the bytes that all its
   strings share, until the parts are small.

Anchors travel packed: a task sends one row for each slice of the keys. The reducers get their slices in order, sorted by
Spark, and hold one at a time; there are as many slices as the input's bytes ask for, so what a reducer holds does not
grow with the input. A context that a task has met in a smaller document is settled there and not sent, so copies cost
one row a task. Texts are taken by PORTION bytes, and a longer text in pieces of that size that overlap.

For the disk's sake, tables above PASS_BYTES are worked on in passes, each of which takes its share of the keys, and later
its share of the documents, and leaves a compressed table in the shared folder; its shuffle files go before the next one.

Defined cases: null texts are empty; texts below 50 bytes keep all; rows without an id are kept and cover nothing; rows
repeated under one id do not cover each other, whether their texts are equal or not, and each text of an id loses its
own bytes; an empty table gives an empty result; other columns pass ``clean``, whatever their names. The spans of one
text are held together, unmerged: at most 8 bytes for each 16 of the text.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelens.llm.common import RANGE_BYTES, SharedTables, even_labels, fresh_name, input_bytes, map_batches, small_batches, tidy_shuffles
from tracelens.llm.jaccard import _mix
from tracelens.llm.suffix_sort import _ranges, suffix_arrays
from tracelens.session import ensure_checkpoint_dir

LENGTH, CORE = 50, 20
#: Anchors that a task gathers before it hands them to the shuffle; bytes of a suffix array at most; bytes sorted in step.
FLUSH, BLOCK, IN_STEP = 400_000, 32_768, 1 << 20
#: Bytes of blocks that a task gathers from its slices before it compares them; texts that one id may have at most.
GATHER, MANY = 8 << 20, 1 << 31
#: Bytes of text whose anchors are found at once (places have 24 bits), and bytes of input for each slice of the keys.
PORTION, SLICE_BYTES = 1 << 19, 1 << 20
#: Bytes of input (as the planner sizes it) from which on there are PASSES passes.
PASS_BYTES, PASSES = 64 << 20, 2

_TABLE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0x9E6C63D0876A9A99 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 2**64))
_PLACE = np.uint64((1 << 24) - 1)
_HALF = np.uint64((1 << 32) - 1)


class Anchors:
    """Anchors of documents, by array operations over a concatenation."""

    def __init__(self, length: int = LENGTH, core: int = CORE):
        self.length, self.core = length, core
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.powers) < n:
            with np.errstate(over="ignore"):
                self.powers = np.r_[np.uint64(1), np.cumprod(np.full(n, _BASE, np.uint64))]
                self.inverse = np.r_[np.uint64(1), np.cumprod(np.full(n, _BASE_INV, np.uint64))]

    def _slide(self, x: np.ndarray, width: int, f) -> np.ndarray:
        """f over windows of `width`, by doubling."""
        have, out = 1, x
        while have < width:
            step = min(have, width - have)
            out = f(out[: len(out) - step], out[step:])
            have += step
        return out

    def find(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """(doc, lo, span, key, ctx, at, sides) for each anchor: its document's index, its context's start, strings less one,
        place, and a hash of the bytes on either side of it (a byte each, 0 where no string has that side's)."""
        found = [self._find(*portion) for portion in self._portions(texts)]
        if not found:
            return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64), np.empty(0, np.uint16))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _portions(self, texts: list[bytes]):
        """(pieces, their documents, their places in these) of about PORTION bytes; pieces of one text overlap by less
        than a string, so that each string is in one of them."""
        pieces, held = [], 0
        for i, t in enumerate(texts):
            for at in range(0, max(1, len(t) - self.length + 1), PORTION):
                piece = t if len(t) <= PORTION else t[at : at + PORTION + self.length - 1]
                if held and held + len(piece) > PORTION:
                    yield tuple(zip(*pieces, strict=True))
                    pieces, held = [], 0
                if len(piece) >= self.length:
                    pieces.append((piece, i, at))
                    held += len(piece)
                if len(t) <= PORTION:
                    break
        if pieces:
            yield tuple(zip(*pieces, strict=True))

    def _find(self, pieces, docs, places) -> tuple[np.ndarray, ...]:
        length, core = self.length, self.core
        sizes = np.array([len(t) for t in pieces], np.int64)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(data)
        self._powers(n + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(_TABLE[data] * self.powers[:n], out=total[1:])
            h = _mix((total[core:] - total[: n - core + 1]) * self.inverse[: n - core + 1])
        start = np.cumsum(sizes) - sizes
        least = self._slide((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), length - core + 1, np.minimum)
        # string starts that stay in their piece, and runs of one anchor
        at, piece = _ranges(start, sizes - length + 1)
        anchor = (least & _PLACE).astype(np.int64)[at]
        first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])])
        lo = at[first]
        span = np.diff(np.r_[first, len(at)]) - 1
        a, piece = anchor[first], piece[first]
        hi = lo + span + length
        with np.errstate(over="ignore"):
            ctx = _mix((total[hi] - total[lo]) * self.inverse[lo])
            ctx = _mix(ctx + (hi - lo).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + (a - lo).astype(np.uint64))
        # strings that start up to `far` bytes before the anchor have all up to the right end, the others all from the left end
        far = (length - core) // 2
        left, right = np.maximum(lo, a - far), np.minimum(hi, a + length - far)
        sides = np.where(lo <= a - far, self._byte(total, left, a + core), 0) | np.where(lo + span >= a - far, self._byte(total, a, right), 0) << 8
        back = np.array(places, np.int64)[piece] - start[piece]
        return np.array(docs, np.int64)[piece], lo + back, span, h[a], ctx, a + back, sides.astype(np.uint16)

    def _byte(self, total: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """1 to 255, by the bytes lo..hi."""
        with np.errstate(over="ignore"):
            return (_mix((total[hi] - total[lo]) * self.inverse[lo]) % np.uint64(255)).astype(np.int64) + 1


_FINDER = Anchors()


def _bytes(x: np.ndarray, cuts: np.ndarray, rows: list[int]) -> pa.Array:
    return pa.array([x[cuts[i] : cuts[i + 1]].tobytes() for i in rows], pa.binary())


def _planed(x: np.ndarray, cuts: np.ndarray, rows: list[int]) -> pa.Array:
    """As ``_bytes``, but all first bytes come before all second ones: the upper bytes of small numbers are a run of 0."""
    planes = x.view(np.uint8).reshape(len(x), x.itemsize)
    return pa.array([planes[cuts[i] : cuts[i + 1]].T.tobytes() for i in rows], pa.binary())


def _unplaned(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


class Slices:
    """Keys are dealt to slices by their lower half, and runs of ``each`` slices to the same task.

    Anchors are least hashes, so their upper halves lie close to 0 and would fill the first slices. As the slice stands
    for the lower half, the upper half is all of a key that is sent; keys that only differ in what is lost meet as one,
    which ``compare`` tells apart.
    """

    def __init__(self, tasks: int, size: int | None):
        tasks = max(tasks, -(-(size or 0) // RANGE_BYTES))
        self.each = max(1, -(-(size or 0) // (SLICE_BYTES * tasks)))
        self.tasks, self.count, self.labels = tasks, tasks * self.each, even_labels(tasks)

    def of(self, keys: np.ndarray) -> np.ndarray:
        return ((keys & _HALF) * np.uint64(self.count) >> np.uint64(32)).astype(np.int64)

    def key(self, upper: np.ndarray, number: int) -> np.ndarray:
        """Keys of a slice from their upper halves."""
        return upper.astype(np.uint64) << np.uint64(32) | np.uint64(-(-(number << 32) // self.count))

    def rows(self, slices: np.ndarray) -> tuple[list[int], np.ndarray, list[pa.Array]]:
        """From sorted slice numbers: the slices that have any, where each begins, and the columns (bucket, slice)."""
        cuts = np.searchsorted(slices, np.arange(self.count + 1))
        full = np.flatnonzero(np.diff(cuts)).tolist()
        return full, cuts, [pa.array([self.labels[i // self.each] for i in full], pa.int32()), pa.array(full, pa.int64())]

    def deal(self, packed: DataFrame) -> DataFrame:
        return packed.repartition(self.tasks, "bucket").sortWithinPartitions("slice")


def _runs(batches, column: str = "slice"):
    """Rows as dicts, in lists of one slice each; rows come sorted."""
    held, now = [], None
    for b in batches:
        for row in b.to_pylist():
            if row[column] != now and held:
                yield held
                held = []
            now = row[column]
            held.append(row)
    if held:
        yield held


_PACKED = "bucket int, slice long, keys binary, ctx binary, sides binary, docs binary, nos binary, lo binary, span binary, base long, wide boolean"


def packed_anchors(docs: DataFrame, slices: Slices, part: int = 0, parts: int = 1) -> DataFrame:
    """Anchors by slice; rows without keys hold contexts already settled within the task (docs, lo, span). Of ``parts``
    shares of the keys, by their upper halves, this is one."""
    small_batches(docs.sparkSession)

    def steps(x, cuts, full):
        out = np.diff(x, prepend=0)
        out[cuts[full]] = x[cuts[full]]
        return out

    def run(batches):
        finder = Anchors()
        held: list[tuple] = []
        count = 0

        def flush():
            doc, no, lo, span, key, ctx, sides = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((doc, ctx, key))
            doc, no, lo, span, key, ctx, sides = (x[order] for x in (doc, no, lo, span, key, ctx, sides))
            first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (ctx[1:] != ctx[:-1])])
            least = np.repeat(doc[first], np.diff(np.r_[first, len(doc)]))
            settled = doc > least
            base = int(doc.min())
            wide = np.int64 if int(doc.max()) - base >= 1 << 32 else np.uint32
            # grouped by slice, by document within, each of these as its distance to the one before
            for rows, sign in ((np.flatnonzero(settled), -1), (np.flatnonzero(~settled), 1)):
                if not len(rows):
                    continue
                b = slices.of(key[rows])
                order = np.lexsort((lo[rows], doc[rows], b))
                rows = rows[order]
                full, cuts, where = slices.rows(b[order])
                empty = pa.array([b""] * len(full), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        *where,
                        _bytes((key[rows] >> np.uint64(32)).astype(np.uint32), cuts, full) if sign > 0 else empty,
                        _bytes(ctx[rows], cuts, full) if sign > 0 else empty,
                        _bytes(sides[rows], cuts, full) if sign > 0 else empty,
                        _planed(steps(doc[rows] - base, cuts, full).astype(wide), cuts, full),
                        _bytes(no[rows], cuts, full) if no[rows].any() else empty,
                        _planed(lo[rows], cuts, full),
                        _bytes(span[rows], cuts, full),
                        pa.array([base] * len(full), pa.int64()),
                        pa.array([wide is np.int64] * len(full), pa.bool_()),
                    ],
                    names=["bucket", "slice", "keys", "ctx", "sides", "docs", "nos", "lo", "span", "base", "wide"],
                )

        for batch in batches:
            ids, nos = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            doc, lo, span, key, ctx, _, sides = finder.find(batch.column(2).cast(pa.binary()).to_pylist())
            if parts > 1:
                mine = (key >> np.uint64(32)) % np.uint64(parts) == np.uint64(part)
                doc, lo, span, key, ctx, sides = (x[mine] for x in (doc, lo, span, key, ctx, sides))
            for at in range(0, len(doc), FLUSH):
                to = slice(at, at + FLUSH)
                held.append((ids[doc[to]], nos[doc[to]].astype(np.int32), lo[to].astype(np.uint32), span[to].astype(np.uint8), key[to], ctx[to], sides[to]))
                count += len(doc[to])
                if count > FLUSH:
                    yield from flush()
                    held, count = [], 0
        if count:
            yield from flush()

    return docs.select("doc_id", "no", "text").where("doc_id is not null and text is not null").mapInArrow(run, _PACKED)


def _numbers(data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(data, np.int32).astype(np.int64) if data else np.zeros(count, np.int64)


def _several(key: np.ndarray, side: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether another document has the same key and side; keys are numbers from 0 up, and side 0 is none."""
    if not len(key):
        return np.zeros(0, bool)
    x = key.astype(np.int64) << 8 | side
    order = np.argsort(x, kind="stable")
    x, d = x[order], doc[order]
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    out = np.empty(len(x), bool)
    out[order] = np.repeat(np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first), np.diff(np.r_[first, len(x)]))
    return out & (side > 0)


def settle(packed: DataFrame, slices: Slices) -> DataFrame:
    """(doc_id, no, lo, hi, key): bytes lo..hi are covered where key is null; else they are to be compared under the key."""

    def unpack(row):
        docs = np.cumsum(_unplaned(row["docs"], np.int64 if row["wide"] else np.uint32).astype(np.int64)) + row["base"]
        return docs, _numbers(row["nos"], len(docs)), _unplaned(row["lo"], np.uint32).astype(np.int64), np.frombuffer(row["span"], np.uint8).astype(np.int64)

    def out(doc, no, lo, span, key):
        for at in range(0, len(doc), 100_000):
            to = slice(at, at + 100_000)
            keys = pa.nulls(len(doc[to]), pa.int64()) if key is None else pa.array(key[to].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(doc[to]), pa.array(no[to].astype(np.int32)), pa.array(lo[to].astype(np.int32)), pa.array((lo[to] + span[to] + LENGTH).astype(np.int32)), keys], names=["doc_id", "no", "lo", "hi", "key"])

    def run(batches):
        for rows in _runs(batches):
            held = []
            for row in rows:
                if not row["keys"]:
                    yield from out(*unpack(row), None)
                else:
                    held.append((*unpack(row), slices.key(np.frombuffer(row["keys"], np.uint32), row["slice"]), np.frombuffer(row["ctx"], np.uint64), np.frombuffer(row["sides"], np.uint16)))
            if held:
                yield from meet(*(np.concatenate(x) for x in zip(*held, strict=True)))

    def meet(doc, no, lo, span, key, ctx, sides):
        # keys of one document end here
        order = np.argsort(key, kind="stable")
        k, d = key[order], doc[order]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        shared = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
        keep = order[np.repeat(shared, np.diff(np.r_[first, len(k)]))]
        if not len(keep):
            return
        keep = keep[np.lexsort((doc[keep], ctx[keep], key[keep]))]
        doc, no, lo, span, key, ctx, sides = (x[keep] for x in (doc, no, lo, span, key, ctx, sides))
        new_key = np.r_[True, key[1:] != key[:-1]]
        first = np.flatnonzero(new_key | np.r_[True, ctx[1:] != ctx[:-1]])
        least = np.repeat(doc[first], np.diff(np.r_[first, len(doc)]))
        covered = doc > least
        yield from out(doc[covered], no[covered], lo[covered], span[covered], None)
        # several contexts under a key: fetch those of each context's smallest document
        key_no = np.cumsum(new_key) - 1
        many = np.bincount(key_no[first])[key_no] > 1
        ask = np.flatnonzero(many & ~covered)
        ask = ask[_several(key_no[ask], sides[ask] & 255, doc[ask]) | _several(key_no[ask], sides[ask] >> 8, doc[ask])]
        yield from out(doc[ask], no[ask], lo[ask], span[ask], key[ask])

    return packed.mapInArrow(run, "doc_id long, no int, lo int, hi int, key long")


def contexts(docs: DataFrame, asked: DataFrame, slices: Slices) -> DataFrame:
    """Bytes of the contexts asked for, packed by slice: (bucket, slice, keys, docs, nos, lo, size, data)."""
    joined = docs.join(asked, ["doc_id", "no"]).select("doc_id", "no", "text", "ask")

    def run(batches):
        keys, ids, nos, los, parts, held = [], [], [], [], [], 0

        def flush():
            k = np.array(keys, np.int64).view(np.uint64)
            b = slices.of(k)
            order = np.argsort(b, kind="stable")
            full, cuts, where = slices.rows(b[order])
            size = np.array([len(p) for p in parts], np.uint32)
            data = [b"".join([parts[x] for x in order[cuts[i] : cuts[i + 1]]]) for i in full]
            return pa.RecordBatch.from_arrays(
                [*where, _bytes(k[order], cuts, full), _bytes(np.array(ids, np.int64)[order], cuts, full), _bytes(np.array(nos, np.int32)[order], cuts, full), _bytes(np.array(los, np.uint32)[order], cuts, full), _bytes(size[order], cuts, full), pa.array(data, pa.binary())],
                names=["bucket", "slice", "keys", "docs", "nos", "lo", "size", "data"],
            )

        for b in batches:
            for i, no, t, ask in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist(), strict=True):
                for a in ask:
                    keys.append(a["key"])
                    ids.append(i)
                    nos.append(no)
                    los.append(a["lo"])
                    parts.append(t[a["lo"] : a["hi"]])
                held += len(ask)
                if held > FLUSH // 4:
                    yield flush()
                    keys, ids, nos, los, parts, held = [], [], [], [], [], 0
        if held:
            yield flush()

    return joined.mapInArrow(run, "bucket int, slice long, keys binary, docs binary, nos binary, lo binary, size binary, data binary")


def compare_blocks(blocks: list[tuple[list[bytes], list[int], list[int]]], many: int, emit) -> None:
    """Suffix arrays of blocks of (texts, owners, places); emit(owner, place) for strings a smaller document has.

    An owner is its document's rank times ``many`` plus the number of its text under that id.
    """
    blocks.sort(key=lambda b: sum(map(len, b[0])))
    at = 0
    while at < len(blocks):
        to, held = at, 0
        while to < len(blocks) and (to == at or held < IN_STEP):
            held += sum(map(len, blocks[to][0])) + len(blocks[to][0])
            to += 1
        _compare(blocks[at:to], many, emit)
        at = to


def _compare(blocks, many: int, emit) -> None:
    joined, doc_of, place_of, valid = [], [], [], []
    for texts, docs, places in blocks:
        joined.append(np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8))  # no byte of UTF-8
        for t, d, p in zip(texts, docs, places, strict=True):
            n = len(t) + 1
            doc_of.append(np.full(n, d, np.int64))
            place_of.append(np.arange(p, p + n))
            v = np.zeros(n, bool)
            v[: len(t) - LENGTH + 1] = True
            valid.append(v)
    order, base = suffix_arrays(joined)
    whole = np.concatenate(joined)
    flat = order + np.repeat(base, [len(x) for x in joined])  # places in `whole`, in the blocks' suffix order
    block = np.repeat(np.arange(len(joined)), [len(x) for x in joined])
    doc, place, ok = np.concatenate(doc_of), np.concatenate(place_of), np.concatenate(valid)
    rows = np.flatnonzero(ok[flat])
    if len(rows) < 2:
        return
    # neighbours in suffix order that begin with the same LENGTH bytes; all between two equal ones are equal and valid
    s = flat[rows]
    view = np.lib.stride_tricks.sliding_window_view(np.r_[whole, np.zeros(LENGTH, np.uint8)], LENGTH)
    same = np.zeros(len(s), bool)
    for i in range(1, len(s), 100_000):
        j = min(len(s), i + 100_000)
        same[i:j] = (view[s[i:j]] == view[s[i - 1 : j - 1]]).all(axis=1)
    same[1:] &= block[rows[1:]] == block[rows[:-1]]
    first = np.flatnonzero(~same)
    rank = doc[s] // many
    least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(s)]))
    hit = s[rank > least]
    emit(doc[hit], place[hit])


def compare(packed: DataFrame) -> DataFrame:
    """(doc_id, no, at): starts of strings of LENGTH bytes that a smaller document has."""

    def run(batches):
        # blocks of several slices at a time: the more of one size, the less each costs
        small: list = []
        ids_of: list[np.ndarray] = []
        found: list[tuple[np.ndarray, np.ndarray]] = []
        count = held = 0

        def emit(d, p):
            found.append((d, p))

        def flush():
            compare_blocks(small, MANY, emit)
            ids = np.concatenate(ids_of) if ids_of else np.empty(0, np.int64)
            if found:
                d, p = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
                for at in range(0, len(d), 100_000):
                    to = slice(at, at + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[d[to] // MANY]), pa.array((d[to] % MANY).astype(np.int32)), pa.array(p[to].astype(np.int32))], names=["doc_id", "no", "at"])

        for rows in _runs(batches):
            keys, docs, nos, los, parts = [], [], [], [], []
            for row in rows:
                size = np.frombuffer(row["size"], np.uint32).astype(np.int64)
                ends = np.cumsum(size)
                keys.append(np.frombuffer(row["keys"], np.uint64))
                docs.append(np.frombuffer(row["docs"], np.int64))
                nos.append(np.frombuffer(row["nos"], np.int32))
                los.append(np.frombuffer(row["lo"], np.uint32).astype(np.int64))
                data = row["data"]
                parts += [data[e - n : e] for n, e in zip(size.tolist(), ends.tolist(), strict=True)]
            key, doc, no, lo = (np.concatenate(x) for x in (keys, docs, nos, los))
            # a row's number stands for it below, in the order of the ids within its slice
            ids, rank = np.unique(doc, return_inverse=True)
            place = lo.tolist()
            order = np.lexsort((doc, key))
            k = key[order]
            first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]).tolist() + [len(k)]
            who = ((rank + count) * MANY + no).tolist()  # document first, then its text's number
            before = len(small)
            for x, y in zip(first[:-1], first[1:], strict=True):
                if doc[order[x]] == doc[order[y - 1]]:  # one document's
                    continue
                idx = order[x:y].tolist()
                _deal([parts[i] for i in idx], [who[i] for i in idx], [place[i] for i in idx], MANY, small, emit)
            ids_of.append(ids)
            count += len(ids)
            held += sum(len(t) for texts, _, _ in small[before:] for t in texts) + 8 * len(ids) + sum(16 * len(d) for d, _ in found)
            if held > GATHER:
                yield from flush()
                small, ids_of, found, count, held = [], [], [], 0, 0
        yield from flush()

    return packed.mapInArrow(run, "doc_id long, no int, at int")


def _deal(texts: list[bytes], docs: list[int], places: list[int], many: int, small: list, emit) -> None:
    """Small groups go to the suffix arrays as they are; large ones are cut until they are small."""
    if sum(map(len, texts)) + len(texts) <= BLOCK or len(texts) == 1:
        small.append((texts, docs, places))
        return
    rows = _FINDER.find(texts)
    anchor = rows[5][np.searchsorted(rows[0], np.arange(len(texts)))].tolist()  # the strings of a context have one anchor
    _cut(list(zip(texts, docs, places, anchor, strict=True)), 0, LENGTH - CORE, many, small, emit)


def _cut(members: list[tuple], near: int, far: int, many: int, small: list, emit) -> None:
    """Strings that start near..far bytes before the anchor, in groups by the bytes that all of these strings share."""
    groups: dict[bytes, list[tuple]] = {}
    for t, d, p, a in members:
        lo, hi = max(0, a - far), min(len(t), a - near + LENGTH)
        if hi - lo >= LENGTH:
            groups.setdefault(t[a - near : a - far + LENGTH], []).append((t[lo:hi], d, p + lo, a - lo))
    for group in groups.values():
        if len({d // many for _, d, _, _ in group}) == 1:
            continue
        if near == far:  # the shared bytes are the string itself
            least = min(d // many for _, d, _, _ in group)
            rest = [(d, p) for _, d, p, _ in group if d // many > least]
            emit(np.array([d for d, _ in rest], np.int64), np.array([p for _, p in rest], np.int64))
        elif sum(len(t) + 1 for t, _, _, _ in group) <= BLOCK:
            small.append(tuple([list(x) for x in zip(*((t, d, p) for t, d, p, _ in group), strict=True)]))
        else:
            middle = (near + far) // 2
            _cut(group, near, middle, many, small, emit)
            _cut(group, middle + 1, far, many, small, emit)


def _merge(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(parts):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def _numbered(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with ``no``: 0, but where an id has several texts each of these has a number of its own."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    mark = F.xxhash64("text")
    several = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi")).where("lo <> hi").select("doc_id")
    if not several.limit(1).count():
        return docs.withColumn("no", F.lit(0))
    texts = docs.join(several, "doc_id").select("doc_id", mark.alias("mark")).distinct()
    numbers = texts.withColumn("no", F.row_number().over(Window.partitionBy("doc_id").orderBy("mark")))
    marked = docs.withColumn("mark", mark).join(numbers, ["doc_id", "mark"], "left")
    return marked.select("doc_id", "text", F.coalesce("no", F.lit(0)).alias("no"))


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, no, spans) from (doc_id, no, text): the packed spans lo << 32 | hi that smaller documents cover, if any."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    tables = SharedTables(spark)
    size = input_bytes(docs)
    parts = PASSES if (size or 0) > PASS_BYTES else 1
    slices = Slices(int(spark.conf.get("spark.sql.shuffle.partitions")), size and -(-size // parts))
    small_batches(spark)
    with tidy_shuffles(spark):
        settled = _all([tables.keep(settle(slices.deal(packed_anchors(docs, slices, k, parts)), slices), f"settled{k}") for k in range(parts)])
        asked = settled.where("key is not null")
        texts = docs.where("doc_id is not null and text is not null")
        fetched = []
        for k in range(parts):
            mine = F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == k
            ask = asked.where(mine).groupBy("doc_id", "no").agg(F.collect_list(F.struct("key", "lo", "hi")).alias("ask"))
            fetched.append(tables.keep(contexts(texts.where(mine), ask, slices), f"fetched{k}"))
        more = tables.keep(compare(slices.deal(_all(fetched))), "more")
        for k in range(parts):
            tables.drop(f"fetched{k}")
        covered = settled.where("key is null").select("doc_id", "no", "lo", "hi").unionByName(more.select("doc_id", "no", F.col("at").alias("lo"), (F.col("at") + LENGTH).alias("hi")))
        span = F.shiftleft(F.col("lo").cast("long"), 32).bitwiseOR(F.col("hi").cast("long"))
        out = _joined(covered.groupBy("doc_id", "no").agg(F.collect_list(span).alias("spans"))).checkpoint()
    tables.drop()
    return out


def _all(frames: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, frames)


def _joined(spans: DataFrame) -> DataFrame:
    """Spans that touch or overlap become one."""

    def run(batches):
        for b in batches:
            out = []
            for x in b.column(2):
                x = np.sort(x.values.to_numpy())
                lo, hi = x >> 32, np.maximum.accumulate(x & 0xFFFFFFFF)
                first = np.flatnonzero(np.r_[True, lo[1:] > hi[:-1]])
                out.append(lo[first] << 32 | hi[np.r_[first[1:], len(x)] - 1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "no", "spans"])

    return spans.mapInArrow(run, "doc_id long, no int, spans array<long>")


def _spans(packed: list[int] | None) -> list[tuple[int, int]]:
    return _merge([(x >> 32, x & 0xFFFFFFFF) for x in packed or ()])


def _kept(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for lo, hi in spans:
        out.append(data[at:lo])
        at = hi
    out.append(data[at:])
    return b"".join(out)


def clean(docs: DataFrame) -> DataFrame:
    """The documents with covered bytes removed from their texts; torn characters go with them."""
    cols = docs.columns
    numbered = _numbered(docs)
    rest = repeats(numbered)
    names = [fresh_name(docs, x) for x in ("sd_doc", "sd_mark", "sd_spans")]
    found = numbered.where("no > 0").select("doc_id", "no", F.xxhash64("text").alias("mark")).distinct()
    marks = rest.where("no > 0").join(found, ["doc_id", "no"]).select("doc_id", "mark", "spans").unionByName(rest.where("no = 0").select("doc_id", F.lit(None).cast("long").alias("mark"), "spans"))
    i, m, s = (F.col(x) for x in names)
    mine = F.xxhash64(docs["text"].cast("string"))
    joined = docs.join(marks.toDF(*names), (docs["doc_id"].cast("long") == i) & (m.isNull() | (m == mine)), "left")
    keep = F.udf(lambda t, s: t if t is None or not s else _kept(t.encode(), _spans(s)).decode("utf-8", "ignore"), "string", useArrow=True)
    return joined.withColumn("text", F.when(s.isNull(), F.col("text")).otherwise(keep("text", s))).select(*cols)


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<lo:long,hi:long>>"


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) for each document."""
    docs = _numbered(docs)
    joined = docs.join(repeats(docs), ["doc_id", "no"], "left").select("doc_id", "text", F.col("spans").alias("packed"))

    def make():
        def f(c):
            out = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")}
            for i, t, packed in zip(c["doc_id"], c["text"], c["packed"], strict=True):
                data, spans = t or b"", _spans(packed)
                for k, v in zip(out, (i, len(data), sum(hi - lo for lo, hi in spans), len(spans), hashlib.sha256(_kept(data, spans)).hexdigest(), [{"lo": a, "hi": b} for a, b in spans]), strict=True):
                    out[k].append(v)
            return out

        return f

    return map_batches(joined, make, _RESULT, binary=("text",))


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return removals(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")


SQL = r"""
with d as (select doc_id, coalesce(text, '') as text, hex(encode(coalesce(text, ''))) as h from documents),
w as (select doc_id, p, substr(h, 2 * p + 1, 100) as s from (select doc_id, h, unnest(range(0, (len(h) // 2 - 49)::bigint)) as p from d where len(h) >= 100)),
m as (select md5(s) as k, min(doc_id) as least from w group by md5(s)),
c as (select w.doc_id, w.p from w join m on md5(w.s) = m.k where m.least < w.doc_id),
g as (select doc_id, p, case when p <= lag(p) over (partition by doc_id order by p) + 50 then 0 else 1 end as fresh from c),
r as (select doc_id, p, sum(fresh) over (partition by doc_id order by p) as run from g),
s as (select doc_id, run, min(p) as lo, max(p) + 50 as hi from r group by doc_id, run),
t as (select doc_id, lo, hi, coalesce(lag(hi) over (partition by doc_id order by lo), 0) as since, row_number() over (partition by doc_id order by lo desc) as back from s),
k as (select t.doc_id, sum(hi - lo)::bigint as n_removed, count(*) as n_spans, string_agg(substr(d.h, (2 * since + 1)::bigint, (2 * (lo - since))::bigint), '' order by lo) || max(case when back = 1 then substr(d.h, (2 * hi + 1)::bigint) else '' end) as rest
      from t join d using (doc_id) group by t.doc_id)
select d.doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(rest, h))) as kept_sha256
from d left join k using (doc_id)
"""
