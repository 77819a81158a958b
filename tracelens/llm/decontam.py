"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The test strings are the word windows of the benchmark items. Blocks of two words index a shift table that skips
positions where no window can end, the block that ends a window selects a bucket of test strings, and a comparison of
the words confirms an occurrence. Windows of one length form one table; items shorter than a window have tables of
their own length, so that they do not shorten the shifts of the others.

Defined cases: null or wordless texts have no words and hit nothing; items without words have no window; an empty
benchmark leaves every document clean; items with a null id hit as any other, and all of them together are one null at
the end of item_ids, which n_items counts and items_sha256 passes over; repeated rows each get their own result, and so
do rows without an id; other columns are ignored, and pass ``keep_clean`` whatever their names.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelens.llm.common import filter_texts, fresh_name, map_batches, table

WINDOW = 13
#: The benchmark goes to the tasks in blocks of at most this many bytes of text; each block is one pass.
BLOCK_BYTES = 16 << 20

# Fixed rule: A-Z become a-z; 0-9, a-z and all bytes from 0x80 are word bytes, anything else parts words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

DDL = "doc_id long, n_words long, n_hit long, item_ids array<string>"


def words_of(data: bytes | None) -> list[bytes]:
    return data.translate(_FOLD).split() if data else []


class WuManber:
    """Occurrences of word windows of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[str | None]]):
        self.m = m = len(next(iter(patterns)))
        self.block = b = min(2, m)
        self.default = m - b + 1
        self.shift: dict = {}
        self.buckets: dict = defaultdict(list)
        for p, items in patterns.items():
            for end in range(b, m + 1):
                key = p[end - 2 : end] if b == 2 else p[0]
                self.shift[key] = min(self.shift.get(key, self.default), m - end)
            self.buckets[p[-2:] if b == 2 else p[0]].append((p[0], list(p), sorted(items)))
        self.buckets = dict(self.buckets)

    def search(self, words: list[bytes]):
        """Yields (start, items) of each occurrence."""
        m, n, default, shift, two = self.m, len(words), self.default, self.shift, self.block == 2
        at = m
        while at <= n:  # a window that ends before `at`
            key = (words[at - 2], words[at - 1]) if two else words[at - 1]
            skip = shift.get(key, default)
            if skip:
                at += skip
                continue
            first = words[at - m]
            for p0, p, items in self.buckets[key]:
                if p0 == first and words[at - m : at] == p:
                    yield at - m, items
            at += 1


def compile_windows(items: list[tuple[str | None, bytes | None]], window: int = WINDOW) -> list[WuManber]:
    by_length: dict[int, dict[tuple[bytes, ...], set[str | None]]] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        words = words_of(text)
        m = min(window, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            by_length[m][tuple(words[i : i + m])].add(item)
    return [WuManber(by_length[m]) for m in sorted(by_length)]


def scan(words: list[bytes], searchers: list[WuManber]) -> tuple[bytearray, set[str | None]]:
    hit, items = bytearray(len(words)), set()
    for s in searchers:
        one = b"\x01" * s.m
        for start, found in s.search(words):
            hit[start : start + s.m] = one
            items.update(found)
    return hit, items


def in_order(items: set[str | None]) -> list[str | None]:
    """Sorted ids, the null id last as array_sort has it."""
    return sorted(items, key=lambda i: (i is None, i or ""))


def _blocks(benchmark: DataFrame):
    """The benchmark in blocks of bounded bytes, read row by row; the driver holds one block at a time."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("binary").alias("t")).where("t is not null")
    for r in rows.toLocalIterator():
        block.append((r.i, bytes(r.t)))
        size += len(r.t)
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, with_mark: bool = False) -> DataFrame:
    """(doc_id, n_words, n_hit, item_ids) for each document; item_ids sorted. ``with_mark`` adds xxhash64 of the text.

    A benchmark within BLOCK_BYTES is searched in one pass without a shuffle. A larger one is searched block by block:
    hit words are then returned as positions and united per document.
    """
    blocks = _blocks(benchmark)
    first, second = next(blocks, []), next(blocks, None)
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def counter(block):
        def make():
            searchers = compile_windows(block, window)

            def f(c):
                out = {"doc_id": c["doc_id"], "n_words": [], "n_hit": [], "item_ids": []}
                for t in c["text"]:
                    words = words_of(t)
                    hit, items = scan(words, searchers)
                    out["n_words"].append(len(words))
                    out["n_hit"].append(sum(hit))
                    out["item_ids"].append(in_order(items))
                return out

            return f

        return make

    if second is None:
        return map_batches(cols, counter(first), DDL, binary=("text",))

    # a text is known by its id and a hash, which stay the same when lost tasks run again; rows alike have one result
    keyed = cols.withColumn("mark", F.xxhash64("text"))

    def marker(block):
        def make():
            searchers = compile_windows(block, window)

            def f(c):
                out = {"doc_id": [], "mark": [], "pos": [], "item_ids": []}
                for i, mark, t in zip(c["doc_id"], c["mark"], c["text"], strict=True):
                    hit, items = scan(words_of(t), searchers)
                    if items:  # texts without a hit send nothing
                        out["doc_id"].append(i)
                        out["mark"].append(mark)
                        out["pos"].append([k for k, x in enumerate(hit) if x])
                        out["item_ids"].append(in_order(items))
                return out

            return f

        return make

    parts = None
    for block in itertools.chain([first, second], blocks):
        one = map_batches(keyed, marker(block), "doc_id long, mark long, pos array<int>, item_ids array<string>", binary=("text",))
        parts = one if parts is None else parts.unionByName(one)
    united = parts.groupBy(F.col("doc_id").alias("h_id"), F.col("mark").alias("h_mark")).agg(F.size(F.array_distinct(F.flatten(F.collect_list("pos")))).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    counted = keyed.select("doc_id", "mark", word_count(F.col("text")).alias("n_words"))
    joined = counted.join(united, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("mark") == F.col("h_mark")), "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), *([F.col("mark")] if with_mark else []))


def word_count(text: Column) -> Column:
    """Words by the rule of ``words_of``; case does not part words."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")


def contaminated(n_hit: int, n_words: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    blocks = _blocks(benchmark)
    first, second = next(blocks, []), next(blocks, None)
    if second is not None:
        i, m = fresh_name(docs, "dc_doc"), fresh_name(docs, "dc_mark")
        bad = decontaminate(docs, benchmark, window, True).where(is_contaminated()).select(F.col("doc_id").alias(i), F.col("mark").alias(m)).distinct()
        return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad[i]) & (F.xxhash64(docs["text"].cast("string")) == bad[m]), "left_anti")

    def make():
        searchers = compile_windows(first, window)

        def f(texts):
            out = []
            for t in texts:
                words = words_of(t.encode()) if t else []
                out.append(not contaminated(sum(scan(words, searchers)[0]), len(words)))
            return out

        return f

    return filter_texts(docs, "text", make)


def is_contaminated(n_hit="n_hit", n_words="n_words"):
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"), is_contaminated().alias("contaminated"))


SQL = r"""
with docs as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
items as (select item_id::varchar as item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
sized as (select item_id, w, least(13, len(w)) as m from items where len(w) > 0),
win as (select distinct item_id, m, array_to_string(w[i:i + m - 1], ' ') as s from (select item_id, w, m, unnest(range(1, (len(w) - m + 2)::bigint)) as i from sized)),
lens as (select distinct m from win),
dwin as (select doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') as s from (select doc_id, w, m, unnest(range(1, (len(w) - m + 2)::bigint)) as i from docs, lens where len(w) >= m)),
occ as (select doc_id, i, dwin.m, item_id from dwin join win on dwin.s = win.s and dwin.m = win.m),
pos as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + m)) as p from (select distinct doc_id, i, m from occ)) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id from occ) group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) as contaminated
from docs d left join pos using (doc_id) left join its using (doc_id)
"""
