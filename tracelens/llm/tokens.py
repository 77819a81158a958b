"""Token counts with overlap resynchronisation.

A huge document is encoded in overlapping chunks with offsets; two neighbours are spliced at a token boundary inside
their overlap that both have and that no pre-token can cross, and the overlap is widened when they have none in common.
Where a whole chunk has no such boundary, it is encoded anew at twice the size, so the work stays in proportion to the
text. The byte-level pre-tokenizer parts texts into runs of letters, of numbers, of other signs and of white space, with
a single space in front of a run as part of it and contractions such as 's as pre-tokens. So a boundary is stable

- before a single space that has a non-space on either side,
- between a letter and a number, after a letter or a number before any other sign,
- after any other sign but an apostrophe before a letter or a number,

and what follows is split as it would be anywhere else. The boundaries before spaces part ordinary documents into units:
a batch's distinct units go to the library once and their lengths are summed, since texts repeat most of their words.

All this holds for a byte-level pre-tokenizer with the common pattern and without a normalizer or a space put in front;
with any other tokenizer, and with texts that contain special strings, the library gets whole texts.

Defined cases: a null text is the empty text (0 tokens); special strings inside a text count as the library counts them
by default; a text of one run of letters is one chunk, whatever its length; an empty table gives an empty result;
repeated rows each have their own; other columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import os
import re

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelens.llm.common import map_batches, table

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
#: Documents of more characters than this are huge; then characters a chunk and characters of a first overlap.
HUGE, CHUNK, OVERLAP = 32_768, 16_384, 128
#: Units whose counts a task keeps.
KEEP_UNITS = 300_000

_BOUNDARY = re.compile(r"(?<=\S)(?= \S)")
_STABLE = regex.compile(r"(?<=\S)(?= \S)|(?<=\p{L})(?=[^\p{L}\s])|(?<=\p{N})(?=[^\p{N}\s])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])")
DDL = "doc_id long, n_bytes long, n_tokens long"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def splits_by_runs(config: dict) -> bool:
    """Whether a tokenizer file has the pre-tokenizer for which the boundaries above are stable."""
    pre = config.get("pre_tokenizer") or {}
    return config.get("normalizer") is None and pre.get("type") == "ByteLevel" and bool(pre.get("use_regex", True)) and not pre.get("add_prefix_space", True)


class Counter:
    """Counts of one tokenizer, which is loaded once a task."""

    def __init__(self, path: str, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.huge, self.chunk, self.overlap = huge, chunk, overlap
        self.units: dict[str, int] = {}
        self.widened = self.encoded = 0
        self.special: list[str] = []
        self.parts = False
        if path.endswith(".model"):
            import sentencepiece

            piece = sentencepiece.SentencePieceProcessor(model_file=path)
            self.direct = lambda texts: [len(x) for x in piece.encode(texts, num_threads=1)]
            return
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.no_truncation()
        self.t.no_padding()
        with open(path) as f:
            self.parts = splits_by_runs(json.load(f))
        self.special = [x.content for x in self.t.get_added_tokens_decoder().values()]

    def direct(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]

    def _starts(self, text: str, lo: int, hi: int) -> list[int]:
        """Where the tokens of text[lo:hi] start."""
        self.encoded += hi - lo
        return [lo + a for a, _ in self.t.encode(text[lo:hi], add_special_tokens=False).offsets]

    def _common(self, text: str, at: int, hi: int, to: int, starts: list[int]) -> tuple[int, list[int]] | None:
        """A stable boundary that the chunk text[at:hi] with its token starts shares with an overlapping chunk up to
        ``to``, and that one's starts; None if the overlap grows over the whole chunk without any."""
        width = self.overlap
        while True:
            lo = max(at, hi - width)
            # the sign at the chunk's end may belong to a longer run, so boundaries count up to the one before it
            stable = {m.start() for m in _STABLE.finditer(text, lo + 1, hi)} - {lo, hi - 1, hi}
            stable.intersection_update(starts[bisect.bisect_left(starts, lo + 1) :])
            if stable:
                nxt = self._starts(text, lo, to)
                common = stable.intersection(nxt[: bisect.bisect_left(nxt, hi)])
                if common:
                    return max(common), nxt
            if lo == at:
                return None
            width *= 2
            self.widened += 1

    def resync(self, text: str) -> int:
        """Tokens of a huge text, chunk by chunk."""
        if any(x in text for x in self.special):
            return self.direct([text])[0]
        n, total, at, size = len(text), 0, 0, self.chunk
        hi = min(n, size)
        starts = self._starts(text, at, hi)
        while hi < n:
            to = min(n, hi + self.chunk)
            found = self._common(text, at, hi, to, starts)
            if found is None:  # nothing to splice at: the chunk anew, twice as long
                size *= 2
                hi = min(n, at + size)
                starts = self._starts(text, at, hi)
                continue
            cut, nxt = found
            total += bisect.bisect_left(starts, cut)
            starts = nxt[bisect.bisect_left(nxt, cut) :]
            at, hi, size = cut, to, self.chunk
        return total + len(starts)

    def count(self, texts: list[str | None]) -> list[int]:
        out, parts, fresh, alone = [0] * len(texts), [], {}, []
        known = self.units
        if len(known) > KEEP_UNITS:
            known.clear()
        for k, t in enumerate(texts):
            if not t:
                continue
            if not self.parts or any(x in t for x in self.special):
                alone.append(k)
            elif len(t) > self.huge:
                out[k] = self.resync(t)
            else:
                units = _BOUNDARY.split(t)
                parts.append((k, units))
                for u in units:
                    if u not in known:
                        fresh[u] = None
        if fresh:
            words = list(fresh)
            known.update(zip(words, self.direct(words), strict=True))
        get = known.__getitem__
        for k, units in parts:
            out[k] = sum(map(get, units))
        for k, n in zip(alone, self.direct([texts[k] for k in alone]) if alone else (), strict=True):
            out[k] = n
        return out


def count_tokens(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens). ``tokenizer`` is a path, or a name in the public tokenizers."""
    name = tokenizer or TOKENIZER

    def make():
        c = Counter(name if os.path.sep in name else tokenizer_path(name))

        def f(b):
            return {"doc_id": b["doc_id"], "n_bytes": [len(t.encode()) if t else 0 for t in b["text"]], "n_tokens": c.count(b["text"])}

        return f

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), make, DDL)


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
