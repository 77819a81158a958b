"""From chats to compressed chats: spans, pooled vectors, placeholders in the trace's place, and their ratio.

A method cuts a trace's tokens into spans and pools each span's token vectors into one. The trace is replaced by one
placeholder a span, and a slot table holds the vectors in the placeholders' order, so that a scorer can put them there.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelens.functions import text as T
from tracelens.functions.numeric import safe_ratio
from tracelens.operators import patching, pooling
from tracelens.operators.chat_tokens import WORDS, Tokenizer
from tracelens.operators.patching import Strategy


@dataclass(frozen=True)
class Method:
    """A family of pooling with the strategy that cuts the spans; ``base`` keeps the trace as it is."""

    family: str
    strategy: Strategy | None = None
    temperature: float = 1.0
    seed: int = 13

    def __post_init__(self):
        if self.family not in pooling.FAMILIES:
            raise ValueError(f"no method {self.family}")

    @property
    def name(self) -> str:
        tag = self.strategy.tag() if self.strategy else ""
        return pooling.name(self.family, tag, self.temperature if self.family == "entropy_weighted_mean" else None)

    @property
    def needs_entropy(self) -> bool:
        return self.family == "entropy_weighted_mean" or bool(self.strategy and self.strategy.needs_entropy)


def methods_from(config: Mapping, key: str = "sample_index") -> list[Method]:
    """Methods from ``{"enabled": [...], "patching": {strategy: options}, family: {"patching": strategy, ...}}``, in the
    order of ``enabled``; an unknown family or strategy is an error."""
    out = []
    for family in config["enabled"]:
        own = dict(config.get(family, {}))
        cut = own.pop("patching", None)
        if family == "base":
            out.append(Method("base"))
            continue
        options = dict((config.get("patching") or {}).get(cut, {}))
        out.append(Method(family, patching.build(cut, key=key, **options) if cut else None, float(own.get("temperature", 1.0)), int(own.get("seed", 13))))
    return out


def traced(chats: DataFrame, key: str = "conv_id", messages: str = "messages") -> DataFrame:
    """(key, messages, idx, trace, answer) of chats whose last assistant message has a trace and an answer."""
    rows = chats.select(key, F.col(messages).alias("messages"), T.last_assistant(F.col(messages)).alias("idx")).where("idx >= 0")
    rows = rows.withColumn("_p", T.trace_parts(F.get("messages", F.col("idx"))["content"])).where("_p is not null")
    return rows.select(key, "messages", "idx", F.col("_p.trace").alias("trace"), F.col("_p.answer").alias("answer"))


def trace_tokens(traces: DataFrame, tokenizer: Tokenizer = WORDS, key: str = "conv_id") -> DataFrame:
    """(key, pos, token, token_id) of the trace's text, tags included; traces without a token have no row."""
    rows = T.settled(traces.select(key, "trace"), _tokens=tokenizer.offsets(F.col("trace")))
    rows = T.settled(rows, _ids=tokenizer.ids(F.col("_tokens")))
    return rows.select(key, F.posexplode(F.arrays_zip("_tokens", "_ids")).alias("pos", "t")).select(key, "pos", F.col("t._tokens.token").alias("token"), F.col("t._ids").alias("token_id"))


def prefix_ids(traces: DataFrame, tokenizer: Tokenizer = WORDS, key: str = "conv_id") -> DataFrame:
    """(key, prefix_ids): tokens of the messages before the trace's, with the generation prompt; none without messages."""
    text = T.render(T.prefix_messages(F.col("messages"), F.col("idx")), generation_prompt=True)
    rows = T.settled(traces.select(key, "idx", text.alias("_text")), _tokens=tokenizer.offsets(F.col("_text")))
    none = F.array().cast("array<int>")
    return rows.select(key, F.when(F.col("idx") > 0, tokenizer.ids(F.col("_tokens"))).otherwise(none).alias("prefix_ids"))


def entropy_eligible(traces: DataFrame, tokenizer: Tokenizer = WORDS, key: str = "conv_id") -> DataFrame:
    """The traces that entropies can be computed for: with tokens and a prefix that is not empty."""
    some = trace_tokens(traces, tokenizer, key).select(key).distinct()
    ready = prefix_ids(traces, tokenizer, key).where(F.size("prefix_ids") > 0).select(key)
    return traces.join(some, key, "left_semi").join(ready, key, "left_semi")


def resolved(rows: DataFrame, method: Method, key: str = "conv_id", h: str = "h") -> DataFrame:
    """Token rows with their span's number in ``patch``; a method that needs entropies skips samples that lack any."""
    if method.needs_entropy:
        if h not in rows.columns:
            raise ValueError(f"{method.name} needs entropies")
        lacking = F.count_if(F.col(h).isNull()).over(Window.partitionBy(key))
        rows = rows.withColumn("_lacking", lacking).where("_lacking = 0").drop("_lacking")
    return rows.withColumn("patch", F.lit(0)) if method.strategy is None else method.strategy.apply(rows)


def weighted(rows: DataFrame, method: Method, key: str = "conv_id") -> DataFrame:
    """Rows with each token's weight ``w`` in its span."""
    if method.family == "entropy_weighted_mean":
        return pooling.entropy_weights(rows, method.temperature, key)
    return pooling.mean_weights(rows, key)


@dataclass(frozen=True)
class Compressed:
    """``chats``: (key, method, messages, original_cot_tokens, compressed_cot_tokens, compression_ratio); ``slots``:
    (key, slot, vector) in the placeholders' order, or none for a method that keeps the trace."""

    chats: DataFrame
    slots: DataFrame | None = field(default=None)


def compress(traces: DataFrame, rows: DataFrame, vectors: DataFrame | None, method: Method, vocabulary: int = 0, key: str = "conv_id") -> Compressed:
    """Compresses each trace; samples without tokens, or without entropies that the method needs, are not in the result.

    ``rows`` are token rows (key, pos, token_id, and h where needed); ``vectors`` is (token_id, vector). The random
    family draws an id below ``vocabulary`` for each span and takes its vector.
    """
    sizes = rows.groupBy(key).agg(F.count("*").cast("int").alias("original_cot_tokens"))
    if method.family == "base":
        kept = traces.join(sizes, key).withColumn("compressed_cot_tokens", F.col("original_cot_tokens"))
        return Compressed(_finished(kept, method, key))
    cut = resolved(rows, method, key)
    spans = cut.groupBy(key, "patch").agg(F.count("*").alias("_n"))
    counts = spans.groupBy(key).agg(F.count("*").cast("int").alias("compressed_cot_tokens"))
    kept = traces.join(sizes, key).join(counts, key)
    kept = kept.withColumn("messages", T.replace_trace(F.col("messages"), F.col("idx"), T.placeholders(F.col("compressed_cot_tokens"))))
    slots = None
    if vectors is not None:
        if method.family == "random":
            slots = pooling.random_ids(spans, vocabulary, method.seed, key).join(vectors, "token_id").select(key, "patch", "vector")
        else:
            slots = pooling.as_vectors(pooling.pool(weighted(cut, method, key), vectors, key), key)
        slots = slots.select(key, F.col("patch").cast("int").alias("slot"), "vector")
    return Compressed(_finished(kept, method, key), slots)


def _finished(kept: DataFrame, method: Method, key: str) -> DataFrame:
    ratio = safe_ratio(F.col("compressed_cot_tokens"), F.col("original_cot_tokens"))
    return kept.select(key, F.lit(method.name).alias("method"), "messages", "answer", "original_cot_tokens", "compressed_cot_tokens", ratio.alias("compression_ratio"))


def slot_places(chats: DataFrame, tokenizer: Tokenizer = WORDS, max_length: int | None = None, key: str = "conv_id") -> DataFrame:
    """(key, compressed_cot_tokens, places): where the placeholders stand in the rendered chat's tokens, counted after
    tokens beyond ``max_length`` are cut off on the left; rows that lost any of them go."""
    rows = T.settled(chats.select(key, "compressed_cot_tokens", T.render(F.col("messages")).alias("_text")), _tokens=tokenizer.offsets(F.col("_text")))
    names = F.transform("_tokens", lambda t: t["token"])
    rows = rows.withColumn("places", T.positions(T.truncate_left(names, max_length) if max_length else names, F.lit(T.PLACEHOLDER)))
    return rows.where(F.size("places") == F.col("compressed_cot_tokens")).select(key, "compressed_cot_tokens", "places")


def spliced(places: DataFrame, slots: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, place, vector): each slot's vector at its placeholder; raises where a chat's slots and placeholders differ
    in number."""
    at = places.select(key, F.posexplode("places").alias("slot", "place"))
    both = at.join(slots, [key, "slot"], "full")
    checked = F.when(F.col("place").isNull() | F.col("vector").isNull(), F.raise_error(F.lit("slots and placeholders differ")).cast("int")).otherwise(F.col("place"))
    return both.select(key, checked.alias("place"), "vector")


def gathered(vectors: DataFrame, ids: Sequence[int] | DataFrame, key: str = "token_id") -> DataFrame:
    """Rows of a table by number, in the numbers' order and as often as these ask: (place, key, ...)."""
    if isinstance(ids, DataFrame):
        return ids.join(vectors, key)
    wanted = vectors.sparkSession.createDataFrame(list(enumerate(ids)), f"place int, {key} long")
    return wanted.join(vectors, key).orderBy("place")
