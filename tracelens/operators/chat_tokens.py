"""Token rows for training and for scoring answers: render, tokenise, mask, collate."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelens.functions import numeric as N
from tracelens.functions import text as T
from tracelens.functions.numeric import hash_bucket

VOCABULARY = 50_000


def token_ids(tokens: Column, vocabulary: int = VOCABULARY) -> Column:
    """Ids of offset tokens by hash; a tokenizer of one's own gives its ids instead."""
    return F.transform(tokens, lambda t: hash_bucket(t["token"], vocabulary).cast("int"))


@dataclass(frozen=True)
class Tokenizer:
    """A tokenizer as two column functions: a text's tokens with their places, and the ids of such tokens.

    Tokens are structs with token, start and end at least, so the ids may be a field that ``offsets`` made.
    """

    offsets: Callable[[Column], Column]
    ids: Callable[[Column], Column]


#: Words between white space; and words parted at tags and special tokens, each of which is a token of its own.
WORDS = Tokenizer(T.word_offsets, token_ids)
MARKED_WORDS = Tokenizer(T.marked_offsets, token_ids)


def python_tokenizer(encode: Callable[[str], list[tuple[int, int, int]]]) -> Tokenizer:
    """A tokenizer from a function of a text to (id, start, end) triples, such as a library's; it runs in Arrow batches."""

    def places(text: str | None):
        return None if text is None else [{"token": text[a:b], "start": a, "end": b, "id": i} for i, a, b in encode(text)]

    kind = "array<struct<token:string,start:int,end:int,id:int>>"
    return Tokenizer(lambda text: F.udf(places, kind, useArrow=True)(text), lambda tokens: F.transform(tokens, lambda t: t["id"]))


def tokenize_for_sft(chats: DataFrame, max_length: int | None = None, tokenizer: Tokenizer = WORDS) -> DataFrame:
    """Adds input_ids, attention_mask and labels: ids of tokens in assistant messages, -100 elsewhere.

    Beyond ``max_length`` tokens are cut off on the left.
    """
    rows = T.settled(chats, _text=T.render(F.col("messages")))
    rows = T.settled(rows, _tokens=tokenizer.offsets(F.col("_text")), _spans=T.assistant_spans(F.col("messages"), F.col("_text")))
    rows = T.settled(rows, input_ids=tokenizer.ids(F.col("_tokens")))
    rows = T.settled(rows, labels=T.labels(F.col("_tokens"), F.col("input_ids"), F.col("_spans")))
    if max_length:
        rows = rows.withColumn("input_ids", T.truncate_left(F.col("input_ids"), max_length)).withColumn("labels", T.truncate_left(F.col("labels"), max_length))
    return rows.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids"))).drop("_text", "_tokens", "_spans")


def has_trainable_tokens(labels: Column) -> Column:
    return F.exists(labels, lambda x: x != T.IGNORE)


def tokenize_answer(traced: DataFrame, tokenizer: Tokenizer = WORDS) -> DataFrame:
    """traced: messages and answer. Adds input_ids, labels and answer_positions; rows without an answer token go."""
    rows = T.settled(traced, _text=T.render(F.col("messages")))
    rows = T.settled(rows, _tokens=tokenizer.offsets(F.col("_text")), _span=T.answer_span(F.col("messages"), F.col("_text"), F.col("answer"))).where("_span is not null")
    rows = T.settled(rows, input_ids=tokenizer.ids(F.col("_tokens")))
    rows = T.settled(rows, labels=T.labels(F.col("_tokens"), F.col("input_ids"), F.array("_span")))
    rows = rows.withColumn("answer_positions", F.filter(F.transform("labels", lambda x, i: F.when(x != T.IGNORE, i)), lambda i: i.isNotNull()))
    return rows.where(F.size("answer_positions") > 0).drop("_text", "_tokens", "_span")


def slots_survive(ids: Column, placeholder: Column, slots: Column) -> Column:
    """Whether as many placeholders are left in a row as it has slot vectors."""
    return F.size(F.filter(ids, lambda x: x == placeholder)) == slots


def collate(rows: DataFrame, batch: str, pad_id: int = 0) -> DataFrame:
    """Pads ids, mask and labels on the right to their batch's longest row."""
    width = F.max(F.size("input_ids")).over(Window.partitionBy(batch))
    padded = rows.withColumn("_width", width)
    for name, fill in (("input_ids", pad_id), ("attention_mask", 0), ("labels", T.IGNORE)):
        padded = padded.withColumn(name, N.pad_right(F.col(name), F.col("_width"), fill))
    return padded.drop("_width")


def epoch_order(rows: DataFrame, key: str, seed: int, epoch: int) -> DataFrame:
    """Rows in the order of a hash of seed, epoch and key."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:{epoch}:"), F.col(key).cast("string")).cast("binary")), key)
