"""Chat messages, traces, answers and spans as column expressions."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tracelens.session import bounded_batches

OPEN, CLOSE = "<think>", "</think>"
PLACEHOLDER = "<|slot|>"
IGNORE = -100


def valid_messages(messages: Column) -> Column:
    """Some messages, each with a role and a content, one of them the assistant's; never null."""
    filled = F.forall(messages, lambda m: m.isNotNull() & F.coalesce(m["role"] != "", F.lit(False)) & F.coalesce(m["content"] != "", F.lit(False)))
    return F.coalesce((F.size(messages) > 0) & filled & F.exists(messages, lambda m: m["role"] == "assistant"), F.lit(False))


def checked_messages(messages: Column) -> Column:
    """Role and content of each message; raises on invalid ones."""
    bare = F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return F.when(valid_messages(messages), bare).otherwise(F.raise_error(F.lit("messages need roles, contents and an assistant")).cast("array<struct<role:string,content:string>>"))


def strip_left(text: Column) -> Column:
    """Without white space in front, Unicode white space included."""
    return F.regexp_replace(text, r"(?U)^\s+", "")


def last_assistant(messages: Column) -> Column:
    """0-based index of the last assistant message, -1 without one."""
    n = F.size(messages)
    last = F.array_max(F.transform(F.filter(F.transform(messages, lambda m, i: F.struct(m["role"].alias("role"), i.alias("i"))), lambda x: x["role"] == "assistant"), lambda x: x["i"]))
    return F.when(n > 0, F.coalesce(last, F.lit(-1))).otherwise(F.lit(-1))


def _char_at(text: Column, needle: str, start: Column | int = 1) -> Column:
    return F.call_function("locate", F.lit(needle), text, F.lit(start) if isinstance(start, int) else start)


def trace_parts(content: Column) -> Column:
    """struct(trace, answer) of an assistant message: the first <think> to the first </think> after it, tags included,
    and what follows without white space in front. Null without both tags or without an answer."""
    a = _char_at(content, OPEN)
    b = _char_at(content, CLOSE, a + len(OPEN))
    end = b + len(CLOSE)
    trace = F.substring(content, a, end - a)
    answer = strip_left(F.substring(content, end, F.length(content)))
    return F.when((a > 0) & (b > 0) & (answer != ""), F.struct(trace.alias("trace"), answer.alias("answer")))


def replace_trace(messages: Column, index: Column, replacement: Column) -> Column:
    """The messages with the inside of the indexed message's trace replaced; both tags stay."""
    def swap(m: Column) -> Column:
        c = m["content"]
        a = _char_at(c, OPEN) + len(OPEN)
        b = _char_at(c, CLOSE, a)
        return F.struct(m["role"].alias("role"), F.concat(F.substring(c, F.lit(1), a - 1), replacement, F.substring(c, b, F.length(c))).alias("content"))

    return F.transform(messages, lambda m, i: F.when(i == index, swap(m)).otherwise(F.struct(m["role"].alias("role"), m["content"].alias("content"))))


def prefix_messages(messages: Column, index: Column) -> Column:
    return F.slice(messages, F.lit(1), F.greatest(index, F.lit(0)))


def render(messages: Column, generation_prompt: bool = False) -> Column:
    """The plain template: <|role|>, content and a line feed after either."""
    text = F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"], F.lit("\n"))), "")
    return F.concat(text, F.lit("<|assistant|>\n")) if generation_prompt else text


#: Places in a text are found by one pass over it. A fold over an array copies what it has at every step, so its time
#: grows with the square of the words; an Arrow function over batches of rows does not. Texts and places become Python
#: objects for so many rows at a time, which bounds a worker whatever the batch.
PLACED_ROWS = 32


def _placed(name: str, rows) -> pa.Array:
    """Rows of (name, start, end) triples, or None, as an array of lists of structs."""
    names, starts, ends, cuts = [], [], [], []
    for places in rows:
        cuts.append(None if places is None else len(names))
        for label, start, end in places or ():
            names.append(label)
            starts.append(start)
            ends.append(end)
    item = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[name, "start", "end"])
    return pa.ListArray.from_arrays(pa.array([*cuts, len(names)], pa.int32()), item)


def _places(name: str):
    kind = ArrayType(StructType([StructField(name, StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))

    def column(f):
        def batch(columns) -> pa.Array:
            n = len(columns[0])
            parts = (zip(*(c.slice(at, PLACED_ROWS).to_pylist() for c in columns), strict=True) for at in range(0, n, PLACED_ROWS))
            out = [_placed(name, (f(*row) for row in part)) for part in parts]
            return pa.concat_arrays(out) if out else _placed(name, ())

        def one(a: pa.Array) -> pa.Array:
            return batch([a])

        def three(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
            return batch([a, b, c])

        return F.arrow_udf(three if f.__code__.co_argcount == 3 else one, kind)

    return column


@_places("role")
def _spans_of(roles: list[str] | None, contents: list[str] | None, rendered: str | None):
    if roles is None or rendered is None:
        return None
    out, cursor = [], 0
    for role, content in zip(roles, contents, strict=True):
        at = -1 if content is None else rendered.find(content, cursor)
        if at >= 0:
            cursor = at + len(content)
        out.append((role, at, cursor if at >= 0 else -1))
    return out


def message_spans(messages: Column, rendered: Column) -> Column:
    """array<struct(role, start, end)>: contents found from left to right, 0-based and half-open; start -1 if missing."""
    return _spans_of(F.transform(messages, lambda m: m["role"]), F.transform(messages, lambda m: m["content"]), rendered)


def assistant_spans(messages: Column, rendered: Column) -> Column:
    """The spans of the assistant's messages; raises where the text lacks one of the messages."""
    spans = message_spans(messages, rendered)
    missing = F.raise_error(F.lit("the text lacks a message")).cast("array<struct<role:string,start:int,end:int>>")
    whole = F.when(F.exists(spans, lambda s: s["start"] < 0), missing).otherwise(spans)
    return F.filter(whole, lambda s: s["role"] == "assistant")


def last_index(text: Column, needle: Column) -> Column:
    """0-based place of the last occurrence, -1 without one."""
    at = F.call_function("locate", F.reverse(needle), F.reverse(text), F.lit(1))
    return F.when(at > 0, F.length(text) - at - F.length(needle) + 1).otherwise(F.lit(-1))


def answer_span(messages: Column, rendered: Column, answer: Column) -> Column:
    """struct(start, end) of the answer: in the first assistant message that has it, else its last occurrence, else null."""
    def inside(s: Column) -> Column:
        at = F.call_function("locate", answer, rendered, s["start"] + 1)
        return (s["start"] >= 0) & (at > 0) & (at - 1 + F.length(answer) <= s["end"])

    spans = message_spans(messages, rendered)
    # the search stops at the first message that is not where it should be
    broken = F.array_position(F.transform(spans, lambda s: s["start"]), F.lit(-1))
    reached = F.when(broken > 0, F.slice(spans, F.lit(1), (broken - 1).cast("int"))).otherwise(spans)
    first = F.try_element_at(F.filter(reached, lambda s: (s["role"] == "assistant") & inside(s)), F.lit(1))
    # without such a message there is no place to start from, which locate would take for "not found"
    near = F.when(first.isNotNull(), F.call_function("locate", answer, rendered, first["start"] + 1) - 1)
    start = F.coalesce(near, F.nullif(last_index(rendered, answer), F.lit(-1)))
    return F.when(start.isNotNull(), F.struct(start.cast("int").alias("start"), (start + F.length(answer)).cast("int").alias("end")))


def word_tokens(text: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")


_WORD = re.compile(r"[^ \t\n\x0b\f\r]+")


@_places("token")
def _offsets_of(text: str | None):
    return None if text is None else ((m[0], m.start(), m.end()) for m in _WORD.finditer(text))


def word_offsets(text: Column) -> Column:
    """array<struct(token, start, end)>: words with their half-open places in the text."""
    return _offsets_of(text)


_MARKED = re.compile(r"<\|\w+\|>|</?think>|[^ \t\n\x0b\f\r<]+|<")


@_places("token")
def _marked_of(text: str | None):
    return None if text is None else ((m[0], m.start(), m.end()) for m in _MARKED.finditer(text))


def marked_offsets(text: Column) -> Column:
    """Words with their places, parted at tags and special tokens."""
    return _marked_of(text)


def overlaps(token: Column, spans: Column) -> Column:
    """Whether a token's half-open place meets a span; tokens of no width meet nothing."""
    return F.exists(spans, lambda s: (token["start"] < s["end"]) & (token["end"] > s["start"])) & (token["end"] > token["start"])


def labels(tokens: Column, ids: Column, spans: Column) -> Column:
    """Token ids where the token overlaps a span, -100 elsewhere."""
    return F.zip_with(tokens, ids, lambda t, i: F.when(overlaps(t, spans), i).otherwise(F.lit(IGNORE)))


def truncate_left(ids: Column, size: int) -> Column:
    return F.when(F.size(ids) > size, F.slice(ids, -size, size)).otherwise(ids)


def placeholders(k: Column) -> Column:
    return F.repeat(F.lit(PLACEHOLDER), k)


def positions(values: Column, wanted) -> Column:
    """0-based places of a value."""
    return F.transform(F.filter(F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), lambda x: x["v"] == wanted), lambda x: x["i"])


def model_slug(name: str) -> str:
    return name.replace("/", "__").replace(" ", "_")


def entropy_table_path(folder: str, model: str) -> str:
    return f"{folder.rstrip('/')}/cot_entropies__{model_slug(model)}"


def method_name(family: str, patching_tag: str | None = None, param: str | None = None) -> str:
    return "_".join(x for x in (family, param, patching_tag) if x)


def settled(rows, **columns: Column):
    """rows with the columns added as plain values.

    Catalyst merges projections, so an expression that a lambda refers to would be evaluated for every element. A
    generator is not merged: each expression is evaluated once a row.
    """
    bounded_batches(rows.sparkSession)
    packed = F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("_settled")
    return rows.select("*", packed).select(*[F.col(c) for c in rows.columns if c not in columns], *[F.col(f"_settled.{k}").alias(k) for k in columns])
