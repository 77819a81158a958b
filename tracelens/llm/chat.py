"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

A raw transcript is a run of lines; where its messages begin and end is not known. Each line shows one symbol: what kind
of speaker marker it starts with, if any (a word for a system, a user or an assistant, some other name, a quoting sign),
with features of the line (question or not, length, list or code). The hidden state is the speaker's role. Emission
tables, a start table and two transition tables, for lines with and without a marker, come from counts over lines of
known roles; Viterbi recovers the roles of all lines, and a turn begins where the role changes or a marker stands.

A conversation may be of any length. Its rows, in order, are pieces of its transcript. They are sorted by range, so a
hot conversation goes over many tasks, and cut into blocks by row number. A first pass reduces each block to a max-plus
matrix, a second chains the small matrices of a conversation and fixes the state each block ends in, a third traces the
block back from there. So no task sees more than a block at a time, or one matrix a block.

Defined cases: null and empty texts are one empty line; rows without a turn number come first, ties go by text, rows
repeated in full are rows of their own; null turns or one turn throughout make blocks like any others; rows without a
conversation are one conversation; null and unknown roles teach nothing; without any known role every line is of the
first role; an empty table gives an empty result; other columns are ignored. A text is held in memory as a whole.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tracelens.llm.common import crc32_mod, schema_of, small_batches, table, tidy_shuffles
from tracelens.session import ensure_checkpoint_dir

ROLES = ("system", "user", "assistant")
#: Rows of a conversation in a block.
BLOCK = 256

# Fixed lists: words that name a speaker's kind, as they stand in transcripts of many sources.
SPEAKERS = {
    "system": ("system", "sys", "instruction", "instructions", "context", "setup"),
    "user": ("user", "human", "q", "question", "customer", "client", "me", "you", "prompter", "input"),
    "assistant": ("assistant", "ai", "a", "answer", "bot", "gpt", "model", "agent", "support", "output", "response"),
}
_KIND = {w: 1 + k for k, words in enumerate(SPEAKERS.values()) for w in words}
OTHER, QUOTE = 4, 5
_MARK = re.compile(r"\s{0,8}(?:[\[(<*#|]{1,4}\s?([A-Za-z][\w .'-]{0,24}?)\s?[\])>*|]{1,4}:?|([A-Za-z][\w'-]{0,24}(?: [A-Z0-9][\w'-]{0,24})?)\s?:)(?=\s|$)\s{0,8}")
_QUOTE = re.compile(r"\s{0,8}(?:>{1,3}|-{2,3}|—)\s")
_ITEM = re.compile(r"\s{0,8}(?:[-*•]|\d{1,3}[.)]|```|    |\t)")
N_SYMBOLS = 6 * 2 * 3 * 2


def symbol(line: str) -> tuple[int, str]:
    """The line's symbol and its text without a speaker's name. Quoting signs stay: they may belong to the text."""
    m, mark, rest = _MARK.match(line), 0, line
    if m:
        name = (m[1] or m[2]).lower().split()
        mark = next((_KIND[w.rstrip("s0123456789")] for w in name if w.rstrip("s0123456789") in _KIND), _KIND.get(name[0], OTHER))
        rest = line[m.end() :]
    elif _QUOTE.match(line):
        mark = QUOTE
    size = 0 if len(rest) < 60 else 1 if len(rest) < 240 else 2
    return ((mark * 2 + ("?" in rest)) * 3 + size) * 2 + bool(_ITEM.match(rest)), rest


def marked(sym: int) -> int:
    """Whether the line has a speaker's name or a quoting sign in front; it chooses the transition table."""
    return int(sym >= 12)


def symbols(text: str | None) -> tuple[list[int], list[str]]:
    out = [symbol(x) for x in (text or "").split("\n")]
    return [a for a, _ in out], [b for _, b in out]


#: Ways to name speakers that ``raw_transcripts`` writes, by the conversation's hash: for a user, an assistant and a system.
STYLES = (("User:", "Assistant:", "System:"), ("**Customer**:", "**Support agent**:", "**Setup**:"), ("Maria:", "Theo:", "Note:"), ("[human 1]", "[bot]", "[context]"), (">", "", ""))


def raw_transcripts(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): a test corpus of raw transcripts from conversations, piece by piece.

    A conversation's hash picks one of STYLES, of which some tell nothing of the role and one marks users' lines alone.
    A message's name stands in a line of its own or before its text, and two of five messages have none. role is kept
    for training and for measuring.
    """
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    style = F.pmod(F.xxhash64(F.lit("style"), conv), F.lit(len(STYLES))).cast("int")
    how = F.pmod(F.xxhash64(F.lit("mark"), conv, turn), F.lit(5))
    name = F.lit("")
    for k, names in enumerate(STYLES):
        for role, n in zip(("user", "assistant", "system"), names, strict=True):
            name = F.when((style == k) & (F.col("role") == role), n).otherwise(name)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    shown = F.when((how < 2) | (name == ""), text).when((how == 2) & (name != ">"), F.concat(name, F.lit("\n"), text)).otherwise(F.concat(name, F.lit(" "), text))
    return conversations.select(conv.alias("conv_id"), turn.alias("turn"), "role", shown.alias("text"))


class Hmm:
    """Log tables: start (roles), step (unmarked or marked line, roles, roles), emit (roles, symbols)."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray):
        self.start, self.step, self.emit = start, step, emit
        self.moves = [step[marked(s)] + emit[:, s][None, :] for s in range(N_SYMBOLS)]

    def advance(self, sym: int) -> np.ndarray:
        """max-plus matrix of one line: from the role before to the role of this line."""
        return self.moves[sym]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Runs of rows with the same first ``keys`` columns, over batch ends."""
    rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
    return itertools.groupby(rows, key=lambda r: r[:keys])


def _write(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    while part := list(itertools.islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


def _map(df: DataFrame, f, ddl: str) -> DataFrame:
    schema = schema_of(ddl)
    arrow = to_arrow_schema(schema)
    return df.mapInArrow(lambda batches: _write(f(batches), arrow), schema)


def _sorted_map(df: DataFrame, by: list[str], order: list, f, ddl: str) -> DataFrame:
    """f over each key's rows in order: rows are dealt by the keys and sorted."""
    return _map(df.repartition(*by).sortWithinPartitions(*by, *order), f, ddl)


def in_blocks(messages: DataFrame) -> DataFrame:
    """(conv_id, block, at, turn, role, text): rows in the order of their conversation, numbered within blocks.

    Sorted ranges follow each other, so a block's number is its range's number and its own within that; ranges are drawn
    by sampling, so the result is to be checkpointed before it is used twice.
    """

    def number(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        for (conv,), run in _groups(batches, 1):
            for k, r in enumerate(run):
                yield conv, part + k // BLOCK, k % BLOCK, *r[1:]

    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("text"), F.col("role").asc_nulls_first()]
    # rows alike in all of these may still be very many: a number of their own deals them to several ranges
    spread = rows.withColumn("tie", F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20)))
    return _map(spread.repartitionByRange(*order, "tie").sortWithinPartitions(*order, "tie").drop("tie"), number, "conv_id long, block long, at int, turn long, role string, text string")


def count_lines(blocks: DataFrame, learn: Column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, steps, emissions) of the rows of known role where ``learn`` holds, over block ends; counts of a fixed number of cells.

    A step is between two lines in a row of one conversation. Each block goes on as one row with the role it ends in and
    the role and kind of line it begins with; the last role is passed to the conversation's next block.
    """
    k = len(ROLES)

    def count(batches):
        cells: dict[tuple, int] = {}
        for (conv, block), run in _groups(batches, 2):
            before = first = None
            for r in run:
                role = ROLES.index(r[3]) if r[3] in ROLES else -1
                for s in symbols(r[4])[0]:
                    if first is None:
                        first = (role, marked(s))
                    elif before >= 0 and role >= 0:
                        cells["s", marked(s), before, role] = cells.get(("s", marked(s), before, role), 0) + 1
                    if role >= 0:
                        cells["e", 0, role, s] = cells.get(("e", 0, role, s), 0) + 1
                    before = role
            yield "b", conv, block, *first, before, 1
        for (kind, m, a, b), n in cells.items():
            yield kind, None, None, a, m, b, n

    rows = _sorted_map(blocks.where(learn).select("conv_id", "block", "at", "role", "text"), ["conv_id", "block"], ["at"], count, "kind string, conv_id long, block long, a int, m int, b int, n long").checkpoint()
    ends = rows.where("kind = 'b'").withColumn("before", F.lag("b").over(Window.partitionBy("conv_id").orderBy("block")))
    met = ends.select(F.when(F.col("before").isNull(), "0").otherwise("s").alias("kind"), F.coalesce("before", F.lit(0)).alias("a"), "m", F.col("a").alias("b"), "n").where("a >= 0 and b >= 0")
    total = rows.where("kind <> 'b'").select("kind", "a", "m", "b", "n").unionByName(met).groupBy("kind", "a", "m", "b").agg(F.sum("n").alias("n"))
    start, steps, emit = np.zeros(k), np.zeros((2, k, k)), np.zeros((k, N_SYMBOLS))
    for r in total.collect():  # at most 3 + 18 + 3 * N_SYMBOLS rows
        if r.kind == "0":
            start[r.b] += r.n
        elif r.kind == "s":
            steps[r.m, r.a, r.b] += r.n
        else:
            emit[r.a, r.b] += r.n
    return start, steps, emit


def fit(blocks: DataFrame, learn: Column | None = None) -> Hmm:
    """Tables from counts with one added to each."""
    log = lambda x: np.log((x + 1) / (x + 1).sum(axis=-1, keepdims=True))
    start, steps, emit = count_lines(blocks, F.lit(True) if learn is None else learn)
    if not emit.any():  # nothing is known: all lines are of the first role
        return Hmm(np.array([0.0, -1.0, -1.0]), np.zeros((2, 3, 3)) + np.array([0.0, -1.0, -1.0]), np.zeros((3, N_SYMBOLS)))
    return Hmm(log(start), log(steps), log(emit))


def _product(matrices: Iterator[np.ndarray]) -> np.ndarray:
    out = next(matrices)
    for m in matrices:
        out = (out[:, :, None] + m[None, :, :]).max(axis=1)
    return out


def viterbi(hmm: Hmm, syms: list[int], enter: np.ndarray, leave: int) -> list[int]:
    """The best roles of a block's lines, given the log scores of the role before it and the role of its last line."""
    score, back = enter, []
    for s in syms:
        m = score[:, None] + hmm.advance(s)
        back.append(m.argmax(axis=0))
        score = m.max(axis=0)
    out = [leave]
    for b in reversed(back[1:]):
        out.append(int(b[out[-1]]))
    return out[::-1]


def render(roles: list[str], starts: list[bool], lines: list[str], opening: bool = True, closing: bool = True) -> str:
    """Canonical turns of a piece of a transcript: <|role|>, the turn's lines, <|end|> before the next one.

    ``opening``: the transcript begins with this piece; ``closing``: it ends with it. The pieces' texts in a row are the
    whole.
    """
    out = []
    for k, (role, start, line) in enumerate(zip(roles, starts, lines, strict=True)):
        if start:
            out.append(f"<|{role}|>\n" if opening and k == 0 else f"<|end|>\n<|{role}|>\n")
        out.append(line + "\n")
    return "".join(out) + ("<|end|>\n" if closing else "")


def recover(blocks: DataFrame, hmm: Hmm) -> DataFrame:
    """(conv_id, block, at, turn, n_lines, roles, starts, rendered) for each row of ``in_blocks``: the roles of its lines, which of
    them begin a turn, and its part of the canonical transcript."""
    small_batches(blocks.sparkSession)
    k = len(ROLES)

    def squeeze(batches):
        for key, run in _groups(batches, 2):
            yield (*key, _product(hmm.advance(s) for r in run for s in symbols(r[3])[0]).ravel().tolist())

    def chain(batches):
        for (conv,), run in _groups(batches, 1):
            run = list(run)
            enter, scores = [], hmm.start - np.log(k)  # the start table stands for the role before the first line
            matrices = [np.array(r[2]).reshape(k, k) for r in run]
            for m in matrices:
                enter.append(scores)
                scores = (scores[:, None] + m).max(axis=0)
                scores = scores - scores.max()
            leave = [int(scores.argmax())]
            for m, e in zip(reversed(matrices), reversed(enter), strict=True):
                leave.append(int((e + m[:, leave[-1]]).argmax()))
            leave = leave[::-1]  # the role before each block, and of its last line
            for i, (r, e) in enumerate(zip(run, enter, strict=True)):
                yield conv, r[1], e.tolist(), leave[i] if i else -1, leave[i + 1], i == len(run) - 1

    def trace(batches):
        for _, run in _groups(batches, 2):
            run = list(run)
            parts = [symbols(r[4]) for r in run]
            syms = [s for p, _ in parts for s in p]
            enter, before, leave, last = run[0][5:9]
            found = viterbi(hmm, syms, np.array(enter), leave)
            at = 0
            for i, (r, (own, lines)) in enumerate(zip(run, parts, strict=True)):
                mine = found[at : at + len(own)]
                starts = [a != b or 12 <= s < 12 * QUOTE for a, b, s in zip(mine, [before, *mine[:-1]], own, strict=True)]
                roles = [ROLES[x] for x in mine]
                yield r[0], r[1], r[2], r[3], len(own), roles, starts, render(roles, starts, lines, before < 0, last and i == len(run) - 1)
                at, before = at + len(own), mine[-1]

    ends = _sorted_map(
        _sorted_map(blocks.select("conv_id", "block", "at", "text"), ["conv_id", "block"], ["at"], squeeze, "conv_id long, block long, matrix array<double>"),
        ["conv_id"], ["block"], chain, "conv_id long, block long, enter array<double>, before int, leave int, last boolean",
    )
    e = ends.select(F.col("conv_id").alias("e_conv"), F.col("block").alias("e_block"), "enter", "before", "leave", "last")
    joined = blocks.join(e, F.col("conv_id").eqNullSafe(F.col("e_conv")) & (F.col("block") == F.col("e_block"))).select("conv_id", "block", "at", "turn", "text", "enter", "before", "leave", "last")
    return _sorted_map(joined, ["conv_id", "block"], ["at"], trace, "conv_id long, block long, at int, turn long, n_lines long, roles array<string>, starts array<boolean>, rendered string")


def held_out(conv_id: Column) -> Column:
    """Conversations that no table is counted from."""
    return crc32_mod(conv_id, 4) == 2


def parse_chats(messages: DataFrame, learn: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows as ``recover`` gives them, rows as ``in_blocks`` gives them); tables are counted where ``learn`` holds.

    The rows in blocks are cut off with a checkpoint: ranges drawn anew would be other blocks.
    """
    spark = messages.sparkSession
    ensure_checkpoint_dir(spark)
    small_batches(spark)
    with tidy_shuffles(spark):
        blocks = in_blocks(messages).checkpoint()
        hmm = fit(blocks, learn)
    return recover(blocks, hmm), blocks


def op10_chat_roles(spark, sf_dir: str) -> DataFrame:
    """The pieces of each transcript with the roles of their lines; every fourth conversation is held out of training."""
    out, _ = parse_chats(raw_transcripts(table(spark, sf_dir, "conversations")), ~held_out(F.col("conv_id")))
    return out.select("conv_id", "block", "at", "turn", held_out(F.col("conv_id")).alias("held_out"), "n_lines", F.element_at("roles", 1).alias("role"), F.concat_ws(",", "roles").alias("roles"), F.size(F.filter("starts", lambda x: x)).cast("long").alias("n_turns"), "rendered")
