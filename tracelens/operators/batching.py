"""Greedy batches under a row and a padded-token limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _batch_numbers(lengths: list[int] | None, rows: int, tokens: int) -> list[int] | None:
    if lengths is None:
        return None
    out, batch, n, longest = [], 0, 0, 0
    for x in lengths:
        if n and (n >= rows or max(longest, x) * (n + 1) > tokens):
            batch, n, longest = batch + 1, 0, 0
        n, longest = n + 1, max(longest, x)
        out.append(batch)
    return out


def greedy_batch_ids(lengths: Column, rows: int, tokens: int) -> Column:
    """Batch numbers of an array of lengths: a batch closes before a row that would pass either limit.

    Padded cost is the longest length times the rows. The limit is not tested on an empty batch, so a row above it is
    alone. Each step depends on the last, so this is one pass over an array, in Arrow batches of arrays: a fold in SQL
    would copy its result at every step.
    """
    return F.udf(lambda x: _batch_numbers(x, rows, tokens), "array<int>", useArrow=True)(lengths.cast("array<long>"))


def greedy_batches(items: DataFrame, group: str, order: list[str], length: str, rows: int, tokens: int) -> DataFrame:
    """(group, order columns, length, batch): batches within each group, which bounds the fold."""
    cols = [*order, length]
    packed = items.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("x"))
    ids = packed.withColumn("b", greedy_batch_ids(F.transform("x", lambda s: s[length]), rows, tokens))
    flat = ids.select(group, F.explode(F.arrays_zip("x", "b")).alias("z"))
    return flat.select(group, *[F.col(f"z.x.{c}").alias(c) for c in cols], F.col("z.b").alias("batch"))
