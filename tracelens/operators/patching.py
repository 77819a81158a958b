"""Segmentation of ordered sequences: strategies that cut [0, n) into spans in a row, as window plans.

A strategy takes rows (key, pos, h) and adds ``patch``, the number of the span that the row is in. ``spans`` turns that
into (key, patch, start, end).
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelens.functions.numeric import half_even, hash_bucket, number_tag, with_quantile


@dataclass(frozen=True)
class Strategy:
    """Base of the strategies. ``needs_entropy``: whether rows without ``h`` must be left out first."""

    key: str = "sample_index"
    pos: str = "pos"
    h: str = "h"
    needs_entropy = False

    @property
    def order(self):
        return Window.partitionBy(self.key).orderBy(self.pos)

    @property
    def whole(self):
        return Window.partitionBy(self.key)

    def tag(self) -> str:
        raise NotImplementedError

    def apply(self, rows: DataFrame) -> DataFrame:
        raise NotImplementedError

    def _from_starts(self, rows: DataFrame, is_start: Column) -> DataFrame:
        flag = F.when((F.col(self.pos) == 0) | F.coalesce(is_start, F.lit(False)), 1).otherwise(0)
        return rows.withColumn("patch", (F.sum(flag).over(self.order.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))


def _checked(ratio: float) -> float:
    if ratio < 1:
        raise ValueError("a ratio is at least 1")
    return ratio


@dataclass(frozen=True)
class Single(Strategy):
    """One span."""

    def tag(self) -> str:
        return ""

    def apply(self, rows):
        return rows.withColumn("patch", F.lit(0))


@dataclass(frozen=True)
class Uniform(Strategy):
    """Spans of one size, the ratio rounded half to even; the last may be shorter."""

    ratio: float = 8.0

    def __post_init__(self):
        _checked(self.ratio)

    @property
    def size(self) -> int:
        return max(1, half_even(self.ratio))

    def tag(self) -> str:
        return f"uniform_cr{number_tag(self.ratio)}"

    def apply(self, rows):
        return rows.withColumn("patch", F.floor(F.col(self.pos) / F.lit(self.size)).cast("int"))


@dataclass(frozen=True)
class Threshold(Strategy):
    """A span starts at every value at or above the sequence's (1 - 1/ratio) quantile."""

    ratio: float = 2.0
    needs_entropy = True

    def __post_init__(self):
        _checked(self.ratio)

    def tag(self) -> str:
        return f"entropy_threshold_cr{number_tag(self.ratio)}"

    def apply(self, rows):
        cut = F.percentile(self.h, F.lit(1 - 1 / self.ratio)).over(self.whole)
        return self._from_starts(rows, F.col(self.h) >= cut)


@dataclass(frozen=True)
class Diff(Strategy):
    """A span starts where the rise over the value before is above the rises' (1 - 1/ratio) quantile."""

    ratio: float = 2.0
    needs_entropy = True

    def __post_init__(self):
        _checked(self.ratio)

    def tag(self) -> str:
        return f"entropy_diff_cr{number_tag(self.ratio)}"

    def apply(self, rows):
        rise = rows.withColumn("_rise", F.col(self.h) - F.lag(self.h).over(self.order))
        cut = with_quantile(rise, "_rise", 1 - 1 / self.ratio, self.key, "_cut")
        return self._from_starts(cut, F.col("_rise") > F.col("_cut")).drop("_rise", "_cut")


@dataclass(frozen=True)
class Budget(Strategy):
    """Spans of about equal sums: cut k is at the first running sum above k budgets, at least at 1.

    The running sum of a row has passed ``least(K - 1, ceil(sum / budget) - 1)`` cuts, so a row starts a span where that
    number is above its neighbour's. K is the length over the ratio, which is the total over the budget. A sequence without any sum is cut uniformly.
    """

    ratio: float = 2.0
    needs_entropy = True

    def __post_init__(self):
        _checked(self.ratio)

    def tag(self) -> str:
        return f"entropy_sum_cr{number_tag(self.ratio)}"

    def apply(self, rows):
        return self.with_budget(rows).drop("_budget")

    def with_budget(self, rows: DataFrame) -> DataFrame:
        """The rows with their span's number and the ``_budget`` that it was cut by."""
        size = max(1, half_even(self.ratio))
        running = self.order.rowsBetween(Window.unboundedPreceding, 0)
        x = rows.withColumn("_cum", F.sum(self.h).over(running)).withColumn("_n", F.count(F.lit(1)).over(self.whole))
        x = x.withColumn("_total", F.max_by("_cum", self.pos).over(self.whole))
        x = x.withColumn("_budget", F.col("_total") * F.lit(float(self.ratio)) / F.col("_n"))
        count = F.greatest(F.lit(1.0), F.rint(F.col("_n") / F.lit(float(self.ratio))))
        passed = F.least(count - 1, F.greatest(F.lit(0.0), F.ceil(F.col("_cum") / F.col("_budget")) - 1))
        x = x.withColumn("_passed", F.when(F.col("_total") > 0, passed))
        before = F.lag("_passed").over(self.order)
        start = F.when(F.col("_total") > 0, (F.col("_passed") > before) | ((F.col(self.pos) == 1) & (before >= 1))).otherwise(F.pmod(F.col(self.pos), F.lit(size)) == 0)
        return self._from_starts(x, start).drop("_cum", "_n", "_total", "_passed")


@dataclass(frozen=True)
class Exponential(Strategy):
    """Span lengths 2**i with i drawn from 0..top for each span by a hash of seed, sample and span number."""

    top: int = 6
    seed: int = 42

    def __post_init__(self):
        if self.top < 0:
            raise ValueError("the largest exponent is at least 0")

    def tag(self) -> str:
        return f"random_exp{self.top}"

    def lengths(self, rows: DataFrame) -> DataFrame:
        """(key, patch, start, end) straight from the sequence lengths."""
        sizes = rows.groupBy(self.key).agg((F.max(self.pos) + 1).cast("long").alias("n"))
        drawn = sizes.select(self.key, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
        length = F.pow(F.lit(2.0), hash_bucket(F.concat(F.lit(f"{self.seed}:"), F.col(self.key).cast("string"), F.lit(":"), F.col("k").cast("string")), self.top + 1)).cast("long")
        w = Window.partitionBy(self.key).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
        summed = drawn.withColumn("len", length).withColumn("stop", F.sum("len").over(w)).withColumn("start", F.col("stop") - F.col("len"))
        return summed.where("start < n").select(self.key, F.col("k").cast("int").alias("patch"), F.col("start").cast("int").alias("start"), F.least("stop", "n").cast("int").alias("end"))

    def apply(self, rows):
        starts = self.lengths(rows).select(self.key, F.col("start").alias(self.pos), F.lit(1).alias("_start"))
        flagged = rows.join(starts, [self.key, self.pos], "left")
        return self._from_starts(flagged, F.col("_start") == 1).drop("_start")


def compat_exponential(n: int, sample: int, top: int = 6, seed: int = 42) -> list[tuple[int, int]]:
    """Spans by the standard library's generator, seeded with seed + sample."""
    rng, out, at = random.Random(seed + sample), [], 0
    while at < n:
        to = min(n, at + 2 ** rng.randint(0, top))
        out.append((at, to))
        at = to
    return out


def compat_spans(sizes: DataFrame, key: str = "sample_index", n: str = "n", top: int = 6, seed: int = 42) -> DataFrame:
    """(key, spans array<struct<start,end>>) by the standard library's generator, in Arrow batches."""

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def draw(k: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b} for a, b in compat_exponential(int(y), int(x), top, seed)] for x, y in zip(k, m, strict=True)])

    return sizes.select(key, draw(F.col(key), F.col(n)).alias("spans"))


STRATEGIES = {"uniform": Uniform, "random": Exponential, "exponential": Exponential, "entropy_threshold": Threshold, "entropy_diff": Diff, "entropy_sum": Budget, "none": Single}


def build(name: str | None, **options) -> Strategy:
    try:
        return STRATEGIES[name or "none"](**options)
    except KeyError:
        raise ValueError(f"no strategy {name}") from None


def spans(rows: DataFrame, strategy: Strategy) -> DataFrame:
    """(key, patch, start, end), half-open."""
    patched = strategy.apply(rows)
    return patched.groupBy(strategy.key, "patch").agg(F.min(strategy.pos).cast("int").alias("start"), (F.max(strategy.pos) + 1).cast("int").alias("end"))
