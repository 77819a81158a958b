"""Scalar and array expressions, and a quantile over windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed grid of the log-probability sketch: bins of 0.01 from -30 to 0.
LO, HI, BINS = -30.0, 0.0, 3000


def half_even(x: float) -> int:
    """Python's round: halves go to the even neighbour."""
    return round(x)


def number_tag(x: float) -> str:
    return f"{x:g}"


def hash_bucket(key: Column, n: Column | int) -> Column:
    """A number in [0, n) from the first 32 bits of the md5 of a text."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long"), n if isinstance(n, Column) else F.lit(n).cast("long"))


def bin_index(logprob: Column) -> Column:
    """The sketch's bin, truncated towards zero; negative below the grid, the last bin at and above its end."""
    return F.least(((logprob - F.lit(LO)) * F.lit(100.0)).cast("int"), F.lit(BINS - 1))


def bin_centre(b: Column) -> Column:
    return F.lit(LO) + (b + F.lit(0.5)) * F.lit(0.01)


def log_sum_exp(logits: Column) -> Column:
    top = F.array_max(logits)
    return top + F.log(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top)))


def softmax_entropy(logits: Column) -> Column:
    """Entropy in nats of the softmax of an array of logits."""
    z = log_sum_exp(logits)
    return z - F.aggregate(logits, F.lit(0.0), lambda a, x: a + x * F.exp(x - z))


def label_logprob(logits: Column, label: Column) -> Column:
    """log softmax at a label; null where the label is the ignore mark -100."""
    return F.when(label != -100, F.try_element_at(logits, (label + 1).cast("int")) - log_sum_exp(logits))


def safe_ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), F.nullif(whole.cast("double"), F.lit(0.0)))


def cosine_warmup(step: Column, warmup: int, total: int) -> Column:
    """Learning-rate factor: linear warmup, then half a cosine down to 0."""
    return F.when(step < warmup, step / F.lit(float(max(1, warmup)))).otherwise(F.greatest(F.lit(0.0), 0.5 * (1 + F.cos(F.lit(3.141592653589793) * (step - warmup) / F.lit(float(max(1, total - warmup)))))))


def optimizer_steps(rows: Column, batch: int, accumulation: int, epochs: int) -> Column:
    return (F.ceil(F.ceil(rows / F.lit(batch)) / F.lit(accumulation)) * F.lit(epochs)).cast("long")


def every(step: Column, interval: int) -> Column:
    """Interval trigger of a step counter; never for an interval of 0."""
    return F.lit(False) if not interval else F.pmod(step, F.lit(interval)) == 0


def pad_right(values: Column, width: Column, fill) -> Column:
    return F.concat(values, F.array_repeat(F.lit(fill), F.greatest(width - F.size(values), F.lit(0)).cast("int")))


def attention_mask(length: Column, width: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), width.cast("int")), lambda i: (i <= length).cast("int"))


def _halves(x: Column) -> tuple[Column, Column]:
    """x as a sum of two numbers of half the digits each."""
    c = x * F.lit(134217729.0)
    high = c - (c - x)
    return high, x - high


def fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c with one rounding at the end, from what the product and the sum lose."""
    (ah, al), (bh, bl) = _halves(a), _halves(b)
    p = a * b
    s = p + c
    back = s - p
    lost = al * bl - (((p - ah * bh) - al * bh) - ah * bl)
    exact = s + (((p - (s - back)) + (c - back)) + lost)
    return F.when((F.abs(a) < 1e150) & (F.abs(b) < 1e150) & (F.abs(c) < 1e150), exact).otherwise(s)


def with_quantile(rows: DataFrame, value: str, q: float, key: str, name: str) -> DataFrame:
    """rows with the quantile of a column over all rows of their key, nulls left out.

    It is interpolated as the catalogue's SQL engine does it: the lower neighbour's share is added by a fused
    multiplication, whose last bit decides about rows that are as good as equal to the quantile.
    """
    whole = Window.partitionBy(key)
    x = rows.withColumn("_at", (F.count(value).over(whole) - 1) * F.lit(float(q)))
    x = x.withColumn("_place", F.row_number().over(whole.orderBy(F.col(value).asc_nulls_last())) - 1)
    x = x.select("*", *[F.max(F.when(F.col("_place") == f("_at"), F.col(value))).over(whole).alias(k) for k, f in (("_low", F.floor), ("_high", F.ceil))])
    d = F.col("_at") - F.floor("_at")
    cut = F.when(d == 0, F.col("_low")).otherwise(fused(F.col("_low"), 1 - d, F.col("_high") * d))
    return x.withColumn(name, cut).drop("_at", "_place", "_low", "_high")


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)
