"""Tables behind plots: box statistics, densities, curves, orders, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EDGES = 80  # edges of a density, so 79 bins


def probabilities(rows: DataFrame, column: str = "logprob", to: str = "prob") -> DataFrame:
    return rows.withColumn(to, F.exp(column))


def quantiles_by_bins(rows: DataFrame, value: str, qs: tuple[float, ...], by: str | None = None) -> DataFrame:
    """(by, q0, q1, ...): exact quantiles, linear between neighbours, in two passes.

    The first pass counts rows in equal bins between each group's ends and finds the bins that hold the wanted ranks;
    the second orders the values of these bins alone. No task holds a group's values, but those of one bin.
    """
    key = F.col(by) if by else F.lit(0)
    x = rows.select(key.alias("_k"), F.col(value).cast("double").alias("_v")).where("_v is not null")
    ends = x.groupBy("_k").agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    bin_ = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.lit(float(BINS))), F.lit(BINS - 1))).otherwise(0).cast("int")
    binned = x.join(F.broadcast(ends), "_k").select("_k", "_v", bin_.alias("_b"))  # one row a group
    counts = binned.groupBy("_k", "_b").agg(F.count("*").alias("_c"))
    w = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("_before", F.sum("_c").over(w) - F.col("_c"))  # at most BINS rows a group
    ranks = ends.select("_k", "_n", F.posexplode(F.array(*[F.lit(float(q)) for q in qs])).alias("_i", "_q")).withColumn("_at", F.col("_q") * (F.col("_n") - 1))
    ranks = ranks.select("_k", "_i", "_at", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))).alias("_r"))
    held = ranks.join(counts, "_k").where((F.col("_r") >= F.col("_before")) & (F.col("_r") < F.col("_before") + F.col("_c"))).select("_k", "_i", "_at", "_r", "_b", "_before")
    wanted = held.select("_k", "_b", "_before").distinct()  # at most two rows a group and quantile
    placed = binned.join(F.broadcast(wanted), ["_k", "_b"]).withColumn("_r", F.col("_before") + F.row_number().over(Window.partitionBy("_k", "_b").orderBy("_v")) - 1)
    found = held.select("_k", "_i", "_at", "_r").join(placed.select("_k", "_r", "_v"), ["_k", "_r"])
    share = F.when(F.floor("_at") == F.ceil("_at"), 1.0).when(F.col("_r") == F.floor("_at"), F.ceil("_at") - F.col("_at")).otherwise(F.col("_at") - F.floor("_at"))
    each = found.groupBy("_k", "_i").agg(F.sum(F.col("_v") * share).alias("_q"))
    out = each.groupBy("_k").agg(*[F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(f"q{i}") for i in range(len(qs))])
    return out.withColumnRenamed("_k", by) if by else out.drop("_k")


#: Bins of the first pass of ``quantiles_by_bins``.
BINS = 4096


def box_stats(rows: DataFrame, value: str, by: str = "method") -> DataFrame:
    """(by, n, mean, std, q1, med, q3, whisker_lo, whisker_hi, fliers): 1.5 IQR whiskers clipped to the data."""
    base = rows.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    base = base.join(quantiles_by_bins(rows, value, (0.25, 0.5, 0.75), by).toDF(by, "q1", "med", "q3"), by)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col(value) >= F.col("q1") - reach) & (F.col(value) <= F.col("q3") + reach)
    ends = rows.join(F.broadcast(base.select(by, "q1", "q3")), by).groupBy(by).agg(F.min(F.when(inside, F.col(value))).alias("whisker_lo"), F.max(F.when(inside, F.col(value))).alias("whisker_hi"), F.count_if(~inside).alias("fliers"))
    return base.join(ends, by)


def density(rows: DataFrame, value: str, by: str = "method", zoom: tuple[float, float] | None = None) -> DataFrame:
    """(by, bin, density): shared edges over all groups; the last bin takes its right edge. ``zoom`` keeps what lies
    within two percentiles of all values and norms on that."""
    if zoom:
        ends = quantiles_by_bins(rows, value, zoom).toDF("lo", "hi")
    else:
        ends = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    kept = rows.crossJoin(F.broadcast(ends)).where(F.col(value).between(F.col("lo"), F.col("hi")))  # one row of ends
    width = (F.col("hi") - F.col("lo")) / F.lit(float(EDGES - 1))
    b = F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(EDGES - 2)).cast("int")
    counts = kept.groupBy(by, b.alias("bin"), width.alias("width")).agg(F.count("*").alias("cnt"))
    total = F.sum("cnt").over(Window.partitionBy(by))
    return counts.select(by, "bin", (F.col("cnt") / (total * F.col("width"))).alias("density"))


def curve_points(summaries: DataFrame) -> DataFrame:
    """Summaries in order within their family, with the base's line: ``point`` from 1 by ratio."""
    w = Window.partitionBy("method_family").orderBy("mean_compression_ratio", "method")
    return summaries.withColumn("point", F.row_number().over(w)).withColumn("is_line", (F.col("method_family") == "base") & (F.col("point") == 1))


def method_order(first_seen: DataFrame) -> DataFrame:
    """(method, place): base, random, then the order of first sight. One row a method."""
    kind = F.when(F.col("method") == "base", 0).when(F.col("method") == "random", 1).otherwise(2)
    return first_seen.withColumn("place", F.row_number().over(Window.orderBy(kind, "first_seen", "method")))


def select_relabel(rows: DataFrame, wanted: list[tuple[str, str]]) -> DataFrame:
    """Rows of the wanted methods, named by their labels; methods without rows fall out."""
    names = rows.sparkSession.createDataFrame(wanted, "method string, label string")
    return rows.join(F.broadcast(names), "method")


def merge_last(rows: DataFrame, run: str = "run", by: str = "method") -> DataFrame:
    """Of each method, the rows of its last run."""
    return rows.withColumn("_last", F.max(run).over(Window.partitionBy(by))).where(F.col(run) == F.col("_last")).drop("_last")


def scatter_points(samples: DataFrame, x: str, y: str) -> tuple[DataFrame, DataFrame]:
    """(method, x, y) of rows that have both, and (method, n, varies): methods whose x is one value have no scatter."""
    points = samples.select("method", F.col(x).alias("x"), F.col(y).alias("y")).dropna(subset=["x", "y"])
    return points, points.groupBy("method").agg(F.count("*").alias("n"), (F.min("x") < F.max("x")).alias("varies"))


def varying_points(samples: DataFrame, x: str, y: str) -> DataFrame:
    """The points of methods that have a scatter."""
    points, methods = scatter_points(samples, x, y)
    return points.join(methods.where("varies").select("method"), "method", "left_semi")


def curve_csv(summaries: DataFrame, fields: list[str]) -> DataFrame:
    """The curve table's columns, ordered by family and ratio with '' and 0 for nulls."""
    have = [F.col(c) if c in summaries.columns else F.lit(None).cast("string").alias(c) for c in fields]
    return summaries.orderBy(F.coalesce("method_family", F.lit("")), F.coalesce("mean_compression_ratio", F.lit(0.0))).select(*have)
