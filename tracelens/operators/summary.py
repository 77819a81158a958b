"""Per-method summaries and the mergeable token sketch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelens.functions.numeric import BINS, LO, bin_centre, bin_index

POSITIONS = 512
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def sample_scores(tokens: DataFrame) -> DataFrame:
    """(method, sample_index, answer_tokens, logprob_sum, logprob_mean)."""
    return tokens.groupBy("method", "sample_index").agg(F.count("logprob").alias("answer_tokens"), F.sum("logprob").alias("logprob_sum")).where("answer_tokens > 0").withColumn("logprob_mean", F.col("logprob_sum") / F.col("answer_tokens"))


def summarize(samples: DataFrame, methods: DataFrame | None = None, skipped: DataFrame | None = None) -> DataFrame:
    """One row a method. Deviations are of the sample, 0 with one value; ``methods`` adds empty ones with null means."""
    dev = lambda c: F.when(F.count(c) > 0, F.coalesce(F.stddev_samp(c), F.lit(0.0)))
    out = samples.groupBy("method").agg(
        F.count("*").alias("samples"),
        F.avg("logprob_mean").alias("mean_logprob"),
        dev("logprob_mean").alias("std_logprob"),
        (dev("logprob_mean") / F.sqrt(F.count("*"))).alias("sem_logprob"),
        F.avg("logprob_sum").alias("mean_logprob_sum"),
        F.avg("answer_tokens").alias("mean_answer_tokens"),
        F.avg("compression_ratio").alias("mean_compression_ratio"),
        dev("compression_ratio").alias("std_compression_ratio"),
        F.avg("compressed_cot_tokens").alias("mean_compressed_cot_tokens"),
    )
    if methods is not None:
        out = methods.select("method").join(out, "method", "left").withColumn("samples", F.coalesce("samples", F.lit(0)))
    if skipped is not None:
        out = out.join(skipped, "method", "left").withColumn("skipped", F.coalesce("skipped", F.lit(0)))
    return out


def moments(tokens: DataFrame) -> DataFrame:
    """(method, n, total, total_sq, under)."""
    under = F.count_if(bin_index(F.col("logprob")) < 0)
    return tokens.groupBy("method").agg(F.count("*").alias("n"), F.sum("logprob").alias("total"), F.sum(F.col("logprob") * F.col("logprob")).alias("total_sq"), under.alias("under"))


def histogram(tokens: DataFrame) -> DataFrame:
    """(method, bin, cnt) over the grid; what is below it is in ``moments``."""
    return tokens.withColumn("bin", bin_index(F.col("logprob"))).where("bin >= 0").groupBy("method", "bin").agg(F.count("*").alias("cnt"))


def merge_histograms(parts: DataFrame) -> DataFrame:
    return parts.groupBy("method", "bin").agg(F.sum("cnt").alias("cnt"))


_SKETCH = "method string, n long, total double, total_sq double, under long, bins map<string,long>"


def sketch_documents(mom: DataFrame, hist: DataFrame) -> DataFrame:
    """(method, value): each method's sketch as one JSON text, to be merged elsewhere; at most 3000 bins a method."""
    bins = hist.groupBy("method").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("bin").cast("string").alias("bin"), "cnt")))).alias("bins"))
    rows = mom.join(bins, "method", "left").select("method", "n", "total", "total_sq", "under", F.coalesce("bins", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))).alias("bins"))
    return rows.select("method", F.to_json(F.struct(*rows.columns)).alias("value"))


def from_sketch_documents(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(moments, histogram) of any number of documents, those of one method merged."""
    rows = documents.select(F.from_json("value", _SKETCH).alias("d")).select("d.*")
    mom = rows.groupBy("method").agg(*[F.sum(c).alias(c) for c in ("n", "total", "total_sq", "under")])
    return mom, merge_histograms(rows.select("method", F.explode("bins").alias("bin", "cnt")).select("method", F.col("bin").cast("int").alias("bin"), "cnt"))


def quantiles(mom: DataFrame, hist: DataFrame, qs=QUANTILES) -> DataFrame:
    """(method, q, value): linear within the first bin whose running count reaches q * n; -30 if that is below the grid.

    The sketch has at most 3000 bins a method, and each window is over one of these.
    """
    cum = hist.join(mom.select("method", "n", "under"), "method")
    w = Window.partitionBy("method").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cum = cum.withColumn("cum", F.col("under") + F.sum("cnt").over(w))
    wanted = mom.select("method", "n", "under", F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q")).withColumn("target", F.col("q") * F.col("n"))
    first = wanted.join(cum.select("method", "bin", "cnt", "cum"), "method").where("cum >= target").groupBy("method", "q", "target", "under").agg(F.min(F.struct("bin", "cnt", "cum")).alias("b"))
    frac = F.when(F.col("b.cnt") == 0, 0.0).otherwise((F.col("target") - (F.col("b.cum") - F.col("b.cnt"))) / F.col("b.cnt"))
    value = F.when(F.col("target") <= F.col("under"), F.lit(LO)).otherwise(F.lit(LO) + F.col("b.bin") * 0.01 + frac * 0.01)
    return first.select("method", "q", value.alias("value"))


def coarse_density(mom: DataFrame, hist: DataFrame) -> DataFrame:
    """(method, coarse, cnt, tail): 240 bins of 0.05 over [-12, 0], and all that is below."""
    body = hist.where("bin >= 1800").groupBy("method", F.floor((F.col("bin") - 1800) / 5).cast("int").alias("coarse")).agg(F.sum("cnt").alias("cnt"))
    low = hist.where("bin < 1800").groupBy("method").agg(F.sum("cnt").alias("low"))
    tail = mom.join(low, "method", "left").select("method", (F.col("under") + F.coalesce("low", F.lit(0))).alias("tail"))
    return body.join(tail, "method")


def token_summary(mom: DataFrame, hist: DataFrame) -> DataFrame:
    """(method, n, mean, std, mean_prob): population deviation from sums; mean_prob leaves what is below the grid out of
    its numerator alone."""
    prob = hist.groupBy("method").agg(F.sum(F.exp(bin_centre(F.col("bin"))) * F.col("cnt")).alias("p"))
    mean = F.col("total") / F.col("n")
    var = F.greatest(F.lit(0.0), F.col("total_sq") / F.col("n") - mean * mean)
    return mom.join(prob, "method", "left").select("method", "n", mean.alias("mean"), F.sqrt(var).alias("std"), (F.coalesce("p", F.lit(0.0)) / F.col("n")).alias("mean_prob"))


def with_position(tokens: DataFrame, order: list[str], by: list[str] | None = None) -> DataFrame:
    """Adds ``position``: the token's number within its sample, from 0."""
    return tokens.withColumn("position", (F.row_number().over(Window.partitionBy(*(by or ["method", "sample_index"])).orderBy(*order)) - 1).cast("int"))


def position_curve(tokens: DataFrame, limit: int = POSITIONS) -> DataFrame:
    """(method, position, cnt, mean) of the first positions of a sample."""
    return tokens.where(F.col("position") < limit).groupBy("method", "position").agg(F.count("*").alias("cnt"), F.avg("logprob").alias("mean"))


__all__ = ["BINS", "POSITIONS", "QUANTILES", "coarse_density", "from_sketch_documents", "histogram", "merge_histograms", "moments", "position_curve", "quantiles", "sample_scores", "sketch_documents", "summarize", "token_summary", "with_position"]
