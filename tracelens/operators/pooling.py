"""Reduction of each segment's vectors to one vector, and the methods that use it."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelens.functions.numeric import hash_bucket, number_tag
from tracelens.functions.text import method_name


def mean_weights(rows: DataFrame, key: str = "sample_index") -> DataFrame:
    """Weight 1 for each row: pooling by the sum over the root of the count."""
    return rows.withColumn("w", F.lit(1.0))


def entropy_weights(rows: DataFrame, temperature: float, key: str = "sample_index", h: str = "h", pos: str = "pos") -> DataFrame:
    """Softmax of log entropy over temperature within a patch; at 0 the first row of the highest entropy alone."""
    if temperature < 0:
        raise ValueError("a temperature is not negative")
    patch = Window.partitionBy(key, "patch")
    if temperature == 0:
        first = F.row_number().over(patch.orderBy(F.col(h).desc(), F.col(pos)))
        return rows.withColumn("w", F.when(first == 1, 1.0).otherwise(0.0))
    safe = F.greatest(F.col(h), F.lit(1e-12))
    power = F.pow(safe / F.max(safe).over(patch), F.lit(1.0 / temperature))
    return rows.withColumn("_p", power).withColumn("w", F.col("_p") / F.sum("_p").over(patch)).drop("_p")


def pool(rows: DataFrame, vectors: DataFrame, key: str = "sample_index", token: str = "token_id") -> DataFrame:
    """(key, patch, dim, x): sum of weight times vector over the root of the summed squared weights.

    Rows of one token in a patch are added up before vectors are attached; vectors is (token_id, vector).
    """
    norm = rows.groupBy(key, "patch").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    tokens = rows.groupBy(key, "patch", token).agg(F.sum("w").alias("w")).join(norm, [key, "patch"])
    # a patch's vectors meet whole and are spread out there: a row for each dimension is never shuffled or sorted
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, or tasks would be joined by what comes in
    met = tokens.join(vectors, token).select(key, "patch", "w", "norm", "vector").repartition(n, key, "patch")
    spread = met.select(key, "patch", "w", "norm", F.posexplode("vector").alias("dim", "v"))
    return spread.groupBy(key, "patch", "dim").agg((F.sum(F.col("w") * F.col("v").cast("double")) / F.first("norm")).alias("x"))


def as_vectors(pooled: DataFrame, key: str = "sample_index") -> DataFrame:
    """(key, patch, vector): dimensions in order; a vector's length bounds each group."""
    return pooled.groupBy(key, "patch").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("vector"))


def random_ids(patches: DataFrame, high: Column | int, seed: int = 13, key: str = "sample_index") -> DataFrame:
    """A vocabulary id below ``high`` for each patch, by a hash of seed, sample and patch."""
    return patches.withColumn("token_id", hash_bucket(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"), F.lit(":"), F.col("patch").cast("string")), high))


def compat_ids(sample: int, count: int, high: int, seed: int = 13) -> list[int]:
    """Ids by the standard library's generator, seeded with seed + sample."""
    rng = random.Random(seed + sample)
    return [rng.randrange(high) for _ in range(count)]


def compat_random_ids(counts: DataFrame, high: int, seed: int = 13, key: str = "sample_index", n: str = "n") -> DataFrame:
    @F.pandas_udf("array<int>")
    def draw(k: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([compat_ids(int(a), int(b), high, seed) for a, b in zip(k, m, strict=True)])

    return counts.select(key, draw(F.col(key), F.col(n)).alias("token_ids"))


def vocabulary_bound(vocabulary: DataFrame) -> DataFrame:
    """(high): the least id of a special token, or the vocabulary's size without one."""
    return vocabulary.agg(F.coalesce(F.min(F.when(F.col("is_special"), F.col("token_id"))), F.max("token_id") + 1).alias("high"))


FAMILIES = ("base", "random", "simple_mean", "entropy_weighted_mean")


def name(family: str, patching_tag: str = "", temperature: float | None = None) -> str:
    if family not in FAMILIES:
        raise ValueError(f"no method {family}")
    if family in ("base", "random") and not patching_tag:
        return family
    return method_name(family, patching_tag, None if temperature is None else f"t{number_tag(temperature)}")
