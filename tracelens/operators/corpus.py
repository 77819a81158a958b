"""Corpus preparation: validation, deterministic split, materialisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelens.functions.text import valid_messages

SPLITS = ("train", "eval", "test")


def messages_of(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, messages): a conversation's turns in order as an array of (role, content)."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return turns.groupBy(key).agg(F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def keep_valid(chats: DataFrame, messages: str = "messages") -> DataFrame:
    return chats.where(valid_messages(F.col(messages)))


def project(chats: DataFrame) -> DataFrame:
    """messages, and dataset_source and id where the table has them."""
    return chats.select(*[c for c in ("messages", "dataset_source", "id") if c in chats.columns])


def shuffle_key(key, seed: int):
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def split(rows: DataFrame, sizes: dict[str, int], seed: int, key: str = "doc_id") -> DataFrame:
    """Adds ``rank`` and ``split``: a shuffled order by hash, cut into consecutive slices of the given sizes.

    The rank is found in two steps, so that no task orders the whole table: rows are ranked within the first hex digits
    of the hash, and each bucket adds the number of rows in the buckets before it. Buckets that begin beyond the last
    wanted rank are left out before any row is ordered.
    """
    hashed = rows.withColumn("_h", shuffle_key(F.col(key), seed)).withColumn("_b", F.substring("_h", 1, 2))
    counts = hashed.groupBy("_b").agg(F.count("*").alias("_n"))
    before = counts.select("_b", (F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))  # at most 256 rows
    before = before.where(F.col("_before") < sum(sizes.values()))
    ranked = hashed.join(F.broadcast(before), "_b").withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)))
    ranked = ranked.withColumn("rank", (F.col("_r") + F.col("_before")).cast("long"))
    label, lo = None, 0
    for name in SPLITS:
        n = sizes.get(name, 0)
        here = (F.col("rank") > lo) & (F.col("rank") <= lo + n)
        label = F.when(here, name) if label is None else label.when(here, name)
        lo += n
    return ranked.withColumn("split", label).where("split is not null").drop("_h", "_b", "_r", "_before")


def checked_split(rows: DataFrame, sizes: dict[str, int], seed: int, key: str = "doc_id") -> DataFrame:
    """``split`` after making sure that there are rows enough."""
    need, have = sum(sizes.values()), rows.count()
    if have < need:
        raise ValueError(f"{need} rows needed, {have} there")
    return split(rows, sizes, seed, key)


def prefix_limit(rows: DataFrame, limit: int | None, key: str = "sample_index") -> DataFrame:
    """The samples numbered below the limit; all of them without one. Numbers are stable, unlike what ``limit`` takes."""
    return rows if limit is None else rows.where(F.col(key) < limit)


def split_counts(parts: DataFrame) -> DataFrame:
    return parts.groupBy("split").agg(F.count("*").alias("n"))


def load_or_build(spark, folder: str, build, sizes: dict[str, int]) -> DataFrame:
    """The split corpus of a folder; builds and writes it first if it is not there. Sizes must agree."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        build().write.mode("overwrite").partitionBy("split").parquet(folder)
    parts = spark.read.parquet(folder)
    found = {r["split"]: r["n"] for r in split_counts(parts).collect()}
    if found != {k: v for k, v in sizes.items() if v}:
        raise ValueError(f"sizes {found} in {folder}, {sizes} wanted")
    return parts
