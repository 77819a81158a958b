"""Domain inputs derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelens.functions.text import word_tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entropy_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_index, pos, h): each user's event values in order."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("sample_index"), (F.row_number().over(w) - 1).cast("int").alias("pos"), F.col("value").alias("h"))


def token_logprobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(method, sample_index, ts, event_id, logprob): events read as scored tokens."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("method"), F.col("user_id").alias("sample_index"), "ts", "event_id", F.log(F.greatest("value", F.lit(0.01)) / F.lit(1000.0)).alias("logprob"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, messages)."""
    from tracelens.operators.corpus import messages_of

    return messages_of(table(spark, sf_dir, "conversations"))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, messages): assistant texts wrapped as traces with an answer, but for every seventh conversation."""
    wrapped = F.concat(F.lit("<think>"), F.col("text"), F.lit("</think>\n Answer "), F.col("turn").cast("string"))
    text = F.when((F.col("role") == "assistant") & (F.col("conv_id") % 7 != 0), wrapped).otherwise(F.col("text"))
    from tracelens.operators.corpus import messages_of

    return messages_of(table(spark, sf_dir, "conversations").withColumn("text", text))


def trace_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, pos, token): words of the first three quarters of each last assistant turn."""
    return _part(spark, sf_dir, F.col("trace"))


def answer_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir, F.col("answer"))


def _part(spark: SparkSession, sf_dir: str, column) -> DataFrame:
    last = table(spark, sf_dir, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))
    cut = F.floor(3 * F.length("text") / 4).cast("int")
    both = last.select("conv_id", F.substring(F.col("text"), F.lit(1), cut).alias("trace"), F.substring(F.col("text"), cut + 1, F.length("text")).alias("answer"))
    return both.select("conv_id", F.posexplode(word_tokens(column)).alias("pos", "token"))
