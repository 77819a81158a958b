"""The token sketch over a stream of JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens import schemas
from tracelens.functions.numeric import bin_index


def read_token_stream(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """Token rows as they arrive; a line cut short arrives without a method and is left out."""
    return spark.readStream.schema(schemas.TOKENS).option("maxFilesPerTrigger", files_per_trigger).json(folder).where("method is not null and logprob is not null")


def histogram_stream(tokens: DataFrame) -> DataFrame:
    """(method, bin, cnt): state is bounded by methods times bins; what is below the grid is bin -1."""
    return tokens.withColumn("bin", F.greatest(bin_index(F.col("logprob")), F.lit(-1))).groupBy("method", "bin").agg(F.count("*").alias("cnt"))


def run_available(stream: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there and returns its state as a table."""
    q = stream.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def write_tokens(tokens: DataFrame, folder: str, checkpoint: str) -> None:
    """Appends the rows that are there to JSON files as they come; what was written once is not written again."""
    q = tokens.writeStream.outputMode("append").format("json").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
