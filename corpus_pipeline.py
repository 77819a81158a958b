"""From raw documents to a training mixture, in five stages; part of the subpackage ``llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next one's
documents. All but the last return the columns of documents; the last adds ``mix_copy``, the number of the copy.

Defined cases: null and empty texts are not toxic, near nothing, lose nothing and hit nothing, so they reach the mixture,
where a source without any word takes none of its documents; rows without an id pass the second and third stage as they
are and the others by their texts; rows repeated in full stay together through the first four stages; texts that share an
id are judged each by itself; empty tables give an empty result; further columns pass, whatever their names, and the last
stage's column gives way to one of its name; texts of any length are worked on as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.llm import decontam, jaccard, mixing, suffix_dedup, toxicity
from tracelens.llm.common import SharedTables, tidy_shuffles
from tracelens.session import ensure_checkpoint_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine trained on the labels takes for toxic go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 of their sets of five words, the one with the smallest id stays."""
    return jaccard.keep_one(docs, 5, 80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by a string of 50 bytes of a smaller document go from the texts; n_chars follows."""
    out = suffix_dedup.clean(docs)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNull(), None).otherwise(F.length("text")).cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more lies in windows of benchmark items go."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says."""
    return mixing.emit(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: The machine of the first stage is beyond SQL; ``tests/llm/test_queries.py`` holds ``run`` against brute force, stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture, checkpointed; a stage's table lies in the shared folder until the next stage is through, and its
    shuffle files go when it ends."""
    ensure_checkpoint_dir(spark)
    tables = SharedTables(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        with tidy_shuffles(spark):
            docs = out.checkpoint() if k == len(STAGES) - 1 else tables.keep(out, f"{k}-{name}")
        if last:
            tables.drop(last)
        last = f"{k}-{name}"
    tables.drop()
    return docs
