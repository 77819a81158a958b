"""An n-gram language model in place of a neural one, and the protocol for attaching one.

Entropies and log-probabilities come from counts over a corpus. A token's entropy is that of the distribution which
produced it: the entropy of its predecessor's successors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelens.functions.text import word_tokens


def tokens(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, token)."""
    return rows.select(key, F.posexplode(word_tokens(F.col(text))).alias("pos", "token"))


def with_previous(toks: DataFrame, key: str) -> DataFrame:
    return toks.withColumn("prev", F.lag("token").over(Window.partitionBy(key).orderBy("pos")))


def bigrams(toks: DataFrame, key: str) -> DataFrame:
    """(prev, token, c)."""
    return with_previous(toks, key).where("prev is not null").groupBy("prev", "token").agg(F.count("*").alias("c"))


def context_entropy(pairs: DataFrame) -> DataFrame:
    """(prev, total, h): entropy in nats of what follows each context, ln N - sum c ln c / N."""
    n = F.sum("c")
    return pairs.groupBy("prev").agg(n.alias("total"), F.greatest(F.lit(0.0), F.log(n) - F.sum(F.col("c") * F.log("c")) / n).alias("h"))


def token_entropies(toks: DataFrame, contexts: DataFrame, key: str) -> DataFrame:
    """toks with h of each token's predecessor; null at a sequence's start and after an unseen context."""
    return with_previous(toks, key).join(contexts.select("prev", "h"), "prev", "left")


def log_probs(toks: DataFrame, pairs: DataFrame, contexts: DataFrame, vocabulary: int | DataFrame, key: str, alpha: float = 0.5) -> DataFrame:
    """toks with logprob = ln((c + alpha) / (N + alpha V)) given the predecessor."""
    v = vocabulary if isinstance(vocabulary, DataFrame) else None
    rows = with_previous(toks, key).where("prev is not null").join(pairs, ["prev", "token"], "left").join(contexts.select("prev", "total"), "prev", "left")
    if v is not None:
        rows = rows.crossJoin(F.broadcast(v))  # one row
    size = F.col("v") if v is not None else F.lit(vocabulary)
    return rows.withColumn("logprob", F.log((F.coalesce("c", F.lit(0)) + F.lit(alpha)) / (F.coalesce("total", F.lit(0)) + F.lit(alpha) * size)))


Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def score_with(rows: DataFrame, scorer: Scorer, schema: str) -> DataFrame:
    """Hands batches of prepared samples to a model outside of Spark and takes rows of ``schema`` back."""
    return rows.mapInPandas(scorer, schema)
