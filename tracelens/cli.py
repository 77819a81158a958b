"""Command line: ``python -m tracelens.cli eval|precompute|report --sf-dir DIR [--out DIR]``."""

from __future__ import annotations

import argparse
import logging
from dataclasses import dataclass, field

from tracelens import config, schemas

log = logging.getLogger("tracelens")

ALIASES = {"evaluate": "eval", "evaluate_methods": "eval", "precompute_entropies": "precompute", "reports": "report"}


@dataclass
class Config:
    """What a run needs; ``options`` are the composed groups."""

    sf_dir: str = "/root/testdata/sf0.01"
    out: str = "out"
    model: str = "ngram"
    options: dict = field(default_factory=config.compose)


def rewrite(args: list[str]) -> list[str]:
    """Puts long names and ``mode=name`` in the place of the short ones."""
    return [ALIASES.get(a.removeprefix("mode="), a.removeprefix("mode=")) for a in args]


def evaluate(spark, cfg: Config) -> None:
    """Scores the answers under each method and writes the run's artifacts, its settings and its metrics."""
    from pyspark.sql import functions as F

    from tracelens.operators import chat_tokens, corpus, summary
    from tracelens.plans import flagship
    from tracelens.sources import artifacts

    own = cfg.options["evaluation"]
    rows = corpus.prefix_limit(flagship.scored_answers(spark, cfg.sf_dir).withColumnRenamed("conv_id", "sample_index"), cfg.options["data"]["limit"])
    tokens = rows.select("method", "sample_index", F.col("pos").cast("int").alias("token_index"), chat_tokens.hash_bucket(F.col("token"), chat_tokens.VOCABULARY).cast("int").alias("token_id"), "logprob")
    sizes = rows.groupBy("method", "sample_index").agg(F.first("k").alias("k"), F.first("n").alias("n"))
    samples = summary.sample_scores(rows).join(sizes, ["method", "sample_index"]).withColumn("compression_ratio", F.col("k") / F.col("n")).withColumn("compressed_cot_tokens", F.rint("k").cast("int")).drop("k", "n")
    summaries = summary.summarize(samples)
    artifacts.write_run(cfg.out, samples, summaries, tokens if own["save_tokens"] else None, own["metric"], own["normalize_by_length"])
    artifacts.write_text(spark, f"{cfg.out}/artifacts/config.json", config.resolved_text(cfg.options))
    run = config.RunLog()
    for r in artifacts.load_summaries(spark, cfg.out).collect():  # one row a method
        run.metrics({f"{r.method}/mean_logprob": r.mean_logprob, f"{r.method}/samples": r.samples})
    run.frame(spark).coalesce(1).write.mode("overwrite").json(f"{cfg.out}/artifacts/metrics.jsonl")


def precompute(spark, cfg: Config) -> None:
    """Writes each trace's entropies; an existing table is found before anything is computed."""
    from pyspark.sql import functions as F

    from tracelens.functions.text import entropy_table_path
    from tracelens.operators import lm
    from tracelens.sources import artifacts, tables

    path = entropy_table_path(cfg.out, cfg.model)
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm):
        log.info("kept %s", path)
        return
    turns = tables.table(spark, cfg.sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text")
    contexts = lm.context_entropy(lm.bigrams(lm.tokens(turns, "id"), "id"))
    rows = lm.token_entropies(tables.trace_tokens(spark, cfg.sf_dir), contexts, "conv_id")
    series = rows.groupBy(F.col("conv_id").alias("sample_index")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("h", F.lit(0.0)).alias("h")))), lambda x: x["h"]).alias("entropies"))
    artifacts.save_entropies(series, path)


def report(spark, cfg: Config) -> None:
    """Tables behind the plots, over the runs below the output folder; over the events table where there is no run."""
    from tracelens.operators import reporting, summary
    from tracelens.sources import artifacts, tables

    runs = bool(artifacts.artifact_paths(spark, cfg.out, "tokens.jsonl"))
    t = artifacts.load_tokens(spark, cfg.out, ["method", "logprob"]) if runs else tables.token_logprobs(spark, cfg.sf_dir)
    mom, hist = summary.moments(t), summary.histogram(t)
    made = {"quantiles": summary.quantiles(mom, hist), "density": summary.coarse_density(mom, hist), "tokens": summary.token_summary(mom, hist), "box": reporting.box_stats(t, "logprob")}
    if runs:
        samples = artifacts.load_samples(spark, cfg.out)
        made["malformed"] = artifacts.malformed_lines(spark, cfg.out)
        made["scatter"] = reporting.varying_points(samples, "compression_ratio", "logprob_mean")
        made["curve"] = reporting.curve_csv(artifacts.load_summaries(spark, cfg.out), schemas.CURVE)
    for name, df in made.items():
        df.write.mode("overwrite").json(f"{cfg.out}/report/{name}")


WORKFLOWS = {"eval": evaluate, "precompute": precompute, "report": report}


def main(argv: list[str] | None = None) -> None:
    import sys

    from tracelens.session import get_session

    p = argparse.ArgumentParser(prog="tracelens")
    p.add_argument("workflow", choices=sorted(WORKFLOWS))
    p.add_argument("--sf-dir", default=Config.sf_dir)
    p.add_argument("--out", default=Config.out)
    p.add_argument("options", nargs="*", help="group.name=value")
    a = p.parse_args(rewrite(sys.argv[1:] if argv is None else argv))
    logging.basicConfig(level=logging.INFO)
    cfg = Config(a.sf_dir, a.out, options=config.compose(a.options))
    WORKFLOWS[a.workflow](get_session(), cfg)
    log.info("%s done in %s", a.workflow, cfg.out)


if __name__ == "__main__":
    main()
