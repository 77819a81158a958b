import os

import pytest
from tracelens import cli, config
from tracelens.operators import compression

DATA = "/root/testdata/sf0.001"


def test_rewrite():
    assert cli.rewrite(["mode=evaluate", "--out", "x"]) == ["eval", "--out", "x"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_workflows_write_their_tables(spark, tmp_path):
    cfg = cli.Config(DATA, str(tmp_path))
    cli.precompute(spark, cfg)
    cli.precompute(spark, cfg)
    assert spark.read.parquet(f"{tmp_path}/cot_entropies__ngram").where("size(entropies) = cot_length").count() > 0
    cli.evaluate(spark, cfg)
    from tracelens.sources import artifacts

    assert artifacts.load_summaries(spark, str(tmp_path)).count() == 3
    samples, tokens = artifacts.load_samples(spark, str(tmp_path)), artifacts.load_tokens(spark, str(tmp_path))
    assert samples.count() == samples.dropna(subset=["logprob_mean", "compression_ratio"]).count() > 0
    assert tokens.where("token_id is not null and logprob < 0").count() == samples.agg({"answer_tokens": "sum"}).first()[0]
    assert [r.folder.rsplit("/", 1)[1] for r in artifacts.artifact_folders(spark, str(tmp_path), "summary.json").collect()] == ["artifacts"]
    assert spark.read.json(f"{tmp_path}/artifacts/metrics.jsonl").where("key = 'base/samples'").count() == 1
    assert spark.read.option("multiLine", True).json(f"{tmp_path}/artifacts/config.json").first().evaluation.metric == "logprob"
    cli.report(spark, cfg)
    assert spark.read.json(f"{tmp_path}/report/quantiles").count() > 0 and spark.read.json(f"{tmp_path}/report/curve").count() == 3
    assert spark.read.json(f"{tmp_path}/report/malformed").count() == 0
    with open(f"{tmp_path}/artifacts/tokens.jsonl/part-99999.json", "w") as f:
        f.write("not json\n")
    assert artifacts.malformed_lines(spark, str(tmp_path)).first().malformed == 1 and artifacts.load_tokens(spark, str(tmp_path)).count() == tokens.count()
    assert artifacts.load_samples(spark, str(tmp_path / "nothing")).count() == 0


def test_settings_are_composed_in_order():
    c = config.compose(["methods.enabled=[\"base\"]", "data.limit=5", "data.limit=7", "evaluation.metric=other", "+new.name=1.5"])
    assert c["methods"]["enabled"] == ["base"] and c["data"]["limit"] == 7 and c["evaluation"]["metric"] == "other" and c["new"] == {"name": 1.5}
    assert config.DEFAULTS["data"]["limit"] is None and config.compose() == config.DEFAULTS
    with pytest.raises(KeyError):
        config.compose(["data.limits=1"])
    with pytest.raises(ValueError):
        config.compose(["data"])


def test_methods_from_settings():
    made = compression.methods_from(config.DEFAULTS["methods"])
    assert [m.name for m in made] == ["base", "simple_mean_uniform_cr4", "entropy_weighted_mean_t0_entropy_threshold_cr4"]
    assert [m.needs_entropy for m in made] == [False, False, True]
    with pytest.raises(ValueError):
        compression.methods_from({"enabled": ["unknown"]})
    with pytest.raises(ValueError):
        compression.methods_from({"enabled": ["random"], "random": {"patching": "unknown"}})
