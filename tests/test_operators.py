import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from tracelens.functions import numeric as N
from tracelens.operators import batching, lm, pooling, reporting, summary
from tracelens.sources import artifacts
from tracelens.streaming import tokens as stream


def patch(spark, hs):
    return spark.createDataFrame([(0, i, float(h), i, 0) for i, h in enumerate(hs)], "sample_index long, pos int, h double, token_id int, patch int")


def vectors(spark, n):
    return spark.createDataFrame([(i, [1.0 if i == j else 0.0 for j in range(n)]) for i in range(n)], "token_id int, vector array<double>")


def pooled(spark, rows, n):
    return [r.x for r in pooling.pool(rows, vectors(spark, n)).orderBy("dim").collect()]


def test_temperature_one_is_plain_entropy_weighting(spark):
    got = pooled(spark, pooling.entropy_weights(patch(spark, [1, 2, 3, 4]), 1.0), 4)
    w = np.array([1, 2, 3, 4]) / 10
    assert np.allclose(got, w / math.sqrt((w**2).sum()))


def test_temperature_zero_keeps_the_first_peak(spark):
    assert pooled(spark, pooling.entropy_weights(patch(spark, [1, 9, 9, 3]), 0), 4) == [0, 1, 0, 0]
    with pytest.raises(ValueError):
        pooling.entropy_weights(patch(spark, [1]), -1)


def test_mean_is_the_sum_over_the_root(spark):
    assert np.allclose(pooled(spark, pooling.mean_weights(patch(spark, [1, 1, 1, 1])), 4), [0.5] * 4)


def test_compat_ids_and_names():
    assert pooling.compat_ids(5, 8, 200) == [46, 31, 169, 114, 85, 61, 50, 125]
    assert pooling.name("simple_mean", "uniform_cr8") == "simple_mean_uniform_cr8"
    assert pooling.name("entropy_weighted_mean", "entropy_threshold_cr2", 1.0) == "entropy_weighted_mean_t1_entropy_threshold_cr2"
    assert pooling.name("random") == "random"
    with pytest.raises(ValueError):
        pooling.name("median")


def test_greedy_batches(spark):
    lengths = [5, 9, 12, 40, 3, 3, 3, 3, 3]
    got = spark.range(1).select(batching.greedy_batch_ids(F.array(*map(F.lit, lengths)), 4, 30)).first()[0]
    assert got == [0, 0, 1, 2, 3, 3, 3, 3, 4]


def test_bin_edges(spark):
    df = spark.createDataFrame([(-30.005,), (-30.02,), (0.0,), (-12.0,)], "x double")
    got = [r[0] for r in df.select(N.bin_index(F.col("x"))).collect()]
    assert got[0] == 0 and got[1] < 0 and got[2] == 2999


def test_sketch_quantiles_are_within_a_bin(spark):
    rng = np.random.default_rng(0)
    xs = -rng.gamma(2.0, 1.5, 5000)
    t = spark.createDataFrame([("m", float(x)) for x in xs], "method string, logprob double")
    got = {r.q: r.value for r in summary.quantiles(summary.moments(t), summary.histogram(t)).collect()}
    for q, v in got.items():
        assert abs(v - np.quantile(xs, q)) <= 0.05


def test_summary_of_one_row_and_of_none(spark):
    s = spark.createDataFrame([("a", -1.0, -4.0, 4, 0.5, 2)], "method string, logprob_mean double, logprob_sum double, answer_tokens int, compression_ratio double, compressed_cot_tokens int")
    m = spark.createDataFrame([("a",), ("b",)], "method string")
    out = {r.method: r for r in summary.summarize(s, m).collect()}
    assert out["a"].std_logprob == 0.0 and out["a"].samples == 1 and out["b"].samples == 0 and out["b"].mean_logprob is None


def test_entropy_and_label_logprob(spark):
    x = [0.5, -1.0, 2.0]
    p = np.exp(x) / np.exp(x).sum()
    r = spark.createDataFrame([(x, 2, -100)], "x array<double>, y int, z int").select(N.softmax_entropy(F.col("x")), N.label_logprob(F.col("x"), F.col("y")), N.label_logprob(F.col("x"), F.col("z"))).first()
    assert math.isclose(r[0], -(p * np.log(p)).sum(), rel_tol=1e-9) and math.isclose(r[1], math.log(p[2]), rel_tol=1e-9) and r[2] is None


def test_entropy_belongs_to_the_produced_token(spark):
    t = lm.tokens(spark.createDataFrame([(0, "a b a c a b")], "id int, text string"), "id")
    got = [r.h for r in lm.token_entropies(t, lm.context_entropy(lm.bigrams(t, "id")), "id").orderBy("pos").collect()]
    h_a = -(2 / 3 * math.log(2 / 3) + 1 / 3 * math.log(1 / 3))
    assert got[0] is None and math.isclose(got[1], h_a) and got[2] == 0.0 and math.isclose(got[3], h_a)


def test_scorer_plug_in(spark):
    def scorer(batches):
        for b in batches:
            yield b.assign(logprob=-b.n.astype(float))

    out = lm.score_with(spark.createDataFrame([(1, 3)], "sample_index long, n int"), scorer, "sample_index long, n int, logprob double").first()
    assert out.logprob == -3.0


def write_runs(root):
    for run, methods in (("r1", ["base", "m"]), ("r2", ["m"])):
        a = root / run / "artifacts"
        a.mkdir(parents=True)
        (a / "summary.json").write_text(json.dumps({"metric": "logprob", "normalize_by_length": True, "methods": [{"method": m, "samples": 2, "mean_logprob": float("nan")} for m in methods]}, indent=1))
        (a / "samples.jsonl").write_text("".join(json.dumps({"method": m, "sample_index": i, "logprob_mean": -1.0 - i, "compression_ratio": None if i else 0.5}) + "\n" for m in methods for i in range(2)) + '{"method": "m", "samp')
        (a / "tokens.jsonl").write_text("".join(json.dumps({"method": m, "sample_index": 0, "token_index": i + 1, "token_id": i, "logprob": -0.5 * i}) + "\n" for m in methods for i in range(4)) + '{"method"')


def test_artifacts_round_trip_and_cut_lines(spark, tmp_path):
    write_runs(tmp_path)
    root = str(tmp_path)
    assert sorted(r.method for r in artifacts.load_summaries(spark, root).collect()) == ["base", "m", "m"]
    samples = artifacts.load_samples(spark, root)
    assert samples.count() == 6
    assert artifacts.sample_xy(samples, "compression_ratio", "logprob_mean").count() == 3
    with pytest.raises(KeyError):
        artifacts.field(samples, "nothing")
    assert artifacts.load_tokens(spark, root, ["method", "sample_index", "logprob"]).count() == 12
    assert [r.malformed for r in artifacts.malformed_lines(spark, root).collect()] == [1, 1]
    assert artifacts.artifact_folders(spark, root, "tokens.jsonl").count() == 2
    last = reporting.merge_last(samples.withColumn("run", F.col("file")))
    assert last.where("method = 'm'").select("run").distinct().count() == 1


def test_entropy_cache(spark, tmp_path):
    s = spark.createDataFrame([(5, [1.0]), (2, [0.1, 0.2, 0.3]), (9, [0.5, 0.5])], "sample_index long, entropies array<float>")
    artifacts.save_entropies(s, str(tmp_path / "e"))
    back = {r.sample_index: r.cot_length for r in artifacts.load_entropies(spark, str(tmp_path / "e")).collect()}
    assert back == {2: 3, 5: 1, 9: 2}
    assert [tuple(r) for r in artifacts.ragged_offsets(s).orderBy("sample_index").collect()] == [(2, 3, 0), (5, 1, 3), (9, 2, 4)]
    wanted = spark.createDataFrame([(2,), (7,)], "sample_index long")
    out = artifacts.read_through(s, wanted, lambda m: m.withColumn("entropies", F.array(F.lit(9.0).cast("float"))))
    assert sorted(r.sample_index for r in out.collect()) == [2, 7]


def test_curve_csv_and_summary_document(spark, tmp_path):
    s = spark.createDataFrame([("b", "f", 0.5), ("a", None, None)], "method string, method_family string, mean_compression_ratio double")
    artifacts.write_curve_csv(s, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns[0] == "method"
    doc = json.loads(artifacts.summary_document(s).first().value)
    assert [m["method"] for m in doc["methods"]] == ["a", "b"] and doc["metric"] == "logprob"


def test_token_stream(spark, tmp_path):
    write_runs(tmp_path)
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "t.json").write_text((tmp_path / "r1/artifacts/tokens.jsonl").read_text())
    hist = stream.histogram_stream(stream.read_token_stream(spark, str(folder)))
    out = stream.run_available(hist, "hist_test", str(tmp_path / "ck"))
    assert sum(r.cnt for r in out.collect()) == 8


def test_box_whiskers(spark):
    xs = [1.0, 2.0, 3.0, 4.0, 100.0]
    r = reporting.box_stats(spark.createDataFrame([("m", x) for x in xs], "method string, v double"), "v").first()
    assert (r.whisker_lo, r.whisker_hi, r.fliers) == (1.0, 4.0, 1)


def test_token_sink_writes_each_row_once(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for k in range(2):
        spark.createDataFrame([("a", 1, k, 7, -1.0 - k)], "method string, sample_index long, token_index int, token_id int, logprob double").write.mode("append").json(source)
        stream.write_tokens(stream.read_token_stream(spark, source), out, state)
        stream.write_tokens(stream.read_token_stream(spark, source), out, state)
        assert sorted(r.logprob for r in spark.read.json(out).collect()) == [-1.0 - x for x in reversed(range(k + 1))]
