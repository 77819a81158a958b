"""Compression from chats to slots, tokenizers of one's own, sketches as documents, exact quantiles by bins."""

import pytest
from pyspark.sql import functions as F
from tracelens.operators import chat_tokens, compression, patching, reporting, summary
from tracelens.operators.compression import Method

CHATS = "conv_id long, messages array<struct<role:string,content:string>>"


def chats(spark):
    talk = [("user", "q"), ("assistant", "<think>a b c d e</think>\nAnswer here")]
    rows = [(1, talk), (2, [("assistant", "no trace")]), (3, talk[1:]), (4, [("user", "q"), ("assistant", "<think>x</think>")])]
    return spark.createDataFrame(rows, CHATS)


def vectors(spark):
    return spark.createDataFrame([(k, [float(k), 1.0]) for k in range(10)], "token_id long, vector array<double>")


def rows(spark, traces, entropies=True):
    t = compression.trace_tokens(traces, chat_tokens.MARKED_WORDS).withColumn("token_id", F.col("pos").cast("long"))
    return t.withColumn("h", F.when(F.lit(entropies) | (F.col("conv_id") != 3), F.col("pos").cast("double")))


def test_traces_and_prefixes(spark):
    traces = compression.traced(chats(spark))
    assert sorted(r.conv_id for r in traces.collect()) == [1, 3]
    assert {r.conv_id: len(r.prefix_ids) for r in compression.prefix_ids(traces).collect()} == {1: 3, 3: 0}
    assert [r.conv_id for r in compression.entropy_eligible(traces).collect()] == [1]


def test_compress_and_splice(spark):
    traces = compression.traced(chats(spark))
    toks = rows(spark, traces)  # <think> a b c d e </think>: 7 tokens
    out = compression.compress(traces, toks, vectors(spark), Method("simple_mean", patching.Uniform(key="conv_id", ratio=3.0)))
    got = {r.conv_id: r for r in out.chats.collect()}
    assert got[1].messages[1].content == "<think><|slot|><|slot|><|slot|></think>\nAnswer here" and got[1].method == "simple_mean_uniform_cr3"
    assert (got[3].original_cot_tokens, got[3].compressed_cot_tokens, got[3].compression_ratio) == (7, 3, 3 / 7)
    places = compression.slot_places(out.chats, chat_tokens.MARKED_WORDS)
    assert {r.conv_id: r.places for r in places.collect()} == {1: [4, 5, 6], 3: [2, 3, 4]}
    both = {(r.conv_id, r.place): r.vector for r in compression.spliced(places, out.slots).collect()}
    want = [[(0 + 1 + 2) / 3**0.5, 3 / 3**0.5], [(3 + 4 + 5) / 3**0.5, 3 / 3**0.5], [6.0, 1.0]]
    assert all(both[1, 4 + k] == pytest.approx(w) for k, w in enumerate(want)) and len(both) == 6
    assert compression.slot_places(out.chats, chat_tokens.MARKED_WORDS, 5).count() == 0  # placeholders cut off on the left
    with pytest.raises(Exception, match="differ"):
        compression.spliced(places, out.slots.where("slot > 0")).collect()


def test_methods_that_need_entropies_skip_samples_without(spark):
    traces = compression.traced(chats(spark))
    m = Method("entropy_weighted_mean", patching.Threshold(key="conv_id", ratio=2.0), 0.0)
    out = compression.compress(traces, rows(spark, traces, entropies=False), vectors(spark), m)
    assert [r.conv_id for r in out.chats.collect()] == [1] and {r.conv_id for r in out.slots.collect()} == {1}
    with pytest.raises(ValueError):
        compression.resolved(rows(spark, traces).drop("h"), m)
    base = compression.compress(traces, rows(spark, traces), None, Method("base"))
    assert base.slots is None and {(r.method, r.compression_ratio) for r in base.chats.collect()} == {("base", 1.0)}
    drawn = compression.compress(traces, rows(spark, traces), vectors(spark), Method("random", patching.Uniform(key="conv_id", ratio=2.0)), 10)
    assert drawn.slots.count() == 8 and all(len(r.vector) == 2 for r in drawn.slots.collect())


def test_gather_keeps_order_and_repeats(spark):
    assert [r.vector[0] for r in compression.gathered(vectors(spark), [3, 1, 3]).collect()] == [3.0, 1.0, 3.0]


def test_a_tokenizer_of_ones_own(spark):
    own = chat_tokens.python_tokenizer(lambda t: [(ord(c), i, i + 1) for i, c in enumerate(t) if c.isalpha()])
    r = chat_tokens.tokenize_answer(compression.traced(chats(spark)).where("conv_id = 3"), own).first()
    text = "<|assistant|>\n<think>a b c d e</think>\nAnswer here\n"
    letters = [c for c in text if c.isalpha()]
    assert r.input_ids == [ord(c) for c in letters] and "".join(chr(x) for x in r.labels if x >= 0) == "Answerhere"
    assert r.answer_positions == list(range(len(letters) - 10, len(letters)))


def test_sketches_as_documents_merge(spark):
    values = [("a", -1.0), ("a", -2.5), ("b", -40.0), ("a", -1.0)]
    parts = [spark.createDataFrame(values[:2], "method string, logprob double"), spark.createDataFrame(values[2:], "method string, logprob double")]
    docs = [summary.sketch_documents(summary.moments(p), summary.histogram(p)) for p in parts]
    mom, hist = summary.from_sketch_documents(docs[0].unionByName(docs[1]))
    whole = spark.createDataFrame(values, "method string, logprob double")
    assert sorted(map(tuple, mom.collect())) == sorted(map(tuple, summary.moments(whole).collect()))
    assert sorted(map(tuple, hist.collect())) == sorted(map(tuple, summary.histogram(whole).collect()))


def test_quantiles_by_bins(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(size=999), "b": np.array([2.0] * 7), "c": np.array([1.0, 5.0]), "d": np.array([3.0]), "e": rng.exponential(size=500) ** 8}
    df = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v] + [("a", None)], "g string, x double")
    qs = (0.0, 0.005, 0.25, 0.5, 0.995, 1.0)
    got = {r.g: r[1:] for r in reporting.quantiles_by_bins(df, "x", qs, "g").collect()}
    for k, v in groups.items():
        assert got[k] == pytest.approx(tuple(np.quantile(v, qs)))
    assert tuple(reporting.quantiles_by_bins(df, "x", qs).first()) == pytest.approx(tuple(np.quantile(np.concatenate(list(groups.values())), qs)))


def test_methods_of_one_ratio_have_no_scatter(spark):
    s = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 2.0), ("b", 2.0, 2.0), ("b", None, 1.0)], "method string, r double, y double")
    assert {(r.method, r.n, r.varies) for r in reporting.scatter_points(s, "r", "y")[1].collect()} == {("a", 2, False), ("b", 2, True)}
    assert {r.method for r in reporting.varying_points(s, "r", "y").collect()} == {"b"}


def test_pooled_dimensions_are_not_shuffled(spark):
    from tracelens.operators import pooling

    rows = spark.createDataFrame([(1, 0, 5, 1.0), (1, 0, 6, 2.0), (1, 1, 5, 1.0)], "sample_index long, patch int, token_id long, w double")
    vectors = spark.createDataFrame([(5, [1.0, 0.0]), (6, [0.0, 1.0])], "token_id long, vector array<double>")
    out = pooling.pool(rows, vectors)
    above = out._jdf.queryExecution().executedPlan().toString().split("Generate posexplode")[0]
    assert "Exchange" not in above and "Join" not in above
    assert sorted((r.patch, r.dim, round(r.x, 6)) for r in out.collect()) == [(0, 0, 0.447214), (0, 1, 0.894427), (1, 0, 1.0), (1, 1, 0.0)]
