import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tracelens.operators import patching


def rows(spark, series):
    data = [(k, i, float(h)) for k, hs in series.items() for i, h in enumerate(hs)]
    return spark.createDataFrame(data, "sample_index long, pos int, h double")


def cut(spark, strategy, hs):
    out = patching.spans(rows(spark, {0: hs}), strategy).orderBy("patch").collect()
    return [(r["start"], r["end"]) for r in out]


# The spans of ``test_uniform`` to ``test_budget_without_sum_is_uniform`` and of ``test_compat_exponential``.
def test_uniform(spark):
    assert cut(spark, patching.Uniform(ratio=8.0), [1] * 20) == [(0, 8), (8, 16), (16, 20)]
    assert cut(spark, patching.Uniform(ratio=1.5), [1] * 6) == [(0, 2), (2, 4), (4, 6)]
    assert patching.Uniform(ratio=2.5).size == 2
    assert patching.Uniform(ratio=8.0).tag() == "uniform_cr8"


def test_threshold(spark):
    assert cut(spark, patching.Threshold(ratio=5.0), [9, 1, 1, 9, 1]) == [(0, 3), (3, 5)]
    assert cut(spark, patching.Threshold(ratio=1.0), [3, 1, 2]) == [(0, 1), (1, 2), (2, 3)]


def test_diff(spark):
    assert cut(spark, patching.Diff(ratio=3.0), [1, 1, 9, 1, 9, 1]) == [(0, 2), (2, 4), (4, 6)]


def test_budget_without_sum_is_uniform(spark):
    assert cut(spark, patching.Budget(ratio=4.0), [0] * 12) == [(0, 4), (4, 8), (8, 12)]


def starts_by_rule(kind, ratio, hs):
    """Where spans start, straight from each strategy's rule."""
    h = np.array(hs)
    if kind == "entropy_threshold":
        found = np.flatnonzero(h >= np.quantile(h, 1 - 1 / ratio))
    elif kind == "entropy_diff":
        rise = np.diff(h)
        found = np.flatnonzero(rise > np.quantile(rise, 1 - 1 / ratio)) + 1
    else:
        total, budget = np.cumsum(h), h.sum() * ratio / len(h)
        found = [max(1, int(np.argmax(total > k * budget))) for k in range(1, max(1, round(len(h) / ratio)))]
    return sorted({0, *map(int, found)})


@pytest.mark.parametrize("kind", ["entropy_threshold", "entropy_diff", "entropy_sum"])
@pytest.mark.parametrize("ratio,seed", [(1.5, 1), (3.0, 2), (7.0, 3)])
def test_starts_follow_the_rule(spark, kind, ratio, seed):
    rng = random.Random(seed)
    series = {k: [rng.expovariate(1) for _ in range(n)] for k, n in enumerate([2, 5, 42, 702])}  # quantiles between two values
    out = patching.spans(rows(spark, series), patching.build(kind, ratio=ratio)).collect()
    for k, hs in series.items():
        assert sorted(r["start"] for r in out if r["sample_index"] == k) == starts_by_rule(kind, ratio, hs)


@pytest.mark.parametrize("kind", ["entropy_threshold", "entropy_diff", "entropy_sum"])
def test_single_token_and_ratio(spark, kind):
    assert cut(spark, patching.build(kind, ratio=2.0), [1.0]) == [(0, 1)]
    with pytest.raises(ValueError):
        patching.build(kind, ratio=0.5)


@pytest.mark.parametrize("strategy", [patching.Single(), patching.Uniform(ratio=3.0), patching.Threshold(ratio=3.0), patching.Diff(ratio=3.0), patching.Budget(ratio=3.0), patching.Exponential(top=3)])
def test_spans_partition_every_sequence(spark, strategy):
    rng = random.Random(1)
    series = {k: [rng.random() for _ in range(n)] for k, n in enumerate([1, 2, 3, 17, 64])}
    out = patching.spans(rows(spark, series), strategy).orderBy("sample_index", "patch").collect()
    for k, hs in series.items():
        mine = [(r["start"], r["end"]) for r in out if r["sample_index"] == k]
        assert mine[0][0] == 0 and mine[-1][1] == len(hs)
        assert all(a < b for a, b in mine) and all(x[1] == y[0] for x, y in zip(mine, mine[1:]))


def test_exponential_forms_agree(spark):
    r = rows(spark, {3: [1.0] * 100, 4: [1.0] * 7})
    s = patching.Exponential(top=4, seed=9)
    a = {tuple(x) for x in s.lengths(r).select("sample_index", "patch", "start", "end").collect()}
    b = {tuple(x) for x in patching.spans(r, s).select("sample_index", "patch", "start", "end").collect()}
    assert a == b
    with pytest.raises(ValueError):
        patching.Exponential(top=-1)


def test_compat_exponential():
    want = [(0, 4), (4, 12), (12, 20), (20, 24), (24, 25), (25, 29), (29, 33), (33, 34), (34, 35), (35, 43), (43, 44), (44, 45), (45, 49), (49, 100)]
    assert patching.compat_exponential(100, 3) == want


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 300), st.integers(0, 1000), st.integers(0, 6))
def test_compat_covers(n, sample, top):
    spans = patching.compat_exponential(n, sample, top)
    assert spans[0][0] == 0 and spans[-1][1] == n and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))


def test_unknown_strategy():
    with pytest.raises(ValueError):
        patching.build("fancy")


#: One user's values whose rises have a quantile that differs from a rise in its last bit, by the way it is interpolated.
CLOSE = [42.22, 7.26, 4.97, 12.57, 51.74, 11.96, 94.5, 16.21, 9.11, 3.35, 31.74, 65.93, 25.09, 21.53, 20.72, 17.93, 19.46, 17.4, 153.12, 12.67, 88.56, 34.98, 49.56, 48.39, 88.08, 79.89, 32.19, 3.16, 58.36, 53.47, 24.47, 22.81, 28.56, 65.0, 21.8, 24.55, 2.87, 37.06, 32.76, 107.52, 26.92, 55.2, 74.56, 43.36, 30.33, 59.44, 51.09, 5.85, 6.08, 35.15, 59.73, 56.46, 86.71, 39.25, 30.3, 86.15, 16.08, 93.77, 4.28, 50.32, 1.88, 47.71, 4.89, 129.9, 50.06, 112.5, 6.41, 116.32, 7.8, 41.93, 89.41, 33.76, 62.08, 140.01, 29.0, 12.79, 67.24]


@pytest.mark.parametrize("name", ["patch_diff", "realised_ratio_by_strategy"])
def test_rises_equal_to_their_quantile_match_sql(spark, tmp_path, name):
    import duckdb
    from tracelens.plans import catalogue

    c = duckdb.connect()
    c.execute("create table events as select i as event_id, make_timestamp(i * 1000000) as ts, 7::bigint as user_id, 'a' as event_type, v as value from (select unnest(range(0, ?)) as i, unnest(?::double[]) as v)", [len(CLOSE), CLOSE])
    c.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    df = catalogue.queries()[name](spark, str(tmp_path))
    sql = c.execute(f"select {', '.join(df.columns)} from ({catalogue.oracle_sql()[name]})").fetchall()
    assert sorted(tuple(r) for r in df.collect()) == sorted(sql)


def test_fused_rounds_once(spark):
    import math

    from pyspark.sql import functions as F
    from tracelens.functions.numeric import fused

    rng = random.Random(3)
    data = [(22.07, 0.25, 24.76 * 0.75)] + [(rng.uniform(-99, 99), rng.choice([0.25, 0.75, 0.3]), rng.uniform(-99, 99)) for _ in range(500)]
    got = spark.createDataFrame(data, "a double, b double, c double").select("a", "b", "c", fused(F.col("a"), F.col("b"), F.col("c")).alias("x")).collect()
    assert all(r["x"] == math.fma(r["a"], r["b"], r["c"]) for r in got) and any(r["x"] != r["a"] * r["b"] + r["c"] for r in got)


def test_budget_is_the_one_of_the_cuts(spark):
    hs = [1e16, *[1.0] * 40, 3.0, 1e15]
    out = patching.Budget(ratio=4.0).with_budget(rows(spark, {0: hs}).repartition(7)).select("_budget").distinct().collect()
    total = 0.0
    for h in hs:
        total += h
    assert [r[0] for r in out] == [total * 4.0 / len(hs)]
