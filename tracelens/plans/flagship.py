"""The flagship query: compression methods compared by the log-probability of the answer.

Each method keeps a weighted part of a trace's tokens; a cache language model scores the answer's tokens from these
weights and from corpus counts. One plan covers all methods: samples, segments, weights, scores, summary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelens.functions.numeric import rounded
from tracelens.operators import lm, patching, pooling
from tracelens.sources import tables

MIX = 0.2


#: Methods, each a column of weights.
METHODS = ("base", "simple_mean_uniform_cr4", "entropy_weighted_mean_t0_entropy_threshold_cr4")


def weighted_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, pos, token, w0, w1, w2): what each method keeps of the traces, all in one set of rows."""
    toks = tables.trace_tokens(spark, sf_dir)
    turns = tables.table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text")
    contexts = lm.context_entropy(lm.bigrams(lm.tokens(turns, "id"), "id"))
    rows = lm.token_entropies(toks, contexts, "conv_id").select("conv_id", "pos", "token", F.coalesce("h", F.lit(0.0)).alias("h"), F.lit(1.0).alias("w0"))
    uni = patching.Uniform(key="conv_id", ratio=4.0).apply(rows)
    mean = uni.withColumn("w1", 1.0 / F.count("*").over(Window.partitionBy("conv_id", "patch"))).drop("patch")
    peak = pooling.entropy_weights(patching.Threshold(key="conv_id", ratio=4.0).apply(mean), 0, "conv_id")
    return peak.select("conv_id", "pos", "token", "w0", "w1", F.col("w").alias("w2"))


def scored_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(method, conv_id, pos, token, logprob, k, n): answer tokens with their log-probability under each method.

    Weights are added up once for all methods; an answer token meets them in one join and is stacked into a row a method.
    """
    names = [f"w{i}" for i in range(len(METHODS))]
    weights = weighted_traces(spark, sf_dir).groupBy("conv_id", "token").agg(*[F.sum(w).alias(w) for w in names], F.count("*").alias("c"))
    totals = weights.groupBy("conv_id").agg(*[F.sum(w).alias(f"k{i}") for i, w in enumerate(names)], F.sum("c").alias("n"))
    turns = tables.table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text")
    counts = lm.tokens(turns, "id").groupBy("token").agg(F.count("*").alias("c"))
    size = counts.agg(F.sum("c").alias("total"), F.count("*").alias("v"))
    answers = tables.answer_tokens(spark, sf_dir).join(totals, "conv_id").join(weights.drop("c"), ["conv_id", "token"], "left").join(counts, "token", "left").crossJoin(F.broadcast(size))  # one row
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.coalesce(w, F.lit(0.0)).alias("w"), F.col(f"k{i}").alias("k")) for i, (m, w) in enumerate(zip(METHODS, names, strict=True))])).alias("m")
    rows = answers.select("conv_id", "pos", "token", "n", "c", "total", "v", each).select("*", "m.*")
    p = F.lit(MIX) * F.col("w") / F.col("k") + F.lit(1 - MIX) * (F.coalesce("c", F.lit(0)) + 0.5) / (F.col("total") + 0.5 * F.col("v"))
    return rows.select("method", "conv_id", "pos", "token", F.log(p).alias("logprob"), "k", "n")


def evaluate_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scored_answers(spark, sf_dir)
    samples = scored.groupBy("method", "conv_id").agg(F.count("*").alias("answer_tokens"), F.sum("logprob").alias("total"), F.first("k").alias("k"), F.first("n").alias("n"))
    samples = samples.withColumn("mean", F.col("total") / F.col("answer_tokens"))
    return samples.groupBy("method").agg(
        F.count("*").alias("samples"),
        rounded(F.avg("mean")).alias("mean_logprob"),
        rounded(F.coalesce(F.stddev_samp("mean"), F.lit(0.0))).alias("std_logprob"),
        rounded(F.avg("total")).alias("mean_logprob_sum"),
        rounded(F.avg(F.col("k") / F.col("n"))).alias("mean_compression_ratio"),
        rounded(F.avg("k")).alias("mean_compressed_cot_tokens"),
    )


TT = r"""
la as (select conv_id, arg_max(text, turn) as text from conversations where role = 'assistant' group by conv_id),
pt as (select conv_id, substring(text, 1, floor(3 * length(text) / 4)::int) as tr, substring(text, floor(3 * length(text) / 4)::int + 1) as an from la),
tt as (select conv_id, (generate_subscripts(w, 1) - 1)::int as pos, unnest(w) as token from (select conv_id, list_filter(string_split_regex(lower(tr), '\s+'), lambda x: x <> '') as w from pt)),
at as (select conv_id, (generate_subscripts(w, 1) - 1)::int as pos, unnest(w) as token from (select conv_id, list_filter(string_split_regex(lower(an), '\s+'), lambda x: x <> '') as w from pt)),
ct as (select conv_id || ':' || turn as id, (generate_subscripts(w, 1) - 1)::int as pos, unnest(w) as token from (select conv_id, turn, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') as w from conversations)),
bg as (select prev, token, count(*) as c from (select token, lag(token) over (partition by id order by pos) as prev from ct) where prev is not null group by all),
cx as (select prev, sum(c)::bigint as total, greatest(0.0::double, ln(sum(c)) - sum(c * ln(c)) / sum(c)) as h from bg group by prev),
th as (select conv_id, pos, token, coalesce(cx.h, 0.0::double) as h from (select *, lag(token) over (partition by conv_id order by pos) as prev from tt) x left join cx on x.prev = cx.prev)
""".replace("at as (", "an as (")

SQL = f"""
with {TT},
un as (select *, floor(pos / 4)::int as patch from th),
tf as (select *, case when pos = 0 or h >= quantile_cont(h, 0.75) over (partition by conv_id) then 1 else 0 end as st from th),
tp as (select *, sum(st) over (partition by conv_id order by pos) - 1 as patch from tf),
kept as (select 'base' as method, conv_id, token, 1.0::double as w from th
  union all select 'simple_mean_uniform_cr4', conv_id, token, 1.0::double / count(*) over (partition by conv_id, patch) from un
  union all select 'entropy_weighted_mean_t0_entropy_threshold_cr4', conv_id, token, case when row_number() over (partition by conv_id, patch order by h desc, pos) = 1 then 1.0::double else 0.0::double end from tp),
tot as (select method, conv_id, sum(w) as k, count(*) as n from kept group by all),
ws as (select method, conv_id, token, sum(w) as w from kept group by all),
cn as (select token, count(*) as c from ct group by token),
sz as (select sum(c)::bigint as total, count(*) as v from cn),
sc as (select tot.method, an.conv_id, ln(0.2::double * coalesce(ws.w, 0) / k + (1 - 0.2::double) * (coalesce(cn.c, 0) + 0.5::double) / (sz.total + 0.5::double * sz.v)) as lp, k, n
  from an join tot using (conv_id) left join ws on ws.method = tot.method and ws.conv_id = an.conv_id and ws.token = an.token left join cn on cn.token = an.token, sz),
sa as (select method, conv_id, count(*) as a, sum(lp) as total, any_value(k) as k, any_value(n) as n from sc group by all)
select method, count(*) as samples, round(avg(total / a), 6) + 0.0 as mean_logprob, round(coalesce(stddev_samp(total / a), 0), 6) + 0.0 as std_logprob, round(avg(total), 6) + 0.0 as mean_logprob_sum,
       round(avg(k / n), 6) + 0.0 as mean_compression_ratio, round(avg(k), 6) + 0.0 as mean_compressed_cot_tokens
from sa group by method
"""
