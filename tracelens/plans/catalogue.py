"""The query catalogue: each operator family over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelens.functions import numeric as N
from tracelens.functions import text as T
from tracelens.functions.numeric import rounded
from tracelens.operators import batching, chat_tokens, compression, corpus, lm, patching, pooling, reporting, summary
from tracelens.plans import flagship
from tracelens.sources import artifacts, tables

EV = "ev as (select user_id as sample_index, (row_number() over (partition by user_id order by ts, event_id) - 1)::int as pos, value as h from events)"
LP = "lp as (select event_type as method, user_id as sample_index, ts, event_id, ln(greatest(value, 0.01) / 1000.0::double) as logprob from events)"
_HIST0 = f"{LP}, bn as (select method, logprob, least(trunc((logprob + 30.0) * 100.0)::int, 2999) as bin from lp), hs as (select method, bin, count(*) as cnt from bn where bin >= 0 group by all), mo as (select method, count(*) as n, sum(logprob) as total, sum(logprob * logprob) as total_sq, count(*) filter (bin < 0) as under from bn group by method)"
_SAMP = f"{LP}, sa as (select method, sample_index, count(*) as answer_tokens, sum(logprob) as logprob_sum, sum(logprob) / count(*) as logprob_mean, case when sample_index % 5 = 0 then null else (count(*) % 7 + 1)::double / 8 end as compression_ratio, (count(*) % 7 + 1)::int as compressed_cot_tokens from lp group by method, sample_index)"
_SUMM = """select method, count(*) as samples, round(avg(logprob_mean), 6) + 0.0 as mean_logprob, round(coalesce(stddev_samp(logprob_mean), 0), 6) + 0.0 as std_logprob, round(coalesce(stddev_samp(logprob_mean), 0) / sqrt(count(*)), 6) + 0.0 as sem_logprob,
round(avg(logprob_sum), 5) + 0.0 as mean_logprob_sum, round(avg(answer_tokens), 6) + 0.0 as mean_answer_tokens, round(avg(compression_ratio), 6) + 0.0 as mean_compression_ratio, round(coalesce(stddev_samp(compression_ratio), 0), 6) + 0.0 as std_compression_ratio, round(avg(compressed_cot_tokens), 6) + 0.0 as mean_compressed_cot_tokens"""
MSG = "cm as (select conv_id, list({'role': role, 'content': text} order by turn) as m from conversations group by conv_id)"
TR = r"""tx as (select conv_id, turn, role, case when role = 'assistant' and conv_id % 7 <> 0 then '<think>' || text || '</think>' || chr(10) || ' Answer ' || turn else text end as text from conversations),
cm as (select conv_id, list({'role': role, 'content': text} order by turn) as m from tx group by conv_id),
la as (select conv_id, max(turn) as turn from tx where role = 'assistant' group by conv_id),
lt as (select tx.conv_id, tx.turn, tx.text, strpos(text, '<think>') as a, strpos(text, '</think>') as b, (select count(*) from tx y where y.conv_id = tx.conv_id and y.turn < tx.turn) as idx from tx join la using (conv_id, turn)),
pa as (select *, substring(text, a, b + 8 - a) as trace, ltrim(substring(text, b + 8), chr(10) || chr(9) || chr(13) || ' ') as answer from lt where a > 0 and b > 0)"""
RENDER = "list_aggregate(list_transform(m, lambda x: '<|' || x.role || '|>' || chr(10) || x.content || chr(10)), 'string_agg', '')"

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def _spans(strategy):
    def f(spark, sf_dir: str) -> DataFrame:
        return patching.spans(tables.entropy_series(spark, sf_dir), strategy).withColumnsRenamed({"start": "start_pos", "end": "end_pos"})

    return f


def _span_sql(flag: str, more: str = "", source: str = "ev") -> str:
    return f"""with {EV}{more},
f as (select sample_index, pos, case when pos = 0 or {flag} then 1 else 0 end as st from {source}),
p as (select sample_index, pos, (sum(st) over (partition by sample_index order by pos) - 1)::int as patch from f)
select sample_index, patch, min(pos)::int as start_pos, (max(pos) + 1)::int as end_pos from p group by all"""


# --- segmentation -----------------------------------------------------------------------------------------------
query("patch_single", _span_sql("false"))(_spans(patching.Single()))
query("patch_uniform", _span_sql("pos % 8 = 0"))(_spans(patching.Uniform(ratio=8.0)))
query("patch_uniform_half_even", _span_sql("pos % 2 = 0"))(_spans(patching.Uniform(ratio=2.5)))
_THR = ", q as (select *, quantile_cont(h, 1 - 1 / 4.0::double) over (partition by sample_index) as cut from ev)"
query("patch_threshold", _span_sql("h >= cut", _THR, "q"))(_spans(patching.Threshold(ratio=4.0)))
_DIFF = ", d as (select *, h - lag(h) over (partition by sample_index order by pos) as rise from ev), q as (select *, quantile_cont(rise, 1 - 1 / 4.0::double) over (partition by sample_index) as cut from d)"
query("patch_diff", _span_sql("rise > cut", _DIFF, "q"))(_spans(patching.Diff(ratio=4.0)))
_SUM = """, c as (select *, sum(h) over (partition by sample_index order by pos rows unbounded preceding) as cum, count(*) over (partition by sample_index) as n from ev),
t as (select *, arg_max(cum, pos) over (partition by sample_index) as total from c), b as (select *, total * 4.0::double / n as budget from t),
g as (select *, least(greatest(1.0, round_even(n / 4.0::double, 0)) - 1, greatest(0.0, ceil(cum / budget) - 1)) as passed from b),
q as (select *, lag(passed) over (partition by sample_index order by pos) as before from g)"""
query("patch_sum", _span_sql("case when total > 0 then passed > before or (pos = 1 and before >= 1) else pos % 4 = 0 end", _SUM, "q"))(_spans(patching.Budget(ratio=4.0)))

_EXP = f"""with {EV},
n as (select sample_index, (max(pos) + 1)::bigint as n from ev group by 1),
k as (select sample_index, n, unnest(range(0, n)) as k from n),
l as (select *, pow(2, ('0x' || substr(md5('42:' || sample_index || ':' || k), 1, 8))::bigint % 7)::bigint as len from k),
s as (select *, sum(len) over (partition by sample_index order by k rows unbounded preceding) as stop from l)
select sample_index, k::int as patch, (stop - len)::int as start_pos, least(stop, n)::int as end_pos from s where stop - len < n"""


@query("patch_exponential_native", _EXP)
def _(spark, sf_dir):
    return patching.Exponential(top=6, seed=42).lengths(tables.entropy_series(spark, sf_dir)).withColumnsRenamed({"start": "start_pos", "end": "end_pos"})


@query("patch_exponential_compat")
def _(spark, sf_dir):
    sizes = tables.entropy_series(spark, sf_dir).groupBy("sample_index").agg(F.count("*").alias("n"))
    return patching.compat_spans(sizes).select("sample_index", F.posexplode("spans").alias("patch", "s")).select("sample_index", "patch", F.col("s.start").alias("start_pos"), F.col("s.end").alias("end_pos"))


@query("realised_ratio_by_strategy", f"""with {EV}{_THR}, {_DIFF.split(', q as')[0][2:]},
q2 as (select *, quantile_cont(rise, 1 - 1 / 4.0::double) over (partition by sample_index) as cut from d),
p as (select 'entropy_threshold_cr4' as strategy, sum(case when pos = 0 or h >= cut then 1 else 0 end) as patches, count(*) as n from q group by sample_index
union all select 'entropy_diff_cr4', sum(case when pos = 0 or rise > cut then 1 else 0 end), count(*) from q2 group by sample_index
union all select 'uniform_cr4', sum(case when pos % 4 = 0 then 1 else 0 end), count(*) from ev group by sample_index)
select strategy, sum(patches)::bigint as patches, sum(n)::bigint as tokens, round(sum(n)::double / sum(patches)::double, 6) + 0.0 as ratio from p group by strategy""")
def _(spark, sf_dir):
    ev, out = tables.entropy_series(spark, sf_dir), None
    for s in (patching.Threshold(ratio=4.0), patching.Diff(ratio=4.0), patching.Uniform(ratio=4.0)):
        one = patching.spans(ev, s).agg(F.count("*").alias("patches"), F.sum(F.col("end") - F.col("start")).cast("long").alias("tokens")).withColumn("strategy", F.lit(s.tag()))
        out = one if out is None else out.unionByName(one)
    return out.select("strategy", "patches", "tokens", rounded(F.col("tokens") / F.col("patches")).alias("ratio"))


@query("patch_sizes_summary", f"""with {EV}{_THR},
f as (select sample_index, pos, case when pos = 0 or h >= cut then 1 else 0 end as st from q),
p as (select sample_index, sum(st) over (partition by sample_index order by pos) as patch from f),
s as (select sample_index, patch, count(*) as n from p group by all)
select sample_index, count(*) as patches, max(n) as longest, round(avg(n), 6) + 0.0 as mean_size, round(coalesce(stddev_samp(n), 0), 6) + 0.0 as std_size from s group by sample_index""")
def _(spark, sf_dir):
    s = patching.spans(tables.entropy_series(spark, sf_dir), patching.Threshold(ratio=4.0)).withColumn("n", F.col("end") - F.col("start"))
    return s.groupBy("sample_index").agg(F.count("*").alias("patches"), F.max("n").cast("long").alias("longest"), rounded(F.avg("n")).alias("mean_size"), rounded(F.coalesce(F.stddev_samp("n"), F.lit(0.0))).alias("std_size"))


@query("patch_information_balance", f"""with {EV}{_SUM},
f as (select sample_index, pos, h, budget, case when pos = 0 or passed > before or (pos = 1 and before >= 1) then 1 else 0 end as st from q),
p as (select *, (sum(st) over (partition by sample_index order by pos) - 1)::int as patch from f)
select sample_index, patch, round(sum(h) / any_value(budget), 4) + 0.0 as share from p group by all""")
def _(spark, sf_dir):
    ev = tables.entropy_series(spark, sf_dir)
    p = patching.Budget(ratio=4.0).with_budget(ev).groupBy("sample_index", "patch").agg(F.sum("h").alias("h"), F.first("_budget").alias("budget"))
    return p.select("sample_index", "patch", rounded(F.col("h") / F.col("budget"), 4).alias("share"))


@query("entropy_windows", f"""with {EV} select sample_index, pos, round(h - lag(h) over w, 6) + 0.0 as rise, round(sum(h) over (partition by sample_index order by pos rows unbounded preceding), 4) + 0.0 as cum,
round(quantile_cont(h, 0.75) over (partition by sample_index), 6) + 0.0 as q75, lead(pos, 1, -1) over w as next_pos from ev window w as (partition by sample_index order by pos)""")
def _(spark, sf_dir):
    w = Window.partitionBy("sample_index").orderBy("pos")
    return tables.entropy_series(spark, sf_dir).select(
        "sample_index", "pos", rounded(F.col("h") - F.lag("h").over(w)).alias("rise"), rounded(F.sum("h").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("cum"),
        rounded(F.percentile("h", F.lit(0.75)).over(Window.partitionBy("sample_index"))).alias("q75"), F.lead("pos", 1, -1).over(w).alias("next_pos"))


@query("cut_positions", f"""with {EV}{_SUM},
c2 as (select distinct sample_index, least(greatest(pos, 1), n - 1)::int as cut from q where n > 1 and passed > coalesce(before, 0))
select sample_index, count(*) as cuts, min(cut) as first_cut, max(cut) as last_cut from c2 group by sample_index""")
def _(spark, sf_dir):
    s = patching.spans(tables.entropy_series(spark, sf_dir), patching.Budget(ratio=4.0)).where("start > 0").select("sample_index", F.col("start").alias("cut")).distinct()
    return s.groupBy("sample_index").agg(F.count("*").alias("cuts"), F.min("cut").alias("first_cut"), F.max("cut").alias("last_cut"))


# --- corpus -----------------------------------------------------------------------------------------------------
@query("messages_validate", f"with {MSG} select conv_id, len(m)::int as n_messages, len(list_filter(m, lambda x: x.role = 'assistant')) > 0 and len(list_filter(m, lambda x: coalesce(x.role, '') = '' or coalesce(x.content, '') = '')) = 0 as is_valid from cm")
def _(spark, sf_dir):
    return tables.conversations(spark, sf_dir).select("conv_id", F.size("messages").alias("n_messages"), T.valid_messages(F.col("messages")).alias("is_valid"))


@query("messages_reject_count", "with v as (select conv_id, bool_or(role = 'assistant') and bool_and(coalesce(role, '') <> '' and coalesce(text, '') <> '') as ok from conversations group by 1) select count(*) filter (ok) as kept, count(*) filter (not ok) as rejected from v")
def _(spark, sf_dir):
    v = tables.conversations(spark, sf_dir).select(T.valid_messages(F.col("messages")).alias("ok"))
    return v.agg(F.count_if("ok").alias("kept"), F.count_if(~F.col("ok")).alias("rejected"))


#: Shares of the table, in hundredths.
_SHARES = {"train": 60, "eval": 15, "test": 20}
_SPLIT = """n as (select count(*) as n from documents), sp as (select doc_id, row_number() over (order by md5('1337:' || doc_id), doc_id) as rank from documents),
la as (select doc_id, rank, case when rank <= n * 60 // 100 then 'train' when rank <= n * 60 // 100 + n * 15 // 100 then 'eval' else 'test' end as split from sp, n where rank <= n * 60 // 100 + n * 15 // 100 + n * 20 // 100)"""


def _split(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "source")
    n = docs.count()
    return corpus.split(docs, {k: n * share // 100 for k, share in _SHARES.items()}, 1337)


@query("corpus_split", f"with {_SPLIT} select doc_id, rank, split from la")
def _(spark, sf_dir):
    return _split(spark, sf_dir).select("doc_id", "rank", "split")


@query("corpus_split_counts", f"with {_SPLIT} select split, count(*) as n from la group by split")
def _(spark, sf_dir):
    return corpus.split_counts(_split(spark, sf_dir))


@query("split_overlap", f"with {_SPLIT} select count(*) as shared from la a join la b on a.doc_id = b.doc_id and a.split < b.split")
def _(spark, sf_dir):
    s = _split(spark, sf_dir)
    a, b = s.select("doc_id", F.col("split").alias("a")), s.select("doc_id", F.col("split").alias("b"))
    return a.join(b, "doc_id").where("a < b").agg(F.count("*").alias("shared"))


@query("prefix_limit", f"with {EV} select sample_index, count(*) as n from ev where sample_index < (select trunc(max(sample_index) / 2.0)::int from ev) group by 1")
def _(spark, sf_dir):
    half = tables.entropy_series(spark, sf_dir).agg((F.max("sample_index") / 2).cast("int")).first()[0]
    return corpus.prefix_limit(tables.entropy_series(spark, sf_dir), half).groupBy("sample_index").agg(F.count("*").alias("n"))


@query("prefix_limit_none", f"with {EV} select sample_index, count(*) as n from ev group by 1")
def _(spark, sf_dir):
    return corpus.prefix_limit(tables.entropy_series(spark, sf_dir), None).groupBy("sample_index").agg(F.count("*").alias("n"))


# --- text -------------------------------------------------------------------------------------------------------
def _traced(spark, sf_dir):
    c = tables.traces(spark, sf_dir).withColumn("idx", T.last_assistant(F.col("messages"))).where("idx >= 0")
    c = c.withColumn("content", F.get("messages", F.col("idx"))["content"]).withColumn("p", T.trace_parts(F.col("content"))).where("p is not null")
    return c.select("conv_id", "messages", "idx", F.col("p.trace").alias("trace"), F.col("p.answer").alias("answer"))


@query("last_assistant", f"with {TR} select conv_id, idx::int as idx, length(text)::int as n_chars from lt")
def _(spark, sf_dir):
    c = tables.traces(spark, sf_dir).withColumn("idx", T.last_assistant(F.col("messages"))).where("idx >= 0")
    return c.select("conv_id", "idx", F.length(F.get("messages", F.col("idx"))["content"]).alias("n_chars"))


@query("trace_extract", f"with {TR} select conv_id, trace, answer from pa where answer <> ''")
def _(spark, sf_dir):
    return _traced(spark, sf_dir).select("conv_id", "trace", "answer")


@query("trace_skips", f"with {TR} select (select count(*) from cm) as conversations, (select count(*) from pa where answer <> '') as kept, (select count(*) from cm) - (select count(*) from pa where answer <> '') as skipped")
def _(spark, sf_dir):
    c = tables.traces(spark, sf_dir).withColumn("idx", T.last_assistant(F.col("messages")))
    ok = (F.col("idx") >= 0) & T.trace_parts(F.try_element_at(F.col("messages"), F.greatest(F.col("idx"), F.lit(0)) + 1)["content"]).isNotNull()
    return c.agg(F.count("*").alias("conversations"), F.count_if(ok).alias("kept"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("skipped"))


@query("trace_replace", f"with {TR} select conv_id, substring(text, 1, a + 6) || repeat('<|slot|>', 3) || substring(text, b) as content from pa where answer <> ''")
def _(spark, sf_dir):
    t = _traced(spark, sf_dir)
    swapped = T.replace_trace(F.col("messages"), F.col("idx"), T.placeholders(F.lit(3)))
    return t.select("conv_id", F.get(swapped, F.col("idx"))["content"].alias("content"))


@query("trace_prefix", f"with {TR} select pa.conv_id, coalesce((select string_agg('<|' || y.role || '|>' || chr(10) || y.text || chr(10), '' order by y.turn) from tx y where y.conv_id = pa.conv_id and y.turn < pa.turn), '') || '<|assistant|>' || chr(10) as prefix from pa where answer <> ''")
def _(spark, sf_dir):
    t = _traced(spark, sf_dir)
    return t.select("conv_id", T.render(T.prefix_messages(F.col("messages"), F.col("idx")), generation_prompt=True).alias("prefix"))


@query("chat_render", f"with {TR} select conv_id, {RENDER} as rendered from cm")
def _(spark, sf_dir):
    return tables.traces(spark, sf_dir).select("conv_id", T.render(F.col("messages")).alias("rendered"))


_SPANS = f"""{TR}, o as (select conv_id, turn, role, length(role) + 5 as head, length(text) as n, text from tx),
s as (select *, (sum(head + n + 1) over (partition by conv_id order by turn) - n - 1)::int as start_pos from o)"""


@query("assistant_spans", f"with {_SPANS} select conv_id, start_pos, (start_pos + n)::int as end_pos from s where role = 'assistant'")
def _(spark, sf_dir):
    c = tables.traces(spark, sf_dir)
    c = T.settled(c, rendered=T.render(F.col("messages")))
    s = c.select("conv_id", F.explode(T.assistant_spans(F.col("messages"), F.col("rendered"))).alias("s"))
    return s.select("conv_id", F.col("s.start").alias("start_pos"), F.col("s.end").alias("end_pos"))


@query("answer_span", f"""with {_SPANS}, a as (select pa.conv_id, pa.answer, s.turn, s.start_pos + strpos(s.text, pa.answer) - 1 as p from pa join s on s.conv_id = pa.conv_id and s.role = 'assistant' and strpos(s.text, pa.answer) > 0 where pa.answer <> '')
select conv_id, arg_min(p, turn)::int as start_pos, (arg_min(p, turn) + any_value(length(answer)))::int as end_pos from a group by conv_id""")
def _(spark, sf_dir):
    t = _traced(spark, sf_dir)
    t = T.settled(t, rendered=T.render(F.col("messages")))
    return t.withColumn("s", T.answer_span(F.col("messages"), F.col("rendered"), F.col("answer"))).select("conv_id", F.col("s.start").alias("start_pos"), F.col("s.end").alias("end_pos"))


_SHIFTED = f"""{_SPANS}, rr as (select conv_id, {RENDER} as r from cm),
sh as (select pa.conv_id, pa.answer, case when pa.conv_id % 2 = 0 then replace(r, '<think>', '<think>' || chr(10)) else replace(r, 'Answer', 'Reply') end as r from pa join rr on rr.conv_id = pa.conv_id where pa.answer <> ''),
fb as (select conv_id, answer, r, case when strpos(r, answer) > 0 then (length(r) - strpos(reverse(r), reverse(answer)) - length(answer) + 1)::int end as start_pos from sh)"""


def _shifted(spark, sf_dir):
    """Rendered texts in which assistant messages are not found as they are; in every other one the answer is not there at all."""
    t = T.settled(_traced(spark, sf_dir), rendered=T.render(F.col("messages")))
    return t.withColumn("rendered", F.when(F.col("conv_id") % 2 == 0, F.replace("rendered", F.lit("<think>"), F.lit("<think>\n"))).otherwise(F.replace("rendered", F.lit("Answer"), F.lit("Reply"))))


@query("answer_span_fallback", f"with {_SHIFTED} select conv_id, start_pos, (start_pos + length(answer))::int as end_pos from fb")
def _(spark, sf_dir):
    t = T.settled(_shifted(spark, sf_dir), s=T.answer_span(F.col("messages"), F.col("rendered"), F.col("answer")))
    return t.select("conv_id", F.col("s.start").alias("start_pos"), F.col("s.end").alias("end_pos"))


@query("token_offsets", r"""with w as (select conv_id, turn, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') as w, text from conversations)
select conv_id, turn, len(w)::int as n_tokens, list_sum(list_transform(w, lambda x: length(x)))::bigint as token_chars, w[1] as first_token, (strpos(text, w[1]) - 1)::int as first_start from w""")
def _(spark, sf_dir):
    c = tables.table(spark, sf_dir, "conversations").withColumn("o", T.word_offsets(F.col("text")))
    chars = F.aggregate("o", F.lit(0).cast("long"), lambda a, t: a + (t["end"] - t["start"]).cast("long"))
    return c.select("conv_id", "turn", F.size("o").alias("n_tokens"), chars.alias("token_chars"), F.col("o")[0]["token"].alias("first_token"), F.col("o")[0]["start"].alias("first_start"))


_ANSWER_AT = f"""{_SPANS}, rr as (select conv_id, {RENDER} as r from cm),
ax as (select pa.conv_id, pa.answer, s.turn, s.start_pos + strpos(s.text, pa.answer) - 1 as p from pa join s on s.conv_id = pa.conv_id and s.role = 'assistant' and strpos(s.text, pa.answer) > 0 where pa.answer <> ''),
ay as (select conv_id, any_value(answer) as answer, arg_min(p, turn)::int as p from ax group by conv_id),
az as (select conv_id, len(list_filter(string_split_regex(answer, '\\s+'), lambda x: x <> '')) as n, len(list_filter(string_split_regex(substring(r, 1, p), '\\s+'), lambda x: x <> '')) as k from ay join rr using (conv_id))"""


@query("answer_label_mask", f"with {_ANSWER_AT} select conv_id, range(k, k + n)::int[] as labelled from az")
def _(spark, sf_dir):
    t = T.settled(_traced(spark, sf_dir), rendered=T.render(F.col("messages")))
    t = T.settled(t, s=T.answer_span(F.col("messages"), F.col("rendered"), F.col("answer")), o=T.word_offsets(F.col("rendered")))
    marked = T.labels(F.col("o"), F.transform("o", lambda x, i: i), F.array("s"))
    return t.select("conv_id", F.filter(marked, lambda x: x != T.IGNORE).alias("labelled"))


_TOKENS = r"'<\|\w+\|>|</?think>|[^ \t\n\f\r<]+|<'"


@query("slot_positions", f"""with {TR}, rr as (select pa.conv_id, pa.idx % 5 + 1 as k, {RENDER} as r, text, substring(text, 1, a + 6) || repeat('<|slot|>', (pa.idx % 5 + 1)::int) || substring(text, b) as swapped from pa join cm using (conv_id) where answer <> ''),
fs as (select conv_id, k, (select string_agg('<|' || role || '|>' || chr(10) || case when x.turn = l.turn then rr.swapped else x.text end || chr(10), '' order by x.turn) from tx x join la l using (conv_id) where x.conv_id = rr.conv_id) as r from rr)
select conv_id, range(n, n + k)::int[] as slots from (select conv_id, k, len(regexp_extract_all(substring(r, 1, strpos(r, '<|slot|>') - 1), {_TOKENS})) as n from fs)""")
def _(spark, sf_dir):
    t = _traced(spark, sf_dir).withColumn("compressed_cot_tokens", (F.col("idx") % 5 + 1).cast("int"))
    t = t.withColumn("messages", T.replace_trace(F.col("messages"), F.col("idx"), T.placeholders(F.col("compressed_cot_tokens"))))
    return compression.slot_places(t, chat_tokens.MARKED_WORDS).select("conv_id", F.col("places").alias("slots"))


_WORDS = r"""{TR}, ids as (select conv_id, turn, role, list_transform(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''), lambda x: (('0x' || substr(md5(x), 1, 8))::bigint % 50000)::int) as i, (('0x' || substr(md5('<|' || role || '|>'), 1, 8))::bigint % 50000)::int as head from tx),
fl as (select conv_id, flatten(list(list_concat([head], i) order by turn)) as input_ids, flatten(list(list_concat([-100], case when role = 'assistant' then i else list_transform(i, lambda x: -100) end) order by turn)) as labels from ids group by conv_id),
w as (select conv_id, role, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) as n from tx),
n as (select conv_id, sum(n + 1)::int as n_tokens, coalesce(sum(n) filter (role = 'assistant'), 0)::int as n_labels from w group by conv_id)""".replace("{TR}", TR)


@query("sft_tokens", f"with {_WORDS} select conv_id, input_ids, labels, n_labels > 0 as trainable from n join fl using (conv_id)")
def _(spark, sf_dir):
    rows = chat_tokens.tokenize_for_sft(tables.traces(spark, sf_dir))
    return rows.select("conv_id", "input_ids", "labels", chat_tokens.has_trainable_tokens(F.col("labels")).alias("trainable"))


@query("sft_truncated", f"with {_WORDS} select conv_id, input_ids[greatest(1, len(input_ids) - 63):] as input_ids, labels[greatest(1, len(labels) - 63):] as labels from fl")
def _(spark, sf_dir):
    return chat_tokens.tokenize_for_sft(tables.traces(spark, sf_dir), 64).select("conv_id", "input_ids", "labels")


@query("collated_batches", f"with {_WORDS} select conv_id, max(n_tokens) over (partition by conv_id // 8) as width, n_tokens as mask_sum, (max(n_tokens) over (partition by conv_id // 8) - n_labels)::int as ignored from n")
def _(spark, sf_dir):
    rows = chat_tokens.tokenize_for_sft(tables.traces(spark, sf_dir)).withColumn("batch", F.floor(F.col("conv_id") / 8))
    out = chat_tokens.collate(rows, "batch")
    return out.select("conv_id", F.size("input_ids").alias("width"), F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("mask_sum"), F.size(F.filter("labels", lambda x: x == T.IGNORE)).alias("ignored"))


@query("answer_positions", f"with {_ANSWER_AT} select conv_id, range(k, k + n)::int[] as answer_positions from az")
def _(spark, sf_dir):
    return chat_tokens.tokenize_answer(_traced(spark, sf_dir)).select("conv_id", "answer_positions")


@query("answer_tokens_fallback", f"""with {_SHIFTED} select conv_id, len(list_filter(string_split_regex(substring(r, 1, start_pos), '\\s+'), lambda x: x <> ''))::int as first_position, len(list_filter(string_split_regex(answer, '\\s+'), lambda x: x <> ''))::int as answer_tokens from fb where start_pos is not null""")
def _(spark, sf_dir):
    t = T.settled(_shifted(spark, sf_dir), s=T.answer_span(F.col("messages"), F.col("rendered"), F.col("answer")), o=T.word_offsets(F.col("rendered"))).where("s is not null")
    marked = F.filter(T.labels(F.col("o"), F.transform("o", lambda x, i: i), F.array("s")), lambda x: x != T.IGNORE)
    return t.select("conv_id", F.array_min(marked).alias("first_position"), F.size(marked).alias("answer_tokens"))


# --- compression ------------------------------------------------------------------------------------------------
_CUT = r"""{TR}, tt as (select conv_id, (generate_subscripts(w, 1) - 1)::int as pos, unnest(w) as token from (select conv_id, list_filter(string_split_regex(trace, '\s+'), lambda x: x <> '') as w from pa where answer <> '')),
th as (select conv_id, pos, token, length(token)::double as h from tt)""".replace("{TR}", TR)


def _compressed(spark, sf_dir, method):
    traces = compression.traced(tables.traces(spark, sf_dir))
    rows = compression.trace_tokens(traces).withColumn("h", F.length("token").cast("double"))
    vectors = tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("token_id"), F.col("embedding").alias("vector"))
    rows = rows.withColumn("token_id", F.col("token_id") % F.lit(500)).join(vectors.select("token_id"), "token_id")
    return compression.compress(traces, rows, vectors, method, 500, "conv_id")


_FINISH = "select pa.conv_id, '{name}' as method, substring(text, 1, a + 6) || repeat('<|slot|>', c.k::int) || substring(text, b) as content, c.n::int as original_cot_tokens, c.k::int as compressed_cot_tokens, round(c.k / c.n::double, 6) as compression_ratio from pa join c on c.conv_id = pa.conv_id"


def _finish(df):
    return df.select("conv_id", "method", F.get("messages", T.last_assistant(F.col("messages")))["content"].alias("content"), "original_cot_tokens", "compressed_cot_tokens", rounded(F.col("compression_ratio")).alias("compression_ratio"))


@query("compress_uniform", f"with {_CUT}, c as (select conv_id, count(*) as n, ceil(count(*) / 4.0) as k from th group by conv_id) " + _FINISH.format(name="simple_mean_uniform_cr4"))
def _(spark, sf_dir):
    return _finish(_compressed(spark, sf_dir, compression.Method("simple_mean", patching.Uniform(key="conv_id", ratio=4.0))).chats)


_THC = f"{_CUT}, q as (select conv_id, quantile_cont(h, 0.75) as q from th group by conv_id), c as (select conv_id, count(*) as n, count(*) filter (pos = 0 or h >= q) as k from th join q using (conv_id) group by conv_id)"


@query("compress_threshold", f"with {_THC} " + _FINISH.format(name="entropy_weighted_mean_t0_entropy_threshold_cr4"))
def _(spark, sf_dir):
    return _finish(_compressed(spark, sf_dir, compression.Method("entropy_weighted_mean", patching.Threshold(key="conv_id", ratio=4.0), 0.0)).chats)


@query("compress_splice", f"with {_THC} select pa.conv_id, c.k as slots, 64 * c.k as numbers from pa join c on c.conv_id = pa.conv_id")
def _(spark, sf_dir):
    """Each slot's vector meets its placeholder: as many as there are spans, with a number for every dimension."""
    out = _compressed(spark, sf_dir, compression.Method("entropy_weighted_mean", patching.Threshold(key="conv_id", ratio=4.0), 0.0))
    both = compression.spliced(compression.slot_places(out.chats, chat_tokens.MARKED_WORDS), out.slots)
    return both.groupBy("conv_id").agg(F.countDistinct("place").alias("slots"), F.sum(F.size(F.filter("vector", lambda x: x.isNotNull()))).alias("numbers"))


@query("entropy_eligible", f"with {TR} select conv_id from pa where answer <> '' and idx > 0")
def _(spark, sf_dir):
    return compression.entropy_eligible(compression.traced(tables.traces(spark, sf_dir))).select("conv_id")


# --- run artifacts ----------------------------------------------------------------------------------------------
def _written(spark, sf_dir):
    """A run's artifacts in the shared folder."""
    import uuid

    from tracelens.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/run-{uuid.uuid4()}"
    tokens = tables.token_logprobs(spark, sf_dir).withColumn("token_index", F.lit(0)).withColumn("token_id", F.col("event_id").cast("int"))
    s = _samples(spark, sf_dir)
    artifacts.write_run(folder, s, summary.summarize(s), tokens)
    return folder


@query("run_artifacts", f"with {_SAMP}, y as ({_SUMM} from sa group by method), t as (select method, count(*) as tokens from lp group by method), r as (select method, count(*) filter (compression_ratio is not null) as points from sa group by method) select y.*, tokens, points from y join t using (method) join r using (method)")
def _(spark, sf_dir):
    """Writes a run and reports on what it reads back: the summary, the number of tokens and of scatter points."""
    folder = _written(spark, sf_dir)
    points, _ = reporting.scatter_points(artifacts.load_samples(spark, folder), "compression_ratio", "logprob_mean")
    tokens = artifacts.load_tokens(spark, folder, ["method"]).groupBy("method").agg(F.count("*").alias("tokens"))
    read = _rounded_summary(artifacts.load_summaries(spark, folder)).withColumn("samples", F.col("samples").cast("long"))
    return read.join(tokens, "method").join(points.groupBy("method").agg(F.count("*").alias("points")), "method").checkpoint()


@query("run_token_statistics", f"with {_HIST0}, p as (select method, sum(exp(-30.0 + (bin + 0.5) * 0.01) * cnt) as p from hs group by method) select mo.method, n, round(total / n, 6) + 0.0 as mean from mo")
def _(spark, sf_dir):
    mom, hist, damaged = artifacts.token_statistics(spark, _written(spark, sf_dir))
    mom, hist = summary.from_sketch_documents(summary.sketch_documents(mom, hist))
    if damaged.count():
        raise ValueError("malformed lines")
    return mom.select("method", "n", rounded(F.col("total") / F.col("n")).alias("mean"))


# --- language model ---------------------------------------------------------------------------------------------
_TOK = r"tok as (select doc_id, (generate_subscripts(w, 1) - 1)::int as pos, unnest(w) as token from (select doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') as w from documents))"
_BG = _TOK + ", bg as (select prev, token, count(*) as c from (select token, lag(token) over (partition by doc_id order by pos) as prev from tok) where prev is not null group by all)"


def _doc_tokens(spark, sf_dir):
    return lm.tokens(tables.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


@query("ngram_entropy", f"with {_BG} select prev, sum(c)::bigint as total, round(greatest(0.0::double, ln(sum(c)) - sum(c * ln(c)) / sum(c)), 6) + 0.0 as h from bg group by prev")
def _(spark, sf_dir):
    return lm.context_entropy(lm.bigrams(_doc_tokens(spark, sf_dir), "doc_id")).select("prev", "total", rounded(F.col("h")).alias("h"))


@query("token_entropy_shifted", f"with {flagship.TT} select conv_id, pos, round(h, 6) + 0.0 as h from th")
def _(spark, sf_dir):
    turns = tables.table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text")
    cx = lm.context_entropy(lm.bigrams(lm.tokens(turns, "id"), "id"))
    return lm.token_entropies(tables.trace_tokens(spark, sf_dir), cx, "conv_id").select("conv_id", "pos", rounded(F.coalesce("h", F.lit(0.0))).alias("h"))


_LPQ = f"""{flagship.TT}, v as (select count(distinct token) as v from ct),
al as (select x.conv_id, x.pos, ln((coalesce(bg.c, 0) + 0.5::double) / (coalesce(cx.total, 0) + 0.5::double * v.v)) as lp from (select *, lag(token) over (partition by conv_id order by pos) as prev from an) x left join bg on bg.prev = x.prev and bg.token = x.token left join cx on cx.prev = x.prev, v where x.prev is not null)"""


def _answer_logprobs(spark, sf_dir):
    turns = tables.table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text")
    toks = lm.tokens(turns, "id")
    pairs = lm.bigrams(toks, "id")
    return lm.log_probs(tables.answer_tokens(spark, sf_dir), pairs, lm.context_entropy(pairs), toks.agg(F.countDistinct("token").alias("v")), "conv_id")


@query("token_logprob", f"with {_LPQ} select conv_id, pos, round(lp, 6) + 0.0 as logprob from al")
def _(spark, sf_dir):
    return _answer_logprobs(spark, sf_dir).select("conv_id", "pos", rounded(F.col("logprob")).alias("logprob"))


@query("answer_logprob", f"with {_LPQ} select conv_id, count(*) as answer_tokens, round(sum(lp), 5) + 0.0 as logprob_sum, round(sum(lp) / count(*), 6) + 0.0 as logprob_mean from al group by conv_id")
def _(spark, sf_dir):
    s = summary.sample_scores(_answer_logprobs(spark, sf_dir).select(F.lit("base").alias("method"), F.col("conv_id").alias("sample_index"), "logprob"))
    return s.select(F.col("sample_index").alias("conv_id"), "answer_tokens", rounded(F.col("logprob_sum"), 5).alias("logprob_sum"), rounded(F.col("logprob_mean")).alias("logprob_mean"))


@query("softmax_entropy_array", """with x as (select vec_id, label, list_transform(embedding, lambda v: v::double) as e from embeddings), z as (select *, list_max(e) + ln(list_sum(list_transform(e, lambda v: exp(v - list_max(e))))) as z from x)
select vec_id, round(z - list_sum(list_transform(e, lambda v: v * exp(v - z))), 6) + 0.0 as entropy, round(e[label + 1] - z, 6) + 0.0 as label_logprob from z""")
def _(spark, sf_dir):
    e = F.transform("embedding", lambda x: x.cast("double"))
    return tables.table(spark, sf_dir, "embeddings").select("vec_id", rounded(N.softmax_entropy(e)).alias("entropy"), rounded(N.label_logprob(e, F.col("label"))).alias("label_logprob"))


# --- pooling ----------------------------------------------------------------------------------------------------
def _pool_rows(spark, sf_dir, strategy):
    turns = tables.table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text")
    cx = lm.context_entropy(lm.bigrams(lm.tokens(turns, "id"), "id"))
    rows = lm.token_entropies(tables.trace_tokens(spark, sf_dir), cx, "conv_id").select("conv_id", "pos", "token", F.coalesce("h", F.lit(0.0)).alias("h"))
    n = tables.table(spark, sf_dir, "embeddings").agg(F.count("*").alias("n_vec"))
    return strategy.apply(rows).crossJoin(F.broadcast(n)).withColumn("token_id", N.hash_bucket(F.col("token"), F.col("n_vec"))).drop("n_vec")  # one row


def _vectors(spark, sf_dir):
    return tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("token_id"), F.col("embedding").alias("vector"))


_ID = "(('0x' || substr(md5(token), 1, 8))::bigint % (select count(*) from embeddings))"
_EMB = "em as (select vec_id, (generate_subscripts(embedding, 1) - 1)::int as dim, unnest(embedding)::double as v from embeddings)"
_THP = "tf as (select *, case when pos = 0 or h >= quantile_cont(h, 1 - 1 / 4.0::double) over (partition by conv_id) then 1 else 0 end as st from th), pr as (select *, (sum(st) over (partition by conv_id order by pos) - 1)::int as patch from tf)"
_UNP = "pr as (select *, floor(pos / 8)::int as patch from th)"


def _pool_sql(patches: str, weight: str) -> str:
    return f"""with {flagship.TT}, {patches}, wt as (select conv_id, patch, pos, {_ID} as vec_id, {weight} as w from pr),
nm as (select conv_id, patch, sqrt(sum(w * w)) as norm from wt group by all), {_EMB},
ag as (select conv_id, patch, vec_id, sum(w) as w from wt group by all)
select conv_id, patch, dim, round(sum(w * v) / any_value(norm), 4) + 0.0 as x from ag join em using (vec_id) join nm using (conv_id, patch) group by conv_id, patch, dim"""


def _pooled(strategy, weigh):
    def f(spark, sf_dir):
        rows = weigh(_pool_rows(spark, sf_dir, strategy))
        return pooling.pool(rows, _vectors(spark, sf_dir), "conv_id").select("conv_id", "patch", "dim", rounded(F.col("x"), 4).alias("x"))

    return f


_POW = "pow(greatest(h, 1e-12::double) / max(greatest(h, 1e-12::double)) over (partition by conv_id, patch), {e})"
query("pool_simple_mean", _pool_sql(_UNP, "1.0::double"))(_pooled(patching.Uniform(key="conv_id", ratio=8.0), lambda r: pooling.mean_weights(r, "conv_id")))
query("pool_entropy_weighted_t1", _pool_sql(_THP + ", pw as (select *, " + _POW.format(e="1.0::double") + " as p from pr), pr2 as (select *, p / sum(p) over (partition by conv_id, patch) as ww from pw)", "ww").replace("as w from pr)", "as w from pr2)"))(_pooled(patching.Threshold(key="conv_id", ratio=4.0), lambda r: pooling.entropy_weights(r, 1.0, "conv_id")))
query("pool_entropy_weighted_t05", _pool_sql(_THP + ", pw as (select *, " + _POW.format(e="2.0::double") + " as p from pr), pr2 as (select *, p / sum(p) over (partition by conv_id, patch) as ww from pw)", "ww").replace("as w from pr)", "as w from pr2)"))(_pooled(patching.Threshold(key="conv_id", ratio=4.0), lambda r: pooling.entropy_weights(r, 0.5, "conv_id")))
query("pool_entropy_weighted_t0", _pool_sql(_THP, "case when row_number() over (partition by conv_id, patch order by h desc, pos) = 1 then 1.0::double else 0.0::double end"))(_pooled(patching.Threshold(key="conv_id", ratio=4.0), lambda r: pooling.entropy_weights(r, 0, "conv_id")))


@query("pool_random_native", f"""with {flagship.TT}, {_UNP}, p as (select distinct conv_id, patch from pr), i as (select *, ('0x' || substr(md5('13:' || conv_id || ':' || patch), 1, 8))::bigint % (select count(*) from embeddings) as token_id from p)
select conv_id, patch, token_id, round(embedding[1]::double, 5) + 0.0 as x0 from i join embeddings on vec_id = token_id""")
def _(spark, sf_dir):
    p = patching.Uniform(key="conv_id", ratio=8.0).apply(tables.trace_tokens(spark, sf_dir)).select("conv_id", "patch").distinct()
    n = tables.table(spark, sf_dir, "embeddings").agg(F.count("*").alias("high"))
    ids = pooling.random_ids(p.crossJoin(F.broadcast(n)), F.col("high"), key="conv_id")  # one row
    return ids.join(_vectors(spark, sf_dir), "token_id").select("conv_id", "patch", "token_id", rounded(F.col("vector")[0].cast("double"), 5).alias("x0"))


@query("pool_random_compat")
def _(spark, sf_dir):
    counts = tables.entropy_series(spark, sf_dir).groupBy("sample_index").agg(F.count("*").alias("n"))
    return pooling.compat_random_ids(counts, 200)


query("evaluate_methods", flagship.SQL)(flagship.evaluate_methods)


# --- summaries and sketch ---------------------------------------------------------------------------------------


def _samples(spark, sf_dir):
    s = summary.sample_scores(tables.token_logprobs(spark, sf_dir))
    kept = (F.col("answer_tokens") % 7 + 1).cast("int")
    return s.withColumn("compression_ratio", F.when(F.col("sample_index") % 5 != 0, N.safe_ratio(kept, F.lit(8)))).withColumn("compressed_cot_tokens", kept)




def _rounded_summary(df):
    return df.select("method", "samples", *[rounded(F.col(c), 5 if c == "mean_logprob_sum" else 6).alias(c) for c in ("mean_logprob", "std_logprob", "sem_logprob", "mean_logprob_sum", "mean_answer_tokens", "mean_compression_ratio", "std_compression_ratio", "mean_compressed_cot_tokens")])


@query("method_summary", f"with {_SAMP} {_SUMM} from sa group by method")
def _(spark, sf_dir):
    return _rounded_summary(summary.summarize(_samples(spark, sf_dir)))


@query("method_summary_empty", f"with {_SAMP}, x as (select distinct method from sa union all select 'unused'), y as ({_SUMM} from sa group by method) select x.method, coalesce(samples, 0) as samples, mean_logprob from x left join y on x.method = y.method")
def _(spark, sf_dir):
    s = _samples(spark, sf_dir)
    names = s.select("method").distinct().unionByName(spark.range(1).select(F.lit("unused").alias("method")))
    return _rounded_summary(summary.summarize(s, names)).select("method", "samples", "mean_logprob")


@query("skip_counts", f"with {_SAMP} select method, count(*) filter (compression_ratio is null) as skipped, count(*) filter (compression_ratio is not null) as kept from sa group by method")
def _(spark, sf_dir):
    status = F.when(F.col("compression_ratio").isNull(), "no_ratio").otherwise("ok")
    return _samples(spark, sf_dir).withColumn("status", status).groupBy("method").agg(F.count_if(F.col("status") != "ok").alias("skipped"), F.count_if(F.col("status") == "ok").alias("kept"))


@query("paired_method_delta", f"with {_SAMP}, m as (select min(method) as a from sa) select b.method, count(*) as pairs, round(avg(b.logprob_mean - a.logprob_mean), 6) + 0.0 as delta from sa a join m on a.method = m.a join sa b on a.sample_index = b.sample_index and b.method <> a.method group by b.method")
def _(spark, sf_dir):
    s = _samples(spark, sf_dir).select("method", "sample_index", "logprob_mean")
    first = s.join(F.broadcast(s.agg(F.min("method").alias("method"))), "method").select("sample_index", F.col("method").alias("a"), F.col("logprob_mean").alias("a_mean"))
    return s.join(first, "sample_index").where("method <> a").groupBy("method").agg(F.count("*").alias("pairs"), rounded(F.avg(F.col("logprob_mean") - F.col("a_mean"))).alias("delta"))


_HIST = _HIST0


@query("hist_fine", f"with {_HIST} select method, bin, cnt from hs")
def _(spark, sf_dir):
    return summary.histogram(tables.token_logprobs(spark, sf_dir))


@query("hist_quantiles", f"""with {_HIST}, cu as (select hs.method, bin, cnt, n, under, (under + sum(cnt) over (partition by hs.method order by bin rows unbounded preceding))::bigint as cum from hs join mo using (method)),
w as (select method, n, under, unnest([0.05, 0.25, 0.5, 0.75, 0.95]::double[]) as q from mo), f as (select w.method, q, q * w.n as target, w.under, min(bin) as bin from w join cu on cu.method = w.method and cum >= q * w.n group by all)
select f.method, q, round(case when target <= f.under then -30.0 else -30.0 + f.bin * 0.01::double + (target - (cum - cnt)) / cnt * 0.01::double end, 6) + 0.0 as value from f join cu on cu.method = f.method and cu.bin = f.bin""")
def _(spark, sf_dir):
    t = tables.token_logprobs(spark, sf_dir)
    return summary.quantiles(summary.moments(t), summary.histogram(t)).select("method", "q", rounded(F.col("value")).alias("value"))


@query("density_coarse", f"with {_HIST} select hs.method, floor((bin - 1800) / 5)::int as coarse, sum(cnt)::bigint as cnt, (any_value(mo.under) + coalesce((select sum(cnt) from hs y where y.method = hs.method and y.bin < 1800), 0))::bigint as tail from hs join mo using (method) where bin >= 1800 group by hs.method, coarse")
def _(spark, sf_dir):
    t = tables.token_logprobs(spark, sf_dir)
    return summary.coarse_density(summary.moments(t), summary.histogram(t))


@query("token_summary", f"with {_HIST}, p as (select method, sum(exp(-30.0 + (bin + 0.5) * 0.01::double) * cnt) as p from hs group by method) select method, n, round(total / n, 6) + 0.0 as mean, round(sqrt(greatest(0, total_sq / n - (total / n) * (total / n))), 6) + 0.0 as std, round(coalesce(p, 0) / n, 6) + 0.0 as mean_prob from mo left join p using (method)")
def _(spark, sf_dir):
    t = tables.token_logprobs(spark, sf_dir)
    return summary.token_summary(summary.moments(t), summary.histogram(t)).select("method", "n", *[rounded(F.col(c)).alias(c) for c in ("mean", "std", "mean_prob")])


@query("sketch_merge", f"with {_HIST} select method, bin, cnt from hs")
def _(spark, sf_dir):
    t = tables.token_logprobs(spark, sf_dir)
    parts = None
    for k in range(3):  # three files' worth of partial sketches
        one = summary.histogram(t.where(F.pmod("event_id", F.lit(3)) == k))
        parts = one if parts is None else parts.unionByName(one)
    return summary.merge_histograms(parts)


@query("position_curve", f"with {LP}, p as (select method, logprob, (row_number() over (partition by method, sample_index order by ts, event_id) - 1)::int as position from lp) select method, position, count(*) as cnt, round(avg(logprob), 6) + 0.0 as mean from p where position < 512 group by all")
def _(spark, sf_dir):
    t = summary.with_position(tables.token_logprobs(spark, sf_dir), ["ts", "event_id"])
    return summary.position_curve(t).select("method", "position", "cnt", rounded(F.col("mean")).alias("mean"))


@query("mean_prob_vs_prob_of_mean", f"with {LP} select method, round(avg(exp(logprob)), 6) + 0.0 as mean_prob, round(exp(avg(logprob)), 6) + 0.0 as prob_of_mean from lp group by method")
def _(spark, sf_dir):
    p = reporting.probabilities(tables.token_logprobs(spark, sf_dir))
    return p.groupBy("method").agg(rounded(F.avg("prob")).alias("mean_prob"), rounded(F.exp(F.avg("logprob"))).alias("prob_of_mean"))


# --- reports ----------------------------------------------------------------------------------------------------
@query("box_stats", f"""with {LP}, b as (select method, count(*) as n, avg(logprob) as mean, stddev_pop(logprob) as std, quantile_cont(logprob, 0.25) as q1, quantile_cont(logprob, 0.5) as med, quantile_cont(logprob, 0.75) as q3 from lp group by method),
i as (select lp.method, logprob, logprob >= q1 - 1.5::double * (q3 - q1) and logprob <= q3 + 1.5::double * (q3 - q1) as inside from lp join b using (method)), e as (select method, min(logprob) filter (inside) as lo, max(logprob) filter (inside) as hi, count(*) filter (not inside) as fliers from i group by method)
select method, n, round(mean, 6) + 0.0 as mean, round(std, 6) + 0.0 as std, round(q1, 6) + 0.0 as q1, round(med, 6) + 0.0 as med, round(q3, 6) + 0.0 as q3, round(lo, 6) + 0.0 as whisker_lo, round(hi, 6) + 0.0 as whisker_hi, fliers from b join e using (method)""")
def _(spark, sf_dir):
    b = reporting.box_stats(tables.token_logprobs(spark, sf_dir), "logprob")
    return b.select("method", "n", *[rounded(F.col(c)).alias(c) for c in ("mean", "std", "q1", "med", "q3", "whisker_lo", "whisker_hi")], "fliers")


def _density_sql(ends: str) -> str:
    return f"""with {LP}, e as (select {ends} from lp), k as (select method, least(floor((logprob - lo) / ((hi - lo) / 79.0::double)), 78)::int as bin, (hi - lo) / 79.0::double as width from lp, e where logprob between lo and hi),
c as (select method, bin, any_value(width) as width, count(*) as cnt from k group by method, bin) select method, bin, round(cnt / (sum(cnt) over (partition by method) * width), 6) + 0.0 as density from c"""


@query("density_hist_full", _density_sql("min(logprob) as lo, max(logprob) as hi"))
def _(spark, sf_dir):
    return reporting.density(tables.token_logprobs(spark, sf_dir), "logprob").withColumn("density", rounded(F.col("density")))


@query("density_hist_zoom", _density_sql("quantile_cont(logprob, 0.005) as lo, quantile_cont(logprob, 0.995) as hi"))
def _(spark, sf_dir):
    return reporting.density(tables.token_logprobs(spark, sf_dir), "logprob", zoom=(0.005, 0.995)).withColumn("density", rounded(F.col("density")))


@query("curve_points", f"""with {_SAMP}, s as (select method, case when method = (select min(method) from sa) then 'base' else 'simple_mean' end as method_family, avg(compression_ratio) as mean_compression_ratio, avg(logprob_mean) as mean_logprob from sa group by method)
select method, method_family, (row_number() over (partition by method_family order by mean_compression_ratio, method))::int as point, method_family = 'base' and row_number() over (partition by method_family order by mean_compression_ratio, method) = 1 as is_line, round(mean_logprob, 6) + 0.0 as mean_logprob from s""")
def _(spark, sf_dir):
    s = summary.summarize(_samples(spark, sf_dir))
    first = s.agg(F.min("method").alias("first"))
    s = s.crossJoin(F.broadcast(first)).withColumn("method_family", F.when(F.col("method") == F.col("first"), "base").otherwise("simple_mean"))  # one row
    return reporting.curve_points(s).select("method", "method_family", "point", "is_line", rounded(F.col("mean_logprob")).alias("mean_logprob"))


@query("method_order", f"with {LP}, f as (select method, min(event_id) as first_seen from lp group by method union all select 'base', 10000000000::bigint union all select 'random', 10000000001::bigint) select method, (row_number() over (order by case method when 'base' then 0 when 'random' then 1 else 2 end, first_seen, method))::int as place from f")
def _(spark, sf_dir):
    seen = tables.token_logprobs(spark, sf_dir).groupBy("method").agg(F.min("event_id").alias("first_seen"))
    extra = spark.sql("select 'base' as method, 10000000000L as first_seen union all select 'random', 10000000001L")
    return reporting.method_order(seen.unionByName(extra)).select("method", "place")


@query("select_relabel", f"with {LP} select case method when 'click' then 'Click' else 'Purchase' end as label, count(*) as n from lp where method in ('click', 'purchase') group by 1")
def _(spark, sf_dir):
    kept = reporting.select_relabel(tables.token_logprobs(spark, sf_dir), [("click", "Click"), ("purchase", "Purchase"), ("unseen", "Unseen")])
    return kept.groupBy("label").agg(F.count("*").alias("n"))


def _runs(spark, sf_dir):
    t = tables.token_logprobs(spark, sf_dir)
    return t.withColumn("run", F.when((F.length("method") % 2 == 0) & (F.pmod("event_id", F.lit(2)) == 0), 2).otherwise(1))


_RUN = f"{LP}, rn as (select *, case when length(method) % 2 = 0 and event_id % 2 = 0 then 2 else 1 end as run from lp)"


@query("merge_last_wins", f"with {_RUN} select method, run, count(*) as n, round(sum(logprob), 4) + 0.0 as total from rn x where run = (select max(run) from rn y where y.method = x.method) group by all")
def _(spark, sf_dir):
    return reporting.merge_last(_runs(spark, sf_dir)).groupBy("method", "run").agg(F.count("*").alias("n"), rounded(F.sum("logprob"), 4).alias("total"))


@query("merge_concat", f"with {_RUN} select method, count(*) as n, count(distinct run) as runs from rn group by method")
def _(spark, sf_dir):
    r = _runs(spark, sf_dir)
    both = r.where("run = 1").unionByName(r.where("run = 2"))
    return both.groupBy("method").agg(F.count("*").alias("n"), F.countDistinct("run").alias("runs"))


# --- caches, ragged arrays, batches, schedules ------------------------------------------------------------------
@query("cache_missing", "select d.doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def _(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").select("doc_id").join(tables.table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("cache_union", "select d.doc_id, coalesce(l.quality, -1) as quality from documents d left join labels l on l.doc_id = d.doc_id")
def _(spark, sf_dir):
    cache = tables.table(spark, sf_dir, "labels").select("doc_id", "quality")
    wanted = tables.table(spark, sf_dir, "documents").select("doc_id")
    return artifacts.read_through(cache, wanted, lambda missing: missing.withColumn("quality", F.lit(-1)), "doc_id")


_RAG = "g as (select l_orderkey, list(l_quantity order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as q from lineitem group by 1)"


def _ragged(spark, sf_dir):
    s = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")))
    return tables.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(s, lambda x: x["l_quantity"]).alias("q"))


@query("ragged_offsets", f"with {_RAG}, n as (select l_orderkey, len(q)::bigint as len from g) select l_orderkey, len, (sum(len) over (order by l_orderkey rows unbounded preceding) - len)::bigint as off from n")
def _(spark, sf_dir):
    return artifacts.ragged_offsets(_ragged(spark, sf_dir), "q", "l_orderkey")


@query("ragged_slice", f"with {_RAG} select l_orderkey, q[2:3] as part, len(q)::int as n from g")
def _(spark, sf_dir):
    return _ragged(spark, sf_dir).select("l_orderkey", F.slice("q", 2, 2).alias("part"), F.size("q").alias("n"))


@query("pad_batch", f"with {_RAG}, b as (select *, max(len(q)) over (partition by l_orderkey // 8) as width from g) select l_orderkey, list_concat(q, list_transform(range(0, (width - len(q))::bigint), lambda x: 0.0::double)) as ids, list_transform(range(1, (width + 1)::bigint), lambda i: case when i <= len(q) then 1 else 0 end) as mask from b")
def _(spark, sf_dir):
    g = _ragged(spark, sf_dir).withColumn("n", F.size("q"))
    g = g.withColumn("width", F.max("n").over(Window.partitionBy(F.floor(F.col("l_orderkey") / 8))))
    return g.select("l_orderkey", N.pad_right(F.col("q"), F.col("width"), 0.0).alias("ids"), N.attention_mask(F.col("n"), F.col("width")).alias("mask"))


@query("greedy_batches", f"""with recursive {EV}, n as (select sample_index % 10 as grp, sample_index, count(*) as len from ev group by all), o as (select *, row_number() over (partition by grp order by sample_index) as k from n),
r as (select grp, sample_index, len, k, 0 as batch, 1 as cnt, len as longest from o where k = 1
union all select o.grp, o.sample_index, o.len, o.k, r.batch + case when r.cnt >= 4 or greatest(r.longest, o.len) * (r.cnt + 1) > 300 then 1 else 0 end, case when r.cnt >= 4 or greatest(r.longest, o.len) * (r.cnt + 1) > 300 then 1 else r.cnt + 1 end, case when r.cnt >= 4 or greatest(r.longest, o.len) * (r.cnt + 1) > 300 then o.len else greatest(r.longest, o.len) end from r join o on o.grp = r.grp and o.k = r.k + 1)
select grp, sample_index, len, batch::int as batch from r""")
def _(spark, sf_dir):
    n = tables.entropy_series(spark, sf_dir).groupBy("sample_index").agg(F.count("*").alias("len")).withColumn("grp", F.col("sample_index") % 10)
    return batching.greedy_batches(n, "grp", ["sample_index"], "len", 4, 300)


@query("cosine_warmup", "select s::bigint as step, round(case when s < 10 then s / 10.0::double else greatest(0, 0.5::double * (1 + cos(3.141592653589793::double * (s - 10) / 90.0::double))) end, 9) + 0.0 as factor, s % 25 = 0 as is_logged from range(0, 101) t(s)")
def _(spark, sf_dir):
    return spark.range(101).select(F.col("id").alias("step"), rounded(N.cosine_warmup(F.col("id"), 10, 100), 9).alias("factor"), N.every(F.col("id"), 25).alias("is_logged"))


@query("optimizer_steps", "select n::bigint as n, (ceil(ceil(n / 4.0::double) / 16.0::double) * 3)::bigint as steps from range(1, 2001, 37) t(n)")
def _(spark, sf_dir):
    return spark.range(1, 2001, 37).select(F.col("id").alias("n"), N.optimizer_steps(F.col("id"), 4, 16, 3).alias("steps"))


@query("ratio_null_safe", f"with {_SAMP} select method, sample_index, round(case when sample_index % 3 = 0 then null else answer_tokens::double / (sample_index % 3) end, 6) + 0.0 as ratio from sa")
def _(spark, sf_dir):
    return _samples(spark, sf_dir).select("method", "sample_index", rounded(N.safe_ratio(F.col("answer_tokens"), F.col("sample_index") % 3)).alias("ratio"))


@query("method_sample_grid", f"with {_SAMP}, m as (select distinct method from sa), s as (select distinct sample_index from sa) select m.method, count(*) as samples, count(sa.sample_index) as present from m cross join s left join sa on sa.method = m.method and sa.sample_index = s.sample_index group by m.method")
def _(spark, sf_dir):
    s = _samples(spark, sf_dir).select("method", "sample_index")
    total = s.select("sample_index").distinct().agg(F.count("*").alias("samples"))
    return s.groupBy("method").agg(F.count("*").alias("present")).crossJoin(F.broadcast(total)).select("method", "samples", "present")  # one row


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)
