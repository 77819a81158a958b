"""Mixing sources to target weights, in DataFrame functions alone.

Tokens are summed per source, a water level turns the weights into targets that respect each source's ceiling, the
target over the size is the source's repetition rate, and each document is emitted floor(rate) times plus one copy
drawn by a hash of its id with probability equal to the fraction.

Defined cases: a null text has size 0; a null source is a source of its own and comes last; an empty table gives an
empty result; repeated rows each get the copies of their id; sources of size 0 have target and rate 0; texts of any
length are counted as a whole. All columns pass through ``mix`` and ``emit`` untouched: where one has the name of a
column that is added, the added one's name ends in an underscore.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelens.llm.common import fresh_name
from tracelens.session import ensure_checkpoint_dir

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: Rates tables of at most this many rows are broadcast; larger ones are joined by a shuffle that salts the documents.
BROADCAST_ROWS = 50_000
SALTS = 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_rates(sized: DataFrame, source: str, size: str, weights: Sequence[int] = WEIGHTS, budget: tuple[int, int] = (3, 2), cap: int = 2) -> DataFrame:
    """One row a source: (source, source_size, target, rate).

    Targets are ``min(cap * size, weight * level)``; in the order of size / weight the level is found by prefix sums, so
    one pass takes the place of resharing the excess round by round. The sums are integers and each target is one
    division, so the result does not depend on the order of addition. The windows see one row a source.
    """
    num, den = budget
    per = sized.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("long").alias("source_size"))
    ranked = per.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.pmod(F.col("k") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    ranked = ranked.withColumn("w", w).withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    # size / weight ascending, compared without division by bringing each to the weights' common multiple
    common = 1
    for x in weights:
        common *= int(x)
    order = Window.orderBy((F.col("source_size") * F.lit(common) / F.col("w")), "k")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    level = ranked.withColumn("gone", F.coalesce(F.sum("source_size").over(before), F.lit(0))).withColumn("w_left", F.sum("w").over(after))
    left = level.withColumn("left", F.lit(num) * F.col("total") - F.lit(den * cap) * F.col("gone"))  # times den
    # capped: cap * size / w <= left / (den * w_left)
    full = left.withColumn("capped", F.lit(den * cap) * F.col("source_size") * F.col("w_left") <= F.col("left") * F.col("w"))
    full = full.withColumn("n", F.row_number().over(order))
    open_ = F.min(F.when(~F.col("capped"), F.struct("n", "left", "w_left"))).over(Window.partitionBy())
    full = full.withColumn("open", open_)
    target = F.when(F.col("capped") | F.col("open").isNull(), (F.lit(cap) * F.col("source_size")).cast("double")).otherwise(
        (F.col("w") * F.col("open.left")).cast("double") / (F.lit(den) * F.col("open.w_left")).cast("double")
    )
    full = full.withColumn("target", target)
    rate = F.when(F.col("source_size") == 0, F.lit(0.0)).when(F.col("capped"), F.lit(float(cap))).otherwise(F.least(F.col("target") / F.col("source_size").cast("double"), F.lit(float(cap))))
    return full.select("source", "source_size", "target", rate.alias("rate"))


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 52 bits of md5(seed:id)."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(2**52))


ADDED = ("mix_size", "mix_source_size", "mix_target", "mix_rate", "mix_copies")


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: int = 17, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """``docs`` with mix_size, mix_source_size, mix_target, mix_rate and mix_copies added at the end.

    The rates have one row a source. They are cut off with a checkpoint, counted, and broadcast only if there are at
    most BROADCAST_ROWS of them; otherwise the documents are salted, so that a hot source meets its rate in many tasks.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    n_size, n_total, n_target, n_rate, n_copies = (fresh_name(docs, x) for x in ADDED)
    key, salt, mine = (fresh_name(docs, x) for x in ("mix_source", "mix_salt", "mix_mine"))
    sized = docs.withColumn(n_size, word_count(F.col(text)))
    rates = source_rates(docs.select(F.col(source).alias("s"), word_count(F.col(text)).alias("n")), "s", "n", weights).checkpoint()
    rates = rates.select(F.col("source").alias(key), F.col("source_size").alias(n_total), F.col("target").alias(n_target), F.col("rate").alias(n_rate))
    if rates.count() <= BROADCAST_ROWS:
        joined = sized.join(F.broadcast(rates), F.col(source).eqNullSafe(F.col(key)))
    else:
        salted = rates.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = sized.withColumn(mine, F.pmod(F.xxhash64(F.col(doc_id)), F.lit(SALTS)).cast("int"))
        joined = dealt.join(salted, F.col(source).eqNullSafe(F.col(key)) & (F.col(mine) == F.col(salt))).drop(mine, salt)
    base = F.floor(n_rate)
    copies = base + F.when(uniform(F.col(doc_id), seed) < F.col(n_rate) - base, 1).otherwise(0)
    return joined.drop(key).withColumn(n_copies, copies.cast("long"))


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: each document once a copy, with mix_copy from 1."""
    mixed = mix(docs, **options)
    copies = F.col(mixed.columns[-1])
    return mixed.where(copies > 0).select(*[F.col(c) for c in docs.columns], F.explode(F.sequence(F.lit(1), copies.cast("int"))).alias(fresh_name(docs, "mix_copy")))


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    m = mix(docs)
    return m.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


SQL = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
r as (select *, row_number() over (order by source asc nulls last) as k, (sum(source_size) over ())::bigint as total from s),
w as (select *, [3, 1, 2][((k - 1) % 3 + 1)::int]::bigint as w from r),
o as (select *, row_number() over (order by (source_size * 6)::double / w, k) as n from w),
l as (select *, (3 * total - 4 * coalesce(sum(source_size) over (order by n rows between unbounded preceding and 1 preceding), 0))::bigint as rest,
      (sum(w) over (order by n rows between current row and unbounded following))::bigint as w_left from o),
c as (select *, 4 * source_size * w_left <= rest * w as capped from l),
f as (select min(n) as n from c where not capped),
t as (select c.source, c.source_size, case when c.capped then (2 * c.source_size)::double else (c.w * x.rest)::double / (2 * x.w_left)::double end as target,
      case when c.source_size = 0 then 0.0::double when c.capped then 2.0::double
           else least((c.w * x.rest)::double / (2 * x.w_left)::double / c.source_size::double, 2.0::double) end as rate
      from c left join (select c.rest, c.w_left from c join f on c.n = f.n) x on true),
u as (select d.doc_id, d.size, t.source_size, t.target, t.rate,
      ('0x' || substr(md5('17:' || coalesce(d.doc_id::varchar, '')), 1, 13))::bigint::double / 4503599627370496.0::double as u
      from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, (size * (floor(rate) + case when u < rate - floor(rate) then 1 else 0 end))::bigint as taken from u
"""
