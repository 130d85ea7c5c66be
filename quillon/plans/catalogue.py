"""All queries of the engine, and for those that SQL can express, the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import kernels
from quillon.functions import scalar as S
from quillon.operators import fit as fits
from quillon.operators import initialise, latents, optimise
from quillon.operators import statistics as st
from quillon.operators.bound import Algebra
from quillon.plans import oracle as O
from quillon.plans.model import FitConfig, Params
from quillon.sources import tables
from quillon.streaming import accumulate as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

P = Params(np.array(O.Z), 1.0, np.ones(2), 1.0)


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return add


def lines(spark: SparkSession, d: str, s: float = 0.0) -> DataFrame:
    c = F.col
    return tables.parquet(spark, d, "lineitem").select(
        F.array((c("l_extendedprice") - 53000) / 30000, (c("l_tax") - 0.04) / 0.024).alias("y"), F.array((c("l_quantity") - 25.5) / 14.5, (c("l_discount") - 0.05) / 0.03).alias("mu"),
        F.array(F.lit(s), F.lit(s)).alias("s"), (c("l_suppkey") % 4).alias("shard"),
    )


def customers(spark: SparkSession, d: str) -> DataFrame:
    x = F.array((F.col("c_acctbal") - 4500) / 3000, (F.col("c_nationkey") - 12) / 7)
    return tables.parquet(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), x.alias("y"), x.alias("mu"), F.array(F.lit(0.5), F.lit(0.5)).alias("s"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return tables.parquet(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), S.doubles(F.col("embedding")).alias("y"), F.col("label").alias("shard"))


def cell(frame: DataFrame, stat: str, digits: int = 4) -> DataFrame:
    return frame.where(F.col("stat") == stat).select("i", "j", "k", F.round("v", digits).alias("v"))


# --- scans, shards and preparation


@query("select count(*) as n from embeddings")
def n_rows(spark, d):
    return vectors(spark, d).agg(F.count("*").alias("n"))


@query("select label as shard, count(*) as n from embeddings group by 1")
def shard_counts(spark, d):
    return vectors(spark, d).groupBy("shard").agg(F.count("*").alias("n"))


@query("select shard, n, cast(coalesce(sum(n) over (order by shard rows between unbounded preceding and 1 preceding), 0) as bigint) as start from (select label as shard, count(*) as n from embeddings group by 1)")
def shard_offsets(spark, d):
    counts = shard_counts(spark, d)  # a row a shard
    return counts.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))


@query("select cast(o_orderkey % 8 as int) as shard, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by 1")
def split_balanced(spark, d):
    shards = tables.split_balanced(tables.parquet(spark, d, "orders"), "o_orderkey", 8)
    return shards.groupBy("shard").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def _scrambled(key: str, seed: int) -> str:
    x = f"(({key} + {seed}) % 2147483646 + 1)"
    for _ in range(3):
        x = f"({x} * 48271 % 2147483647)"
    return x


@query(f"select o_orderkey, cast({_scrambled('o_orderkey', 7)} % 8 as int) as shard from orders")
def split_random(spark, d):
    return tables.split_random(tables.parquet(spark, d, "orders").select("o_orderkey"), "o_orderkey", 8, 7)


@query(f"select vec_id as row_id, cast(i - 1 as int) as i, cast(embedding[i] as double) as v, cast({_scrambled('vec_id', 3)} % 4 as int) as shard from embeddings, (select unnest([1, 2]) as i)")
def split_latents(spark, d):
    rows = vectors(spark, d)
    latents_ = rows.select("row_id", F.slice("y", 1, 2).alias("mu"))
    return tables.split_latents(latents_, tables.split_random(rows.drop("shard"), "row_id", 4, 3)).select("row_id", F.posexplode("mu").alias("i", "v"), "shard")


@query(f"select vec_id as row_id from embeddings order by {_scrambled('vec_id', 5)}, vec_id limit 10")
def random_rows(spark, d):
    return initialise.random_rows(vectors(spark, d), 10, 5).select("row_id")


@query("select vec_id as row_id, label as shard from embeddings")
def shard_union(spark, d):
    rows = vectors(spark, d).select("row_id", "shard")
    return tables.union([rows.where("shard % 2 = 0"), rows.where("shard % 2 = 1")])


@query("select doc_id, cast(len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '')) as bigint) as n from documents where len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '')) > 0")
def nonblank_lines(spark, d):
    lines_ = tables.parquet(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("value"))
    return tables.nonblank_lines(lines_, ["doc_id"])


@query()
def synthetic_rows(spark, d):
    return tables.generate(spark, 1000).select("row_id", F.posexplode("y").alias("i", "v"))


@query("select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as hour, count(*) as n, round(sum(value), 2) as total, round(sum(value * value), 4) as squares from events group by 1")
def windowed_events(spark, d):
    """The streaming operator on a finished table."""
    sums = stream.windowed(tables.parquet(spark, d, "events"), "ts", "value", "1 hour", "1 day")
    return sums.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "n", F.round("total", 2).alias("total"), F.round("squares", 4).alias("squares"))


# --- scalar functions

_E = "from events"
_LOW = "least(value / 20, 30.0)"


@query(f"select event_id, round(ln(1 + exp({_LOW})), 8) as v {_E}")
def softplus(spark, d):
    return tables.parquet(spark, d, "events").select("event_id", F.round(S.softplus(F.least(F.col("value") / 20, F.lit(30.0))), 8).alias("v"))


@query(f"select event_id, round(ln(exp({_LOW}) - 1), 6) as v {_E}")
def softplus_inv(spark, d):
    """Not strict: larger tables have events of value 0. Plain, and rounded in doubles: the SQL's arithmetic also for values near 0 and for results that round to it."""
    v = S.softplus_inverse(F.least(F.col("value") / 20, F.lit(30.0)), strict=False, plain=True)
    return tables.parquet(spark, d, "events").select("event_id", S.rounded(v, 6).alias("v"))


@query(f"select event_id, round(1 / (1 + exp(-({_LOW} - 10))), 8) as v {_E}")
def softplus_grad(spark, d):
    return tables.parquet(spark, d, "events").select("event_id", F.round(S.softplus_gradient(F.least(F.col("value") / 20, F.lit(30.0)) - 10), 8).alias("v"))


@query(f"select event_id, round(case when value - 200 >= 36.04365338911715 then value - 200 when value - 200 <= -36.04365338911715 then exp(value - 200) else ln(1 + exp(value - 200)) end, 8) as v {_E}")
def softplus_clamped(spark, d):
    return tables.parquet(spark, d, "events").select("event_id", F.round(S.softplus(F.col("value") - 200, strict=False), 8).alias("v"))


@query(f"select event_id, least(greatest(value / 100, 0.001), 1.0) as v {_E}")
def clip_variance(spark, d):
    return tables.parquet(spark, d, "events").select("event_id", S.clip(F.col("value") / 100, 0.001, 1.0).alias("v"))


_V = "list_transform(embedding, lambda x: cast(x as double))"


@query(f"select vec_id as row_id, round(list_sum(list_transform({_V}, lambda x: x * x)), 8) as v from embeddings")
def row_sqnorm(spark, d):
    return vectors(spark, d).select("row_id", F.round(S.dot(F.col("y"), F.col("y")), 8).alias("v"))


@query(f"select round(sum(list_sum(list_transform({_V}, lambda x: x * x))), 6) as v from embeddings")
def sum_yyt(spark, d):
    return vectors(spark, d).agg(F.round(F.sum(S.dot(F.col("y"), F.col("y"))), 6).alias("v"))


@query("with m as (select i, avg(cast(embedding[i + 1] as double)) as mean from embeddings, (select unnest(generate_series(0, 63)) as i) group by i) select vec_id as row_id, cast(i as int) as i, round(cast(embedding[i + 1] as double) - mean, 8) as v from embeddings, m")
def centre_rows(spark, d):
    rows = vectors(spark, d)
    means = rows.agg(F.array(*(F.avg(F.get("y", F.lit(i))) for i in range(64))).alias("mean"))
    return rows.crossJoin(F.broadcast(means)).select("row_id", F.posexplode(S.centred(F.col("y"), F.col("mean"))).alias("i", "v")).withColumn("v", F.round("v", 8))


@query("select vec_id as row_id, [cast(embedding[1] as double), cast(embedding[8] as double), cast(embedding[4] as double)] as v from embeddings")
def masked_columns(spark, d):
    return vectors(spark, d).select("row_id", S.masked(F.col("y"), [0, 7, 3]).alias("v"))


# --- moments

_UNITS = "(select vec_id, unnest(generate_series(0, 63)) as i, unnest(embedding) as x from embeddings)"


@query(f"select cast(i as int) as i, round(avg(cast(x as double)), 8) as mean, round(stddev_pop(cast(x as double)), 8) as deviation from {_UNITS} group by i")
def col_moments(spark, d):
    cells = vectors(spark, d).select(F.posexplode("y").alias("i", "x"))
    return cells.groupBy("i").agg(F.round(F.avg("x"), 8).alias("mean"), F.round(F.stddev_pop("x"), 8).alias("deviation"))


@query("select i, j, round(covar_pop(cast(embedding[i + 1] as double), cast(embedding[j + 1] as double)), 8) as v from embeddings, (select cast(a as int) as i, cast(b as int) as j from (select unnest(generate_series(0, 63)) as a), (select unnest(generate_series(0, 63)) as b)) group by i, j")
def cov_matrix(spark, d):
    return _matrix(spark, initialise.moments(vectors(spark, d), 64)[2], 8)


# --- kernels


@query("select a.i, b.i as j, round(exp(-0.5 * ((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))), 10) as v from (values (0, -0.5, -0.5), (1, 0.5, 0.5)) a(i, x, y), (values (0, -0.5, -0.5), (1, 0.5, 0.5)) b(i, x, y)")
def kmm(spark, d):
    z = spark.createDataFrame([(m, *map(float, r)) for m, r in enumerate(P.z)], "i int, a double, b double")
    other = F.broadcast(z.select(F.col("i").alias("j"), F.col("a").alias("c"), F.col("b").alias("e")))
    return z.crossJoin(other).select("i", "j", F.round(kernels.ard([F.col("a"), F.col("b")], [F.col("c"), F.col("e")], P), 10).alias("v"))


@query("select p_partkey as row_id, m, round(exp(-0.5 * (pow(p_size / 25.0 - 1 - z, 2) + pow((p_retailprice - 1400) / 300 - z, 2))), 8) as v from part, (values (0, -0.5), (1, 0.5)) t(m, z)")
def k_cross(spark, d):
    x = [F.col("p_size") / 25.0 - 1, (F.col("p_retailprice") - 1400) / 300]
    cells = [F.struct(F.lit(m).alias("m"), F.round(kernels.ard(x, list(map(float, z)), P), 8).alias("v")) for m, z in enumerate(P.z)]
    return tables.parquet(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.explode(F.array(*cells)).alias("c")).select("row_id", "c.*")


# --- statistics

HALF = O.LINES.format(s="0.5")


@query("select cast(count(*) as double) as v from lineitem")
def psi0(spark, d):
    return lines(spark, d).agg((F.count("*") * P.sf2).alias("v"))


@query(f"with {O.CUSTOMERS} select row_id, round({O.one(0)}, 8) as m0, round({O.one(1)}, 8) as m1 from L")
def psi1_rows(spark, d):
    x, s = ([F.get(c, F.lit(q)) for q in range(2)] for c in ("mu", "s"))
    return customers(spark, d).select("row_id", *(F.round(kernels.psi1(m, x, s, P), 8).alias(f"m{m}") for m in range(2)))


def _statistic(name: str, stat: str, sql: str, **kind) -> None:
    def run(spark, d):
        return cell(st.long_form(lines(spark, d, 0.5), P, 2, **kind), stat)

    run.__name__ = name
    query(sql)(run)


_statistic("psi2_sum", "psi2", O.cells("psi2", O.two, O.PAIR, HALF))
_statistic("psi1y_sum", "psi1y", O.cells("psi1y", lambda m, i: f"{O.one(m)} * y{i}", O.PAIR, HALF))
_statistic("kl_sum", "kl", O.cells("kl", lambda: O.KL, [()], HALF), kl=True)
_statistic("d_psi1y_dz", "psi1y_dz", O.cells("", O.by_z1, O.TRIPLE, HALF), gradients=True)
_statistic("d_psi2_dz", "psi2_dz", O.cells("", O.by_z2, O.TRIPLE, HALF), gradients=True)
_statistic("d_psi1y_dalpha", "psi1y_dalpha", O.cells("", O.by_a1, O.TRIPLE, HALF), gradients=True)
_statistic("d_psi2_dalpha", "psi2_dalpha", O.cells("", O.by_a2, O.TRIPLE, HALF), gradients=True)


@query(f"with {HALF} select 'psi0' as stat, 0 as i, 0 as j, round(cast(count(*) as double), 4) as v from L" + "".join(f" union all select 'psi1y', {m}, {i}, round(sum({O.one(m)} * y{i}), 4) from L union all select 'psi2', {m}, {i}, round(2 * sum({O.two(m, i)}), 4) from L" for m, i in O.PAIR))
def d_sf2(spark, d):
    """By sf2: the statistics themselves, scaled; nothing is summed anew."""
    own = st.long_form(lines(spark, d, 0.5), P, 2)
    times = F.when(F.col("stat") == "psi2", 2 / P.sf2).otherwise(1 / P.sf2)
    out = own.where("stat in ('n', 'psi1y', 'psi2')").select(F.when(F.col("stat") == "n", "psi0").otherwise(F.col("stat")).alias("stat"), "i", "j", F.round(F.col("v") * F.when(F.col("stat") == "n", F.lit(1.0)).otherwise(times), 4).alias("v"))
    return out


_BY_SHARD = f"with {HALF} " + " union all ".join([f"select shard, 'n' as stat, 0 as i, 0 as j, cast(count(*) as double) as v from L group by shard", "select shard, 'yy', 0, 0, round(sum(y0 * y0 + y1 * y1), 4) from L group by shard", *(f"select shard, '{s}', {m}, {k}, round(sum({e}), 4) from L group by shard" for m, k in O.PAIR for s, e in (("psi2", O.two(m, k)), ("psi1y", f"{O.one(m)} * y{k}")))])


@query(_BY_SHARD)
def stats_by_shard(spark, d):
    return st.long_form(lines(spark, d, 0.5), P, 2, by=["shard"]).select("shard", "stat", "i", "j", F.round("v", 4).alias("v"))


def _merged(where: str, share: str) -> str:
    return f"with {HALF} " + " union all ".join([f"select 'n' as stat, 0 as i, 0 as j, cast(count(*) as double){share} as v from L {where}", f"select 'yy', 0, 0, round(sum(y0 * y0 + y1 * y1){share}, 4) from L {where}", *(f"select '{s}', {m}, {k}, round(sum({e}){share}, 4) from L {where}" for m, k in O.PAIR for s, e in (("psi2", O.two(m, k)), ("psi1y", f"{O.one(m)} * y{k}")))])


@query(_merged("", ""))
def stats_merged(spark, d):
    return st.merge(st.long_form(lines(spark, d, 0.5), P, 2, by=["shard"])).select("stat", "i", "j", F.round("v", 4).alias("v"))


_KEPT = fits.keep_shards([0, 1, 2, 3], 0.5, 3)


@query(_merged(f"where shard in ({', '.join(map(str, _KEPT))})", f" / {len(_KEPT) / 4}"))
def stats_dropout(spark, d):
    rows, share = fits.dropped(lines(spark, d, 0.5), [0, 1, 2, 3], 0.5, 3)
    return st.merge(st.long_form(rows, P, 2, by=["shard"]), share).select("stat", "i", "j", F.round("v", 4).alias("v"))


# --- bound and gradients


def _algebra(spark, d, s: float = 0.0, gradients: bool = False) -> Algebra:
    return Algebra.of(P, st.from_long(st.long_form(lines(spark, d, s), P, 2, gradients=gradients, kl=s > 0), P, 2))


def _matrix(spark, a: np.ndarray, digits: int) -> DataFrame:
    return spark.createDataFrame([(i, j, float(a[i, j])) for i, j in np.ndindex(*a.shape)], "i int, j int, v double").withColumn("v", F.round("v", digits))


def _vector(spark, v, digits: int) -> DataFrame:
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(np.ravel(v))], "i int, v double").withColumn("v", F.round("v", digits))


@query(O.algebra(O.LINES.format(s="0.0"), False) + "select round(f, 4) as f from d")
def bound_f(spark, d):
    return spark.createDataFrame([(_algebra(spark, d).bound(),)], "f double").select(F.round("f", 4).alias("f"))


@query(O.algebra(HALF, False) + "select round(f, 4) as f from d")
def bound_f_latent(spark, d):
    return spark.createDataFrame([(_algebra(spark, d, 0.5).bound(),)], "f double").select(F.round("f", 4).alias("f"))


@query(O.algebra(O.LINES.format(s="0.0"), False) + "select round(f, 4) as f from d")
def bound_f_blocks(spark, d):
    """The same bound from the block form."""
    return spark.createDataFrame([(fits.bound(lines(spark, d), P),)], "f double").select(F.round("f", 4).alias("f"))


@query(O.adjoint("fk", 4))
def df_dkmm(spark, d):
    return _matrix(spark, _algebra(spark, d).by_kmm(), 4)


@query(O.adjoint("e", 6))
def df_dc(spark, d):
    return _matrix(spark, _algebra(spark, d).by_psi1y(), 6)


@query(O.adjoint("fp", 6))
def df_dp(spark, d):
    return _matrix(spark, _algebra(spark, d).by_psi2(), 6)


_FULL = O.algebra(HALF)


@query(_FULL + f"select 0 as i, round({O.GRAD_BETA}, 3) as v from d")
def grad_beta(spark, d):
    return _vector(spark, [_algebra(spark, d, 0.5, True).grad_beta()], 3)


@query(_FULL + f"select 0 as i, round({O.GRAD_SF2}, 3) as v from d")
def grad_sf2(spark, d):
    return _vector(spark, [_algebra(spark, d, 0.5, True).grad_sf2()], 3)


@query(_FULL + " union all ".join(f"select {q} as i, round({O.grad_alpha(q)}, 3) as v from d" for q in (0, 1)))
def grad_alpha(spark, d):
    return _vector(spark, _algebra(spark, d, 0.5, True).grad_alpha(), 3)


@query(_FULL + " union all ".join(f"select {m} as i, {q} as j, round({O.grad_z(m, q)}, 3) as v from d" for m, q in O.PAIR))
def grad_z(spark, d):
    return _matrix(spark, _algebra(spark, d, 0.5, True).grad_z(), 3)


def _row_gradients(spark, d):
    rows = customers(spark, d)
    return latents.gradients(rows, Algebra.of(P, st.accumulate(rows, P, 2, False, True)))


def _row_sql(which: str) -> str:
    return O.algebra(O.CUSTOMERS, False) + f"select row_id, {', '.join(f'round({O.row_gradient(which, q)}, 5) as g{q}' for q in (0, 1))} from (select row_id, x0, x1, y0, y1, s from L) cross join d"


@query(_row_sql("mu"))
def grad_mu(spark, d):
    return _row_gradients(spark, d).select("row_id", *(F.round(F.get("grad_mu", F.lit(q)), 5).alias(f"g{q}") for q in (0, 1)))


@query(_row_sql("s"))
def grad_s(spark, d):
    return _row_gradients(spark, d).select("row_id", *(F.round(F.get("grad_s", F.lit(q)), 5).alias(f"g{q}") for q in (0, 1)))


# --- block form with ten inducing points and seven outputs

TEN = Params(np.array([[np.sin(1.7 * m + 1), np.cos(2.3 * m)] for m in range(10)]), 1.3, np.array([0.8, 1.4]), 2.0)
_SEVEN = """L as (select vec_id as row_id, list_transform(embedding[1:7], lambda x: 4 * cast(x as double)) as y, 6 * cast(embedding[20] as double) as x0, 6 * cast(embedding[30] as double) as x1, 0.3 as s from embeddings),
z as (select cast(m as int) as m, sin(1.7 * m + 1) as z0, cos(2.3 * m) as z1 from (select unnest(generate_series(0, 9)) as m)),
one as (select row_id, m, y, x0, x1, s, z0, z1, 0.8 * s + 1 as e0, 1.4 * s + 1 as e1,
  1.3 * exp(-0.5 * (0.8 * (z0 - x0) * (z0 - x0) / (0.8 * s + 1) + 1.4 * (z1 - x1) * (z1 - x1) / (1.4 * s + 1))) / sqrt((0.8 * s + 1) * (1.4 * s + 1)) as k from L, z),
two as (select row_id, a.m as i, b.m as j, x0, x1, s, a.z0 - b.z0 as d0, a.z1 - b.z1 as d1, 1.6 * s + 1 as e0, 2.8 * s + 1 as e1, (2 * x0 - a.z0 - b.z0) / (1.6 * s + 1) as c0, (2 * x1 - a.z1 - b.z1) / (2.8 * s + 1) as c1,
  1.69 * exp(-0.25 * (0.8 * (a.z0 - b.z0) * (a.z0 - b.z0) + 1.4 * (a.z1 - b.z1) * (a.z1 - b.z1)) - 0.8 * pow(x0 - (a.z0 + b.z0) / 2, 2) / (1.6 * s + 1) - 1.4 * pow(x1 - (a.z1 + b.z1) / 2, 2) / (2.8 * s + 1)) / sqrt((1.6 * s + 1) * (2.8 * s + 1)) as k
  from L, z a, z b)"""


def seven(spark, d):
    y = F.col("y")
    return vectors(spark, d).select("row_id", F.transform(F.slice(y, 1, 7), lambda v: 4 * v).alias("y"), F.array(6 * y[19], 6 * y[29]).alias("mu"), F.array(F.lit(0.3), F.lit(0.3)).alias("s"))


def _blocks(name: str, stat: str, sql: str) -> None:
    def run(spark, d):
        v = np.asarray(getattr(st.accumulate(seven(spark, d), TEN, 7, True, True), stat), float)
        cells = [(*ix, *[0] * (3 - len(ix)), float(v[ix])) for ix in np.ndindex(*v.shape)]
        return spark.createDataFrame(cells, "i int, j int, k int, v double").withColumn("v", F.round("v", 6))

    run.__name__ = name
    query(f"with {_SEVEN} {sql}")(run)


_Y = "from one, (select cast(unnest(generate_series(0, 6)) as int) as d)"
_blocks("blocks_psi2", "psi2", "select i, j, 0 as k, round(sum(k), 6) as v from two group by i, j")
_blocks("blocks_psi1y", "psi1y", f"select m as i, d as j, 0 as k, round(sum(k * y[d + 1]), 6) as v {_Y} group by m, d")
_blocks("blocks_kl", "kl", "select 0 as i, 0 as j, 0 as k, round(sum(0.5 * (2 * (s - ln(s)) + x0 * x0 + x1 * x1 - 2)), 6) as v from L")
_blocks("blocks_psi1y_dz", "psi1y_dz", " union all ".join(f"select m as i, {q} as j, d as k, round(sum(k * {a} * (x{q} - z{q}) / e{q} * y[d + 1]), 6) as v {_Y} group by m, d" for q, a in enumerate(TEN.alpha.tolist())))
_blocks("blocks_psi2_dz", "psi2_dz", " union all ".join(f"select i, {q} as j, j as k, round(sum(k * 0.5 * {a} * (c{q} - d{q})), 6) as v from two group by i, j" for q, a in enumerate(TEN.alpha.tolist())))
_blocks("blocks_psi1y_dalpha", "psi1y_dalpha", " union all ".join(f"select {q} as i, m as j, d as k, round(sum(-0.5 * k * (pow((x{q} - z{q}) / e{q}, 2) + s / e{q}) * y[d + 1]), 6) as v {_Y} group by m, d" for q in (0, 1)))
_blocks("blocks_psi2_dalpha", "psi2_dalpha", " union all ".join(f"select {q} as i, i as j, j as k, round(sum(k * (-0.25 * d{q} * d{q} - 0.25 * c{q} * c{q} - s / e{q})), 6) as v from two group by i, j" for q in (0, 1)))


# --- optimiser state: quarters of the vectors stand for gradients and direction


def _state(spark, d):
    part = lambda k: F.slice("y", 16 * k + 1, 16)
    return vectors(spark, d).select("row_id", part(0).alias("g_new"), part(1).alias("g_old"), part(2).alias("g_latest"), part(3).alias("d"))


_G = {"g_new": 0, "g_old": 16, "g_latest": 32, "d": 48}
_AT = lambda c: f"cast(embedding[{_G[c]} + i] as double)"
_IN = "from embeddings, (select unnest(generate_series(1, 16)) as i)"


@query(f"select round(sum({_AT('g_new')} * {_AT('d')}), 6) as mu, round(sum({_AT('d')} * {_AT('d')}), 6) as kappa, round(sum({_AT('d')} * ({_AT('g_latest')} - {_AT('g_new')})), 6) as theta, round(sum({_AT('g_new')} * {_AT('g_new')}), 6) as current, round(sum({_AT('g_new')} * {_AT('g_old')}), 6) as gamma, round(max(abs({_AT('d')})), 6) as max_d {_IN}")
def scg_dots(spark, d):
    out = optimise.scg_products(_state(spark, d))
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query(f"select round(sum(abs({_AT('g_new')})), 6) as total, round(max(abs({_AT('g_new')})), 6) as largest {_IN}")
def gd_norms(spark, d):
    return _state(spark, d).agg(F.round(F.sum(S.sum_abs(F.col("g_new"))), 6).alias("total"), F.round(F.max(S.max_abs(F.col("g_new"))), 6).alias("largest"))


def _unfold(rows: DataFrame, v) -> DataFrame:
    return rows.select("row_id", F.posexplode(v).alias("i", "v")).withColumn("v", F.round("v", 8))


@query(f"select vec_id as row_id, cast(i - 1 as int) as i, round({_AT('g_new')} + 0.25 * {_AT('d')}, 8) as v {_IN}")
def trial_point(spark, d):
    return _unfold(_state(spark, d), S.axpy(F.col("g_new"), 0.25, F.col("d")))


@query(f"select vec_id as row_id, cast(i - 1 as int) as i, round(0.3 * {_AT('d')} - {_AT('g_new')}, 8) as v {_IN}")
def direction_update(spark, d):
    return _unfold(_state(spark, d), F.zip_with("d", "g_new", lambda a, b: a * 0.3 - b))


@query(f"select vec_id as row_id, cast(i - 1 as int) as i, round(-({_AT('g_latest')} + 0.5 * {_AT('d')}), 8) as v {_IN}")
def direction_update_gd(spark, d):
    return _unfold(_state(spark, d), F.zip_with("g_latest", "d", lambda a, b: -(a + 0.5 * b)))


@query(f"select vec_id as row_id, cast(i - 1 as int) as i, round({_AT('g_new')} + 0.1 * {_AT('d')}, 8) as v {_IN}")
def state_update(spark, d):
    """Through the state's own table, as an accepted step does it."""
    state = optimise.Latents(tables.written(_state(spark, d).withColumn("x", F.col("g_new"))))
    state.put(x=S.axpy(F.col("x"), 0.1, F.col("d")), g_old=F.col("g_new"), g_new=F.col("g_latest"))
    return _unfold(state.table, F.col("x"))


# --- initialisers and prediction


def _near_sql(dims: str) -> str:
    return f"""select test_id, row_id, round(distance, 6) as distance from (select a.vec_id as test_id, b.vec_id as row_id, sqrt(list_sum(list_transform({dims}, lambda i: pow(cast(a.embedding[i] as double) - cast(b.embedding[i] as double), 2)))) as distance
  from embeddings a, embeddings b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id) where distance < 6 qualify row_number() over (partition by test_id order by distance, row_id) = 1"""


def _near(spark, d, mask=None):
    rows = vectors(spark, d)
    test = rows.where("row_id % 100 = 0").select(F.col("row_id").alias("test_id"), "y")
    return initialise.nearest(test, rows, 6.0, mask, others=True).withColumn("distance", F.round("distance", 6))


@query(_near_sql("generate_series(1, 64)"))
def nn_init(spark, d):
    return _near(spark, d)


@query(_near_sql("[1, 4, 8, 20]"))
def nn_init_masked(spark, d):
    return _near(spark, d, [0, 3, 7, 19])


@query(f"select cast(i as int) as q, round(1 / var_pop(cast(x as double)), 4) as alpha from {_UNITS} group by i order by 1 / var_pop(cast(x as double)) desc limit 2")
def ard_top2(spark, d):
    cells = vectors(spark, d).select(F.posexplode("y").alias("q", "x"))
    return cells.groupBy("q").agg((1 / F.var_pop("x")).alias("alpha")).orderBy(F.desc("alpha")).limit(2).select("q", F.round("alpha", 4).alias("alpha"))


@query("select vec_id as row_id from embeddings order by vec_id limit 10")
def inducing_prefix(spark, d):
    return initialise.inducing_prefix(vectors(spark, d).withColumn("mu", F.col("y")), 10).select("row_id")


@query(f"with {HALF}, c as (select var_pop(y0) as a, covar_pop(y0, y1) as b, var_pop(y1) as c from L) select round((a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b), 8) as first, round((a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b), 8) as second from c")
def pca_2d(spark, d):
    _, _, cov = initialise.moments(lines(spark, d), 2)
    low, high = np.linalg.eigvalsh(cov)
    return spark.createDataFrame([(float(high), float(low))], "first double, second double").select(F.round("first", 8).alias("first"), F.round("second", 8).alias("second"))


_SCORES = f"""with {O.CUSTOMERS}, c as (select avg(y0) as m0, avg(y1) as m1, var_pop(y0) as a, covar_pop(y0, y1) as b, var_pop(y1) as c from L),
e as (select *, (a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b) as top from c),
w as (select *, sqrt(b * b + (top - a) * (top - a)) as n, case when abs(b) >= abs(top - a) then sign(b) else sign(top - a) end as g from e)
select row_id, round(g * (b * (y0 - m0) + (top - a) * (y1 - m1)) / n / sqrt(top), 6) as v from L, w"""


@query(_SCORES)
def pca_scores_2d(spark, d):
    """Whitened scores on the leading axis of two outputs, for which SQL has a closed form."""
    return initialise.pca(customers(spark, d).drop("mu", "s"), 2, 1).select("row_id", F.round(F.get("mu", F.lit(0)), 6).alias("v"))


@query(_SCORES)
def ppca_scores_2d(spark, d):
    """With one latent dimension, probabilistic scores are those of PCA once their deviation is 1."""
    return initialise.ppca(customers(spark, d).drop("mu", "s"), 2, 1).select("row_id", F.round(F.get("mu", F.lit(0)), 6).alias("v"))


@query()
def pca_scores(spark, d):
    return _unfold(initialise.pca(vectors(spark, d), 64, 2), F.col("mu"))


def _dist(of: str) -> str:
    return f"list_sum(list_transform(generate_series(1, 64), lambda i: pow(cast(e.embedding[i] as double) - cast({of}.embedding[i] as double), 2)))"


@query(f"with z as (select row_number() over (order by vec_id) - 1 as c, embedding from embeddings order by vec_id limit 5), near as (select e.vec_id, e.embedding, z.c from embeddings e, z qualify row_number() over (partition by e.vec_id order by round({_dist('z')}, 9), z.c) = 1), m as (select c, i, avg(cast(embedding[i + 1] as double)) as v from near, (select unnest(generate_series(0, 63)) as i) group by c, i) select cast(c as int) as c, cast(i as int) as i, round(v, 8) as v from m")
def kmeans_step(spark, d):
    """One step of Lloyd's from the first five vectors: the centres go with the closure, sums are partial."""
    rows = vectors(spark, d)
    z = [r["y"] for r in rows.orderBy("row_id").limit(5).collect()]
    gap = lambda c: F.zip_with("y", F.array(*map(F.lit, z[c])), lambda a, b: a - b)
    distances = F.array(*(F.round(S.dot(gap(c), gap(c)), 9) for c in range(5)))
    near = (F.array_position(distances, F.array_min(distances)) - 1).cast("int")
    cells = rows.select(near.alias("c"), F.posexplode("y").alias("i", "v"))
    return cells.groupBy("c", "i").agg(F.round(F.avg("v"), 8).alias("v"))


@query()
def kmeans_inducing(spark, d):
    return _matrix(spark, initialise.inducing(initialise.pca(vectors(spark, d), 64, 2), 10), 6)


@query()
def ppca_fit(spark, d):
    return _unfold(initialise.ppca(vectors(spark, d), 64, 2), F.col("mu"))


@query()
def fa_fit(spark, d):
    return _unfold(initialise.fa(vectors(spark, d), 64, 2), F.col("mu"))


def _fitted(spark, d, **kind) -> fits.Fitted:
    return fits.fit(vectors(spark, d).select("row_id", "y"), FitConfig(inducing=5, latent=2, iterations=3, **kind))


@query()
def fit_gd(spark, d):
    return _fitted(spark, d, optimiser="gd").trace.frame(spark)


@query()
def fit_scg(spark, d):
    return _fitted(spark, d).trace.frame(spark)


@query()
def fit_ard_ranking(spark, d):
    return _fitted(spark, d, init="random").ard_ranking(spark)


def _embedded(spark, d, restarts):
    model = _fitted(spark, d)
    test = vectors(spark, d).where("row_id % 100 = 0").select(F.col("row_id").alias("test_id"), "y")
    return fits.embed(model, test, 20, restarts)


@query()
def embed_rows(spark, d):
    return _embedded(spark, d, 0)


@query()
def embed_restarts(spark, d):
    return _embedded(spark, d, 2)
