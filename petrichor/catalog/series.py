"""Keyed series on ``lineitem``: cube = supplier, time = ship date, value = price; acceptance rules and global
limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from petrichor.catalog import query, rnd, rounded
from petrichor.operators import climate, quality
from petrichor.plans import views as V

END = "DATE '1998-07-04'"
LI = "li AS (SELECT l_suppkey AS cube, CAST(l_shipdate AS DATE) AS t, l_extendedprice AS v, CASE WHEN l_discount < 0.05 THEN 1 ELSE 0 END AS mask, l_returnflag AS f FROM lineitem)"


def _series(spark, sf):
    li = V.table(spark, sf, "lineitem", "l_suppkey", "l_shipdate", "l_extendedprice", "l_discount", "l_returnflag")
    return li.select(F.col("l_suppkey").alias("cube"), F.to_date("l_shipdate").alias("t"), F.col("l_extendedprice").alias("v"), (F.col("l_discount") < 0.05).cast("int").alias("mask"), F.col("l_returnflag").alias("f"))


def _long(spark, sf):
    """Three variables with the naming of the climate table."""
    names = F.when(F.col("f") == "A", "t2m").when(F.col("f") == "N", "t2mmax").otherwise("tp_dailymax")
    return _series(spark, sf).select("cube", "t", names.alias("var"), F.col("v").alias("value"))


_VAR = "CASE f WHEN 'A' THEN 't2m' WHEN 'N' THEN 't2mmax' ELSE 'tp_dailymax' END"
_LIMITS = f"lim AS (SELECT {_VAR} AS var, quantile_cont(v, 0.0001) AS p_low, quantile_cont(v, 0.9999) AS p_high FROM li GROUP BY 1)"


@query("global_climate_percentiles", f"WITH {LI}, {_LIMITS} SELECT var, {rnd('p_low', digits=4)}, {rnd('p_high', digits=4)} FROM lim")
def _(spark, sf):
    return rounded(climate.global_percentiles(_long(spark, sf)), "p_low", "p_high", digits=4)


@query("precipitation_units", f"WITH {LI} SELECT cube, {_VAR} AS var, count(*) AS n, {rnd('sum(CASE WHEN f IN (' + chr(39) + 'A' + chr(39) + ',' + chr(39) + 'N' + chr(39) + ') THEN v ELSE v * 1000 END)', 'total', 2)} FROM li GROUP BY 1, 2")
def _(spark, sf):
    df = climate.scale_precipitation(_long(spark, sf))
    return rounded(df.groupBy("cube", "var").agg(F.count("value").alias("n"), F.sum("value").alias("total")), "total", digits=2)


_BINS = f"bn AS (SELECT cube, {_VAR} || '_mean' AS var, t, avg(v) AS v FROM li GROUP BY ALL)"


@query(
    "robust_climate_scaling",
    f"WITH {LI}, {_LIMITS}, {_BINS} SELECT cube, bn.var, t, {rnd('greatest(-5, least(5, (v - p_low)/(p_high - p_low)))', 'scaled')} FROM bn JOIN lim ON bn.var = lim.var || '_mean'",
)
def _(spark, sf):
    long = _long(spark, sf)
    daily = long.groupBy("cube", F.concat("var", F.lit("_mean")).alias("var"), "t").agg(F.avg("value").alias("value"))
    return rounded(climate.robust_scale(daily, climate.global_percentiles(long)).drop("value"), "scaled")


@query("empty_series_report", f"WITH {LI} SELECT cube, CASE WHEN count(CASE WHEN v > 104000 THEN v END) = 0 THEN 1 ELSE 0 END AS v_all_null FROM li GROUP BY 1")
def _(spark, sf):
    df = _series(spark, sf).withColumn("v", F.when(F.col("v") > 104000, F.col("v")))
    return climate.empty_series(df, cube=["cube"], values=["v"])


@query(
    "accept_raw_cubes",
    f"""WITH {LI}, s AS (SELECT cube, t, avg(mask) AS share FROM li GROUP BY 1, 2), c AS (SELECT cube, count(*) FILTER (share > 0.2 AND t <= {END}) AS n_context, count(*) FILTER (share > 0.2 AND t BETWEEN {END} + 1 AND {END} + 10) AS n_target FROM s GROUP BY 1),
 r AS (SELECT *, CASE WHEN n_context < 75 THEN 'Too few ctx observations (' || n_context || ')' WHEN n_target = 0 THEN 'No valid target observations' ELSE 'ok' END AS reason FROM c) SELECT *, CASE WHEN reason = 'ok' THEN 1 ELSE 0 END AS accepted FROM r""",
)
def _(spark, sf):
    return quality.accept_raw_cubes(_series(spark, sf), cube=["cube"], time="t", mask="mask", event_end=F.lit("1998-07-04").cast("date"), min_context=75, target_days=10)


@query(
    "accept_processed_cubes",
    f"""WITH {LI}, s AS (SELECT cube, t, count(*) FILTER (mask > 0) AS ok, count(*) AS n FROM li GROUP BY 1, 2), w AS (SELECT *, t <= {END} AS ctx, row_number() OVER (PARTITION BY cube, t <= {END} ORDER BY t DESC) AS back, row_number() OVER (PARTITION BY cube, t <= {END} ORDER BY t) AS ahead FROM s),
 g AS (SELECT *, ctx AND back <= 12 AS c, NOT ctx AND ahead <= 4 AS g FROM w),
 a AS (SELECT cube, max(CASE WHEN t = {END} THEN 1 ELSE 0 END) AS has_end, count(*) FILTER (c) AS n_context, sum(ok) FILTER (c) / sum(n) FILTER (c) AS cv, count(*) FILTER (c AND ok/n::DOUBLE >= 0.5) AS n_good_context, count(*) FILTER (g) AS n_target, count(*) FILTER (g AND ok/n::DOUBLE >= 0.5) AS n_good_target FROM g GROUP BY 1)
 SELECT cube, has_end, n_context, {rnd('cv', 'context_valid')}, n_good_context, n_target, n_good_target, CASE WHEN has_end = 0 THEN 'cutoff_date_missing' WHEN n_context < 12 THEN 'Too few ctx timesteps available (' || n_context || ')' WHEN cv < 0.3 THEN format('Too few valid pixels overall in context ({{:.2f}}%)', cv * 100) WHEN n_good_context < 6 THEN 'Too few good ctx steps available (' || n_good_context || ')' WHEN n_target = 0 THEN 'No target timesteps' WHEN n_good_target < 2 THEN 'Too few valid target steps available (' || n_good_target || ')' ELSE 'ok' END AS reason FROM a""",
)
def _(spark, sf):
    out = quality.accept_processed_cubes(
        _series(spark, sf), cube=["cube"], time="t", mask="mask", event_end=F.lit("1998-07-04").cast("date"), n_context=12, n_target=4, context_ratio=0.5, context_fraction=0.5, context_overall=0.3, target_ratio=0.5, min_target_steps=2
    )
    return rounded(out, "context_valid")
