"""Queries on ``events``: cube = event type, pixel = user, value = event value."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from petrichor.catalog import query, rnd, rounded
from petrichor.catalog.sql import BIN, EV, EV5, EVG, EVM
from petrichor.operators import baselines, climate, masks, quality, radar, selection, timegrid
from petrichor.plans import views as V
from petrichor.session import shared_folder, stored
from petrichor.streaming import bins

CUBE, PX = ["cube"], ["px"]
END = "DATE '2024-01-16'"


# ---- masks -----------------------------------------------------------------------------------------
@query("quality_masks", f"WITH {EVM} SELECT id, mask_basic, mask_strict FROM evm")
def _(spark, sf):
    return masks.quality_masks(V.event_obs(spark, sf)).select("id", "mask_basic", "mask_strict")


@query(
    "quality_mask_check",
    f"WITH {EVM}, b AS (SELECT cube, CASE WHEN cube = 'view' AND id % 97 = 0 THEN 2 ELSE mask_basic END AS b, mask_strict AS s FROM evm) SELECT cube, CAST(sum(b) AS BIGINT) AS n_basic, CAST(sum(s) AS BIGINT) AS n_strict, count(*) FILTER (b NOT IN (0, 1) OR s NOT IN (0, 1)) AS n_not_binary, CASE WHEN sum(s) > sum(b) OR count(*) FILTER (b NOT IN (0, 1) OR s NOT IN (0, 1)) > 0 THEN 1 ELSE 0 END AS violated FROM b GROUP BY 1",
)
def _(spark, sf):
    """One cube has wrong mask values."""
    wrong = (F.col("cube") == "view") & (F.col("id") % 97 == 0)
    return masks.quality_mask_check(V.event_masked(spark, sf).withColumn("mask_basic", F.when(wrong, 2).otherwise(F.col("mask_basic"))), CUBE)


@query("apply_strict_mask", f"WITH {EVM} SELECT id, {rnd('CAST(CASE WHEN mask_strict = 1 THEN v END AS FLOAT)', 'v', 3)} FROM evm")
def _(spark, sf):
    return rounded(masks.apply_mask(V.event_masked(spark, sf), ["v"], "mask_strict").select("id", "v"), "v", digits=3)


@query(
    "masking_check",
    f"WITH {EVM}, m AS (SELECT cube, mask_strict, CASE WHEN cube = 'click' AND id % 5 = 0 THEN 1 WHEN mask_strict = 1 THEN v END AS v FROM evm), c AS (SELECT cube, count(*) - count(v) AS n_null, count(*) - count(*) FILTER (mask_strict = 1) AS n_masked FROM m GROUP BY 1) SELECT *, CASE WHEN n_null < n_masked THEN 0 ELSE 1 END AS ok FROM c",
)
def _(spark, sf):
    """One cube has values that should be masked."""
    masked = masks.apply_mask(V.event_masked(spark, sf), ["v"], "mask_strict")
    masked = masked.withColumn("v", F.when((F.col("cube") == "click") & (F.col("id") % 5 == 0), 1.0).otherwise(F.col("v")))
    return masks.masking_check(masked, CUBE, "v", "mask_strict")


@query("coerce_types", f"WITH {EVM} SELECT id, CAST(scl AS SMALLINT) AS scl, CAST(v AS FLOAT) AS v FROM evm")
def _(spark, sf):
    return masks.coerce_types(V.event_obs(spark, sf).select("id", F.col("SCL").alias("scl"), "v"), ["scl"], ["v"])


# ---- 5-day grid ------------------------------------------------------------------------------------
@query("resample_5d_median", f"WITH {EV5} SELECT cube, px, bin, {rnd('v')}, n FROM ev5")
def _(spark, sf):
    return rounded(V.event_bins(spark, sf), "v")


def _replayed(spark, sf):
    """The masked events as files that arrive in six parts, each row up to five days late, so that bins are updated out
    of order."""
    ev = V.event_masked(spark, sf).select("cube", "px", "t", "v", "mask_strict")
    arrival = F.unix_seconds(F.col("t").cast("timestamp")) + F.pmod(F.xxhash64("px", "t"), F.lit(5 * 86_400))
    span = ev.agg(F.min(arrival).alias("a"), F.max(arrival).alias("z"))
    a, z = span.select("a").scalar(), span.select("z").scalar()
    part = F.floor((arrival - a) * 6 / (z - a + 1)).cast("int")
    rows, root = stored(ev.withColumn("part", part), "arrivals", partition_by="part"), shared_folder(spark, "replay")
    for i in range(6):
        rows.filter(F.col("part") == i).drop("part").write.mode("append").parquet(root)
    return spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 3).parquet(root)


def _streamed(spark, binned, keys):
    log = shared_folder(spark, "bin-log")
    bins.start_log(binned, log, f"{log}-state").awaitTermination()
    return bins.newest(spark, log, binned, keys)


@query("streamed_5d_median", f"WITH {EV5} SELECT cube, px, bin, {rnd('v')}, n FROM ev5")
def _(spark, sf):
    """The same bins as ``resample_5d_median``, from the replayed stream."""
    binned = bins.streamed_median(_replayed(spark, sf), cube=["cube"], pixel=["px"], time="t", values=["v"], origin=datetime.date.fromisoformat(V.ORIGIN), mask="mask_strict")
    return rounded(_streamed(spark, binned, ["cube", "px", "bin"]), "v")


@query("streamed_5d_mean_min_max", f"WITH {EV} SELECT cube, {BIN} AS bin, {rnd('avg(v)', 'v_mean', 4)}, {rnd('min(v)', 'v_min', 4)}, {rnd('max(v)', 'v_max', 4)} FROM ev GROUP BY ALL")
def _(spark, sf):
    binned = bins.streamed_stats(_replayed(spark, sf), cube=["cube"], time="t", values=["v"], origin=datetime.date.fromisoformat(V.ORIGIN))
    return rounded(_streamed(spark, binned, ["cube", "bin"]), "v_mean", "v_min", "v_max", digits=4)  # sums in another order


@query("dense_5d_grid", f"WITH {EVG} SELECT cube, px, bin, {rnd('v')}, n FROM evg")
def _(spark, sf):
    return rounded(V.event_grid(spark, sf), "v")


@query("bin_calendar", f"WITH {EV5} SELECT cube, CAST(unnest(generate_series(min(bin), max(bin), INTERVAL 5 DAY)) AS DATE) AS bin FROM ev5 GROUP BY cube")
def _(spark, sf):
    return timegrid.calendar(V.event_bins(spark, sf), CUBE)


_RADAR = f"""rad AS (SELECT px, {BIN} AS bin, median(v) AS r FROM ev WHERE cube = 'view' GROUP BY ALL),
 opt AS (SELECT px, {BIN} AS bin, median(v) AS v FROM ev WHERE cube = 'click' GROUP BY ALL)"""


def _two_sensors(spark, sf):
    """Clicks as optical, views as radar acquisitions of the same pixels."""
    ev = V.event_obs(spark, sf)
    sensor = lambda kind, name: timegrid.resample_median(
        ev.filter(F.col("cube") == kind).withColumnRenamed("v", name), cube=[], pixel=PX, time="t", values=[name], origin=V.origin()
    ).select("px", "bin", name)
    return sensor("click", "v"), sensor("view", "r")


@query("radar_onto_optical_bins", f"WITH {EV}, {_RADAR} SELECT o.px, o.bin, {rnd('o.v', 'v')}, {rnd('r.r', 'r')} FROM opt o LEFT JOIN rad r ON o.px = r.px AND o.bin = r.bin")
def _(spark, sf):
    optical, radar_ = _two_sensors(spark, sf)
    return rounded(timegrid.align_exact(optical, radar_, ["px", "bin"]), "v", "r")


@query(
    "aligned_validity_flags",
    f"WITH {EV}, {_RADAR}, a AS (SELECT o.px, o.bin, o.v, r.r FROM opt o LEFT JOIN rad r ON o.px = r.px AND o.bin = r.bin) SELECT px, bin, CASE WHEN v IS NOT NULL THEN 1 ELSE 0 END AS s2_final_mask, CASE WHEN r IS NOT NULL THEN 1 ELSE 0 END AS s1_final_mask FROM a",
)
def _(spark, sf):
    optical, radar_ = _two_sensors(spark, sf)
    aligned = timegrid.align_exact(optical, radar_, ["px", "bin"])
    return masks.aligned_flags(aligned, "v", ("r",)).select("px", "bin", "s2_final_mask", "s1_final_mask")


@query(
    "merge_static_layers",
    f"WITH {EV5}, st AS (SELECT c_custkey AS px, c_nationkey AS lc FROM customer) SELECT cube, e.px, bin, {rnd('v')}, lc FROM ev5 e LEFT JOIN st USING (px)",
)
def _(spark, sf):
    static = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("px"), F.col("c_nationkey").alias("lc"))
    return rounded(timegrid.merge_static(V.event_bins(spark, sf).drop("n"), static, PX), "v")


@query(
    "final_masks",
    f"WITH {EVG} SELECT cube, px, bin, CASE WHEN v IS NOT NULL THEN 1 ELSE 0 END AS mask_s2, CASE WHEN n IS NOT NULL THEN 1 ELSE 0 END AS mask_s1, CASE WHEN v IS NOT NULL THEN 1 ELSE 0 END AS target_mask FROM evg",
)
def _(spark, sf):
    return masks.final_masks(V.event_grid(spark, sf), "v", ("n",)).drop("v", "n")


@query(
    "final_mask_check",
    f"WITH {EVG}, m AS (SELECT cube, v, n, CASE WHEN cube = 'click' AND px % 10 = 0 OR v IS NOT NULL THEN 1 ELSE 0 END AS m2, CASE WHEN n IS NOT NULL THEN 1 ELSE 0 END AS m1 FROM evg), c AS (SELECT cube, count(*) - count(v) AS s2_nulls, count(*) - CAST(sum(m2) AS BIGINT) AS s2_zeros, count(*) - count(n) AS s1_nulls, count(*) - CAST(sum(m1) AS BIGINT) AS s1_zeros FROM m GROUP BY 1) SELECT *, CASE WHEN s2_nulls <> s2_zeros OR s1_nulls <> s1_zeros THEN 0 ELSE 1 END AS ok FROM c",
)
def _(spark, sf):
    """One cube has mask bits on missing data."""
    ready = masks.final_masks(V.event_grid(spark, sf), "v", ("n",))
    ready = ready.withColumn("mask_s2", F.when((F.col("cube") == "click") & (F.col("px") % 10 == 0), 1).otherwise(F.col("mask_s2")))
    return masks.final_mask_check(ready, CUBE, "v", ("n",))


@query(
    "trim_to_first_valid",
    f"WITH {EV5}, m AS (SELECT cube, px, bin, v, CASE WHEN v > 200 THEN 1 ELSE 0 END AS ok FROM ev5), f AS (SELECT cube, px, min(CASE WHEN ok = 1 THEN bin END) AS first FROM m GROUP BY 1, 2) SELECT m.cube, m.px, m.bin, {rnd('m.v', 'v')} FROM m JOIN f USING (cube, px) WHERE first IS NULL OR bin >= first",
)
def _(spark, sf):
    """Every (type, user) series is its own cube here, so that cubes start at different bins."""
    df = V.event_bins(spark, sf).withColumn("ok", (F.coalesce(F.col("v"), F.lit(0.0)) > 200).cast("int"))
    return rounded(timegrid.trim_to_first_valid(df, cube=["cube", "px"], time="bin", mask="ok").drop("ok", "n"), "v")


_STEPS = f"""st AS (SELECT DISTINCT cube, bin FROM ev5),
 rk AS (SELECT *, bin <= {END} AS ctx, row_number() OVER (PARTITION BY cube, bin <= {END} ORDER BY bin DESC) AS back, row_number() OVER (PARTITION BY cube, bin <= {END} ORDER BY bin) AS ahead FROM st),
 win AS (SELECT cube, bin, CASE WHEN ctx THEN 'context' ELSE 'target' END AS part, CAST(ahead - min(ahead) OVER (PARTITION BY cube, ctx) + 1 AS INTEGER) AS step FROM rk WHERE CASE WHEN ctx THEN back <= 3 ELSE ahead <= 2 END)"""


def _windows(df):
    return timegrid.select_windows(df, cube=CUBE, time="bin", event_end=V.origin(), n_context=3, n_target=2)


@query("context_target_windows", f"WITH {EV5}, {_STEPS} SELECT e.cube, e.px, e.bin, {rnd('e.v', 'v')}, part, step FROM ev5 e JOIN win USING (cube, bin)")
def _(spark, sf):
    return rounded(_windows(V.event_bins(spark, sf).drop("n")), "v")


@query(
    "window_check",
    f"WITH {EV5}, {_STEPS} SELECT cube, count(*) FILTER (part = 'context') AS n_context, count(*) FILTER (part = 'target') AS n_target, max(CASE WHEN part = 'context' THEN bin END) AS context_end, min(CASE WHEN part = 'target' THEN bin END) AS target_start, CASE WHEN max(CASE WHEN part = 'context' THEN bin END) = {END} THEN 1 ELSE 0 END AS ends_at_event, CASE WHEN count(*) FILTER (part = 'context') = 3 AND count(*) FILTER (part = 'target') = 2 THEN 1 ELSE 0 END AS full_length, CASE WHEN min(CASE WHEN part = 'target' THEN bin END) - {END} = 5 THEN 1 ELSE 0 END AS target_follows FROM win GROUP BY 1",
)
def _(spark, sf):
    return timegrid.window_check(V.event_bins(spark, sf), cube=CUBE, time="bin", event_end=V.origin(), n_context=3, n_target=2)


@query(
    "fixed_windows",
    f"WITH {EV5}, o AS (SELECT cube, bin, row_number() OVER (PARTITION BY cube ORDER BY bin) AS o FROM (SELECT DISTINCT cube, bin FROM ev5)) SELECT e.cube, e.px, e.bin, CASE WHEN o <= 3 THEN 'context' ELSE 'target' END AS part, CAST(CASE WHEN o <= 3 THEN o ELSE o - 3 END AS INTEGER) AS step FROM ev5 e JOIN o USING (cube, bin) WHERE o <= 5",
)
def _(spark, sf):
    return timegrid.fixed_windows(V.event_bins(spark, sf), cube=CUBE, time="bin", n_context=3, n_target=2).drop("v", "n")


@query(
    "last_two_steps",
    f"WITH {EV5}, o AS (SELECT cube, bin, row_number() OVER (PARTITION BY cube ORDER BY bin DESC) AS o FROM (SELECT DISTINCT cube, bin FROM ev5)) SELECT e.cube, e.px, e.bin FROM ev5 e JOIN o USING (cube, bin) WHERE o <= 2",
)
def _(spark, sf):
    return timegrid.head_tail(V.event_bins(spark, sf), cube=CUBE, time="bin", n=2, tail=True).select("cube", "px", "bin")


_INTERP = f"""r0 AS (SELECT *, bin <= {END} AS ctx, row_number() OVER (PARTITION BY cube, px, bin <= {END} ORDER BY bin) AS rn FROM evg),
 r1 AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN rn END IGNORE NULLS) OVER wb AS pr, last_value(v IGNORE NULLS) OVER wb AS pv, last_value(CASE WHEN v IS NOT NULL THEN bin END IGNORE NULLS) OVER wb AS pb,
 first_value(v IGNORE NULLS) OVER wf AS nv, first_value(CASE WHEN v IS NOT NULL THEN bin END IGNORE NULLS) OVER wf AS nb FROM r0
 WINDOW wb AS (PARTITION BY cube, px, ctx ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), wf AS (PARTITION BY cube, px, ctx ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 intp AS (SELECT cube, px, bin, ctx, v AS v0, CASE WHEN v IS NOT NULL THEN v WHEN ctx AND pb IS NOT NULL AND nb IS NOT NULL AND rn - pr <= 1 THEN pv + (nv - pv) * (bin - pb) / CAST(nb - pb AS DOUBLE) END AS v FROM r1)"""


def _filled(grid, suffix=""):
    """A gap limit of 5 days: the first NULL of every gap."""
    return timegrid.interpolate_context(grid, pixel=["cube", "px"], time="bin", values=["v"], event_end=V.origin(), max_gap_days=5, suffix=suffix)


@query("interpolate_context", f"WITH {EVG}, {_INTERP} SELECT cube, px, bin, {rnd('v')} FROM intp")
def _(spark, sf):
    return rounded(_filled(V.event_grid(spark, sf)).drop("n"), "v")


_FILL = "CASE WHEN ctx_nulls_before > 0 THEN (ctx_nulls_before - ctx_nulls_after) * 100.0 / ctx_nulls_before ELSE 0 END"
_REPORT = "rep AS (SELECT cube, count(*) FILTER (ctx AND v0 IS NULL) AS ctx_nulls_before, count(*) FILTER (ctx AND v IS NULL) AS ctx_nulls_after, count(*) FILTER (ctx) AS ctx_total, count(*) FILTER (NOT ctx AND v IS NULL) AS after_nulls, count(*) FILTER (NOT ctx) AS after_total FROM intp GROUP BY 1)"


def _fill_report(spark, sf):
    both = _filled(V.event_grid(spark, sf), suffix="_filled")
    return quality.interpolation_report(both, cube=CUBE, time="bin", value="v", filled="v_filled", event_end=V.origin())


@query("interpolation_report", f"WITH {EVG}, {_INTERP}, {_REPORT} SELECT *, {rnd(_FILL, 'fill_rate')} FROM rep")
def _(spark, sf):
    return rounded(_fill_report(spark, sf), "fill_rate")


_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("ctx_nulls_before", "ctx_nulls_after", "ctx_total", "after_nulls", "after_total"))


@query("interpolation_totals", f"WITH {EVG}, {_INTERP}, {_REPORT}, s AS (SELECT {_SUMS} FROM rep) SELECT *, {rnd(_FILL, 'fill_rate')} FROM s")
def _(spark, sf):
    return rounded(quality.interpolation_totals(_fill_report(spark, sf)), "fill_rate")


# ---- baselines -------------------------------------------------------------------------------------
@query(
    "persistence_baseline",
    f"WITH {EVM} SELECT cube, px, {rnd('coalesce(arg_max(CASE WHEN mask_strict = 1 THEN v END, CASE WHEN mask_strict = 1 THEN t END), 0)', 'base')} FROM evm WHERE t < TIMESTAMP '2024-01-16' GROUP BY 1, 2",
)
def _(spark, sf):
    ctx = V.event_masked(spark, sf).filter(F.col("t") < F.lit("2024-01-16").cast("timestamp_ntz"))
    return rounded(baselines.persistence(ctx, pixel=["cube", "px"], time="t", value="v", mask="mask_strict"), "base")


@query("mean_baseline", f"WITH {EVG} SELECT cube, px, {rnd('avg(coalesce(v, 0))', 'base')} FROM evg WHERE bin <= {END} GROUP BY 1, 2")
def _(spark, sf):
    ctx = V.event_grid(spark, sf).filter(F.col("bin") <= V.origin())
    return rounded(baselines.mean_baseline(ctx, pixel=["cube", "px"], value="v"), "base")


@query("zero_baseline", f"WITH {EV5} SELECT DISTINCT cube, px, 0.0::DOUBLE AS base FROM ev5")
def _(spark, sf):
    return baselines.zero_baseline(V.event_bins(spark, sf), pixel=["cube", "px"])


# ---- climate-like aggregation of the same series ----------------------------------------------------
@query("resample_5d_mean_min_max", f"WITH {EV} SELECT cube, {BIN} AS bin, {rnd('avg(v)', 'v_mean')}, {rnd('min(v)', 'v_min')}, {rnd('max(v)', 'v_max')} FROM ev GROUP BY ALL")
def _(spark, sf):
    return rounded(climate.resample_stats(V.event_obs(spark, sf), cube=CUBE, time="t", values=["v"], origin=V.origin()), "v_mean", "v_min", "v_max")


@query(
    "attach_series_to_pixels",
    f"WITH {EV5}, s AS (SELECT cube, {BIN} AS bin, avg(v) AS v_mean FROM ev GROUP BY ALL) SELECT e.cube, px, e.bin, {rnd('v_mean')} FROM ev5 e LEFT JOIN s USING (cube, bin)",
)
def _(spark, sf):
    series = climate.resample_stats(V.event_obs(spark, sf), cube=CUBE, time="t", values=["v"], origin=V.origin()).select("cube", "bin", "v_mean")
    return rounded(climate.attach_series(V.event_bins(spark, sf).drop("v", "n"), series, cube=CUBE), "v_mean")


@query("series_uniformity", f"WITH {EV5} SELECT cube, bin, CASE WHEN min(v) = max(v) AND count(v) = count(*) OR count(v) = 0 THEN 1 ELSE 0 END AS v_uniform FROM ev5 GROUP BY 1, 2")
def _(spark, sf):
    return climate.uniformity_check(V.event_bins(spark, sf), cube=CUBE, bin_col="bin", values=["v"])


@query(
    "daily_calendar_subset",
    f"WITH {EV}, d AS (SELECT px, CAST(unnest(generate_series(CAST(min(t) AS DATE) - 5, CAST(max(t) AS DATE), INTERVAL 1 DAY)) AS DATE) AS day FROM ev GROUP BY px), s AS (SELECT px, CAST(t AS DATE) AS day, avg(v) AS v FROM ev GROUP BY ALL) SELECT d.px, d.day, {rnd('v')} FROM d LEFT JOIN s USING (px, day)",
)
def _(spark, sf):
    ev = V.event_obs(spark, sf)
    daily = ev.groupBy("px", F.to_date("t").alias("day")).agg(F.avg("v").alias("v"))
    return rounded(climate.daily_subset(daily, ev, cube=PX, day="day", obs_time="t"), "v")


@query(
    "exact_climate_reindex",
    f"WITH {EVG}, s AS (SELECT cube, {BIN} AS bin, max(v) AS v_max FROM ev WHERE v > 150 GROUP BY ALL) SELECT b.cube, b.bin, {rnd('v_max')} FROM (SELECT DISTINCT cube, px, bin FROM evg) b LEFT JOIN s USING (cube, bin)",
)
def _(spark, sf):
    series = climate.resample_stats(V.event_obs(spark, sf).filter("v > 150"), cube=CUBE, time="t", values=["v"], origin=V.origin()).select("cube", "bin", "v_max")
    bins = V.event_grid(spark, sf).select("cube", "px", "bin").distinct()
    return rounded(climate.reindex_exact(bins, series, cube=CUBE).drop("px"), "v_max")


@query(
    "time_alignment",
    f"WITH {EV5}, a AS (SELECT DISTINCT px, bin FROM ev5 WHERE cube = 'click'), b AS (SELECT DISTINCT px, bin FROM ev5 WHERE cube = 'view') (SELECT *, 'left' AS only_in FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) UNION ALL (SELECT *, 'right' AS only_in FROM (SELECT * FROM b EXCEPT SELECT * FROM a))",
)
def _(spark, sf):
    bins = V.event_bins(spark, sf)
    return climate.time_alignment(bins.filter("cube = 'click'"), bins.filter("cube = 'view'"), cube=PX)


_NEAR = f"""l AS (SELECT DISTINCT px, t FROM ev WHERE cube = 'click'), r AS (SELECT px, t AS rt, v FROM ev WHERE cube = 'view'),
 m AS (SELECT l.px, l.t, r.rt, r.v, row_number() OVER (PARTITION BY l.px, l.t ORDER BY abs(epoch_us(l.t) - epoch_us(r.rt)), r.rt DESC) AS o FROM l JOIN r ON l.px = r.px AND abs(epoch_us(l.t) - epoch_us(r.rt)) <= 86400000000)"""


@query("nearest_time_join", f"WITH {EV}, {_NEAR} SELECT l.px, l.t, m.rt AS matched_time, {rnd('m.v', 'v')} FROM l LEFT JOIN m ON l.px = m.px AND l.t = m.t AND m.o = 1")
def _(spark, sf):
    ev = V.event_obs(spark, sf)
    left = ev.filter("cube = 'click'").select("px", "t").distinct()
    right = ev.filter("cube = 'view'").select("px", F.col("t").alias("rt"), "v")
    return rounded(climate.nearest_in_time(left, right, cube=PX, time="t", right_time="rt", values=["v"]), "v")


_CAUSAL = """l AS (SELECT px, t, id FROM ev WHERE cube = 'click'), r AS (SELECT px, t AS rt, max(v) AS v FROM ev WHERE cube = 'view' GROUP BY ALL)"""


@query(
    "causal_time_join",
    f"WITH {EV}, {_CAUSAL} SELECT l.id, l.px, l.t, CASE WHEN epoch_us(l.t) - epoch_us(rt) <= 259200000000 THEN rt END AS matched_time, {rnd('CASE WHEN epoch_us(l.t) - epoch_us(rt) <= 259200000000 THEN r.v END', 'v')} FROM l ASOF LEFT JOIN r ON l.px = r.px AND l.t >= r.rt",
)
def _(spark, sf):
    """What was known at each click: the last view of the three days before it, never a later one."""
    ev = V.event_obs(spark, sf)
    left = ev.filter("cube = 'click'").select("id", "px", "t")
    right = ev.filter("cube = 'view'").select("px", F.col("t").alias("rt"), "v")
    return rounded(climate.nearest_in_time(left, right, cube=PX, time="t", right_time="rt", values=["v"], tolerance_days=3, direction="backward"), "v")


# ---- radar limits ----------------------------------------------------------------------------------
_LIMIT = "lim AS (SELECT quantile_cont(v, 0.995) AS m FROM evm WHERE mask_strict = 1)"


def _limits(spark, sf):
    return radar.clip_values(V.event_masked(spark, sf), bands=["v"], veg="mask_strict")


@query("radar_clip_values", f"WITH {EVM}, {_LIMIT} SELECT {rnd('m', 'v_max')} FROM lim")
def _(spark, sf):
    return rounded(_limits(spark, sf), "v_max")


@query("radar_clip", f"WITH {EVM}, {_LIMIT} SELECT id, {rnd('greatest(0, least((SELECT m FROM lim), v))', 'v')} FROM evm")
def _(spark, sf):
    return rounded(radar.clip_bands(V.event_obs(spark, sf), ["v"], _limits(spark, sf)).select("id", "v"), "v")


@query("radar_to_unit_decibel", f"WITH {EV} SELECT id, {rnd('(greatest(-30, least(5, 10*log10(greatest(v/100.0::DOUBLE, 1e-10)))) + 30)/35', 'v')} FROM ev")
def _(spark, sf):
    return rounded(radar.to_unit_decibel(V.event_obs(spark, sf).withColumn("v", F.col("v") / 100.0), ["v"]).select("id", "v"), "v")


# ---- reports ---------------------------------------------------------------------------------------
@query(
    "permanent_gap_report",
    f"WITH {EVM}, p AS (SELECT cube, px, count(CASE WHEN mask_strict = 1 AND v > 100 THEN v END) AS n FROM evm GROUP BY 1, 2) SELECT cube, count(*) FILTER (n = 0) AS n_permanent, count(*) AS n_pixels, {rnd('count(*) FILTER (n = 0) * 100.0 / count(*)', 'pct_permanent')} FROM p GROUP BY 1",
)
def _(spark, sf):
    df = V.event_masked(spark, sf).withColumn("v", F.when((F.col("mask_strict") == 1) & (F.col("v") > 100), F.col("v")))
    return rounded(quality.permanent_gaps(df, cube=CUBE, pixel=PX, value="v"), "pct_permanent")


@query(
    "availability_report",
    f"WITH {EVG}, a AS (SELECT cube, count(*) FILTER (mask_strict <> 1) * 100.0 / count(*) AS pre FROM evm GROUP BY 1), p AS (SELECT cube, px, count(*) FILTER (v IS NULL) AS z, count(*) AS n FROM evg GROUP BY 1, 2), b AS (SELECT cube, sum(z) * 100.0 / sum(n) AS post, count(*) FILTER (z = n) * 100.0 / count(*) AS perm FROM p GROUP BY 1) SELECT cube, {rnd('pre', 'pct_null_before')}, {rnd('post', 'pct_null_after')}, {rnd('perm', 'pct_permanent')} FROM a JOIN b USING (cube)",
)
def _(spark, sf):
    before = masks.apply_mask(V.event_masked(spark, sf), ["v"], "mask_strict")
    out = quality.availability(before, V.event_grid(spark, sf), cube=CUBE, pixel=PX, value="v")
    return rounded(out, "pct_null_before", "pct_null_after", "pct_permanent")


@query("null_share_per_step", f"WITH {EVG} SELECT cube, bin, {rnd('count(*) FILTER (v IS NULL) * 100.0 / count(*)', 'pct_null')} FROM evg GROUP BY 1, 2")
def _(spark, sf):
    return rounded(quality.step_null_share(V.event_grid(spark, sf), cube=CUBE, time="bin", value="v"), "pct_null")


@query("null_frequency_per_pixel", f"WITH {EVG} SELECT cube, px, {rnd('count(*) FILTER (v IS NULL) * 100.0 / count(*)', 'pct_null')} FROM evg WHERE bin <= {END} GROUP BY 1, 2")
def _(spark, sf):
    ctx = V.event_grid(spark, sf).filter(F.col("bin") <= V.origin())
    return rounded(quality.pixel_null_frequency(ctx, pixel=["cube", "px"], value="v"), "pct_null")


_DAY = "CAST(t AS DATE)"


@query("good_steps", f"WITH {EVM} SELECT cube, {_DAY} AS day, {rnd('avg(mask_strict)', 'valid_share')} FROM evm GROUP BY 1, 2 HAVING avg(mask_strict) > 0.45")
def _(spark, sf):
    df = V.event_masked(spark, sf).withColumn("day", F.to_date("t"))
    return rounded(quality.good_steps(df, cube=CUBE, time="day", mask="mask_strict", threshold=0.45), "valid_share")


@query(
    "fewest_nulls_step",
    f"WITH {EVG}, s AS (SELECT cube, bin, count(*) FILTER (v IS NULL) AS n_null FROM evg GROUP BY 1, 2) SELECT cube, bin, n_null FROM (SELECT *, row_number() OVER (PARTITION BY cube ORDER BY n_null, bin) AS o FROM s) WHERE o = 1",
)
def _(spark, sf):
    return quality.fewest_nulls_step(V.event_grid(spark, sf), cube=CUBE, time="bin", value="v")


@query("low_null_steps", f"WITH {EVG} SELECT cube, bin, {rnd('count(*) FILTER (v IS NULL) / count(*)::DOUBLE', 'null_share')} FROM evg GROUP BY 1, 2 HAVING count(*) FILTER (v IS NULL) / count(*)::DOUBLE < 0.5")
def _(spark, sf):
    return rounded(quality.low_null_steps(V.event_grid(spark, sf), cube=CUBE, time="bin", value="v", limit=0.5), "null_share")


_ACQ = f"""per AS (SELECT cube, t, count(CASE WHEN mask_strict = 1 THEN v END) AS nv FROM evm GROUP BY 1, 2),
 b AS (SELECT cube, {BIN} - 5 AS bin_start, count(*) AS n_obs, count(*) FILTER (nv > 0) AS n_valid FROM per GROUP BY ALL),
 fullb AS (SELECT s.cube, d.bin_start FROM (SELECT DISTINCT cube FROM b) s, (SELECT CAST(unnest(generate_series(min(bin_start), max(bin_start), INTERVAL 5 DAY)) AS DATE) AS bin_start FROM b) d),
 acq AS (SELECT cube, bin_start, coalesce(n_obs, 0) AS n_obs, coalesce(n_valid, 0) AS n_valid FROM fullb LEFT JOIN b USING (cube, bin_start))"""


def _acquisitions(spark, sf):
    df = masks.apply_mask(V.event_masked(spark, sf), ["v"], "mask_strict")
    return quality.acquisition_bins(df, sensor="cube", time="t", value="v", origin=V.origin())


@query("acquisition_bins", f"WITH {EVM}, {_ACQ} SELECT * FROM acq")
def _(spark, sf):
    return _acquisitions(spark, sf)


@query(
    "acquisition_report",
    f"WITH {EVM}, {_ACQ} SELECT cube, count(*) AS n_bins, count(*) FILTER (n_obs = 0) AS no_obs, count(*) FILTER (n_obs > 0 AND n_valid = 0) AS only_null, {rnd('count(*) FILTER (n_valid = 0) * 100.0 / count(*)', 'pct_unusable')} FROM acq GROUP BY 1",
)
def _(spark, sf):
    return rounded(quality.acquisition_report(_acquisitions(spark, sf), sensor="cube"), "pct_unusable")


@query(
    "acquisition_window",
    f"WITH {EV} SELECT cube, DATE '2023-07-16' + CAST(5*floor(date_diff('day', DATE '2023-07-16', CAST(t AS DATE))/5.0) AS INTEGER) AS bin_start, count(DISTINCT t) AS n_obs FROM ev WHERE CAST(t AS DATE) BETWEEN DATE '2023-07-16' AND DATE '2024-07-16' GROUP BY ALL",
)
def _(spark, sf):
    return quality.acquisition_window(V.event_obs(spark, sf), sensor="cube", time="t", event_end=V.origin())


@query("step_statistics", f"WITH {EVM} SELECT cube, {_DAY} AS day, {rnd('median(v)', 'v_median')}, {rnd('avg(v)', 'v_mean')}, {rnd('stddev_pop(v)', 'v_std')} FROM evm WHERE mask_strict = 1 GROUP BY ALL")
def _(spark, sf):
    df = V.event_masked(spark, sf).withColumn("day", F.to_date("t"))
    return rounded(quality.step_statistics(df, cube=CUBE, time="day", value="v", veg="mask_strict"), "v_median", "v_mean", "v_std")


@query(
    "sampled_step_statistics",
    f"WITH {EVM} SELECT cube, {_DAY} AS day, {rnd('avg(v)', 'v_mean')}, {rnd('min(v)', 'v_min')}, {rnd('max(v)', 'v_max')} FROM evm WHERE mask_strict = 1 GROUP BY ALL",
)
def _(spark, sf):
    df = V.event_masked(spark, sf).withColumn("day", F.to_date("t"))
    return rounded(quality.step_range(df, cube=CUBE, time="day", value="v", veg="mask_strict"), "v_mean", "v_min", "v_max")


@query(
    "extreme_steps",
    f"WITH {EV5} SELECT cube, px, arg_max(bin, (v, -(bin - DATE '1970-01-01'))) AS argmax, arg_min(bin, (v, bin - DATE '1970-01-01')) AS argmin FROM ev5 WHERE v IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT cube, px, NULL, NULL FROM ev5 GROUP BY 1, 2 HAVING count(v) = 0",
)
def _(spark, sf):
    return selection.extreme_steps(V.event_bins(spark, sf), keys=["cube", "px"], time="bin", value="v")
