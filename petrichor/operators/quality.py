"""Quality reports and acceptance rules. Every report is one mergeable aggregation (no group is collected)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from petrichor.functions import labels as L
from petrichor.functions.scalar import BIN_DAYS, bin_end, count_true, first_reason, flag, hash_text, n_rows
from petrichor.operators.order_stats import _join_keys, group_percentiles
from petrichor.operators.timegrid import context_target_steps



# ---- pixels over time ------------------------------------------------------------------------------
def static_outliers(
    df: DataFrame, *, pixel: list[str], strict: str = "mask_strict", veg: str = "is_veg", ndvi: str = "NDVI", ndwi: str = "NDWI",
    threshold: float = 0.75, min_clear: int = 5,
) -> DataFrame:
    """Pixels that look non-vegetated in more than ``threshold`` of their clear steps get ``static_valid`` 0."""
    clear = F.col(strict) == 1
    suspicious = F.coalesce(F.col(ndvi) < 0.05, F.lit(False)) | F.coalesce(F.col(ndwi) > 0.3, F.lit(False))
    out = df.groupBy(*pixel).agg(
        count_true(clear).alias("n_clear"),
        count_true(clear & suspicious & (F.col(veg) == 1)).alias("n_error"),
        F.max(veg).alias(veg),
    )
    freq = F.when(F.col("n_clear") > min_clear, F.col("n_error") / F.col("n_clear")).otherwise(0.0)
    return out.withColumn("error_freq", freq).withColumn("static_valid", flag(F.col("error_freq") <= threshold))


def removal_check(df: DataFrame, *, cube: list[str], veg: str = "is_veg", valid: str = "static_valid") -> DataFrame:
    """Vegetation pixels before - after = removed."""
    on = F.col(veg) == 1
    out = df.groupBy(*cube).agg(
        count_true(on).alias("n_before"),
        count_true(on & (F.col(valid) == 1)).alias("n_after"),
        count_true(on & (F.col(valid) == 0)).alias("n_removed"),
    )
    return out.withColumn("ok", flag(F.col("n_before") - F.col("n_after") == F.col("n_removed")))


def permanent_gaps(df: DataFrame, *, cube: list[str], pixel: list[str], value: str) -> DataFrame:
    """Pixels of a cube that are NULL at every step, count and percent."""
    per_pixel = df.groupBy(*cube, *pixel).agg(F.count(value).alias("_n"))
    return per_pixel.groupBy(*cube).agg(
        count_true(F.col("_n") == 0).alias("n_permanent"),
        n_rows().alias("n_pixels"),
        (count_true(F.col("_n") == 0) * 100.0 / n_rows()).alias("pct_permanent"),
    )


def availability(before: DataFrame, after: DataFrame, *, cube: list[str], pixel: list[str], value: str) -> DataFrame:
    """Percent NULL before and after resampling, percent of pixels permanently missing."""
    pct_null = count_true(F.col(value).isNull()) * 100.0 / n_rows()
    pre = before.groupBy(*cube).agg(pct_null.alias("pct_null_before"))
    post = after.groupBy(*cube, *pixel).agg(count_true(F.col(value).isNull()).alias("_z"), n_rows().alias("_n")).groupBy(*cube).agg(
        (F.sum("_z") * 100.0 / F.sum("_n")).alias("pct_null_after"),
        (count_true(F.col("_z") == F.col("_n")) * 100.0 / n_rows()).alias("pct_permanent"),
    )
    return pre.join(post, cube)


def pixel_null_frequency(df: DataFrame, *, pixel: list[str], value: str) -> DataFrame:
    return df.groupBy(*pixel).agg((count_true(F.col(value).isNull()) * 100.0 / n_rows()).alias("pct_null"))


def step_null_share(df: DataFrame, *, cube: list[str], time: str, value: str) -> DataFrame:
    return df.groupBy(*cube, time).agg((count_true(F.col(value).isNull()) * 100.0 / n_rows()).alias("pct_null"))


def mean_map(df: DataFrame, *, pixel: list[str], value: str) -> DataFrame:
    return df.groupBy(*pixel).agg(F.avg(F.col(value).cast("double")).alias("v_mean"))


def robust_limits(df: DataFrame, *, cube: list[str], value: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Display limits per cube: [0, 1] when the data lies inside it, else the two percentiles."""
    q = group_percentiles(df, cube, [value], [low, high], [F.min(value).alias("_lo"), F.max(value).alias("_hi")])
    unit = (F.col("_lo") >= 0) & (F.col("_hi") <= 1)
    return q.select(
        *cube,
        F.when(unit, 0.0).otherwise(F.col(f"{value}_p0")).alias("v_low"),
        F.when(unit, 1.0).otherwise(F.col(f"{value}_p1")).alias("v_high"),
    )


def percentile_stretch(df: DataFrame, *, cube: list[str], bands: list[str], low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Bands stretched between two percentiles of their cube and clipped to [0, 1]."""
    q = group_percentiles(df, cube, bands, [low, high])
    out = df.join(q, cube)
    for b in bands:
        lo, hi = F.col(f"{b}_p0"), F.col(f"{b}_p1")
        scaled = F.try_divide(F.col(b).cast("double") - lo, hi - lo)
        out = out.withColumn(b, F.when(scaled.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled))))
    return out.drop(*[f"{b}_p{i}" for b in bands for i in (0, 1)])


# ---- steps -----------------------------------------------------------------------------------------
def good_steps(df: DataFrame, *, cube: list[str], time: str, mask: str, threshold: float = 0.99) -> DataFrame:
    """Steps whose share of valid pixels exceeds the threshold."""
    return df.groupBy(*cube, time).agg(F.avg(mask).alias("valid_share")).filter(F.col("valid_share") > threshold)


def fewest_nulls_step(df: DataFrame, *, cube: list[str], time: str, value: str) -> DataFrame:
    """Fallback: the step with the fewest NULLs, the earliest on a tie."""
    per_step = df.groupBy(*cube, time).agg(count_true(F.col(value).isNull()).alias("n_null"))
    return per_step.groupBy(*cube).agg(F.min_by(time, F.struct("n_null", time)).alias(time), F.min("n_null").alias("n_null"))


def low_null_steps(df: DataFrame, *, cube: list[str], time: str, value: str, limit: float = 0.1) -> DataFrame:
    share = count_true(F.col(value).isNull()) / n_rows()
    return df.groupBy(*cube, time).agg(share.alias("null_share")).filter(F.col("null_share") < limit)


def step_statistics(df: DataFrame, *, cube: list[str], time: str, value: str, veg: str | None = None) -> DataFrame:
    """Spatial mean / median / population std per step over vegetation pixels."""
    rows = df.filter(F.col(veg) == 1) if veg else df
    v = F.col(value).cast("double")
    q = group_percentiles(rows, [*cube, time], [value], [0.5], [F.avg(v).alias("v_mean"), F.stddev_pop(v).alias("v_std")])
    return q.withColumnRenamed(f"{value}_p0", "v_median")


def step_range(df: DataFrame, *, cube: list[str], time: str, value: str, veg: str | None = None) -> DataFrame:
    """mean / min / max per step over all vegetation pixels; mergeable, so no sample is needed."""
    rows = df.filter(F.col(veg) == 1) if veg else df
    v = F.col(value).cast("double")
    return rows.groupBy(*cube, time).agg(F.avg(v).alias("v_mean"), F.min(v).alias("v_min"), F.max(v).alias("v_max"))


def acquisition_bins(
    df: DataFrame, *, sensor: str, time: str, value: str, origin: Column, days: int = BIN_DAYS, cube: list[str] = ()
) -> DataFrame:
    """Per sensor and 5-day interval (left edge ``bin_start``): acquisitions, and valid ones.

    The calendar spans all sensors of a cube; an interval without observations has zero counts.
    """
    per_time = df.groupBy(*cube, sensor, time).agg(F.count(value).alias("_valid"))
    start = F.date_sub(bin_end(F.col(time), origin, days), days)
    binned = per_time.groupBy(*cube, sensor, start.alias("bin_start")).agg(
        n_rows().alias("n_obs"), count_true(F.col("_valid") > 0).alias("n_valid")
    )
    w = Window.partitionBy(*cube) if cube else None
    if w is not None:
        sensors = binned.groupBy(*cube, sensor).agg(F.min("bin_start").alias("_a"), F.max("bin_start").alias("_z"))
        span = sensors.withColumns({"_a": F.min("_a").over(w), "_z": F.max("_z").over(w)})
    else:
        ends = binned.agg(F.min("bin_start").alias("_a"), F.max("bin_start").alias("_z"))
        span = binned.select(sensor).distinct().withColumns(
            {"_a": ends.select("_a").scalar(), "_z": ends.select("_z").scalar()}
        )
    full = span.select(*cube, sensor, F.explode(F.sequence("_a", "_z", F.make_dt_interval(days=F.lit(days)))).alias("bin_start"))
    return full.join(binned, [*cube, sensor, "bin_start"], "left").fillna(0, ["n_obs", "n_valid"])


def acquisition_report(bins: DataFrame, *, sensor: str, cube: list[str] = ()) -> DataFrame:
    missing, only_null = F.col("n_obs") == 0, (F.col("n_obs") > 0) & (F.col("n_valid") == 0)
    return bins.groupBy(*cube, sensor).agg(
        n_rows().alias("n_bins"), count_true(missing).alias("no_obs"), count_true(only_null).alias("only_null"),
        (count_true(missing | only_null) * 100.0 / n_rows()).alias("pct_unusable"),
    )


def acquisition_window(df: DataFrame, *, sensor: str, time: str, event_end: Column, months: int = 6, days: int = BIN_DAYS) -> DataFrame:
    """Variant: acquisitions per interval counted from event end - ``months`` up to + ``months``."""
    day = F.to_date(time)
    start = F.add_months(event_end, -months)
    index = F.floor(F.datediff(day, start) / F.lit(float(days)))
    times = df.filter((day >= start) & (day <= F.add_months(event_end, months))).select(
        sensor, time, F.date_add(start, (index * days).cast("int")).alias("bin_start")
    ).distinct()
    return times.groupBy(sensor, "bin_start").agg(n_rows().alias("n_obs"))


# ---- land cover ------------------------------------------------------------------------------------
def landcover_distribution(df: DataFrame, *, cube: list[str], code: str) -> DataFrame:
    """Percent per class with its name, unknown codes spelled out; sorted by share inside a cube."""
    counts = df.groupBy(*cube, code).agg(n_rows().alias("_n"))
    total = F.sum("_n").over(Window.partitionBy(*cube))
    names = F.create_map(*[F.lit(x) for pair in L.LANDCOVER_NAMES.items() for x in pair])
    name = F.coalesce(F.try_element_at(names, F.col(code).cast("int")), F.format_string("Unmapped Code (%s)", F.col(code).cast("string")))
    return counts.select(*cube, code, name.alias("class_name"), F.round(F.col("_n") * 100.0 / total, 2).alias("pct")).orderBy(*cube, F.desc("pct"), code)


# ---- acceptance ------------------------------------------------------------------------------------
def accept_raw_cubes(
    df: DataFrame, *, cube: list[str], time: str, mask: str, event_end: Column, min_share: float = 0.20, min_context: int = 5, target_days: int = 35
) -> DataFrame:
    """Enough clear steps up to the event, at least one in the days after it."""
    steps = df.groupBy(*cube, time, event_end.alias("_end")).agg(F.avg(mask).alias("_share"))
    valid = F.col("_share") > min_share
    # Label slicing on a timestamp axis: the event end and end + n_rows() days are midnights.
    t = F.col(time).cast("timestamp_ntz")
    end = F.col("_end").cast("timestamp_ntz")
    first, last = F.date_add("_end", 1).cast("timestamp_ntz"), F.date_add("_end", target_days).cast("timestamp_ntz")
    counts = steps.groupBy(*cube).agg(
        count_true(valid & (t <= end)).alias("n_context"),
        count_true(valid & (t >= first) & (t <= last)).alias("n_target"),
    )
    reason = first_reason(
        [
            (F.col("n_context") < min_context, F.format_string("Too few ctx observations (%d)", F.col("n_context"))),
            (F.col("n_target") == 0, "No valid target observations"),
        ],
        "ok",
    )
    return counts.withColumn("reason", reason).withColumn("accepted", flag(F.col("reason") == "ok"))


def accept_processed_cubes(
    df: DataFrame, *, cube: list[str], time: str, mask: str, event_end: Column, n_context: int, n_target: int,
    context_ratio: float, context_fraction: float, context_overall: float, target_ratio: float, min_target_steps: int,
) -> DataFrame:
    """Ordered rules of the processed-cube scan; ``reason`` is the first rule that fails, else 'ok'."""
    steps = df.groupBy(*cube, time, event_end.alias("_end")).agg(count_true(F.col(mask) > 0).alias("_ok"), n_rows().alias("_n"))
    tags = context_target_steps(steps, cube=cube, time=time, event_end=F.col("_end"), n_context=n_context, n_target=n_target)
    tagged = steps.join(tags, [*cube, time], "left")
    ctx, tgt = F.col("part") == "context", F.col("part") == "target"
    share = F.col("_ok") / F.col("_n")
    stats = tagged.groupBy(*cube).agg(
        F.max(flag(F.col(time) == F.col("_end"))).alias("has_end"),
        count_true(ctx).alias("n_context"),
        F.try_divide(F.sum(F.when(ctx, F.col("_ok"))), F.sum(F.when(ctx, F.col("_n")))).alias("context_valid"),
        count_true(ctx & (share >= context_ratio)).alias("n_good_context"),
        count_true(tgt).alias("n_target"),
        count_true(tgt & (share >= target_ratio)).alias("n_good_target"),
    )
    reason = first_reason(
        [
            (F.col("has_end") == 0, "cutoff_date_missing"),
            (F.col("n_context") < n_context, F.format_string("Too few ctx timesteps available (%d)", F.col("n_context"))),
            (F.col("context_valid") < context_overall, F.format_string("Too few valid pixels overall in context (%.2f%%)", F.col("context_valid") * 100)),
            (F.col("n_good_context") < int(n_context * context_fraction), F.format_string("Too few good ctx steps available (%d)", F.col("n_good_context"))),
            (F.col("n_target") == 0, "No target timesteps"),
            (F.col("n_good_target") < min_target_steps, F.format_string("Too few valid target steps available (%d)", F.col("n_good_target"))),
        ],
        "ok",
    )
    return stats.withColumn("reason", reason)


# ---- interpolation ---------------------------------------------------------------------------------
def interpolation_report(df: DataFrame, *, cube: list[str], time: str, value: str, filled: str, event_end: Column) -> DataFrame:
    """Per cube: context NULLs before and after filling, cells, fill rate in percent, NULLs after the event.

    ``df`` carries the original and the filled column (``interpolate_context`` with a suffix).
    """
    ctx, before, after = F.col(time) <= event_end, F.col(value).isNull(), F.col(filled).isNull()
    out = df.groupBy(*cube).agg(
        count_true(ctx & before).alias("ctx_nulls_before"),
        count_true(ctx & after).alias("ctx_nulls_after"),
        count_true(ctx).alias("ctx_total"),
        count_true(~ctx & after).alias("after_nulls"),
        count_true(~ctx).alias("after_total"),
    )
    return _fill_rate(out)


def interpolation_totals(report: DataFrame) -> DataFrame:
    """Global report: sums first, ratios last."""
    cols = ["ctx_nulls_before", "ctx_nulls_after", "ctx_total", "after_nulls", "after_total"]
    return _fill_rate(report.agg(*[F.sum(c).alias(c) for c in cols]))


def _fill_rate(df: DataFrame) -> DataFrame:
    filled = F.col("ctx_nulls_before") - F.col("ctx_nulls_after")
    rate = F.when(F.col("ctx_nulls_before") > 0, filled * 100.0 / F.col("ctx_nulls_before")).otherwise(0.0)
    return df.withColumn("fill_rate", rate)


# ---- consistency -----------------------------------------------------------------------------------
def max_abs_difference(left: DataFrame, right: DataFrame, *, keys: list[str], cube: list[str], value: str, tolerance: float, mask: str | None = None) -> DataFrame:
    """Largest |left - right| per cube over valid pixels and whether it stays within the tolerance."""
    rows = left.filter(F.col(mask) == 1) if mask else left
    joined = rows.select(*keys, F.col(value).alias("_a")).join(right.select(*keys, F.col(value).alias("_b")), keys)
    out = joined.groupBy(*cube).agg(F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_abs_diff"), n_rows().alias("n_compared"))
    return out.withColumn("ok", flag(F.coalesce(F.col("max_abs_diff"), F.lit(0.0)) <= tolerance))


def masked_target_check(df: DataFrame, *, cube: list[str], target: str, mask: str) -> DataFrame:
    """Rows whose target is 0 although the mask says valid."""
    bad = (F.coalesce(F.col(target), F.lit(0.0)) == 0) & (F.col(mask) == 1)
    return df.groupBy(*cube).agg(count_true(bad).alias("n_violations"))


def dataset_counts(cubes: DataFrame, excluded: DataFrame, *, cube: list[str]) -> DataFrame:
    """total / excluded / used, in one pass over the joined table."""
    marked = cubes.join(excluded.select(*cube).distinct().withColumn("_x", F.lit(1)), cube, "left")
    return marked.agg(
        n_rows().alias("n_total"), count_true(F.col("_x") == 1).alias("n_excluded"), count_true(F.col("_x").isNull()).alias("n_used")
    )


def category_distribution(df: DataFrame, *, split: str, category: str) -> DataFrame:
    """Count and share of every category inside its split."""
    counts = df.groupBy(split, category).agg(n_rows().alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(split)))
