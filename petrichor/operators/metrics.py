"""Forecast metrics over prediction pixels.

Pixels are read once: one mergeable aggregation per (cube, step) gives counts, means and centred second
moments. Cube, fold and global tables are built from those few rows. Two dialects stay apart:
``analysis_*`` (NULL where undefined) and ``validation_*`` (epsilon-guarded, with reconstruction flags).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from petrichor.functions import labels as L
from petrichor.functions.scalar import count_true, direction, flag, n_rows, null_if_nan, reasons, rows_signature, safe_ratio
from petrichor.operators.tiles import with_halo

TINY = 1e-12


def _nnse(nse: Column) -> Column:
    return F.when(nse.isNotNull(), 1.0 / (2.0 - nse))


def _guarded_corr(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    both = F.when(a.isNotNull() & b.isNotNull(), a)
    enough = (F.count(both) >= 3) & (F.stddev_pop(a) > TINY) & (F.stddev_pop(b) > TINY)
    # covariance over deviations: the built-in correlation fails on a constant side under ANSI rules
    return F.when(enough, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def step_moments(df: DataFrame, keys: list[str], valid: Column) -> DataFrame:
    """Per key set (cube + step): counts, error means, target moments and response moments over valid pixels."""
    p, t, b = (F.col(c).cast("double") for c in ("pred", "true", "base"))
    on = lambda c: F.when(F.col("_ok"), c)
    rows = df.select(*keys, valid.alias("_ok"), p.alias("_p"), t.alias("_t"), b.alias("_b"))
    err, err_b = F.col("_p") - F.col("_t"), F.col("_b") - F.col("_t")
    obs, fct = F.col("_t") - F.col("_b"), F.col("_p") - F.col("_b")
    return rows.groupBy(*keys).agg(
        count_true(F.col("_ok")).alias("n_valid"),
        n_rows().alias("n_cells"),
        F.avg(on(err * err)).alias("mse"),
        F.avg(on(F.abs(err))).alias("mae"),
        F.avg(on(err)).alias("bias"),
        F.avg(on(err_b * err_b)).alias("mse_base"),
        F.avg(on(F.abs(err_b))).alias("mae_base"),
        F.avg(on(err_b)).alias("bias_base"),
        F.avg(on(F.col("_t"))).alias("y_mean"),
        (F.var_pop(on(F.col("_t"))) * count_true(F.col("_ok"))).alias("sst"),
        F.avg(on(obs)).alias("observed_response"),
        F.avg(on(fct)).alias("predicted_response"),
        F.avg(on(F.abs(obs))).alias("_obs_amp"),
        F.avg(on(F.abs(fct))).alias("_fct_amp"),
        _guarded_corr(on(obs), on(fct)).alias("response_spatial_correlation"),
    )


def analysis_valid() -> Column:
    """mask above one half and all three values finite."""
    finite = [null_if_nan(F.col(c)).isNotNull() for c in ("pred", "true", "base")]
    return F.coalesce(F.col("mask") > 0.5, F.lit(False)) & finite[0] & finite[1] & finite[2]


def step_metrics(df: DataFrame, *, cube: list[str], step: str = "step", response_threshold: float = 0.005, lead_days: int = 5) -> DataFrame:
    """One row per (cube, step). A step without valid pixels keeps its row, n_valid 0 and NULL metrics."""
    m = step_moments(df, [*cube, step], analysis_valid())
    nse = F.when(F.col("sst") > TINY, 1.0 - F.col("mse") * F.col("n_valid") / F.col("sst"))
    match = direction(F.col("observed_response"), response_threshold) == direction(F.col("predicted_response"), response_threshold)
    return m.withColumns(
        {
            "lead_day": F.col(step) * lead_days,
            "spatial_valid_fraction": F.col("n_valid") / F.col("n_cells"),
            "mse_skill": 1.0 - safe_ratio(F.col("mse"), F.col("mse_base")),
            "mae_gain": F.col("mae_base") - F.col("mae"),
            "nse": nse,
            "nnse": _nnse(nse),
            "response_mean_abs_error": F.abs(F.col("predicted_response") - F.col("observed_response")),
            "response_amplitude_ratio": safe_ratio(F.col("_fct_amp"), F.col("_obs_amp")),
            "direction_match": match.cast("double"),
        }
    ).drop("_obs_amp", "_fct_amp")


def _pooled(steps: DataFrame, cube: list[str]) -> DataFrame:
    """Cube totals from step rows; the target's sum of squares is combined around the pooled mean."""
    n = F.col("n_valid")
    over = Window.partitionBy(*cube)
    pooled_mean = F.sum(n * F.col("y_mean")).over(over) / F.nullif(F.sum(n).over(over), F.lit(0))
    return steps.withColumn("_ss", F.col("sst") + n * (F.col("y_mean") - pooled_mean) * (F.col("y_mean") - pooled_mean))


_ERRORS = ["mse", "mae", "bias", "mse_base", "mae_base", "bias_base"]


def cube_metrics(
    steps: DataFrame, *, cube: list[str], step: str = "step", eligible: DataFrame | None = None,
    min_coverage: float = 0.15, min_count: int = 1000, min_variance: float = 1e-6, on_empty: str = "raise",
) -> DataFrame:
    """Pooled metrics, eligibility with reasons, response summaries. ``eligible``: cube + n_eligible pixels.

    A cube without any valid pixel is an error unless ``on_empty='null'``.
    """
    n = F.col("n_valid")
    total = F.sum(n)
    has = F.col("n_valid") > 0
    last = lambda c: F.max_by(F.struct(F.col(c).alias("v")), F.col(step))["v"]
    traj = lambda c: F.when(has, F.col(c))
    agg = _pooled(steps, cube).groupBy(*cube).agg(
        total.alias("n_valid_target_pixel_times"),
        F.sum("n_cells").alias("_cells"),
        n_rows().alias("_steps"),
        *[F.try_divide(F.sum(n * F.col(c)), total).alias(c) for c in _ERRORS],
        F.sum("_ss").alias("target_sst"),
        F.avg(traj("observed_response")).alias("observed_response_auc"),
        F.avg(traj("predicted_response")).alias("predicted_response_auc"),
        last("observed_response").alias("observed_r30"),
        last("predicted_response").alias("predicted_r30"),
        last("response_mean_abs_error").alias("r30_abs_error"),
        last("direction_match").alias("r30_direction_match"),
        _guarded_corr(traj("observed_response"), traj("predicted_response")).alias("response_trajectory_correlation"),
    )
    if eligible is not None:
        agg = agg.join(eligible.select(*cube, F.col("n_eligible").alias("n_eligible_vegetation_pixels")), cube, "left")
    else:
        agg = agg.withColumn("n_eligible_vegetation_pixels", F.lit(None).cast("bigint"))
    count = F.col("n_valid_target_pixel_times")
    possible = F.col("_steps") * F.col("n_eligible_vegetation_pixels")
    agg = agg.withColumns(
        {
            "spatial_valid_fraction": count / F.col("_cells"),
            "valid_target_coverage": F.when(possible > 0, count / possible),
            "target_variance": F.try_divide(F.col("target_sst"), count),
            "mse_skill": 1.0 - safe_ratio(F.col("mse"), F.col("mse_base")),
            "mae_gain": F.col("mae_base") - F.col("mae"),
            "persistence_beaten": (F.col("mse") < F.col("mse_base")).cast("double"),
        }
    )
    why = reasons(
        [
            (count < min_count, "insufficient_valid_target_count"),
            (F.col("valid_target_coverage") < min_coverage, "insufficient_valid_target_coverage"),
            (F.col("target_variance") < min_variance, "target_variance_below_minimum"),
        ]
    )
    agg = agg.withColumn("nnse_exclusion_reason", why)
    fine = F.col("nnse_exclusion_reason") == ""
    sst_ok = F.col("target_sst") > TINY
    nse = lambda c: F.when(sst_ok & fine, 1.0 - F.col(c) * count / F.col("target_sst"))
    out = agg.withColumns({"nse": nse("mse"), "nse_base": nse("mse_base")})
    out = out.withColumns({"nnse": _nnse(F.col("nse")), "nnse_base": _nnse(F.col("nse_base")), "nnse_eligible": flag(fine)})
    if on_empty == "raise":
        error = F.raise_error(F.lit("a cube without any usable target value can't be scored")).cast("bigint")
        out = out.withColumn("n_valid_target_pixel_times", F.when(count > 0, count).otherwise(error))
    return out.drop("_cells", "_steps")


def landcover_metrics(
    df: DataFrame, landcover: DataFrame, *, cube: list[str], pixel: list[str], code: str = "esa_lc", step: str = "step",
    min_pixels: int = 100, **thresholds,
) -> tuple[DataFrame, DataFrame]:
    """(cube, step) metrics per land-cover group; groups under ``min_pixels`` pixels of a cube are left out.

    The code -> group table is a literal; group pixels are the eligible set, no coverage limit applies.
    """
    group = F.lit(None).cast("string")
    for name, codes in L.LANDCOVER_GROUPS.items():
        group = F.when(F.col(code).isin(codes), name).otherwise(group)
    grouped = landcover.select(*cube, *pixel, group.alias("landcover_group")).filter(F.col("landcover_group").isNotNull())
    sizes = grouped.groupBy(*cube, "landcover_group").agg(n_rows().alias("n_eligible")).filter(F.col("n_eligible") >= min_pixels)
    rows = df.join(grouped, [*cube, *pixel]).join(sizes.drop("n_eligible"), [*cube, "landcover_group"], "left_semi")
    keys = [*cube, "landcover_group"]
    steps = step_metrics(rows, cube=keys, step=step)
    # an empty group is skipped, not an error
    seen = steps.withColumn("_any", F.sum("n_valid").over(Window.partitionBy(*keys))).filter(F.col("_any") > 0).drop("_any")
    return cube_metrics(seen, cube=keys, step=step, eligible=sizes, min_coverage=0.0, on_empty="null", **thresholds), seen


# ---- validation dialect ----------------------------------------------------------------------------
def validation_steps(df: DataFrame, *, cube: list[str], step: str = "step") -> DataFrame:
    """Step moments where only the mask decides validity."""
    return step_moments(df, [*cube, step], F.coalesce(F.col("mask") > 0.5, F.lit(False)))


def validation_cubes(
    steps: DataFrame, cubes: DataFrame, *, cube: list[str],
    min_coverage: float = 0.15, min_count: int = 1000, min_variance: float = 1e-6,
) -> DataFrame:
    """Cube audit of a validation epoch; every cube of ``cubes`` keeps a row.

    ``cubes``: cube keys + n_eligible (pixels), n_steps, complete (0/1).
    """
    n = F.col("n_valid")
    total = F.sum(n)
    agg = _pooled(steps, cube).groupBy(*cube).agg(
        total.alias("_total"), *[F.try_divide(F.sum(n * F.col(c)), total).alias(c) for c in _ERRORS], F.sum("_ss").alias("target_sst")
    )
    out = cubes.join(agg, cube, "left").withColumn("n_valid_target_pixel_times", F.coalesce("_total", F.lit(0)))
    count, possible = F.col("n_valid_target_pixel_times"), F.col("n_steps") * F.col("n_eligible")
    out = out.withColumns(
        {
            "valid_target_coverage": F.when(possible > 0, count / possible).otherwise(0.0),
            "target_variance": F.try_divide(F.col("target_sst"), F.nullif(count, F.lit(0))),
            "cube_skill": F.when(count > 0, 1.0 - F.col("mse") / (F.col("mse_base") + 1e-8)),
        }
    )
    why = reasons(
        [
            (F.col("complete") == 0, "incomplete_reconstruction"),
            (F.col("n_eligible") == 0, "no_eligible_vegetation"),
            (count == 0, "no_valid_target_pixel_times"),
            ((count > 0) & (count < min_count), "insufficient_valid_target_count"),
            ((possible > 0) & (F.col("valid_target_coverage") < min_coverage), "insufficient_valid_target_coverage"),
            ((count > 0) & (F.col("target_variance") < min_variance), "target_variance_below_minimum"),
        ]
    )
    out = out.withColumn("r2_nnse_exclusion_reason", why)
    fine = F.col("r2_nnse_exclusion_reason") == ""
    r2 = lambda c: F.when(fine, 1.0 - F.try_divide(F.col(c) * count, F.col("target_sst")))
    out = out.withColumns({"r2": r2("mse"), "r2_base": r2("mse_base"), "r2_nnse_eligible": flag(fine)})
    return out.withColumns({"nnse": _nnse(F.col("r2")), "nnse_base": _nnse(F.col("r2_base"))}).drop("_total")


def validation_micro(steps: DataFrame, *, step: str | None = None) -> DataFrame:
    """Pixel-weighted aggregates over all cubes: per ``step``, or the grand mean without it."""
    n = F.col("n_valid")
    agg = steps.groupBy(*([step] if step else [])).agg(
        F.sum(n).alias("n_valid"),
        *[F.sum(n * F.col(c)).alias(f"_{c}") for c in _ERRORS],
        F.sum(n * F.col("y_mean")).alias("_y"),
        F.sum(F.col("sst") + n * F.col("y_mean") * F.col("y_mean")).alias("_yy"),
    ).filter(F.col("n_valid") > 0)
    sst = F.col("_yy") - F.col("_y") * F.col("_y") / F.col("n_valid") + 1e-8
    out = agg.withColumns({c: F.col(f"_{c}") / F.col("n_valid") for c in _ERRORS})
    out = out.withColumns({"r2": 1.0 - F.col("_mse") / sst, "r2_base": 1.0 - F.col("_mse_base") / sst})
    out = out.withColumns(
        {"nnse": _nnse(F.col("r2")), "nnse_base": _nnse(F.col("r2_base")), "skill": 1.0 - F.col("mse") / (F.col("mse_base") + 1e-8)}
    )
    return out.drop("_y", "_yy", *[f"_{c}" for c in _ERRORS])


def validation_macro(audit: DataFrame, *, raise_if_empty: bool = False) -> DataFrame:
    """Equal cube weight: errors over complete cubes with data, R2/NNSE over eligible cubes."""
    usable = (F.col("complete") == 1) & (F.col("n_valid_target_pixel_times") > 0)
    eligible = F.col("r2_nnse_eligible") == 1
    out = audit.agg(
        *[F.avg(F.when(usable, F.col(c))).alias(c) for c in [*_ERRORS, "cube_skill"]],
        *[F.avg(F.when(eligible, F.col(c))).alias(c) for c in ("r2", "r2_base", "nnse", "nnse_base")],
        count_true(eligible).alias("eligible_cubes"),
        count_true(~eligible).alias("excluded_cubes"),
    )
    if raise_if_empty:
        error = F.raise_error(F.lit("macro scores need at least one eligible cube")).cast("bigint")
        out = out.withColumn("eligible_cubes", F.when(F.col("eligible_cubes") > 0, F.col("eligible_cubes")).otherwise(error))
    return out


# ---- small summaries -------------------------------------------------------------------------------
def fold_macro_mean(df: DataFrame, *, keys: list[str], fold: str, metrics: list[str]) -> DataFrame:
    """Mean per fold, then mean of folds; NULLs are skipped at both levels, a NULL fold is a fold."""
    per_fold = df.groupBy(*keys, fold).agg(*[F.avg(m).alias(m) for m in metrics])
    return per_fold.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics])


def ratio_of_means_skill(df: DataFrame, *, keys: list[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg((1.0 - safe_ratio(F.avg("mse"), F.avg("mse_base"))).alias("mse_skill_ratio"))


def evaluator_steps(df: DataFrame, *, cube: list[str], step: str = "step") -> DataFrame:
    """Evaluator table per (cube, step): zeros instead of NULL where nothing is valid, deltas vs the base."""
    p, t, b = (F.col(c).cast("double") for c in ("pred", "true", "base"))
    ok = F.coalesce(F.col("mask") == 1, F.lit(False))
    on = lambda c: F.when(F.col("_ok"), c)
    rows = df.select(*cube, step, ok.alias("_ok"), p.alias("p"), t.alias("t"), b.alias("b"))
    e, eb, dt, dp = F.expr("t - p"), F.expr("t - b"), F.expr("t - b"), F.expr("p - b")
    named = {
        "mse_pred": F.avg(on(e * e)), "mse_base": F.avg(on(eb * eb)),
        "mae_pred": F.avg(on(F.abs(e))), "mae_base": F.avg(on(F.abs(eb))),
        "bias_abs": F.avg(on(-e)), "mse_delta": F.avg(on((dt - dp) * (dt - dp))), "bias_delta": F.avg(on(dp - dt)),
        "d_true_mean": F.avg(on(dt)), "d_true_std": F.stddev_pop(on(dt)),
        "d_pred_mean": F.avg(on(dp)), "d_pred_std": F.stddev_pop(on(dp)),
    }
    return rows.groupBy(*cube, step).agg(
        count_true(F.col("_ok")).alias("num_valid"), n_rows().alias("n_cells"),
        *[F.coalesce(c, F.lit(0.0)).alias(k) for k, c in named.items()],
    )


def evaluator_report(steps: DataFrame, *, cube: list[str]) -> DataFrame:
    """Pixel-weighted overall errors, winner and coverage in percent."""
    n, total = F.col("num_valid"), F.sum("num_valid")
    mean = lambda c: F.coalesce(F.try_divide(F.sum(n * F.col(c)), total), F.lit(0.0))
    out = steps.groupBy(*cube).agg(
        total.alias("total_valid"), mean("mse_pred").alias("mse_pred"), mean("mse_base").alias("mse_base"),
        mean("bias_delta").alias("bias_delta"), (total * 100.0 / F.sum("n_cells")).alias("coverage_pct"),
    )
    winner = F.when(F.col("total_valid") == 0, "NO DATA").when(F.col("mse_pred") < F.col("mse_base"), "MODEL WINS").otherwise("BASELINE WINS")
    return out.withColumn("result", winner)


def cross_cube_summary(steps: DataFrame, *, cube: str) -> DataFrame:
    """Mean over a cube's non-empty steps, plus an OVERALL row weighted by valid pixels; improvement in %."""
    cols = {"mse_model": "mse_pred", "mse_base": "mse_base", "mae_model": "mae_pred", "bias": "bias_delta"}
    per_cube = steps.filter(F.col("num_valid") > 0).groupBy(F.col(cube).cast("string").alias("cube_id")).agg(
        *[F.avg(c).alias(k) for k, c in cols.items()], F.sum("num_valid").alias("valid_pixels")
    )
    w = F.col("valid_pixels")
    overall = per_cube.agg(*[F.try_divide(F.sum(F.col(k) * w), F.sum(w)).alias(k) for k in cols], F.sum(w).alias("valid_pixels"))
    overall = overall.select(F.lit("OVERALL").alias("cube_id"), *cols, "valid_pixels")
    both = per_cube.unionByName(overall)
    return both.withColumn("improvement_pct", (1.0 - F.try_divide(F.col("mse_model"), F.col("mse_base"))) * 100.0)


def cross_step_summary(steps: DataFrame, *, step: str) -> DataFrame:
    """Mean over the cubes with data, per step."""
    cols = {"mse_model": "mse_pred", "mse_base": "mse_base", "mae_model": "mae_pred", "bias_delta": "bias_delta"}
    return steps.filter(F.col("num_valid") > 0).groupBy(step).agg(*[F.avg(c).alias(k) for k, c in cols.items()])


# ---- error terms -----------------------------------------------------------------------------------
def _masked_ratio(err: Column, mask: Column) -> Column:
    return F.sum(err * mask) / (F.sum(mask) + 1e-8)


def masked_errors(df: DataFrame, *, keys: list[str] = (), pred: str = "pred", true: str = "true", mask: str = "mask") -> DataFrame:
    """Masked L1 and L2."""
    d, m = F.col(pred).cast("double") - F.col(true).cast("double"), F.col(mask).cast("double")
    return df.groupBy(*keys).agg(_masked_ratio(F.abs(d), m).alias("l1"), _masked_ratio(d * d, m).alias("l2"))


def with_deltas(df: DataFrame, *, cube: list[str], pixel: list[str], step: str = "step") -> DataFrame:
    """Change vs the previous step (the base before the first one) and the joint mask of both steps."""
    w = Window.partitionBy(*cube, *pixel).orderBy(step)
    prev = lambda c, first: F.lag(F.col(c).cast("double")).over(w) if first is None else F.coalesce(
        F.when(F.row_number().over(w) > 1, F.lag(F.col(c).cast("double")).over(w)), F.when(F.row_number().over(w) == 1, first)
    )
    base = F.col("base").cast("double")
    return df.withColumns(
        {
            "d_true": F.col("true").cast("double") - prev("true", base),
            "d_pred": F.col("pred").cast("double") - prev("pred", base),
            "mask_delta": F.col("mask") * F.coalesce(prev("mask", F.lit(1.0)), F.lit(0.0)),
        }
    )


def gradient_errors(
    df: DataFrame, *, cube: list[str], y: str = "y", x: str = "x", step: str = "step",
    alpha: float = 1.0, beta: float = 1.0, gamma: float = 1.0, keys: list[str] = (), block: int = 256,
) -> DataFrame:
    """Value, temporal-delta and spatial-gradient errors (L1) and their weighted sum.

    The delta rows are laid out once by blocks of an image, each with the first row and column of the next blocks; both
    neighbour windows refine that partitioning, so no task holds an image, and ``block`` doesn't change the
    result. A pixel whose neighbour is missing has no gradient there, and its mask does not count either.
    """
    d = with_deltas(df, cube=cube, pixel=[y, x], step=step)
    d = with_halo(d, y=y, x=x, block=block, before=0, after=1).repartition(*cube, step, "_by", "_bx")
    for name, line, along in (("x", y, x), ("y", x, y)):
        w = Window.partitionBy(*cube, step, "_by", "_bx", line).orderBy(along)
        next_ = F.lead(along).over(w) == F.col(along) + 1
        gap = F.abs((F.lead("d_pred").over(w) - F.col("d_pred")) - (F.lead("d_true").over(w) - F.col("d_true")))
        d = d.withColumns({f"_g{name}": F.when(next_, gap), f"_m{name}": F.when(next_, F.col("mask_delta").cast("double"))})
    d = d.filter("_own")
    err = F.abs(F.col("pred").cast("double") - F.col("true").cast("double"))
    out = d.groupBy(*keys).agg(
        _masked_ratio(err, F.col("mask").cast("double")).alias("value_error"),
        _masked_ratio(F.abs(F.col("d_pred") - F.col("d_true")), F.col("mask_delta").cast("double")).alias("delta_error"),
        (_masked_ratio(F.col("_gx"), F.col("_mx")) + _masked_ratio(F.col("_gy"), F.col("_my"))).alias("gradient_error"),
    )
    total = alpha * F.col("value_error") + beta * F.col("delta_error") + gamma * F.col("gradient_error")
    return out.withColumn("combined_error", total)


def change_summary(df: DataFrame, *, cube: list[str], pixel: list[str], step: str = "step", veg: str = "is_veg") -> DataFrame:
    """Mean change vs the previous step on doubly valid pixels, vs the base, mean error, predicted change
    over all vegetation; 0 where no pixel qualifies."""
    d = with_deltas(df, cube=cube, pixel=pixel, step=step)
    ok, both, land = F.col("mask") > 0.5, F.col("mask_delta") > 0.5, F.col(veg) > 0.5
    t, p, b = (F.col(c).cast("double") for c in ("true", "pred", "base"))
    mean = lambda c, on: F.coalesce(F.avg(F.when(on, c)), F.lit(0.0))
    return d.groupBy(*cube, step).agg(
        mean(F.col("d_true"), both).alias("change_vs_previous"), mean(t - b, ok).alias("change_vs_base"),
        mean(p - t, ok).alias("error"), mean(p - b, land).alias("predicted_change"),
    )


def change_histogram(df: DataFrame, *, cube: list[str], pixel: list[str], step: str = "step", low: float = -1.0, high: float = 1.0, bins: int = 64) -> DataFrame:
    """Histogram of true and predicted change per step over valid pixels (buckets 0 and bins+1 are outside)."""
    d = with_deltas(df, cube=cube, pixel=pixel, step=step).filter(F.col("mask") > 0.5)
    pair = F.array(
        F.struct(F.lit("true").alias("series"), F.col("d_true").alias("v")), F.struct(F.lit("pred").alias("series"), F.col("d_pred").alias("v"))
    )
    bucket = F.width_bucket("v", F.lit(low), F.lit(high), F.lit(bins))
    return d.select(step, F.inline(pair)).filter(F.col("v").isNotNull()).groupBy(step, "series", bucket.alias("bucket")).agg(n_rows().alias("n"))


# ---- identity across configurations ----------------------------------------------------------------
def data_signature(df: DataFrame, *, cube: list[str], keys: list[str], values=("true", "mask", "base")) -> DataFrame:
    """Order-free fingerprint of a cube's data, equal when the rows are equal."""
    return df.groupBy(*cube).agg(rows_signature(*[F.col(c) for c in [*keys, *values]]).alias("signature"), n_rows().alias("n_rows"))


def alignment_check(cubes: DataFrame, *, cube: str = "cube_id", configuration: str = "configuration") -> DataFrame:
    """Cubes that break comparability: missing from a configuration, or several signatures or folds."""
    n_conf = cubes.select(configuration).distinct().agg(n_rows().alias("_n")).select("_n").scalar()
    fold = F.coalesce(F.col("fold").cast("string"), F.lit("<null>"))
    per = cubes.groupBy(cube).agg(
        F.count_distinct(configuration).alias("n_configurations"), F.count_distinct("data_signature").alias("n_signatures"), F.count_distinct(fold).alias("n_folds")
    )
    why = reasons(
        [
            (n_conf < 2, "needs_two_configurations"),
            (F.col("n_configurations") < n_conf, "cube_sets_differ"),
            (F.col("n_signatures") != 1, "data_differs"),
            (F.col("n_folds") != 1, "folds_differ"),
        ]
    )
    return per.withColumn("problem", why)
