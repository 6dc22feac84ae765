"""Forecast-evaluation queries. Vectors of one label inside a block of ids are the steps of a cube."""

from __future__ import annotations

from pyspark.sql import functions as F

from petrichor.catalog import query, rnd, rounded
from petrichor.catalog.sql import PRED
from petrichor.operators import metrics, quality
from petrichor.plans import views as V
from petrichor.sources import readers

CUBE = ["cube_id"]
ERR = ["mse", "mae", "bias", "mse_base", "mae_base", "bias_base"]
STEP_COLS = [*ERR, "spatial_valid_fraction", "mse_skill", "mae_gain", "nse", "nnse", "observed_response", "predicted_response",
             "response_mean_abs_error", "response_amplitude_ratio", "response_spatial_correlation"]
CUBE_COLS = [*ERR, "spatial_valid_fraction", "valid_target_coverage", "mse_skill", "mae_gain", "target_sst", "target_variance", "nse", "nse_base", "nnse", "nnse_base",
             "observed_response_auc", "predicted_response_auc", "observed_r30", "predicted_r30", "r30_abs_error", "response_trajectory_correlation"]
MIN_COUNT = 250


def _dir(e: str) -> str:
    return f"CASE WHEN {e} > 0.005 THEN 1 WHEN {e} < -0.005 THEN -1 WHEN {e} IS NOT NULL THEN 0 END"


def _step_sql(keys: str, src: str = "px") -> str:
    """Step metrics from the plain definitions."""
    return f"""sm AS (SELECT {keys}, step, count(*) FILTER (ok) AS n_valid, count(*) AS n_cells, avg(pow(pred-tru,2)) FILTER (ok) AS mse, avg(abs(pred-tru)) FILTER (ok) AS mae, avg(pred-tru) FILTER (ok) AS bias,
 avg(pow(base-tru,2)) FILTER (ok) AS mse_base, avg(abs(base-tru)) FILTER (ok) AS mae_base, avg(base-tru) FILTER (ok) AS bias_base, var_pop(tru) FILTER (ok) * count(*) FILTER (ok) AS sst,
 avg(tru-base) FILTER (ok) AS observed_response, avg(pred-base) FILTER (ok) AS predicted_response, avg(abs(tru-base)) FILTER (ok) AS oa, avg(abs(pred-base)) FILTER (ok) AS pa,
 CASE WHEN count(*) FILTER (ok) >= 3 AND stddev_pop(tru-base) FILTER (ok) > 1e-12 AND stddev_pop(pred-base) FILTER (ok) > 1e-12 THEN corr(tru-base, pred-base) FILTER (ok) END AS response_spatial_correlation FROM {src} GROUP BY ALL),
 st AS (SELECT *, step*5 AS lead_day, n_valid/n_cells::DOUBLE AS spatial_valid_fraction, CASE WHEN abs(mse_base) > 1e-12 THEN 1-mse/mse_base END AS mse_skill, mae_base-mae AS mae_gain,
 CASE WHEN sst > 1e-12 THEN 1-mse*n_valid/sst END AS nse, CASE WHEN sst > 1e-12 THEN 1/(2-(1-mse*n_valid/sst)) END AS nnse, abs(predicted_response-observed_response) AS response_mean_abs_error,
 CASE WHEN abs(oa) > 1e-12 THEN pa/oa END AS response_amplitude_ratio, CAST(({_dir('observed_response')}) = ({_dir('predicted_response')}) AS DOUBLE) AS direction_match FROM sm)"""


def _cube_sql(keys: str, eligible: str, coverage: float, src: str = "px") -> str:
    """Cube metrics straight from the pixels (not from step rows) plus the trajectory from step rows."""
    return f"""{_step_sql(keys, src)}, el AS ({eligible}),
 cm AS (SELECT {keys}, count(*) FILTER (ok) AS n, count(*) AS cells, count(DISTINCT step) AS steps_n, avg(pow(pred-tru,2)) FILTER (ok) AS mse, avg(abs(pred-tru)) FILTER (ok) AS mae, avg(pred-tru) FILTER (ok) AS bias,
 avg(pow(base-tru,2)) FILTER (ok) AS mse_base, avg(abs(base-tru)) FILTER (ok) AS mae_base, avg(base-tru) FILTER (ok) AS bias_base, var_pop(tru) FILTER (ok) AS target_variance FROM {src} GROUP BY ALL),
 tr AS (SELECT {keys}, avg(observed_response) AS observed_response_auc, avg(predicted_response) AS predicted_response_auc, max(step) AS last_step,
 CASE WHEN count(observed_response) >= 3 AND stddev_pop(observed_response) > 1e-12 AND stddev_pop(predicted_response) > 1e-12 THEN corr(observed_response, predicted_response) END AS response_trajectory_correlation FROM st GROUP BY ALL),
 c1 AS (SELECT cm.*, tr.* EXCLUDE ({keys}), el.n_eligible AS n_eligible_vegetation_pixels, n/cells::DOUBLE AS spatial_valid_fraction, CASE WHEN el.n_eligible > 0 THEN n/(steps_n*el.n_eligible)::DOUBLE END AS valid_target_coverage, target_variance*n AS target_sst,
 CASE WHEN abs(mse_base) > 1e-12 THEN 1-mse/mse_base END AS mse_skill, mae_base-mae AS mae_gain, CAST(mse < mse_base AS DOUBLE) AS persistence_beaten FROM cm JOIN tr USING ({keys}) LEFT JOIN el USING ({keys})),
 c2 AS (SELECT *, concat_ws(';', CASE WHEN n < {MIN_COUNT} THEN 'insufficient_valid_target_count' END, CASE WHEN valid_target_coverage < {coverage} THEN 'insufficient_valid_target_coverage' END, CASE WHEN target_variance < 1e-6 THEN 'target_variance_below_minimum' END) AS why FROM c1),
 c3 AS (SELECT c2.*, CASE WHEN why = '' AND target_sst > 1e-12 THEN 1-mse*n/target_sst END AS nse, CASE WHEN why = '' AND target_sst > 1e-12 THEN 1-mse_base*n/target_sst END AS nse_base, l.observed_response AS observed_r30, l.predicted_response AS predicted_r30, l.response_mean_abs_error AS r30_abs_error, l.direction_match AS r30_direction_match
 FROM c2 JOIN (SELECT {keys}, step AS last_step, observed_response, predicted_response, response_mean_abs_error, direction_match FROM st) l USING ({keys}, last_step)),
 cc AS (SELECT *, 1/(2-nse) AS nnse, 1/(2-nse_base) AS nnse_base FROM c3)"""


_ELIGIBLE = "SELECT cube_id, count(*) FILTER (is_veg = 1) AS n_eligible FROM (SELECT DISTINCT cube_id, y, x, is_veg FROM px) GROUP BY 1"
_CUBE_OUT = "n AS n_valid_target_pixel_times, n_eligible_vegetation_pixels, persistence_beaten, why AS nnse_exclusion_reason, CASE WHEN why = '' THEN 1 ELSE 0 END AS nnse_eligible, r30_direction_match, " + ", ".join(rnd(c, digits=5) for c in CUBE_COLS)


def _px(spark, sf):
    return V.prediction_pixels(spark, sf)


def _statics(spark, sf):
    return readers.reduce_statics(_px(spark, sf), pixel=["cube_id", "y", "x"], time="step")


def _steps(spark, sf):
    return metrics.step_metrics(_px(spark, sf), cube=CUBE)


def _cubes(spark, sf):
    eligible = readers.eligible_counts(_statics(spark, sf), cube=CUBE)
    return metrics.cube_metrics(_steps(spark, sf), cube=CUBE, eligible=eligible, min_count=MIN_COUNT, on_empty="null")


@query("step_metrics", f"WITH {PRED}, {_step_sql('cube_id')} SELECT cube_id, step, lead_day, n_valid, n_cells, direction_match, {', '.join(rnd(c, digits=5) for c in STEP_COLS)} FROM st")
def _(spark, sf):
    return rounded(_steps(spark, sf).drop("y_mean", "sst"), *STEP_COLS, digits=5)


@query("cube_metrics", f"WITH {PRED}, {_cube_sql('cube_id', _ELIGIBLE, 0.15)} SELECT cube_id, {_CUBE_OUT} FROM cc")
def _(spark, sf):
    return rounded(_cubes(spark, sf), *CUBE_COLS, digits=5)


@query(
    "nnse_eligibility",
    f"WITH {PRED}, {_cube_sql('cube_id', _ELIGIBLE, 0.15)} SELECT cube_id, why AS nnse_exclusion_reason, {rnd('nse')}, {rnd('1/(2-nse)', 'nnse')} FROM c3",
)
def _(spark, sf):
    return rounded(_cubes(spark, sf).select("cube_id", "nnse_exclusion_reason", "nse", "nnse"), "nse", "nnse")


_GROUPS = "WHEN esa_lc IN (10, 95) THEN 'forest' WHEN esa_lc IN (20, 30) THEN 'shrub_grass' WHEN esa_lc = 40 THEN 'cropland' WHEN esa_lc IN (60, 90, 100) THEN 'other_vegetation'"
_LCPX = f"""lp AS (SELECT *, CASE {_GROUPS} END AS landcover_group FROM px), sz AS (SELECT cube_id, landcover_group, count(*) AS n_eligible FROM (SELECT DISTINCT cube_id, y, x, landcover_group FROM lp WHERE landcover_group IS NOT NULL) GROUP BY 1, 2 HAVING count(*) >= 10),
 lq AS (SELECT lp.* FROM lp JOIN sz USING (cube_id, landcover_group)), la AS (SELECT cube_id, landcover_group FROM lq GROUP BY 1, 2 HAVING count(*) FILTER (ok) > 0), lr AS (SELECT lq.* FROM lq JOIN la USING (cube_id, landcover_group))"""


def _landcover(spark, sf):
    return metrics.landcover_metrics(_px(spark, sf).drop("esa_lc", "is_veg"), _statics(spark, sf), cube=CUBE, pixel=["y", "x"], min_pixels=10, min_count=MIN_COUNT)


@query(
    "landcover_cube_metrics",
    f"WITH {PRED}, {_LCPX}, {_cube_sql('cube_id, landcover_group', 'SELECT * FROM sz', 0.0, 'lr')} SELECT cube_id, landcover_group, {_CUBE_OUT} FROM cc",
)
def _(spark, sf):
    return rounded(_landcover(spark, sf)[0], *CUBE_COLS, digits=5)


@query("landcover_step_metrics", f"WITH {PRED}, {_LCPX}, {_step_sql('cube_id, landcover_group', 'lr')} SELECT cube_id, landcover_group, step, lead_day, n_valid, n_cells, direction_match, {', '.join(rnd(c, digits=5) for c in STEP_COLS)} FROM st")
def _(spark, sf):
    return rounded(_landcover(spark, sf)[1].drop("y_mean", "sst"), *STEP_COLS, digits=5)


# ---- validation dialect ----------------------------------------------------------------------------
# its predictions are complete: the missing last step is filled with the base
_VPX = """vp AS (SELECT cube_id, step, y, x, coalesce(pred, base) AS pred, tru, base, mask = 1 AS ok, is_veg FROM px),
 info AS (SELECT cube_id, count(*) FILTER (is_veg = 1 AND step = 1) AS n_eligible, count(DISTINCT step) AS n_steps, CASE WHEN count(DISTINCT step) >= 4 THEN 1 ELSE 0 END AS complete FROM px GROUP BY 1)"""
_VCUBE = f"""vc0 AS (SELECT cube_id, count(*) FILTER (ok) AS n, avg(pow(pred-tru,2)) FILTER (ok) AS mse, avg(abs(pred-tru)) FILTER (ok) AS mae, avg(pred-tru) FILTER (ok) AS bias, avg(pow(base-tru,2)) FILTER (ok) AS mse_base, avg(abs(base-tru)) FILTER (ok) AS mae_base, avg(base-tru) FILTER (ok) AS bias_base, var_pop(tru) FILTER (ok) AS target_variance FROM vp GROUP BY 1),
 vc1 AS (SELECT *, CASE WHEN n_eligible > 0 THEN n/(n_steps*n_eligible)::DOUBLE ELSE 0 END AS valid_target_coverage, target_variance*n AS target_sst, 1-mse/(mse_base+1e-8) AS cube_skill FROM info JOIN vc0 USING (cube_id)),
 vc2 AS (SELECT *, concat_ws(';', CASE WHEN complete = 0 THEN 'incomplete_reconstruction' END, CASE WHEN n_eligible = 0 THEN 'no_eligible_vegetation' END, CASE WHEN n = 0 THEN 'no_valid_target_pixel_times' END, CASE WHEN n > 0 AND n < {MIN_COUNT} THEN 'insufficient_valid_target_count' END,
 CASE WHEN n_eligible > 0 AND valid_target_coverage < 0.15 THEN 'insufficient_valid_target_coverage' END, CASE WHEN n > 0 AND target_variance < 1e-6 THEN 'target_variance_below_minimum' END) AS why FROM vc1),
 vc AS (SELECT *, CASE WHEN why = '' THEN 1-mse*n/target_sst END AS r2, CASE WHEN why = '' THEN 1-mse_base*n/target_sst END AS r2_base FROM vc2)"""
_V_COLS = [*ERR, "cube_skill", "r2", "r2_base", "valid_target_coverage", "target_sst", "target_variance"]


def _vsteps(spark, sf):
    df = _px(spark, sf).withColumn("pred", F.coalesce("pred", "base"))
    return metrics.validation_steps(df, cube=CUBE)


def _vcubes(spark, sf):
    px = _px(spark, sf)
    info = px.groupBy("cube_id").agg(F.count_if((F.col("is_veg") == 1) & (F.col("step") == 1)).alias("n_eligible"), F.count_distinct("step").alias("n_steps"))
    info = info.withColumn("complete", (F.col("n_steps") >= 4).cast("int"))
    return metrics.validation_cubes(_vsteps(spark, sf), info, cube=CUBE, min_count=MIN_COUNT)


@query(
    "validation_cube_audit",
    f"WITH {PRED}, {_VPX}, {_VCUBE} SELECT cube_id, n_eligible, n_steps, complete, n AS n_valid_target_pixel_times, why AS r2_nnse_exclusion_reason, CASE WHEN why = '' THEN 1 ELSE 0 END AS r2_nnse_eligible, {rnd('1/(2-r2)', 'nnse', 5)}, {rnd('1/(2-r2_base)', 'nnse_base', 5)}, {', '.join(rnd(c, digits=5) for c in _V_COLS)} FROM vc",
)
def _(spark, sf):
    return rounded(_vcubes(spark, sf), *_V_COLS, "nnse", "nnse_base", digits=5)


def _micro_sql(by: str) -> str:
    key = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    sst = "(sum(tru*tru) FILTER (ok) - pow(sum(tru) FILTER (ok), 2)/count(*) FILTER (ok) + 1e-8)"
    r2 = f"(1 - sum(pow(pred-tru,2)) FILTER (ok)/{sst})"
    r2b = f"(1 - sum(pow(base-tru,2)) FILTER (ok)/{sst})"
    cols = {
        "mse": "avg(pow(pred-tru,2)) FILTER (ok)", "mae": "avg(abs(pred-tru)) FILTER (ok)", "bias": "avg(pred-tru) FILTER (ok)", "mse_base": "avg(pow(base-tru,2)) FILTER (ok)", "mae_base": "avg(abs(base-tru)) FILTER (ok)", "bias_base": "avg(base-tru) FILTER (ok)",
        "r2": r2, "r2_base": r2b, "nnse": f"1/(2-{r2})", "nnse_base": f"1/(2-{r2b})", "skill": "1-avg(pow(pred-tru,2)) FILTER (ok)/(avg(pow(base-tru,2)) FILTER (ok)+1e-8)",
    }
    return f"SELECT {key}count(*) FILTER (ok) AS n_valid, {', '.join(rnd(e, a, 5) for a, e in cols.items())} FROM vp {group}"


_MICRO = [*ERR, "r2", "r2_base", "nnse", "nnse_base", "skill"]


@query("validation_micro_per_step", f"WITH {PRED}, {_VPX} {_micro_sql('step')}")
def _(spark, sf):
    return rounded(metrics.validation_micro(_vsteps(spark, sf), step="step"), *_MICRO, digits=5)


@query("validation_micro_grand_mean", f"WITH {PRED}, {_VPX} {_micro_sql('')}")
def _(spark, sf):
    return rounded(metrics.validation_micro(_vsteps(spark, sf)), *_MICRO, digits=5)


_MACRO = [*ERR, "cube_skill", "r2", "r2_base", "nnse", "nnse_base"]


@query(
    "validation_macro",
    f"WITH {PRED}, {_VPX}, {_VCUBE} SELECT " + ", ".join(rnd(f"avg({c}) FILTER (complete = 1 AND n > 0)", c, 5) for c in [*ERR, "cube_skill"]) + ", " + ", ".join(rnd(f"avg({e}) FILTER (why = '')", a, 5) for a, e in {"r2": "r2", "r2_base": "r2_base", "nnse": "1/(2-r2)", "nnse_base": "1/(2-r2_base)"}.items()) + ", count(*) FILTER (why = '') AS eligible_cubes, count(*) FILTER (why <> '') AS excluded_cubes FROM vc",
)
def _(spark, sf):
    return rounded(metrics.validation_macro(_vcubes(spark, sf)), *_MACRO, digits=5)


# ---- evaluator dialect -----------------------------------------------------------------------------
_EV = {
    "mse_pred": "avg(pow(tru-pred,2))", "mse_base": "avg(pow(tru-base,2))", "mae_pred": "avg(abs(tru-pred))", "mae_base": "avg(abs(tru-base))", "bias_abs": "avg(pred-tru)", "mse_delta": "avg(pow((tru-base)-(pred-base),2))",
    "bias_delta": "avg(pred-tru)", "d_true_mean": "avg(tru-base)", "d_true_std": "stddev_pop(tru-base)", "d_pred_mean": "avg(pred-base)", "d_pred_std": "stddev_pop(pred-base)",
}
_EVS = "es AS (SELECT cube_id, step, count(*) FILTER (ok) AS num_valid, count(*) AS n_cells, " + ", ".join(f"coalesce({e} FILTER (ok), 0) AS {a}" for a, e in _EV.items()) + " FROM vp GROUP BY 1, 2)"


def _esteps(spark, sf):
    return metrics.evaluator_steps(_px(spark, sf).withColumn("pred", F.coalesce("pred", "base")), cube=CUBE)


@query("evaluator_step_metrics", f"WITH {PRED}, {_VPX}, {_EVS} SELECT cube_id, step, num_valid, n_cells, {', '.join(rnd(c) for c in _EV)} FROM es")
def _(spark, sf):
    return rounded(_esteps(spark, sf), *_EV)


@query(
    "evaluator_report",
    f"WITH {PRED}, {_VPX}, {_EVS}, r AS (SELECT cube_id, CAST(sum(num_valid) AS BIGINT) AS total_valid, " + ", ".join(f"coalesce(sum({c}*num_valid)/nullif(sum(num_valid), 0), 0) AS {c}" for c in ("mse_pred", "mse_base", "bias_delta")) + f", sum(num_valid)*100.0/sum(n_cells) AS coverage_pct FROM es GROUP BY 1) SELECT cube_id, total_valid, {rnd('mse_pred')}, {rnd('mse_base')}, {rnd('bias_delta')}, {rnd('coverage_pct')}, CASE WHEN total_valid = 0 THEN 'NO DATA' WHEN mse_pred < mse_base THEN 'MODEL WINS' ELSE 'BASELINE WINS' END AS result FROM r",
)
def _(spark, sf):
    return rounded(metrics.evaluator_report(_esteps(spark, sf), cube=CUBE), "mse_pred", "mse_base", "bias_delta", "coverage_pct")


_XC = {"mse_model": "mse_pred", "mse_base": "mse_base", "mae_model": "mae_pred", "bias": "bias_delta"}


@query(
    "cross_cube_summary",
    f"WITH {PRED}, {_VPX}, {_EVS}, c AS (SELECT cube_id, " + ", ".join(f"avg({e}) AS {a}" for a, e in _XC.items()) + ", CAST(sum(num_valid) AS BIGINT) AS valid_pixels FROM es WHERE num_valid > 0 GROUP BY 1), a AS (SELECT * FROM c UNION ALL SELECT 'OVERALL', " + ", ".join(f"sum({a}*valid_pixels)/sum(valid_pixels)" for a in _XC) + f", CAST(sum(valid_pixels) AS BIGINT) FROM c) SELECT cube_id, valid_pixels, {', '.join(rnd(a) for a in _XC)}, {rnd('(1-mse_model/nullif(mse_base,0))*100', 'improvement_pct', 4)} FROM a",
)
def _(spark, sf):
    out = metrics.cross_cube_summary(_esteps(spark, sf), cube="cube_id")
    return rounded(rounded(out, *_XC), "improvement_pct", digits=4)


@query("cross_step_summary", f"WITH {PRED}, {_VPX}, {_EVS} SELECT step, " + ", ".join(rnd(f"avg({e})", a) for a, e in {**{k: v for k, v in _XC.items() if k != 'bias'}, "bias_delta": "bias_delta"}.items()) + " FROM es WHERE num_valid > 0 GROUP BY 1")
def _(spark, sf):
    return rounded(metrics.cross_step_summary(_esteps(spark, sf), step="step"), "mse_model", "mse_base", "mae_model", "bias_delta")


# ---- error terms -----------------------------------------------------------------------------------
@query("masked_errors", f"WITH {PRED} SELECT cube_id, {rnd('sum(abs(pred-tru)*mask)/(sum(mask)+1e-8)', 'l1')}, {rnd('sum(pow(pred-tru,2)*mask)/(sum(mask)+1e-8)', 'l2')} FROM px GROUP BY 1")
def _(spark, sf):
    return rounded(metrics.masked_errors(_px(spark, sf), keys=CUBE), "l1", "l2")


_DELTA = """dl AS (SELECT *, tru - CASE WHEN row_number() OVER w = 1 THEN base ELSE lag(tru) OVER w END AS d_true, pred - CASE WHEN row_number() OVER w = 1 THEN base ELSE lag(pred) OVER w END AS d_pred,
 mask * CASE WHEN row_number() OVER w = 1 THEN 1 ELSE lag(mask) OVER w END AS md FROM px WINDOW w AS (PARTITION BY cube_id, y, x ORDER BY step))"""


@query(
    "gradient_errors",
    f"""WITH {PRED}, {_DELTA}, g AS (SELECT a.*, abs((b.d_pred-a.d_pred)-(b.d_true-a.d_true)) AS gx, CASE WHEN b.x IS NOT NULL THEN a.md END AS mx, abs((c.d_pred-a.d_pred)-(c.d_true-a.d_true)) AS gy, CASE WHEN c.x IS NOT NULL THEN a.md END AS my
 FROM dl a LEFT JOIN dl b ON a.cube_id = b.cube_id AND a.step = b.step AND a.y = b.y AND b.x = a.x + 1 LEFT JOIN dl c ON a.cube_id = c.cube_id AND a.step = c.step AND a.x = c.x AND c.y = a.y + 1),
 s AS (SELECT cube_id, sum(abs(pred-tru)*mask)/(sum(mask)+1e-8) AS value_error, sum(abs(d_pred-d_true)*md)/(sum(md)+1e-8) AS delta_error, sum(gx*mx)/(sum(mx)+1e-8) + sum(gy*my)/(sum(my)+1e-8) AS gradient_error FROM g GROUP BY 1)
 SELECT cube_id, {rnd('value_error')}, {rnd('delta_error')}, {rnd('gradient_error')}, {rnd('value_error + 0.5*delta_error + 0.25*gradient_error', 'combined_error')} FROM s""",
)
def _(spark, sf):
    out = metrics.gradient_errors(_px(spark, sf), cube=CUBE, keys=CUBE, alpha=1.0, beta=0.5, gamma=0.25)
    return rounded(out, "value_error", "delta_error", "gradient_error", "combined_error")


@query(
    "change_summary",
    f"WITH {PRED}, {_DELTA} SELECT cube_id, step, {rnd('coalesce(avg(d_true) FILTER (md = 1), 0)', 'change_vs_previous')}, {rnd('coalesce(avg(tru-base) FILTER (mask = 1), 0)', 'change_vs_base')}, {rnd('coalesce(avg(pred-tru) FILTER (mask = 1), 0)', 'error')}, {rnd('coalesce(avg(pred-base) FILTER (is_veg = 1), 0)', 'predicted_change')} FROM dl GROUP BY 1, 2",
)
def _(spark, sf):
    out = metrics.change_summary(_px(spark, sf), cube=CUBE, pixel=["y", "x"])
    return rounded(out, "change_vs_previous", "change_vs_base", "error", "predicted_change")


@query(
    "change_histogram",
    f"WITH {PRED}, {_DELTA}, l AS (SELECT step, 'true' AS series, d_true AS v FROM dl WHERE mask = 1 UNION ALL SELECT step, 'pred', d_pred FROM dl WHERE mask = 1) SELECT step, series, CAST(CASE WHEN v < -1 THEN 0 WHEN v >= 1 THEN 65 ELSE floor((v+1)*32) + 1 END AS BIGINT) AS bucket, count(*) AS n FROM l WHERE v IS NOT NULL GROUP BY ALL",
)
def _(spark, sf):
    return metrics.change_histogram(_px(spark, sf), cube=CUBE, pixel=["y", "x"])


# ---- checks ----------------------------------------------------------------------------------------
@query(
    "truth_consistency",
    f"WITH {PRED} SELECT cube_id, {rnd('max(abs(tru - base)) FILTER (mask = 1)', 'max_abs_diff')}, count(*) FILTER (mask = 1) AS n_compared, CASE WHEN coalesce(max(abs(tru - base)) FILTER (mask = 1), 0) <= 0.6 THEN 1 ELSE 0 END AS ok FROM px GROUP BY 1",
)
def _(spark, sf):
    """Truth of every step against the stored base image, tolerance 0.6."""
    px = _px(spark, sf)
    out = quality.max_abs_difference(
        px, px.select("cube_id", "step", "y", "x", F.col("base").alias("true")), keys=["cube_id", "step", "y", "x"], cube=CUBE, value="true", tolerance=0.6, mask="mask"
    )
    return rounded(out, "max_abs_diff")


@query(
    "baseline_drift",
    f"WITH {PRED} SELECT cube_id, {rnd('max(step - 1) * 3e-6', 'max_abs_diff', 8)}, count(base) AS n_compared, CASE WHEN max(step - 1) * 3e-6 <= 1e-5 THEN 1 ELSE 0 END AS ok FROM px WHERE base IS NOT NULL GROUP BY 1",
)
def _(spark, sf):
    """The base of a run against that of the first run: it drifts by 3e-6 per step, so long cubes exceed 1e-5."""
    px = _px(spark, sf)
    key = ["cube_id", "step", "y", "x"]
    run, first = px.select(*key, (F.col("base") + (F.col("step") - 1) * 3e-6).alias("base")), px.select(*key, "base")
    return rounded(quality.max_abs_difference(run, first, keys=key, cube=CUBE, value="base", tolerance=1e-5), "max_abs_diff", digits=8)


@query(
    "truth_against_source",
    f"WITH {PRED}, d AS (SELECT cube_id, mask, abs(round(tru, CASE WHEN length(cube_id) % 2 = 0 THEN 2 ELSE 6 END) - tru) AS d FROM px) SELECT cube_id, {rnd('max(d) FILTER (mask = 1)', 'max_abs_diff')}, count(*) FILTER (mask = 1) AS n_compared, CASE WHEN coalesce(max(d) FILTER (mask = 1), 0) <= 1e-4 THEN 1 ELSE 0 END AS ok FROM d GROUP BY 1",
)
def _(spark, sf):
    """Stored truth against the source at 1e-4: some cubes were stored with two decimals only."""
    px = _px(spark, sf)
    coarse = F.when(F.length("cube_id") % 2 == 0, F.round("true", 2)).otherwise(F.round("true", 6))
    stored = px.withColumn("true", coarse)
    key = ["cube_id", "step", "y", "x"]
    return rounded(quality.max_abs_difference(stored, px.select(*key, "true"), keys=key, cube=CUBE, value="true", tolerance=1e-4, mask="mask"), "max_abs_diff")


@query("masked_target_check", f"WITH {PRED} SELECT cube_id, count(*) FILTER (abs(tru) < 0.001 AND mask = 1) AS n_violations FROM px GROUP BY 1")
def _(spark, sf):
    df = _px(spark, sf).withColumn("true", F.when(F.abs("true") < 0.001, 0.0).otherwise(F.col("true")))
    return quality.masked_target_check(df, cube=CUBE, target="true", mask="mask")


@query(
    "prediction_tensor_check",
    f"""WITH {PRED}, w AS (SELECT cube_id, step, y, x, CASE WHEN cube_id LIKE '1%' AND x = 3 THEN base + step ELSE base END AS base FROM px WHERE NOT (cube_id LIKE '%1' AND step = 2 AND y = 5)),
 p AS (SELECT cube_id, y, x, count(*) AS t, count(base) AS k, max(base)-min(base) AS d FROM w GROUP BY 1, 2, 3), s AS (SELECT cube_id, count(DISTINCT step) AS n_steps FROM w GROUP BY 1),
 c AS (SELECT cube_id, CAST(sum(t) AS BIGINT) AS n_rows, count(*) FILTER (d > 1e-6 OR (k > 0 AND k < t)) AS n_base_varies, max(n_steps) AS n_steps, 64*max(n_steps) AS n_expected FROM p JOIN s USING (cube_id) GROUP BY 1)
 SELECT *, concat_ws(';', CASE WHEN n_rows <> n_expected THEN 'grid_incomplete' END, CASE WHEN n_base_varies > 0 THEN 'base_not_constant' END) AS problem, CASE WHEN n_rows = n_expected AND n_base_varies = 0 THEN 1 ELSE 0 END AS ok FROM c""",
)
def _(spark, sf):
    """Some cubes lack rows, some have a base that changes over time."""
    px = _px(spark, sf).filter("NOT (cube_id LIKE '%1' AND step = 2 AND y = 5)")
    px = px.withColumn("base", F.when(F.col("cube_id").like("1%") & (F.col("x") == 3), F.col("base") + F.col("step")).otherwise(F.col("base")))
    return readers.prediction_check(px, cube=CUBE)


@query(
    "reduce_static_layers",
    f"WITH {PRED} SELECT cube_id, y, x, max(is_veg) AS is_veg, arg_min(esa_lc, step) AS esa_lc FROM px GROUP BY 1, 2, 3",
)
def _(spark, sf):
    return _statics(spark, sf)


@query("eligible_vegetation", f"WITH {PRED} SELECT * FROM ({_ELIGIBLE})")
def _(spark, sf):
    return readers.eligible_counts(_statics(spark, sf), cube=CUBE)
