"""Result-table statistics on ``orders``: configuration = priority, cube = customer, fold = customer mod 3.

All intervals come from the operators' default of 5000 replicates, each drawn from all rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from petrichor.catalog import query, rnd, rounded
from petrichor.catalog.sql import CT, META, order_hash
from petrichor.operators import meta, metrics, selection, stats
from petrichor.plans import views as V
from petrichor.session import reused

B, SEED = 5000, 777
CI = ["estimate", "ci_low", "ci_high"]
OUT = ", ".join(rnd(c, digits=5) for c in CI)


def _start(keys: list[str]) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', '{SEED}'{''.join(', ' + k for k in keys)})), 1, 8) AS BIGINT)"


def _picks(source: str, keep: str) -> str:
    """(keep, rep, pick) for every draw of rows (keep, start, slot, n): 32 hashed bits scaled to the group's size."""
    x = f"SELECT {keep}rep, n, (start + rep * 2654435761::BIGINT + slot * 2246822507::BIGINT) % 4294967296 AS x FROM {source}, (SELECT CAST(unnest(range({B})) AS BIGINT) AS rep)"
    for shift, factor in ((16, 0x7FEB352D), (15, 0x5BD1E995)):
        x = f"SELECT {keep}rep, n, (xor(x, x >> {shift}) * {factor}::BIGINT) % 4294967296 AS x FROM ({x})"
    return f"SELECT {keep}rep, (xor(x, x >> 16) * n) >> 32 AS pick FROM ({x})"


def _boot_sql(src: str, groups: list[str], strata: list[str], unique: str, metrics_: list[str], ratios: dict[str, tuple[str, str]] | None = None, prefix: str = "b") -> str:
    """Same draws as the Spark side: numbered rows, hashed picks, means per replicate. Ends with ``<prefix>_out``."""
    keys = [*groups, *strata]
    ks = "".join(f"{k}, " for k in keys)
    gs = "".join(f"{g}, " for g in groups)
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    ratios = ratios or {}
    pay = list(dict.fromkeys([*metrics_, *[c for nd in ratios.values() for c in nd]]))
    same = " AND ".join([f"d.{k} IS NOT DISTINCT FROM n.{k}" for k in keys] + ["d.pick = n.slot"])
    def agg(source: str, extra: str, name: str) -> str:
        inner = ", ".join(f"avg({m}) AS {m}" for m in metrics_)
        rat = "".join(f", CASE WHEN abs(avg({b})) > 1e-12 THEN 1 - avg({a})/avg({b}) END AS {k}" for k, (a, b) in ratios.items())
        if not strata:
            return f"{name} AS (SELECT {gs}{extra}{inner}{rat} FROM {source} GROUP BY ALL)" if (gs or extra) else f"{name} AS (SELECT {inner}{rat} FROM {source})"
        return f"{name} AS (SELECT {gs}{extra}{inner} FROM (SELECT {ks}{extra}{inner} FROM {source} GROUP BY ALL) GROUP BY ALL)"
    names_all = [*metrics_, *ratios]
    p = prefix
    melt = lambda t, v, extra="": " UNION ALL ".join(f"SELECT {gs}{extra}'{m}' AS metric, {m} AS {v} FROM {t}" for m in names_all)
    join_g = " AND ".join(["e.metric = c.metric"] + [f"e.{g} IS NOT DISTINCT FROM c.{g}" for g in groups])
    join_n = " AND ".join([f"e.{g} IS NOT DISTINCT FROM k.{g}" for g in groups]) or "true"
    return f"""{p}_n AS (SELECT {_start([*(groups or ['1']), *strata])} AS start, {ks}{unique}{''.join(', ' + x for x in pay if x != unique)}, row_number() OVER ({part} ORDER BY {order_hash(SEED, unique)}, {unique}) - 1 AS slot, count(*) OVER ({part}) AS n FROM {src}),
 {p}_d AS ({_picks(p + '_n', ks)}),
 {p}_r AS (SELECT {''.join('d.' + k + ', ' for k in keys)}d.rep, {', '.join('n.' + x for x in pay)} FROM {p}_d d JOIN {p}_n n ON {same}),
 {agg(src, '', p + '_e')}, {agg(p + '_r', 'rep, ', p + '_s')}, {p}_em AS ({melt(p + '_e', 'estimate')}), {p}_sm AS ({melt(p + '_s', 'v')}),
 {p}_ci AS (SELECT {gs}metric, quantile_cont(v, 0.025) AS ci_low, quantile_cont(v, 0.975) AS ci_high FROM {p}_sm GROUP BY ALL), {p}_k AS (SELECT {gs}count(DISTINCT {unique}) AS n_cubes FROM {src} {'GROUP BY ALL' if groups else ''}),
 {p}_out AS (SELECT e.*, ci_low, ci_high, n_cubes FROM {p}_em e JOIN {p}_ci c ON {join_g} JOIN {p}_k k ON {join_n})"""


def _melt_sql(src: str, keys: str, metrics_: list[str], value: str = "value") -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{m}' AS metric_name, {m} AS {value} FROM {src} WHERE {m} IS NOT NULL" for m in metrics_)


def _ct(spark, sf):
    return V.result_cubes(spark, sf)


# ---- intervals and bootstrap -----------------------------------------------------------------------
@query("percentile_interval", f"WITH {CT} SELECT configuration, {rnd('quantile_cont(mae, 0.025)', 'ci_low')}, {rnd('quantile_cont(mae, 0.975)', 'ci_high')} FROM ct GROUP BY 1")
def _(spark, sf):
    return rounded(stats.percentile_interval(_ct(spark, sf), keys=["configuration"], value="mae"), "ci_low", "ci_high")


@query("global_percentile_interval", f"SELECT {rnd('quantile_cont(l_extendedprice, 0.025)', 'ci_low')}, {rnd('quantile_cont(l_extendedprice, 0.975)', 'ci_high')} FROM lineitem")
def _(spark, sf):
    return rounded(stats.percentile_interval(V.table(spark, sf, "lineitem", "l_extendedprice"), keys=[], value="l_extendedprice"), "ci_low", "ci_high")


@query("cube_bootstrap", f"WITH {CT}, {_boot_sql('ct', ['configuration'], [], 'cube_id', ['mae', 'nnse'], {'mse_skill_ratio': ('mse', 'mse_base')})} SELECT configuration, metric, n_cubes, {OUT} FROM b_out")
def _(spark, sf):
    out = stats.bootstrap(_ct(spark, sf), groups=["configuration"], unique=["cube_id"], metrics=["mae", "nnse"], ratios={"mse_skill_ratio": ("mse", "mse_base")}, n_boot=B, seed=SEED)
    return rounded(out, *CI, digits=5)


@query("fold_stratified_bootstrap", f"WITH {CT}, {_boot_sql('ct', ['configuration'], ['fold'], 'cube_id', ['mae', 'nnse'])} SELECT configuration, metric, n_cubes, {OUT} FROM b_out")
def _(spark, sf):
    out = stats.bootstrap(_ct(spark, sf), groups=["configuration"], strata=["fold"], unique=["cube_id"], metrics=["mae", "nnse"], n_boot=B, seed=SEED)
    return rounded(out, *CI, digits=5)


_G = ["mae_gain", "mse_skill", "observed_r30"]


@query("grouped_bootstrap", f"WITH {CT}, m AS ({_melt_sql('ct', 'configuration, cube_id', ['mae', 'nnse'])}), {_boot_sql('m', ['configuration', 'metric_name'], [], 'cube_id', ['value'])} SELECT configuration, metric_name AS metric, n_cubes, {OUT} FROM b_out")
def _(spark, sf):
    return rounded(stats.grouped_bootstrap(_ct(spark, sf), group="configuration", unique=["cube_id"], metrics=["mae", "nnse"], n_boot=B, seed=SEED), *CI, digits=5)


_CV = ["fold_macro_nnse", "mae", "mse_skill", "persistence_win_rate", "bias"]
_CVT = "cv AS (SELECT *, nnse AS fold_macro_nnse, persistence_beaten AS persistence_win_rate FROM ct)"


@query("cv_summary", f"WITH {CT}, {_CVT}, {_boot_sql('cv', ['configuration'], ['fold'], 'cube_id', _CV)} SELECT configuration, metric, n_cubes, (SELECT count(DISTINCT fold) FROM ct WHERE ct.configuration = b_out.configuration) AS n_folds, {OUT} FROM b_out")
def _(spark, sf):
    return rounded(stats.cv_summary(_ct(spark, sf), n_boot=B, seed=SEED), *CI, digits=5)


@query("cv_fold_table", f"WITH {CT} SELECT configuration, fold, count(DISTINCT cube_id) AS n_cubes, {rnd('avg(nnse)', 'macro_nnse')}, {rnd('avg(mae)', 'macro_mae')}, {rnd('avg(mse_skill)', 'macro_mse_skill')}, {rnd('avg(persistence_beaten)', 'persistence_win_rate')} FROM ct GROUP BY 1, 2")
def _(spark, sf):
    return rounded(stats.cv_folds(_ct(spark, sf)), "macro_nnse", "macro_mae", "macro_mse_skill", "persistence_win_rate")


_PAIRS = "pr AS (SELECT a.cube_id, a.fold, a.configuration AS left_configuration, b.configuration AS right_configuration, b.nnse-a.nnse AS nnse, b.mse_skill-a.mse_skill AS mse_skill, b.mae-a.mae AS mae FROM ct a JOIN ct b ON a.cube_id = b.cube_id AND a.fold = b.fold AND a.configuration < b.configuration)"
_M3 = ["nnse", "mse_skill", "mae"]


@query("pair_configurations", f"WITH {CT}, {_PAIRS} SELECT cube_id, fold, left_configuration, right_configuration, {', '.join(rnd(m) for m in _M3)} FROM pr")
def _(spark, sf):
    return rounded(stats.pair_configurations(_ct(spark, sf), _M3), *_M3)


@query(
    "paired_contrasts",
    f"WITH {CT}, {_PAIRS}, m AS ({_melt_sql('pr', 'cube_id, fold, left_configuration, right_configuration', _M3, 'difference')}), {_boot_sql('m', ['left_configuration', 'right_configuration', 'metric_name'], ['fold'], 'cube_id', ['difference'])} SELECT left_configuration, right_configuration, metric_name AS metric, n_cubes, CASE WHEN metric_name <> 'mae' THEN 1 ELSE 0 END AS higher_is_better, {OUT} FROM b_out",
)
def _(spark, sf):
    return rounded(stats.paired_contrasts(_ct(spark, sf), n_boot=B, seed=SEED), *CI, digits=5)


def _cell(m: str, a: str, b: str) -> str:
    return f"min({m}) FILTER (architecture = '{a}' AND optical_input = '{b}')"


_FACT = "fx AS (" + " UNION ALL ".join(
    f"SELECT cube_id, fold, '{m}' AS measure, {_cell(m, 'alpha', 'bands')} AS c00, {_cell(m, 'alpha', 'indices')} AS c01, {_cell(m, 'beta', 'bands')} AS c10, {_cell(m, 'beta', 'indices')} AS c11 FROM ct GROUP BY 1, 2" for m in _M3
) + "), fe AS (SELECT cube_id, fold, measure, 0.5*((c10-c00)+(c11-c01)) AS first_effect, 0.5*((c01-c00)+(c11-c10)) AS second_effect, (c11-c10)-(c01-c00) AS interaction FROM fx WHERE c00 IS NOT NULL AND c01 IS NOT NULL AND c10 IS NOT NULL AND c11 IS NOT NULL)"
_EFF = ["first_effect", "second_effect", "interaction"]


@query("factor_effects", f"WITH {CT}, {_FACT} SELECT cube_id, fold, measure AS metric, {', '.join(rnd(e) for e in _EFF)} FROM fe")
def _(spark, sf):
    return rounded(stats.factor_effects(_ct(spark, sf), _M3), *_EFF)


@query(
    "factor_contrasts",
    f"WITH {CT}, {_FACT}, m AS ({_melt_sql('fe', 'cube_id, fold, measure', _EFF, 'difference')}), {_boot_sql('m', ['measure', 'metric_name'], ['fold'], 'cube_id', ['difference'])} SELECT measure AS metric, metric_name AS contrast, n_cubes, CASE WHEN measure <> 'mae' THEN 1 ELSE 0 END AS higher_is_better, {OUT} FROM b_out",
)
def _(spark, sf):
    return rounded(stats.factor_contrasts(_ct(spark, sf), n_boot=B, seed=SEED), *CI, digits=5)


_HO = "ho AS (SELECT *, persistence_beaten AS persistence_win_rate, r30_direction_match AS r30_direction_accuracy FROM ct WHERE configuration = '1-URGENT'), he AS (SELECT * FROM ho WHERE nnse_eligible = 1)"


@query(
    "holdout_overall",
    f"WITH {CT}, {_HO}, {_boot_sql('ho', [], [], 'cube_id', ['mae', 'mae_base', 'mae_gain', 'bias', 'persistence_win_rate', 'r30_direction_accuracy'], {'mse_skill_ratio': ('mse', 'mse_base')})}, {_boot_sql('he', [], [], 'cube_id', ['nnse', 'nnse_base'], prefix='h')} SELECT metric, n_cubes, {OUT} FROM b_out UNION ALL SELECT metric, n_cubes, {OUT} FROM h_out",
)
def _(spark, sf):
    return rounded(stats.holdout_overall(_ct(spark, sf).filter("configuration = '1-URGENT'"), n_boot=B, seed=SEED), *CI, digits=5)


_STEPS = "sp AS (SELECT cube_id, CAST(substr(configuration, 1, 1) AS INTEGER) * 5 AS lead_day, mae, mae_base, mse, mse_base, bias, observed_r30 AS observed_response, mae_gain AS predicted_response, spatial_valid_fraction, CAST(CASE WHEN nnse_eligible = 1 THEN round(observed_r30 + 5) ELSE 0 END AS BIGINT) AS n_valid FROM ct), sv AS (SELECT *, CAST(mse < mse_base AS DOUBLE) AS persistence_win_rate FROM sp WHERE n_valid > 0)"
_SM = ["mae", "mae_base", "bias", "observed_response", "predicted_response", "persistence_win_rate", "spatial_valid_fraction"]


@query(
    "holdout_by_step",
    f"WITH {CT}, {_STEPS}, {_boot_sql('sv', ['lead_day'], [], 'cube_id', _SM, {'mse_skill_ratio': ('mse', 'mse_base')})}, t AS (SELECT lead_day, CAST(sum(n_valid) AS BIGINT) AS n_valid_pixel_times FROM sv GROUP BY 1) SELECT b_out.lead_day, metric, n_cubes, n_valid_pixel_times, {OUT} FROM b_out JOIN t ON t.lead_day = b_out.lead_day",
)
def _(spark, sf):
    """The priority's first digit plays the step."""
    df = _ct(spark, sf)
    steps = df.select(
        "cube_id", (F.substring("configuration", 1, 1).cast("int") * 5).alias("lead_day"), "mae", "mae_base", "mse", "mse_base", "bias", F.col("observed_r30").alias("observed_response"), F.col("mae_gain").alias("predicted_response"), "spatial_valid_fraction",
        F.when(F.col("nnse_eligible") == 1, F.round(F.col("observed_r30") + 5)).otherwise(0.0).cast("bigint").alias("n_valid"),
    )
    return rounded(stats.holdout_by_step(steps, n_boot=B, seed=SEED), *CI, digits=5)


def _urgent(spark, sf):
    return _ct(spark, sf).filter("configuration = '1-URGENT'")


_ENV = f"""ur AS (SELECT * FROM ct WHERE configuration = '1-URGENT'), e0 AS (SELECT ur.*, CASE WHEN substr(season, 1, 1) IN ('D','E') THEN 'D/E' ELSE substr(season, 1, 1) END AS grp FROM ur JOIN meta ON CAST(cube AS VARCHAR) = cube_id),
 m1 AS ({_melt_sql('e0', 'grp, cube_id', _G)}), l0 AS (SELECT *, optical_input AS grp FROM ct WHERE optical_input IS NOT NULL), l1 AS (SELECT grp, cube_id || configuration AS cube_id, mae_gain, mse_skill, observed_r30 FROM l0), m2 AS ({_melt_sql('l1', 'grp, cube_id', _G)})"""


@query(
    "environment_summary",
    f"""WITH {CT}, {META}, {_ENV}, {_boot_sql('m1', ['grp', 'metric_name'], [], 'cube_id', ['value'])}, {_boot_sql('m2', ['grp', 'metric_name'], [], 'cube_id', ['value'], prefix='h')},
 a AS (SELECT *, 'climate' AS group_type FROM b_out UNION ALL SELECT *, 'landcover' AS group_type FROM h_out) SELECT grp AS "group", metric_name AS metric, group_type, n_cubes, CASE WHEN n_cubes >= 10 THEN 1 ELSE 0 END AS included_in_main_plot, {OUT} FROM a""",
)
def _(spark, sf):
    merged = _urgent(spark, sf).join(V.cube_meta(spark, sf).select(F.col("cube").cast("string").alias("cube_id"), "season"), "cube_id")
    lc = _ct(spark, sf).filter("optical_input is not null").select(F.col("optical_input").alias("landcover_group"), F.concat("cube_id", "configuration").alias("cube_id"), *_G)
    return rounded(stats.environment_summary(merged, lc, climate="season", n_boot=B, seed=SEED), *CI, digits=5)


# ---- tertiles and association ----------------------------------------------------------------------
_TERT = """ur AS (SELECT *, floor(mae * 4) / 4 AS feat FROM ct WHERE configuration = '1-URGENT'), rk AS (SELECT *, rank() OVER (ORDER BY feat) + (count(*) OVER (PARTITION BY feat) - 1)/2.0::DOUBLE AS r FROM ur),
 ed AS (SELECT quantile_cont(r, 1/3.0::DOUBLE) AS a, quantile_cont(r, 2/3.0::DOUBLE) AS b FROM rk), te AS (SELECT rk.*, CASE WHEN r <= a THEN 'low' WHEN r <= b THEN 'middle' ELSE 'high' END AS grp FROM rk, ed)"""


def _featured(spark, sf):
    return _urgent(spark, sf).withColumn("feat", F.floor(F.col("mae") * 4) / 4.0)


@query("event_tertiles", f"WITH {CT}, {_TERT} SELECT cube_id, {rnd('feat')}, grp AS feat_tertile FROM te")
def _(spark, sf):
    return rounded(stats.event_tertiles(_featured(spark, sf), "feat").select("cube_id", "feat", "feat_tertile"), "feat")


@query("group_medians", f"WITH {CT}, {_TERT}, m AS (SELECT grp, median(feat) AS feat_median FROM te GROUP BY 1) SELECT cube_id, te.grp AS \"group\", {rnd('feat_median')} FROM te JOIN m ON te.grp = m.grp")
def _(spark, sf):
    rows = reused(stats.event_tertiles(_featured(spark, sf), "feat", out="group").select("cube_id", "group", "feat"))
    return rounded(meta.join_group_medians(rows, rows, group="group", value="feat").drop("feat"), "feat_median")


@query(
    "tertile_summary",
    f"WITH {CT}, {_TERT}, m AS ({_melt_sql('te', 'grp, cube_id', ['observed_r30', 'mae_gain', 'mse_skill'])}), {_boot_sql('m', ['grp', 'metric_name'], [], 'cube_id', ['value'])}, md AS (SELECT grp, median(feat) AS feat_median FROM te GROUP BY 1) SELECT b_out.grp AS \"group\", metric_name AS metric, n_cubes, {rnd('feat_median')}, {OUT} FROM b_out JOIN md ON md.grp = b_out.grp",
)
def _(spark, sf):
    return rounded(rounded(stats.tertile_summary(_featured(spark, sf), "feat", n_boot=B, seed=SEED), *CI, digits=5), "feat_median")


def _beta_sql(src: str, outcome: str, feature: str, controls: list[str], prefix: str) -> str:
    """Standardised coefficient per replicate by sweeping the controls out of the covariances."""
    cols = [feature, *controls, outcome]  # 0 is the feature, the last one the outcome
    k, last, p = len(cols), len(cols) - 1, prefix
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    covs = ", ".join(f"covar_pop({cols[i]}, {cols[j]}) AS c{i}_{j}" for i, j in pairs)
    c = lambda i, j: f"c{min(i, j)}_{max(i, j)}"
    def swept(source: str, name: str, extra: str) -> str:
        sql = f"SELECT {extra}sqrt(c0_0 / c{last}_{last}) AS scale, * EXCLUDE ({extra.rstrip(', ') or 'c0_0'}){'' if extra else ', c0_0'} FROM (SELECT {extra}{covs} FROM {source}{' GROUP BY ALL' if extra else ''})"
        for m in range(1, last):
            left = [(i, j) for i, j in pairs if m not in (i, j) and not (0 < i < m) and not (0 < j < m)]
            sql = f"SELECT {extra}scale, {', '.join(f'{c(i, j)} - {c(i, m)} * {c(m, j)} / {c(m, m)} AS {c(i, j)}' for i, j in left)} FROM ({sql})"
        return f"{name} AS (SELECT {extra}c0_{last} / c0_0 * scale AS beta FROM ({sql}))"
    order = order_hash(SEED, "cube_id")
    return f"""{p}_n AS (SELECT *, row_number() OVER (ORDER BY {order}, cube_id) - 1 AS slot, count(*) OVER () AS n, {_start(['1'])} AS start FROM {src}), {p}_d AS ({_picks(p + '_n', '')}),
 {p}_r AS (SELECT rep, {', '.join(cols)} FROM {p}_d JOIN {p}_n ON pick = slot), {swept(p + '_r', p + '_s', 'rep, ')}, {swept(src, p + '_e', '')},
 {p}_out AS (SELECT '{outcome}' AS outcome, '{feature}' AS feature, '{';'.join(controls)}' AS controls, (SELECT beta FROM {p}_e) AS standardized_beta, quantile_cont(beta, 0.025) AS ci_low, quantile_cont(beta, 0.975) AS ci_high, (SELECT count(*) FROM {src}) AS n_cubes FROM {p}_s)"""


_BETA = ["standardized_beta", "ci_low", "ci_high"]
_BETA_OUT = "outcome, feature, controls, n_cubes, " + ", ".join(rnd(c, digits=5) for c in _BETA)
_UR = "ur AS (SELECT *, abs(observed_r30) AS abs_observed_r30 FROM ct WHERE configuration = '1-URGENT')"
_EVENT_CONTROLS = ["abs_observed_r30", "target_variance", "spatial_valid_fraction"]


@query("standardized_beta_simple", f"WITH {CT}, {_UR}, {_beta_sql('ur', 'observed_r30', 'mae', [], 'b')} SELECT {_BETA_OUT} FROM b_out")
def _(spark, sf):
    out = stats.standardized_beta(_urgent(spark, sf), outcome="observed_r30", feature="mae", unique=["cube_id"], n_boot=B, seed=SEED)
    return rounded(out, *_BETA, digits=5)


@query("standardized_beta_controls", f"WITH {CT}, {_UR}, {_beta_sql('ur', 'mae_gain', 'mae', ['observed_r30', 'target_variance', 'fold'], 'b')} SELECT {_BETA_OUT} FROM b_out")
def _(spark, sf):
    out = stats.standardized_beta(_urgent(spark, sf), outcome="mae_gain", feature="mae", controls=["observed_r30", "target_variance", "fold"], unique=["cube_id"], n_boot=B, seed=SEED)
    return rounded(out, *_BETA, digits=5)


@query(
    "event_associations",
    f"WITH {CT}, {_UR}, {_beta_sql('ur', 'observed_r30', 'mae', [], 'b')}, {_beta_sql('ur', 'mae_gain', 'mae', _EVENT_CONTROLS, 'h')} SELECT {_BETA_OUT} FROM b_out UNION ALL SELECT {_BETA_OUT} FROM h_out",
)
def _(spark, sf):
    return rounded(stats.event_analysis(_urgent(spark, sf), ["mae"], n_boot=B, seed=SEED)[0], *_BETA, digits=5)


# ---- small summaries -------------------------------------------------------------------------------
@query("fold_macro_mean", f"WITH {CT} SELECT configuration, {rnd('avg(nnse)', 'nnse')}, {rnd('avg(mae)', 'mae')} FROM (SELECT configuration, fold, avg(nnse) AS nnse, avg(mae) AS mae FROM ct GROUP BY 1, 2) GROUP BY 1")
def _(spark, sf):
    return rounded(metrics.fold_macro_mean(_ct(spark, sf), keys=["configuration"], fold="fold", metrics=["nnse", "mae"]), "nnse", "mae")


@query("ratio_of_means_skill", f"WITH {CT} SELECT configuration, {rnd('1 - avg(mse)/avg(mse_base)', 'mse_skill_ratio')} FROM ct GROUP BY 1")
def _(spark, sf):
    return rounded(metrics.ratio_of_means_skill(_ct(spark, sf), keys=["configuration"]), "mse_skill_ratio")


@query(
    "configuration_alignment",
    f"WITH {CT}, c AS (SELECT cube_id, count(DISTINCT configuration) AS n_configurations, count(DISTINCT mae < 4.5) AS n_signatures, count(DISTINCT fold) AS n_folds FROM ct GROUP BY 1) SELECT *, concat_ws(';', CASE WHEN n_configurations < 5 THEN 'cube_sets_differ' END, CASE WHEN n_signatures <> 1 THEN 'data_differs' END) AS problem FROM c",
)
def _(spark, sf):
    return metrics.alignment_check(_ct(spark, sf).withColumn("data_signature", F.col("mae") < 4.5))


@query("stage_guard", f"WITH {CT} SELECT cube_id, configuration, 'oof' AS stage FROM ct")
def _(spark, sf):
    return stats.stage_guard(_ct(spark, sf).withColumn("stage", F.lit("oof")), stage="oof").select("cube_id", "configuration", "stage")


@query(
    "stage_report",
    f"WITH {CT}, s AS (SELECT configuration, CASE WHEN configuration LIKE '1%' AND mae > 4.5 THEN 'holdout' WHEN configuration LIKE '3%' AND mae < 1 THEN NULL ELSE 'oof' END AS stage FROM ct) SELECT configuration, count(*) AS n_rows, count(*) FILTER (stage IS DISTINCT FROM 'oof') AS n_wrong, coalesce(string_agg(DISTINCT coalesce(stage, '<missing>'), ';' ORDER BY coalesce(stage, '<missing>')) FILTER (stage IS DISTINCT FROM 'oof'), '') AS stages, CASE WHEN n_wrong = 0 THEN 1 ELSE 0 END AS accepted FROM s GROUP BY 1",
)
def _(spark, sf):
    """Some rows of one configuration are holdout rows, some of another have no stage."""
    c = F.col("configuration")
    stage = F.when(c.startswith("1") & (F.col("mae") > 4.5), "holdout").when(c.startswith("3") & (F.col("mae") < 1), None).otherwise("oof")
    return stats.stage_report(_ct(spark, sf).withColumn("stage", stage), stage="oof")


# ---- top-k -----------------------------------------------------------------------------------------
@query("top_cubes", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def _(spark, sf):
    return selection.top_cubes(V.table(spark, sf, "orders", "o_orderkey", "o_totalprice"), cube="o_orderkey", share="o_totalprice", n=5)


@query("first_cubes_above", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_totalprice > 300000 GROUP BY 1 ORDER BY 2, 1 LIMIT 10")
def _(spark, sf):
    o = V.table(spark, sf, "orders", "o_custkey", "o_orderkey", "o_totalprice")
    return selection.first_cubes_above(o, cube="o_custkey", share="o_totalprice", order="o_orderkey", n=10, limit=300000.0)


@query("best_configuration", f"WITH {CT}, f AS (SELECT configuration, avg(nnse) AS nnse FROM (SELECT configuration, fold, avg(nnse) AS nnse FROM ct GROUP BY 1, 2) GROUP BY 1) SELECT configuration, {rnd('nnse')} FROM f ORDER BY f.nnse DESC LIMIT 1")
def _(spark, sf):
    scores = metrics.fold_macro_mean(_ct(spark, sf), keys=["configuration"], fold="fold", metrics=["nnse"])
    return rounded(selection.select_best(scores, score="nnse", tie=["configuration"]), "nnse")
