"""Run selection, manifests and export queries. A run = (order status, priority) with the customers' fold means
as its fold results; splits are the customers of each fold."""

from __future__ import annotations

from pyspark.sql import functions as F

from petrichor.catalog import query, rnd, rounded
from petrichor.catalog.sql import PRED
from petrichor.operators import baselines, scoring, selection
from petrichor.plans import views as V
from petrichor.sources import readers, writers

_RD = "o_orderstatus || '_' || substr(o_orderpriority, 1, 1)"


def _orders(spark, sf):
    o = V.table(spark, sf, "orders")
    return o.withColumn("run_dir", F.concat_ws("_", "o_orderstatus", F.substring("o_orderpriority", 1, 1))).withColumn("fold", (F.col("o_custkey") % 3).cast("int"))


def _folds(spark, sf):
    per = _orders(spark, sf).groupBy("run_dir", "fold").agg(F.avg("o_totalprice").alias("m"), F.count(F.lit(1)).alias("n"))
    epoch = (F.col("n") % 30).cast("int")
    return per.select("run_dir", "fold", (F.col("m") / 1000000.0).alias("best_score"), F.when(F.col("run_dir").startswith("P"), F.lit(None)).otherwise(epoch).alias("best_epoch"), F.concat(F.lit("best-epoch="), epoch.cast("string"), F.lit(".ckpt")).alias("best_checkpoint"))


def _runs(spark, sf):
    """Status F is the newer twin of status O for the same model and predictors."""
    o = _orders(spark, sf)
    r = o.groupBy("run_dir", "o_orderstatus", "o_orderpriority").agg(F.max("o_orderdate").alias("d"))
    arr = lambda *n: F.array(*[F.lit(x) for x in n])
    p = F.substring("o_orderpriority", 1, 1)
    return r.select(
        "run_dir", F.when(p.isin("1", "2"), "A").otherwise("B").alias("model_type"),
        F.when(p.isin("1", "4"), arr("IRECI", "NDMI", "NIRv", "kNDVI")).when(p.isin("2", "5"), arr("B02", "B03", "B04", "B8A")).otherwise(arr("kNDVI")).alias("s2_vars"),
        F.lit("nnse").alias("monitor_metric"), F.lit("max").alias("monitor_mode"), F.when(p == "3", 5).otherwise(3).alias("k_folds"), F.lit(True).alias("cv_enabled"), F.lit(False).alias("refit_enabled"),
        F.lit(0.15).alias("min_valid_target_coverage"), F.lit(1000).alias("min_valid_target_count"), F.lit(1e-6).alias("min_target_variance"),
        F.lit(None).cast("double").alias("mean_val_score"), F.lit(None).cast("int").alias("recommended_final_refit_epochs"),
        F.when(F.col("o_orderstatus") == "F", F.lit("2026-08-02")).when(F.col("o_orderstatus") == "O", F.lit("2026-08-01")).otherwise(F.lit("2026-07-01")).cast("timestamp_ntz").alias("run_ts"),
    )


def _files(spark, sf):
    """Every run validates the same customers."""
    runs = _orders(spark, sf).select("run_dir").distinct().agg(F.array_sort(F.collect_set("run_dir")).alias("r"))  # 15 names
    cust = V.table(spark, sf, "customer").select((F.col("c_custkey") % 3).cast("int").alias("fold"), F.col("c_custkey").cast("string").alias("file"))
    return cust.withColumn("run_dir", F.explode(runs.select("r").scalar())).withColumn("subset", F.lit("val"))


_F = f"fo AS (SELECT {_RD} AS run_dir, CAST(o_custkey % 3 AS INTEGER) AS fold, avg(o_totalprice)/1000000.0::DOUBLE AS s, CAST(count(*) % 30 AS INTEGER) AS e FROM orders GROUP BY ALL)"
_A = f"""{_F}, pr AS (SELECT run_dir, avg(s) AS mean_score, stddev_samp(s) AS std_score, CAST(round_even(median(e), 0) + 1 AS INTEGER) AS refit_epochs, max(CASE WHEN fold = 0 THEN e END) AS e0 FROM fo GROUP BY 1),
 au AS (SELECT pr.*, CASE WHEN substr(run_dir, 3, 1) IN ('1','2') THEN 'A' ELSE 'B' END AS model_type, CASE WHEN substr(run_dir, 3, 1) IN ('1','4') THEN 'Indices' WHEN substr(run_dir, 3, 1) IN ('2','5') THEN 'RGBI_kNDVI' ELSE 'Unknown' END AS predictor_set,
 CASE WHEN substr(run_dir, 3, 1) = '3' THEN 'cross-validation not enabled with the expected folds' ELSE '' END AS reason FROM pr),
 nw AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY reason, model_type, predictor_set ORDER BY CASE substr(run_dir, 1, 1) WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END DESC, run_dir) = 1 THEN 'active' ELSE 'superseded' END AS st FROM au),
 fin AS (SELECT *, CASE WHEN reason <> '' THEN 'rejected' ELSE st END AS status, CASE WHEN reason = '' AND st = 'active' AND mean_score = (SELECT max(mean_score) FROM nw WHERE reason = '' AND st = 'active') THEN 1 ELSE 0 END AS selected FROM nw)"""


def _audit(spark, sf):
    return selection.audit_runs(_runs(spark, sf), _folds(spark, sf), _files(spark, sf))


@query("cv_candidate_audit", f"WITH {_A} SELECT run_dir, model_type, predictor_set, {rnd('mean_score')}, {rnd('std_score')}, refit_epochs, e0 AS fold_0_epoch, reason, CASE WHEN reason = '' THEN 1 ELSE 0 END AS valid FROM au")
def _(spark, sf):
    out = _audit(spark, sf).select("run_dir", "model_type", "predictor_set", "mean_score", "std_score", "refit_epochs", "fold_0_epoch", "reason", "valid")
    return rounded(out, "mean_score", "std_score")


@query("newest_runs", f"WITH {_A} SELECT run_dir, st AS status FROM nw WHERE reason = ''")
def _(spark, sf):
    return selection.newest_runs(_audit(spark, sf).filter("valid = 1"), signature=["model_type", "predictor_set"]).select("run_dir", "status")


@query("final_selection", f"WITH {_A} SELECT run_dir, status, selected, {rnd('mean_score')}, refit_epochs FROM fin")
def _(spark, sf):
    return rounded(selection.final_selection(_audit(spark, sf)).select("run_dir", "status", "selected", "mean_score", "refit_epochs"), "mean_score")


@query(
    "cv_run_summary",
    f"WITH {_F} SELECT run_dir, arg_max(fold, s) AS best_fold, {rnd('avg(s)', 'mean_val_score')}, {rnd('stddev_pop(s)', 'std_val_score')}, CAST(round_even(median(CASE WHEN run_dir NOT LIKE 'P%' THEN e END), 0) + 1 AS INTEGER) AS recommended_final_refit_epochs FROM fo GROUP BY 1",
)
def _(spark, sf):
    return rounded(selection.run_summary(_folds(spark, sf)), "mean_val_score", "std_val_score")


@query("stored_refit_epochs", f"WITH {_F} SELECT CAST(round_even(median(e), 0) + 1 AS INTEGER) AS recommended_final_refit_epochs FROM fo WHERE run_dir = 'F_1'")
def _(spark, sf):
    summaries = selection.run_summary(_folds(spark, sf)).withColumn("cv_summary_path", F.concat("run_dir", F.lit("/cv_summary.json")))
    manifest = _orders(spark, sf).select(F.col("run_dir").alias("configuration"), F.concat("run_dir", F.lit("/cv_summary.json")).alias("cv_summary_path"))
    return selection.stored_epochs(manifest, summaries, configuration="F_1")


@query(
    "missing_grid_cells",
    "WITH a AS (SELECT DISTINCT c_nationkey AS model, date_part('year', o_orderdate) * 100 + date_part('month', o_orderdate) AS inp, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey) SELECT model, inp FROM a EXCEPT SELECT model, inp FROM a WHERE o_totalprice > 300000",
)
def _(spark, sf):
    o, c = V.table(spark, sf, "orders"), V.table(spark, sf, "customer")
    a = o.join(c, F.col("c_custkey") == F.col("o_custkey")).select("o_totalprice", F.col("c_nationkey").alias("model"), (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("bigint").alias("inp"))
    return selection.missing_grid(a.filter("o_totalprice > 300000"), a, first="model", second="inp")


@query("parse_run_timestamps", "SELECT o_orderkey, strptime(strftime(o_orderdate, '%Y-%m-%d_%H-%M-%S'), '%Y-%m-%d_%H-%M-%S') AS ts FROM orders")
def _(spark, sf):
    o = V.table(spark, sf, "orders")
    name = F.concat(F.lit("model_"), F.date_format("o_orderdate", "yyyy-MM-dd_HH-mm-ss"))
    return o.select("o_orderkey", selection.run_timestamp(name).cast("timestamp_ntz").alias("ts"))


# ---- manifests and exports -------------------------------------------------------------------------
_MAN = "SELECT o_orderpriority AS configuration, o_orderstatus AS stage, CAST(o_custkey AS VARCHAR) AS cube_id FROM orders"


def _manifest(spark, sf):
    return V.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("configuration"), F.col("o_orderstatus").alias("stage"), F.col("o_custkey").cast("string").alias("cube_id"), "o_totalprice")


@query(
    "manifest_problems",
    f"WITH m AS ({_MAN}), s AS (SELECT DISTINCT o_orderpriority AS configuration, o_orderstatus AS stage, CAST(o_custkey AS VARCHAR) AS cube_id FROM orders WHERE o_totalprice > 100000) SELECT *, 'duplicate' AS problem FROM m GROUP BY ALL HAVING count(*) > 1 UNION ALL (SELECT *, 'missing_tensor' FROM (SELECT * FROM m EXCEPT SELECT * FROM s))",
)
def _(spark, sf):
    m = _manifest(spark, sf)
    return readers.manifest_problems(m.drop("o_totalprice"), m.filter("o_totalprice > 100000"))


@query("manifest_table", "SELECT DISTINCT o_orderpriority AS configuration, o_orderstatus AS stage, CAST(CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_custkey % 3 END AS INTEGER) AS fold, CAST(o_custkey AS VARCHAR) AS cube_id, 'x/' || o_custkey AS tensor_path FROM orders")
def _(spark, sf):
    m = V.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("configuration"), F.col("o_orderstatus").alias("stage"), F.when(F.col("o_orderstatus") != "F", (F.col("o_custkey") % 3).cast("int")).alias("fold"), F.col("o_custkey").cast("string").alias("cube_id"), F.concat(F.lit("x/"), F.col("o_custkey").cast("string")).alias("tensor_path")
    ).distinct()
    return writers.manifest_table(m)


@query("remaining_cubes", "SELECT c_custkey AS cube_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def _(spark, sf):
    work = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("cube_id"))
    done = V.table(spark, sf, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("cube_id"))
    return writers.remaining(work, done)


@query("export_state", "SELECT count(*) AS n_expected, count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)) AS n_existing, CASE WHEN n_existing = 0 THEN 'empty' WHEN n_existing = n_expected THEN 'complete' ELSE 'partial' END AS state FROM customer")
def _(spark, sf):
    work = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("cube_id"))
    done = V.table(spark, sf, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("cube_id"))
    return writers.export_state(work, done)


@query("score_with_baseline", f"WITH {PRED}, b AS (SELECT cube_id, y, x, coalesce(arg_max(CASE WHEN mask = 1 THEN tru END, CASE WHEN mask = 1 THEN step END), 0) AS p FROM px WHERE step <= 3 GROUP BY 1, 2, 3) SELECT cube_id, step, y, x, {rnd('p', 'pred')} FROM px JOIN b USING (cube_id, y, x) WHERE step > 3")
def _(spark, sf):
    """Steps 1-3 are context, later ones are scored with the persistence baseline."""
    px = V.prediction_pixels(spark, sf)
    base = baselines.persistence(px.filter("step <= 3"), pixel=["cube_id", "y", "x"], time="step", value="true", mask="mask")
    out = scoring.score_baseline(px.filter("step > 3").select("cube_id", "step", "y", "x"), base, keys=["cube_id", "y", "x"])
    return rounded(out, "pred")


def _linear(pdf):
    """Stand-in for a fitted model: works on whole Arrow batches."""
    return 0.8 * pdf["true"] + 0.1 * pdf["base"]


@query("score_tiles", f"WITH {PRED} SELECT cube_id, step, y, x, {rnd('0.8::DOUBLE * tru + 0.1::DOUBLE * base', 'pred')} FROM px")
def _(spark, sf):
    px = V.prediction_pixels(spark, sf).select("cube_id", "step", "y", "x", "true", "base")
    return rounded(scoring.score_tiles(px, _linear).select("cube_id", "step", "y", "x", "pred"), "pred")


def _oof(spark, sf):
    px = V.prediction_pixels(spark, sf)
    fold = (F.substring_index("cube_id", "-", 1).cast("int") % 3).cast("int")
    members = px.select("cube_id", fold.alias("fold")).distinct().withColumn("subset", F.lit("val"))
    return scoring.out_of_fold(px, members, cube="cube_id", configuration="base")


@query("out_of_fold_export", f"WITH {PRED} SELECT cube_id, 'oof' AS stage, 'base' AS configuration, CAST(CAST(split_part(cube_id, '-', 1) AS INTEGER) % 3 AS INTEGER) AS fold, count(*) AS n FROM px GROUP BY ALL")
def _(spark, sf):
    return _oof(spark, sf).groupBy("cube_id", "stage", "configuration", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("export_manifest_rows", f"WITH {PRED} SELECT DISTINCT 'base' AS configuration, 'oof' AS stage, CAST(CAST(split_part(cube_id, '-', 1) AS INTEGER) % 3 AS INTEGER) AS fold, cube_id, 'out/configuration=base/stage=oof/cube_id=' || cube_id AS tensor_path, 'convolutional' AS architecture FROM px")
def _(spark, sf):
    return scoring.manifest_rows(_oof(spark, sf), cube="cube_id", tensor_root="out", architecture="convolutional")


@query("holdout_export", f"WITH {PRED} SELECT cube_id, 'holdout' AS stage, count(*) AS n FROM px WHERE cube_id LIKE '7-%' GROUP BY ALL")
def _(spark, sf):
    px = V.prediction_pixels(spark, sf)
    chosen = px.filter(F.col("cube_id").startswith("7-")).select("cube_id")
    return scoring.holdout(px, chosen, cube="cube_id", configuration="base").groupBy("cube_id", "stage").agg(F.count(F.lit(1)).alias("n"))
