"""Selection of the final configuration from cross-validation runs.

Tables: ``runs`` (run_dir, model_type, s2_vars, monitor_metric, monitor_mode, k_folds, cv_enabled,
refit_enabled, min_valid_target_coverage, min_valid_target_count, min_target_variance, mean_val_score,
recommended_final_refit_epochs, run_ts), ``folds`` (run_dir, fold, best_score, best_epoch,
best_checkpoint), ``files`` (run_dir, fold, subset, file).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from petrichor.functions.scalar import count_true, flag, n_rows, null_if_nan, reasons, rows_signature
from petrichor.operators.meta import predictor_set
from petrichor.session import reused



def run_timestamp(run_dir: Column) -> Column:
    """Timestamp at the end of the run name, NULL when it has none."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(run_dir, r"_(\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2})$", 1), F.lit("")), F.lit("yyyy-MM-dd_HH-mm-ss"))


def refit_epochs(median_epoch: Column) -> Column:
    """Median zero-based best epoch, rounded half to even, plus one."""
    return (F.bround(median_epoch, 0) + 1).cast("int")


#: Files that one task holds while it looks for repeated ones.
TASK_FILES = 500_000


def _distinct_files(val: DataFrame) -> DataFrame:
    """(run_dir, _d_val): distinct files per run. All but a few files are distinct, so nothing is combined before the
    shuffle, which has as many parts as the counted rows ask for."""
    named = val.select("run_dir", "file").filter("file IS NOT NULL")
    parts = 1 + named.count() // TASK_FILES
    return named.repartition(parts, "run_dir", "file").groupBy("run_dir", "file").agg(n_rows()).groupBy("run_dir").agg(n_rows().alias("_d_val"))


def audit_runs(runs: DataFrame, folds: DataFrame, files: DataFrame, *, n_folds: int = 3) -> DataFrame:
    """One row per run: recomputed scores, epochs, notes, and every protocol rule it breaks (``reason``)."""
    epoch = F.coalesce(F.col("best_epoch"), F.expr("try_cast(nullif(regexp_extract(best_checkpoint, 'epoch=([0-9]+)', 1), '') AS int)"))
    score = null_if_nan(F.col("best_score").cast("double"))
    per_run = folds.withColumns({"_e": epoch, "_s": score}).groupBy("run_dir").agg(
        n_rows().alias("_rows"), count_true(F.col("fold").between(0, n_folds - 1)).alias("_known"), F.count_distinct("fold").alias("_distinct"),
        F.avg("_s").alias("mean_score"), F.stddev_samp("_s").alias("std_score"), F.median("_e").alias("_median"),
        count_true(F.col("_s").isNull()).alias("_bad_score"),
        count_true(F.coalesce(F.col("best_checkpoint"), F.lit("")) == "").alias("_no_checkpoint"),
        count_true(F.col("_e").isNull() | (F.col("_e") < 0)).alias("_bad_epoch"),
        *[F.max(F.when(F.col("fold") == f, F.col("_s"))).alias(f"fold_{f}_score") for f in range(n_folds)],
        *[F.max(F.when(F.col("fold") == f, F.col("_e"))).alias(f"fold_{f}_epoch") for f in range(n_folds)],
    )
    val = files.filter(F.col("subset") == "val")
    split = val.groupBy("run_dir").agg(
        n_rows().alias("_n_val"), count_true(~F.col("fold").between(0, n_folds - 1)).alias("_extra_folds"),
        # order-free signature of the validation sets
        rows_signature(F.col("fold"), F.col("file")).alias("split_signature"),
    )
    split_folds = val.groupBy("run_dir", "fold").agg(n_rows()).groupBy("run_dir").agg(F.count("fold").alias("_split_folds"))
    out = runs.join(per_run, "run_dir", "left").join(split, "run_dir", "left").join(split_folds, "run_dir", "left")
    out = out.join(_distinct_files(val), "run_dir", "left").withColumn("_d_val", F.when(F.col("_n_val").isNotNull(), F.coalesce("_d_val", F.lit(0))))
    recomputed = F.abs(F.col("mean_val_score") - F.col("mean_score")) > F.greatest(1e-9 * F.greatest(F.abs("mean_val_score"), F.abs("mean_score")), F.lit(1e-12))
    robust = [F.col(c).isNull() for c in ("min_valid_target_coverage", "min_valid_target_count", "min_target_variance")]
    unknown = lambda c: F.coalesce(c, F.lit(True))
    out = out.withColumns(
        {
            "predictor_set": predictor_set(F.col("s2_vars")),
            "refit_epochs": refit_epochs(F.col("_median")),
            "reason": reasons(
                [
                    (unknown(~F.col("cv_enabled") | (F.col("k_folds") != n_folds)), "cross-validation not enabled with the expected folds"),
                    (F.coalesce(F.col("refit_enabled"), F.lit(False)), "already a final-refit configuration"),
                    (F.col("monitor_metric").isNull() | unknown(~F.col("monitor_mode").isin("min", "max")), "monitor metric or mode incomplete"),
                    (robust[0] | robust[1] | robust[2], "robust metric settings missing"),
                    (unknown((F.col("_rows") != n_folds) | (F.col("_known") != n_folds) | (F.col("_distinct") != n_folds)), "fold results incomplete"),
                    (F.col("_bad_score") > 0, "non-finite score"),
                    (F.col("_no_checkpoint") > 0, "checkpoint missing"),
                    (F.col("_bad_epoch") > 0, "no valid best epoch"),
                    (unknown((F.col("_split_folds") != n_folds) | (F.col("_extra_folds") > 0)), "validation splits incomplete"),
                    (F.col("_n_val") != F.col("_d_val"), "validation cubes overlap"),
                    (F.col("model_type").isNull() | (F.col("model_type") == ""), "model type missing"),
                ]
            ),
            "notes": F.concat_ws(
                " | ",
                F.when(recomputed, "stored mean differs from the recomputed one"),
                F.when(~F.col("recommended_final_refit_epochs").eqNullSafe(refit_epochs(F.col("_median"))), "stored refit epochs absent or inconsistent"),
            ),
        }
    )
    return out.withColumn("valid", flag(F.col("reason") == "")).drop(*[c for c in out.columns if c.startswith("_")])


def newest_runs(runs: DataFrame, *, signature: list[str], ts: str = "run_ts", tie: str = "run_dir") -> DataFrame:
    """Newest run per signature is 'active', the others 'superseded'; equal timestamps keep the first run name.

    A maximum per signature is enough, so no group is sorted.
    """
    runs = reused(runs)  # read for the best ones and for all
    best = runs.groupBy(*signature).agg(F.min_by(tie, F.struct(-F.unix_micros(F.col(ts).cast("timestamp")), F.col(tie))).alias("_best"))
    out = runs.join(best, signature)
    return out.withColumn("status", F.when(F.col(tie) == F.col("_best"), "active").otherwise("superseded")).drop("_best")


def missing_grid(available: DataFrame, expected: DataFrame, *, first: str, second: str) -> DataFrame:
    """Expected (first, second) combinations that are not available."""
    return expected.select(first, second).distinct().join(available.select(first, second).distinct(), [first, second], "left_anti")


def select_best(scores: DataFrame, *, score: str, mode: str | Column = "max", tie: list[str]) -> DataFrame:
    """The single best row; ties go to the smallest key. ``mode`` may be a column holding min/max."""
    m = F.lit(mode) if isinstance(mode, str) else mode
    signed = F.when(m == "min", F.col(score)).otherwise(-F.col(score))
    return scores.filter(F.col(score).isNotNull()).withColumn("_o", signed).orderBy("_o", *tie).limit(1).drop("_o")


def final_selection(audit: DataFrame, *, expected: DataFrame | None = None) -> DataFrame:
    """Audit rows with status (active / superseded / rejected) and the selected flag.

    Raises when the grid is incomplete, the active runs use several metrics or modes, or their validation
    sets differ.
    """
    audit = reused(audit)  # a row per run, read for every check
    accepted = newest_runs(audit.filter("valid = 1"), signature=["model_type", "predictor_set"])
    active = accepted.filter(F.col("status") == "active")
    checks = active.agg(
        F.count_distinct("monitor_metric", "monitor_mode").alias("metrics"), F.count_distinct("split_signature").alias("splits")
    )
    error = F.when(checks.select("metrics").scalar() > 1, "active runs use different selection metrics").when(
        checks.select("splits").scalar() > 1, "active runs use different validation cubes"
    )
    if expected is not None:
        gaps = missing_grid(active, first="model_type", second="predictor_set", expected=expected).agg(n_rows().alias("n"))
        error = F.when(gaps.select("n").scalar() > 0, "the planned comparison is incomplete").otherwise(error)
    winner = select_best(active, score="mean_score", mode=F.col("monitor_mode"), tie=["run_dir"]).select(F.col("run_dir").alias("_w"))
    everything = accepted.unionByName(audit.filter("valid = 0").withColumn("status", F.lit("rejected")))
    out = everything.withColumn("selected", flag(F.col("run_dir") == winner.select("_w").scalar()))
    return out.withColumn("status", F.when(error.isNull(), F.col("status")).otherwise(F.raise_error(error)))


def run_summary(folds: DataFrame, *, mode: str = "max") -> DataFrame:
    """Per run: best fold, mean and population deviation of the fold scores, refit epochs."""
    order = F.col("best_score") if mode == "min" else -F.col("best_score")
    return folds.groupBy("run_dir").agg(
        F.min_by("fold", F.struct(order, F.col("fold"))).alias("best_fold"), F.avg("best_score").alias("mean_val_score"),
        F.stddev_pop("best_score").alias("std_val_score"), refit_epochs(F.median("best_epoch")).alias("recommended_final_refit_epochs"),
    )


def stored_epochs(manifest: DataFrame, summaries: DataFrame, *, configuration: str) -> DataFrame:
    """Positive stored epochs of a configuration's run, from the smallest summary path that has them."""
    paths = manifest.filter(F.col("configuration") == configuration).select("cv_summary_path").dropna().distinct()
    good = paths.join(summaries, "cv_summary_path").filter(F.col("recommended_final_refit_epochs") > 0)
    return good.agg(F.min_by("recommended_final_refit_epochs", "cv_summary_path").alias("recommended_final_refit_epochs"))


def top_cubes(df: DataFrame, *, cube: str, share: str, n: int = 5) -> DataFrame:
    return df.orderBy(F.desc(share), cube).limit(n)


def first_cubes_above(df: DataFrame, *, cube: str, share: str, order: str, n: int, limit: float = 0.65) -> DataFrame:
    """First ``n`` distinct cubes, in arrival order, with a sample whose valid share exceeds the limit."""
    first = df.filter(F.col(share) > limit).groupBy(cube).agg(F.min(order).alias(order))
    return first.orderBy(order, cube).limit(n)


def extreme_steps(df: DataFrame, *, keys: list[str], time: str, value: str) -> DataFrame:
    """First step of the maximum and of the minimum."""
    order = F.unix_micros(F.col(time).cast("timestamp")) if dict(df.dtypes)[time].startswith("timestamp") else F.col(time)
    neg = -order if not dict(df.dtypes)[time] == "date" else -F.datediff(F.col(time), F.lit("1970-01-01").cast("date"))
    some = F.col(value).isNotNull()
    return df.groupBy(*keys).agg(
        F.max_by(time, F.when(some, F.struct(F.col(value), neg))).alias("argmax"), F.min_by(time, F.when(some, F.struct(F.col(value), order))).alias("argmin")
    )
