"""Scans. Schemas are explicit, NaN becomes NULL, partition columns prune by split and cube."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from petrichor import schema as S
from petrichor.functions.scalar import flag, nan_to_null, reasons


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_table(spark: SparkSession, root: str, ddl: str, *, columns: list[str] | None = None) -> DataFrame:
    """Partitioned Parquet table; ``columns`` prunes the scan."""
    df = spark.read.schema(S.struct(ddl)).parquet(root)
    return nan_to_null(df.select(*columns) if columns else df)


def _plain(path):
    return F.regexp_replace(path, "^file:/+", "/")


def read_cubes(spark: SparkSession, roots: list[str], ddl: str) -> tuple[DataFrame, list[str]]:
    """Union of cube folders; a folder without files is reported and skipped. One listing serves all of them."""
    base = _common_root(roots)
    wanted = spark.createDataFrame([(r.rstrip("/"),) for r in roots], "root string").withColumn("key", _plain(F.col("root")))
    found: set[str] = set()
    if _exists(spark, base):
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(base)
        folders = files.select(_plain(F.regexp_extract("path", "^(.*)/[^/]+$", 1)).alias("key")).distinct()
        found = {r.root for r in wanted.join(folders, "key", "left_semi").select("root").collect()}  # of the folders asked for
    there = [r for r in roots if r.rstrip("/") in found]
    if not there:
        raise FileNotFoundError(f"none of {len(roots)} cube folders exists")
    df = spark.read.option("basePath", base).schema(S.struct(ddl)).parquet(*there)
    return nan_to_null(df), [r for r in roots if r not in there]


def read_listed_cubes(spark: SparkSession, root: str, ddl: str, ids: DataFrame, *, cube: str = "cube_id") -> tuple[DataFrame, DataFrame]:
    """(rows of the cubes listed in a table, listed cubes that have no rows). The list is joined, never collected, and
    prunes the cube folders while the query runs."""
    df = read_table(spark, root, ddl)
    wanted = ids.select(cube).distinct()
    return df.join(wanted, cube, "left_semi"), wanted.join(df.select(cube).distinct(), cube, "left_anti")


def read_split_lines(spark: SparkSession, path: str) -> DataFrame:
    """``writers.write_splits`` as (fold, subset, file)."""
    return spark.read.schema("fold int, subset string, block bigint, files array<string>").json(path).select("fold", "subset", F.explode("files").alias("file"))


def _common_root(paths: list[str]) -> str:
    """Folder above the first partition directory (name=value)."""
    parts = paths[0].rstrip("/").split("/")
    for i, part in enumerate(parts):
        if "=" in part:
            return "/".join(parts[:i])
    return "/".join(parts[:-1])


def read_climate(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Daily grids of several products in one long table."""
    return nan_to_null(spark.read.schema(S.struct(S.CLIMATE_DAILY)).parquet(*paths))


def read_csv(spark: SparkSession, path: str, ddl: str | None = None, *, numeric: list[str] = ()) -> DataFrame:
    """Metadata table. Without a schema every column is text; ``numeric`` columns become double, text that is
    not a number becomes NULL."""
    reader = spark.read.option("header", True)
    df = reader.schema(S.struct(ddl)).csv(path) if ddl else reader.csv(path)
    return df.withColumns({c: F.expr(f"try_cast(`{c}` AS double)") for c in numeric}) if numeric else df


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """Fold document ``{fold_k: {train_files, val_files, ...}}`` as (fold, subset, file)."""
    doc = F.from_json("value", S.CV_SPLIT)
    folds = spark.read.text(path, wholetext=True).select(F.explode(doc).alias("_k", "_v"))
    fold = F.regexp_extract("_k", r"^fold_(\d+)$", 1)
    folds = folds.filter(fold != "").select(fold.cast("int").alias("fold"), "_v.*")
    sides = F.array(F.struct(F.lit("train").alias("subset"), F.col("train_files").alias("f")), F.struct(F.lit("val").alias("subset"), F.col("val_files").alias("f")))
    return folds.select("fold", F.inline(sides)).select("fold", "subset", F.explode("f").alias("file"))


def read_cv_summary(spark: SparkSession, path: str) -> DataFrame:
    """Run summaries with one row per file; ``cv_summary_path`` tells which."""
    df = spark.read.option("multiLine", True).schema(S.struct(S.CV_SUMMARY)).json(path)
    return df.withColumn("cv_summary_path", F.regexp_replace(F.input_file_name(), "^file:/+", "/"))


def read_global_stats(spark: SparkSession, path: str) -> DataFrame:
    """Stored robust limits (var, p_low, p_high)."""
    doc = F.from_json("value", S.GLOBAL_STATS)
    return spark.read.text(path, wholetext=True).select(F.explode(doc).alias("var", "_s")).select("var", F.col("_s.p0_01").alias("p_low"), F.col("_s.p99_99").alias("p_high"))


def read_path_list(spark: SparkSession, path: str, *, suffix: str = ".zarr") -> DataFrame:
    """One path per line; blanks and # comments are skipped, any other suffix is an error."""
    return parse_path_list(spark.read.text(path), suffix=suffix)


def parse_path_list(lines: DataFrame, *, text: str = "value", suffix: str = ".zarr") -> DataFrame:
    line = F.trim(F.col(text))
    kept = lines.select(line.alias("path")).filter((F.col("path") != "") & ~F.col("path").startswith("#"))
    checked = F.when(F.col("path").endswith(suffix), F.col("path")).otherwise(F.raise_error(F.concat(F.lit("not a cube path: "), F.col("path"))))
    return kept.select(checked.alias("path"))


# ---- predictions -----------------------------------------------------------------------------------
def load_manifests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Union of manifest CSVs with their path; missing required columns are an error.

    The files are read together with those of the same header, so the plan has a branch per kind of header.
    """
    head = F.rtrim(F.substring_index("value", "\n", 1), F.lit("\r"))
    kinds: dict[str, list[str]] = {}
    for r in spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), head.alias("head")).collect():  # a line per file
        kinds.setdefault(r["head"], []).append(r["path"])
    out = None
    for files in kinds.values():
        df = spark.read.option("header", True).csv(files)
        if missing := [c for c in S.MANIFEST_REQUIRED if c not in df.columns]:
            raise ValueError(f"{files[0]}: missing columns {missing}")
        df = df.withColumn("manifest_path", _plain(F.col("_metadata.file_path")))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def manifest_problems(manifest: DataFrame, tensors: DataFrame | None = None) -> DataFrame:
    """Duplicate (configuration, stage, cube) rows, and rows whose cube has no stored prediction."""
    key = ["configuration", "stage", "cube_id"]
    dup = manifest.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select(*key, F.lit("duplicate").alias("problem"))
    if tensors is None:
        return dup
    stored = tensors.select(*key).distinct()
    gone = manifest.select(*key).distinct().join(stored, key, "left_anti").withColumn("problem", F.lit("missing_tensor"))
    return dup.unionByName(gone)


def prediction_check(pred: DataFrame, *, cube: list[str], step: str = "step", y: str = "y", x: str = "x", atol: float = 1e-6) -> DataFrame:
    """Per cube: full T x H x W grid, and a base that is constant over time (or NULL at every step)."""
    b = F.col("base").cast("double")
    pixel = pred.groupBy(*cube, y, x).agg(F.count(F.lit(1)).alias("_t"), F.count(b).alias("_k"), (F.max(b) - F.min(b)).alias("_d"))
    per = pixel.groupBy(*cube).agg(
        F.sum("_t").alias("n_rows"), F.count_if((F.col("_d") > atol) | ((F.col("_k") > 0) & (F.col("_k") < F.col("_t")))).alias("n_base_varies"),
        ((F.max(y) - F.min(y) + 1) * (F.max(x) - F.min(x) + 1)).cast("bigint").alias("_hw"),
    )
    steps = pred.groupBy(*cube).agg(F.count_distinct(step).alias("n_steps"))
    out = per.join(steps, cube).withColumn("n_expected", F.col("_hw") * F.col("n_steps")).drop("_hw")
    why = reasons([(F.col("n_rows") != F.col("n_expected"), "grid_incomplete"), (F.col("n_base_varies") > 0, "base_not_constant")])
    return out.withColumn("problem", why).withColumn("ok", flag(F.col("problem") == ""))


def reduce_statics(layers: DataFrame, *, pixel: list[str], time: str, veg: str = "is_veg", code: str = "esa_lc") -> DataFrame:
    """Replicated static layers to one row per pixel: vegetation at any time, first land cover."""
    return layers.groupBy(*pixel).agg(F.max(veg).alias(veg), F.min_by(F.struct(F.col(code).alias("v")), F.col(time))["v"].alias(code))


def attach_statics(pred: DataFrame, statics: DataFrame, *, pixel: list[str]) -> DataFrame:
    """Predictions keep their rows; a cube without statics gets NULL layers."""
    return pred.join(statics, pixel, "left")


def eligible_counts(statics: DataFrame, *, cube: list[str], veg: str = "is_veg") -> DataFrame:
    return statics.groupBy(*cube).agg(F.count_if(F.col(veg) == 1).alias("n_eligible"))
