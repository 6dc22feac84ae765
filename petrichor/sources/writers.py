"""Sinks, the statistics cache, and resuming partial work."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from petrichor.sources.readers import _exists


#: A task sorts the rows of one file in memory, some 130 bytes each, and writes its cubes one after the other.
ROWS_PER_FILE = 1_000_000


def z_order(row: Column, column: Column) -> Column:
    """Morton key of two chunk numbers below 65,536: neighbours in both directions lie near each other in its order."""

    def spread(c: Column) -> Column:
        c = c.cast("long").bitwiseAND(F.lit(0xFFFF))
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
        return c

    return F.shiftleft(spread(row), 1).bitwiseOR(spread(column))


def _dealt(df: DataFrame, keys: list, rows_per_file: int) -> DataFrame:
    """Rows in as many ranges of the keys as their number asks for, sorted inside: a large cube gets many files, small
    ones share a task."""
    files = max(1, -(-df.count() // rows_per_file))
    return df.repartitionByRange(files, *keys).sortWithinPartitions(*keys)


def write_cubes(df: DataFrame, root: str, *, chunk: int = 250, time: str = "t", rows_per_file: int = ROWS_PER_FILE, row_group_bytes: int = 32 << 20, overwrite_cubes_only: bool = False) -> None:
    """Partitioned by split and cube; inside, rows lie by time and along a space-filling curve over the spatial chunks.

    The number of files follows from the counted rows, and tasks take ranges of (cube, time, curve), so no cube is one
    task's work. A box of pixels at some times is a few neighbouring row groups, whose minima and maxima rule
    out the others.
    """
    curve = z_order(F.floor(F.col("y") / F.lit(chunk)), F.floor(F.col("x") / F.lit(chunk)))
    out = _dealt(df, [F.col("split"), F.col("cube_id"), F.col(time), curve], rows_per_file)
    writer = out.write.mode("overwrite").partitionBy("split", "cube_id").option("compression", "zstd").option("parquet.block.size", row_group_bytes)
    if overwrite_cubes_only:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(root)


PARTS = ["configuration", "stage", "cube_id"]


def write_predictions(df: DataFrame, root: str, *, rows_per_file: int = ROWS_PER_FILE, chunk: int = 250) -> None:
    """Cubes of predictions, each replaced as a whole; laid out like ``write_cubes``. Not yet valid: see ``commit``."""
    curve = z_order(F.floor(F.col("y") / F.lit(chunk)), F.floor(F.col("x") / F.lit(chunk)))
    out = _dealt(df, [*[F.col(c) for c in PARTS], F.col("step"), curve], rows_per_file)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTS).option("compression", "zstd").parquet(root)


def commit(df: DataFrame, root: str) -> None:
    """Second phase of a write: one marker per cube with the rows it must hold, counted from what was to be written.

    Markers lie beside the data (``<root>.commits``) and are only ever added; the newest of a cube counts. A job that dies between
    the phases, or while it replaces a cube, leaves rows that no marker vouches for.
    """
    now = F.lit(datetime.now(timezone.utc).isoformat())
    df.groupBy(*PARTS).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("committed_at", now).write.mode("append").parquet(f"{root}.commits")


def commit_state(spark: SparkSession, root: str) -> DataFrame:
    """(configuration, stage, cube_id, n_rows, n_stored, state) of every cube that is stored or has a marker: complete,
    truncated (rows differ from the marker's), missing (a marker without rows) or uncommitted. Stored rows are counted without
    reading a column."""
    kinds = ", ".join(f"{c} string" for c in PARTS)
    stored_ = spark.createDataFrame([], f"{kinds}, n_stored bigint")
    if _exists(spark, root):
        stored_ = spark.read.schema(f"step int, {kinds}").parquet(root).groupBy(*PARTS).agg(F.count(F.lit(1)).alias("n_stored"))
    marks = spark.createDataFrame([], f"{kinds}, n_rows bigint")
    if _exists(spark, f"{root}.commits"):
        found = spark.read.schema(f"{kinds}, n_rows bigint, committed_at string").parquet(f"{root}.commits")
        marks = found.groupBy(*PARTS).agg(F.max_by("n_rows", "committed_at").alias("n_rows"))
    state = F.when(F.col("n_rows").isNull(), "uncommitted").when(F.col("n_stored").isNull(), "missing").when(F.col("n_rows") == F.col("n_stored"), "complete").otherwise("truncated")
    return marks.join(stored_, PARTS, "full").select(*PARTS, "n_rows", "n_stored", state.alias("state"))


def complete_cubes(spark: SparkSession, root: str) -> DataFrame:
    """The cubes that a resumed export needn't write again: ``existing`` of ``export_state`` and ``remaining``."""
    return commit_state(spark, root).filter("state = 'complete'").select(*PARTS)


def write_splits(files: DataFrame, path: str, *, block: int = 10_000) -> None:
    """(fold, subset, file) as JSON lines, each a block of files of one side of a fold: no list holds a whole side."""
    blocks = F.floor(F.pmod(F.xxhash64("file"), F.lit(1 << 30)) / F.ceil(F.lit(1 << 30) / F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(block)))))
    sizes = files.groupBy("fold", "subset").agg(F.count(F.lit(1)).alias("_n"))
    lines = files.join(sizes, ["fold", "subset"]).groupBy("fold", "subset", blocks.alias("block")).agg(F.sort_array(F.collect_list("file")).alias("files"))
    lines.write.mode("overwrite").json(path)


def write_result(df: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = df.write.mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def cached_stats(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """Statistics computed once: read the stored table if it exists, else compute, store and read it."""
    if not _exists(spark, path):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def manifest_table(rows: DataFrame) -> DataFrame:
    """Checked manifest: required fields, no duplicate key, sorted with NULL folds last."""
    required = ["configuration", "stage", "cube_id", "tensor_path"]
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"manifest rows lack {missing}")
    key = ["configuration", "stage", "cube_id"]
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    out = rows.join(counts, key)
    checked = F.when(F.col("_n") == 1, F.col("cube_id")).otherwise(F.raise_error(F.concat(F.lit("several manifest rows for one cube: "), F.col("cube_id").cast("string"))))
    out = out.withColumn("cube_id", checked).drop("_n")
    return out.orderBy("configuration", "stage", F.col("fold").asc_nulls_last(), "cube_id")


def write_manifest(rows: DataFrame, path: str) -> None:
    """In order: the parts, by name, follow one another."""
    manifest_table(rows).write.mode("overwrite").option("header", True).csv(path)


def remaining(work: DataFrame, done: DataFrame, *, cube: str = "cube_id") -> DataFrame:
    """Work list without the finished cubes."""
    return work.join(done.select(cube).distinct(), cube, "left_anti")


def export_state(expected: DataFrame, existing: DataFrame, *, cube: str = "cube_id") -> DataFrame:
    """One row: n_expected, n_existing and state complete / partial / empty."""
    hit = existing.select(cube).distinct().withColumn("_h", F.lit(1))
    out = expected.select(cube).distinct().join(hit, cube, "left").agg(F.count(F.lit(1)).alias("n_expected"), F.count("_h").alias("n_existing"))
    state = F.when(F.col("n_existing") == F.col("n_expected"), "complete").when(F.col("n_existing") > 0, "partial").otherwise("empty")
    return out.withColumn("state", state)


def export_if_needed(
    work: DataFrame, existing: Callable[[], DataFrame], run: Callable[[DataFrame], None], *, overwrite: bool = False, cube: str = "cube_id"
) -> str:
    """Reuse a complete export, refuse a partial one unless ``overwrite``, else run the export.

    ``existing`` reads what is stored; after a run it must hold every cube of the work list.
    """
    state = export_state(work, existing(), cube=cube).first()["state"]  # a one-row decision of the job driver
    if state == "complete" and not overwrite:
        return "reused"
    if state == "partial" and not overwrite:
        raise FileExistsError("partial export found; pass overwrite=True after checking it")
    run(work)
    after = export_state(work, existing(), cube=cube).first()
    if after["state"] != "complete":
        raise RuntimeError(f"the export holds {after['n_existing']} of {after['n_expected']} cubes")
    return "exported"


def write_export_document(work: DataFrame, existing: DataFrame, path: str, *, cube: str = "cube_id", **facts: str) -> None:
    """One JSON line about an export: its state, counts and given facts."""
    export_state(work, existing, cube=cube).withColumns({k: F.lit(v) for k, v in facts.items()}).write.mode("overwrite").json(path)
