"""Stored statistics that new cubes refresh: counts per bin of equal width, merged by adding.

A bin is ``floor(value / width)``. The counts of two sets of cubes add up to the counts of both, so a refresh reads the new
cubes only, and stored plus new equals a computation over all of them. A percentile is taken over the bins' middles: it differs
from the exact one by half a width at most. ``climate.global_percentiles`` stays the exact way.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from petrichor.sources.readers import _exists


def bin_counts(df: DataFrame, *, keys: list[str], value: str, width: float) -> DataFrame:
    """(keys, bin, n); NULL, NaN and infinite values are not counted."""
    v = F.col(value).cast("double")
    rows = df.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.groupBy(*keys, F.floor(v / F.lit(float(width))).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def percentiles(counts: DataFrame, *, keys: list[str], width: float, probs: list[float]) -> DataFrame:
    """(keys, n, p0, p1, ...): linear percentiles over the middles of the bins, within width / 2 of the exact ones.

    The window sees one row per bin of a key, range / width at most, however many rows were counted.
    """
    added = counts.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys)
    upto = F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    rows = added.withColumns({"_upto": upto, "_all": F.sum("n").over(group), "_middle": (F.col("bin") + 0.5) * F.lit(float(width))})
    found = []
    for i, p in enumerate(probs):
        place = F.lit(float(p)) * (F.col("_all") - 1)
        low = F.min(F.when(F.col("_upto") > F.floor(place), F.col("_middle")))
        high = F.min(F.when(F.col("_upto") > F.ceil(place), F.col("_middle")))
        found.append((low + (high - low) * F.max(place - F.floor(place))).alias(f"p{i}"))
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"), *found)


def _commits(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(f"{path}/commits") if _exists(spark, f"{path}/commits") else None


def stored_counts(spark: SparkSession, path: str, *, width: float) -> DataFrame | None:
    """(keys, bin, n, batch) of all finished refreshes, or None before the first one. Counts of another width are refused."""
    commits = _commits(spark, path)
    if commits is None:
        return None
    if others := [r["width"] for r in commits.select("width").distinct().limit(2).collect() if r["width"] != float(width)]:
        raise ValueError(f"{path} holds bins of width {others[0]}, not {width}")
    return spark.read.parquet(f"{path}/bins").join(commits.select("batch"), "batch", "left_semi")


def refresh(df: DataFrame, path: str, *, cube: str, keys: list[str], value: str, width: float) -> int:
    """Add the cubes that the stored counts don't know yet; the number of cubes added.

    A refresh writes its cubes' ids and their counts as one batch and then one commit row; a batch without it never counts, so a
    job that dies is simply run again. One writer at a time. A cube is taken as a whole: rows that an already counted cube
    gets later are not seen, and rows without a cube are not counted.
    """
    spark = df.sparkSession
    stored_counts(spark, path, width=width)  # refuses another width
    commits, batch = _commits(spark, path), f"b{uuid.uuid4().hex}"
    ids = df.filter(F.col(cube).isNotNull()).select(cube).distinct()
    if commits is not None:
        ids = ids.join(spark.read.parquet(f"{path}/cubes").join(commits.select("batch"), "batch", "left_semi").select(cube), cube, "left_anti")
    ids.write.parquet(f"{path}/cubes/batch={batch}")
    new = spark.read.schema(ids.schema).parquet(f"{path}/cubes/batch={batch}")
    added = new.count()
    if added:
        rows = df.join(new, cube, "left_semi")
        bin_counts(rows, keys=keys, value=value, width=width).write.parquet(f"{path}/bins/batch={batch}")
        spark.range(1).select(F.lit(batch).alias("batch"), F.lit(float(width)).alias("width"), F.lit(added).cast("long").alias("n_cubes")).write.mode("append").parquet(f"{path}/commits")
    return added
