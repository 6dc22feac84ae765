"""Persistence and the two alternative baselines, as mergeable aggregates per pixel."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def persistence(df: DataFrame, *, pixel: list[str], time: str, value: str, mask: str) -> DataFrame:
    """Last context value with mask 1, 0 where there is none."""
    valid = F.col(mask) == 1
    last = F.max_by(F.when(valid, F.col(value)), F.when(valid, F.col(time)))
    return df.groupBy(*pixel).agg(F.coalesce(last.cast("double"), F.lit(0.0)).alias("base"))


def mean_baseline(df: DataFrame, *, pixel: list[str], value: str) -> DataFrame:
    """Mean of the context after NULLs became 0."""
    return df.groupBy(*pixel).agg(F.avg(F.coalesce(F.col(value).cast("double"), F.lit(0.0))).alias("base"))


def zero_baseline(df: DataFrame, *, pixel: list[str]) -> DataFrame:
    return df.select(*pixel).distinct().withColumn("base", F.lit(0.0))
