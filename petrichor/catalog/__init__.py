"""Registered queries. Each names a Spark function of (spark, table folder) and, where SQL can say it, the
DuckDB text of the same result. All of them read whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = (fn, sql)
        return fn

    return add


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Round for comparison; adding 0.0 turns -0.0 into 0.0."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) + F.lit(0.0) for c in cols})


def rnd(expr: str, alias: str | None = None, digits: int = 6) -> str:
    """The same rounding as SQL text."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0) AS {alias or expr}"


def load() -> dict[str, tuple[Query, str | None]]:
    from petrichor.catalog import events, meta, predictions, rasters, selection, series, statistics, storage  # noqa: F401

    return REGISTRY
