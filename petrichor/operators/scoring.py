"""Batch scoring of tiles with a user's fitted model, and out-of-fold / holdout export tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from petrichor.session import spread


def score_tiles(tiles: DataFrame, fn: Callable[[pd.DataFrame], pd.Series], *, out: str = "pred") -> DataFrame:
    """Apply ``fn`` (batch of tile rows -> predictions) partition by partition in Arrow batches."""
    schema = ", ".join(f"`{n}` {t}" for n, t in tiles.dtypes if n != out) + f", `{out}` double"
    cols = [n for n in tiles.columns if n != out]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[cols].assign(**{out: fn(pdf).astype("float64")})

    return tiles.mapInPandas(run, schema)


def score_whole_tiles(
    pixels: DataFrame, fn: Callable[[np.ndarray], np.ndarray], *, tile: list[str], channels: list[str], patch: int, row: str = "row", col: str = "col", out: str = "pred",
) -> DataFrame:
    """Apply a spatial model: ``fn`` maps one tile (patch, patch, channels), NaN where a value is missing, to
    (patch, patch) predictions; returns the tile's pixels (tile, row, col) with ``out``.

    ``tile`` names one tile at one step, or a whole tile if every step is a channel. A tile is one row on its way
    to Python, patch x patch x channels numbers, however many tiles a cube has.
    """
    values = F.array(*[F.col(c).cast("double") for c in channels])
    pixel = F.struct((F.col(row) * patch + F.col(col)).cast("int").alias("at"), values.alias("v"))
    grouped = pixels.groupBy(*tile).agg(F.collect_list(pixel).alias("_px"))
    flat = grouped.select(*tile, F.col("_px.at").alias("_at"), F.flatten("_px.v").alias("_v"))
    kinds = dict(flat.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for at, v in zip(pdf["_at"], pdf["_v"]):
                image = np.full((patch * patch, len(channels)), np.nan)
                image[at] = np.asarray(v, float).reshape(-1, len(channels))
                found.append(np.asarray(fn(image.reshape(patch, patch, -1)), float).reshape(-1)[at])
            yield pdf[[*tile, "_at"]].assign(_p=found)

    scored = spread(flat, rows=1000).mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in [*tile, "_at"]) + ", _p array<double>")
    pixels_out = scored.select(*tile, F.inline(F.arrays_zip("_at", "_p")))
    value = F.when(F.isnan("_p"), None).otherwise(F.col("_p"))
    return pixels_out.select(*tile, F.floor(F.col("_at") / patch).cast("int").alias(row), (F.col("_at") % patch).alias(col), value.alias(out))


def score_baseline(pixels: DataFrame, baseline: DataFrame, *, keys: list[str], out: str = "pred") -> DataFrame:
    """Native scorer: the baseline of a pixel is its prediction at every step."""
    return pixels.join(baseline.withColumnRenamed("base", out), keys, "left")


def out_of_fold(pixels: DataFrame, membership: DataFrame, *, cube: str, configuration: str) -> DataFrame:
    """Prediction rows of the cubes that validate, stamped with fold, stage and configuration.

    A cube that validates in several folds raises.
    """
    val = membership.filter(F.col("subset") == "val").groupBy(cube).agg(F.min("fold").alias("fold"), F.count_distinct("fold").alias("_n"))
    fold = F.when(F.col("_n") == 1, F.col("fold")).otherwise(F.raise_error(F.concat(F.lit("cube in several folds: "), F.col(cube).cast("string"))).cast("int"))
    val = val.select(cube, fold.alias("fold"))
    return pixels.join(val, cube).withColumns({"stage": F.lit("oof"), "configuration": F.lit(configuration)})


def holdout(pixels: DataFrame, cubes: DataFrame, *, cube: str, configuration: str) -> DataFrame:
    rows = pixels.join(cubes.select(cube).distinct(), cube, "left_semi")
    return rows.withColumns({"fold": F.lit(None).cast("int"), "stage": F.lit("holdout"), "configuration": F.lit(configuration)})


def manifest_rows(predictions: DataFrame, *, cube: str, tensor_root: str, **fixed: str) -> DataFrame:
    """One manifest row per configuration, stage, fold and cube."""
    keys = predictions.select("configuration", "stage", "fold", F.col(cube).cast("string").alias("cube_id")).distinct()
    path = F.concat_ws("/", F.lit(tensor_root), F.concat(F.lit("configuration="), "configuration"), F.concat(F.lit("stage="), "stage"), F.concat(F.lit("cube_id="), "cube_id"))
    return keys.withColumn("tensor_path", path).withColumns({k: F.lit(v) for k, v in fixed.items()})
