"""Radar: global clip values, clipping, decibel scaling and the null-aware Lee speckle filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from petrichor.functions import labels as L
from petrichor.functions.scalar import clip, flag
from petrichor.operators.order_stats import ranked_percentiles
from petrichor.operators.tiles import with_halo


def clip_values(df: DataFrame, *, bands: list[str], veg: str = "is_veg", prob: float = 0.995) -> DataFrame:
    """One row of global upper limits: exact percentile per band over all vegetation pixels with all bands valid.
    The caller passes the training cubes."""
    usable = F.col(veg) == 1
    for b in bands:
        usable = usable & F.col(b).isNotNull()
    melted = df.filter(usable).select(F.inline(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).cast("double").alias("v")) for b in bands])))
    limits = ranked_percentiles(melted, ["band"], "v", [prob])
    return limits.agg(*[F.max(F.when(F.col("band") == b, F.col("p0"))).alias(f"{b}_max") for b in bands])


def clip_bands(df: DataFrame, bands: list[str], limits: DataFrame) -> DataFrame:
    """Clip to [0, global limit]; the limits arrive as scalar subqueries, so no join is planned."""
    upper: dict[str, Column] = {b: limits.select(f"{b}_max").scalar() for b in bands}
    return df.withColumns({b: clip(F.col(b).cast("double"), 0.0, upper[b]) for b in bands})


def to_unit_decibel(df: DataFrame, bands: list[str]) -> DataFrame:
    """Linear power -> dB -> clip -> [0, 1]."""
    span = L.DB_CEIL - L.DB_FLOOR

    def scale(c: Column) -> Column:
        power = F.when(c.isNotNull(), F.greatest(c.cast("double"), F.lit(1e-10)))
        return (clip(10.0 * F.log10(power), L.DB_FLOOR, L.DB_CEIL) - L.DB_FLOOR) / span

    return df.withColumns({b: scale(F.col(b)) for b in bands})


def lee_filter(
    df: DataFrame, *, image: list[str], y: str, x: str, value: str, size: int = 7, cu: float = 0.25, block: int = 256
) -> DataFrame:
    """Speckle filter over a ``size`` x ``size`` box of every image (one cube and time).

    An image of any size is cut into blocks of ``block`` x ``block`` pixels, with the pixels up to half a box around a
    block copied to it, so that a task holds a block and never an image. Box sums are separable: along rows,
    then along columns, and both windows refine the block partitioning, so the data moves once. The
    result doesn't depend on the block size. Missing pixels are NULL rows or no rows.
    """
    half = size // 2
    v = F.col(value).cast("double")
    base = with_halo(df, y=y, x=x, block=block, before=half, after=half).repartition(*image, "_by", "_bx")
    base = base.withColumns({"_s": F.coalesce(v, F.lit(0.0)), "_k": v.isNotNull().cast("int")})
    base = base.withColumn("_q", F.col("_s") * F.col("_s"))
    along_x = Window.partitionBy(*image, "_by", "_bx", y).orderBy(x).rangeBetween(-half, half)
    along_y = Window.partitionBy(*image, "_by", "_bx", x).orderBy(y).rangeBetween(-half, half)
    for w in (along_x, along_y):
        base = base.withColumns({c: F.sum(c).over(w) for c in ("_s", "_q", "_k")})
    n = F.greatest(F.col("_k").cast("double"), F.lit(1e-9))
    stats = base.filter("_own").withColumns({"_m": F.col("_s") / n, "_q": F.col("_q") / n})
    stats = stats.withColumn("_var", F.greatest(F.lit(0.0), F.col("_q") - F.col("_m") * F.col("_m")))
    noise = (cu * F.col("_m")) * (cu * F.col("_m"))
    weight = clip(F.col("_var") / (F.col("_var") + noise + 1e-9), 0.0, 1.0)
    weight = F.when(F.col("_var") < noise, 0.0).otherwise(weight)
    smooth = F.when(F.col(value).isNotNull(), F.col("_m") + weight * (v - F.col("_m")))
    return stats.withColumn(f"{value}_lee", smooth).drop("_s", "_k", "_q", "_m", "_var", "_own", "_by", "_bx")


def grid_check(df: DataFrame, *, image: list[str], y: str, x: str) -> DataFrame:
    """Dense rectangle per image: row count equals height x width."""
    out = df.groupBy(*image).agg(
        F.count(F.lit(1)).alias("n_rows"),
        ((F.max(y) - F.min(y) + 1) * (F.max(x) - F.min(x) + 1)).cast("bigint").alias("n_cells"),
    )
    return out.withColumn("dense", flag(F.col("n_rows") == F.col("n_cells")))
