"""Pixel-level projections: masks, clipping, scaling, dtype rules. All stay inside one codegen stage."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from petrichor.functions import labels as L
from petrichor.functions.scalar import clip, count_true, flag, fold_all


# ---- optical quality -------------------------------------------------------------------------------
def quality_masks(df: DataFrame, scl: str = "SCL", cloud: str = "cloud_mask", drop: bool = True) -> DataFrame:
    """``mask_basic`` / ``mask_strict``; a missing code counts as valid."""
    hit = lambda c, codes: F.coalesce(F.col(c).isin(codes), F.lit(False))
    basic = ~hit(scl, L.SCL_BASIC_INVALID) & ~hit(cloud, L.CLOUD_INVALID)
    strict = basic & ~hit(scl, L.SCL_STRICT_INVALID)
    out = df.withColumns({"mask_basic": basic.cast("int"), "mask_strict": strict.cast("int")})
    return out.drop(scl, cloud) if drop else out


def quality_mask_check(df: DataFrame, cube: list[str], compat: bool = False) -> DataFrame:
    """Counts per cube and whether the strict rule removed pixels (``compat``: equal counts violate too)."""
    out = df.groupBy(*cube).agg(
        F.sum("mask_basic").cast("bigint").alias("n_basic"),
        F.sum("mask_strict").cast("bigint").alias("n_strict"),
        count_true(~F.col("mask_basic").isin(0, 1) | ~F.col("mask_strict").isin(0, 1)).alias("n_not_binary"),
    )
    bad = F.col("n_strict") >= F.col("n_basic") if compat else F.col("n_strict") > F.col("n_basic")
    return out.withColumn("violated", flag(bad | (F.col("n_not_binary") > 0)))


def vegetation_mask(df: DataFrame, landcover: str = "esa_lc", out: str = "is_veg") -> DataFrame:
    return df.withColumn(out, flag(F.col(landcover).isin(L.VEGETATION_CODES)))


def apply_mask(df: DataFrame, bands: list[str], mask: str) -> DataFrame:
    """Bands become NULL where the mask is not 1."""
    return df.withColumns({b: F.when(F.col(mask) == 1, F.col(b)).cast("float") for b in bands})


def masking_check(df: DataFrame, cube: list[str], band: str, mask: str) -> DataFrame:
    """NULLs of the band must cover the masked pixels."""
    out = df.groupBy(*cube).agg(
        count_true(F.col(band).isNull()).alias("n_null"),
        count_true(F.coalesce(F.col(mask), F.lit(0)) != 1).alias("n_masked"),
    )
    return out.withColumn("ok", flag(F.col("n_null") >= F.col("n_masked")))


def band_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if re.fullmatch(r"B[0-9A-Za-z]+", c)]


def clean_bands(df: DataFrame, bands: list[str] | None = None, cast: str = "float") -> DataFrame:
    """Clip reflectance to its valid range and scale it to [0, 1]."""
    bands = bands or band_columns(df)
    scaled = {b: (clip(F.col(b).cast("double"), 0.0, L.REFLECTANCE_MAX) / L.REFLECTANCE_MAX).cast(cast) for b in bands}
    return df.withColumns(scaled)


def band_clip_report(df: DataFrame, bands: list[str], cube: list[str] = ()) -> DataFrame:
    """Long table (cube, band, clipped_low, clipped_high) from one scan."""
    wide = df.groupBy(*cube).agg(
        *[count_true(F.col(b) < 0).alias(f"lo_{b}") for b in bands],
        *[count_true(F.col(b) > L.REFLECTANCE_MAX).alias(f"hi_{b}") for b in bands],
    )
    rows = F.array(*[F.struct(F.lit(b).alias("band"), F.col(f"lo_{b}").alias("clipped_low"), F.col(f"hi_{b}").alias("clipped_high")) for b in bands])
    return wide.select(*cube, F.inline(rows))


def index_range_check(df: DataFrame, indices: list[str], cube: list[str] = ()) -> DataFrame:
    """Status per index: ok, report (outside its interval), critical (impossible value) or empty."""
    wide = df.groupBy(*cube).agg(
        *[f(F.col(i).cast("double")).alias(f"{n}_{i}") for i in indices for n, f in (("lo", F.min), ("hi", F.max))]
    )
    rows = []
    for i in indices:
        low, high = L.INDEX_RANGES.get(i, (-1.0, 1.0))
        lo, hi = F.col(f"lo_{i}"), F.col(f"hi_{i}")
        outside = (hi > high) | (lo < low)
        impossible = (hi > 1.0) | (lo < -1.0)
        status = F.when(lo.isNull(), "empty")
        if i in L.CRITICAL_INDICES:
            status = status.when(outside & impossible, "critical")
        status = status.when(outside, "report").otherwise("ok")
        rows.append(F.struct(F.lit(i).alias("index_name"), lo.alias("v_min"), hi.alias("v_max"), status.alias("status")))
    return wide.select(*cube, F.inline(F.array(*rows)))


def refine_vegetation(df: DataFrame, veg: str = "is_veg", valid: str = "static_valid", landcover: str = "esa_lc") -> DataFrame:
    """Vegetation pixels rejected by the static filter leave the mask and get land-cover label 0."""
    rejected = (F.col(veg) == 1) & (F.col(valid) == 0)
    return df.withColumns(
        {
            landcover: F.when(rejected, 0).otherwise(F.col(landcover)),
            veg: flag((F.col(veg) == 1) & (F.col(valid) == 1)),
        }
    ).drop(valid)


# ---- scaling ---------------------------------------------------------------------------------------
def normalise_elevation(df: DataFrame, pixel: list[str], dem: str = "dem", max_height: float = L.EARTH_MAX_HEIGHT) -> DataFrame:
    """Mean over the layer's own time axis, scaled by the maximal height; ``in_range`` is the check."""
    scaled = (F.avg(dem) / max_height).alias("dem_scaled")
    out = df.groupBy(*pixel).agg(scaled)
    return out.withColumn("in_range", flag(F.col("dem_scaled").between(-0.05, 1.0)))


def safety_clip(df: DataFrame, keep: list[str], limit: float = L.SCALED_LIMIT) -> DataFrame:
    """Clip every numeric column except ``keep`` (keys and land cover)."""
    numeric = ("float", "double", "int", "bigint", "smallint", "tinyint")
    cols = [c for c, t in df.dtypes if t in numeric and c not in keep]
    return df.withColumns({c: clip(F.col(c).cast("double"), -limit, limit) for c in cols})


def coerce_types(df: DataFrame, labels: list[str], measures: list[str]) -> DataFrame:
    """Labels and masks to short (0-255 needs more than a signed byte), measurements to float."""
    return df.withColumns(
        {**{c: F.col(c).cast("smallint") for c in labels}, **{c: F.col(c).cast("float") for c in measures}}
    )


# ---- validity flags --------------------------------------------------------------------------------
def valid_flag(*cols: str) -> Column:
    return fold_all([F.col(c).isNotNull() for c in cols]).cast("int")


def aligned_flags(df: DataFrame, target: str = "kNDVI", radar: tuple[str, ...] = ("vv", "vh")) -> DataFrame:
    """Validity after resampling: the optical target, and the union of the radar bands."""
    return df.withColumns({"s2_final_mask": valid_flag(target), "s1_final_mask": valid_flag(*radar)})


def final_masks(df: DataFrame, target: str = "kNDVI", radar: tuple[str, ...] = ("vv", "vh")) -> DataFrame:
    s2 = valid_flag(target)
    return df.withColumns({"mask_s2": s2, "mask_s1": valid_flag(*radar), "target_mask": s2})


def final_mask_check(df: DataFrame, cube: list[str], target: str = "kNDVI", radar: tuple[str, ...] = ("vv", "vh")) -> DataFrame:
    """NULL counts of the data equal the zero counts of the masks."""
    missing_radar = fold_all([F.col(c).isNull() for c in radar], "or")
    out = df.groupBy(*cube).agg(
        count_true(F.col(target).isNull()).alias("s2_nulls"),
        count_true(F.col("mask_s2") == 0).alias("s2_zeros"),
        count_true(missing_radar).alias("s1_nulls"),
        count_true(F.col("mask_s1") == 0).alias("s1_zeros"),
    )
    return out.withColumn("ok", flag((F.col("s2_nulls") == F.col("s2_zeros")) & (F.col("s1_nulls") == F.col("s1_zeros"))))


def sensor_masks_and_fill(
    df: DataFrame, optical: list[str], radar: list[str], target: str = "kNDVI", veg: str = "is_veg"
) -> DataFrame:
    """Masks first (predictor bands, target, radar, each x vegetation), then NULL becomes 0."""
    predictors = [c for c in optical if c != target]
    veg_on = F.col(veg) == 1
    masked = df.withColumns(
        {
            "m_s2": flag(fold_all([F.col(c).isNotNull() for c in predictors]) & veg_on),
            "m_target": flag((F.col("target_mask") == 1) & veg_on),
            "m_s1": flag((F.col("mask_s1") == 1) & veg_on),
        }
    )
    return masked.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in [*optical, *radar]})


def value_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """min / max / mean per column in long form, from one scan."""
    wide = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max), ("mu", F.avg))])
    rows = [F.struct(F.lit(c).alias("variable"), F.col(f"lo_{c}").alias("v_min"), F.col(f"hi_{c}").alias("v_max"), F.col(f"mu_{c}").alias("v_mean")) for c in columns]
    return wide.select(F.inline(F.array(*rows)))
