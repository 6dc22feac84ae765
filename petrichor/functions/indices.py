"""Spectral indices as column expressions over reflectance columns in [0, 1]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _normalised_difference(a: Column, b: Column) -> Column:
    return F.try_divide(a - b, a + b)


def spectral_index(name: str, band=F.col) -> Column:
    """``band`` maps a band name (B03, B04, ...) to a column. A zero denominator gives NULL."""
    n, r, g = band("B08"), band("B04"), band("B03")
    ndvi = _normalised_difference(n, r)
    formulas = {
        "NDVI": lambda: ndvi,
        # RBF kernel with sigma = (N + R) / 2 reduces to the hyperbolic tangent of NDVI squared
        "kNDVI": lambda: F.tanh(ndvi * ndvi),
        "NIRv": lambda: ndvi * n,
        "NDMI": lambda: _normalised_difference(n, band("B11")),
        "NDWI": lambda: _normalised_difference(g, n),
        "IRECI": lambda: F.try_divide(band("B07") - r, F.try_divide(band("B05"), band("B06"))),
        "CIRE": lambda: F.try_divide(n, band("B05")) - 1.0,
    }
    return formulas[name]()


INDEX_NAMES = ["NDVI", "kNDVI", "NIRv", "NDMI", "NDWI", "IRECI", "CIRE"]


def add_indices(df: DataFrame, names: list[str] = INDEX_NAMES, band=F.col) -> DataFrame:
    return df.withColumns({n: spectral_index(n, band) for n in names})
