"""Reflectance, vegetation indices and quality weights as native column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BANDS = ("b2", "b4", "b8", "b11", "b12")
INDICES = ("ndvi", "evi", "nbr", "crswir")
NODATA = 65535
EPSILON = 1e-8
#: Fixed wavelengths (nm) of the continuum-removed short-wave infrared ratio.
CRSWIR_SLOPE = (1610 - 842) / (2190 - 842)


def clip(x: Column, low: float, high: float) -> Column:
    """``x`` within bounds; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def safe_divide(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def reflectance(dn: Column, nodata: int = NODATA, scale: float = 10000.0) -> Column:
    """Digital number to reflectance; nodata becomes null."""
    return F.nullif(dn, F.lit(nodata)) / F.lit(scale)


def ndvi(b4: Column, b8: Column) -> Column:
    return clip(safe_divide(b8 - b4, b8 + b4 + EPSILON), -1.0, 1.0) / 2 + 0.5


def evi(b2: Column, b4: Column, b8: Column) -> Column:
    return clip(safe_divide(2.5 * (b8 - b4), b8 + 6.0 * b4 - 7.5 * b2 + 1.0 + EPSILON), -1.0, 1.0) / 2 + 0.5


def nbr(b8: Column, b12: Column) -> Column:
    return clip(safe_divide(b8 - b12, b8 + b12 + EPSILON), -1.0, 1.0) / 2 + 0.5


def crswir(b8: Column, b11: Column, b12: Column) -> Column:
    return clip(safe_divide(b11, (b12 - b8) * F.lit(CRSWIR_SLOPE) + b8 + EPSILON), 0.0, 5.0) / 5


def to_reflectance(df: DataFrame, bands: Sequence[str] = BANDS, nodata: int = NODATA) -> DataFrame:
    return df.withColumns({b: reflectance(F.col(b), nodata) for b in bands})


def with_indices(df: DataFrame, fill_zero: bool = False) -> DataFrame:
    """Adds the four indices to reflectance bands; ``fill_zero`` cleans nulls as the first generation did."""
    b2, b4, b8, b11, b12 = (F.col(b) for b in BANDS)
    out = {"ndvi": ndvi(b4, b8), "evi": evi(b2, b4, b8), "nbr": nbr(b8, b12), "crswir": crswir(b8, b11, b12)}
    if fill_zero:
        out = {k: F.coalesce(v, F.lit(0.0)) for k, v in out.items()}
    return df.withColumns(out)


def any_null(columns: Sequence[str]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).isNull()
    return out


def quality_weight(bands: Sequence[str] = BANDS, mask: Column | None = None) -> Column:
    """Cloud mask in [0, 1] (1 without one) times 0 where any band is null."""
    return F.when(any_null(bands), F.lit(0.0)).otherwise(F.coalesce(mask, F.lit(1.0)) if mask is not None else F.lit(1.0))


def is_flagged(flg: Column) -> Column:
    """Cloud, snow or water."""
    return flg.isin(1, 2, 3)
