"""Integer encodings of features and probabilities; 65535 is nodata in 16 bits."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spectral import clip

TOP = 65535


def encode_unit(x: Column) -> Column:
    """[0, 1] to 0..65535, truncated; null is nodata."""
    return F.coalesce(F.floor(clip(x, 0.0, 1.0) * TOP).cast("int"), F.lit(TOP))


def encode_phase(x: Column) -> Column:
    """[-pi, pi] to 0..65535, truncated; null is nodata."""
    return F.coalesce(F.floor(clip((x + math.pi) / (2 * math.pi), 0.0, 1.0) * TOP).cast("int"), F.lit(TOP))


def decode_unit(x: Column) -> Column:
    return F.nullif(x, F.lit(TOP)) / F.lit(float(TOP))


def decode_phase(x: Column) -> Column:
    return decode_unit(x) * (2 * math.pi) - math.pi


def probability_to_byte(p: Column) -> Column:
    """Truncates; null stays null and becomes 0 only in an exported raster."""
    return F.floor(clip(p, 0.0, 1.0) * 255).cast("int")


def classify(v: Column, threshold: int = 128, null_safe: bool = False) -> Column:
    """1 deciduous, 2 evergreen; with ``null_safe`` nodata (0 or null) stays null."""
    out = F.when(v >= threshold, F.lit(2)).otherwise(F.lit(1))
    return F.when(v.isNotNull() & (v != 0), out) if null_safe else out


def apply_mask(mask: Column, v: Column) -> Column:
    return F.when(mask == 1, v).otherwise(F.lit(0))
