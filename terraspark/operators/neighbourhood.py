"""Neighbourhood operators on dense rasters, as window functions over rows and columns.

A disk is a stack of horizontal runs: each run is a range frame along a row, and the
runs of the rows around are fetched by one frame along the column.  So a disk of
1961 cells costs 26 running sums and 51 look-ups a cell, not 1961 joined rows.
Rasters must be dense: a missing cell hides the runs around its place.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def half_widths(radius: int) -> list[int]:
    """Half width of the run at each row distance 0..radius."""
    return [math.isqrt(radius * radius - d * d) for d in range(radius + 1)]


def _disk(df: DataFrame, values: dict[str, Column], how, merge, radius: int, by: Sequence[str]) -> DataFrame:
    widths = half_widths(radius)
    along = Window.partitionBy(*by, "r").orderBy("c")
    across = Window.partitionBy(*by, "c").orderBy("r")
    runs = {f"{name}_run_{w}": how(v).over(along.rangeBetween(-w, w)) for name, v in values.items() for w in sorted(set(widths))}
    out = df.withColumns(runs)
    picked = {}
    for name in values:
        rows = [F.first(f"{name}_run_{widths[abs(d)]}").over(across.rangeBetween(d, d)) for d in range(-radius, radius + 1)]
        picked[name] = merge(rows)
    return out.select(*df.columns, *[v.alias(n) for n, v in picked.items()])


def dilate_disk(df: DataFrame, mask: str, out: str, radius: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """Adds the maximum of ``mask`` over a disk."""
    return _disk(df, {out: F.col(mask)}, F.max, lambda rows: F.greatest(*rows), radius, by)


def mean_disk(df: DataFrame, byte: str, out: str, radius: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """Adds the integer part of the mean of 0-255 values over a disk's cells inside the raster."""
    total = lambda rows: sum((F.coalesce(x, F.lit(0)) for x in rows[1:]), F.coalesce(rows[0], F.lit(0)))
    both = _disk(df, {"sum_": F.col(byte).cast("long"), "cells_": F.lit(1).cast("long")}, F.sum, total, radius, by)
    return both.withColumn(out, F.floor(F.col("sum_") / F.col("cells_")).cast("int")).drop("sum_", "cells_")


def qa_weights(df: DataFrame, flg: str = "flg", out: str = "weight", dilation: int = 5, mean: int = 25, by: Sequence[str] = ()) -> DataFrame:
    """Clear cells dilated, then averaged, in steps of 1/255."""
    clear = df.withColumn("clear_", F.when(F.col(flg).isin(1, 2, 3), F.lit(0)).otherwise(F.lit(1)))
    wide = dilate_disk(clear, "clear_", "wide_", dilation, by).withColumn("wide_", F.col("wide_") * 255)
    return mean_disk(wide, "wide_", "mean_", mean, by).withColumn(out, F.col("mean_") / F.lit(255.0)).drop("clear_", "wide_", "mean_")


def kernel(sigma: float, truncate: float = 4.0) -> list[float]:
    """Half of a normalised Gaussian: the weights at distance 0, 1, ..."""
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(radius + 1)]
    total = raw[0] + 2 * sum(raw[1:])
    return [w / total for w in raw]


def _smooth_lines(df: DataFrame, value: str, line: str, place: str, weights: list[float], by: Sequence[str]) -> DataFrame:
    """Convolution along dense lines; a line is one array, mirrored at its ends."""
    lines = df.groupBy(*by, line).agg(F.array_sort(F.collect_list(F.struct(place, value))).alias("cells_"))
    lines = lines.select(*by, line, F.col(f"cells_.{place}").alias("places_"), F.col(f"cells_.{value}").alias("v_"))

    def at(i: Column) -> Column:
        n = F.size("v_")
        m = F.pmod(i, 2 * n)
        return F.element_at("v_", F.when(m < n, m).otherwise(2 * n - 1 - m).cast("int") + 1)

    def smoothed(i: Column) -> Column:
        out = at(i) * weights[0]
        for k, w in enumerate(weights[1:], 1):
            out = out + (at(i - k) + at(i + k)) * w
        return out

    values = F.transform(F.sequence(F.lit(0), F.size("v_") - 1), smoothed)
    return lines.select(*by, line, F.inline(F.arrays_zip(F.col("places_").alias(place), values.alias(value))))


def gaussian(df: DataFrame, value: str, sigma: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """Separable Gaussian smoothing: ``by, r, c, value``."""
    w = kernel(sigma)
    x = df.select(*by, "r", "c", F.col(value).cast("double").alias(value))
    return _smooth_lines(_smooth_lines(x, value, "c", "r", w, by), value, "r", "c", w, by)


def gradient(df: DataFrame, value: str, resolution: float, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``dy`` (along rows downward) and ``dx``: central differences, one-sided at the edges."""

    def slope(w) -> Column:
        before, after = F.lag(value).over(w), F.lead(value).over(w)
        v = F.col(value)
        return F.when(before.isNull(), (after - v) / resolution).when(after.isNull(), (v - before) / resolution).otherwise((after - before) / (2 * resolution))

    return df.withColumns({"dy": slope(Window.partitionBy(*by, "c").orderBy("r")), "dx": slope(Window.partitionBy(*by, "r").orderBy("c"))})


def aspect(dy: Column, dx: Column) -> Column:
    """Direction of slope in degrees, 0 to 360 (above 360 never, below 0 wrapped)."""
    a = 90.0 - F.degrees(F.atan2(dy, dx))
    return F.when(a < 0, a + 360.0).otherwise(a)


def hillshade(aspect_degrees: Column, azimuth: float = 5 * math.pi / 4, altitude: float = math.pi / 4) -> Column:
    x = F.cos(F.radians(aspect_degrees) - azimuth) * math.sin(altitude)
    return 0.3 + 0.7 * (x + 1) / 2
