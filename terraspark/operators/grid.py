"""Grids: tiling, extents, affine arithmetic, regridding and mosaics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def windows(spark: SparkSession, width: int, height: int, size: int) -> DataFrame:
    """Row-major windows that cover a grid once; the last ones are ragged."""
    rows = spark.range(0, height, size).select(F.col("id").cast("int").alias("row_off"))
    columns = F.explode(F.sequence(F.lit(0), F.lit(width - 1), F.lit(size))).alias("col_off")
    out = rows.select("row_off", columns)
    return out.select(
        (F.floor(F.col("row_off") / size) * math.ceil(width / size) + F.floor(F.col("col_off") / size)).cast("int").alias("window_id"),
        "row_off", "col_off", F.least(F.lit(size), F.lit(height) - F.col("row_off")).alias("height"), F.least(F.lit(size), F.lit(width) - F.col("col_off")).alias("width"),
    )


def window_of(r: Column, c: Column, size: int, width: int) -> Column:
    return (F.floor(r / size) * math.ceil(width / size) + F.floor(c / size)).cast("int")


def evenly_spaced(wins: DataFrame, n: int) -> DataFrame:
    """``n`` windows at equal steps of the row-major order."""
    total = wins.count()
    step = max(total // n, 1)
    return wins.where((F.col("window_id") % step == 0) & (F.col("window_id") < step * n))


def central_window(df: DataFrame, width: int, height: int, size: int) -> DataFrame:
    """The central square, with rows and columns counted from its corner."""
    r0, c0 = max((height - size) // 2, 0), max((width - size) // 2, 0)
    inside = df.where((F.col("r") >= r0) & (F.col("r") < r0 + size) & (F.col("c") >= c0) & (F.col("c") < c0 + size))
    return inside.withColumns({"r": F.col("r") - r0, "c": F.col("c") - c0})


def common_extent(catalog: DataFrame) -> DataFrame:
    """Intersection of bounds at the finest resolution: one row with width and height in cells."""
    out = catalog.agg(*[f(c).alias(c) for f, c in ((F.max, "left"), (F.max, "bottom"), (F.min, "right"), (F.min, "top"), (F.min, "res"))], F.count_distinct("crs").alias("n_crs"))
    span = lambda a, b: F.greatest(F.floor((F.col(a) - F.col(b)) / F.col("res")), F.lit(0)).cast("int")
    return out.withColumns({"width": span("right", "left"), "height": span("top", "bottom")})


def world(r: Column, c: Column, left: Column, top: Column, res: Column) -> tuple[Column, Column]:
    """x and y of a cell's centre."""
    return left + (c + 0.5) * res, top - (r + 0.5) * res


def cell(x: Column, y: Column, left: Column, top: Column, res: Column) -> tuple[Column, Column]:
    """Row and column that hold a point."""
    return F.floor((top - y) / res).cast("int"), F.floor((x - left) / res).cast("int")


def target_grid(spark: SparkSession, rows: int, columns: int) -> DataFrame:
    return spark.range(rows).select(F.col("id").cast("int").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("c"))


def regrid_nearest(df: DataFrame, value: str, target: DataFrame, ratio: float) -> DataFrame:
    """``value`` at each target cell from the source cell under its centre; ``ratio`` = target over source resolution."""
    at = target.withColumns({"sr": F.floor((F.col("r") + 0.5) * ratio).cast("int"), "sc": F.floor((F.col("c") + 0.5) * ratio).cast("int")})
    source = df.select(F.col("r").alias("sr"), F.col("c").alias("sc"), value)
    return at.join(source, ["sr", "sc"], "left").select("r", "c", value)


def regrid_bilinear(df: DataFrame, value: str, target: DataFrame, ratio: float) -> DataFrame:
    """Weighted mean of the four source cells around each target centre; missing ones are left out of the weights."""
    y, x = (F.col("r") + 0.5) * ratio - 0.5, (F.col("c") + 0.5) * ratio - 0.5
    return _bilinear(df, value, target, target.withColumns({"y": y, "x": x}))


def _bilinear(df: DataFrame, value: str, target: DataFrame, at: DataFrame) -> DataFrame:
    """Weighted means around the places ``y, x`` (in cells, centres whole) of ``at``."""
    at = at.withColumns({"y0": F.floor("y").cast("int"), "x0": F.floor("x").cast("int")})
    fy, fx = F.col("y") - F.col("y0"), F.col("x") - F.col("x0")
    corner = lambda dy, dx, w: F.struct((F.col("y0") + dy).alias("sr"), (F.col("x0") + dx).alias("sc"), w.alias("w"))
    corners = F.array(corner(0, 0, (1 - fy) * (1 - fx)), corner(0, 1, (1 - fy) * fx), corner(1, 0, fy * (1 - fx)), corner(1, 1, fy * fx))
    at = at.select("r", "c", F.inline(corners))
    source = df.select(F.col("r").alias("sr"), F.col("c").alias("sc"), F.col(value).alias("v_"))
    out = at.join(source, ["sr", "sc"]).where("w > 0").groupBy("r", "c").agg((F.sum(F.col("w") * F.col("v_")) / F.sum("w")).alias(value))
    return target.join(out, ["r", "c"], "left").select("r", "c", value)


def mosaic(tiles: DataFrame, value: str, nodata: int = 0) -> DataFrame:
    """Union of placed tiles; where they overlap the highest ``priority`` with data wins."""
    return tiles.where(F.col(value) != nodata).groupBy("r", "c").agg(F.max_by(value, "priority").alias(value))


#: Fixed defining constants of the Lambert-93 projection (GRS 80 ellipsoid, degrees, metres).
LAMBERT93 = {"a": 6378137.0, "f": 1 / 298.257222101, "lat1": 44.0, "lat2": 49.0, "lat0": 46.5, "lon0": 3.0, "x0": 700000.0, "y0": 6600000.0}


def _lambert() -> tuple[float, float, float, float]:
    p = LAMBERT93
    e = math.sqrt(2 * p["f"] - p["f"] ** 2)
    m = lambda lat: math.cos(lat) / math.sqrt(1 - (e * math.sin(lat)) ** 2)
    t = lambda lat: math.tan(math.pi / 4 - lat / 2) / ((1 - e * math.sin(lat)) / (1 + e * math.sin(lat))) ** (e / 2)
    a, b, o = (math.radians(p[k]) for k in ("lat1", "lat2", "lat0"))
    n = (math.log(m(a)) - math.log(m(b))) / (math.log(t(a)) - math.log(t(b)))
    big_f = m(a) / (n * t(a) ** n)
    return e, n, big_f, p["a"] * big_f * t(o) ** n


def lambert93_to_geographic(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees; the latitude series converges in five steps to 1e-11 degrees."""
    e, n, big_f, rho0 = _lambert()
    dx, dy = x - LAMBERT93["x0"], F.lit(rho0) - (y - LAMBERT93["y0"])
    rho, theta = F.hypot(dx, dy), F.atan2(dx, dy)
    t = F.pow(rho / (LAMBERT93["a"] * big_f), F.lit(1 / n))
    lat = math.pi / 2 - 2 * F.atan(t)
    for _ in range(5):
        s = F.lit(e) * F.sin(lat)
        lat = math.pi / 2 - 2 * F.atan(t * F.pow((1 - s) / (1 + s), F.lit(e / 2)))
    return F.degrees(theta / n) + LAMBERT93["lon0"], F.degrees(lat)


def geographic_to_lambert93(lon: Column, lat: Column) -> tuple[Column, Column]:
    e, n, big_f, rho0 = _lambert()
    phi = F.radians(lat)
    s = F.lit(e) * F.sin(phi)
    t = F.tan(math.pi / 4 - phi / 2) / F.pow((1 - s) / (1 + s), F.lit(e / 2))
    rho, theta = F.lit(LAMBERT93["a"] * big_f) * F.pow(t, F.lit(n)), F.radians(lon - LAMBERT93["lon0"]) * n
    return rho * F.sin(theta) + LAMBERT93["x0"], F.lit(rho0) - rho * F.cos(theta) + LAMBERT93["y0"]


#: Points on each edge of bounds that are transformed, corners included.
EDGE_POINTS = 23


def with_geographic_bounds(df: DataFrame, points: int = EDGE_POINTS) -> DataFrame:
    """Adds ``west, south, east, north`` of Lambert-93 bounds (left, bottom, right, top).

    An edge is a curve in geographic coordinates, so extremes are taken over points
    along all four edges and not over the corners alone.
    """
    steps = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: i / (points - 1))
    along = lambda a, b: lambda f: F.col(a) + (F.col(b) - F.col(a)) * f
    x, y = along("left", "right"), along("bottom", "top")

    def at(px, py):
        lon, lat = lambert93_to_geographic(px, py)
        return F.struct(lon.alias("lon"), lat.alias("lat"))

    edges = [
        lambda f: at(x(f), F.col("bottom")),
        lambda f: at(x(f), F.col("top")),
        lambda f: at(F.col("left"), y(f)),
        lambda f: at(F.col("right"), y(f)),
    ]
    out = df.withColumn("edge_", F.concat(*[F.transform(steps, e) for e in edges]))
    ends = {"west": F.array_min("edge_.lon"), "south": F.array_min("edge_.lat"), "east": F.array_max("edge_.lon"), "north": F.array_max("edge_.lat")}
    return out.withColumns(ends).drop("edge_")


def window_bounds(df: DataFrame) -> DataFrame:
    """Adds ``left, bottom, right, top`` of windows (row_off, col_off, height, width) on a grid (grid_left, grid_top, res)."""
    left, top = F.col("grid_left") + F.col("col_off") * F.col("res"), F.col("grid_top") - F.col("row_off") * F.col("res")
    return df.withColumns({"left": left, "bottom": top - F.col("height") * F.col("res"), "right": left + F.col("width") * F.col("res"), "top": top})


def sample(df: DataFrame, value: str, target: DataFrame, to: tuple[float, float, float], source: tuple[float, float, float], whole_offsets: bool = False) -> DataFrame:
    """``value`` of the source cell under each target cell's centre; grids are (left, top, resolution), cells outside give null.

    With ``whole_offsets`` the window begins at a whole source cell (its offset truncated).
    """
    (left, top, res), (source_left, source_top, source_res) = to, source
    row0, col0 = (source_top - top) / source_res, (left - source_left) / source_res
    if whole_offsets:
        row0, col0 = int(row0), int(col0)
    ratio = res / source_res
    at = target.withColumns({"sr": F.floor(F.lit(float(row0)) + (F.col("r") + 0.5) * ratio).cast("int"), "sc": F.floor(F.lit(float(col0)) + (F.col("c") + 0.5) * ratio).cast("int")})
    return at.join(df.select(F.col("r").alias("sr"), F.col("c").alias("sc"), value), ["sr", "sc"], "left").select("r", "c", value)


def warp(df: DataFrame, value: str, target: DataFrame, x: Column, y: Column, source: tuple[float, float, float], method: str = "bilinear") -> DataFrame:
    """``value`` of a source grid (left, top, resolution) at each target cell, whose place in the source's coordinates is ``x, y``.

    ``bilinear`` is the weighted mean of the four cells around, of those that have a
    value; ``nearest`` takes the cell that holds the point.  Outside it is null.
    """
    if method not in ("bilinear", "nearest"):
        raise ValueError(method)
    left, top, res = source
    at = target.withColumns({"y": (F.lit(top) - y) / res, "x": (x - F.lit(left)) / res})
    if method == "nearest":
        at = at.withColumns({"sr": F.floor("y").cast("int"), "sc": F.floor("x").cast("int")})
        return at.join(df.select(F.col("r").alias("sr"), F.col("c").alias("sc"), value), ["sr", "sc"], "left").select("r", "c", value)
    return _bilinear(df, value, target, at.withColumns({"y": F.col("y") - 0.5, "x": F.col("x") - 0.5}))


def masked(inference: DataFrame, inference_grid: tuple[float, float, float], mask: DataFrame, mask_grid: tuple[float, float, float], shapes: tuple[tuple[int, int], tuple[int, int]], value: str = "v", flag: str = "m") -> DataFrame:
    """``r, c, value`` of a raster on the common extent at the finest resolution, 0 where the mask is not 1.

    Grids are (left, top, resolution), shapes (rows, columns).  The extent is the
    intersection of both bounds; each raster is sampled there at the cells' centres.
    """
    spark = inference.sparkSession
    bounds = [(g[0], g[1] - s[0] * g[2], g[0] + s[1] * g[2], g[1], g[2], "same") for g, s in zip((inference_grid, mask_grid), shapes, strict=True)]
    extent = common_extent(spark.createDataFrame(bounds, "left double, bottom double, right double, top double, res double, crs string")).first()
    to = (extent.left, extent.top, extent.res)
    cells = target_grid(spark, extent.height, extent.width)
    both = sample(inference, value, cells, to, inference_grid).join(sample(mask, flag, cells, to, mask_grid), ["r", "c"])
    return both.select("r", "c", F.when(F.col(flag) == 1, F.coalesce(F.col(value), F.lit(0))).otherwise(F.lit(0)).alias(value))


def require_one_crs(catalog: DataFrame, crs: str = "crs") -> str | None:
    """The reference system that all inputs share (None without any); ValueError if there are several."""
    found = [r[0] for r in catalog.select(crs).distinct().limit(2).collect()]
    if len(found) > 1:
        raise ValueError(f"inputs differ in their reference system: {sorted(map(str, found))}")
    return found[0] if found else None


def height_mask(heights: DataFrame, value: str, target: DataFrame, ratio: float, least: float = 0.0) -> DataFrame:
    """``r, c, forest``: 1 where the nearest canopy height is at least ``least``, else 0."""
    x = regrid_nearest(heights, value, target, ratio)
    return x.select("r", "c", F.when(F.col(value) >= least, 1).otherwise(0).alias("forest"))


def nearest_window_with(df: DataFrame, wins: DataFrame, size: int, width: int, r: int, c: int) -> DataFrame:
    """The window with data that is closest (in windows, larger of both directions) to the one at (r, c)."""
    filled = df.select(window_of(F.col("r"), F.col("c"), size, width).alias("window_id")).distinct()
    distance = F.greatest(F.abs(F.floor(F.col("row_off") / size) - r // size), F.abs(F.floor(F.col("col_off") / size) - c // size))
    x = wins.join(filled, "window_id", "left_semi").withColumn("distance", distance)
    return x.agg(F.min_by(F.struct("window_id", "row_off", "col_off", "distance"), F.struct("distance", "window_id")).alias("w")).select("w.*")


def contained(left: str, bottom: str, right: str, top: str, extent: tuple[float, float, float, float]) -> Column:
    """Whether bounds lie inside an extent (left, bottom, right, top)."""
    return F.col(left).between(extent[0], extent[2]) & F.col(right).between(extent[0], extent[2]) & F.col(bottom).between(extent[1], extent[3]) & F.col(top).between(extent[1], extent[3])
