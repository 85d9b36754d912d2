"""Pixel tables: windowed and pruned reads, partitioned writes, tile mosaics and statistics sidecars."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_window(df: DataFrame, bands: Sequence[str], row_off: int, col_off: int, height: int, width: int, keys: Sequence[str] = ("pixel_id", "r", "c")) -> DataFrame:
    """The chosen bands of one window; bands and rows are pruned in the scan."""
    inside = (F.col("r") >= row_off) & (F.col("r") < row_off + height) & (F.col("c") >= col_off) & (F.col("c") < col_off + width)
    return df.where(inside).select(*keys, *bands)


def write_tiles(df: DataFrame, path: str, tile: str = "tile_id", nodata: dict[str, int] | None = None, mode: str = "overwrite") -> None:
    """One directory a tile, rows sorted for pruning; nulls become each band's nodata number."""
    if nodata:
        df = df.na.fill(nodata)
    df.repartition(tile).sortWithinPartitions(tile, "r", "c").write.mode(mode).partitionBy(tile).option("compression", "zstd").parquet(path)


def write_checked(df: DataFrame, path: str, expected: int) -> None:
    """Writes and reads the count back; ValueError if it differs."""
    df.write.mode("overwrite").parquet(path)
    if (n := df.sparkSession.read.parquet(path).count()) != expected:
        raise ValueError(f"{path}: {n} rows written, {expected} expected")


def place_tiles(tiles: DataFrame, offsets: DataFrame, tile: str = "tile_id") -> DataFrame:
    """Tile pixels moved to their places in a mosaic (tile, row_off, col_off, priority)."""
    x = tiles.join(F.broadcast(offsets) if offsets.isLocal() else offsets, tile)
    return x.withColumns({"r": F.col("r") + F.col("row_off"), "c": F.col("c") + F.col("col_off")}).drop("row_off", "col_off")


def read_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """Key and value of each statistics item of an XML sidecar."""
    x = spark.read.format("xml").option("rowTag", "MDI").load(path)
    return x.select(F.col("_key").alias("key"), F.col("_VALUE").cast("double").alias("value"))


def blocks(df: DataFrame, value: str, size: int, by: Sequence[str] = ()) -> DataFrame:
    """Dense blocks of a raster as arrays: (by, block_row, block_col, height, width, data)."""
    x = df.withColumns({"block_row": F.floor(F.col("r") / size).cast("int"), "block_col": F.floor(F.col("c") / size).cast("int")})
    x = x.groupBy(*by, "block_row", "block_col").agg(
        (F.max("r") - F.min("r") + 1).alias("height"), (F.max("c") - F.min("c") + 1).alias("width"), F.array_sort(F.collect_list(F.struct("r", "c", F.col(value).alias("v")))).alias("cells")
    )
    return x.select(*by, "block_row", "block_col", "height", "width", F.col("cells.v").alias("data"))


def synthetic_series(spark: SparkSession, pixels: int = 100, dates: int = 36, step_days: int = 10, start: str = "2021-01-01", noise: float = 0.1, missing: float = 0.2, seed: int = 42) -> DataFrame:
    """(pixel_id, obs_date, y): two sines over a base with seeded noise and gaps; the same for any partitioning."""
    day = F.explode(F.sequence(F.lit(0), F.lit(dates - 1))).alias("i")
    x = spark.range(pixels).select(F.col("id").alias("pixel_id"), day)
    u = lambda k: (F.pmod(F.xxhash64("pixel_id", "i", F.lit(seed + k)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    normal = F.sqrt(-2.0 * F.log(u(1))) * F.cos(2 * math.pi * u(2))
    t = F.col("i") * step_days / 365.25
    y = 0.5 + 0.3 * F.sin(2 * math.pi * t + 0.5) + 0.15 * F.sin(4 * math.pi * t + 1.0) + noise * normal
    return x.select("pixel_id", F.date_add(F.lit(start).cast("date"), (F.col("i") * step_days).cast("int")).alias("obs_date"), F.when(u(3) >= missing, y).alias("y"))


def sine_series(spark: SparkSession, pixels: int, dates: int, waves: Sequence[tuple[float, float, float]] = ((0.3, 0.2, 0.5), (0.15, 0.1, 1.0)), base: float = 0.5) -> DataFrame:
    """(pixel_id, i, y): a base and waves (amplitude, phase, frequency) over one turn, without noise or gaps."""
    x = spark.range(pixels).select(F.col("id").alias("pixel_id"), F.explode(F.sequence(F.lit(0), F.lit(dates - 1))).alias("i"))
    turn = F.col("i") * (2 * math.pi / max(dates - 1, 1))
    return x.withColumn("y", sum((a * F.sin(f * turn + p) for a, p, f in waves), F.lit(base)))


def central_windows(df: DataFrame, by: Sequence[str], size: int) -> DataFrame:
    """The central square of each raster named by ``by`` (year, period, tile), cells counted from its corner; one pass over all rasters."""
    shapes = df.groupBy(*by).agg((F.max("r") + 1).alias("rows_"), (F.max("c") + 1).alias("columns_"))
    x = df.join(F.broadcast(shapes) if shapes.limit(100_001).count() <= 100_000 else shapes, list(by))
    r0, c0 = (F.greatest(F.floor((F.col(n) - size) / 2), F.lit(0)).cast("int") for n in ("rows_", "columns_"))
    x = x.withColumns({"r": F.col("r") - r0, "c": F.col("c") - c0})
    return x.where((F.col("r") >= 0) & (F.col("r") < size) & (F.col("c") >= 0) & (F.col("c") < size)).drop("rows_", "columns_")


def list_files(spark: SparkSession, path: str, pattern: str = "*.tif") -> DataFrame:
    """``path, length, modified`` of all files below a directory; contents are not read."""
    x = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return x.select("path", "length", F.col("modificationTime").alias("modified"))


def tile_metadata(tiles: DataFrame, size: float = 50_000.0, cells: int = 5000, tile: str = "tile_id") -> DataFrame:
    """Bounds, resolution, shape and geographic bounds of tiles named ``EPSG<code>_<left>_<bottom>``; other names give nulls."""
    from ..operators import grid

    part = lambda i: F.try_to_number(F.nullif(F.regexp_extract(tile, r"^EPSG(\d+)_(\d+)_(\d+)$", i), F.lit("")), F.lit("9999999999")).cast("double")
    x = tiles.select(tile, F.concat(F.lit("EPSG:"), part(1).cast("int")).alias("crs"), part(2).alias("left"), part(3).alias("bottom"))
    x = x.withColumns({"right": F.col("left") + size, "top": F.col("bottom") + size, "res": F.lit(size / cells), "width": F.lit(cells), "height": F.lit(cells)})
    return grid.with_geographic_bounds(x)


def quarantine(screened: DataFrame, path: str, status: str = "status") -> DataFrame:
    """Writes all files by status (one directory each) and returns the counts."""
    screened.write.mode("overwrite").partitionBy(status).parquet(path)
    return screened.groupBy(status).agg(F.count("*").alias("n"))
