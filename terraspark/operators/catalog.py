"""File catalogs: tiles, dates, pairs and time series parsed from paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed forms of the files' names, which must match the data.
TILE = r"s2_(EPSG\d+_\d+_\d+)\.tif$"
PERIOD = r"/(\d{4})/(\d{2})-(\d{2})_plus_minus_30_days/"
SINGLE_DATE = r"(\d{4})-(\d{2})-(\d{2})_[^/]*S2[AB]_DL_PHENOLOGY\.tif$"


def tile_id(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, TILE, 1), F.lit(""))


def period_date(path: Column, pattern: str = PERIOD) -> Column:
    """The date in a path (year, month, day groups), or null."""
    part = lambda i: F.regexp_extract(path, pattern, i)
    return F.to_date(F.when(part(1) != "", F.concat_ws("-", part(1), part(2), part(3))))


def token_date(path: Column, fmt: str = "yyyyMMdd", token: int = 1) -> Column:
    """Date in a token of the file name; with ``yyyyMM`` its first day."""
    name = F.regexp_extract(path, r"([^/]+)\.[^./]*$", 1)
    text = F.get(F.split(name, "_"), F.lit(token))
    return F.try_to_timestamp(text, F.lit(fmt)).cast("date")


def tiles(paths: DataFrame) -> DataFrame:
    """Distinct tiles of all dates, sorted."""
    return paths.select(tile_id(F.col("path")).alias("tile_id")).where("tile_id is not null").distinct().orderBy("tile_id")


def time_series(paths: DataFrame, years: Sequence[int] | None = None, with_dem: DataFrame | None = None) -> DataFrame:
    """One row a tile: its dates and paths in order; tiles without elevation are left out if ``with_dem`` is given."""
    x = paths.select(tile_id(F.col("path")).alias("tile_id"), period_date(F.col("path")).alias("date"), "path").where("tile_id is not null and date is not null")
    if years is not None:
        x = x.where(F.year("date").isin(*years))
    if with_dem is not None:
        x = x.join(with_dem.select("tile_id").distinct(), "tile_id", "left_semi")
    x = x.groupBy("tile_id").agg(F.array_sort(F.collect_list(F.struct("date", "path"))).alias("items"))
    return x.select("tile_id", F.col("items.date").alias("dates"), F.col("items.path").alias("paths"))


def single_dates(paths: DataFrame, years: Sequence[int] | None = None) -> DataFrame:
    """``path, date`` of files named by a single date, in order of date; ValueError if there are none."""
    x = paths.select("path", period_date(F.col("path"), SINGLE_DATE).alias("date")).where("date is not null")
    if years is not None:
        x = x.where(F.year("date").isin(*years))
    if x.isEmpty():
        raise ValueError("no file of the wanted years")
    return x.orderBy("date", "path")


def with_masks(obs: DataFrame, masks: DataFrame, keys: Sequence[str], mask: str = "clear") -> DataFrame:
    """Observations with the cloud mask of the same pixel and date; 1 (clear) where there is none."""
    return obs.join(masks.select(*keys, mask), list(keys), "left").withColumn(mask, F.coalesce(F.col(mask).cast("double"), F.lit(1.0)))


def sliced(df: DataFrame, order: Sequence[str], start: int, end: int | None = None) -> DataFrame:
    """Rows ``start`` (from 0) up to but not including ``end`` in an order of columns."""
    out = df.orderBy(*order).offset(start)
    return out if end is None else out.limit(max(end - start, 0))


def regions_by_name(metrics: DataFrame, names: DataFrame, geometry: DataFrame | None = None) -> DataFrame:
    """Metrics of regions under their translated names (region, name), with their geometry, sorted by name.

    Names and geometries are one row a region.  Regions without a translation keep a null name and come last.
    """
    out = metrics.join(names, "region", "left")
    if geometry is not None:
        out = out.join(geometry, "region", "left")
    return out.orderBy(F.col("name").asc_nulls_last(), "region")


def paired(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mosaics with their quality files, truly matched on the keys; without a match null."""
    return left.join(right, list(keys), "left")


def paired_by_position(left: DataFrame, right: DataFrame, order: str) -> DataFrame:
    """Both sides in order, matched by position; the numbering is one task, as file lists are small."""
    number = F.row_number().over(Window.orderBy(order))
    return left.withColumn("i", number).join(right.withColumn("i", number), "i").drop("i")


def first_reference(files: DataFrame, by: str, path: str = "path") -> DataFrame:
    return files.groupBy(by).agg(F.min(path).alias(path))


def middle_of_winter(dates: DataFrame, by: Sequence[str], date: str = "date") -> DataFrame:
    """The middle one (n/2 + 1) of a group's distinct dates in December, January and February."""
    winter = dates.where(F.month(date).isin(12, 1, 2)).select(*by, date).distinct()
    listed = winter.groupBy(*by).agg(F.array_sort(F.collect_list(date)).alias("d_"))
    return listed.select(*by, F.element_at("d_", (F.floor(F.size("d_") / 2) + 1).cast("int")).alias(date), F.size("d_").alias("n_winter"))
