"""Processing state as an append-only table, and checks of catalogs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(events: DataFrame, key: str = "tile_idx") -> DataFrame:
    """Last state of each tile in an append-only table (key, completed, last_update)."""
    return events.groupBy(key).agg(F.max("last_update").alias("last_update"), F.max("completed").alias("completed"))


def remaining(tiles: DataFrame, state: DataFrame, key: str = "tile_idx") -> DataFrame:
    return tiles.join(state.where("completed = 1"), key, "left_anti")


def progress(tiles: DataFrame, state: DataFrame, key: str = "tile_idx") -> DataFrame:
    """Total, completed, remaining and percent in one row."""
    x = tiles.join(state.where("completed = 1").select(key, F.lit(1).alias("done")), key, "left")
    x = x.agg(F.count("*").alias("total"), F.count("done").alias("completed"))
    return x.withColumns({"remaining": F.col("total") - F.col("completed"), "percent": F.coalesce(100.0 * F.col("completed") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0))})


def append_completed(spark, path: str, tile_ids: Sequence[int]) -> None:
    """Adds completed tiles; appends never overwrite each other, and repeats do no harm."""
    rows = spark.createDataFrame([(int(t),) for t in tile_ids], "tile_idx long")
    rows.withColumns({"completed": F.lit(1), "last_update": F.current_timestamp()}).coalesce(1).write.mode("append").parquet(path)


def unmapped(df: DataFrame, column: str, known: Sequence) -> DataFrame:
    """Distinct values of a column that a map doesn't know."""
    values = df.select(F.col(column).alias("value")).where("value is not null").distinct()
    kind = dict(values.dtypes)["value"]
    return values.join(df.sparkSession.createDataFrame([(k,) for k in known], f"value {kind}"), "value", "left_anti")


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def validate_bands(obs: DataFrame, keys: Sequence[str], date: str, bands: Sequence[str], dem: DataFrame | None = None, mask: str | None = None) -> DataFrame:
    """``problem, n`` of a cube's violations: dates on which not all pixels have a row, (pixel, date) pairs that occur twice, bands missing as columns, masks outside [0, 1], pixels without elevation and elevations without a pixel."""
    pixels = obs.select(*keys).distinct()
    n = pixels.count()
    per_date = obs.groupBy(date).agg(F.count("*").alias("rows"), F.count_distinct(*keys).alias("pixels"))
    found = per_date.agg(F.count_if(F.col("pixels") != n).alias("ragged_dates"), F.coalesce(F.sum(F.col("rows") - F.col("pixels")), F.lit(0)).alias("repeated_rows"))
    found = found.withColumn("missing_bands", F.lit(len(missing_columns(obs, bands))).cast("long"))
    if mask:
        found = found.crossJoin(obs.agg(F.count_if(~F.col(mask).between(0, 1)).alias("bad_mask")))
    if dem is not None:
        heights = dem.select(*keys).distinct()
        found = found.crossJoin(pixels.join(heights, list(keys), "left_anti").agg(F.count("*").alias("no_elevation")))
        found = found.crossJoin(heights.join(pixels, list(keys), "left_anti").agg(F.count("*").alias("no_pixel")))
    return found.unpivot([], found.columns, "problem", "n")


def invalid_inputs(configs: DataFrame, existing: DataFrame, harmonics: int, max_iter: int) -> DataFrame:
    """``tile_id, problem`` of tile configurations that can't be run: lists of unequal length, files that don't exist, parameters below 1."""
    if harmonics < 1 or max_iter < 1:
        raise ValueError("at least one harmonic and one iteration are needed")
    lengths = configs.where(F.size("mosaic_paths") != F.size("dates")).select("tile_id", F.lit("dates do not match paths").alias("problem"))
    masks = configs.where(F.col("cloud_mask_paths").isNotNull() & (F.size("cloud_mask_paths") != F.size("dates"))).select("tile_id", F.lit("dates do not match cloud masks").alias("problem"))
    files = configs.select("tile_id", F.explode("mosaic_paths").alias("path")).join(existing.select("path"), "path", "left_anti")
    return lengths.unionByName(masks).unionByName(files.select("tile_id", F.lit("a file is missing").alias("problem")).distinct())


def validate_cube(obs: DataFrame, keys: Sequence[str], date: str, n_dates: int, mask: str | None = None) -> DataFrame:
    """One row: pixels, those with another number of dates than ``n_dates``, mask values outside [0, 1]."""
    bad = F.count_if(~F.col(mask).between(0, 1)) if mask else F.lit(0)
    per = obs.groupBy(*keys).agg(F.count_distinct(date).alias("n"), bad.alias("bad"))
    return per.agg(F.count("*").alias("pixels"), F.count_if(F.col("n") != n_dates).alias("ragged"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad_mask"))
