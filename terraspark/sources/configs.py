"""Tile configurations, metadata and metrics as JSON and CSV."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TILE_CONFIG = T.StructType([
    T.StructField("tile_id", T.StringType()),
    T.StructField("mosaic_paths", T.ArrayType(T.StringType())),
    T.StructField("dates", T.ArrayType(T.DateType())),
    T.StructField("dem_path", T.StringType()),
    T.StructField("cloud_mask_paths", T.ArrayType(T.StringType())),
    T.StructField("config", T.StructType([T.StructField(n, T.IntegerType()) for n in ("window_size", "workers_per_tile", "num_harmonics", "max_iter")])),
])
DEFAULTS = {"window_size": 1024, "workers_per_tile": 4, "num_harmonics": 2, "max_iter": 1}


def tile_configs(series: DataFrame, dem_path: Column, settings: Mapping[str, int] | None = None) -> DataFrame:
    """``tile_id, json`` from (tile_id, dates, paths); a tile's own settings are kept in its configuration."""
    chosen = DEFAULTS | dict(settings or {})
    config = F.struct(*[F.lit(v).alias(k) for k, v in chosen.items()])
    body = F.struct("tile_id", F.col("paths").alias("mosaic_paths"), "dates", dem_path.alias("dem_path"), F.lit(None).cast("array<string>").alias("cloud_mask_paths"), config.alias("config"))
    return series.select("tile_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def parse_configs(df: DataFrame, column: str = "json") -> DataFrame:
    return df.select(F.from_json(column, TILE_CONFIG).alias("t")).select("t.*")


def read_configs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TILE_CONFIG).option("multiLine", True).json(path)


def missing_tiles(configs: DataFrame, expected: int, index: str = "tile_idx") -> DataFrame:
    """Indices 0..expected-1 without a configuration."""
    return configs.sparkSession.range(expected).withColumnRenamed("id", index).join(configs, index, "left_anti")


def clean_json(value):
    """NaN and infinities to null, tuples to lists, arrays and scalars of numpy to Python."""
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, dict):
        return {str(k): clean_json(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [clean_json(v) for v in value]
    if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        return None
    return value


def settings_from_yaml(path: str) -> dict[str, int]:
    """Overrides of the four settings from flat ``key: number`` lines; others keep their defaults."""
    out = dict(DEFAULTS)
    with open(path) as f:
        for line in f:
            key, _, value = line.partition("#")[0].partition(":")
            if key.strip() in out and value.strip():
                out[key.strip()] = int(value)
    return out


#: Rows of a table in the JSON report, at most: more is no report of classes and regions.
REPORT_ROWS = 100_000


def _few(df: DataFrame) -> list[dict]:
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a report of more than {REPORT_ROWS} rows: write it as a table")
    return [r.asDict() for r in rows]


def save_run(configs: DataFrame, path: str, settings: Mapping[str, int] | None = None) -> None:
    """A run's folder: tile configurations (one JSON row a tile), metadata and an empty state, all re-read by ``load_run``.

    All settings are stored with the metadata, so that a resumed run uses them again.
    """
    spark = configs.sparkSession
    configs.write.mode("overwrite").text(f"{path}/configs")
    meta = {"num_tiles": configs.count(), "settings": DEFAULTS | dict(settings or {})}
    spark.createDataFrame([(json.dumps(clean_json(meta)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
    spark.createDataFrame([], "tile_idx long, completed int, last_update timestamp").write.mode("overwrite").parquet(f"{path}/state")


def load_run(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Configurations, metadata and state of ``save_run``; ValueError if a tile's configuration is missing."""
    configs = spark.read.schema(TILE_CONFIG).json(f"{path}/configs")
    meta = spark.read.schema("num_tiles long, settings map<string,int>").json(f"{path}/metadata")
    if (n := configs.count()) != (expected := meta.first().num_tiles):
        raise ValueError(f"{path}: {n} configurations of {expected}")
    return configs, meta, spark.read.parquet(f"{path}/state")


def write_infos(tiles: DataFrame, path: str) -> None:
    """Tile metadata as JSON, one object a tile."""
    tiles.write.mode("overwrite").json(path)


def read_infos(spark: SparkSession, path: str, schema: str, order: str = "tile_id", start: int = 0, end: int | None = None) -> DataFrame:
    """Tiles ``start`` up to ``end`` of ``write_infos`` in order."""
    from ..operators.catalog import sliced

    return sliced(spark.read.schema(schema).json(path), [order], start, end)


def write_metrics(total: DataFrame, matrix: DataFrame, regions: DataFrame, path: str) -> None:
    """Three small CSV tables and one JSON document of an evaluation."""
    total.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/global")
    matrix.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/confusion")
    regions.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/regions")
    whole = {"confusion": _few(matrix), "regions": _few(regions)}
    total.sparkSession.createDataFrame([(json.dumps(clean_json(whole)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/json")


def bbox_feature(text: Column) -> Column:
    """``"x0,y0,x1,y1"`` as a GeoJSON feature."""
    from ..operators.vector import polygon_geojson

    part = lambda i: F.trim(F.get(F.split(text, ","), F.lit(i))).cast("double")
    return polygon_geojson(*[part(i) for i in range(4)])


def job_summary(configs: DataFrame) -> list[str]:
    """Lines of a summary: tiles, dates and the settings in use."""
    one = configs.agg(F.count("*").alias("tiles"), F.max(F.size("dates")).alias("dates"), F.max("config").alias("config")).first()
    lines = [f"tiles: {one.tiles}", f"dates: {one.dates}"]
    return lines + [f"{k}: {v}" for k, v in (one.config.asDict() if one.config else {}).items()]
