"""Further registered queries: robust inference, models as data, warps, polygons, catalogs and writers read back."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import codec
from ..functions import spectral as S
from ..operators import catalog, compare, grid, harmonic, model, neighbourhood, state, vector
from ..operators.lineage import cut, shared_dir
from ..sources import configs, rasters
from . import comparison, inference

WIDTH = 50
BOX_GRID = (0.0, 40.0)


def _r(column, digits: int = 6):
    return F.round(column, digits)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[_r(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _dem(spark, d):
    return X.grid(spark, d).where("pixel_id % 7 <> 0").select("pixel_id", "elevation")


def _indexed(spark, d):
    return S.with_indices(S.to_reflectance(harmonic.time_axis(X.observations(spark, d))))


def _files(spark, d):
    return X.paths(spark, d).select("path", catalog.tile_id(F.col("path")).alias("tile_id"), catalog.period_date(F.col("path")).alias("date"))


# --- robust inference


def features_irls(spark, d):
    x = _rounded(inference.feature_table(X.observations(spark, d), _dem(spark, d), max_iter=3), 5)
    # A rounded zero has no sign.
    return x.select(*[(F.col(c) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in x.dtypes])


def probability_map_irls(spark, d):
    return _rounded(inference.probability_map(X.observations(spark, d), _dem(spark, d), max_iter=3))


def robust_by_key(spark, d):
    fitted = harmonic.robust(_indexed(spark, d), ["pixel_id"], ["ndvi"], 2, 3)
    return _rounded(harmonic.parameters(fitted, ["pixel_id"], 2, "ndvi", [F.col("variance_ndvi").alias("residual_variance")]))


def irls_until(spark, d):
    x = _indexed(spark, d).select((F.floor(F.col("r") / 20)).alias("win"), "pixel_id", "t", "ndvi")
    out = harmonic.irls_until(x, ["pixel_id"], "ndvi", 1, 3, group=["win"])
    return out.select("pixel_id", "win", *[_r(F.col(f"x_{i}_y")).alias(f"x_{i}") for i in range(3)], "iterations")


def forest_nodes(trees: int = 100) -> list[tuple]:
    """A full forest of depth 3 by rule: feature, threshold and probability follow from the tree's and the node's number."""
    names = [f"{y}_{n}" for y in S.INDICES for n in ("amplitude_h1", "cos_phase_h1", "offset")]
    out = []
    for t in range(trees):
        out += [(t, k, names[(t * 7 + k * 3) % 12], (t * 13 + k * 5) % 100 / 100, 2 * k + 1, 2 * k + 2, None) for k in range(7)]
        out += [(t, k, None, None, None, None, (t * 31 + k * 17) % 101 / 100) for k in range(7, 15)]
    return out


def forest_score(spark, d):
    x = cut(_rounded(inference.feature_table(X.observations(spark, d))))
    return _rounded(model.score(x, forest_nodes()).select("pixel_id", "probability"))


def model_roundtrip(spark, d):
    path = _folder(spark, "model")
    model.save_nodes(spark, model.DEMO_TREES, path)
    return spark.createDataFrame(model.load_nodes(spark, path), model.NODES)


def remaining_inference(spark, d):
    x = X.observations(spark, d).withColumn("tile_idx", F.floor(F.col("r") / 10))
    done = x.select("tile_idx").distinct().select("tile_idx", F.when(F.col("tile_idx") % 3 == 0, 1).otherwise(0).alias("completed"))
    return _rounded(inference.remaining_inference(x, done))


def classify_with_aspect(spark, d):
    cells = X.grid(spark, d)
    encoded = inference.encoded_features(X.observations(spark, d)).join(cells.select("pixel_id", "r", "c"), "pixel_id")
    return _rounded(inference.classify_with_aspect(encoded, cells.select("r", "c", "elevation"), 10.0).select("pixel_id", "value", "aspect"), 4)


def gaussian_smooth_3(spark, d):
    return _rounded(neighbourhood.gaussian(X.grid(spark, d), "elevation", 3.0))


# --- joins


def cloud_mask_join(spark, d):
    x = X.observations(spark, d).select("pixel_id", "obs_date", "b2").distinct()
    masks = x.where("pixel_id % 3 <> 0").select("pixel_id", "obs_date").distinct().withColumn("clear", F.when(F.dayofmonth("obs_date") % 2 == 0, 0.25).otherwise(1.0))
    return catalog.with_masks(x, masks, ["pixel_id", "obs_date"])


def cloud_mask_weights(spark, d):
    x = S.to_reflectance(X.observations(spark, d))
    masks = x.where("pixel_id % 3 <> 0").select("pixel_id", "obs_date").distinct().withColumn("clear", F.when(F.dayofmonth("obs_date") % 2 == 0, 0.25).otherwise(1.0))
    x = catalog.with_masks(x, masks, ["pixel_id", "obs_date"]).withColumn("weight", S.quality_weight(mask=F.col("clear")))
    return _rounded(x.groupBy("pixel_id").agg(F.sum("weight").alias("weight")))


def region_names(spark, d):
    pairs = comparison.pairs(comparison.align(*[X.grid(spark, d).select("r", "c", c) for c in ("cls1", "cls2", "forest", "eco")]))
    metrics = compare.by_region(pairs).where("total = 0").select("region", "agreement")
    names = spark.createDataFrame([(v, v.upper()) for k, v in comparison.REGIONS.items() if k != 3], "region string, name string")
    areas = X.grid(spark, d).select(compare.label(F.col("eco"), comparison.REGIONS).alias("region"), "r", "c").where("region is not null").groupBy("region").agg(F.min("c").alias("x0"), F.max("c").alias("x1"))
    return _rounded(catalog.regions_by_name(metrics, names, areas))


def dissolve_by_letter(spark, d):
    x = X.boxes(spark, d).withColumn("code", F.concat(F.element_at(F.split(F.lit("A,B,C,D,E"), ","), (F.col("seq") % 5 + 1).cast("int")), F.col("seq").cast("string")))
    return vector.dissolve_regions(x, "code", "seq", "code", "value")


def dissolve_cells(spark, d):
    cells = vector._cells(X.boxes(spark, d), 45, 35).withColumn("key", F.col("seq") % 5)
    return vector.region_cells(cells, "key").groupBy("key").agg(F.count("*").alias("cells"), F.sum(F.col("r") * 45 + F.col("c")).alias("places"))


def tiles_with_elevation(spark, d):
    dem = X.paths(spark, d).select(catalog.tile_id(F.col("path")).alias("tile_id")).where("cast(split(tile_id, '_')[1] as int) % 100000 = 0")
    x = catalog.time_series(X.paths(spark, d), with_dem=dem)
    return x.select("tile_id", F.size("dates").alias("n_dates"))


# --- catalogs, order and slices


def single_date_catalog(spark, d):
    x = X.observations(spark, d).select("obs_date").distinct()
    name = F.format_string("/data/%s_mean_S2%s_DL_PHENOLOGY.tif", F.date_format("obs_date", "yyyy-MM-dd"), F.when(F.dayofmonth("obs_date") % 2 == 0, "A").otherwise("B"))
    return catalog.single_dates(x.select(name.alias("path")), years=[1995, 1996])


def month_dates(spark, d):
    x = X.observations(spark, d).select(F.format_string("/d/s2_%s.tif", F.date_format("obs_date", "yyyyMM")).alias("path")).distinct()
    return x.select("path", catalog.token_date(F.col("path"), "yyyyMM").alias("date"))


def missing_configs(spark, d):
    x = X.tile_state(spark, d).where("tile_idx % 4 <> 1").select("tile_idx")
    return configs.missing_tiles(x, 60)


def first_windows(spark, d):
    height = X.grid(spark, d).agg(F.max("r")).first()[0] + 1
    return catalog.sliced(grid.windows(spark, WIDTH, height, 8), ["window_id"], 0, 10)


def tile_slice(spark, d):
    return catalog.sliced(catalog.tiles(X.paths(spark, d)), ["tile_id"], 3, 9)


def dem_info_slice(spark, d):
    path = _folder(spark, "dem-info")
    tiles = rasters.tile_metadata(catalog.tiles(X.paths(spark, d)))
    configs.write_infos(tiles, path)
    back = configs.read_infos(spark, path, tiles.schema.simpleString()[7:-1].replace(":", " "), start=2, end=12)
    return _rounded(back.select("tile_id", "crs", "left", "west", "north", "width"))


def central_windows(spark, d):
    x = X.grid(spark, d).select((F.col("c") / 25).cast("int").alias("year"), "r", (F.col("c") % 25).alias("c"), "prob")
    return rasters.central_windows(x, ["year"], 12)


# --- grids and warps


def window_bounds(spark, d):
    wins = grid.windows(spark, WIDTH, 35, 16).withColumns({"grid_left": F.lit(100000.0), "grid_top": F.lit(6800000.0), "res": F.lit(10.0)})
    return grid.window_bounds(wins).select("window_id", "left", "bottom", "right", "top")


def affine_roundtrip(spark, d):
    origin = F.lit(100000.0), F.lit(6800000.0), F.lit(10.0)
    x, y = grid.world(F.col("r"), F.col("c"), *origin)
    moved = X.grid(spark, d).select("r", "c", x.alias("x"), y.alias("y"))
    row, column = grid.cell(F.col("x") + 3.0, F.col("y") - 14.0, *origin)
    return moved.select("r", "c", "x", "y", row.alias("row"), column.alias("column"))


def resampled_windows(spark, d):
    x = X.grid(spark, d).select("r", "c", F.col("prob").alias("v"))
    source, to = (0.0, 400.0, 10.0), (47.0, 346.0, 15.0)
    cells = grid.target_grid(spark, 12, 20)
    kept = grid.sample(x, "v", cells, to, source)
    return kept.join(grid.sample(x, "v", cells, to, source, whole_offsets=True).withColumnRenamed("v", "truncated"), ["r", "c"])


def masked_raster(spark, d):
    x = X.grid(spark, d)
    path = _folder(spark, "masked")
    shape = (x.agg(F.max("r")).first()[0] + 1, WIDTH)
    out = grid.masked(x.select("r", "c", F.col("prob").alias("v")), (0.0, 400.0, 10.0), x.select("r", "c", F.col("forest").alias("m")), (33.0, 380.0, 12.0), (shape, shape))
    # Written whole, checked by its count, and read back.
    out = cut(out)
    rasters.write_checked(out, path, out.count())
    return spark.read.parquet(path)


def _geographic_cells(spark, rows: int, columns: int, west: float, north: float, step: float):
    cells = grid.target_grid(spark, rows, columns)
    return cells, F.lit(west) + (F.col("c") + 0.5) * step, F.lit(north) - (F.col("r") + 0.5) * step


def _warped(method):
    def query(spark, d):
        cells, lon, lat = _geographic_cells(spark, 16, 40, 2.99, 46.51, 0.0002)
        x, y = grid.geographic_to_lambert93(lon, lat)
        source = X.grid(spark, d).select("r", "c", F.col("elevation").cast("double").alias("v"))
        return _rounded(grid.warp(source, "v", cells, x, y, (699500.0, 6600400.0, 20.0), method), 4)

    return query


def vpp_extraction(spark, d):
    """A feature from a geographic mosaic onto two Lambert-93 tiles, each with its validity."""
    mosaic = X.grid(spark, d).select("r", "c", F.col("prob").cast("double").alias("v"))
    west, north, step = 2.99, 46.51, 0.0004
    out = None
    for tile, left, top in (("a", 699500.0, 6600200.0), ("b", 100000.0, 6800000.0)):
        cells = grid.target_grid(spark, 10, 12)
        x, y = grid.world(F.col("r"), F.col("c"), F.lit(left), F.lit(top), F.lit(50.0))
        lon, lat = grid.lambert93_to_geographic(x, y)
        one = grid.warp(mosaic, "v", cells, lon, lat, (west, north, step), "bilinear").withColumn("tile", F.lit(tile))
        out = one if out is None else out.unionByName(one)
    valid = out.groupBy("tile").agg(F.count("v").alias("n"), F.max("v").alias("high"))
    return valid.select("tile", "n", _r(F.col("high"), 3).alias("high"), ((F.col("n") > 0) & (F.coalesce("high", F.lit(0.0)) > 0)).alias("valid"))


# --- vectors


def _polygons(spark, d):
    point = lambda x, y: F.struct((x * 1.0).alias("x"), (y * 1.0).alias("y"))
    x0, y0, x1, y1 = (F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1"))
    # A slanted quadrilateral in each box; those of every third supplier are triangles.
    four = F.array(point(x0 + 0.3, y0 + 0.2), point(x1 - 0.1, y0 + 0.7), point(x1 - 0.4, y1 - 0.1), point(x0 + 0.1, y1 - 0.6), point(x0 + 0.3, y0 + 0.2))
    three = F.array(point(x0 + 0.2, y0 + 0.1), point(x1 - 0.2, y1 - 0.3), point(x0 + 0.4, y1 - 0.1), point(x0 + 0.2, y0 + 0.1))
    return X.boxes(spark, d).select("seq", "value", F.when(F.col("seq") % 3 == 0, three).otherwise(four).alias("ring"))


def rasterize_polygons(spark, d):
    return vector.rasterize_polygons(_polygons(spark, d), 45, 35)


# --- checks


def band_validation(spark, d):
    x = X.observations(spark, d).withColumn("flg", F.col("flg").cast("double"))
    return state.validate_bands(x, ["pixel_id"], "obs_date", ["b2", "b4", "b8", "b11", "b12", "b99"], _dem(spark, d), "flg")


def input_validation(spark, d):
    made = configs.parse_configs(configs.tile_configs(catalog.time_series(X.paths(spark, d)), F.lit("dem.tif")))
    # Every fifth tile lacks its last date.
    short = F.when(F.substring("tile_id", -7, 2) == "60", F.slice("dates", 1, F.size("dates") - 1)).otherwise(F.col("dates"))
    made = made.withColumn("dates", F.when(F.col("tile_id").endswith("_6050000"), short).otherwise(F.col("dates")))
    return state.invalid_inputs(made, X.paths(spark, d).where("path not like '%/1996/03-%'"), 2, 1)


def missing_features(spark, d):
    found = state.missing_columns(X.grid(spark, d), ["elevation", "ndvi_offset", "prob", "nbr_offset"])
    return spark.createDataFrame([(c,) for c in found], "name string")


def one_crs(spark, d):
    x = rasters.tile_metadata(catalog.tiles(X.paths(spark, d)))
    return spark.createDataFrame([(grid.require_one_crs(x),)], "crs string")


def isolated_comparison(spark, d):
    x = X.grid(spark, d)
    broken = lambda: spark.read.parquet(f"{d}/no-such-table.parquet")
    out, errors = comparison.against_each({"reference": lambda: x, "gone": broken})
    assert list(errors) == ["gone"]
    return _rounded(out.withColumn("total", F.col("total").cast("int")))


# --- writers, read back


def probability_tiles(spark, d):
    x = X.grid(spark, d).select(F.floor(F.col("r") / 10).cast("int").alias("tile_id"), "r", "c", F.nullif(F.col("prob"), F.lit(7)).alias("prob"))
    path = _folder(spark, "probability")
    rasters.write_tiles(x, path, nodata={"prob": 0})
    return spark.read.parquet(path).select("tile_id", "r", "c", "prob")


def feature_raster(spark, d):
    x = X.grid(spark, d).select(F.lit(1).alias("tile_id"), "r", "c", codec.encode_unit(F.when(F.col("pixel_id") % 9 != 0, F.col("prob") / 255.0)).alias("feature"))
    path = _folder(spark, "features")
    rasters.write_tiles(x, path, nodata={"feature": 65535})
    return spark.read.parquet(path).select("r", "c", "feature")


def class_raster(spark, d):
    x = X.grid(spark, d).select(F.floor(F.col("r") / 10).cast("int").alias("tile_id"), "r", "c", codec.classify(F.col("prob")).alias("class"))
    path = _folder(spark, "classes")
    rasters.write_tiles(x, path)
    return spark.read.parquet(path).groupBy("tile_id", "class").agg(F.count("*").alias("n"))


def rasterized_vectors(spark, d):
    path = _folder(spark, "vectors")
    cells = vector.rasterize(X.boxes(spark, d), 45, 35).withColumn("tile_id", F.floor(F.col("r") / 16).cast("int"))
    rasters.write_tiles(cells, path)
    return spark.read.parquet(path).groupBy("tile_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def raster_blocks(spark, d):
    x = rasters.blocks(X.grid(spark, d), "prob", 16)
    return x.select("block_row", "block_col", "height", "width", F.size("data").alias("n"), F.element_at("data", 1).alias("first"), F.element_at("data", -1).alias("last"))


def elevation_raster(spark, d):
    path = _folder(spark, "dem")
    x = grid.regrid_nearest(X.grid(spark, d).select("r", "c", F.col("elevation").cast("float").alias("elevation")), "elevation", grid.target_grid(spark, 14, 20), 2.5)
    rasters.write_checked(x, path, 14 * 20)
    return spark.read.parquet(path).select("r", "c", _r(F.col("elevation").cast("double"), 3).alias("elevation"))


def run_folder(spark, d):
    path = _folder(spark, "run")
    made = configs.tile_configs(catalog.time_series(X.paths(spark, d)), F.concat(F.lit("/dem/"), F.col("tile_id")), {"max_iter": 10})
    configs.save_run(made.select("json"), path, {"max_iter": 10})
    tiles, meta, done = configs.load_run(spark, path)
    one = meta.select("num_tiles", F.col("settings")["max_iter"].alias("max_iter"), F.col("settings")["window_size"].alias("window_size")).first()
    return tiles.agg(F.count("*").alias("tiles"), F.max("config.max_iter").alias("tile_iter")).select("tiles", "tile_iter", F.lit(one.num_tiles).alias("num_tiles"), F.lit(one.max_iter).alias("max_iter"), F.lit(one.window_size).alias("window_size"), F.lit(done.count()).alias("done"))


def state_upsert(spark, d):
    path = _folder(spark, "state")
    state.append_completed(spark, path, [1, 2, 3])
    state.append_completed(spark, path, [3, 5])
    return state.latest(spark.read.parquet(path)).select("tile_idx", "completed")


def job_summary(spark, d):
    made = configs.parse_configs(configs.tile_configs(catalog.time_series(X.paths(spark, d)), F.lit("dem.tif")))
    return spark.createDataFrame([(x,) for x in configs.job_summary(made)], "line string")


def yaml_settings(spark, d):
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "settings.yaml")
        with open(path, "w") as f:
            f.write("window_size: 512  # smaller\nmax_iter: 10\nunknown: 3\nnum_harmonics:\n")
        found = configs.settings_from_yaml(path)
    return spark.createDataFrame(sorted(found.items()), "name string, value int")


def metrics_report(spark, d):
    path = _folder(spark, "metrics")
    pairs = comparison.pairs(comparison.align(*[X.grid(spark, d).select("r", "c", c) for c in ("cls1", "cls2", "forest", "eco")]))
    names = ["deciduous", "evergreen"]
    configs.write_metrics(compare.metrics_long(compare.agreement(pairs), ["labelled", "agreeing"]), compare.confusion(pairs, names), compare.by_region(pairs), path)
    whole = "confusion array<struct<truth string, pred string, n long>>, regions array<struct<region string, labelled long>>"
    return spark.read.schema(whole).json(f"{path}/json").select(F.inline("confusion"))


def clean_json(spark, d):
    rows = [(i, configs.json.dumps(configs.clean_json(v))) for i, v in enumerate([{"a": float("nan"), "b": (1, 2.5)}, [float("inf"), None], {"c": {"d": -float("inf")}}])]
    return spark.createDataFrame(rows, "i int, json string")


def quarantined_files(spark, d):
    x = X.boxes(spark, d).withColumn("nonzero_percent", F.when(F.col("seq") % 11 == 0, 0.0).otherwise(F.col("seq") % 50 * 1.0))
    path = _folder(spark, "trash")
    rasters.quarantine(vector.screen(x, (5.0, 5.0, 40.0, 30.0)).select("seq", "status"), path)
    return spark.read.parquet(path).select("seq", "status")


def sine_series(spark, d):
    return _rounded(rasters.sine_series(spark, 5, 36, ((0.3, 0.2, 0.5), (0.15, 0.1, 1.0), (0.05, 0.0, 3.0)), 0.4))


_LIST = [
    features_irls, probability_map_irls, robust_by_key, irls_until, forest_score, model_roundtrip, remaining_inference, classify_with_aspect, gaussian_smooth_3, cloud_mask_join, cloud_mask_weights,
    region_names, dissolve_by_letter, dissolve_cells, tiles_with_elevation, single_date_catalog, month_dates, missing_configs, first_windows, tile_slice, dem_info_slice, central_windows, window_bounds,
    affine_roundtrip, resampled_windows, masked_raster, vpp_extraction, rasterize_polygons, band_validation, input_validation, missing_features, one_crs, isolated_comparison, probability_tiles,
    feature_raster, class_raster, rasterized_vectors, raster_blocks, elevation_raster, run_folder, state_upsert, job_summary, yaml_settings, metrics_report, clean_json, quarantined_files, sine_series,
]
QUERIES = {f.__name__: f for f in _LIST} | {"warp_nearest": _warped("nearest"), "warp_bilinear": _warped("bilinear")}
