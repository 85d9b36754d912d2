"""Registered queries of the raster engine over the driver's tables; ``oracles`` has their DuckDB statements."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import codec
from ..functions import harmonics as H
from ..functions import spectral as S
from ..operators.lineage import cut
from ..operators import catalog, compare, grid, harmonic, model, neighbourhood, state, stats, vector
from ..sources import configs, rasters
from ..streaming import fold
from . import comparison, inference, more

BANDS = list(S.BANDS)
WIDTH = 50
EXTENT = (5.0, 5.0, 40.0, 30.0)


def _r(column, digits: int = 6):
    return F.round(column, digits)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[_r(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _indexed(spark, d):
    return S.with_indices(S.to_reflectance(harmonic.time_axis(X.observations(spark, d))))


def _dem(spark, d):
    return X.grid(spark, d).where("pixel_id % 7 <> 0").select("pixel_id", "elevation")


def _height(df: DataFrame) -> int:
    return df.agg(F.max("r")).first()[0] + 1


# --- scans, reflectance, indices, quality


def scan_window(spark, d):
    return rasters.read_window(X.observations(spark, d), ["obs_date", "b2", "b4", "b8"], 8, 10, 16, 16)


def to_reflectance(spark, d):
    return _rounded(S.to_reflectance(X.observations(spark, d)).select("pixel_id", "obs_date", *BANDS))


def spectral_indices(spark, d):
    x = S.with_indices(S.to_reflectance(X.observations(spark, d)))
    return _rounded(x.select("pixel_id", "obs_date", *S.INDICES))


def qa_weight_nan_mask(spark, d):
    x = S.to_reflectance(X.observations(spark, d)).withColumn("weight", S.quality_weight(mask=F.when(S.is_flagged(F.col("flg")), 0.0).otherwise(1.0)))
    return x.groupBy("pixel_id").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))


def flg_filter(spark, d):
    return X.observations(spark, d).where(~S.is_flagged(F.col("flg"))).groupBy("pixel_id").agg(F.count("*").alias("n_clear"), F.min("obs_date").alias("first_clear"))


# --- harmonic regression


def _wls(harmonics):
    def query(spark, d):
        fitted = harmonic.wls(_indexed(spark, d), ["pixel_id"], ["ndvi"], harmonics)
        return _rounded(harmonic.parameters(fitted, ["pixel_id"], harmonics, "ndvi", ["n_obs"]))

    return query


def harmonic_irls_k3(spark, d):
    fitted = harmonic.irls(_indexed(spark, d).select("pixel_id", "t", "ndvi"), ["pixel_id"], "ndvi", 2, 3)
    out = harmonic.collapse(fitted, ["pixel_id"], 5)
    return _rounded(harmonic.parameters(out, ["pixel_id"], 2, "y", ["residual_variance"]))


def harmonic_features_wide(spark, d):
    return _rounded(inference.feature_table(X.observations(spark, d), _dem(spark, d)))


def residual_variance(spark, d):
    fitted = harmonic.irls(_indexed(spark, d).select("pixel_id", "t", "ndvi"), ["pixel_id"], "ndvi", 2, 1)
    return fitted.groupBy("pixel_id").agg(_r(F.var_pop("residual"), 9).alias("variance"), _r(F.max("sigma")).alias("sigma"))


def huber_weights(spark, d):
    fitted = harmonic.irls(_indexed(spark, d).select("pixel_id", "t", "ndvi"), ["pixel_id"], "ndvi", 2, 1)
    return fitted.groupBy("pixel_id").agg(_r(F.sum("w")).alias("weight"), F.count_if((F.col("w") < 1) & (F.col("w") > 0)).alias("n_down"))


def convergence_p75(spark, d):
    fitted = harmonic.irls(_indexed(spark, d).select("pixel_id", "t", "ndvi"), ["pixel_id"], "ndvi", 2, 2)
    one = fitted.groupBy("pixel_id").agg(*[F.first(f"change_{i}").alias(f"change_{i}") for i in range(5)])
    moved = cut(one.select(F.inline(F.array(*[F.struct(F.col(f"change_{i}").alias("x")) for i in range(5)]))))
    return spark.createDataFrame([(stats.percentiles(moved, "x", [0.75])[0],)], "p75 double").select(_r(F.col("p75")).alias("p75"))


def _params(spark, d, iterations=1):
    x = X.observations(spark, d)
    t0, t1 = x.agg(F.min("obs_date"), F.max("obs_date")).first()
    fitted = harmonic.irls(_indexed(spark, d).select("pixel_id", "t", "ndvi"), ["pixel_id"], "ndvi", 2, iterations)
    return fitted, t0, t1


def reconstruct_7day(spark, d):
    fitted, t0, t1 = _params(spark, d)
    signal = harmonic.reconstruct(harmonic.collapse(fitted, ["pixel_id"], 5), ["pixel_id"], t0, t1, 2)
    return _rounded(signal.groupBy("pixel_id").agg(F.count("*").alias("n"), F.avg("signal").alias("mean"), F.min("signal").alias("low"), F.max("signal").alias("high"), F.max("grid_date").alias("last_date")))


def reconstruction_rmse(spark, d):
    fitted, _, _ = _params(spark, d)
    return fitted.where("ndvi is not null").groupBy("pixel_id").agg(_r(F.sqrt(F.avg(F.col("residual") * F.col("residual")))).alias("rmse"))


def _features_h1(spark, d):
    return harmonic.parameters(harmonic.wls(_indexed(spark, d), ["pixel_id"], ["ndvi"], 2), ["pixel_id"], 2, "ndvi")


def feature_encode_u16(spark, d):
    x = _features_h1(spark, d)
    return x.select(
        "pixel_id", codec.encode_unit(_r(F.col("amplitude_h1"), 9)).alias("amplitude_h1"), codec.encode_phase(_r(F.col("phase_h1"), 9)).alias("phase_h1"), codec.encode_unit(_r(F.col("offset"), 9)).alias("offset")
    )


def feature_decode_u16(spark, d):
    x = feature_encode_u16(spark, d)
    return _rounded(x.select("pixel_id", codec.decode_unit(F.col("amplitude_h1")).alias("amplitude_h1"), F.cos(codec.decode_phase(F.col("phase_h1"))).alias("cos_phase_h1"), codec.decode_unit(F.col("offset")).alias("offset")))


# --- scoring and maps


def tree_score_u8(spark, d):
    return _rounded(inference.probability_map(X.observations(spark, d), _dem(spark, d)))


def classify_threshold(spark, d):
    x = X.grid(spark, d)
    return x.select("pixel_id", codec.classify(F.col("prob")).alias("class"), codec.classify(F.col("prob"), null_safe=True).alias("class_null_safe"))


def apply_mask(spark, d):
    x = X.grid(spark, d)
    both = x.select("r", "c", "prob").join(x.select("r", "c", "forest"), ["r", "c"])
    return both.select("r", "c", codec.apply_mask(F.col("forest"), F.col("prob")).alias("prob"))


# --- comparison


def _pairs(spark, d):
    x = X.grid(spark, d)
    part = lambda *c: x.select("r", "c", *c)
    return comparison.pairs(comparison.align(part("cls1"), part("cls2"), part("forest"), part("eco")))


NAMES = ["deciduous", "evergreen"]


def confusion_matrix_long(spark, d):
    return compare.confusion(_pairs(spark, d), NAMES)


def confusion_matrix_pivot(spark, d):
    return compare.pivoted(confusion_matrix_long(spark, d), NAMES)


def confusion_percent(spark, d):
    from pyspark.sql import Window

    x = confusion_matrix_long(spark, d)
    return x.select("truth", "pred", _r(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy())).alias("percent"))


def agreement_global(spark, d):
    return _rounded(compare.agreement(_pairs(spark, d)).select("labelled", "agreeing", "agreement"))


def coverage_global(spark, d):
    return _rounded(compare.agreement(_pairs(spark, d)).select("forest_pixels", "labelled", "coverage"))


def agreement_by_region_rollup(spark, d):
    return _rounded(compare.by_region(_pairs(spark, d)).withColumn("total", F.col("total").cast("int")))


def agreement_by_region_windowed(spark, d):
    return _rounded(compare.by_region_windowed(_pairs(spark, d), 4))


def comparison_two_maps(spark, d):
    x = X.grid(spark, d)
    other = x.withColumn("cls2", F.when(F.col("prob") >= 128, 2).otherwise(1))
    return _rounded(comparison.against({"reference": x, "threshold": other}).withColumn("total", F.col("total").cast("int")))


def metrics_long(spark, d):
    total = compare.agreement(_pairs(spark, d))
    return _rounded(compare.metrics_long(total, ["forest_pixels", "labelled", "agreeing", "agreement", "coverage"]))


def class_dictionary(spark, d):
    return spark.createDataFrame(compare.class_dictionary(comparison.MAP1, comparison.MAP2), "id int, name string")


def unmapped_values_anti(spark, d):
    return state.unmapped(X.grid(spark, d), "cls2", [1, 2])


# --- statistics


def band_stats_by_date(spark, d):
    x = S.with_indices(S.to_reflectance(X.observations(spark, d)))
    return stats.describe(x, [*BANDS, *S.INDICES], ["obs_date"])


def band_identification(spark, d):
    x = S.to_reflectance(X.observations(spark, d))
    return stats.band_roles(x, BANDS)


def index_histogram(spark, d):
    x = S.with_indices(S.to_reflectance(X.observations(spark, d)))
    return stats.histogram(x.select(_r(F.col("ndvi"), 9).alias("ndvi")), "ndvi", 0.0, 1.0)


def phase_amplitude_hist2d(spark, d):
    x = _features_h1(spark, d).select(_r(F.col("phase_h1"), 9).alias("phase"), _r(F.col("amplitude_h1"), 9).alias("amplitude"))
    return stats.histogram2d(x, "phase", "amplitude", (-3.15, 3.15), (0.0, 0.5))


def percentile_stretch(spark, d):
    return _rounded(stats.stretch(X.grid(spark, d).select("pixel_id", F.col("elevation").cast("double").alias("elevation"), F.col("prob").cast("double").alias("prob")), ["elevation", "prob"]))


def minmax_normalise(spark, d):
    return _rounded(stats.minmax(X.grid(spark, d).select("pixel_id", F.col("elevation").cast("double").alias("elevation")), ["elevation"]))


def value_counts(spark, d):
    return _rounded(stats.value_counts(X.grid(spark, d), "cls2"))


# --- catalogs and state


def tile_catalog_regex(spark, d):
    return catalog.tiles(X.paths(spark, d))


def timeseries_catalog(spark, d):
    x = catalog.time_series(X.paths(spark, d), years=[1995, 1996, 1997])
    return x.select("tile_id", F.size("dates").alias("n_dates"), F.element_at("dates", 1).alias("first_date"), F.element_at("dates", -1).alias("last_date"), F.array_join("paths", "|").alias("paths"))


def paired_files_join(spark, d):
    x = X.paths(spark, d).select(catalog.tile_id(F.col("path")).alias("tile_id"), catalog.period_date(F.col("path")).alias("date"), "path")
    flags = x.where("month(date) % 2 = 0").select("tile_id", "date", F.regexp_replace("path", "s2_EPSG", "flg_EPSG").alias("flg_path"))
    return catalog.paired(x, flags, ["tile_id", "date"])


def filename_dates(spark, d):
    x = X.observations(spark, d).select("obs_date").distinct()
    name = F.format_string("/data/s2_%s_mosaic.tif", F.date_format("obs_date", "yyyyMMdd"))
    return x.select(name.alias("path")).select("path", catalog.token_date(F.col("path")).alias("date"))


def asof_next_date(spark, d):
    x = X.observations(spark, d).select("pixel_id", "obs_date").distinct()
    marks = x.select("pixel_id").distinct().select("pixel_id", F.explode(F.sequence(F.lit("1996-01-01").cast("date"), F.lit("2001-01-01").cast("date"), F.expr("interval 1 year"))).alias("asked"))
    return harmonic.as_of_next(marks, x, ["pixel_id"], "asked", "obs_date")


def _tiles(spark, d):
    return X.tile_state(spark, d).select("tile_idx")


def remaining_tiles(spark, d):
    return state.remaining(_tiles(spark, d), X.tile_state(spark, d))


def progress(spark, d):
    return _rounded(state.progress(_tiles(spark, d), X.tile_state(spark, d)))


def config_json_roundtrip(spark, d):
    series = catalog.time_series(X.paths(spark, d))
    made = configs.tile_configs(series, F.concat(F.lit("/dem/dem_"), F.col("tile_id"), F.lit(".tif")), {"window_size": 512})
    back = configs.parse_configs(made)
    return back.select("tile_id", "dem_path", F.size("mosaic_paths").alias("n_paths"), F.element_at("dates", 1).alias("first_date"), F.col("config.window_size").alias("window_size"), F.col("config.max_iter").alias("max_iter"), F.col("cloud_mask_paths").isNull().alias("no_masks"))


def winter_middle_date(spark, d):
    x = X.paths(spark, d).select(catalog.tile_id(F.col("path")).alias("tile_id"), catalog.period_date(F.col("path")).alias("date"))
    return catalog.middle_of_winter(x, ["tile_id"])


def cube_validation(spark, d):
    return state.validate_cube(X.observations(spark, d), ["pixel_id"], "obs_date", 30, "flg")


# --- grids


def window_tiling(spark, d):
    return grid.windows(spark, WIDTH, _height(X.grid(spark, d)), 16)


def tiling_covers_extent(spark, d):
    x = X.grid(spark, d)
    wins = grid.windows(spark, WIDTH, _height(x), 16)
    per = x.groupBy(grid.window_of(F.col("r"), F.col("c"), 16, WIDTH).alias("window_id")).agg(F.count("*").alias("cells"))
    return wins.join(per, "window_id", "left").select("window_id", (F.col("height") * F.col("width")).alias("size"), F.coalesce("cells", F.lit(0)).cast("long").alias("cells"))


def evenly_spaced_windows(spark, d):
    return grid.evenly_spaced(grid.windows(spark, WIDTH, _height(X.grid(spark, d)), 4), 10)


def _catalog(spark, d):
    return X.boxes(spark, d).select(F.col("x0").cast("double").alias("left"), F.col("y0").cast("double").alias("bottom"), (F.col("x1") + 50).cast("double").alias("right"), (F.col("y1") + 50).cast("double").alias("top"), (F.col("value") * 0.5).cast("double").alias("res"), F.lit("EPSG:2154").alias("crs"))


def common_extent(spark, d):
    return grid.common_extent(_catalog(spark, d))


def regrid_nearest(spark, d):
    x = X.grid(spark, d)
    return grid.regrid_nearest(x, "prob", grid.target_grid(spark, int(_height(x) / 1.5), int(WIDTH / 1.5)), 1.5)


def regrid_bilinear(spark, d):
    x = X.grid(spark, d)
    return _rounded(grid.regrid_bilinear(x, "prob", grid.target_grid(spark, int(_height(x) / 1.5), int(WIDTH / 1.5)), 1.5))


def central_window(spark, d):
    x = X.grid(spark, d)
    return grid.central_window(x.select("r", "c", "prob"), WIDTH, _height(x), 32)


def mosaic_union(spark, d):
    x = X.grid(spark, d).select("r", "c", F.col("cls1").alias("v"))
    tiles = x.select((F.col("c") / 25).cast("int").alias("tile_id"), "r", "c", "v")
    tiles = tiles.unionByName(x.where("c >= 20 and c < 30").select(F.lit(2).alias("tile_id"), "r", F.col("c") - 20, ((F.col("v") + F.col("r")) % 3).alias("v")).toDF("tile_id", "r", "c", "v"))
    offsets = spark.createDataFrame([(0, 0, 0, 0), (1, 0, 0, 1), (2, 0, 20, 2)], "tile_id int, row_off int, col_off int, priority int")
    return grid.mosaic(rasters.place_tiles(tiles, offsets), "v")


def crs_transform(spark, d):
    x = X.boxes(spark, d).select("seq", (600000.0 + F.col("x0") * 5000).alias("x"), (6300000.0 + F.col("y0") * 5000).alias("y"))
    lon, lat = grid.lambert93_to_geographic(F.col("x"), F.col("y"))
    x = x.withColumns({"lon": lon, "lat": lat})
    bx, by = grid.geographic_to_lambert93(F.col("lon"), F.col("lat"))
    return x.select("seq", _r(F.col("lon")).alias("lon"), _r(F.col("lat")).alias("lat"), _r(bx, 3).alias("x"), _r(by, 3).alias("y"))


# --- terrain and neighbourhoods


def _smooth(spark, d):
    return neighbourhood.gaussian(X.grid(spark, d), "elevation", 1.0)


def gaussian_smooth(spark, d):
    return _rounded(_smooth(spark, d))


def gradient_aspect(spark, d):
    x = neighbourhood.gradient(_smooth(spark, d).withColumn("elevation", _r(F.col("elevation"), 4)), "elevation", 10.0)
    return _rounded(x.select("r", "c", "dy", "dx", neighbourhood.aspect(F.col("dy"), F.col("dx")).alias("aspect")))


def hillshade(spark, d):
    x = gradient_aspect(spark, d)
    return _rounded(x.select("r", "c", neighbourhood.hillshade(F.col("aspect")).alias("shade")))


def _clear(spark, d):
    return X.grid(spark, d).select("r", "c", "flg", F.when(S.is_flagged(F.col("flg")), 0).otherwise(1).alias("clear"))


def dilate_disk(spark, d):
    return neighbourhood.dilate_disk(_clear(spark, d), "clear", "dilated", 5).select("r", "c", "clear", "dilated")


def mean_disk(spark, d):
    x = X.grid(spark, d).select("r", "c", "prob")
    return neighbourhood.mean_disk(x, "prob", "mean", 7)


def qa_weights_flg(spark, d):
    return _rounded(neighbourhood.qa_weights(X.grid(spark, d).select("r", "c", "flg"), dilation=2, mean=7))


def mean_disk_20(spark, d):
    """The mean filter at the reference's default radius."""
    x = X.grid(spark, d).select("r", "c", "prob")
    return neighbourhood.mean_disk(x, "prob", "mean")


def qa_weights_5_25(spark, d):
    """The weights at the reference's fixed radii of 5 and 25."""
    return _rounded(neighbourhood.qa_weights(X.grid(spark, d).select("r", "c", "flg")))


# --- vectors


def bbox_intersect_join(spark, d):
    x = X.boxes(spark, d)
    named = lambda p: x.select(*[F.col(c).alias(p + c) for c in ("seq", "x0", "y0", "x1", "y1")])
    return vector.box_join(named("a_"), named("b_")).where("a_seq < b_seq").select("a_seq", "b_seq")


def rasterize_boxes(spark, d):
    return vector.rasterize(X.boxes(spark, d), 45, 35)


def dissolve_first(spark, d):
    return vector.dissolve(X.boxes(spark, d).withColumn("key", F.col("seq") % 7), "key", "seq", "value")


def file_screening(spark, d):
    x = X.boxes(spark, d).withColumn("nonzero_percent", F.when(F.col("seq") % 11 == 0, 0.0).otherwise(F.col("seq") % 50 * 1.0))
    return _rounded(vector.screen(x, EXTENT).select("seq", "overlap_percent", "status"))


def geojson_bbox(spark, d):
    x = X.boxes(spark, d)
    text = F.concat_ws(", ", "x0", "y0", "x1", "y1")
    feature = x.select("seq", configs.bbox_feature(text).alias("f"))
    ring = F.from_json("f", "type string, geometry struct<type string, coordinates array<array<array<double>>>>")
    return feature.select("seq", ring.alias("g")).select("seq", F.col("g.type").alias("type"), F.size(F.col("g.geometry.coordinates")[0]).alias("points"), F.col("g.geometry.coordinates")[0][2][0].alias("x2"), F.col("g.geometry.coordinates")[0][2][1].alias("y2"))


def elevation_default_join(spark, d):
    x = X.grid(spark, d).select("pixel_id")
    return x.join(_dem(spark, d), "pixel_id", "left").select("pixel_id", F.coalesce(F.col("elevation").cast("double"), F.lit(0.0)).alias("elevation"))


# --- further catalog, grid and first-generation plans


def tile_metadata(spark, d):
    return _rounded(rasters.tile_metadata(catalog.tiles(X.paths(spark, d))))


def tile_containment(spark, d):
    x = rasters.tile_metadata(catalog.tiles(X.paths(spark, d)))
    inside = grid.contained("left", "bottom", "right", "top", (200000.0, 6000000.0, 1000000.0, 6150000.0))
    return x.select("tile_id", inside.alias("inside"))


def first_reference_file(spark, d):
    x = X.paths(spark, d)
    return catalog.first_reference(x.withColumn("tile_id", catalog.tile_id(F.col("path"))), "tile_id")


def screening_counts(spark, d):
    return file_screening(spark, d).groupBy("status").agg(F.count("*").alias("n"))


def series_guards(spark, d):
    return stats.guards(X.grid(spark, d), ["cls1", "prob", "forest"], ["eco"])


def joint_range(spark, d):
    x = _features_h1(spark, d)
    return _rounded(stats.joint_range(x, ["amplitude_h1", "amplitude_h2", "offset"]))


def canopy_mask(spark, d):
    x = X.grid(spark, d)
    return grid.height_mask(x, "prob", grid.target_grid(spark, int(_height(x) / 2), WIDTH // 2), 2.0, 100)


def nearest_data_window(spark, d):
    x = X.grid(spark, d)
    some = x.where("prob = 255")
    return grid.nearest_window_with(some, grid.windows(spark, WIDTH, _height(x), 4), 4, WIDTH, 20, 24)


def dem_build(spark, d):
    x = X.grid(spark, d).select("r", "c", F.col("elevation").cast("double").alias("elevation"))
    return _rounded(grid.regrid_bilinear(x, "elevation", grid.target_grid(spark, int(_height(x) / 2.5), WIDTH * 2 // 5), 2.5))


def encoded_features(spark, d):
    return inference.encoded_features(X.observations(spark, d))


def classify_encoded(spark, d):
    x = inference.encoded_features(X.observations(spark, d))
    pred, proba = inference.classify_encoded(x), inference.classify_encoded(x, mode="proba").withColumnRenamed("value", "proba")
    return pred.withColumnRenamed("value", "pred").join(proba, "pixel_id")


# --- rows only


def rf_score_ml(spark, d):
    x = inference.feature_table(X.observations(spark, d), _dem(spark, d)).join(X.grid(spark, d).select("pixel_id", "cls1"), "pixel_id")
    x = x.withColumn("label", (F.col("cls1") > 0).cast("double")).na.fill(0.0)
    inputs = [c for c, t in x.dtypes if t == "double" and c != "label"]
    from pyspark.ml.functions import vector_to_array

    scored = inference.random_forest(x, "label", inputs).transform(x)
    return scored.select("pixel_id", vector_to_array("probability")[1].alias("probability"))


def stream_fold(spark, d):
    raw = spark.readStream.schema(X.table(spark, d, "lineitem").schema).parquet(f"{d}/lineitem.parque[t]").selectExpr(*X.V_OBS)
    t0 = harmonic.first_date(X.observations(spark, d))
    sums = fold.run_to_table(spark, fold.folded_sums(raw, t0), "folded_sums")
    return _rounded(harmonic.parameters(fold.fit(sums), ["pixel_id"], 2, "ndvi", ["n_obs"]))


def period_counts(spark, d):
    x = X.observations(spark, d).withColumn("obs_time", F.col("obs_date").cast("timestamp"))
    out = fold.by_period(x, length="60 days")
    return _rounded(out.select(F.col("window.start").cast("date").alias("start"), "pixel_id", "n", "clear"))


_LIST = [
    scan_window, to_reflectance, spectral_indices, qa_weight_nan_mask, flg_filter, harmonic_irls_k3, harmonic_features_wide, residual_variance, huber_weights, convergence_p75, reconstruct_7day,
    reconstruction_rmse, feature_encode_u16, feature_decode_u16, tree_score_u8, classify_threshold, apply_mask, confusion_matrix_long, confusion_matrix_pivot, confusion_percent, agreement_global,
    coverage_global, agreement_by_region_rollup, agreement_by_region_windowed, comparison_two_maps, metrics_long, class_dictionary, unmapped_values_anti, band_stats_by_date, band_identification,
    index_histogram, phase_amplitude_hist2d, percentile_stretch, minmax_normalise, value_counts, tile_catalog_regex, timeseries_catalog, paired_files_join, filename_dates, asof_next_date,
    remaining_tiles, progress, config_json_roundtrip, winter_middle_date, cube_validation, window_tiling, tiling_covers_extent, evenly_spaced_windows, common_extent, regrid_nearest, regrid_bilinear,
    central_window, mosaic_union, crs_transform, gaussian_smooth, gradient_aspect, hillshade, dilate_disk, mean_disk, qa_weights_flg, mean_disk_20, qa_weights_5_25, bbox_intersect_join, rasterize_boxes, dissolve_first,
    file_screening, geojson_bbox, elevation_default_join, tile_metadata, tile_containment, first_reference_file, screening_counts, series_guards, joint_range, canopy_mask,
    nearest_data_window, dem_build, encoded_features, classify_encoded, rf_score_ml, stream_fold, period_counts,
]
QUERIES = {f.__name__: f for f in _LIST} | {"harmonic_wls_h1": _wls(1), "harmonic_wls_h2": _wls(2)} | more.QUERIES


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Observations to class map, most certain pixels first."""
    x = inference.probability_map(X.observations(spark, d), _dem(spark, d))
    return x.orderBy(F.abs(F.col("probability") - 0.5).desc(), "pixel_id").limit(100)


