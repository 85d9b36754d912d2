import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraspark.functions import codec
from terraspark.functions import harmonics as H
from terraspark.functions import spectral as S
from terraspark.operators import catalog, compare, grid, harmonic, model, neighbourhood, state, stats, vector
from terraspark.plans import inference, queries
from terraspark.sources import configs, rasters


def test_fit_equals_numpy_and_recovers_a_signal(spark):
    obs = rasters.synthetic_series(spark, pixels=20, noise=0.0)
    x = harmonic.time_axis(obs)
    got = {r.pixel_id: r for r in harmonic.wls(x, ["pixel_id"], ["y"], 2).collect()}
    pdf = x.toPandas()
    for pixel, g in pdf.groupby("pixel_id"):
        g = g[g.y.notna()]
        a = np.column_stack([f(2 * math.pi * k * g.t) for k in (1, 2) for f in (np.cos, np.sin)] + [np.ones(len(g))])
        want = np.linalg.lstsq(a, g.y, rcond=None)[0]
        assert np.allclose([got[pixel][f"x_{i}_y"] for i in range(5)], want, atol=1e-9)
    one = harmonic.parameters(harmonic.wls(x, ["pixel_id"], ["y"], 2), ["pixel_id"], 2).first()
    assert (round(one.amplitude_h1, 6), round(one.amplitude_h2, 6), round(one.offset, 6)) == (0.3, 0.15, 0.5)


def test_too_few_observations_give_zero(spark):
    rows = [(1, 0.1 * i, 0.5) for i in range(4)] + [(2, 0.1 * i, None) for i in range(9)]
    out = harmonic.wls(spark.createDataFrame(rows, "pixel_id long, t double, y double"), ["pixel_id"], ["y"], 2).collect()
    assert {(r.pixel_id, r.n_obs, r.x_4_y) for r in out} == {(1, 4, 0.0), (2, 0, 0.0)}


def test_constant_series_has_no_residual(spark):
    df = spark.createDataFrame([(1, 0.05 * i, 0.5) for i in range(30)], "pixel_id long, t double, y double")
    out = harmonic.collapse(harmonic.irls(df, ["pixel_id"], "y", 2, 3), ["pixel_id"], 5).first()
    assert abs(out.x_4_y - 0.5) < 1e-9 and out.residual_variance < 1e-18


def test_robust_fit_resists_outliers(spark):
    rows = [(1, i / 40, 0.5 + (5.0 if i % 13 == 0 else 0.0)) for i in range(80)]
    df = spark.createDataFrame(rows, "pixel_id long, t double, y double")
    level = [harmonic.collapse(harmonic.irls(df, ["pixel_id"], "y", 1, k), ["pixel_id"], 3).first().x_2_y for k in (1, 6)]
    assert abs(level[1] - 0.5) < abs(level[0] - 0.5) / 2


def test_result_does_not_depend_on_partitions(spark):
    obs = harmonic.time_axis(rasters.synthetic_series(spark, pixels=8))
    one = harmonic.wls(obs.repartition(1), ["pixel_id"], ["y"]).orderBy("pixel_id").toPandas()
    many = harmonic.wls(obs.repartition(7), ["pixel_id"], ["y"]).orderBy("pixel_id").toPandas()
    assert np.allclose(one, many)


def test_encode_decode(spark):
    df = spark.range(0, 101).select((F.col("id") / 100).alias("x"), ((F.col("id") / 50 - 1) * math.pi).alias("p"))
    out = df.select("x", "p", codec.decode_unit(codec.encode_unit(F.col("x"))).alias("x2"), codec.decode_phase(codec.encode_phase(F.col("p"))).alias("p2")).where("x < 1").toPandas()
    assert (out.x - out.x2).abs().max() <= 1 / 65535 and (out.p - out.p2).abs().max() <= 2 * math.pi / 65535
    assert spark.range(1).select(codec.encode_unit(F.lit(None).cast("double")).alias("x")).first().x == 65535


def test_nodata_and_zero_denominators(spark):
    df = spark.createDataFrame([(65535, 1, 2, 3, 4), (100, 0, 0, 0, 0)], "b2 int, b4 int, b8 int, b11 int, b12 int")
    rows = S.with_indices(S.to_reflectance(df)).collect()
    assert rows[0].evi is None and rows[0].ndvi is not None
    assert 0 <= rows[1].ndvi <= 1


@pytest.mark.parametrize("width,height,size", [(50, 40, 16), (7, 3, 8), (16, 16, 16), (1, 9, 4)])
def test_tiling_covers_once(spark, width, height, size):
    seen = np.zeros((height, width), int)
    for w in grid.windows(spark, width, height, size).collect():
        seen[w.row_off : w.row_off + w.height, w.col_off : w.col_off + w.width] += 1
    assert (seen == 1).all()


def test_disks_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (13, 11))
    df = spark.createDataFrame([(r, c, int(a[r, c]), int(a[r, c] > 230)) for r in range(13) for c in range(11)], "r int, c int, v int, m int")
    got = neighbourhood.dilate_disk(neighbourhood.mean_disk(df, "v", "mean", 3), "m", "wide", 2).collect()
    for x in got:
        at = lambda k: [(i, j) for i in range(13) for j in range(11) if (i - x.r) ** 2 + (j - x.c) ** 2 <= k * k]  # noqa: B023, E731
        assert x.mean == sum(a[p] for p in at(3)) // len(at(3))
        assert x.wide == max(a[p] > 230 for p in at(2))


def test_registered_weights_have_the_reference_footprint(spark, monkeypatch):
    rng = np.random.default_rng(2)
    n, m = 60, 56
    # Mostly flagged, so that the dilated clear area leaves holes.
    flg, prob = np.where(rng.random((n, m)) < 0.006, 0, rng.integers(1, 4, (n, m))), rng.integers(0, 256, (n, m))
    df = spark.createDataFrame([(r, c, int(flg[r, c]), int(prob[r, c])) for r in range(n) for c in range(m)], "r int, c int, flg int, prob int")
    monkeypatch.setattr(queries.X, "grid", lambda spark, d: df)
    rows, cols = np.mgrid[:n, :m]
    disk = lambda r, c, k: (rows - r) ** 2 + (cols - c) ** 2 <= k * k
    wide = np.array([[255 * (flg[disk(r, c, 5)] == 0).any() for c in range(m)] for r in range(n)])
    assert 0 < (wide == 0).mean() < 1
    for x in queries.qa_weights_5_25(spark, "").collect():
        near = wide[disk(x.r, x.c, 25)]
        assert x.weight == round(near.sum() // near.size / 255, 6)
    for x in queries.mean_disk_20(spark, "").collect():
        near = prob[disk(x.r, x.c, 20)]
        assert x["mean"] == near.sum() // near.size


def test_bilinear_keeps_a_plane(spark):
    df = spark.createDataFrame([(r, c, 2.0 * r + c) for r in range(20) for c in range(20)], "r int, c int, v double")
    out = grid.regrid_bilinear(df, "v", grid.target_grid(spark, 9, 9), 2.0).toPandas()
    assert np.allclose(out.v, 2 * (2 * out.r + 0.5) + 2 * out.c + 0.5)


def test_lambert_origin_and_round_trip(spark):
    df = spark.createDataFrame([(700000.0, 6600000.0), (250000.0, 6900000.0)], "x double, y double")
    lon, lat = grid.lambert93_to_geographic(F.col("x"), F.col("y"))
    rows = df.withColumns({"lon": lon, "lat": lat}).collect()
    assert abs(rows[0].lon - 3.0) < 1e-9 and abs(rows[0].lat - 46.5) < 1e-9


def test_confusion_and_agreement(spark):
    rows = [(1, 1, 1, 1), (1, 2, 1, 1), (2, 2, 1, 2), (1, 255, 1, 2), (1, 1, 0, 1)]
    px = spark.createDataFrame([(i, 0, *r) for i, r in enumerate(rows)], "r int, c int, cls1 int, cls2 int, forest int, eco int")
    pairs = compare.labelled_pairs(px, {1: "a", 2: "b"}, {1: "a", 2: "b", 255: "nodata"}, {1: "north", 2: "south"})
    total = compare.agreement(pairs).first()
    assert (total.forest_pixels, total.labelled, total.agreeing) == (4, 3, 2)
    assert total.agreeing <= total.labelled
    matrix = {(r.truth, r.pred): r.n for r in compare.confusion(pairs, ["a", "b"]).collect()}
    assert matrix == {("a", "a"): 1, ("a", "b"): 0, ("b", "a"): 1, ("b", "b"): 1}
    empty = compare.agreement(pairs.where("false")).first()
    assert (empty.agreement, empty.coverage) == (0.0, 0.0)


def test_box_join_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    boxes = [(i, int(x), int(y), int(x + w), int(y + h)) for i, (x, y, w, h) in enumerate(zip(rng.integers(-40, 40, 60), rng.integers(-40, 40, 60), rng.integers(1, 50, 60), rng.integers(1, 50, 60), strict=True))]
    make = lambda p: spark.createDataFrame(boxes, f"{p}seq int, {p}x0 int, {p}y0 int, {p}x1 int, {p}y1 int")
    got = sorted((r.a_seq, r.b_seq) for r in vector.box_join(make("a_"), make("b_"), size=8).collect())
    want = sorted((a[0], b[0]) for a in boxes for b in boxes if a[1] <= b[3] and a[3] >= b[1] and a[2] <= b[4] and a[4] >= b[2])
    assert got == want


def test_state_appends_and_resumes(spark, tmp_path):
    path = str(tmp_path / "state")
    state.append_completed(spark, path, [1, 3])
    state.append_completed(spark, path, [3])
    tiles = spark.range(5).withColumnRenamed("id", "tile_idx")
    now = state.latest(spark.read.parquet(path))
    assert sorted(r.tile_idx for r in state.remaining(tiles, now).collect()) == [0, 2, 4]
    assert state.progress(tiles, now).first().percent == 40.0


def test_token_dates(spark):
    df = spark.createDataFrame([("/a/s2_20210305_x.tif",), ("/a/s2_bad.tif",), ("/a/x.tif",)], "path string")
    assert [r.d for r in df.select(catalog.token_date(F.col("path")).alias("d")).collect()] == [dt.date(2021, 3, 5), None, None]


def test_stretch_of_constant_and_histogram_edge(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (None,)], "x double")
    assert all(r.x is None for r in stats.stretch(df, ["x"]).collect())
    assert [(r.bin, r.n) for r in stats.histogram(df, "x", 0.0, 1.0, 10).collect()] == [(9, 2)]


def test_model_needs_its_features(spark):
    with pytest.raises(ValueError):
        model.ensemble(model.DEMO_TREES, ["ndvi_offset"])


def test_configs(tmp_path):
    f = tmp_path / "c.yaml"
    f.write_text("window_size: 256  # small\nother: 3\n")
    assert configs.settings_from_yaml(str(f)) == configs.DEFAULTS | {"window_size": 256}
    assert configs.clean_json({"a": (1.0, float("nan")), "b": np.arange(2)}) == {"a": [1.0, None], "b": [0, 1]}


def test_tile_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("t1", 0, 0, 5), ("t1", 0, 1, None), ("t2", 0, 0, 7)], "tile_id string, r int, c int, v int")
    rasters.write_tiles(df, str(tmp_path / "x"), nodata={"v": 255})
    back = spark.read.parquet(str(tmp_path / "x"))
    assert sorted((r.tile_id, r.c, r.v) for r in back.collect()) == [("t1", 0, 5), ("t1", 1, 255), ("t2", 0, 7)]


def test_remaining_inference_skips_completed(spark):
    rows = [(t, 1, dt.date(2021, 1 + i, 1), 300, 400, 2500, 900, 700) for t in (0, 1) for i in range(8)]
    obs = spark.createDataFrame(rows, "tile_idx long, pixel_id long, obs_date date, b2 int, b4 int, b8 int, b11 int, b12 int")
    done = spark.createDataFrame([(0, 1)], "tile_idx long, completed int")
    assert [r.tile_idx for r in inference.remaining_inference(obs, done).collect()] == [1]


def test_phase_is_wrapped(spark):
    df = spark.range(1).select(F.lit(-1.0).alias("x_0_y"), F.lit(0.0).alias("x_1_y"))
    assert df.select(H.phase(1).alias("p")).first().p == pytest.approx(math.pi)


def test_listing_and_metadata(spark, tmp_path):
    d = tmp_path / "a" / "b"
    d.mkdir(parents=True)
    (d / "s2_EPSG2154_700000_6600000.tif").write_bytes(b"xy")
    (d / "note.txt").write_text("no")
    files = rasters.list_files(spark, str(tmp_path))
    assert [(r.path.rsplit("/", 1)[1], r.length) for r in files.collect()] == [("s2_EPSG2154_700000_6600000.tif", 2)]
    tiles = files.select(catalog.tile_id(F.col("path")).alias("tile_id")).union(spark.createDataFrame([("odd",)], "tile_id string"))
    good, odd = sorted(rasters.tile_metadata(tiles).collect(), key=lambda r: r.left is None)
    assert abs(good.west - 3.0) < 1e-9 and good.top == 6650000.0 and odd.left is None
    # The lower edge bends: its lowest point is not the corner on the central meridian, which is at 46.5.
    assert 46.498 < good.south < 46.4985


def test_node_table_round_trip(spark, tmp_path):
    path = str(tmp_path / "nodes")
    model.save_nodes(spark, model.DEMO_TREES, path)
    assert sorted(model.load_nodes(spark, path), key=lambda x: x[:2]) == sorted(model.DEMO_TREES, key=lambda x: x[:2])
    model.save_nodes(spark, [], str(tmp_path / "none"))
    with pytest.raises(ValueError):
        model.load_nodes(spark, str(tmp_path / "none"))


def test_guards(spark):
    df = spark.createDataFrame([("a", None, 0.0), ("a", None, 0.0), ("b", 1.0, None)], "g string, x double, y double")
    got = {(r.g, r.name): (r.all_null, r.all_zero) for r in stats.guards(df, ["x", "y"], ["g"]).collect()}
    assert got == {("a", "x"): (True, True), ("a", "y"): (False, True), ("b", "x"): (False, False), ("b", "y"): (True, True)}


def test_quarantine_writes_by_status(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 0, 10, 10, 5.0), (2, 100, 100, 110, 110, 5.0), (3, 0, 0, 4, 4, 0.0)], "seq int, x0 int, y0 int, x1 int, y1 int, nonzero_percent double")
    out = rasters.quarantine(vector.screen(df, (0.0, 0.0, 20.0, 20.0)), str(tmp_path / "q"))
    assert {r.status: r.n for r in out.collect()} == {"valid": 1, "outside_bounds": 1, "empty_file": 1}
    assert spark.read.parquet(str(tmp_path / "q")).count() == 3


def test_config_files(spark, tmp_path):
    series = spark.createDataFrame([("t", [dt.date(2021, 1, 1)], ["/a.tif"])], "tile_id string, dates array<date>, paths array<string>")
    made = configs.tile_configs(series, F.lit("/dem.tif"))
    made.select("json").write.text(str(tmp_path / "c"))
    back = configs.read_configs(spark, str(tmp_path / "c"))
    assert back.first().config.asDict() == configs.DEFAULTS
    assert configs.job_summary(back)[:2] == ["tiles: 1", "dates: 1"]
    assert [r.tile_idx for r in configs.missing_tiles(spark.createDataFrame([(0,)], "tile_idx long"), 2).collect()] == [1]


def test_encoded_classes(spark):
    rows = [(1, dt.date(2021, 1 + i, 1), 300, 400, 2500 + 100 * i, 900, 700) for i in range(10)]
    obs = spark.createDataFrame(rows, "pixel_id long, obs_date date, b2 int, b4 int, b8 int, b11 int, b12 int")
    x = inference.encoded_features(obs)
    assert inference.classify_encoded(x).first().value in (1, 2)
    with pytest.raises(ValueError):
        inference.classify_encoded(x, mode="other")
    with pytest.raises(ValueError):
        harmonic.wls(obs, ["pixel_id"], ["b2"], 0)


def test_stop_rule_for_each_window(spark):
    rows = [(1, w, i / 40, 0.5 + 0.1 * math.cos(2 * math.pi * i / 40) + (2.0 if w and i % 11 == 0 else 0.0)) for w in (0, 1) for i in range(80)]
    df = spark.createDataFrame(rows, "pixel_id long, win int, t double, y double")
    seen, weight = [], F.when((F.col("win") == 1) & (F.col("t") < 1), F.lit(0.3)).otherwise(F.lit(1.0))
    got = {r.win: r for r in harmonic.irls_until(df, ["pixel_id"], "y", 1, 8, 0.01, group=["win"], weight=weight, callback=lambda k, v: seen.append((k, len(v)))).collect()}
    # With uniform weights the first solve repeats the starting fit, so the window stops at once.
    assert got[0].iterations == 1 and 1 < got[1].iterations <= 8
    assert [n for _, n in seen] == [2] + [1] * (len(seen) - 1) and len(seen) == got[1].iterations
    same = harmonic.collapse(harmonic.irls(df.where("win = 1"), ["pixel_id"], "y", 1, got[1].iterations, weight), ["pixel_id"], 3).first()
    assert all(abs(same[f"x_{i}_y"] - got[1][f"x_{i}_y"]) < 1e-9 for i in range(3))
    whole = harmonic.irls_until(df, ["pixel_id", "win"], "y", 1, 1).collect()
    assert len(whole) == 2 and "iterations" in whole[0].asDict()
