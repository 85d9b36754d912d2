"""Further operators against plain Python, each in its awkward cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraspark.functions import harmonics as H
from terraspark.operators import catalog, grid, harmonic, lineage, model, state, stats, vector
from terraspark.plans import more
from terraspark.sources import configs


def test_order_values_are_exact(spark, monkeypatch):
    monkeypatch.setattr(stats, "FEW", 5)
    rng = random.Random(1)
    values = [rng.choice([rng.gauss(0, 1), 3.0, 1e12, -1e-9]) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "x double")
    assert stats.order_values(df, "x", [0, 7, 200, 399, 400, -1]) == {r: sorted(values)[r] for r in (0, 7, 200, 399)}
    got = stats.percentiles(df, "x", [0.0, 0.02, 0.5, 0.75, 1.0])
    assert np.allclose(got, np.percentile(values, [0, 2, 50, 75, 100]), rtol=1e-15)
    assert stats.percentiles(df.where("x is null"), "x", [0.5]) == [None]


def test_describe_counts_infinite_values(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),), (0.0,), (None,)], "x double")
    one = stats.describe(df.where("x < 10 or x is null"), ["x"]).first()
    assert (one.n, one.n_valid, one.zeros, one.median, one.near_zero_percent) == (3, 2, 1, 0.5, round(100 / 3, 6))
    assert stats.describe(df, ["x"]).first().inf_percent == 25.0


def test_means_between_two_results_are_rounded_up_in_any_order(spark):
    rng = random.Random(3)
    # Sums of 32 ten-thousandths that leave 312.5 millionths and the like: halfway between two results.
    groups = {g: [rng.randrange(2000, 6000) for _ in range(31)] for g in range(150)}
    rows = []
    for g, whole in groups.items():
        whole.append(2000 + (8 - 4 * (g % 2) - sum(whole)) % 16)
        rows += [(g, w / 10000) for w in whole]
    want = {g: (200 * sum(w) + 32) // 64 / 1e6 for g, w in groups.items()}
    assert sum(200 * sum(w) % 32 == 0 and 200 * sum(w) // 32 % 2 for w in groups.values()) == 75
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "g int, x double").repartition(seed + 1)
        assert {r.g: r["mean"] for r in stats.describe(df, ["x"], ["g"]).collect()} == want
    odd = [(0, 1e25), (0, 3e25), (1, 9e19), (1, 9e19), (2, float("inf")), (2, 1.0), (3, None), (4, -0.5), (4, -0.500001), (5, float("nan")), (None, 2.0)]
    got = {r.g: r["mean"] for r in stats.describe(spark.createDataFrame(odd, "g int, x double"), ["x"], ["g"]).collect()}
    assert np.isnan(got.pop(5))
    assert got == {0: 2e25, 1: 9e19, 2: float("inf"), 3: None, 4: -0.500001, None: 2.0}


def test_forest_walk_equals_the_expression(spark):
    rng = np.random.default_rng(2)
    nodes = more.forest_nodes(100)
    names = sorted({n[2] for n in nodes if n[2]})
    df = spark.createDataFrame([(i, *map(float, rng.random(len(names)))) for i in range(50)], "id long, " + ", ".join(f"{n} double" for n in names))
    walked = {r.id: r.probability for r in model.score(df, nodes).collect()}
    few = nodes[: 15 * 10]
    assert len(few) <= model.EXPRESSION_NODES < len(nodes)
    plain = {r.id: r.probability for r in model.score(df, few).collect()}
    again = {r.id: r.probability for r in model.walk(df, few).collect()}
    assert plain.keys() == again.keys() and all(abs(plain[i] - again[i]) < 1e-12 for i in plain)
    trees = {}
    for t, k, *rest in nodes:
        trees.setdefault(t, {})[k] = rest

    def leaf(tree, row, k=0):
        f, threshold, left, right, p = tree[k]
        return p if f is None else leaf(tree, row, left if row[f] <= threshold else right)

    for r in df.collect():
        assert abs(walked[r.id] - np.mean([leaf(t, r) for t in trees.values()])) < 1e-12
    with pytest.raises(ValueError, match="needs"):
        model.walk(df.drop(names[0]), nodes)


def test_robust_agrees_with_the_window_form(spark):
    rng = np.random.default_rng(3)
    rows = [(p, float(t), None if rng.random() < 0.2 else float(0.5 + 0.2 * np.cos(6.28 * t) + rng.normal(0, 0.1))) for p in range(6) for t in np.sort(rng.random(30)) * 2]
    rows += [(90, 0.1, 0.5), (90, 0.2, 0.6), (91, 0.1, None), (91, 0.4, None)] + [(92, i / 10, 0.25) for i in range(12)]
    df = spark.createDataFrame(rows, "p long, t double, y double")
    want = {r.p: r for r in harmonic.collapse(harmonic.irls(df, ["p"], "y", 2, 3), ["p"], 5).collect()}
    got = {r.p: r for r in harmonic.robust(df, ["p"], ["y"], 2, 3).collect()}
    assert got.keys() == want.keys()
    for p, r in got.items():
        assert np.allclose([r[f"x_{i}_y"] for i in range(5)], [want[p][f"x_{i}_y"] for i in range(5)], atol=1e-9)
        assert (r.variance_y is None) == (want[p].residual_variance is None)
        assert r.variance_y is None or abs(r.variance_y - want[p].residual_variance) < 1e-9
    assert harmonic.robust(df.where("false"), ["p"], ["y"]).count() == 0
    with pytest.raises(ValueError):
        harmonic.robust(df, ["p"], ["y"], 0)


def test_solver_on_arrays():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(7, 9, 3))
    m, r = np.einsum("kti,ktj->kij", a, a), rng.normal(size=(7, 3))
    assert np.allclose(H.solve_arrays(m, r), np.linalg.solve(m, r[..., None])[..., 0])
    assert (H.solve_arrays(np.zeros((1, 2, 2)), np.ones((1, 2))) == 0).all()


def test_polygons_cover_what_dense_points_touch(spark):
    rng = random.Random(5)
    polygons = []
    for seq in range(25):
        cx, cy = rng.uniform(-2, 22), rng.uniform(-2, 17)
        turns = sorted(rng.uniform(0, 2 * np.pi) for _ in range(rng.randrange(3, 8)))
        ring = [(float(cx + rng.uniform(0.3, 6) * np.cos(t)), float(cy + rng.uniform(0.3, 6) * np.sin(t))) for t in turns]
        polygons.append((seq, seq % 5 + 1, [*ring, ring[0]]))
    df = spark.createDataFrame(polygons, "seq int, value int, ring array<struct<x double, y double>>")
    got = {}
    for seq, _, ring in polygons:
        cells = set()
        for (x0, y0), (x1, y1) in zip(ring, ring[1:], strict=False):
            for f in np.linspace(0, 1, 4001):
                cells.add((int(np.floor(y0 + f * (y1 - y0))), int(np.floor(x0 + f * (x1 - x0)))))
        for r in range(15):
            for c in range(20):
                inside = False
                for (x0, y0), (x1, y1) in zip(ring, ring[1:], strict=False):
                    if (y0 > r + 0.5) != (y1 > r + 0.5) and c + 0.5 < x0 + (r + 0.5 - y0) * (x1 - x0) / (y1 - y0):
                        inside = not inside
                if inside:
                    cells.add((r, c))
        got[seq] = {(r, c) for r, c in cells if 0 <= r < 15 and 0 <= c < 20}
    for seq, _, _ in polygons:
        mine = {(r.r, r.c) for r in vector.rasterize_polygons(df.where(F.col("seq") == seq), 20, 15).collect()}
        # Dense points may miss a corner that an edge cuts off by less than their distance.
        assert got[seq] <= mine and len(mine - got[seq]) <= 1
    whole = {(r.r, r.c): r.value for r in vector.rasterize_polygons(df, 20, 15).collect()}
    assert set(whole) >= set().union(*got.values())


def test_box_join_of_any_sizes(spark):
    rng = random.Random(6)
    boxes = [(i, x, y, x + w, y + h) for i in range(60) for x, y, w, h in [(rng.randrange(-50, 1000), rng.randrange(-50, 1000), rng.choice([1, 5, 40, 900]), rng.choice([1, 5, 40, 900]))]]
    boxes += [(100, 0, 0, 10**6, 10**6), (101, 500, 500, 500, 500)]
    frame = lambda p: spark.createDataFrame(boxes, f"{p}seq int, {p}x0 int, {p}y0 int, {p}x1 int, {p}y1 int")
    want = sorted((a[0], b[0]) for a in boxes for b in boxes if a[1] <= b[3] and a[3] >= b[1] and a[2] <= b[4] and a[4] >= b[2])
    for size in (None, 16):
        got = sorted((r.a_seq, r.b_seq) for r in vector.box_join(frame("a_"), frame("b_"), size=size).select("a_seq", "b_seq").collect())
        assert got == want


def test_geographic_bounds_hold_all_points(spark):
    df = spark.createDataFrame([(100000.0, 6800000.0, 150000.0, 6850000.0), (1200000.0, 6100000.0, 1250000.0, 6150000.0)], "left double, bottom double, right double, top double")
    rows = grid.with_geographic_bounds(df).collect()
    points = [(r.left + 50000 * i / 7, r.bottom + 50000 * j / 7) for r in rows for i in range(8) for j in range(8)]
    lon, lat = grid.lambert93_to_geographic(F.col("x"), F.col("y"))
    for k, p in enumerate(spark.createDataFrame(points, "x double, y double").select(lon.alias("lon"), lat.alias("lat")).collect()):
        r = rows[k // 64]
        assert r.west - 1e-4 <= p.lon <= r.east + 1e-4 and r.south - 1e-4 <= p.lat <= r.north + 1e-4


def test_refusals(spark):
    with pytest.raises(ValueError, match="differ"):
        grid.require_one_crs(spark.createDataFrame([("a",), ("b",)], "crs string"))
    assert grid.require_one_crs(spark.createDataFrame([], "crs string")) is None
    with pytest.raises(ValueError, match="no file"):
        catalog.single_dates(spark.createDataFrame([("x.tif",)], "path string"))
    with pytest.raises(ValueError):
        state.invalid_inputs(spark.range(0), spark.range(0), 0, 1)
    with pytest.raises(ValueError, match="table"):
        configs._few(spark.range(configs.REPORT_ROWS + 1))
    with pytest.raises(ValueError):
        grid.warp(spark.range(0), "v", spark.range(0), F.lit(0), F.lit(0), (0, 0, 1), "cubic")


def test_a_run_that_lacks_a_tile_is_refused(spark, tmp_path):
    made = spark.createDataFrame([('{"tile_id": "a"}',), ('{"tile_id": "b"}',)], "json string")
    configs.save_run(made, str(tmp_path / "run"))
    assert configs.load_run(spark, str(tmp_path / "run"))[0].count() == 2
    made.limit(1).write.mode("overwrite").text(str(tmp_path / "run" / "configs"))
    with pytest.raises(ValueError, match="1 configurations of 2"):
        configs.load_run(spark, str(tmp_path / "run"))


def test_a_cluster_needs_a_shared_folder():
    class Elsewhere:
        class sparkContext:
            master = "spark://host:7077"

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="share"):
        lineage.shared_dir(Elsewhere)
