"""DuckDB statements of the further queries."""

from __future__ import annotations

from . import oracles as O
from .oracles import _FILES, _IDX, _INDICES, _REFL, _with

_WEIGHT = "case when b2 is null or b4 is null or b8 is null or b11 is null or b12 is null then 0e0 else 1e0 end"


def _robust(ys: list[str], iterations: int, harmonics: int = 2, weight: str = _WEIGHT, source: str = "idx", key: str = "pixel_id") -> list[tuple[str, str]]:
    """Steps of the re-weighted fit of several indices: ``{y}_fit`` and ``{y}_res`` (with the last residual)."""
    steps = []
    fitted = " + ".join(f"x_{i}_y * {a}" for i, a in enumerate(O._basis(harmonics)))
    for y in ys:
        steps.append((f"{y}_s1", f"select pixel_id, t, coalesce({y}, avg({y}) over (partition by pixel_id)) as y, case when {y} is null then 0e0 else {weight} end as w from {source}"))
        for k in range(1, iterations + 1):
            fit = f"{y}_fit" if k == iterations else f"{y}_fit{k}"
            res = f"{y}_res" if k == iterations else f"{y}_res{k}"
            steps += O._fit(f"{y}_s{k}", harmonics, ["y"], fit)
            steps.append((res, f"select s.*, s.y - ({fitted}) as residual from {y}_s{k} s join {fit} using (pixel_id)"))
            if k < iterations:
                delta = "(1.345e0 * case when sigma = 0 then 1e-8 else sigma end)"
                huber = f"case when abs(residual) <= {delta} then 1e0 else {delta} / (abs(residual) + 1e-8) end"
                steps.append((f"{y}_s{k + 1}", f"select pixel_id, t, y, w * {huber} as w from (select *, stddev_pop(residual) over (partition by pixel_id) as sigma from {res})"))
    return steps


def _wide_of(elevation: str) -> tuple[str, str]:
    out = []
    for y in _INDICES:
        for k in (1, 2):
            a, b = f"{y}_fit.x_{2 * k - 2}_y", f"{y}_fit.x_{2 * k - 1}_y"
            out += [f"sqrt({a} * {a} + {b} * {b}) as {y}_amplitude_h{k}", f"cos(atan2({b}, {a})) as {y}_cos_phase_h{k}"]
        out.append(f"{y}_fit.x_4_y as {y}_offset")
    joins = " ".join(f"join {y}_fit using (pixel_id)" for y in _INDICES[1:])
    return "wide", f"select pixel_id, {_INDICES[-1]}_fit.n_obs, {', '.join(out)}, {elevation} as elevation from {_INDICES[0]}_fit {joins} left join dem using (pixel_id)"


_DEM = ("dem", "select pixel_id, elevation from v_grid where pixel_id % 7 <> 0")
_IRLS_WIDE = [_REFL, _IDX, *_robust(_INDICES, 3), _DEM, _wide_of("coalesce(dem.elevation, 0)::double")]
_PROB = "round(probability, 6) as probability, floor(probability * 255)::int as prob_u8, case when floor(probability * 255) >= 128 then 2 else 1 end as class"

# --- the full forest of depth 3, walked level by level
_FOREST_FEATURES = [f"{y}_{n}" for y in _INDICES for n in ("amplitude_h1", "cos_phase_h1", "offset")]
_PLAIN_WIDE = [x for x in O._wide() if x[0] not in ("dem", "wide")]
_STEP = "2 * node + case when f[(tree * 7 + node * 3) % 12 + 1] <= ((tree * 13 + node * 5) % 100) / 100e0 then 1 else 2 end"


def _plain_features() -> str:
    out = []
    for y in _INDICES:
        a, b = f"x_0_{y}", f"x_1_{y}"
        out += [f"round(sqrt({a} * {a} + {b} * {b}), 6)", f"round(cos(atan2({b}, {a})), 6)", f"round(x_4_{y}, 6)"]
    return "[" + ", ".join(out) + "]"


_TILE_LETTERS = "substr('ABCDE', (seq % 5 + 1)::int, 1)"
_GEO = "(select unnest(range(0, {rows}))::int as r) a cross join (select unnest(range(0, {columns}))::int as c) b"


def _forward(points: str) -> list[tuple[str, str]]:
    """Lambert-93 of geographic points (lon, lat), from the projection's defining constants alone."""
    m = "(cos(radians({0})) / sqrt(1 - e * e * sin(radians({0})) * sin(radians({0}))))"
    q = "ln(tan(pi() / 4 + radians({0}) / 2) * pow((1 - e * sin(radians({0}))) / (1 + e * sin(radians({0}))), e / 2))"
    return [
        ("ell", "select 6378137e0 as a, sqrt(2 / 298.257222101e0 - 1 / (298.257222101e0 * 298.257222101e0)) as e"),
        ("cone", f"select *, ln({m.format('44e0')} / {m.format('49e0')}) / ({q.format('49e0')} - {q.format('44e0')}) as n from ell"),
        ("big", f"select *, a * {m.format('44e0')} / n * exp(n * {q.format('44e0')}) as k from cone"),
        ("apex", f"select *, 6600000e0 + k * exp(-n * {q.format('46.5e0')}) as ys from big"),
        ("geo", f"select p.*, apex.*, k * exp(-n * {q.format('lat')}) as rho, n * radians(lon - 3) as theta from ({points}) p cross join apex"),
        ("flat", "select *, 700000 + rho * sin(theta) as x, ys - rho * cos(theta) as y from geo"),
    ]


def _around(value: str, source: str, target: str, digits: int) -> str:
    """Bilinear values at places (y, x in cells, centres whole) of ``target`` (r, c)."""
    return (
        f"select t.r, t.c, s.v from {target} t left join (select p.r, p.c, round(sum(w * g.{value}::double) / sum(w), {digits}) as v from (select r, c, floor(y) + i as sr, floor(x) + j as sc, "
        f"(case when i = 0 then 1 - (y - floor(y)) else y - floor(y) end) * (case when j = 0 then 1 - (x - floor(x)) else x - floor(x) end) as w from {target}, (values (0), (1)) di(i), (values (0), (1)) dj(j)) p "
        f"join {source} g on g.r = p.sr and g.c = p.sc where w > 0 group by 1, 2) s on s.r = t.r and s.c = t.c"
    )


_CELLS = f"select r, c, 2.99e0 + (c + 0.5e0) * 0.0002e0 as lon, 46.51e0 - (r + 0.5e0) * 0.0002e0 as lat from {_GEO.format(rows=16, columns=40)}"
_PLACES = ("places", "select r, c, (6600400e0 - y) / 20 as gy, (x - 699500e0) / 20 as gx from flat")

# --- polygons: edges cut by rows of cells, and centres by the number of edges to their left
_RINGS = """
select seq, value, case when seq % 3 = 0
  then [[x0 + 0.2e0, y0 + 0.1e0], [x1 - 0.2e0, y1 - 0.3e0], [x0 + 0.4e0, y1 - 0.1e0]]
  else [[x0 + 0.3e0, y0 + 0.2e0], [x1 - 0.1e0, y0 + 0.7e0], [x1 - 0.4e0, y1 - 0.1e0], [x0 + 0.1e0, y1 - 0.6e0]] end as p from v_box
"""
_POLYGONS = [
    ("rings", _RINGS),
    ("edges", "select seq, value, p[i][1] as ax, p[i][2] as ay, p[i % len(p) + 1][1] as bx, p[i % len(p) + 1][2] as b_y from rings, unnest(range(1, len(p) + 1)) u(i)"),
    ("boxed", "select r, c from (select unnest(range(0, 35))::int as r) a cross join (select unnest(range(0, 45))::int as c) b"),
    (
        "inside",
        "select seq, value, r, c from edges join boxed on (ay <= r + 0.5e0) <> (b_y <= r + 0.5e0) and ax + (r + 0.5e0 - ay) * (bx - ax) / (b_y - ay) <= c + 0.5e0 group by all having count(*) % 2 = 1",
    ),
    (
        "run",
        "select seq, value, r, case when ay = b_y then ax else ax + (greatest(least(ay, b_y), r) - ay) * (bx - ax) / (b_y - ay) end as p, case when ay = b_y then bx else ax + (least(greatest(ay, b_y), r + 1) - ay) * (bx - ax) / (b_y - ay) end as q "
        "from edges join (select unnest(range(0, 35))::int as r) on least(ay, b_y) < r + 1 and greatest(ay, b_y) >= r",
    ),
    ("through", "select seq, value, r, c from run join (select unnest(range(0, 45))::int as c) on c >= floor(least(p, q)) and c <= floor(greatest(p, q))"),
]

_MASKS = ("masks", "select distinct pixel_id, obs_date, case when day(obs_date) % 2 = 0 then 0.25e0 else 1e0 end as clear from v_obs where pixel_id % 3 <> 0")
_SHORT = "tile_id like '%\\_6050000' escape '\\' and substr(tile_id, -7, 2) = '60'"


def _until() -> str:
    """The stop rule: one harmonic, at most three iterations, windows of 20 rows."""
    n = 3
    fitted = " + ".join(f"x_{i}_y * {a}" for i, a in enumerate(O._basis(1)))
    steps = [_REFL, _IDX, ("s1", "select pixel_id, floor(r / 20e0)::bigint as win, t, coalesce(ndvi, avg(ndvi) over (partition by pixel_id)) as y, case when ndvi is null then 0e0 else 1e0 end as w from idx")]
    steps.append(("s0", "select pixel_id, t, y, case when y is null then 0e0 else 1e0 end as w from s1"))
    steps += O._fit("s0", 1, ["y"], "fit0a")
    # The starting fit has parameters where three rows weigh in the weighted one.
    steps.append(("few", "select pixel_id, any_value(win) as win, count(*) filter (where w > 0) as n from s1 group by pixel_id"))
    zero = ", ".join(f"case when n >= {n} then x_{i}_y else 0e0 end as x_{i}_y" for i in range(n))
    steps.append(("fit0", f"select pixel_id, {zero} from fit0a join few using (pixel_id)"))
    for k in (1, 2, 3):
        steps += O._fit(f"s{k}", 1, ["y"], f"fit{k}")
        moved = " union all ".join(f"select win, abs(b.x_{i}_y - a.x_{i}_y) / greatest(abs(a.x_{i}_y), 1e-5) as v from fit{k - 1} a join fit{k} b using (pixel_id) join few using (pixel_id)" for i in range(n))
        steps.append((f"stop{k}", f"select win, quantile_cont(v, 0.75) as v from ({moved}) group by win"))
        steps.append((f"res{k}", f"select s.*, s.y - ({fitted}) as residual from s{k} s join fit{k} using (pixel_id)"))
        delta = "(1.345e0 * case when sigma = 0 then 1e-8 else sigma end)"
        huber = f"case when abs(residual) <= {delta} then 1e0 else {delta} / (abs(residual) + 1e-8) end"
        steps.append((f"s{k + 1}", f"select pixel_id, win, t, y, w * {huber} as w from (select *, stddev_pop(residual) over (partition by pixel_id) as sigma from res{k})"))
    steps.append(("last", "select a.win, case when a.v < 0.05 then 1 when b.v < 0.05 then 2 else 3 end as iterations from stop1 a join stop2 b using (win)"))
    xs = lambda k: ", ".join(f"round(x_{i}_y, 6) as x_{i}" for i in range(n))
    body = " union all ".join(f"select pixel_id, win, {xs(k)}, iterations from fit{k} join few using (pixel_id) join last using (win) where iterations = {k}" for k in (1, 2, 3))
    return _with("v_obs", *steps, body=body)


def _smooth(sigma: float) -> list[tuple[str, str]]:
    offsets = ("k", "select * from (values " + ", ".join(f"({s * i}, {w!r}::double)" for i, w in enumerate(O._gauss(sigma)) for s in ((1,) if not i else (1, -1))) + ") t(o, wt)")
    return [offsets, *O._SMOOTH[1:]]


_AGREEMENT = O._regions("pairs")

SQL: dict[str, str] = {
    "features_irls": _with("v_obs v_grid", *_IRLS_WIDE, body=f"select pixel_id, n_obs, {', '.join(f'round({c}, 5) + 0e0 as {c}' for c in O._WIDE_COLUMNS)} from wide"),
    "probability_map_irls": _with("v_obs v_grid", *_IRLS_WIDE, O._SCORED, body=f"select pixel_id, n_obs, {_PROB} from scored"),
    "robust_by_key": _with("v_obs", _REFL, _IDX, *_robust(["ndvi"], 3, weight="1e0"), body=f"select f.pixel_id, {O._params(2, 'y')}, round(v, 6) as residual_variance from ndvi_fit f join (select pixel_id, var_pop(residual) as v from ndvi_res group by 1) using (pixel_id)"),
    "irls_until": _until(),
    "forest_score": _with(
        "v_obs", *_PLAIN_WIDE,
        ("walk", f"select pixel_id, {_plain_features()} as f, tree, 0 as node from fit cross join (select unnest(range(0, 100)) as tree)"),
        ("walk1", f"select * replace ({_STEP} as node) from walk"), ("walk2", f"select * replace ({_STEP} as node) from walk1"), ("walk3", f"select * replace ({_STEP} as node) from walk2"),
        body="select pixel_id, round(avg(((tree * 31 + node * 17) % 101) / 100e0), 6) as probability from walk3 group by pixel_id",
    ),
    "model_roundtrip": "select * from (values " + ", ".join("(" + ", ".join("null" if v is None else f"'{v}'" if isinstance(v, str) else repr(v) for v in x) + ")" for x in O.DEMO_TREES) + ") t(tree, node, feature, threshold, \"left\", \"right\", p)",
    "remaining_inference": _with("v_obs", *[x for x in O._wide() if x[0] not in ("dem", "wide")], ("dem", "select 0::bigint as pixel_id, 0e0 as elevation where false"), O._wide()[-1], O._SCORED, body=f"select floor(pixel_id / 500.0)::bigint as tile_idx, pixel_id, n_obs, {_PROB} from scored where floor(pixel_id / 500.0)::bigint % 3 <> 0"),
    "classify_with_aspect": _with(
        "v_obs v_grid", *[x for x in O._encoded() if x[0] not in ("wide", "scored")],
        ("wide", f"select pixel_id, 0 as n_obs, {', '.join(f'coalesce({c}, 0e0) as {c}' for c in O._WIDE_COLUMNS if c != 'elevation')}, g.r, g.c, g.elevation::double as elevation from decoded join v_grid g using (pixel_id)"),
        ("scored", O._SCORED[1].replace("n_obs", "r, c")), *_smooth(3.0), ("fixed", "select r, c, v from smooth"), *O._ASPECT[len(O._SMOOTH) + 1 :],
        body="select pixel_id, case when probability > 0.5 then 2 else 1 end as value, round(aspect, 4) as aspect from scored left join asp using (r, c)",
    ),
    "gaussian_smooth_3": _with("v_grid", *_smooth(3.0), body="select r, c, round(v, 6) as elevation from smooth"),
    "cloud_mask_join": _with("v_obs", _MASKS, body="select o.pixel_id, o.obs_date, o.b2, coalesce(clear, 1e0) as clear from (select distinct pixel_id, obs_date, b2 from v_obs) o left join masks m on m.pixel_id = o.pixel_id and m.obs_date = o.obs_date"),
    "cloud_mask_weights": _with("v_obs", _MASKS, body="select o.pixel_id, round(sum(case when b2 = 65535 then 0e0 else coalesce(clear, 1e0) end), 6) as weight from v_obs o left join masks m on m.pixel_id = o.pixel_id and m.obs_date = o.obs_date group by 1"),
    "region_names": _with(
        "v_grid", O._PAIRS, ("m", f"select region, agreement from ({_AGREEMENT}) where total = 0"), ("areas", f"select {O._REGION} as region, min(c) as x0, max(c) as x1 from v_grid group by 1 having region is not null"),
        body="select m.region, agreement, case when m.region <> 'Corsica' then upper(m.region) end as name, x0, x1 from m left join areas using (region)",
    ),
    "dissolve_by_letter": _with("v_box", body=f"select {_TILE_LETTERS} as key, min_by({_TILE_LETTERS} || seq, seq) as code, min_by(value, seq) as value, count(*) as parts from v_box group by 1 having key > (select min({_TILE_LETTERS}) from v_box)"),
    "dissolve_cells": _with("v_box", body="select key, count(*) as cells, sum(r * 45 + c)::bigint as places from (select distinct seq % 5 as key, y.r, x.c from v_box, unnest(range(greatest(y0, 0), least(y1, 35))) y(r), unnest(range(greatest(x0, 0), least(x1, 45))) x(c)) group by key"),
    "tiles_with_elevation": _with("v_path", _FILES, body="select tile_id, count(*)::int as n_dates from files where split_part(tile_id, '_', 2)::int % 100000 = 0 group by tile_id"),
    "single_date_catalog": _with("v_obs", body="select distinct '/data/' || strftime(obs_date, '%Y-%m-%d') || '_mean_S2' || case when day(obs_date) % 2 = 0 then 'A' else 'B' end || '_DL_PHENOLOGY.tif' as path, obs_date as date from v_obs where year(obs_date) in (1995, 1996)"),
    "month_dates": _with("v_obs", body="select distinct '/d/s2_' || strftime(obs_date, '%Y%m') || '.tif' as path, date_trunc('month', obs_date)::date as date from v_obs"),
    "missing_configs": _with("v_state", body="select i as tile_idx from unnest(range(0, 60)) t(i) where i not in (select tile_idx from v_state where tile_idx % 4 <> 1)"),
    "first_windows": _with("v_grid", body="select (r // 8 * 7 + c // 8)::int as window_id, (r // 8 * 8)::int as row_off, (c // 8 * 8)::int as col_off, count(distinct r)::int as height, count(distinct c)::int as width from v_grid group by 1, 2, 3 order by 1 limit 10"),
    "tile_slice": _with("v_path", _FILES, body="select distinct tile_id from files order by 1 limit 6 offset 3"),
    "central_windows": _with("v_grid", ("z", "select c // 25 as year, max(r) + 1 as h, max(c % 25) + 1 as w from v_grid group by 1"), body="select year, (r - r0)::int as r, (c - c0)::int as c, prob from (select z.year::int as year, r, c % 25 as c, prob, greatest((h - 12) // 2, 0) as r0, greatest((w - 12) // 2, 0) as c0 from v_grid g join z on z.year = g.c // 25) where r >= r0 and r < r0 + 12 and c >= c0 and c < c0 + 12"),
    "window_bounds": "select (i * 4 + j)::int as window_id, 100000e0 + j * 160 as \"left\", 6800000e0 - least(i * 16 + 16, 35) * 10 as bottom, 100000e0 + least(j * 16 + 16, 50) * 10 as \"right\", 6800000e0 - i * 160 as top from unnest(range(0, 3)) a(i), unnest(range(0, 4)) b(j)",
    "affine_roundtrip": _with("v_grid", body="select r, c, 100000 + c * 10 + 5e0 as x, 6800000 - r * 10 - 5e0 as y, r + 1 as row, c as \"column\" from v_grid"),
    "resampled_windows": _with(
        "v_grid", ("t", f"select r, c, floor((400 - 346 + (r + 0.5e0) * 15) / 10) as sr, floor((47 + (c + 0.5e0) * 15) / 10) as sc, floor(5 + (r + 0.5e0) * 1.5e0) as tr, floor(4 + (c + 0.5e0) * 1.5e0) as tc from {_GEO.format(rows=12, columns=20)}"),
        body="select t.r, t.c, g.prob as v, h.prob as truncated from t left join v_grid g on g.r = sr and g.c = sc left join v_grid h on h.r = tr and h.c = tc",
    ),
    "masked_raster": _with(
        "v_grid", ("z", "select max(r) + 1 as h from v_grid"),
        ("e", "select greatest(400 - h * 10, 380 - h * 12) as bottom from z"),
        ("t", "select a.r, b.c, 380 - (a.r + 0.5e0) * 10 as y, 33 + (b.c + 0.5e0) * 10 as x from e, unnest(range(0, floor((380 - bottom) / 10e0)::int)) a(r), unnest(range(0, 46)) b(c)"),
        body="select t.r::int as r, t.c::int as c, case when m.forest = 1 then coalesce(g.prob, 0) else 0 end as v from t left join v_grid g on g.r = floor((400 - y) / 10) and g.c = floor(x / 10) left join v_grid m on m.r = floor((380 - y) / 12) and m.c = floor((x - 33) / 12)",
    ),
    "warp_nearest": _with("v_grid", *_forward(_CELLS), _PLACES, body="select p.r, p.c, round(g.elevation::double, 4) as v from places p left join v_grid g on g.r = floor(gy) and g.c = floor(gx)"),
    "warp_bilinear": _with("v_grid", *_forward(_CELLS), _PLACES, ("t", "select r, c, gy - 0.5e0 as y, gx - 0.5e0 as x from places"), body=_around("elevation", "v_grid", "t", 4)),
    "vpp_extraction": _with(
        "v_grid", *O._lambert_steps(f"select r, c, tile, \"left\" + (c + 0.5e0) * 50 as x, top - (r + 0.5e0) * 50 as y from {_GEO.format(rows=10, columns=12)} cross join (values ('a', 699500e0, 6600200e0), ('b', 100000e0, 6800000e0)) o(tile, \"left\", top)"),
        ("t", "select r + case tile when 'a' then 0 else 100 end as r, c, (46.51e0 - degrees(phi)) / 0.0004e0 - 0.5e0 as y, (lon - 2.99e0) / 0.0004e0 - 0.5e0 as x from lat8"), ("w", _around("prob", "v_grid", "t", 9)),
        body="select case when r < 100 then 'a' else 'b' end as tile, count(v) as n, round(max(v), 3) as high, count(v) > 0 and coalesce(max(v), 0) > 0 as valid from w group by 1",
    ),
    "rasterize_polygons": _with("v_box", *_POLYGONS, body="select r, c, max_by(value, seq) as value from (select * from inside union select * from through) group by r, c"),
    "band_validation": _with(
        "v_obs v_grid", ("p", "select distinct pixel_id from v_obs"), ("dem", "select distinct pixel_id from v_grid where pixel_id % 7 <> 0"), ("per", "select obs_date, count(*) as n, count(distinct pixel_id) as m from v_obs group by 1"),
        body="select 'ragged_dates' as problem, count(*) filter (where m <> (select count(*) from p)) as n from per union all select 'repeated_rows', sum(n - m)::bigint from per union all select 'missing_bands', 1 "
        "union all select 'bad_mask', count(*) filter (where flg not between 0 and 1) from v_obs union all select 'no_elevation', count(*) from p where pixel_id not in (select pixel_id from dem) union all select 'no_pixel', count(*) from dem where pixel_id not in (select pixel_id from p)",
    ),
    "input_validation": _with("v_path", _FILES, body=f"select distinct tile_id, 'dates do not match paths' as problem from files where {_SHORT} union all select distinct tile_id, 'a file is missing' from files where path like '%/1996/03-%'"),
    "missing_features": "select unnest(['ndvi_offset', 'nbr_offset']) as name",
    "one_crs": "select 'EPSG:2154' as crs",
    "isolated_comparison": _with("v_grid", O._PAIRS, body=f"select *, 'reference' as prefix from ({_AGREEMENT})"),
    "probability_tiles": _with("v_grid", body="select (r // 10)::int as tile_id, r, c, case when prob = 7 then 0 else prob end as prob from v_grid"),
    "feature_raster": _with("v_grid", body="select r, c, case when pixel_id % 9 <> 0 then floor(prob / 255e0 * 65535)::int else 65535 end as feature from v_grid"),
    "class_raster": _with("v_grid", body="select (r // 10)::int as tile_id, case when prob >= 128 then 2 else 1 end as class, count(*) as n from v_grid group by 1, 2"),
    "rasterized_vectors": f"select (r // 16)::int as tile_id, count(*) as n, sum(value)::bigint as total from ({O.SQL['rasterize_boxes']}) group by 1",
    "raster_blocks": _with("v_grid", body="select (r // 16)::int as block_row, (c // 16)::int as block_col, (max(r) - min(r) + 1)::int as height, (max(c) - min(c) + 1)::int as width, count(*)::int as n, min_by(prob, r * 50 + c) as first, max_by(prob, r * 50 + c) as last from v_grid group by 1, 2"),
    "elevation_raster": _with("v_grid", body=f"select t.r, t.c, round(g.elevation::float::double, 3) as elevation from (select r, c from {_GEO.format(rows=14, columns=20)}) t left join v_grid g on g.r = floor((t.r + 0.5e0) * 2.5e0) and g.c = floor((t.c + 0.5e0) * 2.5e0)"),
    "run_folder": _with("v_path", _FILES, body="select count(distinct tile_id) as tiles, 10 as tile_iter, count(distinct tile_id) as num_tiles, 10 as max_iter, 1024 as window_size, 0 as done from files"),
    "state_upsert": "select unnest([1, 2, 3, 5])::bigint as tile_idx, 1 as completed",
    "job_summary": _with("v_path", _FILES, ("t", "select tile_id, count(*) as n from files group by 1"), body="select unnest(['tiles: ' || count(*), 'dates: ' || max(n), 'window_size: 1024', 'workers_per_tile: 4', 'num_harmonics: 2', 'max_iter: 1']) as line from t"),
    "yaml_settings": "select * from (values ('max_iter', 10), ('num_harmonics', 2), ('window_size', 512), ('workers_per_tile', 4)) t(name, value)",
    "metrics_report": _with("v_grid", O._PAIRS, O._MATRIX, body="select * from matrix"),
    "clean_json": """select * from (values (0, '{"a": null, "b": [1, 2.5]}'), (1, '[null, null]'), (2, '{"c": {"d": null}}')) t(i, json)""",
    "quarantined_files": f"select seq, status from ({O.SQL['file_screening']})",
    "sine_series": "select p as pixel_id, i::int as i, round(0.4e0 + 0.3e0 * sin(0.5e0 * u + 0.2e0) + 0.15e0 * sin(u + 0.1e0) + 0.05e0 * sin(3 * u), 6) as y from unnest(range(0, 5)) a(p), (select j as i, j * 2 * pi() / 35 as u from unnest(range(0, 36)) b(j))",
}

_TILE_EDGES = ("ends", "select tile_id, min(lon) as west, max(degrees(phi)) as north from lat8 group by tile_id")
SQL["dem_info_slice"] = _with(
    "v_path", _FILES, O._TILES, *O._lambert_steps(O._EDGES), _TILE_EDGES,
    body="select tile_id, 'EPSG:2154' as crs, \"left\", round(west, 6) as west, round(north, 6) as north, 5000 as width from tiles join ends using (tile_id) order by tile_id limit 10 offset 2",
)
