"""DuckDB statements of the registered raster queries, written from the mathematics and not from the plans."""

from __future__ import annotations

import math

from ..fixtures import CTE
from ..functions.spectral import CRSWIR_SLOPE
from ..operators.model import DEMO_TREES
from .comparison import REGIONS

PI = "3.141592653589793"


def _with(names: str, *steps: tuple[str, str], body: str) -> str:
    parts = [(n, CTE[n]) for n in names.split()] + list(steps)
    return "with " + ", ".join(f"{n} as ({q})" for n, q in parts) + " " + body


def _clip(x: str, low: float, high: float) -> str:
    return f"(case when ({x}) is not null then least(greatest({x}, {low}), {high}) end)"


def _div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0e0))"


_REFL = ("refl", "select pixel_id, r, c, obs_date, flg, nullif(b2, 65535) / 1e4 as b2, nullif(b4, 65535) / 1e4 as b4, nullif(b8, 65535) / 1e4 as b8, nullif(b11, 65535) / 1e4 as b11, nullif(b12, 65535) / 1e4 as b12 from v_obs")
_NDVI = _clip(_div("b8 - b4", "b8 + b4 + 1e-8"), -1.0, 1.0) + " / 2 + 0.5e0"
_EVI = _clip(_div("2.5e0 * (b8 - b4)", "b8 + 6e0 * b4 - 7.5e0 * b2 + 1e0 + 1e-8"), -1.0, 1.0) + " / 2 + 0.5e0"
_NBR = _clip(_div("b8 - b12", "b8 + b12 + 1e-8"), -1.0, 1.0) + " / 2 + 0.5e0"
_CRSWIR = _clip(_div("b11", f"(b12 - b8) * {CRSWIR_SLOPE!r}::double + b8 + 1e-8"), 0.0, 5.0) + " / 5"
_IDX = (
    "idx",
    f"select pixel_id, r, c, obs_date, date_diff('day', (select min(obs_date) from v_obs), obs_date) / 365.25e0 as t, b2, b4, b8, b11, b12, "
    f"{_NDVI} as ndvi, {_EVI} as evi, {_NBR} as nbr, {_CRSWIR} as crswir from refl",
)


def _basis(harmonics: int, t: str = "t") -> list[str]:
    return [f"{f}({t} * {2 * 3.141592653589793 * k!r}::double)" for k in range(1, harmonics + 1) for f in ("cos", "sin")] + ["1e0"]


def _fit(source: str, harmonics: int, ys: list[str], out: str = "fit") -> list[tuple[str, str]]:
    """Steps that solve the weighted normal equations of ``source`` (pixel_id, t, w, ys)."""
    n = 2 * harmonics + 1
    a = ", ".join(f"{x} as a{i}" for i, x in enumerate(_basis(harmonics)))
    steps = [(f"{out}_a", f"select *, {a} from {source}")]
    sums = [f"sum(w * a{i} * a{j}) as m_{i}_{j}" for i in range(n) for j in range(i + 1)] + [f"sum(w * a{i} * coalesce({y}, 0e0)) as r_{i}_{y}" for y in ys for i in range(n)]
    steps.append((f"{out}_s", f"select pixel_id, count(*) filter (where w > 0) as n_obs, {', '.join(sums)} from {out}_a group by pixel_id"))
    last = f"{out}_s"
    for k in range(n):
        keep = [f"d_{i}" for i in range(k)] + [f"l_{i}_{j}" for j in range(k) for i in range(j + 1, n)]
        keep += [f"r_{i}_{y}" for y in ys for i in range(k + 1)]
        p = f"nullif(m_{k}_{k}, 0e0)"
        new = [f"{p} as d_{k}"] + [f"m_{i}_{k} / {p} as l_{i}_{k}" for i in range(k + 1, n)]
        new += [f"m_{i}_{j} - m_{i}_{k} * m_{j}_{k} / {p} as m_{i}_{j}" for i in range(k + 1, n) for j in range(k + 1, i + 1)]
        new += [f"r_{i}_{y} - m_{i}_{k} * r_{k}_{y} / {p} as r_{i}_{y}" for y in ys for i in range(k + 1, n)]
        steps.append((f"{out}_f{k}", f"select pixel_id, n_obs, {', '.join(keep + new)} from {last}"))
        last = f"{out}_f{k}"
    done: list[str] = []
    for k in reversed(range(n)):
        new = [f"r_{k}_{y} / d_{k}" + "".join(f" - l_{i}_{k} * x_{i}_{y}" for i in range(k + 1, n)) + f" as x_{k}_{y}" for y in ys]
        steps.append((f"{out}_b{k}", f"select *, {', '.join(new)} from {last}"))
        last = f"{out}_b{k}"
        done += [f"x_{k}_{y}" for y in ys]
    xs = ", ".join(f"case when n_obs >= {n} then coalesce({x}, 0e0) else 0e0 end as {x}" for x in done)
    steps.append((out, f"select pixel_id, n_obs, {xs} from {last}"))
    return steps


def _params(harmonics: int, y: str) -> str:
    out = []
    for k in range(1, harmonics + 1):
        a, b = f"x_{2 * k - 2}_{y}", f"x_{2 * k - 1}_{y}"
        out += [f"round(sqrt({a} * {a} + {b} * {b}), 6) as amplitude_h{k}", f"round(atan2({b}, {a}), 6) as phase_h{k}"]
    return ", ".join([*out, f"round(x_{2 * harmonics}_{y}, 6) as \"offset\""])


_ONE = ("src", "select pixel_id, t, ndvi, case when ndvi is null then 0e0 else 1e0 end as w from idx")


def _wls(harmonics: int) -> str:
    return _with("v_obs", _REFL, _IDX, _ONE, *_fit("src", harmonics, ["ndvi"]), body=f"select pixel_id, {_params(harmonics, 'ndvi')}, n_obs from fit")


def _irls(iterations: int) -> list[tuple[str, str]]:
    steps = [_REFL, _IDX, ("src1", "select pixel_id, t, ndvi, coalesce(ndvi, avg(ndvi) over (partition by pixel_id)) as y, case when ndvi is null then 0e0 else 1e0 end as w, row_number() over () as id from idx")]
    fitted = " + ".join(f"x_{i}_y * {a}" for i, a in enumerate(_basis(2)))
    for k in range(1, iterations + 1):
        steps += _fit(f"src{k}", 2, ["y"], f"fit{k}")
        steps.append((f"res{k}", f"select s.*, s.y - ({fitted}) as residual from src{k} s join fit{k} using (pixel_id)"))
        steps.append((f"sig{k}", f"select *, stddev_pop(residual) over (partition by pixel_id) as sigma from res{k}"))
        delta = "(1.345e0 * case when sigma = 0 then 1e-8 else sigma end)"
        steps.append((f"src{k + 1}", f"select * replace (w * case when abs(residual) <= {delta} then 1e0 else {delta} / (abs(residual) + 1e-8) end as w) from sig{k}"))
        if k < iterations:
            steps.append((f"keep{k}", f"select * exclude (residual, sigma) from src{k + 1}"))
            steps[-1], steps[-2] = (f"src{k + 1}", steps[-1][1].replace(f"src{k + 1}", f"upd{k}")), (f"upd{k}", steps[-2][1])
    return steps


_INDICES = ["ndvi", "evi", "nbr", "crswir"]
_ALL = ("src", "select pixel_id, t, ndvi, evi, nbr, crswir, case when ndvi is null or evi is null or nbr is null or crswir is null then 0e0 when b2 is null or b4 is null or b8 is null or b11 is null or b12 is null then 0e0 else 1e0 end as w from idx")


def _wide() -> list[tuple[str, str]]:
    out = []
    for y in _INDICES:
        for k in (1, 2):
            a, b = f"x_{2 * k - 2}_{y}", f"x_{2 * k - 1}_{y}"
            out += [f"sqrt({a} * {a} + {b} * {b}) as {y}_amplitude_h{k}", f"cos(atan2({b}, {a})) as {y}_cos_phase_h{k}"]
        out.append(f"x_4_{y} as {y}_offset")
    wide = ("wide", f"select f.pixel_id, n_obs, {', '.join(out)}, coalesce(dem.elevation, 0)::double as elevation from fit f left join dem using (pixel_id)")
    return [_REFL, _IDX, _ALL, *_fit("src", 2, _INDICES), ("dem", "select pixel_id, elevation from v_grid where pixel_id % 7 <> 0"), wide]


_WIDE_COLUMNS = [f"{y}_{n}" for y in _INDICES for n in ("amplitude_h1", "cos_phase_h1", "amplitude_h2", "cos_phase_h2", "offset")] + ["elevation"]


def _tree(tree: int, node: int = 0) -> str:
    _, _, feature, threshold, left, right, p = next(x for x in DEMO_TREES if x[0] == tree and x[1] == node)
    return f"{p}::double" if feature is None else f"(case when {feature} <= {threshold} then {_tree(tree, left)} else {_tree(tree, right)} end)"


_SCORED = ("scored", f"select pixel_id, n_obs, ({' + '.join(_tree(t) for t in range(3))}) / 3e0 as probability from wide")

_REGION = "case eco " + " ".join(f"when {k} then '{v}'" for k, v in REGIONS.items()) + " end"
_NAME = "case {0} when 1 then 'deciduous' when 2 then 'evergreen' end"
_PAIRS = ("pairs", f"select r, c, {_NAME.format('cls1')} as pred, {_NAME.format('cls2')} as truth, {_REGION} as region from v_grid where forest = 1")
_VALID = "pred is not null and truth is not null"
_COUNTS = f"count(*) as forest_pixels, count(*) filter (where {_VALID}) as labelled, count(*) filter (where {_VALID} and pred = truth) as agreeing"
_RATIOS = "round(coalesce(agreeing / nullif(labelled, 0)::double, 0), 6) as agreement, round(coalesce(labelled / nullif(forest_pixels, 0)::double, 0), 6) as coverage"
_MATRIX = ("matrix", f"select t.n as truth, p.n as pred, count(x.pred) as n from (values ('deciduous'), ('evergreen')) t(n) cross join (values ('deciduous'), ('evergreen')) p(n) left join (select * from pairs where {_VALID}) x on x.truth = t.n and x.pred = p.n group by 1, 2")


def _regions(pairs: str) -> str:
    return f"select region, total, forest_pixels, labelled, agreeing, {_RATIOS} from (select region, 0 as total, {_COUNTS} from {pairs} where region is not null group by region union all select null, 1, {_COUNTS} from {pairs})"


def _describe(by: str, columns: list[str], source: str) -> str:
    long = " union all ".join(f"select {by + ', ' if by else ''}'{c}' as name, {c}::double as x from {source}" for c in columns)
    return (
        f"select {by + ', ' if by else ''}name, count(*) as n, count(x) as n_valid, round(min(x), 6) as low, round(max(x), 6) as high, round(avg(x), 6) as mean, round(stddev_pop(x), 6) as deviation, "
        f"round(quantile_cont(x, 0.5), 6) as median, count(*) filter (where x = 0) as zeros, round(100e0 * (count(*) - count(x)) / count(*), 6) as null_percent, "
        f"round(100e0 * count(*) filter (where x < 0 or x > 1) / count(*), 6) as outside_percent, round(100e0 * count(*) filter (where isinf(x)) / count(*), 6) as inf_percent, round(100e0 * count(*) filter (where abs(x) < 1e-6) / count(*), 6) as near_zero_percent from ({long}) group by all"
    )


def _bin(x: str, low: float, high: float, bins: int = 50) -> str:
    return f"least(floor(({x} - {low}::double) / {(high - low) / bins!r}::double), {bins - 1})::int"


_H1 = [_REFL, _IDX, _ONE, *_fit("src", 2, ["ndvi"]), ("par", "select pixel_id, round(sqrt(x_0_ndvi * x_0_ndvi + x_1_ndvi * x_1_ndvi), 9) as amplitude, round(atan2(x_1_ndvi, x_0_ndvi), 9) as phase, round(x_4_ndvi, 9) as off from fit")]
_ENC = ("enc", f"select pixel_id, floor({_clip('amplitude', 0.0, 1.0)} * 65535)::int as amplitude_h1, floor({_clip(f'(phase + {PI}::double) / {2 * 3.141592653589793!r}::double', 0.0, 1.0)} * 65535)::int as phase_h1, floor({_clip('off', 0.0, 1.0)} * 65535)::int as \"offset\" from par")

_FILES = ("files", "select path, regexp_extract(path, 's2_(EPSG[0-9]+_[0-9]+_[0-9]+)\\.tif$', 1) as tile_id, make_date(substr(path, 7, 4)::int, substr(path, 12, 2)::int, substr(path, 15, 2)::int) as date from v_path")

def _gauss(sigma: float) -> list[float]:
    """Normalised weights exp(-k^2 / 2 sigma^2) out to four deviations, by distance."""
    reach = range(-round(4 * sigma), round(4 * sigma) + 1)
    total = math.fsum(math.exp(-(k * k) / (2 * sigma * sigma)) for k in reach)
    return [math.exp(-(k * k) / (2 * sigma * sigma)) / total for k in reach if k >= 0]


_KERNEL = _gauss(1.0)
_HW = "(select max(r) + 1 as h, max(c) + 1 as w from v_grid)"


def _mirror(i: str, n: str) -> str:
    m = f"((({i}) % (2 * {n}) + 2 * {n}) % (2 * {n}))"
    return f"(case when {m} < {n} then {m} else 2 * {n} - 1 - {m} end)"


_OFFSETS = ("k", "select * from (values " + ", ".join(f"({s * i}, {w!r}::double)" for i, w in enumerate(_KERNEL) for s in ((1,) if not i else (1, -1))) + ") t(o, wt)")
_SMOOTH = [
    _OFFSETS,
    ("down", f"select g.r, g.c, sum(wt * s.elevation::double) as v from v_grid g cross join k cross join {_HW} z join v_grid s on s.c = g.c and s.r = {_mirror('g.r + o', 'h')} group by 1, 2"),
    ("smooth", f"select g.r, g.c, sum(wt * s.v) as v from v_grid g cross join k cross join {_HW} z join down s on s.r = g.r and s.c = {_mirror('g.c + o', 'w')} group by 1, 2"),
]


def _slope(axis: str) -> str:
    by, order = ("c", "r") if axis == "r" else ("r", "c")
    w = f"over (partition by {by} order by {order})"
    return f"case when lag(v) {w} is null then (lead(v) {w} - v) / 10e0 when lead(v) {w} is null then (v - lag(v) {w}) / 10e0 else (lead(v) {w} - lag(v) {w}) / 20e0 end"


_ASPECT = [
    *_SMOOTH,
    ("fixed", "select r, c, round(v, 4) as v from smooth"),
    ("grad", f"select r, c, {_slope('r')} as dy, {_slope('c')} as dx from fixed"),
    ("asp", "select *, case when 90e0 - degrees(atan2(dy, dx)) < 0 then 450e0 - degrees(atan2(dy, dx)) else 90e0 - degrees(atan2(dy, dx)) end as aspect from grad"),
]


def _disk(radius: int) -> str:
    return f"(select y.v as dy, x.v as dx from (select unnest(range(-{radius}, {radius + 1})) as v) y, (select unnest(range(-{radius}, {radius + 1})) as v) x where y.v * y.v + x.v * x.v <= {radius * radius})"


_CLEAR = ("clear_", "select r, c, flg, case when flg in (1, 2, 3) then 0 else 1 end as clear from v_grid")


def _dilate(radius: int) -> str:
    return f"select g.r, g.c, g.flg, g.clear, max(s.clear) as dilated from clear_ g cross join {_disk(radius)} o join clear_ s on s.r = g.r + o.dy and s.c = g.c + o.dx group by all"


def _mean(radius: int, source: str, value: str) -> str:
    return f"select g.r, g.c, floor(sum(s.{value}) / count(*)::double)::int as mean from {source} g cross join {_disk(radius)} o join {source} s on s.r = g.r + o.dy and s.c = g.c + o.dx group by all"


_BILINEAR = """
select t.r, t.c, round(sum(wy * wx * g.prob) / sum(wy * wx), 6) as prob
from (select a.r, b.c, (a.r + 0.5e0) * 1.5e0 - 0.5e0 as y, (b.c + 0.5e0) * 1.5e0 - 0.5e0 as x
      from (select unnest(range(0, floor((select max(r) + 1 from v_grid) / 1.5e0)::int))::int as r) a cross join (select unnest(range(0, 33))::int as c) b) t
cross join (values (0), (1)) dy(i) cross join (values (0), (1)) dx(j)
cross join lateral (select case when i = 0 then 1 - (y - floor(y)) else y - floor(y) end as wy, case when j = 0 then 1 - (x - floor(x)) else x - floor(x) end as wx) w
join v_grid g on g.r = floor(y) + i and g.c = floor(x) + j
where wy * wx > 0 group by 1, 2
"""

SQL: dict[str, str] = {
    "scan_window": _with("v_obs", body="select pixel_id, r, c, obs_date, b2, b4, b8 from v_obs where r between 8 and 23 and c between 10 and 25"),
    "to_reflectance": _with("v_obs", _REFL, body="select pixel_id, obs_date, round(b2, 6) as b2, round(b4, 6) as b4, round(b8, 6) as b8, round(b11, 6) as b11, round(b12, 6) as b12 from refl"),
    "spectral_indices": _with("v_obs", _REFL, _IDX, body="select pixel_id, obs_date, round(ndvi, 6) as ndvi, round(evi, 6) as evi, round(nbr, 6) as nbr, round(crswir, 6) as crswir from idx"),
    "qa_weight_nan_mask": _with("v_obs", body="select pixel_id, sum(case when b2 = 65535 or flg in (1, 2, 3) then 0e0 else 1e0 end) as weight, count(*) as n from v_obs group by pixel_id"),
    "flg_filter": _with("v_obs", body="select pixel_id, count(*) as n_clear, min(obs_date) as first_clear from v_obs where flg not in (1, 2, 3) group by pixel_id"),
    "harmonic_wls_h1": _wls(1),
    "harmonic_wls_h2": _wls(2),
    "harmonic_irls_k3": _with("v_obs", *_irls(3), body=f"select f.pixel_id, {_params(2, 'y')}, round(v, 6) as residual_variance from fit3 f join (select pixel_id, var_pop(residual) as v from sig3 group by 1) using (pixel_id)"),
    "harmonic_features_wide": _with("v_obs v_grid", *_wide(), body=f"select pixel_id, n_obs, {', '.join(f'round({c}, 6) as {c}' for c in _WIDE_COLUMNS)} from wide"),
    "residual_variance": _with("v_obs", *_irls(1), body="select pixel_id, round(var_pop(residual), 9) as variance, round(max(sigma), 6) as sigma from sig1 group by pixel_id"),
    "huber_weights": _with("v_obs", *_irls(1), body="select pixel_id, round(sum(w), 6) as weight, count(*) filter (where w < 1 and w > 0) as n_down from src2 group by pixel_id"),
    "convergence_p75": _with(
        "v_obs", *_irls(2), body="select round(quantile_cont(x, 0.75), 6) as p75 from (" + " union all ".join(f"select abs(b.x_{i}_y - a.x_{i}_y) / greatest(abs(a.x_{i}_y), 1e-5) as x from fit1 a join fit2 b using (pixel_id)" for i in range(5)) + ")"
    ),
    "reconstruct_7day": _with(
        "v_obs", *_irls(1),
        ("days", "select (d0 + 7 * i::int)::date as d, 7 * i / 365.25e0 as t from (select min(obs_date) as d0, max(obs_date) as d1 from v_obs), unnest(range(0, 2000)) as u(i) where d0 + 7 * i::int <= d1 + 6"),
        body="select pixel_id, count(*) as n, round(avg(s), 6) as mean, round(min(s), 6) as low, round(max(s), 6) as high, max(d) as last_date from (select pixel_id, d, " + " + ".join(f"x_{i}_y * {a}" for i, a in enumerate(_basis(2))) + " as s from fit1 cross join days) group by pixel_id",
    ),
    "reconstruction_rmse": _with("v_obs", *_irls(1), body="select pixel_id, round(sqrt(avg(residual * residual)), 6) as rmse from sig1 where ndvi is not null group by pixel_id"),
    "feature_encode_u16": _with("v_obs", *_H1, _ENC, body="select * from enc"),
    "feature_decode_u16": _with(
        "v_obs", *_H1, _ENC,
        body=f"select pixel_id, round(nullif(amplitude_h1, 65535) / 65535e0, 6) as amplitude_h1, round(cos(nullif(phase_h1, 65535) / 65535e0 * {2 * 3.141592653589793!r}::double - {PI}::double), 6) as cos_phase_h1, round(nullif(\"offset\", 65535) / 65535e0, 6) as \"offset\" from enc",
    ),
    "tree_score_u8": _with("v_obs v_grid", *_wide(), _SCORED, body="select pixel_id, n_obs, round(probability, 6) as probability, floor(probability * 255)::int as prob_u8, case when floor(probability * 255) >= 128 then 2 else 1 end as class from scored"),
    "classify_threshold": _with("v_grid", body="select pixel_id, case when prob >= 128 then 2 else 1 end as class, case when prob <> 0 then case when prob >= 128 then 2 else 1 end end as class_null_safe from v_grid"),
    "apply_mask": _with("v_grid", body="select r, c, case when forest = 1 then prob else 0 end as prob from v_grid"),
    "confusion_matrix_long": _with("v_grid", _PAIRS, _MATRIX, body="select * from matrix"),
    "confusion_matrix_pivot": _with("v_grid", _PAIRS, _MATRIX, body="select truth, sum(n) filter (where pred = 'deciduous')::bigint as deciduous, sum(n) filter (where pred = 'evergreen')::bigint as evergreen from matrix group by truth"),
    "confusion_percent": _with("v_grid", _PAIRS, _MATRIX, body="select truth, pred, round(100e0 * n / (select sum(n) from matrix), 6) as percent from matrix"),
    "agreement_global": _with("v_grid", _PAIRS, body=f"select labelled, agreeing, agreement from (select *, {_RATIOS} from (select {_COUNTS} from pairs))"),
    "coverage_global": _with("v_grid", _PAIRS, body=f"select forest_pixels, labelled, coverage from (select *, {_RATIOS} from (select {_COUNTS} from pairs))"),
    "agreement_by_region_rollup": _with("v_grid", _PAIRS, body=_regions("pairs")),
    "agreement_by_region_windowed": _with(
        "v_grid", _PAIRS,
        ("win", f"select region, {_COUNTS} from pairs where region is not null group by region, r // 4, c // 4"),
        ("sums", "select region, sum(forest_pixels)::bigint as forest_pixels, sum(labelled)::bigint as labelled, sum(agreeing)::bigint as agreeing from win where labelled > 0 group by region"),
        body=f"select *, {_RATIOS} from sums",
    ),
    "comparison_two_maps": _with(
        "v_grid", _PAIRS,
        ("other", f"select r, c, {_NAME.format('cls1')} as pred, case when prob >= 128 then 'evergreen' else 'deciduous' end as truth, {_REGION} as region from v_grid where forest = 1"),
        body=f"select *, 'reference' as prefix from ({_regions('pairs')}) union all select *, 'threshold' from ({_regions('other')})",
    ),
    "metrics_long": _with("v_grid", _PAIRS, ("one", f"select *, {_RATIOS} from (select {_COUNTS} from pairs)"), body=" union all ".join(f"select '{c}' as metric, round({c}::double, 6) as value from one" for c in ("forest_pixels", "labelled", "agreeing", "agreement", "coverage"))),
    "class_dictionary": "select (row_number() over (order by name) - 1)::int as id, name from (select unnest(['deciduous', 'evergreen', 'nodata']) as name) where name <> 'nodata'",
    "unmapped_values_anti": _with("v_grid", body="select distinct cls2 as value from v_grid where cls2 not in (1, 2)"),
    "band_stats_by_date": _with("v_obs", _REFL, _IDX, body=_describe("obs_date", ["b2", "b4", "b8", "b11", "b12", "ndvi", "evi", "nbr", "crswir"], "idx")),
    "band_identification": _with(
        "v_obs", _REFL, ("s", " union all ".join(f"select '{b}' as name, max({b}) as high, avg({b}) as mean from refl where {b} <> 0" for b in ("b2", "b4", "b8", "b11", "b12"))),
        body="select name, round(high, 6) as high, round(mean, 6) as mean, case when high > 0.8 then case when mean < 0.1 then 'blue or green' when mean < 0.15 then 'red' else 'near infrared' end when high < 0.5 then 'short-wave infrared' else 'uncertain' end as role from s where high is not null",
    ),
    "index_histogram": _with("v_obs", _REFL, _IDX, body=f"select {_bin('x', 0.0, 1.0)} as bin, count(*) as n from (select round(ndvi, 9) as x from idx) where x between 0 and 1 group by 1"),
    "phase_amplitude_hist2d": _with("v_obs", *_H1, body=f"select {_bin('phase', -3.15, 3.15)} as x_bin, {_bin('amplitude', 0.0, 0.5)} as y_bin, count(*) as n from par where phase between -3.15 and 3.15 and amplitude between 0 and 0.5 group by 1, 2"),
    "percentile_stretch": _with(
        "v_grid", ("q", "select quantile_cont(elevation::double, 0.02) as e0, quantile_cont(elevation::double, 0.98) as e1, quantile_cont(prob::double, 0.02) as p0, quantile_cont(prob::double, 0.98) as p1 from v_grid"),
        body="select pixel_id, round(least(greatest((elevation::double - e0) / (e1 - e0), 0), 1), 6) as elevation, round(least(greatest((prob - p0) / (p1 - p0), 0), 1), 6) as prob from v_grid, q",
    ),
    "minmax_normalise": _with("v_grid", body="select pixel_id, round((elevation::double - min(elevation::double) over ()) / (max(elevation::double) over () - min(elevation::double) over ()), 6) as elevation from v_grid"),
    "value_counts": _with("v_grid", body="select cls2 as value, count(*) as n, round(100e0 * count(*) / sum(count(*)) over (), 6) as percent from v_grid group by cls2"),
    "tile_catalog_regex": _with("v_path", _FILES, body="select distinct tile_id from files"),
    "timeseries_catalog": _with("v_path", _FILES, body="select tile_id, count(*)::int as n_dates, min(date) as first_date, max(date) as last_date, string_agg(path, '|' order by date, path) as paths from files where year(date) in (1995, 1996, 1997) group by tile_id"),
    "paired_files_join": _with("v_path", _FILES, body="select tile_id, date, path, case when month(date) % 2 = 0 then replace(path, 's2_EPSG', 'flg_EPSG') end as flg_path from files"),
    "filename_dates": _with("v_obs", body="select distinct '/data/s2_' || strftime(obs_date, '%Y%m%d') || '_mosaic.tif' as path, obs_date as date from v_obs"),
    "asof_next_date": _with("v_obs", body="select p.pixel_id, a.asked, min(o.obs_date) as obs_date from (select distinct pixel_id from v_obs) p cross join (select make_date(y, 1, 1) as asked from unnest([1996, 1997, 1998, 1999, 2000, 2001]) t(y)) a left join v_obs o on o.pixel_id = p.pixel_id and o.obs_date >= a.asked group by 1, 2"),
    "remaining_tiles": _with("v_state", body="select tile_idx from v_state where completed <> 1"),
    "progress": _with("v_state", body="select count(*) as total, count(*) filter (where completed = 1) as completed, count(*) filter (where completed <> 1) as remaining, round(100e0 * count(*) filter (where completed = 1) / count(*), 6) as percent from v_state"),
    "config_json_roundtrip": _with("v_path", _FILES, body="select tile_id, '/dem/dem_' || tile_id || '.tif' as dem_path, count(*)::int as n_paths, min(date) as first_date, 512 as window_size, 1 as max_iter, true as no_masks from files group by tile_id"),
    "winter_middle_date": _with("v_path", _FILES, body="select tile_id, list(distinct date order by date)[len(list(distinct date)) // 2 + 1] as date, len(list(distinct date))::int as n_winter from files where month(date) in (12, 1, 2) group by tile_id"),
    "cube_validation": _with("v_obs", body="select count(*) as pixels, count(*) filter (where n <> 30) as ragged, sum(bad)::bigint as bad_mask from (select pixel_id, count(distinct obs_date) as n, count(*) filter (where flg not between 0 and 1) as bad from v_obs group by 1)"),
    "window_tiling": _with("v_grid", body="select (r // 16 * 4 + c // 16)::int as window_id, (r // 16 * 16)::int as row_off, (c // 16 * 16)::int as col_off, count(distinct r)::int as height, count(distinct c)::int as width from v_grid group by 1, 2, 3"),
    "tiling_covers_extent": _with("v_grid", body="select (r // 16 * 4 + c // 16)::int as window_id, (count(distinct r) * count(distinct c))::int as size, count(*) as cells from v_grid group by 1"),
    "evenly_spaced_windows": _with(
        "v_grid", ("w", "select (r // 4 * 13 + c // 4)::int as window_id, (r // 4 * 4)::int as row_off, (c // 4 * 4)::int as col_off, count(distinct r)::int as height, count(distinct c)::int as width from v_grid group by 1, 2, 3"),
        ("s", "select greatest(count(*) // 10, 1) as step from w"), body="select w.* from w, s where window_id % step = 0 and window_id < 10 * step",
    ),
    "common_extent": _with(
        "v_box", ("e", "select max(x0)::double as \"left\", max(y0)::double as bottom, min(x1 + 50)::double as \"right\", min(y1 + 50)::double as top, min(value * 0.5)::double as res from v_box"),
        body="select *, 1::bigint as n_crs, greatest(floor((\"right\" - \"left\") / res), 0)::int as width, greatest(floor((top - bottom) / res), 0)::int as height from e",
    ),
    "regrid_nearest": _with(
        "v_grid", ("t", "select a.r, b.c from (select unnest(range(0, floor((select max(r) + 1 from v_grid) / 1.5e0)::int))::int as r) a cross join (select unnest(range(0, 33))::int as c) b"),
        body="select t.r, t.c, g.prob from t left join v_grid g on g.r = floor((t.r + 0.5e0) * 1.5e0) and g.c = floor((t.c + 0.5e0) * 1.5e0)",
    ),
    "regrid_bilinear": _with("v_grid", body=_BILINEAR),
    "central_window": _with("v_grid", ("z", "select greatest((max(r) + 1 - 32) // 2, 0) as r0 from v_grid"), body="select r - r0 as r, c - 9 as c, prob from v_grid, z where r >= r0 and r < r0 + 32 and c >= 9 and c < 41"),
    "mosaic_union": _with(
        "v_grid", ("p", "select r, c, cls1 as v, c // 25 as priority from v_grid"),
        ("t", "select case when priority = 1 then 0 else 0 end + r as r, case when priority = 1 then c else c end as c, v, priority from p union all select r, c, (v + r) % 3, 2 from p where c >= 20 and c < 30"),
        body="select r, c, max_by(v, priority) as v from t where v <> 0 group by r, c",
    ),
    "gaussian_smooth": _with("v_grid", *_SMOOTH, body="select r, c, round(v, 6) as elevation from smooth"),
    "gradient_aspect": _with("v_grid", *_ASPECT, body="select r, c, round(dy, 6) as dy, round(dx, 6) as dx, round(aspect, 6) as aspect from asp"),
    "hillshade": _with("v_grid", *_ASPECT, body=f"select r, c, round(0.3e0 + 0.7e0 * (cos(radians(round(aspect, 6)) - 5 * {PI}::double / 4) * sin({PI}::double / 4) + 1) / 2, 6) as shade from asp"),
    "dilate_disk": _with("v_grid", _CLEAR, ("w", _dilate(5)), body="select r, c, clear, dilated from w"),
    "mean_disk": _with("v_grid", ("m", _mean(7, "v_grid", "prob")), body="select m.r, m.c, v_grid.prob, m.mean from m join v_grid on v_grid.r = m.r and v_grid.c = m.c"),
    "qa_weights_flg": _with("v_grid", _CLEAR, ("w", f"select r, c, flg, dilated * 255 as b from ({_dilate(2)})"), ("m", _mean(7, "w", "b")), body="select m.r, m.c, w.flg, round(m.mean / 255e0, 6) as weight from m join w on w.r = m.r and w.c = m.c"),
    "mean_disk_20": _with("v_grid", ("m", _mean(20, "v_grid", "prob")), body="select m.r, m.c, v_grid.prob, m.mean from m join v_grid on v_grid.r = m.r and v_grid.c = m.c"),
    "qa_weights_5_25": _with("v_grid", _CLEAR, ("w", f"select r, c, flg, dilated * 255 as b from ({_dilate(5)})"), ("m", _mean(25, "w", "b")), body="select m.r, m.c, w.flg, round(m.mean / 255e0, 6) as weight from m join w on w.r = m.r and w.c = m.c"),
    "bbox_intersect_join": _with("v_box", body="select a.seq as a_seq, b.seq as b_seq from v_box a join v_box b on a.seq < b.seq and a.x0 <= b.x1 and a.x1 >= b.x0 and a.y0 <= b.y1 and a.y1 >= b.y0"),
    "rasterize_boxes": _with("v_box", body="select y.r::int as r, x.c::int as c, max_by(value, seq) as value from v_box, unnest(range(greatest(y0, 0), least(y1, 35))) y(r), unnest(range(greatest(x0, 0), least(x1, 45))) x(c) group by 1, 2"),
    "dissolve_first": _with("v_box", body="select seq % 7 as key, min_by(value, seq) as value, min(x0) as x0, max(x1) as x1, min(y0) as y0, max(y1) as y1, count(*) as parts from v_box group by 1"),
    "file_screening": _with(
        "v_box", ("o", "select seq, 100e0 * greatest(least(x1, 40e0) - greatest(x0, 5e0), 0) * greatest(least(y1, 30e0) - greatest(y0, 5e0), 0) / ((x1 - x0) * (y1 - y0)) as p, case when seq % 11 = 0 then 0 else seq % 50 end as nz from v_box"),
        body="select seq, round(p, 6) as overlap_percent, case when p <= 0 then 'outside_bounds' when nz < 0.001 then 'empty_file' else 'valid' end as status from o",
    ),
    "geojson_bbox": _with("v_box", body="select seq, 'Feature' as type, 5 as points, x1::double as x2, y1::double as y2 from v_box"),
    "elevation_default_join": _with("v_grid", body="select pixel_id, case when pixel_id % 7 <> 0 then elevation::double else 0e0 end as elevation from v_grid"),
    "period_counts": _with("v_obs", body="select (date '1970-01-01' + (date_diff('day', date '1970-01-01', obs_date) // 60 * 60)::int)::date as start, pixel_id, count(*) as n, round(avg(case when flg in (1, 2, 3) then 0e0 else 1e0 end), 6) as clear from v_obs group by 1, 2"),
}


def _lambert_steps(points: str = "select seq, 600000e0 + x0 * 5000 as x, 6300000e0 + y0 * 5000 as y from v_box") -> list[tuple[str, str]]:
    """Inverse Lambert-93, from the projection's defining constants alone."""
    m = "(cos(radians({0})) / sqrt(1 - e * e * sin(radians({0})) * sin(radians({0}))))"
    q = "ln(tan(pi() / 4 + radians({0}) / 2) * pow((1 - e * sin(radians({0}))) / (1 + e * sin(radians({0}))), e / 2))"
    steps = [
        ("ell", "select 6378137e0 as a, sqrt(2 / 298.257222101e0 - 1 / (298.257222101e0 * 298.257222101e0)) as e"),
        ("cone", f"select *, ln({m.format('44e0')} / {m.format('49e0')}) / ({q.format('49e0')} - {q.format('44e0')}) as n from ell"),
        ("big", f"select *, a * {m.format('44e0')} / n * exp(n * {q.format('44e0')}) as k from cone"),
        ("apex", f"select *, 6600000e0 + k * exp(-n * {q.format('46.5e0')}) as ys from big"),
        ("pts", f"select p.*, apex.* from ({points}) p cross join apex"),
        ("iso", "select *, 3e0 + degrees(atan((x - 700000e0) / (ys - y)) / n) as lon, -ln(sqrt((x - 700000e0) * (x - 700000e0) + (ys - y) * (ys - y)) / k) / n as l from pts"),
        ("lat0", "select *, 2 * atan(exp(l)) - pi() / 2 as phi from iso"),
    ]
    for i in range(8):
        steps.append((f"lat{i + 1}", f"select * replace (2 * atan(pow((1 + e * sin(phi)) / (1 - e * sin(phi)), e / 2) * exp(l)) - pi() / 2 as phi) from lat{i}"))
    return steps


SQL["crs_transform"] = _with("v_box", *_lambert_steps(), body="select seq, round(lon, 6) as lon, round(degrees(phi), 6) as lat, round(x, 3) as x, round(y, 3) as y from lat8")
SQL["stream_fold"] = SQL["harmonic_wls_h2"]

_TILES = ("tiles", "select tile_id, split_part(tile_id, '_', 2)::double as \"left\", split_part(tile_id, '_', 3)::double as bottom from (select distinct tile_id from files)")
_EDGES = (
    "select tile_id, \"left\" + 50000 * f / 22e0 as x, bottom + 50000 * s as y from tiles, unnest(range(0, 23)) a(f), unnest([0, 1]) b(s) "
    "union all select tile_id, \"left\" + 50000 * s, bottom + 50000 * f / 22e0 from tiles, unnest(range(0, 23)) a(f), unnest([0, 1]) b(s)"
)
SQL["tile_metadata"] = _with(
    "v_path", _FILES, _TILES, *_lambert_steps(_EDGES), ("ends", "select tile_id, min(lon) as west, min(degrees(phi)) as south, max(lon) as east, max(degrees(phi)) as north from lat8 group by tile_id"),
    body="select tile_id, 'EPSG:2154' as crs, \"left\", bottom, \"left\" + 50000 as \"right\", bottom + 50000 as top, 10e0 as res, 5000 as width, 5000 as height, round(west, 6) as west, round(south, 6) as south, round(east, 6) as east, round(north, 6) as north "
    "from tiles join ends using (tile_id)",
)
SQL["tile_containment"] = _with("v_path", _FILES, _TILES, body='select tile_id, "left" >= 200000 and "left" + 50000 <= 1000000 and bottom >= 6000000 and bottom + 50000 <= 6150000 as inside from tiles')
SQL["first_reference_file"] = _with("v_path", _FILES, body="select tile_id, min(path) as path from files group by tile_id")
SQL["screening_counts"] = f"select status, count(*) as n from ({SQL['file_screening']}) group by status"
SQL["series_guards"] = _with("v_grid", body=" union all ".join(f"select eco, '{c}' as name, false as all_null, max(abs({c})) = 0 as all_zero from v_grid group by eco" for c in ("cls1", "prob", "forest")))
SQL["joint_range"] = f"select round(min(least(amplitude_h1, amplitude_h2, \"offset\")), 6) as low, round(max(greatest(amplitude_h1, amplitude_h2, \"offset\")), 6) as high from ({SQL['harmonic_wls_h2']})"
SQL["canopy_mask"] = _with("v_grid", ("z", "select max(r) + 1 as h from v_grid"), body="select ((r - 1) // 2)::int as r, ((c - 1) // 2)::int as c, case when prob >= 100 then 1 else 0 end as forest from v_grid, z where r % 2 = 1 and c % 2 = 1 and r < h // 2 * 2")
SQL["nearest_data_window"] = _with(
    "v_grid", ("w", "select distinct (r // 4 * 13 + c // 4)::int as window_id, (r // 4 * 4)::int as row_off, (c // 4 * 4)::int as col_off, greatest(abs(r // 4 - 5), abs(c // 4 - 6))::bigint as distance from v_grid where prob = 255"),
    body="select * from w order by distance, window_id limit 1",
)
SQL["dem_build"] = (
    SQL["regrid_bilinear"].replace("1.5e0", "2.5e0").replace("range(0, 33)", "range(0, 20)").replace("g.prob", "g.elevation::double").replace("as prob\n", "as elevation\n")
)
_ZERO = ("src", "select pixel_id, t, coalesce(ndvi, 0e0) as ndvi, coalesce(evi, 0e0) as evi, coalesce(nbr, 0e0) as nbr, coalesce(crswir, 0e0) as crswir, 1e0 as w from idx")


def _encoded() -> list[tuple[str, str]]:
    out, decoded = [], []
    tau = repr(2 * 3.141592653589793)
    for y in _INDICES:
        for k in (1, 2):
            a, b = f"x_{2 * k - 2}_{y}", f"x_{2 * k - 1}_{y}"
            amplitude, angle = f"round(sqrt({a} * {a} + {b} * {b}), 9)", f"(round(atan2({b}, {a}), 9) + {PI}::double) / {tau}::double"
            out += [f"floor({_clip(amplitude, 0.0, 1.0)} * 65535)::int as {y}_amplitude_h{k}", f"floor({_clip(angle, 0.0, 1.0)} * 65535)::int as {y}_phase_h{k}"]
            decoded += [f"nullif({y}_amplitude_h{k}, 65535) / 65535e0 as {y}_amplitude_h{k}", f"cos(nullif({y}_phase_h{k}, 65535) / 65535e0 * {tau}::double - {PI}::double) as {y}_cos_phase_h{k}"]
        out.append(f"floor({_clip(f'round(x_4_{y}, 9)', 0.0, 1.0)} * 65535)::int as {y}_offset")
        decoded.append(f"nullif({y}_offset, 65535) / 65535e0 as {y}_offset")
    filled = ", ".join(f"coalesce({c}, 0e0) as {c}" for c in _WIDE_COLUMNS)
    return [
        _REFL, _IDX, _ZERO, *_fit("src", 2, _INDICES), ("encoded", f"select pixel_id, {', '.join(out)} from fit"), ("decoded", f"select pixel_id, {', '.join(decoded)}, 0e0 as elevation from encoded"),
        ("wide", f"select pixel_id, 0 as n_obs, {filled} from decoded"), _SCORED,
    ]


SQL["encoded_features"] = _with("v_obs", *_encoded(), body="select * from encoded")
SQL["classify_encoded"] = _with("v_obs", *_encoded(), body="select pixel_id, case when probability > 0.5 then 2 else 1 end as pred, floor(probability * 255)::int as proba from scored")

from . import more_oracles  # noqa: E402  it builds on the steps above

SQL |= more_oracles.SQL
