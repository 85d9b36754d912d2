"""Harmonic regression operators over pixel time series."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import harmonics as H
from ..functions import spectral as S
from .lineage import cut
from .stats import percentiles


def first_date(obs: DataFrame, date: str = "obs_date"):
    """The tile's first date: one value, used as a literal by every later plan."""
    return obs.agg(F.min(date)).first()[0]


def time_axis(obs: DataFrame, date: str = "obs_date", t0=None) -> DataFrame:
    t0 = first_date(obs, date) if t0 is None else t0
    return obs.withColumn("t", H.year_fraction(F.col(date), F.lit(t0)))


def wls(df: DataFrame, keys: Sequence[str], ys: Sequence[str], harmonics: int = 2, weight: Column | None = None) -> DataFrame:
    """Weighted least squares of several series that share their weights: one shuffle, one aggregate.

    ``df`` has ``t`` and the series; a row with any null series weighs nothing.
    Keys with fewer than 2H+1 weighted rows get parameters 0.
    """
    if harmonics < 1:
        raise ValueError("at least one harmonic is needed")
    n = 2 * harmonics + 1
    w = F.when(S.any_null(ys), F.lit(0.0)).otherwise(weight if weight is not None else F.lit(1.0))
    df = H.with_basis(df.withColumn("w_", w), harmonics)
    sums = H.normal_sums(n, "w_", {y: f"coalesce({y}, 0D)" for y in ys})
    sums = df.groupBy(*keys).agg(*[F.expr(e).alias(c) for c, e in sums.items()], F.count_if(F.col("w_") > 0).alias("n_obs"))
    return H.solve(sums, n, ys, [*keys, "n_obs"], f"n_obs >= {n}")


def parameters(fitted: DataFrame, keys: Sequence[str], harmonics: int, name: str = "y", extra: Sequence[str] = ()) -> DataFrame:
    """Amplitude and phase of each harmonic, and the offset."""
    out = [c.alias(f"{n}_h{k}") for k in range(1, harmonics + 1) for n, c in (("amplitude", H.amplitude(k, name)), ("phase", H.phase(k, name)))]
    return fitted.select(*keys, *out, H.offset(harmonics, name).alias("offset"), *extra)


def irls(df: DataFrame, keys: Sequence[str], y: str, harmonics: int = 2, iterations: int = 3, weight: Column | None = None) -> DataFrame:
    """Rows of ``df`` with the robust fit: ``x_i_y``, ``residual``, ``sigma``, ``w`` (last update) and ``change``.

    Each iteration solves and multiplies the weights by Huber's.  Gaps are filled by
    the series' mean at weight 0, and count for sigma.  All steps are window sums over
    the same keys, so one shuffle and one sort serve every iteration.
    """
    if harmonics < 1 or iterations < 1:
        raise ValueError("at least one harmonic and one iteration are needed")
    n = 2 * harmonics + 1
    by = Window.partitionBy(*keys)
    df = df.withColumns({
        "filled": F.coalesce(F.col(y), F.avg(y).over(by)),
        "w": F.when(F.col(y).isNull(), F.lit(0.0)).otherwise(weight if weight is not None else F.lit(1.0)),
    })
    df = df.withColumn("n_obs", F.count_if(F.col("w") > 0).over(by))
    base = [c for c in df.columns if c != "w"]
    df, a, old = H.with_basis(df, harmonics), [f"a_{i}" for i in range(n)], []
    over = "over (partition by " + ", ".join(f"`{k}`" for k in keys) + ")"
    for _ in range(iterations):
        sums = {c: F.expr(f"{e} {over}") for c, e in H.normal_sums(n, "w", {"y": "filled"}).items()}
        solved = H.solve(df.withColumns(sums), n, ["y"], [*base, "w", *a, *old], f"n_obs >= {n}")
        solved = solved.withColumn("residual", F.col("filled") - H.predict(n))
        solved = solved.withColumn("sigma", F.stddev_pop("residual").over(by))
        step = {"w": F.col("w") * H.huber_weight(F.col("residual"), F.col("sigma"))}
        if old:
            step |= {f"change_{i}": F.expr(f"abs(x_{i}_y - old_{i}) / greatest(abs(old_{i}), 1e-5D)") for i in range(n)}
        df = solved.withColumns(step).withColumns({f"old_{i}": F.col(f"x_{i}_y") for i in range(n)})
        old = [f"old_{i}" for i in range(n)]
    return df


def robust(df: DataFrame, keys: Sequence[str], ys: Sequence[str], harmonics: int = 2, iterations: int = 3, weight: Column | None = None) -> DataFrame:
    """Robust fits of several series with one row a key: ``keys, n_obs, x_i_y, variance_y``.

    The same fit as ``irls`` for each series: gaps are filled by the series' mean at
    weight 0, each iteration solves and multiplies the weights by Huber's.  One shuffle
    gathers a key's dates (as many as there are acquisitions); the kernel solves all keys
    of a batch at once.  Keys with fewer than 2H+1 weighted rows get parameters 0.
    """
    if harmonics < 1 or iterations < 1:
        raise ValueError("at least one harmonic and one iteration are needed")
    n, names = 2 * harmonics + 1, list(keys)
    w = weight if weight is not None else F.lit(1.0)
    items = F.collect_list(F.struct(F.col("t").cast("double").alias("t"), w.cast("double").alias("w"), *[F.col(y).cast("double").alias(y) for y in ys])).alias("items_")
    grouped = df.groupBy(*names).agg(items)
    columns = ["n_obs", *[f"x_{i}_{y}" for y in ys for i in range(n)], *[f"variance_{y}" for y in ys]]

    def fn(batches):
        for batch in batches:
            listed = batch.column(len(names))
            lengths = np.asarray(listed.value_lengths())
            field = lambda c: listed.flatten().field(c).to_numpy(zero_copy_only=False)
            shape = (len(lengths), int(lengths.max(initial=0)))
            there = np.arange(shape[1])[None, :] < lengths[:, None]

            def spread(values: np.ndarray, empty: float) -> np.ndarray:
                out = np.full(shape, empty)
                out[there] = values
                return out

            t, w0 = spread(field("t"), 0.0), spread(field("w"), 0.0)
            basis = H.basis_array(t, harmonics)
            results, n_obs = {}, None
            for y in ys:
                v = spread(field(y), np.nan)
                gap = np.isnan(v)
                with np.errstate(invalid="ignore", divide="ignore"):
                    mean = np.where(gap, 0, v).sum(axis=1) / (~gap).sum(axis=1)
                v = np.where(gap, mean[:, None], v)
                weights = np.where(gap, 0.0, w0)
                # As with several series in one fit, a row counts if it weighs in the last of them.
                n_obs = (weights > 0).sum(axis=1)
                x, residual = H.irls_arrays(basis, np.nan_to_num(v), weights, there, iterations, n_obs >= n)
                for i in range(n):
                    results[f"x_{i}_{y}"] = x[:, i]
                none = ~(there & ~np.isnan(v)).any(axis=1)
                results[f"variance_{y}"] = np.where(none, np.nan, H.masked_variance(residual, there))
            results["n_obs"] = n_obs
            arrays = [pa.array(results[c], pa.int64() if c == "n_obs" else pa.float64(), from_pandas=True) for c in columns]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *arrays], names=[*names, *columns])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in grouped.schema.fields[:-1]] + [f"`{c}` {'long' if c == 'n_obs' else 'double'}" for c in columns])
    return grouped.mapInArrow(fn, schema)


def collapse(fitted: DataFrame, keys: Sequence[str], n: int, extra: Sequence[Column] = ()) -> DataFrame:
    """One row a key from ``irls``; already partitioned by the keys."""
    return fitted.groupBy(*keys).agg(*[F.first(f"x_{i}_y").alias(f"x_{i}_y") for i in range(n)], F.count("*").alias("n_rows"), F.var_pop("residual").alias("residual_variance"), *extra)


def features(obs: DataFrame, harmonics: int = 2, keys: Sequence[str] = ("pixel_id",), weight: Column | None = None, max_iter: int = 1) -> DataFrame:
    """Amplitude, cosine of phase and offset of each index, wide.

    With one iteration the sums of the design are shared by all indices; with more each
    index is re-weighted by its own residuals.
    """
    fitted = wls(obs, keys, S.INDICES, harmonics, weight) if max_iter == 1 else robust(obs, keys, S.INDICES, harmonics, max_iter, weight)
    out = []
    for y in S.INDICES:
        for k in range(1, harmonics + 1):
            out += [H.amplitude(k, y).alias(f"{y}_amplitude_h{k}"), F.cos(H.phase(k, y)).alias(f"{y}_cos_phase_h{k}")]
        out.append(H.offset(harmonics, y).alias(f"{y}_offset"))
    return fitted.select(*keys, "n_obs", *out)


def reconstruct(params: DataFrame, keys: Sequence[str], t0, t1, harmonics: int, step_days: int = 7) -> DataFrame:
    """The fitted signal every ``step_days`` from the first date to the first grid point not before the last."""
    days = F.explode(F.sequence(F.lit(t0), F.date_add(F.lit(t1), step_days - 1), F.expr(f"interval {step_days} days")))
    # 2H+1 parameters a row go down to one value at each date of the grid.
    x = params.select(*keys, *[f"x_{i}_y" for i in range(2 * harmonics + 1)], days.alias("grid_date"))
    t = H.year_fraction(F.col("grid_date"), F.lit(t0))
    signal = sum((H.amplitude(k) * F.cos(t * F.lit(2 * math.pi * k) - H.phase(k)) for k in range(1, harmonics + 1)), H.offset(harmonics))
    return x.select(*keys, "grid_date", signal.alias("signal"))


def as_of_next(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, other: str) -> DataFrame:
    """Each left row with the nearest right date at or after its own: a union and one window, no range join."""
    both = left.select(*keys, F.col(at).alias("d_"), F.lit(None).cast("date").alias("n_")).unionByName(right.select(*keys, F.col(other).alias("d_"), F.col(other).alias("n_")))
    ordered = Window.partitionBy(*keys).orderBy(F.col("d_").desc(), F.col("n_").desc_nulls_last())
    found = both.withColumn("next", F.last("n_", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    return found.where(F.col("n_").isNull()).select(*keys, F.col("d_").alias(at), F.col("next").alias(other))



def irls_until(
    df: DataFrame, keys: Sequence[str], y: str, harmonics: int = 2, max_iter: int = 10, tolerance: float = 0.05, percentile: float = 0.75, group: Sequence[str] = (), weight: Column | None = None,
    callback: Callable[[int, list[tuple]], None] | None = None,
) -> DataFrame:
    """Robust fit with a stop rule for each group (window): ``keys, group, x_i_y, iterations``.

    A group stops after the first iteration whose ``percentile`` of relative parameter
    changes is below the tolerance; the first change is against the unweighted fit.
    ``callback`` gets the iteration and up to a hundred groups' values.  Each iteration
    is checkpointed in the shared folder, so plans stay small and lost executors cost nothing.
    """
    if harmonics < 1 or max_iter < 1:
        raise ValueError("at least one harmonic and one iteration are needed")
    n = 2 * harmonics + 1
    xs = [f"x_{i}_y" for i in range(n)]
    df = df.withColumn("group_", F.struct(*group) if group else F.lit(0))
    by = Window.partitionBy("group_", *keys)
    rows = df.select("group_", *keys, "t", F.coalesce(F.col(y), F.avg(y).over(by)).alias("filled"), F.when(F.col(y).isNull(), F.lit(0.0)).otherwise(weight if weight is not None else F.lit(1.0)).alias("w"))
    # Filled gaps count in the starting fit and in sigma, but weigh nothing afterwards.
    rows = cut(rows.withColumn("n_obs", F.count_if(F.col("w") > 0).over(by)))

    def fit(x: DataFrame, w: Column) -> DataFrame:
        sums = H.normal_sums(n, "w_", {"y": "coalesce(filled, 0D)"})
        sums = H.with_basis(x.withColumn("w_", w), harmonics).groupBy("group_", *keys, "n_obs").agg(*[F.expr(e).alias(c) for c, e in sums.items()])
        return H.solve(sums, n, ["y"], ["group_", *keys], f"n_obs >= {n}")

    old = cut(fit(rows, F.when(F.col("filled").isNull(), F.lit(0.0)).otherwise(F.lit(1.0))))
    done = None
    for k in range(1, max_iter + 1):
        now = cut(fit(rows, F.col("w")))
        before = old.select("group_", *keys, *[F.col(x).alias(f"old_{x}") for x in xs])
        change = F.array(*[F.abs(F.col(x) - F.col(f"old_{x}")) / F.greatest(F.abs(F.col(f"old_{x}")), F.lit(1e-5)) for x in xs])
        moved = now.join(before, ["group_", *keys]).select("group_", F.explode(change).alias("change"))
        if group:
            value = cut(moved.groupBy("group_").agg(F.percentile("change", F.lit(percentile)).alias("value")))
        else:
            # The whole table is one group: its percentile is sought by bins.
            value = df.sparkSession.range(1).select(F.lit(0).alias("group_"), F.lit(percentiles(moved, "change", [percentile])[0]).cast("double").alias("value")).where("value is not null")
        if callback:
            callback(k, [(r["group_"], r["value"]) for r in value.limit(100).collect()])
        stopped = value if k == max_iter else value.where(F.col("value") < tolerance)
        out = now.join(stopped.select("group_"), "group_", "left_semi").withColumn("iterations", F.lit(k))
        done = out if done is None else done.unionByName(out)
        going = value.join(stopped.select("group_"), "group_", "left_anti").select("group_")
        if k == max_iter or going.isEmpty():
            break
        x = rows.join(going, "group_", "left_semi").join(now, ["group_", *keys])
        x = H.with_basis(x, harmonics).withColumn("residual", F.col("filled") - H.predict(n))
        x = x.withColumn("w", F.col("w") * H.huber_weight(F.col("residual"), F.stddev_pop("residual").over(by)))
        rows, old = cut(x.select("group_", *keys, "t", "filled", "w", "n_obs")), now
    return done.select(*keys, *[F.col(f"group_.{g}").alias(g) for g in group], *xs, "iterations")
