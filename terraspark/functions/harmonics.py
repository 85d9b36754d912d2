"""Weighted harmonic regression as sums and an unrolled LDL' solver: no user-defined function."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

YEAR_DAYS = 365.25


def year_fraction(date: Column, t0: Column) -> Column:
    return F.datediff(date, t0) / F.lit(YEAR_DAYS)


def basis(t: Column, harmonics: int) -> list[Column]:
    """cos and sin of each harmonic, and the constant."""
    out = []
    for k in range(1, harmonics + 1):
        w = 2 * math.pi * k
        out += [F.cos(t * F.lit(w)), F.sin(t * F.lit(w))]
    return [*out, F.lit(1.0)]


def with_basis(df: DataFrame, harmonics: int, t: str = "t") -> DataFrame:
    """Adds the basis at ``t`` as columns ``a_0`` to ``a_2H``."""
    return df.withColumns({f"a_{i}": x for i, x in enumerate(basis(F.col(t), harmonics))})


def normal_sums(n: int, w: str, ys: dict[str, str]) -> dict[str, str]:
    """SQL aggregates ``m_i_j`` = sum w a_i a_j and ``r_i_name`` = sum w a_i y over the basis columns.

    Statements rather than column objects: one call a sum, not one an operation.
    """
    out = {f"m_{i}_{j}": f"sum({w} * a_{i} * a_{j})" for i in range(n) for j in range(i + 1)}
    return out | {f"r_{i}_{name}": f"sum({w} * a_{i} * {y})" for name, y in ys.items() for i in range(n)}


def solve(df: DataFrame, n: int, names: Sequence[str], keep: Sequence[str], enough: str) -> DataFrame:
    """``x_i_name`` of the normal equations in ``df``, 0 where ``enough`` is false or a pivot vanishes.

    Each elimination step is one projection, so that a step's columns are computed once.
    The added zero counts as non-deterministic: it keeps the optimizer from copying the
    whole solver into each later filter.  Filter keys before the fit, not after.
    """
    for k in range(n):
        later = range(k + 1, n)
        pivot = f"nullif(m_{k}_{k}, 0D)"
        step = {f"d_{k}": pivot}
        step |= {f"l_{i}_{k}": f"m_{i}_{k} / {pivot}" for i in later}
        step |= {f"m_{i}_{j}": f"m_{i}_{j} - m_{i}_{k} * m_{j}_{k} / {pivot}" for i in later for j in range(k + 1, i + 1)}
        step |= {f"r_{i}_{y}": f"r_{i}_{y} - m_{i}_{k} * r_{k}_{y} / {pivot}" for y in names for i in later}
        df = df.withColumns({c: F.expr(e) for c, e in step.items()})
    for k in reversed(range(n)):
        back = {f"x_{k}_{y}": f"r_{k}_{y} / d_{k}" + "".join(f" - l_{i}_{k} * x_{i}_{y}" for i in range(k + 1, n)) for y in names}
        df = df.withColumns({c: F.expr(e) for c, e in back.items()})
    xs = [f"x_{i}_{y}" for y in names for i in range(n)]
    return df.select(*keep, *[F.expr(f"if({enough}, coalesce({x}, 0D), 0D) + spark_partition_id() * 0D as {x}") for x in xs])


def predict(n: int, name: str = "y") -> Column:
    """The fitted value from the basis columns."""
    return F.expr(" + ".join(f"a_{i} * x_{i}_{name}" for i in range(n)))


def amplitude(k: int, name: str = "y") -> Column:
    return F.hypot(f"x_{2 * k - 2}_{name}", f"x_{2 * k - 1}_{name}")


def phase(k: int, name: str = "y") -> Column:
    """atan2(sin part, cos part), in (-pi, pi]."""
    return F.atan2(F.col(f"x_{2 * k - 1}_{name}"), F.col(f"x_{2 * k - 2}_{name}"))


def offset(harmonics: int, name: str = "y") -> Column:
    return F.col(f"x_{2 * harmonics}_{name}")


def huber_weight(residual: Column, sigma: Column) -> Column:
    """1 within 1.345 sigma, falling as its inverse beyond."""
    delta = 1.345 * F.when(sigma == 0, F.lit(1e-8)).otherwise(sigma)
    return F.when(F.abs(residual) <= delta, F.lit(1.0)).otherwise(delta / (F.abs(residual) + 1e-8))


# The same fit on arrays: one row a series, one column a date.


def basis_array(t: np.ndarray, harmonics: int) -> np.ndarray:
    """The basis at each time, along a last axis."""
    parts = [f(2 * math.pi * k * t) for k in range(1, harmonics + 1) for f in (np.cos, np.sin)]
    return np.stack([*parts, np.ones_like(t)], axis=-1)


def solve_arrays(m: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Solutions of many small symmetric systems; 0 in place of what a vanishing pivot leaves undefined."""
    m, r = m.copy(), r.copy()
    n = r.shape[1]
    lower, pivots = np.zeros_like(m), np.empty_like(r)
    with np.errstate(divide="ignore", invalid="ignore"):
        for k in range(n):
            pivots[:, k] = np.where(m[:, k, k] == 0, np.nan, m[:, k, k])
            column = m[:, :, k].copy()
            lower[:, :, k] = column / pivots[:, k, None]
            r[:, k + 1 :] -= lower[:, k + 1 :, k] * r[:, k, None]
            m[:, k + 1 :, k + 1 :] -= lower[:, k + 1 :, k, None] * column[:, None, k + 1 :]
        x = np.empty_like(r)
        for k in reversed(range(n)):
            x[:, k] = r[:, k] / pivots[:, k] - (lower[:, k + 1 :, k] * x[:, k + 1 :]).sum(axis=1)
    return np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0)


def masked_variance(x: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Population variance of each row's entries where ``there`` holds."""
    n = np.maximum(there.sum(axis=1), 1)
    mean = np.where(there, x, 0).sum(axis=1) / n
    return np.where(there, (x - mean[:, None]) ** 2, 0).sum(axis=1) / n


def irls_arrays(basis: np.ndarray, y: np.ndarray, weights: np.ndarray, there: np.ndarray, iterations: int, enough: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parameters and last residuals of the re-weighted fit; parameters are 0 where ``enough`` is false."""
    for _ in range(iterations):
        weighted = basis * weights[..., None]
        x = solve_arrays(np.einsum("kti,ktj->kij", weighted, basis), np.einsum("kti,kt->ki", weighted, y))
        x[~enough] = 0.0
        residual = y - np.einsum("kti,ki->kt", basis, x)
        sigma = np.sqrt(masked_variance(residual, there))
        delta = 1.345 * np.where(sigma == 0, 1e-8, sigma)[:, None]
        size = np.abs(residual)
        weights = weights * np.where(size <= delta, 1.0, delta / (size + 1e-8))
    return x, residual
