"""Arithmetic of packed slot arrays and their level budget. It emulates layout, wrap and depth for study only and
gives no confidentiality."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def packed(v: Column, slots: int) -> Column:
    return F.concat(v, F.array_repeat(F.lit(0.0), F.lit(slots) - F.size(v)))


def rotated(v: Column, by: int, slots: int) -> Column:
    """Cyclic, to the left."""
    by %= slots
    return v if by == 0 else F.concat(F.slice(v, by + 1, slots - by), F.slice(v, 1, by))


def slotwise(f: Callable[[Column, Column], Column], a: Column, b: Column) -> Column:
    return F.zip_with(a, b, f)


def sum_slots(v: Column, n: int, slots: int) -> Column:
    """Doubling sum over the next power of two from n; slot 0 holds the sum of a zero-padded vector."""
    step = 1
    while step < n:
        v, step = slotwise(lambda x, y: x + y, v, rotated(v, step, slots)), 2 * step
    return v


def replicate_first(v: Column, active: int, slots: int) -> Column:
    """Slot 0 (the others are zero) in the first power of two of slots from ``active``."""
    step = 1
    while step < active:
        v, step = slotwise(lambda x, y: x + y, v, rotated(v, -step, slots)), 2 * step
    return v


def chebyshev(f: Callable[[float], float], low: float, high: float, degree: int) -> list[float]:
    """Coefficients of the interpolant at the Chebyshev nodes of [low, high]; the first one is already halved."""
    n = degree + 1
    theta = (np.arange(n) + 0.5) * math.pi / n
    values = np.array([f(0.5 * (high - low) * math.cos(t) + 0.5 * (high + low)) for t in theta])
    c = [2 / n * float((values * np.cos(k * theta)).sum()) for k in range(n)]
    return [c[0] / 2, *c[1:]]


def clenshaw(x: Column, coefficients: list[float], low: float, high: float) -> Column:
    t = (2 * x - (low + high)) / (high - low)
    b1, b2 = F.lit(0.0), F.lit(0.0)
    for c in reversed(coefficients[1:]):
        b1, b2 = 2 * t * b1 - b2 + c, b1
    return t * b1 - b2 + coefficients[0]


def polynomial_depth(degree: Column) -> Column:
    return 2 * F.ceil(F.log2(degree + 1))


def solver_depth(m: Column, n: Column, d_sqrt: Column, d_inv: Column, d_back: Column, safety: Column) -> Column:
    """Level estimate of a Householder solve, at least 30."""
    raw = F.least(m, n) * (polynomial_depth(d_sqrt) + polynomial_depth(d_inv) + 1) + n * (polynomial_depth(d_back) + 1) + 8
    return F.greatest(F.ceil(raw * safety), F.lit(30)).cast("long")


def ring_dimension(depth: Column) -> Column:
    """Smallest power of two from twice the modulus bits 60 + 50 * depth, at least 1024."""
    return F.greatest(F.lit(1024), F.pow(F.lit(2.0), F.ceil(F.log2(2.0 * (60 + 50 * depth)))).cast("long"))


def context_depth(estimate: Column, security: Column) -> Column:
    """Levels of a context: six beyond the estimate, or the fixed usable budget of the "128" level."""
    return F.when(security == "128", F.lit(25).cast("long")).otherwise(estimate + 6)


def slot_count(depth: Column, security: Column) -> Column:
    """Half the ring, or 32 slots at the "128" level."""
    return F.when(security == "128", F.lit(32).cast("long")).otherwise(F.floor(ring_dimension(depth) / 2))


def modulus_bits(depth: Column) -> Column:
    return 60 + 50 * depth


def refreshed(level: Column, least: int, fresh: int) -> Column:
    """Levels used after a refresh of the values at ``least`` or beyond; the others stay."""
    return F.when(level >= least, F.lit(fresh)).otherwise(level)


def depth_report(level: Column, budget: Column) -> dict[str, Column]:
    """Consumed and remaining levels, the share in percent, and it as a bar of twenty places."""
    share = F.least(F.greatest(level / budget, F.lit(0.0)), F.lit(1.0))
    full = F.floor(20 * share).cast("int")
    return {"consumed": level, "remaining": budget - level, "percent": F.round(100.0 * level / budget, 1), "bar": F.concat(F.repeat(F.lit("#"), full), F.repeat(F.lit("."), 20 - full))}


def rotation_keys(matrix_size: int, n_test: int, feature_dim: int) -> Column:
    """Sorted distinct rotations a solve and its scoring need."""
    powers = lambda n: [2**i for i in range(max(n, 1).bit_length()) if 2**i < n]
    parts = [F.sequence(F.lit(1), F.lit(matrix_size - 1)), F.sequence(F.lit(-1), F.lit(1 - max(matrix_size, n_test)))]
    near = [p for q in powers(matrix_size) for p in (q, -q)] + (powers(feature_dim) if feature_dim > matrix_size else [])
    return F.array_sort(F.array_distinct(F.concat(*parts, F.array(*[F.lit(v) for v in near]))))


def primal_bounds(n: Column, gamma: Column, margin: float = 1.1) -> dict[str, Column]:
    """Data-independent domains of the augmented primal solve for features of unit variance or norm: squared
    column norms, their reflections, and the negative diagonal (low and high of each). A gamma that is not positive
    or fewer than one row raise."""
    bad = F.raise_error(F.lit("gamma must be positive and n at least 1")).cast("double")
    gamma = F.when((gamma > 0) & (n >= 1), gamma).otherwise(bad)
    least = 1 / (2 * gamma + 2 * F.sqrt(gamma / n) + 1 / n)
    low, high = least / margin, (n + 1 / gamma) * margin
    return {"sqrt_low": low, "sqrt_high": high, "vtv_high": 4 * high, "diag_low": -F.sqrt(high), "diag_high": -F.sqrt(low)}
