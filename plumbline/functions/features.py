"""Explicit kernel feature maps as column expressions."""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Degree and homogeneity of the map of each kernel.
KERNEL_MAPS = {"linear": (1, True), "poly": (2, False), "homo_poly": (2, True)}


def kernel_columns(x: list[Column], kernel: str) -> list[Column]:
    """The map of a kernel by its name."""
    if kernel not in KERNEL_MAPS:
        raise ValueError(f"unknown kernel {kernel!r}; known: {sorted(KERNEL_MAPS)}")
    degree, homogeneous = KERNEL_MAPS[kernel]
    return kernel_map(x, degree, None if homogeneous else 1.0)


def monomials(d: int, degree: int, homogeneous: bool) -> list[tuple[int, ...]]:
    """Exponent vectors of total degree up to ``degree`` (exactly ``degree`` if homogeneous), by degree."""
    totals = [degree] if homogeneous else range(degree + 1)
    return [tuple(chosen.count(i) for i in range(d)) for m in totals for chosen in combinations_with_replacement(range(d), m)]


def scale(powers: tuple[int, ...], degree: int, c: float | None) -> float:
    """Square root of the multinomial weight of a monomial in ``(x.y + c)**degree``; c is None: ``(x.y)**degree``."""
    rest = degree - sum(powers)
    weight = math.factorial(degree) / math.prod(map(math.factorial, powers))
    if c is not None:
        weight *= c**rest / math.factorial(rest)
    return math.sqrt(weight)


def kernel_map(x: list[Column], degree: int = 2, c: float | None = 1.0) -> list[Column]:
    """Features whose dot product is ``(x.y + c)**degree``, or ``(x.y)**degree`` where c is None."""
    out = []
    for powers in monomials(len(x), degree, c is None):
        term = F.lit(scale(powers, degree, c))
        for v, p in zip(x, powers):
            for _ in range(p):
                term = term * v
        out.append(term)
    return out


def width(d: int, degree: int, homogeneous: bool = False) -> int:
    return math.comb(d + degree - homogeneous, degree)


def max_width(d: int, kernels: list[str]) -> int:
    """The widest mapped row over the kernels named."""
    return max((width(d, *KERNEL_MAPS[k]) for k in kernels), default=d)


def l2_normalised(x: list[Column]) -> list[Column]:
    """Divided by the row's norm; a norm below 1e-12 counts as 1."""
    norm = F.sqrt(sum((v * v for v in x[1:]), x[0] * x[0]))
    safe = F.when(norm < 1e-12, 1.0).otherwise(norm)
    return [v / safe for v in x]


def dot(x: list[Column], y: list[Column]) -> Column:
    return sum((a * b for a, b in zip(x[1:], y[1:])), x[0] * y[0])


#: Kernel names and their stored mode strings (fixed values).
MODES = {"linear": "primal:linear", "poly": "primal:poly:degree=2:c=1.0", "homo_poly": "primal:homo_poly:degree=2"}


def parsed_mode(mode: Column) -> Column:
    """struct(map, degree, c) of ``primal:<map>[:degree=..][:c=..]``; a missing parameter is 2 or 1.0, an
    unknown map gives null."""
    parts = F.split(mode, ":")
    kind = F.get(parts, F.lit(1))
    number = lambda name: F.try_element_at(F.str_to_map(mode, F.lit(":"), F.lit("=")), F.lit(name)).try_cast("double")
    return F.when(
        kind.isin("linear", "poly", "homo_poly"),
        F.struct(kind.alias("map"), F.coalesce(number("degree"), F.lit(2.0)).cast("int").alias("degree"), F.coalesce(number("c"), F.lit(1.0)).alias("c")),
    )
