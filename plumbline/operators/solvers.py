"""Dense client solvers that are not sums: Householder QR, conjugate gradients, GCV. One client's rows at a time,
bounded by the client cap."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kkt(phi: np.ndarray, y: np.ndarray, gamma: float) -> tuple[np.ndarray, np.ndarray]:
    """[[0, 1'], [1, Omega + I/gamma]] and [0; y] with Omega_ij = y_i K_ij y_j."""
    if gamma <= 0:
        raise ValueError("gamma must be positive")
    n = len(y)
    h = np.ones((n + 1, n + 1))
    h[0, 0] = 0.0
    signed = phi * y[:, None]
    h[1:, 1:] = signed @ signed.T + np.eye(n) / gamma
    return h, np.concatenate([[0.0], y])


def householder_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Reflections v = x + sign(x0)|x| e0, sign(0) = +1; zero columns are left."""
    r = np.array(a, float)
    q = np.eye(len(r))
    for k in range(min(len(r) - 1, r.shape[1])):
        v = r[k:, k].copy()
        size = np.linalg.norm(v)
        if size == 0:
            continue
        v[0] += np.copysign(size, v[0]) if v[0] else size
        v /= np.linalg.norm(v)
        r[k:] -= 2 * np.outer(v, v @ r[k:])
        q[:, k:] -= 2 * np.outer(q[:, k:] @ v, v)
    return q, r


def back_substituted(r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A pivot below 1e-10 gives a zero entry."""
    x = np.zeros(r.shape[1])
    for i in range(r.shape[1] - 1, -1, -1):
        x[i] = (c[i] - r[i, i + 1 :] @ x[i + 1 :]) / r[i, i] if abs(r[i, i]) >= 1e-10 else 0.0
    return x


def conjugate_gradients(a: np.ndarray, b: np.ndarray, steps: int) -> np.ndarray:
    """Jacobi-preconditioned; a diagonal below 1e-12 counts as 1; stops when the residual vanishes."""
    diagonal = np.diag(a).copy()
    scale = 1 / np.sqrt(np.where(diagonal < 1e-12, 1.0, diagonal))
    a, b = a * scale[:, None] * scale[None, :], b * scale
    x, r = np.zeros_like(b), b.copy()
    p, rr = r.copy(), r @ r
    for _ in range(steps):
        ap = a @ p
        if rr < 1e-28 or (curve := p @ ap) <= 0:
            break
        step = rr / curve
        x, r = x + step * p, r - step * ap
        rr, old = r @ r, rr
        p = r + rr / old * p
    return x * scale


def solve_qr(phi: np.ndarray, y: np.ndarray, gamma: float) -> tuple[float, np.ndarray]:
    h, rhs = kkt(phi, y, gamma)
    q, r = householder_qr(h)
    x = back_substituted(r, q.T @ rhs)
    return float(x[0]), phi.T @ (x[1:] * y)


def solve_cg(phi: np.ndarray, y: np.ndarray, gamma: float, steps: int | None = None) -> tuple[float, np.ndarray]:
    """By the Schur complement: K u = y, K v = 1, b = sum u / sum v, alpha = u - b v."""
    h, _ = kkt(phi, y, gamma)
    k, steps = h[1:, 1:], steps or 2 * len(y)
    u, v = conjugate_gradients(k, y, steps), conjugate_gradients(k, np.ones(len(y)), steps)
    b = float(u.sum() / v.sum())
    return b, phi.T @ ((u - b * v) * y)


def client_models(df: DataFrame, keys: list[str], phi: list[str], gamma: float, backend: str) -> DataFrame:
    """One (b, w) a group by ``backend`` ('qr' or 'cg'), with the condition number of its system."""
    solve = {"qr": solve_qr, "cg": solve_cg}[backend]
    d = len(phi)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = rows[phi].to_numpy(float), rows["y"].to_numpy(float)
        b, w = solve(x, y, gamma)
        return pd.DataFrame([[*rows[keys].iloc[0], len(rows), b, *w, np.linalg.cond(kkt(x, y, gamma)[0])]], columns=[*keys, "n", "b", *[f"w{i}" for i in range(d)], "cond"])

    schema = ", ".join([*(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys), "n long", "b double", *(f"w{i} double" for i in range(d)), "cond double"])
    return df.select(*keys, *phi, "y").groupBy(*keys).applyInPandas(one, schema)


def gcv(gamma: float, eigen: np.ndarray, projected: np.ndarray, yy: float, n: int) -> float:
    """Generalised cross-validation of ridge shrinkage e / (e + 1/gamma); ``projected`` = (U'Phi'y)**2 / e."""
    share = eigen / (eigen + 1 / gamma)
    rss = yy - float((projected * (2 * share - share**2)).sum())
    left = (1 - float(share.sum()) / n) ** 2
    return rss / n / left if left > 1e-12 else 1e12


def best_gamma(moment_row: dict, d: int, yy: float, bounds: tuple[float, float] = (1e-6, 1e3)) -> tuple[float, float]:
    """Minimises GCV from the moments G, p, n alone, by golden sections on the logarithm after a grid."""
    g = np.array([[moment_row[f"g{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(g)
    keep = e > 1e-10 * e.max()
    e, u = e[keep], u[:, keep]
    projected = (u.T @ np.array([moment_row[f"p{i}"] for i in range(d)])) ** 2 / e
    f = lambda t: gcv(float(np.exp(t)), e, projected, yy, moment_row["n"])
    grid = np.linspace(*np.log(bounds), 121)
    at = int(np.argmin([f(t) for t in grid]))
    low, high = grid[max(at - 1, 0)], grid[min(at + 1, 120)]
    ratio = (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if f(a) <= f(b) else (a, high)
    t = (low + high) / 2
    return float(np.exp(t)), f(t)


def gcv_curve(moment_row: dict, d: int, yy: float, gammas: list[float]) -> list[float]:
    """GCV at each gamma, from the moments alone."""
    g = np.array([[moment_row[f"g{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(g)
    keep = e > 1e-10 * e.max()
    e, u = e[keep], u[:, keep]
    projected = (u.T @ np.array([moment_row[f"p{i}"] for i in range(d)])) ** 2 / e
    return [gcv(t, e, projected, yy, moment_row["n"]) for t in gammas]


def qr_residuals(a: np.ndarray, q: np.ndarray, r: np.ndarray) -> dict[str, float]:
    """|A - QR| / |A|, |Q'Q - I| and the largest entry of R below its diagonal."""
    return {"reconstruction": float(np.linalg.norm(a - q @ r) / max(np.linalg.norm(a), 1e-300)), "orthogonality": float(np.linalg.norm(q.T @ q - np.eye(q.shape[1]))), "below": float(np.abs(np.tril(r, -1)).max(initial=0.0))}


def diagonal_bounds(r: np.ndarray, margin: float = 0.1, least: float = 1e-15) -> tuple[float, float]:
    """Low and high of the pivots, a margin wider, on their side of zero."""
    d = np.diag(r)
    low, high = float(d.min()), float(d.max())
    low = low * (1 + margin) if low < 0 else max(low * (1 - margin), least)
    high = min(high * (1 - margin), -least) if high < 0 else high * (1 + margin)
    return low, high


def pair_products(df: DataFrame, key: str, x: list[str]) -> DataFrame:
    """Dot products of all pairs of a table that is small by contract (a kernel matrix has that many cells)."""
    a = df.select(F.col(key).alias("i"), *[F.col(c).alias(f"a_{c}") for c in x])
    b = df.select(F.col(key).alias("j"), *[F.col(c).alias(f"b_{c}") for c in x])
    product = F.lit(0.0)
    for c in x:
        product = product + F.col(f"a_{c}") * F.col(f"b_{c}")
    return a.join(b, F.lit(True)).select("i", "j", product.alias("k"))
