"""Normal and Student-t functions, vectorised; Spark has no built-in for them."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STD = NormalDist()


def normal_cdf(x) -> np.ndarray:
    x = np.atleast_1d(np.asarray(x, dtype=float))
    return np.array([0.5 * math.erfc(-v / math.sqrt(2.0)) if np.isfinite(v) else (0.0 if v < 0 else 1.0) for v in x])


def normal_quantile(p: float) -> float:
    return _STD.inv_cdf(p)


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + numerator / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            h = h * step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    return h


def incomplete_beta(a, b, x) -> np.ndarray:
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    flip = x > (a + 1.0) / (a + b + 2.0)
    aa, bb, xx = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1.0 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        log_front = (
            np.vectorize(math.lgamma)(aa + bb) - np.vectorize(math.lgamma)(aa) - np.vectorize(math.lgamma)(bb)
            + aa * np.log(xx) + bb * np.log1p(-xx)
        )
        part = np.where(xx <= 0, 0.0, np.exp(log_front) * _beta_fraction(aa, bb, xx) / aa)
    return np.where(flip, 1.0 - part, part)


def student_sf(t, df) -> np.ndarray:
    """Upper tail of Student's t; NaN in gives NaN out."""
    t = np.atleast_1d(np.asarray(t, dtype=float))
    df = np.broadcast_to(np.asarray(df, dtype=float), t.shape)
    out = np.full(t.shape, np.nan)
    ok = np.isfinite(t) & np.isfinite(df) & (df > 0)
    if ok.any():
        tail = 0.5 * incomplete_beta(df[ok] / 2.0, 0.5, df[ok] / (df[ok] + t[ok] ** 2))
        out[ok] = np.where(t[ok] >= 0, tail, 1.0 - tail)
    return out


@F.pandas_udf(T.DoubleType())
def student_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(student_sf(t.astype(float).to_numpy(), df.astype(float).to_numpy()))


def _poly(coefficients, x: float) -> float:
    return float(np.polyval(list(reversed(coefficients)), x))


# Royston's published polynomials (AS R94, 1995).
SW_C1 = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
SW_C2 = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SW_C3 = (0.544, -0.39978, 0.025054, -0.0006714)
SW_C4 = (1.3822, -0.77857, 0.062767, -0.0020322)
SW_C5 = (-1.5861, -0.31082, -0.083751, 0.0038915)
SW_C6 = (-0.4803, -0.082676, 0.0030302)
SW_G = (-2.273, 0.459)


def shapiro_wilk(values: np.ndarray) -> tuple[float, float]:
    """W and p for 3 to 5000 values (Royston 1995)."""
    x = np.sort(np.asarray(values, dtype=float))
    n = x.size
    if n < 3 or x[0] == x[-1]:
        return float("nan"), float("nan")
    m = np.array([normal_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    ssq, root = float(m @ m), 1.0 / math.sqrt(n)
    a = np.zeros(n)
    if n == 3:
        a[:] = (-math.sqrt(0.5), 0.0, math.sqrt(0.5))
    else:
        last = _poly(SW_C1, root) + m[-1] / math.sqrt(ssq)
        if n > 5:
            before = _poly(SW_C2, root) + m[-2] / math.sqrt(ssq)
            phi = (ssq - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * before**2)
            a = m / math.sqrt(phi)
            a[-2], a[1] = before, -before
        else:
            phi = (ssq - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a = m / math.sqrt(phi)
        a[-1], a[0] = last, -last
    centred = x - x.mean()
    w = min(float((a @ x) ** 2 / (centred @ centred)), 1.0)
    if n == 3:
        p = 6.0 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return w, max(p, 0.0)
    if w >= 1.0:
        return w, 1.0
    y = math.log(1.0 - w)
    if n <= 11:
        gamma = _poly(SW_G, n)
        if y >= gamma:
            return w, 1e-99
        y = -math.log(gamma - y)
        mu, sigma = _poly(SW_C3, n), math.exp(_poly(SW_C4, n))
    else:
        ln = math.log(n)
        mu, sigma = _poly(SW_C5, ln), math.exp(_poly(SW_C6, ln))
    return w, float(0.5 * math.erfc((y - mu) / sigma / math.sqrt(2.0)))


# Largest n for which the distribution of the K-S distance is computed from its matrix form. Beyond it the
# series below agrees with that form to five digits and more, so nothing jumps.
MATRIX_CASES = 140


def kolmogorov_tail(d: float, n: float) -> float:
    """Two-sided p value of a Kolmogorov-Smirnov distance from ``n`` cases, at any n."""
    if not np.isfinite(d) or n <= 0:
        return float("nan")
    if d >= 1:
        return 0.0
    if n * d * d < 1e-3 or d <= 0.5 / n:
        return 1.0
    below = _kolmogorov_matrix(d, int(n)) if n <= MATRIX_CASES else _kolmogorov_series(d, float(n))
    return float(min(max(1.0 - below, 0.0), 1.0))


def _kolmogorov_matrix(d: float, n: int) -> float:
    """Exact distribution as the middle entry of a matrix power (Marsaglia, Tsang and Wang 2003)."""
    k = int(n * d) + 1
    size, rest = 2 * k - 1, int(n * d) + 1 - n * d
    step = np.subtract.outer(np.arange(size), np.arange(size)) + 1
    matrix = (step >= 0).astype(float)
    powers = rest ** np.arange(1, size + 1)
    matrix[:, 0] -= powers
    matrix[-1, :] -= powers[::-1]
    matrix[-1, 0] += max(0.0, 2 * rest - 1) ** size
    matrix /= np.array([[math.factorial(max(v, 0)) for v in row] for row in step], dtype=float)
    result, scale = np.eye(size), 0.0
    for done in range(1, n + 1):
        result = result @ matrix * (done / n)
        top = np.abs(result).max()
        result, scale = result / top, scale + math.log(top)
    return float(result[k - 1, k - 1] * math.exp(scale))


def _kolmogorov_series(d: float, n: float) -> float:
    """The limit law with three correction terms in 1/sqrt(n) (Pelz and Good 1976)."""
    z = math.sqrt(n) * d
    if z > 12:
        return 1.0
    whole = np.arange(-60, 61) ** 2 * math.pi**2
    half = (np.arange(-60, 60) + 0.5) ** 2 * math.pi**2
    e_half, e_whole = np.exp(-half / (2 * z * z)), np.exp(-whole / (2 * z * z))
    root, z2 = math.sqrt(math.pi / 2), z * z
    limit = root / z * e_half.sum()
    first = root / (6 * z**4) * ((half - z2) * e_half).sum()
    second = root / (72 * z**7) * ((6 * z2**3 + 2 * z2**2 + (2 * z2**2 - 5 * z2) * half + (1 - 2 * z2) * half**2) * e_half).sum()
    second -= root / (36 * z**3) * (whole * e_whole).sum()
    third = root / (6480 * z**10) * (
        ((5 - 30 * z2) * half**3 + (212 * z2**2 - 60 * z2) * half**2 + (135 * z2**2 - 96 * z2**3) * half - (30 * z2**3 + 90 * z2**4)) * e_half
    ).sum()
    third += root / (216 * z**6) * ((3 * z2 * whole - whole**2) * e_whole).sum()
    return float(limit + first / math.sqrt(n) + second / n + third / n**1.5)
