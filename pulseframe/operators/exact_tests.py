"""Distributions and exact tests on small samples, in plain Python and numpy."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

N = NormalDist()


def mann_whitney_counts(n1: int, n2: int) -> np.ndarray:
    """Arrangements for each value of U without ties: the Gaussian binomial, by integer polynomial products."""
    c = [0] * (n1 * n2 + 1)
    c[0] = 1
    for i in range(1, n1 + 1):
        for j in range(len(c) - 1, n2 + i - 1, -1):
            c[j] -= c[j - n2 - i]
        for j in range(i, len(c)):
            c[j] += c[j - i]
    return np.array([float(x) for x in c])


def mann_whitney_p(u: float, n1: int, n2: int, ties: float = 0.0) -> float:
    """Two-sided p: exact for at most 8 in the smaller group and no ties, else normal with tie and continuity correction."""
    if min(n1, n2) <= 8 and ties == 0:
        c = mann_whitney_counts(n1, n2)
        top = max(u, n1 * n2 - u)
        return float(min(1.0, 2 * c[int(math.ceil(top)) :].sum() / c.sum()))
    n = n1 + n2
    s = math.sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1))))
    return min(1.0, 2 * (1 - N.cdf(max(abs(u - n1 * n2 / 2) - 0.5, 0) / s))) if s > 0 else 1.0


def wilcoxon_p(w: float, n: int, ties: float = 0.0, zeros: int = 0) -> float:
    """Two-sided p of W = min(W+, W-): exact for n up to 50 without ties and zeros, else normal."""
    if n <= 50 and ties == 0 and zeros == 0:
        c = np.zeros(n * (n + 1) // 2 + 1)
        c[0] = 1
        for i in range(1, n + 1):
            c[i:] = c[i:] + c[: len(c) - i]
        return float(min(1.0, 2 * c[: int(math.floor(w)) + 1].sum() / c.sum()))
    s = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    return min(1.0, 2 * N.cdf((w - n * (n + 1) / 4) / s)) if s > 0 else 1.0


def fisher_exact(a: int, b: int, c: int, d: int) -> tuple[float, float]:
    """(odds ratio, two-sided p) of a 2 x 2 table."""
    n1, n2, k = a + b, c + d, a + c
    log = lambda n, r: math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)
    p = {x: math.exp(log(n1, x) + log(n2, k - x) - log(n1 + n2, k)) for x in range(max(0, k - n2), min(k, n1) + 1)}
    odds = a * d / (b * c) if b * c else (math.inf if a * d else math.nan)
    return odds, min(1.0, sum(v for v in p.values() if v <= p[a] * (1 + 1e-7)))


def mann_whitney_power(r: float, n1: int, n2: int, alpha: float = 0.05) -> float:
    """Power for a rank-biserial effect: under it U moves by r n1 n2 / 2, in units of its null deviation."""
    shift = abs(r) / 2 * math.sqrt(12 * n1 * n2 / (n1 + n2 + 1))
    z = N.inv_cdf(1 - alpha / 2)
    return N.cdf(shift - z) + N.cdf(-shift - z)


def sample_size(r: float, power: float = 0.8, alpha: float = 0.05, most: int = 199) -> int | None:
    """Least equal group size that reaches the power."""
    return next((n for n in range(3, most + 1) if mann_whitney_power(r, n, n, alpha) >= power), None)


def shapiro_wilk(x) -> tuple[float, float]:
    """(W, p) by Royston's approximation (AS R94), n from 3 on."""
    x = np.sort(np.asarray(x, float))
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        return math.nan, math.nan
    m = np.array([N.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    total = float(m @ m)
    u = 1 / math.sqrt(n)
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0, math.sqrt(0.5)])
    else:
        # Royston's polynomials.
        last = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, m[-1] / math.sqrt(total)], u)
        if n > 5:
            second = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, m[-2] / math.sqrt(total)], u)
            phi = (total - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a = m / math.sqrt(phi)
            a[[0, 1, -2, -1]] = -last, -second, second, last
        else:
            phi = (total - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a = m / math.sqrt(phi)
            a[[0, -1]] = -last, last
    w = float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum())
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(min(w, 1))) - math.asin(math.sqrt(0.75))))
    y = math.log(max(1 - w, 1e-300))
    if n <= 11:
        g = -2.273 + 0.459 * n
        if y >= g:
            return w, 1e-99
        y = -math.log(g - y)
        mean, sd = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        v = math.log(n)
        mean, sd = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], v), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], v))
    return w, 1 - N.cdf((y - mean) / sd)


def chi2_sf(x: float, df: int) -> float:
    """Upper tail of the chi-square distribution (series or continued fraction of the incomplete gamma)."""
    if x <= 0:
        return 1.0
    s, z = df / 2, x / 2
    if z < s + 1:
        term = total = 1 / s
        for k in range(1, 1000):
            term *= z / (s + k)
            total += term
            if term < total * 1e-15:
                break
        return 1 - total * math.exp(-z + s * math.log(z) - math.lgamma(s))
    b, c = z + 1 - s, 1e300
    d = 1 / b
    h = d
    for k in range(1, 1000):
        an = -k * (k - s)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(-z + s * math.log(z) - math.lgamma(s))
