"""Random-intercept linear mixed model from per-group sufficient statistics.

The data are summed once by group (X'X, X'y, y'y and sums: a distributed
aggregation); the profile likelihood in theta = var(group) / var(residual) is
then one-dimensional and needs those sums alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.operators.exact_tests import chi2_sf


def design(factors: dict[str, tuple[str, list[str]]], interactions=()) -> dict[str, Column]:
    """Treatment coding: factor -> (reference, other levels); interactions are pairs of factors."""
    out = {"Intercept": F.lit(1.0)}
    own = {f: {f"{f}[{v}]": (F.col(f) == v).cast("double") for v in levels} for f, (_, levels) in factors.items()}
    for cols in own.values():
        out |= cols
    for a, b in interactions:
        out |= {f"{m}:{n}": x * y for m, x in own[a].items() for n, y in own[b].items()}
    return out


def sufficient_statistics(df: DataFrame, group: str, y: str, columns: dict[str, Column]) -> DataFrame:
    """n, yy, sy, s0.. (column sums), v0.. (X'y), m0_0.. (X'X) of each group."""
    names = list(columns)
    d = df.where(F.col(y).isNotNull()).select(group, F.col(y).alias("y"), *[c.alias(f"x{i}") for i, c in enumerate(columns.values())])
    k = range(len(names))
    return d.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.sum("y").alias("sy"), *[F.sum(f"x{i}").alias(f"s{i}") for i in k],
        *[F.sum(F.col(f"x{i}") * F.col("y")).alias(f"v{i}") for i in k], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"m{i}_{j}") for i in k for j in k if j >= i],
    )


@dataclass
class Fit:
    names: list[str]
    coef: np.ndarray
    se: np.ndarray
    var_group: float
    var_residual: float
    llf: float
    n: int
    groups: int
    reml: bool
    rows: list = field(default_factory=list)

    @property
    def icc(self) -> float:
        return self.var_group / (self.var_group + self.var_residual)

    @property
    def aic(self) -> float:
        return 2 * (len(self.names) + 2) - 2 * self.llf

    def table(self) -> list[tuple]:
        """(name, coef, se, z, p, lower, upper)."""
        z = self.coef / self.se
        p = [2 * (1 - NormalDist().cdf(abs(v))) for v in z]
        return [(n, float(b), float(s), float(v), q, float(b - 1.96 * s), float(b + 1.96 * s)) for n, b, s, v, q in zip(self.names, self.coef, self.se, z, p)]


def fit_random_intercept(stats: DataFrame, names: list[str], reml: bool = True) -> Fit:
    """Maximise the (restricted) profile likelihood over theta by golden section on its logarithm."""
    k = len(names)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    # Groups of one size enter alike, so the driver gets the sums of each size and not a row a group.
    rows = stats.groupBy("n").agg(
        F.count(F.lit(1)).alias("groups"), F.sum("yy").alias("yy"), F.sum(F.col("sy") * F.col("sy")).alias("tt"), *[F.sum(f"v{i}").alias(f"v{i}") for i in range(k)], *[F.sum(F.col(f"s{i}") * F.col("sy")).alias(f"t{i}") for i in range(k)],
        *[F.sum(f"m{i}_{j}").alias(f"m{i}_{j}") for i, j in pairs], *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"q{i}_{j}") for i, j in pairs],
    ).sort("n").collect()
    n, groups = (np.array([r[c] for r in rows], float) for c in ("n", "groups"))
    square = lambda c: np.array([[[r[f"{c}{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)] for r in rows], float)
    vector = lambda c: np.array([[r[f"{c}{i}"] for i in range(k)] for r in rows], float)
    xx, xy, ss, sy, tt = square("m").sum(0), vector("v").sum(0), square("q"), vector("t"), np.array([r["tt"] for r in rows], float)
    yy, total = sum(r["yy"] for r in rows), float((n * groups).sum())

    def solve(theta: float):
        w = theta / (1 + theta * n)
        a = xx - np.tensordot(w, ss, 1)
        v = xy - w @ sy
        beta = np.linalg.solve(a, v)
        rss = yy - w @ tt - beta @ v
        free = total - k if reml else total
        ll = -0.5 * (free * math.log(2 * math.pi * rss / free) + groups @ np.log1p(theta * n) + free)
        if reml:
            ll -= 0.5 * np.linalg.slogdet(a)[1]
        return ll, beta, a, rss / free

    lo, hi, g = -12.0, 8.0, (math.sqrt(5) - 1) / 2
    f = lambda u: solve(math.exp(u))[0]
    a, b = hi - g * (hi - lo), lo + g * (hi - lo)
    fa, fb = f(a), f(b)
    while hi - lo > 1e-8:
        if fa > fb:
            hi, b, fb = b, a, fa
            a = hi - g * (hi - lo)
            fa = f(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + g * (hi - lo)
            fb = f(b)
    theta = math.exp((lo + hi) / 2)
    if solve(0.0)[0] >= f((lo + hi) / 2):
        theta = 0.0
    ll, beta, m, var = solve(theta)
    return Fit(names, beta, np.sqrt(np.diag(np.linalg.inv(m)) * var), theta * var, var, float(ll), int(total), int(groups.sum()), reml)


def likelihood_ratio(full: Fit, reduced: Fit) -> tuple[float, int, float]:
    """(2 * difference, degrees of freedom, p) of two maximum-likelihood fits."""
    x, df = 2 * (full.llf - reduced.llf), len(full.names) - len(reduced.names)
    return x, df, chi2_sf(x, df)
