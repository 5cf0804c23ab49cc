"""Permutation and bootstrap tests whose work does not grow with the rows: they draw from the law of what they need.

A shuffle of labels changes a table of two labels only through its cells, which have fixed margins: rounds draw the
cells row by row, from multivariate hypergeometric laws.  The median of a resample is one or two of its ordered
values: rounds draw their places from the law of order statistics, and the data give the values at those places.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.operators.ranks import same, value_places

#: Ranges of places that a group's values are dealt to for the look-up.
STRETCHES = 4096


def random_tables(rows: np.ndarray, columns: np.ndarray, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """(rounds, rows, columns) tables with the given margins, as random matchings of the labels give them."""
    left = np.tile(columns.astype(np.int64), (rounds, 1))
    out = np.empty((rounds, len(rows), len(columns)), np.int64)
    for i, size in enumerate(rows):
        need = np.full(rounds, size, np.int64)
        rest = left.sum(1)
        for j in range(len(columns)):
            rest = rest - left[:, j]
            out[:, i, j] = drawn = rng.hypergeometric(left[:, j], rest, need)
            left[:, j] -= drawn
            need -= drawn
    return out


def chi_square(tables: np.ndarray) -> np.ndarray:
    """Pearson's statistic of each table; margins are those of the first."""
    expected = tables[0].sum(1)[:, None] * tables[0].sum(0)[None] / tables[0].sum()
    return ((tables - expected) ** 2 / expected).sum((1, 2))


def permutation_from_margins(df: DataFrame, a: str, b: str, rounds: int = 10_000, seed: int = 42, batch: int = 500) -> DataFrame:
    """observed chi-square of two labels, p (share of label shuffles that reach it) and rounds.

    One aggregation counts the cells, of which there must be few (a report's table); the rounds run in batches with a
    seed each, spread over tasks.  Rows with a missing label are left out; fewer than two labels on a side give p = 1.
    A table may have up to 10**9 rows, the most that the draws of numpy take.
    """
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    one = cells.agg(F.collect_list(F.struct("a", "b", "n")).alias("cells"))
    runs = df.sparkSession.range(-(-rounds // batch)).crossJoin(F.broadcast(one))  # one row

    def run(frames):
        import pandas as pd

        for p in frames:
            out = []
            for i, found in zip(p["id"], p["cells"]):
                found = [tuple(c.values()) if isinstance(c, dict) else tuple(c) for c in found]
                if not found:
                    continue
                la, lb = (sorted({c[k] for c in found}) for k in (0, 1))
                table = np.zeros((1, len(la), len(lb)), np.int64)
                for x, y, n in found:
                    table[0, la.index(x), lb.index(y)] = n
                observed = chi_square(table)[0]
                n = min(batch, rounds - int(i) * batch)
                drawn = random_tables(table[0].sum(1), table[0].sum(0), n, np.random.default_rng([seed, int(i)]))
                out.append((observed, int((chi_square(drawn) >= observed - 1e-9).sum()), n))
            yield pd.DataFrame(out, columns=["observed", "hits", "n"])

    got = runs.mapInPandas(run, "observed double, hits long, n long")
    return got.groupBy("observed").agg((F.sum("hits") / F.sum("n")).alias("p"), F.sum("n").alias("rounds"))


def middle_places(n: int, rounds: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Places 1 to n, in the data's order, of the middle one or two of n draws with replacement.

    The k-th of n ordered uniform draws has the law Beta(k, n - k + 1), the next one lies above it as the least of
    n - k draws does; a uniform u is the place ceil(n u).
    """
    k = (n + 1) // 2
    u = rng.beta(k, n - k + 1, rounds)
    v = u if n % 2 else u + (1 - u) * (1 - rng.random(rounds) ** (1 / (n - k)))
    return tuple(np.clip(np.ceil(n * x), 1, n).astype(np.int64) for x in (u, v))


def bootstrap_median_places(df: DataFrame, x: str, keys=(), rounds: int = 2000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """keys, n, median, lo, hi: the percentile interval of the median over resamples, of groups of any size.

    The data are counted by value once; `rounds` draws a group are looked up by places.  A group without values has no row.
    """
    keys = list(keys)
    places = value_places(df.select(*keys, F.col(x).cast("double").alias("__x")), "__x", keys)
    sizes = places.groupBy(*keys).agg(F.max("__n").alias("__n")).where("__n > 0")
    fields = ", ".join([*(f"`{k}` {sizes.schema[k].dataType.simpleString()}" for k in keys), "__n long, round int, place long, half double"])

    def draw(frames):
        import pandas as pd

        for p in frames:
            for row in p.itertuples(index=False, name=None):
                n = int(row[-1])
                one, two = middle_places(n, rounds, np.random.default_rng([seed, n]))
                own = pd.DataFrame({"__n": n, "round": np.tile(np.arange(rounds, dtype=np.int32), 2), "place": np.r_[one, two], "half": 0.5})
                # Round -1 is the data's own median.
                mid = pd.DataFrame({"__n": n, "round": np.int32(-1), "place": [(n + 1) // 2, n // 2 + 1], "half": 0.5})
                own = pd.concat([own, mid], ignore_index=True)
                for i, k in enumerate(keys):
                    own.insert(i, k, row[i])
                yield own

    m = at_places(sizes.mapInPandas(draw, fields), places, keys)
    real = F.when(F.col("round") >= 0, F.col("m"))
    return m.groupBy(*keys, "n").agg(F.max(F.when(F.col("round") < 0, F.col("m"))).alias("median"), F.percentile(real, (1 - level) / 2).alias("lo"), F.percentile(real, (1 + level) / 2).alias("hi"))


def at_places(drawn: DataFrame, places: DataFrame, keys) -> DataFrame:
    """keys, n, round, m: sums of half * value over the rows of drawn (keys, __n, round, place from 1, half), from value_places() of __x."""
    wide = F.ceil(F.col("__n") / STRETCHES)
    drawn = drawn.withColumn("__s", F.floor((F.col("place") - 1) / wide))
    held = places.withColumn("__s", F.explode(F.sequence(F.floor(F.col("__lo") / wide), F.floor((F.col("__lo") + F.col("n") - 1) / wide))))
    inside = same("d", "p", [*keys, "__s"]) & (F.col("d.place") > F.col("p.__lo")) & (F.col("d.place") <= F.col("p.__lo") + F.col("p.n"))
    j = drawn.alias("d").join(held.alias("p"), inside).select(*[F.col(f"d.{k}") for k in keys], F.col("d.__n").alias("n"), "round", (F.col("half") * F.col("p.__x")).alias("v"))
    return j.groupBy(*keys, "n", "round").agg(F.sum("v").alias("m"))


def place_law(n: int) -> np.ndarray:
    """P(place <= m) for m = 0 to n of the lower middle of n draws: at least k of them at or below m."""
    k = (n + 1) // 2
    return np.array([sum(math.comb(n, i) * (m / n) ** i * (1 - m / n) ** (n - i) for i in range(k, n + 1)) for m in range(n + 1)])
