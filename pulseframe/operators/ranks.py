"""Exact ranks and quantiles of tables whose keys may not split them at all.

A table of at most FULL rows is ranked in windows of its keys.  Beyond that its values are cut into ranges of at most
about FULL rows: splitters come from approximate percentiles of all rows (mergeable summaries, no shuffle), and ranges
that are still too full, because values crowd there, are cut again by percentiles of their own, until each is small
or holds one value.  Values are counted before anything else, so a range's task has at most as many rows as the range
has distinct values; places before a range are sums over ranges.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one task may hold and sort; splitters of one cut, and the summaries' accuracy for each.
FULL, CUTS, ACCURACY = 1_000_000, 64, 100
_COARSE = 64


def cut_points(df: DataFrame, x: str, full: int | None = None) -> list[float]:
    """Splitters of x, ascending, so that ranges between them have about `full` rows or one value; none for a table below it."""
    full = FULL if full is None else full
    fractions = [k / CUTS for k in range(1, CUTS)]
    v = df.where(F.col(x).isNotNull()).select(F.col(x).cast("double").alias("v"))
    one = v.agg(F.count("v").alias("n"), F.percentile_approx("v", fractions, ACCURACY * CUTS).alias("cuts")).first()
    if one["n"] <= full:
        return []
    cuts = sorted(_around(one["cuts"]))
    largest = one["n"] * (1 / CUTS + 2 / (ACCURACY * CUTS))
    while largest > full:
        per = with_range(v, "v", cuts).groupBy("__r").agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.percentile_approx("v", fractions, ACCURACY * CUTS).alias("cuts"))
        crowded = [r for r in per.where((F.col("n") > full) & (F.col("lo") < F.col("hi"))).collect()]  # at most rows / full
        fresh = {c for r in crowded for c in _around([*r["cuts"], r["hi"]]) if r["lo"] < c <= r["hi"]} - set(cuts)
        if not fresh:
            break
        cuts = sorted(set(cuts) | fresh)
        largest = max(r["n"] for r in crowded)
    return cuts


def _around(found: list[float]) -> set[float]:
    """Splitters; a value that was found twice is frequent and is also cut off from all above it."""
    return {*found, *(math.nextafter(a, math.inf) for a, b in zip(found, found[1:]) if a == b)}


def with_range(df: DataFrame, x: str, cuts: list[float]) -> DataFrame:
    """df with __r: the number of splitters at or below x, found among every _COARSE-th one and then between two of these."""
    if not cuts:
        return df.withColumn("__r", F.lit(0))
    table = df.sparkSession.createDataFrame([(cuts, cuts[_COARSE - 1 :: _COARSE])], "__cuts array<double>, __coarse array<double>")
    d = df.crossJoin(F.broadcast(table))  # one row
    v = F.col(x).cast("double")
    among = lambda a: F.size(F.filter(a, lambda c: c <= v))
    d = d.withColumn("__c", among(F.col("__coarse")) * _COARSE)
    return d.withColumn("__r", F.col("__c") + among(F.slice("__cuts", F.col("__c") + 1, F.lit(_COARSE)))).drop("__cuts", "__coarse", "__c")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys over all shuffle partitions, for groups that cost more time than bytes (by which partitions would be joined)."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def steady_mean(x: str) -> Column:
    """avg(x) added in ascending order: the same to the last bit in each evaluation, whatever order a shuffle delivers its blocks in.

    A group's values are held together, as a median holds them.  For means that are matched, compared or ranked after being read twice.
    """
    v = F.array_sort(F.collect_list(F.col(x).cast("double")))
    return F.try_divide(F.aggregate(v, F.lit(0.0), lambda a, b: a + b), F.count(x))


def same(left: str, right: str, keys) -> Column:
    """Equality of keys, nulls among them."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


def value_places(df: DataFrame, x: str, keys=(), cuts: list[float] | None = None, **also: Column) -> DataFrame:
    """keys, x, n (rows with the value), `also` (aggregates of them), __lo (rows before it) and __n (rows of the keys)."""
    keys = list(keys)
    cuts = cut_points(df, x) if cuts is None else cuts
    c = with_range(df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count(F.lit(1)).alias("n"), *[a.alias(c) for c, a in also.items()]), x, cuts)
    inside = Window.partitionBy(*keys, "__r").orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("__lo", F.sum("n").over(inside) - F.col("n"))
    if not cuts:
        return c.withColumn("__n", F.sum("n").over(Window.partitionBy(*keys))).drop("__r")
    per = c.groupBy(*keys, "__r").agg(F.sum("n").alias("__m"))  # one row a range
    ordered = Window.partitionBy(*keys).orderBy("__r").rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumn("__before", F.sum("__m").over(ordered) - F.col("__m")).withColumn("__n", F.sum("__m").over(Window.partitionBy(*keys)))
    j = c.alias("c").join(per.alias("p"), same("c", "p", [*keys, "__r"]))
    return j.select(*[F.col(f"c.{k}") for k in keys], F.col(f"c.{x}"), "n", *also, (F.col("__lo") + F.col("__before")).alias("__lo"), "__n")


def value_ranks(df: DataFrame, x: str, keys=(), **also: Column) -> DataFrame:
    """keys, x, n (rows with the value), `also` (aggregates of them) and rank (their mean rank).

    What is wanted of a value's rows is aggregated here rather than joined on by value: a mean that is worked out again may differ in its last bit.
    """
    return value_places(df, x, keys, **also).select(*keys, x, "n", *also, (F.col("__lo") + (F.col("n") + 1) / 2.0).alias("rank"))


def row_ranks(df: DataFrame, x: str, keys, name: str = "rank", largest: int | None = None) -> DataFrame:
    """df with the mean rank of x in its keys, null where x is; largest: a bound on the rows of a key, if known."""
    keys = list(keys)
    n = df.count() if largest is None else largest
    if n <= FULL:
        w = Window.partitionBy(*keys)
        rank = F.rank().over(w.orderBy(F.col(x).asc_nulls_last())) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, x)) - 1) / 2.0
        return df.withColumn(name, F.when(F.col(x).isNotNull(), rank))
    r = value_ranks(df, x, keys).withColumnRenamed("rank", name)
    j = df.alias("d").join(r.alias("r"), same("d", "r", [*keys, x]), "left")
    return j.select(*[F.col(f"d.{c}") for c in df.columns if c != name], F.col(f"r.{name}"))


def quantiles(df: DataFrame, x: str, qs: dict[str, float], keys=()) -> DataFrame:
    """Exact, linearly interpolated quantiles: one row a key.  Each lies at, or between, two places in the order.

    In tables beyond FULL, approximate percentiles (of a known largest error in rank) bracket both places; rows outside the brackets
    are counted up to them, so that only about a thousandth of a key's rows a quantile, or all of a key of at most 50,000, are counted by value.
    """
    keys = list(keys)
    if df.where(F.col(x).isNotNull()).count() <= FULL:
        return df.where(F.col(x).isNotNull()).groupBy(*keys).agg(*[F.percentile(x, q).alias(name) for name, q in qs.items()])
    v = _bracketed(df, x, list(qs.values()), keys)
    inside = lambda place: (F.col("__lo") <= place) & (place < F.col("__lo") + F.col("n"))
    at = {name: q * (F.col("__n") - 1) for name, q in qs.items()}
    two = [F.max(F.when(inside(f(p)), F.col(x).cast("double"))).alias(f"__{name}{k}") for name, p in at.items() for k, f in enumerate((F.floor, F.ceil))]
    a = v.groupBy(*keys).agg(F.max("__n").alias("__n"), *two)
    part = {name: q * (F.col("__n") - 1) - F.floor(q * (F.col("__n") - 1)) for name, q in qs.items()}
    return a.select(*keys, *[(F.col(f"__{name}0") + part[name] * (F.col(f"__{name}1") - F.col(f"__{name}0"))).alias(name) for name in qs])


#: Accuracy of the percentiles that bracket a quantile (largest error in rank: rows / NEAR), and the brackets' slack in such errors.
NEAR, SLACK = 10_000, 5


def _bracketed(df: DataFrame, x: str, qs: list[float], keys: list[str]) -> DataFrame:
    """value_places() of the values around the quantiles of each key."""
    d = df.where(F.col(x).isNotNull()).select(*keys, F.col(x).cast("double").alias(x))
    ends = [min(max(q + s * SLACK / NEAR, 0.0), 1.0) for q in qs for s in (-1, 1)]
    a = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.percentile_approx(x, ends, NEAR).alias("__e"))
    # A small key is bracketed whole, and so are both ends of the order.
    small = F.col("__n") <= SLACK * NEAR
    low = [F.when(small | F.lit(p <= 0), F.lit(-math.inf)).otherwise(F.col("__e")[2 * i]) for i, p in enumerate(ends[::2])]
    high = [F.when(small | F.lit(p >= 1), F.lit(math.nan)).otherwise(F.col("__e")[2 * i + 1]) for i, p in enumerate(ends[1::2])]  # NaN is the greatest
    a = a.select(*keys, "__n", *[c.alias(f"__l{i}") for i, c in enumerate(low)], *[c.alias(f"__h{i}") for i, c in enumerate(high)])
    j = d.alias("d").join(a.alias("a"), same("d", "a", keys)).select("d.*", *[F.col(f"a.{c}") for c in a.columns if c not in keys])
    held = F.lit(False)
    for i in range(len(qs)):
        held = held | F.col(x).between(F.col(f"__l{i}"), F.col(f"__h{i}"))
    below = F.array_max(F.array(F.lit(-math.inf), *[F.when(F.col(f"__h{i}") < F.col(x), F.col(f"__h{i}")) for i in range(len(qs))]))
    c = j.withColumn("__out", ~held).withColumn(x, F.when(held, F.col(x)).otherwise(below))
    c = c.groupBy(*keys, x, "__out").agg(F.count(F.lit(1)).alias("n"), F.max("__n").alias("__n"))
    before = Window.partitionBy(*keys).orderBy(x, "__out").rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("__lo", F.sum("n").over(before) - F.col("n"))
    return c.where("NOT __out").select(*keys, x, "n", "__lo", "__n")
