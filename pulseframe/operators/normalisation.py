"""Percentile scales, stratified samples, normalisation, and keyed upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.operators.kpis import quantiles
from pulseframe.operators.ranks import same

#: Ranges of the order's hash in which a group's rows are counted to find where its sample ends.
RANGES = 4096


def stratified_sample(df: DataFrame, keys, frac: float = 0.02, least: int = 5000, most: int = 200_000, seed: int = 0, order: str = "t", mode: str = "random_per_sensor") -> DataFrame:
    """clip(round(frac * N), least, most) rows of each group, N at most, by hash of the order key; 'none' keeps all, 'global_frac' a share.

    Counts by range of the hash tell in which range a group's sample ends; only rows up to that range, `most` and a range's
    at most, are ordered.
    """
    if mode == "none":
        return df
    if mode == "global_frac":
        return df.where(F.pmod(F.xxhash64(*keys, order, F.lit(seed)), F.lit(1_000_000)) < int(frac * 1_000_000))
    keys = list(keys)
    d = df.withColumn("__h", F.xxhash64(order, F.lit(seed)))
    d = d.withColumn("__b", F.shiftright("__h", 65 - RANGES.bit_length()))
    by_range = d.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__m"))
    so_far = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    by_range = by_range.withColumn("__up", F.sum("__m").over(so_far)).withColumn("__all", F.sum("__m").over(Window.partitionBy(*keys)))
    size = F.least(F.greatest(F.rint(F.col("__all") * frac), F.lit(float(least))), F.lit(float(most)), "__all")
    ends = by_range.groupBy(*keys).agg(F.max(size).alias("__n"), F.min(F.when(F.col("__up") >= size, F.col("__b"))).alias("__end"))
    near = d.alias("d").join(F.broadcast(ends).alias("e"), same("d", "e", keys) & (F.col("__b") <= F.col("__end"))).select("d.*", "__n")  # one row a group
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("__h", order))
    return near.withColumn("__r", rank).where("__r <= __n").select(*df.columns)


def percentile_scales(df: DataFrame, x: str, keys, p: int = 95, too_small: float = 1e-8) -> DataFrame:
    """env_scale: exact percentile of the non-negative part (NULL if tiny), its flag and n."""
    raw = df.groupBy(*keys).agg(F.percentile(F.greatest(F.col(x), F.lit(0.0)), p / 100).alias("s"), F.count(x).alias("n_used"))
    small = F.coalesce(F.col("s") < too_small, F.lit(True))
    return raw.select(*keys, F.lit(p).alias("p"), F.when(~small, F.col("s")).alias("env_scale"), small.alias("scale_too_small_flag"), "n_used")


def with_provenance(scales: DataFrame, **facts) -> DataFrame:
    return scales.withColumns({k: F.lit(v) for k, v in facts.items()} | {"computed_utc": F.current_timestamp()})


def bad_scales(scales: DataFrame) -> DataFrame:
    return scales.where("scale_too_small_flag OR env_scale IS NULL")


def apply_scales(df: DataFrame, scales: DataFrame, keys, x: str) -> DataFrame:
    """Adds env_scale and env_norm = x / env_scale; NULL without a valid scale."""
    valid = scales.where("env_scale > 0").select(*keys, "env_scale")
    return df.join(valid, list(keys), "left").withColumn("env_norm", F.try_divide(F.col(x), F.col("env_scale")))


def append_new(old: DataFrame, new: DataFrame, keys) -> DataFrame:
    """old and those rows of new whose key old lacks."""
    return old.unionByName(new.join(old.select(*keys).distinct(), list(keys), "left_anti"), allowMissingColumns=True)


def replace_keys(old: DataFrame, new: DataFrame, keys) -> DataFrame:
    """new and those rows of old whose key new lacks."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, keys, mode: str = "replace") -> DataFrame:
    return {"replace": replace_keys, "append": append_new}[mode](old, new, keys)


def upsert_with_facts(old: DataFrame, new: DataFrame, keys, mode: str = "replace", **facts) -> DataFrame:
    """upsert() by several keys in which each row carries the facts (source, version, ...) of the run that it comes from."""
    return upsert(old, new.withColumns({k: F.lit(v) for k, v in facts.items()}), keys, mode)


def median_impute(df: DataFrame, columns: list[str]) -> DataFrame:
    """Medians of the columns in place of missing values."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    m = quantiles(long, "v", {"m": 0.5}, ("c",)).agg(*[F.max(F.when(F.col("c") == c, F.col("m"))).alias(f"__m_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(m))  # one row
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"__m_{c}")) for c in columns}).select(*df.columns)


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population sd; a constant column becomes 0."""
    stats = df.agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = df.crossJoin(F.broadcast(stats))  # one row
    sd = lambda c: F.when(F.col(f"__s_{c}") > 0, F.col(f"__s_{c}")).otherwise(1.0)
    return out.withColumns({c: (F.col(c) - F.col(f"__m_{c}")) / sd(c) for c in columns}).select(*df.columns)
