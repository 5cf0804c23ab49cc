"""Sliding windows over episodes, their samples, and coverage checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPISODE = ("subject", "trial", "episode_id")


def make_windows(episodes: DataFrame, length: float = 0.2, step: float = 0.1, context: float = 0.0) -> DataFrame:
    """window_id (1..n), t_start, t_end: a grid anchored at t_on; none where an episode is shorter than a window."""
    e = episodes.withColumn("__on", F.col("t_on") - context).withColumn("__off", F.col("t_off") + context)
    n = F.ceil((F.col("__off") - length + 1e-12 - F.col("__on")) / step)
    w = e.where(F.col("__off") - F.col("__on") >= length).where(n >= 1)
    w = w.select("*", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("__i"))
    start = F.col("__on") + F.col("__i") * step
    return w.withColumn("window_id", F.col("__i") + 1).withColumn("t_start", start).withColumn("t_end", start + length).drop("__i", "__on", "__off")


def samples_in_windows(samples: DataFrame, windows: DataFrame, length: float = 0.2, step: float = 0.1, trial=("subject", "trial")) -> DataFrame:
    """Samples with t_start <= t < t_end of every window that holds them.

    Equi-join on the trial and on a coarse bucket of time, so no nested loop:
    a window lies in at most two buckets of its own length.
    """
    bucket = lambda t: F.floor(F.col(t) / length)
    w = windows.withColumn("__b", F.explode(F.sequence(bucket("t_start"), bucket("t_end"))))
    s = samples.withColumn("__b", bucket("t"))
    return s.join(w, [*trial, "__b"]).where("t >= t_start AND t < t_end").drop("__b")


def rate(samples: DataFrame, keys=("subject", "trial"), least: int = 3) -> DataFrame:
    """fs_est: 1 / median step of the distinct times of a trial."""
    d = samples.select(*keys, "t").withColumn("dt", F.col("t") - F.lag("t").over(Window.partitionBy(*keys).orderBy("t")))
    steps = F.when(F.col("dt") > 0, F.col("dt"))
    return d.groupBy(*keys).agg(F.count(steps).alias("n"), F.median(steps).alias("dt")).select(*keys, F.when(F.col("n") >= least - 1, F.try_divide(F.lit(1.0), F.col("dt"))).alias("fs_est"))


def _flags(n: Column, fs: Column, gap: Column, length: float, least_coverage: float, longest_gap: float) -> dict[str, Column]:
    covered = F.coalesce(F.try_divide(n, fs * length) >= least_coverage, F.lit(False))
    gap_ok = F.coalesce(gap <= longest_gap, F.lit(False))
    return {"expected_n": fs * length, "cov_ok": covered, "gap_ok": gap_ok, "ok": covered & gap_ok}


def window_quality(samples: DataFrame, windows: DataFrame, length: float = 0.2, step: float = 0.1, least_coverage: float = 0.6, longest_gap: float = 0.05, trial=("subject", "trial")) -> DataFrame:
    """All windows, also empty ones, with n distinct times, rows, largest gap, and flags; windows are planned once, in one pass with the samples."""
    from pulseframe.operators.window_pass import coverage, meet

    fields = [T.StructField("n", T.LongType()), T.StructField("n_rows", T.LongType()), T.StructField("max_gap_s", T.DoubleType())]
    got = meet(samples.select(*trial, F.col("t").cast("double").alias("t")), windows, lambda s, a, b, _: coverage(s["t"], a, b), fields, length, trial, max(120.0, 20 * length))
    out = got.fillna(0, ["n", "n_rows"]).join(rate(samples, trial), list(trial), "left")
    return out.withColumns(_flags(F.col("n"), F.col("fs_est"), F.col("max_gap_s"), length, least_coverage, longest_gap))


def both_rates(emg: DataFrame, imu: DataFrame, trial=("subject", "trial"), least: int = 3) -> DataFrame:
    """fs_emg_est and fs_imu_est of each trial, with one shuffle of the samples' times."""
    both = emg.select(*trial, "t", F.lit("emg").alias("__m")).unionByName(imu.select(*trial, "t", F.lit("imu").alias("__m"))).repartition(*trial)
    d = both.withColumn("dt", F.col("t") - F.lag("t").over(Window.partitionBy(*trial, "__m").orderBy("t")))
    steps = lambda m: F.when((F.col("dt") > 0) & (F.col("__m") == m), F.col("dt"))
    est = lambda m: F.when(F.count(steps(m)) >= least - 1, F.try_divide(F.lit(1.0), F.median(steps(m)))).alias(f"fs_{m}_est")
    return d.groupBy(*trial).agg(est("emg"), est("imu"))


def windows_of_both(windows: DataFrame, emg: DataFrame, imu: DataFrame, length: float = 0.2, least_coverage: float = 0.6, longest_gap: float = 0.05, trial=("subject", "trial"), span: float = 120.0) -> DataFrame:
    """All windows with both modalities' rates, counts, gaps and flags, out of one pass over the samples and one for the rates."""
    from pulseframe.operators.window_pass import coverage_of

    w = coverage_of(emg, imu, windows, length, trial, span).join(both_rates(emg, imu, trial), list(trial), "left")
    for m in ("emg", "imu"):
        flags = _flags(F.col(f"{m}_n"), F.col(f"fs_{m}_est"), F.col(f"{m}_max_gap_s"), length, least_coverage, longest_gap)
        w = w.withColumns({f"{m}_{c}": v for c, v in flags.items()})
    return w
