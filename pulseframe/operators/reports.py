"""Quality reports of phases and the tables behind figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.functions.dims import ape_status, median_ape, near_share, ok_fail, ok_warn_fail, status
from pulseframe.operators.ranks import quantiles, same


def rate_or_fallback(channels: DataFrame, report: DataFrame, keys, fallback: float, fs: str = "fs") -> DataFrame:
    """fs_used of each channel: the report's if just one row matches, else the fallback."""
    one = report.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.first(fs).alias("__fs")).where("__n = 1").drop("__n")
    return channels.join(one, list(keys), "left").withColumn("fs_used", F.coalesce("__fs", F.lit(fallback))).drop("__fs")


def window_counts(windows: DataFrame, episode, length: float, step: float) -> DataFrame:
    """Windows of each episode against floor((t_off - t_on - length) / step) + 1."""
    a = windows.groupBy(*episode).agg(F.first("t_on").alias("t_on"), F.first("t_off").alias("t_off"), F.count(F.lit(1)).alias("n"))
    expected = F.floor((F.col("t_off") - F.col("t_on") - length + 1e-9) / step) + 1
    return a.withColumn("expected", expected).withColumn("matches", F.abs(F.col("n") - expected) <= 1)


def window_report(windows: DataFrame, keys=("subject",), ok: float = 0.98, warn: float = 0.9) -> DataFrame:
    """Share of windows with coverage, without gaps, and not empty; a status each and the worst of them."""
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    a = windows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_windows"), share(F.col("cov_ok")).alias("coverage"), share(F.col("gap_ok")).alias("gap_free"), share(F.col("n") > 0).alias("filled"))
    for c in ("coverage", "gap_free", "filled"):
        a = a.withColumn(f"{c}_status", status(F.col(c) >= ok, F.col(c) >= warn))
    states = F.array("coverage_status", "gap_free_status", "filled_status")
    return a.withColumn("overall", F.when(F.array_contains(states, "FAIL"), "FAIL").when(F.array_contains(states, "WARN"), "WARN").otherwise("OK"))


def window_table_report(windows: DataFrame, length: float = 0.2, step: float = 0.1, keys=("subject",), trial: str = "trial", emg_hz=(1100.0, 1400.0), imu_hz=(120.0, 180.0)) -> DataFrame:
    """The ten checks of a window table with both modalities' columns (emg_*, imu_*), one row a subject; overall is FAIL if any of the first eight fails."""
    inside = (F.col("t_start") >= F.col("t_on") - 1e-9) & (F.col("t_end") <= F.col("t_off") + 1e-9)
    yes = lambda c: F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double"))
    a = windows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_windows"), F.count_distinct(trial).alias("n_trials"), near_share(F.col("t_end") - F.col("t_start"), length, 1e-6).alias("win_len_ratio"), F.avg(inside.cast("double")).alias("inside_ratio"),
        F.median("fs_emg_est").alias("fs_emg_median"), F.median("fs_imu_est").alias("fs_imu_median"), yes("emg_ok").alias("emg_ok_ratio"), yes("imu_ok").alias("imu_ok_ratio"),
        median_ape("emg_n", F.col("fs_emg_est") * length).alias("ape_emg_median"), median_ape("imu_n", F.col("fs_imu_est") * length).alias("ape_imu_median"),
    )
    e = windows.groupBy(*keys, trial, "episode_id").agg((F.first("t_off") - F.first("t_on")).alias("__s"), F.count(F.lit(1)).alias("__n"))
    expected = F.greatest(F.floor((F.col("__s") - length) / step), F.lit(0)) + 1
    e = e.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_episodes"), F.median(F.abs(F.col("__n") - expected)).alias("episode_diff_median"))
    d = F.col("episode_diff_median")
    checks = {
        "nonempty": ok_fail(F.col("n_windows") > 0), "win_len": ok_warn_fail(F.col("win_len_ratio"), 0.999, 0.98), "inside": ok_warn_fail(F.col("inside_ratio"), 0.999, 0.98),
        "fs_emg": ok_fail(F.col("fs_emg_median").between(*emg_hz)), "fs_imu": ok_fail(F.col("fs_imu_median").between(*imu_hz)), "emg_ok": ok_warn_fail(F.col("emg_ok_ratio"), 0.98, 0.9), "imu_ok": ok_warn_fail(F.col("imu_ok_ratio"), 0.98, 0.9),
        "episodes": status(d == 0, d <= 1), "emg_samples": ape_status(F.col("ape_emg_median")), "imu_samples": ape_status(F.col("ape_imu_median")),
    }
    out = a.join(e, list(keys)).withColumns({f"check_{k}": v for k, v in checks.items()})
    decisive = F.array(*[F.col(f"check_{k}") for k in list(checks)[:8]])
    return out.withColumn("overall", F.when(F.array_contains(decisive, "FAIL"), "FAIL").otherwise("OK"))


def box_table(df: DataFrame, x: str, keys) -> DataFrame:
    """Quartiles and whiskers (the extremes inside the fences) of box plots."""
    keys = list(keys)
    q = quantiles(df, x, {"q1": 0.25, "median": 0.5, "q3": 0.75}, keys)
    d = df.where(F.col(x).isNotNull()).select(*keys, x).alias("d").join(q.alias("q"), same("d", "q", keys)).select(*[F.col(f"d.{k}") for k in keys], x, "q1", "median", "q3")
    fence = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.when(F.col(x).between(F.col("q1") - fence, F.col("q3") + fence), F.col(x))
    return d.groupBy(*keys).agg(*[F.first(c).alias(c) for c in ("q1", "median", "q3")], F.min(inside).alias("low"), F.max(inside).alias("high"), F.count(x).alias("n"))


def histogram(df: DataFrame, x: str, bins: int, keys=()) -> DataFrame:
    """Counts of equal bins between the extremes; the last bin holds its upper edge."""
    keys = list(keys)
    d = df.where(F.col(x).isNotNull()).select(*keys, x)
    ends = d.groupBy(*keys).agg(F.min(x).alias("__lo"), ((F.max(x) - F.min(x)) / bins).alias("__w"))
    d = d.alias("d").join(ends.alias("e"), same("d", "e", keys)).select(*[F.col(f"d.{k}") for k in keys], x, "__lo", "__w")
    b = F.least(F.coalesce(F.floor(F.try_divide(F.col(x) - F.col("__lo"), F.col("__w"))), F.lit(0)), F.lit(bins - 1))
    return d.groupBy(*keys, b.alias("bin")).agg(F.first("__lo").alias("__lo"), F.first("__w").alias("__w"), F.count(F.lit(1)).alias("n")).select(*keys, "bin", (F.col("__lo") + F.col("bin") * F.col("__w")).alias("edge"), "n")


def change_grid(df: DataFrame, row: str, column: str, x: str, columns: list[str]) -> DataFrame:
    return df.groupBy(row).pivot(column, columns).agg(F.first(x))


def forest_table(coefficients: DataFrame, width: float = 1.96) -> DataFrame:
    """name, coef, lower, upper of coefficients with standard errors."""
    return coefficients.select("name", "coef", (F.col("coef") - width * F.col("se")).alias("lower"), (F.col("coef") + width * F.col("se")).alias("upper"))
