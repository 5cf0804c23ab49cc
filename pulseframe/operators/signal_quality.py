"""Signal quality of channels: sampling, gaps, saturation, dead signals, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.functions.dims import finite

CHANNEL = ("subject", "trial", "sensor")


def _in_order(keys, order) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def sampling(df: DataFrame, keys=CHANNEL, t: str = "t", order=("t",), factor: float = 2.0) -> DataFrame:
    """fs (1 / mean positive step), gaps (steps over factor * median), least and largest step, duration, n; in input order."""
    w = _in_order(keys, order)
    d = df.select(*keys, t, (F.col(t) - F.lag(t).over(w)).alias("dt"))
    positive = F.when(F.col("dt") > 0, F.col("dt"))
    d = d.withColumn("__m", F.median(positive).over(Window.partitionBy(*keys)))
    return d.groupBy(*keys).agg(
        F.try_divide(F.lit(1.0), F.avg(positive)).alias("fs"), F.count_if(F.coalesce(positive > factor * F.col("__m"), F.lit(False))).alias("gaps"),
        F.min(positive).alias("dt_min"), F.max(positive).alias("dt_max"), (F.max(t) - F.min(t)).alias("duration_s"), F.count(F.lit(1)).alias("n_samples"),
    )


def run_lengths(df: DataFrame, x: str, keys=CHANNEL, order=("t",), skip_missing: bool = True) -> DataFrame:
    """Adds run_id and run_length: maximal stretches of equal values. Missing values are left out first, or else break runs."""
    d = df.withColumn("__x", finite(x))
    if skip_missing:
        d = d.where(F.col("__x").isNotNull())
    w = _in_order(keys, order)
    new = F.coalesce(F.col("__x") != F.lag("__x").over(w), F.lit(True)).cast("long")
    d = d.withColumn("run_id", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.withColumn("run_length", F.count("__x").over(Window.partitionBy(*keys, "run_id"))).drop("__x")


def saturation(df: DataFrame, x: str, least: int, keys=CHANNEL, order=("t",)) -> DataFrame:
    """Share of samples in runs of at least `least` equal values."""
    return run_lengths(df, x, keys, order).groupBy(*keys).agg(F.avg((F.col("run_length") >= least).cast("double")).alias("saturation_ratio"), F.count(F.lit(1)).alias("n_finite"))


def saturation_mask(df: DataFrame, x: str, least: int, keys=CHANNEL, order=("t",)) -> DataFrame:
    """Adds saturated: whether the sample is in such a run (missing values break runs)."""
    return run_lengths(df, x, keys, order, skip_missing=False).withColumn("saturated", F.col("run_length") >= least).drop("run_id", "run_length")


def expand_mask(df: DataFrame, mask: str, pad: int, keys=CHANNEL, order=("t",)) -> DataFrame:
    """Dilates a mask by `pad` samples to both sides."""
    return df.withColumn(mask, F.max(F.col(mask).cast("int")).over(_in_order(keys, order).rowsBetween(-pad, pad)) == 1)


def dead_signal(x: Column | str, eps: float = 1e-10) -> Column:
    """Aggregate: variance below eps, or nothing at all."""
    return F.coalesce(F.var_pop(finite(x)) < eps, F.lit(True))


def missing_share(x: Column | str) -> Column:
    return F.avg(finite(x).isNull().cast("double"))


def quality_report(df: DataFrame, x: str, least: int = 60, keys=CHANNEL, order=("t",), factor: float = 2.0) -> DataFrame:
    """All figures of each channel in one table."""
    basic = df.groupBy(*keys).agg(missing_share(x).alias("nan_ratio"), F.var_pop(finite(x)).alias("var"), dead_signal(x).alias("lowvar_flag"))
    return basic.join(sampling(df, keys, order=order, factor=factor), list(keys)).join(saturation(df, x, least, keys, order).drop("n_finite"), list(keys), "left")


def quality_by_signal(df: DataFrame, signals: dict[str, int], keys=CHANNEL, order=("t",)) -> DataFrame:
    """quality_report of several value columns (name -> run length) in one pass over the table: long form with `signal`."""
    limits = F.create_map(*[F.lit(x) for kv in signals.items() for x in kv])
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("signal"), F.col(c).cast("double").alias("__v")) for c in signals]))
    held = list(dict.fromkeys([*keys, "t", *order]))
    long = df.select(*held, parts.alias("__p")).select(*held, "__p.*")
    by = (*keys, "signal")
    basic = long.groupBy(*by).agg(missing_share("__v").alias("nan_ratio"), F.var_pop(finite("__v")).alias("var"), dead_signal("__v").alias("lowvar_flag"))
    share = F.avg((F.col("run_length") >= limits[F.col("signal")]).cast("double"))
    runs = run_lengths(long, "__v", by, order).groupBy(*by).agg(share.alias("saturation_ratio"))
    return basic.join(sampling(long, by, order=order), list(by)).join(runs, list(by), "left")


def quality_wide(report: DataFrame, signals: list[str], keys=CHANNEL) -> DataFrame:
    """One row a channel: <signal>_<figure> columns, with the informational flags of channels that have one modality alone."""
    figures = ["fs", "gaps", "dt_min", "dt_max", "nan_ratio", "var", "lowvar_flag", "saturation_ratio", "duration_s", "n_samples"]
    wide = report.groupBy(*keys).pivot("signal", signals).agg(*[F.first(c).alias(c) for c in figures])
    filled = {f"{s}_n_samples": F.coalesce(f"{s}_n_samples", F.lit(0).cast("long")) for s in signals} | {f"{s}_lowvar_flag": F.coalesce(f"{s}_lowvar_flag", F.lit(False)) for s in signals}
    return wide.withColumns(filled)


def trial_status_wide(wide: DataFrame, emg: str, others: list[str], trial=("subject", "trial"), gap_limit: int = 0, saturation_limit: float = 0.01) -> DataFrame:
    """FAIL if any channel has a gap, or has muscle samples that are dead or saturated, or (column mapping_ok) is mapped wrongly."""
    over = lambda c, k: F.coalesce(F.col(c), F.lit(0)) > k
    bad = F.coalesce(F.col(f"{emg}_n_samples"), F.lit(0)) > 0
    bad = bad & (F.coalesce(F.col(f"{emg}_lowvar_flag"), F.lit(False)) | over(f"{emg}_saturation_ratio", saturation_limit))
    for c in (emg, *others):
        bad = bad | over(f"{c}_gaps", gap_limit)
    if "mapping_ok" in wide.columns:
        bad = bad | ~F.coalesce("mapping_ok", F.lit(True))
    return wide.groupBy(*trial).agg(F.when(F.bool_or(bad), "FAIL").otherwise("OK").alias("status"), F.count_if(bad).alias("n_bad"))


def of_subject(report: DataFrame, subject: str) -> DataFrame:
    """A subject's rows; an error where there are none."""
    rows = report.where(F.col("subject") == subject)
    if rows.isEmpty():
        raise LookupError(f"no quality rows of subject {subject}")
    return rows


def with_absent(report: DataFrame, channels: DataFrame, keys=CHANNEL) -> DataFrame:
    """A row for each listed channel; absent ones have no samples, no figures and no flag."""
    out = channels.select(*keys).distinct().join(report, list(keys), "left")
    return out.withColumns({"lowvar_flag": F.coalesce("lowvar_flag", F.lit(False)), "n_samples": F.coalesce("n_samples", F.lit(0).cast("long"))})


def trial_status(report: DataFrame, trial=("subject", "trial"), gap_limit: int = 0, saturation_limit: float = 0.01) -> DataFrame:
    """FAIL if any channel has too many gaps, is saturated or dead; OK otherwise."""
    bad = (F.col("gaps") > gap_limit) | (F.col("saturation_ratio") > saturation_limit) | F.col("lowvar_flag")
    return report.groupBy(*trial).agg(F.when(F.bool_or(F.coalesce(bad, F.lit(False))), "FAIL").otherwise("OK").alias("status"), F.count_if(F.coalesce(bad, F.lit(False))).alias("n_bad"))


def admitted(df: DataFrame, status: DataFrame, repaired: DataFrame | None = None, trial=("subject", "trial")) -> DataFrame:
    """Rows of trials that are OK or on the repair list."""
    ok = status.where("status = 'OK'").select(*trial)
    if repaired is not None:
        ok = ok.unionByName(repaired.select(*trial)).distinct()
    return df.join(ok, list(trial), "left_semi")


def informational_flags(df: DataFrame, emg_n: str, imu_n: str) -> DataFrame:
    e, i = F.coalesce(F.col(emg_n), F.lit(0)) > 0, F.coalesce(F.col(imu_n), F.lit(0)) > 0
    return df.withColumn("imu_only_sensor", i & ~e).withColumn("emg_only_sensor", e & ~i)


def completeness(report: DataFrame, trials: int, sensors: int) -> DataFrame:
    """OK if a subject has the expected trials, sensors and rows; WARN otherwise."""
    a = report.groupBy("subject").agg(F.count_distinct("trial").alias("n_trials"), F.count_distinct("sensor").alias("n_sensors"), F.count(F.lit(1)).alias("n_rows"))
    full = (F.col("n_trials") == trials) & (F.col("n_sensors") == sensors) & (F.col("n_rows") == trials * sensors)
    return a.withColumn("status", F.when(full, "OK").otherwise("WARN"))


def completeness_failures(report: DataFrame, trials: int, sensors: int) -> DataFrame:
    """subject, what ('trials', 'sensors' or 'rows'), expected and found: every count of completeness() that is not as expected."""
    a = completeness(report, trials, sensors)
    rows = [("trials", trials), ("sensors", sensors), ("rows", trials * sensors)]
    parts = F.explode(F.array(*[F.struct(F.lit(n).alias("what"), F.lit(e).cast("long").alias("expected"), F.col(f"n_{n}").alias("found")) for n, e in rows])).alias("x")
    return a.select("subject", parts).select("subject", "x.*").where("expected <> found")


def range_summary(df: DataFrame, columns: list[str], keys=()) -> DataFrame:
    """metric, least, median, largest of several columns."""
    long = df.unpivot(list(keys), columns, "metric", "value")
    return long.groupBy(*keys, "metric").agg(F.min("value").alias("least"), F.median("value").alias("middle"), F.max("value").alias("largest"))
