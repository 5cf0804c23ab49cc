"""Time-domain features of windows, in long form and pivoted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(keys, order=("t",)) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def time_domain(df: DataFrame, x: str, keys, order=("t",), th_rel: float = 0.01, th_abs: float = 50e-6, least: int = 1) -> DataFrame:
    """MAV, RMS, WL, WAMP, ZC and n; thresholds from the window's population sd."""
    every = Window.partitionBy(*keys)
    sign = F.when(F.col(x) >= 0, 1).otherwise(-1)
    d = df.withColumn("__d", F.col(x) - F.lag(x).over(_w(keys, order))).withColumn("__s", sign).withColumn("__p", F.lag(sign).over(_w(keys, order))).withColumn("__sd", F.stddev_pop(x).over(every))
    step = F.abs("__d")
    a = d.groupBy(*keys).agg(
        F.avg(F.abs(x)).alias("MAV"), F.sqrt(F.avg(F.col(x) * F.col(x))).alias("RMS"), F.coalesce(F.sum(step), F.lit(0.0)).alias("WL"),
        F.count_if(F.coalesce(step > F.greatest(F.lit(th_abs), th_rel * F.col("__sd")), F.lit(False))).alias("WAMP"),
        F.count_if(F.coalesce((F.col("__s") != F.col("__p")) & (step > th_rel * F.col("__sd")), F.lit(False))).alias("ZC"), F.count(x).alias("n"),
    )
    return a.where(F.col("n") >= least)


def ar_coefficients(df: DataFrame, x: str, keys, order_by=("t",), order: int = 4) -> DataFrame:
    """AR1..ARp by Yule-Walker on the demeaned signal: lagged sums, then Levinson's recursion as expressions."""
    w = _w(keys, order_by)
    d = df.withColumn("__c", F.col(x) - F.avg(x).over(Window.partitionBy(*keys)))
    for k in range(1, order + 1):
        d = d.withColumn(f"__l{k}", F.lag("__c", k).over(w))
    sums = [F.sum(F.col("__c") * F.col("__c" if k == 0 else f"__l{k}")).alias(f"r{k}") for k in range(order + 1)]
    a = d.groupBy(*keys).agg(F.count(x).alias("n"), *sums)
    coef: list[Column] = []
    err = F.col("r0")
    for m in range(1, order + 1):
        # One column a step keeps the expressions small.
        top = F.col(f"r{m}") - sum((coef[j] * F.col(f"r{m - 1 - j}") for j in range(m - 1)), F.lit(0.0))
        a = a.withColumn(f"__k{m}", F.try_divide(top, err))
        k = F.col(f"__k{m}")
        new = [coef[j] - k * coef[m - 2 - j] for j in range(m - 1)] + [k]
        a = a.withColumns({f"__a{m}_{j}": c for j, c in enumerate(new)})
        coef = [F.col(f"__a{m}_{j}") for j in range(m)]
        a = a.withColumn(f"__e{m}", err * (1 - k * k))
        err = F.col(f"__e{m}")
    ok = F.col("n") >= order + 10
    return a.select(*keys, *[F.when(ok, c).alias(f"AR{j + 1}") for j, c in enumerate(coef)])


def mean_jerk(df: DataFrame, axes, keys, order=("t",), least: int = 3) -> DataFrame:
    """Mean norm of the axes' differences over the median step of distinct times."""
    w = _w(keys, order)
    norm = F.sqrt(sum(((F.col(a) - F.lag(a).over(w)) * (F.col(a) - F.lag(a).over(w)) for a in axes), F.lit(0.0)))
    d = df.withColumn("__n", norm).withColumn("__dt", F.col("t") - F.lag("t").over(w))
    a = d.groupBy(*keys).agg(F.avg("__n").alias("__n"), F.median(F.when(F.col("__dt") > 0, F.col("__dt"))).alias("dt_median_s"), F.count_distinct("t").alias("__c"))
    return a.select(*keys, F.when(F.col("__c") >= least, F.try_divide(F.col("__n"), F.col("dt_median_s"))).alias("jerk_norm_mean"), "dt_median_s")


def imu_summary(df: DataFrame, columns: list[str], keys) -> DataFrame:
    return df.groupBy(*keys).agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("peak", F.max))])


def two_channels(df: DataFrame, x: str, a: str, b: str, keys, sensor: str = "sensor") -> DataFrame:
    """Mean of both sensors at each time that both have: columns a and b."""
    v = lambda s: F.avg(F.when(F.col(sensor) == s, F.col(x)))
    return df.where(F.col(sensor).isin(a, b)).groupBy(*keys, "t").agg(v(a).alias("a"), v(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")


def interpolated(source: DataFrame, grid: DataFrame, x: str, keys) -> DataFrame:
    """x at the grid's times, linear between the samples around, held at the ends.

    Samples and grid are one ordered union, passed over once in each direction.
    """
    s = source.groupBy(*keys, "t").agg(F.avg(x).alias("__x")).withColumn("__g", F.lit(0))
    u = s.unionByName(grid.select(*keys, "t").distinct().withColumn("__x", F.lit(None).cast("double")).withColumn("__g", F.lit(1)))
    # Both frames grow from one side, so that each is a running value.
    up, down = (Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0) for order in (("t", "__g"), (F.desc("t"), "__g")))
    at = F.when(F.col("__x").isNotNull(), F.struct("t", "__x"))
    u = u.withColumn("__p", F.last(at, True).over(up)).withColumn("__f", F.last(at, True).over(down)).where("__g = 1")
    p, f = F.col("__p"), F.col("__f")
    line = p["__x"] + (f["__x"] - p["__x"]) * F.try_divide(F.col("t") - p["t"], f["t"] - p["t"])
    return u.select(*keys, "t", F.when(p.isNull(), f["__x"]).when(f.isNull() | (p["t"] == F.col("t")), p["__x"]).otherwise(line).alias(x)).where(F.col(x).isNotNull())


def coactivation_interpolated(df: DataFrame, x: str, a: str, b: str, keys, sensor: str = "sensor") -> DataFrame:
    """Overlap of two sensors with times of their own: b onto a's times inside the common span, then integrals of least and greatest."""
    first, second = df.where(F.col(sensor) == a), df.where(F.col(sensor) == b)
    span = second.groupBy(*keys).agg(F.min("t").alias("__lo"), F.max("t").alias("__hi"))
    own = first.groupBy(*keys, "t").agg(F.avg(x).alias("a")).join(span, list(keys)).where("t BETWEEN __lo AND __hi").drop("__lo", "__hi")
    return overlap(own.join(interpolated(second, own, x, keys).withColumnRenamed(x, "b"), [*keys, "t"]), keys)


def coactivation_on_grid(df: DataFrame, x: str, a: str, b: str, keys, sensor: str = "sensor", least: int = 3) -> DataFrame:
    """coact of two sensors, both interpolated (held at their ends) to a grid of the median step of their common times."""
    d = df.where(F.col(sensor).isin(a, b)).select(*keys, "t", sensor, x)
    times = d.select(*keys, "t").distinct()
    times = times.withColumn("__dt", F.col("t") - F.lag("t").over(_w(keys)))
    g = times.groupBy(*keys).agg(F.min("t").alias("__a"), F.max("t").alias("__b"), F.count(F.lit(1)).alias("__n"), F.median(F.when(F.col("__dt") > 0, F.col("__dt"))).alias("__dt")).where((F.col("__n") >= least) & (F.col("__dt") > 0))
    n = F.ceil((F.col("__b") + 1e-12 - F.col("__a")) / F.col("__dt")).cast("int")
    g = g.where(n >= least).select(*keys, F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.col("__a") + i * F.col("__dt"))).alias("t"))
    values = d.where(F.col(x).isNotNull())
    one, two = (interpolated(values.where(F.col(sensor) == s), g, x, keys).withColumnRenamed(x, c) for s, c in ((a, "a"), (b, "b")))
    return overlap(one.join(two, [*keys, "t"]), keys).where("coact IS NOT NULL").select(*keys, "coact")


def valid_windows(windows: DataFrame, flags=("emg_ok", "imu_ok")) -> DataFrame:
    """Windows with at least one good modality; a modality without a flag counts as good."""
    have = [f for f in flags if f in windows.columns]
    return windows if len(have) < len(flags) else windows.where(" OR ".join(f"coalesce({f}, false)" for f in have))


def window_features(windows: DataFrame, emg: DataFrame, imu: DataFrame, muscles: list[str], sensors: list[str], pair=("Biceps", "Triceps"), fs: float | None = None, length: float = 0.2, least_emg: int = 32, least_imu: int = 8, trial=("subject", "trial"), span: float = 120.0) -> DataFrame:
    """One wide row a window: EMG_<muscle>_<feature>, IMU_<sensor>_<summary>, pooled columns, has_emg and has_imu.

    emg: trial, sensor, t, emg_bp, env_norm; imu: trial, sensor, t, gyro_mag, acc_mag, acc_dyn, acc_x_g, acc_y_g, acc_z_g.
    The lists of sensors fix the columns.  The rate is `fs`, or the windows' fs_emg_est, or that of the times in a window.
    A missing sample makes a channel's mean features missing, as it does the spectrum; counts leave it out.  Samples and
    windows are shuffled once each, by trial and stretch of `span` seconds.
    """
    from pulseframe.operators.window_pass import features_of

    return features_of(emg, imu, windows, muscles, sensors, pair, length, fs, least_emg, least_imu, trial, span)


def feature_table_report(features: DataFrame, required: list[str], optional: list[str], keys=("subject",), length: float = 0.2) -> DataFrame:
    """Figures, the statuses of all checks, and the overall status of a wide feature table, one row a subject.

    Rates are means over rows and columns; a check without its columns fails.  overall is FAIL if a critical check
    fails (rows, required columns, window length, core coverage of both modalities, the coactivation column), else
    WARN if any check warns.
    """
    from pulseframe.functions.dims import status

    have, cols = set(features.columns), features.columns
    ends = lambda head, *tails: [c for c in cols if c.startswith(head) and c.endswith(tails)]
    emg_core = ends("EMG_", "_MAV", "_RMS", "_WL", "_MNF", "_MDF")
    jerk = ends("IMU_", "jerk_norm_mean", "jerk_abs_mean_1d")
    gyro, acc = ([c for c in cols if c.startswith("IMU_") and f"{k}_mag_" in c] for k in ("gyro", "acc"))
    imu_core = [c for c in cols if c in {*jerk, *gyro, *acc}]
    flag = lambda c, default: F.coalesce(F.col(c), F.lit(False)) if c in have else F.lit(default)
    some = lambda names: F.coalesce(*[F.when(F.col(c).isNotNull(), True) for c in names], F.lit(False)) if names else F.lit(False)
    share = lambda test: F.avg(test.cast("double"))

    def rate(names, test):
        """Mean over columns of the share of rows that a test holds for."""
        return sum((share(F.coalesce(test(F.col(c)), F.lit(False))) for c in names), F.lit(0.0)) / len(names) if names else F.lit(None).cast("double")

    missing, negative = (lambda c: c.isNull()), (lambda c: c < 0)
    emg_target, imu_target = flag("has_emg", False) & flag("emg_ok", True), flag("has_imu", False) & flag("imu_ok", True)
    pair = some(ends("EMG_Biceps_", "_MAV")) & some(ends("EMG_Triceps_", "_MAV"))
    co = F.col("EMG_CoAct_Bic_Tri") if "EMG_CoAct_Bic_Tri" in have else F.lit(None).cast("double")
    span = F.col("t_end") - F.col("t_start")
    a = features.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_windows"), F.median(span).alias("win_len_med"), F.percentile(span, 0.01).alias("win_len_p01"), F.percentile(span, 0.99).alias("win_len_p99"),
        F.avg(F.when(emg_target, some(emg_core).cast("double"))).alias("emg_feat_cov"), F.avg(F.when(imu_target, some(imu_core).cast("double"))).alias("imu_feat_cov"),
        rate(emg_core, missing).alias("emg_nan_ratio"), rate(imu_core, missing).alias("imu_nan_ratio"), rate(ends("EMG_", "_MAV"), negative).alias("emg_mav_neg_rate"), rate(ends("EMG_", "_WL"), negative).alias("emg_wl_neg_rate"),
        F.avg(F.when(pair, co.isNotNull().cast("double"))).alias("coact_cov"), F.avg(F.when(co.isNotNull(), ((co < 0) | (co > 1)).cast("double"))).alias("coact_bad_rate"), F.count_if(pair).alias("coact_both_present"),
        rate(ends("IMU_", "dt_median_s"), lambda c: c.isNull() | (c <= 0)).alias("dt_bad_rate"), rate(gyro, negative).alias("gyro_bad_rate"), rate(acc, negative).alias("acc_bad_rate"), rate(jerk, negative).alias("jerk_bad_rate"),
        F.count_if(emg_target).alias("n_emg_target"), F.count_if(imu_target).alias("n_imu_target"), share(~flag("has_emg", False)).alias("emg_missing_ratio"), share(~flag("has_imu", False)).alias("imu_missing_ratio"),
    )
    c, least, most = F.col, (lambda x, ok, warn: status(F.col(x) >= ok, F.col(x) >= warn)), (lambda x, ok, warn: status(F.col(x) <= ok, F.col(x) <= warn))
    off = F.abs(c("win_len_med") - length)
    checks = {
        "non_empty": F.when(c("n_windows") > 0, "OK").otherwise("FAIL"), "required": F.lit("OK" if set(required) <= have else "FAIL"), "optional": F.lit("OK" if set(optional) <= have else "WARN"),
        "window_length": status(off <= 1e-3, off <= 5e-3), "emg_coverage": least("emg_feat_cov", 0.98, 0.9), "imu_coverage": least("imu_feat_cov", 0.98, 0.9),
        "emg_missing": most("emg_nan_ratio", 0.1, 0.25), "imu_missing": most("imu_nan_ratio", 0.1, 0.25), "mav_negative": most("emg_mav_neg_rate", 0.0, 0.001), "wl_negative": most("emg_wl_neg_rate", 0.0, 0.001),
        "coact_column": F.lit("OK" if "EMG_CoAct_Bic_Tri" in have else "FAIL"), "coact_coverage": least("coact_cov", 0.95, 0.8), "coact_range": F.when(c("coact_bad_rate").isNotNull(), most("coact_bad_rate", 0.0, 0.01)),
        "dt_invalid": most("dt_bad_rate", 0.0, 0.01), "gyro_negative": most("gyro_bad_rate", 0.0, 0.001), "acc_negative": most("acc_bad_rate", 0.0, 0.001), "jerk_negative": most("jerk_bad_rate", 0.0, 0.001),
    }
    a = a.withColumns({f"check_{k}": v for k, v in checks.items()})
    critical = F.array(*[F.col(f"check_{k}") for k in ("non_empty", "required", "window_length", "emg_coverage", "imu_coverage", "coact_column")])
    every = F.array(*[F.col(f"check_{k}") for k in checks])
    return a.withColumn("overall", F.when(F.array_contains(critical, "FAIL"), "FAIL").when(F.array_contains(every, "WARN"), "WARN").otherwise("OK"))


def overlap(pairs: DataFrame, keys) -> DataFrame:
    """coact = integral of least / integral of greatest; cci = 2 * integral of least / integral of the sum (negative parts are 0)."""
    w = Window.partitionBy(*keys).orderBy("t")
    d = pairs.select(*keys, "t", F.greatest(F.col("a"), F.lit(0.0)).alias("a"), F.greatest(F.col("b"), F.lit(0.0)).alias("b"))
    d = d.withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b")).withColumn("dt", F.col("t") - F.lag("t").over(w))
    area = lambda c: F.sum((F.col(c) + F.col(f"__{c}")) / 2 * F.col("dt"))
    d = d.withColumns({f"__{c}": F.lag(c).over(w) for c in ("lo", "hi")})
    g = d.groupBy(*keys).agg(area("lo").alias("lo"), area("hi").alias("hi"))
    return g.select(*keys, F.try_divide("lo", "hi").alias("coact"), F.try_divide(2 * F.col("lo"), F.col("lo") + F.col("hi")).alias("cci"))


def wide(long: DataFrame, keys, name: str, value: str, names: list[str]) -> DataFrame:
    """One column a feature; the listed names fix the schema."""
    return long.groupBy(*keys).pivot(name, names).agg(F.first(value))


def feature_quality(features: DataFrame, columns: list[str], ok: float = 0.1, warn: float = 0.25, keys=("subject",)) -> DataFrame:
    """Share of missing and of negative values of each feature, with a status."""
    long = features.unpivot(list(keys), columns, "feature", "value")
    a = long.groupBy(*keys, "feature").agg(F.avg(F.col("value").isNull().cast("double")).alias("nan_rate"), F.avg(F.coalesce(F.col("value") < 0, F.lit(False)).cast("double")).alias("negative_rate"))
    return a.withColumn("status", F.when(F.col("nan_rate") <= ok, "OK").when(F.col("nan_rate") <= warn, "WARN").otherwise("FAIL"))


def overall_status(report: DataFrame, keys=("subject",)) -> DataFrame:
    worst = F.max(F.when(F.col("status") == "FAIL", 2).when(F.col("status") == "WARN", 1).otherwise(0))
    return report.groupBy(*keys).agg(F.element_at(F.array(F.lit("OK"), F.lit("WARN"), F.lit("FAIL")), worst + 1).alias("overall"))
