"""Indicators of trials and subjects, and the subject matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.operators.ranks import quantiles, row_ranks, value_ranks  # noqa: F401  (ranks are asked for here, too)


def trapezoid(df: DataFrame, columns: list[str], keys, t: str = "t") -> DataFrame:
    """Area of each column over time by the trapezoid rule, on points that have both."""
    w = Window.partitionBy(*keys).orderBy(t)
    d = df.withColumn("__dt", F.col(t) - F.lag(t).over(w)).withColumns({f"__{c}": (F.col(c) + F.lag(c).over(w)) / 2 for c in columns})
    return d.groupBy(*keys).agg(*[F.sum(F.col(f"__{c}") * F.col("__dt")).alias(f"auc_{c}") for c in columns])


def duty_cycle(df: DataFrame, x: str, keys, threshold: float = 0.05, t: str = "t") -> DataFrame:
    """Share of time for which the left sample of a step is over the threshold."""
    d = df.withColumn("__dt", F.lead(t).over(Window.partitionBy(*keys).orderBy(t)) - F.col(t))
    return d.groupBy(*keys).agg(F.try_divide(F.sum(F.when(F.col(x) > threshold, F.col("__dt")).otherwise(0.0)), F.sum("__dt")).alias("duty"))


def weighted_mean(x: Column | str, w: Column | str) -> Column:
    x, w = (F.col(c) if isinstance(c, str) else c for c in (x, w))
    ok = x.isNotNull() & (w > 0)
    return F.try_divide(F.sum(F.when(ok, x * w)), F.sum(F.when(ok, w)))


def most_frequent(c: str) -> Column:
    """The lowest of the most frequent values."""
    return F.mode(c, True)


def mean_of_row_means(df: DataFrame, row, keys, x: str) -> DataFrame:
    return df.groupBy(*keys, *row).agg(F.avg(x).alias("__m")).groupBy(*keys).agg(F.avg("__m").alias(f"mean_{x}"))


def preferring(agg, x: Column, flag: Column) -> Column:
    """An aggregate over flagged rows, over all of them where none is flagged."""
    return F.coalesce(agg(F.when(flag, x)), agg(x))


def multi_stats(df: DataFrame, columns: list[str], keys=("subject",)) -> DataFrame:
    return df.groupBy(*keys).agg(*[f(c).alias(f"{c}__{n}") for c in columns for n, f in (("median", F.median), ("mean", F.avg), ("std", F.stddev_samp))])


def task_medians(df: DataFrame, columns: list[str], tasks: list[str], keys=("subject",), task: str = "task") -> DataFrame:
    """<column>__taskmed__<task> columns."""
    p = df.groupBy(*keys).pivot(task, tasks).agg(*[F.median(c).alias(f"{c}") for c in columns])
    rename = {(f"{t}_{c}" if len(columns) > 1 else t): f"{c}__taskmed__{t}" for c in columns for t in tasks}
    return p.select(*keys, *[F.col(f"`{a}`").alias(b) for a, b in rename.items()])


def mismatch_index(df: DataFrame, effort: str, motion: str) -> DataFrame:
    """z(effort) - z(motion) over all subjects, population sd; NULL where a sd is 0."""
    one = df.agg(*[f(c).alias(f"__{n}_{k}") for k, c in (("e", effort), ("m", motion)) for n, f in (("mean", F.avg), ("sd", F.stddev_pop))])
    z = lambda c, k: F.try_divide(F.col(c) - F.col(f"__mean_{k}"), F.col(f"__sd_{k}"))
    d = df.crossJoin(F.broadcast(one))  # one row
    return d.withColumn("z_effort", z(effort, "e")).withColumn("z_motion", z(motion, "m")).withColumn("nmd", F.col("z_effort") - F.col("z_motion")).drop("__mean_e", "__sd_e", "__mean_m", "__sd_m")


def spearman_pairs(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """a, b, rho, n of all column pairs; ranks are taken on the rows that have both.

    A row gives its pairs without a join; ranks inside a pair are those of row_ranks(), so that long tables are split.
    """
    two = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in two])
    p = df.select(F.explode(F.filter(pairs, lambda s: s["x"].isNotNull() & s["y"].isNotNull())).alias("s")).select("s.*")
    n = df.count()
    p = row_ranks(row_ranks(p, "x", ("a", "b"), "rx", n), "y", ("a", "b"), "ry", n)
    rho = F.try_divide(F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry"))  # NULL where a column is constant
    return p.groupBy("a", "b").agg(rho.alias("rho"), F.count(F.lit(1)).alias("n"))


def redundant_pairs(pairs: DataFrame, threshold: float = 0.9) -> DataFrame:
    return pairs.where(F.abs("rho") >= threshold)


def screen(df: DataFrame, columns: list[str], least_coverage: float = 0.8, least_sd: float = 1e-6) -> DataFrame:
    """feature, coverage, sd and whether it passes."""
    long = df.unpivot([], columns, "feature", "value")
    a = long.groupBy("feature").agg((F.count("value") / F.count(F.lit(1))).alias("coverage"), F.stddev_samp("value").alias("sd"))
    return a.withColumn("passes", (F.col("coverage") >= least_coverage) & F.coalesce(F.col("sd") > least_sd, F.lit(False)))


def feature_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """Median, sd, least, largest and sample-adjusted skewness."""
    n = F.count("value")
    adjusted = F.when(n > 2, F.skewness("value") * F.sqrt(n * (n - 1.0)) / (n - 2.0))
    return df.unpivot([], columns, "feature", "value").groupBy("feature").agg(F.median("value").alias("median"), F.stddev_samp("value").alias("sd"), F.min("value").alias("least"), F.max("value").alias("largest"), adjusted.alias("skew"))


def select_by_priority(passing: DataFrame, priorities: DataFrame, most: int = 20) -> DataFrame:
    """Screened features of a priority list (feature, priority, position); beyond `most`, those of priority 1 and 2 only, `most` at most."""
    j = passing.where("passes").select("feature").join(priorities, "feature")
    n = F.count(F.lit(1)).over(Window.partitionBy())
    j = j.withColumn("__n", n).where((F.col("__n") <= most) | (F.col("priority") <= 2))
    return j.withColumn("rank", F.row_number().over(Window.orderBy("priority", "position"))).where((F.col("__n") <= most) | (F.col("rank") <= most)).drop("__n")


def with_metadata(selected: DataFrame, metadata: DataFrame) -> DataFrame:
    """Selected features with what is known of them; features without metadata stay."""
    return selected.join(metadata, "feature", "left")


def with_duration(subjects: DataFrame, trials: DataFrame, duration: str = "kpi_duration_s", key: str = "subject") -> DataFrame:
    """Subjects with the median duration of their trials, where they have any."""
    return subjects.join(trials.groupBy(key).agg(F.median(duration).alias("duration_median")), key, "left")


def flag_artifacts(df: DataFrame, reasons: dict[str, str], key: str = "subject") -> DataFrame:
    table = F.create_map(*[F.lit(x) for kv in reasons.items() for x in kv]) if reasons else F.create_map().cast("map<string,string>")
    reason = F.try_element_at(table, F.col(key).cast("string"))
    return df.withColumn("excluded", reason.isNotNull()).withColumn("exclude_reason", reason)


def redundancy_profile(pairs: DataFrame, top: int = 10) -> DataFrame:
    """Largest |rho| of each column with any other, the `top` columns."""
    both = pairs.select(F.col("a").alias("kpi"), "rho").unionByName(pairs.select(F.col("b").alias("kpi"), "rho"))
    return both.groupBy("kpi").agg(F.max(F.abs("rho")).alias("max_abs_rho")).orderBy(F.desc("max_abs_rho"), "kpi").limit(top)


# --- indicators of trials and subjects ---

#: Columns that describe a trial, where a table has them.
META = ("group", "label", "exo", "condition", "session", "task", "task_type", "movement", "weight", "level", "side", "arm", "trial_type")


def _mean_of(columns: list[str]) -> Column:
    """Mean of a row's values that are there."""
    values = F.filter(F.array(*[F.col(c).cast("double") for c in columns]), lambda v: v.isNotNull())
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, v: a + v), F.size(values).cast("double"))


def window_kpis(features: DataFrame, keys=("subject", "trial"), distal=("Extensor", "Flexor")) -> DataFrame:
    """Indicators of each trial out of its windows' features (columns as features.window_features names them).

    The interval is that of the windows' median onset and end; motion is taken from windows with good inertial
    data, or from all where none is good, weighed by window length.
    """
    have = set(features.columns)
    length = F.col("t_end") - F.col("t_start")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in have else F.lit(True)
    good = flag("has_imu") & flag("imu_ok")
    rms = [c for c in features.columns if c.startswith("EMG_") and c.endswith("_RMS")]
    far = [c for c in rms if any(f"_{m}_" in c for m in distal)]
    jerk = [c for c in features.columns if c.endswith(("jerk_norm_mean", "jerk_abs_mean_1d"))]
    named = {"__jerk": _mean_of(jerk) if jerk else F.lit(None).cast("double"), "__rms": _mean_of(rms) if rms else F.lit(None).cast("double"), "__far": _mean_of(far) if far else F.lit(None).cast("double")}
    named |= {f"__{c}": F.col(c) if c in have else F.lit(None).cast("double") for c in ("IMU_all_gyro_mag_peak", "IMU_all_gyro_mag_mean", "EMG_CoAct_Bic_Tri")}
    d = features.withColumns(named | {"__w": length, "__good": good})
    weighed = lambda c: F.coalesce(weighted_mean(F.when(F.col("__good"), F.col(c)), F.col("__w")), F.when(~F.bool_or("__good"), weighted_mean(c, "__w")))
    on, off = F.median("t_on"), F.median("t_off")
    a = d.groupBy(*keys).agg(
        F.min("episode_id").alias("episode_id"), *[most_frequent(c).alias(c) for c in META if c in have and c not in keys], on.alias("t_on"), off.alias("t_off"),
        F.when(off > on, off - on).otherwise(F.max("t_end") - F.min("t_start")).alias("kpi_duration_s"),
        F.when(F.bool_or("__good"), F.max(F.when(F.col("__good"), F.col("__IMU_all_gyro_mag_peak")))).otherwise(F.max("__IMU_all_gyro_mag_peak")).alias("kpi_peak_gyro_mag"),
        weighed("__IMU_all_gyro_mag_mean").alias("kpi_mean_gyro_mag"), weighed("__jerk").alias("kpi_mean_jerk"),
        weighted_mean("__EMG_CoAct_Bic_Tri", "__w").alias("kpi_coact_win_mean"), F.median("__EMG_CoAct_Bic_Tri").alias("kpi_coact_win_median"), F.avg("__rms").alias("kpi_abs_rms_mean"), F.avg("__far").alias("kpi_abs_rms_distal"),
    )
    return a.withColumn("task_type", F.coalesce("task_type", "task")) if {"task", "task_type"} <= set(a.columns) else a.withColumnRenamed("task", "task_type")


def envelope_kpis(envelopes: DataFrame, intervals: DataFrame, sensors: list[str], pair=("Biceps", "Triceps"), keys=("subject", "trial"), least_sensor: int = 200, least_any: int = 200, duty: float = 0.05) -> DataFrame:
    """Indicators of each trial out of the normalised envelopes (keys, sensor, t, env_norm) within [t_on, t_off], one row an interval.

    Peak, area and duty of each sensor with enough samples, their sum and largest, and the overlap of the pair with
    the second interpolated to the first; sensors fix the columns.
    """
    from pulseframe.operators.features import coactivation_interpolated

    spans = intervals.where(F.col("t_off") > F.col("t_on")).select(*keys, "t_on", "t_off")
    d = envelopes.join(spans, list(keys)).where("t BETWEEN t_on AND t_off").select(*keys, "sensor", "t", F.greatest("env_norm", F.lit(0.0)).alias("e"), "env_norm")
    d = d.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where(F.col("__n") >= least_any)
    d = d.withColumn("e", F.when(F.col("env_norm").isNotNull(), F.col("e")))
    d = d.withColumn("__m", F.count(F.lit(1)).over(Window.partitionBy(*keys, "sensor"))).where((F.col("__m") >= least_sensor) & F.col("e").isNotNull() & F.col("t").isNotNull())
    by = [*keys, "sensor"]
    w = Window.partitionBy(*by).orderBy("t")
    steps = d.withColumn("__dt", F.lead("t").over(w) - F.col("t")).withColumn("__next", F.lead("e").over(w))
    each = steps.groupBy(*by).agg(
        F.max("e").alias("peak"), F.sum((F.col("e") + F.col("__next")) / 2 * F.col("__dt")).alias("iemg"),
        F.when(F.sum("__dt") > 0, F.sum(F.when(F.col("e") > duty, F.col("__dt")).otherwise(0.0)) / F.sum("__dt")).alias("duty"),
    )
    names = {"peak": "kpi_peak_envn", "iemg": "kpi_iemg_envn", "duty": "kpi_duty"}
    one = lambda c, s: F.max(F.when(F.col("sensor") == s, F.col(c))).alias(f"{names[c]}_{s}")
    wide = each.groupBy(*keys).agg(*[one(c, s) for s in sensors for c in names], F.sum("iemg").alias("kpi_iemg_envn_global_sum"), F.max("peak").alias("kpi_peak_envn_global_max"))
    both = coactivation_interpolated(d.where(F.col("sensor").isin(*pair)), "e", *pair, keys)
    both = both.select(*keys, F.col("coact").alias("kpi_coact_overlap_bic_tric"), F.col("cci").alias("kpi_cci_bic_tric"))
    valid = envelopes.join(spans, list(keys)).where("t BETWEEN t_on AND t_off").groupBy(*keys).agg((F.count(F.lit(1)) >= least_any).alias("kpi_emg_valid"))
    out = intervals.select(*keys).join(valid, list(keys), "left").join(wide, list(keys), "left").join(both, list(keys), "left")
    paired = [F.col(f"kpi_iemg_envn_{s}").isNotNull() if s in sensors else F.lit(False) for s in pair]
    return out.withColumns({"kpi_emg_valid": F.coalesce("kpi_emg_valid", F.lit(False)), "kpi_has_emg_any": F.col("kpi_iemg_envn_global_sum").isNotNull(), "kpi_has_bictri_pair": paired[0] & paired[1]})


def subject_kpis(trials: DataFrame, tasks: list[str], effort: str = "kpi_abs_rms_distal__median", motion: str = "kpi_peak_gyro_mag__median") -> DataFrame:
    """Median, mean and sd of every indicator, medians by task, counts and rates of usable trials, most frequent facts (one aggregation), and the mismatch index."""
    numbers = [f.name for f in trials.schema if f.dataType.simpleString() in ("double", "bigint", "int") and f.name not in ("t_on", "t_off", "subject", "trial")]
    yes = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    n = F.count(F.lit(1))
    valid, emg, pair = yes(F.col("t_off") > F.col("t_on")), yes(F.col("kpi_emg_valid")), yes(F.col("kpi_has_bictri_pair"))
    stats = [f(c).alias(f"{c}__{k}") for c in numbers for k, f in (("median", F.median), ("mean", F.avg), ("std", F.stddev_samp))]
    by_task = [F.median(F.when(F.col("task_type") == k, F.col(c))).alias(f"{c}__taskmed__{k}") for k in tasks for c in numbers] if "task_type" in trials.columns else []
    facts = [most_frequent(c).alias(c) for c in ("group", "exo", "session") if c in trials.columns]
    out = trials.groupBy("subject").agg(
        *stats, *by_task, n.alias("n_trials"), valid.alias("n_trials_valid_interval"), emg.alias("n_trials_emg_valid"), pair.alias("n_trials_has_bictri_pair"),
        (valid / n).alias("rate_valid_interval"), (emg / n).alias("rate_emg_valid"), (pair / n).alias("rate_has_bictri_pair"), *facts,
    )
    if {effort, motion} <= set(out.columns):
        out = mismatch_index(out, effort, motion).withColumnsRenamed({"z_effort": "kpi_NMD_z_effort", "z_motion": "kpi_NMD_z_motion", "nmd": "kpi_NMD"})
    return out
