"""The phases as whole-table plans, each from DataFrames to DataFrames.

Tables are long: muscle samples (subject, trial, sensor, t, emg_mv and what later phases add), inertial samples
(subject, trial, sensor, t, the six axes and what is derived from them), episodes, windows, wide features.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.functions import dims
from pulseframe.operators import batteries, episodes, features, kpis, normalisation, reports, signal_quality, signals, windowing
from pulseframe.operators.statistics import mann_whitney
from pulseframe.sources import tables

CHANNEL, TRIAL = ("subject", "trial", "sensor"), ("subject", "trial")


# --- 0: quality ---


def quality(samples: DataFrame, least: int = 60) -> tuple[DataFrame, DataFrame]:
    """(channel report, trial status) of samples with one value column x."""
    report = signal_quality.quality_report(samples, "x", least)
    return report, signal_quality.trial_status(report)


def with_magnitudes(imu: DataFrame) -> DataFrame:
    return imu.withColumn("gyro_mag", dims.magnitude("gyro_x_dps", "gyro_y_dps", "gyro_z_dps")).withColumn("acc_mag", dims.magnitude("acc_x_g", "acc_y_g", "acc_z_g"))


def quality_of_recordings(emg: DataFrame, imu: DataFrame, emg_run: int = 500, imu_run: int = 60, gap_limit: int = 0, saturation_limit: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """(wide report: a row a channel with emg_, imu_gyro_mag_ and imu_acc_mag_ figures; trial status)."""
    one = signal_quality.quality_by_signal(emg.withColumnRenamed("emg_mv", "emg"), {"emg": emg_run})
    moving = with_magnitudes(imu).withColumnsRenamed({"gyro_mag": "imu_gyro_mag", "acc_mag": "imu_acc_mag"})
    two = signal_quality.quality_by_signal(moving, {"imu_gyro_mag": imu_run, "imu_acc_mag": imu_run})
    names = ["emg", "imu_gyro_mag", "imu_acc_mag"]
    wide = signal_quality.informational_flags(signal_quality.quality_wide(one.unionByName(two), names), "emg_n_samples", "imu_gyro_mag_n_samples")
    return wide, signal_quality.trial_status_wide(wide, "emg", names[1:], gap_limit=gap_limit, saturation_limit=saturation_limit)


# --- 2 and 2b: filters ---


def preprocess_emg(emg: DataFrame, report: DataFrame, status: DataFrame, repaired: DataFrame, fallback: float = 1259.26, least_run: int = 500, pad_s: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(samples with emg_bp and env, log with fs_emg_used and notch_applied a channel) of trials that are OK or on the repair list.

    The rate is the report's emg_fs where just one row of it matches, else the fallback.  In repaired trials, samples
    in long runs of one value, and those within pad_s of them, lose both values.
    """
    d = signal_quality.admitted(emg, status, repaired)
    used = reports.rate_or_fallback(d.select(*CHANNEL).distinct(), report, CHANNEL, fallback, "emg_fs")
    d = d.join(used, list(CHANNEL)).join(F.broadcast(repaired.select(*TRIAL).distinct().withColumn("__repair", F.lit(True))), list(TRIAL), "left")  # a list written by hand
    d = signal_quality.saturation_mask(d, "emg_mv", least_run)
    # The pad in samples depends on the channel's rate, so the nearest saturated times decide.
    w = Window.partitionBy(*CHANNEL)
    place = F.row_number().over(w.orderBy("t"))
    d = d.withColumn("__i", place).withColumn("__hit", F.when(F.col("saturated"), F.col("__i")))
    before = F.last("__hit", True).over(w.orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    after = F.last("__hit", True).over(w.orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0))
    near = F.coalesce(F.least(F.col("__i") - before, after - F.col("__i")) <= F.rint(pad_s * F.col("fs_used")), F.lit(False))
    d = d.withColumn("__drop", F.coalesce("__repair", F.lit(False)) & near).drop("__i", "__hit", "saturated", "__repair")
    # Data and log come from one run of the filters.
    out = tables.staged(signals.emg_channels(d, "emg_mv", CHANNEL, fs_column="fs_used"), "emg-channels")
    log = out.groupBy(*CHANNEL).agg(F.first("fs_used").alias("fs_emg_used"), F.first("notched").alias("notch_applied"))
    kept = lambda c: F.when(~F.col("__drop"), F.col(c))
    return out.select(*CHANNEL, "t", kept("bp").alias("emg_bp"), kept("env").alias("env")), log


def preprocess_imu(imu: DataFrame, report: DataFrame, status: DataFrame, repaired: DataFrame, fallback: float = 148.15) -> DataFrame:
    """Magnitudes, gates, the dynamic part of the acceleration and fs_imu_used of trials that are OK or on the repair list."""
    d = signal_quality.admitted(with_magnitudes(imu), status, repaired)
    used = reports.rate_or_fallback(d.select(*CHANNEL).distinct(), report, CHANNEL, fallback, "imu_gyro_mag_fs").withColumnRenamed("fs_used", "fs_imu_used")
    return signals.imu_channels(d.join(used, list(CHANNEL)), "gyro_mag", "acc_mag", CHANNEL, fs_column="fs_imu_used")


# --- 3: normalisation ---


def normalise(samples: DataFrame, x: str = "x", p: int = 95) -> DataFrame:
    keys = ("subject", "sensor")
    return normalisation.apply_scales(samples, normalisation.percentile_scales(samples, x, keys, p), keys, x)


def normalise_envelopes(samples: DataFrame, x: str = "env", p: int = 95, frac: float = 0.02, least: int = 5000, most: int = 200_000, mode: str = "random_per_sensor") -> tuple[DataFrame, DataFrame]:
    """(samples with env_scale and env_norm, scales with their provenance); percentiles of a stratified sample of each channel."""
    keys = ("subject", "sensor")
    sample = normalisation.stratified_sample(samples.withColumn("__o", F.concat_ws("|", "trial", F.col("t").cast("string"))), keys, frac, least, most, order="__o", mode=mode)
    scales = normalisation.percentile_scales(sample, x, keys, p)
    return normalisation.apply_scales(samples, scales, keys, x), normalisation.with_provenance(scales, sampling_mode=mode, frac=frac, min_per_sensor=least, max_per_sensor=most)


# --- 4: episodes ---


def episodes_and_windows(samples: DataFrame, x: str = "x", length: float = 0.2, step: float = 0.1, bin_s: float = 0.001, **detector) -> tuple[DataFrame, DataFrame]:
    """(episodes, windows) of the gate of all sensors together."""
    gate = episodes.binned_gate(samples.withColumnRenamed(x, "__x"), {"__x": 1.0}, bin_s=bin_s)
    found = episodes.detect_mad(gate, **detector)
    return found, windowing.make_windows(found, length, step)


def trials_of(imu: DataFrame, emg: DataFrame, config: dict) -> DataFrame:
    """subject, trial, use_imu and params of all trials that either modality has."""
    both = imu.select(*TRIAL, F.lit(True).alias("use_imu")).unionByName(emg.select(*TRIAL, F.lit(False).alias("use_imu")))
    return tables.with_parameters(both.groupBy(*TRIAL).agg(F.bool_or("use_imu").alias("use_imu")), config)


def gates(imu: DataFrame, emg: DataFrame, trials: DataFrame, config: dict, bin_s: float = 0.001) -> tuple[DataFrame, DataFrame]:
    """(gates in time order, gates in row order for the tremor variant), each with the trial's params and use_imu.

    imu: subject, trial, row, t, gyro_gate, acc_gate; emg: subject, trial, row, t, env_norm; row numbers the rows of a
    trial as they lie, sensor after sensor.
    """
    p = F.col("params")
    calm = trials.where("params.variant <> 'tremor'")
    keys = [*TRIAL, "use_imu", "params"]
    move = imu.join(calm.where("use_imu").select(*TRIAL, "use_imu", p["alpha_acc"].alias("__alpha")), list(TRIAL))
    bins = move.groupBy(*TRIAL, F.rint(F.col("t") / bin_s).cast("long").alias("bin")).agg(F.avg("t").alias("t"), F.median("gyro_gate").alias("g"), F.median("acc_gate").alias("a"), F.first("__alpha").alias("__alpha"))
    one = bins.select(*TRIAL, "t", F.greatest(F.col("g"), F.col("__alpha") * F.col("a")).alias("gate"))
    two = episodes.emg_gate(emg.join(calm.where("NOT use_imu").select(*TRIAL), list(TRIAL), "left_semi"), "env_norm", TRIAL, bin_s)
    g = one.unionByName(two).join(calm, list(TRIAL))
    parts = [episodes.median_filter(g.where(p["smooth_kernel"] == k), kernel=k, keys=TRIAL) if k > 1 else g.where(p["smooth_kernel"] == k) for k in tables.smoothing_kernels(config)]
    g = parts[0]
    for part in parts[1:]:
        g = g.unionByName(part)
    sharp = episodes.tkeo(g.withColumn("__t", F.col("gate")), "__t", TRIAL)
    g = sharp.withColumn("gate", F.when(p["apply_tkeo"], F.col("__t")).otherwise(F.col("gate"))).drop("__t")
    boosted = episodes.boost_emg_gate(g.withColumn("__raw", F.col("gate")), p["emg_lowvar_mode"], keys=TRIAL)
    g = boosted.withColumn("gate", F.when(F.col("use_imu"), F.col("__raw")).otherwise(F.col("gate"))).drop("__raw")
    flat = F.var_pop("gate").over(Window.partitionBy(*TRIAL)) < p["boost"]["var_threshold"]
    g = g.withColumn("gate", F.col("gate") * F.when(flat, p["boost"]["factor"]).otherwise(1.0))
    shaky = trials.where("params.variant = 'tremor'")
    raw = imu.select(*TRIAL, "row", "t", F.greatest("gyro_gate", "acc_gate").alias("x")).join(shaky.where("use_imu"), list(TRIAL))
    raw = raw.withColumn("__hz", p["lp_imu"]).unionByName(emg.select(*TRIAL, "row", "t", F.col("env_norm").alias("x")).join(shaky.where("NOT use_imu"), list(TRIAL)).withColumn("__hz", p["lp_emg"]))
    tremor = signals.tremor_gate(raw.select(*TRIAL, "row", "t", "x", "__hz"), "x", TRIAL, ("row",), cut_column="__hz").drop("x", "__hz").join(shaky, list(TRIAL))
    return g.select(*keys, "t", "gate"), tremor.select(*keys, "row", "t", "gate")


def detect_episodes(imu: DataFrame, emg: DataFrame, config: dict, curation: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(episodes, log) of all trials by their variants' detectors, with validity, pruning and count rules, numbered and curated.

    curation: subject, trial, action, k (and position), see episodes.curate().
    """
    trials = trials_of(imu, emg, config)
    calm, shaky = gates(imu, emg, trials, config)
    p = F.col("params")
    carry = ("params", "use_imu")
    gap = F.greatest(p["merge_gap_s"], p["secondary_merge_gap"], p["third_merge_gap"])
    a = episodes.detect_mad(calm, p["k_on"], p["k_off"], gap, p["pad_s"], 0.0, p["min_duration_s"], p["peak_multiplier"], p["adjust_rule"], carry=carry, keys=TRIAL)
    b = episodes.detect_tremor(shaky, p["k_on"], p["k_off"], p["merge_gap_s"], p["pad_s"], p["min_raw_s"], p["min_duration_s"], p["min_peak_gate"], _percentile(config), p["thr_off_multiplier"], order=("row",), carry=carry, keys=TRIAL)
    e = a.unionByName(b, allowMissingColumns=True).where(F.col("duration_s") >= p["min_valid_duration_s"]).where(F.coalesce(F.col("peak_gate") >= p["min_valid_peak_gate"], F.lit(True)))
    rule = p["prune"]
    ruled = F.coalesce(rule["task"] == p["task_key"], F.lit(False))
    e = episodes.prune(e.where(ruled), rule["min_duration_s"], rule["max_episodes"], rule["second_min_duration_s"], rule["second_min_peak"], TRIAL).unionByName(e.where(~ruled))
    rank = F.row_number().over(Window.partitionBy(*TRIAL).orderBy(F.desc("duration_s"), "t_on"))
    e = e.withColumn("__r", rank).where(F.coalesce(F.col("__r") <= p["max_episodes_per_trial"], F.lit(True)) & ~p["drop_all_episodes"]).drop("__r")
    e = episodes.numbered(e, TRIAL).select(
        *TRIAL, "episode_id", "t_on", "t_off", "duration_s", "thr_on", "thr_off", "peak_gate", p["task_key"].alias("task_type"), p["variant"].alias("variant"), F.when(F.col("use_imu"), "IMU").otherwise("EMG_fallback").alias("data_source")
    )
    e = tables.staged(e, "detected-episodes")  # the detectors run once for episodes and log
    figures = [F.count(F.lit(1)).alias("n_samples"), F.median("gate").alias("gate_median"), F.percentile("gate", 0.95).alias("gate_95p"), F.var_pop("gate").alias("gate_var")]
    log = calm.select(*TRIAL, "gate").unionByName(shaky.select(*TRIAL, "gate")).groupBy(*TRIAL).agg(*figures)
    log = trials.join(log, list(TRIAL), "left").join(e.groupBy(*TRIAL).agg(F.count(F.lit(1)).alias("n_episodes")), list(TRIAL), "left").withColumn("n_episodes", F.coalesce("n_episodes", F.lit(0)))
    return (e if curation is None else episodes.curate(e, curation)), log


def _percentile(config: dict) -> float:
    """The tremor variants' share of quiet samples; one value for all of them."""
    return float(config["variants"].get("tremor", {}).get("baseline_percentile", 15))


# --- 5: windows ---


def windows_of(found: DataFrame, emg: DataFrame, imu: DataFrame, length: float = 0.2, step: float = 0.1, context: float = 0.0, least_coverage: float = 0.6, longest_gap: float = 0.05) -> DataFrame:
    """Windows of all episodes with both modalities' rates, counts, gaps and flags."""
    w = windowing.make_windows(found, length, step, context).withColumn("context_used", F.lit(context > 0))
    return windowing.windows_of_both(w, emg, imu, length, least_coverage, longest_gap, TRIAL)


# --- 6 to 8: features, indicators, matrix ---


def window_features(samples: DataFrame, windows: DataFrame, x: str = "x", length: float = 0.2, step: float = 0.1) -> DataFrame:
    """Time-domain features of one value column, long form."""
    inside = windowing.samples_in_windows(samples, windows, length, step)
    return features.time_domain(inside, x, ("subject", "trial", "episode_id", "window_id", "sensor"))


def indicators(feature_table: DataFrame, envelopes: DataFrame, sensors: list[str], tasks: list[str], least: int = 200) -> tuple[DataFrame, DataFrame]:
    """(trial indicators, subject indicators); the trials' rows, which the subjects' are made of, are written once."""
    base = tables.staged(kpis.window_kpis(feature_table), "trial-windows")
    trials = base.join(kpis.envelope_kpis(envelopes, base.select(*TRIAL, "t_on", "t_off"), sensors, least_sensor=least, least_any=least), list(TRIAL), "left")
    trials = tables.staged(trials, "trial-indicators")
    return trials, kpis.subject_kpis(trials, tasks)


def mismatch_check(subjects: DataFrame, first: str = "ALS", second: str = "Healthy") -> DataFrame:
    """U, effect, p and means of the mismatch index and of both its sides between the groups."""
    names = ["kpi_NMD", "kpi_NMD_z_effort", "kpi_NMD_z_motion"]
    d = subjects.withColumn("__group", dims.group_of("subject"))
    m = lambda g: F.avg(F.when(F.col("__group") == g, F.col("value")))
    means = batteries.long_form(d, ["subject", "__group"], names).groupBy("measure").agg(m(first).alias("mean_first"), m(second).alias("mean_second"))
    return batteries.two_group_battery(d, "subject", "__group", names, first, second).join(means, "measure")


def matrix(subjects: DataFrame, columns: list[str], priorities: DataFrame, most: int = 20) -> DataFrame:
    """subject and the screened, selected columns, medians in place of gaps, standardised."""
    chosen = kpis.select_by_priority(kpis.screen(subjects, columns), priorities, most).orderBy("rank").select("feature")
    names = [r[0] for r in chosen.collect()]  # `most` rows
    return normalisation.standardise(normalisation.median_impute(subjects.select("subject", *names), names), names)


def subject_medians(window_table: DataFrame, columns: list[str]) -> DataFrame:
    return kpis.multi_stats(window_table, columns, ("subject", "sensor"))


def compare_groups(subjects: DataFrame, x: str, group: str, first: str, second: str) -> DataFrame:
    return mann_whitney(subjects.where(F.col(x).isNotNull()), x, group, first, second, ("sensor",))
