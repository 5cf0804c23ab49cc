"""Detector parameters, the detectors' golden cases and the phases end to end."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.operators import episodes, features, kpis, signals
from pulseframe.plans import phases
from pulseframe.sources import tables

from .test_operators import two_bursts

_TASKS = {
    "lifting": {"min_duration_s": 1.8, "merge_gap_s": 0.35}, "drinking": {"min_duration_s": 1.2, "merge_gap_s": 0.3},
    "pick&place": {"min_duration_s": 2.2, "merge_gap_s": 1.2}, "default": {"min_duration_s": 1.5, "merge_gap_s": 0.4},
}
_BASE = {"k_on": 5.0, "k_off": 3.5, "pad_s": 0.15, "peak_multiplier": 2.5, "secondary_merge_gap": 0.8, "alpha_acc": 1.0, "smooth_kernel": 1, "third_merge_gap": 1.2, "min_valid_duration_s": 2.0, "min_valid_peak_gate": 40.0, "task_settings": _TASKS}
_EMG = {"k_on": 2.0, "k_off": 1.0, "peak_multiplier": 1.2, "min_duration_factor": 0.6, "double_min_duration_factor": True, "merge_gap_factor": 2.0, "secondary_merge_gap": 3.5}
CONFIG = {
    "variants": {
        "standard": {**_BASE, "adjust_rule": "standard", "min_merge_gap_all_tasks": 2.0, "min_secondary_gap_all_tasks": 4.0, "emg_fallback": _EMG, "emg_lowvar_mode": "x5"},
        "standard_als": {
            **_BASE, "adjust_rule": "standard_als", "min_merge_gap_all_tasks": 1.2, "min_secondary_gap_all_tasks": 3.5, "noexo_rule": {"merge_gap_factor": 1.6, "min_secondary_gap": 4.0, "min_duration_factor": 0.75},
            "lowvar_boost_imu": {"var_threshold": 0.0001, "factor": 1.5}, "emg_fallback": {**_EMG, "double_min_duration_factor": False},
        },
        "weak": {
            **_BASE, "smooth_kernel": 5, "adjust_rule": "weak", "third_merge_gap": None, "min_merge_gap_all_tasks": None, "emg_lowvar_mode": "p95",
            "weak_settings": {"k_on": 2.8, "k_off": 1.5, "peak_multiplier": 1.4, "min_duration_factor": 0.65, "merge_gap_factor": 2.2, "secondary_merge_gap": 5.5, "alpha_acc_boost": 1.8, "smooth_kernel": 7, "min_valid_duration_s": 2.0, "min_valid_peak_gate": 35.0},
        },
        "tremor": {
            "k_on": 4.8, "k_off": 6.2, "pad_s": 0.15, "default_min_duration_s": 1.8, "baseline_percentile": 15, "thr_off_multiplier": 1.3, "min_raw_episode_s": 0.3, "gate_lp_imu_hz": 7.0, "gate_lp_emg_hz": 3.0,
            "min_valid_duration_s": 2.0, "min_valid_peak_gate": 28.0, "task_settings": {"drinking": {"merge_gap_s": 0.35}, "default": {"merge_gap_s": 0.45}},
        },
    },
    "subjects": {
        "Healthy_1": {"variant": "standard"}, "Healthy_6": {"variant": "standard", "overrides": {"max_episodes_per_trial": 1}}, "ALS_8": {"variant": "standard_als"}, "ALS_7": {"variant": "weak"},
        "ALS_12": {
            "variant": "tremor", "trial_overrides": {"pick&place_high_exo": {"k_on": 5.2, "k_off": 9.5, "merge_gap_s": 0.15}},
            "overrides": {"prune_rule": {"task": "lifting", "min_duration_s": 2.0, "max_episodes": 3, "second_min_duration_s": 2.5, "second_min_peak": 120.0}},
        },
    },
}


def test_parameters():
    r = lambda *a: tables.resolve_parameters(CONFIG, *a)
    p = r("ALS_12", "pick&place_high_exo", True)
    assert (p["variant"], p["k_on"], p["k_off"], p["merge_gap_s"]) == ("tremor", 5.2, 9.5, 0.15)
    p = r("ALS_12", "pick&place_high_noexo", True)  # an override is for just its trial
    assert (p["k_on"], p["merge_gap_s"], p["min_duration_s"], p["prune_rule"]["task"]) == (4.8, 0.45, 1.8, "lifting")
    p = r("Healthy_1", "drinking_exo", True)
    assert (p["merge_gap_s"], p["secondary_merge_gap"], p.get("max_episodes_per_trial"), p["min_duration_s"]) == (2.0, 4.0, None, 1.2)
    assert r("Healthy_6", "drinking_exo", True)["max_episodes_per_trial"] == 1
    p = r("Healthy_1", "Lifting_exo", False)  # the factor of the duration counts twice
    assert p["min_duration_s"] == pytest.approx(1.8 * 0.36) and (p["merge_gap_s"], p["secondary_merge_gap"], p["k_on"]) == (4.0, 3.5, 2.0)
    p = r("ALS_8", "lifting_noexo", True)
    assert p["merge_gap_s"] == pytest.approx(1.2 * 1.6) and p["min_duration_s"] == pytest.approx(1.35) and p["secondary_merge_gap"] == 4.0
    assert r("ALS_8", "lifting_exo", False)["min_duration_s"] == pytest.approx(1.08)
    p = r("ALS_7", "rest", False)
    assert (p["k_on"], p["smooth_kernel"], p["apply_tkeo"], p["alpha_acc"], p["min_valid_peak_gate"]) == (2.8, 7, True, 1.0, 35.0)
    assert r("ALS_7", "rest", True)["alpha_acc"] == 1.8 and p["merge_gap_s"] == pytest.approx(0.88)
    with pytest.raises(ValueError):
        tables.resolve_parameters({"variants": {"odd": _BASE}, "subjects": {"s": {"variant": "odd"}}}, "s", "x")
    assert tables.smoothing_kernels(CONFIG) == [1, 5, 7]
    every, used = tables.analysis_subjects({"groups": {"a": ["x", "y"], "b": ["z"]}, "excluded_from_analysis": {"y": "artefacts"}})
    assert (every, used) == (["x", "y", "z"], ["x", "z"])


def test_two_bursts_with_the_defaults(spark):
    gate = two_bursts(spark)
    e = episodes.detect_mad(gate, gap=(2.0, 4.0, 1.2)).orderBy("t_on").collect()
    assert len(e) == 2 and abs(e[0]["t_on"] - 5) < 0.3 and abs(e[1]["t_off"] - 28) < 0.3
    assert episodes.detect_tremor(gate).count() == 2
    g = np.array([r["gate"] for r in gate.collect()])
    quiet = g[g <= np.percentile(g, 15)]
    on = min(np.median(quiet) + 4.8 * np.median(np.abs(quiet - np.median(quiet))), np.median(g))
    assert episodes.tremor_thresholds(gate, keys=("subject", "trial")).first()["thr_on"] == pytest.approx(on)


def recordings(spark):
    """Inertial and muscle samples of five subjects; one trial of each has muscles alone."""
    rng = np.random.default_rng(7)
    imu, emg = [], []
    for s, subject in enumerate(CONFIG["subjects"]):
        for trial in ("lifting_exo", "pick&place_high_exo", "drinking_noexo"):
            bursts = np.sort(rng.uniform(2, 50, 4))
            for name, rows, hz in (("imu", imu, 20.0), ("emg", emg, 25.0)):
                if name == "imu" and trial == "drinking_noexo":
                    continue
                n = 0
                for sensor in ("a", "b", "c"):
                    t = np.arange(0, 60, 1 / hz)
                    g = 5 + np.abs(rng.normal(0, 1.5, len(t)))
                    for b in bursts:
                        g[(t > b) & (t < b + 4)] += rng.uniform(60, 200)
                    for k in range(len(t)):
                        rows.append((subject, trial, sensor, n, float(t[k]), float(g[k]), float(g[k] * rng.uniform(0.4, 0.9))))
                        n += 1
    schema = "subject string, trial string, sensor string, row long, t double, "
    return spark.createDataFrame(imu, schema + "gyro_gate double, acc_gate double"), spark.createDataFrame(emg, schema + "env_norm double, other double")


def by_hand(rows, p, use_imu):
    """Episodes of one trial by plain loops over its rows (sensor, row, t, first, second)."""
    rows = sorted(rows, key=lambda r: r["row"])
    if p["variant"] == "tremor":
        t = np.array([r["t"] for r in rows])
        x = np.array([max(r["gyro_gate"], r["acc_gate"]) if use_imu else r["env_norm"] for r in rows])
        g = signals.low_pass(x, 1 / np.diff(t).mean(), p["lp_imu"] if use_imu else p["lp_emg"], 2)
        quiet = g[g <= np.percentile(g, p["baseline_percentile"])]
        m = np.median(quiet)
        d = np.median(np.abs(quiet - m)) + 1e-12
        on, off, gap, peak, raw = min(m + p["k_on"] * d, np.median(g)), (m + p["k_off"] * d) * p["thr_off_multiplier"], p["merge_gap_s"], p["min_peak_gate"], p["min_raw_s"]
    else:
        bins: dict = {}
        for r in rows:
            bins.setdefault(int(np.rint(r["t"] / 0.001)), []).append(r)
        order = sorted(bins)
        t = np.array([np.mean([r["t"] for r in bins[k]]) for k in order])
        mid = lambda c: np.array([np.median([r[c] for r in bins[k]]) for k in order])
        g = np.maximum(mid("gyro_gate"), p["alpha_acc"] * mid("acc_gate")) if use_imu else mid("env_norm")
        k = int(p["smooth_kernel"])
        if k > 1:
            padded = np.pad(g, k // 2)
            g = np.array([np.median(padded[i : i + k]) for i in range(len(g))])
        if p["apply_tkeo"]:
            g = np.r_[g[0], g[1:-1] ** 2 - g[:-2] * g[2:], g[-1]]
        m = np.median(g)
        d, p95, k_on, k_off = np.median(np.abs(g - m)) + 1e-12, np.percentile(g, 95), p["k_on"], p["k_off"]
        on = m + k_on * d
        if p["adjust_rule"] == "standard" and on > p95:
            k_on = max(1.0, 0.7 * k_on)
        elif p["adjust_rule"] == "standard_als" and (on > 0.85 * p95 or p95 < 60):
            k_on, k_off = max(1.5, 0.55 * k_on), max(0.8, 0.6 * k_off)
        elif p["adjust_rule"] == "weak" and on > 1.1 * p95:
            k_on = max(1.2, 0.65 * k_on)
        on, off, peak, raw = m + k_on * d, m + k_off * d, m + p["peak_multiplier"] * d, 0.0
        gap = max(p["merge_gap_s"], p["secondary_merge_gap"], p["third_merge_gap"] or 0)
    found, start = [], None
    for a, v in zip(t, g):
        if start is None:
            start = a if v >= on else None
        elif v <= off:
            found.append((start, a))
            start = None
    if start is not None:
        found.append((start, t[-1]))
    merged: list = []
    for a, b in sorted((max(t[0], a - p["pad_s"]), min(t[-1], b + p["pad_s"])) for a, b in found if b - a >= raw):
        if merged and a - merged[-1][1] <= gap:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    e = [(a, b, g[(t >= a) & (t <= b)].max()) for a, b in merged if b - a >= p["min_duration_s"] and ((t >= a) & (t <= b)).any()]
    e = [x for x in e if x[2] >= peak and x[1] - x[0] >= p["min_valid_duration_s"] and (p["min_valid_peak_gate"] is None or x[2] >= p["min_valid_peak_gate"])]
    rule = p.get("prune_rule")
    if rule and rule["task"] == p["task_key"]:
        e = [x for x in e if x[1] - x[0] >= rule["min_duration_s"]]
        if len(e) > rule["max_episodes"]:
            e = sorted(e, key=lambda x: x[2])[1:]
        if len(e) >= rule["max_episodes"] and (e[1][1] - e[1][0] < rule["second_min_duration_s"] or e[1][2] < rule["second_min_peak"]):
            del e[1]
    if p.get("max_episodes_per_trial"):
        e = sorted(e, key=lambda x: x[1] - x[0])[-p["max_episodes_per_trial"] :]
    return sorted(e)


def test_episodes_of_all_variants(spark):
    imu, emg = recordings(spark)
    found, log = phases.detect_episodes(imu, emg, CONFIG)
    got: dict = {}
    for r in found.collect():
        got.setdefault((r["subject"], r["trial"]), []).append((r["t_on"], r["t_off"], r["peak_gate"], r["episode_id"]))
    trials: dict = {}
    for use, df in ((False, emg), (True, imu)):
        for r in df.collect():
            trials.setdefault((r["subject"], r["trial"], use), []).append(r)
    total = 0
    for subject, trial in {k[:2] for k in trials}:
        use = (subject, trial, True) in trials
        want = by_hand(trials[subject, trial, use], tables.resolve_parameters(CONFIG, subject, trial, use), use)
        have = sorted(got.get((subject, trial), []))
        assert [x[3] for x in have] == list(range(1, len(want) + 1)), (subject, trial)
        assert np.allclose([x[:3] for x in have], want), (subject, trial)
        total += len(want)
    assert total >= 15 and log.count() == 15 and log.agg(F.sum("n_episodes")).first()[0] == total
    rules = spark.createDataFrame([("Healthy_1", "LIFTING", "drop_all", None, 1), ("Healthy_1", "pick", "drop_kth", 1, 2), ("ALS_8", "exo", "drop_longest", None, 1), ("ALS_8", "exo", "drop_last", None, 2)], "subject string, trial string, action string, k int, position int")
    kept, _ = phases.detect_episodes(imu, emg, CONFIG, rules)
    want = {k: sorted(v) for k, v in got.items()}
    want.pop(("Healthy_1", "lifting_exo"), None)
    want.get(("Healthy_1", "pick&place_high_exo"), [()]).pop(0)
    for pick in (lambda e: e[2][1] - e[2][0], lambda e: e[2][0]):  # over all trials of the subject that match
        e = max(((k, i, x) for k, v in want.items() if k[0] == "ALS_8" and "exo" in k[1] for i, x in enumerate(v)), key=pick)
        want[e[0]].pop(e[1])
    assert sorted((r["subject"], r["trial"], r["t_on"]) for r in kept.collect()) == sorted((*k, x[0]) for k, v in want.items() for x in v)


def test_filters_with_repair(spark):
    rng = np.random.default_rng(3)
    t = np.arange(0, 4, 1 / 500)
    x = rng.normal(size=len(t))
    x[900:1000] = 0.25  # a long run of one value
    rows = [("s", trial, "m", float(a), float(b)) for trial in ("good", "stuck", "bad") for a, b in zip(t, x)]
    emg = spark.createDataFrame(rows, "subject string, trial string, sensor string, t double, emg_mv double")
    report = spark.createDataFrame([("s", "good", "m", 500.0), ("s", "stuck", "m", 500.0), ("s", "stuck", "m", 400.0)], "subject string, trial string, sensor string, emg_fs double")
    status = spark.createDataFrame([("s", "good", "OK"), ("s", "stuck", "FAIL"), ("s", "bad", "FAIL")], "subject string, trial string, status string")
    repaired = spark.createDataFrame([("s", "stuck")], "subject string, trial string")
    out, log = phases.preprocess_emg(emg, report, status, repaired, 1000.0, 50, 0.1)
    assert {(r["trial"], r["fs_emg_used"]) for r in log.collect()} == {("good", 500.0), ("stuck", 1000.0)}  # two rows of a report are no rate
    p = out.orderBy("trial", "t").toPandas()
    good, stuck = p[p.trial == "good"], p[p.trial == "stuck"]
    bp, env, _ = signals.emg_envelope(x, 500.0)
    assert np.allclose(good.emg_bp, bp) and np.allclose(good.env, env)
    lost = stuck.emg_bp.isna().to_numpy()
    assert lost[800:1100].all() and lost.sum() == 300 and (stuck.env.isna().to_numpy() == lost).all()  # 0.1 s are 100 samples at the rate used


def test_quality_status_and_windows(spark):
    rng = np.random.default_rng(1)
    emg, imu = [], []
    for trial in ("fine", "gap", "flat"):
        for k in range(400):
            at = k / 100 + (0.5 if trial == "gap" and k > 200 else 0)
            emg.append(("s", trial, "m", at, 1.0 if trial == "flat" else float(rng.normal()), 0.1))
            imu.append(("s", trial, "m", k / 100, *(float(v) for v in rng.normal(size=6))))
    e = spark.createDataFrame(emg, "subject string, trial string, sensor string, t double, emg_mv double, env_norm double")
    i = spark.createDataFrame(imu, "subject string, trial string, sensor string, t double, gyro_x_dps double, gyro_y_dps double, gyro_z_dps double, acc_x_g double, acc_y_g double, acc_z_g double")
    wide, status = phases.quality_of_recordings(e, i)
    assert {r["trial"]: r["status"] for r in status.collect()} == {"fine": "OK", "gap": "FAIL", "flat": "FAIL"}
    one = wide.where("trial = 'fine'").first()
    assert one["emg_n_samples"] == 400 and one["imu_acc_mag_fs"] == pytest.approx(100) and not one["imu_only_sensor"]
    found = spark.createDataFrame([("s", "fine", 1, 0.5, 2.0), ("s", "gap", 1, 1.5, 3.0)], "subject string, trial string, episode_id int, t_on double, t_off double")
    w = phases.windows_of(found, e, i, context=0.3)
    assert w.where("t_on = 0.5").agg(F.min("t_start"), F.max("t_end")).first() == pytest.approx((0.2, 2.3), abs=0.11)  # the interval stays, windows are padded
    w = phases.windows_of(found, e, i)
    assert w.where("trial = 'fine' AND emg_ok AND imu_ok").count() == w.where("trial = 'fine'").count() > 10
    assert w.where("trial = 'gap' AND NOT emg_ok").count() > 0
    moving = phases.with_magnitudes(i).withColumn("acc_dyn", F.col("acc_mag") - 1)
    f = features.window_features(features.valid_windows(w), e.withColumnRenamed("emg_mv", "emg_bp"), moving, ["m"], ["m"], ("m", "none"), 100.0, least_emg=8)
    r = f.where("trial = 'fine' AND window_id = 3").first()
    x = np.array([v[4] for v in emg if v[1] == "fine" and r["t_start"] <= v[3] < r["t_end"]])
    assert r["EMG_m_MAV"] == pytest.approx(np.abs(x).mean()) and r["EMG_m_RMS"] == pytest.approx(np.sqrt((x**2).mean())) and r["has_emg"] and r["has_imu"]
    assert r["IMU_m_gyro_mag_peak"] == r["IMU_all_gyro_mag_peak"] and r["IMU_m_jerk_norm_mean"] > 0
    report = features.feature_table_report(f, ["subject", "t_start"], ["nowhere"]).first()
    assert report["check_optional"] == "WARN" and report["check_window_length"] == "OK" and report["check_coact_coverage"] == "FAIL" and report["n_emg_target"] > 0
    trials, subjects = phases.indicators(f.withColumn("task_type", F.lit("lifting")), e, ["m"], ["lifting"], least=20)
    k = {r["trial"]: r for r in trials.collect()}
    assert k["fine"]["kpi_duration_s"] == pytest.approx(1.5) and k["fine"]["kpi_peak_envn_m"] == pytest.approx(0.1) and k["fine"]["kpi_iemg_envn_m"] == pytest.approx(0.15, abs=0.01)
    assert not k["fine"]["kpi_has_bictri_pair"] and subjects.first()["n_trials"] == 2


def test_mean_rank_and_quantiles_without_keys(spark):
    rng = np.random.default_rng(0)
    v = np.r_[rng.normal(size=300), np.round(rng.normal(size=200), 1), 0.0, 0.0, -1e-300, 1e300]
    d = spark.createDataFrame([(float(x),) for x in v], "x double")
    order = np.sort(v)
    for r in kpis.value_ranks(d, "x").collect():
        lo, hi = np.searchsorted(order, r["x"], "left"), np.searchsorted(order, r["x"], "right")
        assert (r["n"], r["rank"]) == (hi - lo, (lo + hi + 1) / 2)
    q = kpis.quantiles(d, "x", {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}).first()
    assert np.allclose([q[c] for c in "abcde"], np.quantile(v, [0, 0.25, 0.5, 0.9, 1.0]))
