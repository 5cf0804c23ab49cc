"""The fused pass over windows against a loop over windows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.operators import features, signals, windowing
from pulseframe.operators.window_pass import autoregression, coverage, meet, overlap_figure, stacks


def loop_overlap(one, two, lo, hi):
    means = []
    for t, x in (one, two):
        d: dict = {}
        for a, b in zip(t, x):
            if lo <= a < hi and np.isfinite(b):
                d.setdefault(a, []).append(b)
        means.append({k: np.mean(v) for k, v in sorted(d.items())})
    u = np.unique([*means[0], *means[1]])
    if not all(means) or len(u) < 3:
        return np.nan
    grid = np.arange(u[0], u[-1] + 1e-12, np.median(np.diff(u)))
    if len(grid) < 3:
        return np.nan
    a, b = (np.maximum(np.interp(grid, list(d), list(d.values())), 0) for d in means)
    whole = np.trapezoid(np.maximum(a, b), grid)
    return np.trapezoid(np.minimum(a, b), grid) / whole if whole > 0 else np.nan


def loop_muscle(t, x, fs):
    d, sd = np.diff(x), np.nanstd(x)
    s = np.where(x >= 0, 1, -1)
    out = {"MAV": np.mean(np.abs(x)), "RMS": np.sqrt(np.mean(x**2)), "WL": np.abs(d).sum(), "WAMP": (np.abs(d) > max(50e-6, 0.01 * sd)).sum(), "ZC": ((s[1:] != s[:-1]) & (np.abs(d) > 0.01 * sd)).sum()}
    if np.isfinite(x).all():
        out |= {"MNF": signals.mean_frequency(x, fs), "MDF": signals.median_frequency(x, fs)}
        c = x - x.mean()
        r = np.array([(c[k:] * c[: len(c) - k]).sum() for k in range(5)])
        a = np.linalg.solve(r[np.abs(np.arange(4)[:, None] - np.arange(4))], r[1:])
        out |= {f"AR{k + 1}": a[k] for k in range(4)}
    return out


def test_fused_features_equal_a_loop(spark):
    rng = np.random.default_rng(4)
    emg, imu = [], []
    for trial, rate in (("a", 400.0), ("b", 250.0)):
        for m in ("Biceps", "Triceps"):
            t = np.sort(rng.uniform(0, 9, int(9 * rate)))
            x = rng.normal(size=len(t))
            if m == "Biceps":
                x[500] = np.nan
            emg += [("s", trial, m, float(a), None if np.isnan(b) else float(b), float(abs(rng.normal()))) for a, b in zip(t, x)]
        for m in ("wrist", "elbow"):
            t = np.sort(rng.uniform(0, 8, 700))
            imu += [("s", trial, m, float(a), *map(float, rng.normal(size=6))) for a in t]
    axes = ("gyro_mag", "acc_mag", "acc_dyn", "acc_x_g", "acc_y_g", "acc_z_g")
    e = spark.createDataFrame(emg, "subject string, trial string, sensor string, t double, emg_bp double, env_norm double")
    i = spark.createDataFrame(imu, "subject string, trial string, sensor string, t double, " + ", ".join(f"{c} double" for c in axes))
    found = spark.createDataFrame([("s", "a", 1, 0.35, 6.2), ("s", "b", 1, 1.0, 3.0), ("s", "b", 2, 7.0, 12.0), ("s", "none", 1, 0.0, 1.0)], "subject string, trial string, episode_id int, t_on double, t_off double")
    w = windowing.windows_of_both(windowing.make_windows(found), e, i, span=1.0)
    f = features.window_features(w, e, i, ["Biceps", "Triceps"], ["wrist", "elbow"], span=0.7)
    rows = f.collect()
    assert len(rows) == w.count() and f.where("trial = 'none' AND NOT has_emg AND NOT has_imu AND emg_n = 0").count() == 9
    one = lambda table, trial, m: np.array([[np.nan if v is None else v for v in r[3:]] for r in table if r[1] == trial and r[2] == m]).T
    seen = 0
    for r in rows:
        if r["trial"] == "none":
            continue
        lo, hi, env, effort = r["t_start"], r["t_end"], {}, 0.0
        for m in ("Biceps", "Triceps"):
            t, x, env_norm = one(emg, r["trial"], m)
            env[m] = (t, env_norm)
            at = (t >= lo) & (t < hi)
            if at.sum() < 32:
                assert r[f"EMG_{m}_MAV"] is None
                continue
            for c, v in loop_muscle(t[at], x[at], r["fs_emg_est"]).items():
                assert r[f"EMG_{m}_{c}"] == pytest.approx(v, rel=1e-9) if np.isfinite(v) else r[f"EMG_{m}_{c}"] is None, (m, c)
            effort += np.nan_to_num(np.abs(x[at]).mean())
            seen += 1
        assert (r["EMG_global_effort_MAV_sum"] or 0.0) == pytest.approx(effort)
        v = loop_overlap(env["Biceps"], env["Triceps"], lo, hi)
        assert r["EMG_CoAct_Bic_Tri"] == pytest.approx(v) if np.isfinite(v) else r["EMG_CoAct_Bic_Tri"] is None
        for m in ("wrist", "elbow"):
            d = one(imu, r["trial"], m)
            d = d[:, (d[0] >= lo) & (d[0] < hi)]
            if d.shape[1] >= 8:
                dt = np.median(np.diff(d[0]))
                assert r[f"IMU_{m}_jerk_norm_mean"] == pytest.approx(np.sqrt((np.diff(d[4:], axis=1) ** 2).sum(0)).mean() / dt)
                assert r[f"IMU_{m}_acc_dyn_std"] == pytest.approx(d[3].std(ddof=1)) and r[f"IMU_{m}_gyro_mag_peak"] == pytest.approx(d[1].max())
        times = np.concatenate([one(imu, r["trial"], m)[0] for m in ("wrist", "elbow")])
        assert r["imu_n"] == ((times >= lo) & (times < hi)).sum()
    assert seen > 100 and f.where("EMG_Biceps_MAV IS NULL AND EMG_Biceps_WAMP IS NOT NULL").count() >= 1  # of a missing sample


def test_few_exchanges(spark):
    e = spark.createDataFrame([], "subject string, trial string, sensor string, t double, emg_bp double, env_norm double")
    i = spark.createDataFrame([], "subject string, trial string, sensor string, t double, gyro_mag double, acc_mag double, acc_dyn double, acc_x_g double, acc_y_g double, acc_z_g double")
    found = spark.createDataFrame([], "subject string, trial string, episode_id int, t_on double, t_off double")
    f = features.window_features(windowing.windows_of_both(windowing.make_windows(found), e, i), e, i, ["m"], ["m"])
    assert f._jdf.queryExecution().executedPlan().toString().count("Exchange ") <= 6 and f.withColumn("x", F.lit(1)).count() == 0


def test_ranges_and_singular_windows():
    lo, hi = np.array([0, 2, 2, 5]), np.array([3, 5, 2, 9])
    assert sorted((int(k), at.tolist()) for own, places in stacks(lo, hi) for k, at in zip(own, places)) == [(0, [0, 1, 2]), (1, [2, 3, 4]), (3, [5, 6, 7, 8])]
    a = autoregression(np.stack([np.ones(40), np.sin(np.arange(40)), np.r_[np.zeros(20), np.ones(20)]]))
    assert np.isnan(a[0]).all() and np.isfinite(a[1:]).all()
    t = np.arange(10.0)
    assert overlap_figure((t, t * 0 + 2), (t + 0.5, t * 0 + 1), np.array([0.0]), np.array([9.0]))[0] == pytest.approx(0.5)


def test_many_stretches_at_once(spark):
    """One call works on many stretches, a stretch never is in two calls, and times far apart in value keep their steps."""
    from pyspark.sql import types as T

    rows = [(f"s{k}" if k else None, 1, 2e6 + j * 0.25 + k * 1e-6) for k in range(60) for j in range(40)]
    samples = spark.createDataFrame(rows, "subject string, trial int, t double")
    windows = windowing.make_windows(samples.groupBy("subject", "trial").agg(F.lit(1).alias("episode_id"), F.min("t").alias("t_on"), F.max("t").alias("t_off")), 2.0, 1.0)
    fields = [T.StructField(c, k) for c, k in (("n", T.LongType()), ("n_rows", T.LongType()), ("max_gap_s", T.DoubleType()), ("call", T.DoubleType()))]

    def figures(s, start, end, _):
        import random

        return coverage(s["t"], start, end) | {"call": np.full(len(start), random.SystemRandom().random())}

    got = meet(samples, windows, figures, fields, 2.0, span=3.0).collect()
    assert len(got) == windows.count() == 60 * 8 and len({r["call"] for r in got}) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    times = {k: np.array([r[2] for r in rows if r[0] == k]) for k in {r[0] for r in rows}}
    for r in got:
        t = times[r["subject"]]
        t = t[(t >= r["t_start"]) & (t < r["t_end"])]
        assert (r["n"], r["n_rows"], r["max_gap_s"]) == (len(t), len(t), np.diff(t).max())
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(batch, 16)  # stretches go on from one batch to the next
    try:
        few = meet(samples, windows, figures, fields, 2.0, span=3.0, at_once=7).collect()
    finally:
        spark.conf.unset(batch)
    plain = lambda found: sorted((str(r["subject"]), r["window_id"], r["n"], r["max_gap_s"]) for r in found)
    assert plain(few) == plain(got) and len({r["call"] for r in few}) > 60
