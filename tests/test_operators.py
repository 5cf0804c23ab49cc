"""Closed-form values, properties and edge cases of the engine's operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.functions import dims
from pulseframe.operators import clustering, episodes, exact_tests, mixed_model, normalisation, signal_quality, signals, statistics, trees, windowing
from pulseframe.sources import exports, tables


def test_power_and_sample_size():
    got = [round(100 * exact_tests.mann_whitney_power(r, 14, 8), 1) for r in (0.867, 0.750, 0.617, 0.517, 0.3, 0.5, 0.7, 0.9)]
    assert got == [91.2, 81.8, 65.5, 50.6, 20.9, 48.1, 76.3, 93.1]
    assert [exact_tests.sample_size(r) for r in (0.3, 0.5, 0.7)] == [59, 22, 12]


def test_exact_p_values():
    assert exact_tests.mann_whitney_counts(2, 2).tolist() == [1, 1, 2, 1, 1]
    assert exact_tests.mann_whitney_p(0, 3, 3) == pytest.approx(0.1)
    assert exact_tests.wilcoxon_p(0, 5) == pytest.approx(0.0625)
    assert exact_tests.fisher_exact(8, 2, 1, 5)[1] == pytest.approx(0.0349650, abs=1e-6)
    assert exact_tests.chi2_sf(5.991464547, 2) == pytest.approx(0.05)
    w, p = exact_tests.shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert (round(w, 4), round(p, 4)) == (0.7888, 0.0067)


def test_stratified_sizes(spark):
    for n, want in ((300, 300), (5000, 5000), (5200, 5000)):
        d = spark.range(n).select(F.lit("a").alias("g"), F.col("id").alias("t"))
        assert normalisation.stratified_sample(d, ("g",)).count() == want


def test_filters_match_naive_recursion():
    rng = np.random.default_rng(1)
    x = rng.normal(size=700)
    b, a = signals.butterworth(4, 6.0, 148.0)
    assert b.sum() / a.sum() == pytest.approx(1)  # unit gain at 0 Hz
    z, want = np.zeros(4), []
    for v in x:
        y = b[0] * v + z[0]
        z = np.r_[z[1:], 0] + b[1:] * v - a[1:] * y
        want.append(y)
    assert np.allclose(signals.lfilter(b, a, x, np.zeros(4)), want)
    slow = np.sin(np.arange(3000) * 2 * np.pi / 1500)
    assert np.abs(signals.filtfilt(b, a, slow) - slow)[300:-300].max() < 1e-2
    assert np.isnan(signals.filtfilt(b, a, slow[:10])).all()
    t = np.arange(4096) / 1000
    assert signals.mean_frequency(np.sin(2 * np.pi * 100 * t), 1000) == pytest.approx(100, abs=2)
    assert signals.has_mains_peak(np.sin(2 * np.pi * 50 * t) + 0.01 * rng.normal(size=4096), 1000)


def two_bursts(spark):
    rng = np.random.default_rng(0)
    t = np.arange(0, 40, 1 / 148)
    g = 5 + 0.5 * rng.normal(size=len(t)) + 150 * (((t > 5) & (t < 12)) | ((t > 20) & (t < 28)))
    return spark.createDataFrame([("s", "x", float(a), float(b)) for a, b in zip(t, g)], "subject string, trial string, t double, gate double")


def test_two_burst_gate(spark):
    gate = two_bursts(spark)
    for found in (episodes.detect_mad(gate, 10.0, 5.0), episodes.detect_tremor(gate, 10.0, 5.0)):
        r = found.orderBy("t_on").collect()
        assert len(r) == 2
        assert abs(r[0]["t_on"] - 5) < 0.3 and abs(r[1]["t_off"] - 28) < 0.3
    assert episodes.detect_mad(gate.limit(10)).count() == 0


def test_hysteresis_against_recurrence(spark):
    rng = np.random.default_rng(3)
    for on, off in ((6, 3), (3, 6), (5, 5)):
        rows = [(k, float(i), float(v)) for k in range(8) for i, v in enumerate(rng.integers(0, 10, 60))]
        want = set()
        for k in range(8):
            open_at = None
            own = [(t, g) for s, t, g in rows if s == k]
            for t, g in own:
                if open_at is None:
                    open_at = t if g >= on else None
                elif g <= off:
                    want.add((k, open_at, t))
                    open_at = None
            if open_at is not None:
                want.add((k, open_at, own[-1][0]))
        d = spark.createDataFrame(rows, "k int, t double, gate double").withColumn("thr_on", F.lit(on)).withColumn("thr_off", F.lit(off))
        assert {tuple(r) for r in episodes.hysteresis(d, ("k",)).collect()} == want


def test_staged_merges_equal_the_largest(spark):
    rng = np.random.default_rng(5)
    rows = [(1, float(a), float(a + b)) for a, b in zip(np.cumsum(rng.integers(1, 9, 60)), rng.integers(0, 5, 60))]
    d = spark.createDataFrame(rows, "k int, t_on double, t_off double")
    staged = d
    for g in (1.0, 3.0, 2.0):
        staged = episodes.merge_close(staged, g, ("k",))
    key = lambda x: sorted(map(tuple, x.collect()))
    assert key(staged) == key(episodes.merge_close(d, 3.0, ("k",)))


def test_windows_and_range_join(spark):
    e = spark.createDataFrame([("s", "t", 1, 0.0, 1.0), ("s", "t", 2, 5.0, 5.1)], "subject string, trial string, episode_id int, t_on double, t_off double")
    w = windowing.make_windows(e, 0.25, 0.125)
    assert w.count() == 7
    samples = spark.createDataFrame([("s", "t", i / 64) for i in range(128)], "subject string, trial string, t double")
    got = windowing.samples_in_windows(samples, w.select("subject", "trial", "window_id", "t_start", "t_end"), 0.25, 0.125)
    assert all(r["count"] == 16 for r in got.groupBy("window_id").count().collect())


def test_quality_edges(spark):
    d = spark.createDataFrame([(1, float(i), v) for i, v in enumerate([1.0, 1.0, 1.0, None, 1.0, float("nan"), 2.0])], "k int, t double, x double")
    r = signal_quality.saturation(d, "x", 4, ("k",)).first()
    assert r["saturation_ratio"] == pytest.approx(0.8)  # missing values are left out, so four equal ones meet
    m = signal_quality.saturation_mask(d, "x", 3, ("k",)).orderBy("t").collect()
    assert [x["saturated"] for x in m] == [True, True, True, False, False, False, False]
    empty = d.where("k > 5")
    assert signal_quality.quality_report(empty, "x", 3, ("k",)).count() == 0
    even = spark.createDataFrame([(1, float(t)) for t in (0, 1, 2, 4, 7)], "k int, t double")
    assert signal_quality.sampling(even, ("k",)).first()["gaps"] == 0  # 3 is not over twice the median 1.5


def test_benjamini_hochberg_by_hand(spark):
    d = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, None, 0.005])], "i int, p double")
    got = {r["i"]: r["p_fdr"] for r in statistics.benjamini_hochberg(d, "p").collect()}
    assert got == {0: pytest.approx(0.02), 1: pytest.approx(0.04), 2: pytest.approx(0.04), 3: None, 4: pytest.approx(0.02)}


def test_random_intercept_recovers(spark):
    rng = np.random.default_rng(2)
    rows = [(s, g, float(2 + 1.5 * (g == "b") + u + 0.5 * rng.normal())) for s, u in enumerate(rng.normal(size=60)) for g in "ab" for _ in range(6)]
    d = spark.createDataFrame(rows, "s int, g string, y double")
    cols = mixed_model.design({"g": ("a", ["b"])})
    fit = mixed_model.fit_random_intercept(mixed_model.sufficient_statistics(d, "s", "y", cols), list(cols))
    assert fit.coef[1] == pytest.approx(1.5, abs=0.15) and fit.icc == pytest.approx(0.8, abs=0.1)
    ml = [mixed_model.fit_random_intercept(mixed_model.sufficient_statistics(d, "s", "y", c), list(c), False) for c in (cols, mixed_model.design({}))]
    assert mixed_model.likelihood_ratio(*ml)[2] < 1e-6


def test_shapley_adds_up():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 3))
    f = trees.Forest.grown(x, (x[:, 0] > 0).astype(int), 20)
    for row, v in zip(f.shapley(x[:4]), x[:4]):
        assert row.sum() == pytest.approx(f(v[None])[0] - f.value[f.roots].mean())


def test_ward_separates():
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(size=(5, 2)), rng.normal(size=(7, 2)) + 20]
    assert clustering.ward_labels(x, 2).tolist() == [1] * 5 + [2] * 7


EXPORT = "Trial,1\nBic (12), Tric (13),Bic (12)\n"


def export(kinds, rows):
    cells = []
    for k in kinds:
        if k in ("full", "emg"):
            cells += ["EMG 1 Time Series (s)", "EMG 1 (mV)"]
        if k in ("full", "imu"):
            for s in ("ACC", "GYRO"):
                for a in "XYZ":
                    cells += [f"{s} {a} Time Series (s)", f"{s} {a} (u)"]
    body = "\n".join(",".join(f"{i + j / 100}" for j in range(len(cells))) for i in range(rows))
    return EXPORT + ",".join(cells) + "\n" + body + "\n"


def test_exports(spark, tmp_path):
    (tmp_path / "a.csv").write_text(export(["full", "emg"], 4))
    (tmp_path / "b.csv").write_text(export(["imu"], 3))
    (tmp_path / "c.csv").write_text("nothing here")
    rows = exports.read_exports(spark, str(tmp_path))
    facts = {r["file"]: r for r in exports.file_facts(rows).collect()}
    assert facts["a.csv"]["layout"] == "mixed" and facts["a.csv"]["names"] == "Bic|Tric" and facts["a.csv"]["n_rows"] == 4
    assert facts["b.csv"]["layout"] == "imu_only" and facts["b.csv"]["name_source"] == "normalized_from_header"
    assert not facts["c.csv"]["mapping_ok"] and facts["c.csv"]["issue"]
    assert exports.emg_raw(rows).count() == 8 and exports.imu_raw(rows).count() == 7
    r = exports.imu_raw(rows).where("file = 'b.csv' AND row = 1").first()
    assert (r["t_imu"], r["acc_x_g"], r["gyro_z_dps"]) == (1.0, 1.01, 1.11)
    assert exports.anomalies(exports.file_facts(rows)).count() == 3
    assert exports.find_blocks(["EMG 1 Time Series", "x"]) == []


def test_sinks_and_parameters(spark, tmp_path):
    d = spark.createDataFrame([("a", 1.0), ("b", float("nan"))], "subject string, x double")
    tables.write_by_subject(d, str(tmp_path / "p"))
    tables.write_by_subject(d.where("subject = 'a'").withColumn("x", F.lit(5.0)), str(tmp_path / "p"))
    assert {(r["subject"], r["x"]) for r in tables.read_table(spark, str(tmp_path / "p")).collect()} == {("a", 5.0), ("b", None)}


def test_names(spark):
    d = spark.createDataFrame([(" Trap_Desc ",), ("Flessore  carpo",), ("New Name",)], "s string")
    assert [r[0] for r in d.select(dims.canon_name("s")).collect()] == ["Trapezius", "Flexor", "New Name"]
    e = spark.createDataFrame([("lifting_noexo",), ("drinking_EXO",), ("x",)], "s string")
    assert [r[0] for r in e.select(dims.condition_of("s")).collect()] == ["noexo", "exo", "unknown"]
    assert math.isclose(d.select(dims.magnitude(F.lit(3.0), F.lit(4.0), F.lit(0.0))).first()[0], 5.0)
