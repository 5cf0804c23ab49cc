"""All phases from vendor exports to predictions, through the command line's own functions."""

import numpy as np

from pulseframe import __main__ as cli

from .test_phases import CONFIG


def export(rng, ill: bool) -> str:
    """Fourteen seconds of two sensors with two movements."""
    sensors, axes = ("Biceps", "Triceps"), ("ACC X", "ACC Y", "ACC Z", "GYRO X", "GYRO Y", "GYRO Z")
    t, ti = np.arange(0, 14, 1 / 200), np.arange(0, 14, 1 / 50)
    moving = lambda x: ((x > 2) & (x < 5.5)) | ((x > 8) & (x < 12))
    header, columns = [], []
    for _ in sensors:
        header += ["EMG 1 Time Series (s)", "EMG 1 (mV)"]
        columns += [t, rng.normal(0, 1, len(t)) * (0.05 + (0.6 if ill else 0.3) * moving(t))]
        for a in axes:
            header += [f"{a} Time Series (s)", f"{a} (u)"]
            columns += [ti, rng.normal(0, 1, len(ti)) + (120 if a[0] == "G" else 1) * moving(ti) + (a == "ACC Z")]
    lines = ["Application,Discover", "", ", ".join(f"{s} (7{i})" for i, s in enumerate(sensors)), ",".join(header)]
    lines += [",".join(f"{c[k]:.7g}" if k < len(c) else "" for c in columns) for k in range(len(t))]
    return "\r\n".join([*lines, ",".join(["9"] * 90), "not,a,number"])


def test_phases_from_exports_to_windows(spark, tmp_path):
    rng = np.random.default_rng(0)
    subjects = ["ALS_Subject_0", "Healthy_Subject_0"]
    for s in subjects:
        folder = tmp_path / "exports" / s
        folder.mkdir(parents=True)
        (folder / "lifting_exo.csv").write_bytes(export(rng, s[0] == "A").encode())
    (folder / "broken.csv").write_text("nothing here")
    phase4 = {"variants": CONFIG["variants"], "subjects": {s: {"variant": "standard"} for s in subjects}}
    run = cli.Run(spark, str(tmp_path), {"phase4": phase4, "repairs": {subjects[0]: ["lifting_exo"]}, "range_bytes": 100_000})
    for name in ("0", "2", "2b", "3", "4", "5"):
        cli.PHASES[name](run)
    facts = {(r["subject"], r["trial"]): r for r in run.read("facts").collect()}
    assert facts[subjects[1], "broken"]["issue"] and facts[subjects[0], "lifting_exo"]["names"] == "Biceps|Triceps" and facts[subjects[0], "lifting_exo"]["name_issue"] == ""
    assert run.read("emg_raw").count() == 2 * 2 * 2800 and run.read("imu_raw").count() == 2 * 2 * 700
    assert {r["status"] for r in run.read("status").collect()} == {"OK"}
    e = run.read("episodes")
    assert e.count() == 2 and e.where("abs(duration_s - 10.3) > 0.6").count() == 0  # gaps of 2.5 s are below the least gap
    assert run.read("windows").where("emg_ok AND imu_ok").count() > 150


def test_matrix_and_models_of_given_indicators(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(f"{g}_{k}", float((g == "ALS") * 3 + rng.normal()), float(rng.normal()), None if k == 2 else float(k)) for g in ("ALS", "Healthy") for k in range(5)]
    config = {"groups": {"ALS": [r[0] for r in rows[:5]], "Healthy": [r[0] for r in rows[5:]]}, "excluded_from_analysis": {"ALS_4": "artefacts"}, "priorities": [["kpi_a__median", 1], ["kpi_b__median", 2], ["kpi_none", 1]]}
    run = cli.Run(spark, str(tmp_path), config)
    run.write(spark.createDataFrame(rows, "subject string, kpi_a__median double, kpi_b__median double, kpi_c__median double"), "subject_kpis")
    for name in ("8", "10"):
        cli.PHASES[name](run)
    cli.phase_9(run, "groups")
    assert {r["model"] for r in run.read("metrics").collect()} == {"logistic", "svm_rbf", "forest"} and run.read("importances").count() == 2 and run.read("shap").count() == 18
    assert run.read("kpi_summary").where("feature = 'kpi_a__median'").first()["ratio"] is not None and run.read("heatmap").count() == 27
    m = run.read("matrix")
    assert set(m.columns) == {"subject", "kpi_a__median", "kpi_b__median"} and m.count() == 9
    assert run.read("folds").count() == 27 and run.read("folds").where("correct").count() >= 15 and run.read("predictions").count() == 9
    assert run.read("statistics/groups").where("measure = 'kpi_a__median'").first()["rank_biserial"] < -0.5
    assert cli.main(["11", "--root", str(tmp_path)]) == 2 and cli.main(["9:nothing", "--root", str(tmp_path)]) == 2


def test_every_step_of_the_statistics(spark, tmp_path):
    rng = np.random.default_rng(2)
    subjects = [f"{g}_{k}" for g in ("ALS", "Healthy") for k in range(6)]
    sick = {s: s[0] == "A" for s in subjects}
    s_rows = [(s, float(2 * sick[s] + rng.normal()), float(rng.normal()), float(rng.normal()), float(rng.normal())) for s in subjects]
    t_rows = [(s, f"{t}_{c}_{k}", float(np.exp(0.5 * sick[s] - 0.3 * (c == "exo") * sick[s] + 0.2 * rng.normal())), float(rng.normal()), 1.0 + k) for s in subjects for t in ("drinking", "lifting", "pick_place") for c in ("noexo", "exo") for k in range(2)]
    f_rows = [(r[0], r[1], *map(float, np.exp(rng.normal(size=4) + [0.8 * sick[r[0]], 0, 0, 0]))) for r in t_rows]
    run = cli.Run(spark, str(tmp_path), {"clusters": {"k": [2], "rounds": 20}, "phase10": {"muscles": ["Extensor", "Biceps", "none"]}})
    run.write(spark.createDataFrame(s_rows, "subject string, kpi_a__median double, kpi_b__median double, `kpi_abs_rms_distal__median` double, kpi_peak_gyro_mag__median double").selectExpr("*", "kpi_a__median AS kpi_NMD", "kpi_b__median AS kpi_NMD_z_effort", "kpi_b__median AS kpi_NMD_z_motion"), "subject_kpis")
    run.write(spark.createDataFrame(t_rows, "subject string, trial string, kpi_abs_rms_mean double, kpi_other double, t_on double"), "trial_kpis")
    run.write(spark.createDataFrame(f_rows, "subject string, trial string, EMG_Extensor_RMS double, EMG_Flexor_RMS double, EMG_Biceps_RMS double, EMG_Triceps_RMS double"), "features")
    run.write(run.read("subject_kpis").select("subject", "kpi_a__median", "kpi_b__median"), "matrix")
    cli.phase_9(run)
    got = lambda name: run.read(f"statistics/{name}")
    assert got("setup").count() == 12 and got("setup_groups").where("n_subjects = 6 AND n_trials = 72").count() == 2
    assert got("normality").count() == 8 and got("normality_power").where("power BETWEEN 0 AND 1").count() == 4
    assert got("descriptive").count() == 12 and got("pertask").count() == 6 and got("pertask_friedman").count() == 2
    assert got("groups_power_curve").count() == 4 * 58 and got("groups_intervals").where("lo <= median AND median <= hi AND n = 6").count() == 8
    assert got("exo").count() == 6 and got("mismatch").count() == 3
    assert got("clusters").count() == 12 and got("clusters_dendrogram").count() == 11 and got("clusters_jaccard").count() == 2 and got("clusters_members").count() == 12
    assert got("association").where("p BETWEEN 0 AND 1 AND rounds = 10000").count() == 1
    fixed = {r["name"]: r for r in got("lmm").collect()}
    assert fixed["grp[ALS]"]["coef"] > 0.2 and fixed["grp[ALS]:condition[exo]"]["coef"] < 0 and got("lmm_fit").first()["df"] == 3
    closed = got("gap").where("measure = 'kpi_abs_rms_mean'")
    assert closed.count() == 3 and closed.where("pct_closed > 0").count() == 3 and got("gap_tests").count() == 12
    assert got("selectivity").first()["fold_a"] > 1 and got("selectivity_outside").count() == 12
    assert got("posterior").first()["mean"] < 0
    cli.phase_10(run)
    log = {r["name"]: r for r in run.read("run_log").collect()}
    assert log["statistics/clusters"]["n_rows"] == log["statistics/clusters"]["n_subjects"] == 12 and log["statistics/gap"]["n_rows"] == 6 and log["metrics"]["n_rows"] == 3
    assert run.read("folds").count() == 36 and run.read("importances").count() == 2
