"""python -m pulseframe PHASE... --root DIR [--config FILE] [--subjects NAME...]

Phases 0, 2, 2b, 3, 4, 5, 6, 7, 8, 9, 9:STEP and 10, or all.  Each reads tables below the root and writes its own there:

  0   exports/SUBJECT/*.csv -> emg_raw, imu_raw, facts, quality, status
  2   emg_raw, status -> emg_filtered, notch_log          2b  imu_raw, status -> imu_gates
  3   emg_filtered -> emg, scales                         4   imu_gates, emg -> episodes, episode_log
  5   episodes, emg, imu_gates -> windows, window_report  6   windows, emg, imu_gates -> features, feature_report
  7   features, emg -> trial_kpis, subject_kpis, redundant_pairs
  8   subject_kpis -> matrix, kpi_summary, heatmap        9   subject_kpis, trial_kpis, matrix, features -> statistics/STEP...
  10  matrix, or features -> folds, metrics, consistency, predictions, importances, shap

Every table that is written adds a row to run_log (name, n_rows, n_subjects, seconds).
The configuration (YAML) has phase4 (variants and subjects), curation (a list of rules), repairs ({subject: [trials]}),
groups and excluded_from_analysis, priorities ([[feature, priority], ...]), tasks, and for the statistics clusters
({columns, k, rounds}), range_bytes (exports are read by ranges of so many bytes instead of whole files), lmm ([measures]), posterior ({measure, task}) and phase10 ({muscles}: medians of their windows'
RMS in place of the matrix); all but phase4 may be absent.
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pulseframe.functions import dims
from pulseframe.operators import features, kpis, reports
from pulseframe.plans import phases, steps
from pulseframe.plans.steps import STEPS
from pulseframe.sources import export_source, exports, tables

ORDER = ("0", "2", "2b", "3", "4", "5", "6", "7", "8", "9", "10")
TASKS = ("drinking", "lifting", "pick&place", "default")


class Run:
    """One root folder, its tables and its configuration."""

    def __init__(self, spark: SparkSession, root: str, config: dict, subjects: list[str] | None = None) -> None:
        self.spark, self.root, self.config, self.subjects = spark, root.rstrip("/"), config, subjects

    def read(self, name: str) -> DataFrame:
        df = tables.read_table(self.spark, f"{self.root}/{name}")
        return df.where(F.col("subject").isin(self.subjects)) if self.subjects and "subject" in df.columns else df

    def write(self, df: DataFrame, name: str) -> None:
        """Writes a table and appends its rows, subjects and time to run_log; the figures are observed while it is written."""
        seen, began = Observation(), time.time()
        by_subject = "subject" in df.columns
        figures = [F.count(F.lit(1)).alias("n_rows"), *([F.approx_count_distinct("subject").alias("n_subjects")] if by_subject else [])]
        watched = df.observe(seen, *figures)
        if by_subject:
            tables.write_by_subject(watched, f"{self.root}/{name}")
        else:
            watched.write.mode("overwrite").parquet(f"{self.root}/{name}")
        got = seen.get
        row = (name, int(got["n_rows"]), int(got.get("n_subjects", 0)), time.time() - began)
        tables.append_log(self.spark.createDataFrame([row], "name string, n_rows long, n_subjects long, seconds double").coalesce(1), f"{self.root}/run_log")

    def repaired(self) -> DataFrame:
        rows = [(s, t) for s, trials in self.config.get("repairs", {}).items() for t in trials]
        return self.spark.createDataFrame(rows, "subject string, trial string")

    def curation(self) -> DataFrame | None:
        rules = [(r["subject"], r["trial"], r["action"], r.get("k"), i) for i, r in enumerate(self.config.get("curation", ()))]
        return self.spark.createDataFrame(rules, "subject string, trial string, action string, k int, position int") if rules else None

    def sensors(self, df: DataFrame) -> list[str]:
        """Canonical names that a table has (some tens)."""
        return sorted(r[0] for r in df.select("sensor").distinct().collect())


def _canonical(df: DataFrame) -> DataFrame:
    return df.withColumn("sensor", dims.safe_token(dims.canon_name("sensor")))


def phase_0(run: Run) -> None:
    where, size = f"{run.root}/exports/*/*.csv", run.config.get("range_bytes")
    rows = export_source.read_export_ranges(run.spark, where, int(size), folders=run.subjects) if size else exports.read_exports(run.spark, where)
    rows = rows.withColumn("subject", F.col("folder")).withColumn("trial", F.regexp_replace("file", r"\.csv$", ""))
    if run.subjects:
        rows = rows.where(F.col("subject").isin(run.subjects))
    axes = ["acc_x_g", "acc_y_g", "acc_z_g", "gyro_x_dps", "gyro_y_dps", "gyro_z_dps"]
    emg = rows.where("kind = 'emg'").select("subject", "trial", "sensor", "row", "t", "emg_mv")
    imu = rows.where("kind = 'imu'").select("subject", "trial", "sensor", "row", "t", *axes)
    facts = rows.where("kind = 'meta'").select("subject", "trial", "layout", "block_kinds", "names", "name_source", "name_issue", "n_sensors", "n_rows", "mapping_ok", "issue")
    for df, name in ((emg, "emg_raw"), (imu, "imu_raw"), (facts, "facts")):
        run.write(df, name)
    report, status = phases.quality_of_recordings(run.read("emg_raw"), run.read("imu_raw"))
    run.write(report, "quality")
    run.write(status, "status")


def phase_2(run: Run) -> None:
    out, log = phases.preprocess_emg(run.read("emg_raw"), run.read("quality"), run.read("status"), run.repaired())
    run.write(out, "emg_filtered")
    run.write(log, "notch_log")


def phase_2b(run: Run) -> None:
    run.write(phases.preprocess_imu(run.read("imu_raw"), run.read("quality"), run.read("status"), run.repaired()), "imu_gates")


def phase_3(run: Run) -> None:
    out, scales = phases.normalise_envelopes(run.read("emg_filtered"))
    run.write(out, "emg")
    run.write(scales, "scales")


def _rows(df: DataFrame) -> DataFrame:
    """Samples with a row number that follows the sensors' blocks."""
    from pyspark.sql import Window

    return df.withColumn("row", F.row_number().over(Window.partitionBy("subject", "trial").orderBy("sensor", "t")))


def phase_4(run: Run) -> None:
    found, log = phases.detect_episodes(_rows(run.read("imu_gates")), _rows(run.read("emg")), run.config["phase4"], run.curation())
    run.write(found, "episodes")
    run.write(log.drop("params"), "episode_log")


def phase_5(run: Run) -> None:
    run.write(phases.windows_of(run.read("episodes"), run.read("emg"), run.read("imu_gates")), "windows")
    run.write(reports.window_table_report(run.read("windows")), "window_report")


def phase_6(run: Run) -> None:
    emg, imu = _canonical(run.read("emg")), _canonical(run.read("imu_gates"))
    windows = features.valid_windows(run.read("windows"))
    run.write(features.window_features(windows, emg, imu, run.sensors(emg), run.sensors(imu)), "features")
    keys = ["subject", "trial", "episode_id", "window_id", "t_start", "t_end"]
    run.write(features.feature_table_report(run.read("features"), keys, ["task_type", "emg_ok", "imu_ok"]), "feature_report")


def phase_7(run: Run) -> None:
    emg = _canonical(run.read("emg"))
    trials, subjects = phases.indicators(run.read("features"), emg, run.sensors(emg), run.config.get("tasks", list(TASKS)))
    run.write(trials, "trial_kpis")
    run.write(subjects, "subject_kpis")
    s = run.read("subject_kpis")
    names = [c for c in s.columns if c.startswith("kpi_") and c.endswith("__median")]
    run.write(kpis.redundant_pairs(kpis.spearman_pairs(s, "subject", names)), "redundant_pairs")


def _analysed(run: Run, name: str) -> DataFrame:
    df, (_, kept) = run.read(name), tables.analysis_subjects(run.config) if "groups" in run.config else (None, None)
    return df.where(F.col("subject").isin(kept)) if kept else df


def phase_8(run: Run) -> None:
    s = _analysed(run, "subject_kpis")
    names = [c for c in s.columns if c.startswith("kpi_") and "__" in c]
    listed = run.config.get("priorities") or [(c, 1) for c in names]
    priorities = run.spark.createDataFrame([(f, int(p), i) for i, (f, p) in enumerate(listed)], "feature string, priority int, position int")
    run.write(phases.matrix(s, names, priorities), "matrix")
    run.write(steps.distribution_summary(s, names), "kpi_summary")
    run.write(steps.heatmap(s, names), "heatmap")


def phase_9(run: Run, step: str | None = None) -> None:
    inputs = steps.Inputs(lambda name: _analysed(run, name), run.config)
    for name in [step] if step else STEPS:
        for suffix, df in STEPS[name](inputs).items():
            run.write(df, f"statistics/{name}{suffix}")


def phase_10(run: Run) -> None:
    if run.config.get("phase10", {}).get("muscles"):
        m = steps.rms_matrix(_analysed(run, "features"), run.config["phase10"]["muscles"])
    else:
        m = _analysed(run, "matrix").withColumn("y", dims.label_of("subject"))
    for name, df in steps.models(m, [c for c in m.columns if c not in ("subject", "y")]).items():
        run.write(df, name)


PHASES = {"0": phase_0, "2": phase_2, "2b": phase_2b, "3": phase_3, "4": phase_4, "5": phase_5, "6": phase_6, "7": phase_7, "8": phase_8, "9": phase_9, "10": phase_10}


def main(args: list[str]) -> int:
    p = argparse.ArgumentParser(prog="pulseframe", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("phases", nargs="+")
    p.add_argument("--root", required=True)
    p.add_argument("--config")
    p.add_argument("--subjects", nargs="*")
    a = p.parse_args(args)
    wanted = list(ORDER) if a.phases == ["all"] else a.phases
    unknown = [x for x in wanted if x not in PHASES and not (x.startswith("9:") and x[2:] in STEPS)]
    if unknown:
        print(f"unknown phases {unknown}; phases are {', '.join(ORDER)}, and 9: with {', '.join(STEPS)}")
        return 2
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    run = Run(spark, a.root, tables.load_yaml(a.config) if a.config else {}, a.subjects)
    for x in wanted:
        if x.startswith("9:"):
            phase_9(run, x[2:])
        else:
            PHASES[x](run)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
