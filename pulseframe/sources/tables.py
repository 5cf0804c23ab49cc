"""Tables: scans with identity from file names, sinks, and configuration."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet with floating-point NaN as NULL."""
    df = spark.read.parquet(path)
    df = df.select(*columns) if columns else df
    return df.withColumns({f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema if f.dataType.simpleString() in ("double", "float")})


def read_by_file_name(spark: SparkSession, path: str, pattern: str, column: str = "subject") -> DataFrame:
    """All files of a glob with a column from their names; schemas may differ in columns."""
    return spark.read.option("mergeSchema", "true").parquet(path).withColumn(column, F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def write_by_subject(df: DataFrame, path: str, key: str = "subject") -> None:
    """Overwrites the partitions of the subjects at hand alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as a table below spark.checkpoint.dir, which all executors share; where that is unset, below a local folder, and only in local mode.

    What follows reads the table instead of planning and running all that led to it once for each use.  Not for struct
    columns: where two uses of one file read different fields of a struct, Spark 4.1 may take one's exchange for the
    other's (seen with gates that carried their parameters; right with spark.sql.exchange.reuse off).
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="pulseframe-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def load_yaml(path: str) -> dict:
    import yaml

    with open(path) as f:
        return yaml.safe_load(f)


def without(df: DataFrame, excluded: DataFrame, key: str = "subject") -> DataFrame:
    return df.join(excluded.select(key).distinct(), key, "left_anti")


def resolve_parameters(config: dict, subject: str, trial: str, has_imu: bool = True) -> dict:
    """One trial's detector parameters out of variants, their tasks and rules, and the subject's own settings.

    `config` has variants ({..., task_settings: {task: {...}, default: {...}}}) and subjects ({variant, overrides,
    trial_overrides: {trial: {...}}}).  The task is the first one whose name is in the trial's.  Rules are edits in a
    fixed order: least values for all tasks, trials without the device, trials without inertial data, weak signals;
    then the subject's overrides and those of just this trial.
    """
    own = config["subjects"][subject]
    variant, kind, name = own["variant"], config["variants"][own["variant"]], trial.lower()
    task = next((t for t in kind["task_settings"] if t != "default" and t in name), "default")
    settings = kind["task_settings"][task]
    p = {"variant": variant, "task_key": task, "use_imu": has_imu} | {k: kind[k] for k in ("k_on", "k_off", "pad_s", "min_valid_duration_s", "min_valid_peak_gate")} | {"merge_gap_s": settings["merge_gap_s"]}
    edits: list[tuple[str, dict]] = []
    if variant == "tremor":
        p |= {k: kind[k] for k in ("baseline_percentile", "thr_off_multiplier")}
        p |= {"min_duration_s": settings.get("min_duration_s", kind["default_min_duration_s"]), "min_peak_gate": kind["min_valid_peak_gate"]}
        p |= {"lp_imu": kind["gate_lp_imu_hz"], "lp_emg": kind["gate_lp_emg_hz"], "min_raw_s": kind["min_raw_episode_s"]}
    elif variant in ("standard", "standard_v1", "standard_als", "weak"):
        p |= {k: kind[k] for k in ("peak_multiplier", "secondary_merge_gap", "alpha_acc", "adjust_rule", "third_merge_gap")}
        p |= {"min_duration_s": settings["min_duration_s"], "smooth_kernel": kind.get("smooth_kernel", 1), "apply_tkeo": False}
        p |= {"lowvar_boost_imu": kind.get("lowvar_boost_imu"), "emg_lowvar_mode": kind.get("emg_lowvar_mode", "x5")}
        if kind.get("min_merge_gap_all_tasks") is not None:
            edits.append(("at least", {"merge_gap_s": kind["min_merge_gap_all_tasks"], "secondary_merge_gap": kind["min_secondary_gap_all_tasks"]}))
        if (r := kind.get("noexo_rule")) and "noexo" in name:
            edits += [("times", {"merge_gap_s": r["merge_gap_factor"], "min_duration_s": r["min_duration_factor"]}), ("at least", {"secondary_merge_gap": r["min_secondary_gap"]})]
        if (r := kind.get("emg_fallback")) and not has_imu:
            twice = 2 if r.get("double_min_duration_factor") else 1
            edits.append(("times", {"min_duration_s": r["min_duration_factor"] ** twice, "merge_gap_s": r["merge_gap_factor"]}))
            edits.append(("set", {k: r[k] for k in ("secondary_merge_gap", "k_on", "k_off", "peak_multiplier")}))
        if variant == "weak":
            r = kind["weak_settings"]
            edits.append(("times", {"min_duration_s": r["min_duration_factor"], "merge_gap_s": r["merge_gap_factor"]}))
            edits.append(("set", {k: r[k] for k in ("k_on", "k_off", "peak_multiplier", "secondary_merge_gap", "smooth_kernel", "min_valid_duration_s", "min_valid_peak_gate")}))
            edits.append(("set", {"apply_tkeo": not has_imu} | ({"alpha_acc": r["alpha_acc_boost"]} if has_imu else {})))
    else:
        raise ValueError(f"unknown variant {variant}")
    edits += [("set", own.get("overrides") or {}), ("set", (own.get("trial_overrides") or {}).get(trial, {}))]
    for how, values in edits:
        for k, v in values.items():
            p[k] = v if how == "set" else p[k] * v if how == "times" else max(p[k], v)
    return p


_NUMBERS = (
    "k_on", "k_off", "pad_s", "merge_gap_s", "secondary_merge_gap", "third_merge_gap", "min_duration_s", "peak_multiplier", "alpha_acc", "min_valid_duration_s", "min_valid_peak_gate", "min_peak_gate",
    "thr_off_multiplier", "lp_imu", "lp_emg", "min_raw_s", "max_episodes_per_trial",
)
_PRUNE = ("min_duration_s", "max_episodes", "second_min_duration_s", "second_min_peak")
_SCHEMA = (
    "variant string, task_key string, adjust_rule string, emg_lowvar_mode string, smooth_kernel int, apply_tkeo boolean, drop_all_episodes boolean, boost struct<var_threshold: double, factor: double>, prune struct<task: string, "
    + ", ".join(f"{k}: double" for k in _PRUNE) + ">, " + ", ".join(f"{k} double" for k in _NUMBERS)
)


def with_parameters(trials: DataFrame, config: dict) -> DataFrame:
    """subject, trial, use_imu -> adds params, a struct of resolve_parameters(): one small row a trial."""
    number = lambda v: None if v is None else float(v)

    def row(subject, trial, use_imu):
        p = resolve_parameters(config, subject, trial, use_imu)
        boost, prune = p.get("lowvar_boost_imu"), p.get("prune_rule")
        return {
            "variant": p["variant"], "task_key": p["task_key"], "adjust_rule": p.get("adjust_rule", "none"), "emg_lowvar_mode": p.get("emg_lowvar_mode", "x5"), "smooth_kernel": int(p.get("smooth_kernel", 1)),
            "apply_tkeo": bool(p.get("apply_tkeo")), "drop_all_episodes": bool(p.get("drop_all_episodes")), "boost": boost and {k: number(boost[k]) for k in ("var_threshold", "factor")},
            "prune": prune and {"task": prune.get("task"), **{k: number(prune[k]) for k in _PRUNE}}, **{k: number(p.get(k)) for k in _NUMBERS},
        }

    return trials.withColumn("params", F.udf(row, _SCHEMA)("subject", "trial", "use_imu"))


def smoothing_kernels(config: dict) -> list[int]:
    """All kernels that a configuration can name."""
    found = {1}
    for v in config["variants"].values():
        found |= {v.get("smooth_kernel", 1), v.get("weak_settings", {}).get("smooth_kernel", 1)}
    for s in config["subjects"].values():
        found |= {o["smooth_kernel"] for o in [s.get("overrides") or {}, *(s.get("trial_overrides") or {}).values()] if "smooth_kernel" in o}
    return sorted(found)


def analysis_subjects(config: dict) -> tuple[list[str], list[str]]:
    """(all subjects, those that are analysed) of {groups: {name: [subjects]}, excluded_from_analysis: [...] or {...}}."""
    every = [s for group in config["groups"].values() for s in group]
    return every, [s for s in every if s not in config.get("excluded_from_analysis", ())]


def raw_directory(spark: SparkSession, patterns: list[str]) -> str:
    """The first of some spellings of a folder (as Spark's globs) that holds files; FileNotFoundError if none does."""
    for p in patterns:
        try:
            if spark.read.format("binaryFile").load(p).drop("content").limit(1).count():
                return p
        except Exception as error:  # a path that is not there
            if "PATH_NOT_FOUND" not in str(error):
                raise
    raise FileNotFoundError(f"no files in any of {patterns}")
