"""The steps of phases 9 and 10: from tables of subjects, trials and window features to tables of results.

Every step takes an Inputs and returns {suffix: DataFrame}; '' is the step's main table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseframe.functions import dims
from pulseframe.operators import batteries, clustering, exact_tests, kpis, linkage, mixed_model, resampling, statistics, supervised, trees
from pulseframe.plans import phases

PATIENTS, HEALTHY = "ALS", "Healthy"
WITHOUT, WITH = "noexo", "exo"


@dataclass
class Inputs:
    """Tables are read when a step asks for them; config may have clusters ({columns, k, rounds}), lmm, posterior ({measure, task}), muscles."""

    read: Callable[[str], DataFrame]
    config: dict = field(default_factory=dict)

    @property
    def subjects(self) -> DataFrame:
        return self.read("subject_kpis").withColumn("grp", dims.group_of("subject"))

    @property
    def trials(self) -> DataFrame:
        return _sided(self.read("trial_kpis"))

    def medians(self) -> list[str]:
        return [c for c in self.subjects.columns if c.startswith("kpi_") and c.endswith("__median")]

    def measures(self) -> list[str]:
        return [f.name for f in self.trials.schema if f.name.startswith("kpi_") and f.dataType.simpleString() == "double"]


def _sided(df: DataFrame) -> DataFrame:
    return df.withColumn("grp", dims.group_of("subject")).withColumn("condition", dims.condition_of("trial")).withColumn("task", dims.task_of("trial"))


def _by_task(i: Inputs, measures: list[str]) -> DataFrame:
    """Medians of each subject, task and condition."""
    return i.trials.groupBy("subject", "grp", "task", "condition").agg(*[F.median(c).alias(c) for c in measures])


def setup(i: Inputs) -> dict[str, DataFrame]:
    """Subjects, trials and conditions that the statistics have."""
    t = i.trials
    per = t.groupBy("subject", "grp").agg(F.count(F.lit(1)).alias("n_trials"), F.count_distinct("task").alias("n_tasks"), *[F.count_if(F.col("condition") == c).alias(f"n_{c}") for c in (WITHOUT, WITH)])
    return {"": per, "_groups": per.groupBy("grp").agg(F.count(F.lit(1)).alias("n_subjects"), F.sum("n_trials").alias("n_trials"))}


def normality(i: Inputs) -> dict[str, DataFrame]:
    """Shapiro-Wilk of each measure and group, and the power of the group test at the effect that was seen."""
    names = i.medians()
    seen = batteries.two_group_battery(i.subjects, "subject", "grp", names, PATIENTS, HEALTHY)
    return {"": batteries.shape_battery(i.subjects, "subject", "grp", names), "_power": with_power(seen.select("measure", "n1", "n2", "rank_biserial"))}


@F.pandas_udf(T.StructType([T.StructField("power", T.DoubleType()), T.StructField("n_for_80", T.IntegerType())]))
def _power(r: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.DataFrame:
    rows = [(exact_tests.mann_whitney_power(a, b, c), exact_tests.sample_size(a)) if pd.notna(a) else (None, None) for a, b, c in zip(r, n1, n2)]
    return pd.DataFrame(rows, columns=["power", "n_for_80"]).astype({"power": float, "n_for_80": "Int32"})


def with_power(effects: DataFrame, r: str = "rank_biserial") -> DataFrame:
    """effects with the power at their group sizes n1 and n2, and the equal size that would reach 80 %."""
    return effects.withColumn("__p", _power(F.col(r).cast("double"), F.col("n1").cast("long"), F.col("n2").cast("long"))).select("*", "__p.*").drop("__p")


def power_curve(effects: DataFrame, largest: int = 60, r: str = "rank_biserial") -> DataFrame:
    """measure, n, power: what equal groups of 3 to `largest` would have at each effect (the figure's table)."""
    d = effects.select("measure", r, F.explode(F.sequence(F.lit(3), F.lit(largest))).alias("n")).withColumns({"n1": F.col("n"), "n2": F.col("n")})
    return with_power(d, r).select("measure", "n", "power")


def descriptive(i: Inputs) -> dict[str, DataFrame]:
    """Descriptives of each group and all, with a label of the shape."""
    s, out = i.subjects, None
    for c in i.medians():
        part = statistics.describe(s, c, "grp").withColumn("kpi", F.lit(c))
        out = part if out is None else out.unionByName(part)
    return {"": out.withColumn("shape", dims.shape_label("skew", "kurt"))} if out is not None else {}


def per_task(i: Inputs) -> dict[str, DataFrame]:
    """Group tests of each task without aid, and Friedman's test over tasks of each measure."""
    d, tasks = _by_task(i, i.measures()).where(F.col("condition") == WITHOUT), ["drinking", "lifting", "pick_place"]
    out = None
    for c in i.measures():
        part = statistics.friedman(d, "subject", "task", c, tasks).withColumn("measure", F.lit(c))
        out = part if out is None else out.unionByName(part)
    tests = batteries.two_group_battery(d, "subject", "grp", i.measures(), PATIENTS, HEALTHY, ("task",))
    return {"": tests} if out is None else {"": tests, "_friedman": out}


def groups(i: Inputs) -> dict[str, DataFrame]:
    """Group tests of every indicator, the curve of power at their effects, and bootstrap intervals of the medians."""
    tests = batteries.two_group_battery(i.subjects, "subject", "grp", i.medians(), PATIENTS, HEALTHY)
    long = batteries.long_form(i.subjects, ["subject", "grp"], i.medians())
    return {"": tests, "_power_curve": power_curve(tests), "_intervals": resampling.bootstrap_median_places(long, "value", ("measure", "grp"))}


def exo(i: Inputs) -> dict[str, DataFrame]:
    """Paired tests of both conditions in each task."""
    return {"": batteries.paired_battery(i.trials, "subject", "condition", i.measures(), WITHOUT, WITH, ("task",))}


def mismatch(i: Inputs) -> dict[str, DataFrame]:
    return {"": phases.mismatch_check(i.read("subject_kpis"))}


def _cluster_matrix(i: Inputs) -> tuple[DataFrame, list[str], list[int], int]:
    m, own = i.read("matrix"), i.config.get("clusters", {})
    return m, own.get("columns") or [c for c in m.columns if c != "subject"], list(own.get("k", (2, 3))), int(own.get("rounds", 1000))


def clusters(i: Inputs) -> dict[str, DataFrame]:
    """Ward's tree, its cuts, and the stability of each cut under resampling."""
    m, columns, ks, rounds = _cluster_matrix(i)
    cut = linkage.cut_table(m, "subject", columns, ks)
    out = {"": cut, "_dendrogram": linkage.merge_table(m, "subject", columns)}
    jaccard = members = None
    for k in ks:
        own = cut.where(F.col("n_clusters") == k).select("subject", "cluster")
        labels = clustering.bootstrap_ward(m, "subject", columns, k, rounds)
        a = clustering.best_jaccard(own, labels, "subject").withColumn("n_clusters", F.lit(k))
        b = clustering.member_stability(clustering.co_occurrence(labels, "subject"), own, "subject").withColumn("n_clusters", F.lit(k))
        jaccard, members = (a, b) if jaccard is None else (jaccard.unionByName(a), members.unionByName(b))
    return out if jaccard is None else out | {"_jaccard": jaccard, "_members": members}


def association(i: Inputs) -> dict[str, DataFrame]:
    """Chi-square, V and the permutation p of cluster and group, for each number of clusters."""
    m, columns, ks, _ = _cluster_matrix(i)
    cut, out = linkage.cut_table(m, "subject", columns, ks).withColumn("grp", dims.group_of("subject")), None
    for k in ks:
        d = cut.where(F.col("n_clusters") == k)
        p = resampling.permutation_from_margins(d, "cluster", "grp")
        part = statistics.association(d, "cluster", "grp").crossJoin(F.broadcast(p)).withColumn("n_clusters", F.lit(k))  # one row each
        out = part if out is None else out.unionByName(part)
    return {"": out} if out is not None else {}


def lmm(i: Inputs) -> dict[str, DataFrame]:
    """Random-intercept model of the logarithm of measures on group, task, condition and the group's interactions, over subject x task x condition."""
    names = i.config.get("lmm") or [c for c in i.measures() if c.startswith("kpi_abs_rms")]
    d = _by_task(i, names).where(F.col("grp").isin(PATIENTS, HEALTHY) & F.col("condition").isin(WITHOUT, WITH))
    tasks = sorted(r[0] for r in d.select("task").distinct().collect())  # four at most
    if len(tasks) < 2:
        return {}
    factors = {"grp": (HEALTHY, [PATIENTS]), "task": (tasks[0], tasks[1:]), "condition": (WITHOUT, [WITH])}
    full, plain = mixed_model.design(factors, [("grp", "task"), ("grp", "condition")]), mixed_model.design(factors)
    rows, fits = [], []
    for c in names:
        y = d.withColumn("__y", F.ln(F.col(c) + 1e-8))
        fit = {k: mixed_model.fit_random_intercept(mixed_model.sufficient_statistics(y, "subject", "__y", x), list(x), reml) for k, x, reml in (("full", full, True), ("ml", full, False), ("reduced", plain, False))}
        rows += [(c, *r) for r in fit["full"].table()]
        chi, df, p = mixed_model.likelihood_ratio(fit["ml"], fit["reduced"])
        fits.append((c, float(fit["full"].icc), float(fit["full"].llf), float(chi), int(df), float(p)))
    spark = d.sparkSession
    return {"": spark.createDataFrame(rows, "measure string, name string, coef double, se double, z double, p double, lower double, upper double"), "_fit": spark.createDataFrame(fits, "measure string, icc double, llf double, lr double, df int, p double")}


def gap(i: Inputs) -> dict[str, DataFrame]:
    """How much of each measure's gap to the healthy the aid closes, in each task, with tests of both gaps."""
    d = batteries.long_form(_by_task(i, i.measures()), ["subject", "grp", "task", "condition"], i.measures())
    sides = (PATIENTS, HEALTHY, WITHOUT, WITH)
    samples = statistics.gap_samples(d, "value", "grp", "condition", *sides, keys=("measure", "task"))
    return {"": statistics.gap_closure(d, "value", "grp", "condition", *sides, keys=("measure", "task")), "_tests": statistics.mann_whitney(samples, "value", "side", "patients", "healthy", ("measure", "task", "gap"))}


def _muscle_medians(i: Inputs) -> DataFrame:
    """Medians by subject of the windows' RMS without aid, by muscle: columns EMG_<muscle>_RMS."""
    d = _sided(i.read("features"))
    rms = [c for c in d.columns if c.startswith("EMG_") and c.endswith("_RMS")]
    return d.where(F.col("condition") == WITHOUT).groupBy("subject", "grp").agg(*[F.median(c).alias(c) for c in rms])


def _mean(columns: list[str]):
    return sum((F.col(c) for c in columns), F.lit(0.0)) / len(columns)


def selectivity(i: Inputs) -> dict[str, DataFrame]:
    """Fold change of the wrist's muscles over that of the elbow's, and what the aid does to their ratio."""
    d = _muscle_medians(i)
    far, near = ([f"EMG_{m}_RMS" for m in ms if f"EMG_{m}_RMS" in d.columns] for ms in (("Extensor", "Flexor"), ("Biceps", "Triceps")))
    if not far or not near:
        return {}
    d = d.withColumn("wrist", _mean(far)).withColumn("elbow", _mean(near))
    return {"": statistics.selectivity(d, "wrist", "elbow", "grp", PATIENTS, HEALTHY), "_outside": statistics.outside_reference(d, "subject", "wrist", "grp", HEALTHY)}


def posterior(i: Inputs) -> dict[str, DataFrame]:
    """Posterior of the mean log-ratio of both conditions over patients."""
    own = i.config.get("posterior", {})
    names = i.measures()
    measure = own.get("measure") or next((c for c in names if c.startswith("kpi_abs_rms")), names[0] if names else None)
    if measure is None:
        return {}
    d = i.trials.where(F.col("grp") == PATIENTS)
    d = d.where(F.col("task") == own["task"]) if "task" in own else d
    pairs = statistics.paired_conditions(d, ["subject"], "condition", measure, WITHOUT, WITH).where("a > 0 AND b > 0").withColumn("d", F.ln(F.col("b") / F.col("a")))
    s = pairs.agg(F.count("d").alias("n"), F.coalesce(F.sum("d"), F.lit(0.0)).alias("s"), F.coalesce(F.sum(F.col("d") * F.col("d")), F.lit(0.0)).alias("ss"))
    return {"": statistics.grid_posterior(d.sparkSession, s).withColumn("measure", F.lit(measure))}


STEPS: dict[str, Callable[[Inputs], dict[str, DataFrame]]] = {
    "setup": setup, "normality": normality, "descriptive": descriptive, "pertask": per_task, "groups": groups, "exo": exo, "mismatch": mismatch,
    "clusters": clusters, "association": association, "lmm": lmm, "gap": gap, "selectivity": selectivity, "posterior": posterior,
}


# --- phase 10 ---


def rms_matrix(features: DataFrame, muscles: list[str]) -> DataFrame:
    """subject, y and the medians of the muscles' window RMS without aid; a subject's gap is the median over subjects."""
    from pulseframe.operators.normalisation import median_impute

    d = _sided(features).where(F.col("condition") == WITHOUT)
    columns = [f"EMG_{m}_RMS" for m in muscles if f"EMG_{m}_RMS" in d.columns]
    m = d.groupBy("subject").agg(*[F.median(c).alias(c) for c in columns])
    return median_impute(m, columns).withColumn("y", dims.label_of("subject"))


def models(matrix: DataFrame, columns: list[str], tree_count: int = 500) -> dict[str, DataFrame]:
    """folds, metrics, consistency, predictions, importances and shap of a matrix with subject, y and columns; folds are staged once."""
    from pulseframe.sources.tables import staged

    folds = staged(supervised.leave_one_out(matrix, "subject", "y", columns, trees=tree_count), "folds")
    forest = trees.Forest.of_table(trees.forest_table(matrix, "y", columns, tree_count))
    shap = staged(trees.shapley_rows(matrix, "subject", columns, forest), "shap")
    return {
        "folds": folds, "metrics": supervised.model_metrics(folds), "consistency": supervised.consistency(folds, "subject"), "predictions": supervised.prediction_table(folds, "subject", list(supervised.MODELS)),
        "importances": trees.importance_table(shap, forest, columns), "shap": shap,
    }


def heatmap(subjects: DataFrame, columns: list[str]) -> DataFrame:
    """grp, subject, feature, z: standardised indicators, long form (the figure's table)."""
    from pulseframe.operators.normalisation import standardise

    z = standardise(subjects.select("subject", *columns), columns)
    return z.unpivot(["subject"], columns, "feature", "z").select(dims.group_of("subject").alias("grp"), "subject", "feature", "z")


def distribution_summary(subjects: DataFrame, columns: list[str]) -> DataFrame:
    """feature, medians of both groups and their ratio, sd, skewness and coverage."""
    long = batteries.long_form(subjects.withColumn("grp", dims.group_of("subject")), ["subject", "grp"], columns)
    m = lambda g: F.median(F.when(F.col("grp") == g, F.col("value")))
    a = long.groupBy(F.col("measure").alias("feature")).agg(m(PATIENTS).alias("median_patients"), m(HEALTHY).alias("median_healthy"), (F.count("value") / F.count(F.lit(1))).alias("coverage"))
    r = kpis.feature_report(subjects, columns).select("feature", "sd", "skew")
    return a.withColumn("ratio", F.try_divide("median_patients", "median_healthy")).join(r, "feature")
