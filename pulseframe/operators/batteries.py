"""Batteries: many measures, tasks and scopes through one test, with corrected p-values."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseframe.operators import exact_tests
from pulseframe.operators.statistics import benjamini_hochberg, bonferroni, mann_whitney, wilcoxon


@F.pandas_udf(T.DoubleType())
def _mann_whitney_p(u: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([exact_tests.mann_whitney_p(a, int(b), int(c), d) for a, b, c, d in zip(u, n1, n2, ties)])


@F.pandas_udf(T.DoubleType())
def _wilcoxon_p(w: pd.Series, n: pd.Series, ties: pd.Series, zeros: pd.Series) -> pd.Series:
    return pd.Series([exact_tests.wilcoxon_p(a, int(b), c, int(d)) for a, b, c, d in zip(w, n, ties, zeros)])


def tie_term(df: DataFrame, x: str, keys) -> DataFrame:
    """Sum of c**3 - c over tied values of each key."""
    c = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count(F.lit(1)).cast("double").alias("c"))
    return c.groupBy(*keys).agg(F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("ties"))


def long_form(df: DataFrame, keys, measures: list[str]) -> DataFrame:
    return df.unpivot(list(keys), measures, "measure", "value")


def two_group_battery(df: DataFrame, key: str, group: str, measures: list[str], first: str, second: str, scopes=()) -> DataFrame:
    """U, effects, p and p_fdr (a family over all measures of a scope) of every measure and scope."""
    d = long_form(df.where(F.col(group).isin(first, second)), [key, group, *scopes], measures)
    by = [*scopes, "measure"]
    r = mann_whitney(d, "value", group, first, second, by).join(tie_term(d, "value", by), by)
    r = r.withColumn("p", _mann_whitney_p("u", "n1", "n2", "ties")).drop("ties", "p_normal")
    return benjamini_hochberg(r, "p", tuple(scopes))


def paired_battery(df: DataFrame, key: str, condition: str, measures: list[str], before: str, after: str, scopes=(), least: int = 3) -> DataFrame:
    """Signed-rank results of every measure and scope with `least` pairs and a difference; p corrected over all and within scopes."""
    d = long_form(df, [key, condition, *scopes], measures)
    m = lambda c: F.median(F.when(F.col(condition) == c, F.col("value")))
    by = [*scopes, "measure"]
    pairs = d.groupBy(key, *by).agg(m(before).alias("a"), m(after).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    w = wilcoxon(pairs, "a", "b", by).where(F.col("n") >= least)
    ties = tie_term(pairs.withColumn("d", F.abs(F.col("b") - F.col("a"))).where("d > 0"), "d", by)
    w = w.join(ties, by).withColumn("p", _wilcoxon_p("w", "n_nonzero", "ties", F.col("n") - F.col("n_nonzero"))).drop("ties")
    w = benjamini_hochberg(w, "p", (), "p_fdr_all")
    return benjamini_hochberg(w, "p", tuple(scopes), "p_fdr_scope").withColumn("p_bonferroni", bonferroni("p"))


def shape_battery(df: DataFrame, key: str, group: str, measures: list[str]) -> DataFrame:
    """Shapiro-Wilk of every measure and group (their values meet in one task: small samples)."""
    d = long_form(df, [key, group], measures).where("value IS NOT NULL").select(group, "measure", "value")

    def run(p):
        w, q = exact_tests.shapiro_wilk(p["value"])
        return pd.DataFrame([[p[group].iloc[0], p["measure"].iloc[0], len(p), w, q]], columns=[group, "measure", "n", "w", "p"])

    return d.groupBy(group, "measure").applyInPandas(run, f"{group} string, measure string, n int, w double, p double")


def significance(p: Column | str) -> Column:
    p = F.col(p) if isinstance(p, str) else p
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")
