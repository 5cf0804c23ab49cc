"""Queries over ranks of crowded values, resampling laws, merge trees, forests' metrics and figure tables, with SQL where it can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.operators import linkage, ranks, resampling, statistics, supervised
from pulseframe.plans import steps
from pulseframe.queries import _E, _events, _nations, query
from pulseframe.queries_given import _FOLD, _given_folds

_T = "SELECT CAST(floor(t / 600) AS BIGINT) + 1700000000 AS x, event_type AS k FROM e"


def _crowded(t) -> DataFrame:
    """Epoch-like values that lie within a percent of each other, with ties."""
    return _events(t).select((F.floor(F.col("t") / 600) + 1_700_000_000).cast("long").alias("x"), F.col("event_type").alias("k"))


@query(f"WITH {_E}, v AS ({_T}) SELECT x, count(*) AS n, round(min(r) + (count(*) - 1) / 2.0, 6) AS rank FROM (SELECT x, rank() OVER (ORDER BY x) AS r FROM v) GROUP BY x")
def ranks_of_crowded_values(t):
    d = _crowded(t)
    p = ranks.value_places(d, "x", (), ranks.cut_points(d, "x", 500))
    return p.select("x", "n", (F.col("__lo") + (F.col("n") + 1) / 2.0).alias("rank"))


@query(f"WITH {_E}, v AS ({_T}) SELECT k, x, count(*) AS n, min(r) - 1 AS below, any_value(m) AS of FROM (SELECT k, x, rank() OVER (PARTITION BY k ORDER BY x) AS r, count(*) OVER (PARTITION BY k) AS m FROM v) GROUP BY k, x")
def places_of_crowded_values_by_key(t):
    d = _crowded(t)
    return ranks.value_places(d, "x", ("k",), ranks.cut_points(d, "x", 500)).select("k", "x", "n", F.col("__lo").alias("below"), F.col("__n").alias("of"))


_NATS = "n AS (SELECT c_nationkey AS k, median(c_acctbal) AS a, avg(c_acctbal) AS b, stddev_samp(c_acctbal) AS c, avg(CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 ELSE 0 END) AS d FROM customer GROUP BY 1)"


@query(f"WITH {_NATS}, w AS (SELECT * FROM n WHERE c IS NOT NULL) SELECT count(*) - 1 AS merges, round(CAST(count(*) AS DOUBLE) * ((stddev_pop(a) > 0)::INT + (stddev_pop(b) > 0)::INT + (stddev_pop(c) > 0)::INT + (stddev_pop(d) > 0)::INT), 6) AS twice_half_squares FROM w")
def ward_tree_total(t):
    """The squares of Ward's heights are twice the sum of squares that the merges take up, of standardised columns."""
    m = linkage.merge_table(_nations(t), "k", list("abcd"))
    return m.agg(F.count(F.lit(1)).alias("merges"), (F.sum(F.col("height") * F.col("height")) / 2).alias("twice_half_squares"))


@query()
def ward_dendrogram(t):
    return linkage.merge_table(_nations(t), "k", list("abcd"))


@query()
def ward_cuts(t):
    return linkage.cut_table(_nations(t), "k", list("abcd"), [2, 3, 4, 5])


@query(f"""WITH {_FOLD}, a AS (SELECT model, count(*) FILTER (y_pred = 1 AND y_true = 1) AS tp, count(*) FILTER (y_pred = 1 AND y_true = 0) AS fp, count(*) FILTER (y_pred = 0 AND y_true = 1) AS fn, count(*) FILTER (y_pred = 0 AND y_true = 0) AS tn FROM f GROUP BY 1)
SELECT model, tp, fp, fn, tn, round(tp / (tp + fn), 6) AS sensitivity, round(tn / (tn + fp), 6) AS specificity, round(tp / (tp + fp), 6) AS ppv, round(tn / (tn + fn), 6) AS npv, round((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2, 6) AS f1_macro, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy FROM a""")
def model_metrics_given_folds(t):
    return supervised.model_metrics(_given_folds(t)).drop("auc", "balanced_accuracy")


@query("WITH d AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS o FROM lineitem GROUP BY 1, 2), m AS (SELECT *, sum(o) OVER (PARTITION BY a) * sum(o) OVER (PARTITION BY b) / sum(o) OVER () AS e FROM d) SELECT round(sum(o * o / e) - sum(o), 3) AS observed, 10000 AS rounds FROM m")
def permutation_statistic_of_margins(t):
    """The observed statistic of a table of all line items; the rounds' work does not depend on their number."""
    return resampling.permutation_from_margins(t("lineitem"), "l_returnflag", "l_linestatus").select(F.round("observed", 3).alias("observed"), F.col("rounds").cast("int").alias("rounds"))


@query()
def permutation_from_margins(t):
    n = _nations(t).select(F.col("n_regionkey").alias("r"), (F.col("a") > 4500).alias("high"))
    return resampling.permutation_from_margins(n, "r", "high")


@query("SELECT l_returnflag AS g, count(l_extendedprice) AS n, round(median(l_extendedprice), 6) AS median FROM lineitem GROUP BY 1")
def bootstrap_places_median(t):
    b = resampling.bootstrap_median_places(t("lineitem").withColumnRenamed("l_returnflag", "g"), "l_extendedprice", ("g",), 500)
    return b.where("lo <= median AND median <= hi").select("g", "n", "median")


@query()
def bootstrap_places_interval(t):
    return resampling.bootstrap_median_places(t("orders"), "o_totalprice", ("o_orderpriority",))


@query()
def power_of_group_tests(t):
    """Power at the effect and group sizes that each nation's customers show, and the equal size for 80 %."""
    d = t("customer").withColumn("g", F.when(F.col("c_mktsegment") == "BUILDING", "a").when(F.col("c_mktsegment") == "MACHINERY", "b"))
    e = statistics.mann_whitney(d.where("g IS NOT NULL"), "c_acctbal", "g", "a", "b", ("c_nationkey",))
    return steps.with_power(e.where("n1 > 1 AND n2 > 1").select("c_nationkey", "n1", "n2", "rank_biserial"))


def _subjects(t) -> DataFrame:
    who = F.concat(F.when(F.col("s_suppkey") % 3 == 0, "ALS_").otherwise("Healthy_"), F.col("s_suppkey").cast("string"))
    return t("supplier").select(who.alias("subject"), F.col("s_acctbal").alias("a"), F.when(F.col("s_nationkey") % 4 > 0, F.sqrt(F.abs("s_acctbal"))).alias("b"))


_SUB = "s AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'ALS_' ELSE 'Healthy_' END || s_suppkey AS subject, s_acctbal AS a, CASE WHEN s_nationkey % 4 > 0 THEN sqrt(abs(s_acctbal)) END AS b FROM supplier), l AS (SELECT subject, subject LIKE 'ALS%' AS p, unnest(['a', 'b']) AS feature, unnest([a, b]) AS v FROM s)"


@query(f"WITH {_SUB} SELECT feature, round(median(v) FILTER (p), 6) AS median_patients, round(median(v) FILTER (NOT p), 6) AS median_healthy, round(count(v) / count(*), 6) AS coverage, round(median(v) FILTER (p) / median(v) FILTER (NOT p), 6) AS ratio, round(stddev_samp(v), 6) AS sd, round(skewness(v), 6) AS skew FROM l GROUP BY 1")
def kpi_distribution_summary(t):
    return steps.distribution_summary(_subjects(t), ["a", "b"])


@query(f"WITH {_SUB}, z AS (SELECT *, avg(v) OVER (PARTITION BY feature) AS m, stddev_pop(v) OVER (PARTITION BY feature) AS d FROM l) SELECT CASE WHEN p THEN 'ALS' ELSE 'Healthy' END AS grp, subject, feature, round((v - m) / d, 6) AS z FROM z")
def indicator_heatmap(t):
    return steps.heatmap(_subjects(t), ["a", "b"])
