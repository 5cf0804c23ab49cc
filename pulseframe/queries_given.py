"""Queries over operators that need labels, folds, features or recordings, given here by the tables, each with its SQL.

Nations stand for subjects, regions for clusters, suppliers for rounds; line items for windows and trials.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.functions import dims
from pulseframe.operators import batteries, clustering, exact_tests, features, kpis, normalisation, ranks, reports, signal_quality, statistics, supervised
from pulseframe.operators import episodes as ep
from pulseframe.plans import phases
from pulseframe.queries import TR, _E, _driver_rows, _events, query
from pulseframe.sources import tables

# --- stability, given labels ---

_LAB = """o AS (SELECT n_nationkey AS k, n_regionkey + 1 AS cluster FROM nation),
l AS (SELECT s_suppkey % 7 AS round, n_nationkey AS k, min((n_nationkey + s_suppkey // 7) % 4) AS cluster FROM supplier JOIN nation ON (s_suppkey * 5 + n_nationkey * 3) % 4 < 2 GROUP BY 1, 2)"""


def _original(t) -> DataFrame:
    return t("nation").select(F.col("n_nationkey").alias("k"), (F.col("n_regionkey") + 1).alias("cluster"))


def _labels(t) -> DataFrame:
    s = t("supplier").join(F.broadcast(t("nation")), (F.col("s_suppkey") * 5 + F.col("n_nationkey") * 3) % 4 < 2)  # 25 nations
    return s.groupBy((F.col("s_suppkey") % 7).alias("round"), F.col("n_nationkey").alias("k")).agg(F.min((F.col("n_nationkey") + F.floor(F.col("s_suppkey") / 7)) % 4).alias("cluster"))


_PAIRS = """p AS (SELECT x.k AS a, y.k AS b, count(*) FILTER (x.cluster = y.cluster) AS together, count(*) AS both, avg(CASE WHEN x.cluster = y.cluster THEN 1.0 ELSE 0 END) AS share FROM l x JOIN l y ON x.round = y.round AND x.k < y.k GROUP BY 1, 2)"""
_ENDS = "e AS (SELECT a AS who, b AS w, share FROM p UNION ALL SELECT b, a, share FROM p), q AS (SELECT e.who, e.share, i.cluster AS own, j.cluster AS other FROM e JOIN o i ON i.k = who JOIN o j ON j.k = w)"


@query(f"WITH {_LAB}, {_PAIRS} SELECT a, b, together, \"both\", round(share, 6) AS share FROM p")
def cooccurrence_given_labels(t):
    return clustering.co_occurrence(_labels(t), "k")


@query(f"""WITH {_LAB}, c AS (SELECT DISTINCT cluster FROM o), r AS (SELECT DISTINCT round FROM l),
s AS (SELECT round, cluster AS c2, count(*) AS n FROM l GROUP BY 1, 2), z AS (SELECT cluster, count(*) AS n FROM o GROUP BY 1),
i AS (SELECT l.round, o.cluster, l.cluster AS c2, count(*) AS n FROM l JOIN o USING (k) GROUP BY 1, 2, 3),
j AS (SELECT i.round, i.cluster, max(i.n / (z.n + s.n - i.n)) AS jac FROM i JOIN z USING (cluster) JOIN s ON s.round = i.round AND s.c2 = i.c2 GROUP BY 1, 2),
f AS (SELECT c.cluster, coalesce(jac, 0) AS jac FROM c CROSS JOIN r LEFT JOIN j ON j.cluster = c.cluster AND j.round = r.round), a AS (SELECT cluster, avg(jac) AS m, stddev_pop(jac) AS s FROM f GROUP BY 1)
SELECT cluster, round(m, 6) AS mean, round(s, 6) AS sd, CASE WHEN m >= 0.75 THEN 'STABLE' WHEN m >= 0.5 THEN 'MODERATE' ELSE 'UNSTABLE' END AS verdict FROM a""")
def jaccard_given_labels(t):
    return clustering.best_jaccard(_original(t), _labels(t), "k")


@query(f"""WITH {_LAB}, {_PAIRS}, {_ENDS}, a AS (SELECT own AS cluster, avg(share) FILTER (own = other) AS within, avg(share) FILTER (own <> other) AS between_ FROM q GROUP BY own)
SELECT cluster, round(within, 6) AS within, round(between_, 6) AS between, round(within - between_, 6) AS separation, CASE WHEN within - between_ > 0.3 THEN 'well' WHEN within - between_ > 0.1 THEN 'moderate' ELSE 'poor' END AS verdict FROM a""")
def separation_given_labels(t):
    l = _labels(t)  # noqa: E741
    return clustering.separation(clustering.co_occurrence(l, "k"), _original(t), "k")


@query(f"WITH {_LAB}, {_PAIRS}, {_ENDS} SELECT o.k, o.cluster, round(avg(share), 6) AS stability FROM o LEFT JOIN q ON q.who = o.k AND own = other GROUP BY 1, 2")
def member_stability_given_labels(t):
    return clustering.member_stability(clustering.co_occurrence(_labels(t), "k"), _original(t), "k")


# --- models, given folds ---

_FOLD = """f AS (SELECT m AS model, c_custkey AS k, CAST(c_nationkey % 2 AS INTEGER) AS y_true, CAST(p >= 0.5 AS INTEGER) AS y_pred, p AS y_prob FROM
(SELECT *, round((c_custkey * CASE m WHEN 'logistic' THEN 7919 WHEN 'svm_rbf' THEN 104729 ELSE 1299709 END % 1009) / 1009.0, 4) AS p FROM customer, (VALUES ('logistic'), ('svm_rbf'), ('forest')) v(m)))"""


def _given_folds(t) -> DataFrame:
    models = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(k).alias("f")) for m, k in (("logistic", 7919), ("svm_rbf", 104_729), ("forest", 1_299_709))])).alias("m")
    d = t("customer").select(F.col("c_custkey").alias("k"), (F.col("c_nationkey") % 2).cast("int").alias("y_true"), models)
    d = d.select("m.model", "k", "y_true", F.round((F.col("k") * F.col("m.f") % 1009) / 1009.0, 4).alias("y_prob"))
    d = d.withColumn("y_pred", (F.col("y_prob") >= 0.5).cast("int"))
    return d.withColumn("correct", F.col("y_pred") == F.col("y_true"))


@query(f"WITH {_FOLD} SELECT k, CASE WHEN bool_and(y_pred = y_true) THEN 'all correct' WHEN NOT bool_or(y_pred = y_true) THEN 'all wrong' ELSE 'split' END AS agreement FROM f GROUP BY k")
def consistency_given_folds(t):
    return supervised.consistency(_given_folds(t), "k")


@query(f"WITH {_FOLD} SELECT k, y_true, " + ", ".join(f"any_value(y_pred) FILTER (model = '{m}') AS {m}_pred, round(any_value(y_prob) FILTER (model = '{m}'), 6) AS {m}_prob, bool_or(y_pred = y_true) FILTER (model = '{m}') AS {m}_correct" for m in supervised.MODELS) + " FROM f GROUP BY 1, 2")
def prediction_table_given_folds(t):
    return supervised.prediction_table(_given_folds(t), "k", list(supervised.MODELS))


@query(f"""WITH {_FOLD}, a AS (SELECT model, CAST(count(*) FILTER (y_pred = 1 AND y_true = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (y_pred = 0 AND y_true = 0) AS DOUBLE) AS tn, CAST(count(*) FILTER (y_pred = 1 AND y_true = 0) AS DOUBLE) AS fp, CAST(count(*) FILTER (y_pred = 0 AND y_true = 1) AS DOUBLE) AS fn FROM f GROUP BY 1),
r AS (SELECT model, y_true, rank() OVER (PARTITION BY model ORDER BY y_prob) + (count(*) OVER (PARTITION BY model, y_prob) - 1) / 2.0 AS r FROM f),
u AS (SELECT model, (sum(r) FILTER (y_true = 1) - count(*) FILTER (y_true = 1) * (count(*) FILTER (y_true = 1) + 1) / 2) / (CAST(count(*) FILTER (y_true = 1) AS DOUBLE) * count(*) FILTER (y_true = 0)) AS auc FROM r GROUP BY 1)
SELECT model, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round(auc, 6) AS auc, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS phi FROM a JOIN u USING (model)""")
def metrics_given_folds(t):
    f = _given_folds(t)
    d = statistics.detector_metrics(f, F.col("y_pred") == 1, supervised.truth(), ("model",)).join(statistics.auc(f, "y_prob", supervised.truth(), ("model",)), "model")
    return d.select("model", "balanced_accuracy", "auc", "phi")


# --- tests ---

_GRP = "d AS (SELECT l_suppkey AS k, l_returnflag AS g, l_linestatus AS s, median(l_quantity) AS q, avg(l_extendedprice) AS e FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2, 3)"
_TWO = "l AS (SELECT s, g, measure, v FROM d UNPIVOT (v FOR measure IN (q, e))), r AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY s, measure, v) - 1) / 2.0 AS r FROM l WINDOW w AS (PARTITION BY s, measure ORDER BY v)), a AS (SELECT s, measure, count(*) FILTER (g = 'A') AS n1, count(*) FILTER (g = 'R') AS n2, sum(r) FILTER (g = 'A') AS r1 FROM r GROUP BY 1, 2), b AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u FROM a)"


def _by_flag(t) -> DataFrame:
    return t("lineitem").where(F.col("l_returnflag").isin("A", "R")).groupBy(F.col("l_suppkey").alias("k"), F.col("l_returnflag").alias("g"), F.col("l_linestatus").alias("s")).agg(F.median("l_quantity").alias("q"), ranks.steady_mean("l_extendedprice").alias("e"))


@query(f"WITH {_GRP}, {_TWO} SELECT s, measure, n1, n2, round(u, 6) AS u, round(1 - 2 * u / (n1 * n2), 6) AS rank_biserial, round(abs(u - n1 * n2 / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12) / sqrt(n1 + n2), 6) AS r FROM b WHERE n1 > 0 AND n2 > 0")
def two_group_effects(t):
    r = batteries.two_group_battery(_by_flag(t), "k", "g", ["q", "e"], "A", "R", ("s",))
    return r.where("n1 > 0 AND n2 > 0").select("s", "measure", "n1", "n2", "u", "rank_biserial", "r")


@query(f"""WITH {_GRP}, l AS (SELECT k, g, s, measure, v FROM d UNPIVOT (v FOR measure IN (q, e))), p AS (SELECT k, g, measure, median(v) FILTER (s = 'O') AS a, median(v) FILTER (s = 'F') AS b FROM l GROUP BY 1, 2, 3 HAVING a IS NOT NULL AND b IS NOT NULL),
x AS (SELECT *, b - a AS d, rank() OVER (PARTITION BY g, measure ORDER BY abs(b - a)) + (count(*) OVER (PARTITION BY g, measure, abs(b - a)) - 1) / 2.0 AS r FROM p WHERE a <> b),
w AS (SELECT g, measure, count(*) AS n_nonzero, least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)) AS w FROM x GROUP BY 1, 2), n AS (SELECT g, measure, count(*) AS n FROM p GROUP BY 1, 2)
SELECT g, measure, n, n_nonzero, round(w, 6) AS w, round(1 - 4 * w / (n_nonzero * (n_nonzero + 1)), 6) AS effect_r FROM w JOIN n USING (g, measure) WHERE n >= 3""")
def paired_effects(t):
    return batteries.paired_battery(_by_flag(t), "k", "s", ["q", "e"], "O", "F", ("g",)).select("g", "measure", "n", "n_nonzero", "w", "effect_r")


@query("""WITH d AS (SELECT * FROM (SELECT 'Overall' AS scope, l_suppkey, l_quantity, l_tax FROM lineitem UNION ALL SELECT l_returnflag, l_suppkey, l_quantity, l_tax FROM lineitem)),
m AS (SELECT scope, l_suppkey % 3 = 0 AS pt, median(l_quantity) AS a, median(l_tax) AS b FROM d GROUP BY scope, l_suppkey HAVING a > 0 AND b > 0), x AS (SELECT *, ln(a / b) AS lr FROM m),
r AS (SELECT *, rank() OVER (PARTITION BY scope ORDER BY lr) + (count(*) OVER (PARTITION BY scope, lr) - 1) / 2.0 AS r FROM x),
a AS (SELECT scope, count(*) FILTER (pt) AS n1, count(*) FILTER (NOT pt) AS n2, sum(r) FILTER (pt) AS r1, median(lr) FILTER (pt) AS pl, median(lr) FILTER (NOT pt) AS hl FROM r GROUP BY scope), b AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u FROM a)
SELECT scope, n1, n2, round(u, 6) AS u, round(1 - 2 * u / (n1 * n2), 6) AS rank_biserial, round(pl, 6) AS patients_log, round(hl, 6) AS healthy_log, round(pl - hl, 6) AS shift, round(exp(pl), 6) AS patients_ratio, round(exp(hl), 6) AS healthy_ratio FROM b WHERE n1 >= 3 AND n2 >= 3""")
def log_ratio_shift(t):
    d = t("lineitem").withColumn("g", F.when(F.col("l_suppkey") % 3 == 0, "P").otherwise("H"))
    return statistics.log_ratio_shift(d, "l_suppkey", "g", "l_returnflag", "l_quantity", "l_tax", "P", "H").drop("z", "p_normal", "r")


@query("""WITH g AS (SELECT l_suppkey % 3 = 0 AS pt, l_linestatus AS c, l_extendedprice AS x FROM lineitem), s AS (SELECT 'baseline' AS gap, pt, x FROM g WHERE c = 'O' UNION ALL SELECT 'residual', pt, x FROM g WHERE (pt AND c = 'F') OR (NOT pt AND c = 'O')),
r AS (SELECT *, rank() OVER (PARTITION BY gap ORDER BY x) + (count(*) OVER (PARTITION BY gap, x) - 1) / 2.0 AS r FROM s), a AS (SELECT gap, count(*) FILTER (pt) AS n1, count(*) FILTER (NOT pt) AS n2, sum(r) FILTER (pt) AS r1 FROM r GROUP BY gap)
SELECT gap, n1, n2, round(r1 - n1 * (n1 + 1) / 2, 6) AS u FROM a""")
def gap_tests(t):
    d = t("lineitem").select(F.when(F.col("l_suppkey") % 3 == 0, "P").otherwise("H").alias("g"), F.col("l_linestatus").alias("c"), F.col("l_extendedprice").alias("x"))
    return statistics.mann_whitney(statistics.gap_samples(d, "x", "g", "c", "P", "H", "O", "F"), "x", "side", "patients", "healthy", ("gap",)).select("gap", "n1", "n2", "u")


#: Published values of the power of the rank test and of the least equal groups for 80 %.
@query("SELECT * FROM (VALUES (0.3, 20.9, 59), (0.5, 48.1, 22), (0.517, 50.6, NULL), (0.617, 65.5, NULL), (0.7, 76.3, 12), (0.75, 81.8, NULL), (0.867, 91.2, NULL), (0.9, 93.1, NULL)) v(r, power, n_for_80)".replace("(0.3,", "(CAST(0.3 AS DOUBLE),").replace("20.9", "CAST(20.9 AS DOUBLE)"))
def power_table(t):
    rows = [(r, round(100 * float(exact_tests.mann_whitney_power(r, 14, 8)), 1), exact_tests.sample_size(r) if r in (0.3, 0.5, 0.7) else None) for r in (0.3, 0.5, 0.517, 0.617, 0.7, 0.75, 0.867, 0.9)]
    return _driver_rows(t, rows, "r double, power double, n_for_80 int")


_LC = "(lgamma({0} + 1.0) - lgamma({1} + 1.0) - lgamma({0} - ({1}) + 1.0))"


@query(f"""WITH c AS (SELECT c_custkey % 5 AS part, count(*) FILTER (c_acctbal > 8000 AND c_nationkey < 5) AS a, count(*) FILTER (c_acctbal > 8000 AND c_nationkey >= 5) AS b, count(*) FILTER (c_acctbal <= 8000 AND c_nationkey < 5) AS c, count(*) FILTER (c_acctbal <= 8000 AND c_nationkey >= 5) AS d FROM customer GROUP BY 1),
x AS (SELECT *, unnest(range(greatest(0, (a + c) - (c + d)), least(a + b, a + c) + 1)) AS i FROM c), p AS (SELECT part, a, b, c, d, i, exp({_LC.format("(a + b)", "i")} + {_LC.format("(c + d)", "(a + c - i)")} - {_LC.format("(a + b + c + d)", "(a + c)")}) AS p FROM x),
q AS (SELECT *, max(p) FILTER (i = a) OVER (PARTITION BY part) AS own FROM p)
SELECT part, a, b, c, d, round(a * d / nullif(CAST(b AS DOUBLE) * c, 0), 6) AS odds, round(least(sum(p) FILTER (p <= own * (1 + 1e-7)), 1), 6) AS p FROM q GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY part, a, b, c, d"))
def fisher_by_part(t):
    high, near = F.col("c_acctbal") > 8000, F.col("c_nationkey") < 5
    n = lambda x, y, name: F.count_if(x & y).alias(name)
    c = t("customer").groupBy((F.col("c_custkey") % 5).alias("part")).agg(n(high, near, "a"), n(high, ~near, "b"), n(~high, near, "c"), n(~high, ~near, "d"))
    tested = F.udf(lambda a, b, c, d: tuple(map(float, exact_tests.fisher_exact(a, b, c, d))), "struct<odds: double, p: double>")("a", "b", "c", "d")  # one call a table of counts
    return c.withColumn("__f", tested).select("part", "a", "b", "c", "d", F.col("__f.odds").alias("odds"), F.col("__f.p").alias("p"))


# --- labels and checks ---

_WHO = "CASE p_partkey % 6 WHEN 0 THEN 'Patient_3' WHEN 1 THEN 'HC-07' WHEN 2 THEN 'Control x' WHEN 3 THEN 'ALS_Subject_1' WHEN 4 THEN 'archcase' ELSE 'someone' END"


@query(f"""WITH p AS (SELECT *, {_WHO} AS who, (p_size - 25) / 10.0 AS sk FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 6 IN (0, 3) THEN 'ALS' WHEN p_partkey % 6 IN (1, 2, 4) THEN 'Healthy' ELSE 'Unknown' END AS grp, CASE WHEN abs(sk) < 0.5 THEN 'Approximately symmetric' WHEN abs(sk) < 1 THEN 'Mildly skewed' WHEN abs(sk) < 2 THEN 'Moderately skewed' ELSE 'Heavily skewed' END || CASE WHEN p_retailprice / 300 > 3 THEN ' + heavy tails' ELSE '' END AS shape,
CASE WHEN p_size / 50.0 >= 0.9 THEN 'OK' WHEN p_size / 50.0 >= 0.5 THEN 'WARN' ELSE 'FAIL' END AS share_status, CASE WHEN p_size / 100.0 <= 0.05 THEN 'OK' WHEN p_size / 100.0 <= 0.2 THEN 'WARN' ELSE 'FAIL' END AS ape_status,
CASE WHEN who LIKE '%ALS%' THEN 1.0e0 END AS label, CASE WHEN who LIKE '%Control%' THEN 'control' WHEN lower(who) LIKE '%hc%' THEN 'hc' END AS task_key FROM p""")
def label_checks(t):
    who = F.expr(_WHO)
    return t("part").select(
        "p_partkey", dims.group_of_wide(who).alias("grp"), dims.shape_label((F.col("p_size") - 25) / 10.0, F.col("p_retailprice") / 300).alias("shape"), dims.ok_warn_fail(F.col("p_size") / 50.0, 0.9, 0.5).alias("share_status"),
        dims.ape_status(F.col("p_size") / 100.0).alias("ape_status"), dims.label_of(who).alias("label"), dims.first_key_in(who, ["control", "hc"]).alias("task_key"),
    )


@query("""SELECT l_returnflag, round(avg(CASE WHEN abs(l_discount - 0.05) <= 0.01 + 1e-5 * 0.05 THEN 1.0 ELSE 0 END), 6) AS near, round(median(abs(l_quantity - 25 * l_tax * 10) / (25 * l_tax * 10)) FILTER (l_tax > 0), 6) AS ape FROM lineitem GROUP BY 1""")
def near_and_ape(t):
    return t("lineitem").groupBy("l_returnflag").agg(dims.near_share(F.col("l_discount"), 0.05, 0.01).alias("near"), dims.median_ape("l_quantity", F.col("l_tax") * 250).alias("ape"))


@query("""SELECT l_returnflag, round(any_value(v) FILTER (l_linestatus = 'F'), 6) AS F, round(any_value(v) FILTER (l_linestatus = 'O'), 6) AS O FROM (SELECT l_returnflag, l_linestatus, (median(l_extendedprice) - median(l_quantity)) / median(l_quantity) * 100 AS v FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def change_grid(t):
    d = t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.median("l_quantity").alias("a"), F.median("l_extendedprice").alias("b"))
    return reports.change_grid(d.withColumn("v", dims.percent_change("a", "b")), "l_returnflag", "l_linestatus", "v", ["F", "O"])


@query("""WITH d AS (SELECT l_suppkey, l_returnflag, avg(l_quantity) AS m FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, round(avg(m), 6) AS mean_l_quantity, l_suppkey % 10 = 3 AS excluded, CASE WHEN l_suppkey % 10 = 3 THEN 'bad contact' END AS exclude_reason FROM d WHERE l_suppkey % 10 <> 4 GROUP BY l_suppkey""")
def exclusions_and_row_means(t):
    d = tables.without(t("lineitem"), t("supplier").where("s_suppkey % 10 = 4").select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey")
    m = kpis.mean_of_row_means(d, ("l_returnflag",), ("l_suppkey",), "l_quantity").withColumn("__s", (F.col("l_suppkey") % 10).cast("string"))
    return kpis.flag_artifacts(m, {"3": "bad contact"}, "__s").drop("__s")


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def modality_preference(t):
    o = t("orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return ep.prefer_first(o.where("o_orderstatus = 'F'").drop("o_orderstatus"), o.where("o_orderstatus = 'P'").drop("o_orderstatus"), ("o_custkey",))


@query("""SELECT * FROM (SELECT c_custkey, c_acctbal > 0 AS emg_ok, c_nationkey > 12 AS imu_ok FROM customer) WHERE emg_ok OR imu_ok""")
def modality_filter(t):
    return features.valid_windows(t("customer").select("c_custkey", (F.col("c_acctbal") > 0).alias("emg_ok"), (F.col("c_nationkey") > 12).alias("imu_ok")))


@query(f"""WITH {_E}, s AS (SELECT user_id, event_type, quantile_cont(greatest(x, 0), 0.95) AS s FROM e WHERE x < 3 OR user_id % 2 = 0 GROUP BY 1, 2) SELECT user_id, event_type FROM s WHERE s IS NULL OR s < 1.5""")
def bad_scales(t):
    s = normalisation.percentile_scales(_events(t).where("x < 3 OR user_id % 2 = 0"), "x", ("user_id", "event_type"), too_small=1.5)
    return normalisation.bad_scales(s).select("user_id", "event_type")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS name, CAST(n_regionkey AS DOUBLE) AS coef, round(n_regionkey - 1.96e0 * (n_nationkey % 3), 6) + 0.0e0 AS lower, round(n_regionkey + 1.96e0 * (n_nationkey % 3), 6) AS upper FROM nation")
def forest_bounds(t):
    return reports.forest_table(t("nation").select(F.col("n_nationkey").cast("string").alias("name"), F.col("n_regionkey").cast("double").alias("coef"), (F.col("n_nationkey") % 3).cast("double").alias("se")))


_SUPS = "s AS (SELECT l_suppkey AS k, median(l_quantity) AS a, avg(l_extendedprice) AS b, stddev_samp(l_discount) AS c, avg(l_tax) AS d FROM lineitem GROUP BY l_suppkey)"


@query(f"""WITH {_SUPS}, l AS (SELECT k, n, v FROM s UNPIVOT (v FOR n IN (a, b, c, d))), p AS (SELECT x.n AS a, y.n AS b, x.v AS u, y.v AS w FROM l x JOIN l y ON x.k = y.k AND x.n < y.n),
r AS (SELECT *, rank() OVER (PARTITION BY a, b ORDER BY u) + (count(*) OVER (PARTITION BY a, b, u) - 1) / 2.0 AS ru, rank() OVER (PARTITION BY a, b ORDER BY w) + (count(*) OVER (PARTITION BY a, b, w) - 1) / 2.0 AS rw FROM p),
c AS (SELECT a, b, corr(ru, rw) AS rho FROM r GROUP BY 1, 2), e AS (SELECT a AS kpi, rho FROM c UNION ALL SELECT b, rho FROM c) SELECT kpi, round(max(abs(rho)), 6) AS max_abs_rho FROM e GROUP BY kpi ORDER BY 2 DESC, 1 LIMIT 3""")
def redundancy_profile(t):
    s = t("lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.median("l_quantity").alias("a"), F.avg("l_extendedprice").alias("b"), F.stddev_samp("l_discount").alias("c"), F.avg("l_tax").alias("d"))
    return kpis.redundancy_profile(kpis.spearman_pairs(s, "k", ["a", "b", "c", "d"]), 3)


@query("""WITH {}, n AS (SELECT k, count(*) FILTER (v IS NOT NULL) AS n FROM (SELECT l_suppkey AS k, l_tax AS v FROM lineitem) GROUP BY 1) SELECT g, round(q1, 6) AS q1, round(mid, 6) AS mid, round(p95, 6) AS p95 FROM
(SELECT l_returnflag AS g, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS mid, quantile_cont(l_extendedprice, 0.95) AS p95 FROM lineitem GROUP BY 1)""".replace("WITH {}, n AS (SELECT k, count(*) FILTER (v IS NOT NULL) AS n FROM (SELECT l_suppkey AS k, l_tax AS v FROM lineitem) GROUP BY 1) ", ""))
def exact_quantiles(t):
    return kpis.quantiles(t("lineitem").withColumnRenamed("l_returnflag", "g"), "l_extendedprice", {"q1": 0.25, "mid": 0.5, "p95": 0.95}, ("g",))


# --- recordings: quality, windows and indicators ---

_TYPES = ["click", "view"]


def _channels(t) -> DataFrame:
    """Events as samples of two signals: the value, and its distance from 40."""
    return _events(t).select("user_id", "event_type", "event_id", "t", "x", F.abs(F.col("x") - 40).alias("y"))


_SIG = f"""{_E}, c AS (SELECT user_id, event_type, event_id, t, unnest(['x', 'y']) AS signal, unnest([x, abs(x - 40)]) AS v FROM e), d AS (SELECT *, t - lag(t) OVER w AS dt, CASE WHEN v = lag(v) OVER w THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY user_id, event_type, signal ORDER BY t, event_id)),
m AS (SELECT *, median(CASE WHEN dt > 0 THEN dt END) OVER (PARTITION BY user_id, event_type, signal) AS md FROM d),
a AS (SELECT user_id, event_type, signal, 1 / avg(dt) FILTER (dt > 0) AS fs, count(*) FILTER (dt > 2 * md) AS gaps, var_pop(v) AS va, count(*) AS n FROM m GROUP BY 1, 2, 3)"""


@query(f"WITH {_SIG} SELECT user_id, event_type, round(any_value(fs) FILTER (signal = 'x'), 6) AS x_fs, any_value(gaps) FILTER (signal = 'x') AS x_gaps, round(any_value(va) FILTER (signal = 'y'), 6) AS y_var, any_value(n) FILTER (signal = 'y') AS y_n_samples, any_value(va) FILTER (signal = 'x') < 1e-10 AS x_lowvar_flag FROM a GROUP BY 1, 2")
def quality_wide(t):
    keys = ("user_id", "event_type")
    w = signal_quality.quality_wide(signal_quality.quality_by_signal(_channels(t), {"x": 4, "y": 4}, keys, ("t", "event_id")), ["x", "y"], keys)
    return w.select(*keys, "x_fs", "x_gaps", "y_var", "y_n_samples", "x_lowvar_flag")


@query(f"WITH {_SIG} SELECT user_id, CASE WHEN bool_or(gaps > 3 OR (signal = 'x' AND va < 1e-10)) THEN 'FAIL' ELSE 'OK' END AS status FROM a GROUP BY 1")
def trial_status_wide(t):
    keys = ("user_id", "event_type")
    w = signal_quality.quality_wide(signal_quality.quality_by_signal(_channels(t), {"x": 4, "y": 4}, keys, ("t", "event_id")), ["x", "y"], keys)
    return signal_quality.trial_status_wide(w, "x", ["y"], TR, 3, 2.0).drop("n_bad")


# Windows of line items: an order is a trial's episode, line numbers are windows.
_FEAT = """f AS (SELECT l_suppkey AS subject, l_returnflag AS trial, l_orderkey % 3 AS episode_id, CAST(l_linenumber AS DOUBLE) AS t_start, l_linenumber + 0.2 + l_linenumber / 10.0 AS t_end, 1.0e0 AS t_on, l_linenumber + l_tax AS t_off, CASE WHEN l_linestatus = 'O' THEN 'lifting' ELSE 'drinking' END AS task_type,
l_orderkey % 5 > 0 AS has_imu, l_orderkey % 7 > 1 AS imu_ok, l_quantity AS gp, CASE WHEN l_discount > 0 THEN l_discount END AS gm, l_tax AS j1, CASE WHEN l_tax > 0.02 THEN l_discount END AS j2, CASE WHEN l_discount > 0.02 THEN l_tax * 10 END AS co, l_extendedprice AS r1, CASE WHEN l_quantity > 10 THEN l_quantity END AS r2 FROM lineitem)"""


def _feature_rows(t) -> DataFrame:
    n, c = F.col("l_linenumber"), F.col
    return t("lineitem").select(
        c("l_suppkey").alias("subject"), c("l_returnflag").alias("trial"), (c("l_orderkey") % 3).alias("episode_id"), n.cast("double").alias("t_start"), (n + 0.2 + n / 10.0).alias("t_end"), F.lit(1.0).alias("t_on"), (n + c("l_tax")).alias("t_off"),
        F.when(c("l_linestatus") == "O", "lifting").otherwise("drinking").alias("task_type"), (c("l_orderkey") % 5 > 0).alias("has_imu"), (c("l_orderkey") % 7 > 1).alias("imu_ok"), c("l_quantity").alias("IMU_all_gyro_mag_peak"),
        F.when(c("l_discount") > 0, c("l_discount")).alias("IMU_all_gyro_mag_mean"), c("l_tax").alias("IMU_a_jerk_norm_mean"), F.when(c("l_tax") > 0.02, c("l_discount")).alias("IMU_b_jerk_norm_mean"),
        F.when(c("l_discount") > 0.02, c("l_tax") * 10).alias("EMG_CoAct_Bic_Tri"), c("l_extendedprice").alias("EMG_Biceps_RMS"), F.when(c("l_quantity") > 10, c("l_quantity")).alias("EMG_Extensor_RMS"),
    )


_TRIALS = f"""{_FEAT}, w AS (SELECT *, t_end - t_start AS w, coalesce(has_imu AND imu_ok, false) AS good, (j1 + coalesce(j2, 0)) / (1 + CASE WHEN j2 IS NULL THEN 0 ELSE 1 END) AS jk, (r1 + coalesce(r2, 0)) / (1 + CASE WHEN r2 IS NULL THEN 0 ELSE 1 END) AS rm FROM f),
k AS (SELECT subject, trial, min(episode_id) AS episode_id, median(t_on) AS t_on, median(t_off) AS t_off, max(t_end) - min(t_start) AS whole, bool_or(good) AS g,
max(gp) FILTER (good) AS p1, max(gp) AS p2, sum(gm * w) FILTER (good AND gm IS NOT NULL) / sum(w) FILTER (good AND gm IS NOT NULL) AS m1, sum(gm * w) FILTER (gm IS NOT NULL) / sum(w) FILTER (gm IS NOT NULL) AS m2,
sum(jk * w) FILTER (good) / sum(w) FILTER (good) AS j1, sum(jk * w) / sum(w) AS j2, sum(co * w) FILTER (co IS NOT NULL) / sum(w) FILTER (co IS NOT NULL) AS cm, median(co) AS cd, avg(rm) AS ra, avg(r2) AS rd FROM w GROUP BY 1, 2),
ty AS (SELECT subject, trial, task_type, row_number() OVER (PARTITION BY subject, trial ORDER BY count(*) DESC, task_type) AS r FROM f GROUP BY 1, 2, 3),
kt AS (SELECT k.subject, k.trial, episode_id, ty.task_type, t_on, t_off, CASE WHEN t_off > t_on THEN t_off - t_on ELSE whole END AS kpi_duration_s, CASE WHEN g THEN p1 ELSE p2 END AS kpi_peak_gyro_mag, CASE WHEN g THEN m1 ELSE m2 END AS kpi_mean_gyro_mag,
CASE WHEN g THEN j1 ELSE j2 END AS kpi_mean_jerk, cm AS kpi_coact_win_mean, cd AS kpi_coact_win_median, ra AS kpi_abs_rms_mean, rd AS kpi_abs_rms_distal FROM k JOIN ty ON ty.subject = k.subject AND ty.trial = k.trial AND ty.r = 1)"""
_KPI = ["kpi_duration_s", "kpi_peak_gyro_mag", "kpi_mean_gyro_mag", "kpi_mean_jerk", "kpi_coact_win_mean", "kpi_coact_win_median", "kpi_abs_rms_mean", "kpi_abs_rms_distal"]


@query(f"WITH {_TRIALS} SELECT subject, trial, episode_id, task_type, round(t_on, 6) AS t_on, round(t_off, 6) AS t_off, " + ", ".join(f"round({c}, 6) AS {c}" for c in _KPI) + " FROM kt")
def trial_kpis(t):
    return kpis.window_kpis(_feature_rows(t))


_ENV = f"""{_E}, v AS (SELECT user_id AS subject, event_type AS sensor, t, greatest(x - 10, 0) AS x FROM e WHERE t BETWEEN 200000 AND 2000000), n AS (SELECT *, count(*) OVER (PARTITION BY subject) AS na, count(*) OVER (PARTITION BY subject, sensor) AS ns FROM v), q AS (SELECT * FROM n WHERE na >= 20 AND ns >= 4),
s AS (SELECT *, lead(t) OVER w - t AS dt, lead(x) OVER w AS nx FROM q WINDOW w AS (PARTITION BY subject, sensor ORDER BY t)), m AS (SELECT subject, sensor, max(x) AS pk, sum((x + nx) / 2 * dt) AS ar, sum(CASE WHEN x > 0.05 THEN dt ELSE 0 END) / sum(dt) AS du FROM s GROUP BY 1, 2)"""


@query(f"WITH {_ENV}, i AS (SELECT DISTINCT user_id AS subject FROM events), va AS (SELECT subject, count(*) >= 20 AS ok FROM v GROUP BY 1) SELECT i.subject, coalesce(any_value(va.ok), false) AS kpi_emg_valid, " + ", ".join(f"round(any_value(pk) FILTER (sensor = '{c}'), 6) AS kpi_peak_envn_{c}, round(any_value(ar) FILTER (sensor = '{c}'), 3) AS kpi_iemg_envn_{c}, round(any_value(du) FILTER (sensor = '{c}'), 6) AS kpi_duty_{c}" for c in _TYPES) + ", round(sum(ar), 3) AS kpi_iemg_envn_global_sum, round(max(pk), 6) AS kpi_peak_envn_global_max, sum(ar) IS NOT NULL AS kpi_has_emg_any FROM i LEFT JOIN va USING (subject) LEFT JOIN m USING (subject) GROUP BY i.subject")
def envelope_kpis(t):
    d = _events(t).select(F.col("user_id").alias("subject"), F.lit("one").alias("trial"), F.col("event_type").alias("sensor"), "t", (F.col("x") - 10).alias("env_norm"))
    spans = d.select("subject", "trial").distinct().withColumn("t_on", F.lit(200_000.0)).withColumn("t_off", F.lit(2_000_000.0))
    k = kpis.envelope_kpis(d, spans, _TYPES, ("click", "view"), least_sensor=4, least_any=20)
    areas = [c for c in k.columns if "iemg" in c]
    return k.withColumns({c: F.round(c, 3) for c in areas}).drop("trial", "kpi_has_bictri_pair", "kpi_coact_overlap_bic_tric", "kpi_cci_bic_tric")


_SUBJ = f"{_TRIALS}, x AS (SELECT *, (subject + ascii(trial)) % 3 > 0 AS emg_ok FROM kt)"


@query(f"""WITH {_SUBJ}, a AS (SELECT subject, median(kpi_abs_rms_distal) AS ef, median(kpi_peak_gyro_mag) AS mo, avg(kpi_duration_s) AS du, stddev_samp(kpi_mean_jerk) AS js, median(kpi_duration_s) FILTER (task_type = 'lifting') AS tl, count(*) AS n, count(*) FILTER (t_off > t_on) AS nv, count(*) FILTER (emg_ok) AS ne FROM x GROUP BY subject)
SELECT subject, round(ef, 6) AS kpi_abs_rms_distal__median, round(mo, 6) AS kpi_peak_gyro_mag__median, round(du, 6) AS kpi_duration_s__mean, round(js, 6) AS kpi_mean_jerk__std, round(tl, 6) AS kpi_duration_s__taskmed__lifting, n AS n_trials, nv AS n_trials_valid_interval, round(ne / n, 6) AS rate_emg_valid,
round((ef - avg(ef) OVER ()) / stddev_pop(ef) OVER () - (mo - avg(mo) OVER ()) / nullif(stddev_pop(mo) OVER (), 0), 6) AS kpi_NMD FROM a""")
def subject_kpis(t):
    trials = kpis.window_kpis(_feature_rows(t)).withColumn("kpi_emg_valid", (F.col("subject") + F.ascii("trial")) % 3 > 0).withColumn("kpi_has_bictri_pair", F.lit(False))
    s = kpis.subject_kpis(trials, ["lifting", "drinking"])
    return s.select("subject", "kpi_abs_rms_distal__median", "kpi_peak_gyro_mag__median", "kpi_duration_s__mean", "kpi_mean_jerk__std", "kpi_duration_s__taskmed__lifting", "n_trials", "n_trials_valid_interval", "rate_emg_valid", "kpi_NMD")


@query(f"""WITH {_FEAT}, a AS (SELECT subject, count(*) AS n_windows, median(t_end - t_start) AS wl, avg(CASE WHEN r1 IS NOT NULL OR r2 IS NOT NULL THEN 1.0 ELSE 0 END) FILTER (has_imu) AS ec, avg(CASE WHEN gp IS NULL AND gm IS NULL AND j1 IS NULL AND j2 IS NULL THEN 0 ELSE 1.0 END) FILTER (has_imu AND imu_ok) AS ic,
(avg(CASE WHEN r1 IS NULL THEN 1.0 ELSE 0 END) + avg(CASE WHEN r2 IS NULL THEN 1.0 ELSE 0 END)) / 2 AS en, avg(CASE WHEN co < 0 OR co > 1 THEN 1.0 ELSE 0 END) FILTER (co IS NOT NULL) AS cb FROM f GROUP BY subject)
SELECT subject, n_windows, round(wl, 6) AS win_len_med, round(ec, 6) AS emg_feat_cov, round(ic, 6) AS imu_feat_cov, round(en, 6) AS emg_nan_ratio, round(cb, 6) AS coact_bad_rate, CASE WHEN abs(wl - 0.6) <= 1e-3 THEN 'OK' WHEN abs(wl - 0.6) <= 5e-3 THEN 'WARN' ELSE 'FAIL' END AS check_window_length,
CASE WHEN en <= 0.1 THEN 'OK' WHEN en <= 0.25 THEN 'WARN' ELSE 'FAIL' END AS check_emg_missing, CASE WHEN cb = 0 THEN 'OK' WHEN cb <= 0.01 THEN 'WARN' WHEN cb > 0.01 THEN 'FAIL' END AS check_coact_range,
CASE WHEN abs(wl - 0.6) > 5e-3 OR coalesce(ec, 0) < 0.9 OR coalesce(ic, 0) < 0.9 THEN 'FAIL' ELSE 'WARN' END AS overall FROM a""")
def feature_table_report(t):
    f = _feature_rows(t).withColumn("has_emg", F.col("has_imu"))
    r = features.feature_table_report(f, ["subject", "trial"], ["nowhere"], ("subject",), 0.6)
    return r.select("subject", "n_windows", "win_len_med", "emg_feat_cov", "imu_feat_cov", "emg_nan_ratio", "coact_bad_rate", "check_window_length", "check_emg_missing", "check_coact_range", "overall")


@query("""WITH w AS (SELECT l_suppkey AS subject, l_returnflag AS trial, l_orderkey AS episode_id, l_linenumber * 0.1 AS t_start, l_linenumber * 0.1 + CASE WHEN l_tax > 0.01 THEN 0.2 ELSE 0.25 END AS t_end, 0.1 AS t_on, 0.1 + 0.2 * l_linenumber AS t_off, 1000 + l_quantity * 10 AS fe, 100 + l_quantity * 2 AS fi, l_discount < 0.1 AS eo, l_discount > 0 AS io, l_quantity * 8 AS en, l_quantity AS i FROM lineitem),
e AS (SELECT subject, trial, episode_id, max(t_off) - 0.1 AS s, count(*) AS n FROM w GROUP BY 1, 2, 3), d AS (SELECT subject, count(*) AS ne, median(abs(n - (greatest(floor((s - 0.2) / 0.1 + 1e-9), 0) + 1))) AS dm FROM e GROUP BY 1),
a AS (SELECT subject, count(*) AS n, avg(CASE WHEN abs(t_end - t_start - 0.2) <= 1e-6 + 2e-6 THEN 1.0 ELSE 0 END) AS wr, median(fe) AS fe, median(fi) AS fi, avg(CASE WHEN eo THEN 1.0 ELSE 0 END) AS er, avg(CASE WHEN io THEN 1.0 ELSE 0 END) AS ir, median(abs(en - fe * 0.2) / (fe * 0.2)) AS ae FROM w GROUP BY 1)
SELECT subject, n AS n_windows, round(wr, 6) AS win_len_ratio, round(fe, 6) AS fs_emg_median, round(er, 6) AS emg_ok_ratio, round(ir, 6) AS imu_ok_ratio, round(ae, 6) AS ape_emg_median, ne AS n_episodes, CASE WHEN fe BETWEEN 1100 AND 1400 THEN 'OK' ELSE 'FAIL' END AS check_fs_emg, CASE WHEN fi BETWEEN 120 AND 180 THEN 'OK' ELSE 'FAIL' END AS check_fs_imu,
CASE WHEN er >= 0.98 THEN 'OK' WHEN er >= 0.9 THEN 'WARN' ELSE 'FAIL' END AS check_emg_ok, CASE WHEN ae <= 0.05 THEN 'OK' WHEN ae <= 0.2 THEN 'WARN' ELSE 'FAIL' END AS check_emg_samples FROM a JOIN d USING (subject)""")
def window_table_report(t):
    n, c = F.col("l_linenumber"), F.col
    w = t("lineitem").select(
        c("l_suppkey").alias("subject"), c("l_returnflag").alias("trial"), c("l_orderkey").alias("episode_id"), (n * 0.1).alias("t_start"), (n * 0.1 + F.when(c("l_tax") > 0.01, 0.2).otherwise(0.25)).alias("t_end"), F.lit(0.1).alias("t_on"),
        (0.1 + 0.2 * n).alias("t_off"), (1000 + c("l_quantity") * 10).alias("fs_emg_est"), (100 + c("l_quantity") * 2).alias("fs_imu_est"), (c("l_discount") < 0.1).alias("emg_ok"), (c("l_discount") > 0).alias("imu_ok"), (c("l_quantity") * 8).alias("emg_n"), c("l_quantity").alias("imu_n"),
    )
    r = reports.window_table_report(w)
    return r.select("subject", "n_windows", "win_len_ratio", "fs_emg_median", "emg_ok_ratio", "imu_ok_ratio", "ape_emg_median", "n_episodes", "check_fs_emg", "check_fs_imu", "check_emg_ok", "check_emg_samples")


@query(f"""WITH {_E}, d AS (SELECT user_id, t, avg(x) FILTER (event_type = 'click') AS a, avg(x) FILTER (event_type = 'view') AS b FROM e WHERE event_type IN ('click', 'view') GROUP BY 1, 2), s AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS dt FROM d),
g AS (SELECT user_id, min(t) AS t0, max(t) AS t1, count(*) AS n, median(dt) AS dt FROM s GROUP BY 1 HAVING count(*) >= 3), p AS (SELECT user_id, t0 + i * dt AS t FROM (SELECT *, unnest(range(CAST(ceil((t1 + 1e-12 - t0) / dt) AS BIGINT))) AS i FROM g WHERE ceil((t1 + 1e-12 - t0) / dt) >= 3)),
u AS (SELECT user_id, t, a AS v, 'a' AS c FROM d WHERE a IS NOT NULL UNION ALL SELECT user_id, t, b, 'b' FROM d WHERE b IS NOT NULL), k AS (SELECT user_id, t, c FROM p, (VALUES ('a'), ('b')) x(c)),
lo AS (SELECT k.*, u.t AS pt, u.v AS pv FROM k ASOF LEFT JOIN u ON k.user_id = u.user_id AND k.c = u.c AND k.t >= u.t), hi AS (SELECT lo.*, u.t AS ft, u.v AS fv FROM lo ASOF LEFT JOIN u ON lo.user_id = u.user_id AND lo.c = u.c AND lo.t <= u.t),
iv AS (SELECT user_id, t, c, CASE WHEN pt IS NULL THEN fv WHEN ft IS NULL OR pt = t THEN pv ELSE pv + (fv - pv) * (t - pt) / (ft - pt) END AS v FROM hi WHERE pt IS NOT NULL OR ft IS NOT NULL),
ab AS (SELECT user_id, t, greatest(any_value(v) FILTER (c = 'a'), 0) AS a, greatest(any_value(v) FILTER (c = 'b'), 0) AS b FROM iv GROUP BY 1, 2 HAVING count(*) = 2),
q AS (SELECT user_id, t - lag(t) OVER w AS dt, least(a, b) AS l, greatest(a, b) AS h, lag(least(a, b)) OVER w AS pl, lag(greatest(a, b)) OVER w AS ph FROM ab WINDOW w AS (PARTITION BY user_id ORDER BY t))
SELECT user_id, round(sum((l + pl) / 2 * dt) / nullif(sum((h + ph) / 2 * dt), 0), 6) AS coact FROM q GROUP BY 1 HAVING sum((h + ph) / 2 * dt) > 0""")
def coactivation_on_grid(t):
    return features.coactivation_on_grid(_events(t), "x", "click", "view", TR, "event_type")


@query("""WITH d AS (SELECT c_custkey AS subject, CASE c_custkey % 2 WHEN 0 THEN 'ALS_' ELSE 'Healthy_' END || c_custkey AS name, c_acctbal AS v FROM customer), r AS (SELECT *, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM d),
a AS (SELECT count(*) FILTER (subject % 2 = 0) AS n1, count(*) FILTER (subject % 2 = 1) AS n2, sum(r) FILTER (subject % 2 = 0) AS r1, avg(v) FILTER (subject % 2 = 0) AS m1, avg(v) FILTER (subject % 2 = 1) AS m2 FROM r)
SELECT measure, n1, n2, round(r1 - n1 * (n1 + 1) / 2, 6) AS u, round(s * m1, 6) AS mean_first, round(s * m2, 6) AS mean_second FROM a, (VALUES ('kpi_NMD', 1), ('kpi_NMD_z_effort', 2), ('kpi_NMD_z_motion', 3)) v(measure, s)""")
def mismatch_check(t):
    name = F.concat(F.when(F.col("c_custkey") % 2 == 0, "ALS_").otherwise("Healthy_"), F.col("c_custkey").cast("string"))
    v = F.col("c_acctbal")
    s = t("customer").select(name.alias("subject"), v.alias("kpi_NMD"), (2 * v).alias("kpi_NMD_z_effort"), (3 * v).alias("kpi_NMD_z_motion"))
    return phases.mismatch_check(s).select("measure", "n1", "n2", "u", "mean_first", "mean_second")


# --- joins of facts, intervals, importances ---


@query(f"""WITH {_SUPS}, l AS (SELECT feature, v FROM s UNPIVOT (v FOR feature IN (a, b, c, d))) SELECT feature, round(median(v), 6) AS median, round(skewness(v), 6) AS skew FROM l GROUP BY feature""")
def feature_report_skew(t):
    s = t("lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.median("l_quantity").alias("a"), F.avg("l_extendedprice").alias("b"), F.stddev_samp("l_discount").alias("c"), F.avg("l_tax").alias("d"))
    return kpis.feature_report(s, ["a", "b", "c", "d"]).select("feature", "median", "skew")


@query("SELECT p_type AS feature, r_name AS area, n FROM (SELECT p_type, count(*) AS n FROM part GROUP BY 1) LEFT JOIN (SELECT r_name, CASE r_regionkey WHEN 0 THEN 'PROMO' ELSE 'ECONOMY' || r_regionkey END AS f FROM region) ON p_type = f")
def feature_metadata(t):
    selected = t("part").groupBy(F.col("p_type").alias("feature")).agg(F.count(F.lit(1)).alias("n"))
    about = t("region").select(F.when(F.col("r_regionkey") == 0, "PROMO").otherwise(F.concat(F.lit("ECONOMY"), F.col("r_regionkey").cast("string"))).alias("feature"), F.col("r_name").alias("area"))
    return kpis.with_metadata(selected, about).select("feature", "area", "n")


@query("SELECT s_suppkey AS subject, round(m, 6) AS duration_median FROM supplier LEFT JOIN (SELECT l_suppkey, median(l_quantity) AS m FROM lineitem WHERE l_suppkey % 4 > 0 GROUP BY 1) ON s_suppkey = l_suppkey")
def subject_duration(t):
    trials = t("lineitem").where("l_suppkey % 4 > 0").select(F.col("l_suppkey").alias("subject"), F.col("l_quantity").alias("kpi_duration_s"))
    return kpis.with_duration(t("supplier").select(F.col("s_suppkey").alias("subject")), trials)


@query("""WITH v AS (SELECT s_nationkey % 3 AS g, s_acctbal AS v, row_number() OVER (PARTITION BY s_nationkey % 3 ORDER BY s_acctbal) - 1 AS i, count(*) OVER (PARTITION BY s_nationkey % 3) AS n FROM supplier),
d AS (SELECT g, rd, CAST('0x' || substr(md5(rd || '-' || v.i || '-42'), 1, 15) AS BIGINT) % n AS i FROM range(2000) q(rd), v), m AS (SELECT g, rd, median(v.v) AS m FROM d JOIN v USING (g, i) GROUP BY 1, 2)
SELECT g, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM m GROUP BY g""")
def bootstrap_ci_by_group(t):
    return statistics.bootstrap_median_by_group(t("supplier").withColumn("g", F.col("s_nationkey") % 3), "s_acctbal", "g")


@query()
def shap_table(t):
    from pulseframe.queries import _importances

    return _importances(t).select("feature", "mean_abs_shap", "share", "rank", "direction", "gini")
