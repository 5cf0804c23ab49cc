"""Small-sample statistics as relational plans; p-values that need a distribution's code are in exact_tests."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseframe.operators.ranks import quantiles, row_ranks, spread, value_places, value_ranks


def describe(df: DataFrame, x: str, group: str, total: str = "All") -> DataFrame:
    """n, mean, sd, quartiles, IQR, extremes, skewness, excess kurtosis, Tukey outliers; each group and all together (grouping sets).

    Outliers are counted against the quartiles, which come back as one row a group.
    """
    d = df.select(F.col(group).alias("__g"), F.col(x).cast("double").alias("x")).where("x IS NOT NULL")
    a = d.groupingSets([["__g"], []], "__g").agg(
        F.grouping("__g").alias("__all"), F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"),
        F.min("x").alias("least"), F.max("x").alias("largest"), F.skewness("x").alias("skew"), F.kurtosis("x").alias("kurt"),
    )
    # Each row counts in its group and in all: one set of keys for quantiles and fences.
    twice = d.select("x", F.explode(F.array(F.struct(F.col("__g").alias("__h"), F.lit(0).alias("__f")), F.struct(F.lit(None).cast(d.schema["__g"].dataType).alias("__h"), F.lit(1).alias("__f")))).alias("k")).select("x", "k.*")
    q = quantiles(twice, "x", {"q1": 0.25, "median": 0.5, "q3": 0.75}, ("__h", "__f"))
    a = a.join(q, F.col("__g").eqNullSafe(F.col("__h")) & (F.col("__all") == F.col("__f"))).drop("__h", "__f").withColumn("iqr", F.col("q3") - F.col("q1"))
    low, high = F.col("q1") - 1.5 * F.col("iqr"), F.col("q3") + 1.5 * F.col("iqr")
    fences = a.select(F.col("__g").alias("__k"), F.col("__all").alias("__a"), low.alias("__lo"), high.alias("__hi"))
    beyond = twice.join(fences, F.col("__h").eqNullSafe(F.col("__k")) & (F.col("__f") == F.col("__a")))
    out = beyond.groupBy("__h", "__f").agg(F.count_if((F.col("x") < F.col("__lo")) | (F.col("x") > F.col("__hi"))).alias("n_outliers"))
    j = a.join(out, F.col("__g").eqNullSafe(F.col("__h")) & (F.col("__all") == F.col("__f")))
    name = F.when(F.col("__all") == 1, F.lit(total)).otherwise(F.col("__g")).alias(group)
    return j.select(name, "n", "mean", "sd", "median", "q1", "q3", "iqr", "least", "largest", "skew", "kurt", "n_outliers")


def outlier_rows(df: DataFrame, key: str, x: str, group: str) -> DataFrame:
    """group, key, x of rows outside the fences of their group."""
    q = quantiles(df, x, {"__q1": 0.25, "__q3": 0.75}, (group,)).withColumnRenamed(group, "__g")
    fence = 1.5 * (F.col("__q3") - F.col("__q1"))
    d = df.select(group, key, x).join(q, F.col(group).eqNullSafe(F.col("__g")))
    return d.where((F.col(x) < F.col("__q1") - fence) | (F.col(x) > F.col("__q3") + fence)).select(group, key, x)


def tukey_outliers(df: DataFrame, key: str, x: str, group: str) -> DataFrame:
    """outlier_rows() as a report: the names of a group's outliers in one cell, which has to be short enough for a reader."""
    return outlier_rows(df, key, x, group).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list(F.col(key).cast("string"))), ",").alias("who"))


def normal_sf(z: Column) -> Column:
    """Upper tail of the normal distribution (Abramowitz and Stegun 26.2.17, error under 7.5e-8)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def mann_whitney(df: DataFrame, x: str, group: str, first: str, second: str, keys=()) -> DataFrame:
    """n1, n2, U of the first group, rank-biserial 1 - 2U/(n1 n2), tie-corrected Z with continuity, normal p, and |Z|/sqrt(N) without corrections."""
    d = df.where(F.col(group).isin(first, second) & F.col(x).isNotNull()).select(*keys, F.col(group).alias("__g"), F.col(x).alias("__x"))
    # Counts by value come first, so that copies of a value are one row.
    v, t = value_ranks(d, "__x", keys, __one=F.count_if(F.col("__g") == first)), F.col("n").cast("double")
    a = v.groupBy(*keys).agg(F.sum("__one").alias("n1"), F.sum(F.col("n") - F.col("__one")).alias("n2"), F.sum(F.col("rank") * F.col("__one")).alias("r1"), F.sum(t * t * t - t).alias("ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    mid = n1 * n2 / 2
    plain = F.sqrt(n1 * n2 * (n + 1) / 12)
    tied = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1))))
    a = a.withColumn("u", u).withColumn("rank_biserial", 1 - F.try_divide(2 * u, n1 * n2)).withColumn("z", F.try_divide(F.greatest(F.abs(u - mid) - 0.5, F.lit(0.0)), tied))
    return a.withColumn("p_normal", F.least(2 * normal_sf(F.col("z")), F.lit(1.0))).withColumn("r", F.try_divide(F.abs(u - mid), plain) / F.sqrt(n)).drop("r1", "ties")


def wilcoxon(df: DataFrame, before: str, after: str, keys=()) -> DataFrame:
    """Signed-rank W = min(W+, W-) of non-zero differences, its effect 1 - 4W/(n(n+1)), medians; nothing where all differences are 0."""
    d = df.select(*keys, (F.col(after) - F.col(before)).alias("d"), F.col(before).alias("b"), F.col(after).alias("a")).where("d IS NOT NULL")
    ranked = d.where("d <> 0").withColumn("__abs", F.abs("d"))
    v = value_ranks(ranked, "__abs", keys, __up=F.count_if(F.col("d") > 0), __down=F.count_if(F.col("d") < 0))
    w = v.groupBy(*keys).agg(F.sum(F.col("rank") * F.col("__up")).alias("w_plus"), F.sum(F.col("rank") * F.col("__down")).alias("w_minus"), F.sum("n").alias("n_nonzero"))
    m = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.median("b").alias("median_before"), F.median("a").alias("median_after"))
    out = m.join(w, list(keys)) if keys else m.crossJoin(w)  # one row each
    n = F.col("n_nonzero")
    return out.withColumn("w", F.least("w_plus", "w_minus")).withColumn("effect_r", 1 - 4 * F.col("w") / (n * (n + 1)))


def friedman(df: DataFrame, subject: str, task: str, x: str, tasks: list[str], least: int = 4) -> DataFrame:
    """Tie-corrected chi-square over subjects with all tasks; for three tasks p = exp(-chi2 / 2)."""
    k = len(tasks)
    wide = df.groupBy(subject).pivot(task, tasks).agg(F.median(x)).dropna()
    long = row_ranks(wide.unpivot([subject], tasks, "t", "v"), "v", (subject,), "r", k)
    long = long.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy(subject, "v")).cast("double"))
    ties = long.agg(F.sum(F.col("c") * F.col("c") - 1).alias("ties"), F.count_distinct(subject).cast("double").alias("n"))
    sums = long.groupBy("t").agg(F.sum("r").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("ss"))
    n = F.col("n")
    raw = 12 / (n * k * (k + 1)) * F.col("ss") - 3 * n * (k + 1)
    out = ties.crossJoin(sums).where(n >= least).withColumn("chi2", F.try_divide(raw, 1 - F.col("ties") / (n * k * (k * k - 1))))
    out = out.select(n.cast("long").alias("n"), "chi2")
    return out.withColumn("p", F.exp(-F.col("chi2") / 2)) if k == 3 else out


def benjamini_hochberg(df: DataFrame, p: str, family=(), name: str = "p_fdr") -> DataFrame:
    """Adjusted p-values in each family; NULLs stay and do not count.  A family, which is a report's tests, is one task."""
    d = df.withColumn("__ok", F.col(p).isNotNull())
    w = Window.partitionBy(*family, "__ok")
    n = F.count(F.lit(1)).over(w)
    ascending = n - F.row_number().over(w.orderBy(F.desc(p))) + 1
    d = d.withColumn("__q", F.col(p) * n / ascending)
    low = F.min("__q").over(w.orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, 0))
    return d.withColumn(name, F.when(F.col("__ok"), F.least(low, F.lit(1.0)))).drop("__ok", "__q")


def bonferroni(p: Column | str, k: int = 3) -> Column:
    return F.least(k * (F.col(p) if isinstance(p, str) else p), F.lit(1.0))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, observed, expected of all cells."""
    rows, cols = df.groupBy(a).agg(F.count(F.lit(1)).alias("__ra")), df.groupBy(b).agg(F.count(F.lit(1)).alias("__cb"))
    cells = rows.crossJoin(cols)  # a cell of the table each
    seen = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("observed"))
    n = df.agg(F.count(F.lit(1)).alias("__n"))
    out = cells.join(seen, [a, b], "left").crossJoin(n).withColumn("observed", F.coalesce("observed", F.lit(0)))
    return out.select(a, b, "observed", (F.col("__ra") * F.col("__cb") / F.col("__n")).alias("expected"))


def association(df: DataFrame, a: str, b: str) -> DataFrame:
    """chi2 (no continuity correction), Cramer's V, n."""
    t = crosstab(df, a, b)
    s = t.agg(F.sum(F.pow(F.col("observed") - F.col("expected"), 2) / F.col("expected")).alias("chi2"), F.sum("observed").alias("n"), F.count_distinct(a).alias("__r"), F.count_distinct(b).alias("__c"))
    k = F.least(F.col("__r"), F.col("__c")) - 1
    return s.select("n", "chi2", F.sqrt(F.try_divide(F.col("chi2"), F.col("n") * k)).alias("cramers_v"))


def detector_metrics(df: DataFrame, predicted: Column, truth: Column, keys=()) -> DataFrame:
    """TP, TN, FP, FN, sensitivity, specificity, PPV, NPV, accuracy, balanced accuracy, macro F1, phi."""
    a = df.groupBy(*keys).agg(F.count_if(predicted & truth).alias("tp"), F.count_if(~predicted & ~truth).alias("tn"), F.count_if(predicted & ~truth).alias("fp"), F.count_if(~predicted & truth).alias("fn"))
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    d = F.try_divide
    f1, f0 = d(2 * tp, 2 * tp + fp + fn), d(2 * tn, 2 * tn + fp + fn)
    return a.withColumns({
        "sensitivity": d(tp, tp + fn), "specificity": d(tn, tn + fp), "ppv": d(tp, tp + fp), "npv": d(tn, tn + fn), "accuracy": d(tp + tn, tp + tn + fp + fn),
        "balanced_accuracy": (d(tp, tp + fn) + d(tn, tn + fp)) / 2, "macro_f1": (f1 + f0) / 2, "phi": d(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
    })


def auc(df: DataFrame, score: str, truth: Column, keys=()) -> DataFrame:
    """Area under the ROC curve from average ranks."""
    d = df.withColumn("__y", truth.cast("int"))
    v = value_ranks(d, score, keys, __ones=F.sum("__y"))
    n1 = F.sum("__ones").cast("double")
    n0 = F.sum("n") - n1
    return v.groupBy(*keys).agg(F.try_divide(F.sum(F.col("rank") * F.col("__ones")) - n1 * (n1 + 1) / 2, n1 * n0).alias("auc"))


def paired_conditions(df: DataFrame, keys, condition: str, x: str, first: str, second: str) -> DataFrame:
    """Medians of both conditions side by side, by conditional aggregation (no self-join)."""
    m = lambda c: F.median(F.when(F.col(condition) == c, F.col(x)))
    return df.groupBy(*keys).agg(m(first).alias("a"), m(second).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")


def gap_closure(df: DataFrame, x: str, group: str, condition: str, patients: str, healthy: str, base: str, aided: str, keys=(), least: int = 3) -> DataFrame:
    """Medians of the healthy and of patients without and with aid, the share of the gap that aid closes, and the healthy interquartile band.

    Negative shares are gaps that grew.  Without `least` values on each of the three sides there is no row.  The tests
    of both gaps are mann_whitney() on the two rows of gap_samples().
    """
    at = lambda g, c: (F.col(group) == g) & (F.col(condition) == c)
    side = F.when(at(healthy, base), "healthy").when(at(patients, base), "before").when(at(patients, aided), "after")
    d = df.select(*keys, side.alias("__s"), F.col(x).cast("double").alias("__x")).where("__s IS NOT NULL AND __x IS NOT NULL")
    by = [*keys, "__s"]
    q = quantiles(d, "__x", {"q1": 0.25, "m": 0.5, "q3": 0.75}, by).join(d.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), by)
    of = lambda s, c: F.max(F.when(F.col("__s") == s, F.col(c)))
    a = q.groupBy(*keys).agg(*[of(s, "m").alias(s) for s in ("healthy", "before", "after")], of("healthy", "q1").alias("q1"), of("healthy", "q3").alias("q3"), *[of(s, "n").alias(f"n_{s}") for s in ("healthy", "before", "after")])
    full = (F.col("n_healthy") >= least) & (F.col("n_before") >= least) & (F.col("n_after") >= least)
    a = a.where(full).withColumn("gap_before", F.col("before") - F.col("healthy")).withColumn("gap_after", F.col("after") - F.col("healthy"))
    inside = lambda c: F.col(c).between(F.col("q1"), F.col("q3"))
    a = a.withColumn("pct_closed", F.try_divide(F.abs("gap_before") - F.abs("gap_after"), F.abs("gap_before")) * 100)
    return a.withColumn("in_band_before", inside("before")).withColumn("in_band_after", inside("after")).withColumn("entered_band", inside("after") & ~inside("before"))


def gap_samples(df: DataFrame, x: str, group: str, condition: str, patients: str, healthy: str, base: str, aided: str, keys=()) -> DataFrame:
    """keys, gap ('baseline' or 'residual'), side ('patients' or 'healthy'), x: the samples behind both gaps' tests."""
    is_healthy = (F.col(group) == healthy) & (F.col(condition) == base)
    gaps = F.when(is_healthy, F.array(F.lit("baseline"), F.lit("residual"))).when((F.col(group) == patients) & (F.col(condition) == base), F.array(F.lit("baseline"))).when((F.col(group) == patients) & (F.col(condition) == aided), F.array(F.lit("residual")))
    return df.select(*keys, F.explode(gaps).alias("gap"), F.when(is_healthy, "healthy").otherwise("patients").alias("side"), x)


def log_ratio_shift(df: DataFrame, key: str, group: str, task: str, a: str, b: str, patients: str, healthy: str, least: int = 3, overall: str = "Overall") -> DataFrame:
    """Median log-ratio of two measures by subject, compared between groups over all tasks and in each: medians, shift, U and effect of every scope."""
    # A key's rows are shuffled once for both scopes, before each is copied into its two.
    own = df.select(key, group, task, a, b).repartition(key)
    d = scoped(own, task, overall).groupBy("scope", key, group).agg(F.median(a).alias("__a"), F.median(b).alias("__b")).where("__a > 0 AND __b > 0")
    d = d.withColumn("lr", F.ln(F.col("__a") / F.col("__b")))
    m = lambda g: F.median(F.when(F.col(group) == g, F.col("lr")))
    mid = d.groupBy("scope").agg(m(patients).alias("patients_log"), m(healthy).alias("healthy_log"))
    u = mann_whitney(d, "lr", group, patients, healthy, ("scope",)).where(F.least("n1", "n2") >= least)
    return u.join(mid, "scope").withColumn("shift", F.col("patients_log") - F.col("healthy_log")).withColumn("patients_ratio", F.exp("patients_log")).withColumn("healthy_ratio", F.exp("healthy_log"))


def selectivity(df: DataFrame, a: str, b: str, group: str, patients: str, healthy: str, low: float = 0.8, high: float = 1.25) -> DataFrame:
    """Fold changes of two measures, their ratio and its class."""
    long = df.where(F.col(group).isin(patients, healthy)).select(F.col(group).alias("__g"), F.explode(F.array(*[F.struct(F.lit(n).alias("m"), F.col(c).cast("double").alias("v")) for n, c in (("a", a), ("b", b))])).alias("x")).select("__g", "x.*")
    m = quantiles(long, "v", {"mid": 0.5}, ("__g", "m"))
    of = lambda g, n: F.max(F.when((F.col("__g") == g) & (F.col("m") == n), F.col("mid")))
    s = m.agg(*[F.try_divide(of(patients, n), of(healthy, n)).alias(f"fold_{n}") for n in "ab"]).withColumn("index", F.try_divide("fold_a", "fold_b"))
    return s.withColumn("verdict", F.when(F.col("index") > high, "a selective").when(F.col("index") < low, "b selective").otherwise("uniform"))


def outside_reference(df: DataFrame, key: str, x: str, group: str, healthy: str, width: float = 1.96) -> DataFrame:
    """Rows beyond mean +- width * sd of the healthy."""
    h = df.where(F.col(group) == healthy).agg(F.avg(x).alias("__m"), F.stddev_samp(x).alias("__s"))
    d = df.crossJoin(F.broadcast(h))  # one row
    return d.select(key, group, x, (F.abs(F.col(x) - F.col("__m")) > width * F.col("__s")).alias("outside"))


def scoped(df: DataFrame, task: str, overall: str = "Overall") -> DataFrame:
    """Each row in the scope of its task and in the overall one."""
    return df.withColumn("scope", F.explode(F.array(F.lit(overall), F.col(task))))


def scoped_median(df: DataFrame, task: str, x: str, overall: str = "Overall") -> DataFrame:
    """scope, n and median of all rows and of each task."""
    d = scoped(df.where(F.col(x).isNotNull()), task, overall).select("scope", x)
    return d.groupBy("scope").agg(F.count(F.lit(1)).alias("n")).join(quantiles(d, x, {"median": 0.5}, ("scope",)), "scope")


def best_by_effect(df: DataFrame, keys, label: str, r: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(label, F.abs(r)).alias("best"), F.max(F.abs(r)).alias("best_r"))


def grid_posterior(spark: SparkSession, stats: DataFrame, mu=(-3.0, 3.0, 601), sigma=(0.01, 4.0, 400), sd_mu: float = 0.5, sd_sigma: float = 0.5) -> DataFrame:
    """Posterior of a normal mean on a grid, from one row (n, s, ss: count, sum, sum of squares): mean, sd, 95 % bounds, P(mu < 0), P(mu < ln 0.9), P(mu < ln 0.8).

    Priors: normal on mu, half-normal on sigma. The grid is fixed, so it crosses a bounded number of rows.
    """
    axis = lambda lo, hi, k, name: spark.range(k).select((lo + F.col("id") * ((hi - lo) / (k - 1))).alias(name))
    g = axis(*mu, "mu").crossJoin(F.broadcast(axis(*sigma, "sigma"))).crossJoin(F.broadcast(stats))
    square = F.col("ss") - 2 * F.col("mu") * F.col("s") + F.col("n") * F.col("mu") * F.col("mu")
    log_p = -F.col("n") * F.ln("sigma") - square / (2 * F.col("sigma") * F.col("sigma")) - F.col("mu") * F.col("mu") / (2 * sd_mu**2) - F.col("sigma") * F.col("sigma") / (2 * sd_sigma**2)
    g = g.select("mu", log_p.alias("l"))
    top = g.agg(F.max("l").alias("top"))
    m = g.crossJoin(F.broadcast(top)).groupBy("mu").agg(F.sum(F.exp(F.col("l") - F.col("top"))).alias("w"))
    every, so_far = Window.partitionBy(), Window.orderBy("mu").rowsBetween(Window.unboundedPreceding, 0)
    m = m.withColumn("w", F.col("w") / F.sum("w").over(every)).withColumn("cdf", F.sum("w").over(so_far))
    below = lambda v: F.coalesce(F.sum(F.when(F.col("mu") < v, F.col("w"))), F.lit(0.0))
    a = m.agg(
        F.sum(F.col("mu") * F.col("w")).alias("mean"), F.sum(F.col("mu") * F.col("mu") * F.col("w")).alias("__m2"), F.min(F.when(F.col("cdf") >= 0.025, F.col("mu"))).alias("lo"),
        F.min(F.when(F.col("cdf") >= 0.975, F.col("mu"))).alias("hi"), below(0.0).alias("p_below_0"), below(math.log(0.9)).alias("p_below_10pct"), below(math.log(0.8)).alias("p_below_20pct"),
    )
    return a.withColumn("sd", F.sqrt(F.col("__m2") - F.col("mean") * F.col("mean"))).withColumn("pct", 100 * (F.exp("mean") - 1)).drop("__m2")


def uniform(*parts: Column) -> Column:
    """A fixed pseudo-random integer below 2**60 of some values: the first 15 hex digits of the MD5 of their text."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long")


def permutation_association(df: DataFrame, key: str, a: str, b: str, rounds: int = 10_000, seed: int = 42) -> DataFrame:
    """Share of label shuffles whose chi-square reaches the observed one; every round is a partition of its own."""
    base = df.select(key, F.col(a).alias("a"), F.col(b).alias("b"))
    spark = df.sparkSession
    p = base.crossJoin(spark.range(rounds).withColumnRenamed("id", "round"))  # a stated number of copies of a small table
    w = Window.partitionBy("round")
    p = p.withColumn("i", F.row_number().over(w.orderBy(key))).withColumn("j", F.row_number().over(w.orderBy(uniform(F.col(key), F.col("round"), F.lit(seed)), key)))
    shuffled = p.select("round", F.col("i"), "a").join(p.select("round", F.col("j").alias("i"), "b"), ["round", "i"])
    real = base.select(F.lit(-1).cast("long").alias("round"), F.lit(0).alias("i"), "a", "b")
    cells = shuffled.unionByName(real).groupBy("round", "a", "b").agg(F.count(F.lit(1)).alias("o"))
    ra, cb, n = (F.sum("o").over(Window.partitionBy("round", *k)) for k in (("a",), ("b",), ()))
    # Summing o^2 / e over cells with counts gives chi2 + n, so empty cells need no rows.
    chi = cells.withColumn("x", F.col("o") * F.col("o") / (ra * cb / n)).groupBy("round").agg((F.sum("x") - F.sum("o")).alias("chi2"))
    observed = chi.where("round = -1").select(F.col("chi2").alias("observed"))
    return chi.where("round >= 0").crossJoin(F.broadcast(observed)).groupBy("observed").agg(F.avg((F.col("chi2") >= F.col("observed") - 1e-9).cast("double")).alias("p"), F.count(F.lit(1)).alias("rounds"))


def bootstrap_median_by_group(df: DataFrame, x: str, group: str, rounds: int = 2000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """group, lo, hi: bootstrap_median() of each group."""
    return _bootstrap_median(df.where(F.col(group).isNotNull()), x, [group], rounds, seed, level)


def bootstrap_median(df: DataFrame, x: str, rounds: int = 2000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Percentile interval of the median over resamples drawn by hash."""
    return _bootstrap_median(df, x, [], rounds, seed, level)


#: Draws that one row of the plan unfolds to.
BLOCK = 8192


def _bootstrap_median(df: DataFrame, x: str, keys: list[str], rounds: int, seed: int, level: float) -> DataFrame:
    """keys, lo, hi.  A round draws places of the ordered values, so its median is at the middle of the places drawn, and only these are looked up.

    The middle of n drawn places has a deviation of sqrt(n) / 2 around n / 2: places within 16 deviations are kept, those below
    are counted, so a round holds 16 sqrt(n) numbers at most; samples of up to 1,024 rows keep all.  A middle outside
    raises an error, which no hash of a round's number will meet.
    """
    from pulseframe.operators.resampling import at_places

    v = value_places(df.select(*keys, F.col(x).cast("double").alias("__x")), "__x", keys)
    sizes = df.where(F.col(x).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 0")
    blocks = sizes.crossJoin(df.sparkSession.range(rounds).withColumnRenamed("id", "round"))  # a row a group and round
    blocks = spread(blocks.withColumn("__b", F.explode(F.sequence(F.lit(0), F.expr(f"(__n - 1) div {BLOCK}")))), *keys, "round", "__b")
    draws = blocks.withColumn("k", F.explode(F.sequence(F.col("__b") * BLOCK, F.least(F.col("__b") * BLOCK + BLOCK, "__n") - 1)))
    draws = draws.select(*keys, "__n", "round", F.pmod(uniform(F.col("round"), F.col("k"), F.lit(seed)), F.col("__n")).alias("i"))
    half = F.when(F.col("__n") <= 1024, F.col("__n")).otherwise(F.ceil(8 * F.sqrt("__n")))
    low, high = F.expr("__n div 2") - half, F.expr("__n div 2") + half
    near = F.sort_array(F.collect_list(F.when((F.col("i") >= low) & (F.col("i") <= high), F.col("i"))))
    r = draws.groupBy(*keys, "__n", "round").agg(F.count_if(F.col("i") < low).alias("__below"), near.alias("__near"))
    middle = F.explode(F.array(F.expr("(__n - 1) div 2 - __below"), F.expr("__n div 2 - __below")))
    r = r.select(*keys, "__n", "round", "__near", middle.alias("__m"))
    place = F.when((F.col("__m") >= 0) & (F.col("__m") < F.size("__near")), F.get("__near", F.col("__m").cast("int"))).otherwise(F.raise_error(F.lit("the median of a round lies outside the places kept")).cast("long"))
    drawn = r.select(*keys, "__n", "round", (place + 1).alias("place"), F.lit(0.5).alias("half"))
    m = at_places(drawn, v, keys)
    return m.groupBy(*keys).agg(F.percentile("m", (1 - level) / 2).alias("lo"), F.percentile("m", (1 + level) / 2).alias("hi"))
