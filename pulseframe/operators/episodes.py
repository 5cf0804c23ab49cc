"""Movement episodes: gates, thresholds, hysteresis, merging, pruning, curation.

A gate has columns of its trial's keys, t and gate.  Everything is windows over
one partitioning by trial, so a trial is shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.operators.ranks import steady_mean

TRIAL = ("subject", "trial")


def _w(keys, *order) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def binned_gate(df: DataFrame, columns: dict[str, float], keys=TRIAL, bin_s: float = 0.001) -> DataFrame:
    """Mean t and the largest of weight * median(column) in bins (half to even) over all sensors."""
    b = df.groupBy(*keys, F.rint(F.col("t") / bin_s).cast("long").alias("bin")).agg(steady_mean("t").alias("t"), *[F.median(c).alias(c) for c in columns])
    parts = [F.col(c) * w for c, w in columns.items()]
    return b.select(*keys, "t", (F.greatest(*parts) if len(parts) > 1 else parts[0]).alias("gate"))


def emg_gate(df: DataFrame, columns: str | list[str], keys=TRIAL, bin_s: float = 0.001) -> DataFrame:
    """Mean t and, over all sensors, median of the largest of a row's normalised envelopes, in bins."""
    names = [columns] if isinstance(columns, str) else columns
    top = F.greatest(*names) if len(names) > 1 else F.col(names[0])
    return df.groupBy(*keys, F.rint(F.col("t") / bin_s).cast("long").alias("bin")).agg(steady_mean("t").alias("t"), F.median(top).alias("gate")).drop("bin")


def median_filter(df: DataFrame, x: str = "gate", kernel: int = 5, keys=TRIAL, order=("t",)) -> DataFrame:
    """Running median, with zeros beyond both ends; an even kernel grows by one."""
    half = (kernel + (kernel % 2 == 0)) // 2
    w = _w(keys, *order)
    frame = w.rowsBetween(-half, half)
    missing = F.lit(2 * half + 1) - F.count(F.lit(1)).over(frame)
    padded = F.array_sort(F.concat(F.collect_list(x).over(frame), F.array_repeat(F.lit(0.0), missing.cast("int"))))
    return df.withColumn(x, F.get(padded, F.lit(half)))


def tkeo(df: DataFrame, x: str = "gate", keys=TRIAL, order=("t",)) -> DataFrame:
    """x[i]**2 - x[i-1] * x[i+1]; the ends stay."""
    w = _w(keys, *order)
    inner = F.col(x) * F.col(x) - F.lag(x).over(w) * F.lead(x).over(w)
    return df.withColumn(x, F.coalesce(inner, F.col(x)))


def boost_flat_gate(df: DataFrame, factor: float = 1.5, least_var: float = 1e-4, keys=TRIAL) -> DataFrame:
    return df.withColumn("gate", F.col("gate") * F.when(F.var_pop("gate").over(Window.partitionBy(*keys)) < least_var, factor).otherwise(1.0))


def boost_emg_gate(df: DataFrame, mode: Column | str = "x5", least_var: float = 1e-5, keys=TRIAL) -> DataFrame:
    """Scales flat gates: five times (mode x5), or by a 25th of the 95th percentile, four times if that is not positive (mode p95)."""
    every = Window.partitionBy(*keys)
    p95 = F.percentile("gate", 0.95).over(every)
    mode = F.lit(mode) if isinstance(mode, str) else mode
    scale = F.when(mode == "x5", 5.0).when(p95 > 0, p95 / 25).otherwise(4.0)
    return df.withColumn("gate", F.col("gate") * F.when(F.var_pop("gate").over(every) < least_var, scale).otherwise(1.0))


def _c(v: Column | float | str) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def mad_thresholds(df: DataFrame, k_on: Column | float = 5.0, k_off: Column | float = 3.5, rule: Column | str = "none", keys=TRIAL) -> DataFrame:
    """Adds med, mad (+1e-12), p95, thr_on = med + k_on * mad and thr_off, with factors that the rule lowers where onsets are out of reach.

    standard: if thr_on is over p95, k_on falls to 0.7 of it (1 at least); weak: if it is over 1.1 * p95, to 0.65 (1.2 at least);
    standard_als: if it is over 0.85 * p95, or p95 under 60, k_on falls to 0.55 (1.5 at least) and k_off to 0.6 (0.8 at least).
    """
    every = Window.partitionBy(*keys)
    k_on, k_off, rule = _c(k_on), _c(k_off), _c(rule)
    d = df.withColumn("med", F.median("gate").over(every)).withColumn("p95", F.percentile("gate", 0.95).over(every))
    d = d.withColumn("mad", F.median(F.abs(F.col("gate") - F.col("med"))).over(every) + 1e-12)
    on, p95 = F.col("med") + k_on * F.col("mad"), F.col("p95")
    # Share of p95 that the onset may reach, factor and least value of k_on.
    table = {"standard": (1.0, 0.7, 1.0), "standard_als": (0.85, 0.55, 1.5), "weak": (1.1, 0.65, 1.2)}
    lowered, lower = F.lit(False), k_on
    for name, (share, factor, least) in table.items():
        high = (on > p95 * share) | (p95 < 60.0) if name == "standard_als" else on > p95 * share
        lowered = F.when(rule == name, high).otherwise(lowered)
        lower = F.when((rule == name) & high, F.greatest(F.lit(least), k_on * factor)).otherwise(lower)
    off = F.when((rule == "standard_als") & lowered, F.greatest(F.lit(0.8), k_off * 0.6)).otherwise(k_off)
    return d.withColumn("adjusted", lowered).withColumn("thr_on", F.col("med") + lower * F.col("mad")).withColumn("thr_off", F.col("med") + off * F.col("mad"))


def tremor_thresholds(df: DataFrame, k_on: Column | float = 4.8, k_off: Column | float = 6.2, percentile: float = 15.0, off_multiplier: Column | float = 1.3, keys=TRIAL) -> DataFrame:
    """Thresholds from the quiet part (samples up to a percentile, all if under 10); thr_on is at most the median."""
    every = Window.partitionBy(*keys)
    d = df.withColumn("__cut", F.percentile("gate", percentile / 100).over(every)).withColumn("med", F.median("gate").over(every))
    quiet = F.when(F.col("gate") <= F.col("__cut"), F.col("gate"))
    d = d.withColumn("__n", F.count(quiet).over(every)).withColumn("__q", F.when((F.col("__n") < 10) | (F.col("gate") <= F.col("__cut")), F.col("gate")))
    d = d.withColumn("__m", F.median("__q").over(every))
    d = d.withColumn("mad", F.median(F.abs(F.col("__q") - F.col("__m"))).over(every) + 1e-12)
    d = d.withColumn("thr_on", F.least(F.col("__m") + _c(k_on) * F.col("mad"), F.col("med"))).withColumn("thr_off", (F.col("__m") + _c(k_off) * F.col("mad")) * _c(off_multiplier))
    return d.drop("__cut", "__n", "__q", "__m")


def hysteresis(df: DataFrame, keys=TRIAL, least_s: float | Column = 0.0, order=("t",), carry=()) -> DataFrame:
    """t_on, t_off of stretches opened at gate >= thr_on and closed, from the next sample on, at gate <= thr_off.

    A sample sets, resets, toggles (both hold: thresholds are inverted) or holds
    the state, so the state is the last set or reset, inverted by every toggle
    since.  An open stretch closes at the last sample.  Samples follow `order`,
    which need not be that of time; `carry` columns, one value a trial, come along.
    """
    w = _w(keys, *order)
    up, down = F.col("gate") >= F.col("thr_on"), F.col("gate") <= F.col("thr_off")
    d = df.where(F.col("gate").isNotNull()).withColumn("__set", F.when(up & ~down, 1).when(down & ~up, 0)).withColumn("__toggle", (up & down).cast("int"))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("__toggles", F.sum("__toggle").over(so_far))
    d = d.withColumn("__base", F.coalesce(F.last("__set", True).over(so_far), F.lit(0))).withColumn("__since", F.coalesce(F.last(F.when(F.col("__set").isNotNull(), F.col("__toggles")), True).over(so_far), F.lit(0)))
    d = d.withColumn("__state", (F.col("__base") + F.col("__toggles") - F.col("__since")) % 2)
    before = F.coalesce(F.lag("__state").over(w), F.lit(0))
    d = d.withColumn("__opens", ((F.col("__state") == 1) & (before == 0)).cast("int")).withColumn("__closes", (F.col("__state") == 0) & (before == 1))
    last = F.last("t").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    d = d.withColumn("__k", F.sum("__opens").over(so_far)).withColumn("__last", last)
    e = d.where("__k > 0").groupBy(*keys, "__k").agg(
        F.min(F.when(F.col("__opens") == 1, F.col("t"))).alias("t_on"), F.min(F.when(F.col("__closes"), F.col("t"))).alias("__off"), F.first("__last").alias("__last"), *[F.first(c).alias(c) for c in carry]
    )
    e = e.withColumn("t_off", F.coalesce("__off", "__last"))
    return e.where(F.col("t_off") - F.col("t_on") >= least_s).select(*keys, "t_on", "t_off", *carry)


def pad_clip(episodes: DataFrame, spans: DataFrame, pad: float, keys=TRIAL) -> DataFrame:
    """Widens episodes by pad, inside the trial's span (keys, t_first, t_last)."""
    j = episodes.join(spans, list(keys))
    return j.withColumn("t_on", F.greatest(F.col("t_on") - pad, F.col("t_first"))).withColumn("t_off", F.least(F.col("t_off") + pad, F.col("t_last"))).drop("t_first", "t_last")


def merge_close(episodes: DataFrame, gap: float | Column, keys=TRIAL, carry=()) -> DataFrame:
    """Joins episodes whose start is at most `gap` after all earlier ends. Stages with several gaps equal one with the largest."""
    w = _w(keys, "t_on", "t_off")
    end = F.max("t_off").over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = episodes.withColumn("__new", F.coalesce(F.col("t_on") - end > gap, F.lit(True)).cast("int"))
    d = d.withColumn("__k", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "__k").agg(F.min("t_on").alias("t_on"), F.max("t_off").alias("t_off"), *[F.first(c).alias(c) for c in carry]).drop("__k")


def with_peak(episodes: DataFrame, gate: DataFrame, keys=TRIAL) -> DataFrame:
    """Adds duration_s and peak_gate, the largest gate within [t_on, t_off], of episodes that do not overlap; those without samples go.

    Starts and samples form one ordered union, in which a sample belongs to the last start unless that one has ended.
    """
    names = [c for c in episodes.columns if c not in keys]
    e = episodes.select(*keys, F.struct(*names).alias("__e"), F.col("t_on").alias("__t"), F.lit(0).alias("__s"), F.lit(None).cast("double").alias("__g"))
    u = e.unionByName(gate.select(*keys, F.col("t").alias("__t"), F.lit(1).alias("__s"), F.col("gate").alias("__g")), allowMissingColumns=True)
    w = _w(keys, "__t", "__s").rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn("__e", F.last("__e", True).over(w)).where((F.col("__s") == 1) & (F.col("__t") <= F.col("__e.t_off")))
    return u.groupBy(*keys, "__e").agg(F.max("__g").alias("peak_gate")).select(*keys, "__e.*", "peak_gate").withColumn("duration_s", F.col("t_off") - F.col("t_on"))


def numbered(episodes: DataFrame, keys=TRIAL) -> DataFrame:
    return episodes.withColumn("episode_id", F.row_number().over(_w(keys, "t_on", "t_off")))


def valid_only(episodes: DataFrame, least_s: float | None = None, least_peak: float | None = None) -> DataFrame:
    keep = F.lit(True)
    if least_s is not None:
        keep = keep & (F.col("duration_s") >= least_s)
    if least_peak is not None:
        keep = keep & (F.col("peak_gate") >= least_peak)
    return episodes.where(keep)


def longest(episodes: DataFrame, n: int, keys=TRIAL) -> DataFrame:
    return episodes.withColumn("__r", F.row_number().over(_w(keys, F.desc("duration_s"), "t_on"))).where(F.col("__r") <= n).drop("__r")


def prune(episodes: DataFrame, least_s: float | Column = 2.0, keep_over: int | Column = 3, short_s: float | Column = 4.0, weak_peak: float | Column = 0.0, keys=TRIAL) -> DataFrame:
    """Drops short episodes; with more than `keep_over` left the weakest; then, with `keep_over` or more, the second if short or weak.

    The second is by ascending peak if the weakest was dropped, else by time.
    """
    d = episodes.where(F.col("duration_s") >= least_s)
    every = Window.partitionBy(*keys)
    d = d.withColumn("__n", F.count(F.lit(1)).over(every)).withColumn("__weak", F.row_number().over(_w(keys, "peak_gate", "t_on")))
    cut = F.col("__n") > keep_over
    d = d.withColumn("__cut", cut).where(~(cut & (F.col("__weak") == 1)))
    d = d.withColumn("__left", F.count(F.lit(1)).over(every))
    second = F.when(F.col("__cut"), F.row_number().over(_w(keys, "peak_gate", "t_on"))).otherwise(F.row_number().over(_w(keys, "t_on"))) == 2
    d = d.withColumn("__second", second)
    return d.where(~((F.col("__left") >= keep_over) & F.col("__second") & ((F.col("duration_s") < short_s) | (F.col("peak_gate") < weak_peak)))).drop("__n", "__weak", "__cut", "__left", "__second")


def curate(episodes: DataFrame, rules: DataFrame, subject: str = "subject", trial: str = "trial") -> DataFrame:
    """Drops episodes by rules (subject, trial as a part of the name in any case, action, k; optionally position) and renumbers.

    A subject's rules follow one another by position, each on what the ones before it left, over all its
    trials that match together: drop_all, drop_longest, drop_last, last_longest (the later of the two longest)
    or drop_kth in order of t_on.  The trial of the first match is renumbered.  Each round takes the next rule of
    every subject, so there are as many rounds as the subject with most rules has.
    """
    r = rules if "position" in rules.columns else rules.withColumn("position", F.lit(0))
    r = r.withColumn("__i", F.row_number().over(_w(("subject",), "position", "trial", "action", "k")))
    r = r.select(F.col("subject").alias(subject), F.lower("trial").alias("__t"), F.col("action").alias("__a"), F.col("k").alias("__kth"), "__i")
    e = episodes if "episode_id" in episodes.columns else numbered(episodes, (subject, trial))
    names = e.columns
    for i in range(int(r.agg(F.max("__i")).first()[0] or 0)):
        d = e.join(F.broadcast(r.where(F.col("__i") == i + 1).drop("__i")), subject, "left")  # a rule a subject
        d = d.withColumn("__hit", F.coalesce(F.contains(F.lower(trial), F.col("__t")), F.lit(False)))
        of = (subject, "__hit")
        d = d.withColumn("__k", F.row_number().over(_w(of, "t_on", trial))).withColumn("__last", F.row_number().over(_w(of, F.desc("t_on"), F.desc(trial)))).withColumn("__long", F.row_number().over(_w(of, F.desc("duration_s"), "t_on")))
        later = F.max(F.when(F.col("__long") <= 2, F.col("__k"))).over(Window.partitionBy(*of))
        drop = {"drop_all": F.lit(True), "drop_longest": F.col("__long") == 1, "drop_last": F.col("__last") == 1, "last_longest": F.col("__k") == later, "drop_kth": F.col("__k") == F.col("__kth")}
        gone = F.lit(False)
        for action, which in drop.items():
            gone = F.when(F.col("__a") == action, which).otherwise(gone)
        head = F.first(F.when(F.col("__hit"), F.col(trial)), True).over(_w(of, "t_on", trial).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        d = d.withColumn("__head", head).withColumn("__gone", F.col("__hit") & F.coalesce(gone, F.lit(False))).where("NOT __gone")
        again = F.when(F.col("__head") == F.col(trial), F.row_number().over(_w((subject, trial), "t_on"))).otherwise(F.col("episode_id"))
        e = d.withColumn("episode_id", again.cast("int")).select(*names)
    return e


def prefer_first(first: DataFrame, second: DataFrame, keys=TRIAL) -> DataFrame:
    """All of first, and second for trials that first lacks."""
    return first.unionByName(second.join(first.select(*keys).distinct(), list(keys), "left_anti"))


def _with_spans(gate: DataFrame, least_n: int, order, keys) -> DataFrame:
    """Adds the first and the last time in order; trials of under least_n samples go."""
    every = _w(keys, *order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = gate.where(F.col("gate").isNotNull() & F.col("t").isNotNull())
    d = d.withColumn("t_first", F.first("t").over(every)).withColumn("t_last", F.last("t").over(every)).withColumn("__n", F.count(F.lit(1)).over(every))
    return d.where(F.col("__n") >= least_n).drop("__n")


def _found(g: DataFrame, order, least_raw_s, pad, gap, least_s, least_peak: Column, levels, carry, keys) -> DataFrame:
    """Stretches over thresholds, widened, merged, long enough and high enough; parameters are constant in a trial."""
    values = {"__raw": least_raw_s, "__pad": pad, "__gap": gap, "__least": least_s}
    g = g.withColumns({k: _c(v) for k, v in values.items()} | {"__peak": least_peak})
    held = [*levels, *carry, "t_first", "t_last", *values, "__peak"]
    e = hysteresis(g, keys, F.col("__raw"), order, held) if isinstance(least_raw_s, Column) else hysteresis(g, keys, least_raw_s, order, held)
    e = e.withColumn("t_on", F.greatest(F.col("t_on") - F.col("__pad"), "t_first")).withColumn("t_off", F.least(F.col("t_off") + F.col("__pad"), "t_last")).drop("t_first", "t_last", "__raw", "__pad")
    e = merge_close(e, F.col("__gap"), keys, [*levels, *carry, "__gap", "__least", "__peak"]).where(F.col("t_off") - F.col("t_on") >= F.col("__least"))
    return numbered(with_peak(e, g, keys).where(F.col("peak_gate") >= F.col("__peak")).drop("__gap", "__least", "__peak"), keys)


def detect_mad(gate: DataFrame, k_on: Column | float = 5.0, k_off: Column | float = 3.5, gap: Column | float | tuple = (0.45, 0.8, 1.2), pad: Column | float = 0.15, least_raw_s: float = 0.0, least_s: Column | float = 1.8, peak_multiplier: Column | float = 2.5, rule: Column | str = "standard", least_n: int = 20, order=("t",), carry=(), keys=TRIAL) -> DataFrame:
    """Episodes over robust thresholds; a peak must reach med + peak_multiplier * mad.  Merging by several gaps in turn is merging by the largest."""
    gap = float(max(gap)) if isinstance(gap, tuple) else gap
    g = mad_thresholds(_with_spans(gate, least_n, order, keys), k_on, k_off, rule, keys)
    return _found(g, order, least_raw_s, pad, gap, least_s, F.col("med") + _c(peak_multiplier) * F.col("mad"), ("thr_on", "thr_off"), carry, keys)


def detect_tremor(gate: DataFrame, k_on: Column | float = 4.8, k_off: Column | float = 6.2, gap: Column | float = 0.4, pad: Column | float = 0.15, least_raw_s: Column | float = 0.3, least_s: Column | float = 1.8, least_peak: Column | float = 28.0, percentile: float = 15.0, off_multiplier: Column | float = 1.3, least_n: int = 20, order=("t",), carry=(), keys=TRIAL) -> DataFrame:
    """Episodes over thresholds of the quiet part, with one merge and an absolute peak."""
    g = tremor_thresholds(_with_spans(gate, least_n, order, keys), k_on, k_off, percentile, off_multiplier, keys)
    return _found(g, order, least_raw_s, pad, gap, least_s, _c(least_peak).cast("double"), (), carry, keys)
