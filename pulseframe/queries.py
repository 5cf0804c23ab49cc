"""Queries over the engine's operators on the test tables, each with its SQL where SQL can state it.

`events` stands for channels: subject user_id, sensor event_type, t in seconds
since 2024, x = value.  `lineitem` stands for paired conditions and tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.functions import dims
from pulseframe.operators import batteries, clustering, episodes, exact_tests, features, kpis, mixed_model, normalisation, reports, signal_quality, signals, statistics, supervised, trees, windowing
from pulseframe.sources import exports

_QUERIES: dict = {}
_SQL: dict[str, str] = {}

CH, TR = ("user_id", "event_type"), ("user_id",)
ZERO = 1_704_067_200_000_000  # 2024-01-01 in microseconds
_E = f"e AS (SELECT user_id, event_type, event_id, (epoch_us(ts) - {ZERO}) / 1e6 AS t, value AS x FROM events)"
_G = f"{_E}, g AS (SELECT user_id, avg(t) AS t, median(x) AS gate FROM e GROUP BY user_id, CAST(round_even(t / 21600, 0) AS BIGINT))"
_TH = (
    f"{_G}, m AS (SELECT *, median(gate) OVER (PARTITION BY user_id) AS med FROM g), "
    "th AS (SELECT *, median(abs(gate - med)) OVER (PARTITION BY user_id) + 1e-12 AS mad FROM m)"
)


def query(sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _rounded(f(lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")))

        _QUERIES[f.__name__] = run
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to 6 digits, so that the order of additions does not show."""
    return df.select(*[(F.round(c, 6) + 0.0).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def _events(t) -> DataFrame:
    return t("events").select("user_id", "event_type", "event_id", ((F.unix_micros(F.col("ts").cast("timestamp")) - ZERO) / 1e6).alias("t"), F.col("value").alias("x"))


def _gate(t) -> DataFrame:
    return episodes.binned_gate(_events(t), {"x": 1.0}, TR, 21600.0)


def _thresholds(t, on: float = 0.5, off: float = 0.1) -> DataFrame:
    return episodes.mad_thresholds(_gate(t), on, off, keys=TR)


def _episodes(t) -> DataFrame:
    g = _thresholds(t)
    return episodes.with_peak(episodes.merge_close(episodes.hysteresis(g, TR), 20_000.0, TR), g, TR)


def _hyst(on: float | str, off: float | str, with_: str = "") -> str:
    """Episodes by the recurrence itself, over factors of mad or, with names, over columns of a table th2."""
    if isinstance(on, str):
        levels, source = f"{on} AS hi, {off} AS lo", "th2"
    else:
        levels, source = f"med + {on} * mad AS hi, med + {off} * mad AS lo", "th"
    return f"""WITH RECURSIVE {_TH}{with_},
h AS (SELECT user_id, t, gate, {levels}, row_number() OVER (PARTITION BY user_id ORDER BY t) AS i FROM {source}),
s AS (SELECT user_id, i, t, gate >= hi AS open FROM h WHERE i = 1
      UNION ALL SELECT h.user_id, h.i, h.t, CASE WHEN s.open THEN NOT h.gate <= h.lo ELSE h.gate >= h.hi END FROM s JOIN h ON h.user_id = s.user_id AND h.i = s.i + 1),
o AS (SELECT *, coalesce(lag(open) OVER w, false) AS was, max(t) OVER (PARTITION BY user_id) AS tail FROM s WINDOW w AS (PARTITION BY user_id ORDER BY i)),
k AS (SELECT *, count(*) FILTER (open AND NOT was) OVER (PARTITION BY user_id ORDER BY i) AS n FROM o),
ep AS (SELECT user_id, n, min(t) FILTER (open AND NOT was) AS t_on, coalesce(min(t) FILTER (NOT open AND was), any_value(tail)) AS t_off FROM k WHERE n > 0 GROUP BY user_id, n)"""


def _padded(pad: float, gap: float, least: float, raw: float = 0.0) -> str:
    """Episodes of ep, widened inside the trial, merged, long enough (mg), with their peaks (pk)."""
    return f""", sp AS (SELECT user_id, min(t) AS a, max(t) AS b FROM g GROUP BY user_id HAVING count(*) >= 20),
pc AS (SELECT ep.user_id, greatest(t_on - {pad}, a) AS t_on, least(t_off + {pad}, b) AS t_off FROM ep JOIN sp USING (user_id) WHERE t_off - t_on >= {raw}),
w1 AS (SELECT *, max(t_off) OVER (PARTITION BY user_id ORDER BY t_on, t_off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM pc),
w2 AS (SELECT *, sum(CASE WHEN pe IS NULL OR t_on - pe > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t_on, t_off ROWS UNBOUNDED PRECEDING) AS kk FROM w1),
mg AS (SELECT user_id, min(t_on) AS t_on, max(t_off) AS t_off FROM w2 GROUP BY user_id, kk HAVING max(t_off) - min(t_on) >= {least}),
pk AS (SELECT mg.user_id, t_on, t_off, max(th.gate) AS peak, any_value(med) AS med, any_value(mad) AS mad FROM mg JOIN th ON th.user_id = mg.user_id AND th.t BETWEEN t_on AND t_off GROUP BY mg.user_id, t_on, t_off)"""


_EP = f"""{_hyst(0.5, 0.1)},
w1 AS (SELECT *, max(t_off) OVER (PARTITION BY user_id ORDER BY t_on, t_off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM ep),
w2 AS (SELECT *, sum(CASE WHEN pe IS NULL OR t_on - pe > 20000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t_on, t_off ROWS UNBOUNDED PRECEDING) AS kk FROM w1),
mg AS (SELECT user_id, min(t_on) AS t_on, max(t_off) AS t_off FROM w2 GROUP BY user_id, kk),
pk AS (SELECT mg.user_id, t_on, t_off, max(g.gate) AS peak_gate, t_off - t_on AS duration_s FROM mg JOIN g ON g.user_id = mg.user_id AND g.t BETWEEN t_on AND t_off GROUP BY ALL)"""


# --- signal quality ---


@query(f"""WITH {_E}, d AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) AS dt FROM e),
m AS (SELECT *, median(CASE WHEN dt > 0 THEN dt END) OVER (PARTITION BY user_id, event_type) AS md FROM d)
SELECT user_id, event_type, round(1 / avg(dt) FILTER (dt > 0), 6) AS fs, count(*) FILTER (dt > 0 AND dt > 2 * md) AS gaps, round(min(dt) FILTER (dt > 0), 6) AS dt_min,
round(max(dt) FILTER (dt > 0), 6) AS dt_max, round(max(t) - min(t), 6) AS duration_s, count(*) AS n_samples FROM m GROUP BY ALL""")
def signal_fs_gaps(t):
    return signal_quality.sampling(_events(t), CH, order=("t", "event_id"))


_RUNS = f"""{_E}, r AS (SELECT *, floor(x / 40) AS v FROM e),
n AS (SELECT *, CASE WHEN v = lag(v) OVER w THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM n),
l AS (SELECT *, count(*) OVER (PARTITION BY user_id, run) AS len FROM k)"""


@query(f"WITH {_RUNS} SELECT user_id, round(avg(CASE WHEN len >= 4 THEN 1.0 ELSE 0.0 END), 6) AS saturation_ratio, count(*) AS n_finite FROM l GROUP BY user_id")
def saturation_runs(t):
    return signal_quality.saturation(_events(t).withColumn("v", F.floor(F.col("x") / 40).cast("double")), "v", 4, TR, ("t", "event_id"))


@query(f"""WITH {_RUNS}, p AS (SELECT user_id, event_id, max(CASE WHEN len >= 4 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 1 AS saturated FROM l)
SELECT * FROM p""")
def saturation_mask_expanded(t):
    d = _events(t).withColumn("v", F.floor(F.col("x") / 40).cast("double"))
    m = signal_quality.saturation_mask(d, "v", 4, TR, ("t", "event_id"))
    return signal_quality.expand_mask(m, "saturated", 2, TR, ("t", "event_id")).select("user_id", "event_id", "saturated")


@query(f"WITH {_E} SELECT user_id, event_type, round(var_pop(x), 6) AS var, coalesce(var_pop(x) < 50, true) AS dead, round(avg(CASE WHEN x IS NULL THEN 1.0 ELSE 0.0 END), 6) AS nan_ratio FROM e GROUP BY ALL")
def dead_channel(t):
    return _events(t).groupBy(*CH).agg(F.var_pop("x").alias("var"), signal_quality.dead_signal("x", 50.0).alias("dead"), signal_quality.missing_share("x").alias("nan_ratio"))


@query(f"""WITH {_E}, d AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id, event_type ORDER BY t) AS dt FROM e),
m AS (SELECT *, median(CASE WHEN dt > 0 THEN dt END) OVER (PARTITION BY user_id, event_type) AS md FROM d),
c AS (SELECT user_id, event_type, count(*) FILTER (dt > 2 * md) AS gaps, var_pop(x) < 1e-10 AS dead FROM m GROUP BY ALL)
SELECT user_id, CASE WHEN bool_or(gaps > 3 OR coalesce(dead, true)) THEN 'FAIL' ELSE 'OK' END AS status, count(*) FILTER (gaps > 3 OR coalesce(dead, true)) AS n_bad FROM c GROUP BY user_id""")
def trial_status(t):
    report = signal_quality.quality_report(_events(t), "x", 60, CH, ("t",))
    return signal_quality.trial_status(report, TR, gap_limit=3, saturation_limit=2.0)


@query(f"""WITH {_E}, v AS (SELECT *, floor(x / 40) AS v FROM e), d AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) AS dt FROM v),
m AS (SELECT *, median(CASE WHEN dt > 0 THEN dt END) OVER (PARTITION BY user_id, event_type) AS md FROM d),
c AS (SELECT user_id, event_type, count(*) FILTER (dt > 2 * md) AS gaps, coalesce(var_pop(v) < 1e-10, true) AS dead FROM m GROUP BY ALL),
n AS (SELECT *, CASE WHEN v = lag(v) OVER w THEN 0 ELSE 1 END AS new FROM v WHERE v IS NOT NULL WINDOW w AS (PARTITION BY user_id, event_type ORDER BY t, event_id)),
k AS (SELECT *, sum(new) OVER (PARTITION BY user_id, event_type ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM n),
l AS (SELECT *, count(*) OVER (PARTITION BY user_id, event_type, run) AS len FROM k),
s AS (SELECT user_id, event_type, avg(CASE WHEN len >= 4 THEN 1.0 ELSE 0.0 END) AS ratio FROM l GROUP BY ALL),
b AS (SELECT user_id, gaps > 3 OR dead OR coalesce(ratio > 0.3, false) AS bad FROM c LEFT JOIN s USING (user_id, event_type))
SELECT user_id, CASE WHEN bool_or(bad) THEN 'FAIL' ELSE 'OK' END AS status, count(*) FILTER (bad) AS n_bad FROM b GROUP BY user_id""")
def trial_status_saturated(t):
    d = _events(t).withColumn("v", F.floor(F.col("x") / 40).cast("double"))
    report = signal_quality.quality_report(d, "v", 4, CH, ("t", "event_id"))
    return signal_quality.trial_status(report, TR, gap_limit=3, saturation_limit=0.3)


@query(f"""WITH {_E}, a AS (SELECT user_id, count(DISTINCT event_type) AS n_trials, count(DISTINCT floor(t / 864000)) AS n_sensors, count(*) AS n_rows FROM (SELECT DISTINCT user_id, event_type, floor(t / 864000) * 864000 AS t FROM e) GROUP BY user_id)
SELECT *, CASE WHEN n_trials = 5 AND n_sensors = 3 AND n_rows = 15 THEN 'OK' ELSE 'WARN' END AS status FROM a""")
def completeness(t):
    d = _events(t).select(F.col("user_id").alias("subject"), F.col("event_type").alias("trial"), F.floor(F.col("t") / 864000).alias("sensor")).distinct()
    return signal_quality.completeness(d, 5, 3).withColumnRenamed("subject", "user_id")


@query("""WITH l AS (UNPIVOT (SELECT l_returnflag, l_quantity, l_extendedprice, l_discount FROM lineitem) ON l_quantity, l_extendedprice, l_discount INTO NAME metric VALUE v)
SELECT l_returnflag, metric, round(min(v), 6) AS least, round(median(v), 6) AS middle, round(max(v), 6) AS largest FROM l GROUP BY ALL""")
def range_summary(t):
    return signal_quality.range_summary(t("lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], ["l_returnflag"])


@query("""WITH d AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
h AS (SELECT doc_id, min(n) AS header_row FROM d WHERE regexp_matches(line, '[0-9]{3}') GROUP BY doc_id)
SELECT h.doc_id, CAST(header_row AS INTEGER) AS header_row, CAST(max(d.n) AS INTEGER) AS names_row FROM h LEFT JOIN d ON d.doc_id = h.doc_id AND d.n < header_row AND d.n > header_row - 50 AND regexp_matches(d.line, '[A-Z].*,') GROUP BY h.doc_id, header_row""")
def header_line_search(t):
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return exports.header_lines(lines, ("doc_id",), "n", "line", "[0-9]{3}", "[A-Z].*,")


@query("""SELECT p_partkey, regexp_replace(p_name, '\\s+', ' ', 'g') || '|Biceps' AS names FROM part""")
def regex_names_dedupe(t):
    line = F.concat(F.col("p_name"), F.lit("  ("), F.col("p_partkey").cast("string"), F.lit("), Biceps (12), "), F.col("p_name"), F.lit(" (7)"))
    return t("part").select("p_partkey", F.array_join(exports.names_in(line), "|").alias("names"))


_ALIASES = "CASE p_partkey % 6 WHEN 0 THEN ' Trap_Desc ' WHEN 1 THEN 'EXT' WHEN 2 THEN 'abd  5 dito' WHEN 3 THEN 'Flessore-carpo' WHEN 4 THEN 'deltoide' ELSE p_type END"


@query(f"""WITH a AS (SELECT p_partkey, {_ALIASES} AS raw FROM part)
SELECT p_partkey, CASE lower(trim(regexp_replace(replace(replace(raw, '_', ' '), '-', ' '), '\\s+', ' ', 'g'))) WHEN 'trap desc' THEN 'Trapezius' WHEN 'ext' THEN 'Extensor' WHEN 'abd 5 dito' THEN 'AbdV' WHEN 'flessore carpo' THEN 'Flexor' WHEN 'deltoide' THEN 'Deltoid' ELSE raw END AS name,
regexp_replace(regexp_replace(regexp_replace(trim(raw), '\\s+', '_', 'g'), '[^A-Za-z0-9_]', '', 'g'), '_+', '_', 'g') AS token FROM a""")
def alias_normalise(t):
    raw = F.expr(_ALIASES)
    return t("part").select("p_partkey", dims.canon_name(raw).alias("name"), dims.safe_token(raw).alias("token"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_discount AS d, l_tax AS x,
CASE l_orderkey % 4 WHEN 0 THEN 'Drinking_noexo' WHEN 1 THEN 'lifting_exo' WHEN 2 THEN 'pick&place_high_exo' ELSE 'rest' END AS trial, CASE l_linenumber % 3 WHEN 0 THEN 'ALS_Subject_1' WHEN 1 THEN 'Healthy_2' ELSE 'x' END AS who FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN trial LIKE 'Dr%' THEN 'drinking' WHEN trial LIKE 'li%' THEN 'lifting' WHEN trial LIKE 'pi%' THEN 'pick_place' ELSE 'other' END AS task,
CASE WHEN trial LIKE '%noexo' THEN 'noexo' WHEN trial LIKE '%exo' THEN 'exo' ELSE 'unknown' END AS condition, CASE WHEN who LIKE 'ALS%' THEN 'ALS' WHEN who LIKE 'H%' THEN 'Healthy' END AS grp,
round(sqrt(q * q + d * d + x * x), 6) AS magnitude, round(CASE WHEN d > 0 AND x > 0 THEN ln(d / x) END, 6) AS log_ratio, round((x - d) / nullif(d, 0) * 100, 6) AS change,
CASE WHEN d * 10 >= 0.5 THEN 'large' WHEN d * 10 >= 0.3 THEN 'medium' ELSE 'small' END AS effect FROM s""")
def scalar_labels(t):
    trial = F.expr("CASE l_orderkey % 4 WHEN 0 THEN 'Drinking_noexo' WHEN 1 THEN 'lifting_exo' WHEN 2 THEN 'pick&place_high_exo' ELSE 'rest' END")
    who = F.expr("CASE l_linenumber % 3 WHEN 0 THEN 'ALS_Subject_1' WHEN 1 THEN 'Healthy_2' ELSE 'x' END")
    return t("lineitem").select(
        "l_orderkey", "l_linenumber", dims.task_of(trial).alias("task"), dims.condition_of(trial).alias("condition"), dims.group_of(who).alias("grp"), dims.magnitude("l_quantity", "l_discount", "l_tax").alias("magnitude"),
        dims.log_ratio("l_discount", "l_tax").alias("log_ratio"), dims.percent_change("l_discount", "l_tax").alias("change"), dims.effect_label(F.col("l_discount") * 10).alias("effect"),
    )


# --- normalisation ---


@query(f"""WITH {_E}, s AS (SELECT user_id, event_type, quantile_cont(greatest(x, 0), 0.95) AS s FROM e GROUP BY ALL)
SELECT e.user_id, e.event_id, round(s.s, 6) AS env_scale, round(x / s.s, 6) AS env_norm FROM e JOIN s USING (user_id, event_type)""")
def scale_p95_normalise(t):
    d = _events(t)
    return normalisation.apply_scales(d, normalisation.percentile_scales(d, "x", CH), CH, "x").select("user_id", "event_id", "env_scale", "env_norm")


@query("SELECT l_returnflag, l_linestatus, CAST(least(greatest(round_even(count(*) * 0.02, 0), 500), 200000, count(*)) AS BIGINT) AS n FROM lineitem GROUP BY ALL")
def stratified_sample_counts(t):
    keys = ("l_returnflag", "l_linestatus")
    d = t("lineitem").withColumn("k", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return normalisation.stratified_sample(d, keys, least=500, order="k").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, c_acctbal AS v FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, c_acctbal * 2 FROM customer WHERE c_custkey % 3 = 0")
def upsert_replace(t):
    old = t("customer").select("c_custkey", F.col("c_acctbal").alias("v"))
    return normalisation.upsert(old, old.where("c_custkey % 3 = 0").withColumn("v", F.col("v") * 2), ("c_custkey",))


@query("SELECT c_custkey, c_acctbal AS v FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, -1.0 FROM customer WHERE c_custkey % 2 = 1")
def anti_append(t):
    c = t("customer").select("c_custkey", F.col("c_acctbal").alias("v"))
    return normalisation.upsert(c.where("c_custkey % 2 = 0"), c.withColumn("v", F.lit(-1.0)), ("c_custkey",), "append")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR c_custkey % 10 = 0)")
def admission_semi_join(t):
    status = t("customer").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_mktsegment") == "BUILDING", "OK").otherwise("FAIL").alias("status"))
    repaired = t("customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return signal_quality.admitted(t("orders"), status, repaired, ("o_custkey",)).select("o_orderkey", "o_orderstatus")


# --- episodes ---


@query(f"WITH {_G} SELECT user_id, round(t, 6) AS t, round(gate, 6) AS gate FROM g")
def gate_bin_median(t):
    return _gate(t)


@query(f"WITH {_TH} SELECT user_id, any_value(round(med, 6)) AS med, any_value(round(mad, 6)) AS mad, any_value(round(med + 0.5 * mad, 6)) AS thr_on, any_value(round(med + 0.1 * mad, 6)) AS thr_off FROM th GROUP BY user_id")
def mad_thresholds(t):
    return _thresholds(t).select("user_id", "med", "mad", "thr_on", "thr_off").distinct()


@query(_hyst(0.5, 0.1) + " SELECT user_id, round(t_on, 6) AS t_on, round(t_off, 6) AS t_off FROM ep")
def hysteresis_episodes(t):
    return episodes.hysteresis(_thresholds(t), TR)


@query(_hyst(-0.3, 0.6) + " SELECT user_id, round(t_on, 6) AS t_on, round(t_off, 6) AS t_off FROM ep")
def hysteresis_inverted(t):
    return episodes.hysteresis(_thresholds(t, -0.3, 0.6), TR)


@query(_EP + " SELECT user_id, round(t_on, 6) AS t_on, round(t_off, 6) AS t_off FROM mg")
def episode_merge(t):
    return episodes.merge_close(episodes.hysteresis(_thresholds(t), TR), 20_000.0, TR)


@query(_EP + " SELECT user_id, round(t_on, 6) AS t_on, round(t_off, 6) AS t_off, round(peak_gate, 6) AS peak_gate, round(duration_s, 6) AS duration_s FROM pk WHERE duration_s >= 30000 AND peak_gate >= 60")
def episode_peak_filter(t):
    return episodes.valid_only(_episodes(t), 30_000.0, 60.0)


@query(_EP + ", r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY duration_s DESC, t_on) AS rk FROM pk) SELECT user_id, round(t_on, 6) AS t_on, round(t_off, 6) AS t_off, round(peak_gate, 6) AS peak_gate, round(duration_s, 6) AS duration_s FROM r WHERE rk <= 4")
def top_n_longest(t):
    return episodes.longest(_episodes(t), 4, TR)


@query(_EP + """, a AS (SELECT *, count(*) OVER (PARTITION BY user_id) > 3 AS cut, row_number() OVER (PARTITION BY user_id ORDER BY peak_gate, t_on) AS weak FROM pk WHERE duration_s >= 20000),
b AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY peak_gate, t_on) AS by_peak, row_number() OVER (PARTITION BY user_id ORDER BY t_on) AS by_time FROM a WHERE NOT (cut AND weak = 1))
SELECT user_id, round(t_on, 6) AS t_on, round(t_off, 6) AS t_off, round(peak_gate, 6) AS peak_gate, round(duration_s, 6) AS duration_s FROM b WHERE NOT (n >= 3 AND CASE WHEN cut THEN by_peak ELSE by_time END = 2 AND (duration_s < 60000 OR peak_gate < 70))""")
def prune_rule(t):
    return episodes.prune(_episodes(t), 20_000.0, 3, 60_000.0, 70.0, TR)


@query(_EP + """, a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t_on) AS k, row_number() OVER (PARTITION BY user_id ORDER BY t_on DESC) AS z, row_number() OVER (PARTITION BY user_id ORDER BY duration_s DESC, t_on) AS l FROM pk),
b AS (SELECT * FROM a WHERE user_id <> 3 AND NOT (user_id = 5 AND l = 1) AND NOT (user_id = 7 AND z = 1) AND NOT (user_id = 9 AND k = 2))
SELECT user_id, round(t_on, 6) AS t_on, round(t_off, 6) AS t_off, row_number() OVER (PARTITION BY user_id ORDER BY t_on, t_off) AS episode_id FROM b""")
def manual_curation(t):
    e = _episodes(t).withColumn("trial", F.lit("Lifting_exo"))
    rules = e.sparkSession.createDataFrame([(3, "LIFT", "drop_all", None), (5, "lifting", "drop_longest", None), (7, "exo", "drop_last", None), (9, "lifting_exo", "drop_kth", 2), (11, "drinking", "drop_all", None)], "subject long, trial string, action string, k int")
    return episodes.curate(e, rules, "user_id").select("user_id", "t_on", "t_off", F.col("episode_id").cast("long").alias("episode_id"))


@query(f"""WITH {_G}, l AS (SELECT user_id, t, gate, lag(gate) OVER w AS a, lead(gate) OVER w AS b FROM g WINDOW w AS (PARTITION BY user_id ORDER BY t))
SELECT user_id, round(t, 6) AS t, round(coalesce(gate * gate - a * b, gate), 6) AS gate FROM l""")
def tkeo(t):
    return episodes.tkeo(_gate(t), keys=TR)


@query(f"""WITH {_G}, l AS (SELECT user_id, t, [coalesce(lag(gate, 2) OVER w, 0), coalesce(lag(gate) OVER w, 0), gate, coalesce(lead(gate) OVER w, 0), coalesce(lead(gate, 2) OVER w, 0)] AS v FROM g WINDOW w AS (PARTITION BY user_id ORDER BY t))
SELECT user_id, round(t, 6) AS t, round(list_median(v), 6) AS gate FROM l""")
def median_filter(t):
    return episodes.median_filter(_gate(t), kernel=4, keys=TR)


@query(f"WITH {_G}, v AS (SELECT *, var_pop(gate) OVER (PARTITION BY user_id) AS va FROM g) SELECT user_id, round(t, 6) AS t, round(gate * CASE WHEN va < 1500 THEN 1.5 ELSE 1 END, 6) AS gate FROM v")
def flat_gate_boost(t):
    return episodes.boost_flat_gate(_gate(t), 1.5, 1500.0, TR)


_FOUND = "SELECT user_id, round(t_on, 6) AS t_on, round(t_off, 6) AS t_off, round(peak, 6) AS peak_gate, row_number() OVER (PARTITION BY user_id ORDER BY t_on) AS episode_id FROM pk"


def _found(e: DataFrame) -> DataFrame:
    return e.select("user_id", "t_on", "t_off", "peak_gate", F.col("episode_id").cast("long").alias("episode_id"))


@query(_hyst(1.0, 0.2) + _padded(900, 14400, 10000) + _FOUND.join((" ", " WHERE peak >= med + 1.5 * mad")))
def detector_mad(t):
    return _found(episodes.detect_mad(_gate(t), 1.0, 0.2, (7200.0, 14400.0), 900.0, 0.0, 10_000.0, 1.5, "none", keys=TR))


_RULE = """, ru AS (SELECT *, quantile_cont(gate, 0.95) OVER (PARTITION BY user_id) AS p95 FROM th),
th2 AS (SELECT user_id, t, gate, med + CASE WHEN {high} THEN greatest({least}, {on} * {f}) ELSE {on} END * mad AS hi2, med + CASE WHEN {high} AND {als} THEN greatest(0.8, {off} * 0.6) ELSE {off} END * mad AS lo2 FROM ru)"""


@query(_hyst("hi2", "lo2", _RULE.format(high="med + 2.4 * mad > p95", least="1.0", on="2.4", off="0.3", f="0.7", als="false")) + _padded(900, 14400, 10000) + _FOUND.join((" ", " WHERE peak >= med + 1.0 * mad")))
def detector_mad_rule_standard(t):
    return _found(episodes.detect_mad(_gate(t), 2.4, 0.3, 14_400.0, 900.0, 0.0, 10_000.0, 1.0, "standard", keys=TR))


@query(_hyst("hi2", "lo2", _RULE.format(high="(med + 1.9 * mad > 0.85 * p95 OR p95 < 60)", least="1.5", on="1.9", off="1.5", f="0.55", als="true")) + _padded(900, 14400, 10000) + _FOUND.join((" ", " WHERE peak >= med + 1.0 * mad")))
def detector_mad_rule_als(t):
    return _found(episodes.detect_mad(_gate(t), 1.9, 1.5, 14_400.0, 900.0, 0.0, 10_000.0, 1.0, "standard_als", keys=TR))


@query(_hyst("hi2", "lo2", _RULE.format(high="med + 2.6 * mad > 1.1 * p95", least="1.2", on="2.6", off="0.3", f="0.65", als="false")) + _padded(900, 14400, 10000) + _FOUND.join((" ", " WHERE peak >= med + 1.0 * mad")))
def detector_mad_rule_weak(t):
    return _found(episodes.detect_mad(_gate(t), 2.6, 0.3, 14_400.0, 900.0, 0.0, 10_000.0, 1.0, "weak", keys=TR))


_QUIET = """, q0 AS (SELECT *, quantile_cont(gate, 0.15) OVER (PARTITION BY user_id) AS cut FROM th), q1 AS (SELECT *, count(*) FILTER (gate <= cut) OVER (PARTITION BY user_id) AS nq FROM q0),
q2 AS (SELECT *, CASE WHEN nq < 10 OR gate <= cut THEN gate END AS q FROM q1), q3 AS (SELECT *, median(q) OVER (PARTITION BY user_id) AS qm FROM q2), q4 AS (SELECT *, median(abs(q - qm)) OVER (PARTITION BY user_id) + 1e-12 AS qd FROM q3),
th2 AS (SELECT user_id, t, gate, least(qm + {on} * qd, med) AS hi2, (qm + {off} * qd) * 1.3 AS lo2 FROM q4)"""


@query(_hyst("hi2", "lo2", _QUIET.format(on="1.0", off="1.2")) + _padded(900, 7200, 10000, 300) + _FOUND.join((" ", " WHERE peak >= 20")))
def detector_tremor(t):
    return _found(episodes.detect_tremor(_gate(t), 1.0, 1.2, 7200.0, 900.0, 300.0, 10_000.0, 20.0, keys=TR))


@query(f"""WITH {_G}, v AS (SELECT *, var_pop(gate) OVER (PARTITION BY user_id) AS va, quantile_cont(gate, 0.95) OVER (PARTITION BY user_id) AS p95 FROM g)
SELECT user_id, round(t, 6) AS t, round(gate * CASE WHEN va >= 900 THEN 1 WHEN user_id % 2 = 0 THEN 5 WHEN p95 > 0 THEN p95 / 25 ELSE 4 END, 6) AS gate FROM v""")
def emg_gate_boost(t):
    return episodes.boost_emg_gate(_gate(t), F.when(F.col("user_id") % 2 == 0, "x5").otherwise("p95"), 900.0, TR)


@query(f"""WITH {_E} SELECT user_id, round(avg(t), 6) AS t, round(median(greatest(x, 90 - x)), 6) AS gate FROM e GROUP BY user_id, CAST(round_even(t / 21600, 0) AS BIGINT)""")
def emg_gate_bins(t):
    return episodes.emg_gate(_events(t).withColumn("y", 90 - F.col("x")), ["x", "y"], TR, 21600.0)


# --- windows and features ---

_WIN = _EP + """, wn AS (SELECT user_id, t_on, t_off, row_number() OVER (PARTITION BY user_id ORDER BY t_on, t_off) AS episode_id FROM pk),
wi AS (SELECT user_id, episode_id, unnest(range(CAST(ceil((t_off - 86400 + 1e-12 - t_on) / 43200) AS BIGINT))) AS i, t_on FROM wn WHERE t_off - t_on >= 86400),
wd AS (SELECT user_id, episode_id, i + 1 AS window_id, t_on + i * 43200.0 AS t_start, t_on + i * 43200.0 + 86400 AS t_end FROM wi)"""
_SAMP = _WIN + ", sw AS (SELECT wd.user_id, episode_id, window_id, e.t, e.x, e.event_id FROM wd JOIN e ON e.user_id = wd.user_id AND e.t >= t_start AND e.t < t_end)"
WN = ("user_id", "episode_id", "window_id")


def _windows(t) -> DataFrame:
    return windowing.make_windows(episodes.numbered(_episodes(t), TR), 86_400.0, 43_200.0)


def _inside(t) -> DataFrame:
    return windowing.samples_in_windows(_events(t), _windows(t).select(*WN, "t_start", "t_end"), 86_400.0, 43_200.0, TR)


def _long(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in ("episode_id", "window_id")})


@query(_WIN + " SELECT user_id, episode_id, window_id, round(t_start, 6) AS t_start, round(t_end, 6) AS t_end FROM wd")
def sliding_windows(t):
    return _long(_windows(t).select(*WN, "t_start", "t_end"))


@query(_SAMP + """, st AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id, episode_id, window_id ORDER BY t) AS dt FROM sw),
ag AS (SELECT user_id, episode_id, window_id, count(DISTINCT t) AS n, count(*) AS n_rows, max(CASE WHEN dt > 0 THEN dt END) AS max_gap_s FROM st GROUP BY ALL),
ds AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS dt FROM (SELECT DISTINCT user_id, t FROM e)),
fs AS (SELECT user_id, 1 / median(dt) AS fs FROM ds WHERE dt > 0 GROUP BY user_id)
SELECT wd.user_id, wd.episode_id, wd.window_id, coalesce(n, 0) AS n, coalesce(n_rows, 0) AS n_rows, round(max_gap_s, 6) AS max_gap_s, round(fs * 86400, 6) AS expected_n,
coalesce(coalesce(n, 0) / (fs * 86400) >= 0.6, false) AS cov_ok, coalesce(max_gap_s <= 40000, false) AS gap_ok FROM wd LEFT JOIN ag USING (user_id, episode_id, window_id) LEFT JOIN fs USING (user_id)""")
def window_coverage_gap_qc(t):
    q = windowing.window_quality(_events(t), _windows(t).select(*WN, "t_start", "t_end"), 86_400.0, 43_200.0, 0.6, 40_000.0, TR)
    return _long(q.select(*WN, "n", "n_rows", "max_gap_s", "expected_n", "cov_ok", "gap_ok"))


@query(_SAMP + """, d1 AS (SELECT *, CASE WHEN x - 30 >= 0 THEN 1 ELSE -1 END AS sg, x - 30 AS v, stddev_pop(x) OVER (PARTITION BY user_id, episode_id, window_id) AS sd FROM sw),
d2 AS (SELECT *, abs(v - lag(v) OVER w) AS st, lag(sg) OVER w AS ps FROM d1 WINDOW w AS (PARTITION BY user_id, episode_id, window_id ORDER BY t, event_id))
SELECT user_id, episode_id, window_id, round(avg(abs(v)), 6) AS MAV, round(sqrt(avg(v * v)), 6) AS RMS, round(coalesce(sum(st), 0), 6) AS WL,
count(*) FILTER (st > greatest(50e-6, 0.01 * sd)) AS WAMP, count(*) FILTER (sg <> ps AND st > 0.01 * sd) AS ZC, count(*) AS n FROM d2 GROUP BY ALL""")
def window_td_features(t):
    return _long(features.time_domain(_inside(t).withColumn("v", F.col("x") - 30), "v", WN, ("t", "event_id")))


@query(f"""WITH {_E}, c AS (SELECT user_id, event_id, t, x - avg(x) OVER (PARTITION BY user_id) AS c FROM e),
l AS (SELECT user_id, c, lag(c) OVER w AS l1, lag(c, 2) OVER w AS l2 FROM c WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
r AS (SELECT user_id, count(*) AS n, sum(c * c) AS r0, sum(c * l1) AS r1, sum(c * l2) AS r2 FROM l GROUP BY user_id)
SELECT user_id, round(CASE WHEN n >= 12 THEN r1 * (r0 - r2) / (r0 * r0 - r1 * r1) END, 6) AS AR1, round(CASE WHEN n >= 12 THEN (r0 * r2 - r1 * r1) / (r0 * r0 - r1 * r1) END, 6) AS AR2 FROM r""")
def ar2_coeffs(t):
    return features.ar_coefficients(_events(t), "x", TR, ("t", "event_id"), 2)


_LAGS = ", ".join(f"lag(c, {k}) OVER w AS l{k}" for k in range(1, 5))


@query(f"""WITH {_E}, c AS (SELECT user_id, event_id, t, x - avg(x) OVER (PARTITION BY user_id) AS c FROM e), l AS (SELECT user_id, c, {_LAGS} FROM c WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
r AS (SELECT user_id, count(*) AS n, sum(c * c) AS r0, sum(c * l1) AS r1, sum(c * l2) AS r2, sum(c * l3) AS r3, sum(c * l4) AS r4 FROM l GROUP BY user_id),
m1 AS (SELECT *, r1 / r0 AS k1, r0 * (1 - power(r1 / r0, 2)) AS e1 FROM r), m2 AS (SELECT *, (r2 - k1 * r1) / e1 AS k2 FROM m1), n2 AS (SELECT *, k1 - k2 * k1 AS b1, e1 * (1 - k2 * k2) AS e2 FROM m2),
m3 AS (SELECT *, (r3 - b1 * r2 - k2 * r1) / e2 AS k3 FROM n2), n3 AS (SELECT *, b1 - k3 * k2 AS c1, k2 - k3 * b1 AS c2, e2 * (1 - k3 * k3) AS e3 FROM m3), m4 AS (SELECT *, (r4 - c1 * r3 - c2 * r2 - k3 * r1) / e3 AS k4 FROM n3)
SELECT user_id, round(CASE WHEN n >= 14 THEN c1 - k4 * k3 END, 6) AS AR1, round(CASE WHEN n >= 14 THEN c2 - k4 * c2 END, 6) AS AR2, round(CASE WHEN n >= 14 THEN k3 - k4 * c1 END, 6) AS AR3, round(CASE WHEN n >= 14 THEN k4 END, 6) AS AR4 FROM m4""")
def ar4_coeffs(t):
    return features.ar_coefficients(_events(t), "x", TR, ("t", "event_id"))


@query(f"""WITH {_E}, d AS (SELECT user_id, t - lag(t) OVER w AS dt, sqrt(power(x - lag(x) OVER w, 2) + power(x * x - lag(x * x) OVER w, 2)) AS n, t FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT user_id, round(CASE WHEN count(DISTINCT t) >= 3 THEN avg(n) / median(CASE WHEN dt > 0 THEN dt END) END, 6) AS jerk_norm_mean, round(median(CASE WHEN dt > 0 THEN dt END), 6) AS dt_median_s FROM d GROUP BY user_id""")
def jerk_norm(t):
    return features.mean_jerk(_events(t).withColumn("y", F.col("x") * F.col("x")), ("x", "y"), TR, ("t", "event_id"))


@query(f"""WITH {_E}, h AS (SELECT user_id, floor(t / 86400) * 86400 AS t, avg(x) FILTER (event_type = 'click') AS a, avg(x) FILTER (event_type = 'view') AS b FROM e WHERE event_type IN ('click', 'view') GROUP BY ALL),
m AS (SELECT user_id, t, least(a, b) AS lo, greatest(a, b) AS hi FROM h WHERE a IS NOT NULL AND b IS NOT NULL),
d AS (SELECT user_id, (lo + lag(lo) OVER w) / 2 * (t - lag(t) OVER w) AS al, (hi + lag(hi) OVER w) / 2 * (t - lag(t) OVER w) AS ah FROM m WINDOW w AS (PARTITION BY user_id ORDER BY t))
SELECT user_id, round(sum(al) / nullif(sum(ah), 0), 6) AS coact, round(2 * sum(al) / nullif(sum(al) + sum(ah), 0), 6) AS cci FROM d GROUP BY user_id""")
def coactivation_trapz(t):
    d = _events(t).withColumn("t", F.floor(F.col("t") / 86400) * 86400.0)
    return features.overlap(features.two_channels(d, "x", "click", "view", TR, "event_type"), TR)


@query(f"""WITH {_E}, g0 AS (SELECT DISTINCT user_id, t FROM e WHERE event_type = 'click'), s AS (SELECT user_id, t, avg(x) AS x FROM e WHERE event_type = 'view' GROUP BY ALL),
p AS (SELECT g0.user_id, g0.t, s.t AS pt, s.x AS px FROM g0 ASOF LEFT JOIN s ON g0.user_id = s.user_id AND g0.t >= s.t),
f AS (SELECT p.*, s.t AS ft, s.x AS fx FROM p ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.t <= s.t)
SELECT user_id, round(t, 6) AS t, round(CASE WHEN pt IS NULL THEN fx WHEN ft IS NULL OR pt = t THEN px ELSE px + (fx - px) * (t - pt) / (ft - pt) END, 6) AS x FROM f WHERE pt IS NOT NULL OR ft IS NOT NULL""")
def interp_align(t):
    e = _events(t)
    return features.interpolated(e.where("event_type = 'view'"), e.where("event_type = 'click'"), "x", TR)


_OVER = """o AS (SELECT user_id, t, greatest(a, 0) AS a, greatest(b, 0) AS b FROM ab), d AS (SELECT user_id, t - lag(t) OVER w AS dt, least(a, b) AS lo, greatest(a, b) AS hi, lag(least(a, b)) OVER w AS plo, lag(greatest(a, b)) OVER w AS phi FROM o WINDOW w AS (PARTITION BY user_id ORDER BY t)),
r AS (SELECT user_id, sum((lo + plo) / 2 * dt) AS lo, sum((hi + phi) / 2 * dt) AS hi FROM d GROUP BY user_id)"""


@query(f"""WITH {_E}, a AS (SELECT user_id, t, avg(x) AS a FROM e WHERE event_type = 'click' GROUP BY ALL), s AS (SELECT user_id, t, avg(x) AS x FROM e WHERE event_type = 'view' GROUP BY ALL), sp AS (SELECT user_id, min(t) AS lo, max(t) AS hi FROM s GROUP BY user_id),
k AS (SELECT a.* FROM a JOIN sp USING (user_id) WHERE t BETWEEN lo AND hi), p AS (SELECT k.*, s.t AS pt, s.x AS px FROM k ASOF JOIN s ON k.user_id = s.user_id AND k.t >= s.t), f AS (SELECT p.*, s.t AS ft, s.x AS fx FROM p ASOF JOIN s ON p.user_id = s.user_id AND p.t <= s.t),
ab AS (SELECT user_id, t, a, CASE WHEN pt = t THEN px ELSE px + (fx - px) * (t - pt) / (ft - pt) END AS b FROM f), {_OVER}
SELECT user_id, round(lo / nullif(hi, 0), 6) AS coact, round(2 * lo / nullif(lo + hi, 0), 6) AS cci FROM r""")
def coactivation_interpolated(t):
    return features.coactivation_interpolated(_events(t), "x", "click", "view", TR, "event_type")


# --- indicators ---


@query(f"""WITH {_E}, d AS (SELECT user_id, x, lead(t) OVER (PARTITION BY user_id ORDER BY t) - t AS dt FROM e)
SELECT user_id, round(sum(CASE WHEN x > 50 THEN dt ELSE 0 END) / sum(dt), 6) AS duty FROM d GROUP BY user_id""")
def duty_cycle(t):
    return kpis.duty_cycle(_events(t), "x", TR, 50.0)


@query(f"""WITH {_E}, d AS (SELECT user_id, (x + lag(x) OVER w) / 2 * (t - lag(t) OVER w) AS a FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)) SELECT user_id, round(sum(a), 6) AS auc_x FROM d GROUP BY user_id""")
def trapezoid_area(t):
    return kpis.trapezoid(_events(t), ["x"], TR)


@query("""SELECT l_suppkey, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS mean_discount, round(max(l_extendedprice), 6) AS peak, mode_low AS status FROM lineitem JOIN
(SELECT l_suppkey AS k, min(l_returnflag) AS mode_low FROM (SELECT l_suppkey, l_returnflag, rank() OVER (PARTITION BY l_suppkey ORDER BY n DESC) AS r FROM (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2)) WHERE r = 1 GROUP BY l_suppkey) ON k = l_suppkey GROUP BY l_suppkey, mode_low""")
def weighted_kpis(t):
    return t("lineitem").groupBy("l_suppkey").agg(kpis.weighted_mean("l_discount", "l_quantity").alias("mean_discount"), F.max("l_extendedprice").alias("peak"), kpis.most_frequent("l_returnflag").alias("status"))


_STATS = ", ".join(f"round({f}({c}), 6) AS {c}__{n}" for c in ("l_quantity", "l_discount") for n, f in (("median", "median"), ("mean", "avg"), ("std", "stddev_samp")))


@query(f"SELECT l_suppkey, {_STATS} FROM lineitem GROUP BY l_suppkey")
def kpi_multi_stats(t):
    return kpis.multi_stats(t("lineitem"), ["l_quantity", "l_discount"], ("l_suppkey",))


_MEDS = ", ".join(f"round(median({c}) FILTER (l_returnflag = '{f}'), 6) AS {c}__taskmed__{f}" for c in ("l_quantity", "l_discount") for f in "ANR")


@query(f"SELECT l_suppkey, {_MEDS} FROM lineitem GROUP BY l_suppkey")
def kpi_task_medians(t):
    return kpis.task_medians(t("lineitem"), ["l_quantity", "l_discount"], ["A", "N", "R"], ("l_suppkey",), "l_returnflag")


_SUP = "s AS (SELECT l_suppkey AS k, median(l_quantity) AS a, avg(l_extendedprice) AS b, stddev_samp(l_discount) AS c, avg(l_tax) AS d, CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE max(l_tax * l_quantity) END AS e, 1.0 AS f FROM lineitem GROUP BY l_suppkey)"


def _suppliers(t) -> DataFrame:
    e = F.when(F.col("l_suppkey") % 7 != 0, F.max(F.col("l_tax") * F.col("l_quantity")))
    return t("lineitem").groupBy("l_suppkey").agg(F.median("l_quantity").alias("a"), F.avg("l_extendedprice").alias("b"), F.stddev_samp("l_discount").alias("c"), F.avg("l_tax").alias("d"), e.alias("e"), F.lit(1.0).alias("f")).withColumnRenamed("l_suppkey", "k")


@query(f"WITH {_SUP}, z AS (SELECT k, (b - avg(b) OVER ()) / stddev_pop(b) OVER () AS ze, (d - avg(d) OVER ()) / stddev_pop(d) OVER () AS zm FROM s) SELECT k, round(ze, 6) AS z_effort, round(zm, 6) AS z_motion, round(ze - zm, 6) AS nmd FROM z")
def nmd_index(t):
    return kpis.mismatch_index(_suppliers(t), "b", "d").select("k", "z_effort", "z_motion", "nmd")


@query(f"""WITH {_SUP}, l AS (UNPIVOT (SELECT k, a, b, c, d, e FROM s) ON a, b, c, d, e INTO NAME n VALUE v), p AS (SELECT x.n AS a, y.n AS b, x.v AS u, y.v AS w FROM l x JOIN l y ON x.k = y.k AND x.n < y.n),
r AS (SELECT *, rank() OVER (PARTITION BY a, b ORDER BY u) + (count(*) OVER (PARTITION BY a, b, u) - 1) / 2.0 AS ru, rank() OVER (PARTITION BY a, b ORDER BY w) + (count(*) OVER (PARTITION BY a, b, w) - 1) / 2.0 AS rw FROM p)
SELECT a, b, round(corr(ru, rw), 6) AS rho, count(*) AS n FROM r GROUP BY a, b""")
def spearman_pairs(t):
    return kpis.spearman_pairs(_suppliers(t), "k", ["a", "b", "c", "d", "e"])


_COLS = "a, b, c, d, e, f"


@query(f"""WITH {_SUP}, l AS (SELECT feature, v FROM s UNPIVOT INCLUDE NULLS (v FOR feature IN ({_COLS})))
SELECT feature, round(count(v) / count(*), 6) AS coverage, round(stddev_samp(v), 6) AS sd, count(v) / count(*) >= 0.9 AND stddev_samp(v) > 1e-6 AS passes FROM l GROUP BY feature""")
def coverage_variance_screen(t):
    return kpis.screen(_suppliers(t), list("abcdef"), 0.9)


@query(f"""WITH {_SUP}, l AS (UNPIVOT (SELECT {_COLS} FROM s) ON {_COLS} INTO NAME feature VALUE v)
SELECT feature, round(median(v), 6) AS median, round(stddev_samp(v), 6) AS sd, round(min(v), 6) AS least, round(max(v), 6) AS largest FROM l GROUP BY feature""")
def feature_report(t):
    return kpis.feature_report(_suppliers(t), list("abcdef")).drop("skew")


@query("""SELECT p_type AS feature, CAST(row_number() OVER (ORDER BY pr, pos) AS BIGINT) AS rank FROM (SELECT p_type, min(p_size) % 3 + 1 AS pr, min(p_partkey) AS pos, count(*) AS n FROM part GROUP BY p_type) WHERE pr <= 2 OR (SELECT count(DISTINCT p_type) FROM part) <= 4 QUALIFY rank <= 4""")
def priority_select(t):
    p = t("part").groupBy("p_type").agg((F.min("p_size") % 3 + 1).alias("priority"), F.min("p_partkey").alias("position")).withColumnRenamed("p_type", "feature")
    passing = p.select("feature", F.lit(True).alias("passes"))
    return kpis.select_by_priority(passing, p, 4).select("feature", F.col("rank").cast("long").alias("rank"))


_Z = ", ".join(f"round((coalesce({c}, median({c}) OVER ()) - avg(coalesce({c}, m{c})) OVER ()) / stddev_pop(coalesce({c}, m{c})) OVER (), 6) AS {c}" for c in "ae")


@query(f"WITH {_SUP}, m AS (SELECT *, median(a) OVER () AS ma, median(e) OVER () AS me FROM s) SELECT k, {_Z} FROM m")
def impute_standardise(t):
    return normalisation.standardise(normalisation.median_impute(_suppliers(t).select("k", "a", "e"), ["a", "e"]), ["a", "e"])


@query("""SELECT coalesce(l.k, r.k) AS k, round(x, 6) AS x, round(y, 6) AS y FROM (SELECT o_custkey AS k, avg(o_totalprice) AS x FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) l
FULL JOIN (SELECT o_custkey AS k, avg(o_totalprice) AS y FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) r ON l.k = r.k""")
def outer_merge_measures(t):
    f = lambda s, n: t("orders").where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.avg("o_totalprice").alias(n))
    return f("F", "x").join(f("P", "y"), "k", "full_outer")


# --- statistics ---

_CUS = "c AS (SELECT c_custkey, c_acctbal AS x, c_mktsegment AS g FROM customer)"


def _customers(t) -> DataFrame:
    return t("customer").select("c_custkey", F.col("c_acctbal").alias("x"), F.col("c_mktsegment").alias("g"))


@query(f"""WITH {_CUS}, b AS (SELECT x, g FROM c UNION ALL SELECT x, 'All' FROM c), q AS (SELECT g, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3, avg(x) AS m, stddev_pop(x) AS s FROM b GROUP BY g)
SELECT b.g, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, round(median(x), 6) AS median, round(any_value(q1), 6) AS q1, round(any_value(q3), 6) AS q3, round(any_value(q3 - q1), 6) AS iqr, round(min(x), 6) AS least, round(max(x), 6) AS largest,
round(avg(power((x - m) / s, 3)), 6) AS skew, round(avg(power((x - m) / s, 4)) - 3, 6) AS kurt, count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS n_outliers FROM b JOIN q ON b.g = q.g GROUP BY b.g""")
def descriptives_grouping_sets(t):
    return statistics.describe(_customers(t), "x", "g")


@query("""WITH o AS (SELECT o_orderpriority AS g, o_orderkey AS k, o_totalprice AS x FROM orders), q AS (SELECT g, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM o GROUP BY g)
SELECT o.g, count(*) AS n, string_agg(CAST(k AS VARCHAR), ',' ORDER BY CAST(k AS VARCHAR)) AS who FROM o JOIN q USING (g) WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1) GROUP BY o.g""")
def tukey_outliers(t):
    return statistics.tukey_outliers(t("orders").select(F.col("o_orderpriority").alias("g"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("x")), "k", "x", "g")


@query(f"""WITH {_CUS}, d AS (SELECT x, g = 'BUILDING' AS one, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS r, CAST(count(*) OVER (PARTITION BY x) AS DOUBLE) AS tt FROM c WHERE g IN ('BUILDING', 'MACHINERY')),
a AS (SELECT count(*) FILTER (one) AS n1, count(*) FILTER (NOT one) AS n2, sum(r) FILTER (one) AS r1, sum(tt * tt - 1) AS ties FROM d), b AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, CAST(n1 AS DOUBLE) * n2 AS nn, CAST(n1 + n2 AS DOUBLE) AS n FROM a)
SELECT n1, n2, round(u, 6) AS u, round(1 - 2 * u / nn, 6) AS rank_biserial, round(greatest(abs(u - nn / 2) - 0.5, 0) / sqrt(nn / 12 * (n + 1 - ties / (n * (n - 1)))), 6) AS z, round(abs(u - nn / 2) / sqrt(nn * (n + 1) / 12) / sqrt(n), 6) AS r FROM b""")
def mwu_u_effect(t):
    return statistics.mann_whitney(_customers(t), "x", "g", "BUILDING", "MACHINERY").drop("p_normal")


_PAIR = "p AS (SELECT l_suppkey, median(l_quantity) FILTER (l_linestatus = 'O') AS a, median(l_quantity) FILTER (l_linestatus = 'F') AS b FROM lineitem GROUP BY l_suppkey HAVING a IS NOT NULL AND b IS NOT NULL)"


@query(f"WITH {_PAIR} SELECT l_suppkey, round(a, 6) AS a, round(b, 6) AS b FROM p")
def paired_condition_effect(t):
    return statistics.paired_conditions(t("lineitem"), ("l_suppkey",), "l_linestatus", "l_quantity", "O", "F")


@query(f"""WITH {_PAIR}, d AS (SELECT b - a AS d, rank() OVER (ORDER BY abs(b - a)) + (count(*) OVER (PARTITION BY abs(b - a)) - 1) / 2.0 AS r FROM p WHERE b <> a),
w AS (SELECT coalesce(sum(r) FILTER (d > 0), 0) AS w_plus, coalesce(sum(r) FILTER (d < 0), 0) AS w_minus, count(*) AS n_nonzero FROM d)
SELECT (SELECT count(*) FROM p) AS n, (SELECT round(median(a), 6) FROM p) AS median_before, (SELECT round(median(b), 6) FROM p) AS median_after, round(w_plus, 6) AS w_plus, round(w_minus, 6) AS w_minus, n_nonzero, round(least(w_plus, w_minus), 6) AS w,
round(1 - 4 * least(w_plus, w_minus) / (n_nonzero * (n_nonzero + 1)), 6) AS effect_r FROM w""")
def wilcoxon_w_effect(t):
    return statistics.wilcoxon(statistics.paired_conditions(t("lineitem"), ("l_suppkey",), "l_linestatus", "l_quantity", "O", "F"), "a", "b")


@query("""WITH m AS (SELECT l_suppkey AS s, l_returnflag AS k, median(l_quantity) AS v FROM lineitem GROUP BY ALL), f AS (SELECT * FROM m WHERE s IN (SELECT s FROM m GROUP BY s HAVING count(*) = 3)),
r AS (SELECT *, rank() OVER (PARTITION BY s ORDER BY v) + (count(*) OVER (PARTITION BY s, v) - 1) / 2.0 AS r, CAST(count(*) OVER (PARTITION BY s, v) AS DOUBLE) AS c FROM f),
a AS (SELECT sum(c * c - 1) AS ties, CAST(count(DISTINCT s) AS DOUBLE) AS n FROM r), b AS (SELECT sum(x * x) AS ss FROM (SELECT sum(r) AS x FROM r GROUP BY k)),
o AS (SELECT n, (12 / (n * 12) * ss - 12 * n) / (1 - ties / (n * 24)) AS chi2 FROM a, b) SELECT CAST(n AS BIGINT) AS n, round(chi2, 6) AS chi2, round(exp(-chi2 / 2), 6) AS p FROM o""")
def friedman_chi2(t):
    d = t("lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("k"), F.col("l_quantity").alias("v"))
    return statistics.friedman(d, "s", "k", "v", ["A", "N", "R"])


@query("""WITH d AS (SELECT o_orderkey, o_orderpriority AS f, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (o_orderkey * 7919 % 10007) / 10007.0 END AS p FROM orders),
r AS (SELECT *, p * count(p) OVER (PARTITION BY f) / row_number() OVER (PARTITION BY f, p IS NULL ORDER BY p) AS q FROM d)
SELECT o_orderkey, round(CASE WHEN p IS NOT NULL THEN least(min(q) OVER (PARTITION BY f, p IS NULL ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) END, 6) AS p_fdr, round(least(3 * p, 1), 6) AS p_bonf FROM r""")
def bh_fdr_families(t):
    p = F.when(F.col("o_orderkey") % 11 != 0, (F.col("o_orderkey") * 7919 % 10007) / 10007.0)
    d = t("orders").select("o_orderkey", F.col("o_orderpriority").alias("f"), p.alias("p"))
    return statistics.benjamini_hochberg(d, "p", ("f",)).select("o_orderkey", "p_fdr", statistics.bonferroni("p").alias("p_bonf"))


_GAP = "g AS (SELECT l_suppkey, CASE WHEN l_suppkey % 3 = 0 THEN 'P' ELSE 'H' END AS g, l_linestatus AS c, l_extendedprice AS x FROM lineitem)"


def _gap(t) -> DataFrame:
    return t("lineitem").select("l_suppkey", F.when(F.col("l_suppkey") % 3 == 0, "P").otherwise("H").alias("g"), F.col("l_linestatus").alias("c"), F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"))


@query(f"""WITH {_GAP}, a AS (SELECT median(x) FILTER (g = 'H' AND c = 'O') AS healthy, median(x) FILTER (g = 'P' AND c = 'O') AS before, median(x) FILTER (g = 'P' AND c = 'F') AS after,
quantile_cont(x, 0.25) FILTER (g = 'H' AND c = 'O') AS q1, quantile_cont(x, 0.75) FILTER (g = 'H' AND c = 'O') AS q3, count(x) FILTER (g = 'H' AND c = 'O') AS n_healthy, count(x) FILTER (g = 'P' AND c = 'O') AS n_before, count(x) FILTER (g = 'P' AND c = 'F') AS n_after FROM g)
SELECT round(healthy, 6) AS healthy, round(before, 6) AS before, round(after, 6) AS after, round(q1, 6) AS q1, round(q3, 6) AS q3, n_healthy, n_before, n_after, round(before - healthy, 6) AS gap_before, round(after - healthy, 6) AS gap_after,
round((abs(before - healthy) - abs(after - healthy)) / nullif(abs(before - healthy), 0) * 100, 6) AS pct_closed, before BETWEEN q1 AND q3 AS in_band_before, after BETWEEN q1 AND q3 AS in_band_after,
after BETWEEN q1 AND q3 AND NOT before BETWEEN q1 AND q3 AS entered_band FROM a WHERE n_healthy >= 3 AND n_before >= 3 AND n_after >= 3""")
def gap_closure(t):
    return statistics.gap_closure(_gap(t), "x", "g", "c", "P", "H", "O", "F")


@query("""WITH g AS (SELECT l_suppkey % 3 = 0 AS p, l_extendedprice AS x, l_quantity AS y FROM lineitem), f AS (SELECT median(x) FILTER (p) / median(x) FILTER (NOT p) AS a, median(y) FILTER (p) / median(y) FILTER (NOT p) AS b FROM g)
SELECT round(a, 6) AS fold_a, round(b, 6) AS fold_b, round(a / b, 6) AS "index", CASE WHEN a / b > 1.25 THEN 'a selective' WHEN a / b < 0.8 THEN 'b selective' ELSE 'uniform' END AS verdict FROM f""")
def log_ratio_selectivity(t):
    return statistics.selectivity(_gap(t), "x", "y", "g", "P", "H")


@query(f"WITH {_CUS}, h AS (SELECT avg(x) AS m, stddev_samp(x) AS s FROM c WHERE g = 'BUILDING') SELECT c_custkey, g, round(x, 6) AS x, abs(x - m) > 1.5 * s AS outside FROM c, h")
def outside_reference_band(t):
    return statistics.outside_reference(_customers(t), "c_custkey", "x", "g", "BUILDING", 1.5)


@query("SELECT scope, count(*) AS n, round(median(v), 6) AS median FROM (SELECT 'Overall' AS scope, l_quantity AS v FROM lineitem UNION ALL SELECT l_returnflag, l_quantity FROM lineitem) GROUP BY scope")
def scoped_medians(t):
    return statistics.scoped_median(t("lineitem"), "l_returnflag", "l_quantity")


@query("SELECT o_custkey, max_by(o_orderkey, o_totalprice) AS best, round(max(o_totalprice), 6) AS best_r FROM orders GROUP BY o_custkey")
def best_by_effect(t):
    return statistics.best_by_effect(t("orders"), ("o_custkey",), "o_orderkey", "o_totalprice")


@query("""WITH a AS (SELECT l_returnflag AS a, count(*) AS ra FROM lineitem GROUP BY 1), b AS (SELECT l_linestatus AS b, count(*) AS cb FROM lineitem GROUP BY 1), o AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT a.a AS l_returnflag, b.b AS l_linestatus, coalesce(o.n, 0) AS observed, round(ra * cb / (SELECT count(*) FROM lineitem), 6) AS expected FROM a CROSS JOIN b LEFT JOIN o ON o.a = a.a AND o.b = b.b""")
def crosstab_cells(t):
    return statistics.crosstab(t("lineitem"), "l_returnflag", "l_linestatus")


@query("""WITH a AS (SELECT l_returnflag AS a, count(*) AS ra FROM lineitem GROUP BY 1), b AS (SELECT l_linestatus AS b, count(*) AS cb FROM lineitem GROUP BY 1), o AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY 1, 2),
e AS (SELECT coalesce(o.n, 0) AS n, ra * cb / (SELECT count(*) FROM lineitem) AS x FROM a CROSS JOIN b LEFT JOIN o ON o.a = a.a AND o.b = b.b), c AS (SELECT CAST(sum(n) AS BIGINT) AS n, sum(power(n - x, 2) / x) AS chi2 FROM e)
SELECT n, round(chi2, 6) AS chi2, round(sqrt(chi2 / n), 6) AS cramers_v FROM c""")
def crosstab_chi2_v(t):
    return statistics.association(t("lineitem"), "l_returnflag", "l_linestatus")


@query("""WITH d AS (SELECT l_discount > 0.05 AS p, l_quantity > 25 AS t FROM lineitem), a AS (SELECT count(*) FILTER (p AND t) AS tp, count(*) FILTER (NOT p AND NOT t) AS tn, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (NOT p AND t) AS fn FROM d)
SELECT tp, tn, fp, fn, round(tp / (tp + fn), 6) AS sensitivity, round(tn / (tn + fp), 6) AS specificity, round(tp / (tp + fp), 6) AS ppv, round(tn / (tn + fn), 6) AS npv, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy,
round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2, 6) AS macro_f1,
round((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS phi FROM a""")
def confusion_metrics(t):
    return statistics.detector_metrics(t("lineitem"), F.col("l_discount") > 0.05, F.col("l_quantity") > 25)


@query("""WITH d AS (SELECT l_quantity > 25 AS y, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS r FROM lineitem)
SELECT round((sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2) / (CAST(count(*) FILTER (y) AS DOUBLE) * count(*) FILTER (NOT y)), 6) AS auc FROM d""")
def auc_rank(t):
    return statistics.auc(t("lineitem"), "l_extendedprice", F.col("l_quantity") > 25)


_LOG = "SELECT count(*) AS n, sum(d) AS s, sum(d * d) AS ss FROM (SELECT ln(b / a) AS d FROM p WHERE a > 0 AND b > 0)"


@query(f"""WITH {_PAIR}, d AS ({_LOG}), mu AS (SELECT -3 + i * (6.0 / 600) AS mu FROM range(601) r(i)), sg AS (SELECT 0.01 + i * (3.99 / 399) AS sg FROM range(400) r(i)),
l AS (SELECT mu, -n * ln(sg) - (ss - 2 * mu * s + n * mu * mu) / (2 * sg * sg) - mu * mu / 0.5 - sg * sg / 0.5 AS l FROM d, mu, sg), w AS (SELECT mu, sum(exp(l - (SELECT max(l) FROM l))) AS w FROM l GROUP BY mu),
p2 AS (SELECT mu, w / sum(w) OVER () AS w FROM w), c AS (SELECT *, sum(w) OVER (ORDER BY mu) AS cdf FROM p2)
SELECT round(sum(mu * w), 6) AS mean, round(min(mu) FILTER (cdf >= 0.025), 6) AS lo, round(min(mu) FILTER (cdf >= 0.975), 6) AS hi, round(sum(w) FILTER (mu < 0), 6) AS p_below_0, round(coalesce(sum(w) FILTER (mu < {math.log(0.9)!r}), 0), 6) AS p_below_10pct,
round(coalesce(sum(w) FILTER (mu < {math.log(0.8)!r}), 0), 6) AS p_below_20pct, round(sqrt(sum(mu * mu * w) - power(sum(mu * w), 2)), 6) AS sd, round(100 * (exp(sum(mu * w)) - 1), 6) AS pct FROM c""")
def bayes_grid_posterior(t):
    d = statistics.paired_conditions(t("lineitem"), ("l_suppkey",), "l_linestatus", "l_quantity", "O", "F").select(dims.log_ratio("b", "a").alias("d"))
    s = d.agg(F.count("d").alias("n"), F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("ss"))
    return statistics.grid_posterior(t("lineitem").sparkSession, s)


def _nations(t) -> DataFrame:
    """25 rows from all customers: the size that these methods are for."""
    c = t("customer").groupBy("c_nationkey").agg(F.median("c_acctbal").alias("a"), F.avg("c_acctbal").alias("b"), F.stddev_samp("c_acctbal").alias("c"), F.avg((F.col("c_mktsegment") == "BUILDING").cast("double")).alias("d"))
    return c.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_nationkey").cast("long").alias("k"), "n_regionkey", *"abcd")


_NAT = "n AS (SELECT c_nationkey AS k, n_regionkey AS r, median(c_acctbal) > 4500 AS high FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"


@query(f"""WITH {_NAT}, p AS (SELECT rd, k, r, high, row_number() OVER (PARTITION BY rd ORDER BY k) AS i, row_number() OVER (PARTITION BY rd ORDER BY CAST('0x' || substr(md5(k || '-' || rd || '-42'), 1, 15) AS BIGINT), k) AS j FROM n, range(10000) q(rd)),
s AS (SELECT a.rd, a.r, b.high FROM p a JOIN p b ON a.rd = b.rd AND a.i = b.j UNION ALL SELECT -1, r, high FROM n),
c AS (SELECT rd, r, high, count(*) AS o FROM s GROUP BY ALL),
e AS (SELECT rd, o * o / (sum(o) OVER (PARTITION BY rd, r) * sum(o) OVER (PARTITION BY rd, high) / sum(o) OVER (PARTITION BY rd)) AS x, o FROM c),
h AS (SELECT rd, sum(x) - sum(o) AS chi2 FROM e GROUP BY rd), f AS (SELECT chi2 AS observed FROM h WHERE rd = -1)
SELECT round(observed, 6) AS observed, round(avg(CASE WHEN chi2 >= observed - 1e-9 THEN 1.0 ELSE 0.0 END), 6) AS p, count(*) AS rounds FROM h, f WHERE rd >= 0 GROUP BY observed""")
def permutation_p(t):
    n = _nations(t).select("k", F.col("n_regionkey").alias("r"), (F.col("a") > 4500).alias("high"))
    return statistics.permutation_association(n, "k", "r", "high")


@query("""WITH v AS (SELECT row_number() OVER (ORDER BY s_acctbal) - 1 AS i, s_acctbal AS v FROM supplier), n AS (SELECT count(*) AS n FROM v),
d AS (SELECT rd, CAST('0x' || substr(md5(rd || '-' || v.i || '-42'), 1, 15) AS BIGINT) % n AS i FROM range(2000) q(rd), v, n), m AS (SELECT rd, median(v.v) AS m FROM d JOIN v ON d.i = v.i GROUP BY rd)
SELECT round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM m""")
def bootstrap_ci(t):
    return statistics.bootstrap_median(t("supplier"), "s_acctbal")


# --- numpy tier ---


@query()
def filtfilt_bandpass(t):
    d = signals.emg_channels(_events(t).select("user_id", "t", "x"), "x", TR, fs=1259.26)
    return d.select("user_id", "t", "bp", "env", "notched")


@query()
def imu_gates(t):
    d = _events(t).select("user_id", "t", "x").withColumn("a", F.abs(F.col("x") - 40))
    return signals.imu_channels(d, "x", "a", TR, fs=148.15).select("user_id", "t", "gyro_gate", "acc_dyn", "acc_gate")


@query(f"""WITH {_E}, x AS (SELECT user_id, x, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, avg(x) OVER (PARTITION BY user_id) AS m FROM e),
w AS (SELECT user_id, n, i, (x - m) * (0.5 - 0.5 * cos(2 * pi() * i / n)) AS v, power(0.5 - 0.5 * cos(2 * pi() * i / n), 2) AS ww FROM x WHERE n BETWEEN 32 AND 256),
f AS (SELECT user_id, n, k, power(sum(v * cos(2 * pi() * i * k / n)), 2) + power(sum(v * sin(2 * pi() * i * k / n)), 2) AS p, sum(ww) AS ww FROM w, range(129) q(k) WHERE k <= n // 2 GROUP BY ALL),
d AS (SELECT user_id, k * 1259.26 / n AS hz, k, p / (1259.26 * ww) * CASE WHEN k = 0 OR (n % 2 = 0 AND k = n // 2) THEN 1 ELSE 2 END AS p FROM f),
c AS (SELECT *, sum(p) OVER (PARTITION BY user_id ORDER BY k) AS cp, sum(p) OVER (PARTITION BY user_id) AS tp FROM d)
SELECT user_id, round(sum(hz * p) / sum(p), 6) AS MNF, round(min(hz) FILTER (cp >= tp / 2), 6) AS MDF FROM c GROUP BY user_id""")
def welch_mnf_mdf(t):
    return signals.spectral_features(_events(t).select("user_id", "t", "x"), "x", TR, 1259.26)


@query()
def ward_clusters(t):
    return clustering.ward(_nations(t), "k", list("abcd"), 3)


@query()
def ward_jaccard(t):
    n = _nations(t)
    return clustering.best_jaccard(clustering.ward(n, "k", list("abcd"), 3), clustering.bootstrap_ward(n, "k", list("abcd"), 3), "k")


@query()
def ward_cooccurrence(t):
    return clustering.co_occurrence(clustering.bootstrap_ward(_nations(t), "k", list("abcd"), 3), "k")


@query()
def ward_separation(t):
    n = _nations(t)
    pairs = clustering.co_occurrence(clustering.bootstrap_ward(n, "k", list("abcd"), 3), "k")
    return clustering.separation(pairs, clustering.ward(n, "k", list("abcd"), 3), "k")


@query()
def lmm_random_intercept(t):
    d = t("lineitem").select("l_suppkey", "l_returnflag", "l_linestatus", F.ln(F.col("l_extendedprice") + 1e-8).alias("y"))
    cols = mixed_model.design({"l_returnflag": ("A", ["N", "R"]), "l_linestatus": ("F", ["O"])})
    fit = mixed_model.fit_random_intercept(mixed_model.sufficient_statistics(d, "l_suppkey", "y", cols), list(cols))
    return d.sparkSession.createDataFrame([(*r, float(fit.icc), fit.llf) for r in fit.table()], "name string, coef double, se double, z double, p double, lower double, upper double, icc double, llf double")


def _folds(t) -> DataFrame:
    n = _nations(t).withColumn("y", (F.col("a") > 4500).cast("int"))
    return supervised.leave_one_out(n, "k", "y", ["b", "c", "d"])


@query()
def loso_models(t):
    return _folds(t)


@query()
def loso_consistency(t):
    return supervised.consistency(_folds(t), "k")


@query()
def loso_metrics(t):
    f = _folds(t)
    return statistics.detector_metrics(f, F.col("y_pred") == 1, supervised.truth(), ("model",)).join(statistics.auc(f, "y_prob", supervised.truth(), ("model",)), "model")


@query()
def loso_prediction_table(t):
    return supervised.prediction_table(_folds(t), "k", list(supervised.MODELS))


# --- batteries and reports ---


@query()
def two_group_battery(t):
    d = t("lineitem").where(F.col("l_returnflag").isin("A", "R")).groupBy("l_suppkey", F.col("l_returnflag").alias("g")).agg(F.median("l_quantity").alias("q"), F.avg("l_extendedprice").alias("e"), F.avg("l_tax").alias("x"))
    return batteries.two_group_battery(d, "l_suppkey", "g", ["q", "e", "x"], "A", "R")


@query()
def paired_battery(t):
    d = t("lineitem").select("l_suppkey", "l_linestatus", "l_returnflag", "l_quantity", "l_extendedprice")
    return batteries.paired_battery(d, "l_suppkey", "l_linestatus", ["l_quantity", "l_extendedprice"], "O", "F", ("l_returnflag",))


@query()
def shape_battery(t):
    n = _nations(t).withColumn("g", F.when(F.col("n_regionkey") < 2, "A").otherwise("B"))
    return batteries.shape_battery(n, "k", "g", ["a", "b", "c"])


@query(_WIN + """, c AS (SELECT wd.user_id, wd.episode_id, any_value(wn.t_on) AS t_on, any_value(wn.t_off) AS t_off, count(*) AS n FROM wd JOIN wn USING (user_id, episode_id) GROUP BY ALL)
SELECT user_id, episode_id, n, CAST(floor((t_off - t_on - 86400 + 1e-9) / 43200) + 1 AS BIGINT) AS expected, abs(n - (floor((t_off - t_on - 86400 + 1e-9) / 43200) + 1)) <= 1 AS matches FROM c""")
def window_count_check(t):
    return _long(reports.window_counts(_windows(t), ("user_id", "episode_id"), 86_400.0, 43_200.0).withColumn("window_id", F.lit(0))).select("user_id", "episode_id", "n", "expected", "matches")


@query(_SAMP + """, st AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id, episode_id, window_id ORDER BY t) AS dt FROM sw),
ag AS (SELECT user_id, episode_id, window_id, count(DISTINCT t) AS n, max(CASE WHEN dt > 0 THEN dt END) AS gap FROM st GROUP BY ALL), ds AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS dt FROM (SELECT DISTINCT user_id, t FROM e)),
fs AS (SELECT user_id, 1 / median(dt) AS fs FROM ds WHERE dt > 0 GROUP BY user_id),
q AS (SELECT wd.user_id, coalesce(n, 0) / (fs * 86400) >= 0.6 AS c, coalesce(gap <= 40000, false) AS g, coalesce(n, 0) > 0 AS f FROM wd LEFT JOIN ag USING (user_id, episode_id, window_id) LEFT JOIN fs USING (user_id)),
a AS (SELECT user_id, count(*) AS n_windows, avg(CASE WHEN c THEN 1.0 ELSE 0 END) AS coverage, avg(CASE WHEN g THEN 1.0 ELSE 0 END) AS gap_free, avg(CASE WHEN f THEN 1.0 ELSE 0 END) AS filled FROM q GROUP BY user_id),
b AS (SELECT *, CASE WHEN coverage >= 0.98 THEN 'OK' WHEN coverage >= 0.9 THEN 'WARN' ELSE 'FAIL' END AS coverage_status, CASE WHEN gap_free >= 0.98 THEN 'OK' WHEN gap_free >= 0.9 THEN 'WARN' ELSE 'FAIL' END AS gap_free_status, CASE WHEN filled >= 0.98 THEN 'OK' WHEN filled >= 0.9 THEN 'WARN' ELSE 'FAIL' END AS filled_status FROM a)
SELECT user_id, n_windows, round(coverage, 6) AS coverage, round(gap_free, 6) AS gap_free, round(filled, 6) AS filled, coverage_status, gap_free_status, filled_status,
CASE WHEN 'FAIL' IN (coverage_status, gap_free_status, filled_status) THEN 'FAIL' WHEN 'WARN' IN (coverage_status, gap_free_status, filled_status) THEN 'WARN' ELSE 'OK' END AS overall FROM b""")
def window_report(t):
    q = windowing.window_quality(_events(t), _windows(t).select(*WN, "t_start", "t_end"), 86_400.0, 43_200.0, 0.6, 40_000.0, TR)
    return reports.window_report(q, TR)


@query("""WITH q AS (SELECT l_returnflag, l_linestatus, l_extendedprice AS x, quantile_cont(l_extendedprice, 0.25) OVER w AS q1, quantile_cont(l_extendedprice, 0.75) OVER w AS q3 FROM lineitem WINDOW w AS (PARTITION BY l_returnflag, l_linestatus))
SELECT l_returnflag, l_linestatus, round(any_value(q1), 6) AS q1, round(median(x), 6) AS median, round(any_value(q3), 6) AS q3, round(min(x) FILTER (x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS low,
round(max(x) FILTER (x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS high, count(*) AS n FROM q GROUP BY ALL""")
def box_table(t):
    return reports.box_table(t("lineitem"), "l_extendedprice", ("l_returnflag", "l_linestatus"))


@query(f"""WITH {_CUS}, h AS (SELECT g, x, min(x) OVER (PARTITION BY g) AS lo, (max(x) OVER (PARTITION BY g) - min(x) OVER (PARTITION BY g)) / 12 AS w FROM c)
SELECT g, CAST(least(floor((x - lo) / w), 11) AS BIGINT) AS bin, round(any_value(lo) + least(floor((x - lo) / w), 11) * any_value(w), 6) AS edge, count(*) AS n FROM h GROUP BY g, least(floor((x - lo) / w), 11)""")
def histogram(t):
    return reports.histogram(_customers(t), "x", 12, ("g",))


@query("""SELECT l_suppkey, event AS l_returnflag, coalesce(fs, 148.0) AS fs_used FROM (SELECT DISTINCT l_suppkey, l_returnflag AS event FROM lineitem) LEFT JOIN
(SELECT l_suppkey AS s, l_returnflag AS f, round(min(l_quantity), 6) AS fs FROM lineitem WHERE l_linenumber = 7 GROUP BY ALL HAVING count(*) = 1) ON s = l_suppkey AND f = event""")
def rate_or_fallback(t):
    channels = t("lineitem").select("l_suppkey", "l_returnflag").distinct()
    return reports.rate_or_fallback(channels, t("lineitem").where("l_linenumber = 7"), ("l_suppkey", "l_returnflag"), 148.0, "l_quantity")


def _driver_rows(t, rows: list, schema: str) -> DataFrame:
    return t("nation").sparkSession.createDataFrame(rows, schema)


def _importances(t) -> DataFrame:
    n = _nations(t).withColumn("y", (F.col("a") > 4500).cast("int"))
    forest = trees.Forest.of_table(trees.forest_table(n, "y", list("bcd")))
    return trees.importance_table(trees.shapley_rows(n, "k", list("bcd"), forest), forest, list("bcd"))


@query()
def shap_depth2(t):
    return _importances(t).select("feature", "mean_abs_shap", "gini")


@query()
def power_and_sample_size(t):
    rows = [(r, float(exact_tests.mann_whitney_power(r, 14, 8)), exact_tests.sample_size(r)) for r in (0.3, 0.5, 0.517, 0.617, 0.7, 0.75, 0.867, 0.9)]
    return _driver_rows(t, rows, "r double, power double, n_for_80 int")


@query()
def shapiro_fisher_exact(t):
    n = _nations(t).orderBy("k").toPandas()  # 25 rows
    w, p = exact_tests.shapiro_wilk(n["a"])
    high, few = n["a"] > 4500, n["d"] < n["d"].median()
    odds, q = exact_tests.fisher_exact(int((high & few).sum()), int((high & ~few).sum()), int((~high & few).sum()), int((~high & ~few).sum()))
    return _driver_rows(t, [("shapiro", float(w), float(p)), ("fisher", float(odds), float(q))], "test string, statistic double, p double")


@query()
def likelihood_ratio_interactions(t):
    d = t("lineitem").select("l_suppkey", "l_returnflag", "l_linestatus", F.ln(F.col("l_extendedprice") + 1e-8).alias("y"))
    factors = {"l_returnflag": ("A", ["N", "R"]), "l_linestatus": ("F", ["O"])}
    fits = []
    for cross in ([("l_returnflag", "l_linestatus")], []):
        cols = mixed_model.design(factors, cross)
        fits.append(mixed_model.fit_random_intercept(mixed_model.sufficient_statistics(d, "l_suppkey", "y", cols), list(cols), reml=False))
    x, df, p = mixed_model.likelihood_ratio(*fits)
    return _driver_rows(t, [(float(x), df, float(p))], "lr double, df int, p double")


@query()
def tremor_gate_filter(t):
    d = _events(t).select("user_id", "event_id", "t", "x")
    return signals.tremor_gate(d, "x", TR, ("event_id",)).select("user_id", "event_id", "gate")


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
