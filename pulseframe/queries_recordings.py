"""Queries over recordings: windows of both modalities and their fused features, each with its SQL.

Events of two kinds stand for muscles and of two others for inertial sensors; a user is a trial and its extent one
interval, in windows of ten days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.operators import features, normalisation, signal_quality, windowing
from pulseframe.queries import TR, WN, _E, _events, _long, query

LENGTH, STEP, STRETCH = 864_000.0, 432_000.0, 1_000_000.0
MUSCLES, SENSORS = ("click", "view"), ("purchase", "error")

_WD = f"""{_E}, sp AS (SELECT user_id, min(t) AS a, max(t) AS b FROM e GROUP BY user_id),
wi AS (SELECT user_id, a, unnest(range(CAST(ceil((b - {LENGTH} + 1e-12 - a) / {STEP}) AS BIGINT))) AS i FROM sp WHERE b - a >= {LENGTH}),
wd AS (SELECT user_id, CAST(1 AS BIGINT) AS episode_id, i + 1 AS window_id, a + i * {STEP} AS t_start, a + i * {STEP} + {LENGTH} AS t_end FROM wi),
sw AS (SELECT wd.user_id, window_id, event_type, e.t, e.x, event_type IN ('click', 'view') AS muscle FROM wd JOIN e ON e.user_id = wd.user_id AND e.t >= t_start AND e.t < t_end)"""


def _windows(t) -> DataFrame:
    spans = _events(t).groupBy("user_id").agg(F.lit(1).alias("episode_id"), F.min("t").alias("t_on"), F.max("t").alias("t_off"))
    return windowing.make_windows(spans, LENGTH, STEP)


def _emg(t) -> DataFrame:
    return _events(t).where(F.col("event_type").isin(*MUSCLES)).select("user_id", F.col("event_type").alias("sensor"), "t", (F.col("x") - 30).alias("emg_bp"), (F.col("x") / 100).alias("env_norm"))


def _imu(t) -> DataFrame:
    x = F.col("x")
    return _events(t).where(x.isNotNull() & F.col("event_type").isin(*SENSORS)).select(
        "user_id", F.col("event_type").alias("sensor"), "t", x.alias("gyro_mag"), (x * x / 97).alias("acc_mag"), (x - 30).alias("acc_dyn"), x.alias("acc_x_g"), (x * x / 97).alias("acc_y_g"), (-x).alias("acc_z_g")
    )


def _side(name: str, test: str) -> str:
    return f"""{name}_st AS (SELECT user_id, window_id, t, t - lag(t) OVER (PARTITION BY user_id, window_id ORDER BY t) AS dt FROM sw WHERE {test}),
{name}_ag AS (SELECT user_id, window_id, count(DISTINCT t) AS n, count(*) AS n_rows, max(CASE WHEN dt > 0 THEN dt END) AS gap FROM {name}_st GROUP BY ALL),
{name}_ds AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS dt FROM e WHERE {test.replace('muscle', "event_type IN ('click', 'view')") if name == 'emg' else "event_type IN ('purchase', 'error')"}),
{name}_fs AS (SELECT user_id, CASE WHEN count(*) >= 2 THEN 1 / median(dt) END AS fs FROM {name}_ds WHERE dt > 0 GROUP BY user_id)"""


def _flags(name: str) -> str:
    return f"""coalesce({name}_ag.n, 0) AS {name}_n, coalesce({name}_ag.n_rows, 0) AS {name}_n_rows, round({name}_ag.gap, 6) AS {name}_max_gap_s, round({name}_fs.fs * {LENGTH}, 6) AS {name}_expected_n,
coalesce(coalesce({name}_ag.n, 0) / ({name}_fs.fs * {LENGTH}) >= 0.6, false) AS {name}_cov_ok, coalesce({name}_ag.gap <= 300000, false) AS {name}_gap_ok,
coalesce(coalesce({name}_ag.n, 0) / ({name}_fs.fs * {LENGTH}) >= 0.6, false) AND coalesce({name}_ag.gap <= 300000, false) AS {name}_ok"""


@query(f"""WITH {_WD}, {_side('emg', 'muscle')}, {_side('imu', "event_type IN ('purchase', 'error')")}
SELECT wd.user_id, episode_id, wd.window_id, {_flags('emg')}, {_flags('imu')} FROM wd LEFT JOIN emg_ag USING (user_id, window_id) LEFT JOIN imu_ag USING (user_id, window_id) LEFT JOIN emg_fs USING (user_id) LEFT JOIN imu_fs USING (user_id)""")
def windows_both(t):
    w = windowing.windows_of_both(_windows(t), _emg(t), _imu(t), LENGTH, 0.6, 300_000.0, TR, STRETCH)
    return _long(w.select(*WN, *[f"{m}_{c}" for m in ("emg", "imu") for c in ("n", "n_rows", "max_gap_s", "expected_n", "cov_ok", "gap_ok", "ok")]))


_KINDS = ("gyro_mag_mean", "gyro_mag_std", "gyro_mag_peak", "acc_mag_mean", "acc_mag_std", "acc_mag_peak", "acc_dyn_mean", "acc_dyn_std", "jerk_norm_mean", "dt_median_s")
_TD = ("MAV", "RMS", "WL", "WAMP", "ZC")
_ONE = [f"round(any_value({c}) FILTER (event_type = '{m}'), 6) AS EMG_{m}_{c}" if c not in ("WAMP", "ZC") else f"any_value({c}) FILTER (event_type = '{m}') AS EMG_{m}_{c}" for m in MUSCLES for c in _TD]
_TWO = [f"round(any_value({c}) FILTER (event_type = '{m}'), 6) AS IMU_{m}_{c}" for m in SENSORS for c in _KINDS]


@query(f"""WITH {_WD}, e1 AS (SELECT user_id, window_id, event_type, x - 30 AS v, stddev_pop(x) OVER p AS sd, count(*) OVER p AS n, abs(x - lag(x) OVER w) AS st, x >= 30 AS up, lag(x >= 30) OVER w AS was
FROM sw WHERE muscle WINDOW p AS (PARTITION BY user_id, window_id, event_type), w AS (PARTITION BY user_id, window_id, event_type ORDER BY t)),
ea AS (SELECT user_id, window_id, event_type, avg(abs(v)) AS MAV, sqrt(avg(v * v)) AS RMS, sum(st) AS WL, count(*) FILTER (st > greatest(50e-6, 0.01 * sd)) AS WAMP, count(*) FILTER (up <> was AND st > 0.01 * sd) AS ZC FROM e1 WHERE n >= 3 GROUP BY ALL),
ew AS (SELECT user_id, window_id, {', '.join(_ONE)}, round(sum(MAV), 6) AS EMG_global_effort_MAV_sum FROM ea GROUP BY ALL),
i1 AS (SELECT *, t - lag(t) OVER w AS dt, sqrt(2 * power(x - lag(x) OVER w, 2) + power(x * x / 97 - lag(x * x / 97) OVER w, 2)) AS j FROM sw WHERE event_type IN ('purchase', 'error') AND x IS NOT NULL WINDOW w AS (PARTITION BY user_id, window_id, event_type ORDER BY t)),
ia AS (SELECT user_id, window_id, event_type, avg(x) AS gyro_mag_mean, stddev_samp(x) AS gyro_mag_std, max(x) AS gyro_mag_peak, avg(x * x / 97) AS acc_mag_mean, stddev_samp(x * x / 97) AS acc_mag_std, max(x * x / 97) AS acc_mag_peak,
avg(x - 30) AS acc_dyn_mean, stddev_samp(x - 30) AS acc_dyn_std, CASE WHEN count(*) >= 3 THEN avg(j) / median(dt) END AS jerk_norm_mean, CASE WHEN count(*) >= 3 THEN median(dt) / pi() END AS dt_median_s FROM i1 GROUP BY ALL),
iw AS (SELECT user_id, window_id, {', '.join(_TWO)} FROM ia GROUP BY ALL), il AS (SELECT user_id, window_id, round(avg(x), 6) AS IMU_all_gyro_mag_mean, round(max(x), 6) AS IMU_all_gyro_mag_peak FROM i1 GROUP BY ALL),
hs AS (SELECT user_id, window_id, bool_or(muscle) AS has_emg, bool_or(event_type IN ('purchase', 'error') AND x IS NOT NULL) AS has_imu FROM sw GROUP BY ALL)
SELECT wd.user_id, episode_id, wd.window_id, coalesce(has_emg, false) AS has_emg, coalesce(has_imu, false) AS has_imu, ew.* EXCLUDE (user_id, window_id), iw.* EXCLUDE (user_id, window_id), il.* EXCLUDE (user_id, window_id)
FROM wd LEFT JOIN ew USING (user_id, window_id) LEFT JOIN iw USING (user_id, window_id) LEFT JOIN il USING (user_id, window_id) LEFT JOIN hs USING (user_id, window_id)""")
def window_features_wide(t):
    f = features.window_features(_windows(t), _emg(t), _imu(t), list(MUSCLES), list(SENSORS), MUSCLES, None, LENGTH, 3, 3, TR, STRETCH)
    names = [f"EMG_{m}_{c}" for m in MUSCLES for c in _TD] + [f"IMU_{m}_{c}" for m in SENSORS for c in _KINDS]
    return _long(f.select(*WN, "has_emg", "has_imu", "EMG_global_effort_MAV_sum", "IMU_all_gyro_mag_mean", "IMU_all_gyro_mag_peak", *[(F.col(c) / F.pi()).alias(c) if c.endswith("dt_median_s") else c for c in names]))  # so that no value lies between two roundings


@query(f"""WITH {_WD}, s AS (SELECT user_id, window_id, event_type, t, x / 100 AS v FROM sw WHERE muscle AND x IS NOT NULL), two AS (SELECT user_id, window_id FROM s GROUP BY ALL HAVING count(DISTINCT event_type) = 2),
u AS (SELECT DISTINCT user_id, window_id, t FROM s SEMI JOIN two USING (user_id, window_id)), d AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id, window_id ORDER BY t) AS dt FROM u),
g0 AS (SELECT user_id, window_id, min(t) AS a, max(t) AS b, median(dt) AS dt FROM d GROUP BY ALL HAVING count(*) >= 3), g1 AS (SELECT *, CAST(ceil((b + 1e-12 - a) / dt) AS BIGINT) AS n FROM g0),
g AS (SELECT user_id, window_id, dt, a + unnest(range(n)) * dt AS t FROM g1 WHERE n >= 3),
""" + ",\n".join(f"""{k}s AS (SELECT user_id, window_id, t, v FROM s WHERE event_type = '{m}'), {k}p AS (SELECT g.user_id, g.window_id, g.t, q.t AS pt, q.v AS pv FROM g ASOF LEFT JOIN {k}s q ON g.user_id = q.user_id AND g.window_id = q.window_id AND g.t >= q.t),
{k}f AS (SELECT p.*, q.t AS ft, q.v AS fv FROM {k}p p ASOF LEFT JOIN {k}s q ON p.user_id = q.user_id AND p.window_id = q.window_id AND p.t <= q.t), {k}v AS (SELECT user_id, window_id, t, greatest(CASE WHEN pt IS NULL THEN fv WHEN ft IS NULL OR ft = pt THEN pv ELSE pv + (fv - pv) * (t - pt) / (ft - pt) END, 0) AS v FROM {k}f)""" for k, m in zip(("va", "vb"), MUSCLES)) + """,
m AS (SELECT user_id, window_id, vav.t, least(vav.v, vbv.v) AS lo, greatest(vav.v, vbv.v) AS hi FROM vav JOIN vbv USING (user_id, window_id, t)), z AS (SELECT *, lag(lo) OVER w AS pl, lag(hi) OVER w AS ph, t - lag(t) OVER w AS dt FROM m WINDOW w AS (PARTITION BY user_id, window_id ORDER BY t))
SELECT user_id, window_id, round(sum((lo + pl) / 2 * dt) / sum((hi + ph) / 2 * dt), 6) AS coact FROM z GROUP BY ALL HAVING sum((hi + ph) / 2 * dt) > 0""")
def window_coactivation(t):
    f = features.window_features(_windows(t), _emg(t), _imu(t), list(MUSCLES), list(SENSORS), MUSCLES, None, LENGTH, 3, 3, TR, STRETCH)
    return f.where("EMG_CoAct_Bic_Tri IS NOT NULL").select("user_id", F.col("window_id").cast("long").alias("window_id"), F.col("EMG_CoAct_Bic_Tri").alias("coact"))


@query(f"""WITH {_E}, r AS (SELECT DISTINCT user_id AS subject, event_type AS trial, CAST(floor(t / 864000) AS BIGINT) AS sensor FROM e),
a AS (SELECT subject, count(DISTINCT trial) AS n_trials, count(DISTINCT sensor) AS n_sensors, count(*) AS n_rows FROM r GROUP BY 1), l AS (SELECT subject, unnest(['trials', 'sensors', 'rows']) AS what, CAST(unnest([5, 3, 15]) AS BIGINT) AS expected, unnest([n_trials, n_sensors, n_rows]) AS found FROM a)
SELECT * FROM l WHERE expected <> found""")
def completeness_failures(t):
    r = _events(t).select(F.col("user_id").alias("subject"), F.col("event_type").alias("trial"), F.floor(F.col("t") / 864_000).alias("sensor")).distinct()
    return signal_quality.completeness_failures(r, 5, 3)


@query("""WITH o AS (SELECT l_orderkey, l_linenumber, l_tax AS v, 'first' AS source FROM lineitem WHERE l_linenumber < 5), n AS (SELECT l_orderkey, l_linenumber, l_discount AS v, 'second' AS source FROM lineitem WHERE l_linenumber > 2 AND l_orderkey % 3 = 0)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.l_orderkey = o.l_orderkey AND n.l_linenumber = o.l_linenumber)""")
def upsert_two_keys_with_source(t):
    d, keys = t("lineitem"), ("l_orderkey", "l_linenumber")
    old = normalisation.upsert_with_facts(d.limit(0).select(*keys, F.col("l_tax").alias("v"), F.lit("").alias("source")), d.where("l_linenumber < 5").select(*keys, F.col("l_tax").alias("v")), keys, source="first")
    return normalisation.upsert_with_facts(old, d.where("l_linenumber > 2 AND l_orderkey % 3 = 0").select(*keys, F.col("l_discount").alias("v")), keys, source="second")
