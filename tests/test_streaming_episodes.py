"""Stateful episodes of a stream equal hysteresis and merging of the batch."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from pulseframe.operators import episodes
from pulseframe.streaming.episodes import Episodes, track_episodes

SCHEMA = "subject string, trial string, ts timestamp, t double, gate double, thr_on double, thr_off double"
ZERO = datetime(2024, 1, 1, tzinfo=timezone.utc)


def samples(seed: int, subject: str, on: float, off: float, n: int = 600) -> list:
    r, level, out = random.Random(seed), 0.0, []
    for k in range(n):
        level = max(0.0, min(1.0, level + r.uniform(-0.25, 0.25)))
        t = k / 10 + r.uniform(0, 0.05)
        out.append((subject, "x", ZERO + timedelta(seconds=t), t, None if k % 97 == 5 else level, on, off))
    return out


def batch(spark, rows, gap):
    d = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in episodes.merge_close(episodes.hysteresis(d), gap).select("subject", "trial", "t_on", "t_off").collect())


def test_recurrence_without_a_stream(spark):
    for gap in (0.0, 0.7, 5.0):
        for on, off in ((0.7, 0.3), (0.5, 0.5), (0.4, 0.6)):
            rows = [r for r in samples(5, "s", on, off) if r[4] is not None]
            e = Episodes(gap)
            got = [x for r in rows for x in e.push(0, *r[3:])]
            got += e.end()
            assert [("s", "x", *x) for x in got] == batch(spark, rows, gap)


def test_shuffled_micro_batches_with_late_rows(spark, tmp_path):
    gap, delay, kinds = 0.6, 8.0, {"calm": (0.7, 0.3), "inverted": (0.4, 0.6), "short": (0.6, 0.2)}
    rows = [r for k, (name, (on, off)) in enumerate(kinds.items()) for r in samples(k, name, on, off, 200 if name == "short" else 600)]
    r = random.Random(1)
    order = sorted(rows, key=lambda x: x[3] + r.uniform(0, delay * 0.9))  # no row is behind another by more than the delay
    late = [("calm", "x", ZERO + timedelta(seconds=10.5), 10.5, 9.0, 0.7, 0.3)]  # would open an episode, but comes when its time has long passed
    last = [("z", "z", ZERO + timedelta(days=1), 86_400.0, 0.0, 1.0, 0.5)]
    parts = [order[k : k + 150] for k in range(0, len(order), 150)]
    parts[6] = parts[6] + late
    src = tmp_path / "in"
    for k, part in enumerate([*parts, last, [(*last[0][:2], ZERO + timedelta(days=2), 2 * 86_400.0, 0.0, 1.0, 0.5)]]):
        r.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(src / f"{k:03d}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(src))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        q = track_episodes(stream, gap, late=f"{delay} seconds", idle=30.0).writeStream.format("memory").queryName("tracked").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
        q.processAllAvailable()
        progress = q.recentProgress
        q.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = sorted(tuple(x) for x in spark.table("tracked").where("subject <> 'z'").collect())
    want = batch(spark, rows, gap)
    assert got == want and len(want) > 20
    assert batch(spark, rows + late, gap) != want
    first = next(p["batchId"] for p in progress if p["sink"]["numOutputRows"] > 0)
    assert first < len(parts) - 2  # episodes leave while the stream runs
    assert spark.table("tracked").where(F.col("t_off") < F.col("t_on")).count() == 0


def test_schema_follows_the_keys(spark):
    stream = spark.readStream.format("rate").load().select(F.col("value").alias("k"), F.col("timestamp").alias("ts"), *[F.lit(1.0).alias(c) for c in ("t", "gate", "thr_on", "thr_off")])
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        assert dict(track_episodes(stream, 1.0, ("k",)).dtypes) == {"k": "bigint", "t_on": "double", "t_off": "double"}
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    with pytest.raises(Exception, match="thr_off"):
        track_episodes(stream.drop("thr_off"), 1.0, ("k",))
