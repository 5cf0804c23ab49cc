"""A finished stream equals the batch."""

SMALL = "/root/testdata/sf0.001"
from pyspark.sql import functions as F

from pulseframe.streaming import mirror


def test_batch_equality(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src = str(tmp_path / "in")
    # A last row far ahead moves the watermark past all windows.
    last = events.limit(1).withColumn("ts", F.lit("2030-01-01").cast("timestamp")).withColumn("value", F.lit(1000.0))
    events.repartition(1).write.parquet(src)
    last.write.mode("append").parquet(src)
    stream = spark.readStream.schema(events.schema).parquet(src)
    for k, (f, args) in enumerate(((mirror.tumbling_features, (["event_type"], "1 day")), (mirror.session_episodes, (["user_id"], 20.0, "6 hours")))):
        q = f(stream, "ts", "value", *args, late="60 days").writeStream.format("memory").queryName(f"out{k}").outputMode("append").option("checkpointLocation", str(tmp_path / f"c{k}")).start()
        q.processAllAvailable()
        q.stop()
        want = f(events, "ts", "value", *args).drop("w")
        got = spark.table(f"out{k}").drop("w")
        show = lambda d: sorted(tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in d.collect())
        assert show(got) == show(want)
