"""Streaming counterparts of batch operators; equal to them once a stream has ended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_features(stream: DataFrame, ts: str, x: str, keys, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """MAV, RMS, least, largest and n of event-time windows; rows later than the watermark are dropped."""
    w = stream.withWatermark(ts, late) if stream.isStreaming else stream
    return w.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.avg(F.abs(x)).alias("MAV"), F.sqrt(F.avg(F.col(x) * F.col(x))).alias("RMS"), F.min(x).alias("least"), F.max(x).alias("largest"), F.count(x).alias("n"))


def session_episodes(stream: DataFrame, ts: str, x: str, keys, threshold: float, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Episodes as sessions of samples over the threshold that are less than `gap` apart."""
    s = stream.withWatermark(ts, late) if stream.isStreaming else stream
    return s.where(F.col(x) >= threshold).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.min(ts).alias("t_on"), F.max(ts).alias("t_off"), F.max(x).alias("peak"), F.count(F.lit(1)).alias("n"))
