"""Streaming forms of two batch operators, for frames as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_counts(frames: DataFrame, ts: str, key: str, gap: str = "2 hours", late: str = "6 hours") -> DataFrame:
    """Frames by session and key; rows later than the watermark are dropped."""
    rows = frames.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    counts = rows.groupBy(F.session_window("__ts", gap).alias("session"), key).agg(F.count("*").alias("n"))
    return counts.select(key, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "n")


def rejection_counts(frames: DataFrame, ts: str, reason: str, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Rejected frames by reason and tumbling window."""
    rows = frames.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late).where(F.col(reason).isNotNull())
    return rows.groupBy(F.window("__ts", window).alias("w"), reason).agg(F.count("*").alias("n")).select(reason, F.col("w.start").alias("start"), "n")
