"""Streaming twins of the time-driven views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_use(events: DataFrame, limit: int, late: str = "1 day") -> DataFrame:
    """The streaming twin of the daily quota view: (day, user_id, used, over) by tumbling
    UTC days; events later than ``late`` are dropped and finished days leave the state."""
    counts = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).groupBy(F.window("at", "1 day"), "user_id").agg(F.count("*").alias("used"))
    return counts.select(F.date_format("window.start", "yyyyMMdd").alias("day"), "user_id", "used", (F.col("used") > limit).alias("over"))


def parsed_log(lines: DataFrame, fields: str) -> DataFrame:
    """A stream of text lines (value) as JSON fields, or kept raw where they are none."""
    parsed = F.from_json("value", fields, {"mode": "PERMISSIVE"})
    return lines.select(F.when(F.json_object_keys("value").isNotNull(), parsed).alias("record"), F.when(F.json_object_keys("value").isNull(), F.col("value")).alias("raw"))


def job_states(changes: DataFrame) -> DataFrame:
    """The newest state of each job from a stream of changes (job_id, status, at, attempts)."""
    newest = F.max_by(F.struct("status", "attempts", "at"), F.struct("at", "attempts", "status"))
    return changes.groupBy("job_id").agg(newest.alias("s")).select("job_id", "s.*")
