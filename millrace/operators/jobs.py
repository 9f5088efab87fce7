"""Job queue, quotas and logs: batch views of time-driven state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ATTEMPTS = 3


def claimable(jobs: DataFrame, now: DataFrame) -> DataFrame:
    """Jobs that a worker may claim at ``now`` (one row, one timestamp): queued and due, or
    running with an expired lease, with attempts left."""
    at = jobs.crossJoin(F.broadcast(now.toDF("now")))  # one row
    due = ((F.col("status") == "queued") & (F.col("available_at") <= F.col("now"))) | ((F.col("status") == "running") & (F.col("lease_expires_at") < F.col("now")))
    return at.where(due & (F.col("attempts") < MAX_ATTEMPTS)).drop("now")


def next_wake(jobs: DataFrame, now: DataFrame) -> DataFrame:
    """(seconds): from ``now`` to the first time a job falls due or a lease runs out; null if none will."""
    due = jobs.where("status = 'queued'").select(F.col("available_at").alias("at")).union(jobs.where("status = 'running'").select("lease_expires_at"))
    later = due.crossJoin(F.broadcast(now.toDF("now"))).where("at > now")  # one row
    return later.agg(F.min(F.timestamp_diff("MICROSECOND", F.col("now").cast("timestamp"), F.col("at").cast("timestamp")) / 1e6).alias("seconds"))


def daily_use(events: DataFrame, limit: int) -> DataFrame:
    """(day, user_id, used, over): events of each user in each UTC day, and whether they pass ``limit``."""
    counts = events.groupBy(F.date_format("ts", "yyyyMMdd").alias("day"), "user_id").agg(F.count("*").alias("used"))
    return counts.withColumn("over", F.col("used") > limit)


def log_tail(lines: DataFrame, most: int) -> DataFrame:
    """The last ``most`` lines (at, line), newest first, each parsed as JSON or kept raw."""
    last = lines.orderBy(F.desc("at"), F.desc("line")).limit(most)
    return last.withColumn("raw", F.when(F.json_object_keys("line").isNull(), F.col("line")))
