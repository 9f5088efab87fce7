"""State over time: index runs, queue transitions, token families, owners, cached results, timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .jobs import MAX_ATTEMPTS

#: Seconds that a lease holds, that a retry waits for each attempt made, that a cached result
#: counts, and within which a token just rotated may be shown again.
LEASE, RETRY, CACHE_TTL, GRACE = 120, 10, 300, 10
#: Result counts asked for: none or zero is the default, and there is a most.
DEFAULT_TOP_K, MOST_TOP_K = 10, 50


def later(at: Column, seconds: Column | int) -> Column:
    """``at`` and a number of seconds."""
    n = F.lit(seconds) if isinstance(seconds, int) else seconds
    return at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), n.cast("decimal(18,6)"))


def clamped_top_k(asked: Column) -> Column:
    return F.least(F.coalesce(F.nullif(asked, F.lit(0)), F.lit(DEFAULT_TOP_K)), F.lit(MOST_TOP_K))


def run_counters(batches: DataFrame, measures: list[str]) -> DataFrame:
    """(run_id, aborted, files_failed, and each of ``measures``): what an index run adds up to.

    ``batches`` (run_id, place, files, outcome, measures). A batch that fails counts its
    files as failed and nothing else; at one that aborts the run ends, and what was
    finished before it stays.
    """
    stops = batches.where("outcome = 'abort'").groupBy("run_id").agg(F.min("place").alias("stop"))
    placed = batches.join(stops, "run_id", "left")
    done = F.col("stop").isNull() | (F.col("place") < F.col("stop"))
    counted = lambda c: F.coalesce(F.sum(F.when(done & (F.col("outcome") == "ok"), F.col(c))), F.lit(0)).alias(c)
    failed = F.coalesce(F.sum(F.when(done & (F.col("outcome") == "failed"), F.col("files"))), F.lit(0)).alias("files_failed")
    return placed.groupBy("run_id").agg(F.max(F.col("stop").isNotNull()).alias("aborted"), failed, *[counted(m) for m in measures])


def stage_totals(spans: DataFrame) -> DataFrame:
    """(request_id, stage, ms, spans): each stage's time, added up over the times it was entered."""
    return spans.groupBy("request_id", "stage").agg(F.sum("ms").alias("ms"), F.count("*").alias("spans"))


def ribbon(stages: DataFrame) -> DataFrame:
    """Rows with the four shown stages and the overhead of a request's latencies."""
    ms = lambda *names: sum((F.coalesce(F.col(n + "_ms"), F.lit(0)) for n in names[1:]), F.coalesce(F.col(names[0] + "_ms"), F.lit(0)))
    return stages.select("request_id", ms("retrieval").alias("retrieve"), ms("evidence_selection", "context_construction").alias("evidence"), ms("llm").alias("reason"), ms("verification").alias("verify"), ms("intent", "formatting").alias("overhead"))


def transitions(jobs: DataFrame, now: Column, leaving: Column, cancelled: Column, beating: Column) -> DataFrame:
    """Each job with its next ``status``, ``attempts``, ``available_at`` and ``lease_expires_at``.

    In this order: jobs of ``cancelled`` repositories end, queued or running; a running job
    whose lease is over fails once its attempts are used up, else waits for a claim as it
    is; those of a worker that leaves (``leaving``) go back at once with the attempt
    refunded; a beating worker's lease is renewed.
    """
    running = F.col("status") == "running"
    over = running & (F.col("lease_expires_at") < now)
    step = (
        F.when(F.col("status").isin("queued", "running") & cancelled, "cancel").when(over & (F.col("attempts") >= MAX_ATTEMPTS), "reap")
        .when(running & ~over & leaving, "release").when(running & ~over & beating, "renew").otherwise("keep")
    )
    rows, step_ = jobs.withColumn("step", step), F.col("step")
    return rows.withColumns({
        "status": F.when(step_ == "cancel", "cancelled").when(step_ == "reap", "failed").when(step_ == "release", "queued").otherwise(F.col("status")),
        "attempts": F.when(step_ == "release", F.greatest(F.col("attempts") - 1, F.lit(0))).otherwise(F.col("attempts")),
        "available_at": F.when(step_ == "release", now).otherwise(F.col("available_at")),
        "lease_expires_at": F.when(step_.isin("cancel", "reap", "release"), None).when(step_ == "renew", later(now, LEASE)).otherwise(F.col("lease_expires_at")),
    })


def after_failure(jobs: DataFrame, failed_at: Column, lasting: Column) -> DataFrame:
    """Jobs whose attempt failed: requeued RETRY seconds later for each attempt made, or
    failed for good after the last attempt or an error that lasts (``lasting``)."""
    ends = (F.col("attempts") >= MAX_ATTEMPTS) | lasting
    return jobs.withColumn("status", F.when(ends, "failed").otherwise("queued")).withColumn("available_at", F.when(ends, F.col("available_at")).otherwise(later(failed_at, F.col("attempts") * RETRY)))


def token_families(shown: DataFrame) -> DataFrame:
    """(family, revoked_at, refused): per token family when a rotated token came back too
    late to be the same client's double submit, and how many came within the grace.
    ``shown`` (family, rotated_at, shown_at), one row each time a token is presented."""
    age = F.timestamp_diff("MICROSECOND", F.col("rotated_at").cast("timestamp"), F.col("shown_at").cast("timestamp")) / 1e6
    old = F.col("rotated_at").isNotNull() & (age > GRACE)
    soon = F.col("rotated_at").isNotNull() & (age >= 0) & (age <= GRACE)
    return shown.groupBy("family").agg(F.min(F.when(old, F.col("shown_at"))).alias("revoked_at"), F.count_if(soon).alias("refused"))


def reassigned(owned: DataFrame, giver: Column, taker: Column, most: int) -> DataFrame:
    """``owned`` (owner_id, item_id, created_at) with the new owner of up to ``most`` of the
    oldest items of each owner that ``giver`` holds for."""
    place = F.row_number().over(Window.partitionBy("owner_id").orderBy("created_at", "item_id"))
    moved = owned.where(giver).withColumn("place", place).where(F.col("place") <= most).select("item_id", F.lit(True).alias("moved"))
    return owned.join(moved, "item_id", "left").withColumn("owner_id", F.when(F.col("moved"), taker).otherwise(F.col("owner_id"))).drop("moved")


def cache_lookups(lookups: DataFrame, stored: DataFrame) -> DataFrame:
    """(lookup_id, result_id): the newest result stored under a look-up's key that is at most
    CACHE_TTL seconds old, null for a miss. ``lookups`` (lookup_id, key, asked_at), ``stored``
    (result_id, key, stored_at). Keys and spans of CACHE_TTL seconds are joined, so that a
    common key is split by time."""
    span = lambda at: F.floor(F.unix_micros(at.cast("timestamp")) / (CACHE_TTL * 1_000_000))
    asked = lookups.withColumn("span", F.explode(F.array(span(F.col("asked_at")), span(F.col("asked_at")) - 1)))
    met = asked.join(stored.withColumn("span", span(F.col("stored_at"))), ["key", "span"])
    fresh = met.where((F.col("stored_at") <= F.col("asked_at")) & (F.col("asked_at") < later(F.col("stored_at"), CACHE_TTL)))
    newest = fresh.groupBy("lookup_id").agg(F.max_by("result_id", F.struct("stored_at", "result_id")).alias("result_id"))
    return lookups.select("lookup_id").join(newest, "lookup_id", "left")
