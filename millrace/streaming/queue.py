"""The leased job queue as a stream, and a runner that takes each due job once.

A repository has one active job at most, so its state is one small row: ``enqueue`` is
refused while a job is queued or running. Leases and waits are event-time timers, which
the watermark sets off: no worker has to ask. A job that has ended leaves the state
``KEEP`` seconds later, so the state holds active and lately ended jobs only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.jobs import MAX_ATTEMPTS
from ..operators.lifecycle import LEASE, RETRY
from ..sources.scratch import exists

#: Seconds that an ended job stays known, so that events of it that come late are refused as such.
KEEP = 3600
_SECOND = 1_000_000
#: The provider that timers and state need; set it before the stream starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Times are microseconds, as state and timers have no time zone.
STATE = "job_id long, status string, attempts int, available_at long, lease_expires_at long, worker string"
ACTIVE = ("queued", "running")


class Job:
    """The active job of a repository and what an event does to it."""

    def __init__(self, row: tuple | None) -> None:
        self.job_id, self.status, self.attempts, self.available_at, self.lease_expires_at, self.worker = row or (None, None, 0, None, None, None)

    def row(self) -> tuple:
        return self.job_id, self.status, self.attempts, self.available_at, self.lease_expires_at, self.worker

    def over(self, at: int) -> bool:
        return self.status == "running" and self.lease_expires_at < at

    def end(self, status: str) -> None:
        self.status, self.lease_expires_at, self.worker = status, None, None

    def apply(self, kind: str, job_id: int | None, worker: str | None, at: int) -> str:
        """The step taken: the event's own, ``refused`` or, where a lease had run out first, ``reap``."""
        if self.over(at) and self.attempts >= MAX_ATTEMPTS and kind != "cancel":
            self.end("failed")
            return "reap"
        if kind == "enqueue":
            if self.status in ACTIVE:
                return "refused"
            self.job_id, self.status, self.attempts, self.available_at = job_id, "queued", 0, at
            return kind
        if kind == "cancel":  # by repository, whatever its job
            if self.status not in ACTIVE:
                return "refused"
            self.end("cancelled")
            return kind
        if job_id != self.job_id:
            return "refused"
        if kind == "claim":
            due = self.status == "queued" and self.available_at <= at or self.over(at)
            if not due or self.attempts >= MAX_ATTEMPTS:
                return "refused"
            self.status, self.attempts, self.worker, self.lease_expires_at = "running", self.attempts + 1, worker, at + LEASE * _SECOND
            return kind
        if self.status != "running" or worker != self.worker:
            return "refused"  # another worker has it now, or it has ended
        if kind == "beat":
            self.lease_expires_at = at + LEASE * _SECOND
        elif kind == "finish":
            self.end("done")
        elif kind == "break" or kind == "fail" and self.attempts >= MAX_ATTEMPTS:
            self.end("failed")
        elif kind == "fail":
            self.status, self.worker, self.lease_expires_at, self.available_at = "queued", None, None, at + RETRY * self.attempts * _SECOND
        elif kind == "leave":  # the worker is shut down: the attempt is given back
            self.status, self.worker, self.lease_expires_at, self.available_at, self.attempts = "queued", None, None, at, max(self.attempts - 1, 0)
        else:
            return "refused"
        return kind

    def expire(self, at: int) -> str | None:
        """What a timer at ``at`` does: ``due`` when the job may be claimed (again), ``reap``
        when its last lease ran out; None where nothing is left to do."""
        if self.status == "running" and self.lease_expires_at <= at:
            if self.attempts < MAX_ATTEMPTS:
                return "due"
            self.end("failed")
            return "reap"
        return "due" if self.status == "queued" and self.available_at <= at else None

    def timer(self) -> int | None:
        return self.available_at if self.status == "queued" else self.lease_expires_at if self.status == "running" else None


def _ms(at: int) -> int:
    """The timer's millisecond, none too early."""
    return -(-at // 1000)


def _keyed(events: DataFrame) -> DataFrame:
    kept = events.where("repository_id IS NOT NULL AND at IS NOT NULL")
    return kept.select(F.col("repository_id").cast("long"), F.col("job_id").cast("long"), "kind", "worker", F.col("at").cast("timestamp"), F.unix_micros(F.col("at").cast("timestamp")).alias("micros"), "place")


def _timed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.timestamp_micros(c) for c in ("at", "available_at", "lease_expires_at") if c in rows.columns})


class LeasedQueue(StatefulProcessor):
    """``Job`` kept in a value state, with a timer for its lease or wait and one for its removal."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("job", STATE)

    def _change(self, key: tuple, at: int, step: str, job: Job) -> Row:
        return Row(repository_id=key[0], at=at, step=step, **dict(zip((c.split()[0] for c in STATE.split(", ")), job.row())))

    def _settle(self, job: Job, before: int | None, at: int) -> None:
        """Keep the state; set the timer that it now needs instead of the one before."""
        self.state.update(job.row())
        after = job.timer()
        if after != before:
            if before:
                self.handle.deleteTimer(_ms(before))
            if after:
                self.handle.registerTimer(_ms(after) + 1)
        if job.status not in ACTIVE:
            self.handle.registerTimer(_ms(at + KEEP * _SECOND))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        job = Job(self.state.get() if self.state.exists() else None)
        for r in sorted(rows, key=lambda r: (r.micros, r.place)):
            while True:
                timer = job.timer()
                step = job.apply(r.kind, r.job_id, r.worker, r.micros)
                yield self._change(key, r.micros, step, job)
                if job.status is not None:
                    self._settle(job, timer, r.micros)
                if step != "reap":
                    break  # a reaped job makes room for the event itself

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        if not self.state.exists():
            return
        job = Job(self.state.get())
        at = expiredTimerInfo.getExpiryTimeInMs() * 1000
        if job.status not in ACTIVE:
            last = list(self.handle.listTimers())
            if not [t for t in last if t > expiredTimerInfo.getExpiryTimeInMs()]:  # no later removal is set
                self.state.clear()
            return
        step = job.expire(at)
        if step:
            if step == "reap":
                self._settle(job, None, at)
            yield self._change(key, at, step, job)


def leased_queue(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The changes that a stream of ``events`` (repository_id, job_id, kind, worker, at, place)
    makes, those of timers included: each with the job as it then stands.

    ``kind``: enqueue, claim, beat, finish, fail, break (fails for good), leave, cancel.
    Events of one time go by ``place``. Events later than ``late`` behind the newest are
    dropped. Events that may not be are rows with the step ``refused``; unknown kinds too.
    """
    change = "repository_id long, at long, step string, " + STATE
    keyed = _keyed(events).withWatermark("at", late).groupBy("repository_id")
    return _timed(keyed.transformWithState(LeasedQueue(), change, "append", "eventTime"))


def replayed(events: DataFrame, until: datetime | None = None) -> DataFrame:
    """The batch twin of ``leased_queue``: the last state of each repository's newest job
    after all ``events``, with the leases that ran out by ``until``."""

    end = None if until is None else int(until.timestamp() * _SECOND)

    def fold(key: tuple[object, ...], rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        job = Job(None)
        for batch in rows:
            for r in batch.itertuples():
                while job.apply(r.kind, None if pd.isna(r.job_id) else int(r.job_id), r.worker, r.micros) == "reap":
                    pass
        if end is not None and job.status is not None:
            job.expire(end)
        if job.status is not None:
            out = pd.DataFrame([(key[0], *job.row())], columns=["repository_id", *(c.split()[0] for c in STATE.split(", "))])
            yield out

    ordered = _keyed(events).repartition("repository_id").sortWithinPartitions("repository_id", "micros", "place")
    return _timed(ordered.groupBy("repository_id").applyInPandas(fold, "repository_id long, " + STATE))


def run_jobs(due: DataFrame, work: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Start the runner: ``work`` on each batch of the stream ``due``, drained and then stopped.

    A batch's results are one folder under ``target``, written whole and named by the
    batch's id. A batch that was cut short has no complete folder and is done again under
    the same id; one that is complete is not touched, should the stream have stopped
    before it noted so. So each job is in ``target`` once, however often the runner is
    killed. Run it again when ``next_wake`` says.
    """
    spark = due.sparkSession

    def once(batch: DataFrame, batch_id: int) -> None:
        folder = f"{target}/batch={batch_id}"
        if not exists(spark, f"{folder}/_SUCCESS"):
            work(batch).write.mode("overwrite").parquet(folder)

    return due.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
