"""The leased queue: rules on one job, the stream against its batch twin, the runner."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from millrace.streaming import queue

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def micros(when):
    return int(when.timestamp() * 1_000_000)


def steps(*events):
    job = queue.Job(None)
    out = [job.apply(kind, job_id, worker, micros(at(s))) for s, kind, job_id, worker in events]
    return out, (job.job_id, job.status, job.attempts, job.worker)


def test_rules():
    assert steps((0, "claim", 1, "w"), (1, "enqueue", 1, None), (2, "enqueue", 2, None), (3, "claim", 2, "w"), (4, "claim", 1, "w"), (5, "claim", 1, "v"), (6, "beat", 1, "v"), (7, "beat", 1, "w"), (8, "finish", 1, "v"), (9, "finish", 1, "w"), (10, "enqueue", 2, None)) == (
        ["refused", "enqueue", "refused", "refused", "claim", "refused", "refused", "beat", "refused", "finish", "enqueue"], (2, "queued", 0, None))
    # an expired lease lets another worker in; the first may no longer finish
    assert steps((0, "enqueue", 1, None), (0, "claim", 1, "w"), (120, "claim", 1, "v"), (121, "claim", 1, "v"), (122, "finish", 1, "w"), (123, "finish", 1, "v"))[0] == ["enqueue", "claim", "refused", "claim", "refused", "finish"]
    # retries wait longer each time and are used up
    assert steps((0, "enqueue", 1, None), (0, "claim", 1, "w"), (1, "fail", 1, "w"), (10, "claim", 1, "w"), (11, "claim", 1, "w"), (12, "fail", 1, "w"), (31, "claim", 1, "w"), (32, "claim", 1, "w"), (33, "fail", 1, "w")) == (
        ["enqueue", "claim", "fail", "refused", "claim", "fail", "refused", "claim", "fail"], (1, "failed", 3, None))
    # a worker that leaves gives the attempt back; a cancelled job stays cancelled
    assert steps((0, "enqueue", 1, None), (0, "claim", 1, "w"), (1, "leave", 1, "w"), (1, "claim", 1, "v"), (2, "cancel", None, None), (3, "finish", 1, "v"), (4, "cancel", None, None)) == (
        ["enqueue", "claim", "leave", "claim", "cancel", "refused", "refused"], (1, "cancelled", 1, None))
    assert steps((0, "enqueue", 1, None), (0, "claim", 1, "w"), (1, "break", 1, "w"), (2, "what", 1, "w"))[1] == (1, "failed", 1, None)
    lost = [(0, "enqueue", 1, None), *[(200 * i, "claim", 1, "w") for i in range(3)], (1000, "beat", 1, "w")]
    assert steps(*lost)[0][-1] == "reap"


def made(seed, size):
    rng, rows = random.Random(seed), []
    for i in range(size):
        rows.append((rng.randrange(6), rng.randrange(3) if rng.random() < 0.9 else None, rng.choice(["enqueue", "claim", "claim", "claim", "beat", "finish", "fail", "break", "leave", "cancel", "odd"]), rng.choice(["w", "v"]), at(i * 15 + rng.randrange(10)), i))
    return rows


COLUMNS = "repository_id long, job_id long, kind string, worker string, at timestamp, place int"


@pytest.fixture
def rocks(spark):
    spark.conf.set(*queue.STATE_STORE)
    yield
    spark.conf.unset(queue.STATE_STORE[0])


def test_stream_equals_batch(spark, tmp_path, rocks):
    rows = made(3, 300)
    for i in range(4):
        spark.createDataFrame(rows[i * 75 : i * 75 + 75], COLUMNS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    end = at(300 * 15 + 10_000)  # an event far on, of another repository, sets off what timers are left
    spark.createDataFrame([(99, 1, "enqueue", None, end, 0)], COLUMNS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = queue.leased_queue(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(200)
    changes = [r for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.repository_id != 99]
    want = {r.repository_id: (r.job_id, r.status, r.attempts, r.worker) for r in queue.replayed(spark.createDataFrame(rows, COLUMNS), end).collect()}
    alone = {}
    for repo in {r[0] for r in rows}:  # the same once more, without Spark
        job = queue.Job(None)
        for r in sorted((r for r in rows if r[0] == repo), key=lambda r: (r[4], r[5])):
            while job.apply(r[2], r[1], r[3], micros(r[4])) == "reap":
                pass
        job.expire(micros(end))
        alone[repo] = (job.job_id, job.status, job.attempts, job.worker)
    assert want == {k: v for k, v in alone.items() if v[1]}
    order = {"due": 1}
    last = {}
    for r in sorted(changes, key=lambda r: (r.at, order.get(r.step, 0))):
        if r.step not in ("refused", "due"):
            last[r.repository_id] = (r.job_id, r.status, r.attempts, r.worker)
    assert last == want
    assert {"claim", "refused", "reap", "due"} <= {r.step for r in changes}
    # all jobs have ended or wait: of the ended ones nothing is left in the state
    kept = spark.read.format("statestore").option("stateVarName", "job").load(str(tmp_path / "ck")).select("key.repository_id").collect()
    assert {r.repository_id for r in kept} - {99} <= {k for k, v in want.items() if v[1] in queue.ACTIVE}


def test_runner_is_killed_and_runs_each_job_once(spark, tmp_path):
    source = str(tmp_path / "due")
    for i in range(5):
        spark.range(i * 10, i * 10 + 10).withColumnRenamed("id", "job_id").coalesce(1).write.mode("append").parquet(source)
    seen = []

    def work(batch):
        seen.append(sorted(r.job_id for r in batch.collect()))
        if len(seen) == 3:
            raise RuntimeError("killed")
        return batch.selectExpr("job_id", "job_id * 2 AS result")

    def run():
        stream = spark.readStream.schema("job_id long").option("maxFilesPerTrigger", 1).parquet(source)
        return queue.run_jobs(stream, work, str(tmp_path / "done"), str(tmp_path / "ck"))

    with pytest.raises(Exception):
        run().awaitTermination(100)
    # a batch whose results are whole but whose end was not noted
    import shutil

    done = sorted((tmp_path / "ck" / "commits").glob("[0-9]*"))
    for f in (done[-1], done[-1].parent / f".{done[-1].name}.crc"):
        f.unlink(missing_ok=True)
    run().awaitTermination(100)
    run().awaitTermination(100)
    got = sorted(r.job_id for r in spark.read.parquet(str(tmp_path / "done")).collect())
    assert got == list(range(50)) and len(seen) == 6
    shutil.rmtree(tmp_path / "done")
