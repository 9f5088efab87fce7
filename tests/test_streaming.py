"""Streams against their batch twins."""

from millrace.operators import jobs
from millrace.sources import readers
from millrace.streaming import quotas


def drained(stream, spark, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_daily_use_stream_equals_batch(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/events*.parquet")
    got = drained(quotas.daily_use(stream, 3), spark, "daily_use", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, jobs.daily_use(events, 3).collect()))


def test_job_states_stream_keeps_the_newest(spark, tmp_path):
    spark.sql("SELECT * FROM VALUES (1, 'queued', TIMESTAMP'2024-01-01 00:00:00', 0), (1, 'running', TIMESTAMP'2024-01-01 00:01:00', 1), (2, 'done', TIMESTAMP'2024-01-01 00:00:00', 1) AS t(job_id, status, at, attempts)").write.parquet(str(tmp_path / "c"))
    stream = spark.readStream.schema("job_id int, status string, at timestamp, attempts int").parquet(str(tmp_path / "c"))
    got = drained(quotas.job_states(stream), spark, "job_states", "complete")
    assert {(r.job_id, r.status) for r in got.collect()} == {(1, "running"), (2, "done")}


def test_log_lines_parse_or_stay_raw(spark, tmp_path):
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "a.log").write_text('{"level": "info", "n": 1}\nplain\n')
    batch = readers.json_log(spark, str(tmp_path / "l"), "level string, n int").collect()
    assert {(r.record.level if r.record else None, r.raw) for r in batch} == {("info", None), (None, "plain")}
    stream = quotas.parsed_log(spark.readStream.text(str(tmp_path / "l")), "level string, n int")
    assert {r.raw for r in drained(stream, spark, "log_lines", "append").collect()} == {None, "plain"}


def test_source_tree_and_partition_replacement(spark, tmp_path):
    root = tmp_path / "repo"
    (root / "src").mkdir(parents=True)
    (root / "src" / "a.py").write_text("x = 1\n")
    (root / "b.bin").write_bytes(b"\xff\xfe\x00")
    got = {r.path: (r.size_bytes, r.text) for r in readers.source_tree(spark, str(root), "r").collect()}
    assert got == {"src/a.py": (6, "x = 1\n"), "b.bin": (3, None)}
    out = str(tmp_path / "out")
    readers.replace_partitions(spark.createDataFrame([("a", 1), ("b", 2)], ["k", "v"]), out, "k")
    readers.replace_partitions(spark.createDataFrame([("b", 3)], ["k", "v"]), out, "k")
    assert {(r.k, r.v) for r in spark.read.parquet(out).collect()} == {("a", 1), ("b", 3)}
