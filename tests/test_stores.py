"""Commit logs, keyed stores and the incremental index on small tables."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import indexing
from millrace.sources import store
from millrace.sources.commits import CommitLog
from millrace.sources.scratch import scratch_path


def test_of_two_writers_one_gets_the_place(spark):
    log = CommitLog(spark, scratch_path(spark, "log"))
    assert log.entries() == []
    assert log.append({"a": 1}, 0) and not log.append({"a": 2}, 0) and log.append({"a": "é"}, 1)
    assert log.entries() == [{"a": 1}, {"a": "é"}]


def test_a_store_changes_the_buckets_it_must(spark):
    path = scratch_path(spark, "store")
    rows = lambda *r: spark.createDataFrame(r, "id long, v string")
    store.create_store(rows((1, "a"), (2, "b"), (3, "c"), (None, "n")), path, "id", 4)
    before = CommitLog(spark, f"{path}/_commits").entries()[-1]["folders"]
    store.upsert(path, rows((2, "B"), (9, "n")), "id")  # the number of buckets is the store's own
    after = CommitLog(spark, f"{path}/_commits").entries()[-1]["folders"]
    assert sum(before.get(b) == f for b, f in after.items()) >= 1
    show = lambda: sorted(((r.id, r.v) for r in store.read_store(spark, path).collect()), key=str)
    assert show() == [(1, "a"), (2, "B"), (3, "c"), (9, "n"), (None, "n")]
    old = store.read_store(spark, path)
    store.delete(path, rows((1, ""), (3, ""), (77, "")), "id")
    assert show() == [(2, "B"), (9, "n"), (None, "n")] and old.count() == 5  # readers keep the table they opened
    store.delete(path, rows((2, ""), (9, "")), "id")
    assert show() == [(None, "n")]
    store.create_store(rows(), path, "id")
    assert show() == [] and store.read_store(spark, path).columns == ["id", "v"]
    with pytest.raises(ValueError):
        store.upsert(path, rows((1, "a")).withColumnRenamed("v", "key").select(F.col("id").alias("k")), "k")
    with pytest.raises(ValueError):
        store.upsert(scratch_path(spark, "none"), rows((1, "a")), "id")


def test_a_change_that_is_cut_short_changes_nothing(spark, monkeypatch):
    path = scratch_path(spark, "store")
    rows = spark.createDataFrame([(i, "a") for i in range(50)], "id long, v string")
    store.create_store(rows, path, "id", 8)
    monkeypatch.setattr(CommitLog, "append", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        store.delete(path, rows, "id")
    monkeypatch.undo()
    assert store.read_store(spark, path).count() == 50
    assert store.cascade([(path, rows.where("id < 10"), "id"), (path, rows.where("id < 5"), "id")]) == [10, 0]
    assert store.read_store(spark, path).count() == 40


def lengths_provider():
    class Quota(Exception):
        pass

    def lengths(texts):
        if any("poison" in t for t in texts):
            raise ValueError("no such text")
        if any("quota" in t for t in texts):
            raise Quota("used up")
        if any("short" in t for t in texts):
            return []
        return [[float(len(t)), 1.0] for t in texts]

    return indexing.Provider("lengths", 2, lengths, batch_size=2, aborts=(Quota,))  # local, so that it goes to workers by value


PROVIDER = lengths_provider()
FILES = "file_id long, text string, vector int"


def shown(index, at=None):
    return sorted((r.file_id, r.chunk_index, r.text, tuple(r.vector), r.run, r.reused) for r in index.chunks(at).collect())


def test_runs_reuse_replace_and_remove(spark, monkeypatch):
    index = indexing.Index(spark, scratch_path(spark, "index"))
    assert index.chunks().count() == 0 and index.snapshots() == []
    one = index.run(spark.createDataFrame([(1, "aa", 0), (2, "bbb", 0), (3, None, 0), (4, "", 0), (None, "x", 0), (5, "aa", 0), (1, "zz", 0)], FILES), PROVIDER)
    assert (one["files_considered"], one["files_skipped"], one["files_failed"], one["chunks_from_cache"], one["chunks_embedded_fresh"]) == (5, 0, 0, 0, 3)
    assert shown(index) == [(1, 0, "aa", (2.0, 1.0), 1, False), (2, 0, "bbb", (3.0, 1.0), 1, False), (5, 0, "aa", (2.0, 1.0), 1, False)]
    two = index.run(spark.createDataFrame([(1, "aa", 0), (2, "aa", 0), (3, None, 0), (4, "new", 0)], FILES), PROVIDER, tag="t")
    assert (two["files_skipped"], two["chunks_from_cache"], two["chunks_embedded_fresh"]) == (2, 1, 1)
    assert shown(index) == [(1, 0, "aa", (2.0, 1.0), 1, False), (2, 0, "aa", (2.0, 1.0), 2, True), (4, 0, "new", (3.0, 1.0), 2, False)]
    assert len(shown(index, 1)) == 3 and index.run(spark.createDataFrame([], FILES), PROVIDER, tag="t") == two  # not done again
    index.compact()
    assert len(index.snapshots()[-1]["layers"]) == 1 and len(shown(index)) == 3
    index.run(spark.createDataFrame([(1, "aa", 0)], FILES), indexing.Provider("other", 2, lambda texts: [[0.0, 0.0] for _ in texts]))
    assert shown(index) == [(1, 0, "aa", (0.0, 0.0), 4, False)]  # vectors of another model are not reused


def test_a_failing_provider_fails_its_batch_or_ends_the_run(spark, monkeypatch):
    monkeypatch.setattr(indexing, "FILE_BATCH", 1)
    index = indexing.Index(spark, scratch_path(spark, "index"))
    good = [(i, f"text {i}", 0) for i in range(8)]
    index.run(spark.createDataFrame(good, FILES), PROVIDER)
    bad = [(i, f"poison {i}" if i == 3 else f"now {i}", 0) for i in range(8)]
    state = index.run(spark.createDataFrame(bad, FILES), PROVIDER)
    kept = {r[0]: r[2] for r in shown(index)}
    assert state["status"] == "ready" and state["files_failed"] >= 1 and kept[3] == "text 3"  # as it was before
    assert {k for k, v in kept.items() if v.startswith("now")} == {r[0] for r in shown(index) if r[4] == 2} and len(kept) == 8
    assert state["files_failed"] == sum(v.startswith("text") for v in kept.values())
    before = shown(index)
    ended = index.run(spark.createDataFrame([(9, "quota", 0), (10, "fine", 0)], FILES), PROVIDER)
    assert ended["status"] == "failed" and ended["error"].startswith("Quota") and shown(index) == before and len(index.snapshots()) == 2
    assert index.run(spark.createDataFrame([(9, "short", 0)], FILES), PROVIDER)["files_failed"] == 1
    # a run killed before its commit leaves the snapshot before it
    before = shown(index)
    monkeypatch.setattr(CommitLog, "append", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        index.run(spark.createDataFrame([(1, "late", 0)], FILES), PROVIDER)
    monkeypatch.undo()
    assert shown(index) == before


def test_a_run_writes_texts_once(spark, monkeypatch):
    written = []
    settle = indexing.settle
    monkeypatch.setattr(indexing, "settle", lambda df, name: written.append(df.columns) or settle(df, name))
    index = indexing.Index(spark, scratch_path(spark, "index"))
    provider = indexing.Provider("ones", 1, lambda texts: [[1.0] for _ in texts])
    files = spark.createDataFrame([(1, "a"), (2, "b"), (2, "a"), (3, None), (None, "c")], "file_id long, text string")
    index.run(files, provider)
    assert sorted((r.file_id, r.text, r.reused, r.vector) for r in index.chunks().collect()) == [(1, "a", False, [1.0]), (2, "a", False, [1.0])]
    assert written and not any("text" in columns for columns in written)
