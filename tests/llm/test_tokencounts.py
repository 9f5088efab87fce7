import pytest
from pyspark.sql import functions as F

from millrace.llm import tokencounts
from millrace.llm.storage import scratch_path

UP = "doc_id long, source string, lang string, version string, n_tokens long"


def test_inserts_deletes_revisions_and_repeated_commits(spark):
    counts = tokencounts.TokenCounts(spark, scratch_path(spark, "counts"))
    up = lambda *rows: spark.createDataFrame(rows, UP)
    ids = lambda *i: spark.createDataFrame([(x,) for x in i], "doc_id long")
    show = lambda: sorted(map(tuple, counts.totals().collect()), key=str)
    assert show() == []
    first = up((1, "a", "en", "v1", 10), (2, "a", "en", "v1", 20), (3, "b", "fr", "v1", 5), (1, "a", "en", "v2", 7))
    assert counts.commit("one", first) and not counts.commit("one", first)
    assert show() == [("a", "en", "v1", 2, 30), ("a", "en", "v2", 1, 7), ("b", "fr", "v1", 1, 5)]
    assert counts.commit("two", up((2, "a", "en", "v1", 25), (4, None, None, "v1", None)), ids(3, 99))
    assert show() == [("a", "en", "v1", 2, 35), ("a", "en", "v2", 1, 7), (None, None, "v1", 1, 0)]
    assert counts.commit("three", up((1, "c", "en", "v1", 11)), ids(1))
    assert show() == [("a", "en", "v1", 1, 25), ("c", "en", "v1", 1, 11), (None, None, "v1", 1, 0)]
    assert counts.commit("four", None, None) and show()[0] == ("a", "en", "v1", 1, 25)
    assert sorted(r.doc_id for r in counts.ledger().collect()) == [1, 2, 4]


def test_a_batch_that_failed_half_way_counts_once(spark):
    folder = scratch_path(spark, "counts")
    counts = tokencounts.TokenCounts(spark, folder)
    rows = spark.createDataFrame([(1, "a", "en", "v1", 10)], UP)
    rows.write.parquet(f"{folder}/ledger/000000000-one")  # what a lost driver may leave: no marker
    assert counts.totals().count() == 0
    assert counts.commit("one", rows)
    assert [tuple(r) for r in counts.totals().collect()] == [("a", "en", "v1", 1, 10)]


def test_repeated_and_null_rows(spark):
    counts = tokencounts.TokenCounts(spark, scratch_path(spark, "counts"))
    docs = spark.createDataFrame([(1, "s", "en", "two words", "x"), (1, "s", "en", "two words", "x"), (None, None, None, None, "y"), (2, "s", "en", "", "z")], "doc_id long, source string, lang string, text string, version string")
    counts.commit("load", tokencounts.counted(docs, tokencounts.matches("text", "[^ ]+"), "w"))
    assert sorted(map(tuple, counts.totals().collect()), key=str) == [("s", "en", "w", 3, 4), (None, None, "w", 1, 0)]
    counts.commit("drop", deletes=spark.createDataFrame([(1,), (None,)], "doc_id long"))
    assert [tuple(r) for r in counts.totals().collect()] == [("s", "en", "w", 1, 0)]


def test_random_batches_equal_a_dictionary(spark):
    import random

    rng, state = random.Random(8), {}
    counts = tokencounts.TokenCounts(spark, scratch_path(spark, "counts"))
    for b in range(4):
        gone = {rng.randrange(30) for _ in range(5)}
        new = {(d, f"v{rng.randrange(2)}"): (f"s{d % 3}", "en", rng.randrange(100)) for d in (rng.randrange(30) for _ in range(12))}
        counts.commit(f"b{b}", spark.createDataFrame([(d, s, lang, v, n) for (d, v), (s, lang, n) in new.items()], UP), spark.createDataFrame([(d,) for d in gone], "doc_id long"))
        state = {k: x for k, x in state.items() if k[0] not in gone} | new
        want = {}
        for (_, v), (s, lang, n) in state.items():
            docs, total = want.get((s, lang, v), (0, 0))
            want[s, lang, v] = (docs + 1, total + n)
        assert {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in counts.totals().collect()} == want


def test_compacted_batches_count_once(spark):
    counts = tokencounts.TokenCounts(spark, scratch_path(spark, "counts"))
    up = lambda *rows: spark.createDataFrame(rows, UP)
    assert not counts.compact()
    one = up((1, "a", "en", "v1", 10), (2, "a", "en", "v1", 20))
    counts.commit("one", one)
    counts.commit("two", up((2, "b", "en", "v1", 5)))
    before = sorted(map(tuple, counts.totals().collect()))
    assert counts.compact() and sorted(map(tuple, counts.totals().collect())) == before == [("a", "en", "v1", 1, 10), ("b", "en", "v1", 1, 5)]
    assert counts.batches() == ["one", "two"] and not counts.commit("one", one)
    counts.commit("three", deletes=spark.createDataFrame([(1,)], "doc_id long"))
    assert [tuple(r) for r in counts.totals().collect()] == [("b", "en", "v1", 1, 5)]


def test_of_two_writers_one_fails(spark, monkeypatch):
    folder = scratch_path(spark, "counts")
    a, b = tokencounts.TokenCounts(spark, folder), tokencounts.TokenCounts(spark, folder)
    rows = spark.createDataFrame([(1, "a", "en", "v1", 10)], UP)
    write = b._write
    monkeypatch.setattr(b, "_write", lambda *args: a.commit("first", rows) and write(*args))
    with pytest.raises(Exception, match="(?i)exist"):
        b.commit("second", rows)
    assert a.batches() == ["first"] and [tuple(r) for r in a.totals().collect()] == [("a", "en", "v1", 1, 10)]
    assert tokencounts.TokenCounts(spark, folder).commit("second", rows)


def test_a_batch_that_two_writers_commit_counts_once(spark, monkeypatch):
    folder = scratch_path(spark, "counts")
    a, b, c = (tokencounts.TokenCounts(spark, folder) for _ in range(3))
    rows = lambda n: spark.createDataFrame([(n, "a", "en", "v1", n)], UP)
    a.commit("base", rows(5))
    write = b._write
    # b has read the log and written its rows when a commits the same batch, and c starts in between
    monkeypatch.setattr(b, "_write", lambda *args: a.commit("load", rows(10)) and not c.commit("load", rows(10)) and write(*args))
    with pytest.raises(RuntimeError, match="exists"):
        b.commit("load", rows(10))
    assert a.batches() == ["base", "load"] and [tuple(r) for r in a.totals().collect()] == [("a", "en", "v1", 2, 15)]
    assert not tokencounts.TokenCounts(spark, folder).commit("load", rows(10))


def test_empty_tables_and_very_long_texts(spark):
    counts = tokencounts.TokenCounts(spark, scratch_path(spark, "counts"))
    docs = spark.createDataFrame([], "doc_id long, source string, lang string, text string")
    assert counts.commit("none", tokencounts.counted(docs, tokencounts.matches("text", "[^ ]+"), "w"), docs.select("doc_id"))
    assert counts.totals().count() == 0
    long = spark.createDataFrame([(1, "s", "en", "word " * 400_000)], docs.schema)
    counts.commit("long", tokencounts.counted(long, tokencounts.matches("text", "[^ ]+"), "w"))
    assert [tuple(r) for r in counts.totals().collect()] == [("s", "en", "w", 1, 400_000)]
