import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing

DOC = "doc_id long, text string, source string, target string, size int"


def words(n):
    return " ".join(["w"] * n)


def test_targets_share_by_weight_and_stop_at_twice_the_size(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 1000), ("d", 10), (None, 500)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    total = 1.5 * 2610
    assert got["a"] == 200 and got["d"] == 20
    assert sum(got.values()) == pytest.approx(total)
    assert got["b"] == pytest.approx(2 * got["c"]) and got[None] == pytest.approx(min(1000, got["b"]))


def test_taken_words_come_near_the_target_and_reruns_agree(spark):
    rows = [(i, words(3 + i * 7 % 40), f"s{i % 4}" if i % 9 else None) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.plan(docs)
    by_source = plan.groupBy("source").agg(F.sum(F.col("size") * F.size("positions")).alias("taken"), F.first("target").alias("target"), F.max(F.size("positions")).alias("most")).collect()
    assert len(by_source) == 5
    for r in by_source:
        assert abs(r.taken - r.target) <= 45 and r.most <= 2
    again = mixing.plan(docs.repartition(7))
    key = lambda df: sorted((r.doc_id, tuple(r.positions)) for r in df.collect())
    assert key(plan) == key(again)


def test_positions_follow_the_schedule(spark):
    df = spark.range(1001).select((F.col("id") / 1000.0).alias("u"))
    for knots in (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.0), (0.5, 2.0), (1.0, 0.0)), ((0.0, 1.0), (1.0, 1.0))):
        got = [r.t for r in df.select(mixing.inverse_demand(F.col("u"), mixing._segments(knots)).alias("t")).collect()]
        assert all(a <= b + 1e-12 for a, b in zip(got, got[1:])) and got[0] == 0 and got[-1] == pytest.approx(1)
        area = sum((t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(knots, knots[1:]))

        def due(t):
            done = 0.0
            for (t0, a), (t1, b) in zip(knots, knots[1:]):
                x = min(max(t - t0, 0), t1 - t0)
                done += a * x + (b - a) / (t1 - t0) * x * x / 2
            return done / area

        assert all(due(t) == pytest.approx(u / 1000, abs=1e-6) for u, t in enumerate(got))
    with pytest.raises(ValueError):
        mixing._segments(((0.0, 0.0), (1.0, 0.0)))


def test_mix_keeps_columns_repeats_and_order(spark):
    rows = [(i, words(5), "a" if i % 3 else "b", "t", i) for i in range(90)] + [(200, None, "a", "t", 1), (201, "", None, None, None), (None, words(5), None, "t", 1), (5, words(5), "a", "t", 5)]
    docs = spark.createDataFrame(rows, DOC)
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    got = out.collect()
    taken = {(r.doc_id, r.text): len(p) for r, p in ((x.row, x.positions) for x in mixing.plan(docs, carry=True).collect())}
    assert len(got) == sum(len(x.positions) for x in mixing.plan(docs, carry=True).collect())
    assert taken[(200, None)] == 0 and taken[(201, "")] == 0


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOC)
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0
    assert mixing.plan(spark.createDataFrame([(1, "", None, None, None)], DOC)).first().positions == []


def test_query_takes_its_rows_from_the_sorted_mix(spark, sf, monkeypatch):
    from millrace.llm import queries

    seen = []
    sort = mixing.in_order
    monkeypatch.setattr(mixing, "in_order", lambda taken: seen.append(sort(taken)) or seen[-1])
    got = queries.op9_mix_sources(spark, sf).collect()
    uses = seen[0].withColumn("part", F.spark_partition_id()).collect()
    assert [(r.part, r.position) for r in uses] == sorted((r.part, r.position) for r in uses)
    assert [r.position for r in uses] == sorted(r.position for r in uses)
    assert sum(r.taken for r in got) == sum(r.size for r in uses)
