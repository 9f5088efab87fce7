"""Mixing sources to target weights along a time-varying curriculum.

A source's weight over training time is a piecewise-linear schedule. Its
integral, scaled to the source's target of words, is its cumulative demand; the
inverse of that demand gives each document the training position at which its
words are due, and documents are range-sorted by position. Running totals are
taken in two steps, over hash buckets of a source and within a bucket, so that
a source with a third of all rows is spread over thousands of groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import settle

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: The mix holds this share of all words; a source gives at most ``REPEATS`` times its own.
SHARE, REPEATS = 1.5, 2
#: Knots (time, weight) of the schedules that go with WEIGHTS: early, even, late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
WORD = r"[^\x20\x09-\x0D]+"


def _segments(knots) -> Column:
    """Array of (u, t, w, slope, area): where each linear piece starts, in share
    of the schedule's area and in time, its weight, slope and the whole area."""
    area = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))
    if not area > 0:
        raise ValueError("a schedule needs a positive area")
    done, out = 0.0, []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        if t1 <= t0 or min(w0, w1) < 0:
            raise ValueError("times rise and weights are not negative")
        out.append(F.struct(F.lit(done / area).alias("u"), F.lit(t0).alias("t"), F.lit(w0).alias("w"), F.lit((w1 - w0) / (t1 - t0)).alias("slope"), F.lit(area).alias("area")))
        done += (t1 - t0) * (w0 + w1) / 2
    return F.array(*out)


def inverse_demand(share: Column, segments: Column) -> Column:
    """The time at which ``share`` (0 to 1) of a schedule's words is due."""
    piece = F.element_at(F.filter(segments, lambda s: s.u <= share), -1)
    due = (share - piece.u) * piece.area
    root = F.sqrt(F.greatest(F.lit(0.0), piece.w * piece.w + 2.0 * piece.slope * due))
    return piece.t + F.when(due > 0, 2.0 * due / (piece.w + root)).otherwise(0.0)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """(source, source_size, turn, target) from (source, source_size): ``share`` of
    all words split by weight, each source stopping at ``repeats`` times its size
    and the excess reshared. There is one row a source, so one task orders them."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    named = sizes.withColumn("turn", (F.row_number().over(order) - 1) % len(weights))
    named = named.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("turn") + 1))
    named = named.withColumn("most", F.col("source_size") * float(repeats))
    filling = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    # Sources stop in the order of most / weight; the level rises up to the last that stops and falls after it.
    level = (F.sum("source_size").over(every) * share - F.coalesce(F.sum("most").over(filling), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(filling), F.lit(0.0)))
    named = named.withColumn("level", level).withColumn("level", F.max("level").over(every))
    return named.select("source", "source_size", "turn", F.least(F.col("level") * F.col("weight"), F.col("most")).alias("target"))


def plan(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, share: float = SHARE, repeats: float = REPEATS, seed: str = "mix", doc_id: str = "doc_id", text: str = "text", source: str = "source", carry: bool = False) -> DataFrame:
    """One row for each row of ``docs``: (doc_id, source, size, source_size, target,
    positions), with the whole row as the struct ``row`` if ``carry``.

    ``positions`` holds a training position in [0, 1] for each time the mix takes
    the document; it is empty for one that it leaves out. A source's documents
    follow each other in an order hashed from ``seed`` and doc_id, again and
    again until their middles pass the target. A null or empty text has no words
    and is never taken; null sources form one source, last in order; rows that
    repeat a doc_id each count; reruns agree. An empty table gives an empty table.
    """
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    columns = [F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), words.alias("size"), key.alias("key"), F.xxhash64(text).alias("tie")]
    if carry:
        columns.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    sized = docs.select(*columns).withColumn("bucket", F.substring("key", 1, 3))
    if not carry:
        sized = settle(sized, "sizes")
    slim = sized.select("source", "bucket", "size")
    buckets = settle(slim.groupBy("source", "bucket").agg(F.sum("size").alias("held")), "buckets")
    aims = targets(buckets.groupBy("source").agg(F.sum("held").alias("source_size")), weights, share, repeats)
    rising = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("offset", F.coalesce(F.sum("held").over(rising), F.lit(0))).drop("held")
    aims = buckets.join(aims.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    aims = aims.select(F.col("source").alias("name"), F.col("bucket").alias("part"), "offset", "source_size", "turn", "target")
    here = sized.join(aims, F.col("source").eqNullSafe(F.col("name")) & (F.col("bucket") == F.col("part"))).drop("name", "part")
    running = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    here = here.withColumn("begin", F.col("offset") + F.coalesce(F.sum("size").over(running), F.lit(0)))
    middles = F.transform(F.sequence(F.lit(0), F.lit(max(0, -int(-repeats // 1) - 1))), lambda k: F.col("begin") + k * F.col("source_size") + F.col("size") / 2.0)
    taken = F.when(F.col("size") > 0, F.filter(middles, lambda m: m <= F.col("target"))).otherwise(F.array().cast("array<double>"))
    pieces = F.element_at(F.array(*[_segments(k) for k in schedules]), F.col("turn") % len(schedules) + 1)
    positions = F.transform(taken, lambda m: inverse_demand(m / F.col("target"), pieces))
    return here.select("doc_id", "source", "size", "source_size", "target", positions.alias("positions"), *(["row"] if carry else []))


def in_order(taken: DataFrame) -> DataFrame:
    """Rows (position, doc_id, copy, ...) range-sorted by training position."""
    return taken.repartitionByRange("position", "doc_id", "copy").sortWithinPartitions("position", "doc_id", "copy")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with the same columns, as often as the mix takes them
    and range-sorted by training position."""
    taken = plan(docs, carry=True, **options).select("row", "doc_id", F.posexplode("positions").alias("copy", "position"))
    return in_order(taken).select([F.col("row").getField(c).alias(c) for c in docs.columns])
