"""Exact top-k inner-product search with norm buckets.

Vectors are range-sorted by length and packed into buckets of neighbouring
lengths. A query first meets the bucket of the longest vectors, which gives it
a threshold; then a bucket is skipped, or pruned by length or by coordinates,
as the local cosine threshold of that query and bucket allows. What is left is
verified by whole integer products. Queries go to the bands of lengths that they
can reach, and meet the buckets there in a grid of bounded blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import settle

QUERY_ROWS, BUCKET_ROWS = 512, 4096
#: Query blocks in a cell of the grid, buckets in one, and bands of lengths for each dimension.
CELL_QUERIES, CELL_BUCKETS, BANDS = 64, 8, 64
#: From this local cosine threshold on, coordinates prune better than length alone.
COORDINATE_FROM, FOCUS = 0.6, 8
#: Lengths are rounded: what is pruned falls short by more than this share.
SLACK = 1e-9
_MOST = (1 << 63) - 1
_BLOCK = pa.schema([("dim", pa.int32()), ("rows", pa.int32()), ("longest", pa.float64()), ("ids", pa.binary()), ("uids", pa.binary()), ("values", pa.binary()), ("norms", pa.binary())])
_BLOCK_SQL = "dim int, rows int, longest double, ids binary, uids binary, values binary, norms binary"


def finite(vector: Column) -> Column:
    """True for a vector that is not null and holds finite components only."""
    fits = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(fits, F.lit(False))


def _packed(rows: DataFrame, most: int) -> DataFrame:
    """(dim, rows, longest, ids, uids, values, norms): blocks of at most ``most`` rows of
    one dimension, longest vectors first, cut from range-sorted partitions."""

    def block(dim: int, parts: list[tuple]) -> pa.RecordBatch:
        ids, uids, values, norms = (np.concatenate(x) for x in zip(*parts))
        row = {"dim": dim, "rows": len(ids), "longest": float(norms[0]), "ids": ids.tobytes(), "uids": uids.tobytes(), "values": values.tobytes(), "norms": norms.tobytes()}
        return pa.RecordBatch.from_pylist([row], schema=_BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim, parts, held = None, [], 0
        for batch in batches:
            ids, uids, dims, norms = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 4))
            cuts = np.flatnonzero(np.diff(dims)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)]):
                if a == b:
                    continue
                d = int(dims[a])
                if parts and d != dim:
                    yield block(dim, parts)
                    parts, held = [], 0
                dim = d
                values = batch.column(3).slice(a, b - a).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b - a, d)
                at = a
                while at < b:
                    take = min(most - held, b - at)
                    parts.append((ids[at : at + take].astype(np.int64), uids[at : at + take].astype(np.int64), values[at - a : at - a + take], norms[at : at + take].astype(np.float64)))
                    held, at = held + take, at + take
                    if held == most:
                        yield block(dim, parts)
                        parts, held = [], 0
        if parts:
            yield block(dim, parts)

    order = [F.col("dim"), F.col("norm").desc(), F.col("vec_id"), F.col("uid")]
    ordered = rows.select("vec_id", "uid", "dim", "v", "norm").repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.mapInArrow(run, _BLOCK_SQL)


class Block:
    """A block's rows: ids, the vectors as given, their whole numbers (as doubles), lengths of these."""

    def __init__(self, ids, uids, given, norms, scale: float) -> None:
        self.ids, self.uids, self.given, self.norms, self.scale = ids, uids, given, norms, scale
        with np.errstate(over="ignore"):
            self.whole = np.floor(given * scale)

    @classmethod
    def of(cls, row: dict, prefix: str, scale: float) -> Block:
        ids, uids = (np.frombuffer(row[prefix + c], np.int64) for c in ("ids", "uids"))
        given = np.frombuffer(row[prefix + "values"], np.float64).reshape(len(ids), row["dim"])
        return cls(ids, uids, given, np.frombuffer(row[prefix + "norms"], np.float64), scale)

    def exact(self, rows: np.ndarray) -> np.ndarray:
        """Whole numbers of any size, as Python's integers."""
        out = np.empty((len(rows), self.given.shape[1]), object)
        for i, r in enumerate(rows.tolist()):
            out[i] = [floor(Fraction(x) * Fraction(self.scale)) for x in self.given[r].tolist()]
        return out


def products(q: Block, i: np.ndarray, c: Block, j: np.ndarray) -> np.ndarray:
    """Inner products of rows ``i`` and ``j``: in doubles or longs where the lengths
    keep those exact, else in Python's integers."""
    bound = float(q.norms[i].max(initial=0)) * float(c.norms[j].max(initial=0))
    if bound < float(1 << 53) and np.isfinite(bound):
        return (q.whole[i] @ c.whole[j].T).astype(np.int64)
    if bound < float(1 << 62):
        return q.whole[i].astype(np.int64) @ c.whole[j].astype(np.int64).T
    return q.exact(i) @ c.exact(j).T


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to the smaller id."""
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda p: (-scores[p], ids[p]))[:k], np.int64)
    places = np.arange(len(scores))
    if len(scores) > 4 * k:
        places = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    return places[np.lexsort((ids[places], -scores[places]))][:k]


def search_bucket(q: Block, theta: np.ndarray, c: Block, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: (its place, candidate places, scores) of up to ``k`` best
    candidates of the bucket (longest first) that reach the query's threshold."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        local = theta / (q.norms * c.norms[0])
        local = np.where(np.isnan(local) | np.isneginf(theta), np.where(theta > 0, np.inf, -np.inf), local)
        # Candidates shorter than this cannot reach the threshold, whatever their direction.
        least = np.where(theta > 0, theta / q.norms * (1 - SLACK), -np.inf)
    reach = np.where(np.isnan(least), len(c.ids), np.searchsorted(-c.norms, -least, side="right"))
    by_length = np.flatnonzero((local < COORDINATE_FROM) & (reach > 0))
    for a in range(0, len(by_length), 64):  # neighbours in length reach alike
        some = by_length[a : a + 64]
        whole = products(q, some, c, np.arange(int(reach[some].max())))
        for at, i in enumerate(some.tolist()):
            scores = whole[at, : reach[i]]
            near = np.flatnonzero((scores >= theta[i]) & (c.uids[: reach[i]] != q.uids[i]))
            top = near[best(scores[near], c.ids[near], k)]
            yield i, top, scores[top]
    by_coordinate = np.flatnonzero((local >= COORDINATE_FROM) & (local <= 1 + SLACK) & (reach > 0))
    if not len(by_coordinate):
        return
    unit = c.whole / np.maximum(c.norms, 1e-300)[:, None]
    for i in by_coordinate.tolist():
        direction = q.whole[i] / q.norms[i]
        focus = np.argsort(-np.abs(direction))[:FOCUS]
        part = unit[: reach[i], focus]
        rest = np.sqrt(max(0.0, 1 - float(direction[focus] @ direction[focus]))) * np.sqrt(np.maximum(0.0, 1 - (part * part).sum(axis=1)))
        near = np.flatnonzero(~(part @ direction[focus] + rest < local[i] - SLACK))  # what is no number stays
        near = near[c.uids[near] != q.uids[i]]
        scores = products(q, np.array([i]), c, near)[0] if len(near) else np.empty(0, np.int64)
        ok = np.flatnonzero(scores >= theta[i])
        near, scores = near[ok], scores[ok]
        top = best(scores, c.ids[near], k)
        yield i, near[top], scores[top]


def order_key(score: int) -> str | None:
    """A string that sorts as the integer does, for those that do not fit a long."""
    if -_MOST <= score <= _MOST:
        return None
    digits = str(abs(score))
    if score > 0:
        return f"1{len(digits):05d}{digits}"
    return f"0{99999 - len(digits):05d}{digits.translate(str.maketrans('0123456789', '9876543210'))}"


def top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: float = 256.0, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``queries`` holds for, the
    ``k`` highest integer inner products of floor(scale * x) with all other rows,
    ties to the smaller vec_id.

    Take no part: vectors that are null or hold a null or non-finite component, and
    rows without vec_id. Only vectors of equal dimension meet. Rows that repeat a
    vec_id are queries and candidates each for itself, those of a query's own id
    included. Scores beyond a long rank as they are and are shown as the largest or
    smallest long. Fewer than ``k`` candidates give fewer rows; an empty table gives none.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).where(finite(F.col("v")) & F.col("vec_id").isNotNull())
    scaled = F.transform("v", lambda x: F.when(F.abs(x * scale) < float(1 << 53), F.floor(x * scale).cast("double")).otherwise(x * scale))
    norm = F.sqrt(F.aggregate(scaled, F.lit(0.0), lambda s, x: s + x * x))
    rows = settle(rows.select("vec_id", "asks", F.size("v").alias("dim"), "v", norm.alias("norm")).withColumn("uid", F.monotonically_increasing_id()), "searched-vectors")
    numbered = F.monotonically_increasing_id()
    buckets = settle(_packed(rows, BUCKET_ROWS).withColumn("bucket", numbered), "buckets")
    asked = settle(_packed(rows.where("asks"), QUERY_ROWS).withColumn("block", numbered), "query-blocks")
    blocks = buckets.agg(F.count("*")).first()[0]
    lanes = max(1, -(-asked.count() // CELL_QUERIES))
    lane = F.pmod(F.xxhash64("block"), F.lit(lanes))

    def renamed(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(c).alias("c_" + c if c in _BLOCK.names and c != "dim" else c) for c in df.columns])

    longest = buckets.groupBy("dim").agg(F.min_by("bucket", F.struct(-F.col("longest"), F.col("bucket"))).alias("bucket"))
    first = renamed(buckets.join(settle(longest.select("bucket"), "longest-buckets"), "bucket", "left_semi"))
    first = first.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))))

    def thresholds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q = Block.of(row, "", scale)
                theta = np.full(len(q.ids), -np.inf)
                if row["c_ids"] is not None:
                    for i, _, scores in search_bucket(q, theta.copy(), Block.of(row, "c_", scale), k):
                        if len(scores) == k:
                            theta[i] = np.nextafter(_as_double(scores[-1]), -np.inf)
                with np.errstate(divide="ignore", invalid="ignore"):
                    least = np.where(theta > 0, theta / q.norms, -np.inf)
                kept = {c: row[c] for c in (*_BLOCK.names, "block")}
                least = np.where(np.isnan(least), -np.inf, least)
                yield pa.RecordBatch.from_pylist([kept | {"theta": theta.tobytes(), "least": float(least.min())}], schema=pa.schema([*_BLOCK, ("block", pa.int64()), ("theta", pa.binary()), ("least", pa.float64())]))

    asked = asked.withColumn("lane", lane).join(first, ["dim", "lane"], "left").mapInArrow(thresholds, _BLOCK_SQL + ", block long, theta binary, least double")
    asked = settle(asked, "query-thresholds")
    # Bands of lengths, BANDS for each dimension at most; a band of many buckets is cut into stripes.
    bounds = buckets.groupBy("dim").agg(F.percentile_approx("longest", [i / BANDS for i in range(1, BANDS)], 1000).alias("bounds"))
    band = F.size(F.filter(F.array_distinct("bounds"), lambda x: x > F.col("longest")))
    placed = settle(buckets.select("dim", "bucket", "longest").join(F.broadcast(bounds) if blocks < 1 << 16 else bounds, "dim").select("bucket", "dim", "longest", band.alias("band")), "bucket-bands")
    stripes = settle(placed.groupBy("dim", "band").agg(F.max("longest").alias("band_longest"), F.ceil(F.count("*") / CELL_BUCKETS).alias("stripes")), "length-bands")
    right = buckets.drop("dim", "longest").join(placed.withColumnRenamed("longest", "c_longest"), "bucket").join(stripes, ["dim", "band"]).withColumn("stripe", F.pmod(F.xxhash64("bucket"), F.col("stripes")))
    right = right.select("dim", "band", "stripe", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))).alias("lane"), "c_longest", *[F.col(c).alias("c_" + c) for c in ("rows", "ids", "uids", "values", "norms")])
    goals = asked.select("block", "dim", "least", lane.alias("lane")).join(stripes.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long")))), ["dim", "lane"])
    goals = goals.where(F.col("band_longest") >= F.col("least") * (1 - SLACK)).select("block", "lane", "band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("stripes") - 1)).alias("stripe"))
    met = goals.join(asked, "block").join(right, ["dim", "lane", "band", "stripe"]).where(F.col("c_longest") >= F.col("least") * (1 - SLACK))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q, c = Block.of(row, "", scale), Block.of(row, "c_", scale)
                for i, places, scores in search_bucket(q, np.frombuffer(row["theta"]), c, k):
                    keys = pa.array([order_key(s) for s in scores] if scores.dtype == object else [None] * len(scores), pa.string())
                    shown = np.array([max(-_MOST - 1, min(_MOST, int(s))) for s in scores], np.int64)
                    yield pa.record_batch([pa.array(np.full(len(places), x)) for x in (q.uids[i], q.ids[i])] + [pa.array(c.ids[places]), pa.array(c.uids[places]), pa.array(shown), keys], names=["asker", "query_id", "vec_id", "uid", "score", "excess"])

    scored = met.select(*_BLOCK.names, "theta", *[F.col("c_" + c) for c in ("rows", "longest", "ids", "uids", "values", "norms")]).mapInArrow(verified, "asker long, query_id long, vec_id long, uid long, score long, excess string")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("score"), F.desc("excess"), "vec_id", "uid")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _as_double(score) -> float:
    """The nearest double, infinite for integers beyond all."""
    try:
        return float(score)
    except OverflowError:
        return float("inf") if score > 0 else float("-inf")
