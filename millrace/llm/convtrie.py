"""Prefix trie of conversations in minimal-perfect-hash node tables.

A prefix is known by a digest of 128 bits, the exclusive or of its turns' hashes at
their places, so that long conversations are digested block by block. Equal prefixes
meet as one node. Nodes with many turns below, the top of the tree, are few; what
hangs under them falls into subtrees of bounded size, which are dealt to shards. A
shard gives each of its digests a slot by a minimal perfect hash, checks the digest
kept in the slot, scatters the counts into flat arrays and adds them up through the
array of parent slots, deepest nodes first. The top is one more table, over the sums
of the subtrees.

Rows without a conversation id belong to no conversation. Turns go by turn number,
null first, ties by role and text; equal rows are turns of their own. Null roles and
texts count as empty; texts of any length are hashed whole, in the scan. An empty table
has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import settle

#: Turns to a block of a long conversation.
BLOCK = 512
#: A subtree that one shard holds has at most a ``PARTS``-th of all turns, at least
#: ``LEAST`` and at most ``MOST`` of them; the top then has some ``PARTS`` nodes a level.
PARTS, LEAST, MOST = 4096, 1000, 2_000_000
#: Levels of the top that are summed at least in one go, and nodes up to which more are.
BAND, TOP_NODES = 1024, 2_000_000
#: SHA-256 of nothing.
_EMPTY = hashlib.sha256(b"").hexdigest()


def turn_keys(conversations: DataFrame, texts: bool = False) -> DataFrame:
    """(conv_id, pos, k1, k2, check, bytes): the turns of each conversation in order,
    ``pos`` from 1, with three hashes of role and text and the text's UTF-8 bytes; with
    ``texts`` also role and text.

    Rows are sorted by range, whatever conversation they are of, and numbered by the
    place in their range and the rows of the conversation in the ranges before.
    """
    spark = conversations.sparkSession
    role, text = F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), "turn", role, text, F.monotonically_increasing_id().alias("row"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("row")]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.xxhash64(F.lit(i), "role", "text").alias(name) for i, name in enumerate(("k1", "k2", "check"))]
    ranged = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    shown = ["role", "text"] if texts else []
    ranged = settle(ranged.select("conv_id", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("at"), *keys, F.octet_length("text").cast("long").alias("bytes"), *shown), "turns")
    spans = ranged.groupBy("conv_id", "range").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select("conv_id", "range", (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("shift"))
    return ranged.join(spans, ["conv_id", "range"]).select("conv_id", (F.col("at") + F.col("shift")).alias("pos"), "k1", "k2", "check", "bytes", *shown)


def _digested(keys: DataFrame) -> DataFrame:
    """``keys`` with the digest of the prefix that ends in each turn, and its parent's."""
    mixed = keys.select("conv_id", "pos", "check", "bytes", *[F.xxhash64(F.lit(s), "pos", "k1", "k2").alias(f"x{s}") for s in (1, 2)], F.expr(f"(pos - 1) div {BLOCK}").alias("block"))
    blocks = mixed.groupBy("conv_id", "block").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "block", *[F.bit_xor(f"x{s}").over(earlier).alias(f"b{s}") for s in (1, 2)]).where("block > 0")
    here = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = mixed.select("*", *[F.bit_xor(f"x{s}").over(here).alias(f"r{s}") for s in (1, 2)])
    long = run.where("block > 0").join(blocks, ["conv_id", "block"]).select(*run.columns, "b1", "b2")
    whole = run.where("block = 0").select("*", F.lit(0).cast("long").alias("b1"), F.lit(0).cast("long").alias("b2")).union(long)
    digest = {s: F.col(f"r{s}").bitwiseXOR(F.col(f"b{s}")) for s in (1, 2)}
    return whole.select("conv_id", "pos", "check", "bytes", *[digest[s].alias(f"d{s}") for s in (1, 2)], *[digest[s].bitwiseXOR(F.col(f"x{s}")).alias(f"p{s}") for s in (1, 2)])


class SlotTable:
    """A minimal perfect hash of distinct 128-bit digests: level by level, a digest
    that is alone at its bit takes it, and the bits before it count to its slot. The
    digest kept in a slot is compared at each look-up."""

    def __init__(self, a: np.ndarray, b: np.ndarray) -> None:
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        left, taken = np.arange(len(a)), 0
        while len(left):
            if len(self.levels) > 60:
                raise ValueError("a digest comes twice")
            size = 2 * len(left) + 1
            at = self._place(a[left], b[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, bool)
            bits[at[alone]] = True
            ranks = (np.cumsum(bits) - bits + taken).astype(np.int32)
            self.levels.append((size, bits, ranks))
            taken += int(alone.sum())
            left = left[~alone]
        self.a, self.b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        slots = self._slots(a, b)
        self.a[slots], self.b[slots] = a, b

    @staticmethod
    def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        x = a.view(np.uint64) * np.uint64(2 * level + 0x9E3779B97F4A7C15) + b.view(np.uint64)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        return (x % np.uint64(size)).astype(np.int64)

    def _slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, left = np.full(len(a), -1, np.int64), np.arange(len(a))
        for level, (size, bits, ranks) in enumerate(self.levels):
            at = self._place(a[left], b[left], level, size)
            hit = bits[at]
            out[left[hit]] = ranks[at[hit]]
            left = left[~hit]
        return out

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slots of digests; -1 for those that the table does not hold."""
        slots = self._slots(a, b)
        if len(self.a):
            slots[(self.a[slots] != a) | (self.b[slots] != b)] = -1
        return slots


_NODE = "conv_id long, depth long, d1 long, d2 long, p1 long, p2 long, n_convs long, bytes long, n_children long, n_leaves long, saved_tokens long"
_SUMMED = "conv_id long, depth long, d1 long, d2 long, p1 long, p2 long, top boolean, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def add_up(node: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Sums over the subtrees of a shard's nodes; children, leaves and savings that a
    node comes with are those of subtrees in other shards."""
    table = SlotTable(node["d1"], node["d2"])
    slots = table.find(node["d1"], node["d2"])
    depth, parent, conv, children, leaves, saved = (np.zeros(len(slots), np.int64) for _ in range(6))
    depth[slots], conv[slots], children[slots], leaves[slots] = node["depth"], node["conv_id"], node["n_children"], node["n_leaves"]
    saved[slots] = node["saved_tokens"] + np.maximum(node["n_convs"] - 1, 0) * node["bytes"]
    parent[slots] = np.where(node["depth"] > 0, table.find(node["p1"], node["p2"]), -1)
    inner = np.flatnonzero(parent >= 0)
    if len(inner) and (depth[parent[inner]] + 1 != depth[inner]).any():
        raise ValueError("a digest stands for prefixes of two lengths")
    np.add.at(children, parent[inner], 1)
    leaves[children == 0] = 1
    inner = inner[np.argsort(-depth[inner], kind="stable")]
    for level in np.split(inner, np.flatnonzero(np.diff(depth[inner])) + 1):
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    up = parent[slots]
    return {k: node[k] for k in ("conv_id", "depth", "d1", "d2", "p1", "p2")} | {
        "top": up < 0, "parent_conv_id": conv[up] if len(conv) else up, "n_convs": node["n_convs"],
        "n_children": children[slots], "n_leaves": leaves[slots], "saved_tokens": saved[slots],
    }


def _tables(nodes: DataFrame) -> DataFrame:
    """``add_up`` of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            out = add_up({name: table.column(name).to_numpy().astype(np.int64, copy=False) for name in table.column_names})
            yield from pa.table({k: pa.array(v, mask=out["top"] if k == "parent_conv_id" else None) for k, v in out.items()}).to_batches(65_536)

    return nodes.mapInArrow(run, _SUMMED)


def _ends(last: DataFrame) -> DataFrame:
    """(d1, d2, ends_sha256) over the ids of the conversations that end in a prefix, in
    order. Sorted ranges join their ids to chunks first, so the task that hashes a
    prefix in which very many end reads few rows, one after the other."""
    ranges = int(last.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d1, d2, ids = (c.to_numpy() for c in batch.columns)
            starts = np.flatnonzero(np.concatenate(([True], (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])))) if len(ids) else np.zeros(0, np.int64)
            texts = [",".join(map(str, part.tolist())) for part in np.split(ids, starts[1:])] if len(ids) else []
            yield pa.record_batch([pa.array(d1[starts]), pa.array(d2[starts]), pa.array(ids[starts]), pa.array(texts, pa.string())], names=["d1", "d2", "first", "ids"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []
        for batch in batches:
            for d1, d2, ids in zip(*(batch.column(k).to_pylist() for k in ("d1", "d2", "ids"))):
                if (d1, d2) == now:
                    state.update(b"," + ids.encode())
                    continue
                if now:
                    done.append((*now, state.hexdigest()))
                now, state = (d1, d2), hashlib.sha256(ids.encode())
            if len(done) > 10_000:
                yield pa.record_batch(list(map(pa.array, zip(*done))), names=["d1", "d2", "ends_sha256"])
                done = []
        if now:
            done.append((*now, state.hexdigest()))
            yield pa.record_batch(list(map(pa.array, zip(*done))), names=["d1", "d2", "ends_sha256"])

    ordered = last.select("d1", "d2", "conv_id").repartitionByRange(ranges, "d1", "d2", "conv_id").sortWithinPartitions("d1", "d2", "conv_id")
    parts = ordered.mapInArrow(chunks, "d1 long, d2 long, first long, ids string")
    return parts.repartition(ranges, "d1", "d2").sortWithinPartitions("d1", "d2", "first").mapInArrow(hashes, "d1 long, d2 long, ends_sha256 string")


def trie(keys: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of the conversations ``convs`` (conv_id) with the turns
    ``keys`` (as of ``turn_keys``): conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversations without turns are members of the root alone. ``saved_tokens`` counts
    the bytes of last texts that all members but one need not repeat, over the subtree.
    """
    spark = keys.sparkSession
    rows = settle(_digested(keys), "prefixes")
    lengths = settle(rows.groupBy("conv_id").agg(F.count("*").alias("length")), "lengths")
    rows_of = rows.join(lengths, "conv_id")
    ids = convs.select("conv_id").where("conv_id IS NOT NULL").distinct()
    total, members, first = lengths.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0], *ids.agg(F.count("*"), F.min("conv_id")).first()

    same = [F.min(c) == F.max(c) for c in ("check", "p1", "p2", "pos")]
    met = rows_of.groupBy("d1", "d2").agg(
        F.min("conv_id").alias("conv_id"), F.max("pos").alias("depth"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"),
        F.sum(F.col("length") - F.col("pos")).alias("below"), (same[0] & same[1] & same[2] & same[3]).alias("same"),
    )
    one = F.when(F.col("same"), F.lit(False)).otherwise(F.raise_error(F.lit("two prefixes have one digest"))).alias("odd")
    nodes = settle(met.select("conv_id", "depth", "d1", "d2", "p1", "p2", "n_convs", "bytes", "below", one), "nodes")
    root = spark.createDataFrame([(first, 0, 0, 0, 0, 0, members, 0, total)] if members else [], "conv_id long, depth long, d1 long, d2 long, p1 long, p2 long, n_convs long, bytes long, below long")
    most = min(MOST, max(LEAST, total // PARTS))
    none = [F.lit(0).cast("long").alias(c) for c in ("n_children", "n_leaves", "saved_tokens")]
    top = settle(nodes.where(F.col("below") > most).drop("odd").union(root).select("conv_id", "depth", "d1", "d2", "p1", "p2", "n_convs", "bytes"), "top")

    # each conversation leaves the top in one place, where the subtree begins that its later prefixes belong to
    held = rows.join(top.select("d1", "d2", F.lit(True).alias("above")), ["d1", "d2"], "left").where("above IS NULL")
    starts = held.groupBy("conv_id").agg(F.min(F.struct("pos", "d1", "d2")).alias("start")).select("conv_id", F.col("start.d1").alias("s1"), F.col("start.d2").alias("s2"))
    light = nodes.where(F.col("below") <= most).join(starts, "conv_id")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total // MOST) * 2)
    dealt = light.repartition(shards, "s1", "s2").select("conv_id", "depth", "d1", "d2", "p1", "p2", "n_convs", "bytes", *none)
    summed = settle(_tables(dealt), "subtrees")

    done, carried = [summed], _carried(summed)
    for low, high in _bands(top):
        part = top.where(F.col("depth").between(low, high)).join(carried, ["d1", "d2"], "left")
        part = part.select("conv_id", "depth", "d1", "d2", "p1", "p2", "n_convs", "bytes", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")])
        onward = settle(_tables(part.repartition(1)), "top-sums")
        done.append(onward)
        carried = carried.union(_carried(onward)).groupBy("d1", "d2").agg(*[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")])
    found = done[0]
    for more in done[1:]:
        found = found.union(more)
    parents = top.select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv_id").alias("above"))
    tops = found.where("top AND depth > 0").join(parents, ["p1", "p2"]).select("conv_id", "depth", "d1", "d2", F.col("above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens")
    named = found.where("NOT top OR depth = 0").select(*tops.columns).union(tops)

    turnless = ids.join(lengths, "conv_id", "left_anti").select(F.lit(0).cast("long").alias("d1"), F.lit(0).cast("long").alias("d2"), "conv_id")
    last = rows_of.where("pos = length").select("d1", "d2", "conv_id").union(turnless)
    out = named.join(_ends(last), ["d1", "d2"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))


def _carried(summed: DataFrame) -> DataFrame:
    """What the parents of uppermost nodes get from them."""
    tops = summed.where("top AND depth > 0").groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2"))
    return tops.agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))


def _bands(top: DataFrame) -> list[tuple[int, int]]:
    """Ranges of depth of the top, deepest first, each with some ``TOP_NODES`` nodes or ``BAND`` levels."""
    counts = top.groupBy(F.expr(f"depth div {BAND}").alias("band")).count().orderBy(F.desc("band")).collect()
    out: list[tuple[int, int]] = []
    size = TOP_NODES + 1
    for band, n in counts:
        low, high = band * BAND, band * BAND + BAND - 1
        if size + n > TOP_NODES:
            out.append((low, high))
            size = n
        else:
            out[-1] = (low, out[-1][1])
            size += n
    return out


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of ``conversations`` (conv_id, turn, role, text) as they stand."""
    return trie(turn_keys(conversations), conversations)


def with_texts(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """``nodes`` of ``prefix_trie`` with role and text of their last turn; null at the root."""
    turns = turn_keys(conversations, texts=True).select("conv_id", F.col("pos").alias("depth"), "role", "text")
    return nodes.join(turns, ["conv_id", "depth"], "left")
