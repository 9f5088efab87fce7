"""Embedding near-dedup over a robust-pruned flat graph.

Equal vectors are first made one. Centroids, fitted level by level on bounded
samples, deal each vector to the shards of its nearest few, so shards overlap and
stay bounded. A shard's graph keeps each vector's few nearest and, of further ones,
those that no kept neighbour stands clearly closer to; the adjacency lists of all
shards are united. In each shard, searches start from the medoid of every connected
part of the graph and of its edges in range, go on greedily, then spread through
whatever lies in range. A search that reaches a vector of other shards goes on in
those: they take in the vector that asks, and the united lists are searched again.
Finds are verified in double precision and counted in the first shard that both
ends share, so that no list of pairs is made. Recall is audited against a scan of
all vectors; where it stays too low, all blocks are compared whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .storage import settle
from .topk import finite

THRESHOLD = 0.9
SHARD_ROWS, OVERLAP = 2048, 3
#: A cell is cut once it would fill more blocks of SHARD_ROWS than this.
BLOCKS = 4
#: Sample rows that the centroids of a cell are fitted on (about), cells that one is cut into at most, levels.
FIT_ROWS, BRANCH, LEVELS = 16_384, 256, 4
AUDIT_ROWS, AUDIT_RECALL = 256, 0.97
#: Vectors with links that the audit measures, and vectors that it draws at most to find them.
AUDIT_LINKED, AUDIT_MOST = 64, 4096
NEAREST_KEPT, DEGREE, CANDIDATES, ALPHA, BEAM = 8, 20, 48, 1.2, 16
#: Of a vector's united and reverse edges, the nearest this many are walked in a block.
WALKED = 64


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length one, of vectors of any finite length but zero."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def centroids(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means from evenly spaced rows."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), c)
    return c


def build(x: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES, nearest: int = NEAREST_KEPT, alpha: float = ALPHA) -> list[np.ndarray]:
    """Robust-pruned adjacency of the rows of ``x`` (unit, single precision), with reverse edges."""
    n = len(x)
    if n < 2:
        return [np.empty(0, np.int64)] * n
    m = min(candidates, n - 1)
    forward = np.full((n, degree), -1, np.int64)
    for a in range(0, n, 512):
        rows = np.arange(a, min(n, a + 512))
        sims = x[rows] @ x.T
        sims[np.arange(len(rows)), rows] = -np.inf
        cand = np.argpartition(-sims, m - 1, axis=1)[:, :m]
        own = np.take_along_axis(sims, cand, axis=1)
        order = np.argsort(-own, axis=1, kind="stable")
        cand, own = np.take_along_axis(cand, order, axis=1), np.take_along_axis(own, order, axis=1)
        vectors, alive, far = x[cand], np.ones(cand.shape, bool), 2 - 2 * own
        for r in range(degree):
            pick = alive.argmax(axis=1)
            some = alive[np.arange(len(rows)), pick]
            if not some.any():
                break
            chosen = cand[np.arange(len(rows)), pick]
            forward[rows[some], r] = chosen[some]
            if r + 1 < nearest:
                alive[np.arange(len(rows)), pick] = False
                continue
            if r + 1 == nearest:  # those kept for nearness prune the rest too
                for earlier in range(r):
                    kept = forward[rows, earlier]
                    apart = 2 - 2 * np.einsum("ncd,nd->nc", vectors, x[kept])
                    alive &= (alpha * alpha * apart > far) | (kept < 0)[:, None]
            apart = 2 - 2 * np.einsum("ncd,nd->nc", vectors, x[chosen])
            alive &= (alpha * alpha * apart > far) | ~some[:, None]
            alive[np.arange(len(rows)), pick] = False
    src, at = np.nonzero(forward >= 0)
    dst = forward[src, at]
    both = np.unique(np.concatenate((src * n + dst, dst * n + src)))
    src, dst = both // n, both % n
    return np.split(dst, np.searchsorted(src, np.arange(1, n)))


def _medoids(x: np.ndarray, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, sizes): the medoid of each connected part of the rows of ``x``."""
    label = np.arange(len(x))
    while True:
        new = label.copy()
        np.minimum.at(new, src, label[dst])
        np.minimum.at(new, dst, label[src])
        new = new[new]
        if (new == label).all():
            break
        label = new
    _, part, sizes = np.unique(label, return_inverse=True, return_counts=True)
    middle = np.zeros((len(sizes), x.shape[1]))
    np.add.at(middle, part, x)
    order = np.lexsort((-np.einsum("ij,ij->i", x, middle[part]), part))
    return order[np.cumsum(sizes) - sizes], sizes


def entries(x: np.ndarray, neighbours: np.ndarray, least: float) -> np.ndarray:
    """Where searches of a graph (rows of places, -1 for none) start: the medoid of
    each connected part of it, and of each part of two rows or more that edges
    within ``least`` cosine connect, as growth does not cross rows out of range."""
    src, at = np.nonzero(neighbours >= 0)
    dst = neighbours[src, at]
    within = np.einsum("ij,ij->i", x[src], x[dst]) >= least
    close, sizes = _medoids(x, src[within], dst[within])
    return np.unique(np.concatenate((_medoids(x, src, dst)[0], close[sizes > 1])))


def search(x: np.ndarray, neighbours: np.ndarray, starts: np.ndarray, q: np.ndarray, least: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) places of rows found within ``least`` cosine: a greedy beam from
    the nearest of ``starts`` for all queries at once, then growth through rows in
    range. Every start in range is a find, however many there are."""
    n, b = len(x), len(q)
    seen = np.zeros((b, n), bool)
    ids = np.full((b, beam), -1, np.int64)
    sims = np.full((b, beam), -np.inf, np.float32)
    done = np.ones((b, beam), bool)
    first = q @ x[starts].T
    best = np.argpartition(-first, beam - 1, axis=1)[:, :beam] if len(starts) > beam else np.arange(len(starts))[None].repeat(b, 0)
    width = best.shape[1]
    ids[:, :width], sims[:, :width], done[:, :width] = starts[best], np.take_along_axis(first, best, axis=1), False
    seen[:, starts] = True
    who, at = np.nonzero(first >= least)
    hits = [np.stack((who, starts[at]))]
    active = np.arange(b)
    while len(active):
        open_ = np.where(done[active], -np.inf, sims[active])
        pick = open_.argmax(axis=1)
        going = open_[np.arange(len(active)), pick] > -np.inf
        active, pick = active[going], pick[going]
        if not len(active):
            break
        done[active, pick] = True
        near = neighbours[ids[active, pick]]
        fresh = (near >= 0) & ~seen[active[:, None], np.maximum(near, 0)]
        who, at = np.nonzero(fresh)
        rows = near[who, at]
        asks = active[who]
        seen[asks, rows] = True
        got = np.full(near.shape, -np.inf, np.float32)
        got[who, at] = np.einsum("ij,ij->i", x[rows], q[asks])
        within = got[who, at] >= least
        hits.append(np.stack((asks[within], rows[within])))
        all_ids = np.concatenate((ids[active], near), axis=1)
        all_sims = np.concatenate((sims[active], got), axis=1)
        all_done = np.concatenate((done[active], ~fresh), axis=1)
        top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids[active] = np.take_along_axis(all_ids, top, axis=1)
        sims[active] = np.take_along_axis(all_sims, top, axis=1)
        done[active] = np.take_along_axis(all_done, top, axis=1)
    front = np.concatenate(hits, axis=1)
    found = [front]
    while front.shape[1]:
        grown = []
        for a in range(0, front.shape[1], 1 << 14):
            asks, rows = front[:, a : a + (1 << 14)]
            near = neighbours[rows]
            who, at = np.nonzero((near >= 0) & ~seen[asks[:, None], np.maximum(near, 0)])
            keys = np.unique(asks[who] * n + near[who, at])
            asks, rows = keys // n, keys % n
            seen[asks, rows] = True
            within = np.einsum("ij,ij->i", x[rows], q[asks]) >= least
            grown.append(np.stack((asks[within], rows[within])))
        front = np.concatenate(grown, axis=1)
        found.append(front)
    found = np.concatenate(found, axis=1)
    return found[0], found[1]


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the least one that it is connected to."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _cut(members: DataFrame, level: int, threshold: float, shard_rows: int, overlap: int, fit_rows: int) -> DataFrame | None:
    """``members`` (cell, cls, v) with each cell of over BLOCKS * ``shard_rows`` (all of
    ``shard_rows`` at first) dealt to overlapping ones of about ``shard_rows`` by centroids
    of a sample; None if there is none to deal. A cell in which nearly all link with each
    other stays whole: links have to be counted there."""
    overlap = overlap if level == 0 else 2
    large = settle(members.groupBy("cell").agg(F.count("*").alias("size")).where(F.col("size") > shard_rows * (BLOCKS if level else 1)), "large-cells")
    if not large.take(1):
        return None
    span = 1 << 30
    drawn = members.join(large, "cell").where(F.pmod(F.xxhash64("cls", F.lit(level)), F.lit(span)) < F.lit(float(fit_rows)) / F.col("size") * span)

    def fit(table: pa.Table) -> pa.Table:
        x = unit_rows(matrix(table.column("v").take(pa.array(np.argsort(table.column("cls").to_numpy())))))
        cell, size = table.column("cell")[0].as_py(), table.column("size")[0].as_py()
        mean = x.mean(axis=0)
        dense = np.quantile(x @ (mean / max(np.linalg.norm(mean), 1e-300)), 0.1) >= np.sqrt((1 + threshold) / 2)
        c = centroids(x, int(min(BRANCH, len(x), -(-overlap * size // shard_rows))))
        rows = [] if dense or len(c) < 2 else [{"cell": cell, "parts": -(-size // fit_rows), "k": len(c), "middle": c.tobytes()}]
        return pa.Table.from_pylist(rows, schema=pa.schema([("cell", pa.int64()), ("parts", pa.int64()), ("k", pa.int32()), ("middle", pa.binary())]))

    centres = settle(drawn.groupBy("cell").applyInArrow(fit, "cell long, parts long, k int, middle binary"), "centroids")
    dealt = members.join(centres.select("cell", "parts"), "cell").withColumn("part", F.pmod(F.xxhash64("cls", F.lit(-1)), F.col("parts"))).drop("parts")
    spread = centres.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))

    def assign(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = pa.schema([("cell", pa.int64()), ("cls", pa.int64()), ("v", pa.list_(pa.float64()))])
        if not left.num_rows:
            return kinds.empty_table()
        c = np.frombuffer(right.column("middle")[0].as_py(), np.float64).reshape(right.column("k")[0].as_py(), -1)
        o = min(overlap, len(c))
        near = np.argpartition(-(unit_rows(matrix(left.column("v"))) @ c.T), o - 1, axis=1)[:, :o].ravel()
        rows = pa.array(np.repeat(np.arange(left.num_rows), o))
        cell = left.column("cell")[0].as_py() * (BRANCH + 1) + 1 + near.astype(np.int64)
        return pa.table([pa.array(cell), left.column("cls").take(rows), left.column("v").take(rows)], schema=kinds)

    new = dealt.groupBy("cell", "part").cogroup(spread.groupBy("cell", "part")).applyInArrow(assign, "cell long, cls long, v array<double>")
    return settle(members.join(centres, "cell", "left_anti").union(new), "shard-members")


def _parts(members: DataFrame, shard_rows: int) -> DataFrame:
    """``members`` with ``parts``, the blocks that their cell is cut into, and ``part``."""
    sizes = settle(members.groupBy("cell").agg(F.ceil(F.count("*") / shard_rows).alias("parts")), "cell-sizes")
    return members.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")))


def _blocks(members: DataFrame, nodes: DataFrame, shard_rows: int, threshold: float, exact: bool) -> DataFrame:
    """One row a block of a cell: ids, vectors, the united adjacency between them, where
    searches start, how many copies each has, and all cells of each."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table.column("cls").to_numpy())))
        ids, x = table.column("cls").to_numpy(), matrix(table.column("v"))
        near = table.column("near").combine_chunks()
        owner = np.repeat(np.arange(len(ids)), np.diff(near.offsets.to_numpy()))
        target = near.flatten().to_numpy(zero_copy_only=False)
        place = np.searchsorted(ids, target)
        here = ids[np.minimum(place, len(ids) - 1)] == target
        owner, place = owner[here], place[here]
        unit = unit_rows(x)
        order = np.lexsort((-np.einsum("ij,ij->i", unit[owner], unit[place]), owner))
        owner, place = owner[order], place[order]
        nearest = np.arange(len(owner)) - np.searchsorted(owner, owner) < WALKED
        owner, place = owner[nearest], place[nearest]
        counts = np.bincount(owner, minlength=len(ids))
        grid = np.full((len(ids), max(1, int(counts.max(initial=0)))), -1, np.int32)
        grid[owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)] = place
        starts = np.empty(0, np.int64) if exact else entries(unit, grid, threshold)
        cells = table.column("cells").combine_chunks()
        row = {c: table.column(c)[0].as_py() for c in ("cell", "part", "parts")}
        row |= {"n": len(ids), "width": grid.shape[1], "ids": ids.tobytes(), "x": x.tobytes(), "grid": grid.tobytes(), "starts": starts.tobytes(), "copies": table.column("copies").to_numpy().tobytes()}
        row |= {"cells": cells.flatten().to_numpy().tobytes(), "ends": cells.offsets.to_numpy().astype(np.int64).tobytes()}
        return pa.Table.from_pylist([row], schema=pa.schema([("cell", pa.int64()), ("part", pa.int64()), ("parts", pa.int64()), ("n", pa.int32()), ("width", pa.int32()), *((c, pa.binary()) for c in binary)]))

    binary = ("ids", "x", "grid", "starts", "copies", "cells", "ends")
    rows = _parts(members.select("cell", "cls"), shard_rows).join(nodes, "cls").select("cell", "part", "parts", "cls", "v", "near", "copies", "cells")
    return settle(rows.groupBy("cell", "part").applyInArrow(pack, "cell long, part long, parts long, n int, width int, " + ", ".join(f"{c} binary" for c in binary)), "shard-blocks")


class _Shard:
    """A block of ``_blocks``, opened."""

    def __init__(self, row: dict, prefix: str = "") -> None:
        n, get = row[prefix + "n"], lambda c, kind: np.frombuffer(row[prefix + c], kind)
        self.ids, self.copies, self.starts = get("ids", np.int64), get("copies", np.int64), get("starts", np.int64)
        self.unit = unit_rows(get("x", np.float64).reshape(n, -1))
        self.small = self.unit.astype(np.float32)
        self.grid = get("grid", np.int32).reshape(n, row[prefix + "width"])
        self.cells, ends = get("cells", np.int64), get("ends", np.int64)
        self.owner = np.repeat(np.arange(n), np.diff(ends))

    def held(self, cells: np.ndarray) -> np.ndarray:
        """Whether each row is also of each of ``cells`` (sorted)."""
        out = np.zeros((len(self.ids), len(cells)), np.float32)
        at = np.searchsorted(cells, self.cells)
        ok = (at < len(cells)) & (cells[np.minimum(at, len(cells) - 1)] == self.cells) if len(cells) else np.zeros(len(at), bool)
        out[self.owner[ok], at[ok]] = 1
        return out


def _looked(q: _Shard, x: _Shard, threshold: float, beam: int, exact: bool) -> np.ndarray:
    """Which rows of two blocks link: finds of either side, verified in double precision."""
    found = np.zeros((len(q.ids), len(x.ids)), bool)
    for asks, held, out in ((q, x, found), (x, q, found.T)):
        for a in range(0, len(asks.ids), 1024):
            if exact:
                who, at = np.nonzero(asks.small[a : a + 1024] @ held.small.T >= threshold - 1e-5)
            else:
                who, at = search(held.small, held.grid, held.starts, asks.small[a : a + 1024], threshold - 1e-5, beam)
            for s in range(0, len(who), 1 << 16):
                i, j = who[s : s + (1 << 16)] + a, at[s : s + (1 << 16)]
                ok = (np.einsum("ij,ij->i", asks.unit[i], held.unit[j]) >= threshold) & (asks.ids[i] != held.ids[j])
                out[i[ok], j[ok]] = True
    return found


def _meetings(blocks: DataFrame) -> DataFrame:
    """Every two blocks of a cell, each with itself too, dealt out by the one that is asked."""
    columns = [c for c in blocks.columns if c not in ("cell", "part", "parts")]
    asks = blocks.select("cell", *[F.col(c).alias("q_" + c) for c in columns], (F.col("part")).alias("q_part"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("part"))
    return asks.join(blocks.drop("parts"), ["cell", "part"])


def find_links(classes: DataFrame, threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS, overlap: int = OVERLAP, beam: int = BEAM, fit_rows: int = FIT_ROWS, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(cls, links) with the number of other rows of ``classes`` (cls, v, copies) that each links
    with, copies counted, and edges (a, b) that connect all that links connect. ``exact`` makes
    one cell of all vectors of a dimension and compares its blocks whole."""
    members = settle(classes.select(F.size("v").cast("long").alias("cell"), "cls", "v"), "shard-members")
    for level in range(0 if exact else LEVELS):
        cut = _cut(members, level, threshold, shard_rows, overlap, fit_rows)
        if cut is None:
            break
        members = cut

    def graph(table: pa.Table) -> pa.Table:
        ids = table.column("cls").to_numpy()
        lists = [np.empty(0, np.int64)] * len(ids) if exact else build(unit_rows(matrix(table.column("v"))).astype(np.float32))
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
        values = pa.array(ids[np.concatenate(lists)] if lists else np.empty(0, np.int64))
        return pa.table({"cls": ids, "near": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)})

    lists = _parts(members, shard_rows).select("cell", "part", "cls", "v").groupBy("cell", "part").applyInArrow(graph, "cls long, near array<long>")
    united = settle(lists.groupBy("cls").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "adjacency")

    def nodes(members: DataFrame) -> DataFrame:
        cells = members.groupBy("cls").agg(F.sort_array(F.collect_set("cell")).alias("cells"))
        return settle(classes.join(united, "cls").join(cells, "cls").select("cls", "v", "near", "copies", "cells"), "graph-nodes")

    def onward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q, x = _Shard(row, "q_"), _Shard(row)
                found = _looked(q, x, threshold, beam, exact).astype(np.float32)
                cells = np.unique(np.concatenate((q.cells, x.cells)))
                mine, theirs = q.held(cells), x.held(cells)
                for one, there, other in ((q, mine, found @ theirs), (x, theirs, found.T @ mine)):
                    i, c = np.nonzero((other > 0) & (there == 0))
                    yield pa.record_batch([pa.array(cells[c]), pa.array(one.ids[i])], names=["cell", "cls"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q, x = _Shard(row, "q_"), _Shard(row)
                found = _looked(q, x, threshold, beam, exact)
                i, j = np.nonzero(found)
                label = roots(len(q.ids) + len(x.ids), i, len(q.ids) + j)
                ids = np.concatenate((q.ids, x.ids))
                before = np.unique(np.concatenate((q.cells, x.cells)))
                before = before[before < row["cell"]]  # links of an earlier cell that both are in count there
                found &= q.held(before) @ x.held(before).T == 0
                links = np.concatenate((found @ x.copies, (found.T @ q.copies) * (row["q_part"] != row["part"])))
                some = (links > 0) | (label != np.arange(len(label)))
                yield pa.record_batch([pa.array(y[some]) for y in (ids, links.astype(np.int64), ids[label])], names=["cls", "links", "root"])

    table = nodes(members)
    if not exact:
        further = settle(_meetings(_blocks(members, table, shard_rows, threshold, exact)).mapInArrow(onward, "cell long, cls long").distinct(), "further-shards")
        if further.take(1):
            members = settle(members.select("cell", "cls").union(further), "shard-members")
            table = nodes(members)
    counted = settle(_meetings(_blocks(members, table, shard_rows, threshold, exact)).mapInArrow(count, "cls long, links long, root long"), "link-counts")
    links = settle(counted.groupBy("cls").agg(F.sum("links").alias("links")), "vector-links")
    return links, counted.where("cls <> root").select(F.col("cls").alias("a"), F.col("root").alias("b")).distinct()


def audit(classes: DataFrame, links: DataFrame, threshold: float = THRESHOLD, rows: int = AUDIT_ROWS, linked: int = AUDIT_LINKED, most: int = AUDIT_MOST) -> float | None:
    """Mean share of their links found, of vectors chosen by id hash, by a scan of all
    vectors. Vectors without links tell nothing: ``rows`` are drawn first, then more, until
    ``linked`` with links were measured or ``most`` drawn. None if none was measured."""
    shares: list[float] = []
    drawn = 0
    while len(shares) < linked and drawn < most:
        upto = min(most, max(rows, 4 * drawn))
        chosen = classes.orderBy(F.xxhash64("cls", F.lit(1)), "cls").limit(upto).select("cls", "v").collect()[drawn:]
        if not chosen:
            break
        shares += _shares(classes, links, threshold, chosen)
        drawn = upto
    return sum(shares) / len(shares) if shares else None


def _shares(classes: DataFrame, links: DataFrame, threshold: float, chosen: list) -> list[float]:
    """Of each chosen vector with links, the share of them that was found."""
    shared = classes.sparkSession.sparkContext.broadcast([(r.cls, unit_rows(np.array([r.v]))[0]) for r in chosen])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
        for c, v in shared.value:
            by_size.setdefault(len(v), []).append((c, v))
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            for size, asks in by_size.items():
                part = batch.take(pa.array(np.flatnonzero(sizes == size)))
                if not part.num_rows:
                    continue
                ids, q = np.array([c for c, _ in asks]), np.array([v for _, v in asks])
                near = (q @ unit_rows(matrix(part.column(1))).T >= threshold) & (ids[:, None] != part.column(0).to_numpy())
                there = near @ part.column(2).to_numpy()
                yield pa.record_batch([pa.array(ids[there > 0]), pa.array(there[there > 0])], names=["cls", "there"])

    there = classes.select("cls", "v", "copies").mapInArrow(scan, "cls long, there long").groupBy("cls").agg(F.sum("there").alias("there"))
    shares = there.join(links, "cls", "left").select(F.least(F.coalesce("links", F.lit(0)) / F.col("there"), F.lit(1.0)).alias("share"))
    return [r.share for r in shares.collect()]  # one for each chosen vector at most


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", vector: str = "embedding", least_recall: float = AUDIT_RECALL, **options) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audit_recall), one row for each row.

    ``n_links`` counts other rows whose cosine is at least ``threshold``, equal
    vectors included; ``component_id`` is the smallest vec_id reachable. With no
    link are: vectors that are null, zero or hold a null or non-finite component,
    rows without vec_id (component_id null), and vectors of different dimensions
    with each other. If the audit finds less than ``least_recall`` of a vector's
    links in the mean, the shards overlap more and the beam is wider in a second
    and third build, and if that is not enough, all blocks are compared whole. The
    audit is null where it met no vector with links. An empty table gives no row.
    """
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    usable = finite(F.col("v")) & F.col("vec_id").isNotNull() & F.exists("v", lambda x: x != 0)
    classes = rows.where(usable).groupBy("v").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    classes = settle(classes.withColumn("cls", F.monotonically_increasing_id()), "vector-classes")
    overlap, beam = options.pop("overlap", OVERLAP), options.pop("beam", BEAM)
    for _ in range(3):
        links, edges = find_links(classes, threshold, overlap=overlap, beam=beam, **options)
        recall = audit(classes, links, threshold)
        if recall is None or recall >= least_recall:
            break
        overlap, beam = 2 * overlap, 2 * beam
    else:
        links, edges = find_links(classes, threshold, exact=True, **options)
        recall = audit(classes, links, threshold)
    linked = components(edges).withColumnRenamed("node", "cls").join(classes.select("cls", "first"), "cls")
    least = settle(linked.groupBy("component").agg(F.min("first").alias("least")), "component-ids")
    named = classes.join(links, "cls", "left").join(linked.join(least, "component").select("cls", "least"), "cls", "left")
    named = settle(named.select(F.col("v").alias("same"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "first").alias("least")), "named-vectors")
    out = rows.withColumn("key", F.when(usable, F.col("v"))).join(named, F.col("key") == F.col("same"), "left")
    component = F.coalesce("least", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"), F.lit(recall).cast("double").alias("audit_recall"))
