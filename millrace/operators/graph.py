"""Analytics over directed graphs given as edge tables (source, target)."""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from itertools import accumulate, groupby, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.paths import prefixes
from ..sources.scratch import discard, settle


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, in_degree, out_degree, degree) over distinct edges without loops; with
    ``nodes`` (node) also those without an edge."""
    plain = edges.where("source <> target").select("source", "target").distinct()
    ends = plain.select(F.col("target").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(plain.select("source", F.lit(0), F.lit(1)))
    if nodes is not None:
        ends = ends.union(nodes.select("node", F.lit(0), F.lit(0)))
    sums = ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return sums.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def neighbours(edges: DataFrame) -> DataFrame:
    """(node, direction, other): what each node uses and what uses it."""
    uses = edges.select(F.col("source").alias("node"), F.lit("uses").alias("direction"), F.col("target").alias("other"))
    return uses.union(edges.select("target", F.lit("used_by"), "source")).distinct()


def restricted(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (node)."""
    return edges.join(nodes.select(F.col("node").alias("source")), "source", "left_semi").join(nodes.select(F.col("node").alias("target")), "target", "left_semi")


def _spread(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """(node, colour): the least node that reaches each along the edges. Who reaches the
    least node known to reach a node reaches it too, so a round doubles the distance."""
    colour = settle(nodes.select("node", F.col("node").alias("colour")), name)
    while True:
        came = edges.join(colour, edges.source == colour.node).groupBy(F.col("target").alias("node")).agg(F.min("colour").alias("came"))
        step = colour.join(came, "node", "left").select("node", F.col("colour").alias("old"), F.least("colour", "came").alias("step"))
        onward = colour.select(F.col("node").alias("step"), F.col("colour").alias("jump"))
        new = settle(step.join(onward, "step").select("node", F.least("step", "jump").alias("colour"), (F.least("step", "jump") < F.col("old")).alias("moved")), name)
        discard(colour)
        colour = new
        if not new.where("moved").take(1):
            return new


def tangles(edges: DataFrame) -> DataFrame:
    """(node, tangle): strongly connected components of more than one node, each named
    by its least node.

    Nodes with no way in or no way out are trimmed; then every node takes the least
    node that reaches it, and what reaches that node back within its colour is its
    component. Components leave and the rest goes on. Rounds are written to the
    shared folder, each in place of the one before; the driver asks for sizes only.
    """
    spark = edges.sparkSession
    left = settle(edges.where("source <> target").select("source", "target").distinct(), "graph")
    size, found = left.count(), []
    while size:
        trimmed = left
        for _ in range(2):  # more than once before a write
            out, into = trimmed.select(F.col("source").alias("n")).distinct(), trimmed.select(F.col("target").alias("n")).distinct()
            trimmed = restricted(trimmed, out.join(into, "n").withColumnRenamed("n", "node"))
        trimmed = settle(trimmed, "graph")
        discard(left)
        left, before, size = trimmed, size, trimmed.count()
        if size < before or not size:
            continue
        nodes = left.select(F.col("source").alias("node")).union(left.select("target")).distinct()
        colour = _spread(nodes, left, "colours")
        a, b = colour.select(F.col("node").alias("source"), F.col("colour").alias("ca")), colour.select(F.col("node").alias("target"), F.col("colour").alias("cb"))
        inner = settle(left.join(a, "source").join(b, "target").where("ca = cb").select(F.col("target").alias("source"), F.col("source").alias("target")), "inner")
        # A colour's least node is its root: who has it backwards too reaches it and is reached.
        back = _spread(nodes, inner, "marks").select("node", F.col("colour").alias("back"))
        component = settle(colour.join(back, "node").where("colour = back").select("node", F.col("colour").alias("tangle")), "components")
        found.append(component)
        rest = settle(left.join(component.select(F.col("node").alias("source")), "source", "left_anti").join(component.select(F.col("node").alias("target")), "target", "left_anti").select("source", "target"), "graph")
        for table in (left, inner, colour):
            discard(table)
        left, size = rest, rest.count()
    if not found:
        return spark.createDataFrame([], edges.select(F.col("source").alias("node"), F.col("source").alias("tangle")).schema)
    every = reduce(DataFrame.union, found)
    large = every.groupBy("tangle").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return every.join(large, "tangle").select("node", "tangle")


def on_cycles(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of ``nodes`` (node), a bounded few, that a walk along the edges leads back to.
    Each round goes one edge further from all that have not come back. What it joins is
    merged, as tables that the driver hands out would add up over the rounds."""
    left = settle(edges.where("source <> target").select("source", "target").distinct(), "graph")
    seen = settle(nodes.select(F.col("node").alias("start"), "node").distinct(), "reached")
    front, done = seen, settle(seen.where("false").select("start"), "back")
    while True:
        step = settle(front.join(left.hint("merge"), front.node == left.source).select("start", F.col("target").alias("node")).distinct(), "step")
        back = settle(step.where("start = node").select("start").union(done).distinct(), "back")
        new = settle(step.join(seen.hint("merge"), ["start", "node"], "left_anti").join(back, "start", "left_anti"), "front")
        ended = not new.take(1)
        after = None if ended else settle(seen.join(back, "start", "left_anti").select("start", "node").union(new), "reached")
        for table in {id(t): t for t in (step, done, front, seen)}.values():
            discard(table)
        if ended:
            discard(new)
            discard(left)
            return back.withColumnRenamed("start", "node")
        seen, front, done = after, new, back


def short_cycles(edges: DataFrame) -> DataFrame:
    """(length, a, b, c): cycles of two and three different nodes, each once, from its least node."""
    e = edges.where("source <> target").select("source", "target").distinct()
    first = e.where("source < target").select(F.col("source").alias("a"), F.col("target").alias("b"))
    two = first.join(e.select(F.col("source").alias("b"), F.col("target").alias("a")), ["a", "b"]).select(F.lit(2).alias("length"), "a", "b", F.lit(None).cast(first.schema["a"].dataType).alias("c"))
    on = first.join(e.select(F.col("source").alias("b"), F.col("target").alias("c")), "b").where("c > a AND c <> b")
    three = on.join(e.select(F.col("source").alias("c"), F.col("target").alias("a")), ["c", "a"]).select(F.lit(3).alias("length"), "a", "b", "c")
    return two.union(three)


#: Edges of one repository up to which ``with_cycles`` walks its graph rather than have it split.
MOST_EDGES = 2_000_000
#: Edges that a task numbers at once, and nodes of paths that it hands out at once.
NUMBERED, HANDED = 500_000, 100_000


def _walks(begins: Sequence[int], leads: Sequence[int]) -> Iterator[list[int]]:
    """The paths of ``closed_walks`` for numbered nodes: node n leads to
    ``leads[begins[n]:begins[n + 1]]``, numbers in order of name."""
    place = array("i", [0]) * (len(begins) - 1)  # position in the walk from 1 on; 0: not yet seen, -1: done with
    onward = array("q", begins[:-1])  # each node's edge to take next
    for start in range(len(place)):
        walk = [] if place[start] else [start]
        place[start] = place[start] or 1
        while walk:
            node = walk[-1]
            at = onward[node]
            if at == begins[node + 1]:
                place[walk.pop()] = -1
                continue
            onward[node] = at + 1
            step = leads[at]
            if place[step] > 0:
                yield [*walk[place[step] - 1 :], step]
            elif not place[step]:
                walk.append(step)
                place[step] = len(walk)


def closed_walks(edges: Iterable[tuple[str, str]]) -> list[list[str]]:
    """One path for each edge that leads back into the walk that is under way, from the
    node it leads to and back to it. The walk starts at each node not yet seen and takes
    what a node leads to, both in order of name."""
    leads: dict[str, set[str]] = {}
    for a, b in edges:
        leads.setdefault(a, set()).add(b)
        leads.setdefault(b, set())
    names = sorted(leads)
    number = {n: i for i, n in enumerate(names)}
    begins = [0, *accumulate(len(leads[n]) for n in names)]
    return [[names[i] for i in path] for path in _walks(begins, [i for n in names for i in sorted(number[m] for m in leads[n])])]


def _by_repository(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Parts of batches of one repository (first column) each, with its number in the sequence."""
    number, last = 0, None
    for batch in batches:
        codes = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), batch.num_rows]
        for at, end in pairwise(cuts if batch.num_rows else []):
            first = batch.column(0).slice(at, 1)
            number, last = number + (last is not None and not first.equals(last)), first
            yield number, batch.slice(at, end - at)


def _numbered(parts: Iterable[pa.RecordBatch], most: int | None) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, int]:
    """(repository, names, begins, leads, edges) of one repository's rows (repository_id, source,
    target): first its sources, without a target, then its edges, both in order. Edges to nodes
    that lead nowhere are counted only, and all of a graph of more than ``most`` edges."""
    size, names, known, waiting, sources, leads, first = 0, [], None, [], [], [], None

    def number() -> None:
        if not waiting:
            return
        a, b = (pc.index_in(pa.chunked_array([w.column(c) for w in waiting]).cast(pa.large_string()), value_set=known).fill_null(-1).to_numpy() for c in (1, 2))
        sources.append(a[b >= 0]), leads.append(b[b >= 0])
        waiting.clear()

    for part in parts:
        first = part.column(0).slice(0, 1) if first is None else first
        own = part.column(2).null_count
        if own:
            names.append(part.column(1).slice(0, own).cast(pa.large_string()))
        if own == part.num_rows:
            continue
        known = pa.chunked_array(names).combine_chunks() if known is None else known
        size += part.num_rows - own
        if most is not None and size > most:
            waiting.clear(), sources.clear(), leads.clear()
            continue
        waiting.append(part.slice(own))
        if sum(w.num_rows for w in waiting) >= NUMBERED:
            number()
    number()
    begins, none = np.zeros(len(known) + 1, np.int64), np.zeros(0, np.int32)
    for a in sources:
        begins[1:] += np.bincount(a, minlength=len(known))
    return first, known, np.cumsum(begins), np.concatenate([none, *leads]), size


def _listed(batches: Iterable[pa.RecordBatch], most: int | None, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of ``cycle_listing`` from those that ``_numbered`` takes, repository by repository."""
    for _, parts in groupby(_by_repository(batches), key=lambda p: p[0]):
        first, names, begins, leads, size = _numbered((p for _, p in parts), most)
        done, ends, nodes = 0, [0], []

        def rows() -> pa.RecordBatch:
            n = len(ends) - 1  # noqa: B023
            paths = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), names.take(pa.array(nodes, pa.int32())).cast(pa.string()))  # noqa: B023
            return pa.RecordBatch.from_arrays([first.take(pa.array([0] * n, pa.int32())), pa.array(range(done + 1, done + n + 1), pa.int32()), paths, pa.array([size] * n, pa.int64())], schema=schema)  # noqa: B023

        if most is not None and size > most:
            yield pa.RecordBatch.from_arrays([first, pa.nulls(1, pa.int32()), pa.nulls(1, schema.field("path").type), pa.array([size], pa.int64())], schema=schema)
            continue
        for path in _walks(memoryview(begins), memoryview(leads)):
            nodes += path
            ends.append(len(nodes))
            if len(nodes) >= HANDED:
                yield rows()
                done, ends, nodes = done + len(ends) - 1, [0], []
        yield rows()


def cycle_listing(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(repository_id, place, path, edges): the closed walks of each repository's graph,
    ``edges`` (repository_id, source, target), in the order in which they are met.

    The order makes the walk sequential, so one task walks a repository's whole graph, of any
    size: it gets the edges sorted and holds the names of nodes once, edges as numbers, and
    hands the paths out as it meets them. With ``most``, a graph of more edges is not walked
    and has a single row without a place and path. Edges with a null end are ignored,
    repeated ones count once, a loop is a path of its node twice.
    """
    kind = edges.schema["repository_id"].dataType
    schema = pa.schema([("repository_id", to_arrow_type(kind)), ("place", pa.int32()), ("path", pa.list_(pa.string())), ("edges", pa.int64())])
    ends = F.explode(F.array(F.lit(None).cast("string"), F.col("target").cast("string")))
    plain = edges.where("source IS NOT NULL AND target IS NOT NULL").select("repository_id", F.col("source").cast("string"), ends.alias("target")).distinct()
    rows = plain.repartition("repository_id").sortWithinPartitions("repository_id", F.col("target").isNotNull(), "source", "target")
    return rows.mapInArrow(lambda batches: _listed(batches, most, schema), f"repository_id {kind.simpleString()}, place int, path array<string>, edges long")


def with_cycles(edges: DataFrame, most: int = MOST_EDGES) -> DataFrame:
    """(repository_id) whose graph has a cycle: by the listing, or by ``tangles`` for graphs too large to list."""
    listed = cycle_listing(edges, most)
    large = edges.join(listed.where("path IS NULL").select("repository_id"), "repository_id", "left_semi")
    found = listed.where("path IS NOT NULL").select("repository_id")
    if large.take(1):
        named = large.select("repository_id", *[F.struct("repository_id", end).alias(end) for end in ("source", "target")])
        found = found.union(tangles(named).select("node.repository_id"))
    return found.distinct()


def within_cycles(edges: DataFrame, cycles: DataFrame) -> DataFrame:
    """``edges`` (repository_id, source, target) with both ends in listed cycles (repository_id,
    path) of their repository, and whether the edge is a step of one (``step``)."""
    path = F.col("path")
    pairs = F.zip_with(F.slice(path, F.lit(1), F.size(path) - 1), F.slice(path, F.lit(2), F.size(path) - 1), lambda a, b: F.struct(a.alias("source"), b.alias("target")))
    steps = cycles.where("path IS NOT NULL").select("repository_id", F.explode(pairs).alias("e")).select("repository_id", "e.*").distinct()
    nodes = steps.select("repository_id", F.col("source").alias("node")).distinct()  # each node of a closed walk begins a step
    inside = edges.join(nodes.withColumnRenamed("node", "source"), ["repository_id", "source"], "left_semi").join(nodes.withColumnRenamed("node", "target"), ["repository_id", "target"], "left_semi")
    return inside.join(steps.withColumn("step", F.lit(True)), ["repository_id", "source", "target"], "left").select("repository_id", "source", "target", F.coalesce("step", F.lit(False)).alias("step"))


def cycle_edges(cycles: DataFrame) -> DataFrame:
    """(source, target): the edges of cycles given as arrays (nodes), that from the last node
    back to the first included."""
    nodes = F.col("nodes")
    pairs = F.zip_with(nodes, F.concat(F.slice(nodes, F.lit(2), F.size(nodes)), F.slice(nodes, 1, 1)), lambda a, b: F.struct(a.alias("source"), b.alias("target")))
    return cycles.where(F.size("nodes") > 0).select(F.explode(pairs).alias("e")).select("e.*").distinct()


def group_tree(modules: DataFrame) -> DataFrame:
    """(group_id, parent, label, modules, subgroups): the groups that dotted module ids are
    in, without those that hold one subgroup and nothing else.

    Such a group is folded into the label of the next one below it that stays, so a chain of
    them becomes one label with dots. What stays does not change with the folding, as a
    folded group hands its place to one other: the parent is the longest group above that
    stays, the label what the id has beyond it. ``modules`` (module_id); repeated ids count
    once, ids without a dot are in no group.
    """
    ids = modules.where("module_id IS NOT NULL").select("module_id").distinct()
    own = ids.select(F.substring_index("module_id", ".", -1).alias("last"), "module_id").select(F.expr("substring(module_id, 1, length(module_id) - length(last) - 1)").alias("group_id")).where("group_id <> ''")
    counts = own.groupBy("group_id").agg(F.count("*").alias("modules"))
    named = counts.select(F.explode(F.concat(prefixes(F.col("group_id")), F.array("group_id"))).alias("group_id")).distinct()
    above = named.where("instr(group_id, '.') > 0").select(F.expr("substring(group_id, 1, length(group_id) - length(substring_index(group_id, '.', -1)) - 1)").alias("group_id"))
    below = above.groupBy("group_id").agg(F.count("*").alias("below"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    sized = named.join(counts, "group_id", "left").join(below, "group_id", "left").select("group_id", zero("modules").alias("modules"), zero("below").alias("below"))
    stays = sized.where("modules > 0 OR below <> 1")
    chains = stays.where("instr(group_id, '.') > 0").select("group_id", F.explode(prefixes(F.col("group_id"))).alias("parent"))
    nearest = chains.join(stays.select(F.col("group_id").alias("parent")), "parent").groupBy("group_id").agg(F.max_by("parent", F.length("parent")).alias("parent"))
    placed = stays.join(nearest, "group_id", "left")
    label = F.when(F.col("parent").isNull(), F.col("group_id")).otherwise(F.expr("substring(group_id, length(parent) + 2)"))
    return placed.select("group_id", "parent", label.alias("label"), "modules", F.col("below").alias("subgroups"))


def top_per_group(rows: DataFrame, group: str, order: list, most: int) -> DataFrame:
    """``rows`` with ``place`` in the group, the first ``most`` of each."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("place") <= most)
