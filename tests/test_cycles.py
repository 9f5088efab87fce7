"""Cycle listing against a recursive walk."""

import random
import sys

from millrace.operators import graph
from millrace.plans import QUERIES


def walked(edges):
    """The same listing by plain recursion over colours."""
    nodes = sorted({n for e in edges for n in e})
    colour, found, path = dict.fromkeys(nodes, "white"), [], []

    def visit(n):
        colour[n] = "grey"
        path.append(n)
        for m in sorted({b for a, b in edges if a == n}):
            if colour[m] == "grey":
                found.append(path[path.index(m) :] + [m])
            elif colour[m] == "white":
                visit(m)
        path.pop()
        colour[n] = "black"

    for n in nodes:
        if colour[n] == "white":
            visit(n)
    return found


def test_walks_equal_recursion():
    assert graph.closed_walks([]) == []
    assert graph.closed_walks([("a", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "b"), ("d", "c")]) == [["a", "a"], ["a", "b", "c", "a"], ["b", "c", "b"]]
    assert graph.closed_walks([("1", "2"), ("2", "1"), ("1", "3"), ("3", "2")]) == [["1", "2", "1"]]  # 3 leads to a node that is done with
    rng = random.Random(1)
    for size in range(2, 12):
        edges = [(f"n{rng.randrange(size)}", f"n{rng.randrange(size)}") for _ in range(3 * size)]
        assert graph.closed_walks(edges) == walked(edges)
    long = [(f"{i:06}", f"{i + 1:06}") for i in range(50_000)] + [("050000", "000000")]
    assert [len(w) for w in graph.closed_walks(long)] == [50_002]


def test_listing_by_repository(spark):
    rows = [("r", "a", "b"), ("r", "b", "a"), ("r", "a", "b"), ("r", None, "b"), ("r", "b", None), ("q", "b", "a"), ("q", "c", "c"), (None, "x", "y"), (None, "y", "x")]
    rows += [("big", f"{i}", f"{i + 1}") for i in range(20)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "repository_id string, source string, target string, place int")
    got = {(r.repository_id, r.place, tuple(r.path) if r.path else None, r.edges) for r in graph.cycle_listing(df, most=10).collect()}
    assert got == {("r", 1, ("a", "b", "a"), 2), ("q", 1, ("c", "c"), 2), (None, 1, ("x", "y", "x"), 2), ("big", None, None, 20)}
    assert graph.cycle_listing(df.where("false")).count() == 0
    cycles = spark.createDataFrame([("r", ["a", "b", "c", "a"]), ("r", None), ("q", ["a", "a"])], "repository_id string, path array<string>")
    edges = spark.createDataFrame([("r", "a", "b"), ("r", "b", "a"), ("r", "c", "d"), ("q", "a", "a"), ("q", "a", "b")], "repository_id string, source string, target string")
    assert {tuple(r) for r in graph.within_cycles(edges, cycles).collect()} == {("r", "a", "b", True), ("r", "b", "a", False), ("q", "a", "a", True)}


def test_listing_in_parts_equals_the_walk(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(graph, "NUMBERED", 5)
    monkeypatch.setattr(graph, "HANDED", 7)
    rng, rows, want = random.Random(3), [], []
    for repo in [None, 1, 2, 3]:
        edges = sorted({(f"é{rng.randrange(9)}", f"{rng.choice('éz')}{rng.randrange(9)}") for _ in range(25)} if repo != 3 else {("a", "b"), ("a", "c")})
        rows += [(repo, a, None) for a in sorted({a for a, _ in edges})] + [(repo, a, b) for a, b in edges]
        want += [(repo, i, p, len(edges)) for i, p in enumerate(walked(edges), 1)]
    schema = pa.schema([("repository_id", pa.int64()), ("place", pa.int32()), ("path", pa.list_(pa.string())), ("edges", pa.int64())])
    table = pa.table([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string()))], names=["repository_id", "source", "target"])
    for size in (1, 4, 1000):
        batches = list(graph._listed(table.to_batches(max_chunksize=size), None, schema))
        assert [tuple(r.values()) for b in batches for r in b.to_pylist()] == want and len(batches) > 4
    assert list(graph._listed([], None, schema)) == []


def test_queries_equal_recursion(spark, sf):
    from millrace import corpus

    sys.setrecursionlimit(10_000)
    edges = {}
    for r in corpus.module_edges(spark, sf).collect():
        edges.setdefault(r.repository_id, set()).add((r.source, r.target))
    want = {(repo, i, " > ".join(p)) for repo, e in edges.items() for i, p in enumerate(walked(e), 1)}
    got = QUERIES["cycle_listing"](spark, sf).collect()
    assert {(r.repository_id, r.place, r.path) for r in got} == want and len(want) == len(got)
    on = {(repo, n) for repo, _, p in want for n in p.split(" > ")}
    steps = {(repo, *s) for repo, _, p in want for s in zip(p.split(" > "), p.split(" > ")[1:])}
    inside = {(repo, a, b, (repo, a, b) in steps) for repo, e in edges.items() for a, b in e if (repo, a) in on and (repo, b) in on}
    assert {tuple(r) for r in QUERIES["edges_within_cycles"](spark, sf).collect()} == inside


def test_chains_of_single_folders_are_folded(spark):
    ids = ["com.acme.app.core.a", "com.acme.app.core.b", "com.acme.app.web.ui.x.c", "com.acme.app.web.ui.y.d", "main", "lib.one", "lib.deep.er.two", None, "lib.one"]
    got = {r.group_id: (r.parent, r.label, r.modules, r.subgroups) for r in graph.group_tree(spark.createDataFrame([(i,) for i in ids], "module_id string")).collect()}
    assert got == {
        "com.acme.app": (None, "com.acme.app", 0, 2), "com.acme.app.core": ("com.acme.app", "core", 2, 0), "com.acme.app.web.ui": ("com.acme.app", "web.ui", 0, 2),
        "com.acme.app.web.ui.x": ("com.acme.app.web.ui", "x", 1, 0), "com.acme.app.web.ui.y": ("com.acme.app.web.ui", "y", 1, 0), "lib": (None, "lib", 1, 1), "lib.deep.er": ("lib", "deep.er", 1, 0),
    }


def test_walks_back_leave_one_table(spark):
    import os

    shared = spark.conf.get("spark.checkpoint.dir")
    held = set(os.listdir(shared)) if os.path.isdir(shared) else set()
    edges = spark.createDataFrame([(i, (i + 1) % 9) for i in range(9)] + [(20, 21), (21, 22), (3, 20)], "source long, target long")
    got = graph.on_cycles(edges, spark.createDataFrame([(0,), (20,)], "node long"))
    assert [r.node for r in got.collect()] == [0]
    assert len([f for f in set(os.listdir(shared)) - held if f.split("-")[0] in ("graph", "reached", "back", "front", "step")]) == 1


def test_rows_of_a_task_do_not_grow_with_the_table(spark, sf, monkeypatch):
    from millrace import corpus

    few = corpus.edges(spark, sf).rdd.getNumPartitions()
    monkeypatch.setattr(corpus, "TASK_ROWS", 100)
    assert corpus.edges(spark, sf).rdd.getNumPartitions() > 10 * few
