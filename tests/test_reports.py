"""Assembled reports on small facts."""

from collections import Counter

from pyspark.sql import functions as F

from millrace.operators import assembled, graph
from millrace.plans import QUERIES, assembling


def facts(spark, hot=1, cycle=False):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    edges = [("d", f"app.m{i}", "app.core") for i in range(hot)] + [("d", "app.core", "app.m0"), ("d", "app.core", "app.m0")]
    return assembled.Facts(
        repositories=t([("d", "demo", True), ("n", "new", False), ("e", "empty", True)], "repository_id string, name string, computed boolean"),
        files=t([("d", "app/main.py", "Python", False, False), ("d", "app/models/user.py", "Python", False, False), ("d", "tests/test_user.py", "Python", True, False), ("d", "README.md", None, False, True), ("n", "a.py", "Python", False, False)], "repository_id string, path string, language string, is_test boolean, is_doc boolean"),
        symbols=t([("d", "app/models/user.py"), ("d", "app/main.py"), ("d", "app/models/user.py")], "repository_id string, path string"),
        edges=t(edges, "repository_id string, source string, target string"),
        cycles=t([("d", 1, ["app.core", "app.m0", "app.core"]), ("d", 2, ["x", "x"])] if cycle else [], "repository_id string, place int, path array<string>"),
        orphans=t([("d", "README.md"), ("d", "a.md")], "repository_id string, path string"),
        calls=t([("d", "app.main.run", "app.models.user.User")] * 2 + [("d", "a", "b")], "repository_id string, source string, target string"),
        inheritance=t([("d",)], "repository_id string"),
    )


def sections(report):
    out = {}
    for r in report.collect():
        out.setdefault(r.repository_id, {"summary": r.summary, "order": {}})["order"][r.ordinal] = r.heading
        out[r.repository_id][r.heading] = (r.content, r.confidence, r.findings)
    return out


def test_risk_report(spark):
    got = sections(assembled.dependency_risk(facts(spark, hot=6, cycle=True)))
    d = got["d"]
    assert list(dict(sorted(d["order"].items())).values()) == ["Dependency Hotspots", "Circular Dependencies", "Orphan Files", "Call Relationships"]
    assert d["Dependency Hotspots"] == ("Modules ranked by incoming dependency count: app.core (6, risk=high), app.m0 (1, risk=medium)", "verified", ["app.core is high-risk (heavily depended-on and part of a dependency cycle)."])
    assert d["Circular Dependencies"] == ("2 circular dependency chain(s) detected: app.core -> app.m0 -> app.core; x -> x", "verified", ["app.core -> app.m0 -> app.core", "x -> x"])
    assert d["Orphan Files"] == ("2 file(s) are never imported/depended on by any other resolved file: README.md, a.md", "verified", ["README.md", "a.md"])
    assert d["Call Relationships"][0] == "Most-called symbols: app.models.user.User (2 caller(s)), b (1 caller(s))"
    assert d["summary"] == "demo: 7 dependency edge(s), 2 circular dependency chain(s), 2 orphan file(s), 1 high-risk module(s)."
    assert got["n"]["Dependency Hotspots"] == (assembled.NOT_COMPUTED_RISK, "insufficient_evidence", []) and len(got["n"]["order"]) == 1
    assert got["e"]["Dependency Hotspots"][0] == assembled.NO_HOTSPOTS and got["e"]["Circular Dependencies"][0] == assembled.NO_CYCLES and got["e"]["Orphan Files"][0] == assembled.NO_ORPHANS
    assert got["e"]["summary"] == "empty: 0 dependency edge(s), 0 circular dependency chain(s), 0 orphan file(s), 0 high-risk module(s)."


def test_risk_needs_both_signs_to_be_high(spark):
    assert "risk=medium" in sections(assembled.dependency_risk(facts(spark, hot=6)))["d"]["Dependency Hotspots"][0]
    assert "app.core (1, risk=low)" in sections(assembled.dependency_risk(facts(spark)))["d"]["Dependency Hotspots"][0]


def test_health_report(spark):
    got = sections(assembled.health(facts(spark, cycle=True)))
    d = got["d"]
    assert list(dict(sorted(d["order"].items())).values()) == ["Repository Size", "Languages", "Largest Modules", "Dependency Concentration", "Structural Complexity Signals", "Orphan Files", "Test-Related Structure", "Documentation Signals"]
    assert d["Repository Size"][0] == "4 file(s), 3 symbol(s)." and d["Languages"][0] == "Python (3)"
    assert d["Largest Modules"][0] == "Largest modules by symbol count: app/models/user.py (2), app/main.py (1)"
    assert d["Dependency Concentration"][0] == "Top dependency hotspot: app.core with 1 incoming dependencies."
    assert d["Structural Complexity Signals"][:2] == ("2 circular dependency chain(s); 1 inheritance relationship(s); 3 call relationship(s).", "verified")
    assert d["Orphan Files"][0] == "2 orphan file(s) detected." and d["Test-Related Structure"][:2] == ("1 test-related file(s) found (25% of files).", "derived")
    assert d["Documentation Signals"][0] == "1 documentation file(s) found."
    assert d["summary"] == "demo: 4 files, 3 symbols, 1 test file(s), 1 documentation file(s), 2 circular dependency chain(s)."
    assert list(got["n"]["order"].values()) and got["n"]["Structural Complexity Signals"] == (assembled.NOT_COMPUTED, "insufficient_evidence", []) and "Languages" not in got["n"]
    assert got["n"]["summary"] == "new: 1 files, 0 symbols, 0 test file(s), 0 documentation file(s)."
    assert got["e"]["Test-Related Structure"][0] == assembled.NO_FILES and got["e"]["Documentation Signals"][0] == assembled.NO_DOCS and got["e"]["Languages"][0] == assembled.NO_LANGUAGES


def test_queries_equal_plain_python(spark, sf):
    f = assembling.facts(spark, sf)
    held = lambda df, *c: [tuple(r) for r in df.select("repository_id", *c).collect()]
    files, edges = held(f.files, "path", "language", "is_test", "is_doc"), set(held(f.edges, "source", "target"))
    calls, symbols, orphans, inherits = held(f.calls, "target"), held(f.symbols, "path"), held(f.orphans, "path"), held(f.inheritance)
    top = lambda counts, n=10: sorted(counts.items(), key=lambda p: (-p[1], p[0]))[:n]
    risk, health = {}, {}
    for repo in {r[0] for r in files}:
        mine = lambda rows: [r[1:] for r in rows if r[0] == repo]  # noqa: B023, E731
        cycles = graph.closed_walks(mine(edges))
        cyclic, incoming = {n for c in cycles for n in c}, Counter(t for _, t in mine(edges))
        level = lambda m, n: "high" if m in cyclic and n >= 5 else "medium" if m in cyclic or n >= 5 else "low"  # noqa: B023, E731
        hot, lost, called, own = top(incoming), sorted(p for p, in mine(orphans)), top(Counter(t for t, in mine(calls))), mine(files)
        high = [m for m, n in hot if level(m, n) == "high"]
        chains = [" -> ".join(c) for c in cycles]
        risk[repo] = {
            "summary": f"{repo}: {len(mine(edges))} dependency edge(s), {len(cycles)} circular dependency chain(s), {len(lost)} orphan file(s), {len(high)} high-risk module(s).",
            "Dependency Hotspots": "Modules ranked by incoming dependency count: " + ", ".join(f"{m} ({n}, risk={level(m, n)})" for m, n in hot) if hot else "No dependency hotspots were detected.",
            "Circular Dependencies": f"{len(cycles)} circular dependency chain(s) detected: " + "; ".join(chains) if cycles else "No circular dependencies were detected.",
            "Orphan Files": f"{len(lost)} file(s) are never imported/depended on by any other resolved file: " + ", ".join(lost[:15]) if lost else "No orphan files were detected.",
        } | ({"Call Relationships": "Most-called symbols: " + ", ".join(f"{m} ({n} caller(s))" for m, n in called)} if called else {})
        tests, docs = sum(x[2] for x in own), sum(x[3] for x in own)
        largest = top(Counter(p for p, in mine(symbols)))
        health[repo] = {
            "summary": f"{repo}: {len(own)} files, {len(mine(symbols))} symbols, {tests} test file(s), {docs} documentation file(s), {len(cycles)} circular dependency chain(s).",
            "Repository Size": f"{len(own)} file(s), {len(mine(symbols))} symbol(s).",
            "Languages": ", ".join(f"{m} ({n})" for m, n in top(Counter(x[1] for x in own if x[1]), 99)) or "Language distribution unavailable.",
            "Largest Modules": "Largest modules by symbol count: " + ", ".join(f"{m} ({n})" for m, n in largest) if largest else "No module size data is available.",
            "Dependency Concentration": f"Top dependency hotspot: {hot[0][0]} with {hot[0][1]} incoming dependencies." if hot else "No dependency concentration data is available.",
            "Structural Complexity Signals": f"{len(cycles)} circular dependency chain(s); {len(mine(inherits))} inheritance relationship(s); {len(mine(calls))} call relationship(s).",
            "Orphan Files": f"{len(lost)} orphan file(s) detected." if lost else "No orphan files detected.",
            "Test-Related Structure": f"{tests} test-related file(s) found ({tests / len(own):.0%} of files).",
            "Documentation Signals": f"{docs} documentation file(s) found." if docs else "No conventional documentation files (README, docs/) were found.",
        }
    for name, want in (("report_dependency_risk", risk), ("report_health", health)):
        got = {}
        for r in QUERIES[name](spark, sf).collect():
            got.setdefault(r.repository_id, {"summary": r.summary})[r.heading] = r.content
        assert got == want, name


def of_a_large_graph(spark, sf, monkeypatch, name):
    """A report of 2,100 files of which each imports all after it and the second the first: 2,203,951 edges, one cycle."""
    from millrace import corpus
    from millrace.operators import resolve

    path = lambda c: f"concat('r/m', lpad({c}, 4, '0'), '.py')"
    ids = lambda c: spark.range(2100).select(F.col("id").alias(c))
    pairs = ids("a").crossJoin(ids("b")).where("a < b OR (a = 1 AND b = 0)").selectExpr(f"{path('a')} AS source", f"{path('b')} AS target")
    monkeypatch.setattr(corpus, "files", lambda *_: spark.range(2100).selectExpr("id AS file_id", "'r' AS repository_id", f"{path('id')} AS path"))
    monkeypatch.setattr(resolve, "resolve_imports", lambda *_: pairs)
    return {r.heading: (r.content, r.findings, r.summary) for r in QUERIES[name](spark, sf).collect()}


def test_risk_report_lists_the_cycles_of_a_large_graph(spark, sf, monkeypatch):
    got = of_a_large_graph(spark, sf, monkeypatch, "report_dependency_risk")
    chain = "r.m0000 -> r.m0001 -> r.m0000"
    assert got["Circular Dependencies"][:2] == (f"1 circular dependency chain(s) detected: {chain}", chain)
    assert got["Circular Dependencies"][2].startswith("r: 2203951 dependency edge(s), 1 circular dependency chain(s), ")


def test_health_report_counts_the_cycles_of_a_large_graph(spark, sf, monkeypatch):
    got = of_a_large_graph(spark, sf, monkeypatch, "report_health")
    assert got["Structural Complexity Signals"][0].startswith("1 circular dependency chain(s); ")
    assert got["Repository Size"][2].endswith(", 1 circular dependency chain(s).")
