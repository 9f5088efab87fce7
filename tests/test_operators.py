"""Operators on small literal tables."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import answers, chunking, graph, jobs, reports, resolve, retrieval


def test_merge_keeps_the_best_of_each_source_and_first_seen_order(spark):
    rows = [("q", "k", "lexical", 0.4, "b", None, 1, 7, 2), ("q", "k", "semantic", 0.9, "a", "p", None, None, 1), ("q", "k", "lexical", 0.7, "c", "late", 1, 9, 3)]
    df = spark.createDataFrame(rows, "query_id string, key string, source string, score double, reason string, path string, symbol_id long, start_line long, ordinal int")
    row = retrieval.merge(df).first()
    assert (row.semantic, row.lexical, row.structural, row.path, row.symbol_id, row.reasons, row.sources) == (0.9, 0.7, None, "p", 1, "a; b; c", "lexical+semantic")


def test_fusion_weights_boosts_and_ties(spark):
    df = spark.createDataFrame([("q", "a", 1.0, None, None, "z", 9), ("q", "b", 1.0, None, None, "y", 1), ("q", "c", 0.0, 1.0, 1.0, "x", 1), ("q", "d", 1.0, None, None, "z", 2), ("q", "e", 1.0, None, None, "z", None)], "query_id string, key string, semantic double, lexical double, structural double, path string, start_line long")
    fused = retrieval.ranked(retrieval.fuse(df, F.col("key") == "c", F.lit(False), F.lit(False)))
    assert [(r.key, r.final_score) for r in fused.orderBy("rank").collect()] == [("c", 0.55), ("b", 0.5), ("e", 0.5), ("d", 0.5), ("a", 0.5)]


def test_lexical_search_admits_by_pattern_and_stays_in_its_repository(spark):
    symbols = spark.createDataFrame([(1, "r", "xaqbz", "m.xaqbz"), (2, "s", "xaqbz", "m.xaqbz"), (3, "r", "getUserById", "auth.getUserById"), (4, "r", "other", "auth.other")], "symbol_id long, repository_id string, name string, qualified_name string")
    tokens = spark.createDataFrame([("q", "a_b", "r"), ("q", "getUser", "r"), ("q", "zzz", "r")], "query_id string, token string, repository_id string")
    assert sorted((r.token, r.symbol_id) for r in retrieval.lexical(tokens, symbols).collect()) == [("a_b", 1), ("getUser", 3)]
    assert sorted((r.token, r.symbol_id) for r in retrieval.lexical(tokens.drop("repository_id"), symbols).collect()) == [("a_b", 1), ("a_b", 2), ("getUser", 3)]
    files = spark.createDataFrame([(1, "src/session.py", "r"), (2, "src/session.py", "s"), (3, "a_b", "r")], "file_id long, path string, repository_id string")
    asked = spark.createDataFrame([("q", "session", "r"), ("q", "A_B", "r")], "query_id string, token string, repository_id string")
    got = {(r.token, r.file_id): r.score for r in retrieval.file_search(asked, files).collect()}
    assert set(got) == {("session", 1), ("A_B", 3)} and got["A_B", 3] == 1.0 and 0 < got["session", 1] < 1


def test_matching_equals_a_comparison_of_all_pairs(spark):
    import random
    import re

    def grams(t):
        words = [w for w in re.split(r"[^a-z0-9]+", t.lower()) if w]
        return {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}

    rng = random.Random(6)
    parts = ["src", "user", "User", "session", "get", "id", "a", "main.py", "x1", "zebra", "ses", "ion"]
    made = lambda n: {rng.choice(["", "_", "/"]).join(rng.choice(parts) for _ in range(rng.randrange(1, 5))) for _ in range(n)}
    strings, tokens = made(150), made(40) | {"", "_", "a_", "se_sion"}
    want = {}
    for t in tokens:
        for s in strings:
            a, b = grams(t), grams(s)
            similarity = len(a & b) / len(a | b) if a | b else 0.0
            if re.search(re.escape(t).replace("_", "."), s, re.I | re.S) or similarity >= 0.2:
                want[t, s] = round(similarity, 9)
    asked = spark.createDataFrame([(t,) for t in [*tokens, *tokens]], "token string")
    names = spark.createDataFrame([(s,) for s in [*strings, *strings]], "string string")
    got = retrieval.matching(asked, names).collect()
    assert {(r.token, r.string): round(r.similarity, 9) for r in got} == want and len(got) == len(want)
    assert retrieval.matching(asked, names.where("false")).count() == 0


def test_file_search_equals_a_comparison_of_all_pairs(spark, monkeypatch):
    import re

    monkeypatch.setattr(retrieval, "WORDS", 11)
    monkeypatch.setattr(retrieval, "NAMES", 40)

    def grams(t):
        words = [w for w in re.split(r"[^a-z0-9äö]+", t.lower()) if w]
        return {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}

    rng = random.Random(8)
    parts = ["src", "user", "User", "session", "Ähre", "id", "a", "main.py", "x1", "zebra", "ses", "ion", "doc_", "17", "1", "71"]
    made = lambda n: {rng.choice(["", "_", "/"]).join(rng.choice(parts) for _ in range(rng.randrange(1, 6))) for _ in range(n)}
    paths, tokens = sorted(made(250) | {"__", "/_", ".", "a\nb", "+" * 300 + "".join(chr(97 + i % 26) + chr(97 + i // 26) for i in range(400))}), made(40) | {"", "_", "__", "a_", "se_sion", "m%n", "doc_1", "".join(chr(97 + i % 26) + chr(97 + i // 26) for i in range(400))}
    files = [(i, p, "ab"[i % 2] if i % 13 else None) for i, p in enumerate([*paths, *paths[::3], *paths[::5], None])]

    def score(token, path):
        a, b = grams(token), grams(path)
        similarity = len(a & b) / len(a | b) if a | b else 0.0
        if re.search(re.escape(token).replace("_", ".").replace("%", ".*"), path, re.I | re.S) or similarity >= 0.2:
            return 1.0 if token.lower() == path.lower() else similarity

    scores = {(t, p): score(t, p) for t in tokens for p in paths}
    for scoped in (False, True):
        want = set()
        for q, (t, home) in enumerate((t, home) for t in sorted(tokens) for home in "ab"):
            found = sorted((-scores[t, p], p, i) for i, p, r in files if p is not None and scores[t, p] is not None and (r == home or not scoped))
            want |= {(q, t, i, p, round(-x, 9), n + 1) for n, (x, p, i) in enumerate(found[:6])}
        asked = spark.createDataFrame([(q, t, home) for q, (t, home) in enumerate((t, home) for t in sorted(tokens) for home in "ab")] + [(999, None, "a")], "query_id long, token string, repository_id string")
        held = spark.createDataFrame(files, "file_id long, path string, repository_id string")
        got = retrieval.file_search(asked if scoped else asked.drop("repository_id"), held, 6).collect()
        assert {(r.query_id, r.token, r.file_id, r.path, round(r.score, 9), r["rank"]) for r in got} == want and len(got) == len(want)
    assert retrieval.file_search(asked, held.where("false")).count() == 0


def test_file_search_does_not_list_what_is_admitted(spark):
    store = spark._jsc.sc().statusStore()

    def shuffled():
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    tokens = spark.range(300).selectExpr("id AS query_id", "concat('doc_', id) AS token")
    files = spark.range(3000).selectExpr("id AS file_id", "concat('doc_', id, '.py') AS path")  # 900,000 pairs, most of them similar
    before = shuffled()
    assert retrieval.file_search(tokens, files).count() == 300 * 25
    assert shuffled() - before < 100_000


def test_nearest_equals_a_comparison_of_all_pairs(spark, monkeypatch):
    from millrace.functions import vectors

    monkeypatch.setattr(retrieval, "ASKED", 7)
    monkeypatch.setattr(retrieval, "HELD", 10)
    rng = random.Random(4)
    pool = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(30)]
    rows = [(i, "ab"[i % 2] if i % 17 else None, rng.choice(pool)) for i in range(200)] + [(200, "a", None), (201, "a", [1.0, None, 1.0, 1.0, 1.0]), (202, "a", [0.0] * 5), (203, "a", [1.0] * 3), (204, "a", []), (205, "b", [float("nan")] * 5)]
    chunks = spark.createDataFrame(rows, "chunk_id long, repository_id string, embedding array<float>")
    asked = chunks.where("chunk_id % 3 = 0 OR chunk_id >= 200").select(F.col("chunk_id").alias("query_id"), "repository_id", F.col("embedding").alias("vector"))
    both = asked.join(chunks, "repository_id").select("query_id", "chunk_id", vectors.cosine(F.col("vector"), F.col("embedding")).alias("score")).collect()
    want = set()
    for q in {r.query_id for r in both}:
        found = sorted((r for r in both if r.query_id == q and r.score is not None), key=lambda r: (-(float("inf") if r.score != r.score else r.score), r.chunk_id))
        want |= {(q, r.chunk_id, n + 1, str(r.score)) for n, r in enumerate(found[:6]) if not r.score < 0.1}
    got = [(r.query_id, r.chunk_id, r["rank"], str(r.score)) for r in retrieval.nearest(asked, chunks, 6, 0.1).collect()]
    assert set(got) == want and len(got) == len(want) > 200


def test_questions_for_one_name_are_answered_once(spark):
    tokens = spark.createDataFrame([(q, "getuser") for q in range(300)], "query_id long, token string")
    symbols = spark.createDataFrame([(i, "getUser", f"m{i:04}.getUser") for i in range(300)] + [(900, "other", "z.getuser"), (901, "getuserx", "getuserx")], "symbol_id long, name string, qualified_name string")
    got = retrieval.lexical(tokens, symbols, 5)
    assert sorted((r.symbol_id, r["rank"], r.score) for r in got.where("query_id = 7").collect()) == [(i, i + 1, 1.0) for i in range(5)]
    assert got.count() == 1500
    few = symbols.where("symbol_id < 2 OR symbol_id >= 900")
    assert [r.symbol_id for r in retrieval.lexical(tokens.limit(1), few, 5).orderBy("rank").collect()] == [0, 1, 900, 901]


def test_one_hop_needs_exactly_one_end_among_the_seeds(spark):
    seeds = spark.createDataFrame([(1, 10), (1, 11)], "query_id long, node long")
    relations = spark.createDataFrame([(10, 11, "calls"), (10, 12, "imports"), (13, 10, "calls"), (12, 10, "depends_on"), (14, 15, "calls")], "source long, target long, relationship_type string")
    got = {r.node: (r.score, r.types) for r in retrieval.one_hop(seeds, relations).collect()}
    assert got == {12: (0.55, "depends_on,imports"), 13: (0.70, "calls")}


def test_tangles_equal_mutual_reachability(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(55)]
    reach = {a: {b for x, b in edges if x == a} for a in range(40)}
    for _ in range(40):
        reach = {a: reach[a] | set().union(*(reach[b] for b in reach[a]), set()) for a in reach}
    want = {}
    for a in range(40):
        mutual = {b for b in reach[a] if a in reach[b]} | {a}
        if len(mutual) > 1:
            want[a] = min(mutual)
    got = {r.node: r.tangle for r in graph.tangles(spark.createDataFrame(edges, "source long, target long")).collect()}
    assert got == want


def test_tangles_of_an_acyclic_and_an_empty_graph(spark):
    assert graph.tangles(spark.createDataFrame([(1, 2), (2, 3)], "source long, target long")).count() == 0
    assert graph.tangles(spark.createDataFrame([], "source long, target long")).count() == 0


def test_windows_cover_every_line(spark):
    for n in (1, 5, 39, 40, 41, 45, 46, 75, 76, 200):
        df = spark.createDataFrame([(n, "\n".join(f"l{i}" for i in range(n)))], "file_id long, text string")
        rows = chunking.windows(df).orderBy("chunk_index").collect()
        covered = {i for r in rows for i in range(r.start_line, r.end_line + 1)}
        assert covered == set(range(1, n + 1))
        assert sum(r.end_line == n for r in rows) == 1


def test_windows_of_blank_and_null_texts(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "\n\n \n"), (4, "x")], "file_id long, text string")
    assert [(r.file_id, r.text) for r in chunking.windows(df).collect()] == [(4, "x")]


@pytest.mark.parametrize("lengths", [[200] * 50, [10], [], [5000, 1, 1], [3500], [1] * 4000])
def test_pack(lengths):
    spans = chunking.pack(lengths)
    assert {i for a, b in spans for i in range(a, b + 1)} == set(range(len(lengths)))
    for a, b in spans:
        assert a == b or sum(lengths[a : b + 1]) + b - a <= chunking.MAX_CHARS
    assert all(x[0] < y[0] for x, y in zip(spans, spans[1:]))


def test_imports_by_language(spark):
    files = spark.createDataFrame([("a/b/c.py",), ("a/b/d.py",), ("a/e/__init__.py",), ("w/x.js",), ("w/y/index.ts",), ("j/T.java",)], ["path"])
    imports = spark.createDataFrame([
        ("a/b/c.py", "Python", ".d"), ("a/b/c.py", "Python", "a.e"), ("a/b/c.py", "Python", "."), ("a/b/c.py", "Python", "os"), ("a/b/c.py", "Python", "a.b.c"),
        ("w/x.js", "JavaScript", "./y"), ("w/x.js", "JavaScript", "react"), ("w/y/index.ts", "TypeScript", "../x"), ("j/T.java", "Java", "j.T.Inner"), ("x/U.java", "Java", "j.T.Inner"), ("x/U.java", "Java", "j.*"),
    ], ["path", "language", "target"])
    got = {(r.source, r.target) for r in resolve.resolve_imports(imports, files).collect()}
    assert got == {("a/b/c.py", "a/b/d.py"), ("a/b/c.py", "a/e/__init__.py"), ("w/x.js", "w/y/index.ts"), ("w/y/index.ts", "w/x.js"), ("x/U.java", "j/T.java")}


def test_citation_statuses(spark):
    said = spark.createDataFrame([(1, "See src/a.py."), (2, "See ghost.py."), (3, "src/a.py and ghost.py"), (4, "nothing"), (5, "insufficient evidence"), (6, "run go() at lines 2-4"), (7, "lines 2-9"), (8, "see src/größe.py"), (9, "see café/α.py")], "answer_id long, answer string")
    known = spark.createDataFrame([("repo/src/a.py",), ("repo/src/größe.py",)], ["path"])
    claims = answers.path_citations(said, known).union(answers.symbol_citations(said, spark.createDataFrame([("go",)], ["name"]))).union(answers.line_citations(said, spark.createDataFrame([(1, 5)], "start_line long, end_line long")))
    got = {r.answer_id: r.status for r in answers.statuses(said, claims).collect()}
    assert got == {1: "supported", 2: "contradicted", 3: "partially_supported", 4: "supported", 5: "insufficient_evidence", 6: "supported", 7: "contradicted", 8: "supported", 9: "contradicted"}


def test_context_stops_at_the_first_block_that_does_not_fit(spark):
    items = spark.createDataFrame([(1, 1, 100, 2400), (1, 2, 100, 9000), (1, 3, 50, 2000), (2, 1, 13_000, 1), (3, 1, 10, 10)], "query_id long, item long, header_chars long, text_chars long")
    got = {r.query_id: (r["items"], r.chars) for r in answers.context(items).collect()}
    assert got == {1: (3, 2500 + 2600 + 2050), 2: (0, 0), 3: (1, 20)}


def test_evidence_is_capped_by_file_before_the_stop(spark):
    ranked = spark.createDataFrame([("q", i, f"p{i // 3}") for i in range(1, 16)], "query_id string, rank int, path string")
    assert [r.rank for r in answers.select_evidence(ranked, F.lit(False)).orderBy("item").collect()] == [1, 2, 3, 4, 6, 7, 9, 10]


def test_diagram_ids_do_not_collide(spark):
    nodes = spark.createDataFrame([("a.b",), ("a-b",), ("1x",), ("..",)], ["node"])
    got = {r.node: r.id for r in reports.node_ids(nodes).collect()}
    assert got == {"a-b": "n_a_b", "a.b": "n_a_b_2", "1x": "n_1x", "..": "n_node"}


def test_queue_claims_due_and_expired_jobs(spark):
    df = spark.sql("""SELECT * FROM VALUES (1, 'queued', 0, TIMESTAMP_NTZ'2024-01-01 00:00:00', NULL), (2, 'queued', 3, TIMESTAMP_NTZ'2024-01-01 00:00:00', NULL), (3, 'queued', 0, TIMESTAMP_NTZ'2024-01-03 00:00:00', NULL),
      (4, 'running', 1, TIMESTAMP_NTZ'2024-01-01 00:00:00', TIMESTAMP_NTZ'2024-01-01 12:00:00'), (5, 'running', 1, TIMESTAMP_NTZ'2024-01-01 00:00:00', TIMESTAMP_NTZ'2024-01-02 12:00:00') AS t(job_id, status, attempts, available_at, lease_expires_at)""")
    now = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-02 00:00:00' AS now")
    assert sorted(r.job_id for r in jobs.claimable(df, now).collect()) == [1, 4]
    assert jobs.next_wake(df, now).first().seconds == 12 * 3600


def test_an_import_asks_for_one_name(spark):
    files = [("a/b.js",), ("a/b/index.js",), ("a/c/index.ts",), ("a/d",), ("a/d.tsx",), ("p/__init__.py",), ("q.py",), ("q/__init__.py",), ("r/__init__.java",), ("r/T.java",)]
    asked = [
        ("a/x.js", "JavaScript", "./b"), ("a/x.js", "JavaScript", "./c"), ("a/x.js", "JavaScript", ".//./d"), ("a/y/z.ts", "TypeScript", "../b/"), ("a/y/z.ts", "TypeScript", "../../../a/d"),
        ("m.py", "Python", "p"), ("m.py", "Python", "q"), ("M.java", "Java", "r"), ("M.java", "Java", "r.T.Inner"), ("M.java", "Java", "r.*"), ("a/x.js", "JavaScript", "b"),
    ]
    found = resolve.resolve_imports(spark.createDataFrame(asked, "path string, language string, target string"), spark.createDataFrame(files, "path string"))
    want = {("a/x.js", "a/b.js"), ("a/x.js", "a/c/index.ts"), ("a/x.js", "a/d"), ("a/y/z.ts", "a/b.js"), ("m.py", "p/__init__.py"), ("m.py", "q.py"), ("M.java", "r/T.java")}
    assert {(r.source, r.target) for r in found.collect()} == want
    assert "posexplode" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_counted_not_dealt_out(spark, sf):
    from millrace.plans import QUERIES

    assert "posexplode" not in QUERIES["symbol_at_line"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
