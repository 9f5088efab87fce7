import numpy as np

from millrace.llm import vectorgraph
from millrace.llm.queries import op10_embedding_near_dedup


def brute(rows, threshold=0.9):
    out = {k: (i, 0, i, True) for k, (i, _) in enumerate(rows)}
    sound = [k for k, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for dim in {len(rows[k][1]) for k in sound}:
        ok = [k for k in sound if len(rows[k][1]) == dim]
        x = np.array([rows[k][1] for k in ok])
        x = x / np.abs(x).max(axis=1, keepdims=True)
        near = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1)) >= threshold
        label = np.array([rows[k][0] for k in ok])
        while True:
            new = np.where(near, label[None, :], label[:, None]).min(axis=1)
            if (new == label).all():
                break
            label = new
        for a, k in enumerate(ok):
            out[k] = (rows[k][0], int(near[a].sum()) - 1, int(label[a]), bool(label[a] == rows[k][0]))
    return sorted(out.values(), key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, cls int, component string")
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectorgraph.near_duplicates(df, **options).collect()), key=str)


def clustered(seed, n, dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if i % 3 and rows:
            base = np.array(rows[rng.integers(max(0, len(rows) - 40), len(rows))][1])
            rows.append((i, [float(np.float32(v)) for v in base + rng.normal(size=dim) * 0.06]))
        else:
            rows.append((i, [float(np.float32(v)) for v in rng.normal(size=dim)]))
    return rows


def test_recall_against_brute_force_over_many_shards(spark):
    rows = clustered(1, 1500)
    got, want = run(spark, rows, shard_rows=200), brute(rows)
    links, there = sum(r[1] for r in got), sum(r[1] for r in want)
    assert there > 500 and 0.97 * there <= links <= there
    assert sum(a == b for a, b in zip(got, want)) >= 0.95 * len(rows)


def test_a_hot_group_of_equal_and_close_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=16)
    rows = [(i, [float(np.float32(v)) for v in base]) for i in range(300)] + [(1000 + i, [float(np.float32(v)) for v in base + rng.normal(size=16) * 0.01]) for i in range(500)]
    assert run(spark, rows, shard_rows=100) == brute(rows)


def test_query_equals_brute_force(spark, sf):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = op10_embedding_near_dedup(spark, sf).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=str) == brute(rows)


def test_edge_cases(spark):
    rows = [(1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [1.0, 0.0]), (6, [2.0, 0.0]), (6, [2.0, 0.0]), (7, [1.0, 0.4843]), (8, [1.0, 2.0, 3.0]), (11, [1.0, 2.0, 3.1]), (12, [1e200, 1e190]), (13, [1e-300, 1e-301]), (14, [1.0, 1e-9]), (None, [1.0, 0.0]), (9, []), (10, [-1.0, 0.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == [(1, 0, 1, True)]


def groups_of_near_copies(groups, size, others, dim=64):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(groups, dim))
    x = np.concatenate((np.repeat(centres, size, axis=0) + rng.normal(size=(groups * size, dim)) * 0.05, rng.normal(size=(others, dim))))
    return [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(x[rng.permutation(len(x))])]


def test_several_groups_of_near_copies_in_one_shard(spark):
    for groups, size, others in ((10, 100, 0), (10, 100, 100), (20, 60, 300)):
        rows = groups_of_near_copies(groups, size, others)
        x = vectorgraph.unit_rows(np.array([v for _, v in rows]))
        want = ((x @ x.T) >= 0.9).sum(axis=1) - 1
        got = run(spark, rows, least_recall=0.0)  # the first build
        assert {i: n for i, n, _, _ in got} == dict(enumerate(want.tolist()))


def test_audit_below_its_bound_ends_in_an_exact_search(spark, monkeypatch):
    monkeypatch.setattr(vectorgraph, "search", lambda x, neighbours, starts, q, least, beam: (np.empty(0, int), np.empty(0, int)))
    rows = clustered(3, 300)
    assert run(spark, rows, shard_rows=100) == brute(rows)


def test_rare_links_are_measured_and_a_search_that_misses_them_is_noticed(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(2000, 32)))]
    assert {r.audit_recall for r in vectorgraph.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()} == {None}
    rows[700] = (700, [x * 1.001 + 0.001 for x in rows[3][1]])
    monkeypatch.setattr(vectorgraph, "search", lambda x, neighbours, starts, q, least, beam: (np.empty(0, int), np.empty(0, int)))
    classes = spark.createDataFrame([(i, v, 1) for i, v in rows], "cls long, v array<double>, copies long")
    nothing = spark.createDataFrame([], "cls long, links long")
    assert vectorgraph.audit(classes, nothing) == 0.0 and vectorgraph.audit(classes, nothing, most=1) is None
    assert run(spark, rows) == brute(rows)


def test_doubles_are_compared_as_doubles(spark):
    # cosines that differ from the threshold by less than single precision tells
    angle = np.arccos(0.9)
    rows = [(i, [float(np.cos(angle + d)), float(np.sin(angle + d))]) for i, d in enumerate((-1e-9, 1e-9, -1e-10, 1e-10))] + [(9, [1.0, 0.0])]
    got = {i: n for i, n, _, _ in run(spark, rows)}
    assert got[9] == 2 and brute(rows) == run(spark, rows)


def test_default_shards_over_many_vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(900, 32))
    x = centres[rng.integers(0, 900, 6000)] + rng.normal(size=(6000, 32)) * rng.choice((0.1, 0.25, 0.35), (6000, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = {r[0]: r for r in run(spark, rows, least_recall=0.0)}, {r[0]: r for r in brute(rows)}
    shares = [got[i][1] / want[i][1] for i in want if want[i][1]]
    assert len(shares) > 1000 and np.mean(shares) >= 0.97 and max(shares) <= 1
    assert sum(got[i][2] == want[i][2] for i in want) >= 0.97 * len(rows)


def test_cells_are_cut_level_by_level(spark, monkeypatch):
    monkeypatch.setattr(vectorgraph, "BRANCH", 4)
    rows = clustered(5, 1500)
    got, want = run(spark, rows, shard_rows=60, least_recall=0.0), brute(rows)
    there = sum(r[1] for r in want)
    assert 0.95 * there <= sum(r[1] for r in got) <= there
