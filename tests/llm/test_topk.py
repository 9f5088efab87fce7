import math
import random
from fractions import Fraction

from pyspark.sql import functions as F

from millrace.llm import topk


def brute(rows, k=5, every=3):
    fits = [(i, [math.floor(Fraction(x) * 256) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, v) in enumerate(fits):
        if q % every == 0:
            scored = sorted(((-sum(a * b for a, b in zip(v, w)), i) for m, (i, w) in enumerate(fits) if m != n and len(w) == len(v)))
            out += [(q, r + 1, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows, kind="float", **options):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, norm string, rank int")
    return sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 3 == 0, **options).collect())


def test_many_blocks_norms_and_ties(spark, monkeypatch):
    monkeypatch.setattr(topk, "BUCKET_ROWS", 32)
    monkeypatch.setattr(topk, "QUERY_ROWS", 8)
    monkeypatch.setattr(topk, "CELL_QUERIES", 2)
    monkeypatch.setattr(topk, "CELL_BUCKETS", 2)
    rng = random.Random(7)
    rows = []
    for i in range(400):
        scale = rng.choice((0.1, 1.0, 1.0, 5.0, 40.0))
        v = [rng.choice((0.5, 0.25, 0.0)) * scale if i % 5 == 0 else rng.gauss(0, 1) * scale for _ in range(8)]
        rows.append((i, [float(F32(x)) for x in v], None, 1))
    rows += [(i + 1000, rows[i][1], None, 1) for i in range(60)]  # equal vectors: ties by id
    assert run(spark, rows) == brute([r[:2] for r in rows])


def F32(x):
    import numpy as np

    return np.float32(x)


def test_edge_cases(spark):
    rows = [(0, [1.0, 0.5], "x", 1), (3, None, "x", 1), (6, [1.0, None], None, 1), (9, [float("nan"), 1.0], None, 1), (12, [float("inf"), 1.0], "x", None), (None, [1.0, 1.0], "x", 1), (1, [0.0, 0.0], "x", 1),
            (2, [0.25, 0.25], "x", 1), (2, [0.25, 0.25], "x", 1), (15, [1.0, 2.0, 3.0], "x", 1), (18, [], "x", 1), (21, [0.0, 0.0], "x", 1), (4, [1e30, 1.0], "x", 1)]
    assert run(spark, rows) == brute([(r[0], r[1] and [x if x is None else float(F32(x)) for x in r[1]]) for r in rows])
    assert run(spark, []) == []


def test_coordinate_pruning_loses_nothing():
    import numpy as np

    rng = np.random.default_rng(1)
    c = np.floor(rng.normal(size=(500, 16)) * 256).astype(np.int64)
    q = np.floor((c[:20] + rng.normal(size=(20, 16)) * 5)).astype(np.int64)
    norms = np.linalg.norm(c, axis=1)
    order = np.argsort(-norms)
    c, norms = c[order], norms[order]
    scores = q @ c.T
    theta = np.sort(scores, axis=1)[:, -5].astype(float)
    queries = topk.Block(np.full(20, -1), np.full(20, -1), q / 256, np.linalg.norm(q, axis=1), 256.0)
    for i, places, found in topk.search_bucket(queries, theta, topk.Block(np.arange(500), np.arange(500), c / 256, norms, 256.0), 5):
        assert sorted(found.tolist(), reverse=True) == sorted(scores[i].tolist(), reverse=True)[:5]
        assert (scores[i][places] == found).all()


def test_length_pruning_multiplies_no_short_candidates(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    c = np.floor(rng.normal(size=(300, 16)) * np.geomspace(4000, 10, 300)[:, None])
    norms = np.linalg.norm(c, axis=1)
    order = np.argsort(-norms)
    c, norms = c[order], norms[order]
    q = np.floor(rng.normal(size=(10, 16)) * 100)
    block = topk.Block(np.arange(300), np.arange(300), c / 256, norms, 256.0)
    asks = topk.Block(np.full(10, -1), np.full(10, -1), q / 256, np.linalg.norm(q, axis=1), 256.0)
    scores = (q @ c.T).astype(int)
    theta = np.sort(scores, axis=1)[:, -5].astype(float)
    seen, whole = [], topk.products
    monkeypatch.setattr(topk, "products", lambda a, i, b, j: seen.append(len(j)) or whole(a, i, b, j))
    for i, places, found in topk.search_bucket(asks, theta, block, 5):
        assert sorted(found.tolist(), reverse=True) == sorted(scores[i].tolist(), reverse=True)[:5]
    assert max(seen) < 250


def test_vectors_of_any_finite_length(spark, monkeypatch):
    monkeypatch.setattr(topk, "BUCKET_ROWS", 4)
    monkeypatch.setattr(topk, "QUERY_ROWS", 2)
    rng = random.Random(3)
    size = lambda: rng.choice((1.0, 1e3, 1e8, 3e9, 1e15, 1e20, 1e155, 1e308))
    rows = [(i, [rng.uniform(-1, 1) * size() for _ in range(3)], None, 1) for i in range(60)]
    rows += [(100, [1e8, 0.0], None, 1), (102, [1.0, 1.0], None, 1), (102, [1e8, 0.0], None, 1), (103, [-1e8, 0.0], None, 1), (105, [1e300, 1e300], None, 1), (108, [-1e300, -1e299], None, 1)]
    assert run(spark, rows, "double") == brute([r[:2] for r in rows])
