import random

import numpy as np

from millrace.llm import toxicity

DOC = "doc_id long, text string, p_toxic string, words int"
BAD = ["grump", "sneer", "spite", "scorn"]


def corpus(n, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(n):
        junk, toxic = i % 7 == 0, i % 9 == 0
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        if junk:
            words += ["click"] * 3 + ["here"]
        if toxic:
            words[3:3] = rng.sample(BAD, 2)
        rows.append((i, " ".join(words), None, 1))
        labels.append((i, int(not junk), int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus(1500)
    docs = spark.createDataFrame(rows, DOC)
    known = spark.createDataFrame(labels[:900], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(docs, known)
    scored = toxicity.score(docs, chain).collect()
    assert [f for f in scored[0].asDict()] == ["doc_id", "text", "words", "p_quality", "p_toxic"]
    truth = {i: (q, t) for i, q, t in labels}
    rest = [r for r in scored if r.doc_id >= 900]
    assert np.mean([(r.p_toxic >= chain.thresholds['toxic']) == bool(truth[r.doc_id][1]) for r in rest]) >= 0.98
    assert np.mean([(r.p_quality >= 0.5) == bool(truth[r.doc_id][0]) for r in rest]) >= 0.98


def test_held_out_accuracy_on_the_tables(spark, sf):
    folder = sf.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    train, test = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0")
    chain = toxicity.fit(docs, train)
    scored = toxicity.score(docs, chain).join(test, "doc_id").collect()
    assert np.mean([(r.p_toxic >= chain.thresholds["toxic"]) == bool(r.toxic) for r in scored]) >= 0.97


def test_later_models_see_earlier_probabilities(spark):
    rows, labels = corpus(600)
    docs = spark.createDataFrame(rows, DOC)
    known = spark.createDataFrame([(i, t, t) for i, _, t in labels], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(docs, known)
    assert chain.models[0].before.shape == (0,) and chain.models[1].before.shape == (1,) and chain.models[1].before[0] > 0.1


def test_edge_cases(spark):
    rows = [(1, None, "x", 1), (2, "", "x", None), (None, "word", None, 1), (4, "x " * 400_000, "y", 1), (5, "same", "z", 1), (5, "same", "z", 1)]
    docs = spark.createDataFrame(rows, DOC)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, none)).collect()
    assert len(out) == 6 and all(r.p_toxic < 0.01 for r in out)
    odd = spark.createDataFrame([(1, None, 0), (5, 1, None), (5, 0, 0), (None, 1, 1), (99, 1, 1)], none.schema)
    assert len(toxicity.score(docs, toxicity.fit(docs, odd)).collect()) == 6
    one = spark.createDataFrame([(5, 1, 0)], none.schema)
    assert all(r.p_toxic < 0.5 for r in toxicity.score(docs, toxicity.fit(docs, one)).collect())
    empty = spark.createDataFrame([], DOC)
    assert toxicity.score(empty, toxicity.fit(empty, none)).count() == 0


def dense_logistic(x, y, prior):
    """Newton's method with the whole Hessian, the last column of ``x`` without prior."""
    theta, penalty = np.zeros(x.shape[1]), np.array([prior] * (x.shape[1] - 1) + [0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ theta))
        theta = theta - np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(penalty), x.T @ (p - y) + penalty * theta)
    return theta


def test_chain_equals_brute_force(spark):
    rows, labels = corpus(240, seed=3)
    labels[5] = (5, None, 1)
    labels[7] = (7, 1, None)
    docs, known = spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = toxicity.fit(docs, known, min_docs=30, vocabulary=60)
    own = {}
    for _, text, _, _ in rows:
        words = set(text.lower().split())
        for w in words | {"^" + w[:k] for w in words for k in (4, 5) if len(w) > k}:
            own[w] = own.get(w, 0) + 1
    vocabulary = [w for w, n in sorted(own.items(), key=lambda p: (-p[1], p[0])) if n >= 30][:60]
    assert sorted(chain.vocabulary, key=chain.vocabulary.get) == vocabulary
    held = np.array([[float(w in text.split() or w[0] == "^" and any(v.startswith(w[1:]) and len(v) > len(w) - 1 for v in text.split())) for w in vocabulary] for _, text, _, _ in rows])
    fold = np.random.default_rng(0).permutation(240) % 3
    before = np.zeros((240, 0))
    for c, model in zip((1, 2), chain.models):
        y = np.array([np.nan if l[c] is None else l[c] for l in labels], float)
        x = np.column_stack((held, before, np.ones(240)))
        fits = lambda use: dense_logistic(x[use], y[use], toxicity.PRIOR)  # noqa: B023, E731
        theta = fits(~np.isnan(y))
        assert np.abs(np.concatenate((model.words, model.before, [model.bias])) - theta).max() < 1e-3
        p = np.zeros(240)
        for f in range(3):
            p[fold == f] = 1 / (1 + np.exp(-x[fold == f] @ fits(~np.isnan(y) & (fold != f))))
        ok = ~np.isnan(y)
        cuts = sorted(set(p[ok]), reverse=True)
        f1 = [2 * ((p[ok] >= t) & (y[ok] == 1)).sum() / ((p[ok] >= t).sum() + y[ok].sum()) for t in cuts]
        assert (2 * ((p[ok] >= chain.thresholds[("quality", "toxic")[c - 1]]) & (y[ok] == 1)).sum() / ((p[ok] >= chain.thresholds[("quality", "toxic")[c - 1]]).sum() + y[ok].sum())) >= max(f1) - 1e-6
        odds = np.log(np.clip(p, 1e-4, 1 - 1e-4) / (1 - np.clip(p, 1e-4, 1 - 1e-4)))
        before = np.column_stack((before, odds))
    scored = {r.doc_id: r for r in toxicity.score(docs, chain).collect()}
    for i, (doc_id, *_) in enumerate(rows[:40]):
        odds = held[i] @ chain.models[0].words + chain.models[0].bias
        assert abs(scored[doc_id].p_quality - 1 / (1 + np.exp(-odds))) < 1e-9


def test_best_threshold_with_ties():
    p, y = np.array([0.9, 0.5, 0.5, 0.5, 0.1]), np.array([1.0, 1.0, 0.0, 1.0, 0.0])
    assert toxicity.best_threshold(p, y) == 0.3  # the three of one half stand together
    assert toxicity.best_threshold(np.array([0.4, 0.4]), np.array([1.0, 0.0])) == 0.2
    assert toxicity.best_threshold(np.zeros(3), np.zeros(3)) == 0.5


def test_rows_that_repeat_a_labelled_id_count_once(spark):
    rows, labels = corpus(60)
    docs = spark.createDataFrame(rows + [(0, f"other {k}", None, 1) for k in range(500)], DOC)
    chain = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert "other" not in chain.vocabulary


def test_clashing_names(spark):
    rows, labels = corpus(60)
    names = ["id", "words", "y0", "p_quality", "count", "a.b"]
    docs = spark.createDataFrame([(i, t, *"uvwxyz") for i, t, _, _ in rows], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    out = toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert out.columns == ["doc_id", "text", "id", "words", "y0", "count", "a.b", "p_quality", "p_toxic"] and out.count() == 60


def newton(x, y):
    """As ``dense_logistic``, through the n by n system of the rows: weights are sums of rows."""
    kernel, n = x[:, :-1] @ x[:, :-1].T / toxicity.PRIOR, len(y)
    alpha, bias = np.zeros(n), np.log(y.mean() / (1 - y.mean()))
    for _ in range(100):
        p = 1 / (1 + np.exp(-(kernel @ alpha + bias)))
        w = np.maximum(p * (1 - p), 1e-12)
        # the optimum has alpha = y - p and sum(alpha) = 0
        system = np.block([[np.diag(1 / w) + kernel, np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
        target = np.concatenate((kernel @ alpha + bias + (y - p) / w, [0.0]))
        found = np.linalg.solve(system, target)
        moved = np.abs(found[:-1] - alpha).max() + abs(found[-1] - bias)
        alpha, bias = found[:-1], found[-1]
        if moved < 1e-10:
            break
    return np.concatenate((x[:, :-1].T @ alpha / toxicity.PRIOR, [bias]))


def test_query_equals_brute_force(spark, sf):
    import re

    from millrace.llm.queries import op3_toxicity

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    labels = sorted(tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect())
    labels = [row for row in labels if row[0] in docs]

    def held(text):
        words = set(re.findall(r"\w+", text.lower()))
        return words | {"^" + w[:k] for w in words for k in (4, 5) if len(w) > k}

    counts = {}
    for i, *_ in labels:
        for w in held(docs[i]):
            counts[w] = counts.get(w, 0) + 1
    place = {w: i for i, w in enumerate(sorted(w for w, n in counts.items() if n >= toxicity.MIN_DOCS))}
    assert len(place) < toxicity.VOCABULARY

    def matrix(texts):
        x = np.zeros((len(texts), len(place)))
        for i, t in enumerate(texts):
            x[i, [place[w] for w in held(t) if w in place]] = 1
        return x

    x, every = matrix([docs[i] for i, *_ in labels]), matrix(list(docs.values()))
    fold = np.random.default_rng(0).permutation(len(labels)) % toxicity.FOLDS
    before, later, cut = np.zeros((len(labels), 0)), np.zeros((len(docs), 0)), {}
    sure = lambda z: 1 / (1 + np.exp(-z))
    odds = lambda p: np.log(np.clip(p, 1e-4, 1 - 1e-4) / (1 - np.clip(p, 1e-4, 1 - 1e-4)))
    for c, name in ((1, "quality"), (2, "toxic")):
        y = np.array([row[c] for row in labels], float)
        with_ones = np.column_stack((x, before, np.ones(len(y))))
        p = np.zeros(len(y))
        for f in range(toxicity.FOLDS):
            p[fold == f] = sure(with_ones[fold == f] @ newton(with_ones[fold != f], y[fold != f]))
        whole = sure(np.column_stack((every, later, np.ones(len(docs)))) @ newton(with_ones, y))
        f1 = {t: 2 * ((p >= t) & (y == 1)).sum() / ((p >= t).sum() + y.sum()) for t in sorted(set(p), reverse=True)}
        top = max(f1, key=f1.get)
        cut[name] = ((top + max((t for t in f1 if t < top), default=0.0)) / 2, whole)
        before, later = np.column_stack((before, odds(p))), np.column_stack((later, odds(whole)))
    got = {r.doc_id: r for r in op3_toxicity(spark, sf).collect()}
    assert set(got) == set(docs)
    for k, i in enumerate(docs):
        assert abs(got[i].p_quality - cut["quality"][1][k]) < 2e-3 and abs(got[i].p_toxic - cut["toxic"][1][k]) < 2e-3
        if abs(cut["toxic"][1][k] - cut["toxic"][0]) > 5e-3:
            assert got[i].rejected == (cut["toxic"][1][k] >= cut["toxic"][0])
