import random
import re
from collections import Counter

import numpy as np
import pytest

from millrace.llm import phrases
from millrace.llm.queries import op11_phrase_collocations

NAMES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def grams_of(rows):
    grams = {}
    for lang, text in rows:
        counts = grams.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            for k in range(1, 6):
                counts.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return grams


def brute(rows, least, most=2000):
    out = []
    for lang, f in grams_of(rows).items():
        n = sum(v for g, v in f.items() if len(g) == 1)
        candidates = [g for g, v in f.items() if len(g) > 1 and v >= least]
        covered = {g[i : i + k] for g in candidates for k in range(2, len(g)) for i in range(len(g) - k + 1) if f[g] >= f[g[i : i + k]]}
        found = []
        for g in candidates:
            if g not in covered:
                score, k = min((1000 * f[g] * n // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
                found.append((-score, -f[g], " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*NAMES).collect())


def made(seed, size, vocabulary=8):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["É", "中文", "It's", "a\x85b", "-"]
    passage = "the Same line of words that comes back again and again"
    rows = []
    for _ in range(size):
        parts = [rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r"]) for _ in range(rng.randrange(60))]
        if rng.random() < 0.5:
            parts.insert(rng.randrange(len(parts) + 1), passage + " ")
        rows.append((rng.choice(["en", "en", "fr", None, "und"]), "".join(parts)))
    return rows + [("en", None), (None, ""), ("fr", ".,;"), ("en", "x " * 3000), ("en", "x " * 3000)]


@pytest.mark.parametrize("least,limits", [(20, {}), (7, {"BITS": 6, "BUCKETS": 8, "GRAMS": 30}), (9, {"ROW": 16, "HELD": 40, "BLOCK": 30})])
def test_equals_brute_force(spark, monkeypatch, least, limits):
    for name, value in limits.items():
        monkeypatch.setattr(phrases, name, value)
    rows = made(least, 150)
    got = phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), least)
    assert rows_of(got) == brute(rows, least)


def test_ranks_and_query(spark, tmp_path):
    rows = made(3, 700, 5)
    docs = spark.createDataFrame([(i, *r, 1) for i, r in enumerate(rows)], "doc_id long, lang string, text string, words int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert rows_of(op11_phrase_collocations(spark, str(tmp_path))) == brute(rows, 100)
    assert rows_of(phrases.collocations(docs, 30, most=5)) == brute(rows, 30, 5)
    assert phrases.collocations(docs.where("false")).count() == 0 and phrases.collocations(docs.limit(3), 50).count() == 0


def test_another_seed_where_words_clash(spark, monkeypatch):
    from pyspark.sql import functions as F

    real, seeds = phrases._words, []

    def words(docs, seed):
        seeds.append(seed)
        found = real(docs, seed)
        return found.withColumn("id", F.when(F.col("word").isin("w1", "w2"), 7).otherwise(F.col("id"))) if seed == 42 else found

    monkeypatch.setattr(phrases, "_words", words)
    rows = made(4, 100)
    assert rows_of(phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), 20)) == brute(rows, 20)
    assert seeds == [42, 43]


def test_scores_beyond_64_bits(spark):
    df = spark.sql("SELECT 4000000000000L AS a, 5000000000000L AS l, 6000000000000L AS r, 9000000000000L AS n")
    assert df.selectExpr("(cast(a AS decimal(19,0)) * 1000 * n) div (cast(l AS decimal(19,0)) * r) AS s").first().s == 1000 * 4 * 9 // (5 * 6)


def test_unary_paths(spark):
    names = ["lang", *(f"w{i}" for i in range(1, 6))]
    long = list(range(10, 40))
    texts = [long] * 5 + [[1, 2, 3, 4, 5, 6, 7]] * 3 + [[9, 2, 3, 4, 5, 6, 8]] * 2
    counts = Counter((1, *(t[i : i + 5] + [0] * 5)[:5]) for t in texts for i in range(len(t)))
    edges = spark.createDataFrame([(*k, v) for k, v in counts.items()], ", ".join(f"{c} long" for c in [*names, "f"]))
    got = {tuple(r.words): r.f for r in phrases.unary_paths(edges, 2).collect()}
    assert got == {tuple(long): 5, (1, 2, 3, 4, 5): 3, (2, 3, 4, 5, 6): 5, (3, 4, 5, 6, 7): 3, (9, 2, 3, 4, 5): 2, (3, 4, 5, 6, 8): 2}


def test_rows_of_one_hash_are_told_apart(monkeypatch):
    rows = np.array([[1, 2], [3, 4], [1, 2], [5, 6]])
    monkeypatch.setattr(phrases, "_mixed", lambda parts: np.zeros(len(parts[0]), np.uint64))
    found, counts = phrases._distinct(rows, np.array([1, 1, 1, 1]))
    assert dict(zip(map(tuple, found.tolist()), counts.tolist())) == {(1, 2): 2, (3, 4): 1, (5, 6): 1}
    monkeypatch.undo()
    found, counts = phrases._distinct(rows, np.array([5, 1, 7, 1]))
    assert dict(zip(map(tuple, found.tolist()), counts.tolist())) == {(1, 2): 12, (3, 4): 1, (5, 6): 1}


def test_slices_keep_all_rows(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(phrases, "SLICE", 5)
    lists = [[1, 2, 3], [], [4] * 9, [5], [6, 7], [8]]
    batch = pa.record_batch([pa.array(range(6), pa.int64()), pa.array([len(x) for x in lists], pa.int32()), pa.array(lists, pa.list_(pa.int64()))], names=["lang", "own", "ids"]).slice(1)
    parts = list(phrases._slices(iter([batch])))
    assert [r for p in parts for r in p.column(2).to_pylist()] == lists[1:] and len(parts) > 2
    lang, word, starts = phrases._flat(parts[0])
    assert word[starts].tolist() == [w for r in parts[0].column(2).to_pylist() for w in r] and len(lang) == len(word)


def test_very_long_and_clashing(spark):
    text = "one two three four five six " * 60_000 + "seven" * 100_000
    docs = spark.createDataFrame([(1, "en", text, "a", 2)], "doc_id long, lang string, text string, w1 string, f int")
    assert rows_of(phrases.collocations(docs, 50_000)) == brute([("en", text)], 50_000)
