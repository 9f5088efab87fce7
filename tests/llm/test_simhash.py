import random

import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import simhash
from millrace.llm.queries import op1_simhash_near_dedup

DOC = "doc_id long, text string, source string, fp string, component_id int"
CLASHING = "doc_id long, text string, gone string, _gone string, cls long, node long, first string, uid string, `a.b` string"


def brute_fingerprint(text, size=3):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """{row place: smallest id reachable} from (id, fingerprint)."""
    label = {f: f for _, f in rows}
    changed = True
    while changed:
        changed = False
        for a in label:
            for b in label:
                if (a ^ b).bit_count() <= 2 and label[b] < label[a]:
                    label[a], changed = label[b], True
    least = {}
    for i, f in rows:
        if i is not None:
            least[label[f]] = min(i, least.get(label[f], i))
    return [least.get(label[f]) for _, f in rows]


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = [(d.doc_id, brute_fingerprint(d.text)) for d in docs]
    want = sorted((i, f"{f:016x}", c) for (i, f), c in zip(rows, brute_components(rows)))
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in op1_simhash_near_dedup(spark, sf).collect()) == want


@pytest.mark.parametrize("segments, crowd", [(2, 64), (2, 3), (4, 64), (4, 5)])
def test_links_connect_all_within_two_bits(spark, segments, crowd):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = set(base)
    for b in base:
        for _ in range(20):
            f = b
            for bit in rng.sample(range(64), rng.choice((1, 2, 3))):
                f ^= 1 << bit
            fps.add(f)
    rows = [(i, f) for i, f in enumerate(sorted(fps))]
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in rows]
    from millrace.llm.graph import components

    found = components(simhash.links(spark.createDataFrame(signed, "id long, fp long"), 2, segments, crowd))
    root = {r.node: r.component for r in found.collect()}
    groups = {}
    for (i, s) in signed:
        groups.setdefault(root.get(s, s), set()).add(i)
    want = {}
    for (i, _), c in zip(rows, brute_components(rows)):
        want.setdefault(c, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_edge_cases(spark):
    rows = [(1, None, None, "x", 7), (2, "", None, None, None), (3, " \t\n", "s", "y", 1), (4, "One Two", "s", "y", 1), (4, "one two", "s", "y", 1), (None, "one two", "s", "y", 1), (9, "a b " * 60_000, "s", "y", 2)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOC)).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 4), (None, 4), (9, 9)}
    assert {r.fingerprint for r in got if r.component_id == 1} == {"0" * 16}
    assert simhash.near_duplicates(spark.createDataFrame([], DOC)).count() == 0


def test_words_across_blocks_make_the_same_fingerprint(monkeypatch):
    text = " ".join(f"w{i % 37}x{i % 11}" for i in range(3000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr("millrace.llm.words.BLOCK", 64)
    assert simhash.fingerprint(text) == whole == (lambda f: f - (1 << 64) if f >> 63 else f)(brute_fingerprint(text))


def _varied(rng, words, share):
    return [rng.choice("abcdefgh") * 5 + str(rng.random()) if rng.random() < share else w for w in words]


def _jaccard(a, b, size=5):
    s, t = ({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} for w in (a, b))
    return len(s & t) / len(s | t)


def test_similar_documents_finds_copies_and_leaves_others(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(800)]
    originals = [[rng.choice(vocabulary[: 30] if rng.random() < 0.4 else vocabulary) for _ in range(250)] for _ in range(60)]
    rows, near = [], []
    for i, words in enumerate(originals):
        rows.append((i, " ".join(words)))
        for k in range(3):
            copy = _varied(rng, words, 0.012)
            rows.append((1000 + 10 * i + k, " ".join(copy)))
            if _jaccard(words, copy) >= 0.8:
                near.append((i, 1000 + 10 * i + k))
    crowd = originals[0]
    rows += [(5000 + k, " ".join(_varied(rng, crowd, 0.004))) for k in range(700)]  # one crowded group: blocks, not pairs
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[a] == got[b] for a, b in near) >= 0.95 * len(near)
    assert sum(got[5000 + k] == 0 for k in range(700)) >= 690
    assert [got[i] for i in range(60)] == list(range(60))


def test_keep_one_keeps_rows_and_columns(spark):
    rows = [(1, "a b c d e f g", "s", "x", 1), (2, "a b c d e f g", "s", "x", 2), (2, "a b c d e f g", "s", "x", 2), (3, "other words are in here now", None, None, None), (None, "a b c d e f g", "s", "x", 3)]
    kept = simhash.keep_one(spark.createDataFrame(rows, DOC))
    assert kept.columns == ["doc_id", "text", "source", "fp", "component_id"]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 3), (True, 0)]
    assert simhash.keep_one(spark.createDataFrame([], DOC)).count() == 0


def test_clashing_names(spark):
    rows = [(i, t, "g", "h", 1, 2, "f", "u", "ab") for i, t in ((1, "a b c d e f g"), (2, "a b c d e f g"), (3, "others"))]
    docs = spark.createDataFrame(rows, CLASHING)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
    assert sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()) == [(1, 1), (2, 1), (3, 3)]


def test_links_within_one_bit(spark):
    rng = random.Random(7)
    fps = {rng.getrandbits(63) for _ in range(5)}
    for f in list(fps):
        fps |= {f ^ 1 << rng.randrange(63) for _ in range(20)}
    for crowd in (64, 3):
        got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), 1, 2, crowd).collect()}
        assert {frozenset(p) for p in got} == {frozenset((a, b)) for a in fps for b in fps if (a ^ b).bit_count() == 1}


def test_similar_documents_whatever_the_edit(spark):
    rng = random.Random(3)
    rows, near, far = [], [], []
    for i in range(150):
        words = [f"w{rng.randrange(3000)}x" for _ in range(300)]
        extra = [f"v{rng.randrange(3000)}x" for _ in range(300)]
        n = rng.randint(30, 70)
        edits = [words + extra[:n], words[: -n * 4 // 5], words[n:] + words[:n], words[:100] + extra[: n * 4 // 5] + words[100:], words + extra[: n + 40]]
        rows.append((i, " ".join(words)))
        for k, copy in enumerate(edits):
            rows.append((1000 + 10 * i + k, " ".join(copy)))
            (near if _jaccard(words, copy) >= 0.8 else far).append((i, 1000 + 10 * i + k))
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(near) > 500 and len(far) > 100
    assert all(got[a] == got[b] for a, b in near)
    assert [got[i] for i in range(150)] == list(range(150))


def test_texts_below_the_line_are_left_alone(spark):
    rng = random.Random(8)
    rows, want = [], []
    for i in range(120):
        words, extra = ([f"{c}{i}x{k}" for k in range(304)] for c in "wv")
        n = rng.choice((76, 80, 90, 100)) - (i % 2) * 20  # 300 shingles of 300 + n: 0.8 at 75
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words + extra[:n]))]
        want.append(2 * i if 300 / (300 + n) >= 0.8 else 2 * i + 1)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[2 * i + 1] for i in range(120)] == want


def test_large_buckets_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 16)
    rng = random.Random(6)
    base = [f"w{k}" for k in range(200)]
    texts = []
    for _ in range(120):
        copy = list(base)
        for at in rng.sample(range(200), rng.randint(3, 6)):
            copy[at] = f"v{rng.random()}"
        texts.append(copy)
    label = list(range(len(texts)))
    for _ in range(8):
        for i in range(len(texts)):
            label[i] = min(label[j] for j in range(len(texts)) if i == j or _jaccard(texts[i], texts[j]) >= 0.8)
            label[i] = label[label[i]]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == label


def test_sets_are_written_only_where_they_are_compared(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(400)) for _ in range(200)]
    texts += [texts[0] + " more words at the end", texts[0]]
    written = {}

    def seen(df, name):
        written[name] = settle(df, name)
        return written[name]

    settle = simhash.settle
    monkeypatch.setattr(simhash, "settle", seen)
    monkeypatch.setattr(simhash, "discard", lambda table: None)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [d for d, c in got.items() if d != c] == [200, 201] and got[200] == got[201] == 0
    assert "shingles" not in written["wide-fingerprints"].columns
    assert written["shingle-sets"].count() == 2


def test_candidates_come_from_segments_of_the_fingerprint(spark, monkeypatch):
    rng = random.Random(9)
    rows, written = [], {}
    for i in range(150):
        words = [f"w{i}x{rng.randrange(10**6)}" for _ in range(rng.choice((8, 14, 40, 300)))]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words + [f"v{i}x{k}" for k in range((len(words) - 4) // 4)]))]  # Jaccard 0.8 or just above

    def seen(df, name):
        written.setdefault(name, settle(df, name))
        return written[name]

    settle = simhash.settle
    monkeypatch.setattr(simhash, "settle", seen)
    monkeypatch.setattr(simhash, "ROUND", 1000)
    monkeypatch.setattr(simhash, "discard", lambda table: None)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d - d % 2 for d, _ in rows}
    index = {r.cls: r for r in written["segment-index"].collect()}
    for r in index.values():
        assert r.spots[:8] == [w >> 16 * k & 0xFFFF for w in (r.s0, r.s1) for k in range(4)]
    pairs = written["segment-meetings"].where("point is null").collect()
    assert len(pairs) >= 150
    for r in pairs:
        a, b = index[r.a], index[r.b]
        reach = 2 if max(a.size, b.size) < 20 else 0  # balls of radius one meet
        assert min((x ^ y).bit_count() for x, y in zip(a.spots, b.spots)) <= reach


def test_pairs_of_a_family_are_not_listed(spark, monkeypatch):
    rng = random.Random(12)
    base = [f"w{k}" for k in range(150)]
    listed = {}
    settle = simhash.settle

    def seen(df, name):
        written = settle(df, name)
        listed[name] = listed.get(name, 0) + (written.where("point is null") if name == "segment-meetings" else written).count()
        return written

    monkeypatch.setattr(simhash, "settle", seen)
    for size in (300, 900):
        texts = []
        for _ in range(size):
            copy = list(base)
            for at in rng.sample(range(150), rng.randint(1, 6)):
                copy[at] = f"v{rng.random()}"
            texts.append(copy)
        sets = [{tuple(t[i : i + 5]) for i in range(146)} for t in texts]
        label = list(range(size))
        links = [(i, j) for i in range(size) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
        for _ in range(8):
            for i, j in links:
                label[i] = label[j] = min(label[i], label[j])
        listed.clear()
        docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
        got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
        assert [got[i] for i in range(size)] == label
        assert len(set(label)) > 1  # some are linked with none
        assert listed["maybe-links"] <= 40 * size and listed["segment-meetings"] <= 40 * size, (size, listed)


@pytest.mark.parametrize("sizes, others", [([3, 1, 4], [2, 5]), ([1], [1])])
def test_overlaps(sizes, others):
    import numpy as np

    rng = random.Random(2)
    left, right = ([sorted(rng.sample(range(8), n)) for n in ns] for ns in (sizes, others))
    flat = lambda sets: np.array(sum(sets, []), np.uint64).tobytes()
    both = simhash._overlaps(flat(left), np.array(sizes), flat(right), np.array(others))
    assert [both(i).tolist() for i in range(len(left))] == [[len(set(a) & set(b)) for b in right] for a in left]
