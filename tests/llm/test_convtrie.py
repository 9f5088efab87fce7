import hashlib
import zlib

import numpy as np
import pytest

from millrace.llm import convtrie
from millrace.llm.queries import op13_conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def ordered(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(turns)] for c, turns in convs.items()}


def rebuilt(convs):
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in convs}
    return {c: convs.get(c - c % 5, [])[: h[c]] + turns[h[c] :] for c, turns in convs.items()}


def brute(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        under = [p for p in nodes if p[: len(path)] == path]
        children = sum(len(p) == len(path) + 1 for p in under)
        leaves = sum(not any(q[: len(p)] == p and len(q) == len(p) + 1 for q in under) for p in under)
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in under if p)
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(path))))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


ROWS = [
    (1, 0, "user", "hi"), (1, 1, "bot", "hello"), (2, 0, "user", "hi"), (2, 1, "bot", "hello"), (2, 2, "user", "more é"),
    (3, None, None, "first"), (3, 0, "user", None), (3, 0, "user", None), (3, 0, "bot", "tie"), (None, 0, "user", "nobody"),
    (5, 0, "user", "hi"), (6, 7, "user", "a"), (6, 8, "user", "b"), (7, 0, "user", "x"), (8, 0, "userx", ""), (9, 0, "user", "x"), (-4, 0, "user", "hi"),
] + [(20 + i, 0, "user", "hi") for i in range(30)]


def test_small_cases_equal_brute_force(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = convtrie.prefix_trie(df)
    assert rows_of(got) == brute(ordered(ROWS))
    texts = {(r.conv_id, r.depth): (r.role, r.text) for r in convtrie.with_texts(got, df).collect()}
    convs = ordered(ROWS)
    assert all(texts[c, d] == (convs[c][d - 1] if d else (None, None)) for c, d in texts)


def test_long_and_hot_conversations(spark, monkeypatch):
    monkeypatch.setattr(convtrie, "BLOCK", 7)
    monkeypatch.setattr(convtrie, "LEAST", 10)
    monkeypatch.setattr(convtrie, "PARTS", 20)
    monkeypatch.setattr(convtrie, "BAND", 16)
    monkeypatch.setattr(convtrie, "TOP_NODES", 20)
    rows = [(1, i, "user", f"t{i}") for i in range(150)] + [(2, i, "user", f"t{i}") for i in range(100)] + [(3, i, "user", "same") for i in range(60)]
    rows += [(100 + i, t, "user", f"t{t}" if t < i % 5 else f"{i} {t}") for i in range(80) for t in range(4)] + [(4, 1, "user", "again")] * 40
    assert rows_of(convtrie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(ordered(rows))


def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(op13_conversation_trie(spark, sf)) == brute(rebuilt(ordered(rows)))


def test_query_rebuilds_small_cases(spark, tmp_path):
    rows = [r for r in ROWS if r[0] is None or r[0] >= 0]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert rows_of(op13_conversation_trie(spark, str(tmp_path))) == brute(rebuilt(ordered(rows)))


def test_very_long_texts(spark):
    rows = [(1, 0, "user", "x" * 2_000_000), (2, 0, "user", "x" * 2_000_000), (3, 0, "user", "x" * 1_999_999 + "y"), (4, 0, "u" * 500_000, "")]
    assert rows_of(convtrie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(ordered(rows))


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert convtrie.prefix_trie(df.where("false")).count() == 0
    clash = df.selectExpr("*", "1 AS pos", "2 AS d1", "3 AS depth", "4 AS `a.b`", "5 AS range")
    assert rows_of(convtrie.prefix_trie(clash)) == brute(ordered(ROWS))


def test_slots_are_minimal_and_verified():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(2**63), 2**63 - 1, (2, 5000))
    table = convtrie.SlotTable(a, b)
    assert sorted(table.find(a, b)) == list(range(5000))
    assert (table.find(b, a) == -1).all()
    assert convtrie.SlotTable(a[:0], b[:0]).find(a, b).max() == -1
    with pytest.raises(ValueError):
        convtrie.SlotTable(np.append(a, a[:1]), np.append(b, b[:1]))
