import random
import re

import pytest

from millrace.llm import substring
from millrace.llm.queries import op8_substring_dedup

DOC = "doc_id long, text string, removed string, row string"


def mixed(h):
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    h = (h ^ h >> 27) * 0x94D049BB133111EB % 2**64
    return h ^ h >> 31


def word_hash(word):
    return mixed(sum(ord(c) * pow(0x9E3779B97F4A7C15, i, 2**64) for i, c in enumerate(word.replace("İ", "i").lower())) % 2**64)


def own_units(text, near=3):
    """[(start, end, normalised)] of a text, word by word as the docstrings say."""
    words = [(m.start(), m.end(), m[0]) for m in re.finditer(r"\S+", text)]
    n = len(words)
    if not n:
        return []
    small = lambda c: c.isalpha() and c <= "\uffff" and not "A" <= c <= "Z"
    coarse = [True]
    for (_, end, before), (start, _, word) in zip(words, words[1:]):
        capital = re.match("[A-ZÀ-ÖØ-Þ]", word) and len(word) > 1 and small(word[1]) and small(before[-1])
        coarse.append(bool("\n" in text[end:start] or before[-1] in ".!?…" or capital))
    keys = [word_hash(w) for _, _, w in words]
    pair = [mixed((keys[i - 1] * 3 + keys[i]) % 2**64) if not coarse[i] else 2**64 for i in range(n)]
    cuts = list(coarse)
    for i in range(near + 1, n - near):
        if not any(coarse[i - near : i + near + 1]):
            cuts[i] = all(pair[i] < pair[i - d] and pair[i] <= pair[i + d] for d in range(1, near + 1))
    begins = [i for i in range(n) if cuts[i]] + [n]
    return [(words[a][0], words[b - 1][1], " ".join(w.replace("İ", "i").lower() for _, _, w in words[a:b])) for a, b in zip(begins, begins[1:])]


def brute(rows, min_words=substring.MIN_WORDS):
    """{doc_id: spans} by one pass over the documents in order."""
    cut = {i: own_units(text or "") for i, text in rows}
    first = {}
    for doc_id in sorted(cut):
        for _, _, unit in cut[doc_id]:
            first.setdefault(unit, doc_id)
    out = {}
    for doc_id, spans in cut.items():
        seen, again = set(), []
        for _, _, unit in spans:
            again.append(first[unit] != doc_id or unit in seen)
            seen.add(unit)
        runs, i = [], 0
        while i < len(spans):
            j = i
            while j < len(spans) and again[j]:
                j += 1
            if j > i and sum(len(u.split()) for _, _, u in spans[i:j]) >= min_words:
                runs.append((spans[i][0], spans[j - 1][1]))
            i = max(j, i + 1)
        out[doc_id] = runs
    return out


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    text = {d.doc_id: d.text for d in docs}
    want = brute([(d.doc_id, d.text) for d in docs])
    got = {r.doc_id: r for r in op8_substring_dedup(spark, sf).collect()}
    assert {k: [tuple(s) for s in r.removed] for k, r in got.items()} == want
    for k, r in got.items():
        assert r.removed_words == sum(len(text[k][a:b].split()) for a, b in want[k])
        if not want[k]:
            assert r.kept_text == text[k]


def test_every_later_occurrence_goes_with_min_words_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = brute([(d.doc_id, d.text) for d in docs.collect()], min_words=1)
    got = {r.doc_id: [tuple(s) for s in r.removed] for r in substring.dedup(docs, min_words=1).collect()}
    assert got == want and sum(map(bool, want.values())) > 50


@pytest.mark.parametrize("block", [16, 1 << 20])
def test_units_in_blocks_and_odd_letters(monkeypatch, block):
    monkeypatch.setattr(substring, "BLOCK", block)
    rng = random.Random(2)
    pieces = ["İstanbul", "straße", "Σίσυφος", "Ärger", "x" * 40, "a.", "So…", "it", "Is", "\n", "\t\n ", "\u2003", "\U0001d54f", "O'Neil", "42", "é", "É", "end?"]
    for _ in range(200):
        text = "".join(rng.choice(pieces) + rng.choice(("", " ", "  ", "\n", " \n\n")) for _ in range(rng.randint(0, 60)))
        found = substring.units(text)
        want = own_units(text)
        assert list(zip(found.starts.tolist(), found.ends.tolist())) == [(a, b) for a, b, _ in want]
        assert found.words.tolist() == [len(u.split()) for _, _, u in want]
        assert [found.h1[i] == found.h1[j] and found.h2[i] == found.h2[j] for i in range(len(want)) for j in range(i)] == [want[i][2] == want[j][2] for i in range(len(want)) for j in range(i)]


def test_rows_without_id_and_of_one_id(spark):
    prose = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    hosts = [f"{prose(k)}\n{prose('p')}" for k in range(6)]
    docs = spark.createDataFrame([(None, h) for h in hosts] + [(5, f"{prose(8)}\n{prose('q')}"), (5, f"{prose(9)}\n{prose('q')}"), (None, prose("q"))], "doc_id long, text string")
    got = substring.dedup(docs).collect()
    without = sorted(r.kept_text.count("wpx0") for r in got if r.doc_id is None)
    assert without == [0] * 6 + [1]  # the first by text hash keeps the passage
    assert [r.kept_text.count("wqx0") for r in got if r.doc_id == 5] == [1, 1]
    assert sum(r.kept_text.count("wqx0") for r in got) == 2


def test_clashing_names(spark):
    line = "This very line is said again and again in the text and it has more words than needed to count as a passage."
    names = ["doc_id", "text", "_unit_text", "row", "rank", "tie", "again", "h1", "h2", "salt", "first", "t", "c0", "known_rank", "a.b"]
    docs = spark.createDataFrame([(1, line, *"abcdefghijklm"), (2, line, *"abcdefghijklm")], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names[2:]))
    out = substring.dedup(docs)
    assert out.columns == [*names, "kept_text", "removed", "removed_words"]
    assert sorted((r.doc_id, r.kept_text, r.row, r["a.b"]) for r in out.collect()) == [(1, line, "b", "m"), (2, "", "b", "m")]


def test_a_passage_inside_a_line_is_cut_and_clean_text_stays(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeilnorst") for _ in range(rng.randint(2, 8)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    passage = " ".join(sentence(12) for _ in range(5))
    host = lambda: " ".join(sentence(9) for _ in range(6))[:-1].lower()
    clean = [host() for _ in range(4)]
    rows = [(i, f"{clean[i]} and {passage} with {clean[i][::-1]}") for i in range(3)] + [(3, clean[3])]
    got = {r.doc_id: r for r in substring.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].kept_text == rows[0][1] and got[3].kept_text == rows[3][1]
    for i in (1, 2):
        assert [rows[i][1][a:b] for a, b in got[i].removed] == [passage]
        assert got[i].removed_words == 60 and got[i].kept_text == f"{clean[i]} and\nwith {clean[i][::-1]}"


def test_edge_cases(spark):
    long = "This very line is said again and again in the text and it has more words than needed to count as a passage here."
    rows = [(1, None, "x", "y"), (2, "", None, None), (3, long, "x", "y"), (3, long, "x", "y"), (4, long + "\n" + long, None, None), (None, long, "x", "y"), (6, " \n ", "x", "y"), (7, "Short. Short. Short.", "x", "y"), (8, "word " * 200_000, "x", "y")]
    out = substring.dedup(spark.createDataFrame(rows, DOC))
    assert out.columns == ["doc_id", "text", "row", "kept_text", "removed", "removed_words"]
    got = sorted(((r.doc_id or 99, r.kept_text, len(r.removed)) for r in out.collect() if r.doc_id != 8), key=str)
    assert got == sorted([(1, None, 0), (2, "", 0), (3, long, 0), (3, long, 0), (4, "", 1), (99, "", 1), (6, " \n ", 0), (7, "Short. Short. Short.", 0)], key=str)
    assert substring.dedup(spark.createDataFrame([], DOC)).count() == 0


def test_passages_at_any_word_of_a_line_are_cut(spark):
    rng = random.Random(9)
    prose = lambda n: [rng.choice("abcdefgh") + "".join(rng.choice("aeilnorst") for _ in range(rng.randint(1, 7))) for _ in range(n)]
    rows, passages = [], []
    for i in range(200):
        passage = prose(rng.choice((55, 80, 120)))
        passages.append(passage)
        for k in range(2):
            host, at = prose(200), rng.randint(5, 195)
            rows.append((2 * i + k, " ".join([*host[:at], *passage, *host[at:]])))
    got = {r.doc_id: r for r in substring.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    shares = []
    for i, passage in enumerate(passages):
        assert got[2 * i].removed == []
        said, text = " ".join(passage), rows[2 * i + 1][1]
        at = text.index(said)
        assert all(at <= a and b <= at + len(said) for a, b in got[2 * i + 1].removed)
        shares.append(got[2 * i + 1].removed_words / len(passage))
    assert min(shares) > 0.5 and sum(shares) / len(shares) > 0.85
