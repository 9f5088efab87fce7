import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import wordbpe
from millrace.llm.queries import op12_word_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY, CODEC = Tokenizer.from_file(PATH), wordbpe.Codec(PATH)


def ids_of(text):
    return np.frombuffer(CODEC.encode(text), np.int32).tolist()


def same(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    return ids_of(text) == want and CODEC.decode(np.array(want)) == LIBRARY.decode(want, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab Zé1 \n\t\r'.,!#ß中🙂\x1c\x85\xa0　ΣİIst"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_equals_the_library(text):
    assert same(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|end", "oftext|>", " ", "the", "aaaa", "'ll", "'", "é", "́"]), max_size=12))
def test_added_tokens_in_texts(parts):
    assert same("".join(parts))


def test_every_plain_character():
    for i in range(wordbpe.PLAIN + 8):
        assert same(f"a{chr(i)}b1{chr(i)}!'{chr(i)}{chr(i)}")


def test_long_words_and_texts(monkeypatch):
    rng = random.Random(2)
    for text in ("a" * 5_000, "".join(rng.choice("abcdefgh") for _ in range(5_000)), "!" * 3_000, "é" * 999 + "x" * 63 + "é"):
        assert same(text)
    monkeypatch.setattr(wordbpe, "SEGMENT", 40)
    monkeypatch.setattr(wordbpe, "WORDS", 7)
    for _ in range(20):
        assert same("".join(rng.choice(["word", "x" * 50, " ", "  ", "\n", "x, ", "é! ", "中", "<|endoftext|>", "́"]) for _ in range(300)))


def test_little_memory_gives_the_same(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice("etaoinshr ") for _ in range(400)) for _ in range(60)]
    want = CODEC.encode_all(texts)
    for name in ("KEPT", "NODES", "PAIRS", "WORDS"):
        monkeypatch.setattr(wordbpe, name, 10)
    assert wordbpe.Codec(PATH).encode_all(texts) == want == [CODEC.encode(t) for t in texts]


def test_shared_prefixes_are_nodes_once():
    trie = wordbpe.Trie(CODEC.trie.merges, "</w>")
    found = dict(trie.encode(["interns", "intern", "internal", "internals"]))
    assert len(trie.last) - 1 == len("internal") and set(trie.child) >= {(0, "i")}
    assert all([CODEC.names[i] for i in ids] == LIBRARY.encode(w, add_special_tokens=False).tokens for w, ids in found.items())


def test_improper_merges_are_refused():
    vocab = {x: i for i, x in enumerate(["a", "b", "c", "ab", "abc", "bc"])}
    with pytest.raises(ValueError):
        wordbpe.Merges(vocab, [("ab", "c"), ("a", "b")], "abc")
    with pytest.raises(ValueError):
        wordbpe.Merges(vocab, [("a", "b"), ("b", "c"), ("ab", "c"), ("a", "bc")], "abc")
    merges = wordbpe.Merges(vocab, [("b", "c"), ("a", "b"), ("ab", "c")], "abc")
    assert not merges.reachable(vocab["abc"])  # b and c join first
    assert merges.neighbours(vocab["a"], vocab["bc"]) and not merges.neighbours(vocab["a"], vocab["b"])


def test_query_equals_the_library(spark, sf):
    want = []
    for d in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = LIBRARY.encode(d.text or "", add_special_tokens=False).ids
        text = LIBRARY.decode(ids, skip_special_tokens=False)
        want.append((d.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, op12_word_bpe(spark, sf).collect())) == sorted(want)


def test_edges(spark):
    rows = [(None, None, 1), (1, "", 2), (1, "Same text", 3), (1, "Same text", 3), (2, "x" * 5000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `ids.x` long").withColumnRenamed("ids.x", "Token_IDs.old")
    got = wordbpe.encode(docs, PATH, decoded="decoded").collect()
    assert sorted(len(r.token_ids) for r in got) == sorted(len(LIBRARY.encode(t or "", add_special_tokens=False).ids) for _, t, _ in rows)
    assert {r["Token_IDs.old"] for r in got} == {1, 2, 3, None}
    assert wordbpe.encode(docs.where("false"), PATH).count() == 0
    back = wordbpe.decode(spark.createDataFrame([([320, None, 9999999],), (None,), ([],)], "token_ids array<int>"), PATH).collect()
    assert [r.decoded for r in back] == ["a</w>", None, ""]
    clash = wordbpe.encode(docs.withColumn("token_ids", docs.text), PATH)
    assert clash.columns.count("token_ids") == 1 and clash.schema["token_ids"].dataType.typeName() == "array"
