import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import bpe, chunks
from millrace.llm.queries import op6_byte_bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


LIBRARY, CODEC = library(), bpe.Codec(PATH, PATTERN)


def ids_of(text):
    import numpy as np

    return np.frombuffer(CODEC.encode(text), np.int32).tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab Zé1 \n\t\r'.,!#ß中🙂\x1c\x85\xa0　"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_equals_the_library_and_round_trips(text):
    ids = ids_of(text)
    assert ids == LIBRARY.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


def test_long_pretokens():
    rng = random.Random(2)
    for text in ("a" * 20_000, "".join(rng.choice("abcdefgh") for _ in range(20_000)), " " * 5000, "\n" * 5000):
        assert ids_of(text) == LIBRARY.encode_ordinary(text)
    long = "".join(rng.choice("etaoin") for _ in range(300_000))
    assert CODEC.decode(ids_of(long)) == long.encode()


def test_segments_of_long_texts(monkeypatch):
    monkeypatch.setattr("millrace.llm.chunks.SEGMENT", 40)
    rng = random.Random(3)
    text = "".join(rng.choice(["word", " ", " ", "  ", "\n", "x, ", "é! "]) for _ in range(600))
    assert ids_of(text) == LIBRARY.encode_ordinary(text)


def test_query_equals_the_library(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = []
    for d in docs:
        ids = LIBRARY.encode_ordinary(d.text or "")
        want.append((d.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, op6_byte_bpe(spark, sf).collect())) == sorted(want)


def test_edge_cases(spark):
    rows = [(1, None, "kept", [7]), (2, "", "kept", None), (2, "", "kept", None), (None, "a b", None, [1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string, token_ids array<int>")
    coded = bpe.encode(docs, PATH, PATTERN)
    assert coded.columns == ["doc_id", "text", "decoded", "token_ids"]
    assert sorted(map(len, (r.token_ids for r in coded.collect()))) == [0, 0, 0, 2]
    back = bpe.decode(coded, PATH, PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in back) == [b"", b"", b"", b"a b"]
    odd = spark.createDataFrame([(None,), ([1, None],), ([10**6],), ([],)], "token_ids array<int>")
    assert [None if r.decoded is None else bytes(r.decoded) for r in bpe.decode(odd, PATH, PATTERN).collect()] == [None, None, None, b""]
    assert bpe.encode(spark.createDataFrame([], docs.schema), PATH, PATTERN).count() == 0


@pytest.mark.parametrize("pattern", [r"\p{L}+|\P{L}+", r"(\p{N})|(\P{N}+)"])
def test_other_patterns(spark, pattern):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = ["Plain words, and 42 more of them.", "  two  blanks\n\nlines ", "été ça 12,5", ""]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, `a.b` string")
    out = bpe.encode(docs, path, pattern)
    assert out.columns == ["doc_id", "text", "a.b", "token_ids"]
    assert {r.doc_id: r.token_ids for r in out.collect()} == {i: library.encode_ordinary(t) for i, t in enumerate(texts)}


def test_the_given_pattern_is_the_one_that_texts_are_cut_for():
    assert chunks.PATTERN == public_tokenizers.PATTERN
