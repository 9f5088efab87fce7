import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import tokenbin
from millrace.llm.queries import op2_token_id_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=200))
def test_pack_round_trip(bits, values):
    ids = np.array(values, np.uint64).astype(np.uint32) & np.uint32((1 << bits) - 1)
    data = tokenbin.pack(ids, bits)
    assert len(data) == -(-len(ids) * bits // 8)
    assert (tokenbin.unpack(data, len(ids), bits) == ids).all()


@pytest.mark.parametrize("size, bits", [(1, 1), (2, 1), (3, 2), (50_257, 16), (65_536, 16), (65_537, 17)])
def test_fewest_bits(size, bits):
    assert tokenbin.bits_for(size) == bits


def test_query_equals_whole_text_encoding(spark, sf):
    tokenizer = Tokenizer.from_file(PATH)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want, start = [], 0
    for d in docs:
        ids = np.array([*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((d.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, op2_token_id_files(spark, sf).collect())) == want


def test_files_blocks_and_edge_cases(spark):
    rows = [(3, "some words here", "x"), (1, None, "y"), (2, "", None), (2, "again two", "z"), (None, "no id", "z"), (7, "long " * 30_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    manifest = tokenbin.write(docs, PATH, block=512, file_ids=4)
    assert manifest.count() > 1
    got = tokenbin.read(manifest).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(PATH)
    order = [(None, "no id"), (1, ""), *sorted([(2, ""), (2, "again two")], key=lambda r: [g.n_tokens for g in got if g.doc_id == 2].index(1 + len(tokenizer.encode(r[1]).ids))), (3, "some words here"), (7, "long " * 30_000)]
    start = 0
    for r, (doc_id, text) in zip(got, order, strict=True):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) == (doc_id, start, ids)
        start += len(ids)
    last = manifest.orderBy("part", "seq").collect()[-1]
    assert tokenbin.read_document(last.path, last.n_docs - 1).tolist() == [*tokenizer.encode("long " * 30_000, add_special_tokens=False).ids, 0]
    empty = tokenbin.write(spark.createDataFrame([], docs.schema), PATH)
    assert empty.count() == 0 and tokenbin.read(empty).count() == 0


def test_other_bit_widths_and_whole_text_tokenizers(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(1, "Some Words  here"), (2, None)], "doc_id long, text string")
    manifest = tokenbin.write(docs, path, end_id=None)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in tokenbin.read(manifest).collect()}
    assert got == {1: Tokenizer.from_file(path).encode("Some Words  here", add_special_tokens=False).ids, 2: []}


def test_added_tokens_in_a_text_are_those_of_the_library(spark):
    tokenizer = Tokenizer.from_file(PATH)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\ny's <|endoftext", "plain <| end |>", " <|endoftext|>  two " * 3000]
    assert tokenizer.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    manifest = tokenbin.write(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH)
    got = [np.frombuffer(r.ids, "<u4").tolist() for r in tokenbin.read(manifest).orderBy("doc_id").collect()]
    assert got == [[*tokenizer.encode(t, add_special_tokens=False).ids, 0] for t in texts]
