"""The pipeline stage by stage against plain Python over its own input."""

import base64

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken
from test_substring import brute as brute_repeats

from millrace.llm import mixing, toxicity
from millrace.llm.storage import settle

STAGES = dict(corpus_pipeline.STAGES)


def shingles(text, size=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def without(text, spans):
    """``text`` less its spans: what is left, a line for each piece."""
    if not spans:
        return text
    ends = [0, *(x for s in spans for x in s), len(text)]
    return "\n".join(p for p in (text[a:b].strip() if a and b < len(text) else text[a:b].lstrip() if a else text[a:b].rstrip() for a, b in zip(ends[::2], ends[1::2])) if p)


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_order_and_run(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "substring_dedup", "mix_sources", "byte_bpe"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns

    chain = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    clean = settle(STAGES["toxicity"](spark, docs, sf), "t1")
    want = {d.doc_id for d in docs.collect() if chain.predict([chain.places(d.text)])[0, 1] < chain.thresholds["toxic"]}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == want

    kept = settle(STAGES["simhash_near_dedup"](spark, clean, sf), "t2")
    assert kept.columns == columns
    before = {r.doc_id: shingles(r.text) for r in clean.collect()}
    after = {r.doc_id for r in kept.collect()}
    for d, s in before.items():
        near = [jaccard(s, t) for e, t in before.items() if e != d]
        if max(near) < 0.8:
            assert d in after
    for a in after:
        assert all(jaccard(before[a], before[b]) < 0.8 for b in after if b != a)

    cut = settle(STAGES["substring_dedup"](spark, kept, sf), "t3")
    text = {r.doc_id: r.text for r in kept.collect()}
    spans = brute_repeats(list(text.items()))
    assert cut.columns == columns
    for r in cut.collect():
        assert r.text == without(text[r.doc_id] or "", spans[r.doc_id]) and r.n_chars == len(r.text)

    mixed = settle(STAGES["mix_sources"](spark, cut, sf), "t4")
    assert mixed.columns == columns
    plan = mixing.plan(cut).collect()
    counts = {}
    for r in mixed.collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert counts == {r.doc_id: len(r.positions) for r in plan if r.positions}

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    final = {r.doc_id: r for r in cut.collect()}
    out = STAGES["byte_bpe"](spark, mixed, sf).collect()
    assert len(out) == sum(counts.values())
    for r in out:
        assert r.token_ids == library.encode_ordinary(final[r.doc_id].text) and r.n_tokens == len(r.token_ids)


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_on_odd_and_empty_tables(spark, sf, name):
    schema = "doc_id long, text string, lang string, source string, n_chars long, component_id string, token string"
    rows = [(1, None, None, None, None, None, None), (2, "", "en", "a", 0, "x", "y"), (None, "some words here", "en", None, 15, None, None), (3, "some words here", "en", "a", 15, None, None), (3, "some words here", "en", "a", 15, None, None), (4, "w " * 100_000, "en", "b", 200_000, None, None)]
    out = STAGES[name](spark, spark.createDataFrame(rows, schema), sf)
    if name != "byte_bpe":
        assert out.columns == [c.split()[0] for c in schema.split(", ")]
    assert out.count() >= 1
    assert STAGES[name](spark, spark.createDataFrame([], schema), sf).count() == 0
