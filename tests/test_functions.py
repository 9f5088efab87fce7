"""Column functions on small literal rows."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import keys, paths, text, vectors


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("query, tokens", [
    ("", []), ("   ", []), ("where is the Parser implemented", ["Parser"]), ("getUser getuser GETUSER x ab", ["getUser"]),
    ("alpha beta gamma delta epsilon zeta eta theta", ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]), ("call snake_case_name now", ["call", "snake_case_name", "now"]),
])
def test_identifier_tokens(spark, query, tokens):
    assert one(spark, text.identifier_tokens(F.col("q")), q=query) == tokens


def test_trigram_similarity_matches_known_value(spark):
    assert round(one(spark, text.trigram_similarity(F.col("a"), F.col("b")), a="word", b="two words"), 4) == 0.3636
    assert one(spark, text.trigram_similarity(F.col("a"), F.col("b")), a="", b="") == 0.0


@pytest.mark.parametrize("question, intent", [
    ("who is the caller of x", "call_relationships"), ("what DEPENDS on x", "dependency_analysis"), ("side effect of it", "impact_analysis"), ("unit spec for it", "testing"),
    ("where are settings", "configuration"), ("sql injection vulnerability", "security"), ("which schema", "database_data_flow"), ("a traceback", "debugging"),
    ("high-level overview", "architecture_overview"), ("how does it sort", "implementation"), ("definition of X", "symbol_lookup"), ("hello there", "general"),
])
def test_intents(spark, question, intent):
    assert one(spark, text.intent(F.col("q")), q=question) == intent


@pytest.mark.parametrize("path, module", [("a/b.py", "a.b"), ("v1.2/readme", "v1.2.readme"), ("x", "x"), ("a/b.test.js", "a.b.test")])
def test_module_path(spark, path, module):
    assert one(spark, paths.module_path(F.col("p")), p=path) == module


@pytest.mark.parametrize("path, plain", [("a/../b", "b"), ("a/./b//c", "a/b/c"), ("../x", "../x"), ("a/b/../../c", "c"), ("", "")])
def test_normalized_path(spark, path, plain):
    assert one(spark, paths.normalized_path(F.col("p")), p=path) == plain


@pytest.mark.parametrize("path, size, reason", [("a/yarn.lock", 1, "filename_rule"), ("a/x.min.js", 1, "suffix_rule"), ("a/x.py", 6_000_000, "max_file_size"), ("a/x.py", 10, None), ("a/x.PNG", 1, None)])
def test_exclusion_rules_in_order(spark, path, size, reason):
    assert one(spark, paths.exclusion_reason(F.col("p"), F.col("s")), p=path, s=size) == reason


@pytest.mark.parametrize("path, ignored", [("a/b.log", True), ("keep.log", False), ("build/x.py", True), ("src/build.py", False), ("docs/a/b.tmp", True), ("docs/b.txt", False)])
def test_gitignore(spark, path, ignored):
    assert one(spark, paths.gitignore_verdict(F.col("p"), ["# note", "*.log", "!keep.log", "build/", "docs/**/*.tmp"]), p=path) is ignored


def test_the_test_path_rules_differ(spark):
    df = spark.createDataFrame([("tests/a.py",), ("src/tests/a.py",), ("conftest.py",), ("a/test_x.py",), ("a/x.spec.ts",)], ["p"])
    rows = df.select(paths.is_test_for_search(F.col("p")), paths.is_test_for_summary(F.col("p")), paths.is_test_for_reports(F.col("p"))).collect()
    assert [tuple(r) for r in rows] == [(True, True, False), (True, True, True), (True, False, True), (True, True, True), (True, True, False)]


def test_cosine(spark):
    assert one(spark, vectors.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(0.5**0.5)
    assert one(spark, vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None


def test_cache_key_ignores_source_order_and_case(spark):
    def key(query, sources, k=10, rerank=False):
        return one(spark, keys.cache_key(F.lit("r"), F.lit(query), F.lit(k), text.strings(sources), F.lit("v"), F.lit(rerank)))

    assert key("Query", ["a", "b"]) == key("query", ["b", "a"])
    assert len({key("q", ["a"]), key("q", ["a"], 5), key("q", ["a"], 10, True), key("p", ["a"])}) == 4


def test_json_object(spark):
    df = spark.createDataFrame([('{"a": 1}',), ("x ```json\n{\"a\": 2}\n``` y",), ('so {"a": 3} it',), ("none",), ("[1]",)], ["t"])
    assert [r.x for r in df.select(F.get_json_object(text.json_object(F.col("t")), "$.a").alias("x")).collect()] == ["1", "2", "3", None, None]


def test_plain_text(spark):
    assert one(spark, text.plain_text(F.col("t")), t="## Head\r\n**bold** `code` a‑b 【x】") == "Head\nbold code a-b (x)"
