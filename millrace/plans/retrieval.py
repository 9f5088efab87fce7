"""Searches over chunks, symbols and relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import corpus
from ..functions import keys, paths, text
from ..operators import retrieval
from . import fragments as s
from .registry import query

FLOOR = 0.2
#: Searches ask with every row whose id is divisible by this, against all rows.
ASKS = 20


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("repository_id"), "embedding")


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    asked = chunks.where(F.col("chunk_id") % ASKS == 0).select(F.col("chunk_id").alias("query_id"), "repository_id", F.col("embedding").alias("vector"))
    return retrieval.nearest(asked, chunks, 25, FLOOR)


_NEAREST = f"""nearest AS (
  SELECT * FROM (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) DESC, c.vec_id) AS rank
  FROM embeddings q JOIN embeddings c USING (label) WHERE q.vec_id % {ASKS} = 0) WHERE rank <= 25 AND score >= {FLOOR})"""


@query("WITH " + _NEAREST + " SELECT query_id, chunk_id, rank, round(score, 4) AS score FROM nearest")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir).select("query_id", "chunk_id", "rank", F.round("score", 4).alias("score"))


def _lexical_sql(tokens: str) -> str:
    """CTEs from ``tokens`` (query_id, token) to ``lexical``."""
    return f"""{tokens},
strings AS (SELECT name AS string FROM symbols UNION SELECT qualified_name FROM symbols),
tg AS (SELECT DISTINCT token, {s.trigrams('token')} AS g FROM tokens), sg AS (SELECT string, {s.trigrams('string')} AS g FROM strings),
sims AS (SELECT token, string, len(list_intersect(tg.g, sg.g))::DOUBLE / (len(tg.g) + len(sg.g) - len(list_intersect(tg.g, sg.g))) AS similarity FROM tg, sg WHERE len(list_intersect(tg.g, sg.g)) > 0 OR string ILIKE '%' || token || '%'),
best AS (SELECT token, symbol_id, name, qualified_name, max(coalesce(similarity, 0)) AS similarity FROM sims JOIN symbols ON string = name OR string = qualified_name GROUP BY ALL),
lexical AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, token ORDER BY score DESC, qualified_name, symbol_id) AS rank FROM (
  SELECT t.query_id, t.token, symbol_id, qualified_name, CASE WHEN lower(name) = lower(t.token) OR lower(qualified_name) = lower(t.token) THEN 1.0 ELSE similarity END AS score
  FROM tokens t JOIN best b ON t.token = b.token
  WHERE name ILIKE '%' || b.token || '%' OR qualified_name ILIKE '%' || b.token || '%' OR similarity >= {retrieval.LEAST_SIMILARITY})) WHERE rank <= 25)"""


@query(corpus.sql(_lexical_sql(f", tokens AS (SELECT DISTINCT symbol_id AS query_id, substring(name, 1, length(name) - 1) AS token FROM symbols WHERE symbol_id % {ASKS} = 0)") + " SELECT query_id, token, symbol_id, rank, round(score, 4) AS score FROM lexical", "symbols"))
def trigram_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = corpus.symbols(spark, sf_dir)
    tokens = symbols.where(F.col("symbol_id") % ASKS == 0).select(F.col("symbol_id").alias("query_id"), F.expr("substring(name, 1, length(name) - 1)").alias("token"))
    return retrieval.lexical(tokens, symbols).select("query_id", "token", "symbol_id", "rank", F.round("score", 4).alias("score"))


@query(corpus.sql(_lexical_sql(f", tokens AS (SELECT DISTINCT symbol_id AS query_id, substring(name, 1, length(name) - 1) AS token, repository_id FROM symbols JOIN files USING (file_id) WHERE symbol_id % {ASKS} = 0)") + f""",
scoped AS (SELECT *, row_number() OVER (PARTITION BY query_id, token ORDER BY score DESC, qualified_name, symbol_id) AS rank FROM (
  SELECT t.query_id, t.token, b.symbol_id, b.qualified_name, CASE WHEN lower(b.name) = lower(t.token) OR lower(b.qualified_name) = lower(t.token) THEN 1.0 ELSE similarity END AS score
  FROM tokens t JOIN best b ON t.token = b.token JOIN symbols y ON y.symbol_id = b.symbol_id JOIN files f ON f.file_id = y.file_id AND f.repository_id = t.repository_id
  WHERE b.name ILIKE '%' || b.token || '%' OR b.qualified_name ILIKE '%' || b.token || '%' OR similarity >= {retrieval.LEAST_SIMILARITY}))
SELECT query_id, token, symbol_id, rank, round(score, 4) AS score FROM scoped WHERE rank <= 25""", "symbols", "files"))
def repository_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names like those of every ASKS-th symbol, in the symbol's own repository."""
    homes = corpus.files(spark, sf_dir).select("file_id", "repository_id")
    symbols = corpus.symbols(spark, sf_dir).join(homes, "file_id")
    tokens = symbols.where(F.col("symbol_id") % ASKS == 0).select(F.col("symbol_id").alias("query_id"), F.expr("substring(name, 1, length(name) - 1)").alias("token"), "repository_id")
    return retrieval.lexical(tokens, symbols).select("query_id", "token", "symbol_id", "rank", F.round("score", 4).alias("score"))


_FILE_TOKENS = f"""tokens AS (SELECT DISTINCT vec_id AS query_id, token FROM (SELECT vec_id, unnest(['doc_' || vec_id, 'm' || vec_id, 'main']) AS token FROM embeddings WHERE vec_id % {ASKS} = 0))"""


@query(corpus.sql(f""", {_FILE_TOKENS},
grams AS (SELECT *, {s.trigrams('path')} AS g FROM files), wanted AS (SELECT *, {s.trigrams('token')} AS w FROM tokens),
scored AS (SELECT query_id, token, file_id, path, CASE WHEN lower(path) = lower(token) THEN 1.0 ELSE len(list_intersect(w, g))::DOUBLE / (len(w) + len(g) - len(list_intersect(w, g))) END AS score FROM wanted, grams)
SELECT query_id, token, file_id, rank, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, token ORDER BY score DESC, path, file_id) AS rank FROM scored
  WHERE path ILIKE '%' || token || '%' OR score >= {retrieval.LEAST_SIMILARITY}) WHERE rank <= 25""", "files"))
def file_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by parts of their paths, for every chunk whose id is divisible by ASKS."""
    id_ = F.col("chunk_id")
    names = F.array(F.concat(F.lit("doc_"), id_.cast("string")), F.concat(F.lit("m"), id_.cast("string")), F.lit("main"))
    tokens = _chunks(spark, sf_dir).where(id_ % ASKS == 0).select(id_.alias("query_id"), F.explode(names).alias("token"))
    found = retrieval.file_search(tokens, corpus.files(spark, sf_dir).select("file_id", "path"))
    return found.select("query_id", "token", "file_id", "rank", F.round("score", 4).alias("score"))


@query(corpus.sql(f"SELECT question_id, array_to_string({s.tokens('question')}, ' ') AS tokens, {s.normalized('question')} AS normalized FROM questions", "questions"))
def query_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("question")
    return corpus.questions(spark, sf_dir).select("question_id", F.array_join(text.identifier_tokens(q), " ").alias("tokens"), text.normalized(q).alias("normalized"))


@query(corpus.sql(f"SELECT question_id, len(list_intersect(list_transform(string_split({s.normalized('question')}, ' '), lambda w: lower(trim(w, '.,?!:;'))), {s.array(text.TEST_WORDS)})) > 0 AS asks_for_tests FROM questions", "questions"))
def test_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.questions(spark, sf_dir).select("question_id", text.has_test_intent(F.col("question")).alias("asks_for_tests"))


_TYPE_SCORE = "CASE relationship_type " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in retrieval.TYPE_SCORES.items()) + f" ELSE {retrieval.OTHER_TYPE_SCORE}::DOUBLE END"
_ONE_HOP = f"""
touched AS (SELECT query_id, source, target, relationship_type, sum(ends) AS ends FROM (
    SELECT query_id, source, target, relationship_type, 1 AS ends FROM relations JOIN seeds ON node = source
    UNION ALL SELECT query_id, source, target, relationship_type, 2 FROM relations JOIN seeds ON node = target) GROUP BY ALL),
reached AS (SELECT query_id, CASE ends WHEN 1 THEN target ELSE source END AS node, relationship_type FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY source, target, relationship_type) AS spot FROM touched) WHERE spot <= 50 AND ends < 3),
hops AS (SELECT query_id, node, max({_TYPE_SCORE}) AS score, string_agg(DISTINCT relationship_type, ',' ORDER BY relationship_type) AS types FROM reached GROUP BY ALL)"""


@query(corpus.sql(f", seeds AS (SELECT symbol_id // 200 AS query_id, symbol_id AS node FROM symbols WHERE symbol_id % {ASKS} = 0)," + _ONE_HOP + " SELECT query_id, node, score, types FROM hops", "symbols", "relations"))
def one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every symbol whose id is divisible by ASKS is a seed, ten to a question, against all relations."""
    seeds = corpus.symbols(spark, sf_dir).where(F.col("symbol_id") % ASKS == 0).select(F.floor(F.col("symbol_id") / 200).alias("query_id"), F.col("symbol_id").alias("node"))
    return retrieval.one_hop(seeds, corpus.relations(spark, sf_dir))


_HYBRID = f""",
{_NEAREST},
asked AS (SELECT e.vec_id AS query_id, ({s.array(corpus.QUESTIONS)})[(e.vec_id % 12 + 1)::INTEGER] || ' ' || y.name AS question FROM embeddings e JOIN symbols y ON y.symbol_id = e.vec_id WHERE e.vec_id % {ASKS} = 0),
tokens AS (SELECT query_id, unnest({s.tokens('question')}) AS token FROM asked),
""" + _lexical_sql("").lstrip(",\n") + f""",
seeds AS (SELECT query_id, symbol_id AS node FROM (SELECT query_id, symbol_id, row_number() OVER (PARTITION BY query_id ORDER BY max(score) DESC, qualified_name, symbol_id) AS spot FROM lexical GROUP BY query_id, symbol_id, qualified_name) WHERE spot <= 10),
{_ONE_HOP},
located AS (SELECT symbol_id, path, start_line FROM symbols JOIN files USING (file_id)),
paths AS (SELECT DISTINCT path AS string, {s.trigrams('path')} AS g FROM files), wanted AS (SELECT DISTINCT token, {s.trigrams('token')} AS g FROM tokens),
path_sims AS (SELECT token, string, len(list_intersect(w.g, p.g))::DOUBLE / (len(w.g) + len(p.g) - len(list_intersect(w.g, p.g))) AS similarity FROM wanted w, paths p WHERE len(list_intersect(w.g, p.g)) > 0 OR string ILIKE '%' || token || '%'),
file_hits AS (SELECT * FROM (SELECT query_id, t.token, file_id, path, CASE WHEN lower(path) = lower(t.token) THEN 1.0 ELSE similarity END AS score,
    row_number() OVER (PARTITION BY query_id, t.token ORDER BY CASE WHEN lower(path) = lower(t.token) THEN 1.0 ELSE similarity END DESC, path, file_id) AS rank
  FROM tokens t JOIN path_sims p ON p.token = t.token JOIN files ON path = string WHERE string ILIKE '%' || t.token || '%' OR similarity >= {retrieval.LEAST_SIMILARITY}) WHERE rank <= 25),
candidates AS (
  SELECT query_id, 'chunk:' || chunk_id AS key, 'semantic' AS source, score, 'vector' AS reason, path, NULL::BIGINT AS symbol_id, NULL::BIGINT AS start_line, rank AS ordinal FROM nearest JOIN files ON file_id = {corpus.FILE_OF.format('chunk_id')}
  UNION ALL SELECT query_id, 'symbol:' || l.symbol_id, 'lexical', score, 'name ' || token, path, l.symbol_id, start_line, 1000 + rank FROM lexical l JOIN located USING (symbol_id)
  UNION ALL SELECT query_id, 'file:' || file_id, 'lexical', score, 'path ' || token, path, NULL, NULL, 1500 + rank FROM file_hits
  UNION ALL SELECT query_id, 'symbol:' || node, 'structural', score, types, path, node, start_line, 2000 FROM hops JOIN located ON symbol_id = node),
merged AS (
  SELECT query_id, key, max(score) FILTER (source = 'semantic') AS semantic, max(score) FILTER (source = 'lexical') AS lexical, max(score) FILTER (source = 'structural') AS structural,
         min(path) AS path, min(symbol_id) AS symbol_id, min(start_line) AS start_line, string_agg(DISTINCT source, '+' ORDER BY source) AS sources FROM candidates GROUP BY ALL),
hot AS (SELECT path FROM located WHERE symbol_id IN (SELECT target FROM (SELECT target, count(*) AS n FROM edges GROUP BY 1 ORDER BY n DESC, target LIMIT 10))),
fused AS (
  SELECT m.query_id, key, path, symbol_id, start_line, sources,
         round(0.50 * coalesce(semantic, 0) + 0.35 * coalesce(lexical, 0) + 0.15 * coalesce(structural, 0) + CASE WHEN {s.is_entry('path')} THEN 0.05 ELSE 0 END
               + CASE WHEN path IN (SELECT path FROM hot) THEN 0.05 ELSE 0 END
               + CASE WHEN {s.test_search('path')} AND len(list_intersect(list_transform(string_split({s.normalized('question')}, ' '), lambda w: lower(trim(w, '.,?!:;'))), {s.array(text.TEST_WORDS)})) > 0 THEN 0.12 ELSE 0 END, 6)::DOUBLE AS final_score
  FROM merged m JOIN asked USING (query_id)),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, path, coalesce(start_line, 0), key) AS rank FROM fused) WHERE rank <= 10)
"""
_HYBRID_VIEWS = ("files", "symbols", "relations", "edges")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, question): what the hybrid search is asked."""
    ids = _chunks(spark, sf_dir).where(F.col("chunk_id") % ASKS == 0).select(F.col("chunk_id").alias("symbol_id"))
    template = F.element_at(text.strings(corpus.QUESTIONS), (F.col("symbol_id") % 12 + 1).cast("int"))
    return corpus.symbols(spark, sf_dir).join(ids, "symbol_id", "left_semi").select(F.col("symbol_id").alias("query_id"), F.concat_ws(" ", template, "name").alias("question"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols, files = corpus.symbols(spark, sf_dir), corpus.files(spark, sf_dir).select("file_id", "path")
    near = _nearest(spark, sf_dir).withColumn("file_id", corpus.file_of(spark, sf_dir, F.col("chunk_id"))).join(files, "file_id")
    tokens = asked(spark, sf_dir).select("query_id", F.explode(text.identifier_tokens(F.col("question"))).alias("token"))
    words = retrieval.lexical(tokens, symbols)
    order = Window.partitionBy("query_id").orderBy(F.desc("best"), "qualified_name", "symbol_id")
    seeds = words.groupBy("query_id", "symbol_id", "qualified_name").agg(F.max("score").alias("best")).withColumn("at", F.row_number().over(order)).where("at <= 10").select("query_id", F.col("symbol_id").alias("node"))
    hops = retrieval.one_hop(seeds, corpus.relations(spark, sf_dir))
    located = symbols.join(files, "file_id").select("symbol_id", "path", "start_line")
    columns = ["query_id", "key", "source", "score", "reason", "path", "symbol_id", "start_line", "ordinal"]
    none = F.lit(None).cast("string")
    semantic = near.select("query_id", keys.dedup_key(F.col("chunk_id").cast("string"), none, none).alias("key"), F.lit("semantic").alias("source"), "score", F.lit("vector").alias("reason"), "path", F.lit(None).cast("long").alias("symbol_id"), F.lit(None).cast("long").alias("start_line"), F.col("rank").alias("ordinal"))
    by_file = keys.dedup_key(none, none, F.col("file_id").cast("string")).alias("key")
    named = retrieval.file_search(tokens, files).select("query_id", by_file, F.lit("lexical").alias("source"), "score", F.concat(F.lit("path "), "token").alias("reason"), "path", F.lit(None).cast("long").alias("symbol_id"), F.lit(None).cast("long").alias("start_line"), (F.lit(1500) + F.col("rank")).alias("ordinal"))
    by_symbol = keys.dedup_key(none, F.col("symbol_id").cast("string"), none).alias("key")
    lexical = words.join(located, "symbol_id").select("query_id", by_symbol, F.lit("lexical").alias("source"), "score", F.concat(F.lit("name "), "token").alias("reason"), "path", "symbol_id", "start_line", (F.lit(1000) + F.col("rank")).alias("ordinal"))
    structural = hops.withColumnRenamed("node", "symbol_id").join(located, "symbol_id").select("query_id", by_symbol, F.lit("structural").alias("source"), "score", F.col("types").alias("reason"), "path", "symbol_id", "start_line", F.lit(2000).alias("ordinal"))
    return semantic.unionByName(lexical).unionByName(named).unionByName(structural).select(columns)


def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best results of each question: search, merge, fuse, rank."""
    merged = retrieval.merge(_candidates(spark, sf_dir))
    located = corpus.symbols(spark, sf_dir).join(corpus.files(spark, sf_dir).select("file_id", "path"), "file_id")
    top = corpus.edges(spark, sf_dir).groupBy("target").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "target").limit(10)
    hot = located.join(top, located.symbol_id == top.target, "left_semi").select(F.col("path").alias("hot_path")).distinct()
    joined = merged.join(asked(spark, sf_dir), "query_id").join(hot, F.col("path") == F.col("hot_path"), "left")
    tests = paths.is_test_for_search(F.col("path")) & text.has_test_intent(F.col("question"))
    return retrieval.ranked(retrieval.fuse(joined, paths.is_entry_point(F.col("path")), F.col("hot_path").isNotNull(), tests))


@query(corpus.sql(_HYBRID + "SELECT query_id, rank, key, path, sources, round(final_score, 4) AS score FROM ranked", *_HYBRID_VIEWS))
def hybrid_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid(spark, sf_dir).select("query_id", "rank", "key", "path", "sources", F.round("final_score", 4).alias("score"))


@query(corpus.sql(_HYBRID + "SELECT query_id, key, path, symbol_id, sources, round(semantic, 4) AS semantic, round(lexical, 4) AS lexical, round(structural, 4) AS structural FROM merged", *_HYBRID_VIEWS))
def dedup_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = retrieval.merge(_candidates(spark, sf_dir))
    return merged.select("query_id", "key", "path", "symbol_id", "sources", *[F.round(c, 4).alias(c) for c in ("semantic", "lexical", "structural")])


@query(corpus.sql(_HYBRID + "SELECT sources, count(*) AS results, len(string_split(sources, '+')) >= 2 AS dual FROM ranked GROUP BY ALL", *_HYBRID_VIEWS))
def source_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid(spark, sf_dir).groupBy("sources", (F.size(F.split("sources", r"\+")) >= 2).alias("dual")).agg(F.count("*").alias("results"))


@query(corpus.sql(_HYBRID + """, scored AS (SELECT *, CASE WHEN symbol_id IS NOT NULL THEN symbol_id % 97 END AS rerank_score FROM ranked)
SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score IS NULL, rerank_score DESC, rank)::INTEGER AS new_rank FROM scored""", *_HYBRID_VIEWS))
def rerank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in scorer that knows symbols only; rows without a score keep their order after the others."""
    return retrieval.rerank(hybrid(spark, sf_dir), F.col("symbol_id") % 97).select("query_id", "key", "new_rank")


@query(corpus.sql(f"""SELECT question_id, 'retrieval:' || repo || ':' || sha256(repo || '|' || lower({s.normalized('question')}) || '|10|lexical,semantic|' || version || '|rerank=' || CASE WHEN question_id % 2 = 0 THEN 'True' ELSE 'False' END) AS cache_key
FROM (SELECT *, 'r' || (question_id % 5) AS repo, CASE WHEN question_id % 3 = 0 THEN 'unindexed' ELSE question_id || ':hash-1:2024-01-01' END AS version FROM questions)""", "questions"))
def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_ = F.col("question_id")
    version = keys.corpus_version(F.when(id_ % 3 != 0, id_), F.lit("hash-1"), F.lit("2024-01-01"))
    key = keys.cache_key(F.concat(F.lit("r"), (id_ % 5).cast("string")), text.normalized(F.col("question")), F.lit(10), text.strings(["semantic", "lexical"]), version, id_ % 2 == 0)
    return corpus.questions(spark, sf_dir).select("question_id", key.alias("cache_key"))
