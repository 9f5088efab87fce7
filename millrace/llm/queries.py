"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, convtrie, mixing, phrases, simhash, substring, tokenbin, tokencounts, topk, toxicity, vectorgraph, warc, wordbpe
from .storage import scratch_path, settle


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenbin.write(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return tokenbin.read(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, chain, keep_text=False)
    return scored.select("doc_id", "p_quality", "p_toxic", (F.col("p_toxic") >= chain.thresholds["toxic"]).alias("rejected"))


def op4_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    _, files = warc.archive(pages)
    asked = pages.groupBy(warc.url_key(F.col("url")).alias("key")).agg(F.min("url").alias("url"))
    captures = warc.lookup(asked, files)  # every key, by binary search
    records = warc.read_records(captures, keep_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    counts = tokencounts.TokenCounts(spark, scratch_path(spark, "token-counts"))
    words = tokencounts.matches("text", mixing.WORD)
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    load = tokencounts.counted(docs, words, "words-1").union(tokencounts.counted(docs, size, "bytes-1"))
    counts.commit("load", load)
    counts.commit("load", load)  # once more: nothing counts twice
    split = tokencounts.matches("text", r"[^\x20\x09-\x0D']+")
    counts.commit("recount-fr", tokencounts.counted(docs.where("lang = 'fr'"), split, "words-1"))
    named = docs.select("doc_id", F.sha2("text", 256).alias("sha")).where("sha IS NOT NULL")
    first = settle(named.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "copied-texts")
    counts.commit("drop-copies", deletes=named.join(first, "sha").where("doc_id > first").select("doc_id"))
    return counts.totals()


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded="decoded", keep_text=False)
    digits = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(digits, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.dedup(docs).select("doc_id", "removed", "removed_words", "kept_text")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = settle(mixing.plan(_table(spark, sf_dir, "documents")).withColumn("row", F.monotonically_increasing_id()), "mix-plan")
    uses = planned.select("row", "doc_id", "size", F.posexplode("positions").alias("copy", "position"))
    uses = settle(mixing.in_order(uses), "mix-order")
    used = uses.groupBy("row").agg(F.sum("size").alias("taken"), F.min("position").alias("first_position"))
    return planned.join(used, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "first_position")


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorgraph.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = wordbpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), ids="ids", decoded="decoded", packed=True, keep_text=False)
    n_tokens = F.octet_length("ids").cast("long") / 4
    return coded.select("doc_id", n_tokens.cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = convtrie.turn_keys(_table(spark, sf_dir, "conversations"))
    turns = settle(turns, "own-turns")
    c = F.col("conv_id")
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("length"))
    convs = settle(lengths.select("conv_id", (c - c % 5).alias("base"), (F.crc32(c.cast("string").cast("binary")) % 9).alias("h")), "conversations")
    sizes = lengths.select(F.col("conv_id").alias("base"), F.least("length", F.lit(8)).alias("lent"))
    convs = settle(convs.join(sizes, "base", "left").withColumn("lent", F.least("h", F.coalesce("lent", F.lit(0)))), "conversations")
    rest = ["k1", "k2", "check", "bytes"]
    first = turns.where("pos <= 8").withColumnRenamed("conv_id", "base")
    heads = convs.join(first, "base").where("pos <= h").select("conv_id", "pos", *rest)
    own = turns.join(convs, "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("lent")).alias("pos"), *rest)
    return convtrie.trie(heads.union(own), convs)


OP4_SQL = """
WITH hashed AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
firsts AS (SELECT hex, max(page_id) AS first FROM hashed GROUP BY hex)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((('0x' || substr(hex, ((i // 4) * 5 + 1)::INTEGER, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1)::INTEGER, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM hashed JOIN firsts USING (hex)
"""

OP5_SQL = r"""
WITH kept AS (
  SELECT * FROM documents d
  WHERE text IS NULL OR doc_id IN (SELECT min(doc_id) FROM documents WHERE text IS NOT NULL GROUP BY text)),
counted AS (
  SELECT source, lang, 'words-1' AS version,
         coalesce(len(regexp_extract_all(text, CASE WHEN lang = 'fr' THEN '[^\x20\x09-\x0D'']+' ELSE '[^\x20\x09-\x0D]+' END)), 0) AS n FROM kept
  UNION ALL
  SELECT source, lang, 'bytes-1', coalesce(octet_length(encode(text)), 0) FROM kept)
SELECT source, lang, version, count(*)::BIGINT AS docs, sum(n)::BIGINT AS tokens FROM counted GROUP BY ALL
"""

OP7_SQL = """
WITH ints AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM ints q JOIN ints c ON q.vec_id % 50 = 0 AND q.n <> c.n),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS turn
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, ([5.0, 2.0, 1.0])[turn + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS most FROM sources),
filled AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(most) OVER w, 0.0::DOUBLE))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0.0::DOUBLE)) AS level
  FROM weighed WINDOW w AS (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aimed AS (
  SELECT source, source_size, turn, least(max(level) OVER () * weight, most) AS target FROM filled),
begun AS (
  SELECT s.doc_id, s.size, a.source_size, a.turn, a.target,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
           + s.size / 2.0::DOUBLE AS middle
  FROM sized s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source),
curve AS (
  SELECT *, middle / target AS due,
         ([1.5, 1.0, 0.5])[turn + 1]::DOUBLE AS w0, ([-1.0, 0.0, 1.0])[turn + 1]::DOUBLE AS slope FROM begun)
SELECT doc_id, size, source_size, target,
       CASE WHEN size = 0 THEN 0 ELSE size * ((middle <= target)::BIGINT + (middle + source_size <= target)::BIGINT) END AS taken,
       CASE WHEN size > 0 AND middle <= target THEN 2.0::DOUBLE * due / (w0 + sqrt(greatest(0.0::DOUBLE, w0 * w0 + 2.0::DOUBLE * slope * due))) END AS first_position
FROM curve
"""

OP11_SQL = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
starts AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM pieces),
counted AS (
  SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM starts CROSS JOIN (VALUES (1), (2), (3), (4), (5)) AS sizes(k) WHERE i + k - 1 <= len(words) GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM counted WHERE k = 1 GROUP BY lang),
frequent AS (SELECT *, string_split(phrase, ' ') AS words FROM counted WHERE f >= 100),
candidates AS (SELECT * FROM frequent WHERE k > 1),
kept AS (
  SELECT * FROM candidates c WHERE NOT EXISTS (
    SELECT 1 FROM candidates o WHERE o.lang = c.lang AND o.k > c.k AND o.f >= c.f AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, c.cut, x.f AS l, y.f AS r, t.n, (1000::HUGEINT * c.f * t.n) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept) c JOIN totals t USING (lang)
  JOIN frequent x ON x.lang = c.lang AND x.phrase = array_to_string(c.words[1:c.cut], ' ')
  JOIN frequent y ON y.lang = c.lang AND y.phrase = array_to_string(c.words[c.cut + 1:c.k], ' ')),
weakest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM cuts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest WHERE nth = 1)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""

OP13_SQL = """
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn ASC NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id FROM own),
crcs AS (
  SELECT conv_id, xor(4294967295, list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT),
    lambda crc, byte: list_reduce([xor(crc, byte)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))) AS crc
  FROM ids),
convs AS (SELECT conv_id, conv_id - conv_id % 5 AS base, crc % 9 AS h FROM crcs),
parts AS (
  SELECT c.conv_id, 0 AS part, o.pos, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.base AND o.pos <= c.h
  UNION ALL
  SELECT c.conv_id, 1, o.pos, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.pos > c.h),
turns AS (
  SELECT conv_id, row_number() OVER w AS depth, octet_length(encode(text)) AS bytes,
         list(sha256(role) || sha256(text)) OVER (PARTITION BY conv_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING) AS path
  FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)),
passed AS (
  SELECT conv_id, depth, bytes, sha256(array_to_string(path, '')) AS node, CASE WHEN depth = 1 THEN 'root' ELSE sha256(array_to_string(path[1:len(path) - 1], '')) END AS parent FROM turns
  UNION ALL SELECT conv_id, 0, 0, 'root', NULL FROM convs),
lengths AS (SELECT conv_id, max(depth) AS length FROM passed GROUP BY conv_id),
nodes AS (
  SELECT p.node, min(p.conv_id) AS conv_id, any_value(p.depth) AS depth, any_value(p.parent) AS parent, count(*) AS n_convs, any_value(p.bytes) AS bytes,
         sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (p.depth = l.length), '')) AS ends_sha256
  FROM passed p JOIN lengths l USING (conv_id) GROUP BY p.node),
children AS (SELECT parent AS node, count(*) AS n FROM nodes GROUP BY parent),
below AS (
  SELECT p.node, count(*) FILTER (c.n IS NULL) AS n_leaves, sum((v.n_convs - 1) * v.bytes) AS saved
  FROM nodes v JOIN passed p ON p.conv_id = v.conv_id AND p.depth <= v.depth LEFT JOIN children c ON c.node = v.node GROUP BY p.node)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(c.n, 0)::BIGINT AS n_children,
       b.n_leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.node = n.node LEFT JOIN nodes u ON u.node = n.parent LEFT JOIN children c ON c.node = n.node
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_simhash_near_dedup, op2_token_id_files, op3_toxicity, op4_warc_archive, op5_token_counts, op6_byte_bpe, op7_exact_top_k, op8_substring_dedup, op9_mix_sources, op10_embedding_near_dedup, op11_phrase_collocations, op12_word_bpe, op13_conversation_trie)
}
ORACLE: dict[str, str] = {"op4_warc_archive": OP4_SQL, "op5_token_counts": OP5_SQL, "op7_exact_top_k": OP7_SQL, "op9_mix_sources": OP9_SQL, "op11_phrase_collocations": OP11_SQL, "op13_conversation_trie": OP13_SQL}
