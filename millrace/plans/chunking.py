"""Chunks, incremental work and embeddings."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import corpus
from ..operators import chunking, indexing
from ..sources.scratch import scratch_path
from .registry import query

_STRIP = "regexp_replace({}, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')"


def _windows_of(files: str, name: str) -> str:
    """SQL views that cut the texts of ``files`` into the chunks ``name``."""
    stripped = _STRIP.format("array_to_string(l[start:least(start + 39, len(l))], chr(10))")
    return f""", split_{name} AS (SELECT file_id, repository_id, CASE WHEN p[-1] = '' THEN p[1:-2] ELSE p END AS l FROM (SELECT file_id, repository_id, string_split(text, chr(10)) AS p FROM {files})),
cut_{name} AS (SELECT file_id, repository_id, start, least(start + 39, len(l)) AS stop, {stripped} AS text
  FROM (SELECT *, unnest(generate_series(1, greatest(1, len(l) - 5), 35)) AS start FROM split_{name} WHERE len(l) > 0)),
{name} AS (SELECT file_id, repository_id, (row_number() OVER (PARTITION BY file_id ORDER BY start) - 1)::INTEGER AS chunk_index, start::INTEGER AS start_line, stop::INTEGER AS end_line, text FROM cut_{name} WHERE text <> '')
"""


_WINDOWS = _windows_of("files", "chunks")


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.windows(corpus.files(spark, sf_dir).select("file_id", "text"))


@query(corpus.sql(_WINDOWS + "SELECT file_id, chunk_index, start_line, end_line, length(text)::INTEGER AS char_count, sha256(text) AS content_hash FROM chunks", "files"))
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir).select("file_id", "chunk_index", "start_line", "end_line", F.length("text").alias("char_count"), F.sha2("text", 256).alias("content_hash"))


_BY_SYMBOL = """, split_files AS (SELECT file_id, CASE WHEN p[-1] = '' THEN p[1:-2] ELSE p END AS l FROM (SELECT file_id, string_split(text, chr(10)) AS p FROM files)),
spans AS (SELECT file_id, symbol_id, start_line, end_line FROM symbols UNION ALL SELECT file_id, NULL, 1, min(start_line) - 1 FROM symbols GROUP BY 1 HAVING min(start_line) > 1),
cut AS (SELECT file_id, symbol_id, start_line, least(end_line, len(l)) AS end_line, """ + _STRIP.format("array_to_string(l[start_line:least(end_line, len(l))], chr(10))") + """ AS text FROM spans JOIN split_files USING (file_id) WHERE start_line <= least(end_line, len(l)) AND start_line >= 1)
"""


@query(corpus.sql(_BY_SYMBOL + "SELECT file_id, symbol_id, start_line, end_line, length(text)::INTEGER AS char_count, CASE WHEN symbol_id IS NULL THEN 'fallback' WHEN length(text) > 3500 THEN 'symbol_split' ELSE 'symbol' END AS chunk_type FROM cut WHERE text <> ''", "files", "symbols"))
def chunk_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.by_symbol(corpus.files(spark, sf_dir), corpus.symbols(spark, sf_dir))
    return chunks.select("file_id", "symbol_id", "start_line", "end_line", F.length("text").alias("char_count"), "chunk_type")


@query()
def chunk_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy packing is sequential, so there is no SQL for it."""
    return chunking.split_long(corpus.files(spark, sf_dir).select("file_id", "text"))


@query(corpus.sql(_WINDOWS + "SELECT repository_id, count(*) AS chunks, count(DISTINCT file_id) AS files, sum(length(text))::BIGINT AS chars FROM chunks GROUP BY 1", "files"))
def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    home = corpus.files(spark, sf_dir).select("file_id", "repository_id")
    return _windows(spark, sf_dir).join(home, "file_id").groupBy("repository_id").agg(F.count("*").alias("chunks"), F.count_distinct("file_id").alias("files"), F.sum(F.length("text")).alias("chars"))


@query(corpus.sql(_WINDOWS + "SELECT file_id, chunk_index, start_line, end_line FROM chunks ORDER BY file_id, chunk_index LIMIT 50 OFFSET 50", "files"))
def chunks_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir).select("file_id", "chunk_index", "start_line", "end_line").orderBy("file_id", "chunk_index").offset(50).limit(50)


@query(corpus.sql(""", indexed AS (SELECT file_id, CASE WHEN file_id % 3 = 1 THEN content_hash ELSE 'old' END AS hash, CASE WHEN file_id % 5 = 0 THEN 'v1' ELSE 'v2' END AS version FROM files WHERE file_id % 3 <> 0)
SELECT file_id, path FROM files f WHERE NOT EXISTS (SELECT 1 FROM indexed i WHERE i.file_id = f.file_id AND i.hash = f.content_hash AND i.version = 'v2')""", "files"))
def incremental_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work left where a third of the files is indexed, a third was changed since, and some by an older model."""
    files = corpus.files(spark, sf_dir).select("file_id", "path", "content_hash")
    old = F.when(F.col("file_id") % 3 == 1, F.col("content_hash")).otherwise("old")
    indexed = files.where(F.col("file_id") % 3 != 0).select("file_id", old.alias("file_content_hash"), F.when(F.col("file_id") % 5 == 0, "v1").otherwise("v2").alias("embedding_model_version"))
    return chunking.work_list(files, indexed, F.lit("v2")).select("file_id", "path")


@query(corpus.sql(_WINDOWS + "SELECT sha256(text) AS content_hash, count(*) AS uses, sha256(text) IN (SELECT sha256(text) FROM chunks WHERE file_id % 2 = 0) AS hit FROM chunks GROUP BY 1", "files"))
def embed_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which chunk texts have a vector if those of every other file do."""
    chunks = _windows(spark, sf_dir).select("file_id", F.sha2("text", 256).alias("content_hash"))
    return chunking.cache_split(chunks, chunks.where(F.col("file_id") % 2 == 0))


@query("""WITH words AS (SELECT doc_id AS file_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: w <> '')) AS word FROM documents),
sums AS (SELECT file_id, ('0x' || substr(md5(word), 1, 8))::BIGINT % 64 AS place, count(*) AS n FROM words GROUP BY ALL)
SELECT file_id, place, round(n / sqrt((sum(n * n) OVER (PARTITION BY file_id))::DOUBLE), 6) AS weight FROM sums""")
def embed_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = corpus.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "text")
    return chunking.hashed_words(texts).select("file_id", "place", F.round("weight", 6).alias("weight"))


def word_counts(texts: list[str]) -> list[list[float]]:
    """A vector a text: its words counted by hash, over the Euclidean length."""
    out = []
    for text in texts:
        counts = [0.0] * 16
        for word in text.lower().split():
            counts[zlib.crc32(word.encode()) % 16] += 1
        norm = sum(c * c for c in counts) ** 0.5 or 1.0
        out.append([c / norm for c in counts])
    return out


_LATER = """, later AS (SELECT file_id, repository_id, CASE WHEN file_id % 3 = 1 THEN text || chr(10) || 'changed ' || file_id ELSE text END AS text FROM files WHERE file_id % 7 <> 2)
"""


@query(corpus.sql(_LATER + _windows_of("files", "first") + _windows_of("later", "chunks") + """SELECT file_id, chunk_index, start_line, end_line, sha256(text) AS content_hash, (CASE WHEN file_id % 3 = 1 THEN 2 ELSE 1 END)::INTEGER AS run,
  file_id % 3 = 1 AND sha256(text) IN (SELECT sha256(text) FROM first) AS reused FROM chunks""", "files"))
def incremental_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after all files and then, a third of them changed and some gone, once more."""
    files = corpus.files(spark, sf_dir).select("file_id", "text")
    index = indexing.Index(spark, scratch_path(spark, "index"))
    provider = indexing.Provider("word-counts", 16, word_counts)
    index.run(files, provider, tag="first")
    text = F.when(F.col("file_id") % 3 == 1, F.concat("text", F.lit("\nchanged "), F.col("file_id").cast("string"))).otherwise(F.col("text"))
    index.run(files.where("file_id % 7 <> 2").withColumn("text", text), provider, tag="second")
    return index.chunks().select("file_id", "chunk_index", "start_line", "end_line", "content_hash", "run", "reused")
