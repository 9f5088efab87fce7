"""Content identities and cache keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def corpus_version(chunks: Column, model: Column, indexed_at: Column) -> Column:
    """``chunks:model:time``, or ``unindexed`` where nothing was indexed."""
    return F.coalesce(F.concat(chunks.cast("string"), F.lit(":"), model, F.lit(":"), indexed_at.cast("string")), F.lit("unindexed"))


def cache_key(repository: Column, query: Column, top_k: Column, sources: Column, version: Column, rerank: Column, namespace: str = "retrieval") -> Column:
    """Key of all that decides a search result; source order and query case do not."""
    parts = F.concat_ws("|", repository, F.lower(query), top_k.cast("string"), F.array_join(F.array_sort(sources), ","), version, F.concat(F.lit("rerank="), F.initcap(rerank.cast("string"))))
    return F.concat(F.lit(namespace + ":"), repository, F.lit(":"), F.sha2(parts, 256))


def dedup_key(chunk: Column, symbol: Column, file: Column) -> Column:
    """Identity of a candidate: its chunk, else its symbol, else its file."""
    return F.coalesce(F.concat(F.lit("chunk:"), chunk), F.concat(F.lit("symbol:"), symbol), F.concat(F.lit("file:"), file))
