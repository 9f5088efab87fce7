"""Chunks of files by lines, and what of them needs work again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..corpus import split_lines

WINDOW, OVERLAP_LINES = 40, 5
MAX_CHARS, SPLIT_OVERLAP = 3500, 3


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def line_text(lines: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end``, one-based, joined again."""
    return F.array_join(F.slice(lines, start.cast("int"), (end - start + 1).cast("int")), "\n")


def windows(files: DataFrame) -> DataFrame:
    """(file_id, chunk_index, start_line, end_line, text): windows of WINDOW lines that
    share OVERLAP_LINES, up to the first that reaches the end; blank ones are left out
    and do not count. ``files`` (file_id, text)."""
    step = WINDOW - OVERLAP_LINES
    lines = files.where("text IS NOT NULL").select("file_id", split_lines(F.col("text")).alias("lines")).withColumn("n", F.size("lines")).where("n > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("n") - OVERLAP_LINES), F.lit(step))
    cut = F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + WINDOW - 1, F.col("n")).alias("end"), stripped(line_text(F.col("lines"), s, F.least(s + WINDOW - 1, F.col("n")))).alias("text")))
    kept = F.filter(cut, lambda c: c.text != "")
    out = lines.select("file_id", F.posexplode(kept).alias("chunk_index", "c"))
    return out.select("file_id", "chunk_index", F.col("c.start").alias("start_line"), F.col("c.end").alias("end_line"), F.col("c.text").alias("text"))


def by_symbol(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_id, symbol_id, chunk_type, start_line, end_line, text): the text before the
    first symbol, and each symbol's lines; those over MAX_CHARS are marked for splitting.
    ``symbols`` (file_id, symbol_id, start_line, end_line), outermost ones only."""
    lines = files.where("text IS NOT NULL").select("file_id", split_lines(F.col("text")).alias("lines"))
    lead = symbols.groupBy("file_id").agg(F.min("start_line").alias("first")).where("first > 1").select("file_id", F.lit(None).cast("long").alias("symbol_id"), F.lit(1).cast("long").alias("start_line"), (F.col("first") - 1).alias("end_line"))
    spans = symbols.select("file_id", "symbol_id", "start_line", "end_line").union(lead)
    clipped = spans.join(lines, "file_id").withColumn("end_line", F.least("end_line", F.size("lines").cast("long"))).where("start_line <= end_line AND start_line >= 1")
    text = stripped(line_text(F.col("lines"), F.col("start_line"), F.col("end_line")))
    out = clipped.select("file_id", "symbol_id", "start_line", "end_line", text.alias("text")).where("text <> ''")
    kind = F.when(F.col("symbol_id").isNull(), "fallback").when(F.length("text") > MAX_CHARS, "symbol_split").otherwise("symbol")
    return out.withColumn("chunk_type", kind)


def pack(lengths: list[int], most: int = MAX_CHARS, overlap: int = SPLIT_OVERLAP) -> list[tuple[int, int]]:
    """(first, last) places of lines packed greedily; neighbours share ``overlap`` lines,
    each begins later than the one before, and one line over ``most`` stands alone."""
    out, first, n = [], 0, len(lengths)
    while first < n:
        last, size = first, lengths[first]
        while last + 1 < n and size + 1 + lengths[last + 1] <= most:
            last += 1
            size += 1 + lengths[last]
        out.append((first, last))
        if last + 1 >= n:
            break
        first = max(last + 1 - overlap, first + 1)
    return out


def split_long(chunks: DataFrame) -> DataFrame:
    """(file_id, part, start_line, end_line, chars) of texts cut by lines. ``chunks`` (file_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file_id, text in zip(batch["file_id"], batch["text"]):
                lengths = [len(line) for line in (text or "").split("\n")]
                for part, (a, b) in enumerate(pack(lengths)):
                    rows.append((file_id, part, a + 1, b + 1, sum(lengths[a : b + 1]) + b - a))
            yield pd.DataFrame(rows, columns=["file_id", "part", "start_line", "end_line", "chars"])

    return chunks.select("file_id", "text").mapInPandas(run, "file_id long, part int, start_line int, end_line int, chars long")


def work_list(files: DataFrame, indexed: DataFrame, version: Column) -> DataFrame:
    """Files without a chunk of the same content and model version.
    ``indexed`` (file_id, file_content_hash, embedding_model_version)."""
    done = indexed.where(F.col("embedding_model_version") == version).select("file_id", F.col("file_content_hash").alias("content_hash")).distinct()
    return files.join(done, ["file_id", "content_hash"], "left_anti")


def cache_split(chunks: DataFrame, cached: DataFrame) -> DataFrame:
    """(content_hash, uses, hit): each different text once, and whether its vector is known.
    ``chunks`` (content_hash), ``cached`` (content_hash)."""
    uses = chunks.groupBy("content_hash").agg(F.count("*").alias("uses"))
    return uses.join(cached.select("content_hash").distinct().withColumn("known", F.lit(True)), "content_hash", "left").select("content_hash", "uses", F.coalesce("known", F.lit(False)).alias("hit"))


def hashed_words(texts: DataFrame, dim: int = 64) -> DataFrame:
    """(file_id, place, weight): a deterministic embedding, the counts of words by hash
    bucket over their Euclidean length. ``texts`` (file_id, text)."""
    words = texts.select("file_id", F.explode(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != "")).alias("word"))
    counts = words.groupBy("file_id", "word").agg(F.count("*").alias("n"))
    place = (F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("long") % dim).alias("place")
    sums = counts.groupBy("file_id", place).agg(F.sum("n").alias("n"))
    norms = sums.groupBy("file_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double")).alias("norm"))
    return sums.join(norms, "file_id").select("file_id", "place", (F.col("n") / F.col("norm")).alias("weight"))
