"""File scans: classification, exclusions, workspace figures, trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths


def classify(files: DataFrame, gitignore: list[str] | None = None) -> DataFrame:
    """``files`` (path, size_bytes) with language, hidden flag, reason of exclusion
    (null if kept) and whether a directory above is not entered at all."""
    path = F.col("path")
    ignored = paths.gitignore_verdict(path, gitignore) if gitignore else None
    return files.select("*", paths.language(path).alias("language"), paths.is_hidden(path).alias("is_hidden"), paths.exclusion_reason(path, F.col("size_bytes"), ignored).alias("reason"), paths.in_ignored_directory(path).alias("pruned"))


def workspace(classified: DataFrame) -> DataFrame:
    """Per repository: files seen, kept, supported, ignored, and bytes kept."""
    kept = F.col("reason").isNull()
    return classified.where(~F.col("pruned")).groupBy("repository_id").agg(
        F.count("*").alias("total_files"), F.count_if(kept).alias("kept_files"), F.count_if(kept & F.col("language").isNotNull()).alias("supported_files"),
        F.count_if(~kept).alias("ignored_files"), F.coalesce(F.sum(F.when(kept, F.col("size_bytes"))), F.lit(0)).alias("kept_bytes"), F.count_if(kept & F.col("is_hidden")).alias("hidden_files"),
    )


def tree(files: DataFrame) -> DataFrame:
    """(repository_id, node, parent, depth, kind, files): folders and files as a flat tree."""
    parts = F.split("path", "/")
    steps = files.select("repository_id", "path", F.size(parts).alias("n"), F.posexplode(parts).alias("at", "part"))
    node = F.array_join(F.slice(F.split("path", "/"), F.lit(1), F.col("at") + 1), "/")
    parent = F.when(F.col("at") > 0, F.array_join(F.slice(F.split("path", "/"), F.lit(1), F.col("at")), "/"))
    placed = steps.select("repository_id", node.alias("node"), parent.alias("parent"), (F.col("at") + 1).alias("depth"), F.when(F.col("at") + 1 == F.col("n"), "file").otherwise("folder").alias("kind"))
    return placed.groupBy("repository_id", "node", "parent", "depth", "kind").agg(F.count("*").alias("files"))
