"""Readers and sinks of the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source_tree(spark: SparkSession, root: str, repository: str) -> DataFrame:
    """(repository_id, path, size_bytes, last_modified, text): all files below ``root``, binary
    ones without text. The content column is only read if ``text`` is used."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").removeprefix("file://")
    path = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    return found.select(F.lit(repository).alias("repository_id"), F.substring(path, len(base) + 2, 1 << 30).alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("last_modified"), F.when(F.is_valid_utf8("content"), F.decode("content", "UTF-8")).alias("text"))


def json_log(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """Lines of a JSON log as the struct ``record``, or ``raw`` where a line is no JSON object."""
    lines = spark.read.text(path)
    return lines.select("value", F.when(F.json_object_keys("value").isNotNull(), F.from_json("value", fields)).alias("record"), F.when(F.json_object_keys("value").isNull(), F.col("value")).alias("raw"))


def replace_partitions(df: DataFrame, path: str, *keys: str) -> None:
    """Write ``df`` so that exactly the partitions of ``keys`` that it holds are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def append(df: DataFrame, path: str, *keys: str) -> None:
    """Add rows; earlier ones stay as they are."""
    (df.write.mode("append").partitionBy(*keys) if keys else df.write.mode("append")).parquet(path)


def drop_repositories(tables: dict[str, DataFrame], repositories: DataFrame, owned_by: dict[str, tuple[str, str, str]]) -> dict[str, DataFrame]:
    """What is left of ``tables`` once ``repositories`` (repository_id) go.

    A table with a repository_id loses its own rows; ``owned_by`` names for each of the
    others the table that owns it, its key and the owner's key: what lost its owner goes
    too, whatever the depth. Owners come before what they own.
    """
    left: dict[str, DataFrame] = {}
    for name, df in tables.items():
        if name in owned_by:
            owner, key, owner_key = owned_by[name]
            left[name] = df.join(left[owner].select(F.col(owner_key).alias(key)).distinct(), key, "left_semi")
        else:
            left[name] = df.join(repositories.select("repository_id"), "repository_id", "left_anti")
    return left
