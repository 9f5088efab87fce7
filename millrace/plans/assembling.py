"""Whole reports over the files, imports, symbols and calls of every repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import corpus
from ..functions import paths
from ..operators import assembled, graph, resolve
from ..sources.scratch import settle
from . import symbols
from .registry import query


def facts(spark: SparkSession, sf_dir: str) -> assembled.Facts:
    """What the reports are made of. Modules are files that import each other within a repository."""
    path = F.col("path")
    files = settle(corpus.files(spark, sf_dir).select("file_id", "repository_id", "path", paths.language(path).alias("language"), paths.is_test_for_reports(path).alias("is_test"), paths.is_doc(path).alias("is_doc"), paths.is_entry_point(path).alias("is_entry")), "report-files")
    resolved = settle(resolve.resolve_imports(symbols.imports(spark, sf_dir), files.select("path")), "report-imports")
    homes = files.select(F.col("path").alias("target"), F.col("repository_id").alias("other"))
    within = resolved.join(files.select(F.col("path").alias("source"), "repository_id"), "source").join(homes, "target").where("repository_id = other")
    edges = settle(within.select("repository_id", paths.module_path(F.col("source")).alias("source"), paths.module_path(F.col("target")).alias("target")).distinct(), "report-edges")
    orphans = files.where("language IS NOT NULL AND NOT is_entry").join(resolved.select(F.col("target").alias("path")), "path", "left_anti").select("repository_id", "path")
    named = corpus.symbols(spark, sf_dir).join(files.select("file_id", "repository_id", "path"), "file_id").select("symbol_id", "qualified_name", "repository_id", "path")
    kinds = corpus.relations(spark, sf_dir).where("relationship_type IN ('calls', 'extends', 'implements')").join(named.select(F.col("symbol_id").alias("source"), "repository_id", F.col("qualified_name").alias("caller")), "source")
    calls = kinds.where("relationship_type = 'calls'").join(named.select(F.col("symbol_id").alias("target"), F.col("qualified_name").alias("callee")), "target")
    return assembled.Facts(
        repositories=files.select("repository_id", F.col("repository_id").alias("name"), F.lit(True).alias("computed")).distinct(), files=files, symbols=named.select("repository_id", "path"), edges=edges,
        cycles=settle(graph.cycle_listing(edges).select("repository_id", "place", "path"), "report-cycles"), orphans=orphans,
        calls=calls.select("repository_id", F.col("caller").alias("source"), F.col("callee").alias("target")), inheritance=kinds.where("relationship_type <> 'calls'").select("repository_id"),
    )


def _flat(report: DataFrame) -> DataFrame:
    return report.select("repository_id", "summary", "ordinal", "heading", "content", "confidence", F.array_join("findings", "\n").alias("findings"))


@query()
def report_dependency_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cycles that it lists have no SQL."""
    return _flat(assembled.dependency_risk(facts(spark, sf_dir)))


@query()
def report_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(assembled.health(facts(spark, sf_dir)))
