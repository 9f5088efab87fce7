"""Scans, path predicates and rollups over files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import corpus
from ..functions import keys, paths
from ..operators import scan
from . import fragments as s
from .registry import query

_CLASSIFIED = f""", classified AS (
  SELECT *, {s.language('path')} AS language, starts_with({s.file_name('path')}, '.') AS is_hidden, {s.reason('path', 'size_bytes')} AS reason, {s.pruned('path')} AS pruned FROM files)
"""


@query(corpus.sql(_CLASSIFIED + "SELECT file_id, path, size_bytes, language, is_hidden, coalesce(reason, 'kept') AS verdict, pruned FROM classified", "files"))
def scan_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.classify(corpus.files(spark, sf_dir)).select("file_id", "path", "size_bytes", "language", "is_hidden", F.coalesce("reason", F.lit("kept")).alias("verdict"), "pruned")


@query(corpus.sql(_CLASSIFIED + "SELECT repository_id, reason, count(*) AS files, sum(size_bytes)::BIGINT AS bytes FROM classified WHERE reason IS NOT NULL AND NOT pruned GROUP BY ALL", "files"))
def scan_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan.classify(corpus.files(spark, sf_dir)).where("reason IS NOT NULL AND NOT pruned")
    return out.groupBy("repository_id", "reason").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


@query(corpus.sql(_CLASSIFIED + "SELECT language, is_hidden, count(*) AS files FROM classified WHERE language IS NOT NULL GROUP BY ALL", "files"))
def files_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.classify(corpus.files(spark, sf_dir)).where("language IS NOT NULL").groupBy("language", "is_hidden").agg(F.count("*").alias("files"))


@query(corpus.sql("SELECT repository_id, count(*) AS files, sum(size_bytes)::BIGINT AS bytes, count(*) > 20 OR sum(size_bytes) > 100000 AS too_large FROM files GROUP BY 1", "files"))
def repo_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus.files(spark, sf_dir).groupBy("repository_id").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))
    return files.withColumn("too_large", (F.col("files") > 20) | (F.col("bytes") > 100_000))


@query(corpus.sql(_CLASSIFIED + """SELECT repository_id, count(*) AS total_files, count(*) FILTER (reason IS NULL) AS kept_files, count(*) FILTER (reason IS NULL AND language IS NOT NULL) AS supported_files,
  count(*) FILTER (reason IS NOT NULL) AS ignored_files, coalesce(sum(size_bytes) FILTER (reason IS NULL), 0)::BIGINT AS kept_bytes, count(*) FILTER (reason IS NULL AND is_hidden) AS hidden_files
  FROM classified WHERE NOT pruned GROUP BY 1""", "files"))
def workspace_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.workspace(scan.classify(corpus.files(spark, sf_dir)))


@query(corpus.sql(f"SELECT file_id, {s.module_path('path')} AS module, {s.module_of('path', 1)} AS top, {s.module_of('path', 2)} AS area FROM files", "files"))
def module_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return corpus.files(spark, sf_dir).select("file_id", paths.module_path(path).alias("module"), paths.module_of(path, 1).alias("top"), paths.module_of(path, 2).alias("area"))


@query(corpus.sql(f"SELECT {s.module_of('path', 1)} AS directory, count(*) AS files FROM files GROUP BY 1 ORDER BY files DESC, directory LIMIT 10", "files"))
def module_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.files(spark, sf_dir).groupBy(paths.module_of(F.col("path"), 1).alias("directory")).agg(F.count("*").alias("files")).orderBy(F.desc("files"), "directory").limit(10)


@query(corpus.sql("SELECT array_to_string(string_split(module_id, '.')[1:2], '.') AS area, count(*) AS modules FROM modules GROUP BY 1 HAVING count(*) >= 2 ORDER BY modules DESC, area LIMIT 7", "modules"))
def module_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = F.array_join(F.slice(F.split("module_id", r"\."), 1, 2), ".")
    return corpus.modules(spark, sf_dir).groupBy(area.alias("area")).agg(F.count("*").alias("modules")).where("modules >= 2").orderBy(F.desc("modules"), "area").limit(7)


@query(corpus.sql(f"SELECT file_id, {s.is_doc('path')} AS is_doc, {s.is_config('path')} AS is_config, {s.is_persistence('path')} AS is_persistence, {s.is_entry('path')} AS is_entry FROM files", "files"))
def path_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return corpus.files(spark, sf_dir).select("file_id", paths.is_doc(path).alias("is_doc"), paths.is_config(path).alias("is_config"), paths.is_persistence(path).alias("is_persistence"), paths.is_entry_point(path).alias("is_entry"))


@query(corpus.sql(f"SELECT file_id, {s.test_search('path')} AS in_search, {s.test_summary('path')} AS in_summary, {s.test_reports('path')} AS in_reports FROM files", "files"))
def test_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return corpus.files(spark, sf_dir).select("file_id", paths.is_test_for_search(path).alias("in_search"), paths.is_test_for_summary(path).alias("in_summary"), paths.is_test_for_reports(path).alias("in_reports"))


@query(corpus.sql(f"SELECT repository_id, {s.module_kind('module_id')} AS kind, count(*) AS modules FROM modules GROUP BY ALL", "modules"))
def module_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.modules(spark, sf_dir).groupBy("repository_id", paths.module_kind(F.col("module_id")).alias("kind")).agg(F.count("*").alias("modules"))


@query(corpus.sql(""", steps AS (SELECT repository_id, string_split(path, '/') AS p, unnest(range(1, len(string_split(path, '/')) + 1)) AS depth FROM files)
SELECT repository_id, array_to_string(p[1:depth], '/') AS node, CASE WHEN depth > 1 THEN array_to_string(p[1:depth - 1], '/') END AS parent, depth::INTEGER AS depth,
       CASE WHEN depth = len(p) THEN 'file' ELSE 'folder' END AS kind, count(*) AS files FROM steps GROUP BY ALL""", "files"))
def path_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.tree(corpus.files(spark, sf_dir))


@query(corpus.sql("SELECT repository_id, content_hash, min(file_id) AS first_file, count(*) AS copies FROM files GROUP BY ALL", "files"))
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus.files(spark, sf_dir).select("repository_id", "file_id", keys.content_hash(F.col("text")).alias("content_hash"))
    return files.groupBy("repository_id", "content_hash").agg(F.min("file_id").alias("first_file"), F.count("*").alias("copies"))


@query(corpus.sql(f"SELECT file_id, {s.embed_eligible('path', 'size_bytes')} AS eligible FROM files", "files"))
def embed_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.files(spark, sf_dir).select("file_id", paths.embed_eligible(F.col("path"), F.col("size_bytes")).alias("eligible"))


@query(corpus.sql(_CLASSIFIED + "SELECT path, reason FROM classified WHERE reason IS NOT NULL AND NOT pruned ORDER BY path LIMIT 200", "files"))
def excluded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.classify(corpus.files(spark, sf_dir)).where("reason IS NOT NULL AND NOT pruned").select("path", "reason").orderBy("path").limit(200)
