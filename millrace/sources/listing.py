"""Files below a folder, level by level: a folder that scans do not enter is never listed.

Each level is one job: its folders are dealt to tasks, which list them and give what is in
them; the folders found make the next level. So a scan takes as many jobs as the tree is
deep, and the driver holds no list of files. Works on local, HDFS and object-store paths.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from .scratch import discard, qualified, settle

_ENTRY = "path string, kind string, size_bytes long, last_modified timestamp"


def list_tree(spark: SparkSession, root: str, ignored: list[str] | None = None) -> DataFrame:
    """(path, kind, size_bytes, last_modified): files and entered folders below ``root``,
    paths relative to it. Folders of a name in ``ignored`` are neither entered nor given. A
    folder that is gone when it is listed has nothing in it; a root that is missing fails."""
    base = qualified(spark, root).rstrip("/")
    names = set(paths.IGNORED_DIRECTORIES if ignored is None else ignored)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        uri = "file://" + base[len("file:"):] if base.startswith("file:/") and not base.startswith("file://") else base
        there, top = fs.FileSystem.from_uri(uri)
        for folder in (f for b in batches for f in b.column(0).to_pylist()):
            found = there.get_file_info(fs.FileSelector(f"{top}/{folder}".rstrip("/"), allow_not_found=bool(folder)))
            rows = [(f"{folder}/{i.base_name}".lstrip("/"), i) for i in found if i.type == fs.FileType.File or i.type == fs.FileType.Directory and i.base_name not in names]
            files = [i.type == fs.FileType.File for _, i in rows]
            yield pa.record_batch(
                [pa.array([p for p, _ in rows], pa.string()), pa.array(["file" if f else "folder" for f in files], pa.string()), pa.array([i.size if f else None for f, (_, i) in zip(files, rows)], pa.int64()),
                 pa.array([i.mtime for _, i in rows], pa.timestamp("us", tz="UTC"))],
                names=["path", "kind", "size_bytes", "last_modified"],
            )

    levels: list[DataFrame] = []
    front = spark.createDataFrame([("",)], "path string")
    while True:
        level = settle(front.repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, _ENTRY), "listing")
        levels.append(level)
        front = level.where("kind = 'folder'").select("path")
        if not front.take(1):
            break
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    whole = settle(out, "tree")
    for level in levels:
        discard(level)
    return whole


def scan_tree(
    spark: SparkSession, root: str, repository: str, respect_gitignore: bool = True, more_directories: tuple[str, ...] = (), more_names: tuple[str, ...] = (), more_suffixes: tuple[str, ...] = (), most: int = paths.MAX_FILE_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """(files, figures) of a source tree.

    ``files`` (repository_id, path, size_bytes, last_modified, language, is_hidden, reason):
    all files below folders that are entered; ``reason`` says why one is left out, null if it
    is kept. ``figures`` (repository_id, folder_count, total_files, supported_files,
    repository_size_bytes, excluded_count): one row. The root's gitignore file counts unless
    ``respect_gitignore`` is off; those of other folders do not.
    """
    tree = list_tree(spark, root, [*paths.IGNORED_DIRECTORIES, *more_directories])
    lines: list[str] = []
    if respect_gitignore and tree.where("path = '.gitignore' AND kind = 'file'").take(1):
        there = spark._jvm.org.apache.hadoop.fs.Path(f"{qualified(spark, root).rstrip('/')}/.gitignore")
        stream = there.getFileSystem(spark._jsc.hadoopConfiguration()).open(there)  # readers of tables leave hidden files out
        try:
            lines = bytes(stream.readAllBytes()).decode("utf-8", "ignore").splitlines()
        finally:
            stream.close()
    path = F.col("path")
    ignored = paths.gitignore_verdict(path, lines) if lines else None
    extra = paths.file_name(path).isin(list(more_names)) if more_names else F.lit(False)
    ending = paths.any_of(paths.file_name(path), list(more_suffixes), "endswith") if more_suffixes else F.lit(False)
    reason = F.when(extra, "filename_rule").when(ending, "suffix_rule").otherwise(paths.exclusion_reason(path, F.col("size_bytes"), ignored, most))
    files = tree.where("kind = 'file'").select(F.lit(repository).alias("repository_id"), "path", "size_bytes", "last_modified", paths.language(path).alias("language"), paths.is_hidden(path).alias("is_hidden"), reason.alias("reason"))
    kept, is_file = F.col("reason").isNull() & F.col("file"), F.col("file")
    both = files.select(F.lit(True).alias("file"), "reason", "language", "size_bytes").union(tree.where("kind = 'folder'").select(F.lit(False), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("long")))
    figures = both.agg(
        F.count_if(~is_file).alias("folder_count"), F.count_if(kept).alias("total_files"), F.count_if(kept & F.col("language").isNotNull()).alias("supported_files"),
        F.coalesce(F.sum(F.when(kept, F.col("size_bytes"))), F.lit(0)).alias("repository_size_bytes"), F.count_if(is_file & ~kept).alias("excluded_count"),
    )
    return files, figures.select(F.lit(repository).alias("repository_id"), "*")
