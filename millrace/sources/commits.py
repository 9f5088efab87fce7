"""Numbered commits in a folder that all machines share: what a reader takes as done."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class CommitLog:
    """Entries (JSON objects) by place, from 0. An entry is written whole under another name
    and then renamed to its place, which fails if there is one: of two writers that saw the
    same last entry one gets the place, and a reader never sees half an entry.

    Where a file system renames by copying (most object stores), two writers can both believe
    that they got it: keep such folders on HDFS or another file system with atomic renames, or
    let one writer at a time commit.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def entries(self) -> list[dict]:
        fs, path = self._path()
        if not fs.exists(path):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(path))
        out = []
        for name in names:
            if name.endswith(".json") and not name.startswith((".", "_")):
                fs, path = self._path(name)
                stream = fs.open(path)
                try:
                    out.append(json.loads(bytes(stream.readAllBytes()).decode()))
                finally:
                    stream.close()
        return out

    def append(self, entry: dict, place: int) -> bool:
        """Commit ``entry`` as that of ``place``, the number of entries seen; False if another writer was first."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        fs, new = self._path(f"_{uuid.uuid4().hex}")
        _, final = self._path(f"{place:012d}.json")
        stream = fs.create(new, False)
        try:
            stream.write(bytearray(json.dumps(entry).encode()))
        finally:
            stream.close()
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(new).toUri(), conf).rename(fs.makeQualified(new), fs.makeQualified(final), self.spark.sparkContext._gateway.new_array(rename, 0))
        except Py4JJavaError as e:
            fs.delete(new, False)
            if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise
        return True
