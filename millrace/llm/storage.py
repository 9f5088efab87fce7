"""Binary files that tasks write to and read from the shared folder."""

from __future__ import annotations

import gc
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import discard, qualified, scratch_path, settle

__all__ = ["discard", "drop_shuffles", "filesystem", "new_file_name", "numbered", "qualified", "scratch_path", "settle", "unused_name"]


def filesystem(uri: str):
    """(pyarrow filesystem, path inside it) of a local, HDFS or object-store URI, as
    ``qualified`` gives it on the driver; tasks do not guess a scheme."""
    from pyarrow import fs

    if not urlparse(uri).scheme:
        raise ValueError(f"no scheme in {uri}")
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nothing refers to any more. It does
    so when the driver's heap is collected, which by itself may be long after."""
    gc.collect()
    spark._jvm.System.gc()


def new_file_name(kind: str) -> str:
    """A name no other task or attempt uses. Readers only open files that a
    settled manifest names, so files of failed attempts are never read."""
    return f"{kind}-{uuid.uuid4().hex}"


def unused_name(df: DataFrame, name: str) -> str:
    """``name``, after as many underscores as make it none of the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named by place, as names with dots cannot go to tasks."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])
