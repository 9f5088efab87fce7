"""Tables in the folder that all machines share: they cut lineage and survive lost executors.

The folder is the session's ``spark.checkpoint.dir``. Only a local master may do
without: it has the warehouse instead. On a cluster the setting must be there, as
the machines' own folders are no place that all can read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of its file system: the session's default one if it names none."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(there).toString()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return qualified(spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a shared Parquet table and return the table."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._settled = path
    return table


def discard(table: DataFrame) -> None:
    """Remove the files of a settled table that nothing reads any more."""
    path = getattr(table, "_settled", None)
    if path:
        remove(table.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder of ours with all that is in it."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at ``path``, in whatever file system it names."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)
