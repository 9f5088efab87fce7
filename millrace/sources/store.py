"""A table kept by key: rows are inserted, replaced and removed bucket by bucket.

A change writes the buckets that it touches anew, under a folder of its own, and commits
the list of the folders that now count. Until then readers have the table as it was, and a
change that is cut short has changed nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .commits import CommitLog
from .scratch import discard, settle

#: Rows to a bucket that a store is laid out for: an upsert rewrites whole buckets.
BUCKET_ROWS = 500_000


def _log(spark: SparkSession, path: str) -> CommitLog:
    return CommitLog(spark, f"{path.rstrip('/')}/_commits")


def _bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def _written(df: DataFrame, path: str) -> dict[str, str]:
    """Write ``df`` (with bucket) to a new folder; the folder of each bucket that has rows."""
    spark, layer = df.sparkSession, f"layer-{uuid.uuid4().hex}"
    df.write.partitionBy("bucket").parquet(f"{path.rstrip('/')}/{layer}")
    there = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{layer}")
    names = [s.getPath().getName() for s in there.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(there)]
    return {n.removeprefix("bucket="): f"{layer}/{n}" for n in names if n.startswith("bucket=")}


def create_store(df: DataFrame, path: str, key: str, buckets: int | None = None) -> None:
    """Write ``df`` as a store by ``key``, in place of one that is there. Each key should come
    once. The number of buckets, by the rows unless it is given, stays that of the store."""
    log = _log(df.sparkSession, path)
    held = log.entries()
    n = buckets or max(1, -(-df.count() // BUCKET_ROWS))
    entry = {"key": key, "buckets": n, "schema": df.schema.json(), "folders": _written(_bucketed(df, key, n), path)}
    if not log.append(entry, len(held)):
        raise RuntimeError(f"another writer changed {path}")


def read_store(spark: SparkSession, path: str, buckets: list[str] | None = None) -> DataFrame:
    """The rows of the store, or of some of its buckets."""
    now = _log(spark, path).entries()[-1]
    folders = [f"{path.rstrip('/')}/{f}" for b, f in now["folders"].items() if buckets is None or b in buckets]
    schema = StructType.fromJson(json.loads(now["schema"]))
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _change(path: str, keys: DataFrame, new: DataFrame | None, key: str) -> None:
    spark = keys.sparkSession
    log = _log(spark, path)
    held = log.entries()
    if not held:
        raise ValueError(f"there is no store at {path}")
    now = held[-1]
    if now["key"] != key:
        raise ValueError(f"the store at {path} is kept by {now['key']}, not {key}")
    touched = [str(r.bucket) for r in _bucketed(keys.select(key), key, now["buckets"]).select("bucket").distinct().collect()]  # a fixed number
    rows = read_store(spark, path, touched).join(keys.select(key).distinct(), key, "left_anti")
    rows = rows if new is None else rows.unionByName(new.select(rows.columns))
    folders = {b: f for b, f in now["folders"].items() if b not in touched} | _written(_bucketed(rows, key, now["buckets"]), path)
    if not log.append(now | {"folders": folders}, len(held)):
        raise RuntimeError(f"another writer changed {path}")


def upsert(path: str, rows: DataFrame, key: str) -> None:
    """Insert ``rows`` or put them in place of those of the same ``key``; other buckets are not touched."""
    _change(path, rows, rows, key)


def delete(path: str, keys: DataFrame, key: str) -> None:
    """Remove the rows whose ``key`` is among ``keys``; other buckets are not touched."""
    _change(path, keys, None, key)


def cascade(removals: list[tuple[str, DataFrame, str]]) -> list[int]:
    """Remove rows of several stores, (path, keys, key) each, and say how many keys went from each.

    All keys are settled before the first store changes, so that what is owned can be found
    by owners that are removed in the same call. The order is the caller's: what is searched
    (vectors) goes first and owners last, so that a call cut short leaves nothing that points
    to what is gone; made again, it removes the rest.
    """
    settled = [(path, settle(keys.select(key).distinct(), "cascade"), key) for path, keys, key in removals]
    counts = []
    for path, keys, key in settled:
        spark = keys.sparkSession
        counts.append(read_store(spark, path).join(keys, key, "left_semi").count())
        if counts[-1]:
            delete(path, keys, key)
    for _, keys, _ in settled:
        discard(keys)
    return counts
