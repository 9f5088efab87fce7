"""Incremental indexing: changed files are cut, embedded and committed as one snapshot.

A run reads the current snapshot, works on files whose text or model is new, takes the
vectors of known texts over, embeds the rest batch by batch and commits a layer. A file's
newest layer counts, so nothing of earlier layers is rewritten. The files given are read more than once. A run that fails, or is
killed at any point, commits nothing: the snapshot before it stays what readers see.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.commits import CommitLog
from ..sources.scratch import discard, remove, settle
from .chunking import windows, work_list

#: Files that are embedded, and fail, together.
FILE_BATCH = 25
_CHUNK = "file_id long, chunk_index int, start_line int, end_line int, text string, content_hash string, vector array<float>, reused boolean, run int"
_FILE = "file_id long, content_hash string, version string, removed boolean, run int"


@dataclass(frozen=True)
class Provider:
    """What makes vectors of texts. ``embed`` gets up to ``batch_size`` texts and gives a
    vector of ``dimension`` numbers for each; errors of the kinds ``aborts`` end the run,
    others only fail the batch. Model and dimension are the version: vectors of another
    one are never mixed in."""

    model: str
    dimension: int
    embed: Callable[[list[str]], list[list[float]]]
    batch_size: int = 64
    aborts: tuple[type[Exception], ...] = ()

    @property
    def version(self) -> str:
        return f"{self.model}/{self.dimension}"


#: Files whose chunks one task embeds, about, and chunks that it hands on at a time.
TASK_FILES, CHUNK_ROWS = 4_000, 1_024
_PIECE = "file_id long, chunk_index int, start_line int, end_line int, text string, content_hash string"


def embedded(pieces: DataFrame, provider: Provider, files: int) -> DataFrame:
    """The chunks ``pieces`` (batch, _PIECE, known: a vector or null) of about so many ``files``
    with their vectors, then one row without a file_id for each batch with its status: ok,
    failed or abort. Each text of a batch is embedded once. A batch that does not end ok
    has no chunks; its error says why. The texts cross the network once."""
    schema = f"{_PIECE}, vector array<float>, reused boolean, batch long, status string, error string"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.float32()), pa.bool_(), pa.int64(), pa.string(), pa.string()]

    def vectors_of(rows: list[tuple]) -> dict[str, list[float]]:
        todo = sorted({r[5]: r[4] for r in rows if r[6] is None}.items())
        vectors: dict = {}
        for at in range(0, len(todo), provider.batch_size):
            asked = todo[at : at + provider.batch_size]
            part = provider.embed([text for _, text in asked])
            if len(part) != len(asked) or any(len(v) != provider.dimension for v in part):
                raise ValueError(f"{provider.version} gave other vectors than asked for")
            vectors.update(zip((key for key, _ in asked), part))
        return vectors

    def done(batch: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        vectors, status, error = {}, "ok", None
        try:
            vectors = vectors_of(rows)
        except provider.aborts as e:
            rows, status, error = [], "abort", f"{type(e).__name__}: {e}"
        except Exception as e:  # whatever the provider raises fails this batch alone
            rows, status, error = [], "failed", f"{type(e).__name__}: {e}"
        out = [(*r[:6], vectors[r[5]] if r[6] is None else r[6], r[6] is not None, batch, None, None) for r in rows]
        out.append((None,) * 8 + (batch, status, error))
        for at in range(0, len(out), CHUNK_ROWS):
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out[at : at + CHUNK_ROWS]), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for b in batches:
            for batch, *row in zip(*(c.to_pylist() for c in b.columns)):
                if batch != now:
                    if rows:
                        yield from done(now, rows)
                    now, rows = batch, []
                rows.append(row)
        if rows:
            yield from done(now, rows)

    columns = [F.col(c.split()[0]).cast(c.split()[1]) for c in _PIECE.split(", ")]
    tasks = max(pieces.sparkSession.sparkContext.defaultParallelism, -(-files // TASK_FILES))
    return pieces.select("batch", *columns, "known").repartition(tasks, "batch").sortWithinPartitions("batch").mapInArrow(run, schema)


class Index:
    """Chunks of files with their vectors, in snapshots below one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.log = CommitLog(spark, f"{self.folder}/commits")

    def snapshots(self) -> list[dict]:
        """What each committed run said of itself, the current one last."""
        return self.log.entries()

    def _tables(self, at: int | None) -> tuple[DataFrame, DataFrame]:
        """(files, chunks) of the snapshot after ``at`` commits: each file's newest row, and its chunks."""
        held = self.log.entries()[:at]
        layers = held[-1]["layers"] if held else []
        read = lambda kind, schema: self.spark.read.schema(schema).parquet(*[f"{self.folder}/{x}/{kind}" for x in layers]) if layers else self.spark.createDataFrame([], schema)
        files = read("files", _FILE)
        newest = files.groupBy("file_id").agg(F.max("run").alias("run"))
        files = files.join(newest, ["file_id", "run"]).where("NOT removed")
        return files, read("chunks", _CHUNK).join(files.select("file_id", "run"), ["file_id", "run"])

    def chunks(self, at: int | None = None) -> DataFrame:
        """The chunks that count now, or did after ``at`` commits."""
        return self._tables(at)[1].select(*[c.split()[0] for c in _CHUNK.split(", ")])

    def run(self, files: DataFrame, provider: Provider, cut: Callable[[DataFrame], DataFrame] = windows, tag: str | None = None) -> dict:
        """Index ``files`` (file_id, text), all that there are, and commit; what the run adds up to.

        Files that are gone leave the index. A failed batch leaves its files as they were
        before; they are tried again by the next run. ``tag`` names the run: a run whose
        tag is committed is not done again. Null texts have no chunks; null ids are
        left out; of rows with the same id the least text counts.
        """
        held = self.log.entries()
        again = [e for e in held if tag is not None and e["tag"] == tag]
        if again:
            return again[0]
        number = len(held) + 1
        known, old = self._tables(None)
        named = files.where("file_id IS NOT NULL")
        counted = settle(named.groupBy("file_id").agg(F.count("*").alias("n")), "file-ids")
        repeated, one = counted.where("n > 1").select("file_id"), named.select("file_id", "text")
        if repeated.take(1):  # else the texts need not meet by id
            one = one.join(repeated, "file_id", "left_anti").union(one.join(repeated, "file_id", "left_semi").groupBy("file_id").agg(F.min("text")))
        now = one.select(F.col("file_id").cast("long"), "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
        indexed = known.select("file_id", F.col("content_hash").alias("file_content_hash"), F.col("version").alias("embedding_model_version"))
        left = work_list(now, indexed, F.lit(provider.version))
        work = settle(left.select("file_id", "content_hash"), "work")  # without texts, which are cut as they are read again
        considered, todo = counted.count(), work.count()
        batch = F.pmod(F.xxhash64("file_id"), F.lit(max(1, -(-todo // FILE_BATCH)))).alias("batch")

        pieces = cut(left.select("file_id", "text")).withColumn("content_hash", F.sha2("text", 256)).select("*", batch)
        vectors = old.join(known.where(F.col("version") == provider.version).select("file_id"), "file_id", "left_semi").groupBy("content_hash").agg(F.min_by("vector", "file_id").alias("known"))
        layer = f"layer-{uuid.uuid4().hex}"
        made = f"{self.folder}/{layer}/chunks"
        # The status rows lie among the chunks; having no file, they belong to none and no reader meets them.
        embedded(pieces.join(vectors, "content_hash", "left"), provider, todo).withColumn("run", F.lit(number)).write.parquet(made)
        fresh = self.spark.read.schema("file_id long, reused boolean, batch long, status string, error string").parquet(made)
        ends = fresh.where("file_id IS NULL AND status <> 'ok'").select("batch", "status", "error")
        stopped = ends.where("status = 'abort'").first()
        state = {"tag": tag, "version": provider.version, "files_considered": considered, "files_skipped": considered - todo}
        if stopped:
            for table in (counted, work):
                discard(table)
            remove(self.spark, f"{self.folder}/{layer}")
            return state | {"status": "failed", "error": stopped.error}

        good = work.select("file_id", "content_hash", batch).join(ends, "batch", "left_anti")
        gone = known.join(counted.select(F.col("file_id").cast("long")), "file_id", "left_anti").select("file_id", "content_hash", "version", F.lit(True).alias("removed"), F.lit(number).alias("run"))
        done = good.select("file_id", "content_hash", F.lit(provider.version).alias("version"), F.lit(False).alias("removed"), F.lit(number).alias("run"))
        done.union(gone).write.parquet(f"{self.folder}/{layer}/files")
        written = fresh.where("file_id IS NOT NULL").agg(F.count_if("reused").alias("hits"), F.count_if(~F.col("reused")).alias("fresh")).first()
        state |= {"status": "ready", "error": None, "files_failed": todo - good.count(), "chunks_from_cache": written.hits, "chunks_embedded_fresh": written.fresh}
        state["layers"] = (held[-1]["layers"] if held else []) + [layer]
        for table in (counted, work):
            discard(table)
        if not self.log.append(state, len(held)):
            raise RuntimeError("another run committed meanwhile; its snapshot stands")
        return state

    def compact(self) -> None:
        """Put the layers of the current snapshot into one; readers see the same rows."""
        held = self.log.entries()
        if not held or len(held[-1]["layers"]) < 2:
            return
        files, chunks = self._tables(None)
        layer = f"layer-{uuid.uuid4().hex}"
        chunks.select(*[c.split()[0] for c in _CHUNK.split(", ")]).write.parquet(f"{self.folder}/{layer}/chunks")
        files.select(*[c.split()[0] for c in _FILE.split(", ")]).write.parquet(f"{self.folder}/{layer}/files")
        if not self.log.append(held[-1] | {"tag": None, "layers": [layer]}, len(held)):
            raise RuntimeError("another run committed meanwhile; its snapshot stands")
