"""Token counts as delta-maintained rollups.

Each batch of inserts, deletes and revised counts becomes signed rows, which are
kept by document (the ledger) and summed by source, language and tokenizer
version (the rollup). Totals are sums over committed batches, so no batch
rewrites another. A batch counts once its entry stands in the commit log, last;
committing a batch again, or one that failed half-way, changes nothing twice. A
batch reads the ledger rows of the documents that it names only, and ``compact``
sums many batches into one. Of two writers at a time one fails: an entry takes the
place after those that its writer has read, and a place is taken once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.commits import CommitLog
from .storage import settle

_LEDGER = "doc_id long, version string, source string, lang string, docs long, tokens long"
_ROLLUP = "source string, lang string, version string, docs long, tokens long"
_KEYS = ["source", "lang", "version"]


class TokenCounts:
    """Rollups in one folder that all machines share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.log = CommitLog(spark, f"{self.folder}/commits")

    def batches(self) -> list[str]:
        """Ids of all committed batches, those in compacted ones included."""
        return [b for e in self.log.entries() for b in e["batches"]]

    def _live(self) -> list[str]:
        """Folders that count: the last compacted one and those after it."""
        held = self.log.entries()
        start = max((i for i, e in enumerate(held) if e["kind"] == "all"), default=0)
        return [e["folder"] for e in held[start:]]

    def _read(self, kind: str, schema: str) -> DataFrame:
        paths = [f"{self.folder}/{kind}/{b}" for b in self._live()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def ledger(self, named: DataFrame | None = None) -> DataFrame:
        """(doc_id, version, source, lang, docs, tokens): what now stands for each document,
        with ``named`` (doc_id) of those only."""
        rows = self._read("ledger", _LEDGER)
        if named is not None:
            rows = rows.join(named.select(F.col("doc_id").alias("wanted")), rows.doc_id.eqNullSafe(F.col("wanted")), "left_semi")
        sums = rows.groupBy("doc_id", "version", "source", "lang").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs <> 0 OR tokens <> 0")

    def totals(self) -> DataFrame:
        """(source, lang, version, docs, tokens), groups without documents left out."""
        return self._read("rollup", _ROLLUP).groupBy(*_KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")

    def commit(self, batch: str, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> bool:
        """Apply a batch; False if it was committed before.

        ``upserts`` (doc_id, source, lang, version, n_tokens) replaces what the
        document has for that version: an insert where there was nothing, else a
        revised count. ``deletes`` (doc_id) takes back every version of the
        document. Several upserts of one key in a batch all count, as rows of a
        repeated document do; a document both deleted and upserted ends as
        upserted. Ids, sources, languages and counts may be null: null ids match
        each other, and a null count adds a document without tokens. Empty tables
        commit a batch that changes nothing; texts are counted before, whatever
        their length. Another writer's commit meanwhile makes this one fail.
        """
        if not batch or any(c in batch for c in "/\\"):
            raise ValueError("a batch id is a plain name")
        held = self.log.entries()
        if any(batch in e["batches"] for e in held):
            return False
        empty_up = self.spark.createDataFrame([], "doc_id long, source string, lang string, version string, n_tokens long")
        upserts = empty_up if upserts is None else upserts
        added = upserts.select(F.col("doc_id").cast("long").alias("doc_id"), "version", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.lit(1).cast("long").alias("docs"), F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("tokens"))
        signed = added
        if held:
            touched = added.select("doc_id")
            if deletes is not None:
                gone = settle(deletes.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "deleted-ids")
                touched = touched.union(gone)
            standing = self.ledger(touched.distinct())
            named = added.select(F.col("doc_id").alias("u_doc"), F.col("version").alias("u_version")).distinct()
            replaced = standing.join(named, standing.doc_id.eqNullSafe(F.col("u_doc")) & standing.version.eqNullSafe(F.col("u_version")), "left_semi")
            if deletes is not None:
                gone = gone.select(F.col("doc_id").alias("d_doc"))
                replaced = replaced.union(standing.join(gone, standing.doc_id.eqNullSafe(F.col("d_doc")), "left_semi")).distinct()
            signed = added.union(replaced.select("doc_id", "version", "source", "lang", (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens")))
        return self._write(len(held), "one", batch, signed, [batch])

    def _write(self, place: int, kind: str, name: str, signed: DataFrame, batches: list[str]) -> bool:
        folder = f"{place:09d}-{name}-{uuid.uuid4().hex}"
        target = f"{self.folder}/ledger/{folder}"
        signed.write.parquet(target)
        written = self.spark.read.schema(_LEDGER).parquet(target)
        written.groupBy(*_KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.parquet(f"{self.folder}/rollup/{folder}")
        if not self.log.append({"kind": kind, "folder": folder, "batches": batches}, place):
            raise RuntimeError(f"place {place} exists: another writer committed meanwhile")
        return True

    def compact(self) -> bool:
        """Sum all batches into one, which then counts instead of them; False if there is none."""
        held = self.log.entries()
        if not held:
            return False
        return self._write(len(held), "all", "compacted", self.ledger(), [])


def counted(docs: DataFrame, count: Column, version: str) -> DataFrame:
    """Upserts of ``docs`` (doc_id, source, lang and what ``count`` reads)."""
    return docs.select("doc_id", "source", "lang", F.lit(version).alias("version"), count.cast("long").alias("n_tokens"))


def matches(text: str, pattern: str) -> Column:
    """How often ``pattern`` occurs in the whole text; zero for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(pattern)), F.lit(0))
