"""Substring dedup by hashing lines and the pieces they hold.

A text is cut into units at line ends, at sentence ends and before a capitalised
word that follows a lower-case one (so that a passage set into the middle of a
line still begins a unit), and within these at words that their neighbours alone
choose (so that what stands before and after a passage does not move the cuts
inside it). A unit is normalised to its lower-case words; digests of 128 bits are
grouped over all documents, and the occurrence in the smallest doc_id, the first
one within it, is kept. Of the others, runs of neighbouring units that hold
``min_words`` words or more together are cut out; with ``min_words=1`` every later
occurrence goes. Spans cut are offsets in the original text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_WORDS = 20
#: A cut within a unit is the least of the word pairs up to NEAR words around it, with more than NEAR words of the unit before and after it.
NEAR = 3
#: Characters hashed at once, more if no white space follows.
BLOCK = 1 << 20
_SPACE, _END, _SMALL, _CAPITAL = 1, 2, 4, 8
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Odd bases of the polynomials over characters and over words.
_LETTERS, _FIRST, _SECOND = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Bits by code point below 0x10000: white space, sentence end, letter that is not A-Z, Latin-1 capital."""
    out = np.zeros(1 << 16, np.uint8)
    for code in range(1 << 16):
        c = chr(code)
        out[code] = _SPACE * c.isspace() | _END * (c in ".!?…") | _SMALL * (c.isalpha() and not "A" <= c <= "Z") | _CAPITAL * ("A" <= c <= "Z" or "À" <= c <= "Þ" and c != "×")
    return out


@lru_cache(maxsize=32)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd base and of its inverse, modulo 2 ** 64."""
    return tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)))) for b in (base, pow(base, -1, 1 << 64)))


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """For each range: the polynomial of its values in ``base``, whatever its place."""
    up, down = _powers(base, max(1 << 16, 1 << len(values).bit_length()))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)])))
    return (total[ends] - total[starts]) * down[starts]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes, cuts): the words of a text, hashed in lower case, and
    whether a unit ends before each by its line, sentence or capital."""
    classes, parts, at, last = _classes(), [], 0, np.uint8(_END)
    while at < len(text):
        end = min(len(text), at + BLOCK)
        while end < len(text) and not text[end].isspace():
            end += 1
        block = text[at:end]
        codes = np.frombuffer(block.encode("utf-32-le", "surrogatepass"), np.uint32)
        small = block.replace("İ", "i").lower()  # the one letter whose lower case is longer
        lowered = np.frombuffer(small.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = np.where(codes < len(classes), classes[np.minimum(codes, len(classes) - 1)], 0).astype(np.uint8)
        edges = np.diff(np.concatenate(([1], kinds & _SPACE, [1])).astype(np.int8))
        starts, ends = np.flatnonzero(edges < 0), np.flatnonzero(edges > 0)
        if len(starts):
            lines = np.concatenate(([0], np.cumsum(codes == 10)))
            broken = lines[starts] > lines[np.concatenate(([0], ends[:-1]))]
            before = np.concatenate(([last], kinds[ends[:-1] - 1]))
            second = kinds[np.minimum(starts + 1, len(kinds) - 1)] * (ends - starts > 1)
            capital = (before & _SMALL > 0) & (kinds[starts] & _CAPITAL > 0) & (second & _SMALL > 0)
            parts.append((starts + at, ends + at, _mixed(_sums(lowered, starts, ends, _LETTERS)), broken | (before & _END > 0) | capital))
            last = kinds[ends[-1] - 1]
            if lines[-1] > lines[ends[-1]]:
                last = np.uint8(_END)
        elif (codes == 10).any():
            last = np.uint8(_END)
        at = end
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool)
    return tuple(np.concatenate(x) for x in zip(*parts))


class Units(NamedTuple):
    """Places of the units of a text, how many words each has, and its digest."""

    starts: np.ndarray
    ends: np.ndarray
    words: np.ndarray
    h1: np.ndarray
    h2: np.ndarray


def units(text: str) -> Units:
    """The units of a text in order, without the white space between them."""
    starts, ends, words, cuts = _words(text)
    n = len(words)
    if not n:
        return Units(starts, ends, starts, words.view(np.int64), words.view(np.int64))
    cuts[0] = True
    if n > 2 * NEAR + 1:
        unit = np.cumsum(cuts)
        pairs = np.full(n + 2 * NEAR, _LAST)
        inner = np.flatnonzero(~cuts)
        pairs[inner + NEAR] = _mixed(words[inner - 1] * np.uint64(3) + words[inner])
        at = inner[(inner > NEAR) & (inner < n - NEAR)]
        at = at[(unit[at - NEAR - 1] == unit[at]) & (unit[at + NEAR] == unit[at])]
        for d in range(1, NEAR + 1):
            at = at[(pairs[at + NEAR] < pairs[at + NEAR - d]) & (pairs[at + NEAR] <= pairs[at + NEAR + d])]
        cuts[at] = True
    first = np.flatnonzero(cuts)
    after = np.append(first[1:], n)
    count = after - first
    size = count.astype(np.uint64)
    h1, h2 = (_mixed(_sums(w, first, after, base) + size * np.uint64(base)) for w, base in ((words, _FIRST), (_mixed(words), _SECOND)))
    return Units(starts[first], ends[after - 1], count, h1.view(np.int64), h2.view(np.int64))


def _first_of_each(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """For each unit, the place of the first one of the same digest."""
    order = np.lexsort((h2, h1))
    a, b = h1[order], h2[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(order)]
    out = np.empty(len(order), np.int64)
    out[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else order
    return out


def repeated_runs(found: Units, again: np.ndarray, min_words: int) -> list[tuple[int, int, int]]:
    """(start, end, words) of runs of neighbouring repeated units of at least ``min_words`` words together."""
    edges = np.diff(np.concatenate(([0], again, [0])).astype(np.int8))
    begin, end = np.flatnonzero(edges > 0), np.flatnonzero(edges < 0)
    total = np.concatenate(([0], np.cumsum(found.words)))
    words = total[end] - total[begin]
    ok = words >= min_words
    return list(zip(found.starts[begin[ok]].tolist(), found.ends[end[ok] - 1].tolist(), words[ok].tolist()))


def _digests(docs: DataFrame, unplaced: int) -> DataFrame:
    """(rank, tie, h1, h2, again): the digest of every different unit of each row, and
    whether an earlier row of the same batch has it. What is left of a very common unit
    to compare is one row a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, lengths = [], []
            for t in batch.column(2):
                u = units(t.as_py() or "")
                one = _first_of_each(u.h1, u.h2) == np.arange(len(u.h1))
                found.append(np.stack((u.h1[one], u.h2[one])))
                lengths.append(found[-1].shape[1])
            h1, h2 = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
            rank, tie = (np.repeat(batch.column(i).to_numpy(), lengths) for i in (0, 1))
            order = np.lexsort((tie, rank, h2, h1))
            rank, tie, h1, h2 = rank[order], tie[order], h1[order], h2[order]
            new = np.flatnonzero(np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))[: len(order)])
            size = np.diff(np.append(new, len(order)))
            first, first_tie = np.repeat(rank[new], size), np.repeat(tie[new], size)
            again = (rank > first) | ((rank == unplaced) & (tie > first_tie))
            yield pa.record_batch([pa.array(x) for x in (rank, tie, h1, h2, again)], names=["rank", "tie", "h1", "h2", "again"])

    return docs.mapInArrow(run, "rank long, tie long, h1 long, h2 long, again boolean")


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``kept_text`` (string), ``removed`` (array of start, end
    offsets in characters of the original text) and ``removed_words`` (long).

    Documents rank by doc_id, null last. Rows that repeat a doc_id count as one
    document: each keeps what the document keeps, though a unit said again within
    a row goes. Rows without doc_id rank among themselves by a hash of the text;
    those of the same text count as one. A null text stays null and an empty one
    empty, with nothing removed; a text whose every unit is removed becomes empty.
    Columns of the same names as the new ones are replaced, others may have any
    name. An empty table gives an empty table.
    """
    unplaced = (1 << 63) - 1
    id_, words = F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`").cast("string")
    # The tie keeps the groups of a repeated id small; only rows without id are ordered by it.
    rank, tie = F.coalesce(id_, F.lit(unplaced)), F.when(id_.isNull(), F.xxhash64(words)).otherwise(F.hash(words).cast("long"))
    said = _digests(docs.select(rank.alias("rank"), tie.alias("tie"), words.alias("text")), unplaced)
    # Occurrences known to be later need no comparison and are dealt out evenly.
    salt = F.when(F.col("again"), F.xxhash64("rank", "tie", "h2")).otherwise(F.lit(0).cast("long"))
    met = Window.partitionBy("h1", "h2", "salt").orderBy("rank", "tie").rowsBetween(Window.unboundedPreceding, 0)
    placed = said.withColumn("salt", salt).withColumn("first", F.first("rank").over(met)).withColumn("first_tie", F.first("tie").over(met))
    later = placed.where(F.col("again") | (F.col("rank") > F.col("first")) | ((F.col("rank") == unplaced) & (F.col("tie") > F.col("first_tie"))))
    known = later.groupBy(F.col("rank").alias("known_rank"), F.col("tie").alias("known_tie")).agg(F.collect_set(F.struct("h1", "h2")).alias("again"))
    new = {"kept_text": T.StringType(), "removed": T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])), "removed_words": T.LongType()}
    kept = [c for c in docs.columns if c not in new]
    rows = docs.select(F.struct(words.alias("t"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)]).alias("row"), rank.alias("rank"), tie.alias("tie"))
    joined = rows.join(known, (F.col("rank") == F.col("known_rank")) & (F.col("tie") == F.col("known_tie")), "left").select("row", "again")
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(k, v) for k, v in new.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        removed_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            fields = batch.column(0).flatten()
            texts, spans, words = [], [], []
            for t, again in zip(fields[0], batch.column(1)):
                t = t.as_py()
                runs = _runs(t, again.as_py() or (), min_words) if t else []
                texts.append(_without(t, runs))
                spans.append([{"start": a, "end": b} for a, b, _ in runs])
                words.append(sum(n for _, _, n in runs))
            columns = [*fields[1:], pa.array(texts, pa.string()), pa.array(spans, removed_type), pa.array(words, pa.int64())]
            yield pa.record_batch(columns, names=kept + list(new))

    return joined.mapInArrow(run, schema)


def _runs(text: str, known: list[dict], min_words: int) -> list[tuple[int, int, int]]:
    """Runs of units that an earlier document or an earlier place in this text has."""
    found = units(text)
    one = _first_of_each(found.h1, found.h2)
    again = one != np.arange(len(one))
    if known:
        said = {(k["h1"], k["h2"]) for k in known}
        again |= np.array([p in said for p in zip(found.h1.tolist(), found.h2.tolist())])
    return repeated_runs(found, again, min_words) if again.any() else []


def _without(text: str | None, runs: list[tuple[int, int, int]]) -> str | None:
    """``text`` without the spans, with one break where a span and the space around it was."""
    if not runs:
        return text
    parts, at = [], 0
    for a, b, _ in runs:
        parts.append(text[at:a])
        at = b
    parts.append(text[at:])
    kept = [p.strip() if 0 < i < len(parts) - 1 else (p.rstrip() if i == 0 else p.lstrip()) for i, p in enumerate(parts)]
    return "\n".join(p for p in kept if p)
