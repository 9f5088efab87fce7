"""SimHash near-dedup by multi-index hashing.

A fingerprint has one bit for each bit position of the shingle hashes: set if
it is set in over half of them. Fingerprints are cut into segments, with one table
of (segment, value). Two fingerprints at distance r or less are within r // m bits
in one of the first r % m + 1 of m segments, or nearer in another; so the Hamming
ball of that radius is enumerated in each segment, matches are fetched from the
tables and their complete distances verified. A segment value of many fingerprints
is not matched pair by pair: those that have or ask for it meet in whole
fingerprints with one bit flipped, at most 65 of them in each, and linking each to
the smallest keeps every connection.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .storage import discard, drop_shuffles, settle, unused_name
from .words import shingle_blocks, word_blocks

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE_AT = np.arange(8, dtype=np.int64) * 256


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the unsigned 64-bit hashes have each bit set (bit 0 first)."""
    if not len(hashes):
        return np.zeros(64, np.int64)
    bytes_ = hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
    seen = np.bincount((bytes_ + _BYTE_AT).ravel(), minlength=2048).reshape(8, 256)
    return (seen @ _BYTE_BITS).reshape(64)


def majority(counts: np.ndarray, total: int) -> int:
    """The signed 64-bit integer whose bits are set where over half of ``total`` are."""
    return int(np.packbits(2 * counts > total, bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of one text as a signed 64-bit integer; zero for a text without words."""
    from xxhash import xxh64_intdigest

    counts, total = np.zeros(64, np.int64), 0
    for shingles in shingle_blocks(text, shingle):
        counts += bit_counts(np.fromiter((xxh64_intdigest(s, seed) for s in shingles), np.uint64, len(shingles)))
        total += len(shingles)
    return majority(counts, total)


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): one row a document, fingerprints of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


#: Fingerprints that share a segment value are matched pair by pair up to this number.
CROWD = 64


def _flipped(value: Column, at: Column) -> Column:
    return value.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), at))


def _segment(fp: Column, s: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, s * width).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1).cast("long"))


def _spot(s: int, value: Column) -> Column:
    return F.struct(F.lit(s).alias("segment"), value.alias("value"))


def _ball(s: int, value: Column, bits: int) -> Column:
    """Array of the segment's value and, of those one bit off, those with a bit less: of
    two values one bit apart one has the bit, and flipping it finds the other."""
    if not bits:
        return F.array(_spot(s, value))
    held = F.filter(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.getbit(value, i) == 1)
    return F.concat(F.array(_spot(s, value)), F.transform(held, lambda i: _spot(s, _flipped(value, i))))


def meeting_links(fps: DataFrame, max_distance: int) -> DataFrame:
    """(a, b): links by whole fingerprints with one bit flipped. Those two bits apart
    share such a point, those one bit apart have each other's; a point has 65 at most."""
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: _flipped(F.col("fp"), i))
    points = fps.select("fp", F.explode(F.concat(F.array("fp"), flips)).alias("point"))
    least = "fp" if max_distance == 2 else F.when(F.col("fp") == F.col("point"), F.col("fp"))
    met = points.withColumn("near", F.min(least).over(Window.partitionBy("point"))).where("near <> fp")
    return met.select(F.col("near").alias("a"), F.col("fp").alias("b")).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance)


def links(fps: DataFrame, max_distance: int = 2, segments: int = 2, crowd: int = CROWD) -> DataFrame:
    """(a, b): links between different fingerprints (column ``fp``, each once), enough of
    them to connect all that lie ``max_distance`` (at most 2) or fewer bits apart by steps."""
    if not 0 < max_distance <= 2 or segments < 1 or 64 % segments or max_distance // segments > 1:
        raise ValueError("max_distance is 1 or 2; segments divides 64 and leaves a radius of 1 at most")
    width, (radius, spare) = 64 // segments, divmod(max_distance, segments)
    reach = [radius if s <= spare else radius - 1 for s in range(segments)]
    fp = F.col("fp")
    spots = [_spot(s, _segment(fp, s, width)) for s in range(segments) if reach[s] >= 0]
    balls = [_ball(s, _segment(fp, s, width), width if reach[s] else 0) for s in range(segments) if reach[s] >= 0]
    key = ["segment", "value"]
    entries = fps.select("fp", F.explode(F.array(*spots)).alias("k")).select("fp", "k.*")
    probes = fps.select("fp", F.explode(F.concat(*balls)).alias("k")).select("fp", "k.*")
    crowded = settle(entries.groupBy(*key).count().where(F.col("count") > crowd).select(*key), "crowded-segments")
    some = bool(crowded.take(1))
    table = (entries.join(crowded, key, "left_anti") if some else entries).withColumnRenamed("fp", "other")
    near = (fp != F.col("other")) & (F.bit_count(fp.bitwiseXOR(F.col("other"))) <= max_distance)
    found = probes.join(table, key).where(near).select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"))
    if some:
        busy = settle(entries.union(probes).join(crowded, key, "left_semi").select("fp").distinct(), "crowded-fingerprints")
        found = found.union(meeting_links(_spread(busy, "fp"), max_distance))
    return found.distinct()


def _spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt to all partitions, as each row is about to become many."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def near_duplicates(docs: DataFrame, shingle: int = 3, max_distance: int = 2, segments: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of ``docs``.

    ``component_id`` is the smallest doc_id reachable by links. Null and empty
    texts have fingerprint zero and link like any other; rows that repeat a
    doc_id each get their row; a null doc_id gets a row but is the smallest of
    its component only where all are null. An empty table gives no row.
    """
    fps = settle(fingerprints(docs, shingle, 42, doc_id, text), "fingerprints")
    first = settle(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-classes")
    linked = first.join(components(links(_spread(first.select("fp"), "fp"), max_distance, segments)), F.col("fp") == F.col("node")).select("fp", "first", "component")
    named = first.join(_least(linked), "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return fps.join(settle(named, "named-classes"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _least(linked: DataFrame, key: str = "fp") -> DataFrame:
    """(key, component_id): the smallest ``first`` of each component. The aggregate is
    written before it is joined, so that a join with a component of many rows can be split."""
    least = settle(linked.groupBy("component").agg(F.min("first").alias("component_id")), "component-ids")
    return linked.join(least, "component").select(key, "component_id")


#: Index: as many segments as leave a pair on the line without a common one with chance MISSED, each of
#: WIDTH bits or more, so that a table has some eight fingerprints a value. ROUND tables are met at a time.
MISSED, WIDTH, ROUND = 2e-5, 16, 50
#: Sets of fewer shingles than SPARSE, whose bits may differ more often, are sought in balls of radius one, and so are
#: those a quarter larger, which can be on the line with them: of two values one bit apart, the one with the bit asks.
SPARSE = 16
#: Fingerprints over shingles reject candidates before their sets are compared: above SLACK standard deviations of the
#: distance that the similarity leads one to expect. Below ENOUGH shingles that distance is up to a quarter larger.
VERIFY_BITS, SLACK, ENOUGH = 512, 5.0, 64
#: Segment values and families of more than CROWD texts are met in blocks of bounded rows and shingles.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 1 << 19
_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)
_VERIFY = [f"s{k}" for k in range(VERIFY_BITS // 64)]


def differing(similarity: float) -> float:
    """Share of SimHash bits that differ between two sets of the given Jaccard
    similarity: the angle between two sets of equal size."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def most_bits(similarity: float, bits: int = VERIFY_BITS, slack: float = SLACK, stretch: float = 1.0) -> int:
    """The Hamming distance up to which fingerprints of ``bits`` bits count as
    having at least the given Jaccard similarity: that expected, ``stretch``
    times, and ``slack`` standard deviations."""
    share = min(0.5, differing(similarity) * stretch)
    return int(bits * share + slack * np.sqrt(bits * share * (1 - share)))


def index_shape(rows: int, similarity: float) -> tuple[int, int]:
    """(segments, width) of the index of so many rows: wider segments for more rows, so that
    the texts that share a value by chance do not grow in number."""
    width = min(max(WIDTH, (max(rows, 1) - 1).bit_length() - 3), 30)
    alike = min((1 - differing(similarity)) ** width, 0.999)
    return int(np.ceil(np.log(MISSED) / np.log1p(-alike))), width


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the different runs of ``size`` word hashes (all words, if fewer)."""
    size = max(1, min(size, len(words)))
    total = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for j in range(size):
        total += words[j : len(words) - size + 1 + j] * (_SALTS[j % len(_SALTS)] + np.uint64(2 * (j // len(_SALTS))))
    return np.unique(_mixed(total))


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted hashes of the different shingles of a text."""
    from xxhash import xxh64_intdigest

    hashes: list[int] = []
    for block in word_blocks(text):
        hashes += map(xxh64_intdigest, block)
    return _shingle_hashes(np.array(hashes, np.uint64), shingle)


def wide_fingerprint(features: np.ndarray, bits: int) -> np.ndarray:
    """SimHash of ``bits`` bits (0 or 1 each) over the features. A tie in a set below SPARSE
    takes the first feature's bit: with zero, such sets would have many bits in common by chance."""
    turns = _mixed(np.arange(1 << 33, (1 << 33) + -(-bits // 64), dtype=np.uint64))
    twice = np.zeros(len(turns) * 64, np.int64)
    for at in range(0, len(features), 255):  # sums of a byte
        hashes = _mixed(features[at : at + 255, None] + turns).astype("<u8", copy=False)
        on = np.unpackbits(hashes.view(np.uint8), axis=1, bitorder="little")
        twice += 2 * on.sum(axis=0, dtype=np.uint8).astype(np.int64) + (on[0] if len(features) < SPARSE else 0)
    return (twice > len(features))[:bits].astype(np.uint8)


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least ``similarity``."""
    both = len(a) + len(b) - len(np.union1d(a, b))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def _wide(docs: DataFrame, shingle: int, segments: int, width: int) -> DataFrame:
    """(doc_id, key, d1, d2, size, spots, s0..): the text's hash, and digest, size, segment values and first bits of each row's
    set. The sets themselves are longer than the texts; ``_sets`` makes those that are compared once more."""
    kinds = {"doc_id": pa.int64(), "key": pa.int64(), "d1": pa.int64(), "d2": pa.int64(), "size": pa.int64(), "spots": pa.list_(pa.int32()), **dict.fromkeys(_VERIFY, pa.int64())}
    places, bits = 1 << np.arange(width, dtype=np.int32), max(segments * width, VERIFY_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = []
                for t in part.column(2):
                    features = shingle_set(t.as_py(), shingle)
                    digest = np.frombuffer(blake2b(features.tobytes(), digest_size=16).digest(), np.int64).tolist()
                    wide = wide_fingerprint(features, bits)
                    words = np.packbits(wide[:VERIFY_BITS], bitorder="little").view("<i8").tolist()
                    rows.append((*digest, len(features), wide[: segments * width].reshape(segments, width) @ places, *words))
                columns = zip(*rows) if rows else [[]] * (len(kinds) - 2)
                yield pa.record_batch([part.column(0), part.column(1), *(pa.array(c, k) for c, k in zip(columns, list(kinds.values())[2:]))], names=list(kinds))

    return docs.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(run, "doc_id long, key long, d1 long, d2 long, size long, spots array<int>, " + ", ".join(f"{n} long" for n in _VERIFY))


def _near(similarity: float, names: list[str]) -> Column:
    """Whether the sizes and fingerprint words (``names``, after a and b) allow the similarity."""
    apart = sum((F.bit_count(F.col("a" + c).bitwiseXOR(F.col("b" + c))) for c in names), F.lit(0))
    less, more = F.least("asize", "bsize"), F.greatest("asize", "bsize")
    most = F.when(less < ENOUGH, most_bits(similarity, 64 * len(names), stretch=1.25)).otherwise(most_bits(similarity, 64 * len(names)))
    return (less >= similarity * more - 1e-9) & (apart <= most)


def _keyed(index: DataFrame, low: int, width: int) -> DataFrame:
    """The rows of ``index`` (cls, size, s0, s1, ..) without spots, once for each ``point``: a value that they have,
    or ask for, in the tables ``low`` and the ROUND - 1 after it."""
    own = [c for c in index.columns if c != "spots"]
    spots = index.select(*own, F.posexplode(F.slice("spots", low + 1, ROUND)).alias("segment", "value")).select(*own, "segment", F.col("value").cast("long").alias("value"))
    sparse = F.col("size") < SPARSE * 5 / 4
    flips = spots.where(sparse).select(*own, F.explode(_ball(F.col("segment"), F.col("value"), width)).alias("k")).select(*own, "k.*")
    keyed = spots.where(~sparse).union(flips)
    return keyed.select(*own, (F.call_function("shiftleft", F.col("segment").cast("long"), F.lit(32)) + F.col("value")).alias("point"))


def _stars(index: DataFrame, width: int, similarity: float) -> DataFrame:
    """(a, b): each row b of the first ROUND tables with the least, a, of each of its values, where the first words allow it."""
    own = ["cls", "size", "s0", "s1"]
    least = F.min(F.struct(*own)).over(Window.partitionBy("point"))
    met = _keyed(index.select(*own, "spots"), 0, width).select(*own, least.alias("least"))
    met = met.select(*[F.col(c).alias("b" + c) for c in own], *[F.col("least." + c).alias("a" + c) for c in own])
    return met.where((F.col("acls") < F.col("bcls")) & _near(similarity, ["s0", "s1"])).select(F.col("acls").alias("a"), F.col("bcls").alias("b")).distinct()


def _families(linked: DataFrame) -> DataFrame:
    """(cls, family): the texts that ``linked`` (a, b) connects with more than CROWD in all, by a negative name."""
    joined = components(linked)
    large = settle(joined.groupBy("component").count().where(F.col("count") > CROWD).select("component"), "large-families")
    return settle(joined.join(large, "component").select(F.col("node").alias("cls"), (-1 - F.col("component")).alias("family")), "families")


def _segment_meetings(index: DataFrame, low: int, width: int, similarity: float) -> DataFrame:
    """(point, a, b, ..): candidates of the tables ``low`` and the ROUND - 1 after it, from
    (cls, size, s0, s1, spots). Of a value of up to CROWD texts come the pairs (a, b) that the first
    words allow, without point; of a larger one its members b, each with the least, a. With the column
    family, pairs within a family are left out: it is compared as a whole."""
    own = [c for c in index.columns if c != "spots"]
    met = Window.partitionBy("point")
    probes = _keyed(index, low, width).withColumn("n", F.count("*").over(met)).withColumn("least", F.min("cls").over(met))
    few = probes.where(F.col("n").between(2, CROWD))
    left, right = (few.select("point", F.col("cls").alias(c), *[F.col(x).alias(c + x) for x in own[1:]]) for c in "ab")
    others = F.coalesce(F.col("afamily") != F.col("bfamily"), F.lit(True)) if "family" in own else F.lit(True)
    pairs = left.join(right, "point").where((F.col("a") < F.col("b")) & others & _near(similarity, ["s0", "s1"]))
    # All columns go with members as well: both sides then read one shuffle.
    return pairs.select(F.lit(None).cast("long").alias("point"), "a", "b", *["a" + c for c in own[1:]]).union(probes.where(F.col("n") > CROWD).select("point", "least", *own))


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(cls, shingles): hashes of the sets of the rows ``wanted`` (cls, key), each once, from the texts again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle).tobytes() for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(sets, pa.binary())], names=["cls", "shingles"])

    texts = docs.select(F.xxhash64("text").alias("key"), "text").join(wanted, "key").select("cls", "text")
    return settle(texts.dropDuplicates(["cls"]).mapInArrow(run, "cls long, shingles binary"), "shingle-sets")


def _exact(pairs: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of the rows (a, b, a_set, b_set) whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = zip(batch.column(2), batch.column(3))
            ok = [alike(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), similarity) for x, y in sets]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.select("a", "b", "a_set", "b_set").mapInArrow(run, "a long, b long")


def _overlaps(sets: bytes, sizes: np.ndarray, others: bytes, other_sizes: np.ndarray) -> Callable[[int], np.ndarray]:
    """How many shingles the set of a given place among ``sets`` has in common with each of ``others``."""
    left, right = (np.frombuffer(x, np.uint64) for x in (sets, others))
    _, places = np.unique(np.concatenate([left, right]), return_inverse=True)
    own, other = places[: len(left)], places[len(left) :]
    ends, other_ends = np.cumsum(sizes), np.cumsum(other_sizes)
    held = np.zeros(int(places.max(initial=-1)) + 1, bool)

    def count(i: int) -> np.ndarray:
        mine = own[ends[i] - sizes[i] : ends[i]]
        held[mine] = True
        total = np.concatenate(([0], np.cumsum(held[other])))
        held[mine] = False
        return total[other_ends] - total[other_ends - other_sizes]

    return count


def _block_links(found: DataFrame, similarity: float) -> DataFrame:
    """(point, a, b): links between the labels of large buckets: (point, stray, cls, label, unit, size, s0..)
    is cut into blocks, those of strays meet all, and each meeting returns links that connect all
    it can between units: sets (shingles) are compared where not yet connected. Without the
    column shingles, each member whose fingerprint allows a link comes as both a and b."""
    names, exact = ["ids", "labels", "units", "sizes", "bits", "sets"], "shingles" in found.columns
    kinds = pa.schema([("point", pa.int64()), ("part", pa.int64()), *((c, pa.binary()) for c in names)])
    most, most_small = most_bits(similarity), most_bits(similarity, stretch=1.25)

    def pack(table: pa.Table) -> pa.Table:
        bits = np.stack([table.column(c).to_numpy() for c in _VERIFY], axis=1)
        row = {c: table.column(c)[0].as_py() for c in ("point", "part")}
        row |= {k: table.column(c).to_numpy().tobytes() for k, c in (("ids", "cls"), ("labels", "label"), ("units", "unit"), ("sizes", "size"))}
        return pa.Table.from_pylist([row | {"bits": bits.tobytes(), "sets": b"".join(table.column("shingles").to_pylist()) if exact else b""}], schema=kinds)

    parts = F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("size") / BLOCK_SHINGLES), F.lit(1))
    counts = settle(found.groupBy("point").agg(parts.cast("long").alias("parts")), "bucket-parts")
    placed = found.join(counts, "point").withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")))
    packed = [
        settle(rows.groupBy("point", "part").applyInArrow(pack, "point long, part long, " + ", ".join(f"{c} binary" for c in names)), "shingle-blocks")
        for rows in (placed.where("stray"), placed)
    ]
    left = packed[0].drop("part").join(counts, "point").select("point", *names, F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    met = left.join(packed[1].select("point", "part", *[F.col(c).alias("r_" + c) for c in names]), ["point", "part"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                a, b = (np.frombuffer(row[c], np.int64) for c in ("ids", "r_ids"))
                n, m = (np.frombuffer(row[c], np.int64) for c in ("sizes", "r_sizes"))
                unit, r_unit = (np.frombuffer(row[c], np.int64) for c in ("units", "r_units"))
                x, y = (np.frombuffer(row[c], np.uint64).reshape(-1, len(_VERIFY)) for c in ("bits", "r_bits"))
                _, group = np.unique(np.concatenate([np.frombuffer(row[c], np.int64) for c in ("labels", "r_labels")]), return_inverse=True)
                less, more = np.minimum(n[:, None], m[None, :]), np.maximum(n[:, None], m[None, :])
                u, v = np.nonzero((group[: len(a), None] != group[None, len(a) :]) & (unit[:, None] != r_unit[None, :]) & (less >= similarity * more - 1e-9))
                apart = np.zeros(len(u), np.int64)
                for k in range(len(_VERIFY)):
                    apart += np.bitwise_count(x[u, k] ^ y[v, k])
                ok = apart <= np.where(less[u, v] < ENOUGH, most_small, most)
                u, v = u[ok], v[ok]
                if exact:
                    links: tuple[list, list] = ([], [])
                    both, lefts = _overlaps(row["sets"], n, row["r_sets"], m), np.split(v, np.flatnonzero(np.diff(u)) + 1)
                    for i_, js in zip(np.unique(u).tolist(), lefts):
                        js = js[group[len(a) + js] != group[i_]]
                        shared = both(i_)[js] if len(js) else js
                        for j in js[shared >= similarity * (n[i_] + m[js] - shared) - 1e-9].tolist():
                            if group[i_] != group[len(a) + j]:
                                links[0].append(int(a[i_]))
                                links[1].append(int(b[j]))
                                group[group == group[len(a) + j]] = group[i_]
                else:
                    some = np.unique(np.concatenate([a[u], b[v]])).tolist()
                    links = (some, some)
                yield pa.record_batch([pa.array(c, pa.int64()) for c in ([row["point"]] * len(links[0]), *links)], names=["point", "a", "b"])

    return met.drop("part").mapInArrow(compare, "point long, a long, b long")


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, component_id), one row for each row of ``docs``: groups whose members
    are linked by sets of ``shingle``-word shingles of Jaccard ``similarity`` or more.

    A distance that far is about a seventh of a SimHash's bits. Fingerprints are
    therefore thousands of bits wide, and the index has a table for each of their
    segments (``index_shape``): a pair at the similarity shares no segment with
    chance MISSED, whatever the edit. What meets in a table is a candidate; complete
    distances far beyond the line reject, and the sets themselves decide. Equal sets
    are made one first. Texts that first meet the smallest of each of their values
    show the families of many near copies: these are compared in blocks, once and
    whole, and no pair within one is listed. Segment values of many texts meet their
    smallest member; those that this does not connect are compared in blocks too.
    Null and empty texts are alike; nulls and repeats of doc_id as in
    ``near_duplicates``. An empty table gives no row.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    segments, width = index_shape(rows.count(), similarity)
    fps = settle(_wide(rows, shingle, segments, width).withColumn("uid", F.monotonically_increasing_id()), "wide-fingerprints")
    classes = settle(fps.groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.min("uid").alias("cls")), "shingle-classes")
    index = settle(_spread(fps.select(F.col("uid").alias("cls"), "size", "s0", "s1", "spots").join(classes.select("cls"), "cls"), "cls"), "segment-index")
    left, right = (fps.select(F.col("uid").alias(c), *[F.col(x).alias(c + x) for x in ["size", *_VERIFY]]) for c in "ab")

    def allowed(pairs: DataFrame) -> DataFrame:
        return pairs.join(left, "a").join(right, "b").where(_near(similarity, _VERIFY)).select("a", "b")

    stars = settle(allowed(settle(_stars(index, width, similarity), "segment-stars")), "maybe-stars")
    families = _families(stars)
    some = bool(families.take(1))
    dealt = index.join(families, "cls", "left") if some else index
    drop_shuffles(docs.sparkSession)
    tables = []
    for low in range(0, segments, ROUND):
        tables.append(settle(_segment_meetings(dealt, low, width, similarity), "segment-meetings"))
        drop_shuffles(docs.sparkSession)
    met = reduce(DataFrame.union, tables)
    large = met.where("point is not null").select("point", F.col("b").alias("cls"))
    maybe = settle(allowed(met.where("point is null or a <> b").select("a", "b").distinct()).union(stars).distinct(), "maybe-links")
    drop_shuffles(docs.sparkSession)
    keys = fps.select(F.col("uid").alias("cls"), "key")
    sets = _sets(rows, keys.join(maybe.select(F.col("a").alias("cls")).union(maybe.select("b")).distinct(), "cls"), shingle)
    drop_shuffles(docs.sparkSession)
    a_sets, b_sets = (sets.select(F.col("cls").alias(c), F.col("shingles").alias(c + "_set")) for c in "ab")
    near = settle(_exact(maybe.join(a_sets, "a").join(b_sets, "b"), similarity), "near-links")
    drop_shuffles(docs.sparkSession)
    joined = components(near)
    # Families are compared like the values of many texts; there, members of one family are not compared again.
    named = large.union(families.select(F.col("family").alias("point"), "cls")).join(families, "cls", "left")
    named = named.join(joined, named.cls == joined.node, "left").select("point", "cls", "family", F.coalesce("component", "cls").alias("label"))
    named = named.select("point", "cls", "label", F.when(F.col("point") < 0, F.col("label")).otherwise(F.coalesce("family", "label")).alias("unit"))
    units = named.groupBy("point", "unit").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    units = units.groupBy("point").agg(F.max_by("unit", "n").alias("main"), (F.count("*") > 1).alias("split"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    apart_still = settle(units.where("split and lo < hi").select("point", "main"), "bucket-units")
    apart_still = named.join(apart_still, "point").withColumn("stray", F.col("unit") != F.col("main")).drop("main")
    apart_still = settle(apart_still.join(fps.select(F.col("uid").alias("cls"), "size", *_VERIFY), "cls"), "open-buckets")
    if apart_still.take(1):
        members = settle(_block_links(apart_still, similarity).select("point", F.col("a").alias("cls")).distinct(), "open-members")
        if members.take(1):
            open_sets = _sets(rows, keys.join(members.select("cls").distinct(), "cls"), shingle)
            full = apart_still.join(members, ["point", "cls"]).join(open_sets, "cls")
            near = near.union(settle(_block_links(full, similarity).select("a", "b"), "block-links"))
            joined = components(near.distinct())
    linked = classes.join(joined, F.col("cls") == F.col("node")).select("cls", "first", "component")
    named = classes.join(_least(linked, "cls"), "cls", "left").select("d1", "d2", F.coalesce("component_id", "first").alias("component_id"))
    named = settle(named, "named-classes")
    groups = settle(fps.select("doc_id", "d1", "d2").join(named, ["d1", "d2"]).select("doc_id", "component_id"), "similar-documents")
    for table in (fps, index, *tables):  # the largest; nothing reads them any more
        discard(table)
    return groups


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group of similar ones: that of the smallest
    doc_id, with every row that bears it. Rows without doc_id all stay."""
    groups = similar_documents(docs, shingle, similarity, doc_id, text)
    name = unused_name(docs, "gone")
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col(f"`{doc_id}`") == F.col(name), "left_anti")
