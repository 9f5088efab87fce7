"""Token ids in fixed-width bit-packed files.

Layout of a file: magic, then blocks of ``BLOCK`` ids, each id in the fewest
bits that hold the vocabulary; then the index: block offsets, document ids,
whether each is null, and the place of each document's first id; then a trailer
that says where the index is. A block unpacks with a few numpy operations, and
offsets give any document without reading what stands before it.
"""

from __future__ import annotations

import json
import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import Recent, encode_text
from .storage import filesystem, new_file_name, qualified, scratch_path, settle

MAGIC = b"IDBITS01"
BLOCK = 1 << 16
#: A file is closed once it has this many ids.
FILE_IDS = 1 << 27
_TRAILER = struct.Struct("<QQQIIQ")  # index offset, documents, ids, bits, block, blocks


def bits_for(vocabulary: int) -> int:
    """Fewest bits that hold the ids 0 to ``vocabulary`` - 1."""
    return max(1, (max(1, vocabulary) - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as consecutive ``bits``-bit integers, least significant bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(planes[:, :bits].ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """The first ``n`` ids of ``data`` as unsigned 32-bit integers."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    planes = np.zeros((n, 32), np.uint8)
    planes[:, :bits] = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return np.packbits(planes, axis=1, bitorder="little").view("<u4").ravel()


class Writer:
    """Writes one file: ids as they come, in blocks; the index on closing."""

    def __init__(self, stream, bits: int, block: int = BLOCK) -> None:
        self.stream, self.bits, self.block = stream, bits, block
        self.stream.write(MAGIC)
        self.offsets, self.starts, self.doc_ids, self.nulls = [len(MAGIC)], [0], array("q"), bytearray()
        self.held: list[np.ndarray] = []
        self.waiting = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.starts.append(self.starts[-1] + len(ids))
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            self._flush(whole=True)

    def _flush(self, whole: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, np.uint32)
        end = len(ids) // self.block * self.block if whole else len(ids)
        for at in range(0, end, self.block):
            data = pack(ids[at : at + self.block], self.bits)
            self.stream.write(data)
            self.offsets.append(self.offsets[-1] + len(data))
        self.held, self.waiting = [ids[end:]], len(ids) - end

    def close(self) -> None:
        self._flush(whole=False)
        for values in (np.array(self.offsets, "<i8"), np.array(self.doc_ids, "<i8"), np.frombuffer(bytes(self.nulls), np.uint8), np.array(self.starts, "<i8")):
            self.stream.write(values.tobytes())
        self.stream.write(_TRAILER.pack(self.offsets[-1], len(self.doc_ids), self.starts[-1], self.bits, self.block, len(self.offsets) - 1))
        self.stream.close()


class Reader:
    """Random access to one file."""

    def __init__(self, stream, size: int) -> None:
        self.stream = stream
        index, docs, self.n_ids, self.bits, self.block, blocks = _TRAILER.unpack(self._range(size - _TRAILER.size, _TRAILER.size))
        data = self._range(index, size - _TRAILER.size - index)
        if self._range(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a file of packed ids")
        sizes = (8 * (blocks + 1), 8 * docs, docs, 8 * (docs + 1))
        ends = np.cumsum(sizes)
        parts = [data[e - s : e] for s, e in zip(sizes, ends.tolist())]
        self.offsets, self.doc_ids, self.nulls, self.starts = (np.frombuffer(p, k) for p, k in zip(parts, ("<i8", "<i8", np.uint8, "<i8")))

    def _range(self, at: int, n: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(n)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end`` of the file, from the blocks that hold them."""
        if end <= start:
            return np.empty(0, "<u4")
        first, last = start // self.block, (end - 1) // self.block
        base = int(self.offsets[first])
        data = self._range(base, int(self.offsets[last + 1]) - base)
        out = []
        for b in range(first, last + 1):
            n = min(self.block, self.n_ids - b * self.block)
            out.append(unpack(data[int(self.offsets[b]) - base : int(self.offsets[b + 1]) - base], n, self.bits))
        return np.concatenate(out)[start - first * self.block : end - first * self.block]

    def documents(self, ids_at_once: int = 1 << 22) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, place of the first id, ids) of every document, in order."""
        at = 0
        while at < len(self.doc_ids):
            until = max(at + 1, int(np.searchsorted(self.starts, self.starts[at] + ids_at_once, side="right")) - 1)
            base = int(self.starts[at])
            ids = self.ids(base, int(self.starts[until]))
            for d in range(at, until):
                yield (None if self.nulls[d] else int(self.doc_ids[d])), int(self.starts[d]), ids[int(self.starts[d]) - base : int(self.starts[d + 1]) - base]
            at = until


def _shown_bytes() -> dict[int, str]:
    """How byte-level models write bytes: printable Latin-1 as itself, the others in order from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(others)}


_SHOWN = _shown_bytes()


class _Encoder:
    """A tokenizer of the tokenizers library. Where it is plain byte-level BPE,
    encodings of frequent chunks are kept; else whole texts are encoded."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # The library cuts added tokens out before it splits a text, with white space or at word ends
        # only as each says. Texts that hold the string of one are left to it whole.
        added = [t["content"] for t in spec.get("added_tokens") or [] if t["content"]]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        before = spec.get("pre_tokenizer") or {}
        self.local = spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
        self.model, self.recent = self.tokenizer.model, Recent(self._piece if self.local else self._ids, self._ids)

    def _piece(self, piece: str) -> bytes:
        """Ids of one pre-token, from the library's model without its splitting."""
        return array("I", [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(_SHOWN))]).tobytes()

    def _ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> np.ndarray:
        local = self.local and not (self.added and self.added.search(text))
        return np.frombuffer(encode_text(text, self.recent) if local else self._ids(text), np.uint32)


@lru_cache(maxsize=4)
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def vocabulary_size(tokenizer_path: str) -> int:
    """Ids of the tokenizer, added tokens included."""
    return _encoder(tokenizer_path).tokenizer.get_vocab_size(with_added_tokens=True)


def write(docs: DataFrame, tokenizer_path: str, end_id: int | None = 0, folder: str | None = None, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the ids of all documents in ascending doc_id order (nulls first, then
    by text hash) and return the settled manifest: (part, seq, path, bytes,
    n_docs, n_ids), one row a file, whose order is that of (part, seq).

    A null text is empty and gives ``end_id`` alone; rows that repeat a doc_id
    are each written; an empty table gives no file.
    """
    folder = qualified(docs.sparkSession, folder) if folder else scratch_path(docs.sparkSession, "packed-ids")
    bits = bits_for(vocabulary_size(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = _encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        fs, root = filesystem(folder)
        writer, path = None, ""
        tail = np.array([] if end_id is None else [end_id], np.uint32)

        def close() -> pa.RecordBatch:
            writer.close()
            n = fs.get_file_info(path).size
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "path": f"{folder}/{path.rpartition('/')[2]}", "bytes": n, "n_docs": len(writer.doc_ids), "n_ids": int(writer.starts[-1])}], schema=pa_schema)

        pa_schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("bytes", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    path = f"{root}/{new_file_name(f'{part:06d}-{seq:04d}')}"
                    writer = Writer(fs.open_output_stream(path), bits, block)
                writer.add(d, np.concatenate((encoder.encode(t.as_py() or ""), tail)))
                if writer.starts[-1] >= file_ids:
                    yield close()
                    writer, seq = None, seq + 1
        if writer is not None:
            yield close()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    return settle(ordered.mapInArrow(run, "part int, seq int, path string, bytes long, n_docs long, n_ids long"), "packed-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files: ``start`` is
    the number of ids of all documents before it, ``ids`` its ids as little-endian
    unsigned 32-bit integers. The manifest has one row a file."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    files = settle(manifest.select("path", "bytes", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base")), "packed-bases")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                fs, path = filesystem(f["path"])
                with fs.open_input_file(path) as stream:
                    rows, held = [], 0
                    for d, start, ids in Reader(stream, f["bytes"]).documents():
                        rows.append((d, f["base"] + start, len(ids), ids.tobytes()))
                        held += len(ids)
                        if held >= 1 << 22 or len(rows) >= 10_000:
                            yield _rows(rows)
                            rows, held = [], 0
                    if rows:
                        yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()))
        return pa.record_batch([pa.array(x, k) for x, (_, k) in zip(zip(*rows), kinds)], names=[n for n, _ in kinds])

    return files.repartition(max(1, files.count())).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def read_document(path: str, place: int) -> np.ndarray:
    """Ids of the document at ``place`` in one file, by its offsets alone."""
    fs, inner = filesystem(path)
    with fs.open_input_file(inner) as stream:
        reader = Reader(stream, fs.get_file_info(inner).size)
        return reader.ids(int(reader.starts[place]), int(reader.starts[place + 1]))
