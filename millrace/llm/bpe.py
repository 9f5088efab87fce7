"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each merge rank has a bucket of positions in the linked list of parts, least
position first. A bitmap tells which buckets hold any, one above it which of its
words do, and find-first-set in both gives the next rank. An entry whose pair
has changed since is stale and skipped. A pre-token of n bytes costs O(n log n)
whatever its length.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .chunks import LONGEST_KEPT, PATTERN, Recent, encode_text
from .storage import numbered


#: Ranks to a word of the lower bitmap; Python's integers make words this wide as quick as narrow ones.
_BITS = 8
_MASK = (1 << _BITS) - 1


#: Encodings of chunks that a worker keeps, and rows that it encodes at a time.
KEPT, ROWS = 250_000, 512


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """Rank of each pair of tokens that joins to a token, under ``left << 32 | right``."""
    out = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left = ranks.get(token[:i])
            if left is not None and (right := ranks.get(token[i:])) is not None:
                out[left << 32 | right] = rank
    return out


def merge(piece: bytes, single: list[int], twos: list[int], pairs: dict[int, int], words: list[int]) -> list[int]:
    """Ids of one pre-token from the ids of its bytes. ``twos``: ranks of byte pairs,
    -1 for none; ``words``: the lower bitmap, all zero before and after.

    A bucket of one position is that position, a larger one a heap.
    """
    n = len(piece)
    ids = [single[b] for b in piece]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pair = [twos[a << 8 | b] for a, b in zip(piece, piece[1:])]
    pair.append(-1)
    buckets: dict[int, int | list[int]] = {}
    top = 0
    rank_of = pairs.get

    def add(r: int, i: int) -> None:
        held = buckets[r]
        if held.__class__ is int:
            buckets[r] = [held, i] if held < i else [i, held]
        else:
            heappush(held, i)

    for i, r in enumerate(pair):
        if r >= 0:
            if r in buckets:
                add(r, i)
            else:
                buckets[r] = i
                at = r >> _BITS
                words[at] |= 1 << (r & _MASK)
                top |= 1 << at
    while top:
        at = (top & -top).bit_length() - 1
        word = words[at]
        low = word & -word
        r = at << _BITS | low.bit_length() - 1
        i = buckets.pop(r)
        if i.__class__ is int:
            words[at] = word = word ^ low
            if not word:
                top &= top - 1
        else:
            held, i = i, heappop(i)
            buckets[r] = held if len(held) > 1 else held[0]
        if pair[i] != r:
            continue  # stale: another merge took a part of this pair
        j = after[i]
        k = after[j]
        ids[i] = r
        after[i] = k
        pair[j] = -1
        if k < n:
            before[k] = i
            pair[i] = new = rank_of(r << 32 | ids[k], -1)
            if new >= 0:
                if new in buckets:
                    add(new, i)
                else:
                    buckets[new] = i
                    at = new >> _BITS
                    words[at] |= 1 << (new & _MASK)
                    top |= 1 << at
        else:
            pair[i] = -1
        p = before[i]
        if p >= 0:
            pair[p] = new = rank_of(ids[p] << 32 | r, -1)
            if new >= 0:
                if new in buckets:
                    add(new, p)
                else:
                    buckets[new] = p
                    at = new >> _BITS
                    words[at] |= 1 << (new & _MASK)
                    top |= 1 << at
    out, i = [], 0
    while i < n:
        out.append(ids[i])
        i = after[i]
    return out


class Codec:
    """A rank file and a split pattern: texts to ids and back."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import regex

        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        size = 1 + max(self.ranks.values(), default=-1)
        self.tokens: dict[int, bytes] = {r: b for b, r in self.ranks.items()}
        self.pairs = pair_ranks(self.ranks)
        self.single = [self.ranks[bytes((b,))] for b in range(256)]
        self.twos = [self.ranks.get(bytes(divmod(x, 256)), -1) for x in range(1 << 16)]
        self.words = [0] * ((size >> _BITS) + 1)
        split = regex.compile(pattern)
        self.findall = (lambda text: [m[0] for m in split.finditer(text)]) if split.groups else split.findall
        self.cuts = pattern == PATTERN  # only this one is known to cut at every single space
        self.recent = Recent(self._piece, self._text, KEPT)

    def _piece(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.ranks.get(data)
        return array("i", [whole] if whole is not None else merge(data, self.single, self.twos, self.pairs, self.words)).tobytes()

    def _text(self, text: str) -> bytes:
        recent = self.recent
        return b"".join([recent.spaced(p[1:]) if p[0] == " " and 1 < len(p) <= LONGEST_KEPT else recent.short(p) for p in self.findall(text) if p])

    def encode(self, text: str | None) -> bytes:
        """The ids as 32-bit integers in this machine's byte order."""
        return encode_text(text or "", self.recent) if self.cuts else self._text(text or "")

    def decode(self, ids: list[int]) -> bytes | None:
        """The bytes; None if an id is not of the vocabulary."""
        try:
            return b"".join(map(self.tokens.__getitem__, ids))
        except KeyError:
            return None


@lru_cache(maxsize=4)
def codec(ranks_path: str, pattern: str) -> Codec:
    """One codec for each vocabulary in a Python worker."""
    return Codec(ranks_path, pattern)


def _id_lists(encoded: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(encoded) + 1, np.int64)
    np.cumsum([len(x) // 4 for x in encoded], out=offsets[1:])
    values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(encoded))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _schema(df: DataFrame, without: set[str], new: list[T.StructField]) -> T.StructType:
    return T.StructType([f for f in df.schema if f.name not in without] + new)


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "token_ids", decoded: str | None = None, keep_text: bool = True, forget: bool = False) -> DataFrame:
    """``docs`` with the column ``ids`` (array of int): each match of ``pattern``
    is encoded by the ranks, without special tokens.

    A null or empty text has no ids; its list is empty. ``decoded`` names a
    binary column to which the ids are decoded again in the same pass. With ``forget``
    a worker keeps no encodings from one task to the next. A column
    of the same name as a new one is replaced; every row, repeats included, and
    every other column stays as it is. An empty table gives an empty table.
    """
    new = [T.StructField(ids, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.BinaryType())] if decoded else [])
    schema = _schema(docs, {f.name for f in new} | (set() if keep_text else {text}), new)
    at, kept = docs.columns.index(text), [docs.columns.index(f.name) for f in schema if f.name not in {x.name for x in new}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            encoded = [c.encode(t.as_py()) for t in batch.column(at)]
            columns = [batch.column(k) for k in kept] + [_id_lists(encoded)]
            if decoded:
                columns.append(pa.array([c.decode(np.frombuffer(x, np.int32).tolist()) for x in encoded], pa.binary()))
            yield pa.record_batch(columns, names=schema.names)
        c.recent.old = {}
        if forget:
            c.recent.clear()
            c.recent.marks.clear()

    return numbered(docs).mapInArrow(run, schema)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the binary column ``decoded``: null for a null list and for a
    list that holds a null or an id outside the vocabulary."""
    schema = _schema(df, {decoded}, [T.StructField(decoded, T.BinaryType())])
    at, kept = df.columns.index(ids), [df.columns.index(f.name) for f in schema if f.name != decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for batch in batches:
            out = [None if x is None else c.decode(x) for x in (row.as_py() for row in batch.column(at))]
            yield pa.record_batch([batch.column(k) for k in kept] + [pa.array(out, pa.binary())], names=schema.names)

    return numbered(df).mapInArrow(run, schema)
