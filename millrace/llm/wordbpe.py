"""BPE with word ends, encoded over a trie of the distinct words.

The encoding of a prefix is that of a shorter prefix and one last token, and which
token that is follows from neighbours alone: two tokens may stand side by side if no
merge reaches over their boundary. So every node of a trie of words keeps the last
token of its prefix and the node where that token starts. A depth-first walk fills a
node once for all words that share it; a word's own last symbol, which carries the
word end, comes on top. This holds for vocabularies in which the parts of a merge are
symbols or results of earlier merges and each token has one merge; others are refused.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .storage import numbered

_NEVER = 1 << 62
#: Fixed pattern: the split of this kind of tokenizer file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
#: White space as the pattern's library sees it.
_SPACE = "\t-\r \x85\xa0  -     　"
#: Characters below are changed by no normalization but lower-casing, the same in both libraries.
PLAIN = 0x180
#: Words, trie nodes and pairs of tokens that a worker keeps.
KEPT, NODES, PAIRS = 400_000, 1_000_000, 1_000_000
#: Symbols of a word that enters the trie, words that enter it together, characters cut into words at a time.
LONGEST, WORDS, SEGMENT = 64, 300_000, 2 << 20


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Merges:
    """Which tokens may be neighbours."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], symbols: Iterable[str]) -> None:
        self.ids = vocab
        made = {vocab[s]: -1 for s in symbols if s in vocab}
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            if left not in made or right not in made or whole in made:
                raise ValueError(f"merge {rank} ({a} {b}) is not of two earlier tokens to a new one")
            made[whole] = rank
            self.rank[left << 32 | right] = rank
            self.parts[whole] = left, right
        self.made = made
        self.edges: tuple[dict[int, list[tuple[int, int]]], ...] = ({}, {})
        self.whole: dict[int, bool] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at one end of ``token`` while it forms, each with the
        rank of the merge that takes it in. ``side``: 0 the left end, 1 the right."""
        found = self.edges[side].get(token)
        if found is None:
            found, at, until = [], token, _NEVER
            while True:
                found.append((at, until))
                if at not in self.parts:
                    break
                at, until = self.parts[at][side], self.made[at]
            found.reverse()
            self.edges[side][token] = found
        return found

    def crossing(self, a: int, b: int) -> int:
        """Rank of the first merge over the boundary of two tokens that form side by side."""
        left, right = self._edge(a, 1), self._edge(b, 0)
        i = j = 0
        while True:
            (x, taken_x), (y, taken_y) = left[i], right[j]
            rank = self.rank.get(x << 32 | y, _NEVER)
            if rank < taken_x and rank <= taken_y:  # of equal merges the left one comes first
                return rank
            if taken_x <= taken_y:
                if taken_x == _NEVER:
                    return _NEVER
                i += 1
            else:
                j += 1

    def reachable(self, token: int) -> bool:
        """Whether the token's own symbols merge to it."""
        found = self.whole.get(token)
        if found is None:
            if token in self.parts:
                a, b = self.parts[token]
                found = self.reachable(a) and self.reachable(b) and self.crossing(a, b) == self.made[token]
            else:
                found = token in self.made
            self.whole[token] = found
        return found

    def neighbours(self, a: int, b: int) -> bool:
        return self.crossing(a, b) == _NEVER


class Trie:
    """Prefixes of words, each with its last token and the prefix before that token."""

    def __init__(self, merges: Merges, end: str) -> None:
        self.merges = merges
        usable = {s: i for s, i in merges.ids.items() if merges.reachable(i)}
        self.inner = usable if not end else {s: i for s, i in usable.items() if not s.endswith(end)}
        self.final = usable if not end else {s[: -len(end)]: i for s, i in usable.items() if s.endswith(end)}
        self.beside: dict[int, bool] = {}
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.last, self.before = [-1], [0]

    @staticmethod
    def _reach(tokens: dict[str, int]) -> dict[str, int]:
        """Length of the longest token with each ending of three symbols."""
        found: dict[str, int] = {}
        for s in tokens:
            if len(s) > found.get(s[-3:], 2):
                found[s[-3:]] = len(s)
        return found

    @cached_property
    def reaches(self) -> tuple[dict[str, int], dict[str, int]]:
        return self._reach(self.inner), self._reach(self.final)

    def _token(self, path: list[int], shape: str, ends: bool) -> tuple[int, int]:
        """(last token, node before it) of ``shape``; ``path``: the nodes of its proper prefixes."""
        tokens, last, beside, size = (self.final if ends else self.inner), self.last, self.beside, len(shape)
        far = self.reaches[ends].get(shape[-3:], 2)
        for start in range(size - far if far < size else 0, size):
            token = tokens.get(shape[start:])
            if token is not None:
                node = path[start]
                if not node:
                    return token, node
                key = last[node] << 32 | token
                allowed = beside.get(key)
                if allowed is None:
                    if len(beside) > PAIRS:
                        beside.clear()
                    allowed = beside[key] = self.merges.neighbours(last[node], token)
                if allowed:
                    return token, node
        raise ValueError(f"no tokens for {shape!r}")

    def encode(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """(word, ids) of each word, in sorted order: the depth-first walk, in which the
        path of a word begins with what it shares with the word before."""
        path, held = [0], ""
        for word in sorted(words):
            if len(word) > LONGEST:
                yield word, self._alone(word)
                continue
            body = word[:-1]
            same = 0
            for x, y in zip(held, body):
                if x != y:
                    break
                same += 1
            del path[same + 1 :]
            node = path[-1]
            for at in range(same, len(body)):
                key = (node, body[at])
                node = self.child.get(key, 0)
                if not node:
                    node = self.child[key] = len(self.last)
                    token, start = self._token(path, body[: at + 1], False)
                    self.last.append(token)
                    self.before.append(start)
                path.append(node)
            held = body
            token, node = self._token(path, word, True)
            out = [token]
            while node:
                out.append(self.last[node])
                node = self.before[node]
            out.reverse()
            yield word, out

    def _alone(self, word: str) -> list[int]:
        """A very long word: the same walk over arrays of its own, which nothing shares."""
        size = len(word)
        last, before = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
        for stop in range(1, size + 1):
            tokens, far = (self.final if stop == size else self.inner), self.reaches[stop == size].get(word[max(0, stop - 3) : stop], 2)
            for start in range(max(0, stop - far), stop):
                token = tokens.get(word[start:stop])
                if token is not None and (not start or self.merges.neighbours(int(last[start]), token)):
                    last[stop], before[stop] = token, start
                    break
            else:
                raise ValueError(f"no tokens for {word[max(0, stop - 40):stop]!r}")
        out, at = [], size
        while at:
            out.append(int(last[at]))
            at = int(before[at])
        return out[::-1]


def _plain_split() -> Callable[[str], list[str]]:
    """``PATTERN`` for texts of plain characters, letters first, as most words are."""
    import regex

    def members(kind: str) -> str:
        inside = regex.compile(kind)
        return "".join(re.escape(chr(i)) for i in range(PLAIN) if inside.fullmatch(chr(i)))

    letters, numbers = members(r"\p{L}"), members(r"\p{N}")
    return re.compile(f"[{letters}]+|'s|'t|'re|'ve|'m|'ll|'d|[{numbers}]|[^{_SPACE}{letters}{numbers}]+").findall


class Codec:
    """A tokenizer file of this kind: texts to ids and back."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as lines:
            spec = json.load(lines)
        model = spec["model"]
        end = model.get("end_of_word_suffix") or ""
        steps = [s.get("type") for s in (spec["normalizer"] or {}).get("normalizers", [])]
        cuts = [s for s in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        plain = all(not t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("dropout") or model.get("ignore_merges") or steps != ["NFC", "Replace", "Lowercase"] or [c.get("type") for c in cuts] != ["Split", "ByteLevel"] or cuts[0]["pattern"].get("Regex") != PATTERN or not plain:
            raise ValueError(f"{path} is no word BPE of the known kind")
        letters = byte_letters()
        self.shown = {b: letters[b] for b in range(256)}
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.trie = Trie(Merges(model["vocab"], merges, [x + e for x in letters for e in ("", end)]), end)
        self.names = {i: s for s, i in model["vocab"].items()}
        self.names |= {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.added = {t["content"]: np.int32(t["id"]).tobytes() for t in spec["added_tokens"]}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.findall = _plain_split()
        self.strange, self.gap = re.compile(f"[^\0-{chr(PLAIN - 1)}]").search, re.compile(f"[{_SPACE}]")
        library = Tokenizer.from_file(path)
        self.normalize, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.known: dict[str, bytes] = {}
        self.known_shown: dict[str, bytes] = {}

    def _learn(self, words: set[str], known: dict[str, bytes], shape) -> None:
        if len(known) > KEPT:
            known.clear()
        new = words.difference(known)
        if new:
            if len(self.trie.last) > NODES:
                self.trie.clear()
            by_shape = {shape(w): w for w in new}
            for word, ids in self.trie.encode(by_shape):
                known[by_shape[word]] = array("i", ids).tobytes()

    def _shape(self, word: str) -> str:
        return word if word.isascii() and word.isalpha() else word.encode().decode("latin-1").translate(self.shown)

    def _parts(self, text: str) -> Iterator[bytes | tuple[bool, list[str]]]:
        """A text in order: the ids of added tokens, and the words between them, with
        whether they come in byte letters already."""
        for part in self.marks.split(text) if self.marks and self.marks.search(text) else (text,):
            if part in self.added:
                yield self.added[part]
                continue
            at = 0
            while at < len(part):
                end = len(part)
                if end - at > SEGMENT:  # white space is in no word, and nothing before it composes with it
                    cut = self.gap.search(part, at + SEGMENT)
                    end = cut.start() if cut else end
                piece = part[at:end]
                at = end
                if self.strange(piece):
                    yield True, [w for w, _ in self.split(self.normalize(piece))]
                else:
                    yield False, self.findall(piece.lower())

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as 32-bit integers in this machine's byte order. The words
        of each ``WORDS`` or so enter the trie together."""
        done: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, int, bool, list[str]]] = []
        size = 0

        def finish() -> None:
            for shown, known, shape in ((True, self.known_shown, str), (False, self.known, self._shape)):
                self._learn(set().union(*(words for *_, kind, words in held if kind == shown)), known, shape)
                for row, place, kind, words in held:
                    if kind == shown:
                        done[row][place] = b"".join(map(known.__getitem__, words))
            held.clear()

        for row, text in enumerate(texts):
            for part in self._parts(text or ""):
                done[row].append(part)
                if part.__class__ is tuple:
                    held.append((row, len(done[row]) - 1, *part))
                    size += len(part[1])
                    if size > WORDS:
                        finish()
                        size = 0
        finish()
        return [b"".join(x) for x in done]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        """The tokens with a space between; ids outside the vocabulary are left out, as the library does."""
        try:
            return " ".join(map(self.names.__getitem__, ids.tolist()))
        except KeyError:
            return " ".join(self.names[i] for i in ids.tolist() if i in self.names)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec for each file in a Python worker."""
    return Codec(path)


def _with(df: DataFrame, new: list[T.StructField], without: frozenset[str] = frozenset()) -> tuple[T.StructType, list[int]]:
    names = {f.name for f in new} | without
    kept = [f for f in df.schema if f.name not in names]
    return T.StructType(kept + new), [df.columns.index(f.name) for f in kept]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids", decoded: str | None = None, packed: bool = False, keep_text: bool = True) -> DataFrame:
    """``docs`` with the column ``ids``: the ids of each text by the tokenizer file
    ``path``, added tokens' strings in it included, none added around it.

    The ids are an array of int; ``packed`` makes them binary, four bytes each, little
    end first. ``decoded`` names a string column to which they are decoded in the same
    pass. A null or empty text has no ids. Texts of any length are encoded whole, in
    segments that end at white space. Columns of the new names are replaced; rows,
    repeats and ties included, and other columns stay. An empty table gives an empty one.
    """
    kind = T.BinaryType() if packed else T.ArrayType(T.IntegerType())
    new = [T.StructField(ids, kind)] + ([T.StructField(decoded, T.StringType())] if decoded else [])
    schema, kept = _with(docs, new, frozenset() if keep_text else frozenset({text}))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            found = [np.frombuffer(x, np.int32) for x in c.encode_all(batch.column(at).to_pylist())]
            if packed:
                column = pa.array([x.astype("<u4", copy=False).tobytes() for x in found], pa.binary())
            else:
                offsets = np.cumsum([0, *map(len, found)])
                column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(found), pa.int32()))
            columns = [batch.column(k) for k in kept] + [column]
            if decoded:
                columns.append(pa.array([c.decode(x) for x in found], pa.string()))
            yield pa.record_batch(columns, names=schema.names)

    return numbered(docs).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the string column ``decoded`` of an id array: its tokens with a space
    between, without ids that are null or outside the vocabulary; null for a null array."""
    schema, kept = _with(df, [T.StructField(decoded, T.StringType())])
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            rows = (row.as_py() for row in batch.column(at))
            out = [None if x is None else " ".join(c.names[i] for i in x if i in c.names) for x in rows]
            yield pa.record_batch([batch.column(k) for k in kept] + [pa.array(out, pa.string())], names=schema.names)

    return numbered(df).mapInArrow(run, schema)
