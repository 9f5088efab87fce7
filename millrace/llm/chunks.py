"""Texts cut where byte-level pre-tokenization always cuts, so that encodings of
frequent chunks can be kept and joined.

A single space between two characters that are not white space always starts a
new pre-token that contains it, so ``a b`` encodes as ``a`` followed by `` b``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

#: Fixed pattern: the split of byte-level BPE that these cuts hold for.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space but the space and the line feed.
_OTHER_SPACE = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SAFE = re.compile(r"(?<=\S) (?=\S)")
SEGMENT = 4 << 20
#: Chunks of more characters are encoded anew each time.
LONGEST_KEPT = 64


#: A word of Latin letters, perhaps with ASCII marks (but no apostrophe) after it: the marks are one pre-token.
_LETTERS, _MARKS = "[A-Za-zÀ-ÖØ-öø-ɏ]+", r"[!-&(-/:-@\[-`{-~]*"
_WORD = re.compile(f"({_LETTERS})({_MARKS})")
_LINES = re.compile(f"({_LETTERS}{_MARKS})\n({_LETTERS})({_MARKS})")


class Recent(dict):
    """Encodings of chunks with the space before them. Computes what it lacks and
    forgets what two fills of ``limit`` entries did not ask for. ``piece`` encodes
    one pre-token, ``text`` anything."""

    def __init__(self, piece: Callable[[str], bytes], text: Callable[[str], bytes], limit: int = 500_000) -> None:
        super().__init__()
        self.piece, self.text, self.limit, self.old, self.marks = piece, text, limit, {}, {}

    def __missing__(self, chunk: str) -> bytes:
        if len(chunk) > LONGEST_KEPT:
            return self.text(" " + chunk)
        value = self.old.pop(chunk, None)
        if value is None:
            word = _WORD.fullmatch(chunk)
            if word is None:
                if lines := _LINES.fullmatch(chunk):  # a line break between two words is a pre-token of its own
                    return self[lines[1]] + self.short("\n") + self.short(lines[2]) + (self.short(lines[3]) if lines[3] else b"")
                value = self.text(" " + chunk)
            elif word[2]:
                known = word[1] in self or word[1] in self.old
                value = self[word[1]] + self.short(word[2])
                if not known:  # a new word rarely comes back with the same marks
                    return value
            else:
                value = self.piece(" " + chunk)
        return self._keep(chunk, value)

    def _keep(self, chunk: str, value: bytes) -> bytes:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[chunk] = value
        return value

    def spaced(self, chunk: str) -> bytes:
        """The encoding of a chunk that is known to be one pre-token with its space."""
        value = self.get(chunk)
        if value is None:
            value = self.old.pop(chunk, None)
            value = self._keep(chunk, self.piece(" " + chunk) if value is None else value)
        return value

    def short(self, piece: str) -> bytes:
        """The encoding of a pre-token without a space before it."""
        if len(piece) > LONGEST_KEPT:
            return self.piece(piece)
        value = self.marks.get(piece)
        if value is None:
            if len(self.marks) >= self.limit // 4:
                self.marks.clear()
            value = self.marks[piece] = self.piece(piece)
        return value


def segments(text: str) -> Iterator[tuple[str, list[str]]]:
    """(start, chunks) pairs of at most about 4 MB: ``start`` is as it stands,
    and each chunk has lost the space before it."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > SEGMENT:
            cut = _SAFE.search(text, at + SEGMENT)
            end = cut.start() if cut else end
        part = text[at + 1 : end] if at else text[:end]  # a later part began with the space at which it was cut
        single = not ("  " in part or " \n" in part or "\n " in part or _OTHER_SPACE.search(part))
        chunks = part.split(" ") if single else _SAFE.split(part)
        yield ("", chunks) if at else (chunks[0], chunks[1:])
        at = end


def encode_text(text: str, recent: Recent) -> bytes:
    """The encoding of a text, joined from those of its chunks."""
    out = []
    for start, chunks in segments(text):
        if start:
            out.append(recent.text(start))
        out.append(b"".join(map(recent.__getitem__, chunks)))
    return b"".join(out)
