"""ASCII-white-space words of whole texts, as bytes and in bounded blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

#: A-Z to a-z, every other byte as it is.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
BLOCK = 4 << 20


def word_blocks(text: str | None, lower: bool = True) -> Iterator[list[bytes]]:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order, in lists cut from about 4 MB of text each."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if lower:
        data = data.translate(LOWER)
    at = 0
    while at < len(data):
        end = len(data)
        if end - at > BLOCK:
            cut = _SPACE.search(data, at + BLOCK)
            end = cut.start() if cut else end
        yield data[at:end].split()
        at = end


def shingle_blocks(text: str | None, size: int) -> Iterator[list[bytes]]:
    """Space-joined runs of ``size`` words, repeats included; a text of fewer
    words (but one) gives its whole word sequence, a text of none gives nothing."""
    carry: list[bytes] = []
    given = False
    for block in word_blocks(text):
        words = carry + block
        if len(words) >= size:
            given = True
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            yield [joined[a:b] for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())]
        carry = words[max(0, len(words) - size + 1) :] if size > 1 else []
    if not given and carry:
        yield [b" ".join(carry)]
