"""Cutting a text where every byte-level pre-tokenizer of this family also cuts.

The public pattern starts a match at any single space that a non-space character follows, and no
match runs across such a place. The pieces between those places can therefore be tokenized one at
a time, and each different piece only once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa

_ODD = re.compile(r" (?=\s|\Z)")
_CUT = re.compile(r" (?=\S)")

#: Pieces that a worker remembers; when full it starts again, which costs time but no memory.
REMEMBERED = 300_000
#: Longer pieces are tokenized but not remembered.
LONGEST = 64


def split(text: str) -> list[str]:
    """The first piece as it stands, and every later one without the space that it starts with."""
    return text.split(" ") if _ODD.search(text) is None else _CUT.split(text)


class PieceCache:
    """Encoded form of each piece, as little-endian 32-bit ids, for pieces with and without the space."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], remember: int | None = REMEMBERED):
        self.encode = encode
        self.remember = remember
        self.plain: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    def encode_texts(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text; all pieces not yet known are encoded together. A null is empty."""
        if self.remember is not None and len(self.spaced) + len(self.plain) > self.remember:
            self.plain.clear()
            self.spaced.clear()
        spaced, plain = self.spaced, self.plain
        rows: list[list] = []
        #: Row, place and piece of each piece that is not known.
        gaps: list[tuple[int, int, str]] = []
        for i, t in enumerate(self._few(texts)):
            parts = split(t)
            found = list(map(spaced.get, parts))
            found[0] = plain.get(parts[0])
            k = -1
            for _ in range(found.count(None)):
                k = found.index(None, k + 1)
                gaps.append((i, k, parts[k]))
            rows.append(found)
        new, heads = list({p for _, k, p in gaps if k}), list({p for _, k, p in gaps if not k})
        found = self.encode([" " + p for p in new] + heads)
        spaced.update(zip(new, found, strict=False))
        plain.update(zip(heads, found[len(new) :], strict=True))
        for i, k, p in gaps:
            rows[i][k] = spaced[p] if k else plain[p]
        out = [b"".join(r) for r in rows]
        for p in new:
            if len(p) > LONGEST:
                del spaced[p]
        for p in heads:
            if len(p) > LONGEST:
                del plain[p]
        return out

    def look_up(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text, in one pass where all pieces are known; texts with other pieces are encoded together."""
        out, missing = [], []
        for i, t in enumerate(self._few(texts)):
            parts = split(t)
            try:
                out.append(self.plain[parts[0]] + b"".join([self.spaced[p] for p in parts[1:]]))
            except KeyError:
                out.append(b"")
                missing.append(i)
        for i, ids in zip(missing, self.encode_texts(texts.take(pa.array(missing, pa.int64()))) if missing else [], strict=True):
            out[i] = ids
        return out

    @staticmethod
    def _few(texts: pa.Array) -> Iterator[str]:
        for a in range(0, len(texts), 256):
            for t in texts[a : a + 256].to_pylist():
                yield t or ""


def blocks(text: str | bytes, space: str | bytes, limit: int) -> Iterator[str | bytes]:
    """Parts of a text of about ``limit`` characters, cut at spaces, which are left out; a longer word is never cut."""
    a = 0
    while len(text) - a > limit:
        b = text.rfind(space, a, a + limit)
        if b <= a:
            b = text.find(space, a + limit)
            if b < 0:
                break
        yield text[a:b]
        a = b + 1
    yield text[a:] if a else text
