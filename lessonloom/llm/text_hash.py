"""Hashes of all words and character n-grams of many texts at once, in numpy.

A polynomial hash of every prefix gives the hash of any span by one
subtraction and one multiplication, so no word is ever a Python object.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

PIECE = 1 << 20  # bytes hashed at once; longer texts come in pieces cut at white space
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_NO_LETTER = np.zeros(256, dtype=bool)
_NO_LETTER[[b for b in range(128) if not chr(b).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = 2 * PIECE + 64
    up, down = np.full(n, _BASE, dtype=np.uint64), np.full(n, pow(_BASE, -1, 2**64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _spans(data: bytes, overlap: int, back: int, size: int, bare: bool):
    """``start, lead, end`` of the pieces of one text: each adds the bytes from ``lead``
    to ``end`` and repeats those from ``start`` to ``lead``."""
    if len(data) <= size:
        yield 0, 0, len(data)
        return
    raw = np.frombuffer(data, dtype=np.uint8)
    gaps = np.flatnonzero(_SPACE[raw])
    inside = ~(_NO_LETTER if bare else _SPACE)[raw]
    begins = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    lead = 0
    while lead < len(data):
        end = len(data)
        if end - lead > size:
            n = int(np.searchsorted(gaps, lead + size, side="right"))
            if n and gaps[n - 1] > lead:
                end = int(gaps[n - 1])
            else:
                end = min(int(gaps[n]) if n < len(gaps) else end, lead + PIECE, end)
        start = lead
        before = int(np.searchsorted(begins, lead))
        if overlap and before:
            start = int(begins[max(0, before - overlap)])
        yield max(0, min(start, lead - back), lead - PIECE // 2), lead, end
        lead = end


def pieces(texts, overlap: int = 0, back: int = 0, size: int = PIECE // 4, bare: bool = False):
    """Groups of ``(text number, bytes, lead, more)`` of about ``size`` bytes in all.

    A long text gives several pieces, cut at white space. The first ``lead`` bytes of
    a piece repeat the end of the one before: at least its last ``overlap`` words
    (``bare`` as for ``Hashed``) and ``back`` bytes, so that nothing that spans a cut
    is lost; ``more`` tells whether a piece follows. Only a word of more than ``PIECE`` bytes is cut itself, and no more than
    half of that is repeated. Time and copies are linear in the text.
    """
    group, held = [], 0
    for number, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        for start, lead, end in _spans(data, overlap, back, size, bare):
            group.append((number, data[start:end], lead - start, end < len(data)))
            held += end - start
            if held >= size:
                yield group
                group, held = [], 0
    if group:
        yield group


class Hashed:
    """Words of a group of pieces: their hashes, and which piece each belongs to.

    Words are split at ASCII white space, or with ``bare`` at every ASCII
    character that is neither letter nor digit. ``firsts`` and ``counts`` take in the
    words a piece repeats, ``fresh`` and ``added`` only those it adds.
    """

    def __init__(self, group, lower: bool, bare: bool = False):
        owner, parts, leads, more = zip(*group)
        joined = b" ".join(parts) + b" "
        self.raw = np.frombuffer(joined, dtype=np.uint8)
        self.seen = _LOWER[self.raw] if lower else self.raw
        self.blank = (_NO_LETTER if bare else _SPACE)[self.raw]
        self.owner = np.array(owner, dtype=np.int64)
        sizes = np.array([len(data) + 1 for data in parts])
        self.byte_ends = np.cumsum(sizes)
        self.byte_firsts = self.byte_ends - sizes
        self.leads = self.byte_firsts + np.array(leads, dtype=np.int64)
        self.more = np.array(more, dtype=bool)
        up, self._down = _powers()
        letters = np.where(self.blank, np.uint8(32), self.seen).astype(np.uint64) + np.uint64(1)
        self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters * up[: len(letters)])])
        edges = np.diff(self.blank.astype(np.int8), prepend=1)
        self.starts = np.flatnonzero(edges == -1)
        self.ends = np.flatnonzero(edges == 1)
        self.words = self._span(self.starts, self.ends)
        bounds = np.concatenate([[0], np.searchsorted(self.starts, self.byte_ends)])
        self.firsts, self.counts = bounds[:-1], np.diff(bounds)
        self.fresh = np.searchsorted(self.starts, self.leads)
        self.added = bounds[1:] - self.fresh

    def _span(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mixed((self._sums[b] - self._sums[a]) * self._down[a])

    def stems(self, n: int) -> np.ndarray:
        """Hashes of the first ``n`` bytes of every word, of the whole word if shorter."""
        return self._span(self.starts, np.minimum(self.ends, self.starts + n))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all n-byte spans (white space as one kind of letter) and, per
        piece, the first span that ends in the bytes it adds and how many do."""
        many = max(0, len(self.raw) - n + 1)
        a = np.arange(many)
        h = _mixed((self._sums[n:] - self._sums[:many]) * self._down[:many] + np.uint64(n)) if many else np.zeros(0, np.uint64)
        begins = np.minimum(np.maximum(self.byte_firsts, self.leads - n + 1), many)
        ends = np.clip(self.byte_ends - n, 0, many)
        return h, begins, np.maximum(ends - begins, 0) if len(a) else np.zeros(len(begins), np.int64)
