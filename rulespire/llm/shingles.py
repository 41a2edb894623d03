"""Word shingles of whole texts as 64-bit hashes, with numpy.

Words are runs of bytes other than 0x20 and 0x09-0x0D, A-Z in lower case. A text of fewer than
``k`` words is one shingle; a text without words has none.
"""

from __future__ import annotations

import numpy as np

#: Bytes hashed in one step; a longer text is cut between words.
STEP = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_FOLD = np.uint64(0xD6E8FEB86659FD93)


def mix64(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit numbers (a one-to-one mapping)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of a number modulo 2**64, as many as were asked for so far."""

    def __init__(self, base: int):
        self.base, self.known = np.uint64(base), np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.known) < n:
            x = np.full(max(n, STEP + 1024), self.base, np.uint64)
            x[0] = 1
            self.known = np.multiply.accumulate(x)
        return self.known[:n]


_UP, _DOWN = _Powers(_BASE), _Powers(_INVERSE)


def _hash_step(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of some bytes."""
    space = _SPACE[b]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64), start
    # sum of byte * base**-place, so that a word's part times base**start doesn't depend on its place
    run = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((_LOWER[b] + np.uint64(1)) * _DOWN.upto(len(b)), out=run[1:])
    word = (run[end] - run[start]) * _UP.upto(len(b) + 1)[start]
    return mix64(word + (end - start).astype(np.uint64) * _FOLD), start


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and the number of words of each text."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    some: list[int] = []
    held = 0

    def flush():
        nonlocal some, held
        if some:
            joined = np.frombuffer(b" ".join(texts[k] for k in some), np.uint8)
            h, start = _hash_step(joined)
            hashes.append(h)
            bounds = np.cumsum([len(texts[k]) + 1 for k in some])
            counts[some] = np.diff(np.searchsorted(start, bounds), prepend=0)
            some, held = [], 0

    for k, text in enumerate(texts):
        if len(text) > STEP:
            flush()
            at = 0
            while at < len(text):
                cut = at + STEP
                while cut < len(text) and not _SPACE[text[cut]]:
                    cut += 1
                h, _ = _hash_step(np.frombuffer(text[at:cut], np.uint8))
                hashes.append(h)
                counts[k] += len(h)
                at = cut
            continue
        if held + len(text) > STEP:
            flush()
        some.append(k)
        held += len(text) + 1
    flush()
    return np.concatenate(hashes) if hashes else np.empty(0, np.uint64), counts


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """One hash per run of k words of one text, in order; fewer words make one shingle."""
    n = len(words)
    if n == 0:
        return words
    size = min(k, n)
    out = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        out = out * _FOLD + words[i : n - size + 1 + i]
    return mix64(out + np.uint64(size))


def shingle_sets(texts: list[str | None], k: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, counts = word_hashes([(t or "").encode() for t in texts])
    out, at = [], 0
    for n in counts:
        out.append(np.unique(shingle_hashes(words[at : at + n], k)))
        at += n
    return out
