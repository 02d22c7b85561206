"""Hashes of all words of a block of texts at once, in numpy over the texts' bytes.

A word is a run of bytes that ``table`` marks. Its 64-bit hash is a polynomial in its bytes, then mixed; equal
words have equal hashes in every process. Blocks are bounded in bytes, a single longer text being a block.
"""

from __future__ import annotations

import numpy as np

#: Bytes of text in a block.
BLOCK_BYTES = 1 << 19

NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True

_BASE = 0x9E3779B97F4A7C13
_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, np.uint64)


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        more = np.full(max(n, 4096), _BASE, np.uint64)
        more[0] = 1
        _powers = np.multiply.accumulate(more)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def blocks(texts: list[bytes | None], most: int = BLOCK_BYTES):
    """Slices (from, to) of ``texts`` with about ``most`` bytes each."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > at and size + n > most:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)


def word_hashes(texts: list[bytes | None], table: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, edges: words of text i are edges[i] to edges[i + 1], bytes, first byte of each word, of each text)."""
    raw = np.frombuffer(b" ".join([*(t or b"" for t in texts), b""]), np.uint8)
    lengths = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
    text_at = np.concatenate([[0], np.cumsum(lengths + 1)])
    inside = table[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64), raw, starts, text_at
    where = np.flatnonzero(inside)
    before = np.cumsum(first[where]) - 1
    place = where - starts[before]
    terms = _VALUES[raw[where]] * _powers_to(int(place.max()) + 1)[place]
    runs = np.searchsorted(where, starts)
    h = mix(np.add.reduceat(terms, runs) + np.diff(np.append(runs, len(where))).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return h, np.searchsorted(starts, text_at), raw, starts, text_at
