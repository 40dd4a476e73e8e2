"""64-bit hashes of words and of runs of words, for many texts at once in numpy.

A word's hash is a polynomial in its bytes modulo 2**64 with a random odd base,
finished by a mixing step; a run's hash is the same over its words' hashes. The same
bytes have the same hash in every process.
"""

from __future__ import annotations

import numpy as np

# Odd 64-bit multipliers.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_A
    x = x ^ (x >> np.uint64(27))
    x = x * MIX_B
    return x ^ (x >> np.uint64(31))


_POWERS = np.cumprod(np.full(64, BASE, dtype=np.uint64))
KEPT_POWERS = 1 << 20


def powers(n: int) -> np.ndarray:
    """BASE ** 1 .. BASE ** n; the table grows by doubling and is kept up to ``KEPT_POWERS``."""
    global _POWERS
    table = _POWERS
    while len(table) < n:
        table = np.concatenate([table, table * table[-1]])
    _POWERS = table[:KEPT_POWERS]
    return table[:n]


def words(data: bytes, gap: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each maximal run of bytes that are no gap."""
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = ~gap[raw]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start, end
    size = end - start
    at = np.flatnonzero(inside)
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    place = np.arange(len(at)) - np.repeat(first, size)
    terms = (raw[at].astype(np.uint64) + np.uint64(1)) * powers(int(size.max()))[place]
    return mix(np.add.reduceat(terms, first)), start, end


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k consecutive words; empty where there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out += hashes[i : i + n] * powers(k)[i]
    return mix(out)


def joined(texts: list[str | None]) -> tuple[bytes, np.ndarray]:
    """All texts as UTF-8, each followed by a line end, and where each begins; null is empty."""
    parts = [(x or "").encode() for x in texts]
    ends = np.cumsum([len(x) + 1 for x in parts]) if parts else np.zeros(0, np.int64)
    return b"\n".join([*parts, b""]), np.concatenate([[0], ends[:-1]]).astype(np.int64) if parts else ends.astype(np.int64)


def text_words(texts: list[str | None], gap: np.ndarray = WHITE, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and each text's first index into them (one more entry at the end)."""
    data, begin = joined(texts)
    hashes, start, _ = words(data.lower() if lower else data, gap)  # bytes: lower() changes A-Z only
    return hashes, np.concatenate([np.searchsorted(start, begin), [len(hashes)]])


def blocks(texts: list[str | None], most: int = 4 << 20):
    """(low, high) ranges of texts of about ``most`` characters, one text at least."""
    low = size = 0
    for k, x in enumerate(texts):
        size += len(x or "")
        if size >= most:
            yield low, k + 1
            low, size = k + 1, 0
    if low < len(texts):
        yield low, len(texts)
