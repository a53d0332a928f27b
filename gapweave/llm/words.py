"""Words of many texts as hash arrays: lower-cased runs of letters, digits and non-ASCII characters."""

from __future__ import annotations

import numpy as np

from .common import mix64

#: Bytes of text in one pass over arrays.  A single longer text makes a longer pass: texts are never cut.
SLAB = 1 << 20

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(max(n, SLAB), base, np.uint64))), dtype=np.uint64)
        if n <= 2 * SLAB:
            _POWERS[base] = have
    return have


def slabs(texts: list[str | None]):
    """Yield (first, stop) ranges of texts of about SLAB characters."""
    i = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= SLAB:
            yield i, k + 1
            i, size = k + 1, 0
    if i < len(texts):
        yield i, len(texts)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words before each text and in all); null texts have no words."""
    parts = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    lens = np.fromiter(map(len, parts), np.int64, len(parts))
    begin = np.cumsum(lens + 1) - lens - 1
    inside = _WORD[buf]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate(([0], edge))
    start, stop = edge[::2], edge[1::2]  # the last byte is a blank, so each word ends
    n = len(buf)
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n)[:n], dtype=np.uint64)))
    h = mix64((run[stop] - run[start]) * _powers(_INVERSE, n)[start])
    return h, np.searchsorted(start, np.concatenate((begin, [n])))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words (they may cross texts: the caller looks at offsets)."""
    n = len(h) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = mix64((out + np.uint64(0x632BE59BD9B4E019)) ^ h[j : j + n])
    return out
