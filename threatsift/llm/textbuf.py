"""Vectorised text statistics: a batch of texts as one array of code points.

Texts are joined with a separator, so the words, lines and n-grams of a whole
batch come from a few numpy passes instead of a Python loop over words.
Batches are cut into blocks of bounded size; one longer text is a block alone.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np

BLOCK_CHARS = 1 << 18
SEPARATOR = "\x00"
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def blocks(texts: list[str], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Consecutive (first row, texts) of about ``limit`` characters."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        if held and size + len(t) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(t)
        size += len(t) + 1
    if held:
        yield first, held


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all texts joined, start and end of every text)."""
    cp = np.frombuffer(SEPARATOR.join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    size = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    start = np.concatenate([[0], np.cumsum(size + 1)[:-1]]) if len(texts) else np.zeros(0, np.int64)
    return cp, start.astype(np.int64), (start + size).astype(np.int64)


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), dtype=bool, count=0x110000)


def is_word_char(cp: np.ndarray) -> np.ndarray:
    return _letters()[cp]


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of True."""
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


@functools.lru_cache(maxsize=4)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    done = 1
    while done < n:                      # doubling: base^(i+done) = base^i * base^done
        step = min(done, n - done)
        out[done:done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


def _power_table(n: int, base: int) -> np.ndarray:
    size = 1 << max(16, (n - 1).bit_length())
    return _powers(size, base)[:n]


def mix64(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser (multiply and xor-shift)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of values[start:end] for every span, from one prefix sum of
    a polynomial modulo 2**64."""
    n = len(values)
    if n == 0 or len(start) == 0:
        return np.zeros(len(start), dtype=np.uint64)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(mix64(values.astype(np.uint64) + np.uint64(1)) * _power_table(n, _BASE), out=prefix[1:])
    h = (prefix[end] - prefix[start]) * _power_table(n, _INVERSE)[start]
    return mix64(h ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
