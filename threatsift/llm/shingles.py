"""Hashed word shingles of whole texts, straight from Arrow string buffers.

Words are maximal runs of bytes other than space and the ASCII controls 9-13
(no byte of a multi-byte character is one of these); A-Z are lowered. A word's
hash is a chain of bijective mixing steps over its length and its bytes, eight
at a time, all words of a block at once; longer words than ``LONG_WORD`` are
hashed by BLAKE2. No algebra relates the hashes of related words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from threatsift.llm import textbuf

BLOCK_BYTES = 1 << 18
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
LONG_WORD = 1_024
_START, _STEP = np.uint64(0x5851F42D4C957F2D), np.uint64(0x9FB21C651E98DF25)


def byte_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column without nulls."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return off, np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)


def word_hashes(data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of every word of the texts data[start[i]:start[i+1]]."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = ~_SPACE[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[start[:-1]] = True
    cut[n] = True
    begins = np.flatnonzero(word & (np.concatenate([[True], ~word[:-1]]) | cut[:-1]))
    ends = np.flatnonzero(word & (np.concatenate([~word[1:], [True]]) | cut[1:])) + 1
    low = np.concatenate([_LOWERED[data], np.zeros(8, np.uint8)])
    size = ends - begins
    h = textbuf.mix64(size.astype(np.uint64) + _START)
    left = np.flatnonzero(size <= LONG_WORD)
    done = 0
    while len(left):
        at, rest = begins[left] + done, size[left] - done
        chunk = np.zeros(len(left), dtype=np.uint64)
        for k in range(min(8, int(rest.max()))):
            chunk |= np.where(rest > k, low[at + k], 0).astype(np.uint64) << np.uint64(8 * k)
        h[left] = textbuf.mix64((h[left] ^ chunk) * _STEP + _START)
        done += 8
        left = left[rest > 8]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(low[begins[i]:ends[i]].tobytes(), digest_size=8).digest(), "little")
    return np.searchsorted(start, begins, side="right") - 1, h


def shingle_hashes(text: np.ndarray, word: np.ndarray, texts: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash), distinct and sorted, of all shingles of ``width``
    words; a text of fewer words is one shingle, one without words has none."""
    count = np.bincount(text, minlength=texts)
    first = np.cumsum(count) - count
    owners, hashes = [], []
    for k in range(1, width + 1):
        if k == width:
            at = np.flatnonzero(text[:max(0, len(text) - k + 1)] == text[k - 1:]) if len(text) >= k else np.zeros(0, np.int64)
        else:
            at = first[count == k]
        h = np.full(len(at), np.uint64(k), dtype=np.uint64)
        for j in range(k):
            h = textbuf.mix64(h * np.uint64(0x9FB21C651E98DF25) + word[at + j])
        owners.append(text[at])
        hashes.append(h)
    owner, h = np.concatenate(owners), np.concatenate(hashes)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    if len(h):
        new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])])
        owner, h = owner[new], h[new]
    return owner, h


def blocks(column: pa.Array, width: int, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, text index, shingle hash) of consecutive rows of about
    ``limit`` bytes; a longer text is a block alone."""
    off, data = byte_buffer(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        start = off[i:j + 1] - off[i]
        text, word = word_hashes(data[off[i]:off[j]], start)
        owner, h = shingle_hashes(text, word, j - i, width)
        yield i, j - i, owner, h
        i = j
