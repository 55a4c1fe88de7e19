"""Counted word windows in compact batches.

A window is the word at a position with the words behind it, padded where the
piece ends. Within a task, words are numbered and a window is one integer;
``Windows`` counts them and cuts them by bucket into *batches*: the words of the
batch, then per window the numbers of its words and its counts, compressed.
Batches are what crosses a shuffle; merging two is a sort of integers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from threatsift.llm import textbuf

PAD = b""
SPAN = 3                                                     # words of a window
STRETCH = 200_000                                            # words counted at a time
_UPPER = bytes(range(65, 91))
_TABLE = bytearray(range(256))
_TABLE[65:91] = bytes(range(97, 123))
for _c in b".,;:!?\x0a\x0b\x0c\x0d":
    _TABLE[_c] = 0x0A
_TABLE[9] = 0x20
_TABLE = bytes(_TABLE)
_CODEC = "zstd"


def word_lists(data: bytes, step: int = 1 << 20) -> Iterator[list[bytes]]:
    """Lowered words of a text, some hundred thousand at a time; an empty one
    behind every piece."""
    data, lo = data.translate(_TABLE), 0
    while lo < len(data):
        hi = len(data)
        if hi - lo > step:                                   # cut behind a delimiter, a word is never cut
            hi = max(data.rfind(b" ", lo, lo + step), data.rfind(b"\n", lo, lo + step)) + 1
            if hi <= lo:
                hi = 1 + min(x for x in (data.find(b" ", lo), data.find(b"\n", lo), len(data) - 1) if x >= 0)
        pieces = data[lo:hi].split(b"\n")
        out: list[bytes] = []
        for i, piece in enumerate(pieces):
            out += [w for w in piece.split(b" ") if w]
            if i < len(pieces) - 1 or hi == len(data):
                out.append(PAD)
        yield out
        lo = hi


def combined(columns: list[np.ndarray], base: int) -> np.ndarray | None:
    """One integer per row of numbers below ``base``; None if too wide."""
    if base ** len(columns) >= 1 << 63:
        return None
    out = columns[0].astype(np.int64)
    for c in columns[1:]:
        out = out * base + c
    return out


def grouped(columns: list[np.ndarray], base: int, values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct rows of ``columns`` in order, and the sums of ``values``."""
    if not len(columns[0]):
        return columns, values
    key = combined(columns, base)
    order = np.argsort(key, kind="stable") if key is not None else np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    begin = np.flatnonzero(new)
    return [c[begin] for c in columns], [np.add.reduceat(v[order], begin) for v in values]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return textbuf.mix64(np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words)) + np.uint64(0x51ED270B))


def window_buckets(hashes: np.ndarray, columns: list[np.ndarray], buckets: int) -> np.ndarray:
    h = np.full(len(columns[0]), np.uint64(len(columns)))
    for c in columns:
        h = textbuf.mix64(h * np.uint64(0x9FB21C651E98DF25) + hashes[c])
    return (h % np.uint64(buckets)).astype(np.int64)


def pack(words: list[bytes], columns: list[np.ndarray], values: list[np.ndarray]) -> tuple[bytes, int]:
    """A batch: (compressed bytes, size before)."""
    used, index = np.unique(np.concatenate(columns), return_inverse=True)
    text = b"\n".join(words[i] for i in used.tolist())
    index = index.reshape(len(columns), -1)
    kind = np.uint8 if len(used) < 1 << 8 else np.uint16 if len(used) < 1 << 16 else np.uint32
    parts = [len(text).to_bytes(8, "little"), len(columns[0]).to_bytes(8, "little"), text,
             np.diff(index[0], prepend=0).astype(kind).tobytes(), *(i.astype(kind).tobytes() for i in index[1:])]
    for v in values:
        wide = np.uint8 if not len(v) or v.max() < 1 << 8 else np.uint32 if v.max() < 1 << 32 else np.uint64
        parts += [bytes([np.dtype(wide).itemsize]), v.astype(wide).tobytes()]
    raw = b"".join(parts)
    return pa.compress(raw, codec=_CODEC, asbytes=True), len(raw)


def unpack(data: bytes, size: int, span: int, values: int) -> tuple[list[bytes], list[np.ndarray], list[np.ndarray]]:
    raw = pa.decompress(data, decompressed_size=size, codec=_CODEC, asbytes=True)
    text, rows = int.from_bytes(raw[:8], "little"), int.from_bytes(raw[8:16], "little")
    words, at = raw[16:16 + text].split(b"\n"), 16 + text
    kind = np.dtype(np.uint8 if len(words) < 1 << 8 else np.uint16 if len(words) < 1 << 16 else np.uint32)
    columns, sums = [], []
    for _ in range(span):
        columns.append(np.frombuffer(raw, kind, rows, at).astype(np.int64))
        at += rows * kind.itemsize
    columns[0] = np.cumsum(columns[0])
    for _ in range(values):
        wide = np.dtype(f"<u{raw[at]}")
        sums.append(np.frombuffer(raw, wide, rows, at + 1).astype(np.int64))
        at += 1 + rows * wide.itemsize
    return words, columns, sums


class Windows:
    """Counts of the windows of one language, in one task."""

    def __init__(self, limit: int):
        self.limit, self.number, self.words = limit, {PAD: 0}, [PAD]
        self.waiting: list[bytes] = []
        self.held: list[tuple[list[np.ndarray], np.ndarray]] = []
        self.rows = 0

    def add(self, words: list[bytes]) -> None:
        """The next words, with an empty one behind every piece."""
        self.waiting += words
        if len(self.waiting) > STRETCH:
            self._count(len(self.waiting) - SPAN + 1)

    def _count(self, positions: int) -> None:
        """Count the windows that begin at the first waiting words; the others wait on."""
        coded = pa.array(self.waiting, pa.binary()).dictionary_encode()
        local, number = coded.dictionary.to_pylist(), self.number
        for w in local:
            if w not in number:
                number[w] = len(number)
                self.words.append(w)
        code = np.fromiter((number[w] for w in local), np.int64, len(local))[coded.indices.to_numpy()]
        lead = [np.concatenate([code[k:], np.zeros(k, np.int64)]) for k in range(SPAN)]      # lead columns
        for k in range(1, SPAN):
            lead[k] = np.where(lead[k - 1] == 0, 0, lead[k])                                # padded behind a piece's end
        at = np.flatnonzero(code[:positions])
        columns, (n,) = grouped([c[at] for c in lead], len(self.words), [np.ones(len(at), np.int64)])
        self.waiting = self.waiting[positions:]
        self.held.append((columns, n))
        self.rows += len(n)
        if self.rows > self.limit:
            self._merge()

    def _merge(self) -> None:
        columns = [np.concatenate([c[k] for c, _ in self.held]) for k in range(SPAN)]
        columns, (n,) = grouped(columns, len(self.words), [np.concatenate([n for _, n in self.held])])
        self.held, self.rows = [(columns, n)], len(n)

    def full(self) -> bool:
        return self.rows > self.limit // 2 or len(self.words) > self.limit // 4

    def batches(self, buckets: int) -> Iterator[tuple[int, bytes, int]]:
        """(bucket, batch, size) of everything added; then nothing is held."""
        if self.waiting:
            self._count(len(self.waiting))
        if self.held:
            self._merge()
            columns, n = self.held[0]
            yield from cut(self.words, columns, [n, n], buckets)
        self.__init__(self.limit)


def cut(words: list[bytes], columns: list[np.ndarray], values: list[np.ndarray], buckets: int) -> Iterator[tuple[int, bytes, int]]:
    """Batches (bucket, bytes, size) of windows in order; the bucket is a hash of
    the whole window, so a frequent word or pair is spread over all of them."""
    if not len(columns[0]):
        return
    bucket = window_buckets(word_hashes(words), columns, buckets)
    order = np.argsort(bucket, kind="stable")
    edge = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for lo, hi in zip(edge, np.append(edge[1:], len(order))):
        at = order[lo:hi]
        yield int(bucket[at[0]]), *pack(words, [c[at] for c in columns], [v[at] for v in values])


def merged(batches: list[tuple[bytes, int]], span: int, values: int) -> tuple[list[bytes], list[np.ndarray], list[np.ndarray]]:
    """One set of words, windows and sums from batches of one bucket."""
    number: dict[bytes, int] = {PAD: 0}
    columns, sums = [[] for _ in range(span)], [[] for _ in range(values)]
    for data, size in batches:
        words, cols, vals = unpack(data, size, span, values)
        code = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        for out, c in zip(columns, cols):
            out.append(code[c])
        for out, v in zip(sums, vals):
            out.append(v)
    flat, totals = grouped([np.concatenate(c) for c in columns], len(number), [np.concatenate(v) for v in sums])
    return list(number), flat, totals
