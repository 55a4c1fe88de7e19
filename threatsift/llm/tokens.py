"""Byte-level BPE encoding of whole texts, and its splicing over chunks.

The vocabulary is read from a public tokenizer file (JSON of the tokenizers
library). Encoding runs on tiktoken's encoder built from the same vocabulary,
which gives the same ids about four times as fast (compared on every code point
and on generated texts in the tests). A long text is encoded in overlapping
chunks:

* two neighbouring chunks agree on a *common boundary* inside their overlap:
  a place where both have a token boundary and which the pre-tokenisation
  splits whatever surrounds it (a letter or digit followed by a character of
  another class, or any visible character followed by white space);
* it must lie at least ``MARGIN`` characters away from the cut ends, so that no
  special token or contraction cut in two can reach it. Left of it the earlier
  chunk is right, from it on the later chunk is; they are spliced there;
* if an overlap holds no such place (one endless word), the overlap is widened
  and, when it reaches the chunk's start, the chunk itself grows.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np

CHUNK_CHARS = 1 << 16
OVERLAP_CHARS = 256
MARGIN = 16
# Fixed value: the pre-tokenisation pattern of byte-level BPE files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies: visible
    Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    visible = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Ids of a byte-level BPE file; special strings inside a text are special."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if (spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"]
                or spec.get("normalizer") is not None):
            raise ValueError(f"{path}: not a plain byte-level BPE file")
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]) or \
                any(len(s) >= MARGIN for s in special):
            raise ValueError(f"{path}: special tokens of this kind are not covered")
        alphabet = _byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items()
                 if token not in special}
        self._enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self._special = tuple(special)
        size = max([*ranks.values(), *special.values()]) + 1
        self._len = np.zeros(size, dtype=np.int64)
        for token, i in ranks.items():
            self._len[i] = len(token)
        for token, i in special.items():
            self._len[i] = len(token.encode())

    def plain(self, text: str) -> np.ndarray:
        if any(s in text for s in self._special):
            return np.asarray(self._enc.encode(text, allowed_special="all"), dtype=np.uint32)
        return np.asarray(self._enc.encode_ordinary(text), dtype=np.uint32)

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset after every token."""
        return np.cumsum(self._len[ids])

    def encode(self, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> np.ndarray:
        if len(text) <= chunk:
            return self.plain(text)
        return np.concatenate([ids for ids in self.pieces(text, chunk, overlap)])

    def count(self, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
        if len(text) <= chunk:
            return len(self.plain(text))
        return sum(len(ids) for ids in self.pieces(text, chunk, overlap))

    def pieces(self, text: str, chunk: int, overlap: int):
        """Ids of consecutive stretches of ``text`` that add up to all of it;
        two chunks are held at a time."""
        if overlap <= 2 * MARGIN or overlap >= chunk:
            raise ValueError("need 2 * MARGIN < overlap < chunk")
        n = len(text)
        a0, a1 = 0, min(n, chunk)
        ids = self.plain(text[a0:a1])
        ends, done = self.ends(ids), 0           # done: tokens of this chunk given out by earlier ones
        while a1 < n:
            width = overlap
            while True:
                b0 = a1 - width
                if b0 <= a0:                      # no boundary anywhere: the chunk grows
                    grown = min(n, a0 + 2 * (a1 - a0))
                    start = int(ends[done - 1]) if done else 0
                    a1 = grown
                    ids = self.plain(text[a0:a1])
                    ends = self.ends(ids)
                    done = int(np.searchsorted(ends, start, side="right")) if start else 0
                    if a1 >= n:
                        break
                    width = overlap
                    continue
                b1 = min(n, b0 + max(chunk, 2 * width))
                other = self.plain(text[b0:b1])
                other_ends = self.ends(other)
                cut = self._common(text, a0, a1, ends, b0, other_ends, done)
                if cut is not None:
                    break
                width *= 4
            if a1 >= n:
                break
            ka, kb = cut
            yield ids[done:ka]
            a0, a1, ids, ends, done = b0, b1, other, other_ends, kb
        yield ids[done:]

    def _common(self, text, a0, a1, ends, b0, other_ends, done) -> tuple[int, int] | None:
        """Token counts of both chunks before their last common stable boundary."""
        floor = int(ends[done - 1]) if done else 0
        lo, hi = b0 + MARGIN, a1 - MARGIN
        tail = len(text[a0:hi].encode())
        head = len(text[b0:hi].encode())
        p = hi
        while p > lo:
            if stable(text[p - 1], text[p]) and tail > floor:
                ka = int(np.searchsorted(ends, tail))
                kb = int(np.searchsorted(other_ends, head))
                if ka < len(ends) and ends[ka] == tail and kb < len(other_ends) and other_ends[kb] == head:
                    return ka + 1, kb + 1
            p -= 1
            width = len(text[p].encode())
            tail -= width
            head -= width
        return None


def stable(before: str, after: str) -> bool:
    """No alternative of the pattern matches both characters in this order, so
    every pre-tokenisation of any text that holds them splits here."""
    if before.isspace():
        return False
    if after in " \n\t\r":
        return True
    b, a = unicodedata.category(before)[0], unicodedata.category(after)[0]
    return b in "LN" and a != b and a != "C" and b != "C"


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file."""
    return Encoder(path)
