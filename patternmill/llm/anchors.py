"""Content-defined anchors: every string of a given length holds one, and equal strings hold it at the same offset.

The hashes of all k-grams of a text go through a sliding minimum; the first smallest k-gram of each window that starts
a string of the given length is an anchor. Whether two strings of that length are equal can then be decided among the
places with the same anchor k-gram. The rolling hash of k-grams only chooses anchors and groups their places: k-grams
that collide are told apart later. What decides that bytes are equal is XXH3 over the bytes themselves.
"""

from __future__ import annotations

import numpy as np

from patternmill.llm.near_dup import mixed

GRAM = 64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTERS = mixed(np.arange(256, dtype=np.uint64), 77) | np.uint64(1)
_POWERS: list[np.ndarray] = []
#: Bytes that are hashed at once; longer texts go in overlapping parts. No part has more than MOST_PART bytes.
PART, MOST_PART = 8 << 20, 1 << 24
_PLACE = np.uint64(MOST_PART - 1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 5 << 19)
        _POWERS[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)])) for b in (_BASE, _INVERSE)]
    return _POWERS[0][:n], _POWERS[1][:n]


class Hashed:
    """Sums by which any substring of the joined bytes has a hash in constant time; it must not stand for the bytes."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        power, self.inverse = _powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_LETTERS[data] * power[:n], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.inverse[begin], seed)


def byte_hashes(raw: bytes, begin: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """The XXH3 hash of each substring."""
    from xxhash import xxh3_64_intdigest as digest

    return np.fromiter((digest(raw[a:b], seed) for a, b in zip(begin.tolist(), end.tolist(), strict=True)), np.uint64, len(begin))


def anchors(texts: list[bytes], length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, place, first byte and end of the context, anchor hash, context hash) of all anchors.

    The context is what strings of `length` bytes around the anchor can cover, cut at the ends of the text; its hash
    tells the bytes and how they lie about the anchor.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    raw = b"".join(texts)
    data = np.frombuffer(raw, np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < length or (sizes < length).all():
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    ends = np.cumsum(sizes)
    hashed = Hashed(data)
    at = np.arange(len(data) - gram + 1)
    keys = hashed.of(at, at + gram, 5)
    order = (keys & ~_PLACE) | at.astype(np.uint64)
    wide = length - gram + 1
    padded = np.full(-(-(len(order) + wide) // wide) * wide, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(order)] = order
    blocks = padded.reshape(-1, wide)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    # A window is of interest if the string that starts with it lies in one text.
    owner = np.repeat(np.arange(len(texts)), sizes)
    starts = np.flatnonzero(np.arange(len(data)) + length <= ends[owner])
    least = np.minimum(behind[starts], ahead[starts + wide - 1]) & _PLACE
    chosen = np.zeros(len(data), bool)
    chosen[least.astype(np.int64)] = True
    place = np.flatnonzero(chosen)
    text = owner[place]
    begin = ends[text] - sizes[text]
    low, high = np.maximum(begin, place - (length - gram)), np.minimum(ends[text], place + length)
    context = mixed(byte_hashes(raw, low, high) ^ ((place - low).astype(np.uint64) << np.uint64(32)) ^ (high - place).astype(np.uint64), 8)
    return text, place - begin, low - begin, high - begin, keys[place], context
