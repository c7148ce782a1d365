"""Texts as numpy arrays: words, their hashes, windows of them."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: The bytes 09 to 0D and 20 part words.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= MIX
    x ^= x >> np.uint64(29)
    x *= ODD
    return x ^ (x >> np.uint64(32))


class Words(NamedTuple):
    """Words of several texts. A word is bytes start:end of data; text t has the words first[t]:first[t + 1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self, key: int = 0) -> np.ndarray:
        """64-bit hashes of the words; equal words have equal hashes in any process that uses the same key."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        size = self.end - self.start
        begin = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(begin, size)
        # Mixed with the key: a plain polynomial modulo 2^64 is the same for two words of the Thue-Morse sequence, whatever the base.
        power = mixed(np.cumprod(np.full(int(size.max()), ODD, np.uint64)) ^ np.uint64(key))
        at = place + np.repeat(self.start, size)
        values = (self.data[at].astype(np.uint64) + np.uint64(1)) * power[place]
        return mixed(np.add.reduceat(values, begin) + size.astype(np.uint64))


def words_of(texts: list[bytes]) -> Words:
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    space = SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    size = np.array([len(t) + 1 for t in texts], np.int64)
    return Words(data, start, end, np.searchsorted(start, np.concatenate([[0], np.cumsum(size)]) + 1))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every `width` hashes in a row; the caller leaves out those that cross texts."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out *= MIX
        out += hashes[i : i + n]
        out ^= out >> np.uint64(31)
    return mixed(out)
