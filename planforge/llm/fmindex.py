"""A compressed FM-index over integer sequences: Burrows-Wheeler transform in a wavelet matrix, sampled suffix places.

The bits of each level are packed, with a count of the ones before every 64. Of the suffix array only the places stay that
are multiples of SAMPLED or follow a separator; others are found by walking to one. All queries of a batch take each step together.
"""

from __future__ import annotations

import numpy as np

SAMPLED = 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The order of all suffixes, by doubling of the ranked prefix. Each separator 0 is a symbol of its own, smaller than all others, so no two suffixes tie."""
    apart = text == 0
    rank = np.where(apart, np.cumsum(apart) - 1, text + int(apart.sum())).astype(np.int64)
    done = 1
    while True:
        after = np.full(len(rank), -1, np.int64)
        after[: max(0, len(rank) - done)] = rank[done:]
        rank = np.unique(rank * (len(rank) + int(rank.max()) + 2) + after + 1, return_inverse=True)[1].astype(np.int64)
        done *= 2
        if int(rank.max()) + 1 == len(rank):
            order = np.empty(len(rank), np.int64)
            order[rank] = np.arange(len(rank))
            return order


class Bits:
    """A bit vector with rank: the ones before each of many places."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.int32)
        self.zeros = len(bits) - int(bits.sum())

    def rank1(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class FMIndex:
    """Counts and finds patterns in a text of symbols from 1 on; its last symbol is a separator 0. `depth`, the length of the longest, isn't needed any more."""

    def __init__(self, text: np.ndarray, depth: int | None = None):
        # The order is whole: were suffixes to tie, a step to the front could swap two of them of which one alone
        # is at a place that was kept, and one occurrence would be found twice, the other never.
        order = suffix_array(text)
        self.size = len(order)
        bwt = text[order - 1]  # the text is a cycle
        marked = (order % SAMPLED == 0) | (bwt == 0)
        self.marks, self.places = Bits(marked.astype(np.uint8)), order[marked].astype(np.int32)
        top = int(text.max()) if len(text) else 0
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.levels = []
        self.bits = max(1, top.bit_length())
        for k in range(self.bits - 1, -1, -1):
            bit = (bwt >> k) & 1
            self.levels.append(Bits(bit.astype(np.uint8)))
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])
        # Where each symbol's block begins in the last level.
        self.begin = self._down(np.arange(top + 1), np.zeros(top + 1, np.int64))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            ones = level.rank1(at)
            at = np.where((symbols >> k) & 1, level.zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place in the transform."""
        return self._down(symbols, at) - self.begin[symbols]

    def extend(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the intervals of the patterns with one more symbol in front."""
        both = self.rank(np.concatenate([symbols, symbols]), np.concatenate([lo, hi])) + np.tile(self.smaller[symbols], 2)
        return both[: len(lo)], both[len(lo) :]

    def before(self, rows: np.ndarray) -> np.ndarray:
        """The rows of the suffixes that are one symbol longer."""
        symbols, at = np.zeros(len(rows), np.int64), rows
        for level in self.levels:
            one = level.get(at)
            ones = level.rank1(at)
            symbols = (symbols << 1) | one
            at = np.where(one, level.zeros + ones, at - ones)
        return at - self.begin[symbols] + self.smaller[symbols]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place in the text of each row: steps to the front until a place that was kept."""
        out = np.empty(len(rows), np.int64)
        left, at = np.arange(len(rows)), rows
        for steps in range(SAMPLED):  # never across a separator
            here = self.marks.get(at)
            out[left[here]] = self.places[self.marks.rank1(at[here])] + steps
            left, at = left[~here], self.before(at[~here])
            if not len(left):
                break
        return out

    def statistics(self, text: np.ndarray, ends: np.ndarray, limits: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of a streamed text, and the intervals of the matches that reach `threshold`.

        From each end (exclusive) the match is extended to the left, at most `limits` symbols, as long as it has at
        least two occurrences, one being the place itself if the text is indexed. Returns the lengths of all matches,
        and the interval of the last `threshold` symbols of each (empty if the match is shorter).
        """
        length = np.zeros(len(ends), np.int64)
        at = np.zeros((2, len(ends)), np.int64)
        live = np.arange(len(ends))
        lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), self.size, np.int64)
        k = 0
        while len(live):
            k += 1
            keep = limits[live] >= k
            live, lo, hi = live[keep], lo[keep], hi[keep]
            lo, hi = self.extend(text[ends[live] - k], lo, hi)
            keep = hi - lo > 1
            live, lo, hi = live[keep], lo[keep], hi[keep]
            length[live] = k
            if k == threshold:
                at[0, live], at[1, live] = lo, hi
        return length, at[0], at[1]
