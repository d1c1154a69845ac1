"""FM-index over a shard of word numbers: suffix array, wavelet-matrix ranks, sampled positions."""

from __future__ import annotations

import numpy as np

#: Every so many text positions one suffix position is kept.
SAMPLE = 8


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; only suffixes that are still tied are sorted again."""
    n = len(s)
    sa = np.argsort(s, kind="stable")
    starts = np.concatenate([[True], s[sa][1:] != s[sa][:-1]])
    rank = np.empty(n + 1, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    rank[n] = -1
    k = 1
    while True:
        tied = np.flatnonzero(~(starts & np.concatenate([starts[1:], [True]])))
        if not len(tied):
            return sa
        at = sa[tied]
        group, after = rank[at], rank[np.minimum(at + k, n)]
        order = np.lexsort((after, group))
        at, group, after = at[order], group[order], after[order]
        sa[tied] = at
        fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])])
        starts[tied] = fresh
        rank[at] = np.maximum.accumulate(np.where(fresh, tied, 0))
        k *= 2


class Bits:
    """Packed bits with rank of ones."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])

    def rank(self, i: np.ndarray) -> np.ndarray:
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


class Wavelet:
    """Rank of any symbol in a sequence over 0 ... sigma - 1, one bit level at a time."""

    def __init__(self, s: np.ndarray, sigma: int):
        self.levels, self.zeros = [], []
        self.depth = max(1, int(sigma - 1).bit_length())
        for level in range(self.depth - 1, -1, -1):
            bit = (s >> level & 1).astype(np.uint8)
            self.levels.append(Bits(bit))
            self.zeros.append(int(len(s) - bit.sum()))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c before position i."""
        start = np.zeros(len(c), np.int64)
        for level, bits, zeros in zip(range(self.depth - 1, -1, -1), self.levels, self.zeros):
            one = (c >> level & 1).astype(bool)
            ri, rs = bits.rank(i), bits.rank(start)
            i = np.where(one, zeros + ri, i - ri)
            start = np.where(one, zeros + rs, start - rs)
        return i - start


class FMIndex:
    """Backward search and location over symbols 1 ... sigma - 1; 0 is the end mark."""

    def __init__(self, s: np.ndarray, sigma: int):
        s = np.concatenate([s, [0]]).astype(np.int64)
        sa = suffix_array(s)
        self.bwt = s[sa - 1]
        self.below = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=sigma))])
        self.wavelet = Wavelet(self.bwt, sigma)
        kept = sa % SAMPLE == 0
        self.marks, self.kept, self.samples = Bits(kept.astype(np.uint8)), kept, sa[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of patterns, given right-aligned in a matrix, read from the last symbol."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.bwt), np.int64)
        width = patterns.shape[1]
        for step in range(width):
            at = np.flatnonzero((step < lengths) & (lo < hi))
            if not len(at):
                break
            c = patterns[at, width - 1 - step]
            ends = self.wavelet.rank(np.concatenate([c, c]), np.concatenate([lo[at], hi[at]]))
            lo[at], hi[at] = self.below[c] + ends[:len(at)], self.below[c] + ends[len(at):]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back to the next sampled row."""
        out, at, rows = np.zeros(len(rows), np.int64), np.arange(len(rows)), rows.copy()
        steps = 0
        while len(at):
            found = self.kept[rows]
            out[at[found]] = self.samples[self.marks.rank(rows[found])] + steps
            at, rows = at[~found], rows[~found]
            c = self.bwt[rows]
            rows = self.below[c] + self.wavelet.rank(c, rows)
            steps += 1
        return out
