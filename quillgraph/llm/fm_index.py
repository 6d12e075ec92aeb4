"""A compressed FM-index over sequences of names, searched many patterns at once.

The Burrows-Wheeler transform is kept in a wavelet matrix: ceil(log2(names)) bit
vectors of one bit a symbol, with a count every 64 bits.  Neither the text nor
the suffix order stays; running sums of the sequences' weights along the suffix
order tell what the suffixes in a range weigh together.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, largest: int):
        self.height = max(1, int(largest).bit_length())
        self.bits, self.before, self.zeros = [], [], []
        for level in range(self.height - 1, -1, -1):
            bit = (symbols >> level) & 1
            packed = np.zeros((len(bit) + 64) // 64 * 8, dtype=np.uint8)
            bytes_ = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed[: len(bytes_)] = bytes_
            words = packed.view(np.uint64)
            ones = np.bitwise_count(words).astype(np.int32)
            self.bits.append(words)
            self.before.append(np.append(np.int32(0), np.cumsum(ones, dtype=np.int32)))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        part = self.bits[level][word] & ((np.uint64(1) << rest) - np.uint64(1))
        return self.before[level][word] + np.bitwise_count(part)

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where a prefix of ``at`` symbols ends, among equal symbols in order."""
        for level in range(self.height):
            ones = self._ones(level, at)
            high = (symbol >> (self.height - 1 - level)) & 1
            at = np.where(high == 1, self.zeros[level] + ones, at - ones)
        return at


class FMIndex:
    """Of sequences of names from 1 on; each has a weight."""

    def __init__(self, sequences: list[np.ndarray], weights: np.ndarray):
        m = len(sequences)
        sizes = np.array([len(s) for s in sequences], dtype=np.int64)
        of = np.repeat(np.arange(m), sizes + 1)  # each is followed by an end of its own
        ends = np.cumsum(sizes + 1) - 1
        symbols = np.zeros(len(of), dtype=np.int64)
        inner = np.ones(len(of), dtype=bool)
        inner[ends] = False
        symbols[inner] = np.concatenate(sequences) if m else []
        key = symbols + (m - 1)
        key[ends] = np.arange(m)
        order = self._sorted(key, int(sizes.max(initial=0)) + 1)
        self.largest = int(symbols.max(initial=1))
        last = symbols[order - 1]
        self.matrix = WaveletMatrix(last, self.largest)
        counts = np.bincount(symbols, minlength=self.largest + 1)
        self.first = np.cumsum(counts) - counts
        names = np.arange(self.largest + 1)
        self.begin = self.matrix.descend(names, np.zeros(len(names), dtype=np.int64))
        self.mass = np.append(0, np.cumsum(np.asarray(weights, dtype=np.int64)[of[order]]))
        self.size = len(order)

    @staticmethod
    def _sorted(key: np.ndarray, longest: int) -> np.ndarray:
        """The order of all suffixes, by doubling; a suffix is told from others by
        its sequence's own end at the latest."""
        _, rank = np.unique(key, return_inverse=True)
        span = 1
        while span < longest and rank.max() + 1 < len(rank):
            after = np.zeros(len(rank), dtype=np.int64)
            after[:-span] = rank[span:] + 1
            _, rank = np.unique(rank.astype(np.int64) * (len(rank) + 1) + after, return_inverse=True)
            span *= 2
        return np.argsort(rank, kind="stable")

    def extend(self, name: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search for each pattern: ``name`` put in front."""
        both = self.matrix.descend(np.concatenate([name, name]), np.concatenate([low, high]))
        shift = self.first[name] - self.begin[name]
        return both[: len(name)] + shift, both[len(name) :] + shift

    def weight(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self.mass[high] - self.mass[low]

    def statistics(self, names: np.ndarray, ends: np.ndarray, limits: np.ndarray, least: int) -> np.ndarray:
        """Matching statistics by backward search: for every end, how many names
        before it (down to its limit) occur together with weight ``least`` or more."""
        out = np.zeros(len(ends), dtype=np.int64)
        live = np.arange(len(ends))
        low, high = np.zeros(len(ends), dtype=np.int64), np.full(len(ends), self.size, dtype=np.int64)
        at = ends.copy()
        while True:
            more = at > limits[live]
            live, at, low, high = live[more], at[more] - 1, low[more], high[more]
            if not len(live):
                return out
            low, high = self.extend(names[at], low, high)
            enough = self.weight(low, high) >= least
            live, at, low, high = live[enough], at[enough], low[enough], high[enough]
            out[live] += 1


def repeated_spans(index: FMIndex, sequences: list[np.ndarray], threshold: int, least: int = 2) -> list[list[tuple[int, int]]]:
    """For each sequence, the spans of ``threshold`` names or more that occur with
    weight ``least`` or more, as maximal (first, behind last)."""
    sizes = np.array([len(s) for s in sequences], dtype=np.int64)
    base = np.cumsum(sizes) - sizes
    names = np.concatenate(sequences) if len(sequences) else np.zeros(0, dtype=np.int64)
    spans: list[list[tuple[int, int]]] = [[] for _ in sequences]
    which, end = np.flatnonzero(sizes >= threshold), sizes[sizes >= threshold]
    while len(which):
        size = index.statistics(names, base[which] + end, base[which], least)
        begin = end - size
        for k in np.flatnonzero(size >= threshold):
            spans[which[k]].append((int(begin[k]), int(end[k])))
        # A longer span may end before this one, but not begin at or behind its begin.
        end = np.minimum(end - 1, begin - 1 + threshold)
        more = (begin > 0) & (end >= threshold)
        which, end = which[more], end[more]
    return spans
