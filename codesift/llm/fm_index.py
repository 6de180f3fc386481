"""A compressed FM-index over sequences of words, with vectorised backward search.

The Burrows-Wheeler transform of the joined sequences is stored as a wavelet matrix: one bit vector per bit of a symbol,
packed into 64-bit words with running counts, so that a rank is one look-up and one bit count. Suffixes are sorted by their
first ``DEPTH`` words, which is enough for backward search of patterns up to that length.
"""

from __future__ import annotations

import numpy as np

#: Words by which suffixes are sorted.
DEPTH = 64


class Bits:
    """A packed bit vector with rank."""

    def __init__(self, bits: np.ndarray) -> None:
        size = len(bits)
        packed = np.zeros(-(-(size + 1) // 64) * 8, dtype=np.uint8)
        filled = np.packbits(bits, bitorder="little")
        packed[: len(filled)] = filled
        self.words = packed.view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, place: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = place >> 6
        mask = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Ranks of symbols in a sequence of numbers below 2 ** levels."""

    def __init__(self, symbols: np.ndarray, levels: int) -> None:
        self.levels: list[tuple[int, Bits, int]] = []
        for level in reversed(range(levels)):
            bits = (symbols >> level) & 1
            zeros = int(len(bits) - bits.sum())
            self.levels.append((level, Bits(bits.astype(np.uint8)), zeros))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])

    def follow(self, symbols: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where the prefix up to each place ends in the block of its symbol on the lowest level."""
        for level, bits, zeros in self.levels:
            ones = bits.rank(place)
            place = np.where((symbols >> level) & 1, zeros + ones, place - ones)
        return place


class FMIndex:
    """Index of sequences of 64-bit words; ``owners`` names the owner (a long) of each sequence."""

    def __init__(self, sequences: list[np.ndarray], owners: np.ndarray) -> None:
        self.vocabulary = np.unique(np.concatenate(sequences))
        sizes = np.array([len(words) for words in sequences])
        self.first = np.cumsum(sizes + 1) - (sizes + 1)
        total = int((sizes + 1).sum())
        text = np.zeros(total, dtype=np.int64)  # 0 parts the sequences
        owner = np.repeat(owners, sizes + 1)
        for first, words in zip(self.first, sequences, strict=True):
            text[first : first + len(words)] = self.symbols(words)
        self.size = total
        ranks, size = text, 1
        while size < DEPTH:
            if 2 * size == DEPTH:
                self._half = ranks
            ranks = _pair_ranks(ranks, ranks, size)
            size *= 2
        self.order = np.argsort(ranks, kind="stable")
        self.owner = owner[self.order]
        before = text[self.order - 1]  # the word before the first one is the last separator
        levels = max(1, int(len(self.vocabulary)).bit_length())
        self.matrix = WaveletMatrix(before, levels)
        counts = np.bincount(text, minlength=len(self.vocabulary) + 1)
        self.smaller = np.cumsum(counts) - counts
        every = np.arange(len(counts))
        self.base = self.matrix.follow(every, np.zeros(len(counts), dtype=np.int64))

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """Symbols of words; a word that the index lacks is 0."""
        place = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[place] == words, place + 1, 0)

    def extend(self, low: np.ndarray, high: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: intervals of the patterns with a symbol put before each."""
        shift = self.smaller[symbols] - self.base[symbols]
        low, high = self.matrix.follow(symbols, low) + shift, self.matrix.follow(symbols, high) + shift
        return low, np.where(symbols == 0, low, high)

    def classes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """For every row of the index where the rows with the same first ``size`` words (half to all of ``DEPTH``) begin and end."""
        rank = _pair_ranks(self._half, self._half, size - DEPTH // 2)[self.order]
        fresh = np.concatenate([[True], rank[1:] != rank[:-1]])
        starts = np.flatnonzero(fresh)
        ends = np.append(starts[1:], len(rank))
        number = np.cumsum(fresh) - 1
        return starts[number], ends[number]


def _pair_ranks(left: np.ndarray, right: np.ndarray, shift: int) -> np.ndarray:
    """Dense ranks of the pairs (left[i], right[i + shift]); 0 stands past the end."""
    later = np.zeros_like(right)
    if shift < len(right):
        later[: len(right) - shift] = right[shift:]
    keys = left * (int(right.max(initial=0)) + 1) + later
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    ranks = np.empty(len(keys), dtype=np.int64)
    ranks[order] = np.cumsum(np.concatenate([[False], ordered[1:] != ordered[:-1]]))
    return ranks


def earliest_owners(index: FMIndex, sequences: list[np.ndarray], window: int) -> list[np.ndarray]:
    """For every window of ``window`` words of each sequence the smallest owner that has it, or the greatest long if none.

    Sequences are read backwards, all of them at once. The matching statistic of a position (the longest match that begins
    there, cut off at the window's length) is known from the interval that backward search keeps: it is extended
    by the word before, and shortened to the window's length by the rows that share so many words. Where nothing in the
    index continues, shorter matches are tried; that does not happen to sequences that are in the index themselves.
    """
    starts, ends = index.classes(window)
    none = np.iinfo(np.int64).max
    cuts = np.flatnonzero(np.concatenate([[True], starts[1:] != starts[:-1]]))
    least = np.minimum.reduceat(index.owner, cuts)
    class_of = np.cumsum(np.concatenate([[True], starts[1:] != starts[:-1]])) - 1
    sizes = np.array([len(words) for words in sequences])
    first = np.cumsum(sizes) - sizes
    flat = index.symbols(np.concatenate(sequences))
    windows = np.maximum(sizes - window + 1, 0)
    found = [np.full(n, none, dtype=np.int64) for n in windows]
    order = np.argsort(-windows, kind="stable")
    order = order[windows[order] > 0]
    if not len(order):
        return found
    at = first[order] + sizes[order]  # the next word to read is the one before
    low = np.zeros(len(order), dtype=np.int64)
    high = np.full(len(order), index.size, dtype=np.int64)
    length = np.zeros(len(order), dtype=np.int64)
    table = np.full((len(order), int(windows.max())), none, dtype=np.int64)
    while True:
        active = np.flatnonzero(at > first[order])
        if not len(active):
            break
        at[active] -= 1
        symbols = flat[at[active]]
        new_low, new_high = index.extend(low[active], high[active], symbols)
        alive = new_high > new_low
        grown = np.where(alive, length[active] + 1, 0)
        for k in np.flatnonzero(~alive):
            place = int(at[active[k]])
            new_low[k], new_high[k], grown[k] = _longest(index, flat[place : place + int(length[active[k]])])
        full = grown >= window
        if full.any():
            rows = new_low[full]
            new_low[full], new_high[full] = starts[rows], ends[rows]
            grown[full] = window
            table[active[full], at[active[full]] - first[order[active[full]]]] = least[class_of[rows]]
        low[active], high[active], length[active] = new_low, new_high, grown
    for row, number in enumerate(order):
        found[number] = table[row, : windows[number]].copy()
    return found


def _longest(index: FMIndex, symbols: np.ndarray) -> tuple[int, int, int]:
    """Interval and length of the longest prefix of ``symbols`` that the index has."""
    for size in range(len(symbols), 0, -1):
        low, high = np.zeros(1, dtype=np.int64), np.full(1, index.size, dtype=np.int64)
        for symbol in symbols[:size][::-1]:
            low, high = index.extend(low, high, np.array([symbol]))
            if high[0] <= low[0]:
                break
        else:
            return int(low[0]), int(high[0]), size
    return 0, index.size, 0
