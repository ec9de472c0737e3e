"""A compressed full-text index over words: suffix array, BWT and a wavelet matrix of packed bits.

Numpy does one step of the backward search for all streamed passages at once.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


class _Bits:
    """A bit vector of 64-bit words with a rank directory."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[:len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])
        self.ones = int(bits.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        at = i >> 6
        below = self.words[at] & ((_ONE << (i & 63).astype(np.uint64)) - _ONE)
        return self.before[at] + np.bitwise_count(below)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, sigma: int):
        self.depth = max(1, int(sigma - 1).bit_length())
        self.levels: list[_Bits] = []
        self.zeros: list[int] = []
        for shift in range(self.depth - 1, -1, -1):
            bit = ((symbols >> shift) & 1).astype(bool)
            self.levels.append(_Bits(bit))
            self.zeros.append(len(bit) - int(bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        self.first = self._descend(np.arange(sigma), np.zeros(sigma, np.int64))

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in zip(range(self.depth - 1, -1, -1), self.levels, self.zeros):
            ones = bits.rank(i)
            i = np.where((symbol >> shift) & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        return self._descend(symbol, i) - self.first[symbol]


class FMIndex:
    """Passages (lists of word codes 1..sigma - 1, concatenated) with an owner each.

    ``size[p]`` words belong to passage p.  Every passage ends in a terminator of its own, so
    that no match crosses passages and all suffixes differ.
    """

    def __init__(self, codes: np.ndarray, size: np.ndarray, owner: np.ndarray, threshold: int):
        passages, n = len(size), len(codes) + len(size)
        self.size, self.threshold = size, threshold
        self.end = np.cumsum(size + 1) - 1  # place of each terminator
        text = np.zeros(n, np.int64)
        word = np.ones(n, bool)
        word[self.end] = False
        text[word] = codes
        self.text = text
        sigma = int(codes.max()) + 1 if len(codes) else 1
        rank = text + passages - 1
        rank[self.end] = np.arange(passages)
        # prefix doubling up to the longest passage: terminators differ, so the ranks then do, too
        order, step = np.argsort(rank, kind="stable"), 1
        longest = int(size.max()) + 1 if passages else 1
        rank = _ranks(rank, order)
        while step < longest and int(rank[order[-1]]) < n - 1:
            nxt = np.zeros(n, np.int64)
            nxt[:-step] = rank[step:] + 1
            key = rank * (n + 1) + nxt
            order = np.argsort(key, kind="stable")
            rank = _ranks(key, order)
            step *= 2
        bwt = text[order - 1]  # before the first word comes the last terminator: symbol 0
        self.matrix = WaveletMatrix(bwt, sigma)
        self.start = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        # rows of the sorted suffixes that agree in their first ``threshold`` words are one block;
        # an interval whose match is cut to so many words ends where its block does
        passage = np.repeat(np.arange(passages), size + 1)
        same = self._agree(order, text, passage, threshold)
        self.block = np.cumsum(~same) - 1
        self.edge = np.append(np.flatnonzero(~same), n)
        self.owner = np.append(owner[passage[order]], 0)  # one row more, as an end for the last interval

    def _agree(self, order: np.ndarray, text: np.ndarray, passage: np.ndarray, threshold: int) -> np.ndarray:
        """Whether each suffix shares its first ``threshold`` words with the one before it."""
        left = self.end[passage[order]] - order
        at = np.flatnonzero((left[1:] >= threshold) & (left[:-1] >= threshold)) + 1
        for j in range(threshold):
            at = at[text[order[at] + j] == text[order[at - 1] + j]]
        same = np.zeros(len(order), bool)
        same[at] = True
        return same

    def matches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of all passages, streamed from their last word to the first.

        Returns passage, window and low, the first of the rows that start with the window, for
        every window of ``threshold`` words, and high by low, where that interval ends: the backward search keeps the interval
        and length of the match, and drops the match's last words above ``threshold``.  The
        passages are the indexed ones, so that a match never ends.
        """
        live = np.flatnonzero(self.size > 0)
        low, high = np.zeros(len(live), np.int64), np.full(len(live), len(self.text), np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        past = np.zeros(len(self.text), np.int64)
        read = length = 0
        while len(live):
            read, length = read + 1, length + 1
            symbol = self.text[self.end[live] - read]
            both = self.matrix.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
            low, high = self.start[symbol] + both[:len(live)], self.start[symbol] + both[len(live):]
            if length > self.threshold:
                block, length = self.block[low], self.threshold
                low, high = self.edge[block], self.edge[block + 1]
            if length == self.threshold:
                found.append((live, self.size[live] - read, low))
                past[low] = high
            more = self.size[live] > read
            live, low, high = live[more], low[more], high[more]
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none, past
        return *(np.concatenate(x) for x in zip(*found)), past

    def search(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Passage, window and least owner of the window's interval, for every window of ``threshold`` words."""
        passage, window, low, past = self.matches()
        # intervals of so many words are equal or apart
        first = np.flatnonzero(past)
        if len(first):
            past[first] = np.minimum.reduceat(self.owner, np.stack([first, past[first]], axis=1).ravel())[::2]
        return passage, window, past[low]


def _ranks(key: np.ndarray, order: np.ndarray) -> np.ndarray:
    ordered = key[order]
    new = np.ones(len(order), np.int64)
    new[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank
