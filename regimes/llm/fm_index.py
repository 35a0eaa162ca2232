"""A full-text index in minute space over a sequence of whole numbers, for one shard, with numpy."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The starts of all suffixes in order, by doubling the compared length until every suffix stands alone."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    order, k = np.argsort(rank, kind="stable"), 1
    while n and rank.max() < n:
        after = np.zeros(n, np.int64)
        after[: max(0, n - k)] = rank[k:]
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]) + 1
        k *= 2
    return order


class WaveletMatrix:
    """Ranks of any symbol in any prefix of a sequence, from one bit plane for each bit of a symbol."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        v = values
        for b in reversed(range(self.bits)):
            bit = (v >> b & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(v) - self.ones[-1][-1]))
            v = np.concatenate([v[~bit], v[bit]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        start, end = np.zeros_like(upto), upto
        for plane, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            one = (symbol >> (self.bits - 1 - plane) & 1).astype(bool)
            start = np.where(one, zeros + ones[start], start - ones[start])
            end = np.where(one, zeros + ones[end], end - ones[end])
        return end - start


class FMIndex:
    """Backward search by wavelet ranks, and occurrences by suffix positions kept for every ``every``-th place."""

    def __init__(self, text: np.ndarray, symbols: int, every: int = 8):
        """``text``: symbols from 1 up to ``symbols - 1``, and 0 for breaks."""
        t = np.concatenate([text + 1, [0]]).astype(np.int64)  # the end is a symbol of its own, below all others
        symbols += 1
        sa = suffix_array(t)
        self.bwt = t[sa - 1]
        self.ranks = WaveletMatrix(self.bwt, symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=symbols))])
        kept = sa % every == 0
        self.kept_before = np.concatenate([[0], np.cumsum(kept)])
        self.kept, self.places = kept, sa[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix ranges ``[low, high)`` of phrases, rows of ``phrases`` filled to the right; a symbol below 1 occurs nowhere."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.bwt), np.int64)
        for step in range(int(lengths.max(initial=0))):
            rows = np.flatnonzero((lengths > step) & (low < high))
            if not len(rows):
                break
            c = phrases[rows, lengths[rows] - 1 - step]
            dead = c < 1
            c = np.where(dead, 0, c + 1)
            low[rows] = np.where(dead, 0, self.first[c] + self.ranks.rank(c, low[rows]))
            high[rows] = np.where(dead, 0, self.first[c] + self.ranks.rank(c, high[rows]))
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where in the text the suffixes of these rows start: each walks back to the nearest kept place."""
        out, at, steps = np.zeros(len(rows), np.int64), rows.copy(), np.zeros(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            here = at[left]
            found = self.kept[here]
            done = left[found]
            out[done] = self.places[self.kept_before[at[done]]] + steps[done]
            left = left[~found]
            c = self.bwt[at[left]]
            at[left] = self.first[c] + self.ranks.rank(c, at[left])
            steps[left] += 1
        return out
