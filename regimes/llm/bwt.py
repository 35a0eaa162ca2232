"""Burrows-Wheeler transforms of string collections, merged by refining their interleave, with numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Transform:
    """A shard's transform: for each suffix in order the symbol before it, where that one's row is, and the suffix.

    ``symbol`` is 0 before a whole string (its end mark, and those of earlier strings come first); ``string`` and
    ``start`` say which suffix a row is.
    """

    symbol: np.ndarray
    back: np.ndarray
    string: np.ndarray
    start: np.ndarray


def transform(symbols: np.ndarray, lengths: np.ndarray) -> Transform:
    """Sort all suffixes of a shard's strings (given one after another, symbols from 1), by doubling."""
    m = len(lengths)
    n = len(symbols) + m
    ends = np.cumsum(lengths + 1) - 1
    text = np.zeros(n, np.int64)
    inside = np.ones(n, bool)
    inside[ends] = False
    text[inside] = symbols
    rank = text + m
    rank[ends] = np.arange(m)
    order, k = np.argsort(rank, kind="stable"), 1
    while True:
        r = rank[order]
        rank[order] = np.concatenate([[0], np.cumsum(r[1:] != r[:-1])])
        if rank.max() == n - 1:
            break
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1
        rank = rank * (n + 1) + after
        order = np.argsort(rank, kind="stable")
        k *= 2
    starts = np.concatenate([[0], ends[:-1] + 1])
    string = np.repeat(np.arange(m), lengths + 1)[order]
    first = order == starts[string]
    before = np.where(first, ends[string], order - 1)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return Transform(text[before].astype(np.uint16), place[before], string, order - starts[string])


def merge(shards: list[Transform], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge shards' transforms, without sorting suffixes again: ``(rows, prefix)``.

    Round h turns an interleave that is right for the first h symbols into one for h + 1: read in order, each row's
    preceding symbol sends the row before it to that symbol's bucket. Two neighbours have a common prefix of h + 1
    if they come from one symbol and from rows with a common prefix of h: so intervals of equal prefixes, and with
    them the common prefixes' lengths up to ``depth``, come along. ``rows`` are rows of all shards laid end to end,
    in merged order; ``prefix[i]`` is how many symbols row i has in common with row i - 1, at most ``depth``.
    """
    base = np.concatenate([[0], np.cumsum([len(s.symbol) for s in shards])])
    symbol = np.concatenate([s.symbol for s in shards])
    back = np.concatenate([s.back + b for s, b in zip(shards, base)])
    # End marks differ from each other and come by shard and string: their rows never move.
    marks = np.concatenate([np.sort(s.back[s.symbol == 0]) + b for s, b in zip(shards, base)])
    rows, group = np.arange(len(symbol)), np.zeros(len(symbol), np.int64)
    prefix = np.zeros(len(symbol), np.int64)
    for h in range(depth):
        sent = symbol[rows]
        kept = np.flatnonzero(sent)
        kept = kept[np.argsort(sent[kept], kind="stable")]
        source, by = group[kept], sent[kept]
        new = np.concatenate([[True], (source[1:] != source[:-1]) | (by[1:] != by[:-1])]) if len(kept) else np.zeros(0, bool)
        rows = np.concatenate([marks, back[rows[kept]]])
        parted = np.concatenate([np.ones(len(marks), bool), new])
        group = np.cumsum(parted)
        prefix[~parted] = h + 1
        prefix[parted] = np.minimum(prefix[parted], h)
        if parted.all():
            break
    return rows, prefix
