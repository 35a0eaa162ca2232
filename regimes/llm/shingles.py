"""Word shingles as 64-bit hashes, and their MinHash signatures, for blocks of texts with numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .batches import joined

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.default_rng(1)
_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd, and so with an inverse


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the step and of its inverse."""
    out = []
    for base in (int(_STEP), pow(int(_STEP), -1, 1 << 64)):
        p = np.empty(n, np.uint64)
        p[0], k = 1, 1
        while k < n:
            m = min(k, n - k)
            p[k : k + m] = p[:m] * np.uint64(pow(base, k, 1 << 64))
            k += m
        out.append(p)
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that lets each bit depend on all lower and higher ones."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of all parts, and how many words each part has."""
    data, starts = joined(parts, 1)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(parts), np.int64)
    data = data.copy()
    data[starts[1:] - 1] = 32  # a space ends each part
    word = np.concatenate([[False], ~_SPACE[data]])
    edges = np.flatnonzero(word[1:] != word[:-1]).reshape(-1, 2)
    up, down = _powers(1 << max(20, int(len(data)).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)])
    h = mix((sums[edges[:, 1]] - sums[edges[:, 0]]) * down[edges[:, 0]] + (edges[:, 1] - edges[:, 0]).astype(np.uint64))
    return h, np.diff(np.searchsorted(edges[:, 0], starts))


def shingle_sets(texts: list[str | None], k: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingles of each text: runs of ``k`` words (A-Z lower-cased, split at white space), or the
    whole sequence of fewer words. Null texts and texts without words have none."""
    h, n = word_hashes([(t or "").encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts])
    out, at = [], 0
    runs = np.zeros(len(h), np.uint64)
    for j in range(min(k, len(h))):
        runs[: len(h) - j] += mix(h[j:] + np.uint64(j + 1)) * np.uint64(pow(int(_STEP), j, 1 << 64))
    runs = mix(runs)
    for m in n.tolist():
        if m >= k:
            out.append(np.unique(runs[at : at + m - k + 1]))
        elif m:
            few = sum(int(mix(h[at + j : at + j + 1] + np.uint64(j + 1))[0]) * pow(int(_STEP), j, 1 << 64) for j in range(m))
            out.append(mix(np.array([(few + m) & ((1 << 64) - 1)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += m
    return out


def signatures(sets: list[np.ndarray], hashes: int, seed: int = 17) -> np.ndarray:
    """For each set the minima under ``hashes`` universal hash functions ``(a * x + b) >> 32``, 16 bits kept of each.

    Empty sets have zeros.
    """
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 1 << 64, (2, hashes), dtype=np.uint64)
    a |= np.uint64(1)
    out = np.zeros((len(sets), hashes), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        x = np.concatenate([sets[i] for i in full])
        at = np.cumsum([0, *(len(sets[i]) for i in full)])[:-1]
        for j in range(hashes):
            least = np.minimum.reduceat(((a[j] * x + b[j]) >> np.uint64(32)).astype(np.uint32), at)
            out[full, j] = (mix(least.astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)
    return out
