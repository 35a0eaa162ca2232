"""Cutting Arrow batches of texts into blocks of bounded size, inside tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np


def blocks(texts: Sequence, most: int = 1 << 20, rows: int = 256) -> Iterator[tuple[int, int]]:
    """Ranges ``(start, end)`` of about ``most`` characters or bytes and ``rows`` rows at most; longer texts stand alone."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if i > start and (size + n > most or i - start >= rows):
            yield start, i
            start, size = i, 0
        size += n
    if len(texts) > start:
        yield start, len(texts)


def joined(parts: Sequence[bytes], gap: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all parts, each followed by ``gap`` zero bytes, and where each part starts (and where all end)."""
    sep = b"\0" * gap
    lengths = np.fromiter((len(p) + gap for p in parts), np.int64, len(parts))
    return np.frombuffer(sep.join([*parts, b""]), np.uint8), np.concatenate([[0], np.cumsum(lengths)])


def groups(batches: Iterator, key: str) -> Iterator:
    """Runs of rows with equal ``key`` from frames whose rows are sorted by it; a run may go on in the next frame."""
    import pandas as pd

    held: list = []
    for frame in batches:
        if not len(frame):
            continue
        k = frame[key].to_numpy()
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        if held and held[-1][key].iloc[-1] != k[0]:
            yield pd.concat(held) if len(held) > 1 else held[0]
            held = []
        for a, b in zip([0, *cuts], [*cuts, len(frame)]):
            if b < len(frame):
                part = frame.iloc[a:b]
                yield pd.concat([*held, part]) if held else part
                held = []
            else:
                held.append(frame.iloc[a:b])
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]
