"""Fill-in-the-middle: texts cut at seeded units into prefix, middle and suffix, and put in another order."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: What stands before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of a text in one block of the tree.
BLOCK = 2048
RESULT = "n long, form string, prefix_chars long, middle_chars long, output string"
_SPACES = np.frombuffer(b" \t\n\x0b\f\r", np.uint8)


def _line_ends(b: np.ndarray) -> np.ndarray:
    return b[:-1] == 10


def _word_ends(b: np.ndarray) -> np.ndarray:
    space = np.isin(b, _SPACES)
    return space[:-1] & ~space[1:]


def _char_ends(b: np.ndarray) -> np.ndarray:
    return _starts(b[1:])


def _starts(b: np.ndarray) -> np.ndarray:
    """Where a code point starts."""
    return (b & 0xC0) != 0x80


#: Units: lines with their line feed, words with the white space after them, code points. Each function takes the bytes
#: of a text or block and the byte after them, and tells after which bytes a unit ends.
UNITS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"line": _line_ends, "word": _word_ends, "char": _char_ends}


class BlockTree:
    """A text's bytes in fixed blocks under a Fenwick tree that has the units and the code points of each block.

    ``n`` is the number of units; the end of a text ends its last unit. A cut costs a descent of as many steps as the
    number of blocks has binary digits, and a look into one block.
    """

    def __init__(self, data: bytes, unit: str = "line", block: int = BLOCK):
        self.bytes, self.unit, self.block = np.frombuffer(data, np.uint8), UNITS[unit], block
        size = len(self.bytes)
        starts = np.arange(0, size, block)
        counts = np.zeros((len(starts) + 1, 2), np.int64)
        if size:
            ends = self._ends(0, size)
            counts[1:, 0] = np.add.reduceat(ends, starts, dtype=np.int64)
            counts[1:, 1] = np.add.reduceat(_starts(self.bytes), starts, dtype=np.int64)
        self.n, self.chars = (int(x) for x in counts.sum(axis=0))
        # Node i holds the sums of as many blocks up to the i-th as the lowest set bit of i says.
        step = 1
        while 2 * step < len(counts):
            counts[2 * step :: 2 * step] += counts[step : len(counts) - step : 2 * step]
            step *= 2
        self.tree = counts

    def _ends(self, start: int, end: int) -> np.ndarray:
        # After the last byte a letter is as good as any: the end of the text ends a unit whatever the unit is.
        last = self.bytes[end : end + 1] if end < len(self.bytes) else np.frombuffer(b"x", np.uint8)
        ends = self.unit(np.concatenate([self.bytes[start:end], last]))
        if end == len(self.bytes):
            ends[-1] = True
        return ends

    def cut(self, k: int) -> tuple[int, int]:
        """Bytes and code points of the first ``k`` units."""
        if k <= 0:
            return 0, 0
        at = chars = 0
        step = 1 << (len(self.tree) - 1).bit_length()
        while step := step >> 1:
            if at + step < len(self.tree) and self.tree[at + step, 0] < k:
                at += step
                k -= int(self.tree[at, 0])
                chars += int(self.tree[at, 1])
        start = at * self.block
        end = min(start + self.block, len(self.bytes))
        place = start + int(np.flatnonzero(self._ends(start, end))[k - 1]) + 1
        return place, chars + int(np.count_nonzero(_starts(self.bytes[start:place])))


def _one(text: str | None, h1: int, h2: int, h3: int, h4: int, unit: str, rate: int, spm: int, block: int) -> tuple:
    text = text or ""
    data = text.encode()
    tree = BlockTree(data, unit, block)
    if not text or h3 % 100 >= rate or any(x in text for x in (PREFIX, SUFFIX, MIDDLE)):
        return tree.n, "plain", None, None, text
    first, second = sorted((h1 % (tree.n + 1), h2 % (tree.n + 1)))
    (a, chars), (b, more) = tree.cut(first), tree.cut(second)
    prefix, middle, suffix = data[:a].decode(), data[a:b].decode(), data[b:].decode()
    form = "spm" if h4 % 100 < spm else "psm"
    ahead = [SUFFIX, suffix, PREFIX, prefix] if form == "spm" else [PREFIX, prefix, SUFFIX, suffix]
    return tree.n, form, chars, more - chars, "".join([*ahead, MIDDLE, middle])


def transformed(df: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "line", rate: int = 100, spm: int = 50, seed: int = 7, block: int = BLOCK, out: str = "_fim") -> DataFrame:
    """Add ``out``, a struct of ``n`` (units), ``form`` (psm, spm or plain), ``prefix_chars``, ``middle_chars`` and ``output``.

    ``unit`` is line, word or char. ``rate`` of 100 texts are cut, ``spm`` of 100 of those have the suffix first. The
    cuts and the form depend on ``seed`` and the key only (four hashes of both), so that any partitioning and any
    second try of a task give the same. Null texts are empty; empty texts and those that hold one of the marks stay as
    they are (plain, without numbers of characters). Rows with a null key share the hash of an empty key; repeated
    rows are cut alike. Rows are worked on one by one, so no key or source is hot; other columns stay.
    """
    small_batches(df.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))).cast("binary"), 256)
    numbers = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]

    @F.pandas_udf(RESULT)
    def cut(texts: pd.Series, h1: pd.Series, h2: pd.Series, h3: pd.Series, h4: pd.Series) -> pd.DataFrame:
        rows = [_one(*x, unit, rate, spm, block) for x in zip(texts, *(h.tolist() for h in (h1, h2, h3, h4)))]
        frame = pd.DataFrame(rows, columns=[x.split()[0] for x in RESULT.split(", ")])
        return frame.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return df.withColumn(out, cut(F.col(f"`{text}`"), *numbers))


def restored(output: Column, form: Column) -> Column:
    """The text that ``transformed`` had, from its output and form alone."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    order = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    out = F.when(form == "plain", output)
    for name, places in order.items():
        out = out.when(form == name, F.concat(*[F.get(parts, F.lit(i)) for i in places]))
    return out
