"""Benchmark decontamination: an FM-index for each training shard, searched for the benchmark's phrases."""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import blocks, groups
from .common import discard, written
from .fm_index import FMIndex

#: Bytes that belong to words (0-9, a-z and all of non-ASCII letters), A-Z lower-cased; the rest become spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Bytes of text that one index covers; if there are several blocks of phrases, all of which are read for each index.
SHARD_BYTES, SHARD_BYTES_OF_MANY = 1 << 20, 16 << 20
#: Bits of the filter of words, a power of two.
FILTER_BITS = 1 << 22
FOUND = "n_words long, spans array<struct<start: int, end: int>>, items array<string>"


def words(text: str | None) -> list[bytes]:
    """The words of a text, lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


@dataclass(frozen=True)
class Phrases:
    """A block of the benchmark: its words (numbered from 1), its distinct windows, and the items of each window."""

    words: list[bytes]
    windows: np.ndarray
    lengths: np.ndarray
    items: list[list[str]]


def phrases(rows: list[tuple[str | None, list[str]]], window: int) -> Phrases:
    """From texts and the ids of the items that have them."""
    numbers: dict[bytes, int] = {}
    ids = [np.array([numbers.setdefault(x, len(numbers) + 1) for x in words(t)], np.int32) for t, _ in rows]
    # All windows of all texts, filled up to the right with zeros.
    counts = np.array([max(1, len(w) - window + 1) if len(w) else 0 for w in ids], np.int64)
    flat = np.concatenate([np.zeros(0, np.int32), *(np.concatenate([w, np.zeros(window, np.int32)]) for w in ids)])
    first = np.cumsum([0, *(len(w) + window for w in ids)])[:-1]
    starts = np.repeat(first, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    table = flat[starts[:, None] + np.arange(window)] if len(starts) else np.zeros((0, window), np.int32)
    table, which = np.unique(table, axis=0, return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), counts)
    items: list[set[str]] = [set() for _ in range(len(table))]
    for k, row in np.unique(np.stack([which.ravel(), owner], axis=1), axis=0).tolist():
        items[k].update(rows[row][1])
    return Phrases(list(numbers), table, (table > 0).sum(axis=1), [sorted(x) for x in items])


@dataclass(frozen=True)
class WordFilter:
    """Bits set for the words of the whole benchmark: of fixed size, it lets all of them pass and few others."""

    bits: np.ndarray

    def passing(self, found: set[bytes]) -> list[bytes]:
        each = list(found)
        at = _bit(each)
        return [w for w, ok in zip(each, (self.bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).tolist()) if ok]


def _bit(each: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in each), np.uint64, len(each)).astype(np.int64) & (FILTER_BITS - 1)


def word_filter(texts: DataFrame) -> WordFilter:
    """The filter of the words of column ``t``: tasks hand on the filter's 64-bit pieces in which they set a bit, and these are united."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(FILTER_BITS // 64, np.uint64)
        for batch in batches:
            at = _bit(list({w for t in batch["t"] for w in words(t)}))
            np.bitwise_or.at(bits, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        used = np.flatnonzero(bits)
        yield pd.DataFrame({"i": used, "bits": bits[used].view(np.int64)})

    out = np.zeros(FILTER_BITS // 64, np.uint64)
    for r in texts.select("t").mapInPandas(pieces, "i long, bits long").groupBy("i").agg(F.bit_or("bits").alias("bits")).collect():
        out[r.i] = np.uint64(r.bits & (1 << 64) - 1)
    return WordFilter(out)


def _search(texts: list[str | None], known: Callable[[set[bytes]], list[bytes]], least: int, blocks_: Iterable[Phrases]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    """Word count, merged hit spans and items of each text of one shard, whose index is built once and searched for all blocks' phrases.

    A word that no phrase has can't lie in an occurrence, so it is a break, and runs between breaks that are
    shorter than the shortest phrase (``least``) are left out of the index.
    """
    split = [words(t) for t in texts]
    numbers = {w: i for i, w in enumerate(known({w for ws in split for w in ws}), 1)}
    get = numbers.get
    counts, parts = [len(ws) for ws in split], []
    for ws in split:
        parts += [get(w, 0) for w in ws]
        parts.append(0)
    del split
    all_ids = np.array(parts, np.int64)
    starts = np.concatenate([[0], np.cumsum(np.array(counts, np.int64) + 1)])
    out: list = [(n, [], set()) for n in counts]
    inside = np.concatenate([[False], all_ids > 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2)
    runs = edges[edges[:, 1] - edges[:, 0] >= max(least, 1)]
    if not len(runs):
        return out
    # The kept runs, each followed by a break.
    sizes = runs[:, 1] - runs[:, 0] + 1
    origin = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - runs[:, 0], sizes)
    index = FMIndex(all_ids[origin], len(numbers) + 1)
    cover = np.zeros(len(all_ids) + 1, np.int64)
    for p in blocks_:
        # The block's words by the shard's numbers: a word that the shard lacks is 0 and occurs nowhere.
        own = np.array([0, *(get(w, 0) for w in p.words)], np.int64)
        low, high = index.search(own[p.windows], p.lengths)
        n = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(n)), n)
        if not len(which):
            continue
        place = origin[index.locate(np.arange(len(which)) - np.repeat(np.cumsum(n) - n - low, n))]
        np.add.at(cover, place, 1)
        np.add.at(cover, place + p.lengths[which], -1)
        pairs = np.unique(np.stack([np.searchsorted(starts, place, side="right") - 1, which], axis=1), axis=0)
        for d, k in pairs.tolist():
            out[d][2].update(p.items[k])
    # Spans that overlap or touch within a document are merged, whatever the blocks that they come from.
    hit = np.concatenate([[False], np.cumsum(cover)[:-1] > 0, [False]])
    spans = np.flatnonzero(hit[1:] != hit[:-1]).reshape(-1, 2)
    for (a, b), d in zip(spans.tolist(), (np.searchsorted(starts, spans[:, 0], side="right") - 1).tolist()):
        out[d][1].append((a - int(starts[d]), b - int(starts[d])))
    return out


def _read_blocks(files: list[str]) -> Iterator[Phrases]:
    """Blocks of phrases from the shared folder, one at a time in memory."""
    for path in files:
        store, place = fs.FileSystem.from_uri(path)
        with store.open_input_file(place) as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=1, columns=["data"]):
                for data in batch.column(0):
                    yield pickle.loads(data.as_buffer())


def _written_blocks(items: DataFrame, n: int, window: int) -> DataFrame:
    """``data, least``: each block's phrases, worked out once, and its shortest phrase."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups(batches, "block"):
            p = phrases([(t, list(x)) for t, x in zip(g["t"], g["items"])], window)
            yield pd.DataFrame({"data": [pickle.dumps(p)], "least": [int(p.lengths.min(initial=1 << 30))]})

    dealt = items.withColumn("block", F.pmod(F.xxhash64("t"), F.lit(n))).repartition(min(n, 4096), "block").sortWithinPartitions("block")
    return written(dealt.select("block", "t", "items").mapInPandas(made, "data binary, least long"), "phrases")


def _finder(known: Callable[[set[bytes]], list[bytes]], least: int, blocks_: Callable[[], Iterable[Phrases]], shard_bytes: int, rest: bool):
    @F.pandas_udf(f"{FOUND}, rest string" if rest else FOUND)
    def find(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in series:
            texts = [t if isinstance(t, str) else None for t in s]
            rows: list = []
            for a, b in blocks(texts, shard_bytes, 1 << 20):
                rows += [(n, [{"start": x, "end": y} for x, y in spans], sorted(items)) for n, spans, items in _search(texts[a:b], known, least, blocks_())]
            out = pd.DataFrame(rows, columns=["n_words", "spans", "items"])
            yield out.assign(rest=pd.Series([_without(t, spans) if len(spans) else None for t, spans in zip(texts, out["spans"])], dtype=object)) if rest else out

    return find.asNondeterministic()  # else it runs once for a filter and once more for a column


def find(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item: str = "item_id", block_bytes: int = 4 << 20, rest: bool = False) -> DataFrame:
    """``docs`` with a column ``_found``: ``n_words``, the merged ``spans`` of hit words (numbers from 0, end
    exclusive) and the sorted ``items`` that occur.

    A phrase is a run of ``window`` words of a benchmark item, or a shorter item as a whole; a word of a document
    is hit if it lies in an occurrence of a phrase. With ``rest`` there is also the text that ``removed`` leaves (null
    where nothing is hit), made by the same worker: a second function of Python would need as many workers again.

    The benchmark is the query set: its distinct texts, each with
    its items' ids, are dealt into blocks of about ``block_bytes``. Documents are read once, whatever the size of the
    benchmark, and nothing is shuffled: a task builds each shard's index once and searches it for one block after
    another. A benchmark of one block goes to the tasks with the code; the phrases of several are written once, and
    tasks read them from the shared folder, one in memory at a time (it must be a folder that Arrow's file systems
    open); shards are larger then. Words of no phrase are told by a filter of fixed size.

    Null texts have no words. Items without words are no phrase. Items with null id mark words but aren't listed;
    equal ids count once. An empty benchmark hits nothing. A column named ``_found`` is replaced.
    """
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col("text").cast("string").alias("t")).where("t IS NOT NULL")
    items = items.groupBy("t").agg(F.collect_set("item").alias("items"))
    items = written(items.withColumn("size", F.octet_length("t") + F.size("items") * 8), "benchmark")
    size = items.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    n = max(1, -(-size // block_bytes))
    if n == 1:
        p = phrases([(r["t"], list(r["items"])) for r in items.select("t", "items").collect()], window)
        held = frozenset(p.words)
        finder = _finder(lambda found: list(found & held), int(p.lengths.min(initial=1 << 30)), lambda: [p], SHARD_BYTES, rest)
    else:
        kept = _written_blocks(items, n, window)
        files, least, passing = kept.inputFiles(), kept.agg(F.min("least")).first()[0], word_filter(items).passing
        finder = _finder(passing, least, lambda: _read_blocks(files), SHARD_BYTES_OF_MANY, rest)
    discard(items)
    return docs.drop("_found").withColumn("_found", finder(F.col(f"`{text}`").cast("string")))


def _without(t: str, spans: list[dict]) -> str:
    at = [(m.start(), m.end()) for m in _WORD.finditer(t)]
    kept, last = [], 0
    for s in spans:
        kept.append(t[last : at[s["start"]][0]])
        last = at[s["end"] - 1][1]
    return "\n".join([*kept, t[last:]])


def removed(text: Column, spans: Column) -> Column:
    """A text without the words of ``spans`` and what stands between them; a line break takes their place."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, all_spans: pd.Series) -> pd.Series:
        out = [_without(t, spans) if isinstance(t, str) and spans is not None and len(spans) else t for t, spans in zip(texts, all_spans)]
        return pd.Series(out, dtype=object)

    return cut(text, spans)
