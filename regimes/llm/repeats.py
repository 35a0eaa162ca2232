"""Removal of repeated substrings: anchors find where texts repeat, merged Burrows-Wheeler transforms find how far."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import blocks, groups, joined
from .bwt import merge, transform
from .common import discard, partitions, utf8, written
from .shingles import mix

#: Bytes of the grams of which the smallest hash in a window is the window's anchor.
GRAM = 32
#: Windows of one anchor whose places differ by less than this share a core, and are compared together.
BLOCK = 32
#: Strings in a shard whose transform is built by sorting; symbols in one merge, about.
SHARD, MERGE = 1024, 1 << 20
#: A core that more rows share is not gathered in one task: its windows are counted by hash.
HOT = 4096

_RNG = np.random.default_rng(29)
_VALUES = _RNG.integers(0, 1 << 64, (2, 256), dtype=np.uint64)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, list] = {}


def _powers(n: int) -> list:
    size = 1 << max(20, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        out = []
        for base in _BASES:
            for b in (base, pow(base, -1, 1 << 64)):
                p = np.empty(size, np.uint64)
                p[0], k = 1, 1
                while k < size:
                    p[k : 2 * k] = p[:k] * np.uint64(pow(b, k, 1 << 64))
                    k *= 2
                out.append(p)
        _POWERS[size] = out
    return _POWERS[size]


class _Hashes:
    """Hashes of any substrings of some bytes, from running sums: equal substrings have equal hashes."""

    def __init__(self, data: np.ndarray, both: bool = True):
        p = _powers(len(data))
        self.down = [p[1], p[3]]
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[i][data] * p[2 * i][: len(data)], dtype=np.uint64)]) for i in range(1 + both)]

    def of(self, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        return mix((self.sums[which][end] - self.sums[which][start]) * self.down[which][start] + (end - start).astype(np.uint64))


def _anchors(parts: list[bytes], length: int) -> pd.DataFrame:
    """The anchors of all windows of ``length`` bytes of each part.

    A window's anchor is its gram with the smallest hash (of equals the first), which depends on nothing outside
    the window. ``part, at`` say where it is; the windows it anchors start ``near`` to ``far`` bytes before it;
    ``gram`` is its hash, and ``context`` that of all bytes of these windows.
    """
    data, starts = joined(parts)
    width = length - GRAM + 1
    n = len(data)
    hashes = _Hashes(data)
    place = np.arange(n - GRAM + 1)
    gram = hashes.of(place, place + GRAM)
    bits = int(n).bit_length()
    key = (gram >> np.uint64(bits) << np.uint64(bits)) | place.astype(np.uint64)
    # Minima of all runs of ``width``: from the running minima of blocks, forwards and backwards.
    whole = np.full(-(-len(key) // width) * width, ~np.uint64(0))
    whole[: len(key)] = key
    whole = whole.reshape(-1, width)
    ahead = np.minimum.accumulate(whole, axis=1).ravel()
    behind = np.minimum.accumulate(whole[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - length + 1
    least = (np.minimum(behind[:count], ahead[width - 1 : width - 1 + count]) & np.uint64((1 << bits) - 1)).astype(np.int64)
    # Windows within one part only.
    sizes = np.diff(starts)
    inside = np.zeros(n + 1, np.int64)
    np.add.at(inside, starts[:-1], 1)
    np.add.at(inside, starts[:-1] + sizes - length + 1, -1)
    window = np.flatnonzero(np.cumsum(inside)[:count] > 0)
    part = np.repeat(np.arange(len(parts)), sizes - length + 1)
    at = least[window]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (part[1:] != part[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(window)]]) - 1
    a, s1, s2, p = at[first], window[first], window[last], part[first]
    return pd.DataFrame({"part": p, "at": a - starts[p], "near": a - s2, "far": a - s1, "gram": gram[a].view(np.int64), "context": hashes.of(s1, s2 + length, 1).view(np.int64)})


def _find_anchors(length: int):
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            data, ids = list(batch["b"]), batch["d"].to_numpy()
            for i, j in blocks(data):
                found = _anchors(data[i:j], length)
                yield pd.DataFrame({"d": ids[i:j][found["part"]], **{c: found[c] for c in ("at", "near", "far", "gram", "context")}})

    return find


def _cut_cores(length: int):
    """Cut the windows of each anchor into blocks; of each the hash of the core that all its windows share, and what
    its windows have to the left and to the right of that."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, data, found in zip(batch["d"], batch["b"], batch["found"]):
                f = np.array([(x["at"], x["near"], x["far"], x["gram"]) for x in found], np.int64)
                lo, hi = f[:, 1] // BLOCK, f[:, 2] // BLOCK
                row = np.repeat(np.arange(len(f)), hi - lo + 1)
                ob = np.arange(len(row)) - np.repeat(np.cumsum(hi - lo + 1) - (hi - lo + 1), hi - lo + 1) + lo[row]
                at, gram = f[row, 0], f[row, 3].view(np.uint64)
                near, far = np.maximum(f[row, 1], ob * BLOCK), np.minimum(f[row, 2], ob * BLOCK + BLOCK - 1)
                start = at - ob * BLOCK
                end = start - (BLOCK - 1) + length
                hashes = _Hashes(np.frombuffer(data, np.uint8))
                k1 = mix(hashes.of(start, end, 0) ^ gram) + ob.astype(np.uint64)
                k2 = mix(hashes.of(start, end, 1) + gram)
                first, past = at - far, at - near + length
                yield pd.DataFrame({"d": [d] * len(row), "first": first, "k1": k1.view(np.int64), "k2": k2.view(np.int64), "head": [data[x:y] for x, y in zip(first, start)], "tail": [data[x:y] for x, y in zip(end, past)]})

    return cut


def _repeated_in(rows: pd.DataFrame) -> np.ndarray:
    """For strings ``head, core, tail``, by core: which of their windows (by start, up to ``BLOCK``) occur twice.

    A window of the text is a run of ``BLOCK`` symbols that holds the core's symbol, so a window that occurs twice
    is an interval of suffixes with a common prefix of ``BLOCK`` symbols.
    """
    core = np.unique(np.ascontiguousarray(rows[["k1", "k2"]].to_numpy()).view([("a", np.int64), ("b", np.int64)]).ravel(), return_inverse=True)[1] + 257
    heads, tails = list(rows["head"]), list(rows["tail"])
    lengths = np.array([len(h) + 1 + len(t) for h, t in zip(heads, tails)])
    flat = np.frombuffer(b"".join(x for h, t in zip(heads, tails) for x in (h, b"\0", t)), np.uint8).astype(np.int64) + 1
    ends = np.cumsum(lengths)
    flat[ends - lengths + np.array([len(h) for h in heads])] = core
    shards, owner = [], []
    for i in range(0, len(rows), SHARD):
        j = min(i + SHARD, len(rows))
        t = transform(flat[ends[i] - lengths[i] : ends[j - 1]], lengths[i:j])
        shards.append(t)
        owner.append(t.string + i)
    order, prefix = merge(shards, BLOCK)
    same = prefix >= BLOCK
    twice = same | np.concatenate([same[1:], [False]])
    hit = np.zeros((len(rows), BLOCK), bool)
    string, start = np.concatenate(owner)[order[twice]], np.concatenate([t.start for t in shards])[order[twice]]
    hit[string, start] = True
    return hit


def _merge_cores(length: int):
    """Find the windows that occur twice among rows sorted by core, many cores at a time."""

    def spans(rows: pd.DataFrame) -> pd.DataFrame:
        hit = _repeated_in(rows)
        padded = np.zeros((len(hit), BLOCK + 2), np.int8)
        padded[:, 1:-1] = hit
        step = np.diff(padded, axis=1)
        (r, a), (_, b) = np.nonzero(step == 1), np.nonzero(step == -1)
        first = rows["first"].to_numpy()[r]
        return pd.DataFrame({"d": rows["d"].to_numpy()[r], "start": first + a, "end": first + b - 1 + length})

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for g in groups(batches, "k"):
            held.append(g)
            size += len(g) * 2 * BLOCK
            if size > MERGE or len(held) > 30000:
                yield spans(pd.concat(held))
                held, size = [], 0
        if held:
            yield spans(pd.concat(held))

    return find


def _count_windows(length: int):
    """The windows of rows one by one, each with its hash: for cores that very many rows share."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for d, first, k1, k2, head, tail in zip(*(batch[c] for c in ("d", "first", "k1", "k2", "head", "tail"))):
                low = len(head) + len(tail) - (BLOCK - 1)
                for x in range(low + 1):
                    h = hashlib.blake2b(head[x:] + b"|" + tail[: x + BLOCK - 1 - len(head)] + b"%d,%d,%d" % (k1, k2, len(head) - x), digest_size=16).digest()
                    rows.append((d, first + x, h))
            yield pd.DataFrame(rows, columns=["d", "start", "window"])

    return cut


def repeated_spans(docs: DataFrame, length: int = 400) -> DataFrame:
    """``d, spans``: of each distinct text the merged spans of bytes that repeated strings of ``length`` bytes cover.

    ``docs`` has ``d`` (a digest) and ``b`` (bytes), a row for each document. Texts that occur more than once or
    are shorter than ``length`` have no row: of the former everything is covered, of the latter nothing.

    1. Every window of ``length`` bytes has an anchor that its content decides, so a window can only occur twice if
       its anchor's gram does. Anchors whose gram occurs once are done with.
    2. Anchors whose windows all have their bytes in common with another anchor's are settled as a whole.
    3. The windows of the rest are cut into blocks with a common core. Each core becomes one symbol, so that
       strings of bytes around cores stand for the windows; those whose core occurs once are done with. The
       strings' suffixes are put in order by merging shards' Burrows-Wheeler transforms, and intervals with a long
       enough common prefix are the windows that occur twice. A core with very many rows is not gathered: its
       windows are counted by hash instead.
    """
    spark, n_out = docs.sparkSession, partitions(docs.sparkSession)
    long = docs.where(F.length("b") >= length)
    anchors = written(long.mapInPandas(_find_anchors(length), "d binary, at int, near int, far int, gram long, context long"), "anchors")
    what = F.xxhash64("context", "near", "far")
    grams = anchors.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min(what).alias("one"), F.max(what).alias("other")).where("n > 1")
    # Grams, contexts and cores are written before they are joined, so that both sides are dealt anew and Spark can
    # split the rows of a very common one.
    grams = written(grams.select("gram", (F.col("one") != F.col("other")).alias("differ")), "grams")
    # One row for each place of each distinct text, whatever number of copies it has; dealt by place, so that a common
    # gram's rows lie in all parts.
    again = anchors.join(grams, "gram").groupBy("gram", "differ", "d", "at", "near", "far", "context").agg(F.count(F.lit(1)).alias("c"))
    again = written(again, "again")
    discard(anchors, grams)
    contexts = written(again.groupBy("gram", "context", "near", "far", "differ").agg(F.sum("c").alias("n"), F.min(F.struct("d", "at")).alias("some")), "contexts")
    settled = again.join(contexts.where("n > 1").select("gram", "context", "near", "far"), ["gram", "context", "near", "far"], "left_semi")
    whole = settled.select("d", (F.col("at") - F.col("far")).alias("start"), (F.col("at") - F.col("near") + length).alias("end"))

    asked = contexts.where("differ").select("some.d", F.struct(F.col("some.at").alias("at"), "near", "far", "gram").alias("x")).groupBy("d").agg(F.collect_list("x").alias("found"))
    texts = long.join(asked.select("d"), "d", "left_semi").groupBy("d").agg(F.first("b").alias("b"))
    cores = texts.join(asked, "d").mapInPandas(_cut_cores(length), "d binary, first int, k1 long, k2 long, head binary, tail binary")
    cores = written(cores, "cores")
    common = written(cores.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "common")
    shared = written(cores.join(common, ["k1", "k2"]), "shared")
    discard(cores, common)
    dealt = shared.where(F.col("n") <= HOT).withColumn("k", F.xxhash64("k1", "k2")).repartition(n_out, "k").sortWithinPartitions("k").drop("n")
    fine = dealt.mapInPandas(_merge_cores(length), "d binary, start int, end int")
    windows = shared.where(F.col("n") > HOT).drop("n").mapInPandas(_count_windows(length), "d binary, start int, window binary")
    twice = windows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    hot = windows.join(twice, "window", "left_semi").select("d", "start", (F.col("start") + length).alias("end"))
    found = whole.unionByName(fine).unionByName(hot)
    spans = written(found.groupBy("d").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans")), "spans")
    discard(again, contexts, shared)
    return spans


def _cut_text(b: pd.Series, spans: pd.Series) -> pd.DataFrame:
    rows = []
    for data, found in zip(b, spans):
        kept, removed, runs, end = [], 0, 0, 0
        for s in found if found is not None else ():
            if s["start"] > end or not runs:
                kept.append(data[end : s["start"]])
                runs += 1
                removed += s["end"] - s["start"]
                end = s["end"]
            elif s["end"] > end:
                removed += s["end"] - end
                end = s["end"]
        rows.append((removed, runs, b"".join([*kept, data[end:]])))
    return pd.DataFrame(rows, columns=["n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, length: int = 400, text: str = "text") -> DataFrame:
    """``docs`` with ``_n_bytes, _n_removed, _n_spans, _kept``: each text's UTF-8 bytes without those that lie in a
    string of ``length`` bytes that also starts anywhere else, in the same text or in another.

    Strings never cross texts; overlapping occurrences count; all are judged on the input. Null texts are empty.
    Rows with equal texts repeat each other as a whole (if they are long enough), and are settled by their digest
    alone. Columns with these names are replaced. Bytes are compared by 128 bits of hash.
    """
    docs = docs.drop("_n_bytes", "_n_removed", "_n_spans", "_kept")
    cols = [F.col(f"`{c}`") for c in docs.columns]
    b = utf8(F.col(f"`{text}`"))
    keyed = docs.select(F.struct(*cols).alias("row"), b.alias("b")).withColumn("d", F.unhex(F.substring(F.sha2("b", 256), 1, 32)))
    plain = keyed.select("d", "b")
    copies = plain.groupBy("d").agg(F.count(F.lit(1)).alias("copies"))
    spans = repeated_spans(plain, length)
    one = F.coalesce("copies", F.lit(1)) == 1
    facts = copies.where("copies > 1").join(spans, "d", "full").select("d", ~one, F.when(one, F.col("spans"))).toDF("d", "copied", "spans")
    got = keyed.join(written(facts, "spans"), "d", "left")
    size = F.length("b").cast("long")
    gone = F.coalesce("copied", F.lit(False)) & (size >= length)
    cut = F.pandas_udf(_cut_text, "n_removed long, n_spans long, kept binary")
    some, rest = got.where("spans IS NOT NULL"), got.where("spans IS NULL")
    some = some.withColumn("cut", cut("b", "spans")).select("row", size.alias("_n_bytes"), F.col("cut.n_removed").alias("_n_removed"), F.col("cut.n_spans").alias("_n_spans"), F.col("cut.kept").alias("_kept"))
    rest = rest.select("row", size.alias("_n_bytes"), F.when(gone, size).otherwise(0).cast("long").alias("_n_removed"), gone.cast("long").alias("_n_spans"), F.when(gone, F.lit(b"")).otherwise(F.col("b")).alias("_kept"))
    return some.unionByName(rest).select("row.*", "_n_bytes", "_n_removed", "_n_spans", "_kept")
