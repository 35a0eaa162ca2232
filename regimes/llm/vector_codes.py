"""Product codes of vectors: codebooks for parts of vectors, whose nearest entries are found by equal-average search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: Whole numbers are kept as 32-bit ones, shifted so that their bytes sort as they do.
_SHIFT = 1 << 31
#: Copies of each label's sum of errors, so that the rows of a very common label are dealt over as many tasks.
SALTS = 32


@dataclass(frozen=True)
class Codebooks:
    """``entries``: whole numbers by part, entry and place in the part."""

    entries: np.ndarray
    scale: int

    @property
    def width(self) -> int:
        return self.entries.shape[2]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` the nearest row of ``entries`` (of equally near ones the first) and its squared distance.

    Entries are sorted by the sum of their components. By Cauchy and Schwarz a squared distance times the dimension is
    at least the square of the difference of sums. So the search goes outward from a row's own sum, nearer sums first,
    and ends where that square strictly exceeds the best distance times the dimension: a tie can't lie beyond.
    """
    n, width = x.shape
    sums = entries.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    ranked, ordered = sums[order], entries[order]
    own = x.sum(axis=1)
    high = np.searchsorted(ranked, own)
    low = high - 1
    best, found = np.full(n, -1, np.int64), np.full(n, len(entries), np.int64)
    rows, k = np.arange(n), len(entries)
    far = np.int64(np.iinfo(np.int64).max)
    while len(rows):
        below = np.where(low[rows] >= 0, own[rows] - ranked[np.maximum(low[rows], 0)], far)
        above = np.where(high[rows] < k, ranked[np.minimum(high[rows], k - 1)] - own[rows], far)
        down = below <= above
        gap = np.where(down, below, above)
        some = gap < far
        some[some] = (best[rows[some]] < 0) | (gap[some] ** 2 <= best[rows[some]] * width)
        rows, down = rows[some], down[some]
        at = np.where(down, low[rows], high[rows])
        low[rows[down]] -= 1
        high[rows[~down]] += 1
        distance = ((x[rows] - ordered[at]) ** 2).sum(axis=1)
        b, f = best[rows], found[rows]
        better = (b < 0) | (distance < b) | ((distance == b) & (order[at] < f))
        best[rows[better]], found[rows[better]] = distance[better], order[at[better]]
    return found, best


def _parts(whole: Sequence[bytes], parts: int, width: int) -> np.ndarray:
    """Vectors of packed whole numbers by row, part and place."""
    x = np.frombuffer(b"".join(whole), ">u4").astype(np.int64) - _SHIFT
    if x.size and 2 * width * np.abs(x).max() >= _SHIFT:
        raise ValueError("components are too large for exact sums of 64 bits")
    return x.reshape(len(whole), parts, width)


def whole_numbers(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of each component, packed; null for a vector that is null or holds null or non-finite components."""

    @F.arrow_udf("binary")
    def pack(vectors: pa.Array) -> pa.Array:
        lengths = np.asarray(vectors.value_lengths().fill_null(0))
        ends = np.cumsum(lengths)
        x = np.asarray(vectors.flatten().cast(pa.float64()).fill_null(float("nan")))
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
        good = np.asarray(vectors.is_valid()) & (bad[ends] == bad[ends - lengths])
        whole = np.floor(np.where(np.isfinite(x), x, 0.0) * scale)
        kept = np.repeat(good, lengths)
        if np.any(np.abs(whole[kept]) >= _SHIFT):
            raise ValueError(f"a component times {scale} is beyond 32 bits")
        packed = (np.where(kept, whole, 0).astype(np.int64) + _SHIFT).astype(">u4").tobytes()
        return pa.array([packed[4 * (e - n) : 4 * e] if g else None for e, n, g in zip(ends.tolist(), lengths.tolist(), good.tolist())], pa.binary())

    return pack(vector)


def _first_ids(table: DataFrame, key: str, n: int) -> list:
    """The ``n`` smallest ids: each task hands on as many at most."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            ids = batch.column(0).drop_null().unique()
            ids = ids if held is None else pa.concat_arrays([held, ids]).unique()
            held = ids.take(pc.sort_indices(ids)[:n])
        if held is not None:
            yield pa.RecordBatch.from_arrays([held], [key])

    ids = table.select(F.col(f"row.`{key}`").alias(key))
    few = ids.mapInArrow(least, ids.schema)
    return [r[0] for r in few.distinct().orderBy(key).limit(n).collect()]


def _start(table: DataFrame, key: str, parts: int, entries: int) -> np.ndarray | None:
    """The codebooks' first entries: the vectors of the smallest ids. None if no vector has an id."""
    ids = _first_ids(table, key, entries)
    of = F.col(f"row.`{key}`")
    rows = table.where(of.isin(ids)).groupBy(of.alias("id")).agg(F.min("whole").alias("whole")).orderBy("id").collect() if ids else []
    if not rows:
        return None
    size = len(rows[0].whole)
    if size % (4 * parts):
        raise ValueError(f"vectors of {size // 4} components can't be cut into {parts} equal parts")
    first = [np.frombuffer(r.whole, ">u4").astype(np.int64) - _SHIFT for r in rows if len(r.whole) == size]
    return np.stack(first).reshape(len(first), parts, -1).transpose(1, 0, 2)


def _sums(table: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of the parts that each entry is nearest to; each task hands on one row for each part and entry at most."""
    parts, entries, width = books.shape

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = _parts(batch.column(0).to_pylist(), parts, width)
            for p in range(parts):
                found, _ = nearest(x[:, p], books[p])
                np.add.at(total[p], found, x[:, p])
                count[p] += np.bincount(found, minlength=entries)
        used = np.argwhere(count > 0)
        p, e, i = np.repeat(used[:, 0], width), np.repeat(used[:, 1], width), np.tile(np.arange(width), len(used))
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (p, e, i, total[p, e, i], count[p, e])], ["p", "e", "i", "total", "n"])

    rows = table.mapInArrow(assigned, "p long, e long, i long, total long, n long").groupBy("p", "e", "i").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
    for r in rows:
        total[r.p, r.e, r.i], count[r.p, r.e] = r.total, r.n
    return total, count


def encoded(books: Codebooks, whole: Column) -> Column:
    """A struct of ``code`` (two hex digits for each part) and ``error`` (squared distances summed over parts); both null for vectors of another length."""
    entries = books.entries
    parts, _, width = entries.shape

    @F.arrow_udf("code string, error long")
    def encode(column: pa.Array) -> pa.Array:
        vectors = column.to_pylist()
        fit = [i for i, v in enumerate(vectors) if len(v) == 4 * parts * width]
        x = _parts([vectors[i] for i in fit], parts, width)
        code, error = np.zeros(x.shape[:2], np.uint8), np.zeros(len(x), np.int64)
        for p, book in enumerate(entries):
            found, distance = nearest(x[:, p], book)
            code[:, p] = found
            error += distance
        codes, errors = [None] * len(vectors), [None] * len(vectors)
        for i, c, e in zip(fit, code, error.tolist()):
            codes[i], errors[i] = c.tobytes().hex(), e
        return pa.StructArray.from_arrays([pa.array(codes, pa.string()), pa.array(errors, pa.int64())], ["code", "error"])

    return encode(whole)


def decoded(books: Codebooks, code: Column) -> Column:
    """The vector that a code stands for: the middles of its entries' whole numbers over the scale."""
    entries, scale = books.entries, books.scale

    @F.arrow_udf("array<double>")
    def decode(column: pa.Array) -> pa.Array:
        def one(c: str | None) -> list | None:
            return None if c is None else [float(x) for book, e in zip(entries, bytes.fromhex(c)) for x in (book[e] + 0.5) / scale]

        return pa.array([one(c) for c in column.to_pylist()], pa.list_(pa.float64()))

    return decode(code)


def compressed(df: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, Codebooks | None]:
    """The columns of ``df`` but the vector, with ``_code`` and ``_error``, and the codebooks.

    Components become whole numbers, ``floor(scale * x)``; all later arithmetic is exact. A codebook for each of
    ``parts`` equal parts (256 entries at most) starts as that part of the vectors with the smallest ids; a round
    assigns every part to its nearest entry and then moves each entry to the floor of its parts' mean; entries that no
    part is assigned to stay. Every row takes part in every round. A round has no shuffle but of the tasks' sums,
    which are as large as the codebooks; the codebooks alone reach the driver.

    Rows go whose vector is null, holds null or non-finite components. Of an id's several vectors the smallest starts
    an entry (component by component); rows without id are coded, but start none. Without any kept id there is no
    codebook (None) and codes are null; so are those of vectors of another length than the first id's. A component
    that, times the scale, leaves too little room for exact 64-bit sums stops the job.
    """
    if not 0 < entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    rest = [c for c in df.columns if c != vector]
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), whole_numbers(F.col(f"`{vector}`"), scale).alias("whole"))
    table = written(packed.where("whole IS NOT NULL"), "vectors")
    books = _start(table, key, parts, entries)
    if books is None:
        made, code = None, F.lit(None).cast("struct<code:string,error:bigint>")
    else:
        same = table.where(F.octet_length("whole") == 4 * parts * books.shape[2]).select("whole")
        for _ in range(rounds):
            total, count = _sums(same, books)
            used = count > 0
            books = books.copy()
            books[used] = total[used] // count[used][:, None]
        made = Codebooks(books, scale)
        code = encoded(made, F.col("whole"))
    coded = table.select("row", code.alias("c")).select(*[F.col(f"row.`{c}`").alias(c) for c in rest], F.col("c.code").alias("_code"), F.col("c.error").alias("_error"))
    out = written(coded, "codes")
    discard(table)
    return out, made


def with_sums(coded: DataFrame, label: str, value: str = "_error", out: str = "_label_error") -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of equal label, null being a label of its own.

    Sums are copied ``SALTS`` times and rows dealt over the copies, so that a label of very many rows is no single task's.
    """
    of, salt = F.col(f"`{label}`"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))
    sums = coded.groupBy(of.alias("_of")).agg(F.sum(F.col(f"`{value}`")).alias(out)).withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    rows = coded.select(F.struct(*[F.col(f"`{c}`") for c in coded.columns]).alias("_row"), of.alias("_key"), salt.alias("_salt"))
    joined = rows.join(sums.hint("merge"), F.col("_key").eqNullSafe(F.col("_of")) & (F.col("_salt") == F.col("_copy")))
    return joined.select(*[F.col(f"_row.`{c}`").alias(c) for c in coded.columns], out)
