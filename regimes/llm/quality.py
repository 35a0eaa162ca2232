"""A quality classifier from compression: two zstandard dictionaries and a calibrated size difference."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .language_id import held_out

#: Texts are compressed in blocks of so many bytes, each on its own, so that the dictionaries matter throughout.
BLOCK = 512
LEVEL = 3


@dataclass(frozen=True)
class Model:
    """Dictionaries of the bad and the good class, the scale of the features, and the weights of the calibration.

    Without dictionaries (a class had no labelled text) every score is ``rate``.
    """

    dictionaries: tuple[bytes, bytes] | None
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    rate: float


def _compressors(dictionaries: tuple[bytes, bytes]) -> list[zstd.ZstdCompressor]:
    out = []
    for data in dictionaries:
        d = zstd.ZstdCompressionDict(data)
        d.precompute_compress(level=LEVEL)
        out.append(zstd.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def _sizes(text: str | None, by: list[zstd.ZstdCompressor]) -> tuple[int, int, int]:
    """Bytes of the whole text, and of its blocks compressed with the bad and the good dictionary."""
    data = (text or "").encode("utf-8", "surrogatepass")
    parts = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
    return (len(data), *(sum(len(c.compress(x)) for x in parts) for c in by))


def _features(sizes: np.ndarray) -> np.ndarray:
    """The size difference, normalised by the sum; the compressed share and the length, as logarithms; and their products."""
    n, bad, good = np.asarray(sizes, np.float64).reshape(-1, 3).T
    x = [(bad - good) / np.maximum(1, bad + good), np.log(np.maximum((bad + good) / np.maximum(2 * n, 1), 1e-3)), np.log1p(n)]
    return np.stack([*x, *(x[i] * x[j] for i in range(3) for j in range(i, 3))], axis=1)


def _scores(model: Model, sizes: np.ndarray) -> np.ndarray:
    """Probabilities of the good class. Features are kept within 4 deviations, so that odd lengths don't run away."""
    x = np.clip((_features(sizes) - model.centre) / model.scale, -4, 4)
    return 1 / (1 + np.exp(-np.clip(model.weights[0] + x @ model.weights[1:], -30, 30)))


def _train(samples: list[bytes], size: int) -> bytes:
    try:
        return zstd.train_dictionary(size, samples, k=64, d=8, level=LEVEL).as_bytes()
    except zstd.ZstdError:  # too few samples for that: the samples themselves serve
        return b"".join(samples)[:size]


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, text: str = "text", label: str = "quality", rows_per_class: int = 1500, blocks_per_text: int = 8, dictionary_bytes: int = 112640, seed: int = 3) -> Model:
    """Learn from the labelled texts whose ``doc_id`` in ``labels`` the condition ``learn`` admits.

    Documented bounds: ``rows_per_class`` texts of each class are learned from, those of the smallest seeded hashes of
    their ids, or all if there are fewer; of an id that has several texts that of the smallest hash. Half of them build the dictionaries, from ``blocks_per_text`` blocks at
    most of each, spread evenly over the whole text; the other half, compressed whole, fits the calibration (a
    logistic curve over the size difference, the compressed share and the length). Null labels, null texts and
    labels without document are left out; a repeated label counts once.
    """
    marked = labels.where(F.lit(True) if learn is None else learn).where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    marked = marked.select("doc_id", F.col(label).cast("int").alias("y")).distinct()
    counts = {r[0]: r[1] for r in marked.groupBy("y").count().collect()}
    rate = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
    constant = Model(None, np.zeros(9), np.ones(9), np.zeros(10), rate)
    if len(counts) < 2:
        return constant
    dice = F.xxhash64(F.lit(seed), "doc_id")
    few = [marked.where(F.col("y") == y).orderBy(dice, "doc_id").limit(rows_per_class) for y in sorted(counts)]
    chosen = few[0].unionByName(few[1]).select("doc_id", "y", (F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(2)) == 0).alias("builds"))
    texts = docs.select("doc_id", F.col(f"`{text}`").cast("string").alias("t")).where("t IS NOT NULL").join(F.broadcast(chosen), "doc_id")  # rows_per_class ids of each class at most
    # Of an id's several texts one counts, so that as many rows as ids are learned from.
    texts = texts.groupBy("doc_id", "y", "builds").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t")).alias("x")).select("doc_id", "y", "builds", F.col("x.t").alias("t"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for y, t in zip(batch["y"], batch["t"]):
                data = t.encode("utf-8", "surrogatepass")
                starts = range(0, max(1, len(data)), BLOCK)
                picked = {starts[k * len(starts) // blocks_per_text] for k in range(blocks_per_text)}
                rows.append((y, [data[i : i + BLOCK] for i in sorted(picked) if data]))
            yield pd.DataFrame(rows, columns=["y", "blocks"])

    samples = texts.where("builds").select("y", "t").mapInPandas(cut, "y int, blocks array<binary>").collect()
    of = [sorted(bytes(x) for r in samples if r["y"] == y for x in r["blocks"]) for y in (0, 1)]
    if not all(of):
        return constant
    rng = np.random.default_rng(seed)
    dictionaries = tuple(_train([s[i] for i in rng.permutation(len(s))], dictionary_bytes) for s in of)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = _compressors(dictionaries)
        for batch in batches:
            yield pd.DataFrame([(i, y, *_sizes(t, by)) for i, y, t in zip(batch["doc_id"], batch["y"], batch["t"])], columns=["doc_id", "y", "n", "bad", "good"])

    rows = texts.where("NOT builds").select("doc_id", "y", "t").mapInPandas(measure, "doc_id long, y int, n long, bad long, good long").collect()
    data = np.array(sorted(tuple(r) for r in rows), np.float64).reshape(-1, 5)
    if len(set(data[:, 1])) < 2:
        return constant
    y, x = data[:, 1], _features(data[:, 2:])
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    # Each class counts as it does in the labels, however many of it were chosen.
    weight = np.where(y == 1, rate / max(1, (y == 1).sum()), (1 - rate) / max(1, (y == 0).sum())) * len(y)
    z = np.concatenate([np.ones((len(x), 1)), np.clip((x - centre) / scale, -4, 4)], axis=1)
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = z.T @ (z * (weight * p * (1 - p))[:, None]) + 0.01 * np.eye(len(w))
        w += np.linalg.solve(hessian, z.T @ (weight * (y - p)) - 0.01 * w)
    return Model(dictionaries, centre, scale, w, rate)


def score(model: Model, text: Column) -> Column:
    """The probability that a whole text is of the good class, 0 to 1. Null texts score as empty ones do."""

    @F.pandas_udf("double")
    def scored(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        by = _compressors(model.dictionaries) if model.dictionaries else None
        for s in series:
            if by is None:
                yield pd.Series(np.full(len(s), model.rate))
            else:
                yield pd.Series(_scores(model, np.array([_sizes(t, by) for t in s], np.float64).reshape(-1, 3)).round(6))

    return scored(text.cast("string"))


__all__ = ["Model", "fit", "held_out", "score"]
