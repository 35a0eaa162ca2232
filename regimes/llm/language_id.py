"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import blocks

#: Letter classes: 0 is everything but letters, 1-26 are a-z, the others share out all further letters, so that letters
#: of one script differ.
SYMBOLS = 256
UNKNOWN = "und"


@dataclass(frozen=True)
class Space:
    """Random letter vectors of ``dim`` entries of 1 and -1, and the length of the n-grams bound from them."""

    dim: int = 1024
    n: int = 3
    seed: int = 11


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The letter class of each code point."""
    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        if chr(cp).isalpha():
            out[cp] = 27 + cp % (SYMBOLS - 27)
    out[97:123] = np.arange(1, 27)
    return out


@lru_cache(maxsize=2)
def _letters(space: Space) -> np.ndarray:
    """``[place, symbol]``: the letter vectors, permuted (rotated) once for each place before the last."""
    base = np.random.default_rng(space.seed).integers(0, 2, (SYMBOLS, space.dim), dtype=np.int8) * 2 - 1
    return np.stack([np.roll(base, space.n - 1 - k, axis=1) for k in range(space.n)])


def encode(texts: list[str], space: Space) -> tuple[np.ndarray, np.ndarray]:
    """The bundled n-gram vectors of texts, one row each, and the number of letters of each text.

    The vectors of letters that follow one another are permuted by place and bound (multiplied) to an n-gram's
    vector; a text's vector is the sum over all its n-grams. Runs of other characters count as one boundary.
    """
    table, letters = _classes(), _letters(space)
    codes, n_letters = [np.zeros(0, np.int64)], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        c = table[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
        c = c[np.concatenate([[True], (c[1:] | c[:-1]) != 0])].astype(np.int64)
        n_letters[i] = np.count_nonzero(c)
        code = c[: max(0, len(c) - space.n + 1)] + i * SYMBOLS
        for k in range(1, space.n):
            code = code * SYMBOLS + c[k : len(c) - space.n + 1 + k]
        codes.append(code[: len(code) if n_letters[i] else 0])
    pairs, count = np.unique(np.concatenate(codes), return_counts=True)
    of, gram = pairs // SYMBOLS**space.n, pairs % SYMBOLS**space.n
    used, at = np.unique(gram, return_inverse=True)
    counts = np.zeros((len(texts), len(used)), np.float32)
    counts[of, at] = count
    bound = np.ones((len(used), space.dim), np.int8)
    for k in range(space.n):
        bound *= letters[k][used // SYMBOLS ** (space.n - 1 - k) % SYMBOLS]
    return counts @ bound.astype(np.float32), n_letters


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class Model:
    """Language prototypes: unit vectors, one row for each language, and their common mean."""

    space: Space
    langs: tuple[str, ...]
    prototypes: np.ndarray
    mean: np.ndarray


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", learn: Column | None = None, rows_per_lang: int = 2000, space: Space = Space(), seed: int = 5) -> Model:
    """Bundle prototypes from the rows of ``docs`` that ``learn`` admits and whose language isn't null.

    Of a language with more than ``rows_per_lang`` rows about that many are used, chosen by a seeded hash of the
    text: this is the documented bound on what is learned from. Each text counts with unit length. Sums are of
    whole numbers, so that their order doesn't matter. Only the prototypes, one vector for each language, reach
    the driver. Without any row the model knows no language.
    """
    rows = docs.select(F.col(f"`{text}`").cast("string").alias("t"), F.col(f"`{lang}`").cast("string").alias("l"), (F.lit(True) if learn is None else learn).alias("ok")).where("ok AND l IS NOT NULL AND t IS NOT NULL")
    sizes = rows.groupBy("l").count().collect()
    if not sizes:
        return Model(space, (), np.zeros((0, space.dim)), np.zeros(space.dim))
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r[0], min(1.0, rows_per_lang / r[1]))])
    dice = F.pmod(F.xxhash64(F.lit(seed), "t"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(dice < share[F.col("l")]).select("l", "t")

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = list(batch["t"]), list(batch["l"])
            for a, b in blocks(texts):
                vectors, n = encode(texts[a:b], space)
                for name, v, k in zip(langs[a:b], np.rint(_unit(vectors) * (1 << 20)).astype(np.int64), n):
                    if k:
                        sums[name] = sums.get(name, 0) + v
        if sums:
            yield pd.DataFrame({"l": list(sums), "v": [list(map(int, v)) for v in sums.values()]})

    parts = sample.mapInPandas(bundle, "l string, v array<long>").select("l", F.posexplode("v").alias("i", "x"))
    total = parts.groupBy("l", "i").agg(F.sum("x").alias("x")).groupBy("l").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).orderBy("l").collect()
    raw = _unit(np.array([[x["x"] for x in r["v"]] for r in total], np.float64).reshape(-1, space.dim))
    mean = raw.mean(axis=0) if len(raw) > 1 else np.zeros(space.dim)
    return Model(space, tuple(r["l"] for r in total), _unit(raw - mean), mean)


def predict(model: Model, text: Column) -> Column:
    """A struct ``lang, score, letters`` for each whole text: the language whose prototype has the largest cosine with the text's vector.

    What all prototypes share (their mean) is taken off both first. ``score`` is the cosine, cut to 0 to 1. Texts
    that are null or have no letter, and all texts if the model knows no language, give ``und`` and 0. Of equally
    near languages the first by name wins.
    """
    space, langs, prototypes, mean = model.space, np.array([*model.langs, UNKNOWN], object), model.prototypes.astype(np.float32), model.mean.astype(np.float32)

    @F.pandas_udf("lang string, score double, letters long")
    def nearest(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in series:
            texts = [t if isinstance(t, str) else "" for t in s]
            best, score, letters = np.full(len(texts), len(langs) - 1), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            for a, b in blocks(texts):
                vectors, n = encode(texts[a:b], space)
                letters[a:b] = n
                if len(langs) == 1:
                    continue
                cos = _unit(_unit(vectors) - mean) @ prototypes.T
                top = cos.argmax(axis=1)
                best[a:b] = np.where(n > 0, top, len(langs) - 1)
                score[a:b] = np.where(n > 0, np.clip(cos[np.arange(b - a), top], 0, 1), 0)
            yield pd.DataFrame({"lang": langs[best], "score": score.round(6), "letters": letters})

    return nearest.asNondeterministic()(text.cast("string"))  # else it runs once for a filter and once more for a column


def unlike(model: Model, found: Column, deviations: float = 3.5, letters: int = 100) -> Column:
    """Whether a text that :func:`predict` gave ``found`` is like no learned language.

    The cosine of two unrelated vectors has a deviation of one over the root of their length. A text without letters
    is unlike all, and so is one of at least ``letters`` letters whose cosine is below so many ``deviations``; shorter
    texts have too few n-grams to tell. A model of fewer than two languages has nothing to compare, and only rejects
    texts without letters.
    """
    far = F.lit(len(model.langs) > 1) & (found["letters"] >= letters) & (found["score"] < deviations / model.space.dim**0.5)
    return (found["letters"] == 0) | far


def held_out(doc_id: Column, of: int = 3, part: int = 1) -> Column:
    """Whether the CRC-32 of an id, written as text, leaves the remainder ``part``; never for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(of)) == part, F.lit(False))
