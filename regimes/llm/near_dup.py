"""Near-duplicate documents: MinHash banding, signature and full-set verification, connected components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import blocks, groups
from .common import partitions, written
from .components import components
from .shingles import shingle_sets, signatures

#: Minima in a band, and bands: two sets of similarity 0.75 meet in no band with a chance of 3 in ten million.
ROWS, BANDS = 4, 40
#: Weight that one unit of comparison holds at most; larger groups are compared by bucket or in tiles of two blocks.
#: A class weighs as many as it has shingles, and ``LIGHT`` at least: that bounds a unit's pairs, too.
UNIT, LIGHT = 1 << 20, 256
#: Standard deviations below the asked similarity at which a signature's estimate still leads to full comparison.
SLACK = 5.5


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """``key, real, t``: the id of each row, or a hash of its text where the id is null."""
    t, own = F.col(f"`{text}`").cast("string"), F.col(f"`{doc_id}`").cast("long")
    return docs.select(F.coalesce(own, F.xxhash64(t)).alias("key"), own.isNotNull().alias("real"), t.alias("t"))


def profiles(docs: DataFrame, k: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``key, real, h, n, digest, bands`` of each row: its id, a hash of its text, the size of its shingle set, the set's digest and its bands' keys."""

    def profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch["t"]]
            for a, b in blocks(texts):
                sets = shingle_sets(texts[a:b], k)
                bands = signatures(sets, ROWS * BANDS).view(np.int64)
                yield pd.DataFrame({"key": batch["key"].iloc[a:b].to_numpy(), "real": batch["real"].iloc[a:b].to_numpy(), "h": batch["h"].iloc[a:b].to_numpy(), "n": [len(s) for s in sets], "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], "bands": list(bands)})

    return _keyed(docs, text, doc_id).withColumn("h", F.xxhash64("t")).mapInPandas(profile, "key long, real boolean, h long, n long, digest binary, bands array<long>")


def _candidates(classes: DataFrame) -> DataFrame:
    """``unit, cid, side`` for the classes that meet others in some band: units are what is compared, of bounded size.

    All classes of a band's bucket are tied to the smallest, which needs no list of the bucket. What is tied
    together is one unit, if it isn't too large. Else its buckets are the units; but where these hold more pairs than
    the group itself does, since many pairs meet in many buckets, the group is compared as one, each pair once. What is
    still too large is cut into blocks: a block is a unit, and so are each two blocks, whose ``side`` tells them apart
    and of which only pairs across are compared.
    """
    weight = F.greatest("n", F.lit(LIGHT)).cast("double")
    keyed = classes.select("cid", weight.alias("n"), F.posexplode("bands").alias("band", "key")).select("cid", "n", F.xxhash64("band", "key").alias("bucket"))
    met = keyed.groupBy("bucket").agg(F.min("cid").alias("centre"), F.max("cid").alias("last"), F.sum("n").alias("total")).where("centre <> last")
    met = written(keyed.join(met, "bucket").select("bucket", "cid", "n", "centre", "total"), "met")
    tied = components(met.select(F.col("centre").alias("a"), F.col("cid").alias("b")))
    # Weight times that of its buckets, summed over a group's members, is the weight of all pairs in its buckets.
    members = met.groupBy(F.col("cid").alias("node")).agg(F.first("n").alias("n"), F.sum(F.col("n") * F.col("total")).alias("pairs"))
    group = tied.join(members, "node")
    sizes = group.groupBy("component").agg(F.sum("n").alias("size"), F.sum("pairs").alias("pairs"))
    group = group.drop("pairs").join(sizes, "component").select(F.col("node").alias("cid"), "component", "size", "n", (F.col("pairs") > F.col("size") * F.col("size")).alias("dense"))
    group = written(group, "groups")
    whole = group.where(F.col("size") <= UNIT).select(F.xxhash64(F.lit("group"), "component").alias("unit"), "cid", F.lit(0).alias("side"))
    large = met.join(group.where((F.col("size") > UNIT) & ~F.col("dense")).select("cid"), "cid")
    buckets = large.where(F.col("total") <= UNIT).select(F.xxhash64(F.lit("bucket"), "bucket").alias("unit"), "cid", F.lit(0).alias("side"))
    dense = group.where((F.col("size") > UNIT) & F.col("dense")).select(F.xxhash64(F.lit("dense"), "component").alias("of"), F.col("size").alias("total"), "cid")
    cut = large.where(F.col("total") > UNIT).select(F.xxhash64(F.lit("cut"), "bucket").alias("of"), "total", "cid").unionByName(dense)
    cut = cut.withColumn("blocks", F.ceil(F.col("total") / F.lit(UNIT // 2)).cast("int"))
    cut = cut.withColumn("mine", F.pmod(F.xxhash64(F.lit(23), "cid"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = cut.select(F.xxhash64(F.lit("tile"), "of", F.least("mine", "other"), F.greatest("mine", "other")).alias("unit"), "cid", (F.col("mine") > F.col("other")).cast("int").alias("side"))
    return whole.unionByName(buckets).unionByName(tiles)


class _Sets:
    """Disjoint sets over ``n`` things."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, i: int, others: np.ndarray) -> None:
        labels = np.unique(np.append(self.of[others], self.of[i]))
        self.of[np.isin(self.of, labels)] = labels[0]


def _by_signature(similarity: float):
    """Split units by the signatures' estimates: parts between which no pair can be near fall apart, lone classes go."""
    least = similarity - SLACK * (similarity * (1 - similarity) / (ROWS * BANDS)) ** 0.5

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        units, cids, sides, parts = [], [], [], []
        for g in groups(batches, "unit"):
            g = g.sort_values("side", kind="stable")
            sig = np.stack(g["bands"].to_numpy()).view(np.uint16)
            cid, side = g["cid"].to_numpy(), g["side"].to_numpy()
            sets, m, first = _Sets(len(g)), len(g), int((side == 0).sum())
            across = first < m
            for i in range(first if across else m - 1):
                start = first if across else i + 1
                rest = start + np.flatnonzero(sets.of[start:] != sets.of[i])
                near = rest[(sig[rest] == sig[i]).mean(axis=1) >= least] if len(rest) else rest
                if len(near):
                    sets.join(i, near)
            label, count = np.unique(sets.of, return_counts=True)
            kept = np.isin(sets.of, label[count > 1])
            units += [g["unit"].iloc[0]] * int(kept.sum())
            cids += cid[kept].tolist()
            sides += side[kept].tolist()
            parts += cid[sets.of[kept]].tolist()
            if len(cids) > 20000:
                yield pd.DataFrame({"unit": units, "part": parts, "cid": cids, "side": sides})
                units, cids, sides, parts = [], [], [], []
        if cids:
            yield pd.DataFrame({"unit": units, "part": parts, "cid": cids, "side": sides})

    return split


def _by_sets(k: int, per_cent: int):
    """Compare the full shingle sets within units; the links that tie each unit's parts together go out."""

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        links: list[tuple[int, int]] = []
        for g in groups(batches, "unit"):
            texts, cid = list(g["t"]), g["cid"].to_numpy()
            parts = [s for a, b in blocks(texts) for s in shingle_sets(texts[a:b], k)]
            side = g["side"].to_numpy()
            order = np.lexsort(([len(s) for s in parts], side))
            sizes = np.array([len(parts[i]) for i in order])
            first = int((side == 0).sum())
            across = first < len(order)
            flat = np.unique(np.concatenate([parts[i] for i in order]), return_inverse=True)[1]
            starts = np.concatenate([[0], np.cumsum(sizes)])
            mine, sets = np.zeros(flat.max() + 1, bool), _Sets(len(order))
            for i in range(first if across else len(order) - 1):
                # Sets come by size, those of the other side too: smaller and larger ones than these can't be near.
                start = first + np.searchsorted(sizes[first:], -(-per_cent * sizes[i] // 100)) if across else i + 1
                others = first if across else 0
                end = others + np.searchsorted(sizes[others:], sizes[i] * 100 // per_cent, side="right")
                rest = start + np.flatnonzero(sets.of[start:end] != sets.of[i])
                if not len(rest):
                    continue
                own = flat[starts[i] : starts[i + 1]]
                mine[own] = True
                if len(rest) * 2 < end - start:
                    places = np.concatenate([np.arange(starts[j], starts[j + 1]) for j in rest])
                    shared = np.add.reduceat(mine[flat[places]], np.concatenate([[0], np.cumsum(sizes[rest])[:-1]]), dtype=np.int64)
                else:
                    shared = np.add.reduceat(mine[flat[starts[start] : starts[end]]], starts[start:end] - starts[start], dtype=np.int64)[rest - start]
                mine[own] = False
                near = rest[100 * shared >= per_cent * (sizes[i] + sizes[rest] - shared)]
                if len(near):
                    for label in np.unique(sets.of[near]):
                        j = near[sets.of[near] == label][0]
                        links.append((int(cid[order[i]]), int(cid[order[j]])))
                    sets.join(i, near)
            if len(links) > 20000:
                yield pd.DataFrame(links, columns=["a", "b"])
                links = []
        if links:
            yield pd.DataFrame(links, columns=["a", "b"])

    return confirm


def grouped(docs: DataFrame, k: int = 5, per_cent: int = 75, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, h, n_shingles, group, component_id`` for each row of ``docs``, with ``h`` a hash of its text.

    ``group`` is a number that all rows of a component share (null for rows without shingles), ``component_id`` the
    smallest id in it (null if no row of it has one). See :func:`near_duplicates`.
    """
    n_out = partitions(docs.sparkSession)
    rows = written(profiles(docs, k, text, doc_id), "profiles")
    own = F.when(F.col("real"), F.col("key"))
    classes = rows.where("n > 0").groupBy("digest").agg(F.min(own).alias("doc_id"), F.min("key").alias("key"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = written(classes.select("digest", F.coalesce("doc_id", "key").alias("cid"), "doc_id", "n", "bands"), "classes")

    units = _candidates(classes).distinct().join(classes.select("cid", "bands"), "cid")
    dealt = units.repartition(n_out, "unit").sortWithinPartitions("unit").select("unit", "cid", "side", "bands")
    parts = dealt.mapInPandas(_by_signature(per_cent / 100), "unit long, part long, cid long, side int")
    parts = written(parts.select(F.xxhash64("unit", "part").alias("unit"), "cid", "side").distinct(), "parts")

    # One document for each class that is left: that with its smallest id.
    texts = _keyed(docs, text, doc_id).select(F.col("key").alias("cid"), "t").join(parts.select("cid").distinct(), "cid", "left_semi")
    ready = parts.join(texts, "cid").repartition(n_out, "unit").sortWithinPartitions("unit").select("unit", "cid", "side", "t")
    links = written(ready.mapInPandas(_by_sets(k, per_cent), "a long, b long"), "links")
    tied = components(links)
    names = tied.join(classes.select(F.col("cid").alias("node"), "doc_id"), "node").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = tied.join(names, "component").select(F.col("node").alias("cid"), "component", "component_id")
    final = classes.select("digest", "cid", "doc_id").join(named, "cid", "left").select("digest", F.coalesce("component", "cid").alias("group"), F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    # Rows without shingles, which share one digest, take no part. The groups are written first, so that both sides
    # are dealt anew and Spark can split the rows of a very common digest.
    own = rows.select(own.alias("doc_id"), "h", F.col("n").alias("n_shingles"), "digest")
    found = own.where("n_shingles > 0").join(written(final, "final"), "digest").drop("digest")
    return found.unionByName(own.where("n_shingles = 0").drop("digest").withColumn("group", F.lit(None).cast("long")).withColumn("component_id", F.col("doc_id")))


def near_duplicates(docs: DataFrame, k: int = 5, per_cent: int = 75, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``.

    Documents are linked if ``100 * shared >= per_cent * united`` holds for their sets of distinct ``k``-word
    shingles (of fewer words: the sequence as a whole). ``component_id`` is the smallest id that links reach.
    Documents with equal sets are one class and are compared once. Classes that share a band of minima are
    candidates, however many; estimates from signatures thin them out, and full sets decide. Shingles are
    compared as 64-bit hashes. No list of links, classes or components reaches the driver.

    Null and empty texts and texts without words have no shingles, are their own component and are kept. Repeated
    rows get the same component and are all kept or not kept alike; rows of one id but different texts are one node
    of the graph. Rows with a null id take part; they are kept only if nothing reachable has an id.
    :func:`representatives` takes one row of each group, whatever its ids.
    """
    out = grouped(docs, k, per_cent, text, doc_id).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def representatives(docs: DataFrame, k: int = 5, per_cent: int = 75, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group one row, and all rows that have no shingles.

    The row with the smallest id stays; in a group without any id that with the smallest hash of its text. Rows of
    one id and one text are one document, of which one row stays: that with the smallest hash of all its columns.
    """
    found = grouped(docs, k, per_cent, text, doc_id).where("group IS NOT NULL").groupBy("group", "doc_id", "h").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "n"))
    # Written first, so that both sides of the join are dealt anew and Spark can split a very common row's copies.
    kept = written(found.groupBy("group").agg(first.alias("x")).select(F.xxhash64("x.doc_id", "x.h").alias("_key"), F.col("x.n").alias("_n")), "kept")
    t, own = F.col(f"`{text}`").cast("string"), F.col(f"`{doc_id}`").cast("long")
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, T.MapType)]
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(own, F.xxhash64(t)).alias("_key"), F.xxhash64(*plain).alias("_all"))
    # A row for each group: that grows with the corpus, so it isn't broadcast at any size.
    out = keyed.join(kept.hint("merge"), "_key")
    again = out.where("_n > 1").groupBy("_key").agg(F.min_by("row", "_all").alias("row"))
    bare = docs.where(~F.coalesce(F.regexp_like(t, F.lit(r"[^ \t\n\x0B\f\r]")), F.lit(False)))
    return out.where("_n = 1").select("row.*").unionByName(again.select("row.*")).unionByName(bare)
