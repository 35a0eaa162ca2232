"""Document fingerprints from closed syncmers, with DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions

#: Bytes of a k-mer and of its inner substrings; a k-mer has 8 of these.
K, S = 10, 3
#: Ranges of ids for each shuffle partition: with several, partitions come out about even.
RANGES = 4
#: An anchor is one long: the upper 34 bits of its hash, and its place (from 1) in the lower 30.
BITS = 30
_PLACE = (1 << BITS) - 1


def anchors(df: DataFrame, data: str, out: str) -> DataFrame:
    """Add ``out``: the closed syncmers of the binary column ``data``, by place.

    A k-mer is chosen if the smallest hash of its inner substrings is that of the first or of the last one. That
    depends on nothing outside the k-mer, so an edit only changes the anchors that it touches. Most k-mers are ruled
    out by the first comparisons. Data shorter than a k-mer has all its byte pairs as anchors, a single byte itself,
    empty data none.
    """
    # The data are put into an array of one and taken as a lambda's variable: a column's bytes would be copied for
    # each place, and the work on a text would grow with the square of its length.
    last = K - S
    first_least = " AND ".join(f"x <= get(h, i + {j})" for j in range(1, last))
    last_least = " AND ".join(f"get(h, i + {last}) <= get(h, i + {j})" for j in range(last - 1, 0, -1))
    # Where no k-mer begins, the last comparison is with null, and the place isn't chosen.
    chosen = f"transform(h, (x, i) -> if(if(x <= get(h, i + {last}), {first_least}, {last_least}), i + 1, 0))"
    pack = lambda size, before="", after="": f"get(transform(array({data}), b -> transform(_at, i -> (xxhash64({before}substring(b, i, {size}){after}) & {~_PLACE}L) | (i & {_PLACE}))), 0)"
    df = df.withColumn("_n", F.length(data))
    df = df.withColumn("_h", F.expr(f"CASE WHEN _n >= {K} THEN get(transform(array({data}), b -> transform(sequence(1, _n - {S - 1}), i -> xxhash64(substring(b, i, {S})))), 0) ELSE array() END"))
    df = df.withColumn("_at", F.expr(f"CASE WHEN _n >= {K} THEN array_remove(get(transform(array(_h), h -> {chosen}), 0), 0) WHEN _n > 0 THEN sequence(1, greatest(_n - 1, 1)) ELSE array() END"))
    df = df.withColumn(out, F.expr(f"CASE WHEN _n >= {K} THEN {pack(K)} ELSE {pack(2, 'concat(', ', X\'02\')')} END"))
    return df.drop("_n", "_h", "_at")


def _each(column: str, name: str, value: str) -> str:
    """SQL for ``value`` of each element ``x`` at ``i`` of an array, which is a lambda's variable ``name`` to it: so it is read from the row once."""
    return f"get(transform(array({column}), {name} -> transform({name}, (x, i) -> {value})), 0)"


def _sketch(df: DataFrame, found: str, out: str) -> DataFrame:
    """Add ``out``: the anchors ``found`` by hash, each hash at its first place."""
    df = df.withColumn("_s", F.sort_array(found))
    again = f"coalesce(shiftright(x ^ get(s, i - 1), {BITS}) = 0, false)"
    distinct = F.expr(f"array_remove({_each('_s', 's', f'if({again}, 0L, x)')}, 0L)")
    return df.withColumn(out, distinct).drop("_s")


def matched(df: DataFrame, a: str, b: str, shared: str, placed: str) -> DataFrame:
    """Add how many hashes the fingerprints ``a`` and ``b`` share, and how many of these one shift of the texts brings together, at most.

    Anchors with equal hash and place are at shift 0, and are settled first. The rest of both is sorted together, a
    bit between hash and place telling those of ``b``, so that equal hashes are neighbours and differ by that bit and
    their shift. That leaves 29 bits for places: Spark's arrays end at about half as many bytes of text.
    """
    tag, none = 1 << (BITS - 1), 1 << 40
    df = df.withColumn("_u", F.array_except(a, b)).withColumn("_v", F.array_except(b, a))
    df = df.withColumn("_m", F.expr(f"sort_array(concat(_u, transform(_v, v -> v | {tag}L)))"))
    alike = f"coalesce(shiftright(x ^ get(m, i + 1), {BITS}) = 0, false)"
    found = _each("_m", "m", f"if({alike}, coalesce(get(m, i + 1) - x - {tag}L, {none}L), {none}L)")
    df = df.withColumn("_f", F.expr(f"sort_array(array_remove({found}, {none}L))"))
    # Where runs of one shift end, and how long they are.
    df = df.withColumn("_r", F.expr(f"array_remove({_each('_f', 'f', 'if(coalesce(x = get(f, i + 1), false), 0, i + 1)')}, 0)"))
    run = F.expr(f"coalesce(array_max({_each('_r', 'r', 'x - coalesce(get(r, i - 1), 0)')}), 0)")
    still = F.size(a) - F.size("_u")
    return df.withColumn(shared, still + F.size("_f")).withColumn(placed, F.greatest(still, run)).drop("_u", "_v", "_m", "_f", "_r")


def likeness(a: Column, b: Column, shared: Column) -> Column:
    """The likeness of two fingerprints, 0 to 1: anchors that both texts share, over the mean of their numbers; two empty ones are alike."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).otherwise(F.round(2 * shared / both, 6))


def as_text(sketch: Column) -> Column:
    """A fingerprint as text: the anchors in hexadecimal, by hash."""
    return F.lower(F.array_join(F.transform(sketch, F.hex), ","))


def with_next(docs: DataFrame, n: int) -> tuple[DataFrame, object]:
    """Deal ``docs`` (``doc_id, h, t``) into ranges of ids, so that each range also holds the first row of the next.

    The bounds are ids at evenly spaced ranks (about; ``n`` of them at most reach the driver). Returns the rows
    with ``_range`` and ``_ghost``, and the window in which rows follow one another: the last range is followed by
    the first row. Ghosts are rows that belong to the next range.
    """
    marks = [i / n for i in range(1, n)] or [0.5]
    least, cuts = docs.agg(F.min("doc_id"), F.percentile_approx("doc_id", marks, max(1000, 10 * n))).first()
    cuts = sorted(set(cuts or []) - {least})
    step = 64
    known = F.array(*[F.lit(c) for c in cuts]).cast("array<long>")
    coarse = F.array(*[F.lit(c) for c in cuts[::step]]).cast("array<long>")
    first = F.size(F.filter(coarse, lambda c: c <= F.col("doc_id")))
    docs = docs.withColumn("_c", first)
    fine = F.size(F.filter(F.slice(known, F.greatest((F.col("_c") - 1) * step + 1, F.lit(1)), step), lambda c: c <= F.col("doc_id")))
    home = F.when(F.col("_c") == 0, 0).otherwise((F.col("_c") - 1) * step + fine)
    docs = docs.withColumn("_home", home)
    at_cut = F.when(F.col("doc_id") == F.lit(least), F.lit(len(cuts))).when(F.array_contains(F.slice(known, F.greatest(F.col("_home"), F.lit(1)), 1), F.col("doc_id")), F.col("_home") - 1)
    ranges = F.when(at_cut.isNull(), F.array(F.struct(F.col("_home").alias("_range"), F.lit(0).alias("_ghost")))).otherwise(F.array(F.struct(F.col("_home").alias("_range"), F.lit(0).alias("_ghost")), F.struct(at_cut.alias("_range"), F.lit(1).alias("_ghost"))))
    spread = docs.select("doc_id", "h", "t", F.explode(ranges).alias("r")).select("doc_id", "h", "t", "r._range", "r._ghost")
    return spread, Window.partitionBy("_range").orderBy("_ghost", "doc_id", "h")


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Fingerprints of all rows and of their edited texts.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, placed_edited,
    placed_next``. Fingerprints have all anchors; ``near_`` counts the hashes that two of them share, ``placed_`` only
    those that one shift of the texts brings together, for the shift that has most. The edited text has
    its last ``floor(n_chars / 4)`` code points replaced by the first as many (or all) of the next document's, by
    ascending id; the first follows the last. Null texts are empty. Rows of the same id follow one another by a
    hash of their text. Rows without an id are followed by an empty text, and no row is followed by them.

    One shuffle of the texts, by ranges of ids, does it all: the next text and the next fingerprint are both the
    window's following row.
    """
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(t).alias("h"), t.alias("t"))
    spread, order = with_next(rows.where("doc_id IS NOT NULL"), RANGES * partitions(docs.sparkSession))
    chained = spread.withColumn("_next", F.lead("t").over(order))
    # A table of one row is followed by itself: its ghost is there too.
    lone = rows.where("doc_id IS NULL").withColumn("_range", F.lit(-1)).withColumn("_ghost", F.lit(0)).withColumn("_next", F.lit(""))

    out = None
    for part, follow in ((chained, True), (lone, False)):
        part = part.withColumn("n_chars", F.char_length("t").cast("long")).withColumn("_q", F.floor(F.col("n_chars") / 4).cast("int"))
        part = part.withColumn("_b", F.col("t").cast("binary")).withColumn("_kept", F.left("t", (F.col("n_chars") - F.col("_q")).cast("int")).cast("binary"))
        part = part.withColumn("_head", F.coalesce(F.left("_next", F.col("_q")), F.lit("")).cast("binary")).drop("t", "_next")
        part = part.withColumn("edited_sha256", F.sha2(F.concat("_kept", "_head"), 256))
        # The edited text's own part of anchors: those of the kept start, and those of what begins within a k-mer of its end.
        part = part.withColumn("_cut", F.length("_kept")).withColumn("_from", F.greatest(F.col("_cut") - (K - 1), F.lit(0)))
        part = part.withColumn("_tail", F.expr("concat(substring(_kept, _from + 1, _cut - _from), _head)")).withColumn("_add", F.length("_tail")).drop("_kept", "_head")
        part = anchors(anchors(part, "_b", "_own"), "_tail", "_new").drop("_b", "_tail")
        start = F.expr(f"get(transform(array(_cut - {K - 1}), c -> filter(_own, x -> (x & {_PLACE}) <= c)), 0)")
        moved = F.expr(f"get(transform(array(_from), c -> transform(_new, x -> (x & {~_PLACE}L) | ((x + c) & {_PLACE}))), 0)")
        edited = F.when(F.col("_q") == 0, F.col("_own")).when(F.col("_add") >= K, F.concat(start, moved)).when(F.col("_from") > 0, start).otherwise(F.col("_new"))
        part = part.withColumn("_edited", edited)
        part = _sketch(_sketch(part, "_own", "_a"), "_edited", "_e").select("doc_id", "h", "_range", "_ghost", "n_chars", "edited_sha256", "_a", "_e")
        part = part.withColumn("_following", F.lead("_a").over(order) if follow else F.array().cast("array<long>"))
        part = part.where("_ghost = 0")
        pairs = {"edited": "_e", "next": "_following"}
        for name, other in pairs.items():
            part = matched(part, "_a", other, f"_by_{name}", f"_at_{name}")
        near = [likeness(F.col("_a"), F.col(x), F.col(f"_by_{n}")).alias(f"near_{n}") for n, x in pairs.items()]
        placed = [likeness(F.col("_a"), F.col(x), F.col(f"_at_{n}")).alias(f"placed_{n}") for n, x in pairs.items()]
        part = part.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("_a")).alias("fingerprint"), as_text(F.col("_e")).alias("edited_fingerprint"), *near, *placed)
        out = part if out is None else out.unionByName(part)
    return out
