"""Two-pass external shuffle of a table into shards, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, new_folder, partitions, utf8, written

#: Buckets whose offsets one task adds up; with more buckets a second level adds up the sums.
SPAN = 4096
#: Bytes of rows that one task of the second pass gets, about.
TASK_BYTES = 128 << 20
#: Copies of a row that one task makes at a time.
STEP = 1 << 16
_NONE = (1 << 31) - 1


def offsets(counts: DataFrame) -> DataFrame:
    """``bucket, n, offset``: the rows in all lower buckets, from ``bucket, n``, added up in two levels."""
    c = counts.withColumn("span", F.floor(F.col("bucket") / SPAN))
    inner = Window.partitionBy("span").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = c.groupBy("span").agg(F.sum("n").alias("m")).select("span", F.coalesce(F.sum("m").over(outer), F.lit(0)).alias("before"))
    within = c.select("span", "bucket", "n", F.coalesce(F.sum("n").over(inner), F.lit(0)).alias("within"))
    return within.join(spans, "span").select("bucket", "n", (F.col("before") + F.col("within")).alias("offset"))


def size_of(text: Column | str) -> Column:
    """UTF-8 bytes of a text plus 16 for the row's fixed part."""
    return (F.octet_length(utf8(text)) + F.lit(16)).cast("long")


def fisher_yates(df: DataFrame, seed: int, out: str = "places") -> DataFrame:
    """Add ``out``: where a Fisher-Yates shuffle of ``n`` things puts each of them; ``df`` has ``bucket, n``.

    Step i draws j of 0 to i from a hash of seed, bucket and i; thing i goes to place j, and what was there to place
    i. So what lies in a place moves on at the first later step that draws this place. These steps form chains, whose
    ends are found by doubling: work is n log n, and nothing but seed, bucket and n decides the result.
    """
    low = _NONE  # the lower 31 bits of a packed pair
    df = df.withColumn("_j", F.expr(f"transform(sequence(0, int(n) - 1), i -> pmod(xxhash64({seed}L, bucket, i), i + 1L))"))
    # For each place the steps after its own that draw it, and then a mark: the first of them is where its thing goes next.
    drawn = f"filter(transform(_j, (j, i) -> shiftleft(j, 31) | i), x -> shiftright(x, 31) <> (x & {low}L))"
    marks = f"transform(_j, (j, i) -> shiftleft(bigint(i), 31) | {low}L)"
    df = df.withColumn("_s", F.expr(f"sort_array(concat({drawn}, {marks}))"))
    df = df.withColumn("_next", F.expr(f"transform(filter(_s, (x, i) -> i = 0 OR (get(_s, i - 1) & {low}L) = {low}L), x -> int(x & {low}L))"))
    # Thing i leaves its first place at the next step that draws that place.
    later = f"transform(filter(transform(_s, (x, i) -> shiftleft(x & {low}L, 31) | (coalesce(get(_s, i + 1), 0L) & {low}L)), x -> shiftright(x, 31) <> {low}L), x -> x)"
    own = f"filter(transform(_j, (j, i) -> if(j = i, shiftleft(bigint(i), 31) | get(_next, i), -1L)), x -> x >= 0)"
    df = df.withColumn("_leaves", F.expr(f"transform(sort_array(concat({later}, {own})), x -> int(x & {low}L))"))
    ends = f"aggregate(sequence(0, int(ceil(log2(n)))), transform(_next, (k, i) -> if(k = {low}, i, k)), (e, _) -> transform(e, p -> get(e, p)))"
    df = df.withColumn("_ends", F.expr(ends))
    return df.withColumn(out, F.expr(f"transform(_j, (j, i) -> if(get(_leaves, i) = {low}, int(j), get(_ends, get(_leaves, i))))")).drop("_j", "_s", "_next", "_leaves", "_ends")


def _copies(df: DataFrame) -> DataFrame:
    """Each row ``c`` times, with ``copy`` from 0; the copies of one row are made by many tasks."""
    steps = df.withColumn("_step", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(c - 1) div {STEP}L")))).repartition("h", "_step")
    return steps.withColumn("copy", F.explode(F.expr(f"sequence(_step * {STEP}L, least(c, (_step + 1) * {STEP}L) - 1)"))).drop("_step", "c")


def shard(df: DataFrame, path: str, shards: int = 40, seed: int = 7, bucket_bytes: int = 8 << 20, text_col: str = "text") -> DataFrame:
    """Shuffle all rows of ``df`` into ``shards`` shards under ``path`` and return the written table.

    Pass 1 scatters rows over buckets of about ``bucket_bytes`` by a seeded hash of all their columns (maps aside), so
    that a hot source or a group of copies is spread evenly. Pass 2 brings each bucket into one task, numbers its rows
    by that hash and deals them by a seeded Fisher-Yates shuffle. Rows are sorted, not gathered, so a task spills
    where it lacks memory. Buckets follow one another, so a row's place in the whole permutation is its bucket's
    offset plus its place in the bucket, and the permutation is cut into ``shards`` runs whose counts are at most one
    apart (law ``rows``). Seed, rows and ``shards`` alone decide the result, however the input is partitioned.

    Rows equal in all columns share a hash. Those that would fill over a quarter of a bucket are counted, and their
    copies scattered one by one, so that no bucket outgrows the others.

    The result has the columns of ``df`` in the files of ``shard=N`` folders, in order, plus ``_slot`` (gapless from 0
    in each shard) and ``_shard``; columns of ``df`` with these names are replaced. Repeated rows are all kept; null
    ids and texts are rows like others; an empty table gives an empty result.
    """
    spark = df.sparkSession
    df = df.drop("_slot", "_shard")
    cols = [F.col(f"`{c}`") for c in df.columns]
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    rows = df.select(F.xxhash64(F.lit(seed), *plain).alias("h"), F.struct(*cols).alias("row"))
    keys = written(rows.select("h", size_of(F.col("row")[text_col]).alias("size")).groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("size")), "keys")
    total, size = keys.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = max(1, -(-size // bucket_bytes))
    bucket = lambda *of: F.pmod(F.xxhash64(F.lit(seed + 1), *of), F.lit(buckets))

    once = F.lit(0).cast("long").alias("copy")
    heavy = (F.col("c") > 1) & (F.col("size") > bucket_bytes // 4)
    again = keys.where(heavy).select("h", "c")
    some = not again.isEmpty()
    counts = keys.where(~heavy).select("h", F.col("c").alias("n"), once)
    dealt = rows.select("h", "row", once)
    if some:
        # Equal rows are one row and a count until their copies are scattered.
        same = rows.join(again.select("h"), "h", "left_semi").groupBy("h").agg(F.first("row").alias("row"), F.count(F.lit(1)).alias("c"))
        dealt = rows.join(again.select("h"), "h", "left_anti").select("h", "row", once).unionByName(_copies(same))
        counts = counts.unionByName(_copies(again).withColumn("n", F.lit(1).cast("long")))
    plan = fisher_yates(offsets(counts.groupBy(bucket("h", "copy").alias("bucket")).agg(F.sum("n").alias("n"))), seed)
    dealt = dealt.withColumn("bucket", bucket("h", "copy")).repartition(max(partitions(spark), -(-size // TASK_BYTES)), "bucket")
    nth = F.row_number().over(Window.partitionBy("bucket").orderBy("h", "copy")) - 1
    placed = dealt.withColumn("nth", nth).join(plan, "bucket").select("row", (F.col("offset") + F.get("places", F.col("nth"))).alias("at"))
    which = F.expr(f"int((({shards}L * (at + 1)) - 1) div {max(total, 1)}L)")
    start = F.expr(f"(_shard * {max(total, 1)}L) div {shards}L")
    out = placed.withColumn("_shard", which).withColumn("_slot", F.col("at") - start).sortWithinPartitions("_shard", "_slot")
    out = out.select(*[F.col("row")[c].alias(c) for c in df.columns], "_slot", "_shard")
    out.write.partitionBy("_shard").parquet(path)
    discard(keys)
    return spark.read.schema(out.schema).parquet(path)


def shuffled(df: DataFrame, **options) -> DataFrame:
    return shard(df, new_folder(df.sparkSession, "shards"), **options)
