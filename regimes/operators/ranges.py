"""An order cut into ranges: positions, neighbours and running values over one long order without one task for all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows, chosen by a hash, from which the bounds between ranges are taken; only the sizes of ranges depend on them.
SAMPLE = 2048


def parts_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def in_ranges(df: DataFrame, order: list[Column], parts: int | None = None, out: str = "_range") -> DataFrame:
    """Add ``out``: the number of the range, of ``parts`` or fewer, in which a row lies in the order of ``order`` (nulls first).

    Bounds are taken from a sample of fixed size by a scalar subquery; equal rows share a range, so the last column
    of ``order`` should tell rows apart. No result depends on where the bounds lie.
    """
    parts = parts or parts_of(df)
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    seen = df.select(key.alias("t")).orderBy(F.xxhash64("t"), "t").limit(SAMPLE).agg(F.array_sort(F.collect_list("t")).alias("s"))
    picks = F.transform(F.sequence(F.lit(1), F.lit(max(parts - 1, 1))), lambda k: F.get("s", F.floor(k * F.size("s") / parts).cast("int")))
    bounds = seen.select(F.array_distinct(F.array_compact(picks))).scalar()
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(parts.bit_length()))])
    found = F.aggregate(steps, F.lit(0), lambda low, step: F.when((low + step <= F.size("_bounds")) & (F.get("_bounds", low + step - 1) <= F.col("_at")), low + step).otherwise(low))
    return df.withColumn("_bounds", bounds).withColumn("_at", key).withColumn(out, found).drop("_bounds", "_at")


def carried(summary: DataFrame, by: list[str], fold: Column, out: str, later: bool = False) -> DataFrame:
    """``by, _range, out``: for each range what ``fold`` makes of the array ``before`` of the values ``value`` of all earlier
    (or ``later``) ranges of its group, the nearest last.

    ``summary`` has ``by, _range, value``, one row for each range of a group. Groups of one range have no row: what is
    left are two rows for each range at most, whatever the number of groups, as only the groups at a range's ends go
    on beyond it.
    """
    every = F.sort_array(F.collect_list(F.struct("_range", "value")), asc=not later).alias("all")
    groups = (summary.groupBy(*by) if by else summary.groupBy()).agg(every).where(F.size("all") > 1)
    rows = groups.select(*by, "all", F.posexplode("all").alias("i", "x"))
    before = F.transform(F.slice("all", F.lit(1), F.col("i")), lambda x: x["value"])
    return rows.select(*by, F.col("x._range").alias("_range"), before.alias("before")).select(*by, "_range", fold.alias(out))


def with_carried(rows: DataFrame, by: list[str], carry: DataFrame, out: str) -> DataFrame:
    """``rows`` with what ``carried`` has for their group and range, null where it has nothing. A few rows are broadcast: two for each range."""
    small = carry.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate([*by, "_range"])], out)
    same = [F.col(c).eqNullSafe(F.col(f"_c{i}")) for i, c in enumerate([*by, "_range"])]
    return rows.join(F.broadcast(small), same, "left").drop(*[f"_c{i}" for i in range(len(by) + 1)])


def numbered(df: DataFrame, order: list[Column], out: str, parts: int | None = None) -> DataFrame:
    """``df`` in ranges (``_range``), with ``out``: each row's number, from 1, in the order of ``order`` over all rows.

    Rows are numbered within ranges, and the numbers of rows of earlier ranges are added; ``df`` is read three times.
    """
    rows = in_ranges(df, order, parts)
    ahead = carried(rows.groupBy("_range").agg(F.count(F.lit(1)).alias("value")), [], F.aggregate("before", F.lit(0).cast("long"), lambda n, x: n + x), "_ahead")
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return with_carried(rows.withColumn("_own", own), [], ahead, "_ahead").withColumn(out, F.col("_own") + F.coalesce("_ahead", F.lit(0))).drop("_own", "_ahead")


def parts_for(series: DataFrame, least: int = 4 << 30) -> int | None:
    """How many ranges to cut the order of a table of series into: none unless Spark's own estimate of the table is of so
    many bytes that one key's rows may be too much for one task. Tables of unknown size count as small."""
    size = int(str(series._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return parts_of(series) if least <= size < 1 << 62 else None
