"""Exact percentiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import kept
from . import ranges

#: Values of a group that one task's map of values and counts may have.
MOST = 1_000_000


def percentiles(df: DataFrame, by: list[str], value: str, qs: list[float], out: str = "q", most: int = MOST, parts: int | None = None) -> DataFrame:
    """``by, out``: the percentiles ``qs`` (0 to 1) of each group's values, interpolated between neighbours; nulls are skipped.

    Groups without any value have null. If no group has more than ``most`` rows, Spark's own exact percentile, which
    holds a group's values in one place, does it; otherwise all are selected by counts, see ``selected``.
    """
    largest = df.groupBy(*by).agg(F.count(value).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= most:
        return df.groupBy(*by).agg(F.percentile(value, F.array(*[F.lit(float(q)) for q in qs])).alias(out))
    return selected(df, by, value, qs, out, parts)


def selected(df: DataFrame, by: list[str], value: str, qs: list[float], out: str = "q", parts: int | None = None) -> DataFrame:
    """What ``percentiles`` gives, without any group in one place.

    Equal values are counted first, on the map side too. Groups and values are one order, cut into ranges; from the
    number of values in each range of a group follows which ranges hold the wanted places, and only those are sorted.
    """
    groups = df.select(*by).distinct()
    # Zeros are one value whatever their sign.
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, (F.col(value).cast("double") + 0.0).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    rows = kept(ranges.in_ranges(counted, [F.col(c) for c in [*by, "_v"]], parts))
    sizes = rows.groupBy(*by, "_range").agg(F.sum("_n").alias("value"))
    total = F.aggregate("before", F.lit(0).cast("long"), lambda n, x: n + x)
    placed = ranges.with_carried(ranges.with_carried(sizes, by, ranges.carried(sizes, by, total, "_ahead"), "_ahead"), by, ranges.carried(sizes, by, total, "_after", later=True), "_after")
    ahead, after = F.coalesce("_ahead", F.lit(0)), F.coalesce("_after", F.lit(0))
    placed = placed.select(*by, "_range", "value", ahead.alias("_ahead"), (ahead + F.col("value") + after).alias("_all"))
    # The wanted places: below and above each percentile, counted from 0.
    wants = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), F.lit(float(q)).alias("q")) for i, q in enumerate(qs) for side in (0, 1)])
    at = F.col("w.q") * (F.col("_all") - 1)
    place = F.when(F.col("w.side") == 0, F.floor(at)).otherwise(F.ceil(at))
    wanted = placed.withColumn("w", F.explode(wants)).withColumn("_share", at - F.floor(at)).withColumn("_place", place - F.col("_ahead")).where((F.col("_place") >= 0) & (F.col("_place") < F.col("value")))
    names = [F.col(c).alias(f"_w{i}") for i, c in enumerate([*by, "_range"])]
    wanted = wanted.select(*names, "w.i", "w.side", "_share", "_place")
    same = [F.col(c).eqNullSafe(F.col(f"_w{i}")) for i, c in enumerate([*by, "_range"])]
    held = rows.join(wanted.select(*[f"_w{i}" for i in range(len(by) + 1)]).distinct(), same, "left_semi")
    upto = F.sum("_n").over(Window.partitionBy(*by, "_range").orderBy("_v"))
    found = held.withColumn("_upto", upto).join(wanted, same).where((F.col("_place") < F.col("_upto")) & (F.col("_place") >= F.col("_upto") - F.col("_n")))
    sides = found.groupBy(*by, "i").agg(*[F.max(F.when(F.col("side") == s, F.col("_v"))).alias(f"_s{s}") for s in (0, 1)], F.first("_share").alias("_share"))
    between = F.when(F.col("_s0") == F.col("_s1"), F.col("_s0")).otherwise(F.col("_s0") * (1 - F.col("_share")) + F.col("_s1") * F.col("_share"))
    lists = sides.withColumn("x", between).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(out))
    g = groups.select(*[F.col(c).alias(f"_w{i}") for i, c in enumerate(by)])
    return g.join(lists, [F.col(c).eqNullSafe(F.col(f"_w{i}")) for i, c in enumerate(by)], "left").select(*[F.col(f"_w{i}").alias(c) for i, c in enumerate(by)], out)
