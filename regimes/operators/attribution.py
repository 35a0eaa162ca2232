"""Attribution of observations to half-open windows: by day, by most days of a period, and at boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import overlap_days, period
from . import ranges


#: Levels of the bins: a bin of level k is 2**k days wide, and the widest holds every date from year 1 to 9999.
TOP = 22
#: A period is a year long at most, so its own bins are of fewer levels.
PERIOD_TOP = 8
#: Days from year 1 to 1970.
_FIRST = 719_162


def _bins(day: str, top: int) -> str:
    """SQL: the bin of each level that holds a day; level and bin in one number."""
    return f"transform(sequence(0, {top}), l -> shiftright(unix_date({day}) + {_FIRST}L, l) * 32L + l)"


def _cover(start: str, end: str, top: int) -> str:
    """SQL: the fewest bins that together hold the days from ``start`` until before ``end``: two of each level at most.

    A window of any length, one that never ends too, has some forty bins at most, and each of its days lies in just one.
    """
    low, high = f"shiftright(unix_date({start}) + {_FIRST}L + shiftleft(1L, l) - 1L, l)", f"shiftright(unix_date({end}) + {_FIRST}L, l)"
    pieces = f"array(if({low} < {high} AND {low} % 2 = 1, {low} * 32L + l, NULL), if({low} < {high} AND {high} % 2 = 1, ({high} - 1L) * 32L + l, NULL))"
    return f"array_compact(flatten(transform(sequence(0, {top}), l -> {pieces})))"


def _met(spans: DataFrame, windows: DataFrame) -> DataFrame:
    """``spans`` (with ``ps, pe``) with every window (``wid, start, end``) of which it shares a day.

    A span shares a day with a window if the window holds the span's first day, or else starts within the span. Both
    are a day among intervals: the day's bins and the interval's meet in one equi-join, each pair once.
    """
    w = windows.select("wid", "start", "end").where("start < end").withColumn("_bin", F.explode(F.expr(f"concat(transform({_cover('start', 'end', TOP)}, b -> b * 2L), transform({_bins('start', PERIOD_TOP)}, b -> b * 2L + 1L))")))
    p = spans.where("ps < pe").withColumn("_bin", F.explode(F.expr(f"concat(transform({_bins('ps', TOP)}, b -> b * 2L), transform({_cover('date_add(ps, 1)', 'pe', PERIOD_TOP)}, b -> b * 2L + 1L))")))
    return p.join(w, "_bin").drop("_bin")


PERIOD_KEYS = ["freq", "period_kind", "fy_month", "fy_day", "d"]


def term_of_day(days: DataFrame, windows: DataFrame, day: str = "d") -> DataFrame:
    """``day, wid`` for the distinct days of ``days`` that lie in a window ``[start, end)``; of several the first to start."""
    spans = days.select(day).where(F.col(day).isNotNull()).distinct().withColumn("ps", F.col(day)).withColumn("pe", F.date_add(day, 1))
    return _met(spans, windows).groupBy(day).agg(F.min_by("wid", F.struct("start", "wid")).alias("wid"))


def term_of_period(dates: DataFrame, windows: DataFrame, tie: str = "period_end") -> DataFrame:
    """``freq, period_kind, fy_month, fy_day, d, wid``: the window with most days in the period that each date stands for.

    Instants (days) go to the window that holds them, of several the first to start. If several windows have most of a
    period's days, the one that holds the period's last day gets it, even if it isn't one of them, or none
    (``tie='period_end'``), or else the last of them to start (``tie='latest_start'``). What has no day in a window
    has no row. Each distinct date is worked out once, whatever number of series shares it: one join, one aggregation.
    """
    instant = (F.col("freq") == "D") & F.coalesce(F.col("period_kind") == "instant", F.lit(True))
    p = period(F.col("d"), F.col("freq"), F.col("period_kind"), F.coalesce("fy_month", F.lit(10)), F.coalesce("fy_day", F.lit(1)))
    spans = dates.select(*PERIOD_KEYS).where("d IS NOT NULL").distinct().withColumn("day", F.coalesce(instant, F.lit(False)))
    spans = spans.withColumn("p", F.when(F.col("day"), F.struct(F.col("d").alias("start"), F.date_add("d", 1).alias("end"))).otherwise(p)).withColumn("ps", F.col("p.start")).withColumn("pe", F.col("p.end"))
    met = _met(spans.drop("p"), windows).withColumn("days", overlap_days(F.col("ps"), F.col("pe"), F.col("start"), F.col("end")))
    holds = (F.col("start") < F.col("pe")) & (F.col("pe") <= F.col("end"))
    won = met.groupBy(*PERIOD_KEYS, "day").agg(
        F.max(F.struct("days", "start", "wid")).alias("last"), F.min(F.struct((-F.col("days")).alias("less"), "start", "wid")).alias("first"),
        F.min_by("wid", F.when(holds, F.struct("start", "wid"))).alias("holder"),
    )
    tied = F.col("holder") if tie == "period_end" else F.col("last.wid")
    alone = (F.col("first.start") == F.col("last.start")) & (F.col("first.wid") == F.col("last.wid"))
    wid = F.when(alone, F.col("last.wid")).when(F.col("day"), F.col("holder")).otherwise(tied)
    return won.select(*PERIOD_KEYS, wid.alias("wid")).where("wid IS NOT NULL")


def before_boundaries(series: DataFrame, marks: DataFrame, by: str = "series_key", parts: int | None = None) -> DataFrame:
    """``marks`` (``by, mark`` and any other columns) with ``d, v``: the last value of each series, missing ones skipped, on a day before each mark.

    Marks and observations are put in one order for each series, so that the work is one sort, not one scan for each
    mark. Marks without an earlier value have no row. With ``parts`` the order is cut into so many ranges, so that a
    series of very many rows is several tasks' work: a range takes the last value of the earlier ones of its series.
    """
    rest = [c for c in marks.columns if c not in (by, "mark")]
    own = F.struct(*rest) if rest else F.struct(F.lit(0).alias("none"))
    obs = series.where("v IS NOT NULL").select(by, F.col("d").alias("at"), F.lit(1).alias("kind"), "pos", F.struct("d", "v").alias("seen"))
    both = obs.unionByName(marks.select(by, F.col("mark").alias("at"), F.lit(0).alias("kind"), own.alias("of")), allowMissingColumns=True)
    order = ["at", "kind", "pos"]
    last = F.last("seen", ignorenulls=True)
    if parts:
        rows = ranges.in_ranges(both, [F.col(c) for c in (by, *order)], parts)
        ends = rows.groupBy(by, "_range").agg(F.max_by("seen", F.when(F.col("seen").isNotNull(), F.struct(*order))).alias("value"))
        before = ranges.carried(ends, [by], F.try_element_at(F.array_compact("before"), F.lit(-1)), "_before")
        rows = rows.withColumn("_here", last.over(Window.partitionBy(by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        rows = ranges.with_carried(rows, [by], before, "_before").withColumn("got", F.coalesce("_here", "_before"))
    else:
        rows = both.withColumn("got", last.over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    found = rows.where("kind = 0 AND got IS NOT NULL")
    return found.select(by, F.col("at").alias("mark"), *[F.col(f"of.`{c}`").alias(c) for c in rest], F.col("got.d").alias("d"), F.col("got.v").alias("v"))
