"""Period transforms: each observation against an earlier one of its series, by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranges


def _or(col: Column, default: float) -> Column:
    """A parameter; 0 and null mean its default."""
    return F.coalesce(F.nullif(col, F.lit(0)), F.lit(default))


def pct_change(v: Column, base: Column, scale: Column) -> Column:
    return F.when(base != 0, scale * (v / F.nullif(base, F.lit(0.0)) - 1))


def log_growth(v: Column, base: Column, per_year: Column, scale: Column) -> Column:
    return F.when((v > 0) & (base > 0), scale * per_year * F.ln(F.when(v > 0, v) / F.when(base > 0, base)))


def indicator_below(v: Column, threshold: Column) -> Column:
    return F.when(v.isNotNull(), F.when(v < threshold, 1.0).otherwise(0.0))


def earlier_values(df: DataFrame, lags: list[int], by: str, parts: int | None = None) -> DataFrame:
    """Add ``_lag<n>`` for each lag: the value so many rows before in the series (``by``), in the order of ``d, pos``.

    With ``parts`` the order is cut into so many ranges, so that a series of very many rows is several tasks' work: a
    range takes the last values of the earlier ones of its series, as many as the largest lag.
    """
    order, most = ["d", "pos"], max(lags)
    if not parts:
        w = Window.partitionBy(by).orderBy(*order)
        return df.withColumns({f"_lag{n}": F.lag("v", n).over(w) for n in lags})
    rows = ranges.in_ranges(df, [F.col(c) for c in (by, *order)], parts)
    here, back = Window.partitionBy(by, "_range").orderBy(*order), Window.partitionBy(by, "_range").orderBy(*[F.desc(c) for c in order])
    tails = rows.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= most)
    values = F.transform(F.sort_array(F.collect_list(F.struct("_back", "v")), asc=False), lambda x: x["v"])
    halo = ranges.carried(tails.groupBy(by, "_range").agg(values.alias("value")), [by], F.flatten("before"), "_halo")
    rows = ranges.with_carried(rows.withColumns({"_nth": F.row_number().over(here)} | {f"_here{n}": F.lag("v", n).over(here) for n in lags}), [by], halo, "_halo")
    base = lambda n: F.when(F.col("_nth") > n, F.col(f"_here{n}")).otherwise(F.try_element_at("_halo", F.col("_nth") - 1 - n))
    return rows.withColumns({f"_lag{n}": base(n) for n in lags}).drop("_nth", "_halo", "_range", *[f"_here{n}" for n in lags])


def apply_transforms(df: DataFrame, lags: list[int], by: str = "metric_id", parts: int | None = None) -> DataFrame:
    """Replace ``v`` by its transform.

    ``df`` has ``by, pos, d, v`` and the parameters ``transform, lag, scale, annualize, threshold``. ``lags`` are the
    lags that occur. A lag counts rows of the whole series, missing values included, so the first value in a time
    window may look back before it. One sort for each series serves all kinds, in ``parts`` ranges if that is given.
    """
    lags = sorted({x or 1 for x in lags})
    lag = _or(F.col("lag"), 1)
    base = F.lit(None).cast("double")
    if lags:
        df = earlier_values(df, lags, by, parts)
    for n in lags:
        base = F.when(lag == n, F.col(f"_lag{n}")).otherwise(base)
    df = df.withColumn("_base", base).drop(*[f"_lag{n}" for n in lags])
    v, kind = F.col("v"), F.coalesce("transform", F.lit("identity"))
    out = (
        F.when(kind == "identity", v)
        .when(kind == "pct_change", pct_change(v, F.col("_base"), _or(F.col("scale"), 100.0)))
        .when(kind == "growth_rate", log_growth(v, F.col("_base"), _or(F.col("annualize"), 1.0), _or(F.col("scale"), 100.0)))
        .when(kind == "indicator_lt", indicator_below(v, F.coalesce("threshold", F.lit(0.0))))
        .otherwise(F.raise_error(F.concat(F.lit("unsupported transform: "), kind)))
    )
    return df.withColumn("v", out).drop("_base")


def resample_month(series: DataFrame, how: str) -> DataFrame:
    """Monthly values from daily ones: the last value in the month that isn't missing (``eop``) or their mean (``avg``)."""
    month = F.trunc("d", "month").cast("date").alias("m")
    value = F.max_by(F.when(F.col("v").isNotNull(), F.col("v")), F.when(F.col("v").isNotNull(), F.struct("d", "pos"))) if how == "eop" else F.avg("v")
    return series.groupBy("series_key", month).agg(value.alias("v")).select("series_key", F.col("m").alias("d"), "v")
