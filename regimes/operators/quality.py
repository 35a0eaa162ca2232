"""Data-quality checks, each a query that returns ``level, check_id, message``."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import parse_date, parse_loose
from . import ranges


def issue(level: str, check: str, message: Column) -> list[Column]:
    return [F.lit(level).alias("level"), F.lit(check).alias("check_id"), message.alias("message")]


def window_issues(terms: DataFrame) -> DataFrame:
    """Checks of raw windows (texts ``term_id, label, start, end``): ids, dates, order, labels."""
    t = terms.select(F.trim(F.coalesce("term_id", F.lit(""))).alias("id"), "label", parse_date(F.col("start")).alias("s"), parse_date(F.col("end")).alias("e"))
    blank = t.where("id = ''").select(*issue("ERROR", "term_id_blank", F.lit("blank term_id")))
    twice = t.where("id <> ''").groupBy("id").count().where("count > 1").select(*issue("ERROR", "term_id_duplicate", F.concat(F.lit("duplicate term_id: "), F.col("id"))))
    dates = t.where("s IS NULL OR e IS NULL").select(*issue("ERROR", "bad_date", F.concat(F.lit("bad date: "), F.col("id"))))
    order = t.where("e <= s").select(*issue("ERROR", "empty_window", F.concat(F.lit("window ends before it starts: "), F.col("id"))))
    label = t.where(~F.coalesce(F.col("label").isin("D", "R", "Other"), F.lit(False))).select(*issue("WARN", "label", F.concat(F.lit("unexpected label: "), F.col("id"))))
    return reduce(DataFrame.unionByName, [blank, twice, dates, order, label])


def adjacency(df: DataFrame, by: list[str], wid: str = "wid", start: str = "start", end: str = "end", parts: int | None = None) -> DataFrame:
    """``by, wid, next_wid, kind, days``: neighbours by start of which one ends after the next starts (overlap) or before (gap).

    ``by`` may be empty: then all windows are one order. The order is cut into ranges, and the last window of a range
    meets the first one of the next range of its group: neither a common group nor the whole is one task's work.
    """
    columns = [start, end, wid]
    rows = ranges.in_ranges(df.select(*by, *columns), [F.col(c) for c in [*by, *columns]], parts)
    here = Window.partitionBy(*by, "_range").orderBy(*columns)
    head = F.struct(F.col(start).alias("s"), F.col(end).alias("e"), F.col(wid).alias("w"))
    firsts = rows.groupBy(*by, "_range").agg(F.min(head).alias("value"))
    beyond = ranges.carried(firsts, by, F.try_element_at("before", F.lit(-1)), "_beyond", later=True)
    nxt = ranges.with_carried(rows.withColumn("_lead", F.lead(head).over(here)), by, beyond, "_beyond").withColumn("_n", F.coalesce("_lead", "_beyond"))
    days = F.date_diff("_n.s", end)
    return nxt.where(days != 0).select(*by, wid, F.col("_n.w").alias("next_wid"), F.when(days < 0, "overlap").otherwise("gap").alias("kind"), days.alias("days"))


def adjacency_issues(terms: DataFrame) -> DataFrame:
    a = adjacency(terms, [])
    return a.select(F.when(F.col("kind") == "overlap", "ERROR").otherwise("WARN").alias("level"), F.col("kind").alias("check_id"), F.concat_ws(" ", "kind", F.lit("between"), "wid", F.lit("and"), "next_wid").alias("message"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, surplus``: how many rows of each key are too many."""
    return df.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("surplus")).where("surplus > 0")


def non_numeric(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text in ``column`` is neither blank nor a number."""
    s = F.col(column)
    return df.where((F.trim(F.coalesce(s, F.lit(""))) != "") & parse_loose(s).isNull())


def error_top(df: DataFrame, by: str, k: int) -> DataFrame:
    """``by, n``: the ``k`` values of ``by`` with the most errors; of equal numbers the first by name."""
    return df.where("error <> ''").groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by).limit(k)


def missing_labels(df: DataFrame, by: list[str], label: str = "party_abbrev") -> DataFrame:
    """``by, missing``: groups without any D or without any R row."""
    has = df.groupBy(*by).agg(F.bool_or(F.col(label) == "D").alias("d"), F.bool_or(F.col(label) == "R").alias("r"))
    lacks = F.array_compact(F.array(F.when(~F.coalesce("d", F.lit(False)), "D"), F.when(~F.coalesce("r", F.lit(False)), "R")))
    return has.select(*by, F.explode(lacks).alias("missing"))


#: Kinds of which an input should have both.
PAIRS = [("end_minus_start", "end_minus_start_per_year"), ("pct_change_from_levels", "cagr_from_levels")]


def symmetry(metrics: DataFrame) -> DataFrame:
    """``series_key, has, lacks`` for inputs that have one kind of a pair without the other."""
    kinds = metrics.groupBy("series_key").agg(F.collect_set("agg_kind").alias("kinds"))
    sides = [(a, b) for p in PAIRS for a, b in (p, p[::-1])]
    found = F.array_compact(F.array(*[F.when(F.array_contains("kinds", a) & ~F.array_contains("kinds", b), F.struct(F.lit(a).alias("has"), F.lit(b).alias("lacks"))) for a, b in sides]))
    return kinds.select("series_key", F.explode(found).alias("f")).select("series_key", "f.has", "f.lacks")


def inflation_pairs(metrics: DataFrame) -> DataFrame:
    """``series_key``: seasonally adjusted indices with a mean of yearly changes but none of monthly annualised growth."""
    mean = F.col("agg_kind") == "mean"
    yoy = mean & (F.col("transform") == "pct_change") & (F.col("lag") == 12)
    mom = mean & (F.col("transform") == "growth_rate") & (F.col("lag") == 1) & (F.col("annualize") == 12)
    adjusted = metrics.where((F.col("seasonal_adjustment") == "SA") & (F.lower(F.trim("series_units")) == "index"))
    has = adjusted.groupBy("series_key").agg(F.bool_or(F.coalesce(yoy, F.lit(False))).alias("yoy"), F.bool_or(F.coalesce(mom, F.lit(False))).alias("mom"))
    return has.where("yoy AND NOT mom").select("series_key")


def table_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None if there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def input_issues(df: DataFrame | None, name: str) -> DataFrame:
    """An error if an input is missing (None) or has no row."""
    if df is None:
        return SparkSession.active().range(1).select(*issue("ERROR", "missing_input", F.lit(f"{name}: missing input")))
    return df.limit(1).agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(*issue("ERROR", "empty_input", F.lit(f"{name}: empty input")))


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """How many values each column has, in one row."""
    return df.agg(*[F.count_distinct(c).alias(c) for c in columns])


def unknown_series(metrics: DataFrame, series: DataFrame) -> DataFrame:
    """``series_key``: inputs that metrics name and that no series has."""
    return metrics.select("series_key").distinct().join(series.select("series_key").distinct(), "series_key", "left_anti")


def roll_up(issues: DataFrame) -> DataFrame:
    """``n_errors, n_warnings, status``: the status is 1 if there is any error."""
    e, w = (F.count_if(F.col("level") == x) for x in ("ERROR", "WARN"))
    return issues.agg(e.alias("n_errors"), w.alias("n_warnings"), F.when(e > 0, 1).otherwise(0).alias("status"))
