"""Series and windows that the registered queries share, as DataFrames and as SQL over the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.inference import block_id
from ..schema import METRICS

#: Windows ``wid, label, start, end``: one before all data, one after, a gap, a month split evenly, a quarter cut.
WINDOWS = [
    ("W1", "R", "1993-01-20", "1994-12-15"), ("W2", "D", "1994-12-15", "1996-04-16"), ("W3", "R", "1996-04-16", "1997-03-01"),
    ("W4", "D", "1997-03-01", "1998-02-10"), ("W5", "Other", "1998-03-05", "1999-05-17"), ("W6", "R", "1999-05-17", "2000-08-09"),
    ("W7", "D", "2000-08-09", "2001-01-20"), ("W8", "R", "2001-01-20", "2005-01-20"), ("W9", "D", "2005-01-20", "2009-01-20"),
]
#: Windows with ties: one month goes to a window that isn't tied, one to none.
TIES = [
    ("A", "D", "1995-01-01", "1996-09-14"), ("B", "R", "1996-09-14", "1996-09-27"), ("C", "D", "1996-09-27", "1997-06-14"),
    ("E", "R", "1997-06-14", "1997-06-27"), ("F", "D", "1997-07-05", "2002-01-01"),
]


def windows(spark: SparkSession, rows: list[tuple] = WINDOWS) -> DataFrame:
    return spark.createDataFrame(rows, "wid string, label string, start string, end string").select("wid", "label", F.to_date("start").alias("start"), F.to_date("end").alias("end"))


def windows_sql(rows: list[tuple] = WINDOWS) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{w}', '{x}', DATE '{a}', DATE '{b}')" for w, x, a, b in rows) + ') AS t(wid, label, "start", "end")'


def _daily_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact daily sums: series of every frequency come from this one aggregation, whose shuffle they share."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.groupBy(F.col("o_orderdate").cast("date").alias("d")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("v"))


def daily(spark: SparkSession, sf_dir: str, nulls: bool = False) -> DataFrame:
    """Daily order totals; with ``nulls`` those of days divisible by 7 are missing."""
    d = _daily_sums(spark, sf_dir).withColumn("v", F.col("v").cast("double"))
    v = F.when(F.dayofmonth("d") % 7 != 0, F.col("v")) if nulls else F.col("v")
    return d.select(F.lit("daily_nulls" if nulls else "daily").alias("series_key"), F.lit(0).cast("long").alias("pos"), "d", v.alias("v"))


def daily_sql(nulls: bool = False) -> str:
    v = "sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE"
    value = f"CASE WHEN day(CAST(o_orderdate AS DATE)) % 7 <> 0 THEN {v} END" if nulls else v
    return f"SELECT CAST(o_orderdate AS DATE) AS d, {value} AS v FROM orders GROUP BY 1"


TRUNC = {"M": "month", "Q": "quarter", "A": "year"}


def periodic(spark: SparkSession, sf_dir: str, freq: str, nulls: bool = False) -> DataFrame:
    """Order totals by month, quarter or year; with ``nulls`` every fifth month's is missing."""
    d = _daily_sums(spark, sf_dir).groupBy(F.trunc("d", TRUNC[freq]).cast("date").alias("d")).agg(F.sum("v").cast("double").alias("v"))
    v = F.when(F.month("d") % 5 != 0, F.col("v")) if nulls else F.col("v")
    return d.select(F.lit({"M": "monthly", "Q": "quarterly", "A": "yearly"}[freq] + ("_nulls" if nulls else "")).alias("series_key"), F.lit(0).cast("long").alias("pos"), "d", v.alias("v"))


def periodic_sql(freq: str, nulls: bool = False) -> str:
    t = f"CAST(date_trunc('{TRUNC[freq]}', o_orderdate) AS DATE)"
    v = "sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE"
    return f"SELECT {t} AS d, {f'CASE WHEN month({t}) % 5 <> 0 THEN {v} END' if nulls else v} AS v FROM orders GROUP BY 1"


def metrics(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Registry rows; what isn't given is null."""
    names = METRICS.fieldNames()
    base = {"metric_family": "orders", "units": "usd", "transform": "identity"}
    full = [{**base, "metric_label": r["metric_id"].replace("_", " "), **r} for r in rows]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], METRICS)


def quarterly_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean order total by customer segment (the metric) and quarter (the observation): ``metric_id, obs_key, label, value, year, block, pos``.

    Even quarters are D, odd ones R; blocks are two years long, from each metric's first year.
    """
    o, c = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    day = F.col("o_orderdate").cast("date")
    q = (F.year(day) * 4 + F.quarter(day) - 1).alias("obs_key")
    t = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_mktsegment").alias("metric_id"), q).agg((F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))).alias("value"))
    year = F.expr("int(obs_key div 4)")
    block = block_id(F.make_date(year, F.lit(1), F.lit(1)), 2)
    return t.select("metric_id", "obs_key", F.when(F.col("obs_key") % 2 == 0, "D").otherwise("R").alias("label"), F.round("value", 6).alias("value"), year.alias("year"), block.alias("block"), F.col("obs_key").cast("long").alias("pos"))


QUARTERLY_SQL = """SELECT metric_id, obs_key, CASE WHEN obs_key % 2 = 0 THEN 'D' ELSE 'R' END AS label, round(value, 6) AS value, obs_key // 4 AS year, CAST(floor((obs_key // 4 - min(obs_key // 4) OVER (PARTITION BY metric_id)) / 2) AS INTEGER) AS block
FROM (SELECT c_mktsegment AS metric_id, year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS obs_key, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE / count(*) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""

__all__ = ["QUARTERLY_SQL", "TIES", "WINDOWS", "daily", "daily_sql", "metrics", "periodic", "periodic_sql", "quarterly_values", "windows", "windows_sql"]
