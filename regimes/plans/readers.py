"""Queries over the file readers: tables are written as the files that each reader takes, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import inference, quality, reports
from ..schema import TERMS
from ..sources import artefacts, series, sinks, windows
from ..tables import new_folder
from .catalogue import BH_SQL, DAYS_SQL, _bh, _days, _read, query

#: Documents that hold several people or bindings have about so many of them.
PER_DOCUMENT = 200
_DAILY = "SELECT CAST(o_orderdate AS DATE) AS d, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS v, count(*) AS n FROM orders GROUP BY 1"


def _daily(spark: SparkSession, d: str) -> DataFrame:
    o = _read(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("d"))
    return o.agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("v"), F.count(F.lit(1)).alias("n"))


def _as_csv(df: DataFrame, name: str) -> str:
    path = new_folder(df.sparkSession, name)
    df.write.csv(path, header=True, emptyValue="", nullValue="")
    return path


def _as_json(df: DataFrame, number: str, column: str, wrap: str, name: str) -> str:
    """Documents of some ``PER_DOCUMENT`` rows each, one in a line: ``column`` (structs) as JSON arrays within the text ``wrap``.

    The number of files is that of Spark's tasks, whatever the number of documents.
    """
    path = new_folder(df.sparkSession, name)
    docs = df.groupBy(F.expr(f"{number} div {PER_DOCUMENT}").alias("document")).agg(F.format_string(wrap, F.to_json(F.collect_list(column))).alias("value"))
    docs.select("value").write.text(path)
    return path


@query("read_series", f"SELECT d, CASE WHEN day(d) % 7 <> 0 THEN CAST(v AS DOUBLE) END AS v FROM ({_DAILY}) WHERE day(d) % 9 <> 0")
def read_series(spark: SparkSession, d: str) -> DataFrame:
    t = _daily(spark, d).select(F.when(F.dayofmonth("d") % 9 == 0, " ").otherwise(F.col("d").cast("string")).alias("date"), F.when(F.dayofmonth("d") % 7 == 0, ".").otherwise(F.col("v").cast("string")).alias("value"))
    return series.read_series(spark, _as_csv(t, "series"), "daily").select("d", "v")


@query("read_wide", f"SELECT 'daily.' || name AS series_key, d, x AS v FROM (SELECT d, CAST(v AS DOUBLE) AS total, CASE WHEN n > 1 THEN CAST(n AS DOUBLE) END AS orders FROM ({_DAILY})) UNPIVOT INCLUDE NULLS (x FOR name IN (total, orders))")
def read_wide(spark: SparkSession, d: str) -> DataFrame:
    t = _daily(spark, d).select(F.col("d").cast("string").alias("date"), F.col("v").alias("total"), F.when(F.col("n") > 1, F.col("n").cast("string")).otherwise("NA").alias("orders"))
    return series.read_wide(spark, _as_csv(t, "wide"), "daily").select("series_key", "d", "v")


@query("read_dated_csv", f"SELECT d, CAST(v AS DOUBLE) AS v FROM ({_DAILY}) WHERE day(d) % 5 <> 0 AND d BETWEEN DATE '1996-02-01' AND DATE '1998-01-31'")
def read_dated_csv(spark: SparkSession, d: str) -> DataFrame:
    t = _daily(spark, d).select(F.col("d").cast("string").alias("The Day"), F.when(F.dayofmonth("d") % 5 != 0, F.col("v").cast("string")).otherwise(" ").alias("Total"))
    return series.read_dated_csv(spark, _as_csv(t, "dated"), "daily", "The Day", "Total", "1996-02-01", "1998-01-31").select("d", "v")


@query("read_observations", f"SELECT d, CASE WHEN day(d) % 7 <> 0 THEN CAST(v AS DOUBLE) END AS v, DATE '2001-01-01' AS rt_start, CASE WHEN day(d) % 2 = 0 THEN DATE '2002-02-02' END AS rt_end FROM ({_DAILY})")
def read_observations(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("d").cast("string")
    o = F.struct(day.alias("date"), F.when(F.dayofmonth("d") % 7 == 0, ".").otherwise(F.col("v").cast("string")).alias("value"), F.lit("2001-01-01").alias("realtime_start"), F.when(F.dayofmonth("d") % 2 == 0, "2002-02-02").alias("realtime_end"))
    path = _as_json(_daily(spark, d).select(F.unix_date("d").alias("k"), o.alias("o")), "k", "o", '{"observations": %s}', "observations")
    return series.read_observations_json(spark, path, "daily", lines=True).select("d", "v", "rt_start", "rt_end")


@query("read_observations_between", f"SELECT d, CAST(v AS DOUBLE) AS v FROM ({_DAILY}) WHERE d BETWEEN DATE '1995-03-01' AND DATE '1996-02-29'")
def read_observations_between(spark: SparkSession, d: str) -> DataFrame:
    """Documents with times in their dates, read between two days."""
    o = F.struct(F.concat(F.col("d").cast("string"), F.lit("T05:00:00")).alias("date"), F.col("v").cast("string").alias("value"))
    path = _as_json(_daily(spark, d).select(F.unix_date("d").alias("k"), o.alias("o")), "k", "o", '{"observations": %s}', "observations")
    return series.read_observations_json(spark, path, "daily", "1995-03-01", "1996-02-29", lines=True).select("d", "v")


@query("read_graph_csv", f"SELECT d, CASE WHEN day(d) % 7 <> 0 THEN CAST(v AS DOUBLE) END AS v FROM ({_DAILY})")
def read_graph_csv(spark: SparkSession, d: str) -> DataFrame:
    t = _daily(spark, d).select(F.col("d").cast("string").alias("DATE"), F.when(F.dayofmonth("d") % 7 == 0, ".").otherwise(F.col("v").cast("string")).alias("ORDERS"))
    return series.read_graph_csv(spark, _as_csv(t, "graph"), "daily", "ORDERS").select("d", "v")


@query("read_factors", f"SELECT 'f.' || name AS series_key, d, x AS v FROM (SELECT date_trunc('month', d)::DATE AS d, CASE WHEN month(any_value(d)) % 4 <> 0 THEN CAST(sum(v) AS DOUBLE) END AS a, CAST(sum(n) AS DOUBLE) AS b FROM ({_DAILY}) GROUP BY 1) UNPIVOT INCLUDE NULLS (x FOR name IN (a, b))")
def read_factors(spark: SparkSession, d: str) -> DataFrame:
    """A text file for each year, with a preamble, a table of months, and another table after a blank line."""
    m = _daily(spark, d).groupBy(F.trunc("d", "month").alias("m")).agg(F.sum("v").alias("a"), F.sum("n").alias("b"))
    line = F.concat_ws(", ", F.date_format("m", "yyyyMM"), F.when(F.month("m") % 4 == 0, "-99.99").otherwise(F.col("a").cast("string")), F.col("b").cast("string"))
    path = new_folder(spark, "factors")
    text = F.concat(F.lit("Made from orders\n\n,a,b\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n"), F.lit("\n\n  Yearly\n199512, 1, 2"))
    m.groupBy(F.year("m").alias("year")).agg(text.alias("value")).write.partitionBy("year").text(path, lineSep="\u0001")
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return series.factor_lines(files.select(F.replace("value", F.lit("\u0001"), F.lit("")).alias("value")), "f", ["a", "b"]).select("series_key", "d", "v")


_TERMS_SQL = f'SELECT CAST(person AS VARCHAR) || \'-\' || CAST("start" AS VARCHAR) AS term_id, replace(label, \'e\', \' \') AS president, CASE WHEN label = \'view\' THEN \'Other\' WHEN label = \'click\' THEN \'D\' ELSE \'R\' END AS party_abbrev, "start" AS term_start, "end" AS term_end FROM ({DAYS_SQL})'


@query("read_terms", _TERMS_SQL)
def read_terms(spark: SparkSession, d: str) -> DataFrame:
    """Windows written as the terms file and read back: commas in names become spaces, a blank label is Other."""
    t = _days(spark, d)
    named = {
        "term_id": F.concat_ws("-", F.col("person").cast("string"), F.col("start").cast("string")), "president": F.translate("label", "e", ","),
        "party_abbrev": F.when(F.col("label") == "view", None).when(F.col("label") == "click", "D").otherwise("R"), "term_start": F.col("start"), "term_end": F.col("end"),
    }
    path = new_folder(spark, "terms")
    sinks.write_terms(t.select(*[named.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in TERMS.fields]), path)
    return windows.read_terms(spark, path).select("term_id", "president", "party_abbrev", "term_start", "term_end")


@query("read_legislators", """SELECT 'Q' || o_custkey AS person, c_name AS president, CASE WHEN o_orderkey % 3 = 0 THEN 'Democratic' ELSE 'Whig' END AS party, CASE WHEN o_orderkey % 3 = 0 THEN 'D' ELSE 'Other' END AS label,
CAST(o_orderdate AS DATE) AS "start", CASE WHEN o_orderkey % 4 = 0 THEN DATE '9999-12-31' ELSE CAST(o_orderdate AS DATE) + 30 END AS "end" FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 5 <> 0""")
def read_legislators(spark: SparkSession, d: str) -> DataFrame:
    o, c = _read(spark, d, "orders"), _read(spark, d, "customer")
    day, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    term = F.struct(F.when(k % 5 == 0, "rep").otherwise("prez").alias("type"), day.cast("string").alias("start"), F.when(k % 4 != 0, F.date_add(day, 30).cast("string")).alias("end"), F.when(k % 3 == 0, "Democratic").otherwise("Whig").alias("party"))
    people = o.join(c, o.o_custkey == c.c_custkey).groupBy("o_custkey").agg(F.min("c_name").alias("name"), F.collect_list(term).alias("terms"))
    person = F.struct(F.struct(F.concat(F.lit("Q"), F.col("o_custkey").cast("string")).alias("wikidata")).alias("id"), F.struct(F.col("name").alias("official_full")).alias("name"), "terms")
    path = _as_json(people.select("o_custkey", person.alias("p")), "o_custkey", "p", "%s", "people")
    return windows.read_legislators(spark, path, lines=True).select("person", "president", "party", "label", "start", "end")


@query("read_bindings", """SELECT 'Q' || o_custkey AS person, any_value(c_name) AS president, CASE WHEN bool_or(o_orderkey % 3 = 0) THEN 'D' WHEN bool_or(o_orderkey % 3 = 1) THEN 'R' ELSE 'Other' END AS label,
CAST(o_orderdate AS DATE) AS "start", CAST(o_orderdate AS DATE) + 30 AS "end" FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey, 4, 5""")
def read_bindings(spark: SparkSession, d: str) -> DataFrame:
    o, c = _read(spark, d, "orders"), _read(spark, d, "customer")
    day, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    value = lambda v: F.struct(v.cast("string").alias("value"))
    party = F.when(k % 3 == 0, "http://x/entity/Q29552").when(k % 3 == 1, "http://x/entity/Q29468").otherwise("http://x/entity/Q1")
    b = F.struct(value(F.concat(F.lit("http://x/entity/Q"), F.col("o_custkey").cast("string"))).alias("person"), value(F.col("c_name")).alias("personLabel"), value(party).alias("party"), value(day).alias("start"), value(F.date_add(day, 30)).alias("end"))
    rows = o.join(c, o.o_custkey == c.c_custkey).select("o_custkey", b.alias("b"))
    return windows.read_bindings(spark, _as_json(rows, "o_custkey", "b", '{"results": {"bindings": %s}}', "bindings"), lines=True).select("person", "president", "label", "start", "end")


@query("read_metadata", "SELECT CAST(p_partkey AS VARCHAR) AS series_id, trim(p_name) AS title, p_brand AS frequency, p_type AS units, CASE WHEN p_size % 2 = 0 THEN 'SA' END AS seasonal_adjustment FROM part")
def read_metadata(spark: SparkSession, d: str) -> DataFrame:
    text = {"id": F.col("p_partkey").cast("string"), "title": F.concat(F.lit("  "), "p_name", F.lit(" ")), "frequency_short": F.col("p_brand"), "units": F.col("p_type"), "seasonal_adjustment_short": F.when(F.col("p_size") % 2 == 0, "SA")}
    p = _read(spark, d, "part").select("p_partkey", F.struct(*[v.alias(k) for k, v in text.items()]).alias("s"))
    return series.read_series_metadata(spark, _as_json(p, "p_partkey", "s", '{"seriess": %s}', "metadata"), lines=True)


@query("csv_single_file", f"SELECT 'd,mean,n' AS line UNION ALL SELECT d || ',' || printf('%.6f', CAST(v AS DOUBLE) / n) || ',' || n FROM ({_DAILY})")
def csv_single_file(spark: SparkSession, d: str) -> DataFrame:
    """Daily means written as one ordered file with six decimals, and the file's lines."""
    path = f"{new_folder(spark, 'csv')}/daily.csv"
    sinks.write_csv_file(_daily(spark, d).select("d", (F.col("v").cast("double") / F.col("n")).alias("mean"), "n"), path, ["d"])
    return spark.read.text(path).select(F.col("value").alias("line"))


_STORED_SQL = "SELECT '/raw/' || (user_id % 50) AS folder, lpad(CAST(event_id * 7919 % 99991 AS VARCHAR), 8, '0') || '__sha256_' || md5(CAST(event_id AS VARCHAR)) || CASE WHEN event_id % 3 = 0 THEN '.csv.meta.json' ELSE '.csv' END AS name FROM events"


@query("latest_artefacts", f"SELECT folder, folder || '/' || max(name) AS path FROM ({_STORED_SQL}) WHERE name NOT LIKE '%.meta.json' GROUP BY folder")
def latest_artefacts(spark: SparkSession, d: str) -> DataFrame:
    """Stored documents named by stamp and digest, with side files: the last of each folder."""
    key = F.col("event_id")
    stamp = F.lpad((key * 7919 % 99991).cast("string"), 8, "0")
    name = F.concat(stamp, F.lit("__sha256_"), F.md5(key.cast("string").cast("binary")), F.when(key % 3 == 0, ".csv.meta.json").otherwise(".csv"))
    return artefacts.latest(_read(spark, d, "events").select(F.concat_ws("/", F.lit("/raw"), (F.col("user_id") % 50).cast("string"), name).alias("path")))


# Keyed scans, order of ties, blocks, and checks of whole inputs.


@query("keyed_scan_last", "SELECT trim(k) AS k, max(pos) AS pos, arg_max(v, pos) AS v FROM (SELECT CASE WHEN user_id % 10 = 0 THEN ' ' ELSE ' u' || (user_id % 500) || ' ' END AS k, event_id AS pos, value AS v FROM events) WHERE trim(k) <> '' GROUP BY 1")
def keyed_scan_last(spark: SparkSession, d: str) -> DataFrame:
    k = F.when(F.col("user_id") % 10 == 0, " ").otherwise(F.concat(F.lit(" u"), (F.col("user_id") % 500).cast("string"), F.lit(" ")))
    e = _read(spark, d, "events").select(k.alias("k"), F.col("event_id").alias("pos"), F.col("value").alias("v"))
    return reports.last_rows(e, "k", keep_pos=True).select("k", "pos", "v")


@query("first_appearance_order", BH_SQL + ", f AS (SELECT CAST(p_size AS VARCHAR) || ':' || p_brand AS metric_id, min(p_partkey) AS pos FROM part GROUP BY 1) SELECT metric_id, row_number() OVER (ORDER BY round(q, 2) NULLS LAST, pos) AS place FROM q JOIN f USING (metric_id)")
def first_appearance_order(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat_ws(":", F.col("p_size").cast("string"), "p_brand")
    first = _read(spark, d, "part").groupBy(key.alias("metric_id")).agg(F.min("p_partkey").alias("pos"))
    return reports.placed(_bh(spark, d).withColumn("q", F.round("q", 2)), first).select("metric_id", F.col("place").cast("long").alias("place"))


@query("block_ids", """SELECT o_custkey AS metric_id, o_orderkey AS obs_key, CASE WHEN y IS NULL THEN -1 ELSE (y - min(y) OVER (PARTITION BY o_custkey)) // 2 END AS block
FROM (SELECT *, CASE WHEN o_orderkey % 7 <> 0 THEN year(o_orderdate) END AS y FROM orders)""")
def block_ids(spark: SparkSession, d: str) -> DataFrame:
    o = _read(spark, d, "orders").select(F.col("o_custkey").alias("metric_id"), F.col("o_orderkey").alias("obs_key"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate").cast("date")).alias("start"))
    return o.select("metric_id", "obs_key", inference.block_id(F.col("start"), 2).cast("long").alias("block"))


_SEEN_SQL = "SELECT c_mktsegment AS party_abbrev, o_custkey AS metric_id, o_orderkey AS term_id FROM orders JOIN customer ON o_custkey = c_custkey"


@query("distinct_counts", f"SELECT count(DISTINCT metric_id) AS metric_id, count(DISTINCT term_id) AS term_id, count(DISTINCT party_abbrev) AS party_abbrev FROM ({_SEEN_SQL})")
def distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    o, c = _read(spark, d, "orders"), _read(spark, d, "customer")
    seen = o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_mktsegment").alias("party_abbrev"), F.col("o_custkey").alias("metric_id"), F.col("o_orderkey").alias("term_id"))
    return quality.distinct_counts(seen, ["metric_id", "term_id", "party_abbrev"])


@query("dq_roll_up", """WITH t AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE 't' || (o_orderkey // 2) END AS id, o_orderkey % 13 = 0 AS odd FROM orders),
i AS (SELECT 'ERROR' AS level FROM t WHERE id = '' UNION ALL SELECT 'ERROR' FROM (SELECT id FROM t WHERE id <> '' GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'WARN' FROM t WHERE odd
  UNION ALL SELECT 'ERROR' FROM (VALUES (1)) WHERE NOT EXISTS (SELECT * FROM orders WHERE o_orderkey < 0))
SELECT count(*) FILTER (level = 'ERROR') AS n_errors, count(*) FILTER (level = 'WARN') AS n_warnings, CASE WHEN count(*) FILTER (level = 'ERROR') > 0 THEN 1 ELSE 0 END AS status FROM i""")
def dq_roll_up(spark: SparkSession, d: str) -> DataFrame:
    """Issues of windows and of an empty table, and their roll-up."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    o = _read(spark, d, "orders")
    t = o.select(F.when(k % 10 == 0, " ").otherwise(F.concat(F.lit("t"), F.expr("o_orderkey div 2").cast("string"))).alias("term_id"), F.when(k % 13 == 0, "X").otherwise("D").alias("label"), day.cast("string").alias("start"), F.date_add(day, 30).cast("string").alias("end"))
    return quality.roll_up(quality.window_issues(t).unionByName(quality.input_issues(o.where(k < 0), "orders below 0")).unionByName(quality.input_issues(o, "orders")))


@query("dq_input_issues", "SELECT name || ': ' || CASE WHEN n = 0 THEN 'empty input' ELSE 'missing input' END AS message FROM (SELECT 'none' AS name, count(*) AS n FROM events WHERE event_id < 0 UNION ALL SELECT 'all', count(*) FROM events UNION ALL SELECT 'gone', NULL) WHERE n IS NULL OR n = 0")
def dq_input_issues(spark: SparkSession, d: str) -> DataFrame:
    e = _read(spark, d, "events")
    found = [quality.input_issues(x, name) for x, name in ((e.where("event_id < 0"), "none"), (e, "all"), (quality.table_or_none(spark, f"{d}/no-such-table.parquet"), "gone"))]
    return found[0].unionByName(found[1]).unionByName(found[2] if found[2] is not None else found[1].limit(0)).select("message")


@query("dq_unknown_series", "SELECT DISTINCT l_partkey AS series_key FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size % 9 <> 0)")
def dq_unknown_series(spark: SparkSession, d: str) -> DataFrame:
    metrics = _read(spark, d, "lineitem").select(F.col("l_partkey").alias("series_key"))
    known = _read(spark, d, "part").where("p_size % 9 <> 0").select(F.col("p_partkey").alias("series_key"))
    return quality.unknown_series(metrics, known)
