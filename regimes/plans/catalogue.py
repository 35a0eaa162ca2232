"""The registered queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.expressions import derive
from ..operators import aggregates, attribution, inference, quality, reports, spells, transforms
from ..operators.percentiles import percentiles, selected
from ..streaming.series import daily_series
from ..tables import kept
from . import inputs, metric_sql
from .inputs import TIES, WINDOWS

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _read(spark: SparkSession, d: str, t: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{t}.parquet")


def _series(spark: SparkSession, d: str, key: str) -> DataFrame:
    nulls = key.endswith("_nulls")
    if key.startswith("daily"):
        return inputs.daily(spark, d, nulls)
    return inputs.periodic(spark, d, {"monthly": "M", "quarterly": "Q", "yearly": "A"}[key.removesuffix("_nulls")], nulls)


def _all_series(spark: SparkSession, d: str, keys: set[str]) -> DataFrame:
    parts = [_series(spark, d, k) for k in sorted(keys)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Scans, parsing and projections.


@query("scan_missing_tokens", """SELECT event_id, CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 THEN NULL ELSE value END AS v, CAST(substr(strftime(ts, '%Y-%m-%d %H:%M:%S'), 1, 10) AS DATE) AS d FROM events""")
def scan_missing_tokens(spark: SparkSession, d: str) -> DataFrame:
    e = _read(spark, d, "events")
    text = F.when(F.col("event_id") % 11 == 0, " . ").when(F.col("event_id") % 13 == 0, "n/a").otherwise(F.col("value").cast("string"))
    return e.select("event_id", S.parse_number(text).alias("v"), S.parse_date(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("d"))


@query("pushdown_date_filter", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_totalprice AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1997-12-31'")
def pushdown_date_filter(spark: SparkSession, d: str) -> DataFrame:
    o = _read(spark, d, "orders").where("o_orderdate >= timestamp_ntz'1996-01-01' AND o_orderdate <= timestamp_ntz'1997-12-31'")
    return o.select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"), F.col("o_totalprice").alias("v"))


@query("json_flatten_events", "SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events")
def json_flatten_events(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").alias("k"))


@query("derived_column_expr", """SELECT l_orderkey, l_linenumber, round(net, 6) AS net, round(CASE WHEN l_discount <> 0 THEN net / l_discount END, 6) AS ratio, NULL::DOUBLE AS unknown, NULL::DOUBLE AS refused
FROM (SELECT *, l_extendedprice * (1 - l_discount) + -l_tax AS net FROM lineitem)""")
def derived_column_expr(spark: SparkSession, d: str) -> DataFrame:
    t = derive(_read(spark, d, "lineitem"), {"net": "l_extendedprice * (1 - l_discount) + -l_tax", "ratio": "net / l_discount", "unknown": "net + no_such_column", "refused": "abs(net)"})
    return t.select("l_orderkey", "l_linenumber", F.round("net", 6).alias("net"), F.round("ratio", 6).alias("ratio"), "unknown", "refused")


@query("period_bounds", " UNION ALL ".join(f"SELECT d, '{f}' AS freq, {a} AS p_start, {b} AS p_end FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)" for f, (a, b) in metric_sql.PERIODS.items()))
def period_bounds(spark: SparkSession, d: str) -> DataFrame:
    days = _read(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    t = days.withColumn("freq", F.explode(F.array(*[F.lit(x) for x in metric_sql.PERIODS])))
    p = S.period(F.col("d"), F.when(F.col("freq") == "FY", "A").otherwise(F.col("freq")), F.when(F.col("freq") == "FY", "us_fiscal_year"))
    return t.withColumn("p", p).select("d", "freq", F.col("p.start").alias("p_start"), F.col("p.end").alias("p_end"))


@query("label_cleanup", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN trim(p_name) WHEN p_partkey % 3 = 1 THEN '(x) ' || p_name ELSE p_name END AS label, replace(p_name || '|' || p_brand, '|', '\\|') AS escaped,
CASE WHEN p_partkey % 2 = 0 THEN '[' || p_size || ', ' || (p_size + 1) || ']' ELSE '' END AS ci FROM part""")
def label_cleanup(spark: SparkSession, d: str) -> DataFrame:
    p = _read(spark, d, "part")
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("(x) "), "p_name")).otherwise(F.col("p_name"))
    high = F.when(F.col("p_partkey") % 2 == 0, F.col("p_size") + 1)
    return p.select("p_partkey", S.clean_label(raw).alias("label"), S.md_escape(F.concat("p_name", F.lit("|"), "p_brand")).alias("escaped"), S.interval_text(F.col("p_size"), high).alias("ci"))


@query("url_redact", """SELECT page_id, regexp_replace(url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'API_KEY=s' || page_id || '&v=1', '(?i)([?&](?:api_key|apikey|key|token)=)[^&#]*', '\\1REDACTED', 'g') AS url,
regexp_extract(rtrim(url, '/'), '[^/]*$') AS last, sha256(url) AS hash FROM pages""")
def url_redact(spark: SparkSession, d: str) -> DataFrame:
    url = F.concat("url", F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit("API_KEY=s"), F.col("page_id").cast("string"), F.lit("&v=1"))
    return _read(spark, d, "pages").select("page_id", S.redact_url(url).alias("url"), S.last_segment(F.col("url")).alias("last"), S.content_hash(F.col("url")).alias("hash"))


NORMALIZE = "trim(regexp_replace(array_to_string(list_transform(string_split(replace(replace({t}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: trim(regexp_replace(x, '[ \\t\\v\\f]+', ' ', 'g'), ' ')), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10) || ' ')"


@query("text_normalize", f"SELECT doc_id, sha256({NORMALIZE.format(t='text')}) AS text_hash, length({NORMALIZE.format(t='text')}) AS n FROM documents")
def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    t = _read(spark, d, "documents").withColumn("t", S.normalize_text(F.col("text")))
    return t.select("doc_id", S.content_hash(F.col("t")).alias("text_hash"), F.char_length("t").cast("long").alias("n"))


_HTML = "html"
for _a, _b in ((r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>", "' '"), ("(?s)<!--.*?-->", "' '"), (r"(?i)<br\s*/?>|</(?:p|div|li|h[1-6]|tr|table|section|article)\s*>", "chr(10)"), ("(?s)<[^>]*>", "' '")):
    _HTML = f"regexp_replace({_HTML}, '{_a}', {_b}, 'g')"
for _a, _b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _HTML = f"replace({_HTML}, '{_a}', '{_b}')"


@query("html_strip", f"SELECT page_id, sha256({NORMALIZE.format(t=_HTML)}) AS text_hash FROM pages")
def html_strip(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "pages").select("page_id", S.content_hash(S.strip_html(F.col("html"))).alias("text_hash"))


_PLAIN = "regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')"
_MAIN = "coalesce(" + ", ".join(rf"nullif(regexp_extract({_PLAIN}, '(?is)<{c}\b[^>]*>(.*?)</{c}\s*>', 1), '')" for c in S.CONTAINERS) + f", {_PLAIN})"
for _a in S.BOILERPLATE:
    _MAIN = rf"regexp_replace({_MAIN}, '(?is)<{_a}\b.*?</{_a}\s*>', ' ', 'g')"


@query("html_main", f"SELECT page_id, sha256({_MAIN}) AS main_hash FROM pages")
def html_main(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "pages").select("page_id", S.content_hash(S.main_html(F.col("html"))).alias("main_hash"))


@query("first_nonempty_line", "SELECT doc_id, substr(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')[1], 1, 160) AS title FROM documents")
def first_nonempty_line(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "documents").select("doc_id", S.first_line(F.col("text")).alias("title"))


@query("party_mapping", "SELECT doc_id, CASE lang WHEN 'en' THEN 'D' WHEN 'fr' THEN 'R' WHEN 'de' THEN 'D' ELSE 'Other' END AS label, CASE lang WHEN 'en' THEN 'Daily' WHEN 'fr' THEN 'Monthly' ELSE lang END AS freq, CASE WHEN doc_id % 2 = 0 THEN source ELSE lang END AS filled FROM documents")
def party_mapping(spark: SparkSession, d: str) -> DataFrame:
    lang = F.col("lang")
    qid = F.when(lang == "en", "Q29552").otherwise("")
    name = F.when(lang == "fr", " Republican ").when(lang == "de", "DEMOCRAT").otherwise(lang)
    code = F.when(lang == "en", "D").when(lang == "fr", "M").otherwise(lang)
    some = F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("")
    return _read(spark, d, "documents").select("doc_id", S.party_label(qid, name).alias("label"), S.frequency_label(code).alias("freq"), S.first_filled(some, F.lit(None), F.col("lang")).alias("filled"))


# Resampling and transforms.

for _how, _agg in (("eop", "arg_max(v, d) FILTER (v IS NOT NULL)"), ("avg", "avg(v)")):

    def _resample(spark: SparkSession, d: str, how: str = _how) -> DataFrame:
        return transforms.resample_month(_series(spark, d, "daily_nulls"), how).select("d", F.round("v", 6).alias("v"))

    query(f"resample_month_{_how}", f"SELECT CAST(date_trunc('month', d) AS DATE) AS d, round({_agg}, 6) AS v FROM ({metric_sql.SERIES['daily_nulls']}) GROUP BY 1")(_resample)

TRANSFORMS = {
    "transform_identity": {}, "transform_pct_change_lag1": {"transform": "pct_change"}, "transform_pct_change_lag12": {"transform": "pct_change", "lag": 12, "scale": 100.0},
    "transform_logdiff_ann4": {"transform": "growth_rate", "annualize": 4.0}, "transform_logdiff_ann12": {"transform": "growth_rate", "annualize": 12.0, "scale": 100.0}, "transform_indicator_lt": {"transform": "indicator_lt", "threshold": 25000000.0},
}
for _name, _p in TRANSFORMS.items():

    def _transform(spark: SparkSession, d: str, p: dict = _p) -> DataFrame:
        m = inputs.metrics(spark, [{"metric_id": "m", "series_key": "monthly_nulls", "freq": "M", "agg_kind": "mean", **p}])
        return aggregates.observe(_series(spark, d, "monthly_nulls"), m).select("d", F.round("v", 6).alias("v"))

    query(_name, f"SELECT d, round(v, 6) AS v FROM ({metric_sql.transformed('monthly_nulls', **{('kind' if k == 'transform' else k): v for k, v in _p.items()})})")(_transform)


# Attribution.

ATTRIBUTIONS = {
    "attrib_daily_instant": ("daily", "D", None, WINDOWS, "period_end"), "attrib_month_majority": ("monthly", "M", None, WINDOWS, "period_end"), "attrib_quarter_majority": ("quarterly", "Q", None, WINDOWS, "period_end"),
    "attrib_year_majority": ("yearly", "A", None, WINDOWS, "period_end"), "attrib_fiscal_year": ("yearly", "A", "us_fiscal_year", WINDOWS, "period_end"),
    "attrib_tie_period_end": ("monthly", "M", None, TIES, "period_end"), "attrib_tie_latest_start": ("monthly", "M", None, TIES, "latest_start"),
}
for _name, (_s, _f, _k, _w, _t) in ATTRIBUTIONS.items():

    def _attrib(spark: SparkSession, d: str, s: str = _s, f: str = _f, k: str | None = _k, w: list = _w, t: str = _t) -> DataFrame:
        m = inputs.metrics(spark, [{"metric_id": "m", "series_key": s, "freq": f, "period_kind": k, "agg_kind": "mean"}])
        return aggregates.attribute(aggregates.observe(_series(spark, d, s), m), inputs.windows(spark, w), t).select("d", F.round("v", 6).alias("v"), "wid")

    query(_name, f"SELECT d, round(v, 6) AS v, wid FROM ({metric_sql.attributed(metric_sql.SERIES[_s], 'FY' if _k else _f, inputs.windows_sql(_w), _t)})")(_attrib)


@query("boundary_asof_strictly_before", f"""WITH s AS ({metric_sql.SERIES['daily_nulls']}), m AS (SELECT DISTINCT "start" AS mark FROM ({inputs.windows_sql()}))
SELECT mark, max(d) AS d, arg_max(v, d) AS v FROM m JOIN s ON d < mark AND v IS NOT NULL GROUP BY mark""")
def boundary_asof(spark: SparkSession, d: str) -> DataFrame:
    marks = inputs.windows(spark).select(F.lit("daily_nulls").alias("series_key"), F.col("start").alias("mark"))
    return attribution.before_boundaries(_series(spark, d, "daily_nulls"), marks).select("mark", "d", "v")


# Term metrics.

METRICS = [
    {"metric_id": "agg_mean", "series_key": "monthly_nulls", "agg_kind": "mean"}, {"metric_id": "agg_mean_post_scale", "series_key": "daily", "freq": "D", "transform": "indicator_lt", "threshold": 800000.0, "agg_kind": "mean", "post_scale": 100.0},
    {"metric_id": "agg_last", "series_key": "monthly_nulls", "agg_kind": "last"}, {"metric_id": "agg_end_minus_start", "series_key": "monthly_nulls", "agg_kind": "end_minus_start"},
    {"metric_id": "agg_per_year", "series_key": "quarterly", "freq": "Q", "agg_kind": "end_minus_start_per_year"}, {"metric_id": "agg_pct_change", "series_key": "monthly", "agg_kind": "pct_change_from_levels"},
    {"metric_id": "agg_cagr", "series_key": "monthly", "agg_kind": "cagr_from_levels", "agg_scale": 100.0},
    {"metric_id": "agg_fiscal_mean", "series_key": "yearly", "freq": "A", "period_kind": "us_fiscal_year", "fy_month": 10, "fy_day": 1, "agg_kind": "mean"},
    *[{"metric_id": f"agg_daily_{n}", "series_key": "daily_nulls", "freq": "D", "agg_kind": k} for n, k in (("end_minus_start", "end_minus_start"), ("per_year", "end_minus_start_per_year"), ("pct_change", "pct_change_from_levels"), ("cagr", "cagr_from_levels"))],
    {"metric_id": "agg_mean_times_ppy", "series_key": "monthly", "transform": "pct_change", "agg_kind": "mean_times_periods_per_year", "ppy": 12.0}, {"metric_id": "agg_compound_total", "series_key": "monthly", "transform": "pct_change", "agg_kind": "compound_total"},
    {"metric_id": "agg_compound_annualized", "series_key": "monthly", "transform": "pct_change", "agg_kind": "compound_annualized", "ppy": 12.0}, {"metric_id": "agg_std", "series_key": "monthly", "transform": "pct_change", "agg_kind": "annualized_std", "ppy": 12.0},
    {"metric_id": "agg_sharpe", "series_key": "monthly", "transform": "pct_change", "agg_kind": "sharpe_ratio_annualized", "ppy": 12.0},
    {"metric_id": "agg_count_transitions", "series_key": "daily_nulls", "freq": "D", "transform": "indicator_lt", "threshold": 800000.0, "agg_kind": "count_transitions", "from_value": 0.0, "to_value": 1.0},
    {"metric_id": "agg_logdiff_mean", "series_key": "quarterly", "freq": "Q", "transform": "growth_rate", "annualize": 4.0, "agg_kind": "mean"}, {"metric_id": "agg_no_ppy", "series_key": "monthly", "agg_kind": "annualized_std"},
]
METRICS = [{"freq": "M", **m} for m in METRICS]


def term_table(spark: SparkSession, d: str, rows: list[dict]) -> DataFrame:
    series = _all_series(spark, d, {m["series_key"] for m in rows})
    return aggregates.term_metrics(series, inputs.metrics(spark, rows), inputs.windows(spark))


def _short(t: DataFrame) -> DataFrame:
    return t.select("metric_id", "term_id", "party_abbrev", F.round("value", 6).alias("value"), "n_obs", "error")


for _m in METRICS:

    def _agg(spark: SparkSession, d: str, m: dict = _m) -> DataFrame:
        return _short(term_table(spark, d, [m]))

    query(_m["metric_id"], f"SELECT * FROM {metric_sql.metric(_m)}")(_agg)

FULL_SQL = " UNION ALL ".join(f"SELECT * FROM {metric_sql.metric(m)}" for m in METRICS)


@query("term_metrics_full", FULL_SQL)
def term_metrics_full(spark: SparkSession, d: str) -> DataFrame:
    return _short(term_table(spark, d, METRICS))


SUMMARY_SQL = f"SELECT party_abbrev, metric_id, count(*) AS n_terms, round(avg(value), 6) AS mean, round(median(value), 6) AS median FROM ({FULL_SQL}) WHERE value IS NOT NULL GROUP BY 1, 2"


@query("party_summary", SUMMARY_SQL)
def party_summary(spark: SparkSession, d: str) -> DataFrame:
    s = aggregates.party_summary(term_table(spark, d, METRICS))
    return s.select("party_abbrev", "metric_id", "n_terms", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"))


# Inference.

@query("diff_of_means", f"SELECT metric_id, count(*) FILTER (label = 'D') AS n_d, count(*) FILTER (label = 'R') AS n_r, round(avg(value) FILTER (label = 'D') - avg(value) FILTER (label = 'R'), 6) AS diff FROM ({inputs.QUARTERLY_SQL}) GROUP BY 1")
def diff_of_means(spark: SparkSession, d: str) -> DataFrame:
    t = aggregates.diff_of_means(inputs.quarterly_values(spark, d), ["metric_id"], "label")
    return t.select("metric_id", "n_d", "n_r", F.round("diff", 6).alias("diff"))


@query("pop_std", "SELECT o_orderpriority AS k, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS sd FROM orders GROUP BY 1")
def pop_std(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("k")).agg(F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.stddev_pop("o_totalprice"), 4).alias("sd"))


@query("percentile_by_counts", "SELECT l_returnflag AS k, quantile_cont(l_quantity, 0.5) AS median, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90 FROM lineitem GROUP BY 1")
def percentile_by_counts(spark: SparkSession, d: str) -> DataFrame:
    t = _read(spark, d, "lineitem").withColumnRenamed("l_returnflag", "k")
    a, b = selected(t, ["k"], "l_quantity", [0.5], "a"), selected(t, ["k"], "l_extendedprice", [0.9], "b")
    return a.join(b, "k").select("k", F.col("a")[0].alias("median"), F.round(F.col("b")[0], 6).alias("p90"))


@query("percentile_type7", "SELECT event_type AS k, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.3), 6) AS p30, round(quantile_cont(value, 0.975), 6) AS high FROM events GROUP BY 1")
def percentile_type7(spark: SparkSession, d: str) -> DataFrame:
    q = percentiles(_read(spark, d, "events").select(F.col("event_type").alias("k"), "value"), ["k"], "value", [0.025, 0.3, 0.975])
    return q.select("k", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("low", "p30", "high"))])


def _draw(*parts: str) -> str:
    return "('0x' || substr(md5(" + " || ':' || ".join(parts) + "), 1, 8))::BIGINT"


def _perm_sql(block: str, n: int, source: str = inputs.QUARTERLY_SQL) -> str:
    mean = lambda c: f"(sum(CAST(value AS DECIMAL(38,6))) FILTER ({c}))::DOUBLE / nullif(count(*) FILTER ({c}), 0)"
    return f"""WITH q AS (SELECT metric_id, obs_key, label, value, {block} AS block FROM ({source})),
x AS (SELECT *, count(*) FILTER (label = 'D') OVER (PARTITION BY metric_id, block) AS in_d FROM q),
p AS (SELECT metric_id, b, value, row_number() OVER (PARTITION BY metric_id, b, block ORDER BY {_draw("'42'", 'metric_id', "'perm'", 'b', 'obs_key')}, obs_key) <= in_d AS is_d FROM x, range(1, {n + 1}) t(b)),
f AS (SELECT metric_id, b, {mean('is_d')} - {mean('NOT is_d')} AS diff FROM p GROUP BY 1, 2),
o AS (SELECT metric_id, count(*) AS n_obs, count(*) FILTER (label = 'D') AS n_d, count(*) FILTER (label = 'R') AS n_r, {mean("label = 'D'")} - {mean("label = 'R'")} AS observed FROM q GROUP BY 1)
SELECT o.metric_id, any_value(n_obs) AS n_obs, any_value(n_d) AS n_d, any_value(n_r) AS n_r, round(any_value(observed), 6) AS observed, round(avg(diff), 6) AS perm_mean, round(stddev_pop(diff), 6) AS perm_std,
round((any_value(observed) - avg(diff)) / nullif(stddev_pop(diff), 0), 4) AS z, round((1 + count(*) FILTER (abs(diff) >= abs(observed))) / (1 + count(*))::DOUBLE, 6) AS p FROM o JOIN f ON o.metric_id = f.metric_id GROUP BY o.metric_id"""


def _tested(spark: SparkSession, d: str, blocked: bool, n: int) -> DataFrame:
    obs = inputs.quarterly_values(spark, d)
    t = inference.permutation_test(obs if blocked else obs.withColumn("block", F.lit(0)), n)
    return t.select("metric_id", "n_obs", "n_d", "n_r", *[F.round(c, 6).alias(c) for c in ("observed", "perm_mean", "perm_std")], F.round("z", 4).alias("z"), F.round("p", 6).alias("p"))


@query("permutation_portable", _perm_sql("0", 10_000))
def permutation_portable(spark: SparkSession, d: str) -> DataFrame:
    return _tested(spark, d, False, 10_000)


@query("permutation_blocked", _perm_sql("block", 10_000))
def permutation_blocked(spark: SparkSession, d: str) -> DataFrame:
    return _tested(spark, d, True, 10_000)


def _boot_sql(n: int, source: str = inputs.QUARTERLY_SQL) -> str:
    return f"""WITH q AS (SELECT *, row_number() OVER (PARTITION BY metric_id, label ORDER BY obs_key) - 1 AS k, count(*) OVER (PARTITION BY metric_id, label) AS size FROM ({source})),
g AS (SELECT metric_id, label, b, {_draw("'42'", 'metric_id', "'boot'", 'label', 'b', 'k')} % size AS k FROM q, range(1, {n + 1}) t(b)),
f AS (SELECT metric_id, b, (sum(CAST(value AS DECIMAL(38,6))) FILTER (label = 'D'))::DOUBLE / count(*) FILTER (label = 'D') - (sum(CAST(value AS DECIMAL(38,6))) FILTER (label = 'R'))::DOUBLE / count(*) FILTER (label = 'R') AS diff
  FROM g JOIN q USING (metric_id, label, k) GROUP BY 1, 2)
SELECT metric_id, round(quantile_cont(diff, 0.025), 6) AS ci_low, round(quantile_cont(diff, 0.975), 6) AS ci_high FROM f GROUP BY 1"""


BOOT_SQL = _boot_sql(2_000)


@query("bootstrap_ci_portable", BOOT_SQL)
def bootstrap_ci_portable(spark: SparkSession, d: str) -> DataFrame:
    t = inference.bootstrap(inputs.quarterly_values(spark, d), 2_000)
    return t.select("metric_id", F.round("ci_low", 6).alias("ci_low"), F.round("ci_high", 6).alias("ci_high"))


@query("permutation_sequential")
def permutation_sequential(spark: SparkSession, d: str) -> DataFrame:
    return inference.sequential_test(inputs.quarterly_values(spark, d), 10_000, 2_000)


BH_SQL = """WITH t AS (SELECT CAST(p_size AS VARCHAR) || ':' || p_brand AS metric_id, CASE WHEN count(*) % 5 = 0 THEN NULL ELSE round(count(*) / (count(*) + sum(p_partkey % 97)), 6) END AS p, count(*) AS n FROM part GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY p, metric_id) AS r, count(*) OVER () AS m FROM t WHERE p IS NOT NULL),
q AS (SELECT metric_id, p, n, least(1.0, min(p * m / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM r UNION ALL SELECT metric_id, p, n, NULL FROM t WHERE p IS NULL)
"""


def _bh(spark: SparkSession, d: str) -> DataFrame:
    n = F.count(F.lit(1))
    t = _read(spark, d, "part").groupBy(F.concat_ws(":", F.col("p_size").cast("string"), "p_brand").alias("metric_id")).agg(F.when(n % 5 != 0, F.round(n / (n + F.sum(F.col("p_partkey") % 97)), 6)).alias("p"), n.alias("n"))
    return inference.false_discovery(t)


@query("bh_fdr", BH_SQL + "SELECT metric_id, p, round(q, 9) AS q FROM q")
def bh_fdr(spark: SparkSession, d: str) -> DataFrame:
    return _bh(spark, d).select("metric_id", "p", F.round("q", 9).alias("q"))


@query("evidence_tier", BH_SQL + """SELECT metric_id, CASE WHEN q < 0.3 AND n >= 2 THEN 'confirmatory' WHEN q < 0.10 AND n >= 2 THEN 'supportive' ELSE 'exploratory' END AS tier,
CASE WHEN q < 0.05 THEN 'confirmatory' WHEN q < 0.10 THEN 'supportive' ELSE 'exploratory' END AS site_tier FROM q""")
def evidence_tier(spark: SparkSession, d: str) -> DataFrame:
    return _bh(spark, d).select("metric_id", inference.evidence_tier(F.col("q"), F.col("n"), 0.3, 2).alias("tier"), inference.site_tier(F.col("q")).alias("site_tier"))


#: One full run: 10,000 shuffles and 2,000 samples of every metric's windows, discovery rates over all metrics.
RANDOMIZATION_SQL = f"""WITH terms AS MATERIALIZED (SELECT metric_id, term_id AS obs_key, party_abbrev AS label, value, CAST(year("start") AS INTEGER) AS y FROM ({FULL_SQL}) JOIN ({inputs.windows_sql()}) w ON term_id = wid WHERE party_abbrev IN ('D', 'R') AND value IS NOT NULL),
pt AS ({_perm_sql("0", 10_000, "SELECT * FROM terms")}), bt AS ({_boot_sql(2_000, "SELECT * FROM terms")}),
sizes AS (SELECT metric_id, count(*) AS n_obs, count(*) FILTER (label = 'D') AS n_d, count(*) FILTER (label = 'R') AS n_r, min(y) AS min_term_start_year, max(y) AS max_term_start_year FROM terms GROUP BY 1),
tested AS (SELECT sizes.metric_id, sizes.n_obs, sizes.n_d, sizes.n_r, min_term_start_year, max_term_start_year, observed, perm_mean, perm_std, z, p, ci_low, ci_high FROM sizes LEFT JOIN pt ON sizes.metric_id = pt.metric_id LEFT JOIN bt ON sizes.metric_id = bt.metric_id),
ranked AS (SELECT *, row_number() OVER (ORDER BY p, metric_id) AS r, count(*) OVER () AS m FROM tested WHERE p IS NOT NULL),
rated AS (SELECT metric_id, round(least(1.0, min(p * m / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM ranked)
SELECT tested.metric_id, n_obs, n_d, n_r, observed, perm_mean, perm_std, z, p, ci_low, ci_high, q, CASE WHEN q < 0.05 AND n_obs >= 12 THEN 'confirmatory' WHEN q < 0.10 AND n_obs >= 12 THEN 'supportive' ELSE 'exploratory' END AS evidence_tier,
min_term_start_year, max_term_start_year, 10000 AS permutations, 2000 AS bootstrap_samples, 42 AS seed, 0 AS block_years, 0.05::DOUBLE AS q_threshold, 12 AS min_n_threshold FROM tested LEFT JOIN rated ON tested.metric_id = rated.metric_id"""


def _kept_terms(spark: SparkSession, d: str) -> DataFrame:
    """All metrics' values by window, computed once: a row for each metric and window, in the shared folder."""
    return kept(term_table(spark, d, METRICS))


@query("term_randomization", RANDOMIZATION_SQL)
def term_randomization(spark: SparkSession, d: str) -> DataFrame:
    t = inference.randomization(_kept_terms(spark, d).withColumn("value", F.round("value", 6)))
    return t.select("metric_id", "n_obs", "n_d", "n_r", *[F.round(c, 6).alias(c) for c in ("observed", "perm_mean", "perm_std")], F.round("z", 4).alias("z"), "p", *[F.round(c, 6).alias(c) for c in ("ci_low", "ci_high")], "q", "evidence_tier",
                    "min_term_start_year", "max_term_start_year", "permutations", "bootstrap_samples", "seed", "block_years", "q_threshold", "min_n_threshold")


# Construction of windows.

SPANS_SQL = "SELECT user_id AS person, event_type AS label, CAST(ts AS DATE) AS \"start\", CAST(ts AS DATE) + 1 AS \"end\", min(event_id) AS pos FROM events GROUP BY 1, 2, 3, 4"
DAYS_SQL = f'SELECT person, min(label) AS label, "start", max("end") AS "end" FROM ({SPANS_SQL}) GROUP BY 1, 3'


def _spans(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("ts").cast("date")
    return _read(spark, d, "events").groupBy(F.col("user_id").alias("person"), F.col("event_type").alias("label"), day.alias("start"), F.date_add(day, 1).alias("end")).agg(F.min("event_id").alias("pos"))


def _days(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).groupBy("person", "start").agg(F.min("label").alias("label"), F.max("end").alias("end"))


@query("term_numbering", f'SELECT person, "start", row_number() OVER (PARTITION BY person ORDER BY "start") AS term_number FROM ({DAYS_SQL})')
def term_numbering(spark: SparkSession, d: str) -> DataFrame:
    return spells.number_terms(_days(spark, d)).select("person", "start", F.col("term_number").cast("long").alias("term_number"))


@query("merge_consecutive_windows", f"""WITH d AS ({DAYS_SQL}), n AS (SELECT *, CASE WHEN lag(label) OVER o = label AND lag("end") OVER o = "start" THEN 0 ELSE 1 END AS fresh FROM d WINDOW o AS (PARTITION BY person ORDER BY "start")),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY person ORDER BY "start") AS island FROM n), m AS (SELECT person, island, min(label) AS label, min("start") AS "start", max("end") AS "end", count(*) AS n_merged FROM i GROUP BY 1, 2)
SELECT person, label, "start", "end", n_merged, row_number() OVER (PARTITION BY person ORDER BY "start") AS term_number FROM m""")
def merge_consecutive_windows(spark: SparkSession, d: str) -> DataFrame:
    return spells.merge_consecutive(_days(spark, d)).withColumn("term_number", F.col("term_number").cast("long"))


@query("choose_preferred_label", f"""SELECT person, "start", coalesce(arg_min(label, CASE label WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END * 1000000000000 + pos) FILTER (label <> 'view'), '') AS label
FROM ({SPANS_SQL}) GROUP BY 1, 2""")
def choose_preferred_label(spark: SparkSession, d: str) -> DataFrame:
    t = _spans(spark, d).withColumn("label", F.when(F.col("label") != "view", F.col("label")).otherwise(" "))
    return spells.choose_label(t, ["person", "start"], "label", "pos", ("purchase", "signup"))


# Data quality.

@query("dq_duplicates", 'SELECT user_id, CAST(ts AS DATE) AS d, count(*) - 1 AS surplus FROM events GROUP BY 1, 2 HAVING count(*) > 1')
def dq_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return quality.duplicates(_read(spark, d, "events").select("user_id", F.col("ts").cast("date").alias("d")), ["user_id", "d"])


@query("dq_overlap_gap", f"""SELECT person, CAST(wid AS BIGINT) AS wid, CAST(next_wid AS BIGINT) AS next_wid, CASE WHEN days < 0 THEN 'overlap' ELSE 'gap' END AS kind, CAST(days AS INTEGER) AS days FROM (
SELECT person, pos AS wid, lead(pos) OVER o AS next_wid, date_diff('day', "end", lead("start") OVER o) AS days FROM ({SPANS_SQL}) WINDOW o AS (PARTITION BY person ORDER BY "start", "end", pos)) WHERE days <> 0""")
def dq_overlap_gap(spark: SparkSession, d: str) -> DataFrame:
    return quality.adjacency(_spans(spark, d), ["person"], "pos").withColumnRenamed("pos", "wid")


@query("dq_adjacency_all", f"""SELECT CAST(wid AS BIGINT) AS wid, CAST(next_wid AS BIGINT) AS next_wid, CASE WHEN days < 0 THEN 'overlap' ELSE 'gap' END AS kind, CAST(days AS INTEGER) AS days FROM (
SELECT pos AS wid, lead(pos) OVER o AS next_wid, date_diff('day', "end", lead("start") OVER o) AS days FROM ({SPANS_SQL}) WINDOW o AS (ORDER BY "start", "end", pos)) WHERE days <> 0""")
def dq_adjacency_all(spark: SparkSession, d: str) -> DataFrame:
    return quality.adjacency(_spans(spark, d), [], "pos").withColumnRenamed("pos", "wid")


@query("dq_nonnumeric", "SELECT event_id FROM events WHERE event_id % 17 = 3")
def dq_nonnumeric(spark: SparkSession, d: str) -> DataFrame:
    e = _read(spark, d, "events")
    text = F.when(F.col("event_id") % 17 == 3, F.concat(F.col("value").cast("string"), F.lit("?"))).when(F.col("event_id") % 17 == 5, " ").otherwise(F.col("value").cast("string"))
    return quality.non_numeric(e.withColumn("text", text), "text").select("event_id")


@query("dq_error_topk", f"SELECT error, count(*) AS n FROM ({FULL_SQL}) WHERE error <> '' GROUP BY 1 ORDER BY n DESC, error LIMIT 5")
def dq_error_topk(spark: SparkSession, d: str) -> DataFrame:
    return quality.error_top(term_table(spark, d, METRICS), "error", 5)


@query("dq_missing_group", """SELECT c_custkey, unnest(list_filter([CASE WHEN NOT bool_or(o_orderpriority LIKE '1%') THEN 'D' END, CASE WHEN NOT bool_or(o_orderpriority LIKE '2%') THEN 'R' END], lambda x: x IS NOT NULL)) AS missing
FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def dq_missing_group(spark: SparkSession, d: str) -> DataFrame:
    o = _read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.startswith("o_orderpriority", F.lit("1")), "D").when(F.startswith("o_orderpriority", F.lit("2")), "R").otherwise("Other").alias("party_abbrev"))
    known = _read(spark, d, "customer").select("c_custkey")
    return quality.missing_labels(o.join(known, "c_custkey"), ["c_custkey"])


_KINDS = "['end_minus_start', 'end_minus_start_per_year', 'pct_change_from_levels', 'cagr_from_levels', 'mean']"
#: Every line is a metric; the series is what one supplier delivers of one part.
_USED_SQL = f"SELECT CAST(l_suppkey AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR) AS series_key, l_suppkey, l_partkey, l_linenumber, {_KINDS}[(l_partkey + l_linenumber) % 5 + 1] AS agg_kind FROM lineitem"


def _used(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in ("end_minus_start", "end_minus_start_per_year", "pct_change_from_levels", "cagr_from_levels", "mean")])
    key = F.concat_ws(":", F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string"))
    return _read(spark, d, "lineitem").select(key.alias("series_key"), F.get(kinds, ((F.col("l_partkey") + F.col("l_linenumber")) % 5).cast("int")).alias("agg_kind"), F.col("l_linenumber").alias("turn"), F.col("l_suppkey").alias("of"))


@query("dq_symmetry", f"WITH k AS (SELECT series_key, list(DISTINCT agg_kind) AS kinds FROM ({_USED_SQL}) GROUP BY 1) " + " UNION ALL ".join(f"SELECT series_key, '{a}' AS has, '{b}' AS lacks FROM k WHERE list_contains(kinds, '{a}') AND NOT list_contains(kinds, '{b}')" for p in quality.PAIRS for a, b in (p, p[::-1])))
def dq_symmetry(spark: SparkSession, d: str) -> DataFrame:
    return quality.symmetry(_used(spark, d))


def _inflation(used: DataFrame) -> DataFrame:
    k = F.col("turn") % 4
    t = used.withColumn("agg_kind", F.lit("mean")).withColumn("transform", F.when(k == 0, "pct_change").when(k == 1, "growth_rate").otherwise("identity"))
    return t.withColumn("lag", F.when(k == 0, 12).otherwise(1)).withColumn("annualize", F.lit(12.0)).withColumn("seasonal_adjustment", F.when(F.col("of") % 3 != 0, "SA").otherwise("NSA")).withColumn("series_units", F.lit(" Index"))


@query("dq_inflation_pair", f"SELECT series_key FROM ({_USED_SQL}) WHERE l_suppkey % 3 <> 0 GROUP BY 1 HAVING bool_or(l_linenumber % 4 = 0) AND NOT bool_or(l_linenumber % 4 = 1)")
def dq_inflation_pair(spark: SparkSession, d: str) -> DataFrame:
    return quality.inflation_pairs(_inflation(_used(spark, d)))


@query("dq_windows", """WITH t AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE 't' || (o_orderkey // 2) END AS id, o_orderkey % 7 = 0 AS bad, o_orderkey % 11 = 0 AS empty, o_orderkey % 13 = 0 AS odd FROM orders)
SELECT 'ERROR' AS level, 'term_id_blank' AS check_id, count(*) AS n FROM t WHERE id = '' UNION ALL SELECT 'ERROR', 'term_id_duplicate', count(*) FROM (SELECT id FROM t WHERE id <> '' GROUP BY id HAVING count(*) > 1)
UNION ALL SELECT 'ERROR', 'bad_date', count(*) FROM t WHERE bad UNION ALL SELECT 'ERROR', 'empty_window', count(*) FROM t WHERE empty AND NOT bad UNION ALL SELECT 'WARN', 'label', count(*) FROM t WHERE odd""")
def dq_windows(spark: SparkSession, d: str) -> DataFrame:
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    t = _read(spark, d, "orders").select(
        F.when(k % 10 == 0, " ").otherwise(F.concat(F.lit("t"), F.expr("o_orderkey div 2").cast("string"))).alias("term_id"), F.when(k % 13 == 0, "X").otherwise("D").alias("label"),
        day.cast("string").alias("start"), F.when(k % 7 == 0, "soon").otherwise(F.when(k % 11 == 0, day).otherwise(F.date_add(day, 30)).cast("string")).alias("end"),
    )
    return quality.window_issues(t).groupBy("level", "check_id").agg(F.count(F.lit(1)).alias("n"))


# Reports.

CONTRAST_SQL = f"""WITH s AS (SELECT party_abbrev, metric_id, n_terms, round(mean, 6) AS mean FROM ({SUMMARY_SQL}) WHERE party_abbrev IN ('D', 'R')),
c AS (SELECT metric_id, max(n_terms) FILTER (party_abbrev = 'D') AS n_d, max(n_terms) FILTER (party_abbrev = 'R') AS n_r, max(mean) FILTER (party_abbrev = 'D') AS d_mean, max(mean) FILTER (party_abbrev = 'R') AS r_mean FROM s GROUP BY 1)
"""
def _tested_board(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The board with the tests of its own values."""
    t = _kept_terms(spark, d)
    return reports.scoreboard(aggregates.party_summary(t), inference.randomization(t)), t


@query("scoreboard", CONTRAST_SQL + f"""SELECT c.metric_id, replace(c.metric_id, '_', ' ') AS metric_label, c.n_d, c.n_r, d_mean, r_mean, round(d_mean - r_mean, 6) AS diff, q,
CASE WHEN q < 0.05 THEN 'confirmatory' WHEN q < 0.10 THEN 'supportive' ELSE 'exploratory' END AS tier FROM c LEFT JOIN ({RANDOMIZATION_SQL}) t ON c.metric_id = t.metric_id""")
def scoreboard(spark: SparkSession, d: str) -> DataFrame:
    return _tested_board(spark, d)[0].select("metric_id", "metric_label", "n_d", "n_r", "d_mean", "r_mean", "diff", "q", "tier")


@query("scoreboard_tested", CONTRAST_SQL + f"""SELECT c.metric_id, replace(c.metric_id, '_', ' ') AS metric_label, c.n_d, c.n_r, d_mean, r_mean, round(d_mean - r_mean, 6) AS diff, p, q, ci_low, ci_high,
CASE WHEN q < 0.05 THEN 'confirmatory' WHEN q < 0.10 THEN 'supportive' ELSE 'exploratory' END AS tier FROM c LEFT JOIN ({RANDOMIZATION_SQL}) t ON c.metric_id = t.metric_id""")
def scoreboard_tested(spark: SparkSession, d: str) -> DataFrame:
    return _tested_board(spark, d)[0].select("metric_id", "metric_label", "n_d", "n_r", "d_mean", "r_mean", "diff", "p", "q", "ci_low", "ci_high", "tier")


@query("term_details", f"SELECT metric_id, term_id, party_abbrev, CAST(printf('%.4f', value) AS DOUBLE) AS value FROM ({FULL_SQL}) WHERE party_abbrev IN ('D', 'R') AND error = '' AND value IS NOT NULL")
def term_details(spark: SparkSession, d: str) -> DataFrame:
    nested = reports.term_details(term_table(spark, d, METRICS)).select("metric_id", F.explode("terms").alias("t"))
    w = inputs.windows(spark).select(F.col("wid").alias("term_id"), F.col("start").cast("string").alias("s"))
    return nested.join(w, F.col("t.term_start") == F.col("s")).select("metric_id", "term_id", F.col("t.party").alias("party_abbrev"), F.col("t.value").alias("value"))


@query("provenance_join", """SELECT CAST(n_nationkey AS VARCHAR) AS metric_id, n_name AS label, 'region ' || r_name AS publisher, 'p' || n_regionkey AS program, r_name AS access_provider, 'https://x.example/' || CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE '' END AS url,
CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'i' || n_nationkey END AS access_id, CASE n_regionkey WHEN 0 THEN 'Daily' WHEN 1 THEN 'Monthly' ELSE 'W' END AS frequency, 'usd' AS units FROM nation JOIN region ON n_regionkey = r_regionkey""")
def provenance_join(spark: SparkSession, d: str) -> DataFrame:
    n, r = _read(spark, d, "nation"), _read(spark, d, "region")
    key = F.concat(F.lit("i"), F.col("n_nationkey").cast("string"))
    metrics = n.select(F.col("n_nationkey").cast("string").alias("metric_id"), key.alias("series_key"))
    freq = F.when(F.col("n_regionkey") == 0, "D").when(F.col("n_regionkey") == 1, "M").otherwise("W")
    sid = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise("")
    series = n.select(key.alias("series_key"), F.col("n_regionkey").cast("string").alias("source"), sid.alias("series_id"), F.lit(None).cast("string").alias("dataset"), freq.alias("frequency"), F.lit("usd").alias("units"), F.create_map(F.lit("label"), F.col("n_name"), F.lit("program"), F.concat(F.lit("p"), F.col("n_regionkey").cast("string"))).alias("facts"))
    sources = r.select(F.col("r_regionkey").cast("string").alias("source"), F.create_map(F.lit("publisher"), F.concat(F.lit("region "), "r_name"), F.lit("access_provider"), F.col("r_name"), F.lit("label"), F.lit("x"), F.lit("url"), F.lit("https://x.example/{series_id}")).alias("facts"))
    return reports.provenance(metrics, series, sources)


@query("site_export")
def site_export(spark: SparkSession, d: str) -> DataFrame:
    board, t = _tested_board(spark, d)
    sources = board.select("metric_id", F.col("metric_id").alias("access_id"))
    return reports.site(board, sources, reports.term_details(t))


@query("event_daily_series", "SELECT event_type AS series_key, CAST(ts AS DATE) AS d, count(*) AS n, round(sum(CAST(value AS DECIMAL(18,6)))::DOUBLE, 6) AS v FROM events GROUP BY 1, 2")
def event_daily_series(spark: SparkSession, d: str) -> DataFrame:
    return daily_series(_read(spark, d, "events")).withColumn("v", F.round("v", 6))
