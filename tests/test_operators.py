"""Hand-computed fixtures for transforms, attribution, aggregation, windows and checks."""

import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from regimes.functions import scalars as S
from regimes.functions.expressions import compile_expression, derive
from regimes.operators import aggregates, attribution, quality, spells, transforms
from regimes.plans import inputs


def series(spark, values, key="s", start=(2000, 1), step=1):
    rows = []
    for i, v in enumerate(values):
        m = start[1] - 1 + i * step
        rows.append((key, i, date(start[0] + m // 12, m % 12 + 1, 1), None if v is None else float(v)))
    return spark.createDataFrame(rows, "series_key string, pos long, d date, v double")


def one(spark, values, windows, step=1, **params):
    m = inputs.metrics(spark, [{"metric_id": "m", "series_key": "s", "freq": "M", **params}])
    w = spark.createDataFrame(windows, "wid string, label string, start date, end date")
    return {r.term_id: r for r in aggregates.term_metrics(series(spark, values, step=step), m, w).collect()}


YEAR = [("w", "D", date(2000, 1, 1), date(2001, 1, 1)), ("later", "R", date(2030, 1, 1), date(2031, 1, 1))]


@pytest.mark.parametrize("params, values, want", [
    ({"transform": "pct_change"}, [100, 110, None, 121, 0, 5], [None, 10, None, None, -100, None]),
    ({"transform": "growth_rate", "annualize": 4.0}, [100, 110, -1, 5], [None, 400 * math.log(1.1), None, None]),
    ({"transform": "indicator_lt", "threshold": 3.0}, [2, 3, None, 4], [1, 0, None, 0]),
    ({"transform": "pct_change", "lag": 2, "scale": 1.0}, [1, 2, 3, 6], [None, None, 2, 2]),
    ({"transform": "pct_change", "lag": 0, "scale": 0.0}, [1, 2], [None, 100]),
])
def test_transforms(spark, params, values, want):
    m = inputs.metrics(spark, [{"metric_id": "m", "series_key": "s", "freq": "M", "agg_kind": "mean", **params}])
    got = [r.v for r in aggregates.observe(series(spark, values), m).orderBy("d").collect()]
    assert got == [w if w is None else pytest.approx(w) for w in want]


def test_unknown_transform_stops(spark):
    m = inputs.metrics(spark, [{"metric_id": "m", "series_key": "s", "freq": "M", "agg_kind": "mean", "transform": "odd"}])
    with pytest.raises(Exception, match="unsupported transform"):
        aggregates.observe(series(spark, [1]), m).collect()


@pytest.mark.parametrize("kind, params, values, want, error", [
    ("mean", {}, [1, None, 3], 2, ""), ("mean", {"post_scale": 100.0}, [1, 3], 200, ""), ("mean", {}, [None], None, "empty window"),
    ("last", {}, [1, 2, None], 2, ""), ("end_minus_start", {}, [None, 5, 7, None], 2, ""), ("end_minus_start", {}, [5], 0, ""),
    ("end_minus_start_per_year", {}, [5], None, "non-positive elapsed time"), ("pct_change_from_levels", {}, [5], 0, ""), ("pct_change_from_levels", {}, [0, 5], None, "start value is 0"),
    ("cagr_from_levels", {}, [5], None, "non-positive elapsed time"), ("cagr_from_levels", {}, [-5, 5], None, "non-positive level for CAGR"), ("cagr_from_levels", {}, [1, 2], 100 * (2 ** (365.25 / 31) - 1), ""),
    ("mean_times_periods_per_year", {}, [], None, "periods_per_year required"), ("mean_times_periods_per_year", {"ppy": 12.0}, [None], None, "empty window"), ("mean_times_periods_per_year", {"ppy": 12.0}, [1, 2], 18, ""),
    ("compound_total", {}, [10, -5], 4.5, ""), ("compound_annualized", {"ppy": 2.0}, [10, -5], 4.5, ""), ("compound_annualized", {}, [1], None, "periods_per_year required"),
    ("count_transitions", {"from_value": 0.0, "to_value": 1.0}, [0, 1, 1, 0, 1], 2, ""), ("count_transitions", {"from_value": 0.0, "to_value": 1.0}, [0, None, 1], 0, ""), ("count_transitions", {"from_value": 0.0, "to_value": 1.0}, [1], 0, ""),
    ("annualized_std", {"ppy": 4.0}, [1, 3], 2 * math.sqrt(2), ""), ("annualized_std", {"ppy": 4.0}, [1], None, "need at least 2 observations"),
    ("sharpe_ratio_annualized", {"ppy": 4.0}, [1, 3], 2 * 4 / (2 * math.sqrt(2)), ""), ("sharpe_ratio_annualized", {"ppy": 4.0}, [2, 2], None, "zero std"), ("odd", {}, [1], None, "Unsupported term_aggregation.kind: 'odd'"),
])
def test_aggregates(spark, kind, params, values, want, error):
    got = one(spark, values, YEAR, agg_kind=kind, **params)
    assert got["w"].error == error
    assert got["w"].value == (want if want is None else pytest.approx(want))
    if kind == "count_transitions":
        assert got["later"].value == 0 and got["later"].error == ""
    else:
        assert got["later"].value is None and got["later"].error


def test_daily_boundaries(spark):
    rows = [("s", i, date(2000, 1, d), v) for i, (d, v) in enumerate([(1, 5.0), (3, None), (3, 8.0), (5, 10.0), (5, 12.0)])]
    obs = spark.createDataFrame(rows, "series_key string, pos long, d date, v double")
    w = spark.createDataFrame([("a", "D", date(2000, 1, 4), date(2000, 1, 5)), ("b", "R", date(2000, 1, 5), date(2020, 1, 1)), ("none", "R", date(1990, 1, 1), date(1991, 1, 1)), ("future", "D", date(2010, 1, 1), date(2011, 1, 1))], "wid string, label string, start date, end date")
    for kind, want in (("end_minus_start", {"a": 0.0, "b": 4.0, "none": None, "future": 0.0}), ("end_minus_start_per_year", {"a": None, "b": 4 / (2 / 365.25), "none": None, "future": None})):
        m = inputs.metrics(spark, [{"metric_id": "m", "series_key": "s", "freq": "D", "agg_kind": kind}])
        got = {r.term_id: r for r in aggregates.term_metrics(obs, m, w).collect()}
        assert {k: r.value for k, r in got.items()} == {k: v if v is None else pytest.approx(v) for k, v in want.items()}
        assert got["none"].error == "missing boundary observation"
        if kind.endswith("per_year"):
            assert got["future"].error == "non-positive elapsed time"


def test_registry_growth_changes_nothing(spark):
    w = spark.createDataFrame(YEAR, "wid string, label string, start date, end date")
    a = {"metric_id": "a", "series_key": "s", "freq": "M", "agg_kind": "mean", "transform": "pct_change"}
    b = {"metric_id": "b", "series_key": "s", "freq": "M", "agg_kind": "last", "transform": "pct_change", "lag": 3}
    values = [3, 4, None, 8, 2, 9]
    run = lambda rows, n: sorted((r.metric_id, r.term_id, r.value, r.error) for r in aggregates.term_metrics(series(spark, values).repartition(n), inputs.metrics(spark, rows), w).collect())
    alone = run([a], 1)
    assert [x for x in run([a, b], 5) if x[0] == "a"] == alone


def test_ties_and_gaps(spark):
    w = spark.createDataFrame(inputs.TIES, "wid string, label string, start string, end string").select("wid", "label", F.to_date("start").alias("start"), F.to_date("end").alias("end"))
    p = spark.createDataFrame([("M", None, None, None, date(1996, 9, 1)), ("M", None, None, None, date(1997, 6, 1)), ("A", "us_fiscal_year", 10, 1, date(1998, 1, 1))], "freq string, period_kind string, fy_month int, fy_day int, d date")
    assert {r.d: r.wid for r in attribution.term_of_period(p, w).collect()} == {date(1996, 9, 1): "C", date(1998, 1, 1): "F"}
    assert {r.d: r.wid for r in attribution.term_of_period(p, w, "latest_start").collect()} == {date(1996, 9, 1): "B", date(1997, 6, 1): "E", date(1998, 1, 1): "F"}


def test_open_end_and_overlap(spark):
    w = spark.createDataFrame([("a", date(2000, 1, 1), date(9999, 12, 31)), ("b", date(1999, 6, 1), date(2001, 1, 1))], "wid string, start date, end date")
    days = spark.createDataFrame([(date(2000, 5, 5),), (date(2500, 1, 1),), (date(1999, 1, 1),), (None,)], "d date")
    assert {r.d: r.wid for r in attribution.term_of_day(days, w).collect()} == {date(2000, 5, 5): "b", date(2500, 1, 1): "a"}


def test_resample(spark):
    rows = [("s", i, date(2000, 1, d), v) for i, (d, v) in enumerate([(3, 1.0), (20, 4.0), (31, None)])]
    df = spark.createDataFrame(rows, "series_key string, pos long, d date, v double")
    assert transforms.resample_month(df, "eop").first().v == 4 and transforms.resample_month(df, "avg").first().v == 2.5


def test_expressions(spark):
    df = spark.createDataFrame([(6.0, 2.0), (1.0, 0.0), (None, 1.0)], "a double, b double")
    got = derive(df, {"x": "a / b + -1", "y": "x * 2", "z": "a + missing", "bad": "f(a)", "worse": "a +", "none": ""}).collect()
    assert [(r.x, r.y, r.z, r.bad, r.worse) for r in got] == [(2, 4, None, None, None), (None,) * 5, (None,) * 5]
    for text in ("a ** 2", "a if b else 1", "'a'", "True", "a < b"):
        with pytest.raises(ValueError):
            compile_expression(text, {"a", "b"})


def test_scalars(spark):
    row = lambda **c: spark.range(1).select(*[v.alias(k) for k, v in c.items()]).first()
    lit = F.lit
    r = row(a=S.parse_number(lit(" 1.5 ")), b=S.parse_number(lit(".")), c=S.parse_number(lit("x")), d=S.parse_date(lit("2020-02-30")), e=S.parse_date(lit("2020-02-03T23:59:59Z")), f=S.parse_loose(lit("NaN")))
    assert (r.a, r.b, r.c, r.d, r.e) == (1.5, None, None, None, date(2020, 2, 3)) and math.isnan(r.f)
    r = row(a=S.redact_url(lit("http://x/?q=1&API_KEY=s&token=t#f")), b=S.last_segment(lit("http://x/Q12/")), c=S.clean_label(lit("(all)")), d=S.clean_label(lit("GDP (real)")), e=S.party_label(lit(None), lit(" Democrat ")), f=S.party_label(lit("Q1"), lit("Whig")))
    assert tuple(r) == ("http://x/?q=1&API_KEY=REDACTED&token=REDACTED#f", "Q12", "(all)", "GDP", "D", "Other")
    r = row(a=S.normalize_text(lit(" a \t b\r\n\r\n\r\n\r\nc ")), b=S.first_line(lit("\n  \n  T x ")), c=S.strip_html(lit("<p>a&amp;b</p><script>x</script><b>c</b>")), d=S.frequency_label(lit("Q")), e=S.frequency_label(lit("W")))
    assert tuple(r) == ("a b\n\nc", "T x", "a&b\nc", "Quarterly", "W")
    fy = row(p=S.period(lit(date(2020, 1, 1)), "A", "us_fiscal_year")).p
    assert (fy.start, fy.end) == (date(2019, 10, 1), date(2020, 10, 1))


def test_windows(spark):
    df = spark.createDataFrame([("A", "D", 1, 2), ("A", "D", 2, 3), ("A", "D", 5, 6), ("B", "D", 1, 2), ("B", "R", 2, 3)], "person string, label string, start int, end int")
    got = sorted((r.person, r.label, r.start, r.end, r.term_number) for r in spells.merge_consecutive(df).collect())
    assert got == [("A", "D", 1, 3, 1), ("A", "D", 5, 6, 2), ("B", "D", 1, 2, 1), ("B", "R", 2, 3, 2)]
    rows = [("a", "Other", 0), ("a", "R", 1), ("a", "D", 2), ("b", "Other", 0), ("b", "R", 1), ("c", "X", 0), ("c", "Y", 1), ("d", " ", 0), ("d", None, 1)]
    got = {r.g: r.label for r in spells.choose_label(spark.createDataFrame(rows, "g string, label string, pos int"), ["g"], "label", "pos").collect()}
    assert got == {"a": "D", "b": "R", "c": "X", "d": ""}


def test_quality(spark):
    raw = spark.createDataFrame([("a", "D", "2000-01-01", "2001-01-01"), ("a", "Z", "2001-01-01", "2000-01-01"), ("", "R", "x", "2001-01-01")], "term_id string, label string, start string, end string")
    issues = quality.window_issues(raw)
    assert {(r.level, r.check_id) for r in issues.collect()} == {("ERROR", "term_id_blank"), ("ERROR", "term_id_duplicate"), ("ERROR", "bad_date"), ("ERROR", "empty_window"), ("WARN", "label")}
    assert tuple(quality.roll_up(issues).first()) == (4, 1, 1)
    w = spark.createDataFrame([("a", date(2000, 1, 1), date(2001, 1, 1)), ("b", date(2000, 12, 1), date(2002, 1, 1)), ("c", date(2002, 1, 1), date(2003, 1, 1)), ("d", date(2004, 1, 1), date(2005, 1, 1))], "wid string, start date, end date")
    assert sorted((r.level, r.check_id) for r in quality.adjacency_issues(w).collect()) == [("ERROR", "overlap"), ("WARN", "gap")]
