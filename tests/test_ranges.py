"""Orders cut into ranges: the results of one long order, whatever the ranges."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from regimes.operators import aggregates, attribution, inference, percentiles, quality, ranges, reports, transforms
from regimes.plans import inputs

rng = random.Random(5)


@pytest.fixture(autouse=True)
def small_sample(monkeypatch):
    monkeypatch.setattr(ranges, "SAMPLE", 60)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbers_with_ties_and_nulls(spark):
    rows = [(rng.choice([None, 0.5, 1.0, rng.random()]), f"m{i}") for i in range(700)]
    df = spark.createDataFrame(rows, "p double, id string").repartition(3)
    got = ranges.numbered(df, [F.col("p"), F.col("id")], "n", parts=11).collect()
    assert len({r._range for r in got}) > 5
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r.p, r.id) for r in sorted(got, key=lambda r: r.n)] == want and sorted(r.n for r in got) == list(range(1, 701))
    assert ranges.numbered(df.limit(0), [F.col("p")], "n").count() == 0
    assert [r.n for r in ranges.numbered(df.limit(1), [F.col("p")], "n", parts=1).collect()] == [1]


def step_up(ps):
    known = sorted((p, k) for k, p in ps.items() if p is not None)
    q, least = {k: None for k in ps}, 1.0
    for r in range(len(known), 0, -1):
        p, k = known[r - 1]
        least = min(least, p * len(known) / r)
        q[k] = least
    return q


def test_false_discovery_over_ranges(spark):
    ps = {f"m{i}": rng.choice([None, 0.02, 0.02, 0.9, rng.random() ** 3]) for i in range(400)}
    df = spark.createDataFrame(list(ps.items()), "metric_id string, p double").repartition(5)
    out = inference.false_discovery(df, parts=9)
    assert {r.metric_id: r.q for r in out.collect()} == {k: v if v is None else pytest.approx(v) for k, v in step_up(ps).items()}
    windows = [line for line in plan(out).splitlines() if "Window [" in line]
    assert windows and all("windowspecdefinition(_range" in line for line in windows)


def test_adjacency_over_ranges(spark):
    day = lambda: date(2000, 1, 1) + timedelta(days=rng.randrange(3000))
    rows = [(rng.choice(["one", "one", "one", "two", None]), i, s := day(), s + timedelta(days=rng.randrange(1, 9))) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, wid long, start date, end date").repartition(4)
    for by in ([], ["k"]):
        groups = {}
        for k, w, s, e in rows:
            groups.setdefault(k if by else 0, []).append((s, e, w))
        want = set()
        for k, g in groups.items():
            g.sort()
            for (_, e, w), (s, _, n) in zip(g, g[1:]):
                if s != e:
                    want.add((*([k] if by else []), w, n, "overlap" if s < e else "gap", (s - e).days))
        out = quality.adjacency(df, by, parts=7)
        assert {tuple(r) for r in out.collect()} == want


@pytest.mark.parametrize("parts", [None, 6, 40])
def test_lags_of_a_series_over_several_tasks(spark, parts):
    rows = []
    for key, n in (("long", 300), ("short", 5), ("empty lag", 1), (None, 40)):
        rows += [(key, i, date(2000, 1, 1) + timedelta(days=i // 2), rng.choice([None, float(i)])) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, pos long, d date, v double").repartition(5)
    got = transforms.earlier_values(df, [1, 3, 50], "k", parts).collect()
    series = {}
    for k, p, d, v in rows:
        series.setdefault(k, []).append((d, p, v))
    for s in series.values():
        s.sort(key=lambda x: x[:2])
    assert len(got) == len(rows)
    for r in got:
        s = series[r.k]
        i = next(i for i, x in enumerate(s) if x[:2] == (r.d, r.pos))
        for n in (1, 3, 50):
            assert r[f"_lag{n}"] == (s[i - n][2] if i >= n else None)


@pytest.mark.parametrize("parts", [None, 9])
def test_last_values_before_marks_over_ranges(spark, parts):
    rows = [("long", i, date(2000, 1, 1) + timedelta(days=rng.randrange(900)), rng.choice([None, float(i)])) for i in range(300)] + [("few", 0, date(2001, 5, 5), 1.0)]
    marks = [(k, date(2000, 1, 1) + timedelta(days=rng.randrange(1000)), f"w{i}") for i in range(60) for k in ("long", "few", "none")]
    s, m = spark.createDataFrame(rows, "k string, pos long, d date, v double"), spark.createDataFrame(marks, "k string, mark date, wid string")
    got = {(r.k, r.mark, r.wid): (r.d, r.v) for r in attribution.before_boundaries(s, m, "k", parts).collect()}
    want = {}
    for k, at, w in marks:
        seen = [(d, p, v) for x, p, d, v in rows if x == k and d < at and v is not None]
        if seen:
            d, _, v = max(seen)
            want[k, at, w] = (d, v)
    assert got == want


def test_long_series_take_ranges(spark, monkeypatch):
    m = inputs.metrics(spark, [{"metric_id": "m", "series_key": "s", "freq": "D", "agg_kind": "end_minus_start", "transform": "pct_change", "lag": 7}])
    s = spark.createDataFrame([("s", i, date(2000, 1, 1) + timedelta(days=i), float(i % 13 + 1)) for i in range(400)], "series_key string, pos long, d date, v double")
    w = spark.createDataFrame([("a", "D", date(2000, 2, 1), date(2000, 9, 1)), ("b", "R", date(2000, 9, 1), date(9999, 12, 31))], "wid string, label string, start date, end date")
    run = lambda: sorted((r.term_id, r.value, r.start_obs_date, r.end_obs_date) for r in aggregates.term_metrics(s, m, w).collect())
    plain = run()
    assert ranges.parts_for(s) is None and ranges.parts_for(spark.range(1 << 40)) == ranges.parts_of(s)
    monkeypatch.setattr(ranges, "parts_for", lambda df: 5)
    assert run() == plain and plain[0][1] is not None


def test_places(spark):
    board = spark.createDataFrame([(f"m{i}", rng.choice([None, 0.1, 0.2])) for i in range(90)], "metric_id string, q double")
    first = spark.createDataFrame([(f"m{i}", rng.randrange(30)) for i in range(80)], "metric_id string, pos long")
    pos = {r.metric_id: r.pos for r in first.collect()}
    got = sorted(reports.placed(board, first).collect(), key=lambda r: r.place)
    assert [r.place for r in got] == list(range(1, 91))
    key = lambda r: (r.q is None, r.q or 0, pos.get(r.metric_id) is None, pos.get(r.metric_id, 0), r.metric_id)
    assert [r.metric_id for r in got] == [r.metric_id for r in sorted(board.collect(), key=key)]


def test_open_windows_have_few_rows(spark):
    w = spark.createDataFrame([(date(1000, 1, 1), date(9999, 12, 31)), (date(2001, 1, 20), date(2005, 1, 20)), (date(1, 1, 1), date(9999, 12, 31)), (date(2000, 1, 1), date(2000, 1, 2))], "start date, end date")
    sizes = [r.n for r in w.select(F.size(F.expr(attribution._cover("start", "end", attribution.TOP))).alias("n")).collect()]
    assert max(sizes) <= 2 * attribution.TOP and sizes[-1] == 1


def test_interval_join_against_all_pairs(spark):
    day = lambda a, b: date(1999, 1, 1) + timedelta(days=rng.randrange(a, b))
    windows = [(f"w{i}", s := day(0, 1500), s + timedelta(days=rng.choice([-1, 0, 1, 20, 90, 400]))) for i in range(60)] + [("open", date(2001, 1, 1), date(9999, 12, 31))]
    spans = [(i, s := day(-200, 1900), s + timedelta(days=rng.choice([0, 1, 28, 31, 92, 366]))) for i in range(150)]
    got = attribution._met(spark.createDataFrame(spans, "i long, ps date, pe date"), spark.createDataFrame(windows, "wid string, start date, end date")).select("i", "wid").collect()
    want = sorted((i, w) for i, a, b in spans for w, s, e in windows if max(a, s) < min(b, e))
    assert sorted(tuple(r) for r in got) == want


def test_unknown_inputs_stop_the_job(spark):
    m = inputs.metrics(spark, [{"metric_id": "m", "series_key": "s", "freq": "M", "agg_kind": "mean"}, {"metric_id": "lost", "series_key": "typo", "freq": "M", "agg_kind": "mean"}])
    s = spark.createDataFrame([("s", 0, date(2000, 1, 1), 1.0)], "series_key string, pos long, d date, v double")
    w = spark.createDataFrame([("a", "D", date(2000, 1, 1), date(2001, 1, 1))], "wid string, label string, start date, end date")
    known = spark.createDataFrame([("s",), ("other",)], "series_key string")
    with pytest.raises(Exception, match="unknown input typo of metric lost"):
        aggregates.term_metrics(s, m, w, inputs=known).collect()
    with pytest.raises(Exception, match="unknown input typo"):
        aggregates.observe(s, m, known).collect()
    assert [r.value for r in aggregates.term_metrics(s, m.where("metric_id = 'm'"), w, inputs=known).collect()] == [1.0]


def test_percentiles_of_groups_of_any_size(spark):
    rows = [("big", rng.choice([0.0, -0.0, 5.0, 5.0, rng.uniform(-9, 9)])) for _ in range(900)] + [("one", 3.0), ("none", None), ("few", 1.0), ("few", None), ("few", 2.0), (None, 7.0), (None, 9.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    qs = [0.0, 0.025, 0.5, 0.3, 0.975, 1.0]

    def seven(xs, q):
        xs = sorted(xs)
        at = q * (len(xs) - 1)
        low = int(at)
        return xs[low] + (xs[min(low + 1, len(xs) - 1)] - xs[low]) * (at - low)

    for most in (1, 10_000):  # by counts in ranges; by one map for each group
        got = {r.k: r.q for r in percentiles.percentiles(df, ["k"], "v", qs, most=most, parts=9).collect()}
        assert got.pop("none") is None
        assert got == {k: [pytest.approx(seven([v for x, v in rows if x == k and v is not None], q)) for q in qs] for k in ("big", "one", "few", None)}
    alone = percentiles.selected(df.where("k = 'big'"), ["k"], "v", [0.5], parts=7)
    assert alone.first().q == [pytest.approx(seven([v for k, v in rows if k == "big"], 0.5))]
    assert percentiles.selected(df.limit(0), ["k"], "v", [0.5]).count() == 0
