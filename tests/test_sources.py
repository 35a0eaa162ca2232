"""Readers, registry, artefacts, sinks and streams over small files."""

import json
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from regimes.operators import reports
from regimes.sources import artefacts, documents, registry, series, sinks, windows
from regimes.streaming.series import daily_series, read_events, run_once

CSV = "Date,SP500,Dividend\n1956-12-01,46.67,1.0\n1957-01-01,45.43,1.0\n1957-02-01,43.47,1.0\n,1,1\n"


def rows(df):
    return [(r.d, r.v) for r in df.orderBy("pos").collect()]


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text(CSV)
    got = series.read_dated_csv(spark, str(p), "s", "Date", "SP500", start="1957-01-01")
    assert rows(got) == [(date(1957, 1, 1), 45.43), (date(1957, 2, 1), 43.47)]
    assert rows(series.read_dated_csv(spark, str(p), "s", "Date", "SP500", end="1956-12-31")) == [(date(1956, 12, 1), 46.67)]
    with pytest.raises(ValueError, match=r"missing CSV columns: \['Close'\]"):
        series.read_dated_csv(spark, str(p), "s", "Date", "Close")
    with pytest.raises(ValueError, match="no rows"):
        series.read_dated_csv(spark, str(p), "s", "Date", "SP500", start="2000-01-01")
    p.write_text("date,value\n2000-01-01,1\n2000-01-02,.\n2000-01-02,NA\n2000-01-03T05:00:00,2.5\n")
    assert [v for _, v in rows(series.read_series(spark, str(p), "s"))] == [1, None, None, 2.5]
    p.write_text("date,a,b\n2000-01-01,1,x\n2000-02-01,,4\n")
    assert sorted((r.series_key, r.d.month, r.v) for r in series.read_wide(spark, str(p), "t").collect() if r.v is not None) == [("t.a", 1, 1.0), ("t.b", 2, 4.0)]


def test_observations_json(spark, tmp_path):
    p = tmp_path / "o.json"
    p.write_text(json.dumps({"observations": [{"date": "2000-01-01", "value": "."}, {"date": "2000-02-01", "value": "3.5"}]}))
    assert rows(series.read_observations_json(spark, str(p), "s")) == [(date(2000, 1, 1), None), (date(2000, 2, 1), 3.5)]


def test_factor_text_and_zip(spark, tmp_path):
    text = "Made by hand\r\n\r\n,A,B\r\n192607,  2.96, -2.56\r\n192608, -99.99, 1.17\r\n192609, 1\r\n\r\n Annual\r\n1927, 1, 2\r\n"
    p = tmp_path / "f.txt"
    p.write_text(text)
    want = [("k.a", date(1926, 7, 1), 2.96), ("k.a", date(1926, 8, 1), None), ("k.b", date(1926, 7, 1), -2.56), ("k.b", date(1926, 8, 1), 1.17)]
    assert sorted((r.series_key, r.d, r.v) for r in series.read_factor_text(spark, str(p), "k", ["a", "b"]).collect()) == want
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        z.writestr("readme.md", "x")
        z.writestr("F.CSV", text)
    assert sorted((r.series_key, r.d, r.v) for r in series.read_zip_factor(spark, str(tmp_path / "f.zip"), "k", ["a", "b"]).collect()) == want


def test_people_and_bindings(spark, tmp_path):
    p = tmp_path / "l.json"
    p.write_text(json.dumps([
        {"id": {"wikidata": "Q1"}, "name": {"official_full": "A B"}, "terms": [{"type": "prez", "start": "1990-01-20", "end": "1994-01-20", "party": "Democrat"}, {"type": "rep", "start": "1980-01-01"}, {"type": "prez", "start": "1994-01-20", "end": "1998-01-20", "party": "Democrat"}]},
        {"id": {"govtrack": 7}, "name": {"first": "C", "last": "D"}, "terms": [{"type": "prez", "start": "1998-01-20", "party": "Whig"}, {"type": "prez", "start": ""}]},
    ]))
    t = windows.read_legislators(spark, str(p))
    assert sorted((r.person, r.president, r.label, r.start.year, r.end.year) for r in t.collect()) == [("Q1", "A B", "D", 1990, 1994), ("Q1", "A B", "D", 1994, 1998), ("govtrack:7", "C D", "Other", 1998, 9999)]
    assert sorted((r.person, r.start.year, r.end.year, r.n_merged) for r in windows.windows(t).collect()) == [("Q1", 1990, 1998, 2), ("govtrack:7", 1998, 9999, 1)]
    assert windows.windows(t, "term").where("term_number = 2").count() == 1
    b = lambda **k: {n: {"value": v} for n, v in k.items()}
    p.write_text(json.dumps({"results": {"bindings": [b(person="http://x/Q9", personLabel="E", party="http://x/Q5", start="2000-01-01T00:00:00Z"), b(person="http://x/Q9", personLabel="E", party="http://x/Q29468", start="2000-01-01T00:00:00Z"), b(personLabel="nobody")]}}))
    got = windows.read_bindings(spark, str(p)).collect()
    assert [(r.person, r.label, r.start, r.end) for r in got] == [("Q9", "R", date(2000, 1, 1), date(9999, 12, 31))]


SPEC = """
sources: {s: {kind: file}}
series: {a: {source: s, frequency: M, units: idx}, t: {source: s, frequency: Q}}
metrics:
  - {id: m1, family: f, inputs: {series: a}, period_transform: {kind: growth_rate, lag: 1, annualize_periods_per_year: 12}, term_aggregation: {kind: mean, post_scale: 100}}
  - {id: m2, inputs: {table: t, column: c}, term_aggregation: {kind: last}}
"""


def test_registry(spark, tmp_path):
    p = tmp_path / "spec.yaml"
    p.write_text(SPEC)
    spec = registry.load(str(p))
    got = {r.metric_id: r for r in registry.metrics(spark, spec).collect()}
    assert (got["m1"].transform, got["m1"].annualize, got["m1"].post_scale, got["m2"].series_key, got["m2"].freq) == ("growth_rate", 12, 100, "t.c", "Q")
    for change, error in (({"inputs": {"series": "zz"}}, "unknown input"), ({"inputs": {}}, "no input"), ({"period_transform": {"kind": "odd"}}, "unsupported transform"), ({"id": ""}, "without id"), ({"inputs": {"table": "t"}}, "no column")):
        bad = {**spec, "metrics": [{**spec["metrics"][0], **change}]}
        with pytest.raises((ValueError, KeyError), match=error):
            registry.metrics(spark, bad)
    over = {"series_overrides": {"a": {"period": "us_fiscal_year"}}}
    with pytest.raises(ValueError, match="fiscal year without start"):
        registry.metrics(spark, spec, over)


def test_artefacts(spark):
    names = ["/x/a/20200101T000000Z__sha256_1.csv", "/x/a/20200102T000000Z__sha256_0.csv", "/x/a/20200103T000000Z__sha256_0.csv.meta.json", "/x/b/20190101T000000Z__sha256_2.json"]
    got = artefacts.latest(spark.createDataFrame([(n,) for n in names], "path string")).collect()
    assert {r.folder: r.path for r in got} == {"/x/a": names[1], "/x/b": names[3]}


def test_series_metadata(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"seriess": [{"id": "GDP", "title": " Output ", "frequency_short": "Q", "units": "usd", "seasonal_adjustment_short": "SA", "notes": "x"}]}')
    assert [tuple(r) for r in series.read_series_metadata(spark, str(tmp_path)).collect()] == [("GDP", "Output", "Q", "usd", "SA")]


def test_quoted_header(spark, tmp_path):
    (tmp_path / "q.csv").write_text('date,"a, b"\n2000-01-01,3\n')
    assert [tuple(r) for r in series.read_wide(spark, str(tmp_path / "q.csv"), "k").select("series_key", "v").collect()] == [("k.a, b", 3.0)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.0000005), ("b", 0.1234565), ("c", None), ("d", float("inf"))], "k string, v double")
    sinks.write_csv(df, str(tmp_path / "out"), ["k"])
    got = sorted(line for f in (tmp_path / "out").glob("part-*.csv") for line in f.read_text().splitlines() if line != "k,v")
    assert got == ["a,0.000000", "b,0.123456", "c,", "d,"]
    board = spark.createDataFrame([("m2", "x|y", 1.0, 0.5, 0.5, 1, 2, "", "t", 0.5), ("m1", "z", 1.0, 0.5, 0.5, 1, 2, "[0, 1]", "t", None)], "metric_id string, metric_label string, d_mean double, r_mean double, diff double, n_d int, n_r int, ci string, tier string, q double")
    lines = reports.markdown(board)
    assert len(lines) == 4 and lines[2].startswith("| x\\|y |") and lines[3].startswith("| z |")
    sinks.write_site(spark.createDataFrame([("m", None, '{"a": 1}'), ("n", 0.1, '{"a": 2}')], "metric_id string, q double, payload string"), tmp_path / "s.json", "now")
    assert json.loads((tmp_path / "s.json").read_text()) == {"updated": "now", "metrics": [{"a": 2}, {"a": 1}]}


def test_stream_matches_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_type", "ts", "value")
    last = events.agg(F.max("ts")).first()[0]
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    run_once(daily_series(read_events(spark, str(tmp_path / "in"), events.schema), late="60 days"), str(tmp_path / "out"), str(tmp_path / "cp"), "append")
    stream = spark.read.schema("series_key string, d date, n long, v double").parquet(str(tmp_path / "out"))
    want = {(r.series_key, r.d): (r.n, r.v) for r in daily_series(events).collect()}
    got = {(r.series_key, r.d): (r.n, r.v) for r in stream.collect()}
    assert last is not None and all(want[k] == v for k, v in got.items())


def test_elements_of_documents(spark, tmp_path):
    """Ranges of lines lose and repeat nothing, whatever their size; order is that of the files; small files share a task."""
    docs = [{"a": {"b": [{"x": f"d{n}", "y": i, "z": {"k": None}} for i in range(n % 4)]}} for n in range(12)] + [{"a": None}, {}, {"a": {"b": {"x": "one"}}}, {"a": {"b": ["text"]}}]
    text = "\n".join(json.dumps(x) for x in docs) + "\n\n"
    for name in ("b.json", "a.json", "_SUCCESS", ".hidden"):
        (tmp_path / name).write_text(text if name != ".hidden" else "{broken")
    want = [(f"d{n}", str(i), '{"k": null}') for n in range(12) for i in range(n % 4)] + [("one", None, None), (None, None, None)]
    fields = {"x": "x", "y": "y", "z": "z"}
    for split in (37, 300, documents.SPLIT_BYTES):
        got = documents.read_elements(spark, str(tmp_path), "a.b", fields, lines=True, split_bytes=split)
        assert [tuple(r)[1:] for r in got.orderBy("pos").collect()] == want + want
        assert split < documents.SPLIT_BYTES or got.rdd.getNumPartitions() == 1
    got = documents.read_elements(spark, f"file://{tmp_path}", "a.b", fields, lines=True)
    for cond in ("x = 'd7'", "x >= 'd3' AND y < '2'", "x IN ('d5', 'one')", "x LIKE 'd1%'", "y IS NOT NULL AND x <> 'd3'", "y IS NULL", "x = 'd7' OR y = '0'"):
        assert got.where(cond).count() == spark.createDataFrame(want + want, "x string, y string, z string").where(cond).count(), cond
    pushed = got.where("x >= 'd3'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in pushed.split("BatchScan")[0] and "pos" in pushed
    (tmp_path / "none").mkdir()
    assert documents.read_elements(spark, str(tmp_path / "none"), "a", fields).count() == 0
    (tmp_path / "none" / "c.json").write_text("﻿[\n{\"x\": \" y \"},\n{\"x\": 1.5}]")
    assert [r.x for r in documents.read_elements(spark, str(tmp_path / "none"), "", {"x": "x"}, strip=True).orderBy("pos").collect()] == ["y", "1.5"]
    (tmp_path / "none" / "d.json").write_text("{")
    with pytest.raises(Exception, match="broken document at byte 0"):
        documents.read_elements(spark, str(tmp_path / "none"), "", {"x": "x"}).count()
    with pytest.raises(Exception, match="no-such"):
        documents.read_elements(spark, str(tmp_path / "no-such"), "", {"x": "x"}).count()


def test_observations_between(spark, tmp_path):
    days = [{"date": f"2000-01-{n:02d}{'T23:00:00' if n % 2 else ''}", "value": str(n)} for n in range(1, 31)] + [{"date": " 2000-01-05 ", "value": "50"}, {"date": "", "value": "1"}, {"value": "2"}]
    (tmp_path / "o.json").write_text(json.dumps({"observations": days}, indent=1))
    got = series.read_observations_json(spark, str(tmp_path), "s", "2000-01-05", "2000-01-09")
    assert rows(got) == [(date(2000, 1, n), float(n)) for n in range(5, 10)] + [(date(2000, 1, 5), 50.0)]


def test_graph_csv(spark, tmp_path):
    p = tmp_path / "g.csv"
    p.write_text("DATE,GDP\n2000-01-01,1.5\n,2\n2000-04-01,.\n")
    assert rows(series.read_graph_csv(spark, str(p), "s", "GDP")) == [(date(2000, 1, 1), 1.5), (date(2000, 4, 1), None)]
    with pytest.raises(ValueError, match=r"can't answer parameters: \['frequency'\]"):
        series.read_graph_csv(spark, str(p), "s", "GDP", {"frequency": "m"})
    with pytest.raises(ValueError, match=r"missing CSV columns: \['CPI'\]"):
        series.read_graph_csv(spark, str(p), "s", "CPI")
