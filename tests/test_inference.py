"""Tests of resampling, discovery rates and tiers with exact expectations."""

import json

import pytest
from pyspark.sql import functions as F

from regimes.operators import aggregates, inference, reports
from regimes.plans import catalogue


def obs(spark, rows):
    return spark.createDataFrame([(m, i, i, x, v, 2000 + i, 0) for i, (m, x, v) in enumerate(rows)], "metric_id string, obs_key int, pos long, label string, value double, year int, block int")


MINI = [("target", x, v) for x, v in zip("DDDRRR", (5.0, 2.0, 4.0, 1.0, 3.0, 0.0))]


def test_diff_of_means(spark):
    rows = [("a", x, v) for x, v in zip("DDRR", (2.0, 4.0, 1.0, 1.0))] + [("b", "R", 1.0), ("c", "D", 10.0), ("c", "R", 3.0)]
    got = {r.metric_id: r["diff"] for r in aggregates.diff_of_means(obs(spark, rows), ["metric_id"], "label").collect()}
    assert got == {"a": 2.0, "b": None, "c": 7.0}


def test_spread_and_percentiles(spark):
    df = spark.createDataFrame([(float(x),) for x in (2, 4, 4, 4, 5, 5, 7, 9)], "v double")
    assert df.agg(F.stddev_pop("v")).first()[0] == 2.0
    for xs, q, want in (([7], 0.5, 7), ([5, 1, 3], 0.5, 3), ([1, 2, 3, 4], 0.5, 2.5), ([10, 20, 30], 0, 10), ([10, 20, 30], 1, 30), ([1, 2, 3, 4, 5], 0.25, 2), ([10, 20], 0.3, 13)):
        assert spark.createDataFrame([(float(x),) for x in xs], "v double").agg(F.percentile("v", q)).first()[0] == pytest.approx(want)
        assert inference._percentile(xs, q) == pytest.approx(want)
    assert inference._percentile([], 0.5) is None


@pytest.mark.parametrize("ps, want", [([], []), ([0.04], [0.04]), ([0.01, 0.04, 0.03], [0.03, 0.04, 0.04]), ([None, 0.5], [None, 0.5]), ([0.9, 0.95], [0.95, 0.95])])
def test_false_discovery(spark, ps, want):
    df = spark.createDataFrame([(f"m{i}", p) for i, p in enumerate(ps)], "metric_id string, p double")
    got = [r.q for r in inference.false_discovery(df).orderBy("metric_id").collect()]
    assert got == [w if w is None else pytest.approx(w) for w in want]


def test_permutations_keep_label_counts_and_blocks(spark):
    rows = obs(spark, MINI).withColumn("block", F.when(F.col("obs_key").isin(0, 3), 0).otherwise(1))
    got = inference.permutations(rows, 50).collect()
    assert len(got) == 50
    values = {0: (5.0, 1.0), 1: (2.0, 4.0, 3.0, 0.0)}
    possible = {round((a + b + c) / 3 - (15 - a - b - c) / 3, 6) for a in values[0] for i, b in enumerate(values[1]) for c in values[1][i + 1 :]}
    assert {round(r["diff"], 6) for r in got} <= possible


def test_results_do_not_depend_on_other_metrics_or_partitions(spark):
    alone, more = obs(spark, MINI), obs(spark, MINI + [("other", x, v + 1) for _, x, v in MINI]).repartition(7)
    for f in (lambda o: inference.permutation_test(o, 60), lambda o: inference.bootstrap(o, 40), lambda o: inference.sequential_test(o, 60, 40)):
        a, b = f(alone).where("metric_id = 'target'").first(), f(more).where("metric_id = 'target'").first()
        assert a == b


def test_sequential_known_values(spark):
    r = inference.sequential_test(obs(spark, MINI), 200, 100).first()
    assert (r.n_obs, r.n_d, r.n_r) == (6, 3, 3) and r.observed == pytest.approx(11 / 3 - 4 / 3)
    assert 0 < r.p <= 1 and r.ci_low <= r.observed <= r.ci_high and r.p * 201 == pytest.approx(round(r.p * 201))
    one = inference.sequential_test(obs(spark, [("m", "D", 1.0), ("m", "D", 2.0)]), 50, 50).first()
    assert one.observed is None and one.p is None and one.ci_low is None
    same = inference.sequential_test(obs(spark, [("m", "D", 2.0), ("m", "R", 2.0)]), 10, 10).first()
    assert (same.observed, same.p, same.z, same.ci_low, same.ci_high) == (0, 1, None, 0, 0)


def test_tiers(spark):
    df = spark.createDataFrame([(0.04, 11), (0.04, 12), (0.05, 12), (0.1, 50), (None, 50)], "q double, n int")
    got = df.select(inference.evidence_tier(F.col("q"), F.col("n")), inference.site_tier(F.col("q"))).collect()
    assert [tuple(r) for r in got] == [("exploratory", "confirmatory"), ("confirmatory", "confirmatory"), ("supportive", "supportive"), ("exploratory", "exploratory"), ("exploratory", "exploratory")]


def test_randomization_follows_the_values(spark):
    rows = [(m, f"t{i}", "DR"[i % 2], v, None) for m, vs in {"apart": [10.0 * (i % 2) + i / 100 for i in range(16)], "alike": [float(i // 2) for i in range(16)]}.items() for i, v in enumerate(vs)]
    rows += [("apart", "t90", "Other", 5.0, None), ("apart", "t91", "D", None, None), ("lone", "t1", "D", 1.0, None), (" ", "t1", "D", 1.0, None)]
    terms = spark.createDataFrame(rows, "metric_id string, term_id string, party_abbrev string, value double, term_start date")
    got = {r.metric_id: r for r in inference.randomization(terms, 2000, 200).collect()}
    assert set(got) == {"apart", "alike", "lone"} and (got["apart"].n_obs, got["apart"].n_d, got["apart"].n_r) == (16, 8, 8)
    assert got["apart"].p < 0.005 and got["apart"].q == pytest.approx(2 * got["apart"].p) and got["apart"].evidence_tier == "confirmatory" and got["apart"].ci_high < 0
    assert got["alike"].p == 1 and got["alike"].evidence_tier == "exploratory" and got["alike"].ci_low < 0 < got["alike"].ci_high
    assert got["lone"].p is None and got["lone"].q is None and got["lone"].ci_low is None


def test_last_duplicate_of_a_test_wins(spark):
    tests = spark.createDataFrame([(1, "m", 0.5), (3, " m ", 0.01), (2, "m", 0.7), (4, " ", 0.2)], "pos int, metric_id string, p double")
    tests = tests.withColumn("q", F.col("p")).withColumn("ci_low", F.lit(0.0)).withColumn("ci_high", F.lit(1.0))
    summary = spark.createDataFrame([(x, "m", "f", "m", "mean", "u", 3, v) for x, v in (("D", 2.0), ("R", 1.0))], "party_abbrev string, metric_id string, metric_family string, metric_label string, agg_kind string, units string, n_terms long, mean double")
    assert [(r.metric_id, r.q, r.tier) for r in reports.scoreboard(summary, tests).collect()] == [("m", 0.01, "confirmatory")]


def test_site_export_has_the_tests_of_its_values(spark):
    d = "/root/testdata/sf0.001"
    want = {r.metric_id: (r.p, r.q) for r in catalogue.term_randomization(spark, d).collect()}
    got = {r.metric_id: json.loads(r.payload) for r in catalogue.site_export(spark, d).collect()}
    assert {m: (x.get("p"), x.get("q")) for m, x in got.items()} == {m: want.get(m, (None, None)) for m in got}
    assert any(p is not None for p, _ in want.values())
