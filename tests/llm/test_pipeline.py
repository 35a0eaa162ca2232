"""The pipeline on a small corpus, held against plain Python versions of its stages; and queries against their SQL."""

import hashlib
import re
import zlib
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from regimes.llm import decontaminate, language_id, mixing, queries

from .test_operators import brute_groups, brute_hits

D = "/root/testdata/sf0.001"


def plain_language(rows, space=language_id.Space()):
    """Ids that the first stage keeps, n-gram by n-gram."""
    letters, table = language_id._letters(space), language_id._classes()

    def vector(text):
        c = [int(table[ord(x)]) for x in f" {text.lower()} "]
        c = [x for i, x in enumerate(c) if not i or x or c[i - 1]]
        out = np.zeros(space.dim)
        for gram in zip(*(c[k:] for k in range(space.n))):
            out += np.prod([letters[k][x].astype(float) for k, x in enumerate(gram)], axis=0)
        return out, sum(x > 0 for x in c)

    unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
    found, sums = {}, {}
    for r in rows:
        found[r.doc_id] = vector(r.text or "")
        if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and found[r.doc_id][1]:
            sums[r.lang] = sums.get(r.lang, 0) + np.rint(unit(found[r.doc_id][0]) * (1 << 20))
    raw = {x: unit(v) for x, v in sums.items()}
    mean = sum(raw.values()) / len(raw)
    protos = [unit(v - mean) for v in raw.values()]
    best = {i: max(float(unit(unit(v) - mean) @ p) for p in protos) for i, (v, n) in found.items() if n}
    return {i for i, (_, n) in found.items() if n and (n < 100 or round(best[i], 6) >= 3.5 / space.dim**0.5)}


def plain_mix(rows, epochs=2, seed=13):
    """How often each id is taken by the fourth stage."""
    names = {"web": 0.5, "books": 0.2, "code": 0.2, "forum": 0.1}
    leaf = {}
    for r in rows:
        k = int(re.search("[0-9]+", r.source)[0]) % 4 if r.source else None
        leaf.setdefault((list(names)[k] if k is not None else "other", r.lang or mixing.NONE, r.source or mixing.NONE), []).append(r)
    tokens = lambda r: len(re.findall(r"[^ \t\n\x0B\f\r]+", r.text or ""))
    held = {p: sum(map(tokens, v)) for p, v in leaf.items()}

    def share(budget, children):
        """Budgets of ``children``, name to (weight, capacity): those that fall short get what they hold, the rest share what is left."""
        out, open_ = {}, dict(children)
        while open_:
            w = sum(x for x, _ in open_.values())
            short = {n: c for n, (x, c) in open_.items() if c <= budget * x / w + 1e-9}
            if not short:
                return out | {n: budget * x / w for n, (x, _) in open_.items()}
            for n, c in short.items():
                out[n] = c
                budget -= c
                del open_[n]
        return out

    under = lambda path: epochs * sum(h for p, h in held.items() if p[: len(path)] == path)
    domains = {p[0] for p in leaf}
    weight = [lambda n: names.get(n, 1.0), lambda n: {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}.get(n, 1.0), lambda n: 1.0]
    all_w = sum(map(weight[0], domains))
    budgets = {(): int(min(under((n,)) * all_w / weight[0](n) for n in domains))}
    for d in range(3):
        nxt = {}
        for path, b in budgets.items():
            kids = {p[d] for p in leaf if p[:d] == path}
            nxt |= {(*path, n): x for n, x in share(b, {n: (weight[d](n), under((*path, n))) for n in kids}).items()}
        budgets = nxt
    times = Counter()
    for p, v in leaf.items():
        b = int(budgets[p] + 1e-6)
        whole, rest = divmod(b, held[p]) if held[p] else (0, 0)
        before = 0
        for r in sorted(v, key=lambda r: (int(hashlib.md5(f"{seed}:{whole}:{r.doc_id}".encode()).hexdigest()[:15], 16), str(r.doc_id))):
            times[r.doc_id] += whole + (before < rest)
            before += tokens(r)
    return +times, {n: sum(tokens(r) * times[r.doc_id] for p, v in leaf.items() if p[0] == n for r in v) for n in domains}


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").withColumn("extra", F.lit("x"))
    odd = [(9001, "Щ" + "бвгджз клмнп рстфх" * 20, None, "s1"), (9002, "1234 5678", "en", "s2"), (9003, None, "en", "s2"), (9004, "", None, None), (9005, "so", None, "s3")]
    docs = docs.unionByName(spark.createDataFrame([(*r, len(r[1] or ""), "x") for r in odd], docs.select("doc_id", "text", "lang", "source", "n_chars", "extra").schema))
    bench = [tuple(r) for r in spark.read.parquet(f"{D}/benchmark.parquet").select(F.col("item_id").cast("string"), "text").collect()]
    kept = corpus_pipeline.identify_language(spark, docs, D)
    assert kept.columns == docs.columns
    rows = {r.doc_id: r for r in kept.collect()}
    assert set(rows) == plain_language(docs.collect()) and {9001, 9002, 9003, 9004}.isdisjoint(rows) and rows[9005].lang is not None
    one = corpus_pipeline.drop_near_duplicates(spark, kept, D)
    groups = brute_groups([(i, r.text) for i, r in rows.items()])
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == {i for i, (_, g) in groups.items() if i == g}
    clean = corpus_pipeline.remove_benchmark(spark, one, D)
    before = {r.doc_id: r.text for r in one.collect()}
    after = {r.doc_id: r for r in clean.collect()}
    for (i, t), (n, hit, _) in zip(before.items(), brute_hits(list(before.values()), bench, 10)):
        assert (i in after) == (not hit or hit < n)
        if i in after and not hit:
            assert after[i].text == t
        if i in after:
            assert after[i].n_chars == len(after[i].text) and len(decontaminate.words(after[i].text)) == n - hit
    mixed = corpus_pipeline.mix_sources(spark, clean, D)
    want, by_domain = plain_mix(list(after.values()))
    assert mixed.columns == docs.columns and Counter(r.doc_id for r in mixed.collect()) == want and max(want.values()) <= 2
    levels = {"domain": queries.domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}
    taken = {r.domain: r.n for r in mixing.mix(clean, levels, queries.WEIGHTS, share=None).groupBy("domain").agg(F.sum("taken").alias("n")).collect()}
    weight = {n: queries.WEIGHTS["domain"].get(n, 1.0) for n in taken}
    for name, n in taken.items():  # exact in tokens; a leaf's last document stays whole
        assert abs(n / sum(taken.values()) - weight[name] / sum(weight.values())) < 0.001 and by_domain[name] >= n
    out = corpus_pipeline.shard(spark, mixed, D).collect()
    assert Counter(r.doc_id for r in out) == want
    for r in out:
        assert r.text == after[r.doc_id].text


def test_stages_on_odd_rows(spark):
    long = "word and thing of it " * 4000
    rows = [(None, "the same text twice or more often here", "en", None), (None, "the same text twice or more often here", "en", None), (1, long, None, "s1"), (1, long, None, "s1"), (2, None, "fr", "s2"), (3, "", None, "s3"), (4, " \t\n ", "xx", ""), (None, None, None, None), (5, "short", "en", "s4")]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "own", "own") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, row string, _key string")
    for _, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, D)
        assert docs.columns == got.columns[: len(docs.columns)]
        again = sorted(map(str, got.collect()))
        assert sorted(map(str, stage(spark, docs.repartition(1), D).collect())) == again
        assert stage(spark, docs.limit(0), D).count() == 0
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, D).collect()
    assert len(kept) == 7 and sum(r.text == rows[0][1] for r in kept) == 1
    assert corpus_pipeline.remove_benchmark(spark, docs, D).count() == len(rows) == corpus_pipeline.shard(spark, docs, D).count()
    mixed = [r.text for r in corpus_pipeline.mix_sources(spark, docs, D).collect()]
    assert set(mixed) <= {r[1] for r in rows} and mixed.count("short") <= 2


def test_repeated_rows_leave_one(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "lone words here"), (3, ""), (None, "A b c d e f"), (None, "lone words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s1").alias("source"), F.length("text").cast("long").alias("n_chars"))
    got = corpus_pipeline.drop_near_duplicates(spark, docs, D).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, "lone words here"), (1, "a b c d e f"), (3, "")]


def test_remove_benchmark_by_one_worker(spark):
    """Each function of Python in a task has a worker of its own, whose memory counts; the stage has one."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    plan = corpus_pipeline.remove_benchmark(spark, docs, D)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_run_small(spark):
    out = corpus_pipeline.run(spark, D)
    assert {"shard", "slot"} <= set(out.columns) and out.count() > 100
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontaminate", "mixing", "sharding"]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, D)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(str, (tuple(r[c] for c in cols) for r in got.collect()))) == sorted(map(str, want.select(*[f'"{c}"' for c in cols]).fetchall()))


def test_language_accuracy_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op3_language_id(spark, "/root/testdata/sf0.01").where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count()
    assert mixing.NONE not in {r[0] for r in got.select("lang_pred").distinct().collect()}
    assert language_id.UNKNOWN == "und"


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = queries.op2_quality(spark, d).where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted for r in got if r.quality) >= 0.9 * sum(r.quality for r in got)
    assert sum(1 - r.predicted for r in got if not r.quality) >= 0.5 * sum(1 - r.quality for r in got)
