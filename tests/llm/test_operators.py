"""Each operator over odd rows: nulls, empty and very long texts, ties, repeated rows, no rows, clashing columns; and against brute force."""

import gzip
import hashlib
import math
import os
import random
import re
import shutil
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from regimes.llm import bwt, components, decontaminate, fm_index, language_id, mixing, near_dup, quality, repeats, sharding, shingles, syncmers, url_filter, warc
from regimes.llm.common import new_folder, small_batches

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators use themselves.
CLASH = ["_bucket", "_slot", "_shard", "_found", "_d", "rows", "row", "host", "rule", "verdict", "path", "unit", "n", "count", "epoch", "tokens", "key"]
rng = random.Random(4)
WORDS = ["the", "of", "and", "thing", "ocean", "larder", "Größe", "élan", "niño", "über", "wherein", "stone"]


def prose(n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ly", str(rng.randrange(90))]) for _ in range(n))


LONG = prose(9000)


@pytest.fixture(scope="module")
def odd(spark):
    base = prose(120)
    near = base.replace(" of", " off", 1)
    rows = [
        (1, base, "en", "src1"), (2, near, "en", "src1"), (3, base, "en", "src1"), (3, base, "en", "src1"), (4, None, None, None), (5, "", "de", "src2"), (6, "a", None, "src2"),
        (7, LONG, "en", "src3"), (8, "x " + LONG[:3000], "fr", "src3"), (None, prose(40), "fr", None), (None, None, None, None), (9, " \t\n ", "es", "x"), (10, "12 34 56 78", "en", "src1"), (11, "De " * 300, "fr", "src1"), (12, "Zwölf Größen", "de", "src9"),
    ]
    df = spark.createDataFrame([(i, t, x, s, None if t is None else len(t)) for i, t, x, s in rows], SCHEMA)
    for c in CLASH:
        df = df.withColumn(c, F.lit(f"own {c}"))
    return df.repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(df):
    return [r[0] or "" for r in df.select("text").collect()]


def test_sharding(odd, none):
    got = sharding.shuffled(odd, shards=4, bucket_bytes=1000)
    assert set(odd.columns) | {"_slot", "_shard"} == set(got.columns)
    rows = got.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in odd.collect())
    counts = Counter(r._shard for r in rows)
    assert max(counts.values()) - min(counts.get(k, 0) for k in range(4)) <= 1
    for k in counts:
        assert sorted(r._slot for r in rows if r._shard == k) == list(range(counts[k]))
    assert sharding.shuffled(none).count() == 0


def test_sharding_more_shards_than_rows(spark):
    got = sharding.shuffled(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"), shards=40).collect()
    assert len(got) == 2 and all(r._slot == 0 for r in got)


def test_sharding_depends_on_seed_and_rows_only(spark, odd):
    rows = odd.unionByName(odd.limit(1).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit("copy " * 60)).crossJoin(spark.range(700)).drop("id"))
    place = lambda df, **more: Counter((r.doc_id, r.text, r._shard, r._slot) for r in sharding.shuffled(df, shards=7, bucket_bytes=4000, **more).collect())
    one = place(rows)
    assert one == place(rows.repartition(1)) == place(rows.repartition(9, "text"))
    assert one != place(rows, seed=8)
    copies = Counter(s for (i, t, s, _), n in one.items() if t == "copy " * 60)
    assert len(copies) == 7 and max(copies.values()) < 160


def test_fisher_yates(spark):
    df = spark.createDataFrame([(b, n) for b, n in enumerate([1, 2, 3, 5, 17, 64, 1000, 4097])], "bucket long, n long")
    got = {r.bucket: r.places for r in sharding.fisher_yates(df, 7).collect()}
    for r in df.withColumn("j", F.expr("transform(sequence(0, int(n) - 1), i -> pmod(xxhash64(7L, bucket, i), i + 1L))")).collect():
        at = [None] * r.n
        for i, j in enumerate(r.j):
            if j != i:
                at[i] = at[j]
            at[j] = i
        assert [at[p] for p in got[r.bucket]] == list(range(r.n))
    first = [r.places[0] for r in sharding.fisher_yates(spark.range(3000).select(F.col("id").alias("bucket"), F.lit(6).cast("long").alias("n")), 7).collect()]
    assert all(400 < first.count(k) < 600 for k in range(6))


def test_offsets(spark):
    counts = [(b, b % 7 + 1) for b in range(0, 9000, 3)]
    got = {r.bucket: r.offset for r in sharding.offsets(spark.createDataFrame(counts, "bucket long, n long")).collect()}
    total = 0
    for b, n in counts:
        assert got[b] == total
        total += n


def test_quality(spark, odd, none):
    good = [(i, prose(60), 1) for i in range(200)]
    bad = [(1000 + i, " ".join(w + "###" for w in prose(60).split()), 0) for i in range(80)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in good + bad] + [(5000, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.held_out(F.col("doc_id"), of=5, part=0)
    model = quality.fit(docs, labels, learn=~out)
    got = {r.doc_id: r.s for r in docs.where(out).select("doc_id", quality.score(model, F.col("text")).alias("s")).collect()}
    truth = {i: q for i, _, q in good + bad}
    assert min(s for i, s in got.items() if truth[i]) > max(s for i, s in got.items() if not truth[i])
    scores = [r[0] for r in odd.select(quality.score(model, F.col("text"))).collect()]
    assert len(scores) == odd.count() and all(0 <= s <= 1 for s in scores)
    assert none.select(quality.score(model, F.col("text"))).count() == 0
    tied = {r[0] for r in odd.where("doc_id IN (1, 3)").select(quality.score(model, F.col("text"))).collect()}
    assert len(tied) == 1
    lone = quality.fit(none, labels.where("quality = 1"))
    assert {r[0] for r in odd.select(quality.score(lone, F.col("text"))).collect()} == {1.0}
    assert quality.fit(none, labels.limit(0)).rate == 0.5


def test_quality_of_repeated_ids_and_by_plain_python(spark, monkeypatch):
    good, bad = [(i, prose(50), 1) for i in range(60)], [(1000 + i, " ".join(w + "###" for w in prose(50).split()), 0) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in good + bad] + [(7, f"again {n} " + prose(20)) for n in range(3000)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, q) for i, _, q in good + bad], "doc_id long, quality int")
    from pyspark.sql.classic.dataframe import DataFrame

    seen, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: seen.append(rows := collect(self)) or rows)
    model = quality.fit(docs, labels, rows_per_class=40)
    monkeypatch.undo()
    assert sum(len(r) for r in seen) <= 2 * 40 + 2  # and two rows of counts
    texts = ["", None, "word", good[0][1], bad[0][1] * 30]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(quality.score(model, F.col("t"))).collect()]
    for t, s in zip(texts, got):
        data = (t or "").encode()
        sizes = []
        for d in model.dictionaries:
            c = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(c.compress(data[i : i + quality.BLOCK])) for i in range(0, len(data), quality.BLOCK)))
        b, g = sizes
        x = [(b - g) / max(1, b + g), math.log(max((b + g) / max(2 * len(data), 1), 1e-3)), math.log1p(len(data))]
        x += [x[i] * x[j] for i in range(3) for j in range(i, 3)]
        z = model.weights[0] + sum(w * min(4, max(-4, (v - c) / k)) for w, v, c, k in zip(model.weights[1:], x, model.centre, model.scale))
        assert s == pytest.approx(1 / (1 + math.exp(-z)), abs=2e-6)


def test_held_out(spark):
    ids = [0, 1, 17, 123456, None]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").select(language_id.held_out(F.col("doc_id"))).collect()]
    assert got == [i is not None and zlib.crc32(str(i).encode()) % 3 == 1 for i in ids]


def test_language_id(spark, odd, none):
    stock = {"en": ["the", "and", "with", "thing", "other"], "de": ["und", "nicht", "schön", "auch", "einer"], "fr": ["les", "être", "pour", "avec", "où"]}
    rows = [(k * 1000 + i, " ".join(rng.choice(stock[x]) for _ in range(40)), x) for k, x in enumerate(stock) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, learn=~language_id.held_out(F.col("doc_id")))
    got = docs.where(language_id.held_out(F.col("doc_id"))).select("lang", language_id.predict(model, F.col("text")).alias("p")).collect()
    assert got and all(r.lang == r.p.lang and 0 < r.p.score <= 1 for r in got)
    for r in odd.select("text", language_id.predict(model, F.col("text")).alias("p")).collect():
        assert 0 <= r.p.score <= 1
        assert (r.p.lang == "und") == (not any(c.isalpha() for c in r.text or ""))
    far = ["".join(rng.choice("абвгдежзийклмнопрст  ") for _ in range(400)) for _ in range(20)] + ["".join(rng.choice("qzxjkvwbp  ") for _ in range(900)) for _ in range(20)]
    near = [" ".join(rng.choice(stock["de"]) for _ in range(n)) for n in (1, 5, 40, 300)]
    judged = spark.createDataFrame([(t, t in far) for t in far + near] + [("12 + 3", True), (None, True), ("x", False)], "t string, out boolean")
    wrong = judged.withColumn("p", language_id.predict(model, F.col("t"))).where(language_id.unlike(model, F.col("p")) != F.col("out")).collect()
    assert len(wrong) <= 1 and all(r.out for r in wrong)  # 3.5 deviations: one in some thousands
    same = docs.limit(1).union(docs.limit(1)).select(language_id.predict(model, F.col("text")).alias("p")).collect()
    assert same[0] == same[1]
    empty = language_id.fit(none)
    assert {r.p.lang for r in odd.select(language_id.predict(empty, F.col("text")).alias("p")).collect()} == {"und"}
    one = language_id.fit(docs.where("lang = 'en'"))
    assert {r.p.lang for r in docs.select(language_id.predict(one, F.col("text")).alias("p")).collect()} == {"en"}


def test_batches_for_python_are_bounded_by_bytes(spark):
    small_batches(spark)
    texts = spark.range(0, 100, 1, 1).select(F.repeat(F.lit("x"), 1_000_000).alias("text"))
    sizes = [r.size for r in texts.mapInPandas(lambda frames: (f[["text"]].map(len).agg(["sum"]).rename(columns={"text": "size"}) for f in frames), "size long").collect()]
    assert sum(sizes) == 100_000_000 and len(sizes) > 1 and max(sizes) < 70_000_000


def test_warc_round_trip(spark):
    big, cut = "x" * 1500, "ä" * 500
    rows = [
        (1, "http://a/", big), (5, "http://a/5", big), (5, "http://a/5", big), (2, None, big), (3, "http://b/\r\nX: y", cut), (4, "http://b/", cut), (6, "c", "same"), (7, "c", "same"),
        (8, "d", None), (9, "d", ""), (10, "e", "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1"), (11, "long", "ß" * 3_000_000), (12, "long", "ß" * 3_000_000), *((100 + i, "few", "hot") for i in range(300)), (None, "f", "y" * 2000), (None, "f", "y" * 2000), (None, "g", big),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record", F.lit("own"))
    path = warc.archive(pages)
    got = warc.resolve(warc.read_warc(spark, path)).collect()
    leaders = {}
    for i, _, h in rows:
        if i is not None:
            leaders[h or ""] = max(leaders.get(h or "", -1), i)
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        lead = leaders.get(h or "")
        again = len(b) >= 1000 and lead is not None and i != lead
        want[(i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", lead if again else None)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    recs = warc.read_warc(spark, path).where("record_type = 'response'").collect()
    assert Counter(r.payload for r in recs) <= Counter(h or "" for _, _, h in rows)
    payloads = spark.read.parquet(path.rsplit("/", 1)[0] + "/payloads")
    assert payloads.count() == len({h or "" for _, _, h in rows})
    assert warc.resolve(warc.read_warc(spark, warc.archive(pages.limit(0)))).count() == 0
    whole = warc.read_warc(spark, path)
    assert warc.lost_revisits(whole).count() == 0
    revisited = [r.refers_to for r in got if r.record_type == "revisit"]
    short = whole.where(~((F.col("record_type") == "response") & (F.col("page_id") == revisited[0])))
    assert [(r.refers_to, r.n) for r in warc.lost_revisits(short).collect()] == [(revisited[0], revisited.count(revisited[0]))]
    # Each record can be read alone, by its place.
    wanted = spark.createDataFrame([(5,), (5,), (2,), (10,), (777,), (None,)], "page_id int")
    ones = warc.lookup(spark, path, wanted).collect()
    assert Counter(r.page_id for r in ones) == {5: 2, 2: 1, 10: 1}
    assert {r.page_id: r.payload for r in ones} == {5: big, 2: None, 10: "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1"}
    for r in warc.index(spark, path).where("page_id IN (3, 12)").collect():
        with open(f"{path.removeprefix('file://')}/{r.file}", "rb") as f:
            f.seek(r.offset)
            record = gzip.decompress(f.read(r.length))  # one whole member
        assert record.startswith(b"WARC/1.1\r\n") and f"X-Page-Id: {r.page_id}\r\n".encode() in record and record.endswith(b"\r\n\r\n")


def test_warc_files_roll_over_and_lost_tries_are_not_read(spark):
    payloads, headers = warc.build(spark.range(50).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.col("id").cast("string").alias("html")))
    path = warc.write_warc(warc.records(payloads, headers), f"{new_folder(spark, 'warc')}/small", file_bytes=1000)
    places = warc.index(spark, path).collect()
    assert len(places) == 50 and len({r.file for r in places}) > 10
    top = path.removeprefix("file://")
    shutil.copy(f"{top}/{places[0].file}", f"{top}/part-lost.warc.gz")
    assert [r.file for r in warc.unnamed(spark, path).collect()] == ["part-lost.warc.gz"]
    assert sorted(r.page_id for r in warc.read_warc(spark, path).collect()) == list(range(50))
    with open(f"{top}/{places[0].file}", "r+b") as f:
        f.truncate(os.path.getsize(f.name) - 5)
    with pytest.raises(Exception, match="cut short"):
        warc.read_warc(spark, path).collect()


def test_warc_altered_payload_stops(spark):
    payloads, headers = warc.build(spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string"))
    with pytest.raises(Exception, match="no such payload"):
        warc.records(payloads.withColumn("payload", F.lit("other")), headers).collect()


def brute_repeats(bodies, length):
    seen = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        cover = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                cover[i : i + length] = [True] * length
        runs = sum(c and not p for p, c in zip([False, *cover], cover))
        out.append((len(b), sum(cover), runs, hashlib.sha256(bytes(x for x, c in zip(b, cover) if not c)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [4096, 3])
def test_repeats(spark, odd, none, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    passage, other = prose(90), prose(70)
    docs = [prose(20) + passage + prose(30), passage[:450], passage[3:480] + prose(10) + other, other + prose(3) + other, prose(5) + passage[40:470], "ab" * 900, "b" * 399, "b" * 400, "ü" * 300]
    rows = [(100 + i, t) for i, t in enumerate(docs)] + [(r.doc_id, r.text) for r in odd.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_spans", F.lit("own"))
    got = repeats.remove_repeats(df).collect()
    want = brute_repeats([(t or "").encode() for _, t in rows], 400)
    assert Counter((r.doc_id, r._n_bytes, r._n_removed, r._n_spans, hashlib.sha256(r._kept).hexdigest()) for r in got) == Counter((i, *w) for (i, _), w in zip(rows, want))
    assert repeats.remove_repeats(none).count() == 0


def test_repeats_planted_passages(spark):
    """Passages of 50 to 100 words, of which those of at least 400 bytes are repeats, among documents of sf0.01."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    some, passages = random.Random(6), []
    for n in range(50, 101, 2):
        passages.append(" ".join(some.choice(WORDS) + some.choice("aeiou") * some.randrange(4) for _ in range(n)))
    rows = docs + [(100_000 + k * 3 + j, prose(60) + " " + p + " " + prose(50)) for k, p in enumerate(passages) for j in range(3)]
    got = {r.doc_id: r for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(16)).drop("text").collect()}
    bodies = [(t or "").encode() for _, t in rows]
    # Windows are compared by a rolling hash of another kind than the operator's.
    lengths = [len(b) for b in bodies]
    data = np.frombuffer(b"".join(bodies), np.uint8).astype(np.uint64)
    rolled = np.zeros(len(data) - 399, np.uint64)
    step = np.uint64(6364136223846793005)
    for k in range(400):
        rolled = rolled * step + (data[k : k + len(rolled)] + np.uint64(1)) * np.uint64(2862933555777941757)
    ends = np.cumsum(lengths)
    inside = np.ones(len(rolled), bool)
    for e in ends[:-1]:
        inside[max(0, e - 399) : e] = False
    at = np.flatnonzero(inside)
    _, back, n = np.unique(rolled[at], return_inverse=True, return_counts=True)
    cover = np.zeros(len(data) + 1, np.int64)
    np.add.at(cover, at[n[back] > 1], 1)
    np.add.at(cover, at[n[back] > 1] + 400, -1)
    hit, caught = np.cumsum(cover)[:-1] > 0, 0
    for (i, _), b, e in zip(rows, bodies, ends):
        h = hit[e - len(b) : e]
        runs = np.count_nonzero(h & ~np.concatenate([[False], h[:-1]])) if len(h) else 0
        kept = np.frombuffer(b, np.uint8)[~h].tobytes()
        assert (got[i]._n_bytes, got[i]._n_removed, got[i]._n_spans, bytes(got[i]._kept)) == (len(b), int(h.sum()), runs, kept), i
    for k, p in enumerate(passages):
        for j in range(3):
            assert (got[100_000 + k * 3 + j]._n_removed > 0) == (len(p.encode()) + 2 >= 400)
            caught += got[100_000 + k * 3 + j]._n_removed > 0
    assert 0 < caught < 3 * len(passages)


def test_bwt_merge():
    g = np.random.default_rng(0)
    for _ in range(60):
        shards = [[g.integers(1, 4, g.integers(1, 12)).tolist() for _ in range(g.integers(1, 6))] for _ in range(g.integers(1, 4))]
        made = [bwt.transform(np.array(sum(s, []), np.int64), np.array([len(x) for x in s])) for s in shards]
        depth = int(g.integers(1, 6))
        rows, prefix = bwt.merge(made, depth)
        suffixes = [tuple(shards[k][t.string[i]][t.start[i] :]) for k, t in enumerate(made) for i in range(len(t.symbol))]
        assert sorted(rows.tolist()) == list(range(len(suffixes)))
        order = [suffixes[r][:depth] for r in rows]
        assert order == sorted(order)
        for a, b, p in zip(order, order[1:], prefix[1:]):
            assert p == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_fm_index():
    g = np.random.default_rng(1)
    for _ in range(60):
        text = g.integers(0, 4, g.integers(1, 60))
        index = fm_index.FMIndex(text, 4)
        phrases = g.integers(1, 5, (10, 3))
        lengths = g.integers(1, 4, 10)
        low, high = index.search(np.where(phrases > 3, 0, phrases), lengths)
        for p, n, a, b in zip(phrases, lengths, low, high):
            want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p[:n]).all()]
            assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


def brute_hits(docs, items, window):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    out = []
    for t in docs:
        w, hit, found = words(t), set(), set()
        for item, b in items:
            v = words(b)
            n = min(len(v), window)
            grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit.update(range(i, i + n))
                    found.add(item)
        out.append((len(w), len(hit), sorted(x for x in found if x is not None)))
    return out


@pytest.mark.parametrize("block_bytes", [8 << 20, 60])
def test_decontaminate(spark, odd, none, block_bytes):
    item = prose(25)
    items = [("1", item), ("10", prose(14)), ("2", "The  OCEAN"), ("3", None), ("4", "..."), ("5", item), (None, "Zwölf Größen")]
    docs = [item.upper(), prose(4) + " " + " ".join(item.split()[3:15]) + "! " + prose(4), "the ocean; of the ocean", "Zwölf-Größen", prose(3) + item + item]
    rows = [(100 + i, t) for i, t in enumerate(docs)] + [(r.doc_id, r.text) for r in odd.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_more", F.lit("own"))
    got = decontaminate.find(df, spark.createDataFrame(items, "item_id string, text string"), block_bytes=block_bytes)
    cut = got.withColumn("cut", decontaminate.removed(F.col("text"), F.col("_found.spans"))).collect()
    want = Counter((i, n, h, tuple(x)) for (i, _), (n, h, x) in zip(rows, brute_hits([t for _, t in rows], items, 10)))
    assert Counter((r.doc_id, r._found.n_words, sum(s.end - s.start for s in r._found.spans), tuple(r._found["items"])) for r in cut) == want
    for r in cut:
        left = brute_hits([r.cut], [], 10)[0][0]
        assert left == r._found.n_words - sum(s.end - s.start for s in r._found.spans)
    plan = got._jdf.queryExecution().executedPlan().toString()  # documents are read once and not dealt anew, for one block and for many
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan and "Join" not in plan
    assert decontaminate.find(none, spark.createDataFrame(items, "item_id string, text string")).count() == 0
    assert all(not r._found.spans for r in decontaminate.find(df, spark.createDataFrame([], "item_id string, text string")).collect())


@pytest.mark.parametrize("block_bytes", [8 << 20, 60])
def test_decontaminate_rest(spark, odd, block_bytes):
    """The text that is left comes from the worker that found the spans, and is what ``removed`` makes of them."""
    item = prose(25)
    docs = [item, prose(4) + " " + item + "! " + prose(4) + item, "no hit", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*docs, *(r.text for r in odd.collect())])], "doc_id long, text string")
    items = spark.createDataFrame([("1", item), ("2", "The  OCEAN")], "item_id string, text string")
    got = decontaminate.find(df, items, block_bytes=block_bytes, rest=True).withColumn("cut", decontaminate.removed(F.col("text"), F.col("_found.spans"))).collect()
    assert sum(len(r._found.spans) > 0 for r in got) >= 2
    for r in got:
        assert r._found.rest == (r.cut if r._found.spans else None)


def test_mixing_budgets(spark):
    leaves = [("a", "x", 100.0, 0.7, 1.0), ("a", "y", 10.0, 0.7, 1.0), ("b", "x", 1000.0, 0.3, 1.0), ("b", "z", 1000.0, 0.3, 0.0)]
    df = spark.createDataFrame(leaves, "domain string, lang string, capacity double, w_domain double, w_lang double")
    got = {(r.domain, r.lang): r.budget for r in mixing.allocate(df, ["domain", "lang"], 100).collect()}
    # y falls short by 25: its sibling x takes that, not the other domain.
    assert got == {("a", "x"): 60, ("a", "y"): 10, ("b", "x"): 30, ("b", "z"): 0}
    got = {(r.domain, r.lang): r.budget for r in mixing.allocate(df, ["domain", "lang"], 1000).collect()}
    assert got == {("a", "x"): 100, ("a", "y"): 10, ("b", "x"): 890, ("b", "z"): 0}


def test_mixing(odd, none, monkeypatch):
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    for rows_in_range in (1000, 2):
        monkeypatch.setattr(mixing, "BUCKET_ROWS", rows_in_range)
        got = mixing.mix(odd, levels, {"lang": {"en": 0.2}}, share=1.5, max_epochs=3).collect()
        held = {r.doc_id: len(re.findall(r"[^ \t\n\x0B\f\r]+", r.text or "")) for r in odd.collect() if r.doc_id is not None}
        assert all(r.tokens == held[r.doc_id] and 0 <= r.taken <= r.tokens and r.epoch < 3 for r in got if r.doc_id is not None)
        total = sum(len((t or "").split()) for t in texts(odd))
        assert total * 1.5 - 20 <= sum(r.taken for r in got) <= total * 1.5
        again = mixing.mix(odd.repartition(1), levels, {"lang": {"en": 0.2}}, share=1.5, max_epochs=3).collect()
        assert Counter((r.key, r.epoch, r.taken) for r in got) == Counter((r.key, r.epoch, r.taken) for r in again)
    assert mixing.mix(none, levels, {}).count() == 0


def test_url_filter(spark):
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.net", "/en/x", "block"), ("a.org", "", "block"), (None, "/", "block"), ("tie.com", "/", "allow"), ("tie.com", "/", "block"), ("net", "/", "block"), ("ab.eu", "/b", "allow"), ("b.eu", "/ab", "allow"), ("even.eu", "/", "allow"), ("odd.even.eu", "", "block"), ("x.same.eu", "/y", "block"), ("same.eu", "/y/z", "block")], "host string, path string, action string")
    cases = {
        "http://X.Example.NET/en/a?q#f": ("x.example.net", "/en/a", "example.net/en/", "allow"), "http://example.net/en/xy": ("example.net", "/en/xy", "example.net/en/x", "block"), "http://badexample.net/": ("badexample.net", "/", "net/", "block"),
        "http://example.net": ("example.net", "", None, "allow"), "http://example.net?x=/en/": ("example.net", "", None, "allow"), "https://q.a.org": ("q.a.org", "", "a.org", "block"), "no scheme/net/": ("", "", None, "allow"), None: ("", "", None, "allow"),
        "": ("", "", None, "allow"), "://net/": ("net", "/", "net/", "block"), "http:///net/": ("", "/net/", None, "allow"), "http://tie.com/": ("tie.com", "/", "tie.com/", "block"), "http://com/" + "a/" * 20000: ("com", "/" + "a/" * 20000, None, "allow"),
        "http://x.same.eu/y/z": ("x.same.eu", "/y/z", "same.eu/y/z", "block"), "http://net/" + "q" * 300000: ("net", "/" + "q" * 300000, "net/", "block"), "http://a.net/?" + "q" * 300000: ("a.net", "/", "net/", "block"),
        "http://a://net/": ("a:", "//net/", None, "allow"), "http://net./": ("net.", "/", None, "allow"), "http://ÄB.net/\nx": ("Äb.net", "/\nx", "net/", "block"),
    }
    rows = [(i, u) for i, u in enumerate([*cases, *cases])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("key", F.lit(1)).withColumn("host", F.lit("own"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()}
    assert got == {i: cases[u] for i, u in rows}
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, rules.limit(0)).collect()} == {"allow"}


def sketch(b):
    h = lambda x: (lambda v: v - (1 << 64) if v >> 63 else v)(xxhash.xxh64_intdigest(x, seed=42))
    n, k, s, found = len(b), syncmers.K, syncmers.S, {}
    if n >= k:
        inner = [h(b[i : i + s]) for i in range(n - s + 1)]
        at = [(i, b[i : i + k]) for i in range(n - k + 1) if min(inner[i : i + k - s + 1]) in (inner[i], inner[i + k - s])]
    else:
        at = [(i, b[i : i + 2] + b"\x02") for i in range(max(n - 1, 1))] if n else []
    for i, gram in at:
        found.setdefault(h(gram) >> syncmers.BITS, i + 1)
    return [(x << syncmers.BITS) | found[x] for x in sorted(found)]


def test_syncmers(spark, odd, none):
    rows = [(r.doc_id, r.text or "") for r in odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect()]
    got = {r.doc_id: r for r in syncmers.fingerprints(odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])).collect()}
    text = lambda s: ",".join("%x" % (v & ((1 << 64) - 1)) for v in s)

    def like(a, b):
        a, b = ({v >> syncmers.BITS for v in s} for s in (a, b))
        u = sorted(a | b)
        n = sum(x in a and x in b for x in u)
        return 1.0 if not u else round(2 * n / (len(u) + n), 6)

    rows.sort()
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        e = t[: len(t) - q] + nxt[:q]
        a, b, c = sketch(t.encode()), sketch(e.encode()), sketch(nxt.encode())
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(e.encode()).hexdigest(), text(a), text(b)), i
        assert (r.near_edited, r.near_next) == pytest.approx((like(a, b), like(a, c)), abs=1e-5)
    assert syncmers.fingerprints(odd).count() == odd.count()
    assert syncmers.fingerprints(none).count() == 0
    assert syncmers.fingerprints(odd.where("doc_id = 1")).first().near_next == 1.0


def test_syncmers_keep_all_anchors_and_match_by_place(spark):
    some = random.Random(9)
    letters = lambda n: "".join(some.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passage, swapped = letters(400), [letters(3000) for _ in range(4)]
    texts = [letters(20000) + passage + letters(9000), letters(5000) + passage + letters(24000), "".join(swapped), "".join(swapped[::-1]), "", "short", "De " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in syncmers.fingerprints(df).collect()}

    def placed(a, b):
        a, b = ({v >> syncmers.BITS: v & ((1 << syncmers.BITS) - 1) for v in sketch(t.encode())} for t in (a, b))
        most = max(Counter(b[x] - a[x] for x in a if x in b).values(), default=0)
        return 1.0 if not a and not b else round(2 * most / (len(a) + len(b)), 6)

    for i, t in enumerate(texts):
        nxt, q = texts[(i + 1) % len(texts)], len(t) // 4
        assert len(got[i].fingerprint.split(",")) == max(1, len(sketch(t.encode())))
        assert (got[i].placed_edited, got[i].placed_next) == pytest.approx((placed(t, t[: len(t) - q] + nxt[:q]), placed(t, nxt)), abs=1e-6), i
    # A passage of 400 in 30,000 bytes shows; blocks in another order are alike, but not in place.
    assert len(got[0].fingerprint.split(",")) > 5000
    assert 0.008 < got[0].placed_next < 0.02
    assert got[2].near_next > 0.95 and got[2].placed_next < 0.3


def brute_groups(rows, k=5):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w)} if 0 < len(w) < k else {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    group = {i: i for i in sets}

    def find(x):
        return x if group[x] == x else find(group[x])

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                ra, rb = find(a), find(b)
                group[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("unit", [1 << 20, 3000, 300, 60])
def test_near_dup(spark, odd, none, unit, monkeypatch):
    monkeypatch.setattr(near_dup, "UNIT", unit)
    rows = [(r.doc_id, r.text) for r in odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect()]
    base = prose(80).split()
    chain = list(base)
    for i in range(25):  # each is near the one before it, and far from the first in the end
        chain[(i * 3) % 80] = f"new{i}"
        rows.append((200 + i, " ".join(chain)))
    rows += [(300 + i, " ".join(base[: 60 + i])) for i in range(20)] + [(400, "One TWO three"), (401, "one two\tthree"), (402, "one two")]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = brute_groups(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    if unit > 1000:
        whole = near_dup.near_duplicates(odd).collect()
        assert len(whole) == odd.count()
        assert sum(r.kept for r in whole if r.doc_id == 3) == 0 and sum(r.kept for r in whole if r.doc_id == 1) == 1
        assert near_dup.near_duplicates(none).count() == 0


def test_near_dup_finds_all_links(spark):
    """Every link of sf0.1, by a join of rare shingles that no pair of similarity 0.75 can miss."""
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect()
    split = re.compile(r"[^\x20\x09-\x0D]+")
    sets, ids = {}, {}
    for r in rows:
        w = split.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or ""))
        s = frozenset([tuple(w)] if 0 < len(w) < 5 else (tuple(w[j : j + 5]) for j in range(len(w) - 4)))
        ids.setdefault(s, []).append(r.doc_id)
        sets[r.doc_id] = s
    number, df = {}, Counter(g for s in ids for g in s)
    for g, _ in sorted(df.items(), key=lambda x: x[1]):
        number[g] = len(number)
    group = {min(v): min(v) for v in ids.values()}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    seen, links = {}, 0
    for s, own in ids.items():
        n, near = len(s), set()
        for g in sorted(s, key=number.get)[: n - -(-n * 3 // 4) + 1]:
            near.update(seen.get(g, ()))
            seen.setdefault(g, []).append(s)
        for t in near:
            both = len(s & t)
            if 100 * both >= 75 * (n + len(t) - both):
                links += 1
                a, b = sorted((root(min(own)), root(min(ids[t]))))
                group[b] = a
    assert links > 100
    got = {r.doc_id: r for r in near_dup.near_duplicates(spark.createDataFrame(rows)).collect()}
    for s, own in ids.items():
        for i in own:
            assert (got[i].n_shingles, got[i].component_id) == (len(s), root(min(own)) if s else i)


def test_near_dup_representatives(spark, odd, none):
    base = prose(60)
    near = base.replace(" of", " off", 1)
    rows = [(None, base), (1, near), (None, prose(50)), (2, "few words"), (None, "few words"), (None, "few  words"), (None, None), (3, None), (None, "lone text"), (None, "lone text"), (5, "of one id"), (5, "and of another")]
    rows += [(None, rows[2][1]), (None, rows[2][1] + " x")]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, row int").repartition(3)
    got = [(r.doc_id, r.text) for r in near_dup.representatives(df).collect()]
    assert Counter(x for x in got if x[1] is None) == {(None, None): 1, (3, None): 1}
    assert (1, near) in got and (None, base) not in got and (2, "few words") in got and sum("few" in (t or "") for _, t in got) == 1
    assert got.count((None, "lone text")) == 1 and sum((t or "").startswith(rows[2][1]) for _, t in got) == 1
    assert len({t for i, t in got if i == 5}) == 1  # rows of one id are one node
    whole = near_dup.representatives(odd)
    assert whole.columns == odd.columns and len(near_dup.representatives(none).collect()) == 0
    assert Counter(r.doc_id for r in whole.collect())[3] == 0


def test_shared_folder_is_asked_for(spark):
    from types import SimpleNamespace

    from regimes.llm import common

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(cluster)
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_shingles_and_signatures():
    a, b, c, d = shingles.shingle_sets(["A b  c d E\tf", "a B c d e f", None, " "])
    assert len(a) == 2 and (a == b).all() and not len(c) and not len(d)
    sig = shingles.signatures([a, b, c], 8)
    assert (sig[0] == sig[1]).all() and not sig[2].any()
    big = [np.arange(1, 2000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.arange(500, 2500, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)]
    sig = shingles.signatures([shingles.mix(x) for x in big], 400)
    assert abs((sig[0] == sig[1]).mean() - 1500 / 2500) < 0.12


def test_components(spark):
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 420)] + [(7, 7), (500, None)]
    group = {}

    def find(x):
        group.setdefault(x, x)
        return x if group[x] == x else find(group[x])

    for a, b in pairs:
        if b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            group[b] = a
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in group}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
