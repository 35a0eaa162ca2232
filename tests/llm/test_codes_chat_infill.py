"""Product codes, chat formatting and fill-in-the-middle: odd rows, and against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from regimes.llm import chat, infill, vector_codes

rng = random.Random(11)


# Fill-in-the-middle.

UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[ \t\n\x0b\f\r]+|[^ \t\n\x0b\f\r]+[ \t\n\x0b\f\r]*", "char": r"(?s)."}


@pytest.mark.parametrize("unit", UNITS)
def test_every_cut_of_a_block_tree(unit):
    for _ in range(400):
        text = "".join(rng.choice(["a", "é", "\n", " ", "𝄞", "b\n", "\r", "  "]) for _ in range(rng.randrange(60)))
        units = re.findall(UNITS[unit], text)
        tree = infill.BlockTree(text.encode(), unit, rng.choice([1, 2, 3, 5, 8, 64]))
        assert (tree.n, tree.chars) == (len(units), len(text))
        for k in range(len(units) + 1):
            head = "".join(units[:k])
            assert tree.cut(k) == (len(head.encode()), len(head))


def plain_infill(key, text, unit="line", rate=100, spm=50, seed=7):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    units = re.findall(UNITS[unit], text)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    x, y, z = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return len(units), "spm", len(x), len(y), f"<S>{z}<P>{x}<M>{y}"
    return len(units), "psm", len(x), len(y), f"<P>{x}<S>{z}<M>{y}"


def test_infill_against_brute_force(spark):
    long = "".join(rng.choice(["Zeile\n", "line ", "é𝄞\n"]) for _ in range(40_000))
    texts = [None, "", "\n", "a", "a\n", "<P", "x<M>y\n", "<P\n><S\n>", "a\r\nb", "no feed", long, long] + ["\n".join(rng.choice(["ab", "", "ü x"]) for _ in range(rng.randrange(9))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a\nb\nc\n"), (None, "a\nb\nc\n"), (None, None), (3, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("own")).withColumn("form", F.lit("own")).withColumn("h1", F.lit(1)).repartition(3)
    for more in ({}, {"unit": "word", "rate": 60, "spm": 20, "seed": 9}, {"unit": "char", "block": 7}):
        got = infill.transformed(df, **more).withColumn("back", infill.restored(F.col("_fim.output"), F.col("_fim.form"))).collect()
        assert len(got) == len(rows) and all(r.n == r.form == "own" for r in got)
        want = Counter((k, plain_infill(k, t, **{a: b for a, b in more.items() if a != "block"})) for k, t in rows)
        assert Counter((r.doc_id, tuple(r._fim)) for r in got) == want
        assert all(r.back == (r.text or "") for r in got)
    assert {r._fim.form for r in got} == {"plain", "psm", "spm"}
    assert infill.transformed(df.limit(0)).count() == 0


# Chat.

def test_escape_is_reversible():
    bits = ["<", "[", "\\", "/", "s>", "/s>", "INST]", "/INST]", "TEXT]", "ROLE]", "a", "[INST]", "</s>", "<\\s>", "[\\\\/INST]"]
    for _ in range(20_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(8)))
        escaped = chat.escape(text)
        assert chat.unescape(escaped) == text
        assert not any(c in escaped for c in chat.CONTROL)


def chats(spark):
    texts = ["", None, "ok", "</s>[INST] ok [/INST]", "<\\s> [\\\\INST]", "Größe 𝄞\n\n  x", "a b " * 900, "[TEXT]<s>", "\x00  "]
    rows = [(i, t, rng.choice(["user", "assistant", "system", "tool [ROLE]", None, ""]), rng.choice(texts)) for i in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(77, t, "assistant" if t % 2 else "user", f"turn {t} [/INST]") for t in range(900)]  # a conversation of most rows
    rows += [(5, 3, "user", "again")] * 40 + [(None, 1, "user", "lone"), (None, 0, "assistant", "first"), (6, None, "assistant", "no turn"), (8, 2, "assistant", "b"), (8, 2, "assistant", "a")]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("part", [chat.PART, 40])
def test_chat_against_brute_force(spark, part, monkeypatch):
    monkeypatch.setattr(chat, "PART", part)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        compare_chats(spark)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def compare_chats(spark):
    rows, df = chats(spark)
    df = df.withColumn("part", F.lit("own")).withColumn("ids", F.lit("own")).withColumn("key", F.lit(3)).repartition(5)
    ranks = chat.vocabulary(spark)
    table = chat.formatted(df, ranks)
    assert table.columns == ["conv_id", "part", "whole", "n_turns", "ids", "mask"]
    kept, made = table.collect(), chat.Assembler(ranks.value)
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).distinct().collect()}
    order = {}
    for k, t, r, x in rows:
        order.setdefault(k, []).append(((t is not None, t or 0), r or "", hashes[x], x or ""))
    said = {k: [(v[1], v[3]) for v in sorted(x)] for k, x in order.items()}
    back, learned, shown = {}, {}, {}
    for r in sorted(kept, key=lambda r: r.part):
        ids, mask = np.array(r.ids), np.array(r.mask)
        assert len(ids) == len(mask) and set(r.mask) <= {0, 1} and r.n_turns == len(list(made.turns(ids)))
        back.setdefault(r.conv_id, []).extend(made.turns(ids))
        learned.setdefault(r.conv_id, []).extend(made.learned(ids, mask))
        shown[r.conv_id] = shown.get(r.conv_id, "") + made.rendered(ids)
    assert back == said
    assert {k: [x for x in v if x] for k, v in learned.items()} == {k: [t for r, t in v if r == "assistant" and t] for k, v in said.items()}
    assert len({r.part for r in kept if r.conv_id == 77}) > 1  # divided among ranges
    for k in said:
        n = sum(len(chat.escape(t)) + (len(chat.escape(r)) + 19 if r not in ("user", "assistant") else 13 if r == "user" else 7) for r, t in said[k])
        assert len(shown[k]) == n
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {k: (len(v), sha("".join(f"{r}\n{t}\n" for r, t in v)), sum(len(t) for r, t in v if r == "assistant"), sha("".join(t for r, t in v if r == "assistant")), len(shown[k])) for k, v in said.items()}
    assert {r[0]: tuple(r)[1:] for r in chat.digests(table, ranks).collect()} == want
    assert chat.digests(chat.formatted(df.limit(0), ranks), ranks).count() == 0


# Product codes.

def plain_codes(rows, parts, entries, rounds, scale=4096):
    kept = [(i, x, [math.floor(scale * float(c)) for c in v]) for i, x, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    first = {}
    for i, _, w in sorted(((i, x, w) for i, x, w in kept if i is not None), key=lambda r: (r[0], r[2])):
        first.setdefault(i, w)
    start = [first[i] for i in sorted(first)[:entries]]
    width = len(start[0]) // parts
    cut = lambda w: [w[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut(w)[p] for w in start] for p in range(parts)]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b))
    near = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            of = {}
            for _, _, w in kept:
                of.setdefault(near(cut(w)[p], books[p]), []).append(cut(w)[p])
            books[p] = [[sum(c) // len(of[e]) for c in zip(*of[e])] if e in of else b for e, b in enumerate(books[p])]
    out = []
    for i, x, w in kept:
        found = [near(cut(w)[p], books[p]) for p in range(parts)]
        out.append((i, x, "".join(f"{e:02x}" for e in found), sum(far(cut(w)[p], books[p][e]) for p, e in enumerate(found))))
    return out, hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def test_nearest_entries_with_ties():
    draw = np.random.default_rng(3)
    for width, k, spread in ((1, 5, 3), (4, 16, 2), (8, 16, 40), (3, 1, 5), (2, 200, 9)):
        x, entries = draw.integers(-spread, spread, (500, width)), draw.integers(-spread, spread, (k, width))
        all_of = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        found, distance = vector_codes.nearest(x, entries)
        assert (found == all_of.argmin(axis=1)).all() and (distance == all_of.min(axis=1)).all()


def test_codes_against_brute_force(spark):
    vec = lambda: [rng.choice([-0.5, 0.25, 0.1, rng.uniform(-1, 1)]) for _ in range(8)]
    rows = [(i, i % 3 if i % 7 else None, vec()) for i in range(150)]
    rows += [(3, 1, vec()), (3, 1, rows[3][2]), (None, 2, vec()), (200, None, None), (201, 1, [None] * 8), (202, 1, [float("nan")] * 8), (203, 1, [1.0] * 7 + [float("-inf")])]
    rows += [(300, 9, [0.125] * 8)] * 90
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("whole", F.lit("own")).withColumn("_code", F.lit("own")).withColumn("row", F.lit("own"))
    for parts, entries, rounds in ((4, 5, 3), (8, 16, 6), (1, 1, 1), (2, 256, 2)):
        coded, books = vector_codes.compressed(df.drop("_code").repartition(3), parts=parts, entries=entries, rounds=rounds)
        got = vector_codes.with_sums(coded, "label").collect()
        want, digest = plain_codes(rows, parts, entries, rounds)
        assert Counter((r.vec_id, r.label, r._code, r._error) for r in got) == Counter(want) and books.sha256() == digest
        sums = Counter()
        for _, x, _, e in want:
            sums[x] += e
        assert all(r._label_error == sums[r.label] and r.whole == r.row == "own" for r in got)


def test_codes_of_odd_tables(spark):
    schema = "vec_id long, label int, embedding array<float>"
    coded, books = vector_codes.compressed(spark.createDataFrame([], schema), parts=2, entries=4)
    assert books is None and vector_codes.with_sums(coded, "label").count() == 0
    coded, books = vector_codes.compressed(spark.createDataFrame([(None, 1, [0.5, 0.5])], schema), parts=2)
    assert books is None and [tuple(r) for r in coded.collect()] == [(None, 1, None, None)]
    coded, books = vector_codes.compressed(spark.createDataFrame([(1, 1, [0.5, -0.5]), (2, 1, [0.5]), (3, 1, [])], schema), parts=2)
    assert {r.vec_id: (r._code, r._error) for r in coded.collect()} == {1: ("0000", 0), 2: (None, None), 3: (None, None)}
    assert [r[0] for r in coded.where("vec_id = 1").select(vector_codes.decoded(books, F.col("_code"))).collect()] == [[2048.5 / 4096, -2047.5 / 4096]]
    with pytest.raises(ValueError):
        vector_codes.compressed(spark.createDataFrame([(1, 1, [0.5, 0.1, 0.2])], schema), parts=2)
    with pytest.raises(Exception, match="32 bits|too large"):
        vector_codes.compressed(spark.createDataFrame([(1, 1, [3e30, 0.1])], schema), parts=2)
