"""Exact decimals, nested elements of pages, and the sink of one file: against Python's own."""

import csv
import math
import random
import struct
from html.parser import HTMLParser
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from regimes.functions import rounding, scalars
from regimes.sources import single_file, sinks

rng = random.Random(8)


def test_decimals_of_exact_binary_values(spark):
    xs = [0.0, -0.0, 5e-7, 1.5e-6, 2.5e-6, 2.675, 0.0078125, 0.0234375, -0.0078125, 1e-300, 5e-324, 1e22, 1e23, 2.0**53, 2.0**53 - 1, 2.0**63, 2.0**100, -1e-9, 0.9999995, 4503599627370497.5, math.nan, math.inf, -math.inf]
    xs += [rng.uniform(-1, 1) * 10 ** rng.randrange(-9, 20) for _ in range(1500)] + [rng.randrange(-(10**9), 10**9) / 2 ** rng.randrange(1, 12) for _ in range(1500)]
    xs += [(rng.randrange(10**9) + 0.5) / 1e6 for _ in range(1500)] + [x for x in (struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0] for _ in range(1500)) if not 2.0**123 <= abs(x) < math.inf]
    df = spark.createDataFrame([(x,) for x in [*xs, None]], "x double")
    out = df.select("x", sinks.fixed6(F.col("x")).alias("t"), scalars.round6(F.col("x")).alias("r"), rounding.round_even(F.col("x"), 4).alias("q"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        if r.x is None or not math.isfinite(r.x):
            assert r.t == ""
        else:
            assert (r.t, r.r, r.q) == (f"{r.x:.6f}", round(r.x, 6), round(r.x, 4))


class Elements(HTMLParser):
    """Where tracked elements begin and end in the text, by a stack."""

    def __init__(self, page):
        super().__init__(convert_charrefs=False)
        self.page, self.lines, self.open, self.found = page, [0], [], []
        for line in page.splitlines(keepends=True):
            self.lines.append(self.lines[-1] + len(line))
        self.feed(page)
        self.close()
        self.found += [(n, a, b, len(page), len(page)) for n, a, b in self.open if n in scalars.CONTAINERS]

    def place(self):
        line, col = self.getpos()
        return self.lines[line - 1] + col

    def handle_starttag(self, tag, attrs):
        if tag in scalars.CONTAINERS + scalars.BOILERPLATE:
            self.open.append((tag, self.place(), self.place() + len(self.get_starttag_text())))

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        for i in reversed(range(len(self.open))):
            if self.open[i][0] == tag:
                self.found.append((*self.open[i], self.place(), self.page.index(">", self.place()) + 1))
                del self.open[i:]
                return


def plain_main(page):
    e = Elements(page).found
    for c in scalars.CONTAINERS:
        held = sorted((a, b, x, y) for n, a, b, x, y in e if n == c and page[b:x])
        if held:
            start, end = held[0][1], held[0][2]
            break
    else:
        start, end = 0, len(page)
    cuts = sorted((a, y) for n, a, _, _, y in e if n in scalars.BOILERPLATE and a >= start and y <= end)
    out, at = [], start
    for a, b in cuts:
        if a >= at:
            out += [page[at:a], " "]
            at = b
    return "".join(out) + page[at:end]


def test_main_of_nested_elements(spark):
    pages = [
        "<body><main>a<main>b</main>c</main>d</body>", "<article>x</article><main></main><body>y</body>", "<main>never closed <nav>n", "<body>a<nav>1<nav>2</nav>3</nav>b</nav>c</body>",
        "<header><main>in a header that is never closed</main>", "no tags < at all", "", "<MAIN class='a>b'>q</Main >r", "<body><form>f<aside>g</form>h</aside>i</body>", "<main>s<svg/>t<svg>u</svg>v</main>",
    ]
    names = [*scalars.CONTAINERS, *scalars.BOILERPLATE, "div"]
    for _ in range(250):
        pages.append("".join(rng.choice([f"<{n}>", f"</{n}>", f"<{n} a=1>", "text ", f"<{n}/>", "\n"]) for n in rng.choices(names, k=rng.randrange(14))))
    got = spark.createDataFrame([(i, p) for i, p in enumerate([*pages, None])], "i int, p string").select("i", "p", scalars.main_html(F.col("p")).alias("m")).collect()
    for r in got:
        assert r.m == (None if r.p is None else plain_main(r.p)), r.p
    assert spark.createDataFrame([("<body>a<!-- <main>no</main> -->b</body>",)], "p string").select(scalars.main_html(F.col("p"))).first()[0] == "a b"


def test_one_ordered_file(spark, tmp_path):
    rows = [(i, rng.choice([None, "a,b", 'say "x"', "", "é"]), i / 3) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, s string, v double").repartition(7)
    path = tmp_path / "out.csv"
    sinks.write_csv_file(df, str(path), ["k"])
    with path.open(newline="") as f:
        got = list(csv.reader(f))
    assert got == [["k", "s", "v"], *[[str(k), s or "", f"{v:.6f}"] for k, s, v in rows]]
    assert [p.name for p in tmp_path.iterdir()] == ["out.csv"]
    # A task that fails leaves the older file as it was, and nothing beside it.
    before = path.read_bytes()
    bad = df.withColumn("v", F.when(F.col("k") == 499, F.raise_error(F.lit("broken row"))).otherwise(F.col("v")).cast("double"))
    with pytest.raises(Exception, match="broken row"):
        sinks.write_csv_file(bad, str(path), ["k"])
    assert path.read_bytes() == before and [p.name for p in tmp_path.iterdir()] == ["out.csv"]
    with pytest.raises(Exception, match="FileExistsError|out.csv"):
        sinks.write_csv_file(df, str(path), ["k"], overwrite=False)
    sinks.write_csv_file(df.limit(0), f"file://{path}", ["k"])
    assert Path(path).read_text() == "k,s,v\n"


def test_one_file_from_parts_in_pieces(spark, tmp_path, monkeypatch):
    """Sorted parts are appended by number, in pieces of bounded size; they go afterwards."""
    monkeypatch.setattr(single_file, "CHUNK", 7)
    df = spark.range(3000).select((F.col("id") * 7919 % 3000).alias("k"), F.lit("é,x").alias("s")).repartition(5)
    path = tmp_path / "in" / "out.csv"
    sinks.write_csv_file(df, str(path), ["k"])
    assert path.read_text() == "k,s\n" + "".join(f'{k},"é,x"\n' for k in range(3000))
    assert [p.name for p in path.parent.iterdir()] == ["out.csv"]
