"""Every query of the catalogue against its SQL, and the entry module without the optional parts."""

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from regimes.plans import catalogue, readers  # noqa: F401

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    want = con.sql(catalogue.SQL[name])
    got = catalogue.QUERIES[name](spark, D)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(tuple(norm(r[c]) for c in cols) for r in got.collect()) == sorted(tuple(norm(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", ["permutation_sequential", "site_export"])
def test_without_sql(spark, name):
    assert catalogue.QUERIES[name](spark, D).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 9 * len(catalogue.METRICS) and "value" in df.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_optional_parts(tmp_path):
    repo = Path(entry.__file__).parent
    (tmp_path / "regimes").mkdir()
    (tmp_path / "__spark_entry__.py").write_text((repo / "__spark_entry__.py").read_text())
    for p in (repo / "regimes").iterdir():
        if p.name != "llm":
            (tmp_path / "regimes" / p.name).symlink_to(p)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()))"], cwd=tmp_path, capture_output=True, text=True)
    assert out.stdout.split() == [str(len(catalogue.QUERIES)), "False"], out.stderr


def test_entry_tells_of_broken_parts(tmp_path):
    """Only the subpackage itself may be missing: a fault inside it isn't hidden."""
    repo = Path(entry.__file__).parent
    (tmp_path / "__spark_entry__.py").write_text((repo / "__spark_entry__.py").read_text())
    (tmp_path / "regimes").symlink_to(repo / "regimes")
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_library")
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True)
    assert "no_such_library" in out.stderr and out.returncode != 0
