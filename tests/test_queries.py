"""Registered queries against DuckDB on the smallest tables; and that the corpus operators can be left out."""

import datetime as dt
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from calspark import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for i, n in enumerate(sorted(catalog.oracle_sql())) if i % 6 == 0 or n.startswith("x")]
ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_equals_oracle(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    want = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    assert rows == sorted(tuple(map(plain, r)) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 93
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_corpus_operators(tmp_path):
    for p in ("calspark", "__spark_entry__.py"):
        (tmp_path / p).symlink_to(ROOT / p) if p.endswith(".py") else None
    (tmp_path / "calspark").mkdir()
    for p in (ROOT / "calspark").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "calspark" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert not any(n.startswith('op') for n in q) and 'j6_conflict_pairs' in q; e.oracle_sql()"
    assert subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}).returncode == 0
