"""Every registered query with SQL against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tracklens import catalog

DATA = Path("/root/testdata/sf0.001")
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.sql(f"create view {f.stem} as select * from '{f}'")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, (list, tuple)):
        return str([plain(y) for y in x])
    return str(x)[:19] if hasattr(x, "isoformat") else None if x is None else str(x)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(([plain(r[i]) for i in order] for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    want = duck.sql(SQL[name])
    assert table(df.columns, df.collect()) == table(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_entry_without_the_document_operators():
    """In a process of its own, since modules stay imported: the guard names what is missing, and the other queries are there."""
    import subprocess
    import sys

    code = "import sys, warnings; sys.modules['tracklens.llm'] = None; warnings.simplefilter('always'); import __spark_entry__ as e; print(sum(k.startswith('op') for k in e.queries()), len(e.queries()), sorted(e.oracle_sql())[0])"
    got = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, check=True)
    assert got.stdout.split()[:2] == ["0", str(len(QUERIES))] and "tracklens.llm" in got.stderr
