"""Every registered reference query against its SQL in DuckDB, on whole small tables."""

import math
from pathlib import Path

import pytest

from corvane.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    import duckdb

    if not Path(data).exists():
        pytest.skip("no data")
    c = duckdb.connect()
    for t in TABLES:
        p = Path(data, f"{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, duck, data, name):
    df = registry.QUERIES[name](spark, data)
    found = duck.execute(registry.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(str([plain(dict(zip(names, r))[c]) for c in df.columns]) for r in found.fetchall())
    assert sorted(str([plain(r[c]) for c in df.columns]) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, data, name):
    if not Path(data).exists():
        pytest.skip("no data")
    assert registry.QUERIES[name](spark, data).count() > 0


def test_entry(spark, data):
    import __spark_entry__ as entry

    if not Path(data).exists():
        pytest.skip("no data")
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_nothing_else_imports_llm():
    root = Path(__file__).resolve().parents[1] / "corvane"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "llm" in p.read_text()]
