"""Every query that has SQL, against DuckDB on the same tables."""

import decimal
import math
from pathlib import Path

import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)[:19].replace("T", " ") if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck(folder):
    import duckdb

    c = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, folder, duck, name):
    df = QUERIES[name](spark, folder)
    cols = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    want = [tuple(plain(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in ORACLES and not n.startswith(("p1_", "p7_", "p8_", "p9_"))))
def test_runs(spark, folder, name):
    df = QUERIES[name](spark, folder)
    assert df.columns and df.count() >= 0


def test_entry(spark, folder):
    assert entry.entry(spark).count() > 0
