"""The registered queries against their SQL in DuckDB on the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from ligature.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tiny}/{t}.parquet')")
    return con


def plain(rows):
    return Counter(tuple(float(v) if type(v).__name__ in ("float", "Decimal") else v for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, tiny, name):
    df = registry.queries()[name](spark, tiny)
    columns = sorted(df.columns)
    got = df.select(*columns).collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert all(not (isinstance(v, float) and math.isnan(v)) for r in got for v in r)
        return
    result = duck.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert plain(got) == plain(tuple(r[i] for i in at) for r in result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
