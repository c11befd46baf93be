"""Every query against its SQL in DuckDB, as the driver does it."""

import os

import duckdb
import pytest

from spinweave import registry


@pytest.fixture(scope="session")
def duck(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


def shown(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(str(tuple(r[k] for k in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    got = duck.execute(sql)
    names = [d[0] for d in got.description]
    want = got.fetchall()
    assert sorted(names) == sorted(df.columns)
    assert shown(df.columns, rows) == shown(names, want)
    assert want
