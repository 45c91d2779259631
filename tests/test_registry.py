"""Every store query against its SQL in DuckDB."""

from pathlib import Path

import duckdb
import pytest

from orbitkeep.plans import registry


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, sf_dir, name):
    got = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    rows = sorted(map(repr, map(tuple, got.select(*columns).collect())))
    assert rows
    if name in registry.ORACLE_SQL:
        want = duck.sql(registry.ORACLE_SQL[name])
        assert sorted(want.columns) == columns
        assert rows == sorted(map(repr, want.select(*[f'"{c}"' for c in columns]).fetchall()))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_mixed_order_follows_weights(spark, sf_dir):
    first = {r["group_id"]: r["count"] for r in registry.QUERIES["mix_states"](spark, sf_dir).filter("prio = 1").groupBy("group_id").count().collect()}
    n = sum(first.values())
    assert abs(first[3] / n - 4 / 7) < 0.06 and abs(first[1] / n - 1 / 7) < 0.06
