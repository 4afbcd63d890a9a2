"""Every query of the engine's own operators against its SQL twin."""

import math
import os

import pytest

from lexmill import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def canonical(rows: list[dict]) -> list[str]:
    def show(v) -> str:
        if v is None or isinstance(v, float) and math.isnan(v):
            return "~"
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    return sorted("|".join(show(row[c]) for c in sorted(row)) for row in rows)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_agrees_with_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toArrow(), duck.sql(registry.SQL[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert canonical(got.to_pylist()) == canonical(want.to_pylist())


def test_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(registry.QUERIES) <= set(e.queries())
    assert e.entry(spark).count() > 0
