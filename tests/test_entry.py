import duckdb
import pytest

import __spark_entry__ as entry
from pricecompass import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def _plain(row):
    return tuple(repr(round(v, 6)) if isinstance(v, float) else str(v) for v in row)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    found = entry.queries()[name](spark, SF)
    columns = sorted(found.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLES[name]})").fetchall()
    assert sorted(map(_plain, found.select(columns).collect())) == sorted(map(_plain, want))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
