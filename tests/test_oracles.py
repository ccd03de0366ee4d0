"""Every query with SQL gives what DuckDB gives on the same files."""

import duckdb
import pytest

from ledgerline.plans.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def ordered(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", ORACLES)
def test_oracle(spark, duck, name):
    mine, theirs = QUERIES[name](spark, DATA), duck.sql(ORACLES[name])
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert ordered(map(tuple, mine.collect()), mine.columns) == ordered(theirs.fetchall(), theirs.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
