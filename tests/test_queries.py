"""Every registered query against its oracle SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from loomgraph import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(queries.QUERIES) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_the_oracle(spark, data, oracle, name):
    df = entry.queries()[name](spark, data)
    got = df.select(*sorted(df.columns)).collect()
    found = oracle.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    order = sorted(range(len(columns)), key=columns.__getitem__)
    key = lambda r: [(v is None, str(v)) for v in r]
    assert sorted(columns) == sorted(df.columns)
    assert sorted((tuple(r) for r in got), key=key) == sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=key)
