"""Every registered query against its SQL on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect(config={"memory_limit": "6GB"})
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_sql(spark, sql, name):
    df = queries()[name](spark, SF)
    cols = sorted(df.columns)
    mine = Counter(map(repr, (tuple(r) for r in df.select(*cols).collect())))
    text = oracle_sql().get(name)
    if text is None:
        assert mine
        return
    cur = sql.execute(text)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    theirs = Counter(repr(tuple(r[names.index(c)] for c in cols)) for r in cur.fetchall())
    assert mine == theirs


def test_entry(spark):
    assert entry(spark).count() > 0
