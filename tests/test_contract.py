import duckdb
import pytest

import __spark_entry__ as contract

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Here all that the measurement engine registers; the other operators have their own tests.
NAMES = sorted(contract.base.QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df, r = contract.queries()[name](spark, DATA), con.execute(contract.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    rows = lambda found, cols: sorted(repr([x[cols.index(c)] for c in order]) for x in found)
    got = rows([tuple(x) for x in df.collect()], df.columns)
    assert got and got == rows(r.fetchall(), names)


def test_entry(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
