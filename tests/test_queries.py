import duckdb
import pytest

import __spark_entry__
from pactframe.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    d = duckdb.connect()
    for n in "region nation customer supplier part orders lineitem events pages".split():
        d.sql(f"create view {n} as select * from '{SF}/{n}.parquet'")
    return d


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df, want = QUERIES[name](spark, SF), duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.collect(), df.columns) == rows_of(want.fetchall(), want.columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["path", "code", "n"]
