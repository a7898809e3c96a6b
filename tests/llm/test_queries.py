import duckdb
import pytest

from quern.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    theirs = con.sql(ORACLES[name])
    mine = QUERIES[name](spark, DATA)
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    at = [theirs.columns.index(c) for c in columns]
    assert sorted(str(tuple(r[c] for c in columns)) for r in mine.collect()) == sorted(str(tuple(r[i] for i in at)) for r in theirs.fetchall())
