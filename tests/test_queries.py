import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from quern.plans import knowledge, registry, warehouse  # noqa: F401
from tools.compare import plain

DATA = "/root/testdata/sf0.001"
#: Made of parts that are tested elsewhere, and long.
SLOW = {"rag_answers"}


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        made.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return made


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_queries_equal_their_sql(spark, con, name):
    mine, theirs = registry.QUERIES[name](spark, DATA), con.sql(registry.ORACLES[name])
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    at = [theirs.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in mine.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in theirs.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES) - SLOW))
def test_other_queries_run(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_the_entry_works_without_the_corpus_part():
    root = Path(__file__).resolve().parents[1]
    code = "import sys; sys.modules['quern.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'dws_shop_day' in e.queries() and not any(n.startswith('op') for n in e.queries()); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
