"""Every query with SQL gives the rows that DuckDB gives."""

import glob
import os

import duckdb
import pytest

from pagewright.plans import audit_queries, corpus_queries, queries, report_queries, site_queries
from pagewright.storage import staged

PLANS = (queries, site_queries, report_queries, corpus_queries, audit_queries)
ORACLE_SQL = {k: v for m in PLANS for k, v in m.ORACLE_SQL.items()}
QUERIES = {k: v for m in PLANS for k, v in m.QUERIES.items()}

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.fixture(scope="module", autouse=True)
def one_bag(spark):
    """The issues of all sources are gathered once for all queries that begin with them."""
    every = staged(corpus_queries.all_issues(spark, SF), "issues")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(corpus_queries, "all_issues", lambda spark, sf: every)
        yield


def rows(frame):
    cols = sorted(frame.columns)
    return sorted(tuple("" if v is None or v != v else str(v) for v in r) for r in frame[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_duckdb(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry_imports_without_llm():
    import __spark_entry__

    assert set(ORACLE_SQL) - __spark_entry__.BY_HAND <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
