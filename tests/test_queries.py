import pytest

import __spark_entry__ as entry
from tests.oracle import compare

from tessel import queries_data, queries_docs, queries_io, queries_sql

CORE = {k: v for m in (queries_data, queries_sql, queries_docs, queries_io) for k, v in m.QUERIES.items()}
SQL = {k: v for m in (queries_data, queries_sql, queries_docs, queries_io) for k, v in m.SQL.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, name):
    compare(spark, sf, name, CORE[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(CORE) - set(SQL)))
def test_runs(spark, sf, name):
    assert CORE[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
