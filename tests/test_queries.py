"""Every query against the same in SQL over the same tables."""

from __future__ import annotations

import importlib

import oracle
import pytest
from conftest import DATA

from halyard.plans import catalog, problems, relational, tools

QUERIES = {**problems.QUERIES, **relational.QUERIES, **catalog.QUERIES, **tools.QUERIES}
SQL = {**problems.SQL, **relational.SQL, **catalog.SQL, **tools.SQL}
#: Of which there may be none in the smallest tables.
MAY_BE_EMPTY = {"in_semi", "intersect_keys", "except_keys", "except_all", "not_exists_anti", "having_groups", "keyword_and_search", "keyword_bm25_rank", "json_extract", "exists_semi", "full_outer_gap", "catalog_drift", "model_crosscheck"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    if name in SQL:
        assert oracle.compare(df, SQL[name], DATA) == ""
    if name not in MAY_BE_EMPTY:
        assert not df.isEmpty()


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
