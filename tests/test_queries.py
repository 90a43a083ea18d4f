"""Every query of the library against its SQL, or for rows where SQL has no form of it."""

from __future__ import annotations

import pytest

from mnemospark.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()
#: Empty at the smallest scale by nature of the data.
MAY_BE_EMPTY = {"snk02_export_page", "a14_recommend_k", "wn10_predict_next"}


def test_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert registry.FLAGSHIP in QUERIES


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, same):
    assert same(QUERIES[name], SQL[name]) or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(name, spark, data):
    assert QUERIES[name](spark, data).count() or name in MAY_BE_EMPTY
