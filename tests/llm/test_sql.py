"""Queries of the operators that SQL can express against that SQL."""

import pytest

from tessera.llm.queries import QUERIES, SQL
from tests.test_queries import connection, plain


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    found = connection(sf_dir).execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(frame.columns)
    assert plain([tuple(r) for r in frame.collect()], frame.columns) == plain(found.fetchall(), names)
