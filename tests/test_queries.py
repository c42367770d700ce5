"""Every query against its SQL in DuckDB, row for row; those without SQL must give rows."""

import math

import duckdb
import pytest

from tessera.plans.registry import load
from tests.conftest import SF

QUERIES, SQL = load()
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)

    def value(v):
        return "nan" if isinstance(v, float) and math.isnan(v) else v

    return sorted(repr([value(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name, sf_dir=SF):
    frame = QUERIES[name](spark, sf_dir)
    found = connection(sf_dir).execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(frame.columns)
    want = plain(found.fetchall(), names)
    got = plain([tuple(r) for r in frame.collect()], frame.columns)
    assert len(got) == len(want) and got[:5] == want[:5] and got == want
    assert len(want) > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name, sf_dir=SF):
    assert QUERIES[name](spark, sf_dir).count() > 0
