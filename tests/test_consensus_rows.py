"""Consensus of pairs with few proposals: by batches of rows, as the plain loop finds it."""

import pytest

from tessera.operators import matching
from tessera.plans import lenses as ls


def plain(rows, threshold, strict):
    out = {}
    for pair in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == pair]
        near = lambda p, m: (p[2] - m[2]) ** 2 + (p[3] - m[3]) ** 2 < threshold**2 or (not strict and (p[2] - m[2]) ** 2 + (p[3] - m[3]) ** 2 == threshold**2)
        scored = [(-sum(near(p, m) for m in own), min(q[1] for q in own if q[2:] == p[2:]), p[2], p[3]) for p in own]
        less, _, dx, dy = min(scored)
        out[pair] = (dx, dy, -less, len(own))
    return out


@pytest.mark.parametrize("kind,strict", [("long", False), ("long", True), ("double", False), ("int", True)])
def test_few_proposals_as_the_loop(spark, kind, strict):
    number = float if kind == "double" else int
    rows = [(i % 17 % 9, i * 7919 % 101, number(i * 31 % 23), number(i * 17 % 19)) for i in range(300)] + [(99, 1, number(4), number(5))]
    df = spark.createDataFrame(rows, f"pair long, ord long, dx {kind}, dy {kind}")
    found = matching.consensus(df, ["pair"], 5, strict=strict)
    assert {r.pair: (r.dx, r.dy, r.support, r.total) for r in found.collect()} == plain(rows, 5, strict)
    assert [f.dataType.simpleString() for f in found.schema] == ["bigint", kind.replace("long", "bigint"), kind.replace("long", "bigint"), "bigint", "bigint"]


def test_missing_offsets_agree_with_nothing(spark):
    rows = [(1, 1, None, 2.0), (1, 2, 3.0, 2.0), (1, 3, 3.0, 2.5), (2, 1, None, None), (3, 1, float("nan"), 0.0), (3, 2, 1.0, 0.0), (None, 5, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "pair long, ord long, dx double, dy double")
    got = {r.pair: (r.dx, r.dy, r.support, r.total) for r in matching.consensus(df, ["pair"], 5).collect()}
    assert got == {1: (3.0, 2.0, 2, 3), 2: (None, None, 0, 1), 3: (1.0, 0.0, 1, 2), None: (1.0, 1.0, 1, 1)}


def test_rows_are_scored_by_batches(spark, sf_dir):
    plan = matching.consensus(ls.matches(spark, sf_dir), ["pair"], 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan


def test_attempts_are_counted_side_by_side(spark, sf_dir):
    from tessera.plans.registry import load

    plan = load()[0]["multi_ratio_pick"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(" not in plan
