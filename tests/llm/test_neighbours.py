"""Nearest neighbours against brute force."""

import math

import numpy as np

from tessera.llm import neighbours


def brute(rows, every=100, nearest=10):
    good = [(i, np.array(v, np.float64)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)]
    out = {}
    for q, v in good:
        if q % every == 0:
            found = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in good if i != q)[:nearest]
            out[q] = [(k + 1, i, d) for k, (d, i) in enumerate(found)]
    return out


def result(frame, **more):
    out = {}
    for r in neighbours.nearest_neighbours(frame, **more).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(x) for q, x in out.items()}


def recall(got, want):
    return np.mean([len({i for _, i, _ in got[q]} & {i for _, i, _ in want[q]}) / len(want[q]) for q in want])


def test_recall_and_scores(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    want, got = brute(rows, every=50), result(frame, every=50)
    assert got.keys() == want.keys()
    vectors = {i: np.array(v, np.float64) for i, v in rows}
    for q, found in got.items():
        assert [k for k, _, _ in found] == list(range(1, 11))
        assert found == sorted(found, key=lambda x: (x[2], x[1]))
        assert all(abs(d - np.sqrt(((vectors[q] - vectors[i]) ** 2).sum())) < 1e-12 and i != q for _, i, d in found)
    assert recall(got, want) >= 0.93


def test_copies_and_odd_vectors(spark):
    draw = np.random.default_rng(0)
    one = draw.normal(size=8).tolist()
    rows = [(i, one) for i in range(60)] + [(i, draw.normal(size=8).tolist()) for i in range(60, 200)]
    rows += [(200, None), (201, [0.0] * 8), (202, [float("nan")] + [1.0] * 7), (203, [None] + [1.0] * 7), (204, [float("inf")] * 8), (205, [1.0] * 3), (210, one)]
    frame = spark.createDataFrame([(i, v, 1, "c") for i, v in rows], "vec_id long, embedding array<float>, copy int, code string").repartition(4)
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows if i != 205]
    want, got = brute(single, every=10), result(frame, every=10)
    assert got.keys() == want.keys()
    for q in range(0, 60, 10):
        assert [i for _, i, _ in got[q]] == [i for _, i, _ in want[q]]
    assert recall(got, want) > 0.9


def test_few_vectors(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.5]), (7, [3.0, 0.0])], "vec_id long, embedding array<double>")
    assert result(frame) == brute([(0, [1.0, 2.0]), (1, [1.0, 2.5]), (7, [3.0, 0.0])])
    assert result(frame.limit(1)) == {}
    assert neighbours.nearest_neighbours(frame.limit(0)).collect() == []


def test_blocks_change_nothing(spark):
    from tessera.llm.neighbours import Codes, _search

    draw = np.random.default_rng(5)
    x = draw.normal(size=(300, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
    codes = Codes(x)
    queries = rows.where("vec_id % 10 = 0")
    whole = {tuple(r) for r in _search(rows, queries, codes, codes.radius, 5).collect()}
    dealt = {tuple(r) for r in _search(rows, queries, codes, codes.radius, 5, index_block=9, query_block=7).collect()}
    assert whole == dealt and len(whole) > 100


def test_repeated_ids(spark):
    rng = np.random.default_rng(12)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(40)]
    rows += [(0, [1.0] * 8), (7, [1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.1]), (7, rows[7][1]), (None, [1.0] * 8)]
    got = result(spark.createDataFrame([(*r, 3, "q") for r in rows], "vec_id long, embedding array<double>, rank int, query_id string"))
    least = {}
    for i, v in rows:
        if i is not None:
            least[i] = min(least.get(i, v), v)
    want = brute(sorted(least.items()))
    assert list(got) == [0] == list(want) and [i for _, i, _ in got[0]] == [i for _, i, _ in want[0]]
    assert np.allclose([d for *_, d in got[0]], [d for *_, d in want[0]])
