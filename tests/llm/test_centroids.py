"""Lloyd's clustering against plain loops over Python integers."""

import hashlib
import math

import numpy as np

from tessera.llm import centroids


def plain_lloyd(rows, clusters, components, rounds):
    kept = [(i, [max(-(1 << 27), min(1 << 27, math.floor(256 * x))) if abs(x) < 1e100 else int(math.copysign(1 << 27, x)) for x in v]) for i, v in rows if v is not None and len(v) == components and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centres = [list(v) for _, v in first[:clusters]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centres))

    for _ in range(rounds):
        own = [[] for _ in centres]
        for _, v in kept:
            own[near(v)[1]].append(v)
        centres = [[sum(x) // len(vs) for x in zip(*vs)] if vs else c for vs, c in zip(own, centres)]
    found = [(i, *near(v)) for i, v in kept]
    inertia = [sum(d for _, d, k in found if k == c) for c in range(len(centres))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, k, d, min(inertia[k], 2**63 - 1), min(sum(inertia), 2**63 - 1), sha[k]) for i, d, k in found), key=repr)


def test_rounds_are_plain_loops(spark):
    draw = np.random.default_rng(4)
    rows = [(i, [float(x) for x in draw.normal(size=4).round(1)]) for i in range(120)]
    rows += [(7, rows[7][1]), (8, rows[9][1]), (200, rows[3][1]), (None, rows[5][1]), (None, [1.0] * 4), (201, None), (202, [1.0, None, 1.0, 1.0]), (203, [math.nan, 0.0, 0.0, 0.0])]
    rows += [(204, [math.inf, 0.0, 0.0, 0.0]), (205, [1.0] * 3), (206, []), (207, [0.0] * 4)]
    frame = spark.createDataFrame([(*r, 3, [1]) for r in rows], "vec_id long, embedding array<double>, cluster int, x array<int>")
    for parts in (1, 7):
        got = centroids.cluster_vectors(frame.repartition(parts), clusters=9, components=4, rounds=5)
        assert sorted(map(tuple, got.collect()), key=repr) == plain_lloyd(rows, 9, 4, 5)


def test_extremes_few_and_none(spark):
    rows = [(1, [1e308, -1e308]), (2, [-1e308, 1e308]), (3, [0.0, 0.0]), (None, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = centroids.cluster_vectors(frame, clusters=2, components=2, rounds=2)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_lloyd(rows, 2, 2, 2)
    few = centroids.cluster_vectors(frame, clusters=9, components=2, rounds=2)
    assert sorted(map(tuple, few.collect()), key=repr) == plain_lloyd(rows, 9, 2, 2)
    unnamed = centroids.cluster_vectors(frame.where("vec_id IS NULL"), components=2).collect()
    assert [tuple(r) for r in unnamed] == [(None,) * 6]
    assert centroids.cluster_vectors(frame.limit(0), components=2).collect() == []


def test_an_empty_centroid_stays(spark):
    centres = np.array([[0, 0], [50, 50], [9, 9]])
    sums = np.array([[7, -7, 2, 0], [0, 0, 0, 0], [-1, 1, 3, 0]], object)
    assert centroids.moved(centres, sums).tolist() == [[3, -4], [50, 50], [-1, 0]]


def test_ties_go_to_the_smaller_number():
    cluster, distance = centroids.nearest(np.array([[0, 0], [2, 0]]), np.array([[1, 0], [-1, 0], [1, 0]]))
    assert cluster.tolist() == [0, 0] and distance.tolist() == [1, 1]
