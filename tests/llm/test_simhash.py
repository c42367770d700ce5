"""SimHash fingerprints, pigeonring candidates and components against brute force."""

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.components import components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for i in range(64):
            counts[i] += h >> i & 1
    return sum(1 << i for i in range(64) if counts[i] * 2 > len(grams))


def reach(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows):
    fps = {i: plain_fingerprint(t) for i, t in rows}
    ids = sorted(fps)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if bin(fps[a] ^ fps[b]).count("1") <= 4]
    roots = reach(pairs, ids)
    return sorted((i, f"{fps[i]:016x}", roots[i]) for i in ids)


def test_every_near_pair_shares_a_viable_key():
    rng = np.random.default_rng(1)
    for _ in range(2000):
        x = 0
        for b in rng.choice(64, int(rng.integers(0, 5)), replace=False):
            x |= 1 << int(b)
        base = int(rng.integers(0, 1 << 63))
        k1, k2 = simhash.ring_keys(np.array([base, base ^ x], np.uint64)).T
        at = np.flatnonzero(k1 == k2)
        starts = (k1[at] >> np.uint64(30)).astype(np.int64)
        assert len(at) and simhash.viable(np.full(len(at), x, np.uint64), starts).any()


def test_matches_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows += [(1000, None), (1001, " \n"), (1002, "one"), (1003, "ONE"), (1004, "a b c d"), (1005, "a b  c\td "), (1006, "é É")]
    frame = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, fp long, key string").repartition(3)
    assert sorted(tuple(r) for r in simhash.near_duplicates(frame).collect()) == brute(rows)


def test_large_groups_and_chains(spark):
    rng = np.random.default_rng(2)
    fps = [int(rng.integers(0, 1 << 62)) for _ in range(50)]
    fps += [fps[0] ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.choice(64, (1500, 2))]
    chain = fps[1]
    for i in range(12):
        chain ^= 0b1011 << (4 * i)
        fps.append(chain)
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    found = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    got = {r.node: r.root for r in components(found).collect()}
    u = np.array(fps, np.int64).astype(np.uint64)
    pairs = [(fps[i], fps[j]) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(u[i] ^ u) <= 4).tolist() if j > i]
    want = reach(pairs, fps)
    assert {n: got.get(n, n) for n in fps} == want
    assert found.count() < 3 * 64 * len(fps)


def test_groups_dealt_out_give_the_same(spark):
    rng = np.random.default_rng(5)
    base = [int(rng.integers(0, 1 << 62)) for _ in range(6)]
    fps = sorted({b ^ sum(1 << int(i) for i in set(rng.choice(64, int(rng.integers(0, 9))))) for b in base for _ in range(60)})
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    whole, parts = ({r.node: r.root for r in components(simhash.links(frame, most)).collect()} for most in (1 << 40, 2))
    u = np.array(fps, np.int64).astype(np.uint64)
    pairs = [(fps[i], fps[j]) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(u[i] ^ u) <= 4).tolist() if j > i]
    want = reach(pairs, fps)
    assert {n: whole.get(n, n) for n in fps} == want == {n: parts.get(n, n) for n in fps}


def test_group_links_connect_what_chains_connect():
    rng = np.random.default_rng(6)
    for start in (0, 5, 15):
        centre = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
        flips = np.array([sum(1 << int(i) for i in set(rng.choice(64, int(rng.integers(0, 8))))) for _ in range(400)], np.uint64)
        fps = np.unique(centre[rng.integers(0, 4, 400)] ^ flips)
        a, b = simhash.group_links(fps, start)
        near = [(int(fps[i]), int(fps[j])) for i in range(len(fps)) for j in np.flatnonzero(simhash.viable(fps[i] ^ fps, start)).tolist() if j > i]
        nodes = [int(f) for f in fps]
        assert reach(zip(a.tolist(), b.tolist()), nodes) == reach(near, nodes) and len(a) < len(fps)


def test_components_of_a_path(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in components(edges).collect()} == {0}


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
