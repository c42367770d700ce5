"""Byte and word de-duplication against brute force."""

import hashlib

import numpy as np
import pytest

from tessera.llm import substring_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, key string, block_id long, dup string"


def frame(spark, rows):
    """Extra columns carry names that the operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA).repartition(3)


def brute_bytes(rows, window):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - window + 1):
            w = b[i : i + window]
            first[w] = min(first.get(w, d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if first[b[i : i + window]] < d:
                gone[i : i + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def brute_words(rows, window):
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, (d, i)), (d, i))
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (d, i):
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus():
    rng = np.random.default_rng(5)
    vocabulary = ["aa", "b", "ccc", "dé", "über", "x" * 70]
    passage = " ".join(rng.choice(vocabulary, 60).tolist())
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "word"), (4, "For " * 400), (5, "For " * 30)]
    for i in range(6, 40):
        own = " ".join(rng.choice(vocabulary, int(rng.integers(1, 120))).tolist())
        rows.append((i, own + (" " if i % 2 else "\n") + passage if i % 3 else own))
    rows += [(40, rows[8][1]), (41, rows[8][1]), (42, " ".join(["q"] * 50)), (43, "abc" * 3000)]
    return rows


def test_suffix_array():
    rng = np.random.default_rng(0)
    for n in [*range(1, 40), 100, 500]:
        for k in (1, 2, 6):
            t = rng.integers(1, k + 1, n)
            want = sorted(range(n), key=lambda i: t[i:].tolist())
            assert suffix_dedup.suffix_array(t).tolist() == want


def test_suffix_array_of_large_numbers():
    rng = np.random.default_rng(1)
    t = rng.integers(1, 40, 3000) * 2**17
    want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
    assert suffix_dedup.suffix_array(t).tolist() == want


@pytest.mark.parametrize("hot", [1024, 2])
def test_bytes_match_brute_force(spark, hot):
    rows = corpus()
    got = suffix_dedup.dedup_bytes(frame(spark, rows), hot_blocks=hot)
    assert sorted(tuple(r)[:5] for r in got.collect()) == brute_bytes(rows, 50)
    for r in got.collect():
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256


@pytest.mark.parametrize("hot", [1024, 2])
def test_words_match_brute_force(spark, hot):
    rows = corpus()
    got = substring_dedup.dedup_words(frame(spark, rows), hot_blocks=hot)
    assert sorted(tuple(r)[:4] for r in got.collect()) == brute_words(rows, 20)


def test_small_windows(spark):
    rows = corpus()[:20]
    assert sorted(tuple(r)[:5] for r in suffix_dedup.dedup_bytes(frame(spark, rows), window=10).collect()) == brute_bytes(rows, 10)
    assert sorted(tuple(r)[:4] for r in substring_dedup.dedup_words(frame(spark, rows), window=3).collect()) == brute_words(rows, 3)


def test_empty_table_and_missing_ids(spark):
    for run in (suffix_dedup.dedup_bytes, substring_dedup.dedup_words):
        assert run(frame(spark, [])).collect() == []
        text = "one two three four five six " * 20
        got = {r.doc_id: r.n_removed for r in run(frame(spark, [(None, text), (7, text), (7, None)])).collect() if r.n_removed or r.doc_id is None}
        assert got[None] > 0


def test_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(tuple(r) for r in substring_dedup.dedup_words(docs, keep_text=False).collect()) == brute_words(rows, 20)
    assert sorted(tuple(r) for r in suffix_dedup.dedup_bytes(docs, keep_text=False).collect()) == brute_bytes(rows, 50)
