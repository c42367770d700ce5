"""Importance resampling: counts and weights against plain loops, kept documents against labels."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import quality


def test_trigrams_match_plain_loops(monkeypatch):
    monkeypatch.setattr(quality, "CHUNK", 16)
    texts = ["", "ab", "abc", None, "über alles " * 5, "x" * 40, "abcde"]
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.cumsum([0, *map(len, raw)])
    got = [Counter() for _ in texts]
    for place, first, second, _ in quality.trigrams(data, offsets):
        for p, a, b in zip(place.tolist(), first.tolist(), second.tolist()):
            assert a & 255 == b >> 8
            got[int(np.searchsorted(offsets, p, side="right")) - 1][a << 8 | b & 255] += 1
    assert got == [Counter(int.from_bytes(r[i : i + 3], "big") for i in range(len(r) - 2)) for r in raw]


def test_model_sums_to_one():
    counts = np.zeros(quality.BUCKETS, np.int64)
    text = np.frombuffer(b"the theme of the thing", np.uint8)
    for _, first, _, hashed in quality.trigrams(text, np.array([0, len(text)])):
        np.add.at(counts, first >> 8, 1)
        np.add.at(counts, quality.BIGRAMS + first, 1)
        np.add.at(counts, quality.BIGRAMS + 65536 + hashed, 1)
    model = quality.Model(counts)
    assert (model.bigram.reshape(256, 256).sum(1) <= 1 + 1e-9).all()
    first, second, hashed = next((f, s, h) for _, f, s, h in quality.trigrams(text, np.array([0, len(text)])))
    assert model.of(first, second, hashed).min() > 1 / 256


def test_kth_largest(spark):
    draw = np.random.default_rng(0)
    values = draw.integers(0, 1 << 50, 500).tolist() + [7] * 20
    frame = spark.createDataFrame([(v,) for v in values], "v long")
    for k in (1, 3, 400, 505, 520):
        assert quality.kth_largest(frame, "v", k) == sorted(values, reverse=True)[k - 1]


def test_keeps_good_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.resample(docs, labels)
    assert rows.count() == docs.count()
    judged = rows.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("keep").cast("int")).alias("kept"), F.count("*").alias("n")).collect()
    kept = {r.quality: r.kept for r in judged}
    assert kept[1] > 0.98 and kept[0] < 0.15, kept


def plain_resample(rows, labels, folds, uniform):
    """Scores, weights, keys and kept rows by loops over trigrams; ``rows`` (doc_id, text)."""
    good = {d for d, q in labels if q == 1}

    def bucket(g):
        x = np.array([g], np.uint64)
        return int(quality.mixed(x)[0]) & (quality.HASHED - 1)

    def count(texts):
        one, two, three, words = Counter(), Counter(), Counter(), [0.5, 0.5]
        for t in texts:
            b = (t or "").encode()
            for i in range(len(b) - 2):
                one[b[i]] += 1
                two[b[i : i + 2]] += 1
                three[bucket(b[i] << 16 | b[i + 1] << 8 | b[i + 2])] += 1
            w = (t or "").split()
            for x, y in zip(w, w[1:]):
                words[x != y] += 1
        return one, two, three, [math.log(v / sum(words)) for v in words]

    def p(model, b, i):
        one, two, three, _ = model
        bigram = (two[b[i + 1 : i + 3]] + 4 / 256) / (one[b[i + 1]] + 4)
        return (three[bucket(b[i] << 16 | b[i + 1] << 8 | b[i + 2])] + 4 * bigram) / (two[b[i : i + 2]] + 4)

    def score(t, raw, target):
        b, w = (t or "").encode(), (t or "").split()
        if len(b) < 3:
            return 0.0
        total = sum(math.log(p(target, b, i) / p(raw, b, i)) for i in range(len(b) - 2))
        same = sum(x == y for x, y in zip(w, w[1:]))
        total += same * (target[3][0] - raw[3][0]) + (max(len(w) - 1, 0) - same) * (target[3][1] - raw[3][1])
        return total / (len(b) - 2 + 100)

    raw, whole = count(t for _, t in rows), count(t for d, t in rows if d in good)
    half = {k: count(t for d, t in rows if d in good and folds[d] == k) for k in (1, 2)}
    scores = [score(t, raw, whole) for _, t in rows]
    keys = [s * 100 - math.log(-math.log(uniform[d])) for s, (d, _) in zip(scores, rows)]
    cut = np.quantile([score(t, raw, half[3 - folds[d]]) for d, t in rows if d in good], 0.0025)
    k = sum(s >= cut for s in scores)
    limit = sorted(keys, reverse=True)[k - 1]
    return [(d, s * 100, key, key >= limit - 1e-6) for (d, _), s, key in zip(rows, scores, keys)]


def test_weights_and_kept_rows_are_the_plain_ones(spark, sf_dir):
    docs = [(r.doc_id, r.text[:1500]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs += [(9000, None), (9001, "ab"), (9002, ""), (9003, "same same same")]
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    frame = spark.createDataFrame([(*r, "q") for r in docs], "doc_id long, text string, fold string")
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(quality.SEED)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    drawn = frame.select("doc_id", u.alias("u"), (F.lit(1) + F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(2))).alias("fold")).collect()
    want = {r[0]: r for r in plain_resample(docs, labels, {r.doc_id: r.fold for r in drawn}, {r.doc_id: r.u for r in drawn})}
    got = quality.resample(frame.drop("fold"), spark.createDataFrame([(*r, 0) for r in labels], "doc_id long, quality int, text int")).collect()
    assert len(got) == len(docs) and 0 < sum(r.keep for r in got) < len(docs)
    for r in got:
        _, weight, key, keep = want[r.doc_id]
        assert abs(r.log_weight - weight) < 1e-6 and abs(r.gumbel_key - key) < 1e-6 and r.keep == keep


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "ab", 0), (None, "words here", 1), (5, "words here", 1), (5, "words here", 1)], "doc_id long, text string, good int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.resample(docs, none).collect()
    assert len(got) == 6 and all(r.keep and r.log_weight == 0 for r in got)
    assert quality.resample(docs.limit(0), none).collect() == []
    some = spark.createDataFrame([(5, 1, 0), (5, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.resample(docs, some).count() == 6
