"""Context mixing against plain loops, the base score against counters, defined cases."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import lm_scoring, mixing

TEXTS = [None, "", " \t\n", "The cat sat on the mat. The cat sat.", "a cat\x0band A DOG #1", "über Straße Ünder", "the the the " * 40, "x" * 700, "One fish two fish red fish blue fish " * 9, "mat on sat cat the", "zebra quagga"]


def tokens(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def trains(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 != 0


def plain_bits(text, code):
    """(contexts, node, bit, place in the stream) of each bit of a text."""
    before, place = b"", 0
    for token in [*(w + b" " for w in tokens(text)), b"\n"]:
        pieces = [token[a : a + mixing.PIECE] for a in range(0, len(token), mixing.PIECE)]
        for piece in pieces:
            for i, symbol in enumerate(piece):
                two = (piece[i - 2] if i > 1 else 0) << 8 | (piece[i - 1] if i else 32)
                pair = int(code.classes[two]) << 8 | symbol
                last = (bytes(4) + (b" " if not i else piece[:i]))[-4:]
                at = code.place[pair]
                for node, bit in zip(code.nodes[at : at + code.length[pair]], code.bits[at : at + code.length[pair]]):
                    yield [(0, pair >> 8), (1, last), (2, piece[:i]), (3, piece[:i], before) if i < 3 else None], int(node), int(bit), place
                place += 1
            before = piece
        before = piece if token != b"\n" else b""


def plain_model(texts, ids, weights, code):
    counts = Counter()
    for text, i in zip(texts, ids):
        if trains(i):
            counts.update((context, node, bit) for contexts, node, bit, _ in plain_bits(text, code) for context in contexts if context)

    def says(context, node):
        if context is None:
            return 0
        x = 12 * math.log((counts[context, node, 1] + 0.4) / (counts[context, node, 0] + 0.4))
        return max(-127, min(127, round(x)))

    out = []
    for text in texts:
        total, lane, learned = 0.0, -1, None
        for contexts, node, bit, place in plain_bits(text, code):
            if place // mixing.LANE != lane:
                lane, learned = place // mixing.LANE, [0.0] * 4
            x = [says(c, node) for c in contexts]
            sure = [0 if v == 0 else 1 if abs(v) < 24 else 2 for v in x[2:4]]
            w = weights[3 * sure[0] + sure[1]]
            z = max(-12, min(12, sum((float(a) + b) * v for a, b, v in zip(w, learned, x))))
            p = 1 / (1 + math.exp(-z))
            total -= math.log(p if bit else 1 - p)
            learned = [b + mixing.RATE / 144 * (bit - p) * v for b, v in zip(learned, x)]
        out.append(-total / math.log(10))
    return out


def rows_of(texts):
    return [(i + 1, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def fitted(spark):
    rows = rows_of(TEXTS * 2)
    docs = spark.createDataFrame([(*r, 1, b"w", 2) for r in rows], "doc_id long, text string, pair int, window binary, rank int")
    got = {r.doc_id: r for r in lm_scoring.score_texts(docs.repartition(3)).collect()}
    blocks = lm_scoring._blocks(docs)
    return rows, docs, got, lm_scoring.fit(blocks)


def test_score_is_a_plain_loop(fitted):
    rows, _, got, (code, _, weights, _, _) = fitted
    want = plain_model([t for _, t in rows], [i for i, _ in rows], weights, code)
    for (i, text), score in zip(rows, want):
        assert got[i].score == pytest.approx(score, rel=1e-3, abs=1e-3)
        n = sum(len(w) + 1 for w in tokens(text)) + 1
        assert got[i].bits_per_byte == pytest.approx(-got[i].score * math.log2(10) / n)


def test_base_score_is_counted(fitted):
    rows, _, got, _ = fitted
    counts = Counter(w for i, t in rows if trains(i) for w in [*tokens(t), b"\n"])
    n, v = sum(counts.values()), len(counts)
    for i, t in rows:
        own = [*tokens(t), b"\n"]
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (not trains(i), len(own), sum(w in counts for w in own), n)
        assert got[i].base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), abs=1e-9)


def test_layout_changes_nothing(spark, fitted, monkeypatch):
    _, docs, got, _ = fitted
    monkeypatch.setattr(lm_scoring, "FAN", 2)  # tables and senders meet in several rounds
    monkeypatch.setattr(lm_scoring, "SENDERS", 2)
    for r in lm_scoring.score_texts(docs.repartition(7)).collect():
        assert r.score == pytest.approx(got[r.doc_id].score, rel=1e-5) and r.base_score == got[r.doc_id].base_score and r.n_known == got[r.doc_id].n_known


def test_batches_change_nothing(monkeypatch):
    data = (b"some words of a text that is longer " * 900 + b"y" * 9000 + b" Z") * 2
    stream, ends = mixing.stream_of(np.frombuffer(data, np.uint8), np.array([0, 5, 5, len(data)]))
    starts = mixing.tokens_of(stream)
    classes = mixing.classes_of(mixing.pair_counts(stream, starts))
    code = mixing.Code(mixing.class_counts(stream, starts, classes), classes)
    table, parts = np.zeros((mixing.STARTS[-1], 2), np.int32), np.zeros((mixing.STARTS[-1], 2), np.int32)
    mixing.count_bits(table, stream, starts, code)
    said, weights = mixing.predictions(table), np.full((mixing.GATES, 4), 0.02, np.float32)
    whole = mixing.lane_costs(stream, starts, ends, code, said, weights)
    cuts = mixing.cuts_of
    monkeypatch.setattr(mixing, "cuts_of", lambda docs: cuts(docs, 1000))
    monkeypatch.setattr(mixing, "BATCH", 1000)
    mixing.count_bits(parts, stream, starts, code)
    assert (parts == table).all()
    assert np.allclose(mixing.lane_costs(stream, starts, ends, code, said, weights), whole, rtol=1e-5)


def test_codes_are_complete():
    classes = mixing.classes_of(np.arange(65536))
    assert sorted(classes[-256:]) == list(range(256, 512)) and (classes[:-256] == np.arange(65280) % 256).all()
    code = mixing.Code(np.random.default_rng(1).integers(0, 9, mixing.CLASSES << 8) ** 3, classes)
    assert np.allclose((0.5 ** code.length.reshape(-1, 256)).sum(1), 1)


def test_fitted_weights_are_where_the_slope_ends():
    draw = np.random.default_rng(2)
    inputs = draw.integers(-60, 60, (5000, 4)).astype(np.int8)
    inputs *= np.where(draw.random(5000) < 1 / (1 + np.exp(-inputs[:, 0] / 20.0)), 1, -1).astype(np.int8)[:, None]  # as said for the value
    weights, gate = mixing.fit_weights(inputs).astype(np.float64), mixing.gates_of(inputs)
    for g in np.unique(gate):
        x = inputs[gate == g].astype(float)
        slope = mixing.RIDGE * (weights[g] - 1.5 / 48) - x.T @ (1 / (1 + np.exp(np.clip(x @ weights[g], -30, 30))))
        assert np.abs(slope).max() < 1 + 1e-4 * np.abs(x).sum()


def test_words_of_one_hash_are_told_apart(monkeypatch):
    stream, bounds = np.frombuffer(b"ab cd ab ef \nab ", np.uint8), np.array([0, 3, 6, 9, 12, 13, 16])
    number, index, _ = mixing.word_classes(stream, bounds)
    assert number.tolist() == [0, 1, 0, 2, 3, 0] and index.tolist() == [0, 1, 3, 4]
    monkeypatch.setattr(mixing, "_TIMES", np.zeros(1 << 16, np.uint64))
    number, index, hashed = mixing.word_classes(stream, bounds)
    assert number.tolist() == [0, 1, 0, 2, 3, 0] and index.tolist() == [0, 1, 3, 4] and len(set(hashed[:3].tolist())) == 1


def test_better_than_its_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = lm_scoring.score_texts(docs).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_defined_cases(spark):
    kind = "doc_id long, text string, lang string"
    rows = [(None, "a b", None), (None, None, None), (3, "a b a", "x"), (3, "a b a", "x"), (4, "lorem ipsum " * 200_000, "x")]
    got = lm_scoring.score_texts(spark.createDataFrame(rows, kind)).collect()
    assert len(got) == 5 and all(r.held_out == (r.doc_id is None) and r.score < 0 and r.train_tokens == 8 + 400_001 for r in got)
    assert lm_scoring.score_texts(spark.createDataFrame([], kind)).collect() == []
    untrained = lm_scoring.score_texts(spark.createDataFrame(rows[:2], kind)).collect()
    assert all(r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 and r.score < 0 for r in untrained)


def test_weights_are_fitted_to_all_training_documents(spark, monkeypatch):
    """Where the steps begin doesn't matter, and the slope over every training bit, each half judged by the other, ends there."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    blocks = lm_scoring._blocks(docs.repartition(3))
    code, _, weights, _, _ = lm_scoring.fit(blocks)
    monkeypatch.setattr(lm_scoring, "SAMPLE", 2)
    assert np.allclose(lm_scoring.fit(blocks)[2], weights, atol=3e-3)
    rows = [r for r in docs.select("doc_id", "text").collect() if trains(r.doc_id)]
    streams = []
    for half in (0, 1):
        texts = [(r.text or "").encode() for r in rows if lm_scoring._half(r.doc_id) == half]
        stream, _ = mixing.stream_of(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
        streams.append((stream, mixing.tokens_of(stream)))
    slope, size = np.zeros((mixing.GATES, 4)), np.zeros((mixing.GATES, 4))
    for own, (stream, starts) in zip(streams, streams[::-1]):
        table = np.zeros((mixing.STARTS[-1], 2), np.int32)
        mixing.count_bits(table, *own, code)
        said = mixing.predictions(table)
        said[: 1 << mixing.BITS[0]] = mixing.predictions(mixing.node_counts(mixing.class_counts(*own, code.classes), code))
        x = mixing.inputs_of(mixing.batch_of(stream, starts, 0, len(stream), code), said)
        gate, x = mixing.gates_of(x), x.astype(float)
        q = 1 / (1 + np.exp(np.clip((x * weights[gate]).sum(1), -30, 30)))
        for g in range(mixing.GATES):
            slope[g] -= x[gate == g].T @ q[gate == g]
            size[g] += np.abs(x[gate == g]).T @ q[gate == g]
    slope += mixing.RIDGE * (weights - 1.5 / 48)
    assert (np.abs(slope) <= 0.02 * size + 30).all()
