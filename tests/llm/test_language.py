"""The recurrent network: gradients, held-out accuracy, defined cases."""

import math
import zlib

import numpy as np

from tessera.llm import language


def test_gradients_match_differences():
    net = language.Network(3, hidden=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, label = language.framed([b"abc", b"bca", b"aab"]), np.array([0, 2, 1])
    _, grads = net.gradients(x, label)
    draw = np.random.default_rng(0)
    for name, value in net.p.items():
        for _ in range(6):
            at = tuple(int(draw.integers(0, s)) for s in value.shape)
            if name[0] == "g":
                at = (int(draw.choice(np.unique(x))), at[1])
            old, step = value[at], 1e-3
            value[at] = old + step
            up = net.gradients(x, label)[0]
            value[at] = old - step
            down = net.gradients(x, label)[0]
            value[at] = old
            assert abs((up - down) / (2 * step) - grads[name][at]) < 1e-4


def plain_means(net, raw):
    """A loop over positions and units."""
    n, out = net.hidden, []
    sigmoid = lambda v: 1 / (1 + math.exp(-v))

    def states(order, direction):
        g, u, h, at = net.p[f"g{direction}"], net.p[f"u{direction}"], [0.0] * n, {}
        for t in order:
            s = [sum(h[i] * float(u[i, j]) for i in range(n)) for j in range(3 * n)]
            a = [float(v) for v in g[raw[t]]] if raw[t] is not None else [float(v) for v in g[32]]
            z, r = [sigmoid(a[j] + s[j]) for j in range(n)], [sigmoid(a[n + j] + s[n + j]) for j in range(n)]
            new = [math.tanh(a[2 * n + j] + r[j] * s[2 * n + j]) for j in range(n)]
            h = [new[j] + z[j] * (h[j] - new[j]) for j in range(n)]
            at[t] = h
        return at

    forward, backward = states(range(len(raw)), "f"), states(range(len(raw) - 1, -1, -1), "b")
    for t in range(len(raw)):
        both = forward[t] + backward[t]
        score = [sum(b * float(net.p["v"][i, k]) for i, b in enumerate(both)) + float(net.p["c"][k]) for k in range(len(net.p["c"]))]
        e = [math.exp(v - max(score)) for v in score]
        out.append([v / sum(e) for v in e])
    return out


def test_windows_are_a_plain_loop(monkeypatch):
    monkeypatch.setattr(language, "CORE", 10)
    monkeypatch.setattr(language, "AROUND", 4)
    net = language.Network(3, hidden=4)
    texts = [b"", b"abc", b"the quick brown fox jumps", b"x" * 10, "über".encode()]
    got = language.document_means(net, np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    for text, row in zip(texts, got):
        found = []
        for at in range(0, len(text), 10):
            window = [text[i] if 0 <= i < len(text) else None for i in range(at - 4, at + 14)]
            found += plain_means(net, window)[4 : 4 + min(10, len(text) - at)]
        want = np.mean(found, 0) if found else np.zeros(3)
        assert np.allclose(row, want, atol=1e-5)


def test_positions_see_the_words_around():
    net = language.Network(3)
    one, other = (net.positions(np.frombuffer(t, np.uint8)[None])[0][8:11] for t in (b"of that the one", b"on them the two"))
    assert np.abs(one - other).max() > 1e-4


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = language.identify(docs).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    rows = [r for r in got if r.held_out]
    right = sum(r.lang_pred == truth[r.doc_id] for r in rows) / len(rows)
    assert right > 0.97, right


def test_defined_cases(spark):
    rows = [(1, None, "en"), (2, "", None), (3, "123 !", "de"), (None, "the words", "en"), (5, "x" * 500, "en"), (6, "über die", "de"), (8, "of and the", "en"), (9, "ein Wort " * 20_000, "de"), (9, "ein Wort " * 20_000, "de")]
    frame = spark.createDataFrame([(*r, 9, [b"w"]) for r in rows], "doc_id long, text string, lang string, place int, windows array<binary>")
    assert len(language.identify(frame).collect()) == len(rows)
    assert all(zlib.crc32(str(i).encode()) % 4 != 2 for i in (103, 104))
    only_long = language.fit(frame.where("doc_id = 9 OR doc_id = 8").withColumn("doc_id", frame.doc_id + 95))  # no document is too long to learn from
    assert only_long[1] == ["de", "en"]
    got = {r.doc_id: r for r in language.identify(frame).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[None].held_out
    assert language.identify(frame.limit(0)).collect() == []
    assert all(r.lang_pred == "und" for r in language.identify(frame.withColumn("lang", frame.lang.substr(9, 0)).where("doc_id IS NULL")).collect())
