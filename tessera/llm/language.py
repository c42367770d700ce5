"""Operator 9: language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's bytes in both directions and labels every position; a document's
probabilities are the means over all its positions.  A text is read in windows of ``CORE`` bytes
with ``AROUND`` bytes of the same text on either side, so that every position has been reached
across the words before and after it.  The network is trained in numpy by back-propagation through
time on a bounded sample of labelled documents.

Defined results: a text that is null or has no letter gets ``und`` with score 0, and so does every
text if there is nothing to learn from.  Of languages that tie the first by name is taken.  Rows
that repeat keep a row each; a null doc_id is held out; columns beside doc_id, text and lang are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import record_batch, slices, text_buffer

HIDDEN = 16
CORE, AROUND = 448, 32
#: Cores of windows are padded to multiples of so many bytes.
STEP = 64
#: Windows read at once.
ROWS = 768
#: The bound of the training sample: documents a language (those of least hash), and windows of so
#: many bytes drawn from each.
SAMPLE_DOCS = 300
SAMPLE_WINDOWS = 4
SAMPLE_BYTES = 128
#: So many times the sample is drawn by hash before it is ordered.
SPARE = 4
#: Languages whose shares are broadcast.
MOST_LANGUAGES = 10_000
EPOCHS = 4
BATCH = 32
UNKNOWN = "und"
SPACE = 32


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Parameters: for each direction the gates' rows by byte (256 x 3H, biases included) and
    recurrent weights (H x 3H); output weights (2H x K) and biases."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 7):
        draw = np.random.default_rng(seed)
        scale = 1 / np.sqrt(hidden)
        self.hidden = hidden
        self.p = {}
        for d in "fb":
            self.p[f"g{d}"] = draw.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
            self.p[f"u{d}"] = draw.uniform(-scale, scale, (hidden, 3 * hidden)).astype(np.float32)
        self.p["v"] = draw.uniform(-scale, scale, (2 * hidden, classes)).astype(np.float32)
        self.p["c"] = np.zeros(classes, np.float32)

    def read(self, x: np.ndarray, direction: str, keep: bool = False):
        """States after each byte of ``x`` (batch x length), read forwards or backwards."""
        g, u, n = self.p[f"g{direction}"], self.p[f"u{direction}"], self.hidden
        columns = np.ascontiguousarray(x.T)
        steps = range(len(columns)) if direction == "f" else range(len(columns) - 1, -1, -1)
        h = np.zeros((len(x), n), g.dtype)
        states = np.empty((len(columns), len(x), n), g.dtype)
        tape = []
        for t in steps:
            a, s = g[columns[t]], h @ u
            gates = _sigmoid(a[:, : 2 * n] + s[:, : 2 * n])
            z, r, inner = gates[:, :n], gates[:, n:], s[:, 2 * n :]
            new = np.tanh(a[:, 2 * n :] + r * inner)
            if keep:
                tape.append((t, h, z, r, inner, new))
            h = new + z * (h - new)
            states[t] = h
        return states, tape

    def states(self, x: np.ndarray, direction: str) -> np.ndarray:
        """The states of ``read``, without a tape and in buffers that are used again."""
        g, u, n = self.p[f"g{direction}"], self.p[f"u{direction}"], self.hidden
        columns = np.ascontiguousarray(x.T)
        out = np.empty((len(columns), len(x), n), g.dtype)
        a, s = np.empty((len(x), 3 * n), g.dtype), np.empty((len(x), 3 * n), g.dtype)
        gates, new, h = np.empty((len(x), 2 * n), g.dtype), np.empty((len(x), n), g.dtype), np.zeros((len(x), n), g.dtype)
        z, r = gates[:, :n], gates[:, n:]
        negative = g * np.repeat(np.array([-1, -1, 1], g.dtype), n)
        turned = u * np.repeat(np.array([-1, -1, 1], u.dtype), n)  # gates come out negated, as exp wants them
        for t in range(len(columns)) if direction == "f" else range(len(columns) - 1, -1, -1):
            np.take(negative, columns[t], axis=0, out=a, mode="clip")
            np.matmul(h, turned, out=s)
            np.add(a[:, : 2 * n], s[:, : 2 * n], out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            np.multiply(s[:, 2 * n :], r, out=new)
            new += a[:, 2 * n :]
            np.tanh(new, out=new)
            h -= new
            h *= z
            h += new
            out[t] = h
        return out

    def labelled(self, both: np.ndarray) -> np.ndarray:
        scores = both @ self.p["v"] + self.p["c"]
        scores = np.exp(scores - scores.max(-1, keepdims=True))
        return scores / scores.sum(-1, keepdims=True)

    def positions(self, x: np.ndarray, keep: bool = False):
        """Probabilities at each position (length x batch x classes), states and tapes."""
        forward, tape_f = self.read(x, "f", keep)
        backward, tape_b = self.read(x, "b", keep)
        both = np.concatenate([forward, backward], 2)
        return self.labelled(both), both, tape_f, tape_b

    def gradients(self, x: np.ndarray, label: np.ndarray, own: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over the positions (those that are ``own``), and its gradients, back through time."""
        p, both, tape_f, tape_b = self.positions(x, keep=True)
        rows = np.arange(len(x))
        weight = np.ones(p.shape[:2], p.dtype) if own is None else own.T.astype(p.dtype)
        weight /= max(weight.sum(), 1)
        loss = -float((np.log(p[:, rows, label] + 1e-9) * weight).sum())
        d = p.copy()
        d[:, rows, label] -= 1
        d *= weight[:, :, None]
        n, v = self.hidden, self.p["v"]
        out = {"v": both.reshape(-1, 2 * n).T @ d.reshape(-1, v.shape[1]), "c": d.sum((0, 1))}
        dstates = d @ v.T
        for direction, tape, part in (("f", tape_f, dstates[:, :, :n]), ("b", tape_b, dstates[:, :, n:])):
            u = self.p[f"u{direction}"]
            dg, du = np.zeros_like(self.p[f"g{direction}"]), np.zeros_like(u)
            dh = np.zeros((len(x), n), np.float32)
            for t, h, z, r, inner, new in reversed(tape):
                dh = dh + part[t]
                dnew = dh * (1 - z) * (1 - new * new)
                dz = dh * (h - new) * z * (1 - z)
                dr = dnew * inner * r * (1 - r)
                da = np.concatenate([dz, dr, dnew], 1)
                ds = np.concatenate([dz, dr, dnew * r], 1)
                np.add.at(dg, x[:, t], da)
                du += h.T @ ds
                dh = dh * z + ds @ u.T
            out[f"g{direction}"], out[f"u{direction}"] = dg, du
        return loss, out


def framed(words: list[bytes]) -> np.ndarray:
    """Byte strings of one length as rows of bytes between spaces."""
    return np.frombuffer(b"".join(b" %b " % w for w in words), np.uint8).reshape(len(words), -1)


def train(windows: list[bytes], labels: np.ndarray, classes: int, *, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """A network by Adam over batches of windows; shorter ones are padded, and padding isn't judged."""
    net, draw = Network(classes, seed=seed), np.random.default_rng(seed)
    length = np.array([len(w) for w in windows])
    x = np.full((len(windows), int(length.max())), SPACE, np.uint8)
    for i, w in enumerate(windows):
        x[i, : len(w)] = np.frombuffer(w, np.uint8)
    own = np.arange(x.shape[1]) < length[:, None]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for epoch in range(epochs):
        order = draw.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            which = order[at : at + BATCH]
            _, grads = net.gradients(x[which], labels[which], own[which])
            step += 1
            rate = 0.01 * 0.5**epoch
            for k, g in grads.items():
                m, s = moments[k]
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                net.p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return net


def document_means(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean probabilities over the positions of each text; zeros for an empty one."""
    lengths = np.diff(offsets)
    cuts = -(-lengths // CORE)
    doc = np.repeat(np.arange(len(lengths)), cuts)
    start = offsets[:-1][doc] + CORE * (np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts))
    size = np.minimum(CORE, offsets[1:][doc] - start)
    total = np.zeros((len(lengths), len(net.p["c"])))
    span = np.minimum(CORE, -(-size // STEP) * STEP)  # a window's padding depends on its own length alone
    batches = [(int(most), own[at : at + ROWS]) for most in np.unique(span) for own in [np.flatnonzero(span == most)] for at in range(0, len(own), ROWS)]
    for most, which in batches:
        place = start[which, None] - AROUND + np.arange(most + 2 * AROUND)
        inside = (place >= offsets[:-1][doc[which], None]) & (place < offsets[1:][doc[which], None])
        x = np.where(inside, data[np.clip(place, 0, len(data) - 1)], np.uint8(SPACE))
        states = [net.states(x, d)[AROUND : AROUND + most].reshape(-1, net.hidden) for d in "fb"]
        p = sum(v.T @ s.T for v, s in zip(np.split(net.p["v"], 2), states)) + net.p["c"][:, None]  # classes x positions
        p -= p.max(0)
        np.exp(p, out=p)
        p /= p.sum(0)
        p = p.reshape(-1, most, len(which))
        p *= np.arange(most)[:, None] < size[which]
        np.add.at(total, doc[which], p.sum(1).T)
    return total / np.maximum(lengths, 1)[:, None]


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def fit(docs: DataFrame, *, docs_a_language: int = SAMPLE_DOCS, windows_a_document: int = SAMPLE_WINDOWS) -> tuple[Network | None, list[str]]:
    """Network and languages from the labelled documents that aren't held out: of each language up
    to ``docs_a_language`` (whatever their lengths), and of each up to ``windows_a_document`` windows,
    evenly spaced.  Only those windows reach the driver."""
    use = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    counts = use.groupBy("lang").count()  # a row for each language
    share = counts.select(F.col("lang").alias("l"), (F.lit(SPARE * docs_a_language) / F.col("count")).alias("share"))
    # broadcast where the rows, one for each language, are few enough; texts aren't shuffled then
    few = use.join(F.broadcast(share) if counts.count() <= MOST_LANGUAGES else share, use.lang == F.col("l")).where(F.pmod(F.xxhash64("doc_id", F.lit("few")), F.lit(1 << 30)) / float(1 << 30) < F.col("share")).select("doc_id", "lang", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = []
                for text in part.column("text").to_pylist():
                    raw = text.encode()
                    n = min(windows_a_document, -(-len(raw) // SAMPLE_BYTES))
                    room = max(len(raw) - SAMPLE_BYTES, 0)
                    found.append([raw[(a := room * i // max(n - 1, 1)) : a + SAMPLE_BYTES] for i in range(n)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array(found, pa.list_(pa.binary()))], names=["doc_id", "lang", "windows"])

    least = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "windows")
    drawn = few.mapInArrow(cut, "doc_id long, lang string, windows array<binary>").withColumn("place", F.row_number().over(least))
    rows = drawn.where(F.col("place") <= docs_a_language).select("lang", "windows").collect()
    languages = sorted({r.lang for r in rows})
    number = {language: i for i, language in enumerate(languages)}
    pairs = sorted((number[r.lang], bytes(w)) for r in rows for w in r.windows)
    return (train([w for _, w in pairs], np.array([i for i, _ in pairs]), len(languages)), languages) if pairs else (None, languages)


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def predict(docs: DataFrame, net: Network | None, languages: list[str]) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                letters = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool)
                if net is None:
                    names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                else:
                    data, offsets = text_buffer(pa.array([t if ok else "" for t, ok in zip(texts, letters)], pa.string()))
                    p = document_means(net, data, offsets)
                    names = [languages[k] if ok else UNKNOWN for k, ok in zip(p.argmax(1).tolist(), letters)]
                    score = np.where(letters, p.max(1), 0.0)
                yield record_batch(_OUT, part.column("doc_id"), part.column("held_out"), names, np.clip(score, 0, 1))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(work, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, *fit(docs))
