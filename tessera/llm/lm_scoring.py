"""Operator 11: scores of texts by online logistic context mixing (``mixing``).

What the model knows is counted over every training document: pairs of bytes (codes), and for each
hashed context the zeros and ones of the bits that came after it.  A task sums its bits in one
table, sends the parts of it that it used, and these meet a few at a time until one remains; the
broadcast model is one byte a slot, whatever the input.  The weights that a lane starts from are
fitted to every bit of every training document: each of two halves, by the hash of the id, is judged by what
the other half counted, so no document is judged by itself.  Newton's steps sum slopes over all blocks, until
one takes almost nothing off.  They begin where a fit to windows of WINDOW words from the SAMPLE training
documents of least hash ends, which spares passes; nothing is a sample in the result.

The base score needs the exact count of every word.  A block of documents sends each distinct word
once, dealt out by the word's hash, and learns its total.  Blocks under one hash meet at most
SENDERS at a time, what these sum up meets in turn, so a word that every block holds is no hot
group.

Defined results: a null or blank text is its end token alone; the model's text is the words in
lower case (A-Z), each with a space after it, and the end.  A null doc_id is held out, and so
is the largest long, which stands for it.  Rows that
repeat keep a row each, and count once each in training.  Without training documents the base
score is 0, and the model holds nothing but its codes.  Other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import mixing
from .anchors import NO_ID
from .common import materialize, record_batch, shuffle_partitions, slices, text_buffer

SAMPLE, WINDOW = 256, 160
#: Tables that meet in one task, and senders of words that do.
FAN, SENDERS = 32, 4096
#: Smoothing of the base score.
ADD = 0.1
_TOKENS, _DOCS = -1, -2


def held_out(doc_id: int) -> bool:
    return doc_id == NO_ID or zlib.crc32(str(doc_id).encode()) % 10 == 0


def _last(stream: np.ndarray) -> np.ndarray:
    """Where tokens end."""
    return np.flatnonzero((stream == mixing.SPACE) | (stream == mixing.END))


def _blocks(docs: DataFrame) -> DataFrame:
    """Documents as blocks of token streams, written to the shared folder."""
    schema = pa.schema([("block_id", pa.int64()), ("doc_ids", pa.binary()), ("ends", pa.binary()), ("payload", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, made = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch):
                stream, ends = mixing.stream_of(*text_buffer(part.column("text")))
                ids = part.column("doc_id").cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)
                yield record_batch(schema, [made], [ids.astype(np.int64).tobytes()], [ends.tobytes()], [squeeze.compress(stream.tobytes())])
                made += 1

    return materialize(docs.select("doc_id", "text").mapInArrow(pack, "block_id long, doc_ids binary, ends binary, payload binary"), "lm-blocks")


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _half(doc_id: int) -> int:
    return xxhash.xxh64_intdigest(str(doc_id)) & 1


def _streams(row: dict, train_only: bool = False, half: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's ids, which of its documents train (those of one half, if asked for), token stream and its
    offsets."""
    ids, ends = np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["ends"], np.int64)
    stream = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["payload"]), np.uint8)
    train = np.array([not held_out(i) and (half is None or _half(i) == half) for i in ids.tolist()], bool)
    if train_only:
        length = np.diff(ends)
        stream, ends = stream[np.repeat(train, length)], np.r_[0, np.cumsum(length[train])]
    return ids, train, stream, ends


def _sums(blocks: DataFrame) -> DataFrame:
    """pair, n: counts of byte pairs, tokens and documents; rank, window: of the documents of least hash."""
    schema = pa.schema([("pair", pa.int32()), ("n", pa.int64()), ("rank", pa.int64()), ("window", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, tokens, docs = np.zeros(65536, np.int64), 0, 0
        for batch in batches:
            for row in _rows(batch):
                ids, train, stream, ends = _streams(row, train_only=True)
                pairs += mixing.pair_counts(stream, mixing.tokens_of(stream))
                tokens += len(_last(stream))
                docs += len(ends) - 1
                ranks = np.array([xxhash.xxh64_intdigest(str(i)) >> 1 for i in ids[train].tolist()], np.int64)
                least = np.argsort(ranks, kind="stable")[:SAMPLE]
                windows = []
                for k in least.tolist():
                    words = stream[ends[k] : ends[k + 1] - 1].tobytes().split(b" ")[:-1]
                    at = int(ranks[k]) % max(1, len(words) - WINDOW + 1)
                    windows.append(b" ".join(words[at : at + WINDOW]))
                none = [None] * len(least)
                yield record_batch(schema, none, none, ranks[least], windows)
        used = np.flatnonzero(pairs)
        yield record_batch(schema, np.r_[used, _TOKENS, _DOCS].astype(np.int32), np.r_[pairs[used], tokens, docs], *[[None] * (len(used) + 2)] * 2)

    return blocks.mapInArrow(work, "pair int, n long, rank long, window binary")


def _class_counts(blocks: DataFrame, classes: np.ndarray) -> list[np.ndarray]:
    """How often each byte follows each class in training documents of each half."""
    shared = blocks.sparkSession.sparkContext.broadcast(classes)
    schema = pa.schema([("at", pa.int32()), ("n", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * (mixing.CLASSES << 8), np.int64)
        for batch in batches:
            for row in _rows(batch):
                for half, own in enumerate(np.split(counts, 2)):
                    _, _, stream, _ = _streams(row, True, half)
                    own += mixing.class_counts(stream, mixing.tokens_of(stream), shared.value)
        used = np.flatnonzero(counts)
        yield record_batch(schema, used.astype(np.int32), counts[used])

    out = np.zeros(2 * (mixing.CLASSES << 8), np.int64)
    for r in blocks.mapInArrow(work, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # CLASSES * 512 rows at most
        out[r["at"]] = r.n
    return np.split(out, 2)


def _bit_counts(blocks: DataFrame, code, half: int) -> DataFrame:
    """chunk, half, part, counts: each task's sums over its training documents of one half, by chunks of slots."""
    schema = pa.schema([("chunk", pa.int32()), ("half", pa.int32()), ("part", pa.int64()), ("counts", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((mixing.STARTS[-1], 2), np.int32)
        for batch in batches:
            for row in _rows(batch):
                _, _, stream, _ = _streams(row, True, half)
                mixing.count_bits(table, stream, mixing.tokens_of(stream), code.value)
        squeeze, part = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId()
        for chunk in range(mixing.STARTS[-1] // mixing.CHUNK):
            own = table[chunk * mixing.CHUNK : (chunk + 1) * mixing.CHUNK]
            if own.any():
                yield record_batch(schema, [chunk], [half], [part], [squeeze.compress(own.astype(np.int64).tobytes())])

    return blocks.mapInArrow(work, "chunk int, half int, part long, counts binary")


def _added(group: pa.Table, half: int | None = None) -> np.ndarray:
    total = np.zeros((mixing.CHUNK, 2), np.int64)
    for x, of in zip(group.column("counts"), group.column("half").to_pylist()):
        if half is None or of == half:
            total += np.frombuffer(zstandard.ZstdDecompressor().decompress(x.as_py()), np.int64).reshape(-1, 2)
    return total


def _merged(counts: DataFrame, parts: int) -> DataFrame:
    """At most FAN rows a chunk and half."""
    schema = pa.schema([("chunk", pa.int32()), ("half", pa.int32()), ("part", pa.int64()), ("counts", pa.binary())])

    def add(group: pa.Table) -> pa.Table:
        packed = zstandard.ZstdCompressor(level=1).compress(_added(group).tobytes())
        return pa.Table.from_batches([record_batch(schema, group.column("chunk")[:1].to_pylist(), group.column("half")[:1].to_pylist(), [group.column("part")[0].as_py() // FAN], [packed])])

    while parts > FAN:
        counts = counts.groupBy("chunk", "half", F.floor(F.col("part") / FAN).alias("meeting")).applyInArrow(add, "chunk int, half int, part long, counts binary")
        parts = math.ceil(parts / FAN)
    return counts


def _said(counts: DataFrame, sample: np.ndarray) -> list[np.ndarray]:
    """What all slots say, what they say without the ``sample`` (slots x 2), and what each half says."""
    used = np.flatnonzero(sample.any(1))
    removed = counts.sparkSession.sparkContext.broadcast((used.astype(np.int32), sample[used]))
    names = ["said", "without", "first", "second"]
    schema = pa.schema([("chunk", pa.int32()), *((n, pa.binary()) for n in names)])

    def say(group: pa.Table) -> pa.Table:
        chunk, halves = group.column("chunk")[0].as_py(), [_added(group, half) for half in (0, 1)]
        slots, less = removed.value
        a, z = np.searchsorted(slots, [chunk * mixing.CHUNK, (chunk + 1) * mixing.CHUNK])
        total = halves[0] + halves[1]
        rest = total.copy()
        rest[slots[a:z] - chunk * mixing.CHUNK] -= less[a:z]
        squeeze = zstandard.ZstdCompressor(level=1)
        return pa.Table.from_batches([record_batch(schema, [chunk], *([squeeze.compress(mixing.predictions(x).tobytes())] for x in (total, rest, *halves)))])

    out = [np.zeros(mixing.STARTS[-1], np.int8) for _ in names]
    for r in counts.groupBy("chunk").applyInArrow(say, f"chunk int, {', '.join(f'{n} binary' for n in names)}").collect():  # a byte a slot, each
        for own, n in zip(out, names):
            own[r.chunk * mixing.CHUNK : (r.chunk + 1) * mixing.CHUNK] = np.frombuffer(zstandard.ZstdDecompressor().decompress(r[n]), np.int8)
    return out


def _fitted(blocks: DataFrame, code, halves: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """Weights after Newton's steps over all training documents; a step that made things worse is halved."""
    spark = blocks.sparkSession
    others = spark.sparkContext.broadcast(halves[::-1])
    schema = pa.schema([("at", pa.int32()), ("v", pa.float64())])

    def sums(now: np.ndarray) -> np.ndarray:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = np.zeros((mixing.GATES, mixing.SUMS))
            for batch in batches:
                for row in _rows(batch):
                    for half in (0, 1):
                        _, _, stream, _ = _streams(row, True, half)
                        own += mixing.slopes(stream, mixing.tokens_of(stream), code.value, others.value[half], now)
            yield record_batch(schema, np.arange(own.size, dtype=np.int32), own.ravel())

        out = np.zeros(mixing.GATES * mixing.SUMS)
        for r in blocks.mapInArrow(work, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
            out[r["at"]] = r.v
        return out.reshape(mixing.GATES, mixing.SUMS)

    last, cost = weights, math.inf
    for _ in range(mixing.ROUNDS):
        after, now, off = mixing.newton(sums(weights), weights)
        if now > cost * (1 + 1e-9):
            weights = (weights + last) / 2
            continue
        last, cost, weights = weights, now, after
        if off <= mixing.SETTLED * now:
            break
    return weights


def fit(blocks: DataFrame) -> tuple[mixing.Code, np.ndarray, np.ndarray, int, int]:
    """Codes, what the slots say, weights; and how many tokens and documents trained."""
    sums = materialize(_sums(blocks), "lm-sums")
    pairs, totals = np.zeros(65536, np.int64), {_TOKENS: 0, _DOCS: 0}
    for r in sums.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # 65,538 rows at most
        if r.pair < 0:
            totals[r.pair] = r.n
        else:
            pairs[r.pair] = r.n
    windows = [r.window for r in sums.where("rank IS NOT NULL").orderBy("rank", "window").limit(SAMPLE).select("window").collect()]
    classes = mixing.classes_of(pairs)
    of_half = _class_counts(blocks, classes)
    after = of_half[0] + of_half[1]
    code = mixing.Code(after, classes)
    shared = blocks.sparkSession.sparkContext.broadcast(code)
    counts = _merged(_bit_counts(blocks, shared, 0).unionByName(_bit_counts(blocks, shared, 1)), 2 * blocks.rdd.getNumPartitions())
    sizes = np.array([len(w) for w in windows], np.int64)
    stream, _ = mixing.stream_of(np.frombuffer(b"".join(windows), np.uint8), np.r_[0, np.cumsum(sizes)].astype(np.int64))
    starts = mixing.tokens_of(stream)
    own = np.zeros((mixing.STARTS[-1], 2), np.int32)
    mixing.count_bits(own, stream, starts, code)
    said, without, *halves = _said(counts, own)
    rest = np.maximum(after - mixing.class_counts(stream, starts, classes), 0)
    said[: 1 << mixing.BITS[0]] = mixing.predictions(mixing.node_counts(after, code))
    without[: 1 << mixing.BITS[0]] = mixing.predictions(mixing.node_counts(rest, code))
    for own_half, counted in zip(halves, of_half):
        own_half[: 1 << mixing.BITS[0]] = mixing.predictions(mixing.node_counts(counted, code))
    judged = mixing.inputs_of(mixing.batch_of(stream, starts, 0, len(stream), code), without) if windows else np.zeros((0, mixing.CONTEXTS), np.int8)
    weights = _fitted(blocks, shared, halves, mixing.fit_weights(judged).astype(np.float64)) if windows else mixing.fit_weights(judged)
    return code, said, weights.astype(np.float32), totals[_TOKENS], totals[_DOCS]


class Words:
    """The words of a block: of each its number among the distinct ones, which stand by bucket."""

    def __init__(self, stream: np.ndarray, buckets: int):
        last = _last(stream)
        bounds = np.r_[0, last + 1]
        number, index, hashed = mixing.word_classes(stream, bounds)
        word = stream[last[index]] == mixing.SPACE  # ends aside
        bucket = ((hashed * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(33)).astype(np.int64) % buckets
        order = np.flatnonzero(word)[np.argsort(bucket[word], kind="stable")]
        raw, index = stream.tobytes(), index[order]
        self.distinct, self.bucket = [raw[a:z] for a, z in zip(bounds[index].tolist(), last[index].tolist())], bucket[order]
        place = np.full(len(bucket), -1)
        place[order] = np.arange(len(order))
        self.number = place[number]
        self.number = self.number[self.number >= 0]
        self.cut = np.flatnonzero(np.r_[True, self.bucket[1:] != self.bucket[:-1]]) if len(order) else np.zeros(0, np.int64)


def _word_totals(blocks: DataFrame, buckets: int, n_blocks: int) -> tuple[DataFrame, int]:
    """block_id, bucket, totals: how often each distinct word of a block stands in training documents,
    in the order of ``Words``; and how many words do."""
    salts = math.ceil(n_blocks / SENDERS)
    sent = pa.schema([("bucket", pa.int32()), ("salt", pa.int32()), ("block_id", pa.int64()), ("words", pa.binary()), ("counts", pa.binary())])
    summed = pa.schema([("bucket", pa.int32()), ("salt", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), ("known", pa.int64())])
    told = pa.schema([("block_id", pa.int64()), ("bucket", pa.int32()), ("totals", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                _, train, stream, ends = _streams(row)
                own = Words(stream, buckets)
                if not len(own.distinct):
                    continue
                each = np.diff(np.r_[0, np.cumsum(stream == mixing.SPACE)][ends])
                counts = np.bincount(own.number[np.repeat(train, each)], minlength=len(own.distinct))
                bounds = list(zip(own.cut.tolist(), [*own.cut[1:].tolist(), len(own.distinct)]))
                n, salt = len(bounds), xxhash.xxh32_intdigest(str(row["block_id"])) % salts
                yield record_batch(
                    sent, own.bucket[own.cut].astype(np.int32), np.full(n, salt, np.int32), np.full(n, row["block_id"]),
                    [b" ".join(own.distinct[a:z]) for a, z in bounds], [counts[a:z].tobytes() for a, z in bounds],
                )

    def joined(group: pa.Table) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Distinct words, their numbers in each row, and sums."""
        lists = [x.as_py().split(b" ") for x in group.column("words")]
        number, words = pd.factorize(np.array([*(w for own in lists for w in own), None], object)[:-1])
        counts = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in group.column("counts")])
        total = np.zeros(len(words), np.int64)
        np.add.at(total, number, counts)
        return words, np.split(number, np.cumsum([len(own) for own in lists])[:-1]), total

    def add(group: pa.Table) -> pa.Table:
        words, _, total = joined(group)
        return pa.Table.from_batches([record_batch(summed, group.column("bucket")[:1].to_pylist(), group.column("salt")[:1].to_pylist(), [b" ".join(words)], [total.tobytes()], [0])])

    def close(group: pa.Table) -> pa.Table:
        _, numbers, total = joined(group)
        known = [int(np.count_nonzero(total)), *[0] * (group.num_rows - 1)]
        return pa.Table.from_batches([record_batch(summed, group.column("bucket").to_pylist(), group.column("salt").to_pylist(), group.column("words").to_pylist(), [total[x].tobytes() for x in numbers], known)])

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return told.empty_table()
        total = dict(zip(known.column("words")[0].as_py().split(b" "), np.frombuffer(known.column("counts")[0].as_py(), np.int64).tolist()))
        totals = [np.array([total[w] for w in x.as_py().split(b" ")], np.int64).tobytes() for x in asked.column("words")]
        return pa.Table.from_batches([record_batch(told, asked.column("block_id").to_pylist(), asked.column("bucket").to_pylist(), totals)])

    rows = materialize(blocks.mapInArrow(send, "bucket int, salt int, block_id long, words binary, counts binary"), "lm-words")
    kind = "bucket int, salt int, words binary, counts binary, known long"
    totals = materialize(rows.groupBy("bucket", "salt").applyInArrow(add, kind).groupBy("bucket").applyInArrow(close, kind), "lm-totals")
    known = totals.agg(F.sum("known")).first()[0] or 0
    asked = rows.groupBy("bucket", "salt").cogroup(totals.groupBy("bucket", "salt")).applyInArrow(answer, "block_id long, bucket int, totals binary")
    return materialize(asked, "lm-answers"), known


_OUT = pa.schema(
    [
        ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()),
        ("base_score", pa.float64()), ("score", pa.float64()), ("bits_per_byte", pa.float64()),
    ]
)
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the model's
    probability) and bits_per_byte (its bits, for each byte of the model's text)."""
    blocks = _blocks(docs)
    n_blocks = blocks.count()
    if not n_blocks:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    buckets = max(shuffle_partitions(docs.sparkSession), 2 * n_blocks)
    code, said, weights, n_tokens, n_docs = fit(blocks)
    answers, words = _word_totals(blocks, buckets, n_blocks)
    size = n_tokens + ADD * (words + bool(n_docs) + 1)
    model = docs.sparkSession.sparkContext.broadcast((code, said, weights))

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        totals = {r["bucket"]: r["totals"] for r in right.to_pylist()}
        for row in left.to_pylist():
            ids, train, stream, ends = _streams(row)
            own = Words(stream, buckets)
            counts = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(totals[b], np.int64) for b in own.bucket[own.cut].tolist())])
            last = _last(stream)
            count = np.full(len(last), n_docs, np.int64)  # of each token, ends included
            count[stream[last] == mixing.SPACE] = counts[own.number]
            first = np.searchsorted(last, ends[:-1])
            base = np.add.reduceat(np.log10((count + ADD) / size), first)
            known = np.add.reduceat((count > 0).astype(np.int64), first)
            cost = mixing.lane_costs(stream, mixing.tokens_of(stream), ends, *model.value)
            out.append(
                record_batch(
                    _OUT, pa.array(ids, mask=ids == NO_ID), ~train, np.diff(np.r_[first, len(last)]), known, np.full(len(ids), n_tokens),
                    base, -cost / math.log(10), cost / math.log(2) / np.diff(ends),
                )
            )
        return pa.Table.from_batches(out, schema=_OUT)

    spread = blocks.repartition(max(shuffle_partitions(docs.sparkSession), n_blocks // FAN), "block_id")  # much work for few bytes
    return spread.groupBy("block_id").cogroup(answers.groupBy("block_id")).applyInArrow(work, SCHEMA)
