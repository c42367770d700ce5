"""Operator 6: quality by importance resampling over hashed n-grams.

Two generative models give a byte's probability after the two before it, from counts of hashed
trigrams that lean on bigrams and those on single bytes: the target model counts a bounded sample
of documents labelled good, the raw model all documents.  A document's score is the log ratio of
its likelihoods a trigram, shrunk for short texts; word bigrams of one word twice have their own
two buckets.  ``TEMPER`` scores are its log importance weight: whatever its length, a document
counts as so many trigrams.  A Gumbel draw is added to the weight, and the k documents of the
largest sums are a sample without replacement in proportion to the weights.

k follows the labels: good documents are scored by models that have not seen them (two folds), and
k is the number of documents that reach the ``LOSS`` quantile of those scores.

Defined results: a text without trigrams (null, or under three bytes) scores 0; without a labelled
good document all scores are 0 and every document is kept; documents that tie with the k-th are
kept too.  The draw depends on doc_id alone, so rows that repeat a doc_id draw alike; a label that
repeats counts once.  Columns beside doc_id and text are carried or ignored.  An empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .anchors import mixed
from .common import materialize, record_batch, slices, text_buffer

#: Buckets of trigrams, by hash; bytes and bigrams have one each, word bigrams two.
HASHED = 1 << 17
BYTES, BIGRAMS, WORDS = 0, 256, 256 + 65536 + HASHED
BUCKETS = WORDS + 2
PRIOR = 4.0
SHRINK = 100
TEMPER = 100.0
#: Labelled documents of the target model: those of least hash.
SAMPLE_DOCS = 20_000
LOSS = 0.0025
SEED = 29
CHUNK = 1 << 16


def trigrams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Places, first and second bigrams and buckets of the trigrams that stay inside one text,
    chunk by chunk."""
    starts = offsets[:-1]
    for at in range(0, max(len(data) - 2, 0), CHUNK):
        raw = data[at : at + CHUNK + 2].astype(np.int64)
        count = len(raw) - 2
        good = np.ones(count, bool)
        inside = starts[np.searchsorted(starts, at, side="right") : np.searchsorted(starts, at + len(raw), side="left")] - at
        for d in (1, 2):  # trigrams that begin d bytes before a text
            cross = inside - d
            good[cross[(cross >= 0) & (cross < count)]] = False
        place = np.flatnonzero(good)
        first, second, third = raw[place], raw[place + 1], raw[place + 2]
        hashed = (mixed((first << 16 | second << 8 | third).astype(np.uint64)) & np.uint64(HASHED - 1)).astype(np.int64)
        yield place + at, first << 8 | second, second << 8 | third, hashed


def repeats(text: str | None) -> tuple[int, int]:
    """Word bigrams of one word twice, and the others."""
    words = (text or "").split()
    same = sum(map(str.__eq__, words, words[1:]))
    return same, max(len(words) - 1, 0) - same


_COUNTS = pa.schema([("bucket", pa.int32()), ("raw", pa.int64()), ("one", pa.int64()), ("two", pa.int64())])


def count_grams(docs: DataFrame) -> DataFrame:
    """``docs`` (text, fold: 0, or 1 or 2 for good documents): counts by bucket over all
    documents (raw) and over either fold (one, two)."""

    def add(counts: np.ndarray, first, _, hashed) -> None:
        counts[BYTES:BIGRAMS] += np.bincount(first >> 8, minlength=256)
        counts[BIGRAMS : BIGRAMS + 65536] += np.bincount(first, minlength=65536)
        counts[BIGRAMS + 65536 : WORDS] += np.bincount(hashed, minlength=HASHED)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((3, BUCKETS), np.int64)
        for batch in batches:
            for part in slices(batch):
                data, offsets = text_buffer(part.column("text"))
                fold = part.column("fold").to_numpy()
                for place, *grams in trigrams(data, offsets):
                    add(counts[0], *grams)
                    if fold.any():
                        of = fold[np.searchsorted(offsets, place, side="right") - 1]
                        for k in (1, 2):
                            add(counts[k], *(g[of == k] for g in grams))
                twice = np.array([repeats(t) for t in part.column("text").to_pylist()])
                counts[0, WORDS:] += twice.sum(0)
                for k in (1, 2):
                    counts[k, WORDS:] += twice[fold == k].sum(0)
        seen = np.flatnonzero(counts[0])
        yield record_batch(_COUNTS, seen.astype(np.int32), *counts[:, seen])

    sums = [F.sum(c).alias(c) for c in ("raw", "one", "two")]
    return docs.mapInArrow(work, "bucket int, raw long, one long, two long").groupBy("bucket").agg(*sums)


class Model:
    """Probabilities of a byte after two others, and of repeated words."""

    def __init__(self, counts: np.ndarray):
        c1, c2 = counts[BYTES:BIGRAMS], counts[BIGRAMS : BIGRAMS + 65536]
        self.bigram = (c2 + PRIOR / 256) / np.repeat(c1 + PRIOR, 256)
        self.context = c2 + PRIOR
        self.hashed = counts[BIGRAMS + 65536 : WORDS].astype(np.float64)
        words = counts[WORDS:] + 0.5
        self.words = np.log(words / words.sum())

    def of(self, first, second, hashed) -> np.ndarray:
        return (self.hashed[hashed] + PRIOR * self.bigram[second]) / self.context[first]


def scores(part: pa.RecordBatch, raw: Model, target: Model) -> np.ndarray:
    data, offsets = text_buffer(part.column("text"))
    total, grams = np.zeros(part.num_rows), np.zeros(part.num_rows)
    for place, first, second, hashed in trigrams(data, offsets):
        of = np.searchsorted(offsets, place, side="right") - 1
        cut = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else of
        if len(cut):
            ratio = np.log(target.of(first, second, hashed) / raw.of(first, second, hashed))
            total[of[cut]] += np.add.reduceat(ratio, cut)
            grams[of[cut]] += np.diff(np.r_[cut, len(of)])
    twice = np.array([repeats(t) for t in part.column("text").to_pylist()])
    return np.where(grams > 0, total + twice @ (target.words - raw.words), 0.0) / (grams + SHRINK)


def score_documents(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """``docs`` (doc_id, text, fold, and maybe row): doc_id, score and, for good documents, their
    score by the other fold's model (unseen); with row, also that."""
    carry = "row" in docs.columns
    schema = StructType(StructType.fromDDL("doc_id long, score double, unseen double").fields + ([docs.schema["row"]] if carry else []))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [Model(c) for c in (*counts, counts[1] + counts[2])] if counts[1:].any() else None
        for batch in batches:
            for part in slices(batch):
                fold = part.column("fold").to_numpy()
                score, unseen = np.zeros(part.num_rows), np.full(part.num_rows, np.nan)
                if models:
                    score = scores(part, models[0], models[3])
                    for k in (1, 2):
                        which = np.flatnonzero(fold == k)
                        if len(which):
                            unseen[which] = scores(part.take(pa.array(which)), models[0], models[3 - k])
                columns = [part.column("doc_id"), pa.array(score), pa.array(unseen, mask=np.isnan(unseen)), *([part.column("row")] if carry else [])]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(work, schema)


def kth_largest(values: DataFrame, column: str, k: int) -> int:
    """The k-th largest of a column of longs under 2**51, by counts of 17 bits at a time."""
    prefix = 0
    for shift in (34, 17, 0):
        digit = F.shiftright(column, shift)
        counts = {r.d: r["count"] for r in values.where(F.shiftright(column, shift + 17) == prefix).groupBy(digit.alias("d")).count().collect()}
        for d in sorted(counts, reverse=True):
            if k <= counts[d]:
                prefix = d
                break
            k -= counts[d]
    return prefix


def resample(docs: DataFrame, labels: DataFrame, *, sample_docs: int = SAMPLE_DOCS, seed: int = SEED, carry: bool = False) -> DataFrame:
    """doc_id, log_weight, gumbel_key, keep; with ``carry`` also row, all columns of the document."""
    least = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    good = F.broadcast(least.select("doc_id", (F.lit(1) + F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(2))).cast("int").alias("fold")))
    whole = [F.struct(*docs.columns).alias("row")] if carry else []
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *whole).join(good, "doc_id", "left").withColumn("fold", F.coalesce("fold", F.lit(0)))
    counts = np.zeros((3, BUCKETS), np.int64)
    for batch in count_grams(marked.select("text", "fold")).toArrow().to_batches():  # a row for each bucket
        bucket, *columns = (c.to_numpy() for c in batch.columns)
        counts[:, bucket] = columns
    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    drawn = score_documents(marked, counts).withColumn("log_weight", F.col("score") * TEMPER).withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform)))
    step = (F.least(F.greatest("gumbel_key", F.lit(-1e9)), F.lit(1e9)) * 1e6 + 1e15).cast("long")
    scored = materialize(drawn.withColumn("step", step), "weights")
    cut = scored.agg(F.percentile("unseen", F.lit(LOSS))).first()[0]
    k = scored.where(F.col("score") >= F.lit(cut)).count() if cut is not None else 0
    limit = kth_largest(scored, "step", k) if k else 0
    return scored.select("doc_id", "log_weight", "gumbel_key", (F.col("step") >= limit).alias("keep"), *(["row"] if carry else []))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, all columns."""
    return resample(docs, labels, carry=True).where("keep").select("row.*")
