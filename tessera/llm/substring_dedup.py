"""Operator 2: removal of repeated word windows by relative Lempel-Ziv factoring.

Runs of windows that may repeat (``anchors``) meet by content in reference blocks.  Within a
block the run texts are factored greedily in document order against what the block has indexed so
far: a factor starts where the index holds the next 20 words, and grows for as long as its source
goes on alike.  Factors are long enough to be duplicate spans by themselves; the windows that
straddle the end of one are looked up one by one.  What is no factor is indexed.

Defined results: words are maximal runs of bytes other than space and 0x09-0x0D; a null, empty or
blank text has none and keeps the digest of nothing; of rows with one doc_id and one text none
repeats the other where their places are equal; a null doc_id counts as the largest.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from .anchors import NO_ID, Units, carried, mixed, repeated_windows
from .common import record_batch

WINDOW = 20
GRAM = 4
HOT_BLOCKS = 1024


def word_units(data: bytes, offsets: np.ndarray) -> Units:
    """Words of each document; ``data`` becomes the words, each followed by one space."""
    texts = [data[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    counts = np.array([len(t) for t in texts], np.int64)
    joined = b"".join(b" ".join(t) + b" " for t in texts if t)
    raw = np.frombuffer(joined, np.uint8)
    ends = np.flatnonzero(raw == 32)
    starts = np.r_[0, ends[:-1] + 1] if len(ends) else ends
    docs = np.r_[0, np.cumsum(counts)].astype(np.int64)
    if not len(ends):
        return Units(joined, np.zeros(0, np.uint64), starts, ends, docs)
    inside = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    parts = mixed(raw.astype(np.uint64) + (inside.astype(np.uint64) << np.uint64(8)) + np.uint64(1))
    return Units(joined, np.add.reduceat(parts, starts), starts, ends, docs)


def factor(rows: list[tuple], window: int = WINDOW) -> list[list[int]]:
    """Greedy factors of the run texts of a reference block, as (from, to) window pairs."""
    index: dict[bytes, tuple[list[bytes], int]] = {}
    out = []
    for text, windows, _, _ in rows:
        words = text.split(b" ")
        found: list[int] = []
        at = 0
        while at < windows:
            gram = b" ".join(words[at : at + window])
            source = index.setdefault(gram, (words, at))
            if source[0] is words and source[1] == at:
                at += 1
                continue
            other, start = source
            length, most = window, min(len(words) - at, len(other) - start)
            while length < most and words[at + length] == other[start + length]:
                length += 1
            to = min(at + length - window + 1, windows)
            if found and found[-1] == at:
                found[-1] = to
            else:
                found += [at, to]
            at = to
        out.append(found)
    return out


SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])


def remaining(units: Units, gone: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Number of words removed, and the remaining ones joined by a space, of each document."""
    total = np.r_[0, np.cumsum(gone)]
    removed = (total[units.docs[1:]] - total[units.docs[:-1]]).astype(np.int64)
    kept = []
    for a, b, n in zip(units.docs[:-1].tolist(), units.docs[1:].tolist(), removed.tolist()):
        whole = units.data[units.starts[a] : units.ends[b - 1]] if b > a else b""
        kept.append(b" ".join(compress(whole.split(b" "), (~gone[a:b]).tolist())) if n else whole)
    return removed, kept


def without_repeats(docs: DataFrame, *, window: int = WINDOW, hot_blocks: int = HOT_BLOCKS) -> DataFrame:
    """The documents, all columns, without their repeated words: a text that loses any becomes its
    remaining words joined by one space, any other (null, too) stays as it is."""
    names = docs.columns
    rest = [c for c in names if c != "text"]
    schema = to_arrow_schema(docs.select(*rest, "text").schema)
    flag = "_".join(["text_is_null", *names])  # carries whether a text was null; no column has that name

    def finish(row: dict, ids: np.ndarray, offsets: np.ndarray, data: bytes, units: Units, gone: np.ndarray) -> pa.RecordBatch:
        removed, kept = remaining(units, gone)
        other = carried(row)
        texts = [(k if n else data[a:b]).decode() for n, k, a, b in zip(removed.tolist(), kept, offsets[:-1].tolist(), offsets[1:].tolist())]
        missing = other.column(flag).to_numpy(zero_copy_only=False).astype(bool)
        columns = [other.column(c).cast(schema.field(c).type) for c in rest]
        return pa.RecordBatch.from_arrays([*columns, pa.array(texts, schema.field("text").type, mask=missing)], schema=schema)

    marked = docs.withColumn(flag, docs.text.isNull())
    gram = GRAM if window >= 2 * GRAM else 1
    result = repeated_windows(
        marked, word_units, lambda rows: factor(rows, window), finish, (docs.select(*rest, "text").schema, schema), window=window, gram=gram, within=True,
        hot_blocks=hot_blocks, name="words", carry=True,
    )
    return result.select(*names)


def dedup_words(docs: DataFrame, *, window: int = WINDOW, hot_blocks: int = HOT_BLOCKS, keep_text: bool = True) -> DataFrame:
    """Remove every word covered by a window of ``window`` words that also starts earlier.
    Returns doc_id, n_words, n_removed, kept_sha256 and, with ``keep_text``, kept (the remaining
    words, joined by one space)."""
    gram = GRAM if window >= 2 * GRAM else 1

    def finish(_, ids: np.ndarray, offsets: np.ndarray, data: bytes, units: Units, gone: np.ndarray) -> pa.RecordBatch:
        removed, kept = remaining(units, gone)
        return record_batch(
            _OUT, pa.array(ids, mask=ids == NO_ID), np.diff(units.docs), removed, [hashlib.sha256(k).hexdigest() for k in kept],
            [k.decode() for k in kept] if keep_text else [None] * len(kept),
        )

    result = repeated_windows(
        docs, word_units, lambda rows: factor(rows, window), finish, (SCHEMA, _OUT), window=window, gram=gram, within=True, hot_blocks=hot_blocks, name="words"
    )
    return result if keep_text else result.drop("kept")
