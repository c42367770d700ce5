"""Operator 1: exact substring de-duplication of bytes over a difference-cover suffix array.

Runs of windows that other documents may share (``anchors``) meet by content; every task sorts
the suffixes of its runs by the difference-cover construction: triples at two of three positions
are sorted and named, the names are sorted by recursion, the remaining suffixes are merged in,
and neighbours in the array with equal 50-byte prefixes are one string.

Defined results: a null text is empty; an empty text, or one under the window, loses nothing and
keeps the digest of its bytes; rows that repeat a doc_id are judged apart and never repeat each
other; a null doc_id counts as the largest.  Columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .anchors import NO_ID, Shifted, Units, repeated_windows
from .common import record_batch

WINDOW = 50
GRAM = 16
HOT_BLOCKS = 1024


def byte_units(data: bytes, offsets: np.ndarray) -> Units:
    return Units(data, np.frombuffer(data, np.uint8), Shifted(0), Shifted(1), offsets)


def suffix_array(text: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Suffix array of an array of positive integers, numbers and length under 2**31.

    ``depth``: order by so many leading symbols is enough; deeper ties are left as they come.
    """
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: tuple(text[i:].tolist())), np.int64)
    s = np.concatenate([text.astype(np.int64), np.zeros(4, np.int64)])
    k = int(s.max()) + 1
    pair = s * k + np.r_[s[1:], 0]
    if k * k * max(k, n + 3) >= 1 << 62:  # names in place of pairs, to stay within 64 bits
        pair = np.unique(pair, return_inverse=True)[1]
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    triples = pair[sample] * k + s[sample + 2]
    order = np.argsort(triples, kind="stable")
    ranked = triples[order]
    names = np.empty(len(sample), np.int64)
    names[order] = np.cumsum(np.r_[True, ranked[1:] != ranked[:-1]])
    if int(names.max()) < len(sample) and (depth is None or depth > 3):
        order = suffix_array(names, None if depth is None else -(-depth // 3))
    rank = np.zeros(n + 4, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    ordered = sample[order]
    ordered = ordered[ordered < n]
    r = len(sample) + 2
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(s[rest] * r + rank[rest + 1], kind="stable")]
    first, second = ordered[ordered % 3 == 1], ordered[ordered % 3 == 2]
    before = np.searchsorted(s[first] * r + rank[first + 1], s[rest] * r + rank[rest + 1])
    before += np.searchsorted(pair[second] * r + rank[second + 2], pair[rest] * r + rank[rest + 2])
    out = np.empty(n, np.int64)
    slot = np.maximum.accumulate(before) + np.arange(len(rest))  # ties beyond the depth may cross
    free = np.ones(n, bool)
    free[slot] = False
    out[slot] = rest
    out[free] = ordered
    return out


def _prefix_words(text: np.ndarray, at: np.ndarray, window: int) -> list[np.ndarray]:
    padded = np.concatenate([text.astype(np.uint8), np.zeros(16, np.uint8)])
    eights = np.lib.stride_tricks.sliding_window_view(padded, 8)
    places = [*range(0, window - 8, 8), window - 8] if window >= 8 else None
    if places is None:
        return [padded[at + i] for i in range(window)]
    return [np.ascontiguousarray(eights[at + p]).view(np.uint64).ravel() for p in places]


def earlier_windows(rows: list[tuple], window: int = WINDOW) -> list[np.ndarray]:
    """For each run the windows whose string also starts in a document with a smaller id."""
    segs = [r[0] for r in rows]
    lengths = np.array([len(x) for x in segs])
    text = np.frombuffer(b"".join(segs), np.uint8)
    starts = np.cumsum(lengths) - lengths
    usable = lengths - window + 1
    run = np.repeat(np.arange(len(rows)), usable)
    at = np.arange(int(usable.sum())) - np.repeat(np.cumsum(usable) - usable, usable) + np.repeat(starts, usable)
    doc = np.array([r[2] for r in rows], np.int64)[run]
    place = np.full(len(text), -1, np.int64)
    place[at] = np.arange(len(at))
    order = place[suffix_array(text.astype(np.int64) + 1, window)]
    order = order[order >= 0]
    equal = np.ones(max(len(order) - 1, 0), bool)
    for part in _prefix_words(text, at[order], window):
        equal &= part[1:] == part[:-1]
    begins = np.flatnonzero(np.r_[True, ~equal])
    owner = np.minimum.reduceat(doc[order], begins)
    dup = np.zeros(len(order), bool)
    dup[order] = np.repeat(owner, np.diff(np.r_[begins, len(order)])) < doc[order]
    out = [np.zeros(0, np.int32)] * len(rows)
    edge_run = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    for i in np.unique(run[dup]).tolist():
        a = edge_run[i]
        flags = dup[a : a + usable[i]].astype(np.int8)
        out[i] = np.flatnonzero(np.diff(np.r_[0, flags, 0])).astype(np.int32)
    return out


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]
)


def dedup_bytes(docs: DataFrame, *, window: int = WINDOW, hot_blocks: int = HOT_BLOCKS, keep_text: bool = True) -> DataFrame:
    """Remove every byte covered by a ``window``-byte string that starts in a document with a
    smaller doc_id too.  Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with
    ``keep_text``, kept (the remaining bytes)."""
    gram = GRAM if window >= 2 * GRAM else 4

    def finish(_, ids: np.ndarray, offsets: np.ndarray, data: bytes, units: Units, gone: np.ndarray) -> pa.RecordBatch:
        raw = np.frombuffer(data, np.uint8)
        kept = [raw[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        lengths = np.diff(offsets)
        head = gone & np.r_[True, ~gone[:-1]] if len(gone) else gone
        begins = offsets[:-1][lengths > 0]
        head[begins] = gone[begins]
        spans = np.r_[0, np.cumsum(head)]
        return record_batch(
            _OUT, pa.array(ids, mask=ids == NO_ID), lengths, lengths - np.array([len(k) for k in kept], np.int64), spans[offsets[1:]] - spans[offsets[:-1]],
            [hashlib.sha256(k).hexdigest() for k in kept], kept if keep_text else [None] * len(kept),
        )

    result = repeated_windows(
        docs, byte_units, lambda rows: earlier_windows(rows, window), finish, (SCHEMA, _OUT), window=window, gram=gram, within=False, hot_blocks=hot_blocks, name="bytes"
    )
    return result if keep_text else result.drop("kept")
