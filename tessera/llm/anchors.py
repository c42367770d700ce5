"""Where windows of units may repeat: content-chosen anchors and the blocks that share them.

A *unit* is a byte or a word, a *window* a fixed number of consecutive units of one document.
The anchor of a window is the smallest hash among the unit n-grams inside it, so equal windows
have equal anchors wherever they stand; consecutive windows mostly share one anchor and form a
*run*.  Documents travel in blocks of a few megabytes; a block sends each of its anchors once
(copies inside a block are thereby aggregated before the shuffle), and learns which of them other
documents have too.  Only those runs take part in the exact comparison that follows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import materialize, record_batch, shuffle_partitions, slices, text_buffer

BLOCK_SCHEMA = "block_id long, doc_ids binary, offsets binary, payload binary, rest binary"
_BLOCK = pa.schema([("block_id", pa.int64()), ("doc_ids", pa.binary()), ("offsets", pa.binary()), ("payload", pa.binary()), ("rest", pa.binary())])
_KEYS = pa.schema([("bucket", pa.int32()), ("block_id", pa.int64()), ("keys", pa.binary()), ("local", pa.binary())])
_REPLY = pa.schema([("block_id", pa.int64()), ("keys", pa.binary()), ("hot", pa.binary())])
#: A document without an id counts as the last one.
NO_ID = np.iinfo(np.int64).max


class Shifted:
    """The numbers from ``by`` on, to be looked up like an array."""

    def __init__(self, by: int):
        self.by = by

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return at + self.by


@dataclass
class Units:
    """Units of a block: a hash each, byte bounds in ``data``, and each document's first unit."""

    data: bytes
    hashes: np.ndarray
    starts: np.ndarray | Shifted
    ends: np.ndarray | Shifted
    docs: np.ndarray  # len(documents) + 1 offsets into the units


def text_blocks(docs: DataFrame, name: str, carry: bool = False) -> DataFrame:
    """Documents as compressed blocks, written to the shared folder; ``carry``: with their other
    columns."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, made = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch):
                data, offsets = text_buffer(part.column("text"))
                ids = part.column("doc_id").cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)
                rest = squeeze.compress(_to_bytes(part.drop_columns(["text"]))) if carry else None
                yield record_batch(_BLOCK, [made], [ids.astype(np.int64).tobytes()], [offsets.tobytes()], [squeeze.compress(data.tobytes())], [rest])
                made += 1

    return materialize((docs if carry else docs.select("doc_id", "text")).mapInArrow(pack, BLOCK_SCHEMA), name)


def _to_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def carried(row: dict) -> pa.RecordBatch | None:
    """The other columns of a block's documents."""
    if row["rest"] is None:
        return None
    with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(row["rest"])) as stream:
        return stream.read_next_batch()


def open_block(row: dict) -> tuple[np.ndarray, np.ndarray, bytes]:
    data = zstandard.ZstdDecompressor().decompress(row["payload"])
    return np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["offsets"], np.int64), data


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _doubled(x: np.ndarray, width: int, join) -> np.ndarray:
    """``join`` over every ``width`` neighbours; the last width-1 places are dropped."""
    size = 1
    while size * 2 <= width:
        x = join(x[:-size], x[size:]) if size < len(x) else x[:0]
        size *= 2
    if size < width:
        step = width - size
        x = join(x[:-step], x[step:]) if step < len(x) else x[:0]
    return x


@dataclass
class Runs:
    """Runs of windows: first window (unit index), number of windows, anchor, document ordinal,
    and whether the anchor stands at more than one place (if asked for)."""

    first: np.ndarray
    count: np.ndarray
    key: np.ndarray
    doc: np.ndarray
    again: np.ndarray | None = None


#: Windows of a run; a longer one (of periodic text) is cut.
LONGEST_RUN = 64
#: Units whose hashes are made at once: their arrays stay in a core's cache.
CHUNK = 1 << 15


def runs_of(units: Units, window: int, gram: int, again: bool = False) -> Runs:
    empty = np.zeros(0, np.int64)
    n, width = len(units.hashes), window - gram + 1
    if n < window:
        return Runs(empty, empty, np.zeros(0, np.uint64), empty, empty.astype(bool))
    factor = 0x9E3779B97F4A7C15
    anchor = np.empty(n - window + 1, np.uint64)
    grams = np.empty(n - gram + 1, np.uint64) if again else None
    for at in range(0, len(anchor), CHUNK):
        part, size, power = units.hashes[at : at + CHUNK + window - 1].astype(np.uint64), 1, factor
        while size < gram:  # a polynomial hash by doubling; gram is a power of two
            part = part[:-size] * np.uint64(power) + part[size:]
            size, power = size * 2, power * power % (1 << 64)
        part = mixed(part)
        if again:
            grams[at : at + len(part)] = part
        anchor[at : at + CHUNK] = _doubled(part, width, np.minimum)
    change = np.empty(len(anchor), bool)
    change[0] = True
    np.not_equal(anchor[1:], anchor[:-1], out=change[1:])
    starts, last = units.docs[:-1], units.docs[1:] - window + 1  # windows from ``last`` on leave the document
    for edges in (starts, last):
        change[edges[(edges >= 0) & (edges < len(anchor))]] = True
    cut = np.flatnonzero(change)
    doc = np.searchsorted(units.docs, cut, side="right") - 1
    count = np.diff(np.r_[cut, len(anchor)])
    use = cut < last[doc]
    runs = Runs(cut[use], count[use], anchor[cut[use]], doc[use])
    if again:
        inside = np.lib.stride_tricks.sliding_window_view(grams, width)
        left = (inside[runs.first] == runs.key[:, None]).argmax(1)
        right = width - 1 - (inside[runs.first + runs.count - 1][:, ::-1] == runs.key[:, None]).argmax(1)
        runs.again = left != right + runs.count - 1
    if len(runs.count) and runs.count.max() > LONGEST_RUN:
        pieces = -(-runs.count // LONGEST_RUN)
        step = LONGEST_RUN * (np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        cut = np.minimum(np.repeat(runs.count, pieces) - step, LONGEST_RUN)
        again = None if runs.again is None else np.repeat(runs.again, pieces)
        runs = Runs(np.repeat(runs.first, pieces) + step, cut, np.repeat(runs.key, pieces), np.repeat(runs.doc, pieces), again)
    return runs


def folded(key: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the upper, 32 hash bits in the lower half."""
    x = mixed(key ^ np.uint64(0xD1B54A32D192ED03))
    return ((x >> np.uint64(34)) % np.uint64(buckets)) << np.uint64(32) | (x & np.uint64(0xFFFFFFFF))


def shared_anchors(
    blocks: DataFrame, units_of: Callable[[bytes, np.ndarray], Units], window: int, gram: int, buckets: int, within: bool, hot_blocks: int
) -> DataFrame:
    """Per block the anchors that may stand in front of a repeated window.

    ``within``: a repeat inside one document counts too.  Anchors of ``hot_blocks`` or more
    blocks are reported apart.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, offsets, data = open_block(row)
                runs = runs_of(units_of(data, offsets), window, gram, within)
                if not len(runs.key):
                    continue
                key, owner = folded(runs.key, buckets), ids[runs.doc]
                order = np.argsort(key, kind="stable")
                key, owner = key[order], owner[order]
                at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                if within:
                    local = (np.diff(np.r_[at, len(key)]) > 1) | np.logical_or.reduceat(runs.again[order], at)
                else:
                    local = np.minimum.reduceat(owner, at) != np.maximum.reduceat(owner, at)
                key = key[at]
                bucket = (key >> np.uint64(32)).astype(np.int64)
                cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                ends = np.r_[cut[1:], len(key)]
                low = key.astype(np.uint32)
                yield record_batch(
                    _KEYS, bucket[cut].astype(np.int32), np.full(len(cut), row["block_id"]),
                    [low[a:b].tobytes() for a, b in zip(cut, ends)], [np.packbits(local[a:b]).tobytes() for a, b in zip(cut, ends)],
                )

    def meet(group: pa.Table) -> pa.Table:
        block = group.column("block_id").to_numpy()
        keys = [np.frombuffer(x, np.uint32) for x in group.column("keys").to_pylist()]
        local = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8))[: len(k)] for x, k in zip(group.column("local").to_pylist(), keys)])
        sizes = np.array([len(k) for k in keys])
        key, of = np.concatenate(keys), np.repeat(np.arange(len(keys)), sizes)
        order = np.argsort(key, kind="stable")
        at = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        counts = np.diff(np.r_[at, len(key)])
        shared = (counts > 1) | np.logical_or.reduceat(local[order].astype(bool), at)
        flags, hots = np.zeros(len(key), bool), np.zeros(len(key), bool)
        flags[order] = np.repeat(shared, counts)
        hots[order] = np.repeat(counts >= hot_blocks, counts)
        ends = np.cumsum(sizes)
        bucket = np.uint64(group.column("bucket")[0].as_py() << 32)
        rows = ([], [], [])
        for i, (a, b) in enumerate(zip(ends - sizes, ends)):
            if flags[a:b].any():
                full = key[a:b].astype(np.uint64) | bucket
                rows[0].append(int(block[i]))
                rows[1].append(full[flags[a:b]].tobytes())
                rows[2].append(full[flags[a:b] & hots[a:b]].tobytes())
        return pa.Table.from_batches([record_batch(_REPLY, *rows)], schema=_REPLY)

    sent = blocks.mapInArrow(send, "bucket int, block_id long, keys binary, local binary")
    return sent.groupBy("bucket").applyInArrow(meet, "block_id long, keys binary, hot binary")


def _spread(runs: Runs, which: np.ndarray) -> Runs:
    """Every window of the chosen runs as a run of its own."""
    count = runs.count[which]
    step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return Runs(np.repeat(runs.first[which], count) + step, np.ones(len(step), np.int64), np.repeat(runs.key[which], count), np.repeat(runs.doc[which], count))


@dataclass
class Places:
    """Runs of a block whose anchor is shared, and their distinct texts.

    doc, place, at, count, text: of each run, the last a number in ``texts``; first: the first
    run (by document, then place) with each text; order: the texts by bucket; fold: their keys.
    """

    doc: np.ndarray
    place: np.ndarray
    at: np.ndarray
    count: np.ndarray
    text: np.ndarray
    texts: list[bytes]
    first: np.ndarray
    fold: np.ndarray
    order: np.ndarray


def places_of(ids: np.ndarray, units: Units, flagged: np.ndarray, hot: np.ndarray, window: int, gram: int, buckets: int) -> Places:
    """Runs of hot anchors are dealt out window by window, by the hash of the window."""
    runs = runs_of(units, window, gram)
    fold = folded(runs.key, buckets)
    use = np.isin(fold, flagged)
    warm = use & np.isin(fold, hot) if len(hot) else np.zeros(len(use), bool)
    cold = use & ~warm
    spread = _spread(runs, np.flatnonzero(warm))
    at, count = np.r_[runs.first[cold], spread.first], np.r_[runs.count[cold], spread.count]
    ordinal, fold = np.r_[runs.doc[cold], spread.doc], fold[cold]
    lo, hi = units.starts[at].tolist(), units.ends[at + count + window - 2].tolist()
    segs = [units.data[a:b] for a, b in zip(lo, hi)]
    if len(spread.first):
        own = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in segs[len(fold) :]), np.uint64, len(spread.first))
        fold = np.r_[fold, folded(own, buckets)]
    doc, place = ids[ordinal], at - units.docs[ordinal]
    numbers: dict[bytes, int] = {}
    text, first = np.empty(len(at), np.int64), []
    for i in np.lexsort((place, doc)).tolist():
        text[i] = n = numbers.setdefault(segs[i], len(numbers))
        if n == len(first):
            first.append(i)
    firsts = np.array(first, np.int64)
    return Places(doc, place, at, count, text, list(numbers), firsts, fold[firsts], np.argsort(fold[firsts] >> np.uint64(32), kind="stable"))


def _flags(replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = [np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in replies.column(c).to_pylist() if x)])) for c in ("keys", "hot")]
    return keys[0], keys[1]


_TEXTS = pa.schema([("bucket", pa.int32()), ("block_id", pa.int64()), ("n", pa.int32()), ("payload", pa.binary())])
_JUDGED = pa.schema([("block_id", pa.int64()), ("keys", pa.binary()), ("hot", pa.binary()), ("bucket", pa.int32()), ("all", pa.binary()), ("dup", pa.binary())])
JUDGED = "block_id long, keys binary, hot binary, bucket int, all binary, dup binary"


def repeated_windows(
    docs: DataFrame,
    units_of: Callable[[bytes, np.ndarray], Units],
    compare: Callable[[list[tuple]], list],
    finish: Callable[[dict, np.ndarray, np.ndarray, bytes, Units, np.ndarray], pa.RecordBatch],
    schema: tuple[str | StructType, pa.Schema],
    *,
    window: int,
    gram: int,
    within: bool,
    hot_blocks: int,
    name: str,
    carry: bool = False,
    batch_bytes: int = 1 << 20,
) -> DataFrame:
    """Find the units covered by repeated windows, block by block, and ``finish`` the blocks.

    ``compare`` gets (text, windows, doc_id, place) of distinct runs with all their partners, by
    first place, and returns for each of them the windows that stand earlier, as (from, to) pairs.
    ``finish`` gets a block's row, document ids, offsets, bytes, units and the flags of the units to
    remove.
    """
    blocks = text_blocks(docs, f"{name}-blocks", carry)
    # two buckets a block of text, so that what a task holds of a bucket doesn't grow with the input
    buckets = max(shuffle_partitions(docs.sparkSession), 2 * blocks.count())
    shared = materialize(shared_anchors(blocks, units_of, window, gram, buckets, within, hot_blocks), f"{name}-anchors")

    def deal(left: pa.Table, right: pa.Table) -> pa.Table:
        out, squeeze = [], zstandard.ZstdCompressor(level=3)
        flagged, hot = _flags(right)
        for row in left.to_pylist() if len(flagged) else []:
            ids, offsets, data = open_block(row)
            units = units_of(data, offsets)
            found = places_of(ids, units, flagged, hot, window, gram, buckets)
            bucket = (found.fold[found.order] >> np.uint64(32)).astype(np.int32)
            cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
            payloads, sizes = [], []
            for a, b in zip(cut, [*cut[1:], len(bucket)]):
                which = found.order[a:b]
                runs, texts = found.first[which], [found.texts[i] for i in which.tolist()]
                parts = [found.fold[which].astype(np.uint32), np.array([len(t) for t in texts], np.uint32), found.count[runs].astype(np.uint32), found.place[runs].astype(np.uint32) if within else np.zeros(len(runs), np.uint32), found.doc[runs]]
                payloads.append(squeeze.compress(b"".join([*(p.tobytes() for p in parts), *texts])))
                sizes.append(b - a)
            if payloads:
                out.append(record_batch(_TEXTS, bucket[cut], np.full(len(cut), row["block_id"]), np.array(sizes, np.int32), payloads))
        return pa.Table.from_batches(out, schema=_TEXTS)

    def judge(group: pa.Table) -> pa.Table:
        texts: list[bytes] = []
        parts: list[list[np.ndarray]] = []
        sizes = group.column("n").to_pylist()
        for n, payload in zip(sizes, group.column("payload").to_pylist()):
            raw = zstandard.ZstdDecompressor().decompress(payload)
            parts.append([*(np.frombuffer(raw, np.uint32, n, 4 * n * i) for i in range(4)), np.frombuffer(raw, np.int64, n, 16 * n)])
            ends = np.cumsum(parts[-1][1].astype(np.int64)) + 24 * n
            texts += [raw[a:b] for a, b in zip([24 * n, *ends[:-1].tolist()], ends.tolist())]
        key, _, count, place, doc = (np.concatenate(x) for x in zip(*parts))
        numbers: dict[bytes, int] = {}
        number = np.fromiter((numbers.setdefault(t, len(numbers)) for t in texts), np.int64, len(texts))
        order = np.lexsort((place, doc, number))
        firsts = order[np.r_[True, number[order][1:] != number[order][:-1]]]  # of each text, by its number
        whole = (doc > doc[firsts][number]) | ((doc == doc[firsts][number]) & (place > place[firsts][number]))
        # texts by key; those that are alone with their key hold no window of another
        by_key = firsts[np.argsort(key[firsts], kind="stable")]
        begins = np.flatnonzero(np.r_[True, key[by_key][1:] != key[by_key][:-1]])
        partners = np.diff(np.r_[begins, len(by_key)])
        if not within:
            by_key = by_key[np.repeat(partners > 1, partners)]
            begins = np.flatnonzero(np.r_[True, key[by_key][1:] != key[by_key][:-1]]) if len(by_key) else begins[:0]
        length = np.cumsum(np.array([len(texts[i]) for i in by_key.tolist()], np.int64))
        dup: dict[int, np.ndarray] = {}
        start = 0
        while start < len(by_key):
            most = (length[start - 1] if start else 0) + batch_bytes
            stop = int(np.searchsorted(begins, np.searchsorted(length, most) + 1))
            stop = int(begins[stop]) if stop < len(begins) else len(by_key)
            which = by_key[start:stop]
            which = which[np.lexsort((place[which], doc[which]))]
            columns = (count[which].tolist(), doc[which].tolist(), place[which].tolist())
            for i, found in zip(which.tolist(), compare(list(zip([texts[i] for i in which.tolist()], *columns)))):
                if len(found):
                    dup[int(number[i])] = np.asarray(found, np.int32)
            start = stop
        offsets = np.r_[0, np.cumsum(sizes)]
        has = np.zeros(len(numbers), bool)
        has[list(dup)] = True
        spans: list[list[int]] = [[] for _ in sizes]
        for i in np.flatnonzero(has[number] & ~whole).tolist():
            sender = int(np.searchsorted(offsets, i, side="right")) - 1
            found = dup[int(number[i])]
            spans[sender] += [i - int(offsets[sender]), len(found) // 2, *found.tolist()]
        whole = [whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        keep = [i for i in range(len(whole)) if whole[i].any() or spans[i]]
        none = [None] * len(keep)
        blocks_, buckets_ = group.column("block_id").to_pylist(), group.column("bucket").to_pylist()
        batch = record_batch(
            _JUDGED, [blocks_[i] for i in keep], none, none, [buckets_[i] for i in keep], [np.packbits(whole[i]).tobytes() for i in keep],
            [np.array(spans[i], np.int32).tobytes() for i in keep],
        )
        return pa.Table.from_batches([batch], schema=_JUDGED)

    def close(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        flagged, hot = _flags(right)
        for row in left.to_pylist():
            ids, offsets, data = open_block(row)
            units = units_of(data, offsets)
            edge = np.zeros(len(units.hashes) + 1, np.int64)
            judged = right.filter(right.column("bucket").is_valid()).to_pylist()
            if len(flagged):
                found = places_of(ids, units, flagged, hot, window, gram, buckets)
                bucket = (found.fold[found.order] >> np.uint64(32)).astype(np.int64)
                whole, dup = np.zeros(len(found.texts), bool), {}
                for x in judged:
                    a, b = np.searchsorted(bucket, [x["bucket"], x["bucket"] + 1])
                    which = found.order[a:b]
                    whole[which] = np.unpackbits(np.frombuffer(x["all"], np.uint8))[: b - a].astype(bool)
                    spans, at = np.frombuffer(x["dup"], np.int32), 0
                    while at < len(spans):
                        dup[int(which[spans[at]])] = spans[at + 2 : at + 2 + 2 * spans[at + 1]].reshape(-1, 2)
                        at += 2 + 2 * int(spans[at + 1])
                first = found.first[found.text]
                later = found.doc > found.doc[first]
                if within:
                    later |= (found.doc == found.doc[first]) & (found.place > found.place[first])
                gone = later | whole[found.text]
                lo, hi = [found.at[gone]], [found.at[gone] + found.count[gone]]
                partly = np.zeros(len(found.texts), bool)
                partly[list(dup)] = True
                for i in np.flatnonzero(partly[found.text] & ~gone).tolist():
                    pairs = dup[int(found.text[i])] + found.at[i]
                    lo.append(pairs[:, 0])
                    hi.append(pairs[:, 1])
                np.add.at(edge, np.concatenate(lo), 1)
                np.add.at(edge, np.concatenate(hi) + window - 1, -1)
            out.append(finish(row, ids, offsets, data, units, np.cumsum(edge)[:-1] > 0))
        return pa.Table.from_batches(out, schema=schema[1])

    texts = blocks.groupBy("block_id").cogroup(shared.groupBy("block_id")).applyInArrow(deal, "bucket int, block_id long, n int, payload binary")
    judged = texts.groupBy("bucket").applyInArrow(judge, JUDGED)
    known = shared.withColumns({"bucket": F.lit(None).cast("int"), "all": F.lit(None).cast("binary"), "dup": F.lit(None).cast("binary")})
    return blocks.groupBy("block_id").cogroup(known.unionByName(judged).groupBy("block_id")).applyInArrow(close, schema[0])
