"""Operator 5: SimHash near-duplicates, candidates pruned by the pigeonring principle.

A 64-bit fingerprint is a ring of 16 segments of 4 bits.  If two fingerprints differ in at most 4
bits, the ring has a segment from which every chain of l consecutive segments differs in at most
l * 4 / 16 bits: none in the first three, at most one in the first seven, and so on.  So some
start and some one segment of the fourth to seventh leave 24 equal bits: that is the key by which
fingerprints meet.  Pairs that meet have to pass the budgets of all longer chains before their
distance is counted.

Copies are joined first: only distinct fingerprints meet.  In a group of fingerprints under one key,
one after another becomes a pivot that takes the fingerprints within reach of it; then groups of
pivots that are near enough to hold a link are compared.  So from a group that is all linked only a
star of links leaves the task, and near copies aren't squared.  A group beyond a bound is dealt out
in pairs of blocks, with the same links in the end.

Defined results: a null or blank text has fingerprint zero and links like any other; rows that
repeat a doc_id keep a row each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import materialize, record_batch, shuffle_partitions, slices
from .components import components

SHINGLE = 4
SEED = 42
DISTANCE = 4
SEGMENTS, WIDTH, CHAIN = 16, 4, 7
#: Fingerprints compared at once.
BLOCK = 1024
#: Groups of so many members are compared in one operation over all groups, larger ones by pivots.
FEW = 6
#: Members of a group, or of a block of a larger group, that a task compares.
MOST = 20_000


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Fingerprint of one text, as an unsigned number."""
    return majority(_hashes((text or "").encode(), shingle, seed))


def majority(hashes: Sequence[int] | np.ndarray) -> int:
    """The bits that over half of the hashes have set; zero for none."""
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        bits += np.unpackbits(np.array(part, ">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > len(hashes)).tobytes(), "big") if len(hashes) else 0


def _hashes(raw: bytes, shingle: int, seed: int) -> list[int]:
    words = raw.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(joined, seed)]
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = [0, *(spaces[: len(words) - shingle] + 1).tolist()], [*spaces[shingle - 1 :].tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(starts, ends)]


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, carry: bool = False) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long); with ``carry`` also row, all columns."""
    whole = [F.struct(*docs.columns).alias("row")] if carry else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *whole)
    schema = StructType(StructType.fromDDL("doc_id long, fp long").fields + ([rows.schema["row"]] if carry else []))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = np.array([fingerprint(t, shingle, seed) for t in part.column("text").to_pylist()], np.uint64)
                columns = [part.column("doc_id"), pa.array(found.astype(np.int64)), *([part.column("row")] if carry else [])]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(work, schema)


def _turned(x: np.ndarray, start: int) -> np.ndarray:
    """The ring read from segment ``start`` on."""
    n = WIDTH * start
    return x if n == 0 else (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def ring_keys(fps: np.ndarray) -> np.ndarray:
    """Keys of each fingerprint: a row for each start and each segment left out."""
    out = []
    for start in range(SEGMENTS):
        chain = _turned(fps, start) >> np.uint64(64 - WIDTH * CHAIN)
        for out_at in range(3, CHAIN):
            keep = ((1 << WIDTH * CHAIN) - 1) & ~(15 << WIDTH * (CHAIN - 1 - out_at))
            out.append((chain & np.uint64(keep)) | np.uint64((start * 4 + out_at - 3) << 28))
    return np.array(out)


def viable(x: np.ndarray, start: np.ndarray | int, distance: int = DISTANCE) -> np.ndarray:
    """Whether every chain of the differences ``x`` from ``start`` on keeps its budget, a share of
    ``distance`` in proportion to its length; the whole ring is the Hamming check.

    Counts grow along a chain, so of all lengths with one budget the longest is looked at."""
    n = np.asarray(start, np.uint64) * np.uint64(WIDTH)
    ring = (x << n) | np.where(n == 0, np.uint64(0), x >> ((np.uint64(64) - n) & np.uint64(63)))
    budgets = [l * distance // SEGMENTS for l in range(1, SEGMENTS + 1)]
    good = np.ones(x.shape, bool)
    for l, budget in enumerate(budgets, 1):
        if l == SEGMENTS or budgets[l] > budget:
            good &= np.bitwise_count(ring >> np.uint64(64 - WIDTH * l)) <= budget
    return good


def group_links(fps: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between distinct fingerprints of one key, one fewer than members for each group of them
    that chains from ``start`` connect."""
    rest = np.arange(len(fps))
    pivots, members = [], []
    while len(rest):
        near = viable(fps[rest] ^ fps[rest[0]], start)
        pivots.append(rest[0])
        members.append(rest[near])
        rest = rest[~near]
    a = [np.repeat(p, len(m) - 1) for p, m in zip(pivots, members)]
    b = [m[1:] for m in members]
    root = list(range(len(pivots)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    centre = fps[pivots]
    for at in range(0, len(centre), BLOCK):
        for to in range(at, len(centre), BLOCK):  # members within reach of each other have pivots within three times that
            near = np.bitwise_count(centre[at : at + BLOCK, None] ^ centre[None, to : to + BLOCK]) <= 3 * DISTANCE
            for i, j in zip(*np.nonzero(near)):
                i, j = int(i) + at, int(j) + to
                if i < j and top(i) != top(j) and (found := _first_link(fps[members[i]], fps[members[j]], start)):
                    a.append(members[i][[found[0]]])
                    b.append(members[j][[found[1]]])
                    root[max(top(i), top(j))] = min(top(i), top(j))
    a, b = (np.concatenate(x) if x else np.zeros(0, int) for x in (a, b))
    return fps[a], fps[b]


def _first_link(left: np.ndarray, right: np.ndarray, start: int) -> tuple[int, int] | None:
    for at in range(0, len(left), BLOCK):
        for to in range(0, len(right), BLOCK):
            near = viable(left[at : at + BLOCK, None] ^ right[None, to : to + BLOCK], start)
            if near.any():
                i, j = np.unravel_index(int(near.argmax()), near.shape)
                return at + int(i), to + int(j)
    return None


def links(distinct: DataFrame, most: int = MOST) -> DataFrame:
    """``distinct`` (fp): links a, b that connect all fingerprints within the distance."""

    keyed_schema = pa.schema([("key", pa.int64()), ("fp", pa.int64())])
    met_schema = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
    link_schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            for at in range(0, len(fps), 2048):
                part = fps[at : at + 2048]
                keys = ring_keys(part.astype(np.uint64))
                yield record_batch(keyed_schema, keys.ravel().astype(np.int64), np.tile(part, len(keys)))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links (key null), and the members (b null) of groups over ``most``, to be dealt out."""

        def found(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[begins, len(key)])
            group = np.repeat(size, size)
            a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            small = np.flatnonzero((group > 1) & (group <= FEW))
            k, f = key[small], fp[small]
            for step in range(1, FEW):
                at = np.flatnonzero(k[step:] == k[:-step]) if step < len(k) else []
                if not len(at):
                    break
                at = at[viable(f[at] ^ f[at + step], k[at] >> 30)]
                a.append(f[at])
                b.append(f[at + step])
            for i in np.flatnonzero(size > FEW).tolist():
                x, y = group_links(fp[begins[i] : begins[i] + size[i]], int(key[begins[i]]) >> 30)
                a.append(x)
                b.append(y)
            a, b = (np.concatenate(x).astype(np.int64) for x in (a, b))
            return record_batch(met_schema, pa.nulls(len(a), pa.int64()), a, b)

        def put_off(key: int, fps: np.ndarray) -> pa.RecordBatch:
            return record_batch(met_schema, np.full(len(fps), key), fps.astype(np.int64), pa.nulls(len(fps), pa.int64()))

        key, fp, large = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
        for batch in batches:
            new, fps = batch.column("key").to_numpy(), batch.column("fp").to_numpy().astype(np.uint64)
            if large is not None:  # the rest of a group that was put off
                more = int(np.searchsorted(new, large, side="right"))
                if more:
                    yield put_off(large, fps[:more])
                    new, fps = new[more:], fps[more:]
            if not len(new):
                continue
            key, fp = np.r_[key, new], np.r_[fp, fps]
            ready = int(np.searchsorted(key, key[-1]))
            if ready:
                yield found(key[:ready], fp[:ready])
                key, fp = key[ready:], fp[ready:]
            if len(key) > most:
                large = int(key[0])
                yield put_off(large, fp)
                key, fp = key[:0], fp[:0]
        if len(key):
            yield found(key, fp)

    def cell(group: pa.Table) -> pa.Table:
        fps = np.unique(group.column("a").to_numpy().astype(np.uint64))
        a, b = group_links(fps, group.column("key")[0].as_py() >> 30)
        return pa.Table.from_batches([record_batch(link_schema, a.astype(np.int64), b.astype(np.int64))])

    keyed = distinct.select("fp").mapInArrow(spread, "key long, fp long")
    dealt = keyed.repartition(shuffle_partitions(distinct.sparkSession), "key").sortWithinPartitions("key")
    met = materialize(dealt.mapInArrow(meet, "key long, a long, b long"), "met")
    direct, late = met.where("key IS NULL").select("a", "b"), met.where("key IS NOT NULL").select("key", "a")
    if not late.take(1):
        return direct
    blocks = late.groupBy("key").agg(F.ceil(F.count("*") / most).alias("n"))
    own = late.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("a"), F.col("n"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    cells = own.select("key", "a", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return direct.unionByName(cells.groupBy("key", "i", "j").applyInArrow(cell, "a long, b long"))


#: Parts that a large component's rows are dealt to when its label is joined.
SALT = 16


def labelled(own: DataFrame) -> DataFrame:
    """``own`` (doc_id, fp): fp, component_id of each fingerprint."""
    nodes = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes))
    linked = nodes.join(roots, nodes.fp == roots.node).select("fp", "least", "root", F.pmod(F.xxhash64("fp"), F.lit(SALT)).alias("salt"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    known = linked.join(salted, ["root", "salt"]).select("fp", "component_id")
    return nodes.join(known, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links)."""
    own = materialize(fingerprints(docs, shingle, seed), "fingerprints")
    return own.join(labelled(own), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
