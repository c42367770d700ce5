"""Operator 10: harmonic packing of tokenized documents into sequences of a fixed capacity.

A document's ids are cut into full sequences and, of the rest, pieces of a half, a quarter and an
eighth of the capacity; what is left is shorter than an eighth.  A piece of length n belongs to
the reciprocal class j = capacity // n, and a bin of class j takes j pieces, whatever they are.
Each task fills the bins of each class by itself and keeps at most j - 1 pieces of a class back;
those are ranked over all tasks by counts for each task and class, and fill bins the same way.
What then remains is under j pieces for each class, whatever the input: they go first-fit into
the last bins.

Defined results: a null or empty text is the end token alone; rows that repeat a doc_id are packed
apart; the string of the special token in a text is that token, as in the library; columns beside
doc_id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, record_batch, slices

CAPACITY = 2048
END = 1


class Tokens:
    """Ids by the tokenizers file; one for each worker process and file.

    Texts of Latin-1 characters go through the same vocabulary and merges in the tiktoken
    library, which gives the same ids in a fifth of the time; any other text through tokenizers.
    """

    made: dict[str, Tokens] = {}

    @classmethod
    def of(cls, path: str) -> Tokens:
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        #: The byte alphabet of such files: printable bytes stand for themselves, others follow.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(letters[c] for c in token): rank for token, rank in data["model"]["vocab"].items() if token not in self.special}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.special)

    def ids(self, text: str) -> np.ndarray:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, allowed_special="all").astype(np.uint32)


def cuts(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document with ``n`` ids."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    for part in (capacity // 2, capacity // 4, capacity // 8):
        if 0 < part <= rest:
            out.append(part)
            rest -= part
    return out + [rest] * (rest > 0)


_PIECE = pa.schema(
    [
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()),
        ("offset", pa.int64()), ("share", pa.int32()), ("task", pa.int64()), ("number", pa.int64()), ("ids", pa.list_(pa.int32())),
    ]
)
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, share int, task long, number long, ids array<int>"


def _first_fit(table: pa.Table, capacity: int) -> pa.Table:
    rows = sorted(table.drop(["sequence_id", "offset", "one"]).to_pylist(), key=lambda r: (-r["length"], r["task"], r["share"], r["number"]))
    filled: list[int] = []
    open_: dict[int, list[int]] = defaultdict(list)  # room -> bins
    for r in rows:
        room = next((x for x in range(r["length"], capacity + 1) if open_[x]), None)
        if room is None:
            filled.append(0)
            b, room = len(filled) - 1, capacity
        else:
            b = open_[room].pop()
        r |= {"sequence_id": (3 << 60) + b, "offset": filled[b]}
        filled[b] += r["length"]
        open_[room - r["length"]].append(b)
    return pa.Table.from_pylist(rows, schema=_PIECE)


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end: int = END, keep_ids: bool = True) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with
    ``keep_ids``, ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, task = Tokens.of(tokenizer), TaskContext.get().partitionId()
        open_: dict[int, list[list]] = defaultdict(list)
        bins = 0

        def columns(rows: list[list]) -> pa.RecordBatch:
            return record_batch(_PIECE, *(map(list, zip(*rows)) if rows else [[]] * len(_PIECE)))

        for batch in batches:
            for part in slices(batch):
                done: list[list] = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = np.append(tokens.ids(text or ""), np.uint32(end))
                    at = 0
                    for n in cuts(len(ids), capacity):
                        own = ids[at : at + n]
                        share = capacity // n
                        open_[share].append([doc, at, n, zlib.crc32(own.astype("<u4").tobytes()), len(ids), None, None, share, task, 0, own.astype(np.int32) if keep_ids else None])
                        at += n
                        if len(open_[share]) == share:
                            offset = 0
                            for row in open_.pop(share):
                                row[5], row[6] = task << 32 | bins, offset
                                offset += row[2]
                                done.append(row)
                            bins += 1
                yield columns(done)
        rest = []
        for rows in open_.values():
            for i, row in enumerate(rows):
                row[9] = i
                rest.append(row)
        yield columns(rest)

    made = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, PIECE), "pieces")
    full, rest = made.where("sequence_id IS NOT NULL"), made.where("sequence_id IS NULL")
    before = Window.partitionBy("share").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = rest.groupBy("share", "task").agg(F.count("*").alias("n"))
    ahead = counts.select("share", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"), F.sum("n").over(Window.partitionBy("share")).alias("all"))
    ranked = rest.join(ahead, ["share", "task"]).withColumn("rank", F.col("ahead") + F.col("number")).withColumn("bin", F.expr("rank div share"))
    in_bin = Window.partitionBy("share", "bin").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    second = ranked.where("(bin + 1) * share <= all").withColumns(
        {"sequence_id": F.lit(1 << 61) + F.shiftleft(F.col("share").cast("long"), 44) + F.col("bin"), "offset": F.coalesce(F.sum("length").over(in_bin), F.lit(0))}
    )
    last = ranked.where("(bin + 1) * share > all").select(*made.columns)
    third = last.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(lambda t: _first_fit(t, capacity), PIECE)
    columns = [c for c in made.columns if c not in ("share", "task", "number") and (keep_ids or c != "ids")]
    return full.select(*columns).unionByName(second.select(*columns)).unionByName(third.select(*columns))
