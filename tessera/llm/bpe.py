"""Operator 3: byte-level BPE encoding and decoding by recursive queries.

Each task splits its texts by the public pattern and keeps the ids of the words it has met
(bounded).  New words go to an embedded DuckDB: token-position rows join the merge table, every
round contracts each word's leftmost pair of least rank, until no pair of it merges; ordered
aggregation gives the ids and, from the token table, the decoded bytes.

Defined results: a null or empty text has no ids; digests are those of nothing.  Rows that repeat,
also a doc_id, keep a row each; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import record_batch, slices

#: Fixed value: the pattern of the public vocabulary that splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose ids a worker keeps, in each of two generations.
KEEP_WORDS = 400_000
WORDS_A_QUERY = 20_000
#: Bytes from which on a word (runs of one character, and the like) is merged by a heap: a round of
#: the query contracts one pair, and so many rounds over so many rows are too slow.
LONG_WORD = 256

MERGE = """
WITH RECURSIVE steps(word, pos, tok, live) AS (
    SELECT word, pos, tok, true FROM start
    UNION ALL (
        WITH pairs AS (
            SELECT word, pos, tok, lead(tok) OVER w AS following, lead(word) OVER w AS owner, lead(pos) OVER w AS next
            FROM steps WHERE live WINDOW w AS (ORDER BY pos)
        ), best AS (
            SELECT word, min(m.merged::BIGINT << 32 | p.pos) AS key, arg_min(p.next, m.merged::BIGINT << 32 | p.pos) AS gone
            FROM pairs p JOIN merges m ON m.a = p.tok AND m.b = p.following WHERE p.owner = p.word GROUP BY word
        )
        SELECT word, pos, CASE WHEN pos = key & 4294967295 THEN (key >> 32)::INTEGER ELSE tok END, key IS NOT NULL
        FROM pairs LEFT JOIN best USING (word) WHERE gone IS NULL OR pos <> gone
    )
)
SELECT word, string_agg(tok, ',') AS ids, string_agg(hex, '') AS decoded
FROM (SELECT * FROM steps JOIN tokens USING (tok) WHERE NOT live ORDER BY pos) GROUP BY word ORDER BY word
"""


class Encoder:
    """Ids of words by the merge table; one for each worker process and vocabulary."""

    made: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    def __init__(self, path: str):
        import duckdb
        import regex

        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.split = regex.compile(PATTERN).findall
        rows = [
            (self.ranks[t[:i]], self.ranks[t[i:]], rank) for t, rank in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks
        ]
        #: Bytes that stand side by side in some token: no merge crosses other pairs.
        self.beside = np.zeros((256, 256), bool)
        for t in self.ranks:
            self.beside[list(t[:-1]), list(t[1:])] = True
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.connection = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        self.connection.register("given", pa.table(dict(zip("a b merged".split(), (pa.array(c, pa.int32()) for c in zip(*rows))))))
        self.connection.execute("CREATE TABLE merges AS FROM given")
        self.connection.register("given", pa.table({"tok": pa.array(self.ranks.values(), pa.int32()), "hex": [t.hex() for t in self.ranks]}))
        self.connection.execute("CREATE TABLE tokens AS FROM given")
        self.connection.unregister("given")
        #: word -> (ids joined by commas, decoded bytes)
        self.young: dict[str, tuple[str, bytes]] = {}
        self.old: dict[str, tuple[str, bytes]] = {}

    def long_merged(self, word: bytes) -> tuple[str, bytes]:
        """The same contraction, leftmost pair of least rank first, with a heap of pairs."""
        parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))

        def rank(i: int) -> int | None:
            return self.ranks.get(parts[i] + parts[after[i]]) if after[i] < len(parts) else None

        heap = [(r, i, len(parts[i]) + len(parts[i + 1])) for i in range(len(parts) - 1) if (r := rank(i)) is not None]
        heapify(heap)
        while heap:
            r, i, size = heappop(heap)
            if parts[i] is None or rank(i) != r or len(parts[i]) + len(parts[after[i]]) != size:
                continue
            gone = after[i]
            parts[i] += parts[gone]
            parts[gone] = None
            after[i] = after[gone]
            if after[i] < len(parts):
                before[after[i]] = i
            for j in (before[i], i):
                if j >= 0 and (new := rank(j)) is not None:
                    heappush(heap, (new, j, len(parts[j]) + len(parts[after[j]])))
        kept = [p for p in parts if p is not None]
        return ",".join(str(self.ranks[p]) for p in kept), b"".join(kept)

    def merged(self, words: list[bytes]) -> list[tuple[str, bytes]]:
        """Ids and decoded bytes of words."""
        out: list[tuple[str, bytes]] = []
        for at in range(0, len(words), WORDS_A_QUERY):
            part = words[at : at + WORDS_A_QUERY]
            raw = np.frombuffer(b"".join(part), np.uint8)
            lengths = np.array([len(w) for w in part])
            ends = np.cumsum(lengths)
            begin = np.zeros(len(raw), bool)
            begin[1:] = ~self.beside[raw[:-1], raw[1:]]
            begin[ends - lengths] = True
            stretch = np.cumsum(begin) - 1
            start = {"word": pa.array(stretch.astype(np.int32)), "pos": pa.array(np.arange(len(raw), dtype=np.int32)), "tok": pa.array(self.bytes[raw])}
            self.connection.register("start", pa.table(start))
            found = self.connection.sql(MERGE).to_arrow_table()
            self.connection.unregister("start")
            ids, decoded = found.column("ids").to_pylist(), found.column("decoded").to_pylist()
            firsts = stretch[ends - lengths].tolist()
            for a, b in zip(firsts, [*firsts[1:], int(stretch[-1]) + 1]):
                out.append((",".join(ids[a:b]), bytes.fromhex("".join(decoded[a:b]))))
            if [decoded for _, decoded in out[at:]] != part:  # aggregated in another order than sorted
                raise RuntimeError("tokens do not give their words")
        return out

    def learn(self, words: set[str]) -> None:
        """Have all of ``words`` among the young."""
        if len(self.young) > KEEP_WORDS:
            self.old, self.young = self.young, {}
        rest = []
        for w in words:
            if w in self.young:
                continue
            if (known := self.old.get(w)) is not None:
                self.young[w] = known
            elif (rank := self.ranks.get(raw := w.encode())) is not None:  # a token by itself
                self.young[w] = (str(rank), raw)
            elif len(raw) >= LONG_WORD:
                self.young[w] = self.long_merged(raw)
            else:
                rest.append(w)
        if rest:
            self.young.update(zip(rest, self.merged([w.encode() for w in rest])))


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
_IDS = pa.schema([*_DIGEST, ("ids", pa.list_(pa.int32()))])


def encode(docs: DataFrame, vocabulary: str, *, keep_ids: bool = True) -> DataFrame:
    """Encode each text by the rank file ``vocabulary`` and decode the ids.  Returns doc_id,
    n_tokens, ids_sha256, decoded_sha256 and, with ``keep_ids``, ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(vocabulary)
        for batch in batches:
            for part in slices(batch, max_bytes=2 << 20):
                texts = [encoder.split(t or "") for t in part.column("text").to_pylist()]
                encoder.learn(set(chain.from_iterable(texts)))
                rows: tuple = ([], [], [], [])
                for words in texts:
                    found = list(map(encoder.young.__getitem__, words))
                    ids = ",".join([f[0] for f in found])
                    rows[0].append(ids.count(",") + 1 if ids else 0)
                    rows[1].append(hashlib.sha256(ids.encode()).hexdigest())
                    rows[2].append(hashlib.sha256(b"".join([f[1] for f in found])).hexdigest())
                    rows[3].append(list(map(int, ids.split(","))) if keep_ids and ids else [])
                yield record_batch(_IDS if keep_ids else _DIGEST, part.column("doc_id"), *rows[: 4 if keep_ids else 3])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select(docs.doc_id.cast("long").alias("doc_id"), "text").mapInArrow(work, schema)
