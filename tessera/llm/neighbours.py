"""Operator 4: nearest neighbours by multi-index hashing of learned binary codes.

Codes are the signs of a vector after centring and a rotation learned by iterative quantization
on a bounded sample.  A code splits into parts; if two codes differ in at most R bits, some part
of m differs in at most R // m (pigeonhole).  Every vector is indexed under each part's value, and
a query probes in each part all values within R // m; what it meets within R bits is ranked by the
exact distance.  R is the radius that covers the sample's own true neighbours.  Index values with
the same leading bits share a shard, where buckets are slices of one sorted array.  A shard is
dealt out in blocks of bounded numbers of index rows and of queries, and each pair of blocks is a
task, which returns a query's nearest k.  Queries with fewer than k found probe again at full
radius.

Of equal vectors only the k + 1 of least id are indexed (no query needs more), and queries with
equal vectors are asked once.

Defined results: vectors that are null, zero, of a length other than the table's most frequent, or
hold a null or non-finite component take no part.  Distances are Euclidean in double precision, and
ties go to the smaller id.  Of rows that repeat a vec_id the one of least vector, in the order of
arrays, takes part; a null vec_id takes none.  Other columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, record_batch

NEAREST = 10
#: Bits of a part, and of the code at most.
PART, LONGEST = 8, 64
#: Leading bits of a part's value that choose the task.
SHARD_BITS = 3
#: Index rows and queries of a task's blocks, about.
INDEX_BLOCK, QUERY_BLOCK = 100_000, 20_000
#: Vectors that fit rotation and radius: those of least hash; of them, queries that fit the radius.
SAMPLE, ASKED = 8_000, 200
COVER = 0.98
ROUNDS = 30


class Codes:
    """Centre, rotation and radius."""

    def __init__(self, sample: np.ndarray, nearest: int = NEAREST, seed: int = 3):
        draw = np.random.default_rng(seed)
        self.mean = sample.mean(0)
        x = sample - self.mean
        bits = min(LONGEST, x.shape[1])
        _, _, axes = np.linalg.svd(x, full_matrices=False)
        axes = np.vstack([axes, np.zeros((max(0, bits - len(axes)), x.shape[1]))])[:bits]
        v = x @ axes.T
        turn = np.linalg.qr(draw.normal(size=(bits, bits)))[0]
        for _ in range(ROUNDS):
            a, _, b = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
            turn = (a @ b).T
        self.rotation = axes.T @ turn
        self.parts = -(-bits // PART)
        codes = self.of(sample)
        asked = np.sort(draw.permutation(len(sample))[:ASKED])
        true = []
        for i in asked.tolist():
            d = ((sample - sample[i]) ** 2).sum(1)
            d[i] = np.inf
            near = np.argsort(d, kind="stable")[: min(nearest, len(sample) - 1)]
            true.append(np.bitwise_count(codes[near] ^ codes[i]))
        true = np.concatenate(true) if true else np.zeros(0)
        self.radius = int(np.quantile(true, COVER, method="higher")) if len(true) else LONGEST

    def of(self, x: np.ndarray) -> np.ndarray:
        """Codes as unsigned 64-bit numbers; the first part is the lowest byte."""
        bits = np.packbits((x - self.mean) @ self.rotation >= 0, axis=1, bitorder="little")
        return np.ascontiguousarray(np.pad(bits, ((0, 0), (0, 8 - bits.shape[1])))).view(np.uint64).ravel()


def vectors_of(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(table: DataFrame, id_column: str, vector_column: str) -> tuple[DataFrame, int]:
    good = table.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull()
        & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("v", lambda x: x != 0)
    )
    size = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    whole = good.where(F.size("v") == (size.n if size else 0))
    return whole.groupBy("vec_id").agg(F.min("v").alias("v")), (size.n if size else 0)


_SHARD = "shard int, vec_id long, code long, v array<double>"
_FOUND = pa.schema([("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
FOUND = "query long, vec_id long, score double"


def _spread(rows: DataFrame, codes: Codes, radius: int | None) -> DataFrame:
    """Rows for each shard: of an index row (``radius`` None) one in each part, of a query one for
    each shard with a value within the radius."""
    schema = pa.schema([("shard", pa.int32()), ("vec_id", pa.int64()), ("code", pa.int64()), ("v", pa.list_(pa.float64()))])
    values = np.arange(1 << PART)
    shards = 1 << SHARD_BITS
    of_value = values >> (PART - SHARD_BITS)

    def work(batches):
        if radius is not None:  # value x shard: whether a probe of the value touches the shard
            near = np.bitwise_count(values[:, None] ^ values[None, :]) <= radius
            touches = np.stack([near[:, of_value == s].any(1) for s in range(shards)], 1)
        for batch in batches:
            if not batch.num_rows:
                continue
            code = codes.of(vectors_of(batch.column("v")))
            for part in range(codes.parts):
                value = ((code >> np.uint64(PART * part)) & np.uint64(255)).astype(np.int64)
                if radius is None:
                    at, shard = np.arange(len(code)), of_value[value]
                else:
                    at, shard = np.nonzero(touches[value])
                take = pa.array(at)
                yield record_batch(
                    schema, (part * shards + shard).astype(np.int32), batch.column("vec_id").take(take), code[at].astype(np.int64), batch.column("v").take(take).cast(pa.list_(pa.float64()))
                )

    return rows.select("vec_id", "v").mapInArrow(work, _SHARD)


def _search(index: DataFrame, queries: DataFrame, codes: Codes, radius: int, nearest: int, index_block: int = INDEX_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query, vec_id, score: the nearest of each query's bucket members within the radius."""
    reach = min(radius // codes.parts, PART)

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _FOUND.empty_table()
        shift = np.uint64(PART * (left.column("shard")[0].as_py() >> SHARD_BITS))
        code = left.column("code").to_numpy().astype(np.uint64)
        value = ((code >> shift) & np.uint64(255)).astype(np.int64)
        order = np.argsort(value, kind="stable")
        code, ids, v = code[order], left.column("vec_id").to_numpy()[order], vectors_of(left.column("v"))[order]
        edges = np.searchsorted(value[order], np.arange((1 << PART) + 1))
        held = np.flatnonzero(np.diff(edges))
        asked = right.column("code").to_numpy().astype(np.uint64)
        asked_v, asked_id = vectors_of(right.column("v")), right.column("vec_id").to_numpy()
        out = ([], [], [])
        for i in range(len(asked)):
            own = int((asked[i] >> shift) & np.uint64(255))
            buckets = held[np.bitwise_count(held ^ own) <= reach]
            if not len(buckets):
                continue
            at = np.concatenate([np.arange(edges[b], edges[b + 1]) for b in buckets.tolist()])
            at = at[np.bitwise_count(code[at] ^ asked[i]) <= radius]
            if not len(at):
                continue
            d = np.sqrt(((v[at] - asked_v[i]) ** 2).sum(1))
            if len(d) > nearest:
                few = d <= np.partition(d, nearest - 1)[nearest - 1]
                at, d = at[few], d[few]
            best = np.lexsort((ids[at], d))[:nearest]
            out[0].append(np.full(len(best), asked_id[i]))
            out[1].append(ids[at][best])
            out[2].append(d[best])
        return pa.Table.from_batches([record_batch(_FOUND, *(np.concatenate(x) if x else [] for x in out))], schema=_FOUND)

    # an index row stands in one shard of 2 ** SHARD_BITS in each part, a query in up to all of them
    held, asking = -(-(index.count() >> SHARD_BITS) // index_block) or 1, -(-queries.count() // query_block) or 1
    own, every = (lambda n: F.pmod(F.xxhash64("vec_id", "code"), F.lit(n)).cast("int")), (lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    left = _spread(index, codes, None).withColumn("held", own(held)).withColumn("asking", every(asking))
    right = _spread(queries, codes, reach).withColumn("held", every(held)).withColumn("asking", own(asking))
    cell = ["shard", "held", "asking"]
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(probe, FOUND)
    best = Window.partitionBy("query").orderBy("score", "vec_id")
    return found.groupBy("query", "vec_id").agg(F.min("score").alias("score")).withColumn("place", F.row_number().over(best)).where(F.col("place") <= nearest).drop("place")


def nearest_neighbours(table: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", every: int = 100, nearest: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score for every row whose id is divisible by ``every``."""
    rows, size = usable(table, id_column, vector_column)
    spark = table.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not size:
        return empty
    own = Window.partitionBy("v").orderBy("vec_id")
    index = materialize(rows.withColumn("copy", F.row_number().over(own)).where(F.col("copy") <= nearest + 1).select("vec_id", "v"), "index")
    asked = rows.where(F.col("vec_id") % every == 0)
    asked = materialize(asked.select("vec_id", "v", F.min("vec_id").over(Window.partitionBy("v")).alias("query")), "asked")
    queries = asked.where("vec_id = query").select("vec_id", "v")
    sample = np.array([r.v for r in index.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()]).reshape(-1, size)
    codes = Codes(sample, nearest)
    found = materialize(_search(index, queries, codes, codes.radius, nearest + 1), "found")
    whole = min(index.count(), nearest + 1)
    short = queries.join(found.groupBy(F.col("query").alias("vec_id")).agg(F.count("*").alias("n")), "vec_id", "left").where(F.coalesce("n", F.lit(0)) < whole)
    short = materialize(short.select("vec_id", "v"), "short")
    if short.count():
        again = _search(index, short, codes, LONGEST + PART, nearest + 1)
        found = found.join(short.select(F.col("vec_id").alias("query")), "query", "left_anti").unionByName(again)
    place = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        asked.select(F.col("vec_id").alias("query_id"), "query").distinct()
        .join(found, "query")
        .where(F.col("query_id") != F.col("vec_id"))
        .withColumn("rank", F.row_number().over(place))
        .where(F.col("rank") <= nearest)
        .select("query_id", "rank", "vec_id", "score")
    )
