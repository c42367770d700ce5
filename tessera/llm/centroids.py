"""Operator 13: Lloyd's clustering of integer vectors.

Each round broadcasts the centroids (at most ``clusters`` rows of ``components`` integers).
``mapInPandas`` takes the squared differences to one centroid after another, the least wins and of
equal ones the smaller number, and a partition emits the integer sums and counts of its clusters;
they merge through ``groupBy``, and the driver gets ``clusters * (components + 1)`` numbers a
round.  All arithmetic is on integers, so neither order nor layout of the rows changes a result.

Defined results: vectors that are null, of another length, or hold a null or non-finite component
take no part.  Quantized components beyond 2**27 either way are held at that, so that a distance
fits a long; inertias beyond a long are held at its largest.  Rows that repeat a vec_id keep a row
each; of equal hashes the least vector, in the order of arrays, comes first.  A null vec_id has no
hash: such a row is clustered, but starts no centroid.  With fewer vectors than ``clusters`` there
are as many centroids as there are vectors with an id; with none, every vector is left without a
cluster (nulls).  Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS, CLUSTERS, ROUNDS = 64, 40, 5
SCALE = 256
SEED = 2
#: Largest quantized component: 64 squares of twice that fit a long.
MOST = 1 << 27
LONGEST = (1 << 63) - 1
#: Rows whose differences are held at once.
ROWS = 4096


def quantized(embeddings: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id and the integer components of each vector that takes part."""
    x = F.col("embedding")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    kept = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(x.isNotNull() & (F.size(x) == components)).where(~odd)

    def step(v):
        return F.floor(F.greatest(F.least(v.cast("double") * float(scale), F.lit(float(MOST))), F.lit(float(-MOST)))).cast("long")

    return kept.select("vec_id", F.transform(x, step).alias("x"))


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors of least hash of ``seed:vec_id``, in that order."""
    named = vectors.where("vec_id IS NOT NULL").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "x")
    return np.array([r.x for r in named.orderBy("h", "x").limit(clusters).collect()], np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to the nearest centroid of each row; the first of equal ones."""
    cluster, distance = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    for at in range(0, len(x), ROWS):
        part = x[at : at + ROWS]
        squares = np.empty((len(part), len(centroids)), np.int64)
        for k, centroid in enumerate(centroids):
            gap = part - centroid
            np.einsum("ij,ij->i", gap, gap, out=squares[:, k])
        cluster[at : at + ROWS] = squares.argmin(1)
        distance[at : at + ROWS] = squares.min(1)
    return cluster, distance


def _matrix(column: pd.Series, components: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64) if len(column) else np.zeros((0, components), np.int64)


def partial_sums(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cluster, place, total: the sums of each component (place 0, 1, ...), then the count and the sum
    of distances."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres = shared.value
        k, n = centres.shape
        sums = np.zeros((k, n + 1), np.int64)
        apart = [0] * k  # distances may add up to more than a long
        for batch in batches:
            x = _matrix(batch["x"], n)
            cluster, distance = nearest(x, centres)
            order = np.argsort(cluster, kind="stable")
            if len(order):
                own, at = np.unique(cluster[order], return_index=True)
                sums[own, :n] += np.add.reduceat(x[order], at, axis=0)
                sums[own, n] += np.diff(np.append(at, len(order)))
                for c, d in zip(own.tolist(), np.split(distance[order], at[1:]), strict=True):
                    apart[c] += int(d.sum()) if len(d) * int(d.max()) <= LONGEST else sum(d.tolist())
        seen = np.flatnonzero(sums[:, n])
        rows = [(int(c), p, str(t)) for c in seen for p, t in enumerate([*sums[c].tolist(), apart[c]])]
        yield pd.DataFrame(rows, columns=["cluster", "place", "total"])

    parts = vectors.select("x").mapInPandas(work, "cluster int, place int, total string")
    return parts.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def _table(sums: DataFrame, clusters: int, components: int) -> np.ndarray:
    out = np.zeros((clusters, components + 2), object)
    for r in sums.collect():  # clusters * (components + 2) numbers at most
        out[r.cluster, r.place] = int(r.total)
    return out


def moved(centroids: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Each centroid at the floor of its vectors' mean; an empty one stays."""
    out = centroids.copy()
    n = centroids.shape[1]
    for k, row in enumerate(sums):
        if row[n]:
            out[k] = [total // row[n] for total in row[:n]]
    return out


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance, the inertias, and a digest of each centroid."""
    if not len(centroids):
        absent = [F.lit(None).cast(kind).alias(name) for name, kind in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))]
        return vectors.select("vec_id", *absent)
    k, n = centroids.shape
    apart = [int(row[n + 1]) for row in _table(partial_sums(vectors, centroids), k, n)]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    shared = vectors.sparkSession.sparkContext.broadcast((centroids, [min(a, LONGEST) for a in apart], min(sum(apart), LONGEST), digests))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, each, total, names = shared.value
        each, names = np.array(each, np.int64), np.array(names, object)
        for batch in batches:
            cluster, distance = nearest(_matrix(batch["x"], n), centres)
            yield pd.DataFrame(
                {
                    "vec_id": batch["vec_id"].astype("Int64"),
                    "cluster": cluster.astype(np.int32),
                    "distance": distance,
                    "cluster_inertia": each[cluster],
                    "inertia": np.full(len(cluster), total, np.int64),
                    "centroid_sha256": names[cluster],
                }
            )

    return vectors.mapInPandas(work, "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")


def lloyd(
    embeddings: DataFrame, *, clusters: int = CLUSTERS, components: int = COMPONENTS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED
) -> tuple[DataFrame, np.ndarray]:
    """The vectors that take part, quantized, and the centroids after ``rounds``."""
    vectors = quantized(embeddings, components, scale)
    centroids = first_centroids(vectors, clusters, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(centroids, _table(partial_sums(vectors, centroids), *centroids.shape))
    return vectors, centroids


def cluster_vectors(embeddings: DataFrame, **options) -> DataFrame:
    return assign(*lloyd(embeddings, **options))
