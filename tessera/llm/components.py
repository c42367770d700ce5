"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``edges`` (a, b): undirected links of comparable ids.  Returns node, root (the least node
    that can be reached), for every node that has a link.

    Each round is written to the shared folder; what is looked at on the driver are two sums.
    Minima are pre-aggregated, so a node with very many links only skews a join, which adaptive
    execution splits.
    """
    current = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "links")
    seen = None
    for _ in range(most_rounds):
        both = current.select("v", "u").unionByName(current.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u <> v").distinct()
        down = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (
            large.join(down, "v")
            .select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct("v", F.col("m").alias("u")))).alias("e"))
            .select("e.*")
            .where("u <> v")
            .distinct()
        )
        after = materialize(small, "links")
        mark = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        discard(current)
        current = after
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = current.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return roots.unionByName(current.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
