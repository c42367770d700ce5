"""Ordering, top-k, Pareto and island operators, renumbering, set operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import geometry as g


def retain_best(points: DataFrame, keys: Sequence[str], response: str, n: int) -> DataFrame:
    """O3: the ``n`` points of largest response of each key, ties at the cut included."""
    return points.withColumn("place", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc(response)))).where(F.col("place") <= n).drop("place")


def near_maximum(points: DataFrame, keys: Sequence[str], response: str, share: float = 0.99) -> DataFrame:
    """Points whose response is at least ``share`` of their key's largest."""
    top = points.groupBy(*keys).agg(F.max(response).alias("top"))
    return points.join(top, list(keys)).where(F.col(response) >= share * F.col("top")).drop("top")


def first_points(points: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 6) -> DataFrame:
    """The first ``n`` points of each edge."""
    return points.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n).drop("place")


def pick_setting(settings: DataFrame, target: float, *, accuracy: str = "accuracy", cost: str = "cost", order: Sequence[str] = ()) -> DataFrame:
    """The cheapest setting of at least the target accuracy, else the most accurate one."""
    ok = (F.col(accuracy) >= target).cast("int")
    return settings.orderBy(F.desc(ok), F.when(ok == 1, F.col(cost)), F.when(ok == 0, -F.col(accuracy)), *order).limit(1)


def pareto_front(settings: DataFrame, *, accuracy: str = "accuracy", cost: str = "cost") -> DataFrame:
    """Settings that no other beats in one of accuracy and cost and equals in the rest.

    Of each accuracy the least cost is kept, then a setting stays if it costs less than all more
    accurate ones: one window over distinct accuracies in place of a self-join.
    """
    least = settings.groupBy(accuracy).agg(F.min(cost).alias("least"))
    better = Window.orderBy(F.desc(accuracy)).rowsBetween(Window.unboundedPreceding, -1)
    kept = least.withColumn("cheapest", F.min("least").over(better)).where(F.col("cheapest").isNull() | (F.col("least") < F.col("cheapest")))
    return settings.join(kept.select(F.col(accuracy).alias("_a"), "least"), (F.col(accuracy) == F.col("_a")) & (F.col(cost) == F.col("least")), "left_semi")


def islands(df: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """Runs of consecutive numbers of each key: first, last, length."""
    own = df.select(*keys, number).distinct()
    group = F.col(number) - F.row_number().over(Window.partitionBy(*keys).orderBy(number))
    return own.withColumn("_g", group).groupBy(*keys, "_g").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count("*").alias("length")).drop("_g")


def renumbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Dense numbers from zero within each key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1)


def normalized(tiles: DataFrame, keys: Sequence[str], *, width: float, height: float, order: Sequence[str], box=("x_start", "x_finish", "y_start", "y_finish")) -> DataFrame:
    """Starts shifted by their key's least start and rounded, finishes by the tile extent,
    ids dense by ``order``."""
    least = tiles.groupBy(*keys).agg(F.min(box[0]).alias("_x"), F.min(box[2]).alias("_y"))
    x, y = F.round(F.col(box[0]) - F.col("_x")), F.round(F.col(box[2]) - F.col("_y"))
    moved = tiles.join(least, list(keys)).withColumns({box[0]: x, box[2]: y}).withColumns({box[1]: F.col(box[0]) + width, box[3]: F.col(box[2]) + height}).drop("_x", "_y")
    return renumbered(moved, keys, order, "tile_ord")


def replicated(df: DataFrame, n: int, number: str) -> DataFrame:
    """U4: every row ``n`` times, renumbered from zero."""
    return df.withColumn(number, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))


def without(df: DataFrame, removed: DataFrame | Column, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not among ``removed``: a table, or a condition on the key itself,
    for which nothing is joined."""
    if isinstance(removed, Column):
        return df.where(~F.coalesce(removed, F.lit(False)))
    return df.join(removed.select(*keys).distinct(), list(keys), "left_anti")


def in_either_direction(pairs: DataFrame, edges: DataFrame | Column, keys: Sequence[str] = ()) -> DataFrame:
    """Pairs (a, b) for which an edge stands in one direction or the other: a table of edges or,
    where the pairs are the edges in both directions, a condition that reads the same both ways."""
    if isinstance(edges, Column):
        return pairs.where(edges)
    both = edges.select(*keys, "a", "b").unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    return pairs.join(both, [*keys, "a", "b"], "left_semi")


def adjacent(sections: DataFrame, number: str, columns: Sequence[str]) -> DataFrame:
    """Each section with the one before it (previous_<column>); the first has none."""
    before = sections.select((F.col(number) + 1).alias(number), *(F.col(c).alias(f"previous_{c}") for c in columns))
    return sections.join(before, number, "left")


def undirected(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct undirected edges, lower end first."""
    return edges.select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def grid_of_settings(spark, **values: Sequence) -> DataFrame:
    """Every combination of a few settings."""
    out = spark.range(1).select()
    for name, own in values.items():
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, own))))
    return out


def drawn(df: DataFrame, n: int, seed: int, keys: Sequence[str]) -> DataFrame:
    """``n`` rows by a seeded hash of their key, the same on every run."""
    # a column of its own, as an ordering by an expression computes it anew for both rows of each comparison;
    # digits order as the numbers do
    return df.withColumn("_drawn", g.drawn_digits(seed, *keys)).orderBy("_drawn", *keys).limit(n).drop("_drawn")


def joined_text(df: DataFrame, keys: Sequence[str], text: Column, order: Sequence[str]) -> DataFrame:
    """Texts of each key joined by semicolons, in order."""
    items = F.array_sort(F.collect_list(F.struct(*order, text.alias("t"))))
    return df.groupBy(*keys).agg(F.concat_ws(";", F.transform(items, lambda x: x["t"])).alias("line"))


def succeeded(df: DataFrame, *results: str) -> DataFrame:
    """rows whose results are there and not empty; a failed extraction leaves null or nothing."""
    out = df
    for c in results:
        ok = F.col(c).isNotNull()
        out = out.where(ok & (F.size(c) > 0) if df.schema[c].dataType.typeName() == "array" else ok)
    return out


def concatenated(*blocks: DataFrame) -> DataFrame:
    """Descriptor blocks one after another; columns that a block lacks are null."""
    out = blocks[0]
    for block in blocks[1:]:
        out = out.unionByName(block, allowMissingColumns=True)
    return out


def swept(tiles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """O1, O2: places of tiles in their key by x and by y, ties by id."""
    place = lambda axis: F.row_number().over(Window.partitionBy(*keys).orderBy(axis, "tile_id"))
    return tiles.withColumns({"by_x": place("x_start"), "by_y": place("y_start")})
