"""Spatial joins by grid cells: overlap, box and point-location joins without nested loops.

Each shape is dealt to the cells it touches and shapes meet by cell (an equi-join, so shuffled
hash, sort-merge and skew splitting all apply).  Two boxes that share several cells meet in one only:
the owner cell, which holds the lower corner of their intersection, so one of them has its lower x in
that cell and one its lower y.  Which of the two may own a pair is part of what they are joined by
(``ROLES``): boxes that share a cell and don't own it don't meet, and no distinct follows.

A pair of boxes is few bytes before the join and many pairs after it, so cells are dealt to an explicit
number of tasks; adaptive execution would merge them by bytes.  What is asked of the two tiles of a
pair goes along (``carry``): pairs may be far more rows than tiles, and are never joined with them again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import geometry as g

#: Column names of a box.
BOX = ("x_start", "x_finish", "y_start", "y_finish")


def cell_of(v, size) -> Column:
    return F.floor(g.col(v) / g.col(size)).cast("long")


def to_cells(df: DataFrame, box: Sequence[str], size: float) -> DataFrame:
    """A row for each cell (cx, cy) that a box touches."""
    span = lambda a, b: F.sequence(cell_of(a, size), F.greatest(cell_of(a, size), cell_of(b, size)))
    return df.withColumn("cx", F.explode(span(box[0], box[1]))).withColumn("cy", F.explode(span(box[2], box[3])))


#: A box lies in a cell with its lower x (2), its lower y (1), both (3) or neither (0).  Two boxes meet in
#: the cells where, between them, they have both: these are the ways, of the first and of the second box.
ROLES = ((3, 3), (3, 2), (3, 1), (3, 0), (2, 3), (2, 1), (1, 3), (1, 2), (0, 3))
#: The same where it doesn't matter which box is the first.
UNORDERED = ((3, 3), (3, 2), (3, 1), (3, 0), (2, 1))


def box_join(left: DataFrame, right: DataFrame, keys: Sequence[str], cell: float, *, condition: Column | None = None, left_box=BOX, right_box=BOX, roles=ROLES) -> DataFrame:
    """Pairs of boxes that meet (edges included) with equal ``keys``, as aliases ``a`` and ``b``;
    ``condition`` narrows them.  With ``UNORDERED`` roles each pair of a table with itself comes once, in
    any order, but for those of role 0, which come both ways and with themselves."""
    a, b = (_dealt(df, box, keys, cell, [r[i] for r in roles]).alias(side) for i, (df, box, side) in enumerate(((left, left_box, "a"), (right, right_box, "b"))))
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, "cx", "cy", "_role"]]
    left_, right_ = sides(left_box, right_box)
    return a.join(b.hint("merge"), [*on, g.meets_box(left_, right_) if condition is None else condition])


def handed_join(few: DataFrame, many: DataFrame, keys: Sequence[str], cell: float, *, condition: Column, left_box=BOX, right_box=BOX) -> DataFrame:
    """``box_join`` by a condition that only boxes that meet fulfil, where the first table is small enough to be
    handed to every task: rows of the other stay where they are, and nothing is written."""
    a, b = (_by_role(to_cells(df, box, cell), box, cell, [r[i] for r in ROLES]).alias(side) for i, (df, box, side) in enumerate(((few, left_box, "a"), (many, right_box, "b"))))
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, "cx", "cy", "_role"]]
    return b.join(F.broadcast(a), [*on, condition])


def _by_role(dealt: DataFrame, box: Sequence[str], cell: float, roles: Sequence[int]) -> DataFrame:
    """Boxes in cells once for each role that the box may have there."""
    home = F.when(F.col("cx") == cell_of(box[0], cell), 2).otherwise(0) + F.when(F.col("cy") == cell_of(box[2], cell), 1).otherwise(0)
    own = F.array(*(F.array(*(F.lit(n) for n, role in enumerate(roles) if role == kind)).cast("array<int>") for kind in range(4)))
    return dealt.withColumn("_role", F.explode(own[home]))


def _dealt(df: DataFrame, box: Sequence[str], keys: Sequence[str], cell: float, roles: Sequence[int] = ()) -> DataFrame:
    """Boxes by cell and, with ``roles``, once for each role that the box may have there."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out, by = to_cells(df, box, cell), [*keys, "cx", "cy"]
    if roles:
        out, by = _by_role(out, box, cell, roles), [*by, "_role"]
    return out.repartition(tasks, *by)


def with_any(left: DataFrame, right: DataFrame, keys: Sequence[str], cell: float, condition: Column, *, left_box=BOX, right_box=BOX) -> DataFrame:
    """Rows of ``left``, once for each cell in which some box of ``right`` meets the condition (aliases
    ``a`` and ``b``): the first found is enough, so no pairs are made."""
    a, b = (_dealt(df, box, keys, cell).alias(side) for df, box, side in ((left, left_box, "a"), (right, right_box, "b")))
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, "cx", "cy"]]
    return a.join(b, [*on, condition], "left_semi").select(*left.columns)


def sides(left_box=BOX, right_box=BOX) -> tuple[list[str], list[str]]:
    return [f"a.{c}" for c in left_box], [f"b.{c}" for c in right_box]


def overlap_pairs(
    tiles: DataFrame, *, keys: Sequence[str] = ("section_id",), id_column: str = "tile_id", cell: float = 3000, least: float | None = None, canonical: bool = False, with_self: bool = False,
    fraction: float | None = None, carry: Sequence[str] = (),
) -> DataFrame:
    """Pairs of tiles whose boxes overlap (F1; F3 with ``least``).

    ``canonical``: only b < a; ``with_self``: a tile meets itself, too; ``fraction``: only pairs
    whose overlap fraction is over it.  Returns the keys, a, b, both boxes, and the columns to ``carry``
    of either tile (a_<column>, b_<column>).
    """
    a_box, b_box = sides()
    a_id, b_id = F.col(f"a.{id_column}"), F.col(f"b.{id_column}")
    whole = [f"_whole_{c}" for c in BOX]  # cut before they meet: there are far more candidates than tiles
    test = g.overlaps(*sides(whole, whole), least=least)
    if canonical:
        test = ((a_id > b_id) | ((F.col("a._role") > 0) & (a_id != b_id))) & test
    elif not with_self:
        test &= b_id != a_id
    if fraction is not None:
        test &= g.overlap_fraction(a_box, b_box) > fraction
    cut = tiles.withColumns({w: F.col(c).cast("int") for w, c in zip(whole, BOX)})
    pairs = box_join(cut, cut, keys, cell, condition=test, roles=UNORDERED if canonical else ROLES)
    columns = [id_column, *BOX, *carry]
    of = {"a": [F.col(f"a.{c}") for c in columns], "b": [F.col(f"b.{c}") for c in columns]}
    if canonical:  # the test is the same both ways, so pairs are put in order once they are found
        first = a_id > b_id
        of = {s: [F.when(first, F.col(f"{s}.{c}")).otherwise(F.col(f"{t}.{c}")) for c in columns] for s, t in ("ab", "ba")}
    named = [v.alias(f"{s}_{c}" if n else s) for n, c in enumerate(columns) for s, v in (("a", of["a"][n]), ("b", of["b"][n]))]
    ids, rest = named[:2], named[2:]
    return pairs.select(*(F.col(f"a.{k}").alias(k) for k in keys), *ids, *rest[::2], *rest[1::2])


def overlap_counts(tiles: DataFrame, *, keys: Sequence[str] = ("section_id",), id_column: str = "tile_id", cell: float = 3000) -> DataFrame:
    """The canonical pairs of ``overlap_pairs`` by their boxes, for what asks no more of a pair: keys, both
    boxes (in either order) and how many pairs of tiles have them, n.

    Tiles of one box are counted first, so pairs are those of distinct boxes, and copies don't multiply.
    Pairs of rows that repeat an id, which aren't pairs of tiles, come with a negative n."""
    boxed = [F.col(c) for c in (*keys, *BOX)]
    known = tiles.where(F.col(id_column).isNotNull())
    boxes = known.groupBy(*boxed).agg(F.count("*").alias("n"), F.min(F.struct(*BOX)).alias("_box"))
    pairs = overlap_pairs(boxes, keys=keys, id_column="_box", cell=cell, canonical=True, carry=["n"])
    sides_ = [f"{s}_{c}" for s in "ab" for c in BOX]
    within = lambda n: F.expr(f"{n} * ({n} - 1) div 2")
    itself = lambda df, n: df.where(g.overlaps(BOX, BOX, whole=True)).select(*keys, *(F.col(c).alias(f"{s}_{c}") for s in "ab" for c in BOX), n.alias("n"))
    out = pairs.select(*keys, *sides_, (F.col("a_n") * F.col("b_n")).alias("n")).unionByName(itself(boxes.where("n > 1"), within("n")))
    again = known.groupBy(*keys, id_column).agg(F.count("*").alias("_rows")).where("_rows > 1").select(*keys, id_column)
    alike = known.join(again, [*keys, id_column], "left_semi").groupBy(*keys, id_column, *BOX).agg(F.count("*").alias("n"), F.min(F.struct(*BOX)).alias("_box"))
    of_id = overlap_pairs(alike, keys=[*keys, id_column], id_column="_box", cell=cell, canonical=True, carry=["n"])
    return out.unionByName(of_id.select(*keys, *sides_, (-F.col("a_n") * F.col("b_n")).alias("n"))).unionByName(itself(alike.where("n > 1"), -within("n")))


def sliding_boxes(extent: DataFrame, keys: Sequence[str], size: float, step: float) -> DataFrame:
    """Boxes of ``size`` every ``step`` over the extent (keys, x_start ...) of each key."""
    at = lambda lo, hi: F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.col(hi) - F.col(lo)) / step) - 1).cast("int"))
    xs = extent.withColumn("ix", F.explode(at(BOX[0], BOX[1]))).withColumn("iy", F.explode(at(BOX[2], BOX[3])))
    x0, y0 = F.col(BOX[0]) + F.col("ix") * step, F.col(BOX[2]) + F.col("iy") * step
    return xs.select(*keys, "ix", "iy", x0.alias(BOX[0]), (x0 + size).alias(BOX[1]), y0.alias(BOX[2]), (y0 + size).alias(BOX[3]))


def points_in_triangles(points: DataFrame, triangles: DataFrame, keys: Sequence[str], cell: float, *, strict: bool = False, outer: bool = False) -> DataFrame:
    """For each point (keys, point_id, x, y) the triangle (keys, t, ax ... cy) of least
    number that holds it, with its weights u, v, w; ``outer`` keeps points that none holds.

    Triangles are dealt to the cells of their bounding boxes, points to their own cell.
    """
    box = triangles.select(
        *keys, "t", "ax", "ay", "bx", "by", "cx", "cy",
        F.least("ax", "bx", "cx").alias("x0"), F.greatest("ax", "bx", "cx").alias("x1"), F.least("ay", "by", "cy").alias("y0"), F.greatest("ay", "by", "cy").alias("y1"),
    )
    corners = box.withColumnsRenamed({"cx": "ex", "cy": "ey"})
    dealt = to_cells(corners, ("x0", "x1", "y0", "y1"), cell)
    own = points.withColumns({"cx": cell_of("x", cell), "cy": cell_of("y", cell)})
    u, v, w = g.barycentric(("x", "y"), ("ax", "ay"), ("bx", "by"), ("ex", "ey"))
    met = own.join(dealt, [*keys, "cx", "cy"]).withColumns({"u": u, "v": v, "w": w})
    inside = (F.col("u") > 0) & (F.col("v") > 0) & (F.col("w") > 0) if strict else (F.col("u") >= 0) & (F.col("v") >= 0) & (F.col("w") >= 0)
    best = met.where(inside).groupBy(*keys, "point_id").agg(F.min(F.struct("t", "u", "v", "w", "ax", "ay", "bx", "by", "ex", "ey")).alias("hit"))
    hit = best.select(*keys, "point_id", "hit.*")
    return points.join(hit, [*keys, "point_id"], "left" if outer else "inner")


def sampled_boxes(sections: DataFrame, area: DataFrame, n: int, size: int, seed: int) -> DataFrame:
    """``n`` drawn boxes of ``size`` inside the first section's extent, each in a drawn section and in
    the one after it: i, side (1, 2), section_id, box.  Draws are hashes of the box's number (``draw``).

    Sections: section_id; area: the extent of each (section_id, box).  With one section, or an extent no
    larger than a box, there is none.  The window numbers the sections, not the tiles."""
    ranked = sections.select("section_id").distinct().withColumn("place", F.row_number().over(Window.orderBy("section_id")).cast("long") - 1)
    head = area.orderBy("section_id").limit(1).select(F.floor(F.col(BOX[1]) - size).cast("long").alias("wide"), F.floor(F.col(BOX[3]) - size).cast("long").alias("high"))
    count = ranked.agg((F.count("*") - 1).alias("steps"))
    room = F.broadcast(head.join(count).where("wide > 0 AND high > 0 AND steps > 0"))  # one row
    i = F.col("i")
    at = lambda what, most: F.floor(g.draw(seed, i, F.lit(what)) * F.col(most)).cast("long")
    drawn = sections.sparkSession.range(n).select(F.col("id").alias("i")).join(room).select("i", at("section", "steps").alias("first"), at("x", "wide").cast("double").alias("x"), at("y", "high").cast("double").alias("y"))
    both = drawn.withColumn("side", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("place", F.col("first") + F.col("side") - 1)
    x, y = F.col("x"), F.col("y")
    return both.join(ranked, "place").select("i", "side", "section_id", x.alias(BOX[0]), (x + size).alias(BOX[1]), y.alias(BOX[2]), (y + size).alias(BOX[3]))
