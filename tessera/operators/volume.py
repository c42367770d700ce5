"""Alignment of sections to their neighbours: matches in boxes, affines, meshes, and the chain.

A row's ``section_id`` names the section that is aligned; its neighbour's rows carry the same
number (``to_neighbour``), so all pairs of sections are matched at once.  Keypoints: section_id,
id, x, y, v (stack coordinates and descriptor).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.operators import matching
from tessera.operators.aggregates import extent
from tessera.operators.mesh import affine_mesh, elastic_meshes, elastic_transform, located
from tessera.operators.spatial import BOX, cell_of, sliding_boxes, to_cells
from tessera.operators.tables import delete, written

KEYS = ("section_id",)
MODEL = matching.MODEL
#: Keypoints a box needs on either side, and pixels within which a match agrees.
LEAST_POINTS = 12
THRESHOLD = 64.0


def stack_keypoints(keypoints: DataFrame, tiles: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """C20: keypoints (keys, tile_id, x, y ...) in stack coordinates (P1); tiles have x_start,
    y_start and, where they were moved, offset_x, offset_y."""
    off = {c: F.col(c) if c in tiles.columns else F.lit(0.0) for c in ("offset_x", "offset_y")}
    own = tiles.select(*keys, "tile_id", F.col("x_start").alias("_sx"), F.col("y_start").alias("_sy"), off["offset_x"].alias("_ox"), off["offset_y"].alias("_oy"))
    x, y = g.rigid("x", "y", "_ox", "_oy", "_sx", "_sy")
    return keypoints.join(own, [*keys, "tile_id"]).withColumns({"x": x, "y": y}).drop("_sx", "_sy", "_ox", "_oy")


def to_neighbour(rows: DataFrame) -> DataFrame:
    """Rows of each section under the number of the section after it."""
    return rows.withColumn("section_id", F.col("section_id") + 1)


def points_in_boxes(boxes: DataFrame, points: DataFrame, keys: Sequence[str] = KEYS, cell: float = 6000) -> DataFrame:
    """Points with every box (keys, ix, iy, box) that holds them, edges included."""
    own = points.withColumns({"cx": cell_of("x", cell), "cy": cell_of("y", cell)})
    met = own.join(to_cells(boxes.select(*keys, "ix", "iy", *BOX), BOX, cell), [*keys, "cx", "cy"])
    return met.where(g.in_box("x", "y", BOX)).drop("cx", "cy", *BOX)


def near_model(points: DataFrame, models: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    """Points (keys, x, y, u, v) that their key's affine takes to within ``threshold`` of (u, v)."""
    met = points.join(models.select(*keys, *MODEL), list(keys))
    px, py = g.affine("x", "y", MODEL)
    return met.where(g.distance(px, py, "u", "v") <= threshold).select(*points.columns)


def box_matches(
    boxes: DataFrame, left: DataFrame, right: DataFrame, *, ratio: float = 0.92, least: int = 120, share: float = 0.1, threshold: float = THRESHOLD, seed: int = 1
) -> DataFrame:
    """Matches that agree on an affine in each box: keypoints of both sides in the box, at least
    12 of each; nearest two and ratio test; at least ``least`` matches; affine consensus; and at
    least 12 inliers and a ``share`` of the matches.  Returns section_id, ix, iy, a, b, x, y, u, v.

    C8, the form for new keypoints of one side, is ``ratio`` 0.65, ``least`` 12, ``share`` 0.05."""
    names = [*KEYS, "ix", "iy"]
    sides = [points_in_boxes(boxes, side.select(*KEYS, "id", "x", "y", "v")) for side in (left, right)]
    enough = [side.groupBy(*names).count().where(F.col("count") >= LEAST_POINTS).select(*names) for side in sides]
    a, b = (side.join(enough[0], names, "left_semi").join(enough[1], names, "left_semi") for side in sides)
    found = matching.ratio_test(matching.nearest_two(a.withColumnRenamed("id", "q"), b.withColumnRenamed("id", "c"), names), ratio).where("good")
    from_ = left.select(*KEYS, F.col("id").alias("a"), "x", "y")
    to = right.select(*KEYS, F.col("id").alias("b"), F.col("x").alias("u"), F.col("y").alias("v"))
    found, found_at = written(found, "nearest")
    put = found.select(*names, F.col("query").alias("a"), F.col("c1").alias("b")).join(from_, [*KEYS, "a"]).join(to, [*KEYS, "b"])
    many = put.groupBy(*names).count().where(F.col("count") >= least).select(*names)
    points, _ = written(put.join(many, names, "left_semi").select(*names, "a", "b", "x", "y", "u", "v"), "matches")  # read several times
    models = matching.affine_consensus(points, names, threshold, seed=seed)
    good = models.where(matching.acceptable("inliers", "total", least=LEAST_POINTS, share=share))
    out, _ = written(near_model(points, good, names, threshold), "matches")
    delete(left.sparkSession, found_at)
    return out


def _boxes(area: DataFrame, size: float, step: float, beyond: float) -> DataFrame:
    wide = area.select(*KEYS, BOX[0], (F.col(BOX[1]) + beyond).alias(BOX[1]), BOX[2], (F.col(BOX[3]) + beyond).alias(BOX[3]))
    return sliding_boxes(wide, KEYS, size, step)


def extent_of_points(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    both = {BOX[0]: x, BOX[1]: x, BOX[2]: y, BOX[3]: y}
    return extent(points.select(*KEYS, *(F.col(c).alias(name) for name, c in both.items())), KEYS)


def elastic_matches(left: DataFrame, right: DataFrame, mesh: DataFrame, neighbour_mesh: DataFrame, triangles: DataFrame, neighbour_triangles: DataFrame, *, size: float = 12_000, cell: float = 6000, **settings) -> DataFrame:
    """Matches of all boxes that have over 12, each with its triangle in the section's
    deformed mesh (t, u, v, w) and in the neighbour's original one, all weights over zero.

    The neighbour's triangle is the one that holds the section's own point, as surveyed.  Returns
    section_id, ix, iy, a, b, t, u, v, w, other_t, dst_x, dst_y."""
    boxes = _boxes(extent_of_points(left), size, size, 2 * size)
    names = [*KEYS, "ix", "iy"]
    found = box_matches(boxes, left, right, **settings).withColumnsRenamed({"u": "dst_x", "v": "dst_y"})
    many = found.groupBy(*names).count().where(F.col("count") > LEAST_POINTS).select(*names)
    points, _ = written(found.join(many, names, "left_semi").withColumn("point_id", F.concat_ws(":", "ix", "iy", "a", "b")), "points")
    own = located(points, triangles, mesh, KEYS, cell, xy=("x", "y")).where("u > 0 AND v > 0 AND w > 0")
    own, _ = written(own.drop("ax", "ay", "bx", "by", "ex", "ey"), "located")  # read several times
    place = own.select(*KEYS, "point_id", "x", "y", "dst_x", "dst_y")
    other = located(place, neighbour_triangles, neighbour_mesh, KEYS, cell)
    weights = g.barycentric(("dst_x", "dst_y"), ("ax", "ay"), ("bx", "by"), ("ex", "ey"))
    inside = other.where((weights[0] > 0) & (weights[1] > 0) & (weights[2] > 0)).select(*KEYS, "point_id", F.col("t").alias("other_t"))
    return own.join(inside, [*KEYS, "point_id"]).drop("point_id", "x", "y")


def fine_affine(left: DataFrame, right: DataFrame, *, size: float = 48_000, seed: int = 1, **settings) -> DataFrame:
    """C11: one affine a section: matches of boxes of ``size`` every half of it, those that a second
    consensus keeps (12 at least) pooled over the boxes, and least squares."""
    names = [*KEYS, "ix", "iy"]
    found = box_matches(_boxes(extent_of_points(left), size, size / 2, size), left, right, seed=seed, **settings)
    models = matching.affine_consensus(found, names, THRESHOLD, seed=seed).where(F.col("inliers") >= LEAST_POINTS)
    return matching.fit_affine(near_model(found, models, names, THRESHOLD), KEYS)


def coarse_models(left: DataFrame, right: DataFrame, coarse, tries: int = 10) -> DataFrame:
    """C10 until it succeeds, at most ``tries`` times with other draws; sections without a model
    keep the identity."""
    spark = left.sparkSession
    done, paths = None, []
    for seed in range(1, tries + 1):
        rest = [side if done is None else side.join(done.select(*KEYS), list(KEYS), "left_anti") for side in (left, right)]
        if done is not None and not rest[0].take(1):
            break
        found, path = written(coarse(*rest, list(KEYS), seed=seed).where("a00 IS NOT NULL").select(*KEYS, *MODEL), "coarse")
        paths.append(path)
        done = found if done is None else done.unionByName(found)
    models, _ = written(done, "coarse")
    delete(spark, *paths)
    return models


def _transformed(keypoints: DataFrame, triangles: DataFrame, mesh: DataFrame) -> DataFrame:
    """C14: keypoints through the mesh's transform."""
    places = keypoints.select(*KEYS, F.col("id").alias("point_id"), "x", "y")  # without v, which is a weight there
    moved = elastic_transform(places, triangles, mesh, KEYS, 6000).select(*KEYS, F.col("point_id").alias("id"), "x", "y")
    return moved.join(keypoints.select(*KEYS, "id", "v"), [*KEYS, "id"])


def align_neighbours(left: DataFrame, right: DataFrame, mesh: DataFrame, triangles: DataFrame, neighbour_mesh: DataFrame, neighbour_triangles: DataFrame, coarse, *, turns: int = 2, descent: dict | None = None, **settings) -> DataFrame:
    """Each section's mesh aligned to its neighbour (keypoints with tile_id): coarse affine (C10) on the mesh (C13),
    then elastic matches (C9) and descent (I6), twice.  Returns the mesh: section_id, idx, x0, y0,
    x, y; sections that find no matches keep the mesh they have."""
    spark = mesh.sparkSession
    models = coarse_models(left, right, coarse)
    identity = dict(zip(MODEL, g.IDENTITY))
    moved = mesh.select(*KEYS, "idx", "x0", "y0", F.col("x0").alias("x"), F.col("y0").alias("y")).join(models, list(KEYS), "left").fillna(identity)
    own, at = written(affine_mesh(moved, MODEL).select(*KEYS, "idx", "x0", "y0", "x", "y"), "mesh")
    own_left = left.join(models, list(KEYS), "left").fillna(identity)
    x, y = g.affine("x", "y", MODEL)
    placed = own_left.withColumns({"x": x, "y": y}).select(*KEYS, "id", "x", "y", "v")
    for turn in range(turns):
        # keypoints follow the mesh: in the first turn by the affine, then by the elastic transform
        points = placed if turn == 0 else _transformed(left, triangles, own)
        points, points_at = written(points, "keypoints")  # read several times
        links = elastic_matches(points, right, own, neighbour_mesh, triangles, neighbour_triangles, **settings)
        after, now = written(elastic_meshes(own, triangles, links, KEYS, **(descent or {})).drop("settled"), "mesh")
        delete(spark, at, points_at)
        own, at = after, now
    return own


def chained(meshes: DataFrame, triangles: DataFrame, sections: Sequence[int], cell: float = 6000) -> DataFrame:
    """Meshes, each aligned to the section before, in the coordinates of the first: in the order
    of ``sections`` the points of each go through the transform of the one before it, which already
    has gone through its own.  Sequential by definition, so a few jobs a section."""
    spark = meshes.sparkSession
    columns = [*KEYS, "idx", "x0", "y0", "x", "y"]
    out, paths, before = None, [], None
    for number in sections:
        own = meshes.where(F.col("section_id") == number).select(*columns)
        if before is not None:
            prior = before.withColumn("section_id", F.lit(number).cast(meshes.schema["section_id"].dataType))
            prior_triangles = triangles.where(F.col("section_id") == before_number).withColumn("section_id", F.lit(number).cast(meshes.schema["section_id"].dataType))
            own = elastic_transform(own.withColumn("point_id", F.col("idx")), prior_triangles, prior, KEYS, cell).select(*columns)
        before, path = written(own, "chain")
        before_number = number
        paths.append(path)
        out = before if out is None else out.unionByName(before)
    if out is None:
        return meshes.select(*columns).limit(0)
    whole, _ = written(out, "chain")
    delete(spark, *paths)
    return whole
