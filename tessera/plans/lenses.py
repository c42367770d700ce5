"""Views of the given tables as tiles, matches, descriptors, settings and meshes.

All arithmetic is on integers or exact in doubles, so that any engine gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geometry as g


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """section_id, tile_id, mfov_id, box, bad: from ``part``."""
    k = F.col("p_partkey")
    p = read(spark, sf_dir, "part").select(
        (F.col("p_size") % 4).cast("long").alias("section_id"), k.alias("tile_id"), (k % 7).cast("int").alias("mfov_id"), ((k * 7919) % 60013).cast("double").alias("x_start"),
        ((k * 104729) % 60013).cast("double").alias("y_start"), (k % 11 == 0).alias("bad"),
    )
    return p.select(
        "section_id", "tile_id", "mfov_id", "x_start", (F.col("x_start") + g.TILE_WIDTH).alias("x_finish"), "y_start", (F.col("y_start") + g.TILE_HEIGHT).alias("y_finish"), "bad"
    )


TILES = """tiles AS (
  SELECT CAST(p_size % 4 AS BIGINT) section_id, p_partkey tile_id, CAST(p_partkey % 7 AS INTEGER) mfov_id,
    CAST((p_partkey * 7919) % 60013 AS DOUBLE) x_start, CAST((p_partkey * 7919) % 60013 + 3128 AS DOUBLE) x_finish,
    CAST((p_partkey * 104729) % 60013 AS DOUBLE) y_start, CAST((p_partkey * 104729) % 60013 + 2724 AS DOUBLE) y_finish,
    p_partkey % 11 = 0 bad
  FROM part)"""


def jiggled(tiles_: DataFrame) -> DataFrame:
    """The tiles of a second alignment: up to ten units away."""
    dx, dy = (F.col("tile_id") * 31) % 21 - 10, (F.col("tile_id") * 17) % 21 - 10
    return tiles_.withColumns({"x_start": F.col("x_start") + dx, "x_finish": F.col("x_finish") + dx, "y_start": F.col("y_start") + dy, "y_finish": F.col("y_finish") + dy})


JIGGLED = """jiggled AS (
  SELECT section_id, tile_id, mfov_id, x_start + (tile_id * 31) % 21 - 10 x_start, x_finish + (tile_id * 31) % 21 - 10 x_finish,
    y_start + (tile_id * 17) % 21 - 10 y_start, y_finish + (tile_id * 17) % 21 - 10 y_finish, bad
  FROM tiles)"""


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair, ord, dx, dy: from ``lineitem``, distinct."""
    return (
        read(spark, sf_dir, "lineitem")
        .select(
            F.col("l_partkey").alias("pair"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.col("l_quantity").cast("long").alias("dx"),
            F.round(F.col("l_discount") * 100).cast("long").alias("dy"),
        )
        .distinct()
    )


MATCHES = """matches AS (
  SELECT DISTINCT l_partkey pair, l_orderkey * 10 + l_linenumber ord, CAST(trunc(l_quantity) AS BIGINT) dx, CAST(round(l_discount * 100) AS BIGINT) dy
  FROM lineitem)"""


def edges(spark: SparkSession, sf_dir: str, least: float = g.MIN_OVERLAP, *, carry: bool = False, now: DataFrame | None = None) -> DataFrame:
    """section_id, a, b, ideal_dx, ideal_dy: overlapping tiles, b < a, and where a should be from b.
    ``carry``: with the positions of both (ax, ay, bx, by) and whether they are bad (abad, bbad); ``now``: with
    the positions that this table (section_id, tile_id, x, y) gives them."""
    from tessera.operators.spatial import overlap_pairs

    own, place = tiles(spark, sf_dir), ("x_start", "y_start")
    if now is not None:
        own, place = own.join(now, ["section_id", "tile_id"]), ("x", "y")
    pairs = overlap_pairs(own, least=least, canonical=True, carry=["bad"] if now is None else ["bad", "x", "y"])
    ends = [F.col(f"{t}_{c}").alias(f"{t}{n}") for t in "ab" for c, n in zip((*place, "bad"), ("x", "y", "bad"))]
    off = (F.col("a") * 13 + F.col("b") * 7) % 25 - 12
    return pairs.select(
        "section_id", "a", "b", (F.col("a_x_start") - F.col("b_x_start") + off).alias("ideal_dx"), (F.col("a_y_start") - F.col("b_y_start") - off % 5).alias("ideal_dy"), *(ends if carry or now is not None else [])
    )


EDGES = """edges AS (
  SELECT a.section_id, a.tile_id a, b.tile_id b,
    a.x_start - b.x_start + ((a.tile_id * 13 + b.tile_id * 7) % 25 - 12) ideal_dx,
    a.y_start - b.y_start - ((a.tile_id * 13 + b.tile_id * 7) % 25 - 12) % 5 ideal_dy
  FROM tiles a JOIN tiles b ON a.section_id = b.section_id AND b.tile_id < a.tile_id
    AND least(a.x_finish - b.x_start, b.x_finish - a.x_start) >= 50 AND least(a.y_finish - b.y_start, b.y_finish - a.y_start) >= 50)"""


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles(spark, sf_dir).select("section_id", "tile_id", F.col("x_start").alias("x"), F.col("y_start").alias("y"))


SYMMETRIC = """sym AS (
  SELECT section_id, a, b, ideal_dx, ideal_dy FROM edges UNION ALL SELECT section_id, b, a, -ideal_dx, -ideal_dy FROM edges),
placed AS (
  SELECT s.*, sqrt(pow(p.x_start - q.x_start - ideal_dx, 2) + pow(p.y_start - q.y_start - ideal_dy, 2)) deviation
  FROM sym s JOIN tiles p ON p.section_id = s.section_id AND p.tile_id = s.a JOIN tiles q ON q.section_id = s.section_id AND q.tile_id = s.b)"""


def keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tile_id, kp, response: from ``lineitem``, distinct."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("tile_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("kp"), F.col("l_extendedprice").alias("response")).distinct()


KEYPOINTS = "keypoints AS (SELECT DISTINCT l_partkey tile_id, l_orderkey * 10 + l_linenumber kp, l_extendedprice response FROM lineitem)"


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flag, status, line, accuracy, cost: from ``lineitem``, in whole numbers."""
    li = read(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_linenumber").alias("line")).agg(
        (F.sum(F.round(F.col("l_discount") * 100).cast("long")) * 1000).cast("long").alias("s"), F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("q")
    ).select("flag", "status", "line", F.expr("s div n").alias("accuracy"), F.expr("q * 100 div n").alias("cost"))


SETTINGS = """settings AS (
  SELECT l_returnflag flag, l_linestatus status, l_linenumber line,
    CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) * 1000 // count(*) accuracy, CAST(sum(CAST(trunc(l_quantity) AS BIGINT)) AS BIGINT) * 100 // count(*) AS cost
  FROM lineitem GROUP BY ALL)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, score, good: labelled documents, scored by their length."""
    docs = read(spark, sf_dir, "documents").select("doc_id", ((F.col("n_chars") % 1000) / 1000).alias("score"), "n_chars")
    return docs.join(read(spark, sf_dir, "labels"), "doc_id").select("doc_id", "score", "n_chars", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))


SCORED = """scored AS (
  SELECT d.doc_id, (n_chars % 1000) / 1000.0::DOUBLE score, n_chars, quality = 1 good, toxic = 1 toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def mesh(spark: SparkSession, sf_dir: str, spacing: float = 6000.0) -> tuple[DataFrame, DataFrame]:
    """Mesh points (deformed by whole numbers) and triangles over the tiles of each section."""
    from tessera.operators.aggregates import extent
    from tessera.operators.mesh import hex_grid, hex_triangles

    grid = hex_grid(extent(tiles(spark, sf_dir), ["section_id"]), ["section_id"], spacing)
    points = grid.select("section_id", "idx", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("idx") % 13 * 10).alias("x"), (F.col("y") - F.col("idx") % 7 * 10).alias("y"))
    return points, hex_triangles(grid, ["section_id"])


MESH = """ext AS (SELECT section_id, min(x_start) x0, max(x_finish) x1, min(y_start) y0, max(y_finish) y1 FROM tiles GROUP BY 1),
dims AS (SELECT *, CAST(ceil((x1 - x0) / 6000.0::DOUBLE) AS BIGINT) + 6 nc, CAST(ceil((y1 - y0) / 4500.0::DOUBLE) AS BIGINT) + 6 nr FROM ext),
grid AS (SELECT section_id, r * nc + c idx, r, c, nc, nr, x0 + (c - 3) * 6000.0::DOUBLE + CASE WHEN r % 2 = 1 THEN 3000.0 ELSE 0.0 END::DOUBLE x, y0 + (r - 3) * 4500.0::DOUBLE y
  FROM dims, range(0, nr) t(r), range(0, nc) u(c)),
mesh AS (SELECT section_id, idx, x x0, y y0, x + idx % 13 * 10 x, y - idx % 7 * 10 y FROM grid),
tris AS (
  SELECT section_id, idx * 2 t, idx i, idx + 1 j, CASE WHEN r % 2 = 1 THEN idx + nc + 1 ELSE idx + nc END k FROM grid WHERE r < nr - 1 AND c < nc - 1
  UNION ALL
  SELECT section_id, idx * 2 + 1, CASE WHEN r % 2 = 1 THEN idx ELSE idx + 1 END, idx + nc + 1, idx + nc FROM grid WHERE r < nr - 1 AND c < nc - 1)"""
