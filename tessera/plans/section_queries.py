"""Queries of the alignment between sections, over embeddings as keypoints of three sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import mesh as me
from tessera.operators import matching, volume
from tessera.operators.tables import written
from tessera.plans import lenses as ls
from tessera.plans.pipelines import coarse_affine, coarse_matches
from tessera.plans.registry import query

KEYS = ["section_id"]
SECTIONS = 3


#: Tiles of a section, and responses of their points as shares of the tile's strongest.
TILES = 5
SHARES = (1.0, 0.995, 0.98)


def keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """section_id, tile_id, id, x, y, v, response: every vector in three sections, each a step from the
    one before; every tenth point of the middle one is out of place.  Each tile's strongest response is
    its own: tenfold from one tile to the next."""
    e = ls.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    e = e.withColumn("section_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SECTIONS - 1).cast("long"))))
    s, i = F.col("section_id"), F.col("id")
    off = F.when((i % 10 == 0) & (s % 2 == 1), 3000).otherwise(0)
    x, y = (i * 7919) % 20011 + s * (120 + i % 5) + off, (i * 104729) % 20011 - s * (80 - i % 3)
    tile = i % TILES
    share = F.element_at(F.array(*map(F.lit, SHARES)), (F.floor(i / TILES) % len(SHARES) + 1).cast("int"))
    return e.select("section_id", "id", x.cast("double").alias("x"), y.cast("double").alias("y"), "v", tile.alias("tile_id"), (F.pow(F.lit(10.0), tile) * share).alias("response"))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = keypoints(spark, sf_dir)
    return k.where("section_id > 0"), volume.to_neighbour(k.where(F.col("section_id") < SECTIONS - 1))


def meshes(points: DataFrame, deformed: bool = True) -> tuple[DataFrame, DataFrame]:
    grid = me.hex_grid(volume.extent_of_points(points), KEYS, 6000)
    x, y = (F.col("x") + F.col("idx") % 13, F.col("y") - F.col("idx") % 7) if deformed else (F.col("x"), F.col("y"))
    points = grid.select("section_id", "idx", F.col("x").alias("x0"), F.col("y").alias("y0"), x.alias("x"), y.alias("y"))
    return written(points, "mesh")[0], written(me.hex_triangles(grid, KEYS), "triangles")[0]


def _box_sql(size: int, step: int) -> str:
    """Matches of boxes that agree with the step between the sections, which consensus has to find."""
    return f"""kp AS (SELECT CAST(s AS BIGINT) section_id, vec_id id, CAST((vec_id * 7919) % 20011 + s * (120 + vec_id % 5) + CASE WHEN vec_id % 10 = 0 AND s % 2 = 1 THEN 3000 ELSE 0 END AS DOUBLE) x,
    CAST((vec_id * 104729) % 20011 - s * (80 - vec_id % 3) AS DOUBLE) y, embedding v FROM embeddings, range(0, {SECTIONS}) t(s)),
  l AS (SELECT * FROM kp WHERE section_id > 0), r AS (SELECT section_id + 1 section_id, id, x, y, v FROM kp WHERE section_id < {SECTIONS - 1}),
  area AS (SELECT section_id, min(x) x0, max(x) x1, min(y) y0, max(y) y1 FROM l GROUP BY 1),
  boxes AS (SELECT section_id, CAST(i AS INTEGER) ix, CAST(j AS INTEGER) iy, x0 + i * {step} bx, y0 + j * {step} bys FROM area,
    range(0, CAST(ceil((x1 + {2 * step} - x0) / {step}.0::DOUBLE) AS BIGINT)) t(i), range(0, CAST(ceil((y1 + {2 * step} - y0) / {step}.0::DOUBLE) AS BIGINT)) u(j)),
  pa AS (SELECT b.section_id, ix, iy, id, x, y, v FROM boxes b JOIN l ON l.section_id = b.section_id AND x BETWEEN bx AND bx + {size} AND y BETWEEN bys AND bys + {size}),
  pb AS (SELECT b.section_id, ix, iy, id, x, y, v FROM boxes b JOIN r ON r.section_id = b.section_id AND x BETWEEN bx AND bx + {size} AND y BETWEEN bys AND bys + {size}),
  ok AS (SELECT section_id, ix, iy FROM pa GROUP BY ALL HAVING count(*) >= 12 INTERSECT SELECT section_id, ix, iy FROM pb GROUP BY ALL HAVING count(*) >= 12),
  d AS (SELECT a.section_id, a.ix, a.iy, a.id a, b.id b, a.x, a.y, b.x u, b.y w, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: pow(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE), 2)))) d
    FROM pa a JOIN pb b ON a.section_id = b.section_id AND a.ix = b.ix AND a.iy = b.iy SEMI JOIN ok ON ok.section_id = a.section_id AND ok.ix = a.ix AND ok.iy = a.iy),
  n2 AS (SELECT section_id, ix, iy, a, x, y, list({{'d': d, 'b': b, 'u': u, 'w': w}} ORDER BY d, b)[1:2] f FROM d GROUP BY ALL),
  good AS (SELECT section_id, ix, iy, a, x, y, f[1].b b, f[1].u u, f[1].w w FROM n2 WHERE len(f) = 2 AND f[1].d < 0.92::DOUBLE * f[2].d),
  many AS (SELECT section_id, ix, iy, count(*) total FROM good GROUP BY ALL HAVING count(*) >= 120),
  near AS (SELECT g.*, total FROM good g JOIN many m ON m.section_id = g.section_id AND m.ix = g.ix AND m.iy = g.iy WHERE sqrt(pow(x - 122 - u, 2) + pow(y + 79 - w, 2)) <= 64),
  kept AS (SELECT section_id, ix, iy, count(*) n FROM near GROUP BY ALL HAVING count(*) >= 12 AND count(*) >= 0.1 * any_value(total)),
  found AS (SELECT near.* FROM near JOIN kept k ON k.section_id = near.section_id AND k.ix = near.ix AND k.iy = near.iy)"""


@query(f"WITH {_box_sql(12000, 12000)} SELECT section_id, ix, iy, count(*) n, CAST(sum(a) AS BIGINT) ids FROM found GROUP BY ALL")
def box_matches(spark, sf_dir):
    """Matches in boxes that agree on an affine."""
    left, right = _sides(spark, sf_dir)
    boxes = volume._boxes(volume.extent_of_points(left), 12_000, 12_000, 24_000)
    return volume.box_matches(boxes, left, right).groupBy("section_id", "ix", "iy").agg(F.count("*").alias("n"), F.sum("a").alias("ids"))


@query(f"""WITH {_box_sql(48000, 24000)},
s AS (SELECT section_id, count(*) n, avg(x) mx, avg(y) my, avg(u) mu, avg(w) mw, var_pop(x) xx, var_pop(y) yy, covar_pop(x, y) xy, covar_pop(x, u) xu, covar_pop(y, u) yu, covar_pop(x, w) xw, covar_pop(y, w) yw FROM found GROUP BY 1),
m AS (SELECT *, (xu * yy - yu * xy) / (xx * yy - xy * xy) a00, (yu * xx - xu * xy) / (xx * yy - xy * xy) a01, (xw * yy - yw * xy) / (xx * yy - xy * xy) a10, (yw * xx - xw * xy) / (xx * yy - xy * xy) a11 FROM s)
SELECT section_id, n, round(a00, 5) + 0 a00, round(a01, 5) + 0 a01, round(mu - a00 * mx - a01 * my, 3) + 0 tx, round(a10, 5) + 0 a10, round(a11, 5) + 0 a11, round(mw - a10 * mx - a11 * my, 3) + 0 ty FROM m""")
def fine_affine(spark, sf_dir):
    """C11: one affine a section, pooled over boxes."""
    rows = volume.fine_affine(*_sides(spark, sf_dir))
    return rows.select("section_id", "n", *((F.round(c, 3 if c[0] == "t" else 5) + 0.0).alias(c) for c in volume.MODEL))  # no negative zeros


COARSE = f"""kp AS (SELECT CAST(s AS BIGINT) section_id, vec_id id, CAST((vec_id * 7919) % 20011 + s * (120 + vec_id % 5) + CASE WHEN vec_id % 10 = 0 AND s % 2 = 1 THEN 3000 ELSE 0 END AS DOUBLE) x,
    CAST((vec_id * 104729) % 20011 - s * (80 - vec_id % 3) AS DOUBLE) y, embedding v, vec_id % {TILES} tile, pow(10.0::DOUBLE, vec_id % {TILES}) * {list(SHARES)}[vec_id // {TILES} % {len(SHARES)} + 1]::DOUBLE response
    FROM embeddings, range(0, {SECTIONS}) t(s)),
  strong AS (SELECT * FROM kp QUALIFY response >= 0.99::DOUBLE * max(response) OVER (PARTITION BY section_id, tile)),
  d AS (SELECT a.section_id, a.id a, b.id b, a.x, a.y, b.x u, b.y w, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: pow(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE), 2)))) d
    FROM strong a JOIN strong b ON b.section_id = a.section_id - 1),
  good AS (SELECT section_id, a, x, y, f[1].b b, f[1].u u, f[1].w w FROM (SELECT section_id, a, x, y, list({{'d': d, 'b': b, 'u': u, 'w': w}} ORDER BY d, b)[1:2] f FROM d GROUP BY ALL) WHERE len(f) = 2 AND f[1].d < 0.92::DOUBLE * f[2].d),
  found AS (SELECT * FROM good WHERE sqrt(pow(x - 122 - u, 2) + pow(y + 79 - w, 2)) <= 64 QUALIFY count(*) OVER (PARTITION BY section_id) >= 32)"""


@query(f"""WITH {COARSE},
s AS (SELECT section_id, count(*) n, CAST(sum(a) AS BIGINT) ids, avg(x) mx, avg(y) my, avg(u) mu, avg(w) mw, var_pop(x) xx, var_pop(y) yy, covar_pop(x, y) xy, covar_pop(x, u) xu, covar_pop(y, u) yu, covar_pop(x, w) xw, covar_pop(y, w) yw FROM found GROUP BY 1),
m AS (SELECT *, (xu * yy - yu * xy) / (xx * yy - xy * xy) a00, (yu * xx - xu * xy) / (xx * yy - xy * xy) a01, (xw * yy - yw * xy) / (xx * yy - xy * xy) a10, (yw * xx - xw * xy) / (xx * yy - xy * xy) a11 FROM s)
SELECT section_id, n, ids, round(a00, 5) + 0 a00, round(a01, 5) + 0 a01, round(mu - a00 * mx - a01 * my, 3) + 0 tx, round(a10, 5) + 0 a10, round(a11, 5) + 0 a11, round(mw - a10 * mx - a11 * my, 3) + 0 ty FROM m""")
def coarse_alignment(spark, sf_dir):
    """What passes the strongest keypoints of each tile and both consensuses, and the affine."""
    k = keypoints(spark, sf_dir)
    found = coarse_matches(k.where("section_id > 0"), volume.to_neighbour(k.where(F.col("section_id") < SECTIONS - 1)), KEYS)
    ids = found.groupBy(*KEYS).agg(F.sum("a").alias("ids"))
    rows = matching.fit_affine(found, KEYS).join(ids, KEYS)
    return rows.select("section_id", "n", "ids", *((F.round(c, 3 if c[0] == "t" else 5) + 0.0).alias(c) for c in volume.MODEL))


def _located_sql(name: str, points: str, mesh: str, x: str, y: str) -> str:
    """``name``: of each point its triangle of least number in the mesh's columns x, y."""
    return f"""{name}_at AS MATERIALIZED (FROM {points}), {name}_flat AS MATERIALIZED (SELECT t.section_id, t.t, a.{x} ax, a.{y} ay, b.{x} bx, b.{y} bys, c.{x} cx, c.{y} cy, (b.{x} - a.{x}) * (c.{y} - a.{y}) - (c.{x} - a.{x}) * (b.{y} - a.{y}) twice
      FROM {mesh}_tris t JOIN {mesh} a ON a.section_id = t.section_id AND a.idx = t.i JOIN {mesh} b ON b.section_id = t.section_id AND b.idx = t.j JOIN {mesh} c ON c.section_id = t.section_id AND c.idx = t.k),
    {name} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY section_id, ix, iy, a, b ORDER BY t) rn FROM (
      SELECT *, ((bx - x) * (cy - y) - (cx - x) * (bys - y)) / twice q1, ((x - ax) * (cy - ay) - (cx - ax) * (y - ay)) / twice q2, ((bx - ax) * (y - ay) - (x - ax) * (bys - ay)) / twice q3 FROM (
        SELECT p.*, f.* EXCLUDE (section_id) FROM {name}_at p JOIN {name}_flat f ON f.section_id = p.section_id))
      WHERE q1 >= 0 AND q2 >= 0 AND q3 >= 0) WHERE rn = 1)"""


def _mesh_sql(name: str, points: str) -> str:
    text = ls.MESH.split("\n", 1)[1]
    for old in ("dims", "grid", "mesh", "tris"):
        text = text.replace(f"{old} AS (", f"{name if old == 'mesh' else f'{name}_{old}'} AS (").replace(f"FROM {old}", f"FROM {name}_{old}")
    text = text.replace("FROM ext", f"FROM {name}_ext").replace("x + idx % 13 * 10 x", "x + idx % 13 x").replace("y - idx % 7 * 10 y", "y - idx % 7 y")
    return f"{name}_ext AS (SELECT section_id, min(x) x0, max(x) x1, min(y) y0, max(y) y1 FROM {points} GROUP BY 1),\n{text}"


@query(f"""WITH {_box_sql(12000, 12000)}, {_mesh_sql("own", "l")}, {_mesh_sql("other", "r")},
pts AS (SELECT f.* FROM found f JOIN kept k ON k.section_id = f.section_id AND k.ix = f.ix AND k.iy = f.iy AND k.n > 12),
{_located_sql("mine", "pts", "own", "x", "y")},
inner_ AS (SELECT section_id, ix, iy, a, b, x, y, u, w, t AS mine_t, q1 AS m1 FROM mine WHERE q1 > 0 AND q2 > 0 AND q3 > 0),
{_located_sql("theirs", "inner_", "other", "x0", "y0")}
SELECT section_id, count(*) n, CAST(sum(mine_t) AS BIGINT) own_t, CAST(sum(t) AS BIGINT) other_t, round(sum(m1), 4) weights FROM theirs
WHERE ((bx - u) * (cy - w) - (cx - u) * (bys - w)) / twice > 0 AND ((u - ax) * (cy - ay) - (cx - ax) * (w - ay)) / twice > 0 AND ((bx - ax) * (w - ay) - (u - ax) * (bys - ay)) / twice > 0 GROUP BY 1""")
def elastic_matches(spark, sf_dir):
    """Matches with their triangles in both meshes."""
    left, right = _sides(spark, sf_dir)
    (mesh, triangles), (other, other_triangles) = meshes(left), meshes(right)
    found = volume.elastic_matches(left, right, mesh, other, triangles, other_triangles)
    return found.groupBy("section_id").agg(F.count("*").alias("n"), F.sum("t").alias("own_t"), F.sum("other_t").alias("other_t"), F.round(F.sum("u"), 4).alias("weights"))


@query()
def aligned_sections(spark, sf_dir):
    """The sections' meshes aligned to their neighbours, and the chain of them."""
    left, right = _sides(spark, sf_dir)
    (mesh, triangles), (other, other_triangles) = meshes(left, False), meshes(right, False)
    own = volume.align_neighbours(left, right, mesh, triangles, other, other_triangles, coarse_affine)
    return volume.chained(own, triangles, range(1, SECTIONS))
