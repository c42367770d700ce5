"""Extension of a mesh's border against the larger grid, and its descent to rest."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import mesh

KEYS = ["section_id"]
BOX = "section_id long, x_start double, x_finish double, y_start double, y_finish double"


def made(spark, box, spacing=10.0):
    extent = spark.createDataFrame([(0, 0.0, 40.0, 0.0, 25.0), (1, 5.0, 30.0, 3.0, 19.0)], BOX)
    grid = mesh.hex_grid(extent, KEYS, spacing, pad=1)
    return grid, spark.createDataFrame([(s, *box) for s in (0, 1)], BOX)


@pytest.mark.parametrize("box", [(-60.0, 90.0, -50.0, 75.0), (0.0, 10.0, 0.0, 10.0), (-33.0, 10.0, 0.0, 200.0)])
def test_extension_is_the_rest_of_the_larger_grid(spark, box):
    grid, larger = made(spark, box)
    points, fresh = mesh.border_extension(grid, larger, KEYS, 10.0)
    for s in (0, 1):
        old = {r.idx: (r.x, r.y) for r in grid.where(f"section_id = {s}").collect()}
        new = {r.idx: (r.x, r.y) for r in points.where(f"section_id = {s}").collect()}
        assert not set(old) & set(new) and sorted(new) == list(range(len(old), len(old) + len(new)))
        at = old | new
        places = {p for p in at.values()}
        assert len(places) == len(at)
        xs, ys = [x for x, _ in places], [y for _, y in places]
        assert min(xs) <= min(box[0], min(x for x, _ in old.values()) - 10) and max(xs) >= box[1] and min(ys) <= box[2] and max(ys) >= box[3]
        own = [(r.t, frozenset((r.i, r.j, r.k))) for r in mesh.hex_triangles(grid, KEYS).where(f"section_id = {s}").collect()]
        more = [(r.t, frozenset((r.i, r.j, r.k))) for r in fresh.where(f"section_id = {s}").collect()]
        faces = own + more
        assert len({t for t, _ in faces}) == len({v for _, v in faces}) == len(faces) and all(max(v) >= len(old) for _, v in more)
        # together they are the lattice: two to each pair of neighbours in two rows, all turned alike, without gaps
        wide, high = len({x for x, y in places if (y - min(ys)) % 15 < 1}), len(set(ys))
        assert len(faces) == 2 * (wide - 1) * (high - 1)
        area = sum(abs((at[b][0] - at[a][0]) * (at[c][1] - at[a][1]) - (at[c][0] - at[a][0]) * (at[b][1] - at[a][1])) / 2 for a, b, c in (tuple(v) for _, v in faces))
        assert area == pytest.approx((wide - 1) * 10 * (high - 1) * 7.5)


def test_old_points_stay_and_new_ones_come_to_rest(spark):
    grid, larger = made(spark, (-30.0, 60.0, -25.0, 45.0))
    bent = grid.select(*KEYS, "idx", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("idx") % 3 * 0.5).alias("x"), (F.col("y") - F.col("idx") % 2 * 0.4).alias("y"))
    out, faces = mesh.expanded_mesh(bent, mesh.hex_triangles(grid, KEYS), grid, larger, KEYS, 10.0)
    was = {(r.section_id, r.idx): (r.x, r.y) for r in bent.collect()}
    rows = {(r.section_id, r.idx): r for r in out.collect()}
    assert all((rows[k].x, rows[k].y) == v for k, v in was.items()) and all(r.settled for r in rows.values())
    for s in (0, 1):
        ids = sorted(i for k, i in rows if k == s)
        x0, x = (np.array([[getattr(rows[s, i], a + b) for a in "xy"] for i in ids]) for b in ("0", ""))
        tris = np.array([[r.i, r.j, r.k] for r in faces.where(f"section_id = {s}").collect()])
        edges = np.unique(np.sort(np.concatenate([tris[:, [0, 1]], tris[:, [1, 2]], tris[:, [0, 2]]]), axis=1), axis=0)
        cost = mesh._energy(x0, edges, tris, 1.0, 1.0, lambda _, __: 0.0)
        free = np.array([(s, i) not in was for i in ids])
        here = cost(x)[0]
        for i in np.flatnonzero(free)[::7]:  # no new point finds less energy nearby
            for step in np.array([[1, 0], [-1, 0], [0, 1], [0, -1]]) * 0.05:
                moved = x.copy()
                moved[i] += step
                assert cost(moved)[0] >= here - 1e-7
    assert np.abs([rows[k].x - rows[k].x0 for k in rows if k not in was]).max() > 0


def test_affine_places_new_points(spark):
    grid, larger = made(spark, (-30.0, 60.0, -25.0, 45.0))
    m = {"a00": 1.1, "a01": 0.1, "tx": 3.0, "a10": -0.05, "a11": 0.95, "ty": -2.0}
    put = mesh.affine_mesh(grid.select(*KEYS, "idx", F.col("x").alias("x0"), F.col("y").alias("y0"), "x", "y").withColumns({k: F.lit(v) for k, v in m.items()}), tuple(m))
    models = larger.select("section_id", *(F.lit(v).alias(k) for k, v in m.items())).where("section_id = 0")
    out, _ = mesh.expanded_mesh(put.select(*KEYS, "idx", "x0", "y0", "x", "y"), mesh.hex_triangles(grid, KEYS), grid, larger, KEYS, 10.0, models, most=1)
    added = [r for r in out.where("section_id = 0").collect() if r.idx >= grid.where("section_id = 0").count()]
    assert added and all(abs(r.x - (1.1 * r.x0 + 0.1 * r.y0 + 3)) < 0.5 and abs(r.y - (-0.05 * r.x0 + 0.95 * r.y0 - 2)) < 0.5 for r in added)
