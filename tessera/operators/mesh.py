"""Triangle meshes over sections: hexagonal grids, edges, elastic transforms and descent.

Points: keys, idx, x0, y0 (original), x, y (deformed).  Triangles: keys, t, i, j, k (indices).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.operators.spatial import BOX, points_in_triangles
from tessera.operators.tables import delete, written


def hex_grid(extent: DataFrame, keys: Sequence[str], spacing: float, *, pad: int = 3) -> DataFrame:
    """Points of a hexagonal grid over each key's extent, padded by ``pad`` spacings:
    rows three quarters of a spacing apart, odd rows shifted by half a spacing."""
    rise = spacing * 0.75
    wide = F.ceil((F.col(BOX[1]) - F.col(BOX[0])) / spacing).cast("long") + 2 * pad
    high = F.ceil((F.col(BOX[3]) - F.col(BOX[2])) / rise).cast("long") + 2 * pad
    grid = extent.select(*keys, *BOX, wide.alias("cols"), high.alias("rows"))
    grid = grid.withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))).withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cols") - 1)))
    x = F.col(BOX[0]) + (F.col("c") - pad) * spacing + F.when(F.col("r") % 2 == 1, spacing / 2).otherwise(0.0)
    y = F.col(BOX[2]) + (F.col("r") - pad) * rise
    return grid.select(*keys, (F.col("r") * F.col("cols") + F.col("c")).alias("idx"), "r", "c", "cols", "rows", x.alias("x"), y.alias("y"))


def hex_triangles(grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The triangles of the grid, in closed form: two to each pair of neighbours in two rows."""
    i, cols, odd = F.col("idx"), F.col("cols"), F.col("r") % 2 == 1
    inner = grid.where((F.col("r") < F.col("rows") - 1) & (F.col("c") < F.col("cols") - 1))
    up = F.when(odd, F.array(i, i + 1, i + cols + 1)).otherwise(F.array(i, i + 1, i + cols))
    down = F.when(odd, F.array(i, i + cols + 1, i + cols)).otherwise(F.array(i + 1, i + cols + 1, i + cols))
    both = inner.select(*keys, "idx", F.posexplode(F.array(up, down)).alias("side", "p"))
    return both.select(*keys, (F.col("idx") * 2 + F.col("side")).alias("t"), F.col("p")[0].alias("i"), F.col("p")[1].alias("j"), F.col("p")[2].alias("k"))


def mesh_edges(triangles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct undirected edges of the triangles."""
    pairs = F.array(*(F.struct(F.least(a, b).alias("i"), F.greatest(a, b).alias("j")) for a, b in (("i", "j"), ("j", "k"), ("i", "k"))))
    return triangles.select(*keys, F.explode(pairs).alias("e")).select(*keys, "e.i", "e.j").distinct()


def with_corners(triangles: DataFrame, points: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The triangles with ``columns`` of their corners, named a_, b_ and c_."""
    for corner, index in zip("abc", "ijk"):
        own = points.select(*keys, F.col("idx").alias(index), *(F.col(c).alias(f"{corner}_{c}") for c in columns))
        triangles = triangles.join(own, [*keys, index])
    return triangles


def located(points: DataFrame, triangles: DataFrame, mesh: DataFrame, keys: Sequence[str], cell: float, *, xy=("x0", "y0"), outer: bool = False) -> DataFrame:
    """C17: points (keys, point_id, x, y) with the triangle of the mesh that holds them."""
    corner = with_corners(triangles, mesh, keys, xy)
    flat = corner.select(*keys, "t", *(F.col(f"{c}_{xy[k]}").alias(f"{c}{'xy'[k]}") for c in "abc" for k in (0, 1)))
    return points_in_triangles(points, flat, keys, cell, outer=outer)


def elastic_transform(points: DataFrame, triangles: DataFrame, mesh: DataFrame, keys: Sequence[str], cell: float) -> DataFrame:
    """Points through the deformation of the triangle that holds them; others stay."""
    hit = located(points, triangles, mesh, keys, cell, outer=True).select(*points.columns, "t", "u", "v", "w")
    deformed = with_corners(triangles, mesh, keys, ("x", "y")).select(*keys, "t", *(f"{c}_{a}" for c in "abc" for a in "xy"))
    moved = hit.join(deformed, [*keys, "t"], "left")
    new = {a: F.coalesce(F.col("u") * F.col(f"a_{a}") + F.col("v") * F.col(f"b_{a}") + F.col("w") * F.col(f"c_{a}"), F.col(a)) for a in "xy"}
    return moved.select(*(c for c in points.columns if c not in ("x", "y")), new["x"].alias("x"), new["y"].alias("y"), F.col("t").isNotNull().alias("moved"))


def affine_mesh(mesh: DataFrame, m) -> DataFrame:
    """Deformed points of a mesh through an affine."""
    x, y = g.affine("x", "y", m)
    return mesh.withColumns({"x": x, "y": y})


def flips(triangles: DataFrame, mesh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Triangles of each key, and how many of them turned over."""
    corner = with_corners(triangles, mesh, keys, ("x0", "y0", "x", "y"))
    sides = [[(f"{c}_{x}", f"{c}_{y}") for c in "abc"] for x, y in (("x0", "y0"), ("x", "y"))]
    return corner.groupBy(*keys).agg(F.count("*").alias("triangles"), F.count_if(g.flipped(*sides)).alias("flipped"))


def _energy(x0: np.ndarray, edges: np.ndarray, triangles: np.ndarray, spring: float, area: float, links: Callable):
    """Cost and gradient at points: springs on the edges, the triangles' relative areas, and
    ``links``, which adds its gradient to the given one and returns its cost."""
    rest = np.sqrt(((x0[edges[:, 0]] - x0[edges[:, 1]]) ** 2).sum(1) + 1e-4)

    def areas(x):
        a, b, c = (x[triangles[:, i]] for i in range(3))
        return 0.5 * ((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (c[:, 0] - a[:, 0]) * (b[:, 1] - a[:, 1]))

    area0 = areas(x0)

    def cost(x):
        grad = np.zeros_like(x)
        d = x[edges[:, 0]] - x[edges[:, 1]]
        length = np.sqrt((d * d).sum(1) + 1e-4)
        gap = length - rest
        pull = spring * (2 * gap / length)[:, None] * d / len(edges)
        np.add.at(grad, edges[:, 0], pull)
        np.add.at(grad, edges[:, 1], -pull)
        total = spring * float((gap * gap).mean())
        ratio = areas(x) / area0 - 1
        total += area * float((ratio * ratio).mean())
        for i in range(3):
            b, c = x[triangles[:, (i + 1) % 3]], x[triangles[:, (i + 2) % 3]]
            side = np.stack([b[:, 1] - c[:, 1], c[:, 0] - b[:, 0]], 1) * 0.5
            np.add.at(grad, triangles[:, i], area * 2 * (ratio / area0)[:, None] * side / len(triangles))
        return total + links(x, grad), grad

    return cost


def _huber_links(triangles: np.ndarray, links: tuple[np.ndarray, np.ndarray, np.ndarray], cross: float, sigma: float) -> Callable:
    """Mean Huber loss of links: triangle, weights, and where the point should be."""
    tri, weights, target = links

    def add(x, grad):
        if not len(tri):
            return 0.0
        p = (weights[:, :, None] * x[triangles[tri]]).sum(1) - target
        r = np.sqrt((p * p).sum(1) + 1e-12)
        near = r <= sigma
        slope = cross * (np.where(near, r, sigma) / r)[:, None] * p / len(tri)
        for i in range(3):
            np.add.at(grad, triangles[tri, i], weights[:, i : i + 1] * slope)
        return cross * float(np.where(near, r * r / 2, sigma * (r - sigma / 2)).mean())

    return add


#: Sums a triangle: products of its links' weights, of weights and targets, and of targets.
FORMS = (*(f"{a}{b}" for a, b in ("uu", "uv", "uw", "vv", "vw", "ww")), *(f"{a}{b}" for a in "uvw" for b in "xy"), "dd")


def _square_links(triangles: np.ndarray, tri: np.ndarray, forms: np.ndarray, cross: float, n: float) -> Callable:
    """Mean of half the squared distances, by the sums of each triangle."""
    pairs = forms[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3)
    target, squares = forms[:, 6:12].reshape(-1, 3, 2), float(forms[:, 12].sum())

    def add(x, grad):
        if not len(tri):
            return 0.0
        corner = x[triangles[tri]]
        moved = pairs @ corner
        slope = cross * (moved - target) / n
        for i in range(3):
            np.add.at(grad, triangles[tri, i], slope[:, i])
        return cross * (float((corner * (moved - 2 * target)).sum()) + squares) / (2 * n)

    return add


def _descended(cost: Callable, x: np.ndarray, most: int, step: float, grow: float = 1.01, cut: float = 0.95, free: np.ndarray | None = None) -> tuple[np.ndarray, bool]:
    """Descent with momentum, steps grown and, with the move taken back, cut, and whether it met the
    stopping rule within ``most`` steps; only ``free`` points move."""
    open_ = 1.0 if free is None else free[:, None].astype(float)
    x, velocity, done = x.copy(), np.zeros_like(x), False
    best, grad = cost(x)
    for _ in range(most):
        velocity = 0.9 * velocity - step * grad * len(x) * open_
        after, new = cost(x + velocity)
        if after <= best:
            done = best - after < 1e-12 * max(best, 1e-12)
            x, best, grad, step = x + velocity, after, new, step * grow
            if done:
                break
        else:
            velocity, step = np.zeros_like(velocity), step * cut
            if step < 1e-12:
                break
    return x, done


def elastic_settling(
    x0: np.ndarray, edges: np.ndarray, triangles: np.ndarray, links: tuple[np.ndarray, np.ndarray, np.ndarray], *, spring: float = 1.0, area: float = 1.0, cross: float = 1.0,
    sigma: float = 10.0, most: int = 10_000, step: float = 1e-3,
) -> tuple[np.ndarray, bool]:
    """Points of least energy of one small mesh with its links at hand.  Returns the points
    and whether the stopping rule was met within ``most`` steps."""
    return _descended(_energy(x0, edges, triangles, spring, area, _huber_links(triangles, links, cross, sigma)), x0, most, step)


def elastic_descent(x0: np.ndarray, edges: np.ndarray, triangles: np.ndarray, links: tuple[np.ndarray, np.ndarray, np.ndarray], **settings) -> np.ndarray:
    """The points of ``elastic_settling``."""
    return elastic_settling(x0, edges, triangles, links, **settings)[0]


def _link_forms(links: DataFrame, triangles: DataFrame, mesh: DataFrame, keys: Sequence[str], sigma: float) -> DataFrame:
    """Sums of each triangle's links, a link beyond ``sigma`` weighed by sigma over its distance, so
    that the squares touch the Huber losses from above; n links, and their loss."""
    met = links.join(with_corners(triangles.select(*keys, "t", "i", "j", "k"), mesh, keys, ("x", "y")), [*keys, "t"])
    at = {a: sum((F.col(w) * F.col(f"{corner}_{a}") for w, corner in zip("vw", "bc")), F.col("u") * F.col(f"a_{a}")) - F.col(f"dst_{a}") for a in "xy"}
    r = F.sqrt(at["x"] * at["x"] + at["y"] * at["y"] + F.lit(1e-12))
    own = met.withColumn("r", r).withColumn("q", F.least(F.lit(1.0), F.lit(sigma) / F.col("r")))
    names = {"u": F.col("u"), "v": F.col("v"), "w": F.col("w"), "x": F.col("dst_x"), "y": F.col("dst_y")}
    sums = [F.sum(F.col("q") * names[f[0]] * names[f[1]]).alias(f) for f in FORMS[:-1]]
    squares = F.sum(F.col("q") * (F.col("dst_x") * F.col("dst_x") + F.col("dst_y") * F.col("dst_y"))).alias("dd")
    return own.groupBy(*keys, "t").agg(*sums, squares, F.count("*").cast("double").alias("n"), F.sum(g.huber("r", sigma)).alias("loss"))


def elastic_meshes(
    mesh: DataFrame, triangles: DataFrame, links: DataFrame, keys: Sequence[str], *, spring: float = 1.0, area: float = 1.0, cross: float = 1.0, sigma: float = 10.0, most: int = 10_000,
    step: float = 1e-3, grow: float = 1.01, cut: float = 0.95, turns: int = 60, still: float = 1e-9,
) -> DataFrame:
    """Deformed mesh of each key, from x, y where the mesh has them, else from x0, y0; ``settled``
    says whether it came to rest.  Links: keys, t, u, v, w, dst_x, dst_y.

    Links stay dealt out: each turn sums them for every triangle, in squares that touch their Huber
    losses from above at the present mesh, and only the sums (13 numbers a triangle) meet the mesh,
    which has some hundred points whatever the number of tiles.  The energy falls every turn; a key
    is at rest once its descent met the stopping rule and the next turn begins with an energy lower by
    under ``still`` of itself.  Where the mesh has a column ``free``, the
    other points stay."""
    names, spark = list(keys), mesh.sparkSession
    start = {a: F.col(a if a in mesh.columns else f"{a}0").cast("double") for a in "xy"}
    begun = mesh.select(*names, F.col("idx").cast("long").alias("idx"), F.col("x0").cast("double").alias("x0"), F.col("y0").cast("double").alias("y0"), start["x"].alias("x"), start["y"].alias("y"))
    begun = begun.withColumn("free", F.lit(True)) if "free" not in mesh.columns else mesh.select(*names, F.col("idx").cast("long").alias("idx"), "free").join(begun, [*names, "idx"])
    state, at = written(begun.withColumns({"energy": F.lit(None).cast("double"), "rest": F.lit(False), "settled": F.lit(False)}), "elastic")
    columns = state.columns
    whole, whole_at = written(links.select(*names, "t", "u", "v", "w", "dst_x", "dst_y"), "links")
    tris = triangles.select(*names, "t", "i", "j", "k")

    def descend(points: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        p, t = points.sort_values("idx"), rows.sort_values("t")
        if not len(p) or p.settled.iloc[0]:
            return p[columns]
        if not len(t):
            return p.assign(settled=True)[columns]
        x0, x = p[["x0", "y0"]].to_numpy(), p[["x", "y"]].to_numpy()
        corners = np.searchsorted(p.idx.to_numpy(), t[["i", "j", "k"]].to_numpy())
        edges = np.unique(np.sort(np.concatenate([corners[:, [0, 1]], corners[:, [1, 2]], corners[:, [0, 2]]]), axis=1), axis=0)
        tri = np.flatnonzero(t.n.notna())
        held, n = t.iloc[tri], max(t.n.sum(), 1.0)
        cost = _energy(x0, edges, corners, spring, area, _square_links(corners, tri, held[list(FORMS)].to_numpy(), cross, n))
        energy = _energy(x0, edges, corners, spring, area, lambda _, __: cross * held.loss.sum() / n)(x)[0]
        before = p.energy.iloc[0]
        if p.rest.iloc[0] and before - energy <= still * max(energy, 1e-12):
            return p.assign(energy=energy, settled=True)[columns]
        moved, rest = _descended(cost, x, most, step, grow, cut, p.free.to_numpy(bool))
        return p.assign(x=moved[:, 0], y=moved[:, 1], energy=energy, rest=rest)[columns]

    for _ in range(turns):
        if not state.where(~F.col("settled")).take(1):
            break
        forms = tris.join(_link_forms(whole, tris, state, names, sigma), [*names, "t"], "left")
        after, now = written(state.groupBy(*names).cogroup(forms.groupBy(*names)).applyInPandas(descend, state.schema), "elastic")
        delete(spark, at)
        state, at = after, now
    delete(spark, whole_at)
    return state.select(*names, "idx", "x0", "y0", "x", "y", "settled")


def border_settled(mesh: DataFrame, triangles: DataFrame, keys: Sequence[str], **settings) -> DataFrame:
    """I8: the points of a mesh that are ``free`` (those new at its border) settled by springs and
    areas alone, the others held; steps grow by a tenth and are halved."""
    none = mesh.sparkSession.createDataFrame([], "t long, u double, v double, w double, dst_x double, dst_y double")
    types = {f.name: f.dataType for f in mesh.schema}
    links = none.select(*(F.lit(None).cast(types[k]).alias(k) for k in keys), *none.columns)
    return elastic_meshes(mesh, triangles, links, keys, grow=1.1, cut=0.5, **settings)


def _lattice_index(r, c) -> Column:
    """Index of a lattice place: an old point's own, then the new ones row by row."""
    cols, rows = F.col("cols"), F.col("rows")
    place = (r + F.col("up")) * (cols + F.col("left") + F.col("right")) + c + F.col("left")
    before = F.when(r < 0, F.lit(0)).when(r >= rows, rows * cols).otherwise(r * cols + F.least(F.greatest(c, F.lit(0)), cols))
    old = (r >= 0) & (r < rows) & (c >= 0) & (c < cols)
    return F.when(old, r * cols + c).otherwise(rows * cols + place - before)


def border_extension(grid: DataFrame, box: DataFrame, keys: Sequence[str], spacing: float) -> tuple[DataFrame, DataFrame]:
    """The points and triangles that a hexagonal grid (as from ``hex_grid``) lacks to cover a larger
    ``box`` of each key: at least a column and two rows on every side.

    Points carry on the grid's lattice and are numbered after the old ones, row by row; triangles are
    those of the larger lattice that have a new corner, numbered after the old ones too, so none stands
    twice and no old index changes.  All is in closed form, without a join to the old mesh.  Returns
    points (keys, idx, x, y) and triangles (keys, t, i, j, k)."""
    rise = spacing * 0.75
    whole = grid.groupBy(*keys).agg(F.max("cols").alias("cols"), F.max("rows").alias("rows"), F.min("x").alias("ox"), F.min("y").alias("oy"))
    high, low = F.col("oy") + (F.col("rows") - 1) * rise, F.col("oy")
    wide = F.col("ox") + (F.col("cols") - 1) * spacing

    def more(apart, step: float, least: int):
        return F.greatest(F.ceil(apart / step).cast("long"), F.lit(least).cast("long"))

    own = whole.join(box.select(*keys, *BOX), list(keys)).withColumns(
        {"left": more(F.col("ox") - F.col(BOX[0]), spacing, 1), "right": more(F.col(BOX[1]) - wide, spacing, 1), "up": more(low - F.col(BOX[2]), rise, 2), "down": more(F.col(BOX[3]) - high, rise, 2)}
    )
    r, c = F.col("r"), F.col("c")
    places = own.withColumn("r", F.explode(F.sequence(-F.col("up"), F.col("rows") - 1 + F.col("down")))).withColumn("c", F.explode(F.sequence(-F.col("left"), F.col("cols") - 1 + F.col("right"))))
    odd = F.pmod(r, F.lit(2)) == 1
    new = (r < 0) | (r >= F.col("rows")) | (c < 0) | (c >= F.col("cols"))
    x = F.col("ox") + c * spacing + F.when(odd, spacing / 2).otherwise(0.0)
    points = places.where(new).select(*keys, _lattice_index(r, c).alias("idx"), x.alias("x"), (F.col("oy") + r * rise).alias("y"))

    inner = places.where((r < F.col("rows") - 1 + F.col("down")) & (c < F.col("cols") - 1 + F.col("right")))
    at = {(i, j): _lattice_index(r + i, c + j) for i in (0, 1) for j in (0, 1)}
    up = F.when(odd, F.array(at[0, 0], at[0, 1], at[1, 1])).otherwise(F.array(at[0, 0], at[0, 1], at[1, 0]))
    down = F.when(odd, F.array(at[0, 0], at[1, 1], at[1, 0])).otherwise(F.array(at[0, 1], at[1, 1], at[1, 0]))
    both = inner.select(*keys, "rows", "cols", ((r + F.col("up")) * (F.col("cols") + F.col("left") + F.col("right")) + c + F.col("left")).alias("place"), F.posexplode(F.array(up, down)).alias("side", "p"))
    number = 2 * F.col("rows") * F.col("cols") + 2 * F.col("place") + F.col("side")
    fresh = both.where(F.array_max("p") >= F.col("rows") * F.col("cols"))
    return points, fresh.select(*keys, number.alias("t"), F.col("p")[0].alias("i"), F.col("p")[1].alias("j"), F.col("p")[2].alias("k"))


def expanded_mesh(mesh: DataFrame, triangles: DataFrame, grid: DataFrame, box: DataFrame, keys: Sequence[str], spacing: float, models: DataFrame | None = None, **settings) -> tuple[DataFrame, DataFrame]:
    """A mesh carried on over a larger box: G7's points go where the section's affine (``models``:
    keys and the six numbers; none: where they are) takes them, and settle by I8, old points held.
    Returns the whole mesh (keys, idx, x0, y0, x, y, settled) and its triangles."""
    names = list(keys)
    points, fresh = border_extension(grid, box, keys, spacing)
    model = ("a00", "a01", "tx", "a10", "a11", "ty")
    moved = points.withColumns({c: F.lit(v) for c, v in zip(model, g.IDENTITY)}) if models is None else points.join(models.select(*names, *model), names, "left").fillna(dict(zip(model, g.IDENTITY)))
    x, y = g.affine("x", "y", model)
    added = moved.select(*names, "idx", F.col("x").alias("x0"), F.col("y").alias("y0"), x.alias("x"), y.alias("y"), F.lit(True).alias("free"))
    whole = mesh.select(*names, "idx", "x0", "y0", "x", "y", F.lit(False).alias("free")).unionByName(added)
    faces = triangles.select(*names, "t", "i", "j", "k").unionByName(fresh)
    whole, whole_at = written(whole, "expanded")
    faces, _ = written(faces, "faces")
    out = border_settled(whole, faces, keys, **settings)
    delete(mesh.sparkSession, whole_at)
    return out, faces
