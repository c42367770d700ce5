"""Rendering of tiles through a section's mesh (R1, R3): warped patches, and their mosaic by blocks.

A tile is one row with the triangles that its box meets; its pixels are warped in blocks: one of
under ``SMALL`` pixels whose corners lie in one triangle takes that triangle's affine, others split,
and only what is left when blocks are ``LEAST`` pixels long is located pixel by pixel.  Patches are
cut at output blocks of bounded size, so a mosaic gathers the few tiles that cover a block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.operators.mesh import with_corners
from tessera.operators.raster import image_of, spread_out
from tessera.operators.spatial import BOX, box_join

#: A block may take one affine below so many pixels, and isn't split at so many.
SMALL, LEAST = 128, 8
#: Pixels of an output block's side.
BLOCK = 1024
CORNERS = tuple(f"{c}_{a}" for c in "abc" for a in ("x0", "y0", "x", "y"))
MODEL = ("a00", "a01", "tx", "a10", "a11", "ty")


class Triangles:
    """Triangles by number, with the affine of each from its original to its deformed corners."""

    def __init__(self, number: np.ndarray, corners: np.ndarray):
        order = np.argsort(number, kind="stable")
        c = corners[order].reshape(-1, 3, 4)
        (ax, ay), (bx, by), (cx, cy) = c[:, 0, :2].T, c[:, 1, :2].T, c[:, 2, :2].T
        twice = (bx - ax) * (cy - ay) - (cx - ax) * (by - ay)
        good = twice != 0
        ax, ay, bx, by, cx, cy, twice, c = (v[good] for v in (ax, ay, bx, by, cx, cy, twice, c))
        # each corner's weight as a linear function of the point
        self.weights = np.stack([
            np.stack([by - cy, cx - bx, bx * cy - cx * by], 1), np.stack([cy - ay, ax - cx, cx * ay - ax * cy], 1), np.stack([ay - by, bx - ax, ax * by - bx * ay], 1)
        ], 1) / twice[:, None, None]
        self.affine = np.einsum("tkw,tkd->tdw", self.weights, c[:, :, 2:])
        self.located = 0

    def inside(self, which: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        w = self.weights[which]
        return (w[..., 0] * x[:, None] + w[..., 1] * y[:, None] + w[..., 2] >= -1e-9).all(1)

    def find(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The first triangle that holds each point, or -1."""
        self.located += len(x)
        found = np.full(len(x), -1)
        for t in range(len(self.weights) - 1, -1, -1):
            found[self.inside(np.full(len(x), t), x, y)] = t
        return found

    def move(self, which: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Points through their triangles' affines; those of none stay."""
        m = np.where((which >= 0)[:, None, None], self.affine[which] if len(self.affine) else 0.0, np.array([[1.0, 0, 0], [0, 1, 0]]))
        return m[:, 0, 0] * x + m[:, 0, 1] * y + m[:, 0, 2], m[:, 1, 0] * x + m[:, 1, 1] * y + m[:, 1, 2]


def _halves(b: np.ndarray) -> np.ndarray:
    """Blocks (x0, y0, x1, y1) cut across their longer side; the first half has the odd pixel."""
    wide = b[:, 2] - b[:, 0] > b[:, 3] - b[:, 1]
    first, second = b.copy(), b.copy()
    for side, which in ((0, wide), (1, ~wide)):
        half = (b[which, side + 2] - b[which, side]) // 2
        first[which, side + 2] -= half
        second[which, side] = first[which, side + 2]
    return np.concatenate([first, second])


def warped(shape: tuple[int, int], start: tuple[float, float], scale: float, model: Sequence[float], triangles: Triangles) -> tuple[np.ndarray, np.ndarray]:
    """Output column and row of each pixel of a tile that starts at ``start`` and whose pixels are
    ``scale`` apart: through the section's affine, then through the mesh."""
    h, w = shape
    out = np.empty((2, h, w), np.int32)

    def placed(px: np.ndarray, py: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y = px * scale + start[0], py * scale + start[1]
        return model[0] * x + model[1] * y + model[2], model[3] * x + model[4] * y + model[5]

    def put(px: np.ndarray, py: np.ndarray, which: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        for k, v in enumerate(triangles.move(which, x, y)):
            out[k, py, px] = np.trunc(v / scale + 0.5)

    todo = np.array([[0, 0, w, h]])
    while len(todo):
        size = todo[:, 2:] - todo[:, :2]
        small = (size < SMALL).all(1)
        one = np.full(len(todo), -1)
        if small.any():
            corners = [placed(todo[small, i], todo[small, j]) for i in (0, 2) for j in (1, 3)]
            first = triangles.find(*corners[0])
            alike = first >= 0
            for x, y in corners[1:]:
                alike &= triangles.inside(first, x, y) if len(triangles.weights) else False
            one[small] = np.where(alike, first, -1)
        for (x0, y0, x1, y1), t in zip(todo[one >= 0].tolist(), one[one >= 0].tolist()):
            py, px = (v.ravel() for v in np.mgrid[y0:y1, x0:x1])
            put(px, py, np.full(len(px), t), *placed(px, py))
        rest = one < 0
        split = rest & (size.max(1) > LEAST)
        for x0, y0, x1, y1 in todo[rest & ~split].tolist():
            py, px = (v.ravel() for v in np.mgrid[y0:y1, x0:x1])
            x, y = placed(px, py)
            put(px, py, triangles.find(x, y), x, y)
        todo = _halves(todo[split])
    return out[0], out[1]


_PATCH = "bx long, by long, x0 int, y0 int, width int, pixels binary, covered binary"


def warp_tiles(tiles: DataFrame, triangles: DataFrame, mesh: DataFrame, keys: Sequence[str], *, scale: float = 1.0, block: int = BLOCK, cell: float = 6000) -> DataFrame:
    """Each tile's pixels where affine and mesh take them, as patches of output blocks.

    Tiles: keys, tile_id, data, width, x_start, x_finish, y_start, y_finish (of the pixels, which are
    ``scale`` apart), and, where the section has one, the affine's columns.  A pixel outside the mesh
    keeps its place; of pixels of one tile that meet, the last by row and column stays; a tile without
    pixels gives no patch.  The affine is applied before triangles are looked for.  Returns keys,
    tile_id, bx, by (output block), x0, y0 (in it), width, pixels, covered (bits)."""
    names = [*keys, "tile_id"]
    model = [F.col(c) if c in tiles.columns else F.lit(v) for c, v in zip(MODEL, g.IDENTITY)]
    own = tiles.select(*names, *BOX, F.array(*(m.cast("double") for m in model)).alias("model"))
    x0, y0, x1, y1 = g.affine_box(BOX[0], BOX[2], BOX[1], BOX[3], [F.col("model")[i] for i in range(6)])
    placed = own.select(*names, *(c.alias(n) for c, n in zip((x0, x1, y0, y1), BOX)))
    flat = with_corners(triangles, mesh, keys, ("x0", "y0", "x", "y"))
    bounds = [f(*(f"{c}_{a}0" for c in "abc")).alias(n) for a, n0, n1 in (("x", *BOX[:2]), ("y", *BOX[2:])) for f, n in ((F.least, n0), (F.greatest, n1))]
    met = box_join(placed, flat.select(*keys, "t", *CORNERS, *bounds), keys, cell)
    near = met.select(*(F.col(f"a.{k}").alias(k) for k in names), F.struct("b.t", F.array(*(F.col(f"b.{c}").cast("double") for c in CORNERS)).alias("corners")).alias("near"))
    grouped = near.groupBy(*names).agg(F.collect_list("near").alias("near"))  # triangles that a tile's box meets
    rows = tiles.select(*names, "data", "width", "x_start", "y_start").join(own.select(*names, "model"), names).join(grouped, names, "left")
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tiles.select(*names).schema)
    arrow = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    columns = [x.split()[0] for x in _PATCH.split(", ")]

    def patches(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> Iterator[tuple]:
        left, low = int(x.min()), int(y.min())
        value = np.zeros((int(y.max()) - low + 1, int(x.max()) - left + 1), np.uint8)
        hit = np.zeros(value.shape, bool)
        value[y - low, x - left] = image  # the last of those that meet
        hit[y - low, x - left] = True
        for by in range(low // block, (low + value.shape[0] - 1) // block + 1):
            for bx in range(left // block, (left + value.shape[1] - 1) // block + 1):
                y0, x0 = max(low, by * block), max(left, bx * block)
                cut = (slice(y0 - low, min((by + 1) * block - low, value.shape[0])), slice(x0 - left, min((bx + 1) * block - left, value.shape[1])))
                if hit[cut].any():
                    yield bx, by, x0 - bx * block, y0 - by * block, hit[cut].shape[1], value[cut].tobytes(), np.packbits(hit[cut]).tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).drop_columns(names).to_pylist()[0]
                image = image_of(r["data"], r["width"])
                if not image.size:
                    continue
                found = r["near"] or []
                mesh_ = Triangles(np.array([n["t"] for n in found]), np.array([n["corners"] for n in found], float).reshape(-1, 12))
                out = list(patches(image, *warped(image.shape, (r["x_start"], r["y_start"]), scale, r["model"], mesh_)))
                held = batch.select(names).take(pa.array(np.full(len(out), i)))
                yield pa.RecordBatch.from_arrays([*held.columns, *(pa.array([o[k] for o in out], t) for k, t in enumerate(arrow))], names=[*names, *columns])

    return spread_out(rows, *names).mapInArrow(work, f"{types}, {_PATCH}")


def mosaic(patches: DataFrame, keys: Sequence[str], *, block: int = BLOCK) -> DataFrame:
    """Output blocks, each pixel that of the largest tile_id that covers it, others zero: keys, bx,
    by, data, width, covered (pixels)."""
    names = [*keys, "bx", "by"]
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in patches.select(*names).schema)

    def lay(group: pa.Table) -> pa.Table:
        out, hit = np.zeros((block, block), np.uint8), np.zeros((block, block), bool)
        for r in sorted(group.drop_columns(names).to_pylist(), key=lambda r: r["tile_id"]):
            value = np.frombuffer(r["pixels"], np.uint8).reshape(-1, r["width"])
            on = np.unpackbits(np.frombuffer(r["covered"], np.uint8))[: value.size].reshape(value.shape).astype(bool)
            cut = (slice(r["y0"], r["y0"] + value.shape[0]), slice(r["x0"], r["x0"] + value.shape[1]))
            out[cut][on] = value[on]
            hit[cut] |= on
        own = group.select(names).slice(0, 1)
        return pa.table([*own.columns, pa.array([out.tobytes()], pa.binary()), pa.array([block], pa.int32()), pa.array([int(hit.sum())], pa.int64())], names=[*names, "data", "width", "covered"])

    return patches.groupBy(*names).applyInArrow(lay, f"{types}, data binary, width int, covered long")
