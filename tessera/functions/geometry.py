"""Column expressions of tile, point, triangle and transform geometry.

Every function takes columns (or names) and gives columns, so that predicates and projections stay
inside the optimizer and whole-stage code generation.  Coordinates are doubles; an affine is the
six numbers a00, a01, tx, a10, a11, ty.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extent of a tile, and of the overlap that a match needs.
TILE_WIDTH, TILE_HEIGHT = 3128, 2724
MIN_OVERLAP = 50
IDENTITY = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


# -- points ------------------------------------------------------------------------------------


def rigid(x, y, offset_x, offset_y, start_x, start_y) -> tuple[Column, Column]:
    """A point of a tile in section coordinates."""
    return col(x) + col(offset_x) + col(start_x), col(y) + col(offset_y) + col(start_y)


def affine(x, y, m) -> tuple[Column, Column]:
    """A point through an affine (six numbers or columns)."""
    a00, a01, tx, a10, a11, ty = (col(v) for v in m)
    return a00 * col(x) + a01 * col(y) + tx, a10 * col(x) + a11 * col(y) + ty


def compose(second, first) -> tuple[Column, ...]:
    """The affine that applies ``first``, then ``second``."""
    a00, a01, tx, a10, a11, ty = (col(v) for v in second)
    b00, b01, ux, b10, b11, uy = (col(v) for v in first)
    return (
        a00 * b00 + a01 * b10, a00 * b01 + a01 * b11, a00 * ux + a01 * uy + tx,
        a10 * b00 + a11 * b10, a10 * b01 + a11 * b11, a10 * ux + a11 * uy + ty,
    )


def fold_affines(matrices) -> Column:
    """Product of an array of affines (arrays of six numbers), from left to right."""

    def times(a, b):
        return F.array(*compose([a[i] for i in range(6)], [b[i] for i in range(6)]))

    return F.aggregate(col(matrices), F.array(*map(F.lit, IDENTITY)), times)


def rotate(x, y, angle, about_x=0.0, about_y=0.0) -> tuple[Column, Column]:
    """A point turned about another, ``angle`` in radians."""
    dx, dy, c, s = col(x) - col(about_x), col(y) - col(about_y), F.cos(col(angle)), F.sin(col(angle))
    return dx * c - dy * s + col(about_x), dx * s + dy * c + col(about_y)


def distance(ax, ay, bx, by) -> Column:
    """Euclidean distance."""
    dx, dy = col(ax) - col(bx), col(ay) - col(by)
    return F.sqrt(dx * dx + dy * dy)


def deviation(pa, pb, ideal) -> Column:
    """How far the difference of two points is from the ideal one."""
    dx = col(pa[0]) - col(pb[0]) - col(ideal[0])
    dy = col(pa[1]) - col(pb[1]) - col(ideal[1])
    return F.sqrt(dx * dx + dy * dy)


def regular_length(dx, dy) -> Column:
    """Length of a spring, never zero."""
    return F.sqrt(col(dx) * col(dx) + col(dy) * col(dy) + F.lit(1e-4))


def huber(d, sigma) -> Column:
    """Huber loss."""
    d, s = F.abs(col(d)), col(sigma)
    return F.when(d <= s, d * d / 2).otherwise(s * (d - s / 2))


def huber_gradient(d, sigma, slopes: Sequence) -> list[Column]:
    """Gradient of the Huber loss by the derivatives ``slopes`` of d.  Beyond ``sigma`` it is
    sigma times the derivative, without the sign of d, as the surveyed one is."""
    d, s = col(d), col(sigma)
    scale = F.when(F.abs(d) <= s, d).otherwise(s)
    return [scale * col(x) for x in slopes]


def angle_degrees(dx, dy) -> Column:
    """Direction in degrees, from 0 up to 360."""
    a = F.degrees(F.atan2(col(dy), col(dx)))
    return F.when(a < 0, a + 360).otherwise(a)


# -- boxes -------------------------------------------------------------------------------------


def corners(x0, y0, width=TILE_WIDTH, height=TILE_HEIGHT) -> list[tuple[Column, Column]]:
    """P5: the corners of a tile."""
    x0, y0 = col(x0), col(y0)
    return [(x0, y0), (x0 + width, y0), (x0, y0 + height), (x0 + width, y0 + height)]


def affine_box(x0, y0, x1, y1, m) -> tuple[Column, Column, Column, Column]:
    """Bounding box (min x, min y, max x, max y) of a box through an affine."""
    points = [affine(x, y, m) for x in (x0, x1) for y in (y0, y1)]
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)


def scaled(v, scale) -> Column:
    """V / scale, half added, cut towards zero."""
    return (col(v) / col(scale) + F.lit(0.5)).cast("int")


def centre(x0, x1, y0, y1) -> tuple[Column, Column]:
    """P16."""
    return (col(x0) + col(x1)) / 2, (col(y0) + col(y1)) / 2


def shared_extent(a0, a1, b0, b1) -> Column:
    """Length of the overlap of two intervals, zero if apart."""
    return F.greatest(F.lit(0), F.least(col(a1), col(b1)) - F.greatest(col(a0), col(b0)))


def overlap_fraction(a, b) -> Column:
    """Shared area by the sum of both areas; boxes are (x0, x1, y0, y1)."""
    area = lambda r: (col(r[1]) - col(r[0])) * (col(r[3]) - col(r[2]))
    shared = shared_extent(a[0], a[1], b[0], b[1]) * shared_extent(a[2], a[3], b[2], b[3])
    return shared / (area(a) + area(b))


def overlaps(a, b, *, whole: bool = False, least=None) -> Column:
    """F1 (``whole``: coordinates cut to integers), F2, F3 (``least`` shared length each way)."""
    cut = (lambda v: col(v).cast("int")) if whole else col
    a, b = [cut(v) for v in a], [cut(v) for v in b]
    out = (a[0] < b[1]) & (a[1] > b[0]) & (a[2] < b[3]) & (a[3] > b[2])
    if least is not None:
        out &= (F.least(a[1] - b[0], b[1] - a[0]) >= least) & (F.least(a[3] - b[2], b[3] - a[2]) >= least)
    return out


def overlaps_compat(a, b) -> Column:
    """F16: the overlap test with its known slip: what should ask whether b ends before a begins
    asks whether b ends before it begins itself.  So only boxes a that end before b are rejected,
    and inverted boxes b."""
    apart = lambda i: (col(a[i + 1]) < col(b[i])) | (col(b[i + 1]) < col(b[i]))
    return ~(apart(0) | apart(2))


def transformed_overlaps(a, m, box) -> Column:
    """a box through an affine overlaps another (P6, then F1 on whole numbers)."""
    low_x, low_y, high_x, high_y = affine_box(a[0], a[2], a[1], a[3], m)
    return overlaps((low_x, high_x, low_y, high_y), box, whole=True)


def in_box(x, y, box) -> Column:
    """point in a box, edges included; box is (x0, x1, y0, y1)."""
    return col(x).between(col(box[0]), col(box[1])) & col(y).between(col(box[2]), col(box[3]))


def meets_box(a, box) -> Column:
    """not wholly beside the box; edges included."""
    return ~((col(a[1]) < col(box[0])) | (col(a[0]) > col(box[1])) | (col(a[3]) < col(box[2])) | (col(a[2]) > col(box[3])))


def contained(a, box) -> Column:
    """wholly inside."""
    return (col(a[0]) >= col(box[0])) & (col(a[1]) <= col(box[1])) & (col(a[2]) >= col(box[2])) & (col(a[3]) <= col(box[3]))


# -- triangles ---------------------------------------------------------------------------------


def signed_area(a, b, c) -> Column:
    """P10."""
    return ((col(b[0]) - col(a[0])) * (col(c[1]) - col(a[1])) - (col(c[0]) - col(a[0])) * (col(b[1]) - col(a[1]))) / 2


def barycentric(p, a, b, c) -> tuple[Column, Column, Column]:
    """Weights of the corners a, b, c in p, the shares of the areas opposite to them; null for
    a flat triangle."""
    whole = signed_area(a, b, c)
    return tuple(F.when(whole != 0, part / whole) for part in (signed_area(p, b, c), signed_area(a, p, c), signed_area(a, b, p)))


def in_triangle(p, a, b, c, strict: bool = False) -> Column:
    """all weights at least zero (``strict``: over zero)."""
    weights = barycentric(p, a, b, c)
    test = [(w > 0) if strict else (w >= 0) for w in weights]
    return test[0] & test[1] & test[2]


def flipped(before, after) -> Column:
    """a triangle changed its orientation; each side is three points."""
    return F.signum(signed_area(*before)) * F.signum(signed_area(*after)) < 0


# -- descriptors and strings -------------------------------------------------------------------


def quantized(desc) -> Column:
    """Numbers cut to signed bytes that wrap."""
    return F.transform(col(desc), lambda x: (F.pmod(x.cast("int") + 128, F.lit(256)) - 128).cast("tinyint"))


def restored(desc) -> Column:
    return F.transform(col(desc), lambda x: x.cast("float"))


def squared_distance(a, b) -> Column:
    """Squared L2 distance of two arrays, in double precision."""
    d = F.zip_with(col(a), col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(d, F.lit(0.0), lambda s, x: s + x)


def mean_difference(a, b) -> Column:
    """Mean absolute difference of two arrays."""
    d = F.zip_with(col(a), col(b), lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return F.aggregate(d, F.lit(0.0), lambda s, x: s + x) / F.size(col(a))


def parsed_affine(text) -> Column:
    """P20: array of six from "m00 m10 m01 m11 tx ty"."""
    p = F.split(F.trim(col(text)), "\\s+")
    return F.array(*(p[i].cast("double") for i in (0, 2, 4, 1, 3, 5)))


def parsed_rigid(text) -> Column:
    """P20, rigid form: array of six from "angle tx ty"."""
    p = F.split(F.trim(col(text)), "\\s+")
    c, s = F.cos(p[0].cast("double")), F.sin(p[0].cast("double"))
    return F.array(c, -s, p[1].cast("double"), s, c, p[2].cast("double"))


def rounded(v, places: int) -> Column:
    """``F.round`` of a double, whole numbers as they are: rounding takes the decimal digits of a number,
    which costs more than to find it."""
    v = col(v)
    return F.when(F.rint(v) == v, v).otherwise(F.round(v, places))


def padded(text, width: int, fill: str = "0") -> Column:
    """Pad on the left; longer texts stay whole."""
    text = col(text).cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit(fill))


def parsed_box(text: str) -> tuple[float, float, float, float]:
    """Four numbers from "x0,x1,y0,y1"."""
    parts = [float(p) for p in text.split(",")]
    if len(parts) != 4 or not all(map(math.isfinite, parts)):
        raise ValueError(f"a box has four finite numbers: {text!r}")
    return parts[0], parts[1], parts[2], parts[3]


# -- draws -------------------------------------------------------------------------------------


def draw(seed: int, *keys) -> Column:
    """A number from 0 up to 1 by a hash of the key, the same in any layout and in any engine with
    md5: its first eight hexadecimal digits."""
    return F.conv(drawn_digits(seed, *keys), 16, 10).cast("double") / 4294967296.0


def drawn_digits(seed: int, *keys) -> Column:
    """The digits of ``draw``, which are ordered alike."""
    text = F.concat_ws(":", F.lit(str(seed)), *(col(k).cast("string") for k in keys))
    return F.substring(F.md5(text.cast("binary")), 1, 8)
