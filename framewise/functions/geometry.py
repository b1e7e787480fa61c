"""Box geometry as Column expressions: nothing here leaves the JVM.

A `Box` is four columns. Halves are rounded to even where the reference rounds,
and truncated where it truncates.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CONFUSED


class Box(NamedTuple):
    """Four edge columns."""

    x1: Column
    y1: Column
    x2: Column
    y2: Column

    def struct(self) -> Column:
        return F.struct(*(c.alias(n) for n, c in zip(self._fields, self, strict=True)))


def columns(prefix: str = "") -> Box:
    """The box in columns <prefix>x1 ... <prefix>y2."""
    return Box(*(F.col(prefix + n) for n in Box._fields))


def fields(value: Column) -> Box:
    """The box in the fields of a struct."""
    return Box(*(value[n] for n in Box._fields))


def values(x1: float, y1: float, x2: float, y2: float) -> Box:
    return Box(*(F.lit(v) for v in (x1, y1, x2, y2)))


def rounded(value: Column) -> Column:
    """Half to even, as an int."""
    return F.rint(value).cast("int")


def width(b: Box) -> Column:
    return b.x2 - b.x1


def height(b: Box) -> Column:
    return b.y2 - b.y1


def product(a: Column, b: Column) -> Column:
    """A product that no pixel count overflows."""
    return a.cast("double") * b.cast("double")


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
    h = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    zero = F.lit(0)
    return product(F.greatest(w, zero), F.greatest(h, zero))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where the boxes don't meet, whatever their areas."""
    inter = intersection(a, b)
    union = product(width(a), height(a)) + product(width(b), height(b)) - inter
    return F.when(inter == 0, F.lit(0.0)).otherwise(inter / F.when(inter != 0, union))


def overlaps(a: Box, b: Box, margin: int = 0) -> Column:
    """Whether interiors meet; boxes that touch don't, unless a margin reaches over."""
    return (a.x1 - margin < b.x2) & (b.x1 < a.x2 + margin) & (a.y1 - margin < b.y2) & (b.y1 < a.y2 + margin)


def covered_fraction(inner: Box, outer: Box) -> Column:
    """The part of `inner` that lies in `outer`; 0 for boxes without area."""
    area = product(width(inner), height(inner))
    return F.when(area <= 0, F.lit(0.0)).otherwise(intersection(inner, outer) / F.when(area > 0, area))


def centre(b: Box) -> tuple[Column, Column]:
    return (b.x1 + b.x2) * 0.5, (b.y1 + b.y2) * 0.5


def distance(a: Box, b: Box) -> Column:
    (ax, ay), (bx, by) = centre(a), centre(b)
    return F.hypot(ax - bx, ay - by)


def diagonal(b: Box) -> Column:
    return F.hypot(width(b).cast("double"), height(b).cast("double"))


def area_floored(b: Box) -> Column:
    """Sides of at least 0, product of at least 1."""
    zero = F.lit(0)
    return F.greatest(F.lit(1.0), product(F.greatest(width(b), zero), F.greatest(height(b), zero)))


def area(b: Box) -> Column:
    """Product of the sides, at least 0."""
    return F.greatest(F.lit(0.0), product(width(b), height(b)))


def min_side(b: Box) -> Column:
    return F.least(width(b), height(b))


def max_side(b: Box) -> Column:
    return F.greatest(width(b), height(b))


def relative_area(plate: Box, vehicle: Box) -> Column:
    return area_floored(plate) / area_floored(vehicle)


def area_ratio_ok(before: Box, after: Box, ratio: float) -> Column:
    """A box may grow freely and shrink at most `ratio` times; 0 or less allows all."""
    return F.lit(True) if ratio <= 0 else area_floored(before) / area_floored(after) <= ratio


def lerp(a: Box, b: Box, t: Column) -> Box:
    return Box(*(rounded(p + (q - p) * t) for p, q in zip(a, b, strict=True)))


class Pose(NamedTuple):
    """A plate relative to its vehicle: centre and size in vehicle sides."""

    x: Column
    y: Column
    w: Column
    h: Column


def pose(plate: Box, vehicle: Box) -> Pose:
    vw, vh = (F.greatest(F.lit(1.0), s.cast("double")) for s in (width(vehicle), height(vehicle)))
    cx, cy = centre(plate)
    return Pose((cx - vehicle.x1) / vw, (cy - vehicle.y1) / vh, width(plate) / vw, height(plate) / vh)


def lerp_pose(a: Pose, b: Pose, t: Column) -> Pose:
    return Pose(*(p + (q - p) * t for p, q in zip(a, b, strict=True)))


def placed(at: Pose, vehicle: Box) -> Box:
    """The plate that has this pose on a vehicle; sides of at least 4."""
    vw, vh = (F.greatest(F.lit(1.0), s.cast("double")) for s in (width(vehicle), height(vehicle)))
    cx, cy = vehicle.x1 + at.x * vw, vehicle.y1 + at.y * vh
    w, h = (F.greatest(F.lit(4.0), s) * 0.5 for s in (at.w * vw, at.h * vh))
    return Box(rounded(cx - w), rounded(cy - h), rounded(cx + w), rounded(cy + h))


def motion_ok(a: Box, b: Box, gap: Column, vehicle: Box | None, px: float, frac: float, margin: float = 1.15) -> Column:
    """Whether the way from a to b is plausible over `gap` missing frames."""
    reach = F.lit(float(px))
    if vehicle is not None:
        reach = F.greatest(reach, diagonal(vehicle) * frac)
    return (gap <= 0) | (distance(a, b) <= reach * gap * margin)


def class_link_ok(a: Column, b: Column, gap: Column, flip: int) -> Column:
    """One class, or a short flip among the classes that detectors confuse."""
    return (a == b) | (a.isin(*CONFUSED) & b.isin(*CONFUSED) & (gap >= 0) & (gap <= flip))


def same_vehicle(a: Box, b: Box, least_iou: float) -> Column:
    return (iou(a, b) >= least_iou) | overlaps(a, b)


def identity_ok(a: Box, b: Box, gap: Column, least_iou: float, flip: int) -> Column:
    return same_vehicle(a, b, least_iou) | ((gap >= 0) & (gap <= flip))


def centre_in(inner: Box, outer: Box, expand: float = 0.0) -> Column:
    """Whether the centre lies in the box, edges included, each side moved out by a fraction of it."""
    cx, cy = centre(inner)
    ex, ey = (s * expand for s in (width(outer), height(outer))) if expand else (0, 0)
    return cx.between(outer.x1 - ex, outer.x2 + ex) & cy.between(outer.y1 - ey, outer.y2 + ey)


def same_detection(a_cls: Column, a: Box, b_cls: Column, b: Box, least_iou: float = 0.40, least_contained: float = 0.60) -> Column:
    """Two boxes of one class that are one vehicle seen twice: much in common, or one within the other."""
    one = F.lit(1.0)
    smaller = F.least(F.greatest(one, product(width(a), height(a))), F.greatest(one, product(width(b), height(b))))
    inter = intersection(a, b)
    return (a_cls == b_cls) & ((iou(a, b) >= least_iou) | ((inter > 0) & (inter / smaller >= least_contained)))


def union_box(a: Box, b: Box) -> Box:
    return Box(F.least(a.x1, b.x1), F.least(a.y1, b.y1), F.greatest(a.x2, b.x2), F.greatest(a.y2, b.y2))


def remainder(wide: Box, kept: Box, least: float = 16.0) -> Column:
    """The larger side of `wide` that `kept` leaves free, as a struct; null where both are narrower than `least`."""
    left = F.greatest(F.lit(0.0), (kept.x1 - wide.x1).cast("double"))
    right = F.greatest(F.lit(0.0), (wide.x2 - kept.x2).cast("double"))
    of_right = Box(*map(rounded, (kept.x2, wide.y1, wide.x2, wide.y2))).struct()
    of_left = Box(*map(rounded, (wide.x1, wide.y1, kept.x1, wide.y2))).struct()
    return F.when((right >= left) & (right >= least), of_right).when(left >= least, of_left)


def clamped_size(b: Box, frame_w: int, frame_h: int, frac: float) -> Box:
    """Shrunk about its centre until no side is over a fraction of the frame's; truncated."""
    w, h = width(b), height(b)
    one = F.lit(1)
    scale = F.least(frame_w * frac / F.greatest(w, one), frame_h * frac / F.greatest(h, one))
    cx, cy = centre(b)
    hw, hh = w * scale / 2.0, h * scale / 2.0
    fits = (w <= frame_w * frac) & (h <= frame_h * frac)
    small = Box(*(c.cast("int") for c in (cx - hw, cy - hh, cx + hw, cy + hh)))
    return Box(*(F.when(fits, o).otherwise(s) for o, s in zip(b, small, strict=True)))


def rear_region(v: Box, bottom: float, side: float, frame_w: int | None = None, frame_h: int | None = None) -> Box:
    """The lower part of a vehicle box with padding at the sides, within the frame where its size is given."""
    one, zero = F.lit(1), F.lit(0)
    pad = rounded(F.greatest(one, width(v)) * side)
    x1, x2 = v.x1 - pad, v.x2 + pad
    y1, y2 = v.y1 + rounded(F.greatest(one, height(v)) * bottom), v.y2
    if frame_w is not None:
        x1, x2 = F.greatest(zero, x1), F.least(F.lit(frame_w), x2)
    if frame_h is not None:
        y1, y2 = F.greatest(zero, y1), F.least(F.lit(frame_h), y2)
    return Box(x1, y1, x2, y2)


class Letterbox(NamedTuple):
    """How a crop is put into a square: scale and padding."""

    scale: Column
    pad_x: Column
    pad_y: Column


def letterbox(crop_w: Column, crop_h: Column, size: int, max_scale: float | None = None) -> Letterbox:
    """The whole crop in a square, enlarged `max_scale` times at most; crops without area stay as they are."""
    empty = (crop_w <= 0) | (crop_h <= 0)
    side = F.lit(float(size))
    scale = F.least(side / F.when(~empty, crop_w), side / F.when(~empty, crop_h))
    if max_scale is not None:
        scale = F.least(scale, F.lit(float(max_scale)))
    pads = [(side - F.greatest(F.lit(1), rounded(s * scale))) / 2.0 for s in (crop_w, crop_h)]
    return Letterbox(F.when(empty, 1.0).otherwise(scale), *(F.when(empty, 0.0).otherwise(p) for p in pads))


def unletterbox(b: Box, box: Letterbox, crop_w: Column, crop_h: Column) -> Box:
    """From square to crop coordinates, rounded and kept within the crop."""
    inverse = F.when(box.scale > 0, F.lit(1.0) / F.when(box.scale > 0, box.scale)).otherwise(1.0)

    def back(v: Column, pad: Column, most: Column) -> Column:
        return F.greatest(F.lit(0), F.least(most, rounded((v - pad) * inverse)))

    return Box(back(b.x1, box.pad_x, crop_w), back(b.y1, box.pad_y, crop_h), back(b.x2, box.pad_x, crop_w), back(b.y2, box.pad_y, crop_h))


def centre_on_content(b: Box, box: Letterbox, crop_w: Column, crop_h: Column) -> Column:
    """Whether a box's centre in the square lies on the crop and not on padding."""
    cx, cy = centre(b)
    return cx.between(box.pad_x, box.pad_x + crop_w * box.scale) & cy.between(box.pad_y, box.pad_y + crop_h * box.scale)


def blur_kernel(strength: int, w: Column, h: Column) -> Column:
    """Odd kernel size for a region: at least the strength, larger for large regions, 81 at most."""
    base = max(1, strength) | 1
    by_size = (F.least(w, h) * 0.42).cast("int").bitwiseOR(F.lit(1))
    return F.least(F.lit(81), F.greatest(F.lit(base), by_size))


def padded(b: Box, pad: int, frame_w: int, frame_h: int) -> Box:
    """Moved out by `pad` on each side, within the frame."""
    zero = F.lit(0)
    return Box(F.greatest(zero, b.x1 - pad), F.greatest(zero, b.y1 - pad), F.least(F.lit(frame_w), b.x2 + pad), F.least(F.lit(frame_h), b.y2 + pad))


class Yolo(NamedTuple):
    """Centre and size as fractions of the picture."""

    cx: Column
    cy: Column
    w: Column
    h: Column


def to_yolo(b: Box, w: Column, h: Column, least: float = 0.001) -> Yolo:
    """Fractions kept in [0, 1], sizes at least `least`."""

    def kept(v: Column, low: float) -> Column:
        return F.greatest(F.lit(low), F.least(F.lit(1.0), v))

    return Yolo(kept((b.x1 + b.x2) / 2.0 / w, 0.0), kept((b.y1 + b.y2) / 2.0 / h, 0.0), kept((b.x2 - b.x1) / w, least), kept((b.y2 - b.y1) / h, least))


def from_yolo(y: Yolo, w: Column, h: Column) -> Box:
    return Box((y.cx - y.w / 2) * w, (y.cy - y.h / 2) * h, (y.cx + y.w / 2) * w, (y.cy + y.h / 2) * h)


def warped(b: Box, matrix: list[list[float]], out_w: int, out_h: int, least_area: float = 24.0) -> Column:
    """The frame around a box's corners after an affine (2 x 3) or perspective (3 x 3) map, within the picture; null if too small."""

    def moved(x: Column, y: Column) -> tuple[Column, Column]:
        px, py = (matrix[i][0] * x + matrix[i][1] * y + matrix[i][2] for i in (0, 1))
        if len(matrix) == 3:
            d = matrix[2][0] * x + matrix[2][1] * y + matrix[2][2]
            px, py = px / d, py / d
        return px, py

    corners = [moved(x, y) for x, y in ((b.x1, b.y1), (b.x2, b.y1), (b.x2, b.y2), (b.x1, b.y2))]
    xs, ys = zip(*corners, strict=True)

    def within(v: Column, most: int) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(float(most)), v))

    out = Box(within(F.least(*xs), out_w), within(F.least(*ys), out_h), within(F.greatest(*xs), out_w), within(F.greatest(*ys), out_h))
    return F.when(product(width(out), height(out)) >= least_area, out.struct())


#: Point orders of a quad: turned by 0 to 3 places, then its mirror likewise.
QUAD_ORDERS = [[(i - k) % 4 for i in range(4)] for k in range(4)] + [[3 - (i - k) % 4 for i in range(4)] for k in range(4)]


def aligned_quad(reference: Column, quad: Column) -> Column:
    """The order of a quad's points that is nearest to the reference (least squares, the first on ties).

    Both are best given as columns of their own: they are named often here. There is no
    function of an array's elements, as Spark would interpret it and all below it.
    """
    square = lambda i, j, c: F.pow((quad[i][c] - reference[j][c]).cast("double"), 2.0)
    errors = [sum(square(i, j, c) for j, i in enumerate(order) for c in ("x", "y")) for order in QUAD_ORDERS]
    best = F.least(*(F.struct(error.alias("error"), F.lit(n).alias("n")) for n, error in enumerate(errors)))["n"]
    return F.array(*(F.array(*(quad[i] for i in order)) for order in QUAD_ORDERS))[best]
