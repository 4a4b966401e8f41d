"""Geometry as column expressions; everything stays inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _all(*cs):
    out = cs[0]
    for c in cs[1:]:
        out = out & c
    return out


def dist(x1, y1, x2, y2) -> Column:
    """Euclidean distance."""
    dx, dy = x1 - x2, y1 - y2
    return F.sqrt((dx * dx + dy * dy).cast("double"))


def manhattan(x1, y1, x2, y2) -> Column:
    return F.abs(x1 - x2) + F.abs(y1 - y2)


def chebyshev(x1, y1, x2, y2) -> Column:
    return F.greatest(F.abs(x1 - x2), F.abs(y1 - y2))


def half(a: Column, b: Column) -> Column:
    """Floored midpoint of two whole coordinates."""
    return F.floor((a + b) / F.lit(2)).cast("bigint")


def box(p: str) -> tuple[Column, ...]:
    """Columns x1, y1, x2, y2, optionally with a prefix ("l_" -> l_x1)."""
    return tuple(F.col(p + c) for c in ("x1", "y1", "x2", "y2"))


def overlap_sides(a, b) -> tuple[Column, Column]:
    return (F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))


def overlapping(a, b) -> Column:
    """True when the boxes share area; touching edges do not count."""
    w, h = overlap_sides(a, b)
    return (w > 0) & (h > 0)


def overlap_area(a, b) -> Column:
    w, h = overlap_sides(a, b)
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0))


def area(a) -> Column:
    return (a[2] - a[0]) * (a[3] - a[1])


def iou(a, b) -> Column:
    inter = overlap_area(a, b)
    return F.when(inter > 0, inter.cast("double") / (area(a) + area(b) - inter)).otherwise(F.lit(0.0))


def same_position(a, b, tol: int = 10) -> Column:
    return _all(*[F.abs(p - q) < tol for p, q in zip(a, b)])


def segment_meets_box(s, r) -> Column:
    """Segment against a rectangle: their bounds meet, and the corners do not all lie on one side of the segment's line.

    The few terms keep the joins that test it in methods small enough for the compiler of the JVM.
    """
    near = ((F.greatest(s[0], s[2]) >= r[0]) & (F.least(s[0], s[2]) <= r[2])
            & (F.greatest(s[1], s[3]) >= r[1]) & (F.least(s[1], s[3]) <= r[3]))
    dx, dy = s[2] - s[0], s[3] - s[1]
    rise, run = [dx * (r[i] - s[1]) for i in (1, 3)], [dy * (r[i] - s[0]) for i in (0, 2)]
    # the least and the greatest turn from the segment to a corner
    return near & (F.least(*rise) <= F.greatest(*run)) & (F.greatest(*rise) >= F.least(*run))


def grow(r, by: int):
    return r[0] - by, r[1] - by, r[2] + by, r[3] + by


def to_relative(b, w, h) -> tuple[Column, ...]:
    """Normalised centre and size."""
    x1, y1, x2, y2 = (c.cast("double") for c in b)
    return (x1 + x2) / 2 / w, (y1 + y2) / 2 / h, (x2 - x1) / w, (y2 - y1) / h


def to_pixels(cx, cy, bw, bh, w, h) -> tuple[Column, ...]:
    """Pixel corners, truncated."""
    return tuple(v.cast("bigint") for v in
                 ((cx - bw / 2) * w, (cy - bh / 2) * h, (cx + bw / 2) * w, (cy + bh / 2) * h))


def extended(s, by: int = 3) -> tuple[Column, ...]:
    """Segment lengthened by `by` at both ends, truncated; a point stays where it is."""
    dx, dy = (s[2] - s[0]).cast("double"), (s[3] - s[1]).cast("double")
    length = F.sqrt(dx * dx + dy * dy)
    length = F.when(length == 0, F.lit(1.0)).otherwise(length)
    ux, uy = dx / length, dy / length
    return ((s[0] - ux * by).cast("bigint"), (s[1] - uy * by).cast("bigint"),
            (s[2] + ux * by).cast("bigint"), (s[3] + uy * by).cast("bigint"))


def clamped(b, w, h) -> tuple[Column, ...]:
    """Box inside the picture with at least two pixels of width and height."""
    x1 = F.greatest(F.lit(0), F.least(b[0], w - 1))
    y1 = F.greatest(F.lit(0), F.least(b[1], h - 1))
    return x1, y1, F.greatest(x1 + 2, F.least(b[2], w)), F.greatest(y1 + 2, F.least(b[3], h))
