"""Planar expressions: curves, boxes, matrices. All are columns; exact ones take integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: chains of named intermediate columns would be written out anew for each use."""
    return F.transform(F.array(value), body)[0]


def cubic(p0: Column, p1: Column, p2: Column, p3: Column, t: Column) -> Column:
    """One coordinate of a cubic Bezier curve."""
    u = 1 - t
    return u * u * u * p0 + 3 * u * u * t * p1 + 3 * u * t * t * p2 + t * t * t * p3


def cubic_extremes(p0: Column, p1: Column, p2: Column, p3: Column) -> Column:
    """Parameters in (0, 1) at which the derivative of one coordinate vanishes."""
    a = -p0 + 3 * p1 - 3 * p2 + p3
    b = 2 * (p0 - 2 * p1 + p2)
    c = p1 - p0
    # derivative / 3 = a t^2 + b t + c
    root = F.sqrt(F.greatest(b * b - 4 * a * c, F.lit(0.0)))
    real = b * b - 4 * a * c >= 0
    two = F.array(F.when(real, F.try_divide(-b - root, 2 * a)), F.when(real, F.try_divide(-b + root, 2 * a)))
    one = F.array(F.try_divide(-c, b))
    roots = F.when(F.abs(a) < 1e-12, F.when(F.abs(b) < 1e-12, F.array().cast("array<double>")).otherwise(one)).otherwise(two)
    return F.filter(roots, lambda t: t.isNotNull() & (t > 0) & (t < 1))


def cubic_range(p0: Column, p1: Column, p2: Column, p3: Column) -> tuple[Column, Column]:
    """Least and greatest value of one coordinate over the curve, not over its control points."""
    inner = F.transform(cubic_extremes(p0, p1, p2, p3), lambda t: cubic(p0, p1, p2, p3, t))
    values = F.concat(F.array(p0, p3), inner)
    return F.array_min(values), F.array_max(values)


def cross(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Exact for integers below 2**30 in size."""
    return ax * by - ay * bx


def rotated_hull(x: Column, y: Column, w: Column, h: Column, degrees: Column) -> dict[str, Column]:
    """The upright hull of a box rotated about its centre."""
    r = F.radians(degrees)
    c, s = F.abs(F.cos(r)), F.abs(F.sin(r))
    hw, hh = (w * c + h * s) / 2, (w * s + h * c) / 2
    cx, cy = x + w / 2, y + h / 2
    return {"left": cx - hw, "top": cy - hh, "right": cx + hw, "bottom": cy + hh}


def box_under(m: list[Column], x: Column, y: Column, w: Column, h: Column) -> dict[str, Column]:
    """The hull of the four corners of a box under a matrix a b c d e f."""
    a, b, c, d, e, f = m
    xs = [a * px + c * py + e for px in (x, x + w) for py in (y, y + h)]
    ys = [b * px + d * py + f for px in (x, x + w) for py in (y, y + h)]
    return {"left": F.least(*xs), "top": F.least(*ys), "right": F.greatest(*xs), "bottom": F.greatest(*ys)}


def point_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment; a segment of no length is a point."""
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    t = F.coalesce(F.try_divide((px - ax) * dx + (py - ay) * dy, n), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def stroke_reach(width: Column, cap: Column, join: Column, miter: Column) -> Column:
    """How far a stroke reaches beyond its path."""
    corner = F.when(join == "miter", F.greatest(F.lit(1.0), miter)).otherwise(F.lit(1.0))
    end = F.when(cap == "square", F.lit(2.0**0.5)).otherwise(F.lit(1.0))
    return width / 2 * F.greatest(corner, end)


def gradient_axis(angle: Column, x: Column, y: Column, w: Column, h: Column) -> dict[str, Column]:
    """End points of the axis of a linear gradient over a box, clockwise, for angles in steps of 1/60000 degree; the four
    right angles are exact and a box has some extent."""
    angle = F.pmod(F.floor(angle * 60_000 + 0.5), F.lit(21_600_000)) / 60_000
    w, h = F.greatest(w, F.lit(0.01)), F.greatest(h, F.lit(0.01))
    r = F.radians(angle)
    dx = F.when(angle.isin(90.0, 270.0), 0.0).when(angle == 0, 1.0).when(angle == 180, -1.0).otherwise(F.cos(r))
    dy = F.when(angle.isin(0.0, 180.0), 0.0).when(angle == 90, 1.0).when(angle == 270, -1.0).otherwise(F.sin(r))
    half = (F.abs(dx) * w + F.abs(dy) * h) / 2
    cx, cy = x + w / 2, y + h / 2
    return {"ax": cx - dx * half, "ay": cy - dy * half, "bx": cx + dx * half, "by": cy + dy * half}


def halves(p0: Column, p1: Column, p2: Column, p3: Column) -> tuple[Column, Column, Column, Column, Column]:
    """The five new control values of a cubic cut in the middle."""
    a, q, d = (p0 + p1) / 2, (p1 + p2) / 2, (p2 + p3) / 2
    b, c = (a + q) / 2, (q + d) / 2
    return a, b, (b + c) / 2, c, d


def monotone(p0: Column, p1: Column, p2: Column, p3: Column) -> Column:
    """1 or -1 where all coefficients of the derivative have that sign and one isn't zero, else 0."""
    steps = [p1 - p0, p2 - p1, p3 - p2]
    return F.when((F.least(*steps) >= 0) & (F.greatest(*steps) > 0), 1).when((F.greatest(*steps) <= 0) & (F.least(*steps) < 0), -1).otherwise(0).cast("long")


def bracket(p: list[Column], level: float, steps: int) -> Column:
    """(low, high): the parameters around the crossing of a level by a coordinate that runs one way, halved ``steps`` times."""
    begin = F.signum(p[0] - level)
    start = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))

    def halve(b: Column, _: Column) -> Column:
        t = (b["low"] + b["high"]) / 2
        before = F.signum(cubic(*p, t) - level) == begin
        return F.struct(F.when(before, t).otherwise(b["low"]).alias("low"), F.when(before, b["high"]).otherwise(t).alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve)
