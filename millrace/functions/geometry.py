"""Curves through numbers, points against shapes, and element-wise vectors, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .special import lit


def lerp(a, b, t: Column) -> Column:
    return lit(a) + (lit(b) - lit(a)) * t


def hermite(a, b, slope_a, slope_b, t: Column) -> Column:
    """The cubic from a to b with the slopes given at both ends."""
    a, b, u, v = map(lit, (a, b, slope_a, slope_b))
    return a + t * (u + t * (3 * (b - a) - 2 * u - v + t * (2 * (a - b) + u + v)))


def bezier(a, b, c, d, t: Column) -> Column:
    """The cubic from a to d that b and c pull at."""
    a, b, c, d = map(lit, (a, b, c, d))
    s = 1 - t
    return s * s * s * a + 3 * s * s * t * b + 3 * s * t * t * c + t * t * t * d


def catmull_rom(a, b, c, d, t: Column) -> Column:
    """Between b and c, along the slopes that their neighbours give."""
    b_, c_ = lit(b), lit(c)
    return hermite(b_, c_, (c_ - lit(a)) / 2, (lit(d) - b_) / 2, t)


def b_spline(points: list, times: list[float], t: Column) -> Column:
    """The B-spline of points over knots, of degree len(times) - len(points) - 1; 0 outside the knots.

    A table of one row a degree: each weight is made of two of the degree below. A share
    between equal knots is 0.
    """
    weights = [F.when((t >= a) & (t < b), 1.0).otherwise(0.0) for a, b in zip(times, times[1:], strict=False)]
    for p in range(1, len(times) - len(points)):
        rise = [(t - times[i]) / (times[i + p] - times[i]) if times[i + p] > times[i] else F.lit(0.0) for i in range(len(times) - p)]
        weights = [rise[i] * weights[i] + (1 - rise[i + 1] if times[i + p + 1] > times[i + 1] else F.lit(0.0)) * weights[i + 1] for i in range(len(weights) - 1)]
    out = F.lit(0.0)
    for x, w in zip(points, weights, strict=True):
        out = out + x * w
    return out


def interpolated(points: Column, t: Column) -> Column:
    """Of an array of numbers at 0, 1, 2, ...: the value at t, by catmull_rom; the ends are repeated. Outside it is null."""
    last = F.size(points) - 1
    at = F.least(F.floor(t).cast("int"), F.greatest(last - 1, F.lit(0)))

    def p(i):
        return F.get(points, F.greatest(F.lit(0), F.least(last, at + i))).cast("double")

    return F.when((t >= 0) & (t <= last), catmull_rom(p(-1), p(0), p(1), p(2), t - at))


def turn(ax, ay, bx, by, x, y) -> Column:
    """Above 0 if (x, y) lies to the left on the way from a to b, below if to the right, 0 on the line."""
    return (lit(bx) - lit(ax)) * (lit(y) - lit(ay)) - (lit(by) - lit(ay)) * (lit(x) - lit(ax))


def in_convex(xs: list, ys: list, x: Column, y: Column) -> Column:
    """Whether a point is in a convex polygon, border included, whichever way round its corners are given."""
    n = len(xs)
    if n < 3:
        raise ValueError("a polygon has at least 3 corners")
    turns = [turn(xs[i], ys[i], xs[(i + 1) % n], ys[(i + 1) % n], x, y) for i in range(n)]
    left = turn(xs[0], ys[0], xs[1], ys[1], xs[2], ys[2]) >= 0
    return F.when(left, F.least(*turns) >= 0).otherwise(F.greatest(*turns) <= 0)


def vector(a: Column, b: Column | float, f) -> Column:
    """f of the elements of two vectors of equal length, or of a vector and a number."""
    if not isinstance(b, Column):
        return F.transform(a, lambda v: f(v, F.lit(float(b))))
    same = F.size(a) == F.size(b)
    return F.when(same, F.zip_with(a, b, f)).otherwise(F.raise_error(F.lit("vectors of unequal length")).cast("array<double>"))


def split_relation(side: Column, other: Column) -> Column:
    """disjoint, equal, child (side within other), parent or conflict."""
    both, n, m = F.size(F.array_intersect(side, other)), F.size(F.array_distinct(side)), F.size(F.array_distinct(other))
    return F.when(both == 0, "disjoint").when((both == n) & (both == m), "equal").when(both == n, "child").when(both == m, "parent").otherwise("conflict")


def splits_fit(side: Column, other: Column, leaves: Column) -> Column:
    """Whether one unrooted tree can have both splits: one of the four ways to be on their sides holds no leaf."""
    out = F.array_except(leaves, other)
    rest = F.array_except(leaves, side)
    return ~(F.arrays_overlap(side, other) & F.arrays_overlap(side, out) & F.arrays_overlap(rest, other) & F.arrays_overlap(rest, out))
