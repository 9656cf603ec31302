"""Column expressions shared by the operators. NULL in, NULL out."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def clean(x) -> Column:
    """NaN and infinities as NULL."""
    x = _c(x)
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def clip(x, lo: float = 0.0, hi: float = 1.0) -> Column:
    x = _c(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi))))


def difference_ratio(a, b, epsilon: float = 0.0) -> Column:
    """(a - b) / (a + b + epsilon); NULL where that is not defined."""
    a, b = _c(a), _c(b)
    return F.try_divide(a - b, a + b + F.lit(epsilon) if epsilon else a + b)


def classed(x, edges: Sequence[float]) -> Column:
    """How many edges are at most x: classes 0 to len(edges), closed to the left."""
    x = _c(x)
    out = F.lit(0)
    for e in edges:
        out = out + (x >= e).cast("int")
    return out


def unit(x, lo, hi, invert: bool = False) -> Column:
    """x between lo and hi as 0 to 1, clipped; 0 where lo and hi coincide."""
    x, lo, hi = _c(x), _c(lo), _c(hi)
    out = F.when(x.isNull(), None).when(hi - lo < 1e-12, 0.0).otherwise(clip(F.try_divide(x - lo, hi - lo)))
    return 1 - out if invert else out


def lookup(x, values: dict) -> Column:
    """The value of a literal map at x; NULL where it has none."""
    pairs = [F.lit(v) for kv in values.items() for v in kv]
    return F.try_element_at(F.create_map(*pairs), _c(x))


def correlation(a, b) -> Column:
    """Pearson's correlation as an aggregate; NULL where a side doesn't vary."""
    both = _c(a).isNotNull() & _c(b).isNotNull()
    a, b = F.when(both, _c(a)), F.when(both, _c(b))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def water_year(day, first_month: int = 10) -> Column:
    """The year in which the water year of a date ends."""
    day = _c(day)
    return F.year(day) + (F.month(day) >= first_month).cast("int")


def in_ring(px, py, ring: Sequence[tuple[float, float]]) -> Column:
    """Whether a point is inside a literal ring, by even-odd ray casting."""
    px, py = _c(px), _c(py)
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
        if y1 == y2:
            continue
        at = (py - y1) * F.lit((x2 - x1) / (y2 - y1)) + x1
        crossings = crossings + (((py >= min(y1, y2)) & (py < max(y1, y2))) & (px < at)).cast("int")
    return crossings % 2 == 1


def in_polygon(px, py, ring: Column) -> Column:
    """The same for a ring column, array<struct<x, y>>, closed or not."""
    px, py = _c(px), _c(py)
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))

    def crossing(a: Column, b: Column) -> Column:
        over = (a["y"] > py) != (b["y"] > py)
        at = F.try_divide((b["x"] - a["x"]) * (py - a["y"]), b["y"] - a["y"]) + a["x"]
        return F.when(over & (px < at), 1).otherwise(0)

    return F.aggregate(F.zip_with(ring, after, crossing), F.lit(0), lambda n, v: n + v) % 2 == 1


def ring_area(ring: Column) -> Column:
    """Area of a ring by the shoelace sum."""
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    cross = F.zip_with(ring, after, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2


def line_length(points: Column) -> Column:
    """Length of a polyline, array<struct<x, y>>."""
    parts = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.size(points)), lambda a, b: F.hypot(a["x"] - b["x"], a["y"] - b["y"]))
    return F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)


def albers(lon, lat) -> tuple[Column, Column]:
    """Metres east and north in the equal-area conic of the contiguous United
    States (GRS80, parallels 29.5 and 45.5, origin 23 N 96 W), after Snyder."""


    a, e2 = 6378137.0, 0.006694380022903
    e = math.sqrt(e2)

    def q(s):
        return (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    def m(p):
        return math.cos(p) / math.sqrt(1 - e2 * math.sin(p) ** 2)

    p0, p1, p2 = (math.radians(v) for v in (23.0, 29.5, 45.5))
    n = (m(p1) ** 2 - m(p2) ** 2) / (q(math.sin(p2)) - q(math.sin(p1)))
    c = m(p1) ** 2 + n * q(math.sin(p1))
    rho0 = a * math.sqrt(c - n * q(math.sin(p0))) / n
    s = F.sin(F.radians(_c(lat)))
    here = (1 - e2) * (s / (1 - e2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
    rho = a * F.sqrt(c - n * here) / n
    theta = n * F.radians(_c(lon) + 96.0)
    return rho * F.sin(theta), rho0 - rho * F.cos(theta)


def student_p(t: Column, freedom: Column) -> Column:
    """Two-sided p of Student's t with whole degrees of freedom: the finite series
    in the angle whose tangent is t over the root of the degrees."""
    n = freedom.cast("int")
    angle = F.atan(F.abs(t) / F.sqrt(n))
    cos2, odd = F.pow(F.cos(angle), 2), n % 2
    # Of terms that each are the one before times (k - 1 + odd) / (k + odd) times the squared cosine, k = 1, 3, ..
    steps = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((n - 2 - odd) / 2).cast("int"), F.lit(0))), lambda j: 2 * j + 1 + odd)
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total"))
    added = F.aggregate(steps, zero, lambda a, k: F.struct((a["term"] * cos2 * k / (k + 1)).alias("term"), (a["total"] + a["term"]).alias("total")))["total"]
    even_inside = F.sin(angle) * added
    odd_inside = 2 / math.pi * (angle + F.when(n > 1, F.sin(angle) * F.cos(angle) * added).otherwise(0.0))
    return F.when(t.isNotNull(), F.greatest(1 - F.when(odd == 1, odd_inside).otherwise(even_inside), F.lit(0.0)))
