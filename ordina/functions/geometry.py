"""Points and vectors as structs of doubles; every function is a Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the reference constant that angles use.
PI = 3.14159


def vec(*parts: Column) -> Column:
    return F.struct(*[p.alias(n) for p, n in zip(parts, "xyz", strict=False)])


def axes(d: int) -> str:
    return "xyz"[:d]


def plus(a: Column, b: Column, d: int = 2) -> Column:
    return vec(*[a[k] + b[k] for k in axes(d)])


def minus(a: Column, b: Column, d: int = 2) -> Column:
    return vec(*[a[k] - b[k] for k in axes(d)])


def times(a: Column, s: Column | float, d: int = 2) -> Column:
    return vec(*[a[k] * s for k in axes(d)])


def over(a: Column, s: Column | float, d: int = 2) -> Column:
    return vec(*[a[k] / s for k in axes(d)])


def dot(a: Column, b: Column, d: int = 2) -> Column:
    total = a["x"] * b["x"]
    for k in axes(d)[1:]:
        total = total + a[k] * b[k]
    return total


def cross2(a: Column, b: Column) -> Column:
    return a["x"] * b["y"] - a["y"] * b["x"]


def cross3(a: Column, b: Column) -> Column:
    return vec(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def length(a: Column, d: int = 2) -> Column:
    return F.sqrt(dot(a, a, d))


def max_dim(a: Column, d: int = 2) -> Column:
    return F.greatest(*[a[k] for k in axes(d)])


def min_coords(a: Column, b: Column, d: int = 2) -> Column:
    return vec(*[F.least(a[k], b[k]) for k in axes(d)])


def max_coords(a: Column, b: Column, d: int = 2) -> Column:
    return vec(*[F.greatest(a[k], b[k]) for k in axes(d)])


def quadrant(p: Column, centre: Column, d: int = 2) -> Column:
    """Bit k is set where the coordinate exceeds the centre's."""
    total = F.lit(0)
    for bit, k in enumerate(axes(d)):
        total = total + F.when(p[k] > centre[k], 1 << bit).otherwise(0)
    return total


def offset_point(centre: Column, q: Column, half: Column | float, d: int = 2) -> Column:
    """The centre of quadrant q of a cell, ``half`` away on each axis."""
    return vec(*[centre[k] + F.when(q.bitwiseAND(1 << bit) != 0, half).otherwise(-half) for bit, k in enumerate(axes(d))])


def out_of_box(p: Column, centre: Column, half: Column | float, d: int = 2) -> Column:
    wrong = F.lit(False)
    for k in axes(d):
        wrong = wrong | (p[k] - half > centre[k]) | (p[k] + half < centre[k])
    return wrong


def tri_area(a: Column, b: Column, c: Column) -> Column:
    """Twice the signed area."""
    return cross2(minus(b, a), minus(c, a))


def counter_clockwise(a: Column, b: Column, c: Column) -> Column:
    return tri_area(a, b, c) > 0


def tri_area_normalized(a: Column, b: Column, c: Column) -> Column:
    return tri_area(a, b, c) / (length(minus(b, a)) * length(minus(c, a)))


def on_parabola(v: Column) -> Column:
    return vec(v["x"], v["y"], v["x"] * v["x"] + v["y"] * v["y"])


def in_circle_value(a: Column, b: Column, c: Column, d: Column) -> Column:
    ad, bd, cd = (on_parabola(minus(p, d)) for p in (a, b, c))
    return dot(cross3(ad, bd), cd, 3)


def in_circle(a: Column, b: Column, c: Column, d: Column) -> Column:
    return in_circle_value(a, b, c, d) > 0


def angle(a: Column, b: Column, c: Column) -> Column:
    """The angle at a, in degrees."""
    ba, ca = minus(b, a), minus(c, a)
    return F.acos(dot(ba, ca) / (length(ba) * length(ca))) * 180 / PI


def circumcenter(a: Column, b: Column, c: Column) -> Column:
    ba, ca = minus(b, a), minus(c, a)
    d = 2 * cross2(ba, ca)
    bb, cc = dot(ba, ba), dot(ca, ca)
    return vec(a["x"] + (ca["y"] * bb - ba["y"] * cc) / d, a["y"] + (ba["x"] * cc - ca["x"] * bb) / d)


def gravity(p: Column, q: Column, mp: Column, mq: Column, d: int = 3) -> Column:
    """Force of q on p."""
    v = minus(q, p, d)
    r2 = dot(v, v, d)
    return times(v, mp * mq / (r2 * F.sqrt(r2)), d)
