"""Easing curves: parsing and evaluation."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The named curves.
NAMES = ("hold", "linear", "easeIn", "easeOut", "easeInOut")
_NUMBER = r"\s*([^,()]+?)\s*"
_BEZIER = r"^cubicBezier\(" + ",".join([_NUMBER] * 4) + r"\)$"


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def parse(text: str) -> tuple | None:
    """('easeIn',) or ('cubicBezier', x1, y1, x2, y2); None for anything else. Case counts."""
    if text in NAMES:
        return (text,)
    m = re.match(_BEZIER, text or "")
    try:
        points = tuple(map(float, m.groups())) if m else ()
    except ValueError:
        return None
    return ("cubicBezier", *points) if points and all(map(math.isfinite, points)) else None


def _polynomial(p, q) -> tuple:
    """(cube, square, line) of the Bezier with inner values p and q."""
    return 1 + 3 * p - 3 * q, 3 * (q - p) - 3 * p, 3 * p


def _bound(x: Column, f) -> Column:
    """``f(x)`` with ``x`` worked out once."""
    return F.transform(F.array(x), f)[0]


def _sharpened(t: Column, u: Column, a, b, c) -> Column:
    """A root of a t^3 + b t^2 + c t = u after one Newton step, kept in 0..1."""
    slope = (3 * a * t + 2 * b) * t + c
    return clamp01(F.when(F.abs(slope) > 1e-6, t - (((a * t + b) * t + c) * t - u) / slope).otherwise(t))


def _one_root(turn: Column, flat, p) -> Column:
    root = F.sqrt(F.greatest(flat * flat * flat + turn * turn, F.lit(0.0)))
    return F.cbrt(turn + root) + F.cbrt(turn - root) - p / 3


def _three_roots(turn: Column, flat, p) -> Column:
    """Of three real roots the one in 0..1."""
    wide = F.sqrt(-flat) if isinstance(flat, Column) else F.lit(math.sqrt(-flat))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), turn / (wide * wide * wide))))
    roots = [2 * wide * F.cos((angle + k * math.pi) / 3) - p / 3 for k in (0, 2, 4)]
    within = lambda t: t.between(-1e-9, 1 + 1e-9)
    return F.when(within(roots[0]), roots[0]).when(within(roots[1]), roots[1]).otherwise(roots[2])


def bezier(u: Column, x1: Column | float, y1: Column | float, x2: Column | float, y2: Column | float) -> Column:
    """y of the curve where x = u; exact at 0 and 1. x1 and x2 are clamped to 0..1, so there is one such place.

    x is a cubic of the curve's parameter, whose root in 0..1 is taken in closed form and sharpened by a Newton step:
    no loop.
    """
    known = not any(isinstance(v, Column) for v in (x1, y1, x2, y2))
    if known:
        x1, x2 = (min(1.0, max(0.0, v)) for v in (x1, x2))
        ay, by, cy = _polynomial(y1, y2)
        y = _bound(u, lambda v: _bound(_root(v, *_polynomial(x1, x2)), lambda t: ((ay * t + by) * t + cy) * t))
    else:
        shape = F.struct(*[v.alias(n) for n, v in zip("abc", _polynomial(clamp01(x1), clamp01(x2)))])
        ay, by, cy = _polynomial(y1, y2)
        y = _bound(shape, lambda k: _bound(u, lambda v: _bound(_root_by(v, k["a"], k["b"], k["c"]), lambda t: ((ay * t + by) * t + cy) * t)))
    return F.when(u <= 0, 0.0).when(u >= 1, 1.0).otherwise(y)


def _root(u: Column, a: float, b: float, c: float) -> Column:
    if abs(a) < 1e-9:  # a square or a line
        first = 2 * u / (c + F.sqrt(F.greatest(c * c + 4 * b * u, F.lit(0.0))))
    else:
        p, q = b / a, c / a
        flat = (3 * q - p * p) / 9
        one = lambda turn: _one_root(turn, flat, p)
        any_ = (lambda turn: F.when(flat**3 + turn * turn < 0, _three_roots(turn, flat, p)).otherwise(one(turn))) if flat < 0 else one
        first = _bound((9 * p * q - 2 * p**3) / 54 + u * (0.5 / a), any_)
    return _bound(clamp01(first), lambda t: _sharpened(t, u, a, b, c))


def _root_by(u: Column, a: Column, b: Column, c: Column) -> Column:
    """``_root`` for coefficients in columns."""
    line = 2 * u / F.nullif(c + F.sqrt(F.greatest(c * c + 4 * b * u, F.lit(0.0))), F.lit(0.0))
    p, q = b / F.nullif(a, F.lit(0.0)), c / F.nullif(a, F.lit(0.0))
    cubic = _bound(F.struct(p.alias("p"), ((3 * q - p * p) / 9).alias("flat"), ((9 * p * q - 2 * p * p * p) / 54 + u * 0.5 / F.nullif(a, F.lit(0.0))).alias("turn")), lambda k: F.when(
        k["flat"] * k["flat"] * k["flat"] + k["turn"] * k["turn"] < 0, _three_roots(k["turn"], k["flat"], k["p"])).otherwise(_one_root(k["turn"], k["flat"], k["p"])))
    return _bound(F.when(F.abs(a) < 1e-9, line).otherwise(cubic), lambda t: _sharpened(clamp01(t), u, a, b, c))


def eased(ease: tuple | str, u: Column) -> Column:
    """A parsed or named curve at u, 0..1."""
    ease = (ease,) if isinstance(ease, str) else ease
    if ease[0] == "hold":
        return F.lit(0.0)
    if ease[0] == "linear":
        return u
    if ease[0] == "easeIn":
        return u * u * u
    if ease[0] == "easeOut":
        return 1 - (1 - u) * (1 - u) * (1 - u)
    if ease[0] == "easeInOut":
        back = -2 * u + 2
        return F.when(u < 0.5, 4 * u * u * u).otherwise(1 - back * back * back / 2)
    return bezier(u, *ease[1:])


def eased_by(ease: Column, u: Column, p: Column | None = None) -> Column:
    """The curve that a column names; a name that does not parse is linear. ``p``: its ``points``, where they are a column already."""
    p = points(ease) if p is None else p
    out = F.when(ease == "hold", 0.0)
    for name in NAMES[2:]:
        out = out.when(ease == name, eased(name, u))
    return out.when(p.isNotNull(), bezier(u, p[0], p[1], p[2], p[3])).otherwise(u)


def points(ease: Column) -> Column:
    """array<double> of the four numbers of a cubicBezier; null if it is none or not all are finite."""
    got = F.array(*[F.regexp_extract(ease, _BEZIER, i).try_cast("double") for i in range(1, 5)])
    ok = F.forall(got, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(ease.startswith("cubicBezier("), F.when(ease.rlike(_BEZIER) & ok, got))


def parsed(ease: Column) -> Column:
    """'hold' ... or 'cubicBezier'; null where the text is no easing."""
    return F.when(ease.isin(*NAMES), ease).when(points(ease).isNotNull(), F.lit("cubicBezier"))


def with_fallback(ease: Column) -> Column:
    """The parsed kind, linear where the text is no easing."""
    return F.coalesce(parsed(ease), F.lit("linear"))
