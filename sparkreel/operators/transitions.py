"""Transition blends and fades, per pixel or per frame."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkreel.functions.color import mix
from sparkreel.functions.easing import clamp01

#: Fixed value: half the width of a wipe's lip.
SOFTNESS = 0.04


def crossfade(a: Column, b: Column, progress: Column) -> Column:
    return mix(a, b, progress)


def smoothstep(lo: Column, hi: Column, x: Column) -> Column:
    z = clamp01((x - lo) / (hi - lo))
    return z * z * (3 - 2 * z)


def wipe_amount(u: Column, v: Column, dx: int, dy: int, progress: Column, softness: float = SOFTNESS) -> Column:
    """How much of B shows at (u, v); row 0 is the top, so direction (0, -1) enters from the bottom."""
    swept = u if dx > 0 else 1 - u if dx < 0 else v if dy > 0 else 1 - v
    edge = mix(F.lit(-softness), F.lit(1 + softness), progress)
    return 1 - smoothstep(edge - softness, edge + softness, swept)


def slide_source(u: Column, v: Column, dx: int, dy: int, progress: Column) -> tuple[Column, Column, Column]:
    """(u, v, shows): where B is sampled as it is pushed over A, and whether it covers the pixel."""
    bu, bv = u + dx * (1 - progress), v + dy * (1 - progress)
    return bu, bv, bu.between(0, 1) & bv.between(0, 1)


def fade(t: Column, duration: Column | float, fade_in: float | None, fade_out: float | None) -> Column:
    """Opacity of black over the whole output."""
    duration = duration if isinstance(duration, Column) else F.lit(float(duration))
    a = F.lit(0.0)
    if fade_in and fade_in > 0:
        a = F.greatest(a, F.when(t < fade_in, 1 - t / fade_in).otherwise(0.0))
    if fade_out and fade_out > 0:
        start = duration - fade_out
        a = F.greatest(a, F.when((duration > 0) & (t > start), (t - start) / fade_out).otherwise(0.0))
    return clamp01(a)


def dip(local: Column, duration: Column, kind_out: Column, d_out: Column, kind_in: Column, d_in: Column) -> Column:
    """Opacity of black around hard cuts that dip; half of the transition lies on either side. Not clamped."""
    leaving = (kind_out == "dipToBlack") & (d_out > 0) & (local > duration - d_out / 2)
    entering = (kind_in == "dipToBlack") & (d_in > 0) & (local < d_in / 2)
    out = F.when(leaving, (local - (duration - d_out / 2)) / (d_out / 2)).otherwise(0.0)
    into = F.when(entering, 1 - local / (d_in / 2)).otherwise(0.0)
    return F.greatest(out, into)
