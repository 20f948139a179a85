"""Visibility windows and ordered compositing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkreel.functions.easing import clamp01
from sparkreel.functions.geometry import CANVAS_H, CANVAS_W


def visible(t: Column, start: Column, end: Column) -> Column:
    """start <= t < end; a null bound is open."""
    return (start.isNull() | (t >= start)) & (end.isNull() | (t < end))


def interval_join(points: DataFrame, windows: DataFrame, keys: list[str], t: str, start: str, end: str, width: float) -> DataFrame:
    """Points with the half-open windows that hold them. Windows may overlap.

    Both sides are cut into buckets of ``width``, which turns the range condition into an equi-join: a window takes part
    once for each bucket it touches, a point once. A width near the windows' length keeps both low.
    """
    w = windows.withColumn("__k", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    p = points.withColumn("__k", F.floor(F.col(t) / width))
    return p.join(w, [*keys, "__k"]).filter((F.col(t) >= F.col(start)) & (F.col(t) < F.col(end))).drop("__k")


def changes(df: DataFrame, keys: list[str], order: list[str], state: str) -> DataFrame:
    """``df`` with ``changed``: whether ``state`` differs from the row before; the first row of a key has changed."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("changed", (F.row_number().over(w) == 1) | ~F.col(state).eqNullSafe(F.lag(state).over(w)))


def overlay_state(x, y, w, h, opacity, canvas_w, canvas_h, opacity_at=None, dx=None, dy=None, scale=None) -> dict[str, Column]:
    """An overlay's rectangle and opacity once its tracks have values: offset first, then scaled about its centre."""
    if dx is not None or dy is not None:
        x = x + (dx if dx is not None else 0) * (canvas_w / CANVAS_W)
        y = y + (dy if dy is not None else 0) * (canvas_h / CANVAS_H)
    if scale is not None:
        s = F.greatest(F.lit(0.0), scale)
        x, y, w, h = x + w * (1 - s) / 2, y + h * (1 - s) / 2, w * s, h * s
    return {"x": x, "y": y, "w": w, "h": h, "opacity": opacity * clamp01(opacity_at) if opacity_at is not None else opacity}


def over(bg: Column, src: Column, alpha: Column, opacity: Column | float) -> Column:
    """One channel of a premultiplied source over an opaque background."""
    return src * opacity + (1 - alpha * opacity) * bg


def covers(px: Column, py: Column, x: Column, y: Column, w: Column, h: Column, clip_right: Column | float = 1.0) -> Column:
    """Whether an overlay draws at a pixel: in its rectangle and not right of the clip."""
    u = (px - x + 0.5) / w
    return (px >= x) & (py >= y) & (px < x + w) & (py < y + h) & (u <= clip_right)


def layered(df: DataFrame, layers: list[tuple], channels: str = "rgb") -> DataFrame:
    """``df`` with its channels under layers that the plan knows: (z, source channels, alpha, opacity), in order of z.

    Each layer is one projection, so all of them are generated code with no array.
    """
    for _, src, alpha, opacity in sorted(layers, key=lambda l: l[0]):
        df = df.withColumns({c: over(F.col(c), s, alpha, opacity) for c, s in zip(channels, src)})
    return df


def composed(bg: Column, layers: Column) -> Column:
    """struct<r,g,b> background under ``layers``, array<struct<z,r,g,b,a,opacity>> of any number, folded in order of z. See ``layered``."""
    step = lambda acc, l: F.struct(*[over(acc[c], l[c], l["a"], l["opacity"]).alias(c) for c in "rgb"])
    return F.aggregate(F.array_sort(layers), bg, step)


def glyph_step(acc: Column, mask: Column, color: Column) -> Column:
    """One glyph over an 8-bit premultiplied struct<r,g,b,a>, in truncating integer arithmetic. ``color`` is 0xRRGGBBAA with inverted alpha."""
    byte = lambda n: F.shiftright(color, n).bitwiseAND(255)
    div = lambda a, n: F.floor(a / n).cast("bigint")
    a16 = mask * (255 - byte(0))
    alpha = div(a16, 255)
    src = {"r": div(byte(24) * a16, 65025), "g": div(byte(16) * a16, 65025), "b": div(byte(8) * a16, 65025), "a": alpha}
    out = F.struct(*[F.least(F.lit(255).cast("bigint"), s + div(acc[c] * (255 - alpha), 255)).alias(c) for c, s in src.items()])
    return F.when((mask == 0) | (byte(0) >= 255), acc).otherwise(out)


def drawn(df: DataFrame, images: list[tuple]) -> DataFrame:
    """``df`` (r, g, b, a) with glyphs that the plan knows, (ord, mask, color), drawn in order: one projection each."""
    for _, mask, color in sorted(images, key=lambda g: g[0]):
        out = glyph_step(F.struct(*"rgba"), mask, color)
        df = df.withColumns({c: out[c] for c in "rgba"})
    return df


def glyphs(bg: Column, images: Column) -> Column:
    """``images``, array<struct<ord, mask, color>> of any number, drawn in order. See ``drawn``."""
    return F.aggregate(F.array_sort(images), bg, lambda acc, g: glyph_step(acc, g["mask"], g["color"]))


def checker(x: Column, y: Column, size: int = 8) -> Column:
    """The checkerboard backdrop, 8-bit grey."""
    return F.when((F.floor(x / size) + F.floor(y / size)) % 2 == 0, 90).otherwise(160)
