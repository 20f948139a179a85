"""Geometry: letterbox, sampling coordinates, anchors, Ken Burns windows, bands."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The safe-area insets of a 1080 x 1920 canvas.
INSET_X, INSET_Y = 32.0, 58.0
CANVAS_W, CANVAS_H = 1080.0, 1920.0
#: Corner codes as numpad positions.
CORNERS = {"tl": 7, "tc": 8, "tr": 9, "ml": 4, "mc": 5, "mr": 6, "bl": 1, "bc": 2, "br": 3}


def _num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def clamp(x: Column, lo, hi) -> Column:
    return F.greatest(_num(lo), F.least(_num(hi), x))


def letterbox(src_w, src_h, dst_w, dst_h) -> tuple[Column, Column, Column, Column]:
    """(x, y, width, height) of the source fitted into the destination and centred."""
    src_w, src_h, dst_w, dst_h = map(_num, (src_w, src_h, dst_w, dst_h))
    ratio = src_w / src_h
    wide = ratio > dst_w / dst_h
    w = F.when(wide, dst_w).otherwise(dst_h * ratio)
    h = F.when(wide, dst_w / ratio).otherwise(dst_h)
    zero = F.lit(0.0)
    return F.when(wide, zero).otherwise((dst_w - w) / 2), F.when(wide, (dst_h - h) / 2).otherwise(zero), w, h


def inside(px: Column, py: Column, box) -> Column:
    x, y, w, h = box
    return (px >= x) & (py >= y) & (px < x + w) & (py < y + h)


def bypass_uv(u: Column, v: Column, mirror: bool = False, zoom=1.0, crop=0.0) -> tuple[Column, Column]:
    """Mirrored, zoomed and cropped source coordinates."""
    k = (1 - _num(crop)) / _num(zoom)
    u = 1 - u if mirror else u
    return (u - 0.5) * k + 0.5, (v - 0.5) * k + 0.5


def guarded(zoom: Column, crop: Column, noise: Column, grain: Column, sigma: Column, band: Column) -> tuple[Column, ...]:
    """The kernel's limits, taken after tracks are evaluated."""
    zero = F.lit(0.0)
    return F.greatest(zoom, F.lit(1.0)), clamp(crop, 0, 0.5), F.greatest(noise, zero), F.greatest(grain, zero), F.greatest(sigma, zero), clamp(band, 0, 0.5)


def bilinear(plane: Column, width: int, height: int, u: Column, v: Column) -> Column:
    """A row-major plane (array<double>) at normalized coordinates, clamped to the edge; texel centres are at half steps."""
    x, y = u * width - 0.5, v * height - 0.5
    x0, y0 = F.floor(x), F.floor(y)
    fx, fy = x - x0, y - y0
    at = lambda i, j: F.element_at(plane, (clamp(j, 0, height - 1) * width + clamp(i, 0, width - 1) + 1).cast("int"))
    top = at(x0, y0) * (1 - fx) + at(x0 + 1, y0) * fx
    bottom = at(x0, y0 + 1) * (1 - fx) + at(x0 + 1, y0 + 1) * fx
    return top * (1 - fy) + bottom * fy


def gaussian(plane: Column, width: int, height: int, u: Column, v: Column, step_u: float, step_v: float) -> Column:
    """The weighted mean of 13 x 13 bilinear taps around a point; weights fall off with 3 taps."""
    taps = [(i, j, math.exp(-(i * i + j * j) / 18)) for j in range(-6, 7) for i in range(-6, 7)]
    grid = F.array(*[F.struct(F.lit(i * step_u).alias("u"), F.lit(j * step_v).alias("v"), F.lit(w).alias("w")) for i, j, w in taps])
    total = F.aggregate(grid, F.lit(0.0), lambda acc, t: acc + bilinear(plane, width, height, u + t["u"], v + t["v"]) * t["w"])
    return total / sum(w for _, _, w in taps)


def anchor(w: Column, h: Column, canvas_w, canvas_h, position: Column, dx: Column, dy: Column) -> tuple[Column, Column]:
    """Whole-pixel origin of an overlay at a numpad position; anything else is bottom centre."""
    cw, ch = _num(canvas_w), _num(canvas_h)
    kx, ky = cw / CANVAS_W, ch / CANVAS_H
    x = F.when(position.isin(1, 4, 7), INSET_X * kx).when(position.isin(3, 6, 9), cw - w - INSET_X * kx).otherwise((cw - w) / 2)
    y = F.when(position.isin(7, 8, 9), INSET_Y * ky).when(position.isin(4, 5, 6), (ch - h) / 2).otherwise(ch - h - INSET_Y * ky)
    limit = lambda at, room: F.round(F.greatest(F.lit(0.0), F.least(room, at)), 0)
    return limit(x + dx * kx, cw - w), limit(y + dy * ky, ch - h)


def ken_burns(img_w: Column, img_h: Column, w: Column, h: Column, zoom: Column, cx: Column, cy: Column) -> tuple[Column, ...]:
    """(x, y, width, height) of the source window with the aspect of a w x h rectangle, in 0..1."""
    image, target = img_w / img_h, w / F.greatest(F.lit(1.0), h)
    z = F.greatest(F.lit(1.0), zoom)
    ww = F.when(image > target, target / image).otherwise(1.0) / z
    hh = F.when(image > target, 1.0).otherwise(image / target) / z
    centre = lambda c, s: F.least(1 - s / 2, F.greatest(s / 2, c))
    return centre(cx, ww) - ww / 2, centre(cy, hh) - hh / 2, ww, hh


def edge_alpha(y: Column, height, band: float) -> Column:
    """How far the top and bottom bands have blurred away at a row of pixels."""
    n = y / _num(height)
    return F.when(n <= band, 1 - n / band).when(n >= 1 - band, (n - (1 - band)) / band).otherwise(0.0)


def corner_position(code: Column) -> Column:
    """A corner code as a numpad position; null for any other text."""
    return F.create_map(*[F.lit(x) for kv in CORNERS.items() for x in kv])[code]


def text_box(w: Column, h: Column, shadow: Column, pill: Column) -> tuple[Column, Column]:
    """A text's box: 4 pixels a side for a shadow and 12 for a pill."""
    pad = F.when(shadow, 4).otherwise(0) + F.when(pill, 12).otherwise(0)
    return w + 2 * pad, h + 2 * pad
