"""Colour: conversion, grading, lookup tables, noise, quantising. Channels are doubles, 0..1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .easing import clamp01

#: BT.709 luma weights, and the hue rotation as its three columns, each entry (constant, cos, sin).
LUMA = (0.2126, 0.7152, 0.0722)
HUE = (
    ((0.299, 0.701, 0.168), (0.587, -0.587, 0.330), (0.114, -0.114, -0.497)),
    ((0.299, -0.299, -0.328), (0.587, 0.413, 0.035), (0.114, -0.114, 0.292)),
    ((0.299, -0.300, 1.250), (0.587, -0.588, -1.050), (0.114, 0.886, -0.203)),
)
RGB = tuple[Column, Column, Column]
_M32 = 0xFFFFFFFF


def mix(a: Column, b: Column, t) -> Column:
    return a + (b - a) * t


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column) -> RGB:
    """BT.709 limited range, 0..1 in and out."""
    y = (y - 16 / 255) * (255 / 219)
    cb, cr = ((c - 128 / 255) * (255 / 224) for c in (cb, cr))
    return clamp01(y + 1.5748 * cr), clamp01(y - 0.1873 * cb - 0.4681 * cr), clamp01(y + 1.8556 * cb)


def contrast_brightness(rgb: RGB, contrast, brightness) -> RGB:
    return tuple((c - 0.5) * contrast + 0.5 + brightness for c in rgb)


def luma(rgb: RGB) -> Column:
    return sum((w * c for w, c in zip(LUMA[1:], rgb[1:])), LUMA[0] * rgb[0])


def saturated(rgb: RGB, amount) -> RGB:
    y = luma(rgb)
    return tuple(mix(y, c, amount) for c in rgb)


def hue_rotated(rgb: RGB, radians: Column | float) -> RGB:
    """The rotation as the kernel applies it: the triples are columns, so grey is not quite kept. Clamped."""
    angle = radians if isinstance(radians, Column) else F.lit(float(radians))
    c, s = F.cos(angle), F.sin(angle)
    entry = [[k + kc * c + ks * s for k, kc, ks in column] for column in HUE]
    return tuple(clamp01(entry[0][i] * rgb[0] + entry[1][i] * rgb[1] + entry[2][i] * rgb[2]) for i in range(3))


def graded(rgb: RGB, brightness=0.0, contrast=1.0, saturation=1.0, tint=0.0) -> RGB:
    """Contrast and brightness, saturation, hue, then the clamp."""
    return hue_rotated(saturated(contrast_brightness(rgb, contrast, brightness), saturation), tint)


def wang_hash(x: Column) -> Column:
    """The 32-bit hash on bigints: every product stays below 2^63."""
    x = x.bitwiseAND(_M32)
    x = x.bitwiseXOR(F.lit(61)).bitwiseXOR(F.shiftright(x, 16))
    x = (x * 9).bitwiseAND(_M32)
    x = x.bitwiseXOR(F.shiftright(x, 4))
    x = (x * 0x27D4EB2D).bitwiseAND(_M32)
    return x.bitwiseXOR(F.shiftright(x, 15))


def hash_noise(x: Column, y: Column, seed) -> Column:
    """0..1 from the low 24 bits."""
    h = wang_hash(x.cast("bigint") * 1973 + y.cast("bigint") * 9277 + seed * 26699)
    return h.bitwiseAND(0xFFFFFF) / float(0xFFFFFF)


def _where(strength, changed: RGB, rgb: RGB) -> RGB:
    """An effect that is skipped at a strength of 0.001 or less, where it is a number already in the plan."""
    if isinstance(strength, Column):
        return tuple(F.when(strength > 0.001, a).otherwise(b) for a, b in zip(changed, rgb))
    return changed if strength > 0.001 else rgb


def noisy(rgb: RGB, x: Column, y: Column, seed, strength) -> RGB:
    n = (hash_noise(x, y, seed) - 0.5) * (strength / 100)
    return _where(strength, tuple(clamp01(c + n) for c in rgb), rgb)


def grainy(rgb: RGB, y: Column, seed, strength) -> RGB:
    """One value for each row of pixels."""
    g = (hash_noise(y, F.lit(0), seed) - 0.5) * (strength / 200)
    return _where(strength, tuple(clamp01(c * (1 + g)) for c in rgb), rgb)


def quantized(c: Column) -> Column:
    """8-bit unorm, half to even."""
    return F.bround(clamp01(c) * 255, 0).cast("int")


def hex_channel(text: Column, i: int) -> Column:
    """Channel i, 0..1, of 'RRGGBB' or 'RRGGBBAA' with an optional '#'; alpha is 1 where it is missing; null where the text is neither."""
    digits = F.regexp_replace(text, "^#", "")
    part = F.conv(F.substring(digits, 2 * i + 1, 2), 16, 10).cast("double") / 255
    value = F.when(F.length(digits) == 6, F.lit(1.0) if i == 3 else part).otherwise(part)
    return F.when(digits.rlike("^([0-9A-Fa-f]{6}|[0-9A-Fa-f]{8})$"), value)


def identity_lut(spark, n: int = 33):
    """(ri, gi, bi, r, g, b) of the lookup table that changes nothing."""
    axis = lambda c: spark.range(n).select(F.col("id").cast("int").alias(c))
    table = axis("ri").crossJoin(axis("gi")).crossJoin(axis("bi"))
    return table.select("*", *[(F.col(f"{c}i") / (n - 1)).alias(c) for c in "rgb"])


def lut_corner(v: Column, n: int) -> tuple[Column, Column, Column]:
    """(lower index, upper index, weight of the upper) along one axis: texel centres, clamped to the edge."""
    at = F.greatest(F.lit(0.0), F.least(F.lit(float(n - 1)), v * n - 0.5))
    lo = F.floor(at).cast("int")
    return lo, F.least(lo + 1, F.lit(n - 1)), at - lo


def lut_sampled(rgb: RGB, table: Column, n: int, amount: float) -> RGB:
    """Trilinear lookup in ``table``, array<struct<r,g,b>> with r fastest; skipped where the amount is 0.001 or less."""
    if amount <= 0.001:
        return rgb
    (r0, r1, fr), (g0, g1, fg), (b0, b1, fb) = (lut_corner(c, n) for c in rgb)
    texel = lambda r, g, b: F.element_at(table, (r + g * n + b * n * n + 1).cast("int"))
    out = []
    for i, c in enumerate("rgb"):
        at = lambda r, g, b: texel(r, g, b)[c]  # noqa: B023, E731
        low = mix(mix(at(r0, g0, b0), at(r1, g0, b0), fr), mix(at(r0, g1, b0), at(r1, g1, b0), fr), fg)
        high = mix(mix(at(r0, g0, b1), at(r1, g0, b1), fr), mix(at(r0, g1, b1), at(r1, g1, b1), fr), fg)
        out.append(mix(rgb[i], mix(low, high, fb), amount))
    return tuple(out)
