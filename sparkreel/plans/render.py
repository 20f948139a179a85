"""Render plans: the main pass, whole frames, chunks and probes."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkreel.functions import color, geometry
from sparkreel.functions.easing import clamp01
from sparkreel.functions.resolve import OVERLAPPING, TRANSITIONS
from sparkreel.operators import composite, transitions
from sparkreel.operators.tracks import Key, literal_track
from sparkreel.sources.spec import NoFrame


@dataclass(frozen=True)
class Look:
    """Grade and bypass; a track replaces the value of its name at each time."""

    brightness: float = 0.0
    contrast: float = 1.0
    saturation: float = 1.0
    tint: float = 0.0
    noise: float = 0.0
    grain: float = 0.0
    lut_mix: float = 0.0
    mirror: bool = False
    zoom: float = 1.0
    crop: float = 0.0
    sigma: float = 0.0
    band: float = 0.12
    tracks: dict[str, list[Key]] = field(default_factory=dict)

    def at(self, name: str, tracked: bool) -> Column | float:
        return F.col(f"at_{name}") if tracked and name in self.tracks else getattr(self, name)

    def grade_only(self) -> Look:
        """What chunked renders keep."""
        return Look(self.brightness, self.contrast, self.saturation, self.tint)


def with_tracks(df: DataFrame, look: Look, t: Column) -> DataFrame:
    """``df`` with ``at_<name>``, each track's value at ``t``: a column of its own, so it is worked out once per row."""
    return df.withColumns({f"at_{name}": literal_track(t, keys) for name, keys in look.tracks.items()})


def main_pass(rgb: color.RGB, look: Look, x: Column, y: Column, seed: Column, tracked: bool = False, lut: Column | None = None, n: int = 33) -> color.RGB:
    """Grade, lookup table, noise, grain: one expression, so one pass over the pixels. ``tracked``: the rows come from with_tracks."""
    rgb = color.graded(rgb, *(look.at(c, tracked) for c in ("brightness", "contrast", "saturation", "tint")))
    if lut is not None:
        rgb = color.lut_sampled(rgb, lut, n, look.lut_mix)
    return textured(rgb, look, x, y, seed, tracked)


def textured(rgb: color.RGB, look: Look, x: Column, y: Column, seed: Column, tracked: bool = False) -> color.RGB:
    """Noise, then grain."""
    rgb = color.noisy(rgb, x, y, seed, look.at("noise", tracked))
    return color.grainy(rgb, y, seed, look.at("grain", tracked))


@dataclass(frozen=True)
class Shape:
    """Sizes of the luma plane, whose chroma planes have half of each, and of the output."""

    src_w: int
    src_h: int
    dst_w: int
    dst_h: int


def plane_colours(df: DataFrame, look: Look, shape: Shape, fu: Column, fv: Column, lut: bool, n: int, out: tuple[str, str, str]) -> DataFrame:
    """``df`` (luma, cb, cr, lut) with the graded colour at a place of the fitted rectangle, 0..1, in ``out``.

    Source coordinates, sampling, conversion, contrast, saturation, hue, lookup table: a projection each, as every step
    uses the values before it several times.
    """
    tracked, start = bool(look.tracks), df.columns
    step = lambda d, names, values: d.withColumns(dict(zip(names, values)))
    zoom, crop = F.greatest(F.lit(1.0), geometry._num(look.at("zoom", tracked))), geometry.clamp(geometry._num(look.at("crop", tracked)), 0, 0.5)
    df = step(df, ("__u", "__v"), (fu, fv))
    df = step(df, ("__u", "__v"), geometry.bypass_uv(F.col("__u"), F.col("__v"), look.mirror, zoom, crop))
    sizes = {"luma": (shape.src_w, shape.src_h), "cb": (shape.src_w // 2, shape.src_h // 2), "cr": (shape.src_w // 2, shape.src_h // 2)}
    df = step(df, [f"__{c}" for c in sizes], [geometry.bilinear(F.col(c), *size, F.col("__u"), F.col("__v")) for c, size in sizes.items()])
    rgb = tuple(map(F.col, out))
    df = step(df, out, color.ycbcr_to_rgb(*(F.col(f"__{c}") for c in sizes)))
    df = step(df, out, color.contrast_brightness(rgb, look.at("contrast", tracked), look.at("brightness", tracked)))
    df = step(df, out, color.saturated(rgb, look.at("saturation", tracked)))
    df = step(df, out, color.hue_rotated(rgb, look.at("tint", tracked)))
    if lut:
        df = step(df, out, color.lut_sampled(rgb, F.col("lut"), n, look.lut_mix))
    return df.select(*start, *[c for c in out if c not in start])


#: Taps on either side of a blurred pixel, and their fall-off in taps.
TAPS, FALL_OFF = 6, 3.0


def planes_rendered(frames: DataFrame, look: Look, shape: Shape, keep: list[str], seed: str, lut: DataFrame | None = None, n: int = 33) -> DataFrame:
    """The whole main pass: frames (``keep``, luma, cb, cr: array<double>, at_ columns of with_tracks) as pixels (keep, x, y, r, g, b).

    Letterbox, source coordinates, sampling, conversion, grade, lookup table, edge blur, noise, grain. ``seed`` is one
    of ``keep``. ``lut``: one row with ``lut``, array<struct<r,g,b>> of n^3 entries, broadcast. Only pixels of the
    blurred bands are multiplied by their taps, which are summed before any shuffle.
    """
    tracked = bool(look.tracks)
    scalars = [*keep, *(f"at_{c}" for c in look.tracks)]
    axis = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    px = frames.select(*scalars, "luma", "cb", "cr", axis(shape.dst_w).alias("x")).withColumn("y", axis(shape.dst_h))
    px = px.crossJoin(F.broadcast(lut)) if lut is not None else px
    box = geometry.letterbox(shape.src_w, shape.src_h, shape.dst_w, shape.dst_h)
    x, y = F.col("x"), F.col("y")
    fu, fv = (x - box[0]) / box[2], (y - box[1]) / box[3]
    seen = geometry.inside(x, y, box)
    black = px.filter(~seen).select(*scalars, "x", "y", *[F.lit(0.0).alias(c) for c in "rgb"])
    px = plane_colours(px.filter(seen), look, shape, fu, fv, lut is not None, n, ("r", "g", "b"))
    out = px
    if look.sigma > 0.001 and look.band > 0.001:
        alpha = geometry.edge_alpha(y, shape.dst_h, look.band)
        step = max(look.sigma / TAPS, 1.0)
        taps = [(i, j, math.exp(-(i * i + j * j) / (2 * FALL_OFF * FALL_OFF))) for j in range(-TAPS, TAPS + 1) for i in range(-TAPS, TAPS + 1)]
        grid = F.array(*[F.struct(F.lit(i * step).alias("i"), F.lit(j * step).alias("j"), F.lit(w).alias("w")) for i, j, w in taps])
        soft = px.withColumn("alpha", alpha).filter("alpha > 0.001").withColumn("tap", F.explode(grid))
        soft = plane_colours(soft, look, shape, fu + F.col("tap.i") / box[2], fv + F.col("tap.j") / box[3], lut is not None, n, ("tr", "tg", "tb"))
        soft = soft.groupBy(*scalars, "x", "y", "r", "g", "b", "alpha").agg(*[(F.sum(F.col(f"t{k}") * F.col("tap.w")) / F.sum("tap.w")).alias(f"b{k}") for k in "rgb"])
        soft = soft.select(*scalars, "x", "y", *[color.mix(F.col(c), F.col(f"b{c}"), F.col("alpha")).alias(c) for c in "rgb"])
        out = px.filter(alpha <= 0.001).select(*soft.columns).unionByName(soft)
    out = out.withColumns(dict(zip("rgb", textured(tuple(map(F.col, "rgb")), look, x, y, F.col(seed), tracked))))
    return out.select(*black.columns).unionByName(black).select(*keep, "x", "y", *"rgb")


@dataclass(frozen=True)
class Layer:
    """An overlay of one colour (premultiplied by its alpha) over a rectangle; bounds of time may be open, keys scale the opacity."""

    z: int
    rgb: tuple[float, float, float]
    alpha: float
    opacity: float = 1.0
    start: float | None = None
    end: float | None = None
    keys: tuple[Key, ...] = ()
    rect: tuple[float, float, float, float] | None = None


def overlaid(df: DataFrame, layers: list[Layer], t: Column, x: Column, y: Column) -> DataFrame:
    """``df`` (r, g, b) under the layers that are visible at ``t``."""
    null = F.lit(None).cast("double")
    bound = lambda v: null if v is None else F.lit(float(v))
    parts = []
    for l in layers:
        shown = composite.visible(t, bound(l.start), bound(l.end))
        if l.rect:
            shown &= composite.covers(x, y, *(F.lit(float(v)) for v in l.rect))
        opacity = l.opacity * clamp01(literal_track(t, list(l.keys))) if l.keys else F.lit(float(l.opacity))
        parts.append((l.z, [F.lit(float(c)) for c in l.rgb], F.lit(float(l.alpha)), F.when(shown, opacity).otherwise(0.0)))
    return composite.layered(df, parts)


def transition_blend(a: color.RGB, b: color.RGB, kind: Column, u: Column, v: Column, progress: Column) -> color.RGB:
    """Each overlapping transition's own blend; ``kind`` is a name of TRANSITIONS. A null progress leaves A."""
    out = list(a)
    for name, (family, dx, dy) in TRANSITIONS.items():
        if family not in OVERLAPPING:
            continue
        if family == "slide":
            shows = transitions.slide_source(u, v, dx, dy, progress)[2]
            got = [F.when(shows, q).otherwise(p) for p, q in zip(a, b)]
        else:
            amount = progress if family == "crossfade" else transitions.wipe_amount(u, v, dx, dy, progress)
            got = [color.mix(p, q, amount) for p, q in zip(a, b)]
        out = [F.when((kind == name) & progress.isNotNull(), g).otherwise(o) for g, o in zip(got, out)]
    return tuple(out)


def faded(df: DataFrame, alpha: Column) -> DataFrame:
    """``df`` (r, g, b) under black."""
    return composite.layered(df, [(0, [F.lit(0.0)] * 3, F.lit(1.0), F.least(F.lit(1.0), alpha))])


def fade_alpha(t: Column, total: float, fade_in: float | None, fade_out: float | None) -> Column:
    """Fades of the whole output and dips around hard cuts, the stronger of both; rows come from on_timeline."""
    dips = transitions.dip(*(F.col(c) for c in ("pts", "duration", "kind_out", "d_out", "kind_in", "d_in")))
    return F.greatest(transitions.fade(t, total, fade_in, fade_out), dips)


def render(pixels: DataFrame, look: Look, seed: Column, t: str | None = None) -> DataFrame:
    """``pixels`` (x, y, r, g, b, ...) with r, g and b rendered."""
    tracked = with_tracks(pixels, look, F.col(t)) if t else pixels
    rgb = main_pass(tuple(F.col(c) for c in "rgb"), look, F.col("x"), F.col("y"), seed, bool(t))
    return tracked.withColumns(dict(zip("rgb", rgb))).select(*pixels.columns)


def letterboxed(rgb: color.RGB, px: Column, py: Column, box) -> color.RGB:
    """Black outside the fitted rectangle."""
    seen = geometry.inside(px, py, box)
    return tuple(F.when(seen, c).otherwise(0.0) for c in rgb)


def probe(frames: DataFrame, t: str, at: float, order: str) -> DataFrame:
    """One row: the first frame at or after a time. The query fails with NoFrame in its message where there is none."""
    row = frames.filter(F.col(t) >= at).agg(F.min_by(F.struct(*frames.columns), F.struct(t, order)).alias("f"))
    found = row.select(F.coalesce("f", F.raise_error(F.lit(f"{NoFrame.__name__}: no frame at or after {at}")).cast(row.schema["f"].dataType)).alias("f"))
    return found.select("f.*")


def probes(frames: DataFrame, key: str, t: str, at: Column, order: str) -> DataFrame:
    """Of each ``key`` the first frame at or after a time, which may depend on the key; keys without one have no row."""
    row = frames.filter(F.col(t) >= at).groupBy(key).agg(F.min_by(F.struct(*[c for c in frames.columns if c != key]), F.struct(t, order)).alias("f"))
    return row.select(key, "f.*")
