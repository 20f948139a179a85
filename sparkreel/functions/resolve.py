"""Names in a spec resolved to values: presets, codecs, transitions, encoder settings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Transition names with kind and direction.
TRANSITIONS = {
    "cut": ("cut", 0, 0),
    "crossfade": ("crossfade", 0, 0),
    "dipToBlack": ("dipToBlack", 0, 0),
    "wipeLeft": ("wipe", 1, 0),
    "wipeRight": ("wipe", -1, 0),
    "wipeUp": ("wipe", 0, -1),
    "wipeDown": ("wipe", 0, 1),
    "slideLeft": ("slide", 1, 0),
    "slideRight": ("slide", -1, 0),
    "slideUp": ("slide", 0, -1),
    "slideDown": ("slide", 0, 1),
}
OVERLAPPING = ("crossfade", "wipe", "slide")


def preset(name: Column) -> tuple[Column, Column, Column]:
    """(width, height, bits a second)."""
    parts = F.filter(F.split(F.lower(name), "x"), lambda p: p != "")
    numbers = F.filter(F.transform(parts, lambda p: p.try_cast("bigint")), lambda n: n.isNotNull())
    sized = F.size(numbers) == 2
    w, h = F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1))
    small = F.lower(name) == "720p"
    default = lambda s, d: F.when(small, s).when(sized, None).otherwise(d)
    rate = F.greatest(F.lit(2_000_000).cast("bigint"), F.floor(w * h * 5 / 100).cast("bigint"))
    return (
        F.coalesce(default(720, 1080).cast("bigint"), w),
        F.coalesce(default(1280, 1920).cast("bigint"), h),
        F.coalesce(default(5_000_000, 10_000_000).cast("bigint"), rate),
    )


def codec(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low == "hevc", "hevc").when(low.isin("prores", "prores422hq"), "prores422hq").otherwise("h264")


def container(kind: Column) -> Column:
    return F.when(kind == "prores422hq", "mov").otherwise("mp4")


def transition(name: Column) -> tuple[Column, Column, Column, Column]:
    """(kind, direction x, direction y, unknown). An unknown name is a cut."""
    table = F.create_map(*[x for k, (kind, x, y) in TRANSITIONS.items() for x in (F.lit(k), F.struct(F.lit(kind).alias("kind"), F.lit(x).alias("dx"), F.lit(y).alias("dy")))])
    got = table[name]
    return F.coalesce(got["kind"], F.lit("cut")), F.coalesce(got["dx"], F.lit(0)), F.coalesce(got["dy"], F.lit(0)), got.isNull()


def encoder_settings(kind: Column, fps: Column, bitrate: Column, peak: Column, delivery: Column) -> dict[str, Column]:
    """What the encoder is told: a key frame each 2 s, the peak in bytes a second; ProRes takes none of it."""
    plain = kind != "prores422hq"
    return {
        "gop": F.when(plain, (fps * 2).cast("bigint")),
        "reorder": F.when(plain, delivery),
        "bitrate": F.when(plain, bitrate),
        "peak_bytes": F.when(plain & delivery, F.floor(F.coalesce(peak, F.floor(bitrate * 1.5)) / 8).cast("bigint")),
        "container": container(kind),
    }


def logo_size(canvas_w: Column, fraction: Column, img_w: Column, img_h: Column) -> tuple[Column, Column]:
    w = canvas_w * fraction
    return w, w * img_h / img_w
