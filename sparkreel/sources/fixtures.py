"""Generated inputs: moving test frames as planes, cues in even steps, sample tables. They need no file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def test_frames(spark: SparkSession, seconds: float, fps: float, width: int, height: int) -> DataFrame:
    """(pts, luma, cb, cr): a gradient that moves by a pixel a frame, inside the limited range."""
    k = F.col("id")
    plane = lambda w, h, f: F.transform(F.sequence(F.lit(0), F.lit(w * h - 1)), lambda i: f(i % w, F.floor(i / w)))
    level = lambda n: (16 + n % 220) / 255
    luma = plane(width, height, lambda x, y: level(x * 7 + y * 3 + k))
    cb, cr = (plane(width // 2, height // 2, lambda x, y, m=m: level(x * m + y * 5 + k * 2 + 60)) for m in (11, 4))
    return spark.range(int(seconds * fps)).select((k / fps).alias("pts"), luma.alias("luma"), cb.alias("cb"), cr.alias("cr"))


def cues(spark: SparkSession, seconds: float, every: float, shown: float) -> DataFrame:
    """(start, end, text): a cue each ``every`` seconds that stays for ``shown``."""
    start = F.col("id") * every
    return spark.range(int(seconds // every)).select(start.alias("start"), (start + shown).alias("end"), F.concat(F.lit("cue "), F.col("id").cast("string")).alias("text"))


def tone(spark: SparkSession, seconds: float, rate: int, hertz: float) -> DataFrame:
    """(n, ch, v): a sine on two channels."""
    import math

    v = F.sin(F.col("id") * (2 * math.pi * hertz / rate)) * 0.5
    return spark.range(int(seconds * rate)).select(F.col("id").alias("n"), F.explode(F.array(F.lit(0), F.lit(1))).alias("ch"), v.alias("v"))
