"""Audio: mixing of sample tables, chunk plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkreel.functions.geometry import clamp


def mixed(narration: DataFrame, music: DataFrame | None, volume: float, keys: tuple[str, ...] = ("n", "ch")) -> DataFrame:
    """Narration (n, ch, v) plus music at ``volume``, clamped to -1..1 where both sound. Music beyond the narration is dropped."""
    volume = max(0.0, min(1.0, volume))
    if music is None or volume <= 0:
        return narration
    m = music.select(*keys, F.col("v").alias("__m"))
    v = F.when(F.col("__m").isNull(), F.col("v")).otherwise(clamp(F.col("v") + F.col("__m") * volume, -1, 1))
    return narration.join(m, list(keys), "left").withColumn("v", v).drop("__m")


def chunk(n: Column, rate: int) -> Column:
    """The chunk, of one second, that a sample is fed in."""
    return F.floor(n / rate).cast("bigint")
