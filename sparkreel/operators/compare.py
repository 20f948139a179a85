"""Parity of renders, and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mse(a: list[Column], b: list[Column]) -> Column:
    """Aggregate: the mean squared difference over channels."""
    return F.avg(sum(((x - y) * (x - y) for x, y in zip(a[1:], b[1:])), (a[0] - b[0]) * (a[0] - b[0])) / len(a))


def parity(a: DataFrame, b: DataFrame, keys: list[str], channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """One row for two renders, joined pixel by pixel: ``pixels`` both have, ``missing`` that one lacks, ``mse``, ``psnr``."""
    other = b.select(*keys, *[F.col(c).alias(f"__{c}") for c in channels], F.lit(True).alias("__in_b"))
    both = a.select(*keys, *channels, F.lit(True).alias("__in_a")).join(other, keys, "full")
    error = mse([F.col(c) for c in channels], [F.col(f"__{c}") for c in channels])
    got = both.agg(F.count_if(F.col("__in_a") & F.col("__in_b")).alias("pixels"), F.count_if(F.col("__in_a").isNull() | F.col("__in_b").isNull()).alias("missing"), error.alias("mse"))
    return got.withColumn("psnr", psnr(F.col("mse")))


def psnr(error: Column) -> Column:
    """Decibels of a mean squared error of 0..1 channels; infinite where it is 0."""
    return F.when(error == 0, F.lit(float("inf"))).otherwise(10 * F.log10(1 / error))


def frame_digest(rows: DataFrame, frame: str, order: list[str], value: Column) -> DataFrame:
    """One digest per frame over its values in order. A frame is the unit of output, so its pixels come together."""
    parts = rows.select(frame, F.struct(*order, value.alias("value")).alias("p"))
    return parts.groupBy(frame).agg(F.md5(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["value"]), ",")).alias("digest"))


def realtime_ratio(source_seconds: Column, wall: Column) -> Column:
    return F.when(wall > 0, source_seconds / wall).otherwise(0.0)
