"""Chunked processing: even splits of time, rebased times, ordered concatenation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordered import numbered

#: Fixed value: shorter inputs, in seconds, stay whole.
LEAST_SECONDS = 5.0


def effective(total: float, chunks: int) -> int:
    return 1 if chunks == 1 or total < LEAST_SECONDS else chunks


def chunk_of(t: Column, total: float, chunks: int) -> Column:
    """The chunk of a time; the last takes the remainder."""
    n = effective(total, chunks)
    return F.least(F.floor(t / (total / n)), F.lit(n - 1)).cast("int") if n > 1 else F.lit(0)


def rebased(df: DataFrame, chunk: str, t: str, order: str, width: float = 1.0) -> DataFrame:
    """``local``, the time since the chunk's first frame, and ``chunk_frame``, the frame's number in it.

    A chunk is spread over tasks by buckets of ``width`` in time; its first time is one row per chunk.
    """
    first = df.groupBy(chunk).agg(F.min(t).alias("__first"))
    d = df.join(F.broadcast(first), chunk).withColumn("local", F.col(t) - F.col("__first")).drop("__first")
    return numbered(d, [F.floor(F.col(t) / width)], [t, order], "chunk_frame", (chunk,)).select(*df.columns, "local", "chunk_frame")


def cursors(df: DataFrame, chunk: str, seconds: str) -> DataFrame:
    """One row per chunk (few), with the running sum of the lengths before it."""
    return df.withColumn("cursor", F.sum(seconds).over(W.orderBy(chunk).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col(seconds))


def concatenated(parts: list[DataFrame]) -> DataFrame:
    """Parts in order, numbered by ``part``; a writer that sorts by (part, time) keeps the order."""
    return reduce(lambda a, b: a.unionByName(b), [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)])
