"""Playlist timelines: clamped transitions, segment offsets, emitted frames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkreel.functions.resolve import OVERLAPPING, TRANSITIONS

from .ordered import asof_join, numbered

#: Fixed value: the tolerance, in seconds, of time comparisons.
EPSILON = 1e-4


@dataclass(frozen=True)
class Transition:
    """Out of a segment; the name is one of TRANSITIONS."""

    name: str
    seconds: float = 0.5
    ease: str = "linear"


@dataclass(frozen=True)
class Slot:
    """A segment in place; d is the transition's clamped length, 0 without one."""

    seg_idx: int
    offset: float
    duration: float
    name: str | None
    d: float
    overlaps: bool
    ease: str


def resolve(durations: list[float], out: list[Transition | None]) -> list[Slot]:
    """Offsets and clamped transitions. Each depends on the one before, so this is a fold; segments are few (one per clip)."""
    slots, offset, before = [], 0.0, 0.0
    for i, seg in enumerate(durations):
        tr = out[i] if i < len(out) and i + 1 < len(durations) else None
        name = tr.name if tr and tr.name in TRANSITIONS and tr.name != "cut" else None
        over = bool(name) and TRANSITIONS[name][0] in OVERLAPPING
        d = 0.0
        if name:
            d = max(0.0, min(tr.seconds, seg - before if over else seg, durations[i + 1]))
        slots.append(Slot(i, offset, seg, name, d, over, tr.ease if tr else "linear"))
        before = d if over else 0.0
        offset += seg - before
    return slots


def total_seconds(slots: list[Slot]) -> float:
    return slots[-1].offset + slots[-1].duration if slots else 0.0


def as_table(spark: SparkSession, slots: list[Slot]) -> DataFrame:
    """One row per segment, with the transition into it."""
    rows = [(s.seg_idx, s.offset, s.duration, s.name, s.d, s.overlaps, s.ease, slots[i - 1].name if i else None, slots[i - 1].d if i else 0.0) for i, s in enumerate(slots)]
    return spark.createDataFrame(rows, "seg_idx int, offset double, duration double, kind_out string, d_out double, overlaps boolean, ease_out string, kind_in string, d_in double")


def on_timeline(frames: DataFrame, table: DataFrame) -> DataFrame:
    """``frames`` (seg_idx, pts, ...) with their segment's columns and ``out_pts``. The table has one row per segment and is broadcast."""
    return frames.join(F.broadcast(table), "seg_idx").withColumn("out_pts", F.col("offset") + F.col("pts"))


def emitted(placed: DataFrame) -> DataFrame:
    """Frames beyond all that earlier segments have shown: the maximum per segment, then a running maximum over segments."""
    ends = placed.groupBy("seg_idx").agg(F.max("out_pts").alias("end"))
    before = W.orderBy("seg_idx").rowsBetween(W.unboundedPreceding, -1)  # over one row per segment
    mark = ends.select("seg_idx", F.max("end").over(before).alias("mark"))
    shown = placed.join(F.broadcast(mark), "seg_idx", "left")
    return shown.filter(F.col("mark").isNull() | (F.col("out_pts") > F.col("mark") + EPSILON)).drop("mark")


def frame_index(shown: DataFrame, order: str, width: float = 1.0) -> DataFrame:
    """``frame_no`` over all emitted frames by segment and time; the noise seed of a frame is frame_no + 1."""
    return numbered(shown, [F.col("seg_idx"), F.floor(F.col("pts") / width)], ["pts", order], "frame_no")


def segment_at(times: DataFrame, t: str, slots: list[Slot]) -> DataFrame:
    """``times`` with the last segment whose offset is at most ``t``; the first one before that."""
    chain = F.lit(0)
    for s in slots[1:]:
        chain = F.when(F.col(t) >= s.offset, s.seg_idx).otherwise(chain)
    at = F.array(*[F.lit(s.offset) for s in slots])
    out = times.withColumn("seg_idx", chain)
    return out.withColumn("local", F.col(t) - F.element_at(at, F.col("seg_idx") + 1))


def probe_targets(at: DataFrame, slots: list[Slot]) -> DataFrame:
    """Times with their segment (``segment_at``) and ``target``, the local time to seek: inside the segment, a millisecond before its end at most."""
    ends = F.array(*[F.lit(s.duration) for s in slots])
    last = F.element_at(ends, F.col("seg_idx") + 1) - 0.001
    return at.withColumn("target", F.greatest(F.lit(0.0), F.least(F.col("local"), last))).drop("local")


def blended(placed: DataFrame, frames: DataFrame, t: str = "pts", width: float = 1.0) -> DataFrame:
    """Frames inside an overlapping transition, with ``progress`` and the frame of the next segment shown with them.

    That is the latest frame of the next segment at most EPSILON past the transition's clock, held after its end, or
    its first frame where none is that early.
    """
    inside = placed.filter(F.col("overlaps") & (F.col("d_out") > 0) & (F.col(t) >= F.col("duration") - F.col("d_out")))
    a = inside.withColumn("b_time", F.col(t) - (F.col("duration") - F.col("d_out"))).withColumn("progress", F.col("b_time") / F.col("d_out"))
    a = a.withColumn("seg_b", F.col("seg_idx") + 1)
    b = frames.select(F.col("seg_idx").alias("seg_b"), F.col(t).alias("b_time"), *[c for c in frames.columns if c not in ("seg_idx", t)])
    got = asof_join(a, b, ["seg_b"], "b_time", width, EPSILON)
    first = b.groupBy("seg_b").agg(F.min(F.struct("b_time", *[c for c in b.columns if c not in ("seg_b", "b_time")])).alias("first_b"))
    return got.join(F.broadcast(first), "seg_b", "left").withColumn("b", F.coalesce("b", "first_b")).drop("first_b", "seg_b")
