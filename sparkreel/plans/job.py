"""Jobs: a spec document run over frame tables, whole, in chunks or as a probe of one time."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from sparkreel.functions import easing, resolve
from sparkreel.operators import chunks, timeline
from sparkreel.sources.spec import DecodeError, Job, NoVideo, parse_job

from . import render

#: Columns of a frame table: time in its segment, and planes of luma and of halved chroma.
FRAME = ("pts", "luma", "cb", "cr")
#: Names of a spec that a Look calls otherwise.
_NAMES = {"lutMix": "lut_mix", "cropPct": "crop", "edgeBlurSigma": "sigma", "edgeBlurBand": "band"}


@dataclass
class JobResult:
    """``frames``: those emitted, numbered and placed; ``pixels``: their rendered pixels; ``stats``: one row."""

    job: Job
    frames: DataFrame
    pixels: DataFrame
    stats: DataFrame


def look_of(job: Job) -> render.Look:
    """Grade and bypass with defaults and unit conversions applied."""
    grade, bypass = job.grade, job.bypass
    tint = grade["tint"] + math.radians(bypass["colorTintDeg"])
    tracks = {_NAMES.get(k, k): v for k, v in job.tracks.items() if k in ("brightness", "contrast", "saturation", "tint", "zoom", "cropPct", "noise", "grain")}
    return render.Look(
        grade["brightness"], grade["contrast"], grade["saturation"], tint, bypass["noise"], bypass["grain"], grade["lutMix"] if grade.get("lutPath") else 0.0,
        bypass["mirror"], bypass["zoom"], bypass["cropPct"] / 100, bypass["edgeBlurSigma"], bypass["edgeBlurBand"], tracks,
    )


def segments(spark: SparkSession, job: Job, read: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """All inputs as one table (seg_idx, FRAME). Raises DecodeError where an input cannot be read or lacks a column."""
    out = None
    for i, part in enumerate(job.inputs):
        try:
            df = (read or spark.read.parquet)(part["path"]).select(F.lit(i).alias("seg_idx"), *FRAME)
        except AnalysisException as e:
            raise DecodeError(f"{part['path']}: {e}") from e
        out = df if out is None else out.unionByName(df)
    return out


def placed(spark: SparkSession, job: Job, frames: DataFrame, fps: float) -> tuple[DataFrame, list[timeline.Slot]]:
    """Frames on the timeline. One duration per segment comes to the driver: the last frame's time and one frame more."""
    ends = {r["seg_idx"]: r["end"] + 1 / fps for r in frames.groupBy("seg_idx").agg(F.max("pts").alias("end")).collect()}
    if len(ends) < len(job.inputs):
        raise NoVideo(f"inputs without frames: {[p['path'] for i, p in enumerate(job.inputs) if i not in ends]}")
    out = [p["transition"] and timeline.Transition(p["transition"], p["duration"], p["ease"]) for p in job.inputs]
    slots = timeline.resolve([ends[i] for i in range(len(job.inputs))], out)
    return timeline.on_timeline(frames, timeline.as_table(spark, slots)), slots


def run_job(spark: SparkSession, text: str, shape: render.Shape, fps: float = 30.0, fades: tuple[float | None, float | None] = (None, None), layers: list[render.Layer] = (), lut: DataFrame | None = None, lut_size: int = 33, read: Callable[[str], DataFrame] | None = None) -> JobResult:
    """A spec from its document to rendered pixels.

    Tracks, main pass of both sides of a transition with the same seed, the transition's blend, layers in order of z
    (captions first), fades. The incoming side of a slide is taken at the pixel nearest to the place it is pushed to.
    """
    job = parse_job(text)
    look = look_of(job)
    frames = segments(spark, job, read)
    on_time, slots = placed(spark, job, frames, fps)
    shown = timeline.frame_index(timeline.emitted(on_time), "pts")
    held = timeline.blended(on_time, frames).select("seg_idx", "pts", "progress", F.col("b").alias("b"))
    keep = ["frame_no", "seed", "out_pts", "pts", "duration", "kind_out", "d_out", "kind_in", "d_in", "ease_out", "progress"]
    shown = shown.join(held, ["seg_idx", "pts"], "left").withColumn("seed", F.col("frame_no") + 1)
    shown = render.with_tracks(shown, look, F.col("out_pts"))
    pixels = render.planes_rendered(shown, look, shape, keep, "seed", lut, lut_size)
    both = shown.filter("progress is not null").withColumns({c: F.col(f"b.{c}") for c in FRAME[1:]})
    b = render.planes_rendered(both, look, shape, ["frame_no", "seed"], "seed", lut, lut_size).select("frame_no", F.col("x").alias("bx"), F.col("y").alias("by"), *[F.col(c).alias(f"b{c}") for c in "rgb"])
    pixels = pixels.withColumn("eased", easing.eased_by(F.col("ease_out"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("progress")))))
    u, v = (F.col("x") + 0.5) / shape.dst_w, (F.col("y") + 0.5) / shape.dst_h
    bx, by = F.col("x"), F.col("y")
    for name, (family, dx, dy) in resolve.TRANSITIONS.items():
        if family == "slide":
            slid = F.col("kind_out") == name
            bx = F.when(slid, F.floor((u + dx * (1 - F.col("eased"))) * shape.dst_w).cast("int")).otherwise(bx)
            by = F.when(slid, F.floor((v + dy * (1 - F.col("eased"))) * shape.dst_h).cast("int")).otherwise(by)
    pixels = pixels.withColumns({"bx": bx, "by": by}).join(b, ["frame_no", "bx", "by"], "left")
    mixed = render.transition_blend(tuple(map(F.col, "rgb")), tuple(F.col(f"b{c}") for c in "rgb"), F.col("kind_out"), u, v, F.when(F.col("br").isNotNull(), F.col("eased")))
    pixels = pixels.withColumns(dict(zip("rgb", mixed)))
    total = timeline.total_seconds(slots)
    pixels = render.faded(render.overlaid(pixels, list(layers), F.col("out_pts"), F.col("x"), F.col("y")), render.fade_alpha(F.col("out_pts"), total, *fades))
    stats = shown.agg(F.count("*").alias("frames"), F.lit(total).alias("source_seconds"))
    return JobResult(job, shown.select("frame_no", "seg_idx", "pts", "out_pts"), pixels.select("frame_no", "x", "y", *"rgb"), stats)


def run_chunks(spark: SparkSession, text: str, shape: render.Shape, parts: int, fps: float = 30.0, read: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """A job's frames in even chunks of time as pixels (chunk, local, chunk_frame, x, y, r, g, b). Chunks keep only the grade and cuts."""
    job = parse_job(text)
    for part in job.inputs:
        part["transition"] = None
    on_time, slots = placed(spark, job, segments(spark, job, read), fps)
    cut = on_time.withColumn("chunk", chunks.chunk_of(F.col("out_pts"), timeline.total_seconds(slots), parts))
    cut = chunks.rebased(cut, "chunk", "out_pts", "seg_idx").withColumn("seed", F.lit(1))
    return render.planes_rendered(cut, look_of(job).grade_only(), shape, ["chunk", "local", "chunk_frame", "seed"], "seed").drop("seed")


def probe(spark: SparkSession, text: str, at: float, shape: render.Shape, fps: float = 30.0, fades: tuple[float | None, float | None] = (None, None), layers: list[render.Layer] = (), lut: DataFrame | None = None, lut_size: int = 33, read: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """The pixels (x, y, r, g, b) that a job shows at a time: no blend, the first frame's seed. A time without a frame fails with NoFrame."""
    job = parse_job(text)
    look = look_of(job)
    on_time, slots = placed(spark, job, segments(spark, job, read), fps)
    slot = max((s for s in slots if s.offset <= at or not s.seg_idx), key=lambda s: s.seg_idx)
    target = max(0.0, min(at - slot.offset, slot.duration - 0.001))
    one = render.probe(on_time.filter(F.col("seg_idx") == slot.seg_idx), "pts", target, "pts").withColumn("seed", F.lit(1))
    one = render.with_tracks(one, look, F.col("out_pts"))
    keep = ["seed", "out_pts", "pts", "duration", "kind_out", "d_out", "kind_in", "d_in"]
    pixels = render.planes_rendered(one, look, shape, keep, "seed", lut, lut_size)
    pixels = render.overlaid(pixels, list(layers), F.col("out_pts"), F.col("x"), F.col("y"))
    return render.faded(pixels, render.fade_alpha(F.col("out_pts"), timeline.total_seconds(slots), *fades)).select("x", "y", *"rgb")
