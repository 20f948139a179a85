"""Keyframe tracks: a value at each time, eased between keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkreel.functions import easing

from .ordered import asof_join

Key = tuple[float, float, str]


def literal_track(t: Column, keys: list[Key]) -> Column:
    """The value at ``t`` of a track given as (time, value, ease) keys: one CASE chain, no join.

    The ease is that of the later key. Before the first key its value holds, from the last on its value; without
    keys the value is 0. An ease that does not parse is linear.
    """
    keys = sorted(keys, key=lambda k: k[0])
    if not keys:
        return F.lit(0.0)
    out = F.when(t <= keys[0][0], float(keys[0][1])).when(t >= keys[-1][0], float(keys[-1][1]))
    for (t0, v0, _), (t1, v1, ease) in zip(keys, keys[1:]):
        if t1 > t0:
            u = (t - t0) / (t1 - t0)
            out = out.when(t < t1, v0 + (v1 - v0) * easing.eased(easing.parse(ease) or ("linear",), u))
    return out.otherwise(float(keys[-1][1]))


def table_tracks(probes: DataFrame, keys: DataFrame, track: str, t: str, width: float, order: str | None = None) -> DataFrame:
    """``probes`` (track, t, ...) with ``value`` from ``keys`` (track, t, v, ease): an as-of join to segments.

    Keys of equal time are taken by ``order``, a column of ``keys``; the later wins, but at the first time the first does.
    """
    w = W.partitionBy(track).orderBy(t, *([order] if order else []))
    seg = keys.withColumns({
        "__t1": F.lead(t).over(w), "__v1": F.lead("v").over(w), "__e1": F.lead("ease").over(w), "__n": F.row_number().over(w),
        "__first": F.first("v").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
        "__start": F.first(t).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
    })
    # the curve's numbers are read once per key, not once per probe
    lead = seg.select(track, t, "__n", "v", "__t1", "__v1", "__e1", "__first", "__start", easing.points(F.col("__e1")).alias("__p1"))
    edge = lead.groupBy(track).agg(F.first("__first").alias("first_v"))
    got = asof_join(probes, lead, [track], t, width).join(edge, track, "left")
    u = (F.col(t) - F.col(f"b.{t}")) / (F.col("b.__t1") - F.col(f"b.{t}"))
    inner = F.col("b.v") + (F.col("b.__v1") - F.col("b.v")) * easing.eased_by(F.col("b.__e1"), u, F.col("b.__p1"))
    value = (
        F.when(F.col("b").isNull(), F.coalesce("first_v", F.lit(0.0)))
        .when(F.col(t) == F.col("b.__start"), F.when(F.col("b.__t1").isNull() & (F.col("b.__n") > 1), F.col("b.v")).otherwise(F.col("b.__first")))
        .when(F.col("b.__t1").isNull(), F.col("b.v"))
        .otherwise(inner)
    )
    return got.withColumn("value", value).drop("b", "first_v")
