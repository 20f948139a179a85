"""Embedding near-duplicates: an exact metric range join on the unit sphere.

Method: pivots partition the vectors, each going to the cell of its nearest
pivot. A cosine of at least t is a distance of at most r = sqrt(2 - 2t) between
unit vectors. By the triangle inequality a vector x with nearest pivot p can
have a partner at home in the cell of q only if d(x, q) - d(x, p) <= 2r, and in
Euclidean space only if it is within r of the plane between p and q; there it
is replicated. Cells then join independently: the vectors at home against all
members. A large cell is split into blocks of the vectors at home and of the members; the
home block is held in memory and the members stream past it.

Equal vectors are one vector with a count, and the links of a block leave it as
stars, so a group of copies or near copies of any size makes no pairs.
Cost: where the data has no metric structure at all (random directions in many
dimensions), no exact method prunes and the join compares all vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, least_labels
from .shared import dropped, staged

#: Vectors per pivot that are aimed at, and the most pivots; the driver and each task hold MAX_PIVOTS vectors.
PER_PIVOT = 4096
MAX_PIVOTS = 512
#: Vectors at home that a unit of work holds, and members that stream past them.
HOME_BLOCK = 4096
MEMBER_BLOCK = 1 << 16
_SLACK = 1e-6


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Double vectors; None for those that are null or zero or have null or non-finite components."""
    out = []
    for i in range(len(column)):
        v = column[i]
        x = None
        if v.is_valid and len(v) and not v.values.null_count:
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if not np.isfinite(x).all() or not x.any():
                x = None
        out.append(x)
    return out


def _unit(raw: list[bytes]) -> np.ndarray:
    """Rows of unit length."""
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw = [None if x is None else x.tobytes() for x in _vectors(b.column(1))]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], ["vec_id", "raw"])


def _cells(pivots: dict[int, np.ndarray], radius: float):
    """Give each vector its cells: (rep, many, raw, cell, home)."""
    apart = {d: np.sqrt(np.maximum(2 - 2 * p @ p.T, 1e-18)) for d, p in pivots.items()}
    first = dict(zip(pivots, np.cumsum([0, *(len(p) for p in pivots.values())])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(2).to_pylist()
            sizes = np.array([len(r) // 8 for r in raw])
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                p = pivots[int(dim)]
                d2 = np.maximum(2 - 2 * _unit([raw[i] for i in at]) @ p.T, 0)
                home = d2.argmin(1)
                least = d2[np.arange(len(at)), home]
                near = np.sqrt(d2) - np.sqrt(least)[:, None] <= 2 * radius + _SLACK
                near &= d2 - least[:, None] <= 2 * (radius + _SLACK) * apart[int(dim)][home] + _SLACK
                near[np.arange(len(at)), home] = True
                i, cell = np.nonzero(near)
                rows = pa.array(at[i])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(rows), b.column(1).take(rows), b.column(2).take(rows), pa.array(cell + first[int(dim)], pa.int32()), pa.array(home[i] == cell)],
                    ["rep", "many", "raw", "cell", "home"],
                )

    return run


def _join(threshold: float):
    """Units of work, sorted so that the vectors at home come before the members of their unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, home_ids, home = None, [], []
        x = None
        for b in batches:
            units, side = b.column(0).to_pylist(), b.column(1).to_numpy()
            ids, many, raw = b.column(2).to_numpy(), b.column(3).to_numpy(), b.column(4).to_pylist()
            cuts = [0, *(i for i in range(1, len(units)) if units[i] != units[i - 1] or side[i] != side[i - 1]), len(units)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi == lo:
                    continue
                if units[lo] != unit:
                    unit, home_ids, home, x = units[lo], [], [], None
                if side[lo] == 0:
                    home_ids.append(ids[lo:hi])
                    home += raw[lo:hi]
                    x = None
                    continue
                if not home:
                    continue
                if x is None:
                    x, own = _unit(home), np.concatenate(home_ids)
                linked = x @ _unit(raw[lo:hi]).T >= threshold
                linked &= own[:, None] != ids[lo:hi][None, :]
                i, j = np.nonzero(linked)
                if not len(i):
                    continue
                got = np.bincount(i, many[lo:hi][j], len(own)).astype(np.int64)
                at = np.flatnonzero(got)
                nodes, label = least_labels(own[i], ids[lo:hi][j])
                keep = nodes != label
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate((own[at], nodes[keep]))), pa.array(np.concatenate((own[at], label[keep]))), pa.array(np.concatenate((got[at], np.zeros(keep.sum(), np.int64))))],
                    ["a", "b", "links"],
                )

    return run


def near_duplicates(df: DataFrame, threshold: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``df``.

    Two vectors link when their cosine, in double precision, is at least ``threshold``. ``n_links`` counts the
    other rows linked directly, copies included; ``component_id`` is the least id that links lead to. Vectors that
    are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of different
    lengths with each other. Rows that repeat an id are vectors of their own. Other columns are not read.
    """
    src = df.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    rows = src.mapInArrow(_checked, "vec_id bigint, raw binary").withColumns({"k1": F.xxhash64("raw"), "k2": F.xxhash64("raw", F.lit(1))})
    same = rows.filter("raw is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("many"), F.first("raw").alias("raw")).withColumn("rep", F.col("k1"))  # ids may be null or repeat
    distinct = staged(same, "vectors")
    sizes = distinct.groupBy(F.length("raw").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(MAX_PIVOTS).collect()
    if distinct.select(F.length("raw")).distinct().count() > len(sizes):
        raise ValueError("vectors of too many different lengths")
    pivots, left = {}, MAX_PIVOTS
    for s in sizes:
        k = max(1, min(-(-s["rows"] // PER_PIVOT), left - len(sizes) + 1))
        got = distinct.filter(F.length("raw") == s["n"]).orderBy(F.xxhash64("rep"), "k1").limit(k).select("raw").collect()
        pivots[s["n"] // 8] = _unit([bytes(r["raw"]) for r in got])
        left -= len(got)
    member = distinct.select("rep", "many", "raw").mapInArrow(_cells(pivots, float(np.sqrt(max(2 - 2 * threshold, 0)))), "rep bigint, many bigint, raw binary, cell int, home boolean")
    cells = staged(member, "cells")
    plan = cells.groupBy("cell").agg(F.count_if("home").alias("n_home"), F.count("*").alias("n_member"))
    blocks = F.broadcast(plan.select(  # one row per pivot
        "cell", F.ceil(F.col("n_home") / HOME_BLOCK).cast("int").alias("hb"), F.ceil(F.col("n_member") / MEMBER_BLOCK).cast("int").alias("mb"),
    ))
    member = cells.join(blocks, "cell").withColumns({"hb": F.greatest("hb", F.lit(1)), "mb": F.greatest("mb", F.lit(1))})
    spot = lambda n, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), n).cast("int")
    count = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    unit = lambda i, j: F.concat_ws(".", "cell", i, j)
    homes = member.filter("home").withColumn("j", F.explode(count("mb"))).select(unit(spot(F.col("hb"), 1), F.col("j")).alias("unit"), F.lit(0).alias("side"), "rep", "many", "raw")
    others = member.withColumn("i", F.explode(count("hb"))).select(unit(F.col("i"), spot(F.col("mb"), 2)).alias("unit"), F.lit(1).alias("side"), "rep", "many", "raw")
    units = homes.unionByName(others).repartition("unit").sortWithinPartitions("unit", "side")
    found = staged(units.mapInArrow(_join(threshold), "a bigint, b bigint, links bigint"), "found")
    direct = found.filter("links > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    label = components(found.filter("links = 0").select("a", "b"))
    dropped(cells)
    groups = staged(
        distinct.select("k1", "k2", "rep", "many", "least").join(direct, "rep", "left").join(label.withColumnRenamed("id", "rep"), "rep", "left")
        .select("k1", "k2", "least", (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("own")),
        "labelled",
    )
    least = groups.groupBy("own").agg(F.min("least").alias("component"))
    groups = groups.join(least, "own").select("k1", "k2", "links", "component")
    out = rows.withColumn("k1", F.when(F.col("raw").isNotNull(), F.col("k1"))).drop("raw").join(groups, ["k1", "k2"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
