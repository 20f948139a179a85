"""Connected components of a graph that is a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, staged

MAX_ROUNDS = 60


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, least id of its component) of a graph that fits in memory, by repeated minima and jumps."""
    ids, inverse = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        for side in (x, y):  # hook the labels themselves, so that whole trees move
            np.minimum.at(new, label[side], least)
            np.minimum.at(new, side, least)
        while not np.array_equal(new[new], new):
            new = new[new]
        if np.array_equal(new, label):
            return ids, ids[label]
        label = new


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a batch as stars around the least ids: as connected, never more than the ids."""
    for batch in batches:
        ids, label = least_labels(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        keep = ids != label
        yield pa.RecordBatch.from_arrays([pa.array(label[keep]), pa.array(ids[keep])], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id of ``links`` (a, b: bigint, not null): the least id that links lead to.

    Each round points every node to its least neighbour, jumps, and contracts the links; a node with very many
    links only takes part in minima that are combined before the shuffle and in joins against one row per node.
    Tables between rounds are in the shared folder.
    """
    edges = staged(links.filter("a <> b").mapInArrow(_forest, "a bigint, b bigint").distinct(), "links")
    labels = None
    for _ in range(MAX_ROUNDS):
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("up"))
        up = staged(to, "up")
        again = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
        jumped = staged(up.join(again, "up", "left").select("node", F.coalesce("top", "up").alias("up")), "jumped")
        dropped(up)
        if labels is None:
            new = jumped.select(F.col("node").alias("id"), F.col("up").alias("component"))
        else:
            new = labels.join(jumped, labels["component"] == jumped["node"], "left").select("id", F.coalesce("up", "component").alias("component"))
        new = staged(new, "labels")
        a = jumped.select(F.col("node").alias("a"), F.col("up").alias("a2"))
        b = jumped.select(F.col("node").alias("b"), F.col("up").alias("b2"))
        moved = edges.join(a, "a").join(b, "b").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
        left = staged(moved.filter("a <> b").distinct(), "links")
        for old in (edges, jumped, labels):
            if old is not None:
                dropped(old)
        edges, labels = left, new
    else:
        raise RuntimeError("the links did not contract")
    return labels if labels is not None else edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
