"""Ordered computations that stay parallel: as-of joins and numbering by buckets of time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], t: str, width: float, slack: float = 0.0) -> DataFrame:
    """``left`` with ``b``, the last row of ``right`` (as a struct) of its keys whose ``t`` is at most ``left.t + slack``.

    Rows of equal time: the greatest struct wins. Null where none comes before. Both sides are cut into buckets of
    ``width`` in time, so a key with any number of rows is spread over tasks; what a bucket inherits is the last row
    before it, found on one row per bucket. No non-equi join is made.
    """
    rows = [c for c in right.columns if c not in keys]
    value = F.struct(t, *[c for c in rows if c != t])
    bucket = lambda c: F.floor(c / width)
    r = right.select(*keys, F.col(t).alias("__t"), value.alias("__b")).withColumn("__k", bucket(F.col("__t")))
    l = left.withColumn("__t", F.col(t) + slack).withColumn("__k", bucket(F.col("__t")))
    last = r.groupBy(*keys, "__k").agg(F.max("__b").alias("__carry"))
    carried = last.unionByName(l.select(*keys, "__k").distinct().withColumn("__carry", F.lit(None)), allowMissingColumns=True)
    carried = carried.groupBy(*keys, "__k").agg(F.max("__carry").alias("__own"))
    before = W.partitionBy(*keys).orderBy("__k").rowsBetween(W.unboundedPreceding, -1)
    carried = carried.select(*keys, "__k", F.last("__own", ignorenulls=True).over(before).alias("__carry"))
    side = F.struct(*left.columns)
    both = r.select(*keys, "__k", "__t", F.lit(0).alias("__side"), "__b", F.lit(None).cast(l.select(side).schema[0].dataType).alias("__l"))
    both = both.unionByName(l.select(*keys, "__k", "__t", F.lit(1).alias("__side"), F.lit(None).cast(r.schema["__b"].dataType).alias("__b"), side.alias("__l")))
    upto = W.partitionBy(*keys, "__k").orderBy("__t", "__side", "__b").rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = both.withColumn("__seen", F.last("__b", ignorenulls=True).over(upto)).filter("__side = 1")
    out = seen.join(carried, [*keys, "__k"], "left")
    return out.select("__l.*", F.coalesce("__seen", "__carry").alias("b"))


#: Buckets whose sizes are summed in one task; the sums of such groups are summed once more.
GROUP = 1024


def numbered(df: DataFrame, bucket: list, order: list, name: str, within: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``name``, 0, 1, ... over all rows, or over those of equal ``within``, by ``bucket`` and then ``order``.

    Rows are numbered inside their bucket and buckets are offset by their sizes, on two levels: a task sums GROUP
    buckets, and what meets in one task is one row per group of buckets. ``bucket``, whose last column is a
    number, must be coarser than, and in line with, ``order``.
    """
    keys = [f"__k{i}" for i in range(len(bucket))]
    d = df.withColumns(dict(zip(keys, bucket)))
    upto = lambda part, by: W.partitionBy(*part).orderBy(*by).rowsBetween(W.unboundedPreceding, W.currentRow)
    n = d.groupBy(*within, *keys).agg(F.count("*").alias("__n")).withColumn("__g", F.floor(F.col(keys[-1]) / GROUP))
    coarse = [*keys[:-1], "__g"]
    n = n.withColumn("__base", F.sum("__n").over(upto([*within, *coarse], keys[-1:])) - F.col("__n"))
    g = n.groupBy(*within, *coarse).agg(F.sum("__n").alias("__all"))
    g = g.select(*within, *coarse, (F.sum("__all").over(upto(within, coarse)) - F.col("__all")).alias("__before"))
    n = n.join(g, [*within, *coarse]).select(*within, *keys, (F.col("__base") + F.col("__before")).alias("__base"))
    d = d.withColumn("__i", F.row_number().over(W.partitionBy(*within, *keys).orderBy(*order)))
    return d.join(n, [*within, *keys]).withColumn(name, (F.col("__base") + F.col("__i") - 1).cast("bigint")).drop(*keys, "__i", "__base")
