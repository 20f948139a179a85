"""3-D lookup tables in .cube text."""

from __future__ import annotations

import contextlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkreel.functions.color import lut_corner

from .spec import LutError

#: Keywords of the format.
KEYWORDS = ("TITLE", "LUT_3D_SIZE", "LUT_1D_SIZE", "DOMAIN_MIN", "DOMAIN_MAX")


def entries(lines: DataFrame, line: str = "line", no: str = "line_no") -> DataFrame:
    """(ri, gi, bi, r, g, b) of numbered lines, red fastest. Only lines that begin with three numbers count; comments, keywords, domains and others are skipped."""
    text = F.trim(F.col(line))
    word = F.upper(F.split(text, r"\s+")[0])
    parts = F.split(text, r"\s+")
    size = lines.filter(word == "LUT_3D_SIZE").select(F.get(parts, F.lit(1)).try_cast("int").alias("n")).filter("n is not null")
    number = [F.get(parts, F.lit(k)).try_cast("double") for k in range(3)]
    body = lines.filter(~text.startswith("#") & ~word.isin(*KEYWORDS) & number[0].isNotNull() & number[1].isNotNull() & number[2].isNotNull())
    # the file's rows are its one ordered list of n^3 entries, so they are numbered as a whole
    rows = body.select(F.row_number().over(Window.orderBy(no)).alias("i"), *[v.alias(c) for v, c in zip(number, "rgb")])
    d = rows.crossJoin(F.broadcast(size.limit(1))).withColumn("i", F.col("i") - 1)
    n = F.col("n")
    return d.select((F.col("i") % n).cast("int").alias("ri"), (F.floor(F.col("i") / n) % n).cast("int").alias("gi"), F.floor(F.col("i") / (n * n)).cast("int").alias("bi"), "r", "g", "b")


def read_cube(spark: SparkSession, path: str) -> DataFrame:
    """A .cube file through Spark's readers, checked to hold n^3 entries. Such files are small: they are parsed on the driver."""
    text = spark.read.text(path, wholetext=True).first()
    n, rows = parse_cube(text[0] if text else "")
    return spark.createDataFrame([(i % n, i // n % n, i // (n * n), *v) for i, v in enumerate(rows)], "ri int, gi int, bi int, r double, g double, b double")


def parse_cube(text: str) -> tuple[int, list[tuple[float, float, float]]]:
    n, rows = 0, []
    for raw in text.splitlines():
        words = raw.split()
        if not words or words[0].startswith("#"):
            continue
        if words[0].upper() in KEYWORDS:
            n = int(words[1]) if words[0].upper() == "LUT_3D_SIZE" and words[1:2] and words[1].isdigit() else n
            continue
        with contextlib.suppress(ValueError):  # what is not three numbers is no row
            row = tuple(map(float, words[:3]))
            rows += [row] if len(row) == 3 else []
    if not n or len(rows) != n**3:
        raise LutError(f"{len(rows)} rows for size {n}")
    return n, rows


def as_array(table: DataFrame) -> DataFrame:
    """One row with the whole table as array<struct<r,g,b>>, red fastest (n^3 entries, 36 thousand at the usual 33)."""
    return table.agg(F.transform(F.sort_array(F.collect_list(F.struct("bi", "gi", "ri", "r", "g", "b"))), lambda e: F.struct(e["r"].alias("r"), e["g"].alias("g"), e["b"].alias("b"))).alias("lut"))


def corners_joined(pixels: DataFrame, table: DataFrame, n: int, key: str) -> DataFrame:
    """Trilinear lookup by joins: each pixel meets its eight corners, weighted. The table (n^3 rows) is broadcast."""
    axis = {c: lut_corner(F.col(c), n) for c in "rgb"}
    side = lambda c: F.array(*[F.struct(axis[c][k].alias("i"), w.alias("w")) for k, w in ((0, 1 - axis[c][2]), (1, axis[c][2]))])
    eight = pixels.select(key, F.explode(side("r")).alias("x"), "g", "b").select(key, "x", F.explode(side("g")).alias("y"), "b").select(key, "x", "y", F.explode(side("b")).alias("z"))
    got = eight.join(F.broadcast(table), (F.col("x.i") == F.col("ri")) & (F.col("y.i") == F.col("gi")) & (F.col("z.i") == F.col("bi")))
    weight: Column = F.col("x.w") * F.col("y.w") * F.col("z.w")
    return got.groupBy(key).agg(*[F.sum(weight * F.col(c)).alias(c) for c in "rgb"])
