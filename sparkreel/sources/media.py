"""Frame tables, subtitles, logs and images as sources and sinks."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .spec import ImageError

_TIME = r"(\d+):(\d+):(\d+(?:\.\d+)?)"


def frames(spark: SparkSession, path: str, start: float | None = None, end: float | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
    """A frames table (seg_idx, pts, ...), [start, end) in seconds; the range and the columns reach the scan."""
    df = spark.read.parquet(path)
    df = df.select(*columns) if columns else df
    df = df.filter(F.col("pts") >= start) if start is not None else df
    return df.filter(F.col("pts") < end) if end is not None else df


def samples(spark: SparkSession, path: str, rate: int = 44_100, seconds: float | None = None) -> DataFrame:
    """A sample table (n, ch, v), at most so many seconds of it."""
    df = spark.read.parquet(path)
    return df.filter(F.col("n") < int(seconds * rate)) if seconds is not None else df


def write_frames(df: DataFrame, path: str, by: str = "chunk", order: str = "pts") -> None:
    """Overwrite ``path`` with one folder per ``by``, each sorted by ``order``."""
    df.repartitionByRange(by).sortWithinPartitions(by, order).write.mode("overwrite").partitionBy(by).parquet(path)


def _seconds(text: Column) -> Column:
    part = lambda i: F.regexp_extract(text, _TIME, i).cast("double")
    return part(1) * 3600 + part(2) * 60 + part(3)


def cues(lines: DataFrame, line: str = "value") -> DataFrame:
    """(start, end, text) of the Dialogue lines of an ASS script."""
    d = lines.filter(F.col(line).startswith("Dialogue:"))
    fields = F.split(F.col(line), ",", 10)
    return d.select(_seconds(fields[1]).alias("start"), _seconds(fields[2]).alias("end"), F.get(fields, F.lit(9)).alias("text"))


def read_cues(spark: SparkSession, path: str) -> DataFrame:
    return cues(spark.read.text(path))


#: The lines of the progress protocol.
META = r"^\[meta\] sourceSecs=([\d.]+)"
FRAME = r"^\[engine\] frame (\d+)\s+src=([\d.]+)s\s+wall=([\d.]+)s\s+speed=([\d.]+)x"
DONE = r"^\[done\] frames=(\d+)\s+src=([\d.]+)s\s+wall=([\d.]+)s\s+speed=([\d.]+)x"
EVERY = 60


def progress_line(frame_no: Column, src: Column, wall: Column, speed: Column) -> Column:
    """The line of a frame; one in EVERY has one (``has_line``). Numbers are given as text."""
    return F.concat(F.lit("[engine] frame "), frame_no.cast("string"), F.lit("  src="), src, F.lit("s  wall="), wall, F.lit("s  speed="), speed, F.lit("x"))


def has_line(frame_no: Column) -> Column:
    return (frame_no + 1) % EVERY == 0


def parsed_log(line: Column) -> dict[str, Column]:
    """kind and numbers of a log line; null where it is none of the three."""
    kind = F.when(line.rlike(META), "meta").when(line.rlike(FRAME), "frame").when(line.rlike(DONE), "done")
    number = lambda i: F.coalesce(*[F.nullif(F.regexp_extract(line, p, i), F.lit("")) for p in (FRAME, DONE)])
    return {
        "kind": kind,
        "frames": number(1).try_cast("bigint"),
        "src": F.coalesce(number(2), F.nullif(F.regexp_extract(line, META, 1), F.lit(""))).try_cast("double"),
        "wall": number(3).try_cast("double"),
        "speed": number(4).try_cast("double"),
    }


def progress(lines: DataFrame, job: str, order: str) -> DataFrame:
    """Frame and done lines (kind, src) with ``ratio``: how much of the source is done, by the newest meta line, else by the most seen so far; 1 when done."""
    w = W.partitionBy(job).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    meta = F.last(F.when(F.col("kind") == "meta", F.col("src")), ignorenulls=True).over(w)
    most = F.max(F.when(F.col("kind") == "frame", F.col("src"))).over(w)
    d = lines.withColumn("total", F.when(meta > 0, meta).otherwise(most)).filter("kind = 'done' or (kind = 'frame' and total > 0)")
    return d.withColumn("ratio", F.when(F.col("kind") == "done", 1.0).otherwise(F.least(F.lit(1.0), F.col("src") / F.col("total")))).drop("total")


def png(width: int, height: int, rgb: bytes) -> bytes:
    """An 8-bit RGB image as PNG."""
    rows = b"".join(b"\0" + rgb[i : i + 3 * width] for i in range(0, 3 * width * height, 3 * width))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def png_rows(images: DataFrame) -> DataFrame:
    """(frame_no, width, height, rgb binary) with ``png`` binary; a frame is one row."""

    def run(batches):
        for pdf in batches:
            yield pdf.assign(png=[png(w, h, rgb) for w, h, rgb in zip(pdf.width, pdf.height, pdf.rgb)])[["frame_no", "png"]]

    return images.select("frame_no", "width", "height", "rgb").mapInPandas(run, "frame_no bigint, png binary")


def unpng(data: bytes) -> tuple[int, int, bytes]:
    """(width, height, RGBA bytes, premultiplied) of an 8-bit RGB or RGBA PNG without interlace. Raises ImageError for anything else."""
    try:
        if data[:8] != b"\x89PNG\r\n\x1a\n":
            raise ValueError("no PNG")
        at, head, body = 8, b"", b""
        while at < len(data):
            (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
            head, body = (data[at + 8 : at + 8 + n] if kind == b"IHDR" else head), body + (data[at + 8 : at + 8 + n] if kind == b"IDAT" else b"")
            at += 12 + n
        w, h, depth, colour, _, _, lace = struct.unpack(">IIBBBBB", head)
        size = {2: 3, 6: 4}[colour]
        if depth != 8 or lace:
            raise ValueError("8 bits a channel and no interlace are needed")
        raw, before, rows = zlib.decompress(body), bytearray(w * size), []
        for y in range(h):
            kind, line = raw[y * (w * size + 1)], bytearray(raw[y * (w * size + 1) + 1 : (y + 1) * (w * size + 1)])
            for i in range(len(line)):
                left, up, corner = (line[i - size] if i >= size else 0), before[i], (before[i - size] if i >= size else 0)
                guess = left + up - corner
                near = min((left, up, corner), key=lambda v: abs(guess - v))
                line[i] = (line[i] + (0, left, up, (left + up) // 2, near)[kind]) & 255
            rows.append(line)
            before = line
        out = bytearray()
        for line in rows:
            for i in range(0, len(line), size):
                alpha = line[i + 3] if size == 4 else 255
                out += bytes([*((c * alpha + 127) // 255 for c in line[i : i + 3]), alpha])
        return w, h, bytes(out)
    except (ValueError, KeyError, IndexError, struct.error, zlib.error) as e:
        raise ImageError(str(e)) from e


def images(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, rgba binary, error): image files, decoded where they lie; ``error`` tells why one did not."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for p, data in zip(pdf.path, pdf.content):
                try:
                    out.append((p, *unpng(bytes(data)), None))
                except ImageError as e:
                    out.append((p, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "width", "height", "rgba", "error"]).astype({"width": "Int32", "height": "Int32"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, width int, height int, rgba binary, error string")
