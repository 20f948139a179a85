"""The frame stream as Structured Streaming: bounded intake, late and repeated frames dropped, change detection, progress."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def frame_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 4) -> DataFrame:
    """A folder of frame files as a stream; ``files_per_trigger`` bounds what is in flight."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def once(frames: DataFrame, key: list[str], ts: str | None = None, delay: str | None = None) -> DataFrame:
    """Each frame once, in whatever order files come: its key stays in the state, so none is lost or shown twice.

    With ``ts`` and ``delay`` the state is bounded instead: keys are forgotten after ``delay``, and a frame that comes
    later than that behind the newest one is dropped unseen. Files must then be at most ``delay`` out of order.
    """
    if ts and delay:
        return frames.withWatermark(ts, delay).dropDuplicatesWithinWatermark(key)
    return frames.dropDuplicates(key)


def changes(frames: DataFrame, key: str, order: str, state: str) -> DataFrame:
    """``frames`` with ``changed``: whether ``state`` (text) differs from the frame before of its key, over all batches.

    One value per key is kept between batches; a batch's frames are taken by ``order``. The first frame has changed.
    """

    def run(_, parts, kept):
        import pandas as pd

        rows = pd.concat(list(parts)).sort_values(order, kind="stable")
        before = [kept.get[0] if kept.exists else None, *rows[state].tolist()[:-1]]
        known = [kept.exists, *[True] * (len(rows) - 1)]
        kept.update((rows[state].iloc[-1],))
        none = lambda v: None if pd.isna(v) else v
        yield rows.assign(changed=[not k or none(a) != none(b) for k, a, b in zip(known, before, rows[state])])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema), "changed boolean"])
    return frames.groupBy(key).applyInPandasWithState(run, schema, "last string", "append", "NoTimeout")


def until(query: StreamingQuery, cancelled: threading.Event, every: float = 0.2) -> bool:
    """Wait for a query and stop it, with its running batch, once ``cancelled`` is set. Whether it was cancelled."""
    while query.isActive:
        if cancelled.wait(every):
            query.stop()
            return True
    return False


def frame_counts(frames: DataFrame, ts: str, segment: str, every: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Frames per segment and stretch of time, final once the watermark has passed it."""
    counts = frames.withWatermark(ts, delay).groupBy(F.window(ts, every), segment).agg(F.count("*").alias("frames"))
    return counts.select(segment, F.col("window.start").alias("start"), "frames")


class Progress(StreamingQueryListener):
    """Calls ``report(rows so far, rows a second)`` after each batch."""

    def __init__(self, report):
        self.report, self.rows = report, 0

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.rows += event.progress.numInputRows
        self.report(self.rows, event.progress.processedRowsPerSecond)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass
