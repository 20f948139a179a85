import os
import threading

import pytest

from sparkreel.streaming import frames

SCHEMA = "seg_idx int, frame_no int, ts timestamp"
ROWS = "SELECT CAST(id % 2 AS INT) AS seg_idx, CAST(id AS INT) AS frame_no, timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(id AS INT)) AS ts, CAST(id DIV 7 AS STRING) AS cue FROM range(120)"


def written(spark, path, order):
    """Three files: the first 60 frames, the last 60, and the first 30 again; read in the given order."""
    d = spark.sql(ROWS)
    for i, part in enumerate((d.filter("frame_no < 60"), d.filter("frame_no >= 60"), d.filter("frame_no < 30"))):
        part.coalesce(1).write.mode("append").parquet(str(path / f"p{i}"))
        for name in os.listdir(path / f"p{i}"):
            if name.endswith(".parquet"):
                os.makedirs(path / "in", exist_ok=True)
                os.rename(path / f"p{i}" / name, path / "in" / f"f{i}.parquet")
                os.utime(path / "in" / f"f{i}.parquet", (1_700_000_000 + 60 * order.index(i),) * 2)


def rows_of(spark, df, name, path):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(path / name)).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


@pytest.mark.parametrize("order", [[0, 1, 2], [1, 2, 0]])
def test_frames_once_in_any_order_of_files(spark, tmp_path, order):
    written(spark, tmp_path, order)
    name = "once" + "".join(map(str, order))
    got = rows_of(spark, frames.once(frames.frame_stream(spark, str(tmp_path / "in"), SCHEMA, 1), ["frame_no"]), name, tmp_path)
    assert sorted(r["frame_no"] for r in got.collect()) == list(range(120))


def test_counts_changes_and_cancelling(spark, tmp_path):
    written(spark, tmp_path, [0, 1, 2])
    seen = []
    listener = frames.Progress(lambda n, rate: seen.append(n))
    spark.streams.addListener(listener)
    counts = frames.frame_counts(frames.frame_stream(spark, str(tmp_path / "in"), SCHEMA, 1), "ts", "seg_idx")
    q = counts.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    cancelled = threading.Event()
    cancelled.set()
    assert frames.until(q, cancelled) and not q.isActive
    assert sum(r["frames"] for r in spark.table("counts").collect()) == 150
    spark.streams.removeListener(listener)
    (tmp_path / "in" / "f2.parquet").unlink()
    got = rows_of(spark, frames.changes(frames.frame_stream(spark, str(tmp_path / "in"), SCHEMA + ", cue string", 1), "seg_idx", "frame_no", "cue"), "changed", tmp_path)
    by = {r["frame_no"]: (r["cue"], r["changed"]) for r in got.collect()}
    assert len(by) == 120 and all(changed == (n < 2 or by[n - 2][0] != cue) for n, (cue, changed) in by.items())
