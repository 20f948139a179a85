import json

import pytest

from sparkreel.operators import chunks
from sparkreel.plans import job, render
from sparkreel.sources import fixtures, media, spec

SHAPE = render.Shape(8, 4, 4, 6)
SPEC = {
    "output": "o.mp4", "preset": "1080p", "grade": {"brightness": 0.05, "contrast": 1.1}, "bypass": {"noise": 10, "grain": 5, "edgeBlurSigma": 6, "edgeBlurBand": 0.4},
    "inputs": [{"path": "a", "transition": {"type": "wipeLeft", "duration": 0.5, "ease": "easeIn"}}, {"path": "b", "transition": {"type": "slideUp", "duration": 0.4}}, {"path": "c"}],
    "animate": {"saturation": [{"t": 0, "v": 1}, {"t": 2, "v": 0.5}]},
}


def read(spark):
    return lambda path: fixtures.test_frames(spark, {"a": 2, "b": 1.5, "c": 2}[path], 10, 8, 4)


def test_job_probe_and_chunks(spark):
    text = json.dumps(SPEC)
    layer = [render.Layer(1, (0.5, 0.5, 0.5), 0.5, 0.6, 0.2, 1.0)]
    got = job.run_job(spark, text, SHAPE, 10.0, (0.3, 0.3), layer, read=read(spark))
    stats = got.stats.first()
    assert abs(stats["source_seconds"] - 4.6) < 1e-6 and stats["frames"] == got.frames.count()
    pixels = {(r["frame_no"], r["x"], r["y"]): (r["r"], r["g"], r["b"]) for r in got.pixels.collect()}
    assert len(pixels) == stats["frames"] * 24 and all(0 <= c <= 1 for p in pixels.values() for c in p)
    # a frame outside transitions is what a probe shows, but for the seed of its noise, which is equal in the first frame
    first = {(0, r["x"], r["y"]): (r["r"], r["g"], r["b"]) for r in job.probe(spark, text, 0.0, SHAPE, 10.0, (0.3, 0.3), layer, read=read(spark)).collect()}
    assert all(pixels[k] == pytest.approx(v) for k, v in first.items()) and len(first) == 24
    plain = json.dumps(SPEC | {"bypass": {}, "animate": {}, "inputs": [{"path": p} for p in "abc"]})
    whole = {(r["frame_no"], r["x"], r["y"]): r["r"] for r in job.run_job(spark, plain, SHAPE, 10.0, read=read(spark)).pixels.collect()}
    cut = job.run_chunks(spark, plain, SHAPE, 3, 10.0, read(spark)).collect()
    starts, n = {}, 0
    for c in range(3):
        starts[c] = n
        n += max(r["chunk_frame"] for r in cut if r["chunk"] == c) + 1
    assert {(starts[r["chunk"]] + r["chunk_frame"], r["x"], r["y"]): r["r"] for r in cut} == pytest.approx(whole)


def test_job_errors(spark):
    with pytest.raises(spec.DecodeError):
        job.run_job(spark, json.dumps(SPEC), SHAPE, read=lambda p: spark.read.parquet("/nowhere/at/all"))
    with pytest.raises(spec.NoVideo):
        job.run_job(spark, json.dumps(SPEC), SHAPE, read=lambda p: fixtures.test_frames(spark, 0, 10, 8, 4))


def test_images_fixtures_and_order_of_chunks(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(media.png(2, 2, bytes(range(12))))
    (tmp_path / "b.png").write_bytes(b"not an image")
    got = {r["path"][-5:]: r for r in media.images(spark, str(tmp_path)).collect()}
    assert bytes(got["a.png"]["rgba"]) == bytes([0, 1, 2, 255, 3, 4, 5, 255, 6, 7, 8, 255, 9, 10, 11, 255]) and got["a.png"]["width"] == 2
    assert got["b.png"]["rgba"] is None and got["b.png"]["error"]
    assert fixtures.cues(spark, 10, 2, 1.5).count() == 5 and fixtures.tone(spark, 1, 100, 10).count() == 200
    parts = [spark.createDataFrame([(float(i), i) for i in range(5)], "pts double, id int"), spark.createDataFrame([(float(i), 10 + i) for i in range(3)], "pts double, id int")]
    media.write_frames(chunks.concatenated(parts), str(tmp_path / "out"), "part")
    for part, ids in ((0, list(range(5))), (1, [10, 11, 12])):
        assert [r["id"] for r in spark.read.parquet(str(tmp_path / "out" / f"part={part}")).collect()] == ids
