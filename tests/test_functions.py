"""Easing curves, tracks, timelines and names against golden values and plain Python models."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkreel.functions import easing, geometry, resolve
from sparkreel.operators import chunks, timeline, transitions
from sparkreel.operators.ordered import asof_join, numbered
from sparkreel.operators.tracks import literal_track
from sparkreel.sources import cube, media, spec

GOLDEN = [
    ("linear", (0.25, 0.5, 0.75), 1e-6), ("easeIn", (0.015625, 0.125, 0.421875), 1e-6), ("easeOut", (0.578125, 0.875, 0.984375), 1e-6),
    ("easeInOut", (0.0625, 0.5, 0.9375), 1e-6), ("hold", (0, 0, 0), 1e-6), ("cubicBezier(0.42,0,1,1)", (0.093, 0.315, 0.622), 1e-3),
]
BAD = ["easeInn", "", "cubicBezier(1,2)", "cubicBezier(a,b,c,d)", "cubicBezier(0,0,1,1,1)", "cubicBezier(0,0,1,nan)", "cubicBezier(0,0,1,1"]


def test_golden_points(spark):
    for name, want, tol in GOLDEN:
        got = spark.range(1).select(*[easing.eased(easing.parse(name), F.lit(u)) for u in (0.25, 0.5, 0.75)], *[easing.eased_by(F.lit(name), F.lit(u)) for u in (0.25, 0.5, 0.75)]).first()
        assert all(abs(g - w) <= tol for g, w in zip(got, want * 2)), name


def test_endpoints_and_bad_names(spark):
    curves = ["linear", "easeIn", "easeOut", "easeInOut", "cubicBezier(0.42,0,1,1)", "cubicBezier(0.25,0.1,0.25,1)", "cubicBezier(1,0,1,0)"]
    got = spark.range(1).select(*[easing.eased(easing.parse(c), F.lit(u)) for c in curves for u in (0.0, 1.0)]).first()
    assert list(got) == [0.0, 1.0] * len(curves)
    assert all(easing.parse(b) is None for b in BAD)
    d = spark.createDataFrame([(b,) for b in BAD], "e string").select(easing.parsed(F.col("e")), easing.with_fallback(F.col("e")))
    assert {tuple(r) for r in d.collect()} == {(None, "linear")}


def test_flat_curve(spark):
    for t in (0.9, 0.99, 0.996):
        x, y = 1 - (1 - t) ** 3, t**3
        assert abs(spark.range(1).select(easing.bezier(F.lit(x), 1, 0, 1, 0)).first()[0] - y) <= 2e-3


def test_track_edges(spark):
    keys = [(1.0, 5.0, "linear"), (1.0, 6.0, "linear"), (2.0, 8.0, "linear"), (2.0, 9.0, "linear")]
    got = spark.range(1).select(*[literal_track(F.lit(t), keys) for t in (0.0, 1.0, 1.5, 2.0, 3.0)], literal_track(F.lit(1.0), [])).first()
    assert list(got) == [5.0, 5.0, 7.0, 9.0, 9.0, 0.0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(0.1, 50), min_size=1, max_size=6), st.data())
def test_timeline_total(durations, data):
    out = [timeline.Transition(data.draw(st.sampled_from([*resolve.TRANSITIONS, "spin"])), data.draw(st.floats(0, 60))) for _ in durations]
    slots = timeline.resolve(durations, out)
    overlap = sum(s.d for s in slots if s.overlaps)
    assert math.isclose(timeline.total_seconds(slots), sum(durations) - overlap, abs_tol=1e-6)
    assert all(0 <= s.d <= s.duration + 1e-9 for s in slots)


def test_emission_and_blend_against_sequential_model(spark):
    rng = random.Random(3)
    durations, rows = [], []
    for seg in range(4):
        step = rng.choice([0.31, 0.4, 0.55])
        pts = [round(rng.choice([0.0, 0.17]) + i * step, 3) for i in range(rng.randint(8, 14))]
        durations.append(pts[-1] + step)
        rows += [(seg, p, seg * 100 + i) for i, p in enumerate(pts)]
    slots = timeline.resolve(durations, [timeline.Transition(n, 2.0) for n in ("crossfade", "dipToBlack", "slideLeft", "cut")])
    frames = spark.createDataFrame(rows, "seg_idx int, pts double, id int")
    placed = timeline.on_timeline(frames, timeline.as_table(spark, slots))
    shown, last, want, blends = [], -1.0, [], {}
    for s in slots:
        for seg, p, i in [r for r in rows if r[0] == s.seg_idx]:
            t = s.offset + p
            if seg and t <= last + timeline.EPSILON:
                continue
            want.append(i)
            shown.append(t)
            last = max(last, t)
    for s in slots:
        nxt = [r for r in rows if r[0] == s.seg_idx + 1]
        for seg, p, i in [r for r in rows if r[0] == s.seg_idx]:
            if s.overlaps and s.d > 0 and p >= s.duration - s.d:
                b = [r for r in nxt if r[1] <= p - (s.duration - s.d) + timeline.EPSILON]
                blends[i] = (b[-1] if b else nxt[0])[2]
    numbered_frames = timeline.frame_index(timeline.emitted(placed), "id", 1.0).orderBy("frame_no").collect()
    assert [r["id"] for r in numbered_frames] == want
    assert [r["frame_no"] for r in numbered_frames] == list(range(len(want)))
    got = {r["id"]: r["b"]["id"] for r in timeline.blended(placed, frames, width=0.7).select("id", "b").collect()}
    assert got == blends and blends


def test_asof_join_matches_plain_search(spark):
    rng = random.Random(5)
    left = [(rng.randint(0, 2), round(rng.uniform(0, 30), 1), i) for i in range(200)]
    right = [(rng.randint(0, 2), round(rng.uniform(0, 30), 1), i) for i in range(40)]
    got = asof_join(spark.createDataFrame(left, "k int, t double, i int"), spark.createDataFrame(right, "k int, t double, v int"), ["k"], "t", 3.0, 0.05).collect()
    assert len(got) == len(left)
    for r in got:
        best = max(((t, v) for k, t, v in right if k == r["k"] and t <= r["t"] + 0.05), default=None)
        assert (r["b"] and (r["b"]["t"], r["b"]["v"])) == best


def test_wipe_and_slide_ends(spark):
    amounts = [transitions.wipe_amount(F.lit(u), F.lit(v), dx, dy, F.lit(p)) for p in (0.0, 1.0) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)) for u, v in ((0.0, 0.0), (1.0, 1.0), (0.4, 0.6))]
    assert list(spark.range(1).select(*amounts).first()) == [0.0] * 12 + [1.0] * 12
    top, bottom = spark.range(1).select(transitions.wipe_amount(F.lit(0.5), F.lit(0.0), 0, -1, F.lit(0.3)), transitions.wipe_amount(F.lit(0.5), F.lit(1.0), 0, -1, F.lit(0.3))).first()
    assert (top, bottom) == (0.0, 1.0)


def test_numbers_and_chunks(spark):
    d = spark.createDataFrame([(i, float(i) * 0.37) for i in range(50)], "i int, t double")
    assert [(r["i"], r["n"]) for r in numbered(d, [F.floor("t")], ["t"], "n").orderBy("i").collect()] == [(i, i) for i in range(50)]
    assert (chunks.effective(4.0, 3), chunks.effective(60.0, 3), chunks.effective(60.0, 1)) == (1, 3, 1)
    assert [spark.range(1).select(chunks.chunk_of(F.lit(t), 60.0, 3)).first()[0] for t in (0.0, 19.9, 20.0, 60.0)] == [0, 0, 1, 2]


def test_sources(spark, tmp_path):
    text = "TITLE \"x\"\nLUT_3D_SIZE 2\n" + "\n".join(f"{r} {g} {b}" for b in (0, 1) for g in (0, 1) for r in (0, 1))
    (tmp_path / "a.cube").write_text(text)
    assert sorted(map(tuple, cube.read_cube(spark, str(tmp_path / "a.cube")).collect()))[1] == (0, 0, 1, 0.0, 0.0, 1.0)
    with pytest.raises(spec.LutError):
        cube.parse_cube("LUT_3D_SIZE 2\n0 0 0")
    ass = ["[Events]"] + [f"Dialogue: 0,0:00:{a:05.2f},0:00:{b:05.2f},Default,,0,0,0,,one, two" for a, b in ((0, 5), (5, 12), (12, 20), (20, 34), (34, 59.5))]
    (tmp_path / "a.ass").write_text("\n".join(ass))
    cues = media.read_cues(spark, str(tmp_path / "a.ass")).orderBy("start").collect()
    assert [(c["start"], c["end"]) for c in cues] == [(0, 5), (5, 12), (12, 20), (20, 34), (34, 59.5)] and cues[0]["text"] == "one, two"
    frames = spark.createDataFrame([(i % 3, i, i * 0.5) for i in range(30)], "chunk int, frame_no int, pts double")
    for _ in range(2):  # the second write replaces the first
        media.write_frames(frames, str(tmp_path / "f"))
    back = media.frames(spark, str(tmp_path / "f"), 2.0, 5.0, ("frame_no", "pts"))
    assert sorted(r["pts"] for r in back.collect()) == [2.0, 2.5, 3.0, 3.5, 4.0, 4.5]
    assert "PushedFilters: [IsNotNull(pts), GreaterThanOrEqual(pts,2.0), LessThan(pts,5.0)]" in back._jdf.queryExecution().toString()
    image = media.png_rows(spark.createDataFrame([(1, 2, 1, bytearray(b"\x01\x02\x03\x04\x05\x06"))], "frame_no bigint, width int, height int, rgb binary")).first()
    assert bytes(image["png"]).startswith(b"\x89PNG")


def test_specs():
    job = spec.parse_job('{"output": "o", "preset": "1080p", "inputs": [{"path": "a", "transition": {"type": "spin"}}], "input": "b", "grade": {"lutPath": "x"}, "animate": {"cropPct": [{"t": 0, "v": 50, "ease": "bouncy"}]}}')
    assert [i["path"] for i in job.inputs] == ["a"] and job.grade["lutMix"] == 1.0 and job.tracks["cropPct"] == [(0.0, 0.5, "bouncy")]
    assert job.warnings == ["unknown transition spin", "unknown ease bouncy"]
    for bad in ("{", '{"preset": "a"}', '{"output": "o", "preset": "p"}'):
        with pytest.raises(spec.SpecError):
            spec.parse_job(bad)
    assert spec.argument("--at", ["x", "--at", "3", "--at", "4"]) == "3" and spec.argument("--at", ["--at"]) is None


def test_lut_by_array_and_by_join_agree(spark):
    from sparkreel.functions import color

    table = color.identity_lut(spark, 4).withColumns({c: F.sqrt(F.col(c)) for c in "rgb"})
    px = spark.createDataFrame([(i, (i * 37 % 101) / 100, (i * 53 % 97) / 96, (i * 11 % 89) / 88) for i in range(60)], "id int, r double, g double, b double")
    by_join = {r["id"]: (r["r"], r["g"], r["b"]) for r in cube.corners_joined(px, table, 4, "id").collect()}
    by_array = px.crossJoin(cube.as_array(table)).select("id", *color.lut_sampled(tuple(map(F.col, "rgb")), F.col("lut"), 4, 1.0)).collect()
    assert all(abs(x - y) < 1e-9 for r in by_array for x, y in zip(r[1:], by_join[r["id"]]))


def test_no_frame(spark):
    from sparkreel.plans import render

    with pytest.raises(Exception, match="NoFrame"):
        render.probe(spark.createDataFrame([(1, 0.5)], "id int, pts double"), "pts", 1.0, "id").collect()


def test_geometry_guards(spark):
    got = spark.range(1).select(*geometry.guarded(*[F.lit(x) for x in (0.5, 0.9, -1.0, -2.0, -3.0, 0.7)])).first()
    assert list(got) == [1.0, 0.5, 0.0, 0.0, 0.0, 0.5]
