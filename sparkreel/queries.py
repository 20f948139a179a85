"""The registered queries of the timeline and pixel engine, each with DuckDB SQL that gives the same rows.

Roles of the tables: events are frames (five types are five segments; an hour counts as a second), lineitem rows are
pixels, orders are keyframes, embeddings are 8 x 8 planes, parts are sizes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import color, easing, geometry, resolve
from .operators import audio, chunks, compare, composite, timeline, tracks, transitions
from .operators.ordered import numbered
from .plans import render
from .sources import cube, media, spec

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def r6(x: Column, digits: int = 6) -> Column:
    """Rounded, and never minus zero. The nudge keeps values that end in 5 off the edge, where the two engines round apart."""
    return F.round(x + 1e-9, digits) + F.lit(0.0)


def R(x: str, digits: int = 6) -> str:
    return f"(round({x} + 1e-9, {digits}) + 0e0)"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


TYPES = ("click", "error", "purchase", "signup", "view")
MICROS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {})"


def events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "event_type", "user_id", "value", F.expr(MICROS.format("ts")).alias("us"))
    return e.withColumn("seg_idx", (F.array_position(F.array(*map(F.lit, TYPES)), F.col("event_type")) - 1).cast("int"))


def frames(spark: SparkSession, d: str) -> DataFrame:
    """seg_idx, event_id, user_id, value, pts. The first time of each segment is one row per segment."""
    e = events(spark, d)
    start = e.groupBy("seg_idx").agg(F.min("us").alias("start"))
    e = e.join(F.broadcast(start), "seg_idx")
    return e.select("seg_idx", "event_id", "user_id", "value", ((F.col("us") - F.col("start")) / 3.6e9).alias("pts"))


EV = """
ev AS (SELECT event_id, event_type, user_id, value, epoch_us(ts) AS us, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INT) AS seg_idx FROM events),
fr AS (SELECT seg_idx, event_id, user_id, value, (us - min(us) OVER (PARTITION BY seg_idx)) / 3.6e9 AS pts FROM ev)
"""
FR = "WITH " + EV
OUT = [timeline.Transition("crossfade", 20.0), timeline.Transition("wipeUp", 15.0), timeline.Transition("dipToBlack", 12.0), timeline.Transition("slideLeft", 900.0, "easeIn"), None]
TL = f"""
WITH RECURSIVE {EV},
seg AS (SELECT seg_idx, max(pts) + 0.5e0 AS duration FROM fr GROUP BY seg_idx),
tr(seg_idx, kind, sec, ovl) AS (VALUES (0, 'crossfade', 20e0, true), (1, 'wipeUp', 15e0, true), (2, 'dipToBlack', 12e0, false), (3, 'slideLeft', 900e0, true)),
sx AS (SELECT s.seg_idx, s.duration, lead(s.duration) OVER (ORDER BY s.seg_idx) AS nxt, kind, sec, coalesce(ovl, false) AS ovl FROM seg s LEFT JOIN tr USING (seg_idx)),
tl AS (
  SELECT seg_idx, 0e0 AS offs, duration, kind, ovl, CASE WHEN kind IS NULL OR nxt IS NULL THEN 0e0 ELSE greatest(0e0, least(sec, duration, nxt)) END AS d FROM sx WHERE seg_idx = 0
  UNION ALL
  SELECT s.seg_idx, tl.offs + tl.duration - CASE WHEN tl.ovl THEN tl.d ELSE 0e0 END, s.duration, s.kind, s.ovl,
    CASE WHEN s.kind IS NULL OR s.nxt IS NULL THEN 0e0 ELSE greatest(0e0, least(s.sec, CASE WHEN s.ovl THEN s.duration - CASE WHEN tl.ovl THEN tl.d ELSE 0e0 END ELSE s.duration END, s.nxt)) END
  FROM tl JOIN sx s ON s.seg_idx = tl.seg_idx + 1
),
pl AS (
  SELECT fr.*, t.offs, t.duration, t.kind AS kind_out, t.d AS d_out, t.ovl, p.kind AS kind_in, coalesce(p.d, 0e0) AS d_in, t.offs + fr.pts AS out_pts
  FROM fr JOIN tl t USING (seg_idx) LEFT JOIN tl p ON p.seg_idx = t.seg_idx - 1
),
mk AS (SELECT t.seg_idx, (SELECT max(out_pts) FROM pl p WHERE p.seg_idx < t.seg_idx) AS mark FROM tl t),
em AS (SELECT pl.* FROM pl JOIN mk USING (seg_idx) WHERE mark IS NULL OR out_pts > mark + 1e-4),
bl AS (
  SELECT a.*, b.event_id AS b_id, b.value AS b_value FROM (
    SELECT *, pts - (duration - d_out) AS b_time, (pts - (duration - d_out)) / d_out AS progress, seg_idx + 1 AS seg_b, pts - (duration - d_out) + 1e-4 AS lim
    FROM pl WHERE ovl AND d_out > 0 AND pts >= duration - d_out) a
  ASOF LEFT JOIN fr b ON a.seg_b = b.seg_idx AND a.lim >= b.pts
),
f1 AS (SELECT seg_idx AS seg_b, arg_min(event_id, pts) AS f_id, arg_min(value, pts) AS f_value FROM fr GROUP BY seg_idx),
hb AS (SELECT bl.* EXCLUDE (b_id, b_value), coalesce(b_id, f_id) AS b_id, coalesce(b_value, f_value) AS b_value FROM bl JOIN f1 USING (seg_b))
"""


def slots(f: DataFrame) -> list[timeline.Slot]:
    """The resolved timeline; one duration per segment comes to the driver."""
    rows = f.groupBy("seg_idx").agg((F.max("pts") + 0.5).alias("duration")).orderBy("seg_idx").collect()
    return timeline.resolve([r["duration"] for r in rows], OUT)


def placed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    f = frames(spark, d)
    return timeline.on_timeline(f, timeline.as_table(spark, slots(f))), f


def pixels(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem")
    return p.select(
        "l_orderkey", (F.col("l_quantity") / 50).alias("r"), (F.col("l_discount") * 10).alias("g"), (F.col("l_tax") * 12.5).alias("b"),
        (F.col("l_orderkey") % 1080).alias("x"), (F.col("l_partkey") % 1920).alias("y"),
    )


PX = "WITH px AS (SELECT l_orderkey, l_quantity / 50 AS r, l_discount * 10 AS g, l_tax * 12.5e0 AS b, l_orderkey % 1080 AS x, l_partkey % 1920 AS y FROM lineitem)"
def RGB():  # noqa: N802
    """The pixel as columns."""
    return tuple(map(F.col, "rgb"))


def rgb6(rgb) -> list[Column]:
    return [r6(c).alias(n) for c, n in zip(rgb, "rgb")]


def c01(x: str) -> str:
    return f"greatest(0e0, least(1e0, {x}))"


# ---- easing and tracks

def _U() -> Column:  # noqa: N802
    return F.col("value") / 500


@query(f"""
WITH e AS (SELECT event_id, value / 500 AS u FROM events)
SELECT event_id, 0e0 AS hold, {R('u')} AS linear, {R('u * u * u')} AS ease_in, {R('1 - (1 - u) * (1 - u) * (1 - u)')} AS ease_out,
  {R('CASE WHEN u < 0.5e0 THEN 4 * u * u * u ELSE 1 - (2 - 2 * u) * (2 - 2 * u) * (2 - 2 * u) / 2 END')} AS ease_in_out FROM e""")
def ease_named(spark, d):
    cols = {"hold": "hold", "linear": "linear", "easeIn": "ease_in", "easeOut": "ease_out", "easeInOut": "ease_in_out"}
    return table(spark, d, "events").select("event_id", *[r6(easing.eased(k, _U())).alias(v) for k, v in cols.items()])


def sql_bezier(u: str, x1: float, y1: float, x2: float, y2: float) -> str:
    at = lambda t, a, b: f"(3 * (1 - {t}) * (1 - {t}) * {t} * {a}e0 + 3 * (1 - {t}) * {t} * {t} * {b}e0 + {t} * {t} * {t})"
    t = f"list_reduce(list_transform(range(50), lambda i: pow(0.5e0, i + 2)), lambda acc, h: CASE WHEN {at('acc', x1, x2)} < {u} THEN acc + h ELSE acc - h END, 0.5e0)"
    return f"(CASE WHEN {u} <= 0 THEN 0e0 WHEN {u} >= 1 THEN 1e0 ELSE list_transform([{t}], lambda acc: {at('acc', y1, y2)})[1] END)"


@query(f"""
WITH e AS (SELECT event_id, value / 500 AS u FROM events)
SELECT event_id, {R(sql_bezier('u', 0.42, 0, 1, 1))} AS ease, {R(sql_bezier('u', 0.25, 0.1, 0.25, 1))} AS soft FROM e""")
def ease_bezier(spark, d):
    return table(spark, d, "events").select("event_id", r6(easing.bezier(_U(), 0.42, 0, 1, 1)).alias("ease"), r6(easing.bezier(_U(), 0.25, 0.1, 0.25, 1)).alias("soft"))


EASES = ["easeIn", "easeInn", "", "cubicBezier(1,2)", "cubicBezier(a,b,c,d)", "cubicBezier(0.42, 0, 1 ,1)", "cubicBezier(0,0,1,nan)", "cubicBezier(0,0,1,1", "hold", "cubicBezier(0,0,1,1,1)", "linear", "EaseOut"]


def _ease_text() -> Column:
    return F.element_at(F.array(*map(F.lit, EASES)), (F.col("event_id") % len(EASES) + 1).cast("int"))


_EASE_SQL = "[" + ", ".join(f"'{e}'" for e in EASES) + f"][event_id % {len(EASES)} + 1]"
_EASE_KIND = """CASE WHEN ease IN ('hold', 'linear', 'easeIn', 'easeOut', 'easeInOut') THEN ease
  WHEN regexp_full_match(ease, 'cubicBezier\\((\\s*-?[0-9.]+\\s*,){3}\\s*-?[0-9.]+\\s*\\)') THEN 'cubicBezier' END"""


@query(f"WITH e AS (SELECT event_id, {_EASE_SQL} AS ease FROM events) SELECT event_id, ease, {_EASE_KIND} AS kind, coalesce({_EASE_KIND}, 'linear') AS used FROM e")
def ease_parse(spark, d):
    e = table(spark, d, "events").select("event_id", _ease_text().alias("ease"))
    return e.select("event_id", "ease", easing.parsed(F.col("ease")).alias("kind"), easing.with_fallback(F.col("ease")).alias("used"))


@query(f"WITH e AS (SELECT {_EASE_SQL} AS ease FROM events) SELECT DISTINCT ease FROM e WHERE {_EASE_KIND} IS NULL")
def unknown_ease_names(spark, d):
    e = table(spark, d, "events").select(_ease_text().alias("ease"))
    return e.filter(easing.parsed(F.col("ease")).isNull()).distinct()


KEYS = [(0.0, 0.0, "linear"), (100.0, 1.0, "easeIn"), (300.0, 0.2, "hold"), (500.0, 0.6, "cubicBezier(0.42,0,1,1)"), (700.0, 0.9, "easeInOut")]
SQL_TRACK = f"""(CASE WHEN t <= 0 THEN 0e0 WHEN t >= 700 THEN 0.9e0
  WHEN t < 100 THEN pow(t / 100, 3)
  WHEN t < 300 THEN 1e0
  WHEN t < 500 THEN 0.2e0 + 0.4e0 * {sql_bezier('((t - 300) / 200)', 0.42, 0, 1, 1)}
  WHEN t < 600 THEN 0.6e0 + 0.3e0 * 4 * pow((t - 500) / 200, 3)
  ELSE 0.6e0 + 0.3e0 * (1 - pow(2 - 2 * (t - 500) / 200, 3) / 2) END)"""


@query(f"{FR}, e AS (SELECT event_id, pts AS t FROM fr) SELECT event_id, {R(SQL_TRACK)} AS value FROM e")
def track_eval_literal(spark, d):
    return frames(spark, d).select("event_id", r6(tracks.literal_track(F.col("pts"), KEYS)).alias("value"))


PROBES = (0.0, 0.5, 100.25, 400.5, 900.75, 5000.0)


@query(f"""
WITH k0 AS (SELECT o_custkey AS c, o_orderkey AS k, o_totalprice AS v, (epoch_us(o_orderdate) - min(epoch_us(o_orderdate)) OVER (PARTITION BY o_custkey)) / 8.64e10 AS t,
    ['linear', 'easeIn', 'hold', 'cubicBezier(0.42,0,1,1)'][o_orderkey % 4 + 1] AS ease FROM orders),
k AS (SELECT *, lead(t) OVER w AS t1, lead(v) OVER w AS v1, lead(ease) OVER w AS e1, row_number() OVER (PARTITION BY c, t ORDER BY k DESC) AS back, first_value(v) OVER w AS v0 FROM k0 WINDOW w AS (PARTITION BY c ORDER BY t, k)),
s AS (SELECT * FROM k WHERE back = 1),
p AS (SELECT c_custkey AS c, unnest([{', '.join(f'{x}e0' for x in PROBES)}]) AS t FROM customer),
j AS (SELECT p.c, p.t, s.t AS t0, s.v, s.t1, s.v1, s.e1, s.v0, (p.t - s.t) / (s.t1 - s.t) AS u FROM p ASOF LEFT JOIN s ON p.c = s.c AND p.t >= s.t)
SELECT c AS custkey, t, {R(f'''CASE WHEN t0 IS NULL THEN 0e0 WHEN t = 0 AND t1 IS NOT NULL THEN v0 WHEN t1 IS NULL THEN v
  ELSE v + (v1 - v) * CASE e1 WHEN 'linear' THEN u WHEN 'easeIn' THEN u * u * u WHEN 'hold' THEN 0e0 ELSE {sql_bezier('u', 0.42, 0, 1, 1)} END END''', 3)} AS value FROM j""")
def track_eval_table(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("v"), F.expr(MICROS.format("o_orderdate")).alias("us"))
    keys = o.withColumn("t", (F.col("us") - F.min("us").over(W.partitionBy("o_custkey"))) / 8.64e10)
    kinds = F.array(*map(F.lit, ("linear", "easeIn", "hold", "cubicBezier(0.42,0,1,1)")))
    keys = keys.select(F.col("o_custkey").alias("custkey"), "t", "v", F.element_at(kinds, (F.col("o_orderkey") % 4 + 1).cast("int")).alias("ease"), "o_orderkey")
    probes = table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), F.explode(F.array(*map(F.lit, PROBES))).alias("t"))
    return tracks.table_tracks(probes, keys, "custkey", "t", 1000.0, "o_orderkey").select("custkey", "t", r6(F.col("value"), 3).alias("value"))


# ---- colour


def sql_grade(b: str, c: str, s: str, tint: str, rgb=("r", "g", "b"), src: str = "px", keep: str = "*") -> str:
    """CTEs g1 (contrast), g2 (saturation) and g3 (hue) over ``src``; g3 has gr, gg, gb."""
    hue = lambda i: c01(" + ".join(
        f"({color.HUE[j][i][0]}e0 + ({color.HUE[j][i][1]}e0) * cos({tint}) + ({color.HUE[j][i][2]}e0) * sin({tint})) * s{n}" for j, n in enumerate("rgb")))
    y = "(0.2126e0 * cr + 0.7152e0 * cg + 0.0722e0 * cb)"
    return f"""g1 AS (SELECT {keep}, {', '.join(f'({x} - 0.5e0) * {c} + 0.5e0 + {b} AS c{n}' for x, n in zip(rgb, 'rgb'))} FROM {src}),
g2 AS (SELECT *, {', '.join(f'{y} + (c{n} - {y}) * {s} AS s{n}' for n in 'rgb')} FROM g1),
g3 AS (SELECT *, {', '.join(f'{hue(i)} AS g{n}' for i, n in enumerate('rgb'))} FROM g2)"""


LOOK = render.Look(brightness=0.05, contrast=1.1, saturation=0.9, tint=0.3)
SQL_LOOK = sql_grade("0.05e0", "1.1e0", "0.9e0", "0.3e0")


@query(f"{PX}, {SQL_LOOK} SELECT l_orderkey, count(*) AS pixels, {R('avg(gr)')} AS r, {R('avg(gg)')} AS g, {R('avg(gb)')} AS b FROM g3 GROUP BY l_orderkey")
def grade_pixels(spark, d):
    """The flagship: every pixel graded, then the mean colour of each frame (an order)."""
    p = render.render(pixels(spark, d), LOOK, F.lit(1))
    return p.groupBy("l_orderkey").agg(F.count("*").alias("pixels"), *[r6(F.avg(c)).alias(c) for c in "rgb"])


@query(f"{PX}, {sql_grade('0e0', '1e0', '1e0', '(0.3e0 + radians(20e0))')} SELECT l_orderkey, {', '.join(f'{R(f'g{n}')} AS {n}' for n in 'rgb')} FROM g3")
def hue_rotate(spark, d):
    tint = F.lit(0.3) + F.radians(F.lit(20.0))
    return pixels(spark, d).select("l_orderkey", *rgb6(color.graded(RGB(), tint=tint)))


@query(f"""{PX}, q AS (SELECT l_orderkey, (r - 16 / 255e0) * 255 / 219 AS yy, (g - 128 / 255e0) * 255 / 224 AS pb, (b - 128 / 255e0) * 255 / 224 AS pr FROM px)
SELECT l_orderkey, {R(c01('yy + 1.5748e0 * pr'))} AS r, {R(c01('yy - 0.1873e0 * pb - 0.4681e0 * pr'))} AS g, {R(c01('yy + 1.8556e0 * pb'))} AS b FROM q""")
def ycbcr_rgb(spark, d):
    return pixels(spark, d).select("l_orderkey", *rgb6(color.ycbcr_to_rgb(*RGB())))


def sql_hash(x: str, y: str, seed: str) -> str:
    m = "4294967295"
    h0 = f"(({x}) * 1973 + ({y}) * 9277 + ({seed}) * 26699) & {m}"
    h1 = f"xor(xor(({h0}), 61), ({h0}) >> 16)"
    h2 = f"((({h1}) * 9) & {m})"
    h3 = f"xor({h2}, {h2} >> 4)"
    h4 = f"((({h3}) * 668265261) & {m})"
    return f"((xor({h4}, {h4} >> 15) & 16777215) / 16777215e0)"


@query(f"{PX} SELECT l_orderkey, x, y, {R(sql_hash('x', 'y', '7'))} AS noise, {', '.join(R(c01(f'{c} + ({sql_hash('x', 'y', '7')} - 0.5e0) * 0.2e0')) + f' AS {c}' for c in 'rgb')} FROM px")
def noise_hash(spark, d):
    x, y = F.col("x"), F.col("y")
    return pixels(spark, d).select("l_orderkey", "x", "y", r6(color.hash_noise(x, y, 7)).alias("noise"), *rgb6(color.noisy(RGB(), x, y, 7, 20.0)))


@query(f"{PX} SELECT l_orderkey, y, {', '.join(R(c01(f'{c} * (1 + ({sql_hash('y', '0', '7')} - 0.5e0) * 0.2e0)')) + f' AS {c}' for c in 'rgb')} FROM px")
def grain_rows(spark, d):
    return pixels(spark, d).select("l_orderkey", "y", *rgb6(color.grainy(RGB(), F.col("y"), 7, 40.0)))


@query(f"{PX} SELECT l_orderkey, {', '.join(f'CAST(round_even({c01(f'{c} * 0.9e0')} * 255, 0) AS INT) AS {c}' for c in 'rgb')} FROM px")
def quantize8(spark, d):
    return pixels(spark, d).select("l_orderkey", *[color.quantized(c * 0.9).alias(n) for c, n in zip(RGB(), "rgb")])


N = 5


def _lut(spark: SparkSession) -> DataFrame:
    """A table that squares each channel."""
    return color.identity_lut(spark, N).withColumns({c: F.col(c) * F.col(c) for c in "rgb"})


@query(f"SELECT CAST(a AS INT) AS ri, CAST(b AS INT) AS gi, CAST(c AS INT) AS bi, {R('a / 32e0')} AS r, {R('b / 32e0')} AS g, {R('c / 32e0')} AS b FROM range(33) x(a), range(33) y(b), range(33) z(c)")
def lut_identity(spark, d):
    return color.identity_lut(spark, 33).select("ri", "gi", "bi", *rgb6(RGB()))


def sql_square_lut(v: str) -> str:
    at = f"greatest(0e0, least({N - 1}e0, ({v}) * {N} - 0.5e0))"
    lo = f"floor({at})"
    sq = lambda i: f"pow({i} / {N - 1}e0, 2)"
    return f"({sq(lo)} + ({sq(f'least({lo} + 1, {N - 1})')} - {sq(lo)}) * ({at} - {lo}))"


@query(f"{PX} SELECT l_orderkey, {', '.join(R(f'{c} + ({sql_square_lut(c)} - {c}) * 0.75e0') + f' AS {c}' for c in 'rgb')} FROM px")
def lut_apply(spark, d):
    one = cube.as_array(_lut(spark))  # one row of N^3 entries
    p = pixels(spark, d).crossJoin(F.broadcast(one))
    return p.select("l_orderkey", *rgb6(color.lut_sampled(RGB(), F.col("lut"), N, 0.75)))


CUBE = ["# a comment", "TITLE \"t\"", "LUT_3D_SIZE 2", "", "domain_min 0 0 0", "LUT_3D_INPUT_RANGE 0 1", "0.5 0.5", "a b c", *[f"{r * 0.5} {g * 0.25} {b}" for b in (0, 1) for g in (0, 1) for r in (0, 1)]]


@query("SELECT CAST(r AS INT) AS ri, CAST(g AS INT) AS gi, CAST(b AS INT) AS bi, r * 0.5e0 AS r, g * 0.25e0 AS g, b * 1e0 AS b FROM range(2) x(r), range(2) y(g), range(2) z(b)")
def cube_parse(spark, d):
    lines = spark.createDataFrame(list(enumerate(CUBE)), "line_no int, line string")
    return cube.entries(lines)


TRACKED = render.Look(contrast=1.2, saturation=0.8, tracks={"brightness": KEYS})


@query(f"""{FR}, e AS (SELECT event_id, value / 500 AS r, 1 - value / 500 AS g, 0.5e0 AS b, pts AS t FROM fr), px AS (SELECT *, {SQL_TRACK} AS bright FROM e),
{sql_grade('bright', '1.2e0', '0.8e0', '0e0')} SELECT event_id, {', '.join(f'{R(f'g{n}')} AS {n}' for n in 'rgb')} FROM g3""")
def grade_tracks_apply(spark, d):
    f = frames(spark, d).select("event_id", "pts", _U().alias("r"), (1 - _U()).alias("g"), F.lit(0.5).alias("b"), F.lit(0).alias("x"), F.lit(0).alias("y"))
    return render.render(f, TRACKED, F.lit(1), "pts").select("event_id", *rgb6(RGB()))


# ---- names and settings


@query("""
WITH p AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '720p' WHEN 1 THEN '1080P' WHEN 2 THEN concat(p_size * 160, 'x', p_size * 90) WHEN 3 THEN 'bogus' WHEN 4 THEN '1x2x3' ELSE concat(p_size * 16, 'X', 9) END AS preset FROM part),
q AS (SELECT *, list_filter(list_transform(string_split(lower(preset), 'x'), lambda s: TRY_CAST(s AS BIGINT)), lambda n: n IS NOT NULL) AS n FROM p)
SELECT p_partkey, preset,
  CASE WHEN lower(preset) = '720p' THEN 720 WHEN len(n) = 2 THEN n[1] ELSE 1080 END::BIGINT AS width,
  CASE WHEN lower(preset) = '720p' THEN 1280 WHEN len(n) = 2 THEN n[2] ELSE 1920 END::BIGINT AS height,
  CASE WHEN lower(preset) = '720p' THEN 5000000 WHEN len(n) = 2 THEN greatest(2000000, n[1] * n[2] * 5 // 100) ELSE 10000000 END::BIGINT AS bitrate FROM q""")
def preset_resolve(spark, d):
    size, key = F.col("p_size"), F.col("p_partkey") % 6
    name = (
        F.when(key == 0, "720p").when(key == 1, "1080P").when(key == 2, F.concat((size * 160).cast("string"), F.lit("x"), (size * 90).cast("string")))
        .when(key == 3, "bogus").when(key == 4, "1x2x3").otherwise(F.concat((size * 16).cast("string"), F.lit("X9")))
    )
    w, h, rate = resolve.preset(F.col("preset"))
    return table(spark, d, "part").select("p_partkey", name.alias("preset")).select("p_partkey", "preset", w.alias("width"), h.alias("height"), rate.alias("bitrate"))


@query(f"""
WITH p AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN printf('#%06x', p_partkey * 7919 % 16777216) WHEN 1 THEN printf('%08x', p_partkey * 104729 % 4294967296) WHEN 2 THEN 'zzz' ELSE '#12345' END AS hex FROM part),
q AS (SELECT *, ltrim(hex, '#') AS x FROM p),
v AS (SELECT *, len(x) IN (6, 8) AND regexp_full_match(x, '[0-9a-f]+') AS ok FROM q)
SELECT p_partkey, hex, {', '.join(f"CASE WHEN ok THEN {R(f"CAST(('0x' || substr(x, {2 * i + 1}, 2)) AS INT) / 255e0")} END AS {c}" for i, c in enumerate('rgb'))},
  CASE WHEN ok AND len(x) = 6 THEN 1e0 WHEN ok THEN {R("CAST(('0x' || substr(x, 7, 2)) AS INT) / 255e0")} END AS a FROM v""")
def hex_color(spark, d):
    key = F.col("p_partkey")
    text = (
        F.when(key % 4 == 0, F.format_string("#%06x", key * 7919 % 16777216)).when(key % 4 == 1, F.format_string("%08x", key * 104729 % 4294967296)).when(key % 4 == 2, "zzz").otherwise("#12345")
    )
    return table(spark, d, "part").select("p_partkey", text.alias("hex")).select("p_partkey", "hex", *[r6(color.hex_channel(F.col("hex"), i)).alias(c) for i, c in enumerate("rgba")])


_CODECS = ["HEVC", "h264", "ProRes", "prores422hq", "vp9"]


def _pick(values: list[str], key: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def sql_pick(values: list[str], key: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][{key} % {len(values)} + 1]"


SQL_CODEC = "CASE lower(raw) WHEN 'hevc' THEN 'hevc' WHEN 'prores' THEN 'prores422hq' WHEN 'prores422hq' THEN 'prores422hq' ELSE 'h264' END"


@query(f"WITH p AS (SELECT p_partkey, {sql_pick(_CODECS, 'p_partkey')} AS raw FROM part) SELECT p_partkey, raw, {SQL_CODEC} AS codec FROM p")
def codec_parse(spark, d):
    return table(spark, d, "part").select("p_partkey", _pick(_CODECS, "p_partkey").alias("raw")).withColumn("codec", resolve.codec(F.col("raw")))


@query(f"""
WITH p AS (SELECT p_partkey, {sql_pick(_CODECS, 'p_partkey')} AS raw, 20 + p_size AS fps, p_size * 100003 AS bitrate, CASE WHEN p_partkey % 3 = 0 THEN p_size * 200001 END AS peak, p_partkey % 2 = 0 AS delivery FROM part),
q AS (SELECT *, {SQL_CODEC} AS codec FROM p)
SELECT p_partkey, codec, CASE WHEN codec <> 'prores422hq' THEN fps * 2 END::BIGINT AS gop, CASE WHEN codec <> 'prores422hq' THEN delivery END AS reorder,
  CASE WHEN codec <> 'prores422hq' THEN bitrate END::BIGINT AS bitrate,
  CASE WHEN codec <> 'prores422hq' AND delivery THEN floor(coalesce(peak, floor(bitrate * 1.5e0)) / 8) END::BIGINT AS peak_bytes,
  CASE WHEN codec = 'prores422hq' THEN 'mov' ELSE 'mp4' END AS container FROM q""")
def encoder_settings(spark, d):
    size = F.col("p_size").cast("bigint")
    peak = F.when(F.col("p_partkey") % 3 == 0, size * 200001)
    kind = resolve.codec(_pick(_CODECS, "p_partkey"))
    got = resolve.encoder_settings(kind, size + 20, size * 100003, peak, F.col("p_partkey") % 2 == 0)
    return table(spark, d, "part").select("p_partkey", kind.alias("codec"), *[c.alias(n) for n, c in got.items()])


_NAMES = [*resolve.TRANSITIONS, "spin"]


@query(f"""
WITH p AS (SELECT p_partkey, {sql_pick(_NAMES, 'p_partkey')} AS name FROM part)
SELECT p_partkey, name, CASE WHEN name LIKE 'wipe%' THEN 'wipe' WHEN name LIKE 'slide%' THEN 'slide' WHEN name IN ('crossfade', 'dipToBlack') THEN name ELSE 'cut' END AS kind,
  CAST(CASE WHEN name LIKE '%Left' THEN 1 WHEN name LIKE '%Right' THEN -1 ELSE 0 END AS INT) AS dx, CAST(CASE WHEN name LIKE '%Up' THEN -1 WHEN name LIKE '%Down' THEN 1 ELSE 0 END AS INT) AS dy, name = 'spin' AS unknown FROM p""")
def transition_parse(spark, d):
    kind, dx, dy, unknown = resolve.transition(F.col("name"))
    p = table(spark, d, "part").select("p_partkey", _pick(_NAMES, "p_partkey").alias("name"))
    return p.select("p_partkey", "name", kind.alias("kind"), dx.alias("dx"), dy.alias("dy"), unknown.alias("unknown"))


_CORNERS = ["tl", "tc", "tr", "ml", "mc", "mr", "bl", "bc", "br", "xx"]


@query(f"WITH p AS (SELECT p_partkey, {sql_pick(_CORNERS, 'p_partkey')} AS code FROM part) SELECT p_partkey, code, CAST([7, 8, 9, 4, 5, 6, 1, 2, 3, NULL][p_partkey % 10 + 1] AS INT) AS position FROM p")
def corner_to_numpad(spark, d):
    p = table(spark, d, "part").select("p_partkey", _pick(_CORNERS, "p_partkey").alias("code"))
    return p.withColumn("position", geometry.corner_position(F.col("code")))


@query(f"""
WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, '1080p' AS preset, k / 100e0 AS brightness, 1e0 AS contrast, CASE WHEN k % 2 = 0 THEN 1e0 ELSE 0e0 END AS lut_mix, {R('k / 100e0')} AS crop, {R('0.25e0 + radians(k * 1e0)')} AS tint FROM e""")
def spec_json_decode(spark, d):
    k = F.from_json("props", "k bigint", {"mode": "FAILFAST"})["k"]
    text = F.format_string('{"output": "o", "preset": "1080p", "grade": {"brightness": %.2f, "tint": 0.25%s}, "bypass": {"cropPct": %d, "colorTintDeg": %d}, "extra": [1]}',
        k / 100, F.when(k % 2 == 0, ', "lutPath": "a.cube"').otherwise(""), k, k)
    s = F.col("s")
    return table(spark, d, "events").select("event_id", spec.decoded(text).alias("s")).select(
        "event_id", "s.preset", spec.grade_field(s, "brightness").alias("brightness"), spec.grade_field(s, "contrast").alias("contrast"),
        spec.grade_field(s, "lutMix").alias("lut_mix"), r6(spec.crop_fraction(s)).alias("crop"), r6(spec.tint_radians(s)).alias("tint"))


# ---- timeline and transitions


@query(f"{TL} SELECT seg_idx, {R('offs')} AS start, {R('duration')} AS duration, kind, {R('d')} AS d, ovl AS overlaps, {R('max(offs + duration) OVER ()', 3)} AS total, lead(kind) OVER (ORDER BY seg_idx) AS next_kind FROM tl")
def timeline_resolve(spark, d):
    s = slots(frames(spark, d))
    t = timeline.as_table(spark, s)
    return t.select(
        "seg_idx", r6(F.col("offset")).alias("start"), r6(F.col("duration")).alias("duration"), F.col("kind_out").alias("kind"), r6(F.col("d_out")).alias("d"), "overlaps",
        r6(F.lit(timeline.total_seconds(s)), 3).alias("total"), F.lead("kind_out").over(W.orderBy("seg_idx")).alias("next_kind"),
    )


@query(f"{TL}, e AS (SELECT event_id, us / 1e6 - 1704067200e0 AS t0 FROM ev), q AS (SELECT event_id, t0 / 900 AS t FROM e) SELECT event_id, {R('t')} AS t, (SELECT CAST(max(seg_idx) AS INT) FROM tl WHERE offs <= t OR seg_idx = 0) AS seg_idx, {R('t - (SELECT max(offs) FROM tl WHERE offs <= t OR seg_idx = 0)')} AS local FROM q")
def segment_at(spark, d):
    s = slots(frames(spark, d))
    t = events(spark, d).select("event_id", ((F.col("us") / 1e6 - 1704067200.0) / 900).alias("t"))
    return timeline.segment_at(t, "t", s).select("event_id", r6(F.col("t")).alias("t"), "seg_idx", r6(F.col("local")).alias("local"))


@query(f"{TL} SELECT seg_idx, event_id, {R('out_pts')} AS out_pts FROM em")
def emitted_frames(spark, d):
    p, _ = placed(spark, d)
    return timeline.emitted(p).select("seg_idx", "event_id", r6(F.col("out_pts")).alias("out_pts"))


@query(f"{TL} SELECT seg_idx, event_id, row_number() OVER (ORDER BY seg_idx, pts, event_id) - 1 AS frame_no, row_number() OVER (ORDER BY seg_idx, pts, event_id) AS seed FROM em")
def frame_index(spark, d):
    p, _ = placed(spark, d)
    n = timeline.frame_index(timeline.emitted(p), "event_id", 10.0)
    return n.select("seg_idx", "event_id", "frame_no", (F.col("frame_no") + 1).alias("seed"))


def held(spark, d) -> DataFrame:
    p, f = placed(spark, d)
    return timeline.blended(p, f, width=10.0)


@query(f"{TL} SELECT event_id, b_id, {R('progress')} AS progress FROM hb")
def trans_hold(spark, d):
    return held(spark, d).select("event_id", F.col("b.event_id").alias("b_id"), r6(F.col("progress")).alias("progress"))


def _pair() -> tuple[Column, Column, Column]:
    """A, B and the progress."""
    return F.col("value") / 500, F.col("b.value") / 500, F.col("progress")


def _uv() -> tuple[Column, Column]:
    return (F.col("event_id") % 100 + 0.5) / 100, (F.col("event_id") % 37 + 0.5) / 37


@query(f"{TL} SELECT event_id, {R('value / 500 + (b_value - value) / 500 * progress')} AS mixed FROM hb WHERE kind_out = 'crossfade'")
def trans_crossfade(spark, d):
    return held(spark, d).filter("kind_out = 'crossfade'").select("event_id", r6(transitions.crossfade(*_pair())).alias("mixed"))


@query(f"""{TL}, w AS (SELECT *, 1 - (event_id % 37 + 0.5e0) / 37 AS s, -0.04e0 + 1.08e0 * progress AS edge FROM hb WHERE kind_out = 'wipeUp'),
z AS (SELECT *, {c01('(s - (edge - 0.04e0)) / 0.08e0')} AS z FROM w)
SELECT event_id, {R('1 - z * z * (3 - 2 * z)')} AS amount, {R('value / 500 + (b_value - value) / 500 * (1 - z * z * (3 - 2 * z))')} AS mixed FROM z""")
def trans_wipe(spark, d):
    a, b, progress = _pair()
    m = transitions.wipe_amount(*_uv(), 0, -1, progress)
    return held(spark, d).filter("kind_out = 'wipeUp'").select("event_id", r6(m).alias("amount"), r6(color.mix(a, b, m)).alias("mixed"))


@query(f"""{TL}, w AS (SELECT *, (event_id % 100 + 0.5e0) / 100 + (1 - progress) AS bu FROM hb WHERE kind_out = 'slideLeft')
SELECT event_id, {R('bu')} AS bu, bu >= 0 AND bu <= 1 AS shows, {R('CASE WHEN bu >= 0 AND bu <= 1 THEN b_value ELSE value END / 500')} AS mixed FROM w""")
def trans_slide(spark, d):
    a, b, progress = _pair()
    bu, _, shows = transitions.slide_source(*_uv(), 1, 0, progress)
    return held(spark, d).filter("kind_out = 'slideLeft'").select("event_id", r6(bu).alias("bu"), shows.alias("shows"), r6(F.when(shows, b).otherwise(a)).alias("mixed"))


@query(f"""{TL}, a AS (SELECT event_id, greatest(CASE WHEN kind_out = 'dipToBlack' AND d_out > 0 AND pts > duration - d_out / 2 THEN (pts - (duration - d_out / 2)) / (d_out / 2) ELSE 0e0 END,
  CASE WHEN kind_in = 'dipToBlack' AND d_in > 0 AND pts < d_in / 2 THEN 1 - pts / (d_in / 2) ELSE 0e0 END) AS a FROM pl)
SELECT event_id, {R('least(1e0, a)')} AS alpha FROM a WHERE a > 0""")
def dip_fade(spark, d):
    p, _ = placed(spark, d)
    a = transitions.dip(*(F.col(c) for c in ("pts", "duration", "kind_out", "d_out", "kind_in", "d_in")))
    return p.withColumn("a", a).filter("a > 0").select("event_id", r6(F.least(F.lit(1.0), F.col("a"))).alias("alpha"))


@query(f"""{TL}, t AS (SELECT max(offs + duration) AS total FROM tl), a AS (SELECT event_id, greatest(0e0, CASE WHEN out_pts < 24 THEN 1 - out_pts / 24 ELSE 0e0 END, CASE WHEN out_pts > total - 36 THEN (out_pts - (total - 36)) / 36 ELSE 0e0 END) AS a FROM pl, t)
SELECT event_id, {R('least(1e0, a)')} AS alpha FROM a WHERE a > 0""")
def fade_opacity(spark, d):
    f = frames(spark, d)
    s = slots(f)
    p = timeline.on_timeline(f, timeline.as_table(spark, s))
    a = transitions.fade(F.col("out_pts"), timeline.total_seconds(s), 24.0, 36.0)
    return p.select("event_id", a.alias("a")).filter("a > 0").select("event_id", r6(F.col("a")).alias("alpha"))


# ---- visibility and compositing

HOURS6 = 21_600.0


def _click_cues(spark, d) -> tuple[DataFrame, DataFrame]:
    e = events(spark, d).withColumn("sec", F.col("us") / 1e6)
    clicks = e.filter("event_type = 'click'").select("user_id", "event_id", "sec")
    cues = e.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("cue_id"), F.col("sec").alias("start"), (F.col("sec") + HOURS6).alias("end"))
    return clicks, cues


CUES = "ck AS (SELECT user_id, event_id, us / 1e6 AS sec FROM ev WHERE event_type = 'click'), cu AS (SELECT user_id, event_id AS cue_id, us / 1e6 AS s, us / 1e6 + 21600 AS e FROM ev WHERE event_type = 'signup'), jn AS (SELECT ck.*, cu.cue_id FROM ck LEFT JOIN cu ON ck.user_id = cu.user_id AND sec >= s AND sec < e)"


@query(f"{FR}, {CUES} SELECT event_id, cue_id FROM jn WHERE cue_id IS NOT NULL")
def overlay_visible(spark, d):
    clicks, cues = _click_cues(spark, d)
    return composite.interval_join(clicks, cues, ["user_id"], "sec", "start", "end", HOURS6).select("event_id", "cue_id")


def _active(spark, d) -> DataFrame:
    clicks, cues = _click_cues(spark, d)
    hit = composite.interval_join(clicks, cues, ["user_id"], "sec", "start", "end", HOURS6).groupBy("event_id").agg(F.count("*").alias("cues"))
    return clicks.join(hit, "event_id", "left").withColumn("cues", F.coalesce("cues", F.lit(0)))


@query(f"{FR}, {CUES} SELECT event_id, CAST(any_value(sec) * 1000 AS BIGINT) AS ms, count(cue_id) AS cues FROM jn GROUP BY event_id HAVING count(cue_id) > 0".replace("CAST(any_value(sec) * 1000 AS BIGINT)", "CAST(trunc(any_value(sec) * 1000) AS BIGINT)"))
def cue_active(spark, d):
    return _active(spark, d).filter("cues > 0").select("event_id", (F.col("sec") * 1000).cast("bigint").alias("ms"), "cues")


@query(f"{FR}, {CUES}, n AS (SELECT user_id, event_id, any_value(sec) AS sec, count(cue_id) AS cues FROM jn GROUP BY user_id, event_id) SELECT event_id, cues, coalesce(cues <> lag(cues) OVER (PARTITION BY user_id ORDER BY sec, event_id), true) AS changed FROM n")
def cue_change(spark, d):
    return composite.changes(_active(spark, d), ["user_id"], ["sec", "event_id"], "cues").select("event_id", "cues", "changed")


@query(f"""WITH p AS (SELECT p_partkey, p_size * 7e0 AS x, p_size * 11e0 AS y, p_size * 16e0 AS w, (51 - p_size) * 9e0 AS h, p_retailprice - 900 AS t FROM part),
q AS (SELECT *, 0.8e0 * {c01('t / 50')} AS op, x + 40 * t / 100 * (720 / 1080e0) AS ox, y - 20 * (1280 / 1920e0) AS oy, greatest(0e0, 1 - t / 80) AS s FROM p)
SELECT p_partkey, {R('ox + w * (1 - s) / 2')} AS x, {R('oy + h * (1 - s) / 2')} AS y, {R('w * s')} AS w, {R('h * s')} AS h, {R('op')} AS opacity,
  CAST(w AS BIGINT) + CASE WHEN p_partkey % 2 = 0 THEN 8 ELSE 0 END + CASE WHEN p_partkey % 3 = 0 THEN 24 ELSE 0 END AS box_w FROM q""")
def overlay_state(spark, d):
    size, t = F.col("p_size"), F.col("p_retailprice") - 900
    w, h = size * 16.0, (51 - size) * 9.0
    got = composite.overlay_state(size * 7.0, size * 11.0, w, h, F.lit(0.8), F.lit(720.0), F.lit(1280.0), opacity_at=t / 50, dx=40 * t / 100, dy=F.lit(-20.0), scale=1 - t / 80)
    box, _ = geometry.text_box((size * 16).cast("bigint"), F.lit(0), F.col("p_partkey") % 2 == 0, F.col("p_partkey") % 3 == 0)
    return table(spark, d, "part").select("p_partkey", *[r6(c).alias(n) for n, c in got.items()], box.alias("box_w"))


@query(f"""WITH p AS (SELECT p_partkey, p_size * 16e0 / ((51 - p_size) * 9e0) AS ia, (p_partkey % 50 + 10) / 40e0 AS da, p_retailprice / 900 - 0.05e0 AS z, p_partkey % 11 / 10e0 AS cx, p_partkey % 7 / 6e0 AS cy FROM part),
q AS (SELECT *, CASE WHEN ia > da THEN da / ia ELSE 1e0 END / greatest(1e0, z) AS w, CASE WHEN ia > da THEN 1e0 ELSE ia / da END / greatest(1e0, z) AS h FROM p)
SELECT p_partkey, {R('least(1 - w / 2, greatest(w / 2, cx)) - w / 2')} AS x, {R('least(1 - h / 2, greatest(h / 2, cy)) - h / 2')} AS y, {R('w')} AS w, {R('h')} AS h FROM q""")
def ken_burns(spark, d):
    size, key = F.col("p_size"), F.col("p_partkey")
    got = geometry.ken_burns(size * 16.0, (51 - size) * 9.0, key % 50 + 10.0, F.lit(40.0), F.col("p_retailprice") / 900 - 0.05, key % 11 / 10, key % 7 / 6)
    return table(spark, d, "part").select("p_partkey", *[r6(c).alias(n) for n, c in zip("xywh", got)])


@query(f"""WITH p AS (SELECT p_partkey, p_size * 16e0 AS w, p_size * 9e0 AS h, p_partkey % 10 AS pos, p_partkey % 90 - 45e0 AS dx, p_partkey % 70 - 35e0 AS dy FROM part),
q AS (SELECT *, CASE WHEN pos IN (1, 4, 7) THEN 32 * (720 / 1080e0) WHEN pos IN (3, 6, 9) THEN 720 - w - 32 * (720 / 1080e0) ELSE (720 - w) / 2 END AS bx,
  CASE WHEN pos IN (7, 8, 9) THEN 58 * (1280 / 1920e0) WHEN pos IN (4, 5, 6) THEN (1280 - h) / 2 ELSE 1280 - h - 58 * (1280 / 1920e0) END AS byy FROM p)
SELECT p_partkey, round(greatest(0e0, least(720 - w, bx + dx * (720 / 1080e0))), 0) AS x, round(greatest(0e0, least(1280 - h, byy + dy * (1280 / 1920e0))), 0) AS y, {R('720 * 0.12e0 * h / w')} AS logo_h FROM q""")
def anchor_rect(spark, d):
    size, key = F.col("p_size"), F.col("p_partkey")
    x, y = geometry.anchor(size * 16.0, size * 9.0, 720, 1280, key % 10, key % 90 - 45.0, key % 70 - 35.0)
    _, logo_h = resolve.logo_size(F.lit(720.0), F.lit(0.12), size * 16.0, size * 9.0)
    return table(spark, d, "part").select("p_partkey", x.alias("x"), y.alias("y"), r6(logo_h).alias("logo_h"))


@query(f"""WITH p AS (SELECT p_partkey, p_size * 16e0 AS sw, (51 - p_size) * 9e0 AS sh, p_partkey % 1080 AS px, p_partkey * 7 % 1920 AS py FROM part),
q AS (SELECT *, sw / sh > 1080 / 1920e0 AS wide FROM p),
b AS (SELECT *, CASE WHEN wide THEN 1080e0 ELSE 1920 * (sw / sh) END AS w, CASE WHEN wide THEN 1080 / (sw / sh) ELSE 1920e0 END AS h FROM q),
o AS (SELECT *, CASE WHEN wide THEN 0e0 ELSE (1080 - w) / 2 END AS x, CASE WHEN wide THEN (1920 - h) / 2 ELSE 0e0 END AS y FROM b)
SELECT p_partkey, {R('x')} AS x, {R('y')} AS y, {R('w')} AS w, {R('h')} AS h, px >= x AND py >= y AND px < x + w AND py < y + h AS inside FROM o""")
def letterbox_fit(spark, d):
    size, key = F.col("p_size"), F.col("p_partkey")
    box = geometry.letterbox(size * 16.0, (51 - size) * 9.0, 1080, 1920)
    return table(spark, d, "part").select("p_partkey", *[r6(c).alias(n) for n, c in zip("xywh", box)], geometry.inside(key % 1080, key * 7 % 1920, box).alias("inside"))


@query(f"WITH p AS (SELECT l_orderkey, l_orderkey % 1080 / 1080e0 AS u, l_partkey % 1920 / 1920e0 AS v, (1 - l_discount) / (1 + l_tax) AS k FROM lineitem) SELECT l_orderkey, {R('(1 - u - 0.5e0) * k + 0.5e0')} AS u, {R('(v - 0.5e0) * k + 0.5e0')} AS v FROM p")
def bypass_uv(spark, d):
    u, v = geometry.bypass_uv(F.col("l_orderkey") % 1080 / 1080, F.col("l_partkey") % 1920 / 1920, True, 1 + F.col("l_tax"), F.col("l_discount"))
    return table(spark, d, "lineitem").select("l_orderkey", r6(u).alias("u"), r6(v).alias("v"))


def _layers() -> list[tuple]:
    """Four layers given out of order, each a colour over part of the frame; the clip drops the right of layer 2."""
    def layer(z, r, g, b, alpha, opacity, seen=None):
        a = alpha if seen is None else F.when(seen, alpha).otherwise(0.0)
        return z, [c * a for c in (r, g, b)], a, opacity

    x, y = F.col("x"), F.col("y")
    boxed = composite.covers(x, y, F.lit(100.0), F.lit(200.0), F.lit(600.0), F.lit(900.0), 0.7)
    g, b = F.col("g0"), F.col("b0")
    return [layer(3, 0.2, 0.4, 0.9, b, 0.5), layer(1, 0.9, 0.1, 0.3, g, 0.8), layer(4, 1.0, 1.0, 1.0, g * b, 0.25), layer(2, 0.3, 0.8, 0.2, F.lit(1.0), 0.6, boxed)]


def _sql_over(c: str, layers) -> str:
    out = c
    for color_, alpha, opacity in layers:
        out = f"({color_}e0 * ({alpha}) * {opacity}e0 + (1 - ({alpha}) * {opacity}e0) * {out})"
    return out


_BOX = "CASE WHEN x >= 100 AND y >= 200 AND x < 700 AND y < 1100 AND (x - 100 + 0.5e0) / 600 <= 0.7e0 THEN 1e0 ELSE 0e0 END"


@query(f"{PX} SELECT l_orderkey, " + ", ".join(R(_sql_over(n, [(a, "g", 0.8), (b, _BOX, 0.6), (c, "b", 0.5), (1, "g * b", 0.25)])) + f" AS {n}" for n, a, b, c in (("r", 0.9, 0.3, 0.2), ("g", 0.1, 0.8, 0.4), ("b", 0.3, 0.2, 0.9))) + " FROM px")
def composite_over(spark, d):
    p = pixels(spark, d).withColumns({"g0": F.col("g"), "b0": F.col("b")})
    return composite.layered(p, _layers()).select("l_orderkey", *rgb6(RGB()))


def _sql_glyph(prev: str, mask: str, colour: str, name: str) -> str:
    """One more CTE: the glyph over r, g, b, a of ``prev``."""
    inv = f"({colour} & 255)"
    a16 = f"({mask} * (255 - {inv}))"
    skip = f"{mask} = 0 OR {inv} >= 255"
    part = lambda c, n: f"CASE WHEN {skip} THEN {c} ELSE least(255, (({colour} >> {n}) & 255) * {a16} // 65025 + {c} * (255 - {a16} // 255) // 255) END AS {c}"
    alpha = f"CASE WHEN {skip} THEN a ELSE least(255, {a16} // 255 + a * (255 - {a16} // 255) // 255) END AS a"
    return f"{name} AS (SELECT l_orderkey, x, y, {part('r', 24)}, {part('g', 16)}, {part('b', 8)}, {alpha} FROM {prev})"


@query(f"""WITH g0 AS (SELECT l_orderkey, l_orderkey % 256 AS x, l_partkey % 256 AS y, l_orderkey * 3 % 256 AS r, l_partkey * 5 % 256 AS g, l_suppkey * 7 % 256 AS b, 255::BIGINT AS a FROM lineitem),
{_sql_glyph('g0', 'x', '4286611488', 'g1')}, {_sql_glyph('g1', 'y', '16777471', 'g2')}, {_sql_glyph('g2', '((x + y) // 2)', '305419776', 'g3')} SELECT l_orderkey, r, g, b, a FROM g3""")
def glyph_blend(spark, d):
    p = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_orderkey") % 256).alias("x"), (F.col("l_partkey") % 256).alias("y"), *[
        (F.col(c) * k % 256).alias(n) for c, k, n in (("l_orderkey", 3, "r"), ("l_partkey", 5, "g"), ("l_suppkey", 7, "b"))])
    x, y = F.col("x"), F.col("y")
    colour = lambda c: F.lit(c).cast("bigint")
    images = [(2, y, colour(16777471)), (1, x, colour(4286611488)), (3, F.floor((x + y) / 2), colour(305419776))]
    return composite.drawn(p.withColumn("a", F.lit(255).cast("bigint")), images).select("l_orderkey", "r", "g", "b", "a")


@query(f"{PX} SELECT DISTINCT x, y, CAST(CASE WHEN (x // 8 + y // 8) % 2 = 0 THEN 90 ELSE 160 END AS INT) AS grey FROM px")
def backdrop_checker(spark, d):
    return pixels(spark, d).select("x", "y", composite.checker(F.col("x"), F.col("y")).alias("grey")).distinct()


# ---- sampling


def _planes(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: (v.cast("double") + 1) / 2).alias("plane"))


def sql_bilinear(u: str, v: str, plane: str = "embedding", n: int = 8, value: str = "({}::DOUBLE + 1) / 2") -> str:
    last = n - 1
    at = lambda i, j: "(" + value.format(f"{plane}[CAST(greatest(0, least({last}, {j})) * {n} + greatest(0, least({last}, {i})) + 1 AS INT)]") + ")"
    x, y = f"(({u}) * {n} - 0.5e0)", f"(({v}) * {n} - 0.5e0)"
    x0, y0 = f"floor({x})", f"floor({y})"
    row = lambda j: f"({at(x0, j)} * (1 - ({x} - {x0})) + {at(f'({x0} + 1)', j)} * ({x} - {x0}))"
    return f"({row(y0)} * (1 - ({y} - {y0})) + {row(f'({y0} + 1)')} * ({y} - {y0}))"


@query(f"SELECT vec_id, {R(sql_bilinear('vec_id % 7 / 7e0 + 0.05e0', 'vec_id % 5 / 5e0 + 0.1e0'))} AS value FROM embeddings")
def bilinear_sample(spark, d):
    v = geometry.bilinear(F.col("plane"), 8, 8, F.col("vec_id") % 7 / 7 + 0.05, F.col("vec_id") % 5 / 5 + 0.1)
    return _planes(spark, d).select("vec_id", r6(v).alias("value"))


@query(f"""WITH p AS (SELECT vec_id, embedding, vec_id % 8 AS x, y, CASE WHEN y / 8e0 <= 0.25e0 THEN 1 - y / 2e0 WHEN y / 8e0 >= 0.75e0 THEN (y / 8e0 - 0.75e0) / 0.25e0 ELSE 0e0 END AS alpha FROM embeddings, range(8) t(y)),
s AS (SELECT p.*, {sql_bilinear('x / 8e0', 'y / 8e0')} AS sharp FROM p),
t AS (SELECT s.vec_id, s.y, any_value(alpha) AS alpha, any_value(sharp) AS sharp, sum({sql_bilinear('x / 8e0 + dx / 8e0', 'y / 8e0 + dy / 8e0')} * exp(-(dx * dx + dy * dy) / 18e0)) / sum(exp(-(dx * dx + dy * dy) / 18e0)) AS blur
  FROM s, range(-6, 7) a(dx), range(-6, 7) b(dy) WHERE alpha > 0.001e0 GROUP BY s.vec_id, s.y)
SELECT vec_id, y, {R('sharp + (blur - sharp) * alpha', 5)} AS value FROM t""")
def edge_blur_band(spark, d):
    p = _planes(spark, d).withColumn("y", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(7).cast("bigint"))))
    p = p.withColumn("alpha", geometry.edge_alpha(F.col("y"), 8, 0.25)).filter("alpha > 0.001")
    blurred = composite_blur(F.col("plane"), F.col("vec_id") % 8 / 8, F.col("y") / 8, 3.0)
    sharp = geometry.bilinear(F.col("plane"), 8, 8, F.col("vec_id") % 8 / 8, F.col("y") / 8)
    return p.select("vec_id", "y", r6(color.mix(sharp, blurred, F.col("alpha")), 5).alias("value"))


def composite_blur(plane: Column, u: Column, v: Column, sigma: float) -> Column:
    """The 13 x 13 Gaussian of an 8 x 8 plane; taps are max(sigma / 6, 1) pixels apart."""
    step = max(sigma / 6, 1.0) / 8
    return geometry.gaussian(plane, 8, 8, u, v, step, step)


# ---- audio, chunks, probes, parity, logs


def _stem(spark, d, kind: str) -> DataFrame:
    """Samples of one event type by time; channel 0. Numbered by hour buckets."""
    e = events(spark, d).filter(F.col("event_type") == kind)
    n = numbered(e, [F.floor(F.col("us") / 3.6e9)], ["us", "event_id"], "n")
    return n.select("n", F.lit(0).alias("ch"), (F.col("value") / 250 - 1).alias("v"))


STEMS = "st AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY us, event_id) - 1 AS n, value / 250 - 1 AS v FROM ev), na AS (SELECT n, v FROM st WHERE event_type = 'click'), mu AS (SELECT n, v FROM st WHERE event_type = 'view')"


MIX = "CASE WHEN {m}.v IS NULL THEN na.v ELSE greatest(-1e0, least(1e0, na.v + {m}.v * 0.7e0)) END"


@query(f"""{FR}, {STEMS}, mx AS (
  SELECT 'none' AS music, na.n, na.v FROM na UNION ALL SELECT 'silent', na.n, na.v FROM na
  UNION ALL SELECT 'shorter', na.n, {MIX.format(m='sh')} FROM na LEFT JOIN (SELECT * FROM mu WHERE n < 100) sh USING (n)
  UNION ALL SELECT 'longer', na.n, {MIX.format(m='lo')} FROM na LEFT JOIN (SELECT * FROM mu UNION ALL SELECT n + (SELECT count(*) FROM mu), v FROM mu) lo USING (n))
SELECT music, n, 0 AS ch, {R('v')} AS v FROM mx""")
def audio_mix(spark, d):
    """Narration with no music, with silent music, with less of it and with more of it than the narration lasts."""
    na, mu = _stem(spark, d, "click"), _stem(spark, d, "view")
    more = mu.crossJoin(F.broadcast(mu.agg(F.count("*").alias("all")))).select((F.col("n") + F.col("all")).alias("n"), "ch", "v")
    mixes = {"none": (None, 0.7), "silent": (mu, 0.0), "shorter": (mu.filter("n < 100"), 0.7), "longer": (mu.unionByName(more), 0.7)}
    out = None
    for name, (music, volume) in mixes.items():
        got = audio.mixed(na, music, volume).select(F.lit(name).alias("music"), "n", "ch", r6(F.col("v")).alias("v"))
        out = got if out is None else out.unionByName(got)
    return out


@query(f"{FR}, {STEMS} SELECT n // 100 AS chunk, count(*) AS samples, min(n) AS first FROM na GROUP BY 1")
def audio_chunk_plan(spark, d):
    s = _stem(spark, d, "click")
    return s.groupBy(audio.chunk(F.col("n"), 100).alias("chunk")).agg(F.count("*").alias("samples"), F.min("n").alias("first"))


CH = f"{TL}, tt AS (SELECT max(offs + duration) AS total FROM tl), ch AS (SELECT pl.event_id, pl.out_pts, value, CAST(least(floor(out_pts / (total / 7)), 6) AS INT) AS chunk FROM pl, tt)"


def _chunked(spark, d) -> DataFrame:
    """All frames of the timeline in seven even chunks of its time."""
    f = frames(spark, d)
    s = slots(f)
    return timeline.on_timeline(f, timeline.as_table(spark, s)).withColumn("chunk", chunks.chunk_of(F.col("out_pts"), timeline.total_seconds(s), 7))


@query(f"{CH} SELECT event_id, chunk FROM ch")
def chunk_split(spark, d):
    return _chunked(spark, d).select("event_id", "chunk")


@query(f"{CH} SELECT event_id, chunk, {R('out_pts - min(out_pts) OVER (PARTITION BY chunk)')} AS local, row_number() OVER (PARTITION BY chunk ORDER BY out_pts, event_id) - 1 AS chunk_frame FROM ch")
def chunk_rebase(spark, d):
    return chunks.rebased(_chunked(spark, d), "chunk", "out_pts", "event_id", 10.0).select("event_id", "chunk", r6(F.col("local")).alias("local"), "chunk_frame")


@query(f"{CH}, c AS (SELECT chunk, count(*) AS n, max(out_pts) - min(out_pts) AS secs FROM ch GROUP BY chunk) SELECT chunk, n AS frames, {R('coalesce(sum(secs) OVER (ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)')} AS cursor FROM c")
def chunk_concat(spark, d):
    c = _chunked(spark, d).groupBy("chunk").agg(F.count("*").alias("frames"), (F.max("out_pts") - F.min("out_pts")).alias("secs"))
    return chunks.cursors(c, "chunk", "secs").select("chunk", "frames", r6(F.col("cursor")).alias("cursor"))


@query(f"{FR} SELECT seg_idx, event_id, {R('pts')} AS pts FROM (SELECT *, row_number() OVER (PARTITION BY seg_idx ORDER BY pts, event_id) AS k FROM fr WHERE pts >= 123.25e0) WHERE k = 1")
def frame_probe(spark, d):
    """The first frame at or after a time, of every segment."""
    return render.probes(frames(spark, d), "seg_idx", "pts", F.lit(123.25), "event_id").select("seg_idx", "event_id", r6(F.col("pts")).alias("pts"))


@query(f"""{FR}, px AS (SELECT event_id, value / 500 AS r, 1 - value / 500 AS g, 0.5e0 AS b FROM fr), {SQL_LOOK},
k AS (SELECT * FROM g3 WHERE event_id % 10 <> 3), e AS (SELECT avg(((gr - r) * (gr - r) + (gg - g) * (gg - g) + (gb - b) * (gb - b)) / 3) AS m, count(*) AS n FROM k)
SELECT n AS pixels, (SELECT count(*) FROM px) - n AS missing, {R('m')} AS mse, {R('10 * log10(1 / m)', 4)} AS psnr, CAST('Infinity' AS DOUBLE) AS same FROM e""")
def psnr(spark, d):
    """Two renders joined pixel by pixel, one of which lacks some; and one with itself, which must be equal before others are judged."""
    px = frames(spark, d).select("event_id", _U().alias("r"), (1 - _U()).alias("g"), F.lit(0.5).alias("b"))
    graded = px.filter("event_id % 10 <> 3").select("event_id", *[c.alias(n) for c, n in zip(color.graded(RGB(), 0.05, 1.1, 0.9, 0.3), "rgb")])
    same = compare.parity(px, px, ["event_id"]).select(F.col("psnr").alias("same"))
    got = compare.parity(graded, px, ["event_id"]).crossJoin(F.broadcast(same))  # one row each
    return got.select("pixels", "missing", r6(F.col("mse")).alias("mse"), r6(F.col("psnr"), 4).alias("psnr"), "same")


@query("WITH p AS (SELECT l_orderkey, l_orderkey % 1080 AS x, l_partkey % 1920 AS y, CAST(round(l_quantity) AS BIGINT) * 100 + CAST(round(l_discount * 100) AS BIGINT) AS v FROM lineitem) SELECT l_orderkey, md5(string_agg(v::VARCHAR, ',' ORDER BY y, x, v::VARCHAR)) AS digest FROM p GROUP BY l_orderkey")
def frame_digest(spark, d):
    v = F.round("l_quantity").cast("bigint") * 100 + F.round(F.col("l_discount") * 100).cast("bigint")
    p = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_orderkey") % 1080).alias("x"), (F.col("l_partkey") % 1920).alias("y"), v.cast("string").alias("v"))
    return compare.frame_digest(p, "l_orderkey", ["y", "x"], F.col("v"))


@query(f"{TL} SELECT (SELECT count(*) FROM em) AS frames, {R('max(offs + duration)', 3)} AS source_seconds, {R('max(offs + duration) / 20.5e0', 3)} AS ratio, 0e0 AS idle FROM tl")
def render_stats(spark, d):
    f = frames(spark, d)
    s = slots(f)
    total = F.lit(timeline.total_seconds(s))
    shown = timeline.emitted(timeline.on_timeline(f, timeline.as_table(spark, s)))
    return shown.agg(F.count("*").alias("frames")).select(
        "frames", r6(total, 3).alias("source_seconds"), r6(compare.realtime_ratio(total, F.lit(20.5)), 3).alias("ratio"), compare.realtime_ratio(total, F.lit(0.0)).alias("idle"))


def _lines(spark, d) -> DataFrame:
    """A log per user: frame lines, one meta line for some users, noise and a final line."""
    key = F.col("event_id")
    tenth = lambda c: F.concat(F.floor(c / 10).cast("string"), F.lit("."), (c % 10).cast("string"))
    line = (
        F.when(key % 10 == 0, F.concat(F.lit("[meta] sourceSecs="), tenth(F.col("user_id") * 10 + 5000)))
        .when(key % 10 == 1, F.concat(F.lit("[done] frames="), key.cast("string"), F.lit("  src=9.5s  wall=2.5s  speed=3.8x")))
        .when(key % 10 == 2, F.lit("[engine] opened"))
        .otherwise(media.progress_line(key, tenth(key * 7 % 9000), tenth(key * 3 % 5000), F.lit("2.3")))
    )
    return table(spark, d, "events").select("event_id", "user_id", line.alias("line"))


LOG = """WITH l AS (SELECT event_id, user_id, event_id % 10 AS m, event_id * 7 % 9000 AS s, event_id * 3 % 5000 AS w FROM events),
p AS (SELECT event_id, user_id, CASE m WHEN 0 THEN 'meta' WHEN 1 THEN 'done' WHEN 2 THEN NULL ELSE 'frame' END AS kind, CASE WHEN m = 1 OR m > 2 THEN event_id END AS frames,
  CASE WHEN m = 0 THEN (user_id * 10 + 5000) / 10e0 WHEN m = 1 THEN 9.5e0 WHEN m > 2 THEN s / 10e0 END AS src, CASE WHEN m = 1 THEN 2.5e0 WHEN m > 2 THEN w / 10e0 END AS wall, CASE WHEN m = 1 THEN 3.8e0 WHEN m > 2 THEN 2.3e0 END AS speed FROM l)"""


@query(f"{LOG} SELECT event_id, kind, frames, src, wall, speed, (event_id + 1) % 60 = 0 AS has_line FROM p")
def log_parse(spark, d):
    got = media.parsed_log(F.col("line"))
    return _lines(spark, d).select("event_id", *[c.alias(n) for n, c in got.items()], media.has_line(F.col("event_id")).alias("has_line"))


@query(f"""{LOG}, r AS (SELECT *, last_value(CASE WHEN kind = 'meta' THEN src END IGNORE NULLS) OVER w AS meta, max(CASE WHEN kind = 'frame' THEN src END) OVER w AS most FROM p WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, {R('least(1e0, src / CASE WHEN coalesce(meta, 0) > 0 THEN meta ELSE most END)')} AS ratio FROM r WHERE kind = 'frame' AND CASE WHEN coalesce(meta, 0) > 0 THEN meta ELSE most END > 0 UNION ALL SELECT event_id, 1e0 FROM r WHERE kind = 'done'""")
def progress_ratio(spark, d):
    got = media.parsed_log(F.col("line"))
    p = _lines(spark, d).select("event_id", "user_id", got["kind"].alias("kind"), got["src"].alias("src"))
    return media.progress(p, "user_id", "event_id").select("event_id", r6(F.col("ratio")).alias("ratio"))


# ---- whole pipelines

MAIN = render.Look(brightness=0.05, contrast=1.1, saturation=0.9, tint=0.3, noise=20.0, grain=40.0, lut_mix=0.75, mirror=True, zoom=1.2, crop=0.1, sigma=9.0, band=0.4)
SHAPE = render.Shape(8, 8, 6, 12)


def sql_texture(seed: str, rgb=("g{}",), src: str = "g3", x: str = "x", y: str = "y") -> str:
    """CTEs n1 (noise of 20) and n2 (grain of 40) over ``src``; n2 has kr, kg, kb."""
    n, g = sql_hash(x, y, seed), sql_hash(y, "0", seed)
    return (f"n1 AS (SELECT *, {', '.join(f'{c01(f'{rgb[0].format(c)} + ({n} - 0.5e0) * 0.2e0')} AS n{c}' for c in 'rgb')} FROM {src}), "
            f"n2 AS (SELECT *, {', '.join(f'{c01(f'n{c} * (1 + ({g} - 0.5e0) * 0.2e0)')} AS k{c}' for c in 'rgb')} FROM n1)")


_STRIDE = "1.5e0 / 6"  # sigma 9 over 6 taps, over a fitted width and height of 6
_UV = {c: f"(({f}) - 0.5e0) * (0.9e0 / 1.2e0) + 0.5e0" for c, f in (("u", f"1 - (x / 6e0 + dx * {_STRIDE})"), ("v", f"(y - 3) / 6e0 + dy * {_STRIDE}"))}


@query(f"""
WITH p0 AS (SELECT vec_id, list_transform(embedding, lambda e: (e::DOUBLE + 1) / 2) AS luma, list_transform(embedding[17:32], lambda e: (e::DOUBLE + 1) / 2) AS cb, list_transform(embedding[33:48], lambda e: (e::DOUBLE + 1) / 2) AS cr, x, y,
    CASE WHEN y / 12e0 <= 0.4e0 THEN 1 - y / 12e0 / 0.4e0 WHEN y / 12e0 >= 0.6e0 THEN (y / 12e0 - 0.6e0) / 0.4e0 ELSE 0e0 END AS alpha FROM embeddings, range(6) a(x), range(12) b(y)),
tp AS (SELECT dx, dy, exp(-(dx * dx + dy * dy) / 18e0) AS w FROM range(-6, 7) a(dx), range(-6, 7) b(dy)),
sm AS (SELECT p0.*, 0 AS dx, 0 AS dy, -1e0 AS w FROM p0 WHERE y >= 3 AND y < 9 UNION ALL SELECT p0.*, tp.* FROM p0, tp WHERE y >= 3 AND y < 9 AND alpha > 0.001e0),
uv AS (SELECT *, {_UV['u']} AS u, {_UV['v']} AS v FROM sm),
ys AS (SELECT vec_id, x, y, alpha, w, ({sql_bilinear('u', 'v', 'luma', 8, '{}')} - 16 / 255e0) * 255 / 219 AS yy, ({sql_bilinear('u', 'v', 'cb', 4, '{}')} - 128 / 255e0) * 255 / 224 AS pb, ({sql_bilinear('u', 'v', 'cr', 4, '{}')} - 128 / 255e0) * 255 / 224 AS pr FROM uv),
px AS (SELECT *, {c01('yy + 1.5748e0 * pr')} AS r, {c01('yy - 0.1873e0 * pb - 0.4681e0 * pr')} AS g, {c01('yy + 1.8556e0 * pb')} AS b FROM ys),
{SQL_LOOK},
lu AS (SELECT vec_id, x, y, alpha, w, {', '.join(f'g{c} + ({sql_square_lut(f"g{c}")} - g{c}) * 0.75e0 AS g{c}' for c in 'rgb')} FROM g3),
bl AS (SELECT vec_id, x, y, any_value(alpha) AS alpha, {', '.join(f'max(g{c}) FILTER (WHERE w < 0) AS s{c}, sum(g{c} * w) FILTER (WHERE w > 0) / sum(w) FILTER (WHERE w > 0) AS b{c}' for c in 'rgb')} FROM lu GROUP BY vec_id, x, y),
mx AS (SELECT vec_id, x, y, {', '.join(f'CASE WHEN b{c} IS NULL THEN s{c} ELSE s{c} + (b{c} - s{c}) * alpha END AS g{c}' for c in 'rgb')} FROM bl),
{sql_texture('(vec_id % 97 + 1)', src='mx')}
SELECT vec_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, {', '.join(f'{R(f"k{c}", 5)} AS {c}' for c in 'rgb')} FROM n2
UNION ALL SELECT vec_id, CAST(x AS INT), CAST(y AS INT), 0e0, 0e0, 0e0 FROM p0 WHERE y < 3 OR y >= 9""")
def pipeline_main(spark, d):
    """The whole main pass over planes: letterbox, mirror, zoom and crop, sampling, conversion, grade, table, edge blur, noise, grain."""
    plane = lambda lo, n: F.transform(F.slice("embedding", lo, n), lambda v: (v.cast("double") + 1) / 2)
    f = table(spark, d, "embeddings").select("vec_id", plane(1, 64).alias("luma"), plane(17, 16).alias("cb"), plane(33, 16).alias("cr"), (F.col("vec_id") % 97 + 1).alias("seed"))
    out = render.planes_rendered(f, MAIN, SHAPE, ["vec_id", "seed"], "seed", cube.as_array(_lut(spark)), N)
    return out.select("vec_id", "x", "y", *[r6(F.col(c), 5).alias(c) for c in "rgb"])


FRAME_LOOK = render.Look(contrast=1.2, saturation=0.8, noise=20.0, grain=40.0, tracks={"brightness": KEYS})
FADE_KEYS = ((0.0, 0.2, "linear"), (4000.0, 1.0, "linear"))
#: Captions first, then overlays, in order of z.
LAYERS = [
    render.Layer(1, (0.45, 0.35, 0.05), 0.5, 0.4, rect=(0.0, 0.0, 60.0, 30.0)),
    render.Layer(2, (0.1, 0.2, 0.8), 0.8, 0.9, 500.0, 3000.0, FADE_KEYS),
]
CAPTIONS = [(10.0, 700.25), (700.5, 1500.0), (2000.0, None)]
FADES = (24.0, 36.0)


def _marked(df: DataFrame) -> DataFrame:
    """``df`` under the captions, whose clock is whole milliseconds, and then the overlays."""
    x, y = F.col("x"), F.col("y")
    ms = F.floor(F.col("out_pts") * 1000) / 1000
    df = render.overlaid(df, [render.Layer(k, (0.9, 0.9, 0.9), 0.9, 1.0, a, b) for k, (a, b) in enumerate(CAPTIONS)], ms, x, y)
    return render.overlaid(df, LAYERS, F.col("out_pts"), x, y)


def _sql_marked(src: str) -> str:
    """CTE ov over ``src``, which has mr, mg, mb, t, x, y; ov has vr, vg, vb."""
    ms = "(floor(t * 1000) / 1000)"
    cap = " OR ".join(f"({ms} >= {a}e0" + (f" AND {ms} < {b}e0)" if b else ")") for a, b in CAPTIONS)
    key = "least(1e0, greatest(0e0, CASE WHEN t <= 0 THEN 0.2e0 WHEN t >= 4000 THEN 1e0 ELSE 0.2e0 + 0.8e0 * t / 4000 END))"
    o1 = "(CASE WHEN x < 60 AND y < 30 THEN 0.4e0 ELSE 0e0 END)"
    o2 = f"(CASE WHEN t >= 500 AND t < 3000 THEN 0.9e0 * {key} ELSE 0e0 END)"
    return (f"c1 AS (SELECT *, {', '.join(f'CASE WHEN {cap} THEN 0.9e0 + 0.1e0 * m{c} ELSE m{c} END AS q{c}' for c in 'rgb')} FROM {src}), "
            f"c2 AS (SELECT *, {', '.join(f'{k}e0 * {o1} + (1 - 0.5e0 * {o1}) * q{c} AS w{c}' for c, k in zip('rgb', LAYERS[0].rgb))} FROM c1), "
            f"ov AS (SELECT *, {', '.join(f'{k}e0 * {o2} + (1 - 0.8e0 * {o2}) * w{c} AS v{c}' for c, k in zip('rgb', LAYERS[1].rgb))} FROM c2)")


_SQL_DARK = """least(1e0, greatest(0e0, CASE WHEN t < 24 THEN 1 - t / 24 ELSE 0e0 END, CASE WHEN t > total - 36 THEN (t - (total - 36)) / 36 ELSE 0e0 END,
  CASE WHEN kind_out = 'dipToBlack' AND d_out > 0 AND pts > duration - d_out / 2 THEN (pts - (duration - d_out / 2)) / (d_out / 2) ELSE 0e0 END, CASE WHEN kind_in = 'dipToBlack' AND d_in > 0 AND pts < d_in / 2 THEN 1 - pts / (d_in / 2) ELSE 0e0 END))"""


def _main_of(v: Column, seed: Column) -> color.RGB:
    return render.main_pass((v, 1 - v, F.lit(0.5)), FRAME_LOOK, F.col("x"), F.col("y"), seed, True)


def _sql_main(value: str, src: str, seed: str, tag: str) -> str:
    """CTEs that end in {tag}_n2 with kr, kg, kb: the main pass over a value of ``src``, which has bright, x, y."""
    ctes = f"px_ AS (SELECT *, {value} AS r, 1 - {value} AS g, 0.5e0 AS b FROM {src}), " + sql_grade("bright", "1.2e0", "0.8e0", "0e0", src="px_") + ", " + sql_texture(seed)
    for name in ("px_", "g1", "g2", "g3", "n1", "n2"):
        ctes = ctes.replace(f"{name} AS (", f"{tag}_{name} AS (").replace(f"FROM {name})", f"FROM {tag}_{name})")
    return ctes


@query(f"""{TL}, tt AS (SELECT max(offs + duration) AS total FROM tl),
sh AS (SELECT em.*, hb.b_value, CASE WHEN em.kind_out = 'slideLeft' THEN pow(hb.progress, 3) ELSE hb.progress END AS progress, row_number() OVER (ORDER BY em.seg_idx, em.pts, event_id) AS seed FROM em LEFT JOIN hb USING (event_id)),
bt AS (SELECT event_id, kind_out, kind_in, d_out, d_in, pts, duration, out_pts AS t, total, progress, seed, value / 500 AS va, b_value / 500 AS bv, event_id % 100 AS x, event_id % 37 AS y, (event_id % 100 + 0.5e0) / 100 AS u, (event_id % 37 + 0.5e0) / 37 AS v FROM sh, tt),
br AS (SELECT *, {SQL_TRACK} AS bright FROM bt),
{_sql_main('va', 'br', 'seed', 'a')}, am AS (SELECT * EXCLUDE (kr, kg, kb, r, g, b, cr, cg, cb, sr, sg, sb, gr, gg, gb, nr, ng, nb), kr AS ar, kg AS ag, kb AS ab FROM a_n2),
{_sql_main('bv', 'am', 'seed', 'b')},
wp AS (SELECT *, 1 - v AS swept, -0.04e0 + 1.08e0 * progress AS edge FROM b_n2), wz AS (SELECT *, {c01('(swept - (edge - 0.04e0)) / 0.08e0')} AS z, u + (1 - progress) AS bu FROM wp),
mx AS (SELECT *, {', '.join(f"CASE WHEN progress IS NULL THEN a{c} WHEN kind_out = 'crossfade' THEN a{c} + (k{c} - a{c}) * progress WHEN kind_out = 'wipeUp' THEN a{c} + (k{c} - a{c}) * (1 - z * z * (3 - 2 * z)) WHEN bu >= 0 AND bu <= 1 THEN k{c} ELSE a{c} END AS m{c}" for c in 'rgb')} FROM wz),
{_sql_marked('mx')}, dk AS (SELECT *, {_SQL_DARK} AS dark FROM ov)
SELECT event_id, {', '.join(f'{R(f"(1 - dark) * v{c}", 5)} AS {c}' for c in 'rgb')} FROM dk""")
def pipeline_frame(spark, d):
    """Frames end to end: placed, deduplicated, numbered; tracks; the main pass of both sides; each transition's own blend; captions; overlays; fades."""
    f = frames(spark, d)
    s = slots(f)
    p = timeline.on_timeline(f, timeline.as_table(spark, s))
    b = timeline.blended(p, f, width=10.0).select("event_id", F.col("b.value").alias("b_value"), "progress")
    shown = timeline.frame_index(timeline.emitted(p), "event_id", 10.0).join(b, "event_id", "left")
    u, v = _uv()
    shown = shown.withColumns({"x": F.col("event_id") % 100, "y": F.col("event_id") % 37, "eased": easing.eased_by(F.col("ease_out"), F.col("progress"))})
    shown = render.with_tracks(shown, FRAME_LOOK, F.col("out_pts"))
    seed = F.col("frame_no") + 1
    sides = {f"{side}{c}": v for side, value in (("a", _U()), ("b", F.col("b_value") / 500)) for c, v in zip("rgb", _main_of(value, seed))}
    shown = shown.withColumns(sides)
    a, b = (tuple(F.col(f"{side}{c}") for c in "rgb") for side in "ab")
    mixed = render.transition_blend(a, b, F.col("kind_out"), u, v, F.when(F.col("progress").isNotNull(), F.col("eased")))
    out = render.faded(_marked(shown.withColumns(dict(zip("rgb", mixed)))), render.fade_alpha(F.col("out_pts"), timeline.total_seconds(s), *FADES))
    return out.select("event_id", *[r6(F.col(c), 5).alias(c) for c in "rgb"])


PROBE_AT = (0.0, 123.25, 700.75, 2100.0, 100_000.0)


@query(f"""{TL}, tt AS (SELECT max(offs + duration) AS total FROM tl), ask("at") AS (SELECT unnest([{', '.join(f'{t}e0' for t in PROBE_AT)}])),
sg AS (SELECT "at", coalesce(max(seg_idx) FILTER (WHERE offs <= "at"), 0) AS seg_idx FROM ask, tl GROUP BY "at"),
lo AS (SELECT sg."at", sg.seg_idx, greatest(0e0, least("at" - offs, duration - 0.001e0)) AS target FROM sg JOIN tl USING (seg_idx)),
fd AS (SELECT lo."at", pl.*, row_number() OVER (PARTITION BY "at" ORDER BY pts, event_id) AS k FROM lo JOIN pl ON pl.seg_idx = lo.seg_idx AND pl.pts >= target),
bt AS (SELECT "at", event_id, kind_out, kind_in, d_out, d_in, pts, duration, out_pts AS t, total, value / 500 AS va, event_id % 100 AS x, event_id % 37 AS y FROM fd, tt WHERE k = 1),
br AS (SELECT *, {SQL_TRACK} AS bright FROM bt),
{_sql_main('va', 'br', '1', 'a')}, mx AS (SELECT *, {', '.join(f'k{c} AS m{c}' for c in 'rgb')} FROM a_n2),
{_sql_marked('mx')}, dk AS (SELECT *, {_SQL_DARK} AS dark FROM ov)
SELECT "at", event_id, {', '.join(f'{R(f"(1 - dark) * v{c}", 5)} AS {c}' for c in 'rgb')} FROM dk""")
def pipeline_probe(spark, d):
    """Single frames as the whole pipeline shows them, without a blend and with the first frame's seed, 1."""
    f = frames(spark, d)
    s = slots(f)
    p = timeline.on_timeline(f, timeline.as_table(spark, s))
    at = spark.createDataFrame([(t,) for t in PROBE_AT], "at double")
    want = timeline.probe_targets(timeline.segment_at(at, "at", s), s)
    got = render.probes(p.join(F.broadcast(want), "seg_idx"), "at", "pts", F.col("target"), "event_id")  # five times
    got = got.withColumns({"x": F.col("event_id") % 100, "y": F.col("event_id") % 37})
    got = render.with_tracks(got, FRAME_LOOK, F.col("out_pts"))
    out = _marked(got.withColumns(dict(zip("rgb", _main_of(_U(), F.lit(1))))))
    out = render.faded(out, render.fade_alpha(F.col("out_pts"), timeline.total_seconds(s), *FADES))
    return out.select("at", "event_id", *[r6(F.col(c), 5).alias(c) for c in "rgb"])


@query(f"""{CH}, px AS (SELECT *, value / 500 AS r, 1 - value / 500 AS g, 0.5e0 AS b FROM ch), {SQL_LOOK}
SELECT chunk, event_id, {R('out_pts - min(out_pts) OVER (PARTITION BY chunk)')} AS local, {', '.join(f'{R(f'g{c}')} AS {c}' for c in 'rgb')} FROM g3""")
def pipeline_chunk(spark, d):
    """The timeline in even chunks of time, each rebased and graded; chunks keep only the grade. Frames are independent, so chunked and whole renders are equal."""
    c = chunks.rebased(_chunked(spark, d), "chunk", "out_pts", "event_id", 10.0)
    c = c.withColumns({"r": _U(), "g": 1 - _U(), "b": F.lit(0.5), "x": F.lit(0), "y": F.lit(0)})
    return render.render(c, MAIN.grade_only(), F.lit(1)).select("chunk", "event_id", r6(F.col("local")).alias("local"), *rgb6(RGB()))
