"""Queries of the frame engine, each with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillflow.functions import hashing, names, pixels, timecode
from stillflow.operators import preview, restore, selection, sheet, stills
from stillflow.operators import scenes as S
from stillflow.plans.proxies import FPS, INTERVAL, LENGTH, MIN_LEN, OPTIONS, SIDE, THRESHOLD, event_frames, event_placed, names_of_documents, picture_frames, table
from stillflow.sources import images

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Parts of oracles, each a list of common table expressions that builds on those before it.

_FRAMES = """
raw AS (SELECT user_id AS video_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS i, value AS sharpness,
  CAST(regexp_extract(props, '"k": ?([0-9]+)', 1) AS INT) AS k, ('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 15))::BIGINT AS dhash FROM events),
frames AS (SELECT video_id, i, i AS pos, i / 2.0e0 AS t, sharpness, k * 2.55e0 AS luma, k / 1.0e2 AS highlight_frac,
  coalesce(abs(sharpness - lag(sharpness) OVER (PARTITION BY video_id ORDER BY i)), 0.0e0) AS delta, dhash FROM raw)"""
_BOUNDS = f"""{_FRAMES},
cuts AS (SELECT video_id, pos FROM frames WHERE pos > 0 AND delta >= {THRESHOLD}e0),
totals AS (SELECT video_id, count(*)::INT AS total FROM frames GROUP BY video_id),
starts(video_id, start) AS (SELECT video_id, 0 FROM totals UNION ALL
  SELECT s.video_id, min(c.pos) FROM starts s JOIN cuts c ON c.video_id = s.video_id AND c.pos >= s.start + {MIN_LEN} GROUP BY s.video_id, s.start),
kept AS (SELECT s.video_id, s.start, t.total FROM starts s JOIN totals t USING (video_id) WHERE s.start = 0 OR t.total - s.start >= {MIN_LEN}),
bounds AS (SELECT video_id, (row_number() OVER w - 1)::INT AS id, start, (lead(start, 1, total) OVER w - 1)::INT AS "end" FROM kept WINDOW w AS (PARTITION BY video_id ORDER BY start))"""
_SCENES = f"""{_BOUNDS},
placed AS (SELECT f.*, b.id AS scene FROM frames f JOIN bounds b ON b.video_id = f.video_id AND f.pos BETWEEN b.start AND b."end"),
scenes AS (SELECT video_id, scene AS id, min(pos) AS start, max(pos) AS "end", min(i) AS start_i, max(i) AS end_i, min(t) AS start_t, max(t) AS end_t, count(*)::INT AS frame_count,
  (list(i ORDER BY sharpness DESC, pos))[1] AS best_frame, max(sharpness) AS best_sharpness, round(avg(sharpness) + 1e-9, 4) AS mean_sharpness FROM placed GROUP BY video_id, scene)"""
_JUDGED = f"""{_SCENES},
judged AS (SELECT p.*, p.pos BETWEEN s.start + 2 AND s."end" - 2 AS safe,
  CASE WHEN luma < 24.0e0 THEN 'dark' WHEN highlight_frac > 0.95e0 THEN 'blown' WHEN sharpness < s.best_sharpness * 0.35e0 THEN 'soft' END AS weak
  FROM placed p JOIN scenes s ON s.video_id = p.video_id AND s.id = p.scene),
ok AS (SELECT * FROM judged WHERE safe AND weak IS NULL),
quota AS (SELECT o.video_id, o.scene, greatest(1, least(round_even(max(s."end" - s.start + 1) / 2.0e0 / 4.0e0, 0)::INT, 8, count(*)::INT)) AS quota, count(*)::INT AS n_eligible
  FROM ok o JOIN scenes s ON s.video_id = o.video_id AND s.id = o.scene GROUP BY o.video_id, o.scene),
gaps AS (SELECT q.*, s.start + 2 AS lo, s."end" - 2 AS hi, greatest(1, floor(0.2e0 * (s."end" - 2 - s.start - 2 + 1) / q.quota)::INT) AS gap FROM quota q JOIN scenes s ON s.video_id = q.video_id AND s.id = q.scene)"""
_INTERVAL = f"""{_SCENES},
known AS (SELECT p.*, p.pos BETWEEN s.start + 2 AND s."end" - 2 AS safe, floor(p.t / 2.0e0 + 1e-9)::INT AS bucket FROM placed p JOIN scenes s ON s.video_id = p.video_id AND s.id = p.scene),
ranked AS (SELECT *, row_number() OVER (PARTITION BY video_id, bucket ORDER BY safe DESC, sharpness DESC, pos) AS rn FROM known),
picks AS (SELECT video_id, bucket, i AS frame, t, scene, sharpness, dhash, NOT safe AS unsafe, [i - 2, i + 2] AS "window" FROM ranked WHERE rn = 1)"""
_PIXELS = f"""
levels AS (SELECT (vec_id // {LENGTH})::VARCHAR AS video_id, (vec_id % {LENGTH})::INT AS i, [least(greatest(floor(127.5e0 + 480.0e0 * v::DOUBLE)::INT, 0), 255) for v in embedding] AS px FROM embeddings),
pix AS (SELECT video_id, i, c::INT AS cell, (c % 8)::INT AS x, (c // 8)::INT AS y, px[c + 1] AS b, px[(c + 21) % 64 + 1] AS g, px[(c + 42) % 64 + 1] AS r FROM levels, range(64) cells(c))"""


def _colours(pixels: str = "pix") -> str:
    """gray, hue, sat, val of the pixels of a table with r, g, b."""
    return f"""
spans AS (SELECT *, floor(0.299e0 * r + 0.587e0 * g + 0.114e0 * b + 0.5e0)::INT AS gray, greatest(r, g, b) AS val, (greatest(r, g, b) - least(r, g, b))::DOUBLE AS span FROM {pixels}),
turns AS (SELECT *, CASE WHEN span = 0 THEN 0.0e0 WHEN val = r THEN 60 * (g - b) / span WHEN val = g THEN 120 + 60 * (b - r) / span ELSE 240 + 60 * (r - g) / span END AS turn FROM spans),
colours AS (SELECT video_id, i, cell, x, y, gray, val, CASE WHEN val = 0 THEN 0 ELSE round_even(255 * span / val, 0)::INT END AS sat, round_even((CASE WHEN turn < 0 THEN turn + 360 ELSE turn END) / 2, 0)::INT % 180 AS hue FROM turns)"""


def _measures(x0: int = 0, y0: int = 0, w: int = 8, h: int = 8) -> str:
    """m: video_id, i, t, sharpness, luma, highlight_frac, delta of the pictures' part of w x h pixels from x0, y0."""
    n = w * h
    return f"""{_PIXELS},{_colours()},
part AS (SELECT video_id, i, cell, x - {x0} AS x, y - {y0} AS y, gray, hue, sat, val FROM colours WHERE x >= {x0} AND x < {x0 + w} AND y >= {y0} AND y < {y0 + h}),
edge AS (SELECT c.video_id, c.i, l.gray + r.gray + u.gray + d.gray - 4 * c.gray AS e FROM part c
  JOIN part l ON l.video_id = c.video_id AND l.i = c.i AND l.y = c.y AND l.x = abs(c.x - 1) JOIN part r ON r.video_id = c.video_id AND r.i = c.i AND r.y = c.y AND r.x = {w - 1} - abs({w - 1} - (c.x + 1))
  JOIN part u ON u.video_id = c.video_id AND u.i = c.i AND u.x = c.x AND u.y = abs(c.y - 1) JOIN part d ON d.video_id = c.video_id AND d.i = c.i AND d.x = c.x AND d.y = {h - 1} - abs({h - 1} - (c.y + 1))),
sharp AS (SELECT video_id, i, round_even(({n} * sum(e * e) - sum(e) * sum(e))::DOUBLE / {n * n}, 4) AS sharpness FROM edge GROUP BY video_id, i),
before AS (SELECT *, lag(hue) OVER w AS h0, lag(sat) OVER w AS s0, lag(val) OVER w AS v0 FROM part WINDOW w AS (PARTITION BY video_id, cell ORDER BY i)),
m AS (SELECT b.video_id, b.i, round(b.i / 25.0e0, 4) AS t, any_value(s.sharpness) AS sharpness, round_even(sum(gray) / {n}.0e0, 2) AS luma, round_even(count(*) FILTER (gray >= 230) / {n}.0e0, 4) AS highlight_frac,
  CASE WHEN bool_or(h0 IS NULL) THEN 0.0e0 ELSE round_even((sum(least(abs(hue - h0), 180 - abs(hue - h0))) / {n}.0e0 + sum(abs(sat - s0)) / {n}.0e0 + sum(abs(val - v0)) / {n}.0e0) / 3, 4) END AS delta
  FROM before b JOIN sharp s ON s.video_id = b.video_id AND s.i = b.i GROUP BY b.video_id, b.i)"""


# Nine cells of eight ninths of a pixel in each row; a bit for each but the first: is it brighter than the one to its left?
_HASH = """
nine AS (SELECT c.video_id, c.i, c.y, j::INT AS j, sum(greatest(0, least((j + 1) * 8, (c.x + 1) * 9) - greatest(j * 8, c.x * 9)) * c.gray) AS s FROM colours c, range(9) cells(j) GROUP BY c.video_id, c.i, c.y, j),
bits AS (SELECT *, s > lag(s) OVER (PARTITION BY video_id, i, y ORDER BY j) AS up FROM nine),
bytes AS (SELECT video_id, i, y, sum(CASE WHEN up THEN 1 << (8 - j) ELSE 0 END)::INT AS byte FROM bits WHERE j > 0 GROUP BY video_id, i, y),
hashes AS (SELECT video_id, i, string_agg(printf('%02x', byte), '' ORDER BY y) AS dhash FROM bytes GROUP BY video_id, i)"""
_SEGMENTS = """
wanted AS (SELECT DISTINCT o_custkey AS video_id, (o_orderkey % 50)::DOUBLE AS from_t, (o_orderkey % 50 + 1 + o_orderkey % 7)::DOUBLE + 0.25e0 AS to_t FROM orders),
ranges AS (SELECT video_id, round_even(from_t * 2.0e0, 0)::INT AS start, round_even(to_t * 2.0e0, 0)::INT + 1 AS stop FROM wanted),
marked AS (SELECT *, CASE WHEN start > max(stop) OVER (PARTITION BY video_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh,
  row_number() OVER (PARTITION BY video_id ORDER BY start, stop) AS rn FROM ranges),
islands AS (SELECT *, (sum(CASE WHEN rn = 1 THEN 1 ELSE fresh END) OVER (PARTITION BY video_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) - 1)::INT AS seg FROM marked),
segments AS (SELECT video_id, seg, min(start) AS start, max(stop) AS stop FROM islands GROUP BY video_id, seg)"""
_STEMS = """
stems AS (SELECT doc_id, concat_ws('-', source, lang, repeat(lang, 16)) AS stem, CASE WHEN doc_id % 11 <> 0 THEN (doc_id % 7)::INT END AS scene, (doc_id * 37)::INT AS frame, CASE WHEN doc_id % 3 = 0 THEN (doc_id % 5)::INT END AS seed FROM documents),
named AS (SELECT *, left(stem, 32) || '_s' || coalesce(printf('%03d', scene), 'xxx') || '_f' || printf('%06d', frame) || coalesce('_seed' || seed, '') || '.png' AS file FROM stems)"""
_STILLS = f"""{_STEMS},
parsed AS (SELECT doc_id, file, nullif(regexp_extract(file, '(?i)_s(\\d+)_f(\\d+)(?:_seed(\\d+))?', 1), '')::INT AS scene, nullif(regexp_extract(file, '(?i)_s(\\d+)_f(\\d+)(?:_seed(\\d+))?', 2), '')::INT AS frame,
  nullif(regexp_extract(file, '(?i)_s(\\d+)_f(\\d+)(?:_seed(\\d+))?', 3), '')::INT AS seed FROM named),
pick AS (SELECT (doc_id * 37)::INT AS frame, doc_id / 4.0e0 AS t, doc_id % 97 * 1.5e0 AS source_sharpness, [(doc_id * 37)::INT - 2, (doc_id * 37)::INT + 2] AS "window" FROM documents WHERE doc_id % 5 <> 0),
found AS (SELECT p.doc_id, p.file, p.scene, p.frame, p.seed, k.t, k.source_sharpness, k."window" FROM parsed p LEFT JOIN pick k ON k.frame = p.frame),
was AS (SELECT n.file, CASE WHEN l.quality IS NOT NULL THEN l.quality = 1 END AS restored FROM named n JOIN labels l ON l.doc_id = n.doc_id),
stills AS (SELECT f.*, coalesce(w.restored, true) AS restored, 640 + (f.doc_id % 3 * 64)::INT AS width, 360 + (f.doc_id % 5 * 30)::INT AS height, (f.doc_id % 40)::INT AS sheet FROM found f LEFT JOIN was w ON w.file = f.file)"""


def _with(parts: str, select: str, recursive: bool = True) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts.strip()} {select}"


# Scenes.


@query(_with(_INTERVAL, "SELECT * FROM picks"))
def sharpest_per_interval(spark, sf_dir):
    """The sharpest frame of every interval of every scene's video."""
    return selection.select_interval(event_placed(event_frames(spark, sf_dir)), INTERVAL)


@query(_with(_INTERVAL, "SELECT video_id, count(*)::INT AS intervals, count(*) FILTER (unsafe)::INT AS window_unsafe FROM picks GROUP BY video_id"))
def select_interval(spark, sf_dir):
    picks = sharpest_per_interval(spark, sf_dir)
    return picks.groupBy("video_id").agg(F.count("*").cast("int").alias("intervals"), F.count_if("unsafe").cast("int").alias("window_unsafe"))


@query(_with(_FRAMES, "SELECT video_id, i, t FROM frames"))
def frame_time(spark, sf_dir):
    return event_frames(spark, sf_dir).select("video_id", "i", "t")


@query(_with(_FRAMES, "SELECT video_id, i, pos, delta FROM frames"))
def frame_pos(spark, sf_dir):
    return S.with_position(event_frames(spark, sf_dir)).select("video_id", "i", "pos", "delta")


@query(_with(_FRAMES, f"SELECT video_id, pos, delta FROM frames WHERE pos > 0 AND delta >= {THRESHOLD}e0"))
def cuts(spark, sf_dir):
    return S.cuts(event_frames(spark, sf_dir), THRESHOLD).select("video_id", "pos", "delta")


@query(_with(_BOUNDS, "SELECT * FROM bounds"))
def scene_bounds(spark, sf_dir):
    return S.scene_bounds(event_frames(spark, sf_dir), THRESHOLD, MIN_LEN)


@query(_with(_SCENES, "SELECT video_id, i, scene FROM placed"))
def scene_assign(spark, sf_dir):
    return event_placed(event_frames(spark, sf_dir)).select("video_id", "i", "scene")


@query(_with(_SCENES, "SELECT * FROM scenes"))
def scene_stats(spark, sf_dir):
    return S.scene_stats(event_placed(event_frames(spark, sf_dir)))


@query(_with(_SCENES, "SELECT video_id, id, start_i, end_i, frame_count, best_frame FROM scenes WHERE id < 20"))
def scene_table(spark, sf_dir):
    return scene_stats(spark, sf_dir).filter("id < 20").select("video_id", "id", "start_i", "end_i", "frame_count", "best_frame")


@query(_with(_SCENES, "SELECT f.video_id, count(*)::INT AS frame_count, round(count(*) / 2.0e0, 3) AS duration_s, (SELECT count(*)::INT FROM scenes s WHERE s.video_id = f.video_id) AS scenes FROM frames f GROUP BY f.video_id"))
def video_summary(spark, sf_dir):
    frames = event_placed(event_frames(spark, sf_dir))
    return frames.groupBy("video_id").agg(F.count("*").cast("int").alias("frame_count"), F.round(F.count("*") / FPS, 3).alias("duration_s"), F.countDistinct("scene").cast("int").alias("scenes"))


@query(_with(_SEGMENTS, "SELECT * FROM segments", False))
def segments_merge(spark, sf_dir):
    return S.merge_segments(_wanted(spark, sf_dir), FPS)


def _wanted(spark, sf_dir):
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("video_id"), (key % 50).cast("double").alias("from_t"), ((key % 50 + 1 + key % 7).cast("double") + 0.25).alias("to_t"))
    return rows.distinct()


@query(
    _with(
        f"{_FRAMES}, {_SEGMENTS.strip()}, inside AS (SELECT f.video_id, s.seg, f.i, f.sharpness, CASE WHEN row_number() OVER (PARTITION BY f.video_id, s.seg ORDER BY f.i) = 1 THEN 0.0e0 ELSE f.delta END AS delta, (row_number() OVER (PARTITION BY f.video_id ORDER BY f.i) - 1)::INT AS pos FROM frames f JOIN segments s ON s.video_id = f.video_id AND f.i >= s.start AND f.i < s.stop)",
        "SELECT * FROM inside",
    )
)
def segment_scan(spark, sf_dir):
    return S.in_segments(event_frames(spark, sf_dir), segments_merge(spark, sf_dir)).select("video_id", "seg", "i", "sharpness", "delta", "pos")


_SEGMENT_SCENES = f"""{_FRAMES}, {_SEGMENTS.strip()},
inside AS (SELECT f.video_id, s.seg, f.i, CASE WHEN row_number() OVER w = 1 THEN 0.0e0 ELSE f.delta END AS delta, (row_number() OVER w - 1)::INT AS pos, (row_number() OVER (PARTITION BY f.video_id ORDER BY f.i) - row_number() OVER w)::INT AS ahead
  FROM frames f JOIN segments s ON s.video_id = f.video_id AND f.i >= s.start AND f.i < s.stop WINDOW w AS (PARTITION BY f.video_id, s.seg ORDER BY f.i)),
cuts AS (SELECT video_id, seg, pos FROM inside WHERE pos > 0 AND delta >= {THRESHOLD}e0),
totals AS (SELECT video_id, seg, count(*)::INT AS total, min(ahead) AS ahead FROM inside GROUP BY video_id, seg),
begins(video_id, seg, start) AS (SELECT video_id, seg, 0 FROM totals UNION ALL
  SELECT b.video_id, b.seg, min(c.pos) FROM begins b JOIN cuts c ON c.video_id = b.video_id AND c.seg = b.seg AND c.pos >= b.start + {MIN_LEN} GROUP BY b.video_id, b.seg, b.start),
kept AS (SELECT b.video_id, b.seg, b.start, t.total, t.ahead FROM begins b JOIN totals t ON t.video_id = b.video_id AND t.seg = b.seg WHERE b.start = 0 OR t.total - b.start >= {MIN_LEN}),
ended AS (SELECT video_id, seg, start + ahead AS start, (lead(start, 1, total) OVER (PARTITION BY video_id, seg ORDER BY start) - 1 + ahead)::INT AS "end" FROM kept)"""


@query(_with(_SEGMENT_SCENES, 'SELECT video_id, seg, (row_number() OVER (PARTITION BY video_id ORDER BY start) - 1)::INT AS id, start, "end" FROM ended'))
def segment_scenes(spark, sf_dir):
    return S.segment_scenes(S.in_segments(event_frames(spark, sf_dir), segments_merge(spark, sf_dir)), THRESHOLD, MIN_LEN)


@query(_with(f"{_FRAMES}, v AS (SELECT video_id, 0 AS start, count(*)::INT AS stop FROM frames GROUP BY video_id)", "SELECT video_id, start, stop, unnest(range(5))::INT AS k, (start + (stop - start) * unnest(range(5)) // 4)::BIGINT AS edge FROM v"))
def range_partition_edges(spark, sf_dir):
    v = event_frames(spark, sf_dir).groupBy("video_id").agg(F.lit(0).alias("start"), F.count("*").cast("int").alias("stop"))
    return S.range_edges(v, 4)


# Selection.


@query(_with(_JUDGED, "SELECT video_id, i, safe FROM judged"))
def window_safe(spark, sf_dir):
    return _judged(spark, sf_dir).select("video_id", "i", "safe")


def _judged(spark, sf_dir):
    return selection.judge_frames(event_placed(event_frames(spark, sf_dir)), OPTIONS)


@query(
    _with(
        _JUDGED,
        "SELECT video_id, count(*) FILTER (safe AND weak = 'dark') AS too_dark, count(*) FILTER (safe AND weak = 'blown') AS blown_highlights, count(*) FILTER (safe AND weak = 'soft') AS too_soft, count(*) FILTER (safe AND weak IS NULL) AS eligible_frames FROM judged GROUP BY video_id",
    )
)
def weak_frames(spark, sf_dir):
    return selection.weak_counts(_judged(spark, sf_dir))


@query(_with(_JUDGED, "SELECT * FROM quota"))
def scene_quota(spark, sf_dir):
    return selection.scene_quota(_judged(spark, sf_dir), OPTIONS)


@query(_with(_JUDGED, "SELECT * FROM gaps"))
def scene_gap(spark, sf_dir):
    return selection.scene_gap(_judged(spark, sf_dir), OPTIONS)


@query(
    _with(
        f"{_JUDGED}, slices AS (SELECT *, unnest(range(quota))::INT AS slice FROM gaps)",
        "SELECT o.video_id, o.scene, s.slice, o.i, row_number() OVER (PARTITION BY o.video_id, o.scene, s.slice ORDER BY o.sharpness DESC, o.i)::INT AS rank FROM ok o JOIN slices s ON s.video_id = o.video_id AND s.scene = o.scene AND o.pos >= s.lo + s.slice * (s.hi - s.lo + 1) // s.quota AND o.pos < s.lo + (s.slice + 1) * (s.hi - s.lo + 1) // s.quota",
    )
)
def slice_candidates(spark, sf_dir):
    return selection.slice_candidates(_judged(spark, sf_dir), OPTIONS).select("video_id", "scene", "slice", "i", "rank")


@query()
def select_scene(spark, sf_dir):
    return selection.select_scene(_judged(spark, sf_dir), OPTIONS)


@query(
    _with(
        _JUDGED,
        "SELECT s.video_id, sum(coalesce(q.n_eligible, 0))::BIGINT AS eligible_frames, sum(coalesce(q.quota, 0))::BIGINT AS wanted, coalesce(list(s.id ORDER BY s.id) FILTER (q.quota IS NULL), []) AS scenes_unusable FROM scenes s LEFT JOIN quota q ON q.video_id = s.video_id AND q.scene = s.id GROUP BY s.video_id",
    )
)
def select_stats(spark, sf_dir):
    return selection.select_stats(_judged(spark, sf_dir), OPTIONS)


@query(_with(_INTERVAL, 'SELECT video_id, frame, "window"[1] AS lo, "window"[2] AS hi FROM picks'))
def pick_windows(spark, sf_dir):
    return sharpest_per_interval(spark, sf_dir).select("video_id", "frame", F.col("window")[0].alias("lo"), F.col("window")[1].alias("hi"))


@query(_with(_INTERVAL, "SELECT video_id, frame, range(frame - 2, frame + 3)::INT[] AS source_frames FROM picks"))
def source_frames(spark, sf_dir):
    return sharpest_per_interval(spark, sf_dir).select("video_id", "frame", F.sequence(F.col("window")[0], F.col("window")[1]).alias("source_frames"))


@query(
    _with(
        f"{_INTERVAL}, m AS (SELECT p.video_id, p.frame, list(f.i ORDER BY f.i) AS members, list(f.sharpness ORDER BY f.i) AS sharpness FROM picks p JOIN frames f ON f.video_id = p.video_id AND f.i BETWEEN p.frame - 2 AND p.frame + 2 GROUP BY p.video_id, p.frame)",
        "SELECT video_id, frame, members, sharpness, len(members) = 5 AS complete FROM m",
    )
)
def restore_window(spark, sf_dir):
    frames = event_frames(spark, sf_dir)
    done = restore.restore_windows(selection.select_interval(event_placed(frames), INTERVAL), frames, ["sharpness"])
    return done.select("video_id", "frame", F.col("members.i").alias("members"), F.col("members.sharpness").alias("sharpness"), "complete")


@query(_with(f"{_INTERVAL}, m AS (SELECT p.video_id, p.frame, list(f.i ORDER BY f.i) AS a FROM picks p JOIN frames f ON f.video_id = p.video_id AND f.i BETWEEN p.frame - 2 AND p.frame + 2 GROUP BY p.video_id, p.frame)", "SELECT video_id, frame, a[len(a) // 2 + 1] AS centre FROM m"))
def centre_frame(spark, sf_dir):
    return restore_window(spark, sf_dir).select("video_id", "frame", F.element_at("members", F.floor(F.size("members") / 2).cast("int") + 1).alias("centre"))


@query(_with(f"{_FRAMES}, r AS (SELECT video_id, i, (row_number() OVER (PARTITION BY video_id ORDER BY i) - 1)::INT AS n, count(*) OVER (PARTITION BY video_id)::INT AS total FROM frames)", "SELECT video_id, i, n - (total - 9) // 2 AS place FROM r WHERE n >= (total - 9) // 2 AND n < (total - 9) // 2 + 9"))
def centred_subwindow(spark, sf_dir):
    frames = S.with_position(event_frames(spark, sf_dir)).select("video_id", "i", "pos")
    total = frames.groupBy("video_id").agg(F.floor((F.count("*") - 9) / 2).cast("int").alias("k"))
    return frames.join(total, "video_id").filter("pos >= k and pos < k + 9").select("video_id", "i", (F.col("pos") - F.col("k")).alias("place"))


@query(
    _with(
        f"{_INTERVAL}, pairs AS (SELECT a.video_id, bit_count(xor(a.dhash, b.dhash))::INT AS d, a.frame AS fa, b.frame AS fb FROM picks a JOIN picks b ON a.video_id = b.video_id AND a.frame < b.frame), r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY d, fa, fb) AS rn FROM pairs)",
        "SELECT video_id, d, fa, fb FROM r WHERE rn = 1",
    )
)
def closest_pair(spark, sf_dir):
    return selection.closest_pairs(sharpest_per_interval(spark, sf_dir))


@query(_with(f"{_FRAMES}, n AS (SELECT video_id, i, dhash, lag(dhash) OVER (PARTITION BY video_id ORDER BY i) AS before FROM frames)", "SELECT video_id, i, bit_count(xor(dhash, before))::INT AS bits FROM n WHERE before IS NOT NULL"))
def hamming(spark, sf_dir):
    f = event_frames(spark, sf_dir).withColumn("before", F.lag("dhash").over(S.frame_order())).filter("before is not null")
    return f.select("video_id", "i", hashing.hamming(F.col("dhash"), F.col("before")).alias("bits"))


_WINDOWS = f"""{_FRAMES}, v AS (SELECT video_id, count(*)::INT AS n FROM frames GROUP BY video_id), each AS (SELECT video_id, n, n / 5.0e0 AS span, least(2.0e0, n / 5.0e0) AS width, unnest(range(5))::INT AS k FROM v),
mid AS (SELECT *, (k + 0.5e0) * span AS m FROM each), st AS (SELECT *, floor(greatest(0.0e0, least(n - 1.0e0, m - width / 2)))::INT AS start FROM mid),
windows AS (SELECT video_id, k, start, floor(least(n::DOUBLE, greatest(start + 1.0e0, m + width / 2)))::INT AS stop FROM st)"""


def _windows(spark, sf_dir):
    videos = event_frames(spark, sf_dir).groupBy("video_id").agg(F.count("*").cast("int").alias("frame_count")).withColumn("fps", F.lit(FPS))
    return preview.preview_windows(videos, 5)


@query(_with(_WINDOWS, "SELECT * FROM windows"))
def preview_windows(spark, sf_dir):
    return _windows(spark, sf_dir)


@query(
    _with(
        f"{_WINDOWS}, best AS (SELECT w.video_id, w.k, (list(f.i ORDER BY f.sharpness DESC, f.i))[1] AS frame, max(f.sharpness) AS sharpness FROM windows w JOIN frames f ON f.video_id = w.video_id AND f.i >= w.start AND f.i < w.stop GROUP BY w.video_id, w.k), r AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame ORDER BY k) AS rn FROM best)",
        "SELECT video_id, k, frame, sharpness FROM r WHERE rn = 1",
    )
)
def quick_preview(spark, sf_dir):
    return preview.quick_preview(event_frames(spark, sf_dir), _windows(spark, sf_dir))


# Pictures, measured by the pass over pixels that scans take.


def _measured(spark, sf_dir):
    """Short runs, so that most pictures' predecessors come from the run before."""
    return images.measure(picture_frames(spark, sf_dir), chunk=16)


@query(_with(f"{_measures()},{_HASH}", "SELECT m.*, h.dhash FROM m JOIN hashes h ON h.video_id = m.video_id AND h.i = m.i", False))
def frame_metrics(spark, sf_dir):
    return _measured(spark, sf_dir)


@query(_with(_measures(), "SELECT video_id, i, luma FROM m", False))
def luma(spark, sf_dir):
    return _measured(spark, sf_dir).select("video_id", "i", "luma")


@query(_with(_measures(), "SELECT video_id, i, highlight_frac FROM m", False))
def highlight_frac(spark, sf_dir):
    return _measured(spark, sf_dir).select("video_id", "i", "highlight_frac")


@query(_with(_measures(), "SELECT video_id, i, sharpness FROM m", False))
def sharpness(spark, sf_dir):
    return _measured(spark, sf_dir).select("video_id", "i", "sharpness")


@query(_with(f"{_PIXELS},{_colours()},{_HASH}", "SELECT video_id, i, dhash FROM hashes", False))
def dhash(spark, sf_dir):
    return _measured(spark, sf_dir).select("video_id", "i", "dhash")


@query(_with(_measures(), "SELECT video_id, i, delta FROM m", False))
def scene_delta(spark, sf_dir):
    return _measured(spark, sf_dir).select("video_id", "i", "delta")


@query(_with(_measures(2, 1, 4, 6), "SELECT video_id, i, sharpness, luma, highlight_frac, delta FROM m", False))
def crop(spark, sf_dir):
    """Measures of rows 1 to 6 and columns 2 to 5 of each picture."""
    return images.measure(picture_frames(spark, sf_dir), (2, 1, 4, 6), 16).select("video_id", "i", "sharpness", "luma", "highlight_frac", "delta")


@query(_with(f"{_PIXELS},{_colours()}", "SELECT video_id, i, list(gray ORDER BY cell) AS gray FROM colours GROUP BY video_id, i", False))
def to_gray(spark, sf_dir):
    return images.planes(picture_frames(spark, sf_dir)).select("video_id", "i", "gray")


@query(_with(f"{_PIXELS},{_colours()}", "SELECT video_id, i, list(hue ORDER BY cell) AS hue, list(sat ORDER BY cell) AS saturation, list(val ORDER BY cell) AS value FROM colours GROUP BY video_id, i", False))
def hsv(spark, sf_dir):
    return images.planes(picture_frames(spark, sf_dir)).select("video_id", "i", "hue", "saturation", "value")


_HALVED = f"""{_PIXELS},
small AS (SELECT video_id, i, (y // 2 * 4 + x // 2)::INT AS cell, 0 AS x, 0 AS y, floor(sum(r) / 4.0e0 + 0.5e0)::INT AS r, floor(sum(g) / 4.0e0 + 0.5e0)::INT AS g, floor(sum(b) / 4.0e0 + 0.5e0)::INT AS b FROM pix GROUP BY video_id, i, y // 2 * 4 + x // 2),{_colours("small")}"""


@query(_with(_HALVED, "SELECT video_id, i, list(gray ORDER BY cell) AS gray, list(hue ORDER BY cell) AS hue FROM colours GROUP BY video_id, i", False))
def downscale(spark, sf_dir):
    """Pictures at half their size."""
    return images.planes(picture_frames(spark, sf_dir), (SIDE // 2, SIDE // 2)).select("video_id", "i", "gray", "hue")


@query(
    _with(
        f"{_PIXELS}, steps AS (SELECT video_id, greatest(1, count(*) // 3) AS step FROM levels GROUP BY video_id), lit AS (SELECT p.video_id, x, y FROM pix p JOIN steps s ON s.video_id = p.video_id WHERE p.i % s.step = 0 GROUP BY p.video_id, x, y HAVING max(greatest(r, g, b)) > 250)",
        "SELECT s.video_id, coalesce(min(x), 0)::INT AS x, coalesce(min(y), 0)::INT AS y, coalesce(max(x) - min(x) + 1, 8)::INT AS w, coalesce(max(y) - min(y) + 1, 8)::INT AS h FROM steps s LEFT JOIN lit l ON l.video_id = s.video_id GROUP BY s.video_id",
        False,
    )
)
def content_box(spark, sf_dir):
    return images.content_boxes(picture_frames(spark, sf_dir), samples=3, threshold=250)


@query("SELECT p_partkey AS part, 100 * (1 - (p_size * 10)::DOUBLE * 480 / (640 * 480)) AS matte FROM part")
def matte_pct(spark, sf_dir):
    """The share of a 640 x 480 frame outside a content box, in percent."""
    share = pixels.matte_percent(F.col("p_size") * 10, F.lit(480), F.lit(640), F.lit(480))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), share.alias("matte"))


# Text.

_CLOCK = "(o_orderkey % 5)::VARCHAR || ':' || (o_orderkey % 83)::VARCHAR || ':' || printf('%.1f', (o_orderkey % 600) / 10.0e0)"


@query(f"SELECT o_orderkey, {_CLOCK} AS clock, (o_orderkey % 5) * 3600.0e0 + (o_orderkey % 83) * 60.0e0 + printf('%.1f', (o_orderkey % 600) / 10.0e0)::DOUBLE AS seconds FROM orders")
def parse_ts(spark, sf_dir):
    key = F.col("o_orderkey")
    clock = F.concat_ws(":", (key % 5).cast("string"), (key % 83).cast("string"), F.format_string("%.1f", (key % 600) / 10.0))
    return table(spark, sf_dir, "orders").select("o_orderkey", clock.alias("clock")).withColumn("seconds", timecode.parse_timestamp(F.col("clock")))


@query(
    """WITH v AS (SELECT o_orderkey, o_totalprice / 64.0e0 - 100.0e0 AS s FROM orders), w AS (SELECT *, greatest(s, 0.0e0) AS p FROM v),
x AS (SELECT o_orderkey, floor(p)::BIGINT AS whole, round_even((p - floor(p)) * 1000, 0)::BIGINT AS ms FROM w),
y AS (SELECT o_orderkey, CASE WHEN ms = 1000 THEN whole + 1 ELSE whole END AS n, CASE WHEN ms = 1000 THEN 0 ELSE ms END AS ms FROM x)
SELECT o_orderkey, CASE WHEN n >= 3600 THEN (n // 3600) || ':' ELSE '' END || printf('%02d:%02d.%03d', n % 3600 // 60, n % 60, ms) AS clock FROM y"""
)
def format_ts(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", timecode.format_timestamp(F.col("o_totalprice") / 64.0 - 100.0).alias("clock"))


@query("WITH x AS (SELECT o_orderkey, floor(greatest(o_totalprice / 16.0e0 - 500.0e0, 0.0e0))::BIGINT AS n FROM orders) SELECT o_orderkey, CASE WHEN n >= 3600 THEN printf('%d:%02d:%02d', n // 3600, n % 3600 // 60, n % 60) ELSE printf('%d:%02d', n // 60, n % 60) END AS clock FROM x")
def format_hms(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", timecode.format_hms(F.col("o_totalprice") / 16.0 - 500.0).alias("clock"))


@query(_with(_STEMS, "SELECT doc_id, file FROM named", False))
def still_name(spark, sf_dir):
    return _named(spark, sf_dir).select("doc_id", "file")


def _named(spark, sf_dir):
    d = names_of_documents(spark, sf_dir)
    return d.withColumn("file", names.still_name(F.col("stem"), F.col("scene"), F.col("frame"), F.col("seed")))


@query(_with(_STILLS, "SELECT doc_id, scene, frame, seed FROM parsed", False))
def parse_still_name(spark, sf_dir):
    return _named(spark, sf_dir).select("doc_id", names.parse_still_name(F.col("file")).alias("n")).select("doc_id", "n.*")


@query(_with(_STEMS, "SELECT doc_id, regexp_replace(file, '\\.png$', '_upscaled.png') AS out, false AS before, true AS after FROM named", False))
def upscaled_name(spark, sf_dir):
    out = names.upscaled_name(F.col("file"))
    return _named(spark, sf_dir).select("doc_id", out.alias("out"), names.is_upscaled(F.col("file")).alias("before"), names.is_upscaled(out).alias("after"))


@query("SELECT page_id, lower(regexp_extract(url || CASE WHEN page_id % 3 = 0 THEN '.MP4' WHEN page_id % 3 = 1 THEN '.txt' ELSE '' END, '\\.[^./]*$', 0)) AS ext, page_id % 3 = 0 AS video FROM pages")
def ext_filter(spark, sf_dir):
    path = F.concat("url", F.when(F.col("page_id") % 3 == 0, ".MP4").when(F.col("page_id") % 3 == 1, ".txt").otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", names.extension(path).alias("ext"), names.is_video(path).alias("video"))


# Stills.


def _stills(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("doc_id % 5 <> 0")
    frame = (F.col("doc_id") * 37).cast("int")
    picks = d.select(frame.alias("frame"), (F.col("doc_id") / 4.0).alias("t"), (F.col("doc_id") % 97 * 1.5).alias("sharpness"), F.array(frame - 2, frame + 2).alias("window"))
    named = _named(spark, sf_dir).select("doc_id", "file")
    prior = named.join(table(spark, sf_dir, "labels"), "doc_id").select("file", (F.col("quality") == 1).alias("restored"))
    found = stills.with_restored(stills.collect_stills(named, picks), prior)
    sizes = {"width": F.lit(640) + (F.col("doc_id") % 3 * 64).cast("int"), "height": F.lit(360) + (F.col("doc_id") % 5 * 30).cast("int"), "sheet": (F.col("doc_id") % 40).cast("int")}
    return found.withColumns(sizes), picks, prior, named


@query(_with(_STILLS, 'SELECT file, scene, frame, seed, t, source_sharpness, "window" FROM stills', False))
def collect_stills(spark, sf_dir):
    return _stills(spark, sf_dir)[0].select("file", "scene", "frame", "seed", "t", "source_sharpness", "window")


@query(_with(_STILLS, "SELECT file, restored FROM stills", False))
def restored_flag(spark, sf_dir):
    return _stills(spark, sf_dir)[0].select("file", "restored")


_SOME = "coalesce(list(file ORDER BY file) FILTER ({}), [])[1:3]"


@query(_with(_STILLS, f"SELECT count(*) FILTER (frame IS NULL) AS unnamed, count(*) FILTER (frame IS NOT NULL AND t IS NULL) AS unmatched, {_SOME.format('frame IS NULL')} AS unnamed_files, {_SOME.format('frame IS NOT NULL AND t IS NULL')} AS unmatched_files FROM stills", False))
def provenance_gaps(spark, sf_dir):
    return stills.provenance_gaps(_stills(spark, sf_dir)[0])


@query(_with(_STILLS, "SELECT sheet, count(*) AS stills, count(*) FILTER (NOT restored) AS raw, count(*) FILTER (t IS NOT NULL) AS with_provenance FROM stills GROUP BY sheet", False))
def manifest_counts(spark, sf_dir):
    return stills.manifest_counts(_stills(spark, sf_dir)[0], "sheet")


@query(_with(f"{_STILLS}, m AS (SELECT file, restored, bool_or(restored) OVER (PARTITION BY sheet) AND bool_or(NOT restored) OVER (PARTITION BY sheet) AS mixed FROM stills)", "SELECT file, CASE WHEN mixed THEN CASE WHEN restored THEN 'upscaled' ELSE 'source' END END AS variant FROM m", False))
def variant_label(spark, sf_dir):
    return stills.variant_labels(_stills(spark, sf_dir)[0], "sheet").select("file", "variant")


@query(_with(f"{_STILLS}, two AS (SELECT frame, file FROM parsed UNION ALL SELECT frame, regexp_replace(file, '\\.png$', '_upscaled.png') FROM parsed WHERE doc_id % 2 = 0)", "SELECT frame, list(file ORDER BY file) AS files, count(*)::INT AS n FROM two GROUP BY frame", False))
def group_variants(spark, sf_dir):
    named = _named(spark, sf_dir).select("doc_id", "file")
    two = named.select("file").union(named.filter("doc_id % 2 = 0").select(names.upscaled_name(F.col("file"))))
    parsed = two.select("file", names.parse_still_name(F.col("file"))["frame"].alias("frame"))
    return stills.group_variants(parsed)


@query(_with(_INTERVAL, "SELECT video_id, frame, unnest([42, 43, 44])::INT AS seed FROM picks"))
def seed_variants(spark, sf_dir):
    return stills.seed_variants(sharpest_per_interval(spark, sf_dir), 42, 3).select("video_id", "frame", "seed")


@query(_with(f"{_STILLS}, have AS (SELECT file, coalesce(restored, true) AS r FROM was)", "SELECT n.file, CASE WHEN h.file IS NULL THEN 'todo' WHEN NOT h.r THEN 'stale' ELSE 'done' END AS state FROM named n LEFT JOIN have h ON h.file = n.file", False))
def resume_todo(spark, sf_dir):
    _, _, prior, named = _stills(spark, sf_dir)
    return stills.resume_todo(named.select("file"), prior).select("file", "state")


@query(
    _with(
        f"{_STILLS}, files AS (SELECT file FROM named UNION ALL SELECT regexp_replace(file, '\\.png$', '_upscaled.png') FROM named WHERE doc_id % 7 = 0)"
        """, x AS (SELECT file, regexp_replace(file, '\\.png$', '_upscaled.png') AS out, nullif(regexp_extract(file, '(?i)_s(\\d+)_f(\\d+)', 2), '')::INT AS frame FROM files)""",
        """SELECT x.file, x.frame, CASE WHEN regexp_matches(x.file, '_upscaled\\.png$') THEN 'upscaled' WHEN w.restored THEN 'done' WHEN k.frame IS NULL THEN 'orphan' WHEN o.file IS NOT NULL THEN 'present' ELSE 'todo' END AS state
FROM x LEFT JOIN pick k ON k.frame = x.frame LEFT JOIN was w ON w.file = x.file LEFT JOIN files o ON o.file = x.out""",
        False,
    )
)
def kept_stills(spark, sf_dir):
    _, picks, prior, named = _stills(spark, sf_dir)
    files = named.select("file").union(named.filter("doc_id % 7 = 0").select(names.upscaled_name(F.col("file"))))
    return stills.kept_stills(files, picks, prior)


@query(_with(_STILLS, "SELECT file, frame, scene, seed, width, height, restored FROM stills", False))
def manifest(spark, sf_dir):
    """Entries written as JSON and read back."""
    rows = stills.manifest_rows(_stills(spark, sf_dir)[0])
    entry = F.from_json("entry", "frame int, scene int, seed int, width int, height int, restored boolean")
    return rows.select("file", entry.alias("e")).select("file", "e.*")


@query(_with(_STILLS, "SELECT file, CASE WHEN doc_id % 2 = 0 THEN restored ELSE true END AS restored FROM stills", False))
def prior_restored(spark, sf_dir):
    """What an earlier manifest says of its files; a file without the field counts as restored."""
    rows = stills.manifest_rows(_stills(spark, sf_dir)[0].withColumn("restored", F.when(F.col("doc_id") % 2 == 0, F.col("restored"))))
    return rows.select("file", F.coalesce(F.from_json("entry", "restored boolean")["restored"], F.lit(True)).alias("restored"))


@query(_with(_FRAMES, "SELECT video_id, CASE WHEN count(*) < 60 THEN 'failed' ELSE 'done' END AS status, CASE WHEN count(*) < 60 THEN count(*) || ' frames' END AS reason FROM frames GROUP BY video_id"))
def batch_status(spark, sf_dir):
    """Outcome of each video of a batch: an error stays with its video."""
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            if len(pdf) < 60:
                raise ValueError(f"{len(pdf)} frames")
            return pd.DataFrame({"video_id": [pdf["video_id"].iloc[0]], "status": ["done"], "reason": [None]})
        except ValueError as error:
            return pd.DataFrame({"video_id": [pdf["video_id"].iloc[0]], "status": ["failed"], "reason": [str(error)]})

    return event_frames(spark, sf_dir).select("video_id", "i").groupBy("video_id").applyInPandas(one, "video_id long, status string, reason string")


# Sheets.

_SIZES = f"""{_STILLS}, agg AS (SELECT sheet, count(*)::INT AS n, median(height / width) AS aspect FROM stills GROUP BY sheet),
sizes AS (SELECT sheet, n, greatest(1, least(5, n)) AS columns, 420 AS cell_w, round_even(aspect * 420, 0)::INT AS cell_h, 62 AS label_h, 52 AS title_h FROM agg)"""
_PLACED = f"""{_SIZES}, o AS (SELECT s.*, (row_number() OVER (PARTITION BY s.sheet ORDER BY coalesce(s.frame, 1073741824), coalesce(s.seed, -1), s.file) - 1)::INT AS ordinal FROM stills s),
p AS (SELECT o.*, z.columns, z.cell_w, z.cell_h, z.label_h, z.title_h, ordinal // z.columns AS row, ordinal % z.columns AS col, least(z.cell_w / o.width, z.cell_h / o.height) AS scale FROM o JOIN sizes z USING (sheet)),
f AS (SELECT *, greatest(1, floor(width * scale)::INT) AS fit_w, greatest(1, floor(height * scale)::INT) AS fit_h FROM p)"""


def _layout(spark, sf_dir):
    return sheet.sheet_layout(_stills(spark, sf_dir)[0], ["sort_key"])


@query(_with(_PLACED, "SELECT file, sheet, ordinal, row, col, col * cell_w AS x0, title_h + row * (cell_h + label_h) AS y0 FROM f", False))
def sheet_layout(spark, sf_dir):
    return _layout(spark, sf_dir).select("file", "sheet", "ordinal", "row", "col", "x0", "y0")


@query(_with(_PLACED, "SELECT file, fit_w, fit_h, floor((cell_w - fit_w) / 2)::INT AS fit_x, floor((cell_h - fit_h) / 2)::INT AS fit_y FROM f", False))
def sheet_fit(spark, sf_dir):
    return _layout(spark, sf_dir).select("file", "fit_w", "fit_h", "fit_x", "fit_y")


@query(
    _with(
        _PLACED,
        """SELECT file, '#' || printf('%02d', ordinal) || coalesce('  f' || frame, '') || coalesce('  ' || printf('%.2fs', t), '') || coalesce('  scene ' || scene, '') AS first,
concat_ws('   ', 'seed ' || seed, CASE WHEN "window" IS NOT NULL THEN printf('from %d frames [%d..%d]', "window"[2] - "window"[1] + 1, "window"[1], "window"[2]) END, width || 'x' || height) AS second FROM f""",
        False,
    )
)
def sheet_labels(spark, sf_dir):
    first, second = sheet.labels()
    return _layout(spark, sf_dir).withColumn("variant", F.lit(None).cast("string")).select("file", first.alias("first"), second.alias("second"))
