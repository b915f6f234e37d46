"""From ordered frame rows to scenes: positions, changes, cuts, greedy scene bounds, assignment and statistics.

Frames are rows of video_id, i (frame number), t, sharpness, luma, highlight_frac, delta, dhash. All operators keep videos
apart by video_id, so any number of videos is one job. A window over one video sorts metric rows only, never pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCENE_THRESHOLD, MIN_SCENE_LEN = 27.0, 15


def frame_order(*keys: str):
    return Window.partitionBy(*(keys or ("video_id",))).orderBy("i")


def with_position(frames: DataFrame, *keys: str) -> DataFrame:
    """pos: the place of a frame among those of its video, from 0 (frame numbers may have gaps)."""
    return frames.withColumn("pos", F.row_number().over(frame_order(*keys)) - 1)


def with_delta(frames: DataFrame, change: Column, *keys: str) -> DataFrame:
    """delta: change (an expression of value and before) from the frame before; 0 for the first of a video or segment."""
    before = F.lag("value").over(frame_order(*keys))
    return frames.withColumn("before", before).withColumn("delta", F.coalesce(change, F.lit(0.0))).drop("before")


def cuts(frames: DataFrame, threshold: float = SCENE_THRESHOLD) -> DataFrame:
    """Positions where a scene may begin: a change of at least threshold, not at the first frame."""
    return frames.filter((F.col("pos") > 0) & (F.col("delta") >= threshold))


def scene_bounds(frames: DataFrame, threshold: float = SCENE_THRESHOLD, min_len: int = MIN_SCENE_LEN, keys: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """keys, id, start, end (positions, both inclusive).

    A cut counts if it is min_len or more after the last that counted; a last scene under min_len joins the one before.
    Only a video's cuts are gathered, and folded in order.
    """
    at = F.when((F.col("pos") > 0) & (F.col("delta") >= threshold), F.col("pos"))
    video = frames.groupBy(*keys).agg(F.count("*").cast("int").alias("total"), F.array_sort(F.collect_list(at)).alias("at"))
    kept = F.aggregate("at", F.array(F.lit(0)), lambda acc, c: F.when(c - F.element_at(acc, -1) >= min_len, F.concat(acc, F.array(c))).otherwise(acc))
    video = video.withColumn("starts", kept)
    short_tail = (F.size("starts") > 1) & (F.col("total") - F.element_at("starts", -1) < min_len)
    video = video.withColumn("starts", F.when(short_tail, F.slice("starts", 1, F.size("starts") - 1)).otherwise(F.col("starts")))
    each = video.select(*keys, "total", "starts", F.posexplode("starts").alias("id", "start"))
    end = F.coalesce(F.try_element_at("starts", F.col("id") + 2), F.col("total")) - 1
    return each.select(*keys, "id", "start", end.alias("end"))


def assign_scenes(frames: DataFrame, scenes: DataFrame, keys: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """frames and scene: scene starts are matched by position and counted up along the video, which costs no range join."""
    starts = scenes.select(*keys, F.col("start").alias("pos"), F.lit(1).alias("_begins"))
    marked = frames.join(starts, [*keys, "pos"], "left")
    count = F.sum(F.coalesce("_begins", F.lit(0))).over(Window.partitionBy(*keys).orderBy("pos"))
    return marked.withColumn("scene", (count - 1).cast("int")).drop("_begins")


def scene_stats(frames: DataFrame, keys: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """One row for each scene of frames with pos and scene: bounds by position, frame number and time, and sharpness; ties go to the first frame.

    The mean is raised by a hair before it is rounded, so that halves do not hang on the order of summation.
    """
    best = F.max_by(F.struct("i", "sharpness"), F.struct("sharpness", -F.col("pos")))
    ends = lambda c: (F.min_by(c, "pos"), F.max_by(c, "pos"))
    (i0, i1), (t0, t1) = ends("i"), ends("t")
    stats = frames.groupBy(*keys, F.col("scene").alias("id")).agg(
        F.min("pos").alias("start"), F.max("pos").alias("end"), i0.alias("start_i"), i1.alias("end_i"), t0.alias("start_t"), t1.alias("end_t"),
        F.count("*").cast("int").alias("frame_count"), best.alias("_best"), F.avg("sharpness").alias("_mean"),
    )
    return stats.select(*keys, "id", "start", "end", "start_i", "end_i", "start_t", "end_t", "frame_count", F.col("_best.i").alias("best_frame"), F.col("_best.sharpness").alias("best_sharpness"), F.round(F.col("_mean") + 1e-9, 4).alias("mean_sharpness"))


def merge_segments(segments: DataFrame, fps: float) -> DataFrame:
    """video_id, seg, start, stop (exclusive) of wanted times (video_id, from_t, to_t, in seconds): overlapping and adjacent ones are one.

    A segment that does not end after it begins is an error.
    """
    fine = F.when(F.col("to_t") > F.col("from_t"), F.col("from_t")).otherwise(F.raise_error(F.lit("a segment must end after it begins")).cast("double"))
    # Half to even, as the numbers of both ends are rounded.
    ranges = segments.select("video_id", F.bround(fine * fps).cast("int").alias("start"), (F.bround(F.col("to_t") * fps).cast("int") + 1).alias("stop"))
    order = Window.partitionBy("video_id").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("_new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    islands = marked.withColumn("seg", (F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
    return islands.groupBy("video_id", "seg").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))


def in_segments(frames: DataFrame, segments: DataFrame) -> DataFrame:
    """Frames within a segment (by i), with seg and pos over the video's scanned frames; the change at a segment's first frame is 0.

    Beginnings of segments are put among the frames, and each frame looks back to the last one: no frame meets every segment.
    """
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in frames.schema if f.name not in ("video_id", "i")]
    begins = segments.select("video_id", F.col("start").alias("i"), *nothing, F.struct("seg", "stop").alias("_s"), F.lit(0).alias("_frame"))
    kind = begins.schema["_s"].dataType
    both = frames.select(*begins.columns[: len(frames.columns)], F.lit(None).cast(kind).alias("_s"), F.lit(1).alias("_frame")).unionByName(begins)
    last = F.last("_s", ignorenulls=True).over(Window.partitionBy("video_id").orderBy("i", "_frame"))
    kept = both.withColumn("_s", last).filter("_frame = 1 and i < _s.stop").select(*frames.columns, F.col("_s.seg").alias("seg"))
    first = F.row_number().over(frame_order("video_id", "seg")) == 1
    return with_position(kept.withColumn("delta", F.when(first, 0.0).otherwise(F.col("delta"))))


def segment_scenes(frames: DataFrame, threshold: float, min_len: int) -> DataFrame:
    """Scenes of frames with seg: none spans a segment; ids and positions run on through the video."""
    local = frames.withColumn("_at", F.min("pos").over(Window.partitionBy("video_id", "seg"))).withColumn("pos", F.col("pos") - F.col("_at"))
    bounds = scene_bounds(local, threshold, min_len, ("video_id", "seg"))
    shift = local.groupBy("video_id", "seg").agg(F.first("_at").alias("_at"))
    placed = bounds.join(shift, ["video_id", "seg"]).withColumns({"start": F.col("start") + F.col("_at"), "end": F.col("end") + F.col("_at")})
    return placed.withColumn("id", (F.row_number().over(Window.partitionBy("video_id").orderBy("start")) - 1).cast("int")).select("video_id", "seg", "id", "start", "end")


def range_edges(ranges: DataFrame, parts: int) -> DataFrame:
    """start + length * k div parts for k = 0 .. parts: where parallel readers of (start, stop) begin and end."""
    each = ranges.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(parts))))
    return each.withColumn("edge", F.expr(f"start + (stop - start) * k div {parts}"))
