"""A quick look without a scan: windows in the middle of equal slices, the sharpest frame of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COUNT, WINDOW_S, BOX_SAMPLES = 20, 1.0, 60


def preview_windows(videos: DataFrame, count: int = COUNT, window_s: float = WINDOW_S) -> DataFrame:
    """video_id, k, start, stop (exclusive) of videos (video_id, frame_count, fps): windows shrink to their slice, so they stay apart."""
    span = F.col("frame_count") / F.lit(float(count))
    width = F.least(F.lit(window_s) * F.col("fps"), span)
    each = videos.select("*", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("k"))
    middle = (F.col("k") + 0.5) * span
    start = F.floor(F.greatest(F.lit(0.0), F.least(F.col("frame_count") - 1.0, middle - width / 2)))
    each = each.withColumn("start", start.cast("int"))
    stop = F.floor(F.least(F.col("frame_count").cast("double"), F.greatest(F.col("start") + 1.0, middle + width / 2)))
    return each.select("video_id", "k", "start", stop.cast("int").alias("stop"))


def quick_preview(frames: DataFrame, windows: DataFrame) -> DataFrame:
    """video_id, k, frame, sharpness: the sharpest frame of each window (ties: the first); frames that several windows pick count once.

    Windows are spread into frame numbers, so frames join by number, not by range.
    """
    wanted = windows.select("video_id", "k", F.explode(F.sequence("start", F.col("stop") - 1)).alias("i"))
    seen = wanted.join(frames.select("video_id", "i", "sharpness"), ["video_id", "i"])
    best = seen.groupBy("video_id", "k").agg(F.max_by(F.struct("i", "sharpness"), F.struct("sharpness", -F.col("i"))).alias("b"))
    first = F.row_number().over(Window.partitionBy("video_id", "b.i").orderBy("k"))
    return best.withColumn("_n", first).filter("_n = 1").select("video_id", "k", F.col("b.i").alias("frame"), F.col("b.sharpness").alias("sharpness"))
