"""The driver's tables read as frames: events as the metric rows of one video for each user, embeddings as videos of 8 x 8 pictures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillflow.functions.hashing import hex_to_long
from stillflow.operators import scenes as S
from stillflow.operators.selection import Options

FPS = 2.0
THRESHOLD, MIN_LEN = 120.0, 5
#: Selection on events; highlights run evenly up to 0.99 there.
OPTIONS = Options(fps=FPS, seconds_per_still=4.0, per_scene_max=8, hash_distance=8, min_luma=24.0, max_highlight_frac=0.95)
INTERVAL = 2.0
SIDE, LENGTH = 8, 125


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, i, pos, t, sharpness, luma, highlight_frac, delta, dhash."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", "props")
    order = "row_number() over (partition by user_id order by ts, event_id) - 1"
    k = F.regexp_extract("props", '"k": ?([0-9]+)', 1).cast("int")
    rows = events.select(
        F.col("user_id").alias("video_id"), F.expr(order).alias("i"), F.col("value").alias("value"), k.alias("k"), hex_to_long(F.substring(F.md5(F.col("event_id").cast("string")), 1, 15)).alias("dhash")
    )
    changed = S.with_delta(rows, F.abs(F.col("value") - F.col("before")))
    return changed.select("video_id", "i", F.col("i").alias("pos"), (F.col("i") / FPS).alias("t"), F.col("value").alias("sharpness"), (F.col("k") * 2.55).alias("luma"), (F.col("k") / 100.0).alias("highlight_frac"), "delta", "dhash")


def event_placed(frames: DataFrame) -> DataFrame:
    """Frames with their scenes."""
    return S.assign_scenes(frames, S.scene_bounds(frames, THRESHOLD, MIN_LEN))


def picture_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, i, t, fps, height, width, data (blue-green-red bytes) of 8 x 8 colour pictures: each number of an embedding is a
    pixel's blue, the one 21 further on its green, 42 further on its red; LENGTH pictures are a video."""
    e = table(spark, sf_dir, "embeddings")
    level = F.transform("embedding", lambda v: F.least(F.greatest(F.floor(127.5 + 480.0 * v.cast("double")).cast("int"), F.lit(0)), F.lit(255)))
    px = e.select("vec_id", level.alias("px"))
    byte = lambda k, shift: F.lpad(F.hex(F.element_at("px", ((k + shift) % 64 + 1).cast("int"))), 2, "0")
    data = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.concat(byte(k, 0), byte(k, 21), byte(k, 42))), ""))
    i = (F.col("vec_id") % LENGTH).cast("int")
    return px.select(F.floor(F.col("vec_id") / LENGTH).cast("string").alias("video_id"), i.alias("i"), F.round(i / 25.0, 4).alias("t"), F.lit(25.0).alias("fps"), F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"), data.alias("data"))


def names_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, stem, scene, frame, seed: made-up still files, one for each document."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    scene = F.when(F.col("doc_id") % 11 != 0, (F.col("doc_id") % 7).cast("int"))
    seed = F.when(F.col("doc_id") % 3 == 0, (F.col("doc_id") % 5).cast("int"))
    return d.select("doc_id", F.concat_ws("-", "source", "lang", F.repeat("lang", 16)).alias("stem"), scene.alias("scene"), (F.col("doc_id") * 37).cast("int").alias("frame"), seed.alias("seed"))
