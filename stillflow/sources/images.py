"""Pictures and folders: decoded frames of PNG sequences, file listings, and PNG files without an imaging library."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stillflow.functions import pixels
from stillflow.functions.names import is_video

FRAME = "video_id string, i int, t double, fps double, height int, width int, data binary"
METRICS = "video_id string, i int, t double, sharpness double, luma double, highlight_frac double, delta double, dhash string"


def list_videos(spark: SparkSession, folder: str) -> DataFrame:
    """path of the video files of a folder's first level, by extension in any case."""
    return spark.read.format("binaryFile").load(folder).select("path").filter(is_video(F.col("path"))).orderBy("path")


def list_stills(spark: SparkSession, folder: str) -> DataFrame:
    """file, path of the PNG files of a folder; parts of files that a stopped run left are passed over."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(folder).select("path")
    return files.withColumn("file", F.regexp_extract("path", "[^/]*$", 0)).filter(~F.col("file").endswith(".part.png")).select("file", "path")


def png_frames(spark: SparkSession, folder: str, fps: float = 25.0, exclude: str = "restored_") -> DataFrame:
    """video_id (the folder), i (from 0, in name order), t, fps, height, width, data (blue-green-red bytes) of a folder of PNG files."""
    images = spark.read.format("image").option("dropInvalid", True).load(folder).select("image.*")
    named = images.withColumn("file", F.regexp_extract("origin", "[^/]*$", 0)).filter(~F.col("file").startswith(exclude))
    # The order is taken on names alone; pictures join it.
    order = named.select("origin", (F.row_number().over(Window.partitionBy(F.lit(folder)).orderBy("file")) - 1).alias("i"))
    return named.join(order, "origin").select(F.lit(folder).alias("video_id"), "i", F.round(F.col("i") / fps, 4).alias("t"), F.lit(float(fps)).alias("fps"), "height", "width", "data")


def _picture(r) -> np.ndarray:
    return np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3)


def measure(frames: DataFrame, box: tuple[int, int, int, int] | None = None, chunk: int = 256) -> DataFrame:
    """METRICS of frames (video_id, i, t, height, width, data): one pass over pixels.

    Frames are dealt in runs of chunk frames with the one before each run, so a change at a run's border sees its true
    predecessor and the result does not depend on the dealing.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, before, out = pdf.sort_values("i"), None, []
        for r in pdf.itertuples():
            picture = pixels.crop(_picture(r), box)
            small = pixels.bilinear_resize(picture, *pixels.work_size(picture.shape[1], picture.shape[0]))
            hsv = pixels.to_hsv(small)
            if not r.lead:
                gray = pixels.to_gray(picture)
                delta = 0.0 if before is None else pixels.scene_score(before, hsv)
                out.append((r.video_id, r.i, r.t, round(pixels.laplacian_variance(gray), 4), round(float(gray.mean()), 2), round(float((gray >= pixels.HIGHLIGHT).mean()), 4), round(delta, 4), pixels.difference_hash(pixels.to_gray(small))))
            before = hsv
        return pd.DataFrame(out, columns=[c.split()[0] for c in METRICS.split(", ")])

    number = F.floor(F.col("i") / chunk)
    own = frames.select("video_id", "i", "t", "height", "width", "data", number.alias("run"), F.lit(False).alias("lead"))
    lead = own.filter((F.col("i") + 1) % chunk == 0).withColumns({"run": F.col("run") + 1, "lead": F.lit(True)})
    return own.unionByName(lead).groupBy("video_id", "run").applyInPandas(run, METRICS)


def planes(frames: DataFrame, size: tuple[int, int] | None = None) -> DataFrame:
    """video_id, i, gray, hue, saturation, value: what the pixel kernels make of frames (scaled to width, height of size first), row by row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                picture = _picture(r) if size is None else pixels.bilinear_resize(_picture(r), *size)
                out.append((r.video_id, r.i, pixels.to_gray(picture).ravel().astype(int).tolist(), *(c.ravel().astype(int).tolist() for c in np.moveaxis(pixels.to_hsv(picture), -1, 0))))
            yield pd.DataFrame(out, columns=["video_id", "i", "gray", "hue", "saturation", "value"])

    kinds = "video_id string, i int, gray array<int>, hue array<int>, saturation array<int>, value array<int>"
    return frames.select("video_id", "i", "height", "width", "data").mapInPandas(run, kinds)


def content_boxes(frames: DataFrame, samples: int = 60, threshold: int = 16) -> DataFrame:
    """video_id, x, y, w, h of what any of about samples frames of a video lights above threshold.

    Each task sends on one projection (the brightest value of each pixel) for each video that it has seen.
    """

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top: dict = {}
        for pdf in batches:
            for r in pdf.itertuples():
                peak = _picture(r).max(2)
                top[r.video_id] = np.maximum(top[r.video_id], peak) if r.video_id in top else peak
        yield pd.DataFrame([(v, p.shape[0], p.shape[1], p.tobytes()) for v, p in top.items()], columns=["video_id", "height", "width", "data"])

    def box(pdf: pd.DataFrame) -> pd.DataFrame:
        all_ = np.maximum.reduce([np.frombuffer(r.data, np.uint8).reshape(r.height, r.width) for r in pdf.itertuples()])
        return pd.DataFrame([(pdf["video_id"].iloc[0], *pixels.content_box(all_, threshold))], columns=["video_id", "x", "y", "w", "h"])

    step = frames.groupBy("video_id").agg(F.greatest(F.lit(1), F.floor(F.count("*") / samples)).alias("step"))
    sampled = frames.join(step, "video_id").filter("i % step = 0").select("video_id", "height", "width", "data")
    parts = sampled.mapInPandas(project, "video_id string, height int, width int, data binary")
    return parts.groupBy("video_id").applyInPandas(box, "video_id string, x int, y int, w int, h int")


def png_bytes(rgb: np.ndarray) -> bytes:
    """A PNG file of 8-bit [height, width, 3] red-green-blue values."""
    height, width = rgb.shape[:2]

    def part(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = np.concatenate([np.zeros((height, 1), np.uint8), np.ascontiguousarray(rgb, np.uint8).reshape(height, -1)], 1)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows.tobytes(), 6)) + part(b"IEND", b"")


def write_whole(data: bytes, path: str) -> None:
    """A file that appears whole: written beside its place under a name that no listing takes, then renamed."""
    part = path + ".part"
    with open(part, "wb") as file:
        file.write(data)
    os.replace(part, path)


def write_png(rgb: np.ndarray, path: str) -> None:
    write_whole(png_bytes(rgb), path)
