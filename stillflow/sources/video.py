"""Videos as a Spark data source: ranges of frame numbers are partitions, and filters on i reach the decoder.

Decoding needs OpenCV, which is optional: without it the source says so when it is read.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from stillflow.sources.images import FRAME

#: Frames that are worth a partition of their own.
LEAST_FRAMES = 100


class FrameRange(InputPartition):
    def __init__(self, path: str, start: int, stop: int | None):
        super().__init__((path, start, stop))
        self.path, self.start, self.stop = path, start, stop


def frame_ranges(start: int, stop: int, parts: int) -> list[tuple[int, int]]:
    """Even ranges of frames, at most parts and none much smaller than LEAST_FRAMES."""
    length = max(0, stop - start)
    n = max(1, min(parts, length // LEAST_FRAMES))
    edges = [start + length * k // n for k in range(n + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


class VideoReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.parts = options["path"], int(options.get("partitions", 8))
        self.low, self.high = 0, None

    def pushFilters(self, filters):
        for f in filters:
            on_i = tuple(getattr(f, "attribute", ())) == ("i",)
            if on_i and isinstance(f, (GreaterThanOrEqual, GreaterThan, EqualTo)):
                self.low = max(self.low, int(f.value) + isinstance(f, GreaterThan))
            if on_i and isinstance(f, (LessThanOrEqual, LessThan, EqualTo)):
                stop = int(f.value) + (not isinstance(f, LessThan))
                self.high = stop if self.high is None else min(self.high, stop)
            yield f  # ranges only spare work: Spark tests the rows again

    def _open(self, path: str):
        try:
            import cv2
        except ImportError as missing:
            raise RuntimeError("reading videos needs OpenCV (cv2), which is not installed") from missing
        capture = cv2.VideoCapture(path)
        if not capture.isOpened():
            raise OSError(f"cannot open video: {path}")
        return cv2, capture

    def partitions(self):
        cv2, capture = self._open(self.path)
        declared = int(capture.get(cv2.CAP_PROP_FRAME_COUNT))
        capture.release()
        stop = declared if self.high is None else min(declared, self.high)
        ranges = frame_ranges(self.low, stop, self.parts)
        # The declared count is a hint: the last range reads to the end of the file.
        last = None if self.high is None else self.high
        return [FrameRange(self.path, a, last if b == stop else b) for a, b in ranges]

    def read(self, partition: FrameRange):
        cv2, capture = self._open(partition.path)
        fps = capture.get(cv2.CAP_PROP_FPS) or 25.0
        capture.set(cv2.CAP_PROP_POS_FRAMES, partition.start)
        i = partition.start
        while partition.stop is None or i < partition.stop:
            fine, frame = capture.read()
            if not fine:
                break
            yield (partition.path, i, round(i / fps, 4), fps, frame.shape[0], frame.shape[1], frame.tobytes())
            i += 1
        capture.release()


def register(spark: SparkSession) -> None:
    """Makes spark.read.format("frames_of_video").option("path", ...).load() known, with filters on i reaching the decoder."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VideoSource)


class VideoSource(DataSource):

    @classmethod
    def name(cls) -> str:
        return "frames_of_video"

    def schema(self) -> str:
        return FRAME

    def reader(self, schema) -> VideoReader:
        return VideoReader(self.options)
