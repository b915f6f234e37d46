"""The same operators on streams of frame metrics: interval picks with watermarks, and scenes with the last kept cut as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCENE = "video_id long, id int, start int, `end` int"
STATE = "id int, start int, next int"


def interval_picks(frames: DataFrame, interval: str = "2 seconds", lateness: str = "10 seconds") -> DataFrame:
    """The sharpest frame of every interval of each video, of a stream with an event time ts; ties go to the first frame."""
    timed = frames.withWatermark("ts", lateness)
    best = F.max_by(F.struct("i", "sharpness"), F.struct("sharpness", -F.col("i"))).alias("b")
    return timed.groupBy("video_id", F.window("ts", interval)).agg(best).select("video_id", F.col("window.start").alias("start"), F.col("b.i").alias("frame"), F.col("b.sharpness").alias("sharpness"))


def closed_scenes(frames: DataFrame, threshold: float, min_len: int) -> DataFrame:
    """Scenes of a stream of frames (video_id, pos, delta) as soon as a later cut closes them.

    Frames of a video arrive in order of pos across batches; within a batch they are sorted. A cut closes the open scene
    if that is min_len frames long by then. The last scene of a video stays open, as a stream has no end.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, start, after = state.get if state.exists else (0, 0, 0)
        out = []
        for r in pd.concat(list(batches)).sort_values("pos").itertuples():
            if r.pos > 0 and r.delta >= threshold and r.pos - start >= min_len:
                out.append((key[0], number, start, int(r.pos) - 1))
                number, start = number + 1, int(r.pos)
            after = int(r.pos) + 1
        state.update((number, start, after))
        yield pd.DataFrame(out, columns=["video_id", "id", "start", "end"])

    return frames.groupBy("video_id").applyInPandasWithState(fold, SCENE, STATE, "append", GroupStateTimeout.NoTimeout)
