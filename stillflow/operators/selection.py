"""Choosing frames: safe windows, weak frames, quotas, gaps, time slices, interval picks, and the ordered pick of scenes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Options:
    """How frames are chosen; a limit of 0 for luma or highlights turns that test off."""

    fps: float
    window: int = 5
    seconds_per_still: float = 4.0
    per_scene_max: int = 8
    hash_distance: int = 8
    min_gap_s: float = 0.4
    gap_fraction: float = 0.2
    min_sharpness_frac: float = 0.35
    min_luma: float = 24.0
    max_highlight_frac: float = 0.20

    def __post_init__(self):
        if self.window < 5 or self.window % 4 != 1:
            raise ValueError("window must be 4 n + 1 and 5 at least")

    @property
    def half(self) -> int:
        return self.window // 2

    @property
    def min_gap(self) -> int:
        return round(self.min_gap_s * self.fps)


def check_interval(interval: float) -> float:
    """An interval in seconds, to one decimal: 0.1 at least, and a multiple of it."""
    tenths = round(interval * 10)
    if interval < 0.1 - 1e-9 or abs(interval * 10 - tenths) > 1e-5:
        raise ValueError("interval must be 0.1 s or a multiple of it")
    return tenths / 10


def _scene():
    """Frames of a scene: partitioned by video they are together already, so such windows cost no shuffle."""
    return Window.partitionBy("video_id", "scene")


def with_span(frames: DataFrame, half: int) -> DataFrame:
    """frames (with pos and scene) and lo, hi: the positions of their scene whose window fits it; safe: is theirs one?"""
    spans = frames.withColumns({"lo": F.min("pos").over(_scene()) + half, "hi": F.max("pos").over(_scene()) - half})
    return spans.withColumn("safe", F.col("pos").between(F.col("lo"), F.col("hi")))


def judge_frames(frames: DataFrame, o: Options) -> DataFrame:
    """frames (with pos and scene) and lo, hi, safe (as with_span), weak: dark, blown or soft, the first that holds, null for none.

    Soft is judged against the best of the whole scene, weak frames and those near cuts included.
    """
    known = with_span(frames, o.half).withColumn("_best", F.max("sharpness").over(_scene()))
    weak = F.when(F.lit(o.min_luma > 0) & (F.coalesce("luma", F.lit(255.0)) < o.min_luma), "dark")
    weak = weak.when(F.lit(o.max_highlight_frac > 0) & (F.coalesce("highlight_frac", F.lit(0.0)) > o.max_highlight_frac), "blown")
    weak = weak.when(F.col("sharpness") < F.col("_best") * o.min_sharpness_frac, "soft")
    return known.withColumn("weak", weak).drop("_best")


def eligible(judged: DataFrame) -> DataFrame:
    return judged.filter("safe and weak is null")


def weak_counts(judged: DataFrame) -> DataFrame:
    """For each video, how many safe frames were turned down for what, and how many were not."""
    n = lambda c: F.count_if(F.col("safe") & c)
    return judged.groupBy("video_id").agg(
        n(F.col("weak").eqNullSafe("dark")).alias("too_dark"), n(F.col("weak").eqNullSafe("blown")).alias("blown_highlights"), n(F.col("weak").eqNullSafe("soft")).alias("too_soft"), n(F.col("weak").isNull()).alias("eligible_frames")
    )


def with_quota(judged: DataFrame, o: Options) -> DataFrame:
    """judged and, of their scenes, n_eligible, quota (one still for so many seconds, half to even, 1 to per_scene_max; null
    without an eligible frame) and gap: frames that picks of the scene keep apart."""
    counted = judged.withColumn("n_eligible", F.count_if(F.col("safe") & F.col("weak").isNull()).over(_scene()).cast("int"))
    room = F.col("hi") - F.col("lo") + 1
    want = F.bround((room + 2 * o.half) / o.fps / o.seconds_per_still).cast("int") if o.seconds_per_still > 0 else F.lit(1)
    quota = F.when(F.col("n_eligible") > 0, F.greatest(F.lit(1), F.least(want, F.lit(o.per_scene_max), "n_eligible")))
    gap = F.greatest(F.lit(o.min_gap), F.floor(F.lit(o.gap_fraction) * room / F.col("quota")).cast("int"))
    return counted.withColumn("quota", quota).withColumn("gap", F.when(F.col("quota").isNotNull(), gap))


def scene_quota(judged: DataFrame, o: Options) -> DataFrame:
    """video_id, scene, quota, n_eligible of scenes with an eligible frame."""
    return scene_gap(judged, o).select("video_id", "scene", "quota", "n_eligible")


def scene_gap(judged: DataFrame, o: Options) -> DataFrame:
    """video_id, scene, quota, n_eligible, lo, hi, gap of scenes with an eligible frame."""
    facts = ("quota", "n_eligible", "lo", "hi", "gap")
    return with_quota(judged, o).filter("quota is not null").groupBy("video_id", "scene").agg(*(F.first(c).alias(c) for c in facts))


def slice_candidates(judged: DataFrame, o: Options) -> DataFrame:
    """Eligible frames in the time slices of their scenes: slice (from 0), rank by sharpness (ties: the earlier frame)."""
    span, place = F.col("hi") - F.col("lo") + 1, F.col("pos") - F.col("lo")
    # The slice k with lo + k * span div quota <= pos: the last one that begins at or before it.
    sliced = eligible(with_quota(judged, o)).withColumn("slice", F.floor(((place + 1) * F.col("quota") - 1) / span).cast("int"))
    order = Window.partitionBy("video_id", "scene", "slice").orderBy(F.desc("sharpness"), "i")
    return sliced.withColumn("rank", F.row_number().over(order))


def select_interval(frames: DataFrame, interval: float, window: int = 5) -> DataFrame:
    """The sharpest frame of every interval that has any (ties: the first); frames (with pos and scene) whose window fits their scene come first.

    unsafe: the interval had none of these.
    """
    half, interval = window // 2, check_interval(interval)
    bucket = F.floor(F.col("t") / interval + 1e-9).cast("int")
    best = F.max_by(F.struct("i", "t", "scene", "sharpness", "dhash", "safe"), F.struct("safe", "sharpness", -F.col("pos")))
    picks = with_span(frames, half).groupBy("video_id", bucket.alias("bucket")).agg(best.alias("p"))
    return picks.select("video_id", "bucket", F.col("p.i").alias("frame"), "p.t", "p.scene", "p.sharpness", "p.dhash", (~F.col("p.safe")).alias("unsafe"), F.array(F.col("p.i") - half, F.col("p.i") + half).alias("window"))


PICKS = "video_id long, frame int, t double, scene int, sharpness double, dhash long, filled boolean, window array<int>"


def pick_in_order(rows: pd.DataFrame, o: Options, by_frame_number: bool = False) -> pd.DataFrame:
    """One video's picks from its candidates (eligible frames with quota, lo, hi, gap of their scenes).

    Scene by scene and slice by slice the sharpest frame is taken that keeps its distance, in frames and in hash bits, from
    every pick so far; then scenes that came short take the frame farthest in time from all picks, the sharper on ties.
    by_frame_number: slices hold frames by number instead of position, as matters where only segments were scanned.
    """
    rows = rows.sort_values("pos", kind="stable").reset_index(drop=True)
    i, scene, sharp = rows["i"].to_numpy(np.int64), rows["scene"].to_numpy(), rows["sharpness"].to_numpy()
    bits = rows["dhash"].to_numpy(np.int64).view(np.uint64)
    gap, place = rows["gap"].to_numpy(), rows["i" if by_frame_number else "pos"].to_numpy()
    far = np.full(len(rows), np.iinfo(np.int64).max)  # frames to the nearest pick
    fine = np.ones(len(rows), bool)  # keeps its distance from all picks
    chosen: list[int] = []

    def take(k: int) -> None:
        away = np.abs(i - i[k])
        near = np.where(scene == scene[k], away < gap, away < o.min_gap)
        fine[near | (np.bitwise_count(bits ^ bits[k]) < o.hash_distance) | (np.arange(len(i)) == k)] = False
        np.minimum(far, away, out=far)
        chosen.append(k)

    have: dict[int, int] = {}
    groups = {s: np.flatnonzero(scene == s) for s in sorted(set(scene))}
    facts = {s: tuple(int(rows[c].iat[g[0]]) for c in ("quota", "lo", "hi")) for s, g in groups.items()}
    for s, own in groups.items():
        quota, lo, hi = facts[s]
        span = hi - lo + 1
        have[s] = 0
        for k in range(quota):
            begin, end = lo + k * span // quota, lo + (k + 1) * span // quota
            inside = own[(place[own] >= begin) & (place[own] < end)]
            inside = inside[fine[inside]]
            if len(inside):
                take(int(inside[np.argmax(sharp[inside])]))
                have[s] += 1
    first = len(chosen)
    for s, own in groups.items():
        while have[s] < facts[s][0]:
            left = own[fine[own]]
            if not len(left):
                break
            distance = far[left] if chosen else np.zeros(len(left), np.int64)
            best = left[distance == distance.max()]
            take(int(best[np.argmax(sharp[best])]))
            have[s] += 1
    order = sorted(range(len(chosen)), key=lambda x: i[chosen[x]])
    picked = rows.iloc[[chosen[x] for x in order]]
    out = picked[["video_id", "i", "t", "scene", "sharpness", "dhash"]].rename(columns={"i": "frame"})
    out["filled"] = [x >= first for x in order]
    out["window"] = [[int(f) - o.half, int(f) + o.half] for f in out["frame"]]
    return out


def select_scene(judged: DataFrame, o: Options, by_frame_number: bool = False) -> DataFrame:
    """Picks of every video: quotas and gaps in the plan, the ordered part video by video over eligible metric rows only."""
    rows = eligible(with_quota(judged, o)).select("video_id", "i", "t", "pos", "scene", "sharpness", "dhash", "quota", "lo", "hi", "gap")
    return rows.groupBy("video_id").applyInPandas(lambda pdf: pick_in_order(pdf, o, by_frame_number), PICKS)


def select_stats(judged: DataFrame, o: Options) -> DataFrame:
    """For each video: eligible frames, stills wanted, scenes without an eligible frame (sorted)."""
    every = with_quota(judged, o).groupBy("video_id", "scene").agg(F.first("quota").alias("quota"), F.first("n_eligible").alias("n_eligible"))
    return every.groupBy("video_id").agg(
        F.sum("n_eligible").alias("eligible_frames"), F.sum(F.coalesce("quota", F.lit(0))).alias("wanted"), F.array_sort(F.collect_list(F.when(F.col("quota").isNull(), F.col("scene")))).alias("scenes_unusable")
    )


def closest_pairs(picks: DataFrame) -> DataFrame:
    """For each video of picks (video_id, frame, dhash) with two or more, the pair that differs in the fewest hash bits: d, fa, fb (ties: the first frames)."""

    def least(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame", kind="stable")
        frame, bits, best = pdf["frame"].to_numpy(), pdf["dhash"].to_numpy(np.int64).view(np.uint64), None
        for k in range(len(bits) - 1):  # one row of pairs at a time, none kept
            away = np.bitwise_count(bits[k + 1 :] ^ bits[k])
            j = int(away.argmin())
            if best is None or int(away[j]) < best[0]:
                best = (int(away[j]), int(frame[k]), int(frame[k + 1 + j]))
        return pd.DataFrame([] if best is None else [(pdf["video_id"].iloc[0], *best)], columns=["video_id", "d", "fa", "fb"])

    kind = picks.schema["video_id"].dataType.simpleString()
    return picks.select("video_id", "frame", "dhash").groupBy("video_id").applyInPandas(least, f"video_id {kind}, d int, fa int, fb int")
