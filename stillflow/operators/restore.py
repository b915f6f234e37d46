"""Windows of frames around picks, and restorers that turn a window into one still."""

from __future__ import annotations

import importlib
from functools import lru_cache
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillflow.functions.pixels import bilinear_resize


def restore_windows(picks: DataFrame, frames: DataFrame, values: list[str], window: int = 5) -> DataFrame:
    """picks (video_id, frame) and members: the frames i - half .. i + half in order, with values; complete: none is missing.

    Windows are spread into frame numbers, so this is an equi-join, not a range join.
    """
    half = window // 2
    wanted = picks.select("video_id", "frame", F.explode(F.sequence(F.col("frame") - half, F.col("frame") + half)).alias("i"))
    found = wanted.join(frames.select("video_id", "i", *values), ["video_id", "i"], "left")
    present = F.when(F.col(values[0]).isNotNull(), F.struct("i", *values))
    return found.groupBy("video_id", "frame").agg(F.array_sort(F.collect_list(present)).alias("members")).withColumn("complete", F.size("members") == window)


#: What restorers that sample start from, and the parameters of such with their defaults.
SEED = 42
PARAMETERS = {"resolution": 1080, "cfg_scale": 1.0, "input_noise_scale": 0.0, "latent_noise_scale": 0.0, "color_correction": "lab"}


class Restorer(Protocol):
    """Turns frames [T, height, width, 3] of 8-bit values into one picture; unknown parameters are a TypeError.

    takes_seed: whether seed is one of them, and stills of different seeds differ. defaults: what holds where nothing is said.
    """

    takes_seed: bool
    defaults: dict

    def restore(self, frames: np.ndarray, **parameters) -> np.ndarray: ...


def check_window(frames: np.ndarray) -> np.ndarray:
    if frames.dtype != np.uint8 or frames.ndim != 4 or frames.shape[-1] != 3:
        raise ValueError("frames must be 8-bit [T, height, width, 3]")
    if len(frames) < 5 or len(frames) % 4 != 1:
        raise ValueError("a window has 4 n + 1 frames, 5 at least")
    return frames


class _Plain:
    """Restorers without a model: one picture of the window's values, its short side resolution pixels long if asked for."""

    takes_seed = False
    defaults: dict = {}

    def restore(self, frames: np.ndarray, resolution: int | None = None) -> np.ndarray:
        picture = self.merge(check_window(frames))
        if resolution is None:
            return picture
        height, width = picture.shape[:2]
        scale = resolution / min(height, width)
        return bilinear_resize(picture, max(1, round(width * scale)), max(1, round(height * scale)))


class Centre(_Plain):
    """The middle frame as it is."""

    def merge(self, frames: np.ndarray) -> np.ndarray:
        return frames[len(frames) // 2]


class Mean(_Plain):
    def merge(self, frames: np.ndarray) -> np.ndarray:
        return np.floor(frames.mean(0) + 0.5).astype(np.uint8)


class Median(_Plain):
    def merge(self, frames: np.ndarray) -> np.ndarray:
        return np.median(frames, 0).astype(np.uint8)


class External:
    """Stands where a model of one's own is configured: factory (with options) makes it, once a worker, which then stays warm.

    factory: a callable, or the text module:name of one.
    """

    takes_seed = True
    defaults = PARAMETERS

    def __init__(self, factory=None, **options):
        self.factory, self.options, self.model = factory, options, None

    def __getstate__(self):
        return {"factory": self.factory, "options": self.options, "model": None}

    def _made(self):
        if self.factory is None:
            raise RuntimeError("no restoration model is configured: pass a factory that returns one")
        if self.model is None:
            factory = self.factory
            if isinstance(factory, str):
                module, _, name = factory.partition(":")
                factory = getattr(importlib.import_module(module), name)
            self.model = _warm(factory, tuple(sorted(self.options.items())))
        return self.model

    def restore(self, frames: np.ndarray, **parameters) -> np.ndarray:
        unknown = set(parameters) - set(PARAMETERS) - {"seed"}
        if unknown:
            raise TypeError(f"unknown parameters: {', '.join(sorted(unknown))}")
        return self._made().restore(check_window(frames), **{**PARAMETERS, "seed": SEED, **parameters})


@lru_cache(1)
def _warm(factory, options: tuple):
    """A worker's model: made at its first window, kept for all that follow."""
    return factory(**dict(options))
