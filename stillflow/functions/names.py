"""Names of still files: the name is the key that ties a file to its frame."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of files that count as videos.
VIDEO_EXTENSIONS = (".mp4", ".mkv", ".mov", ".avi", ".webm", ".m4v", ".mpg", ".mpeg", ".ts", ".m2ts", ".mts", ".wmv", ".flv", ".3gp")
UPSCALED = "_upscaled"
_STILL = r"(?i)_s(\d+)_f(\d+)(?:_seed(\d+))?"


def still_name(stem: Column, scene: Column, frame: Column, seed: Column | None = None) -> Column:
    """stem (32 characters at most)_s000_f000000[_seed0].png; without a scene, _sxxx, which parse_still_name cannot read back."""
    scene_part = F.when(scene.isNotNull(), F.format_string("%03d", scene)).otherwise("xxx")
    parts = [F.left(stem, F.lit(32)), F.lit("_s"), scene_part, F.lit("_f"), F.format_string("%06d", frame)]
    if seed is not None:
        parts.append(F.when(seed.isNotNull(), F.concat(F.lit("_seed"), seed.cast("string"))).otherwise(""))
    return F.concat(*parts, F.lit(".png"))


def parse_still_name(name: Column) -> Column:
    """struct(scene, frame, seed) of the first match in a name, nulls where there is none."""
    part = lambda k: F.regexp_extract(name, _STILL, k).try_cast("int")
    return F.struct(part(1).alias("scene"), part(2).alias("frame"), part(3).alias("seed"))


def upscaled_name(name: Column) -> Column:
    return F.regexp_replace(name, r"\.([^.]*)$", UPSCALED + ".$1")


def is_upscaled(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "").endswith(UPSCALED)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]*$", 0))


def is_video(path: Column) -> Column:
    return extension(path).isin(*VIDEO_EXTENSIONS)
