"""Picture measures: numpy kernels for decoded frames, and column expressions for small pictures kept as arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column

HIGHLIGHT = 230
WORK_WIDTH = 256


def to_gray(bgr: np.ndarray) -> np.ndarray:
    """8-bit brightness of blue-green-red pixels."""
    b, g, r = (bgr[..., k].astype(np.float64) for k in range(3))
    return np.floor(0.299 * r + 0.587 * g + 0.114 * b + 0.5).astype(np.uint8)


def crop(image: np.ndarray, box: tuple[int, int, int, int] | None) -> np.ndarray:
    """The part of a picture in a box of x, y, width, height."""
    if box is None:
        return image
    x, y, w, h = box
    return image[y : y + h, x : x + w]


def laplacian_variance(gray: np.ndarray) -> float:
    """Population variance of the four-neighbour Laplacian; the border mirrors without repeating its edge. Exact for whole numbers but for one rounding."""
    wide = np.pad(gray.astype(np.int64), 1, mode="reflect" if min(gray.shape) > 1 else "edge")
    edge = wide[:-2, 1:-1] + wide[2:, 1:-1] + wide[1:-1, :-2] + wide[1:-1, 2:] - 4 * wide[1:-1, 1:-1]
    n, total, squares = edge.size, int(edge.sum()), int((edge * edge).sum())
    return (n * squares - total * total) / (n * n)


def to_hsv(bgr: np.ndarray) -> np.ndarray:
    """Hue 0 to 179, saturation and value 0 to 255."""
    b, g, r = (bgr[..., k].astype(np.float64) for k in range(3))
    v, low = np.maximum(np.maximum(b, g), r), np.minimum(np.minimum(b, g), r)
    span = v - low
    safe = np.where(span == 0, 1, span)
    hue = np.select([v == r, v == g], [60 * (g - b) / safe, 120 + 60 * (b - r) / safe], 240 + 60 * (r - g) / safe)
    hue = np.where(span == 0, 0, hue % 360) / 2
    return np.stack([np.round(hue) % 180, np.round(np.where(v == 0, 0, 255 * span / np.where(v == 0, 1, v))), v], -1)


def scene_score(before: np.ndarray, now: np.ndarray) -> float:
    """Mean of the mean changes of hue (around the circle), saturation and value."""
    change = np.abs(before.astype(np.float64) - now)
    change[..., 0] = np.minimum(change[..., 0], 180 - change[..., 0])
    return float(change.reshape(-1, 3).mean(0).mean())


def area_sums(gray: np.ndarray, width: int, height: int) -> np.ndarray:
    """For each target pixel the sum of the source area that it covers, in parts of a pixel: whole numbers, so that equal areas are equal."""

    def parts(n: int, m: int) -> np.ndarray:
        """m parts to a source pixel, n to a target pixel: how many each pair shares."""
        cell, target = np.arange(n), np.arange(m)[:, None]
        return np.clip(np.minimum((target + 1) * n, (cell + 1) * m) - np.maximum(target * n, cell * m), 0, None)

    return parts(gray.shape[0], height) @ gray.astype(np.int64) @ parts(gray.shape[1], width).T


def area_resize(gray: np.ndarray, width: int, height: int) -> np.ndarray:
    """Each target pixel is the mean of the source area that it covers."""
    return area_sums(gray, width, height) / (gray.shape[0] * gray.shape[1])


def work_size(width: int, height: int) -> tuple[int, int]:
    """Size of the small picture for scores and hashes: 256 wide at most, fractions cut, 1 at least."""
    scale = min(1.0, WORK_WIDTH / width)
    return max(1, int(width * scale)), max(1, int(height * scale))


def bilinear_resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    def grid(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), at - low

    y0, y1, fy = grid(image.shape[0], height)
    x0, x1, fx = grid(image.shape[1], width)
    fy, fx = fy.reshape(-1, 1, *[1] * (image.ndim - 2)), fx.reshape(1, -1, *[1] * (image.ndim - 2))
    rows = image[y0] * (1 - fy) + image[y1] * fy
    return np.floor(rows[:, x0] * (1 - fx) + rows[:, x1] * fx + 0.5).astype(image.dtype)


def difference_hash(gray: np.ndarray, size: int = 8) -> str:
    """Hex of size * size bits: is each cell of a small picture brighter than the one to its left? Row by row, first bit on top."""
    small = area_sums(gray, size + 1, size)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def content_box(projection: np.ndarray, threshold: int = 16) -> tuple[int, int, int, int]:
    """x, y, width, height of what exceeds the threshold; all of it if nothing does."""
    lit = projection > threshold
    if not lit.any():
        return 0, 0, projection.shape[1], projection.shape[0]
    x, y = np.flatnonzero(lit.any(0)), np.flatnonzero(lit.any(1))
    return int(x[0]), int(y[0]), int(x[-1] - x[0] + 1), int(y[-1] - y[0] + 1)


def matte_percent(box_width: Column, box_height: Column, width: Column, height: Column) -> Column:
    """The share of a frame outside its content box, in percent."""
    return 100 * (1 - box_width.cast("double") * box_height / (width * height))
