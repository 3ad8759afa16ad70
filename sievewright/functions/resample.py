"""Resampling of pictures as products with rows of weights, and what is done to pixels around it.

A picture is an array (height, width, channels). Resizing is separable: a matrix of weights for the lines, one for the
columns. Each row of a matrix belongs to a pixel of the result and is 0 but for the few pixels that it is made from.
"""

from __future__ import annotations

import functools
import math

import numpy as np


def _triangle(x: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, 1.0 - np.abs(x))


def _lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


#: Kernels with the distance, in pixels of the coarser side, from which they are 0.
KERNELS = {"bilinear": (_triangle, 1.0), "lanczos": (_lanczos, 3.0)}


@functools.lru_cache(256)
def weights(size: int, target: int, kind: str) -> np.ndarray:
    """A (target, size) matrix whose rows sum to 1.

    ``area``: how much of a pixel's stretch each source pixel covers. Others: the kernel around the pixel's middle,
    wider by the reduction where there is one, with the weights beyond an edge shared out over those inside.
    """
    scale = size / target
    places = np.arange(size)
    if kind == "area":
        low, high = np.arange(target)[:, None] * scale, (np.arange(target)[:, None] + 1) * scale
        out = np.clip(np.minimum(high, places + 1) - np.maximum(low, places), 0, None)
    else:
        kernel, reach = KERNELS[kind]
        wide = max(scale, 1.0)
        middle = (np.arange(target)[:, None] + 0.5) * scale
        inside = (places + 0.5 > middle - reach * wide) & (places + 0.5 < middle + reach * wide)
        out = np.where(inside, kernel((places + 0.5 - middle) / wide), 0.0)
    return out / out.sum(1, keepdims=True)


def resize(picture: np.ndarray, height: int, width: int, kind: str, whole: bool = False) -> np.ndarray:
    """The picture at another size, columns first; ``whole`` keeps to whole levels from 0 to 255 after either pass."""
    level = (lambda x: np.clip(np.floor(x + 0.5), 0, 255)) if whole else (lambda x: x)
    across = level(np.einsum("yxc,wx->ywc", picture, weights(picture.shape[1], width, kind)))
    return level(np.einsum("yxc,hy->hxc", across, weights(picture.shape[0], height, kind)))


def shorter_side(height: int, width: int, side: int) -> tuple[int, int]:
    """Height and width with the shorter one at ``side``, the other in proportion, cut to a whole number."""
    return (side, int(side * width / height)) if height <= width else (int(side * height / width), side)


def centre(picture: np.ndarray, side: int) -> np.ndarray:
    """The square in the middle; halves go to the even place. Pictures that are too small are padded with 0."""
    missing = [max(0, side - n) for n in picture.shape[:2]]
    if any(missing):
        picture = np.pad(picture, [*((m // 2, m - m // 2) for m in missing), (0, 0)])
    top, left = (round((n - side) / 2) for n in picture.shape[:2])
    return picture[top : top + side, left : left + side]


def rotate(picture: np.ndarray, degrees: float) -> np.ndarray:
    """Turned counter-clockwise around the middle: every pixel asks where it came from and takes the nearest; 0 from outside."""
    height, width = picture.shape[:2]
    y, x = np.mgrid[0:height, 0:width] + 0.5
    y, x = y - height / 2, x - width / 2
    turn = math.radians(degrees)
    from_x = np.floor(math.cos(turn) * x - math.sin(turn) * y + width / 2).astype(int)
    from_y = np.floor(math.sin(turn) * x + math.cos(turn) * y + height / 2).astype(int)
    there = (from_x >= 0) & (from_x < width) & (from_y >= 0) & (from_y < height)
    return np.where(there[..., None], picture[np.clip(from_y, 0, height - 1), np.clip(from_x, 0, width - 1)], 0.0)


def low_frequencies(grey: np.ndarray, keep: int) -> np.ndarray:
    """The keep * keep lowest coefficients of the orthonormal cosine transform of a square."""
    n = len(grey)
    waves = np.cos(np.pi * (2 * np.arange(n) + 1) * np.arange(keep)[:, None] / (2 * n)) * np.sqrt(2 / n)
    waves[0] *= math.sqrt(0.5)
    return waves @ grey @ waves.T


def median_bits(values: np.ndarray) -> int:
    """One bit a value, the first one highest: whether it lies above the median."""
    return int("".join("1" if x else "0" for x in values > np.median(values)), 2)
