"""Packed forms of the grid operators: numpy on one whole frame at a time, where the frame is read, without a shuffle.

``plane_fn`` turns packed frames into planes (frame_id, height, width, values), ``values`` in reading order; planes can go through
further functions, and ``plane_pixels`` gives them as pixel rows. Results equal those of the long forms in ``grid`` and ``marks``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlake.operators import frames as packed
from scanlake.operators import grid

Plane = Callable[[np.ndarray], np.ndarray]


def plane_fn(frames: DataFrame, *steps: Plane) -> DataFrame:
    """Planes of packed frames (their gray values) or of planes after the given steps."""
    key = frames.schema["frame_id"].dataType.simpleString()
    raw = "values" not in frames.columns

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                plane = packed.gray_of(packed.as_array(row.data, row.height, row.width, row.n_channels)) if raw else np.asarray(row.values).reshape(row.height, row.width)
                for step in steps:
                    plane = step(plane)
                yield pd.DataFrame({"frame_id": [row.frame_id], "height": [plane.shape[0]], "width": [plane.shape[1]], "values": [plane.astype(float).ravel()]})

    columns = ("frame_id", "height", "width", "n_channels", "data") if raw else ("frame_id", "height", "width", "values")
    return frames.select(*columns).mapInPandas(apply, f"frame_id {key}, height int, width int, values array<double>")


def plane_pixels(planes: DataFrame, kind: str = "double") -> DataFrame:
    """Pixel rows (frame_id, r, c, v) of planes."""
    cells = planes.select("frame_id", "width", F.posexplode("values").alias("_p", "v"))
    return cells.select("frame_id", F.floor(F.col("_p") / F.col("width")).cast("int").alias("r"), (F.col("_p") % F.col("width")).cast("int").alias("c"), F.col("v").cast(kind).alias("v"))


def _slide(plane: np.ndarray, best: np.ufunc, k: int, axis: int) -> np.ndarray:
    """Best value of the k places round each one that lie inside the plane."""
    out, n = plane.copy(), plane.shape[axis]
    for shift in range(-(k // 2), k - k // 2):
        here, there = [slice(None)] * 2, [slice(None)] * 2
        here[axis], there[axis] = slice(max(0, -shift), min(n, n - shift)), slice(max(0, shift), min(n, n + shift))
        out[tuple(here)] = best(out[tuple(here)], plane[tuple(there)])
    return out


def dilate(kh: int = 3, kw: int = 3) -> Plane:
    return lambda plane: _slide(_slide(plane, np.maximum, kw, 1), np.maximum, kh, 0)


def erode(kh: int = 3, kw: int = 3) -> Plane:
    return lambda plane: _slide(_slide(plane, np.minimum, kw, 1), np.minimum, kh, 0)


def opening(kh: int = 3, kw: int = 3) -> Plane:
    return lambda plane: dilate(kh, kw)(erode(kh, kw)(plane))


def above(threshold: float) -> Plane:
    """255 above the threshold, else 0."""
    return lambda plane: np.where(plane > threshold, 255, 0)


def otsu(plane: np.ndarray) -> np.ndarray:
    """255 above the threshold with the largest between-class variance, else 0; the first maximum wins."""
    levels, n = np.unique(plane, return_counts=True)
    w0, s0 = np.cumsum(n.astype(float)), np.cumsum((n * levels).astype(float))
    gap, w1 = s0[-1] * w0 - w0[-1] * s0, w0[-1] - w0
    between = np.divide(gap * gap, w0 * w1, out=np.zeros(len(w0)), where=w1 > 0)
    return above(levels[int(np.argmax(between))])(plane)


def stencil(kernel: Sequence[Sequence[int]]) -> Plane:
    """A 3x3 kernel; beyond the border the plane is mirrored without repeating the edge."""

    def apply(plane: np.ndarray) -> np.ndarray:
        wide = plane
        for axis in (0, 1):
            mode = "reflect" if plane.shape[axis] > 1 else "edge"
            wide = np.pad(wide, [(1, 1) if a == axis else (0, 0) for a in (0, 1)], mode=mode)
        h, w = plane.shape
        return sum(weight * wide[j : j + h, i : i + w] for j, row in enumerate(kernel) for i, weight in enumerate(row) if weight)

    return apply


def downsample(s: int) -> Plane:
    """Mean of each s x s block; blocks at the far edges have the pixels that are there."""

    def apply(plane: np.ndarray) -> np.ndarray:
        rows, cols = (np.arange(0, n, s) for n in plane.shape)
        total = np.add.reduceat(np.add.reduceat(plane.astype(float), rows, axis=0), cols, axis=1)
        return total / np.outer(*[np.diff(np.append(at, n)) for at, n in zip((rows, cols), plane.shape)])

    return apply


def gaussian(sigma: float) -> Plane:
    """Separable blur with mirrored borders, as ``grid.gaussian_blur``."""
    weights = np.array(grid.gaussian_weights(sigma))

    def apply(plane: np.ndarray) -> np.ndarray:
        out = plane.astype(float)
        for axis in (1, 0):
            n = out.shape[axis]
            period = max(1, 2 * (n - 1))
            total = np.zeros_like(out)
            for k, weight in enumerate(weights):
                q = (np.arange(n) + k - len(weights) // 2) % period
                total += weight * np.take(out, np.minimum(q, 0 if n == 1 else period - q), axis=axis)
            out = total
        return out

    return apply
