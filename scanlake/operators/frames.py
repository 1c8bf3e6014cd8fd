"""Frames in packed form: one row per frame with its bytes (frame_id, height, width, n_channels, data).

Nothing is shuffled here: numpy works on one frame at a time inside the tasks that read it. 16-bit frames are little-endian
and recognised by their length; channels are in blue, green, red order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of an image that go out in one batch; keeps batches small for large frames.
LINES_PER_BATCH = 256


def as_array(data: bytes, height: int, width: int, n_channels: int) -> np.ndarray:
    """Frame bytes as height x width x channels."""
    wide = len(data) == 2 * height * width * n_channels
    return np.frombuffer(data, dtype="<u2" if wide else np.uint8).reshape(height, width, n_channels)


def explode_pixels(frames: DataFrame) -> DataFrame:
    """One row per pixel and channel: frame_id, r, c, ch, v."""
    key = frames.schema["frame_id"].dataType.simpleString()

    def pixels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                image = as_array(row.data, row.height, row.width, row.n_channels)
                for top in range(0, row.height, LINES_PER_BATCH):
                    part = image[top : top + LINES_PER_BATCH]
                    r, c, ch = np.indices(part.shape, dtype=np.int32).reshape(3, -1)
                    yield pd.DataFrame({"frame_id": row.frame_id, "r": r + top, "c": c, "ch": ch, "v": part.reshape(-1).astype(np.int32)})

    return frames.select("frame_id", "height", "width", "n_channels", "data").mapInPandas(
        pixels, f"frame_id {key}, r int, c int, ch int, v int"
    )


def colour_pixels(channel_rows: DataFrame) -> DataFrame:
    """Channel rows as one row per pixel with blue, green and red."""
    picks = [F.max(F.when(F.col("ch") == k, F.col("v"))).alias(name) for k, name in enumerate(("blue", "green", "red"))]
    return channel_rows.groupBy("frame_id", "r", "c").agg(*picks)


def frame_fn(frames: DataFrame, fn: Callable[[np.ndarray], float | None], out: str = "metric") -> DataFrame:
    """Apply a function of the image array to every frame: frame_id and its value."""
    key = frames.schema["frame_id"].dataType.simpleString()

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values = [fn(as_array(r.data, r.height, r.width, r.n_channels)) for r in pdf.itertuples(index=False)]
            yield pd.DataFrame({"frame_id": pdf["frame_id"], out: pd.Series(values, dtype="float64", index=pdf.index)})

    return frames.select("frame_id", "height", "width", "n_channels", "data").mapInPandas(apply, f"frame_id {key}, {out} double")


def gray_of(image: np.ndarray) -> np.ndarray:
    """Gray plane of an image, the luma of its colours when it has three channels."""
    if image.shape[2] == 1:
        return image[:, :, 0].astype(np.int64)
    blue, green, red = (image[:, :, k].astype(np.int64) for k in range(3))
    return (9798 * red + 19235 * green + 3735 * blue + 16384) >> 15


def _mirror_pad(plane: np.ndarray) -> np.ndarray:
    """One pixel more on each side, mirrored without repeating the edge; a single line is repeated."""
    for axis, n in enumerate(plane.shape):
        width = [(1, 1) if a == axis else (0, 0) for a in (0, 1)]
        plane = np.pad(plane, width, mode="reflect" if n > 1 else "edge")
    return plane


def _laplacian(plane: np.ndarray) -> float:
    p = _mirror_pad(plane)
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * plane).var())


def _tenengrad(plane: np.ndarray) -> float:
    p = _mirror_pad(plane)
    across = p[:, 2:] - p[:, :-2]
    along = p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    gx = across[:-2] + 2 * across[1:-1] + across[2:]
    gy = along[2:] - along[:-2]
    return float((gx**2 + gy**2).mean())


PLANE_METRICS: dict[str, Callable[[np.ndarray], float]] = {
    "LaplacianVariance": _laplacian,
    "Tenengrad": _tenengrad,
    "Brightness": lambda plane: float(plane.mean()),
    "ImageVariance": lambda plane: float(plane.var()),
}


def frame_metric(frames: DataFrame, name: str = "LaplacianVariance", shrink: int = 1) -> DataFrame:
    """Focus metric of packed frames, the same numbers as the pixel form gives. ``shrink`` averages blocks first, those at the far edges over the pixels they have."""
    if name not in PLANE_METRICS:
        raise ValueError(f"unknown metric {name!r}, known: {sorted(PLANE_METRICS)}")
    metric = PLANE_METRICS[name]

    def score(image: np.ndarray) -> float:
        plane = gray_of(image)
        if shrink > 1:
            rows, cols = (np.arange(0, n, shrink) for n in plane.shape)
            total = np.add.reduceat(np.add.reduceat(plane.astype(float), rows, axis=0), cols, axis=1)
            sizes = [np.diff(np.append(at, n)) for at, n in zip((rows, cols), plane.shape)]
            plane = total / np.outer(*sizes)
        return metric(plane)

    return frame_fn(frames, score)
