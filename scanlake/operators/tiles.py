"""Full-size frames in parts: tiles with what they need of their neighbours, numpy on one tile at a time.

A tile row is (frame_id, height, width, ch, tr, tc, kind, data): the frame's size, the channel, the tile's place in units of tiles, and
its values in reading order as bytes of the numpy type ``kind``. Tiles at the far edges are smaller. Further columns of the frames stay.
Results equal those of the long forms in ``grid`` and ``pixels``.
"""

from __future__ import annotations

import math
import zlib
from collections import deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlake.operators import frames as packed
from scanlake.operators import grid, ordered
from scanlake.operators.ordered import HALO, SLICE
from scanlake.operators.planes import Plane

SIDE = (256, 256)
PLACE = ("tr", "tc")
KEYS = ("frame_id", "ch", *PLACE)
#: Bytes of counts a task holds before it sends them on.
COUNT_BYTES = 64_000_000


def values_of(row, side: Sequence[int]) -> np.ndarray:
    """The values of a tile row."""
    h, w = min(side[0], row.height - row.tr * side[0]), min(side[1], row.width - row.tc * side[1])
    return np.frombuffer(row.data, row.kind).reshape(h, w)


def _schema(df: DataFrame, *columns: str) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def split(frames: DataFrame, side: Sequence[int] = SIDE, gray: bool = False) -> DataFrame:
    """Tiles of packed frames, all channels or the gray plane, without a shuffle."""
    extra = [c for c in frames.columns if c not in ("frame_id", "height", "width", "n_channels", "data")]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                image = packed.as_array(row.data, row.height, row.width, row.n_channels)
                image = packed.gray_of(image).astype(image.dtype)[:, :, None] if gray else image
                for ch in range(image.shape[2]):
                    for tr in range(math.ceil(row.height / side[0])):
                        line = image[tr * side[0] : (tr + 1) * side[0], :, ch]
                        parts = [np.ascontiguousarray(line[:, c : c + side[1]]).tobytes() for c in range(0, row.width, side[1])]
                        known = {c: [getattr(row, c)] * len(parts) for c in ("frame_id", *extra, "height", "width")}
                        yield pd.DataFrame(known | {"ch": ch, "tr": tr, "tc": range(len(parts)), "kind": image.dtype.str, "data": parts})

    columns = f"{_schema(frames, 'frame_id', *extra, 'height', 'width')}, ch int, tr int, tc int, kind string, data binary"
    return frames.select("frame_id", *extra, "height", "width", "n_channels", "data").mapInPandas(cut, columns)


def pixels(tiles: DataFrame, side: Sequence[int] = SIDE, kind: str = "int", keys: Sequence[str] = ("frame_id", "ch")) -> DataFrame:
    """Pixel rows (keys, r, c, v) of tiles."""
    place = f"{_schema(tiles, *keys)}, r int, c int, v {kind}"

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                plane = values_of(row, side)
                r, c = np.indices(plane.shape, dtype=np.int32).reshape(2, -1)
                known = {k: [getattr(row, k)] * plane.size for k in keys}
                yield pd.DataFrame(known | {"r": r + row.tr * side[0], "c": c + row.tc * side[1], "v": plane.reshape(-1).astype(float if kind == "double" else np.int64)})

    return tiles.select(*dict.fromkeys((*keys, "height", "width", *PLACE, "kind", "data"))).mapInPandas(spread, place)


def _reach(tile: int, side: int, halo: int, end: int) -> range:
    """Tiles along one axis that need a part of this one."""
    last = math.ceil(end / side) - 1
    return range(max(0, (tile * side - halo) // side), min(last, (min((tile + 1) * side, end) - 1 + halo) // side) + 1)


def _window(tile: int, side: int, halo: int, end: int) -> tuple[int, int]:
    """First place and place behind the last one that a tile with its halo covers."""
    return max(0, tile * side - halo), min(end, (tile + 1) * side + halo)


def apply(tiles: DataFrame, *steps: tuple[int, Plane], side: Sequence[int] = SIDE) -> DataFrame:
    """Planes of the frames after all ``steps`` (halo, function of a plane), tile by tile.

    A function sees a tile with as many pixels of its neighbours as all halos together, and its own rule for borders holds at the frame's
    rim alone. One exchange: each tile sends its rims to the neighbours that need them and itself to its own place.
    """
    halo = sum(h for h, _ in steps)
    parts = f"{_schema(tiles, 'frame_id')}, height int, width int, ch int, tr int, tc int, r int, c int, h int, w int, kind string, data binary"

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                plane = values_of(row, side)
                top, left = row.tr * side[0], row.tc * side[1]
                for tr in _reach(row.tr, side[0], halo, row.height):
                    r0, r1 = _window(tr, side[0], halo, row.height)
                    for tc in _reach(row.tc, side[1], halo, row.width):
                        c0, c1 = _window(tc, side[1], halo, row.width)
                        r, c = max(r0, top), max(c0, left)
                        part = plane[r - top : r1 - top, c - left : c1 - left]
                        out.append((row.frame_id, row.height, row.width, row.ch, tr, tc, r, c, *part.shape, row.kind, np.ascontiguousarray(part).tobytes()))
            yield pd.DataFrame(out, columns=["frame_id", "height", "width", "ch", "tr", "tc", "r", "c", "h", "w", "kind", "data"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                (r0, r1), (c0, c1) = _window(row.tr, side[0], halo, row.height), _window(row.tc, side[1], halo, row.width)
                plane = np.zeros((r1 - r0, c1 - c0), row.parts[0]["kind"])
                for p in row.parts:
                    plane[p["r"] - r0 : p["r"] - r0 + p["h"], p["c"] - c0 : p["c"] - c0 + p["w"]] = np.frombuffer(p["data"], p["kind"]).reshape(p["h"], p["w"])
                plane = plane.astype(np.int64) if plane.dtype.kind == "u" else plane
                for _, step in steps:
                    plane = step(plane)
                r, c = row.tr * side[0] - r0, row.tc * side[1] - c0
                plane = np.ascontiguousarray(plane[r : r + side[0], c : c + side[1]][: row.height - row.tr * side[0], : row.width - row.tc * side[1]])
                out.append((row.frame_id, row.height, row.width, row.ch, row.tr, row.tc, plane.dtype.str, plane.tobytes()))
            yield pd.DataFrame(out, columns=["frame_id", "height", "width", "ch", "tr", "tc", "kind", "data"])

    sent = tiles.select("frame_id", "height", "width", "ch", *PLACE, "kind", "data").mapInPandas(send, parts)
    met = sent.groupBy(*KEYS).agg(F.first("height").alias("height"), F.first("width").alias("width"), F.collect_list(F.struct("r", "c", "h", "w", "kind", "data")).alias("parts"))
    return met.mapInPandas(run, f"{_schema(tiles, 'frame_id')}, height int, width int, ch int, tr int, tc int, kind string, data binary")


def stencil(kernel: Sequence[Sequence[int]]) -> tuple[int, Plane]:
    from scanlake.operators import planes

    return 1, planes.stencil(kernel)


def gaussian(sigma: float) -> tuple[int, Plane]:
    from scanlake.operators import planes

    return len(grid.gaussian_weights(sigma)) // 2, planes.gaussian(sigma)


def box(plane_fn: Callable[[int, int], Plane], kh: int, kw: int, passes: int = 1) -> tuple[int, Plane]:
    """A dilation or erosion (one pass) or an opening (two) by a kh x kw box."""
    return passes * (max(kh, kw) // 2), plane_fn(kh, kw)


def equalise(frames: DataFrame, side: Sequence[int], clip: float = 4.0) -> DataFrame:
    """``grid.tile_equalise`` of packed frames with tiles of ``side``: each tile makes its map where it is read, and one exchange brings
    the maps of a tile's neighbours and its values together."""
    tiles = split(frames, side, gray=True)
    parts = f"{_schema(tiles, 'frame_id')}, height int, width int, ch int, tr int, tc int, dr int, dc int, map binary, kind string, data binary"

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                own = grid.equal_map(np.bincount(values_of(row, side).ravel(), minlength=256)[None, :], clip)[0].tobytes()
                for tr in _reach(row.tr, side[0], 1, row.height):
                    for tc in _reach(row.tc, side[1], 1, row.width):
                        home = tr == row.tr and tc == row.tc
                        out.append((row.frame_id, row.height, row.width, row.ch, tr, tc, row.tr - tr, row.tc - tc, own, row.kind, row.data if home else None))
            yield pd.DataFrame(out, columns=["frame_id", "height", "width", "ch", "tr", "tc", "dr", "dc", "map", "kind", "data"])

    def blend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                maps = {(p["dr"], p["dc"]): np.frombuffer(p["map"], "<f8") for p in row.parts}
                last = [math.ceil(row.height / side[0]) - 1, math.ceil(row.width / side[1]) - 1]
                near, share = [], []
                for tile, s, end, n in zip((row.tr, row.tc), side, (row.height, row.width), last):
                    place = (np.arange(tile * s, min((tile + 1) * s, end)) + 0.5) / s - 0.5
                    low = np.floor(place)
                    near.append([np.clip(low + k, 0, n).astype(int) - tile for k in (0, 1)])
                    share.append([1 - (place - low), place - low])
                plane = np.frombuffer(row.data, row.kind).reshape(len(near[0][0]), len(near[1][0])).astype(int)
                total = np.zeros(plane.shape)
                for i in (0, 1):
                    for j in (0, 1):
                        # each row and column reads one neighbour's map
                        value = np.zeros(plane.shape)
                        for dr in np.unique(near[0][i]):
                            for dc in np.unique(near[1][j]):
                                at = np.ix_(near[0][i] == dr, near[1][j] == dc)
                                value[at] = maps[int(dr), int(dc)][plane[at]]
                        total += np.outer(share[0][i], share[1][j]) * value
                data = np.rint(total.clip(0, 255)).astype(np.int32)
                out.append((row.frame_id, row.height, row.width, row.ch, row.tr, row.tc, data.dtype.str, data.tobytes()))
            yield pd.DataFrame(out, columns=["frame_id", "height", "width", "ch", "tr", "tc", "kind", "data"])

    sent = tiles.select("frame_id", "height", "width", "ch", *PLACE, "kind", "data").mapInPandas(send, parts)
    met = sent.groupBy(*KEYS).agg(
        F.first("height").alias("height"), F.first("width").alias("width"), F.first("kind").alias("kind"), F.max("data").alias("data"), F.collect_list(F.struct("dr", "dc", "map")).alias("parts")
    )
    return met.mapInPandas(blend, f"{_schema(tiles, 'frame_id')}, height int, width int, ch int, tr int, tc int, kind string, data binary")


class _Counts:
    """Counts of each value at each place of a tile, over the range of values met so far."""

    def __init__(self, area: int, low: int, width: int):
        self.low, self.counts = low, np.zeros((area, width), np.int64)

    def cover(self, low: int, high: int) -> None:
        first, last = min(low, self.low), max(high, self.low + self.counts.shape[1] - 1)
        if (first, last) != (self.low, self.low + self.counts.shape[1] - 1):
            wide = np.zeros((len(self.counts), last - first + 1), np.int64)
            wide[:, self.low - first : self.low - first + self.counts.shape[1]] = self.counts
            self.low, self.counts = first, wide

    def add(self, places: np.ndarray, values: np.ndarray) -> None:
        self.cover(int(values.min()), int(values.max()))
        self.counts[places, values - self.low] += 1  # a place occurs once in a tile

    def merge(self, low: int, counts: np.ndarray) -> None:
        self.cover(low, low + counts.shape[1] - 1)
        self.counts[:, low - self.low : low - self.low + counts.shape[1]] += counts

    def median(self) -> np.ndarray:
        """Median at each place, the mean of the middle two for an even number; nan where nothing was counted."""
        upto = np.cumsum(self.counts, axis=1)
        n = upto[:, -1]
        low, high = ((upto < k[:, None]).sum(axis=1) for k in ((n + 1) // 2, n // 2 + 1))
        return np.where(n > 0, (low + high) / 2.0 + self.low, np.nan)


def flat_field(tiles: DataFrame, side: Sequence[int] = SIDE) -> DataFrame:
    """Median over all frames for each pixel and channel, as tiles (ch, tr, tc, height, width, kind, data) of the largest frame's size.

    Each task adds up the counts of its tiles, one array of pixel x value for a place, over the range of values that occur there, and sends them on when
    they fill ``COUNT_BYTES``. So what is shuffled is bounded by places x tasks while the counts of a task fit, and by the tiles themselves
    beyond. Counts are merged as a stream in order of place, one place at a time in memory.
    """
    area = side[0] * side[1]
    columns = ["ch", "tr", "tc", "height", "width", "low", "counts"]

    def row_of(key, size, counts: _Counts):
        return (*key, *size, counts.low, zlib.compress(counts.counts.astype("<u4").tobytes(), 1))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, _Counts] = {}
        sizes: dict[tuple, tuple[int, int]] = {}
        filled = 0
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                plane, key = values_of(row, side).astype(np.int64), (row.ch, row.tr, row.tc)
                places = (np.arange(plane.shape[0])[:, None] * side[1] + np.arange(plane.shape[1])).ravel()
                if key not in held:
                    held[key], sizes[key] = _Counts(area, int(plane.min()), int(plane.max() - plane.min()) + 1), (0, 0)
                    filled += held[key].counts.nbytes
                filled -= held[key].counts.nbytes
                held[key].add(places, plane.ravel())
                filled += held[key].counts.nbytes
                sizes[key] = tuple(map(max, sizes[key], (row.height, row.width)))
                if filled > COUNT_BYTES:
                    yield pd.DataFrame([row_of(k, sizes[k], v) for k, v in held.items()], columns=columns)
                    held, sizes, filled = {}, {}, 0
        if held:
            yield pd.DataFrame([row_of(k, sizes[k], v) for k, v in held.items()], columns=columns)

    def medians(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done():
            return pd.DataFrame([(*key, *size, "<f8", counts.median().tobytes())], columns=["ch", "tr", "tc", "height", "width", "kind", "data"])

        key, size, counts = None, (0, 0), None
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                own = np.frombuffer(zlib.decompress(row.counts), "<u4").reshape(area, -1).astype(np.int64)
                if (row.ch, row.tr, row.tc) != key:
                    if key is not None:
                        yield done()
                    key, size, counts = (row.ch, row.tr, row.tc), (0, 0), _Counts(area, row.low, own.shape[1])
                counts.merge(row.low, own)
                size = tuple(map(max, size, (row.height, row.width)))
        if key is not None:
            yield done()

    partial = tiles.select("height", "width", "ch", *PLACE, "kind", "data").mapInPandas(count, "ch int, tr int, tc int, height int, width int, low int, counts binary")
    line = partial.repartition("ch", *PLACE).sortWithinPartitions("ch", *PLACE)
    return line.mapInPandas(medians, "ch int, tr int, tc int, height int, width int, kind string, data binary")


def flat_pixels(flat: DataFrame, side: Sequence[int] = SIDE) -> DataFrame:
    """Rows (ch, r, c, flat) of a flat field; places that no frame has are left out."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                values = np.frombuffer(row.data, row.kind)
                at = np.flatnonzero(~np.isnan(values))
                yield pd.DataFrame({"ch": row.ch, "r": at // side[1] + row.tr * side[0], "c": at % side[1] + row.tc * side[1], "flat": values[at]})

    return flat.select("ch", *PLACE, "kind", "data").mapInPandas(spread, "ch int, r int, c int, flat double")


def apply_flat(tiles: DataFrame, flat: DataFrame, side: Sequence[int] = SIDE) -> DataFrame:
    """Divide by the flat field (at least 1) and scale by its mean. The flat is read twice: pass a stored or checkpointed one."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values = [np.maximum(v[~np.isnan(v)], 1.0) for v in (np.frombuffer(d, "<f8") for d in pdf["data"])]
            yield pd.DataFrame({"total": [float(v.sum()) for v in values], "n": [len(v) for v in values]})

    mean = flat.select("data").mapInPandas(sums, "total double, n long").agg(F.sum("total") / F.sum("n")).scalar()
    rows = tiles.join(flat.select("ch", *PLACE, F.col("data").alias("_flat")), ["ch", *PLACE]).withColumn("_mean", mean)

    def divide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.rename(columns={"_flat": "flat", "_mean": "mean"}).itertuples(index=False):
                plane = values_of(row, side)
                under = np.frombuffer(row.flat, "<f8").reshape(side)[: plane.shape[0], : plane.shape[1]]
                out.append((plane / np.maximum(under, 1.0) * row.mean).tobytes())
            yield pdf[columns].assign(kind="<f8", data=out)

    columns = list(tiles.columns)
    return rows.mapInPandas(divide, _schema(tiles, *columns))


def global_stretch(tiles: DataFrame, side: Sequence[int] = SIDE) -> DataFrame:
    """Stretch each frame to 0..255 with one scale for all channels; a flat frame is only clipped. Tiles send their limits, two numbers each, and are joined to those of their frame."""

    def limits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            planes = [np.frombuffer(d, k) for d, k in zip(pdf["data"], pdf["kind"])]
            yield pd.DataFrame({"frame_id": pdf["frame_id"], "_lo": [float(p.min()) for p in planes], "_hi": [float(p.max()) for p in planes]})

    ends = tiles.select("frame_id", "kind", "data").mapInPandas(limits, f"{_schema(tiles, 'frame_id')}, _lo double, _hi double").groupBy("frame_id").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    columns = list(tiles.columns)

    def stretch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for data, kind, lo, hi in zip(pdf["data"], pdf["kind"], pdf["_lo"], pdf["_hi"]):
                values = np.frombuffer(data, kind).astype(float)
                values = (values - lo) / (hi - lo) * 255.0 if hi > lo else values
                out.append(np.floor(values.clip(0.0, 255.0)).astype(np.int32).tobytes())
            yield pdf[columns].assign(kind="<i4", data=out)

    return tiles.join(ends, "frame_id").mapInPandas(stretch, _schema(tiles, *columns))


def temporal_average(tiles: DataFrame, n: int, side: Sequence[int] = SIDE, camera: str = "camera", index: str = "n", size: int = 4096) -> DataFrame:
    """Mean of each pixel over the last ``n`` frames of its camera, truncated. ``index`` counts a camera's frames without gaps.

    One exchange by (camera, channel, place, slice of frames); a task goes through the tiles of a place in order with a running sum.
    """
    rows = ordered.with_halo(tiles, index, n - 1, size) if n > 1 else tiles.withColumns({SLICE: F.lit(0).cast("long"), HALO: F.lit(False)})
    group = [camera, "ch", *PLACE, SLICE]
    columns = list(tiles.columns)

    def mean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, total, last = None, None, deque()
        for pdf in batches:
            out = []
            for name, copy, row in zip(zip(*(pdf[c] for c in group)), pdf[HALO], pdf[columns].itertuples(index=False)):
                plane = values_of(row, side).astype(np.int64)
                if name != key:
                    key, total, last = name, np.zeros((min(side[0], row.height), side[1]), np.int64)[: plane.shape[0], : plane.shape[1]] * 0, deque()
                if last and last[0].shape != plane.shape:
                    raise ValueError("the frames of a camera differ in size")
                total = total + plane
                last.append(plane)
                if len(last) > n:
                    total = total - last.popleft()
                out.append(None if copy else np.floor(total / len(last)).astype("<i4").tobytes())
            done = pdf[columns].assign(kind="<i4", data=out)
            yield done[~pdf[HALO].to_numpy(bool)]

    line = rows.repartition(*group).sortWithinPartitions(*group, index)
    return line.mapInPandas(mean, _schema(tiles, *columns))
