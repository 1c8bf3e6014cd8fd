"""Index marks: thresholds, connected components, mark centres and grid rotation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanlake.functions import units
from scanlake.operators import grid
from scanlake.session import cut_lineage

# Mark size limits as shares of the short image side, largest aspect, smallest fill.
MARK_MIN, MARK_MAX = 0.02, 0.25
MARK_ASPECT = 3.5
MARK_FILL = 0.05
NEAR_PX = 20
MIN_AREA = 20
# Shortest bar of a cross, and the clip limits of the equalisation before clusters and crossings are looked for.
MIN_ARM = 12
CLUSTER_CLIP, CROSSING_CLIP = 4.0, 2.0
# Digit boxes (x0, y0, x1, y1) round the centre of a mark, in pixels of a frame 850 wide.
DIGIT_BOXES = {
    "TL": (-46.5, -67.2, -8.2, -7.8),
    "TR": (8.2, -68.0, 45.8, -8.8),
    "BL": (-47.2, 9.0, -6.5, 69.5),
    "BR": (8.5, 8.0, 47.2, 69.0),
}
CALIBRATION_WIDTH = 850.0
# Side of a tile in pixels, of a tile of cells in cells, and nodes joined along each axis by a level of the tree over the tiles.
TILE, CELL_TILE, FAN = 256, 32, 4
# Centres that are compared with each other directly.
FEW = 16
# Pixel (r, c) as one number that sorts in reading order; images are less than 2^20 pixels wide.
_ROW_STRIDE = 1 << 20


def otsu_threshold(pixels: DataFrame, value: str = "v", keys: Sequence[str] = grid.FRAME) -> DataFrame:
    """Threshold of each plane with the largest between-class variance; the first maximum wins, foreground is above it."""
    counts = pixels.groupBy(*keys, F.col(value).alias("t")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("t")
    level = counts.select(
        *keys, "t", F.sum("n").over(upto).alias("w0"), F.sum(F.col("n") * F.col("t")).over(upto).alias("s0"),
        F.sum("n").over(whole).alias("w"), F.sum(F.col("n") * F.col("t")).over(whole).alias("s"),
    )
    w1 = F.col("w") - F.col("w0")
    gap = F.col("s") * F.col("w0") - F.col("w") * F.col("s0")
    between = F.when(w1 > 0, gap * gap / (F.col("w0") * w1)).otherwise(F.lit(0.0))
    best = level.groupBy(*keys).agg(F.max(F.struct(between.alias("b"), (-F.col("t")).alias("minus"))).alias("top"))
    return best.select(*keys, (-F.col("top.minus")).alias("threshold"))


def binarise(pixels: DataFrame, thresholds: DataFrame, value: str = "v", keys: Sequence[str] = grid.FRAME) -> DataFrame:
    rows = pixels.join(thresholds, list(keys))
    return rows.select(*keys, "r", "c", F.when(F.col(value) > F.col("threshold"), 255).otherwise(0).alias(value))


def mark_binary(pixels: DataFrame, size: tuple[int, int], tiles: tuple[int, int] = (8, 8), clip: float = 4.0, channel: str = "red") -> DataFrame:
    """Bright marks on a dark ground: equalise one channel by tiles, then threshold each frame."""
    plane = pixels.select(*grid.FRAME, "r", "c", F.col(channel).alias("v"))
    even = grid.tile_equalise(plane, size, tiles, clip)
    return binarise(even, otsu_threshold(even))


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` entries the first one it is linked with, directly or through others; links are pairs of positions."""
    first = np.arange(n)
    while True:
        low, high = np.minimum(first[a], first[b]), np.maximum(first[a], first[b])
        if np.array_equal(low, high):
            return first
        np.minimum.at(first, high, low)
        while not np.array_equal(first, first[first]):
            first = first[first]


def _touching(group: np.ndarray, r: np.ndarray, c: np.ndarray, connectivity: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of neighbouring pixels of one group; pixels are distinct and sorted by group, r, c, with r and c from 0 on."""
    width = int(max(r.max(), c.max())) + 3  # neighbours beyond the last row or column meet nothing
    key = (group * width + r) * width + c
    links = [(np.zeros(0, np.int64),) * 2]
    for dr, dc in [(0, 1), (1, 0)] + ([(1, -1), (1, 1)] if connectivity == 8 else []):
        other = key + dr * width + dc
        at = np.minimum(np.searchsorted(key, other), len(key) - 1)
        here = np.flatnonzero(key[at] == other)
        links.append((here, at[here]))
    return tuple(np.concatenate(side) for side in zip(*links))


def _flat(arrays: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(number of the row, value) of all elements of some arrays."""
    n = np.fromiter(map(len, arrays), np.int64, len(arrays))
    return np.repeat(np.arange(len(n)), n), np.concatenate([np.zeros(0, np.int64), *arrays]).astype(np.int64)


def _split(values: np.ndarray, like: pd.Series) -> pd.Series:
    ends = np.cumsum(np.fromiter(map(len, like), np.int64, len(like)))
    return pd.Series(np.split(values, ends[:-1]) if len(like) else [])


def _code(r: Column, c: Column) -> Column:
    wide = F.raise_error(F.lit(f"a column is not below {_ROW_STRIDE}")).cast("long")
    return F.when((c >= _ROW_STRIDE) | (c < 0), wide).otherwise(r.cast("long") * _ROW_STRIDE + c)


def label_components(
    mask: DataFrame, keys: Sequence[str] = grid.FRAME, connectivity: int = 8, tile: int = TILE, size: tuple[int, int] | None = None, fan: int = FAN,
) -> DataFrame:
    """Component label (its first pixel in reading order, as r * 2^20 + c) of every set pixel.

    Tiles are labelled on their own, at most ``tile`` squared pixels at a time. Then a tree over the tiles puts components together: each
    level joins ``fan`` x ``fan`` neighbours by the labels on their rims alone and passes its own rim on. The number of levels follows
    from ``size`` (height, width of the largest frame, read from the pixels unless given); frames of one tile have none. Fails on columns
    below 0 or from 2^20 on, which have no label.
    """
    on = list(keys)
    place = [(F.floor(F.col(a) / tile)).cast("int").alias(f"t{a}") for a in ("r", "c")]
    pixels = mask.where(F.col("v") > 0).select(*on, *place, _code(F.col("r"), F.col("c")).alias("code"))
    tiles = pixels.groupBy(*on, "tr", "tc").agg(F.sort_array(F.collect_list("code")).alias("codes"))

    @F.pandas_udf("array<bigint>")
    def label(codes: pd.Series) -> pd.Series:
        group, code = _flat(codes)
        if len(code) == 0:
            return codes
        r, c = np.divmod(code, _ROW_STRIDE)
        return _split(code[_joined(len(code), *_touching(group, r % tile, c % tile, connectivity))], codes)

    local = tiles.select(*on, "tr", "tc", F.explode(F.arrays_zip("codes", label("codes").alias("labels"))).alias("_p"))
    local = local.select(
        *on, "tr", "tc", F.expr(f"CAST(_p.codes DIV {_ROW_STRIDE} AS INT)").alias("r"), F.expr(f"CAST(_p.codes % {_ROW_STRIDE} AS INT)").alias("c"),
        F.col("_p.labels").alias("label"),
    )
    levels = _levels(size, tile, fan) if size else None
    if levels != 0:
        local = cut_lineage(local)
    roots = _tree(local, on, tile, fan, levels, connectivity)
    if roots is None:
        return local.select(*on, "r", "c", "label")
    joined = local.join(roots, [*on, "label"], "left")
    return joined.select(*on, "r", "c", F.coalesce("root", "label").alias("label"))


def _levels(size: tuple[int, int], tile: int, fan: int) -> int:
    """Levels of the tree over the tiles of a frame of this size."""
    tiles, levels = -(-max(size) // tile), 0
    while tiles > 1:
        tiles, levels = -(-tiles // fan), levels + 1
    return levels


def _tree(local: DataFrame, on: list[str], tile: int, fan: int, levels: int | None, connectivity: int) -> DataFrame | None:
    """label and root of the tile labels whose components reach over tile borders; None for frames of one tile.

    ``local`` has tr, tc, r, c and label. A level's group holds the rims of fan x fan nodes: about ``4 * fan * side`` pixels.
    """
    if levels is None:
        row = local.agg(*[F.max(f"t{a}").alias(a) for a in "rc"]).first()
        levels = _levels(((row["r"] or 0) + 1, (row["c"] or 0) + 1), 1, fan)

    def on_rim(side: int) -> Column:
        edge = F.lit(False)
        for axis in ("r", "c"):
            edge = edge | F.pmod(F.col(axis), F.lit(side)).isin(0, side - 1)
        return edge

    @F.pandas_udf("array<bigint>")
    def merge(codes: pd.Series, labels: pd.Series) -> pd.Series:
        (group, code), (_, label) = _flat(codes), _flat(labels)
        r, c = np.divmod(code, _ROW_STRIDE)
        start = np.concatenate(([True], group[1:] != group[:-1]))
        for axis in (r, c):
            axis -= np.minimum.reduceat(axis, np.flatnonzero(start))[np.cumsum(start) - 1]
        order = np.lexsort((label, group))
        same = np.flatnonzero((group[order][1:] == group[order][:-1]) & (label[order][1:] == label[order][:-1]))
        a, b = _touching(group, r, c, connectivity)
        root = _joined(len(code), np.concatenate((a, order[same])), np.concatenate((b, order[same + 1])))
        least = label.copy()
        np.minimum.at(least, root, label)
        return _split(least[root], codes)

    side, rim, maps = tile, local.where(on_rim(tile)).select(*on, "r", "c", "label"), []
    for _ in range(levels):
        side *= fan
        node = [F.floor(F.col(a) / side).cast("int").alias(f"n{a}") for a in ("r", "c")]
        packed = F.sort_array(F.collect_list(F.struct(_code(F.col("r"), F.col("c")).alias("code"), "label")))
        nodes = rim.groupBy(*on, *node).agg(packed.alias("_p"))
        codes, labels = F.col("_p.code"), F.col("_p.label")
        met = nodes.select(*on, F.explode(F.arrays_zip(codes.alias("code"), labels.alias("label"), merge(codes, labels).alias("root"))).alias("_p"))
        met = met.select(*on, F.expr(f"CAST(_p.code DIV {_ROW_STRIDE} AS INT)").alias("r"), F.expr(f"CAST(_p.code % {_ROW_STRIDE} AS INT)").alias("c"), "_p.label", "_p.root")
        maps.append(met.where("label <> root").select(*on, "label", "root").distinct())
        rim = met.where(on_rim(side)).select(*on, "r", "c", F.col("root").alias("label"))
    if not maps:
        return None
    # what a level made of a label may have got another root on a later one
    roots = maps.pop()
    for earlier in reversed(maps):
        later = roots.select(*on, F.col("label").alias("root"), F.col("root").alias("_last"))
        roots = earlier.join(later, [*on, "root"], "left").select(*on, "label", F.coalesce("_last", "root").alias("root")).unionByName(roots)
    return roots


def component_stats(labels: DataFrame, keys: Sequence[str] = grid.FRAME) -> DataFrame:
    """Bounding box, area and centroid sums of each component."""
    out = labels.groupBy(*keys, "label").agg(
        F.min("c").alias("left"), F.min("r").alias("top"), F.max("c").alias("_right"), F.max("r").alias("_bottom"),
        F.count(F.lit(1)).alias("area"), F.avg("c").alias("mean_x"), F.avg("r").alias("mean_y"),
    )
    return out.select(
        *keys, "label", "left", "top", (F.col("_right") - F.col("left") + 1).alias("width"), (F.col("_bottom") - F.col("top") + 1).alias("height"),
        "area", "mean_x", "mean_y",
    )


def components(mask: DataFrame, keys: Sequence[str] = grid.FRAME, tile: int = TILE, size: tuple[int, int] | None = None) -> DataFrame:
    """8-connected components of a mask with their boxes."""
    return component_stats(label_components(mask, keys, 8, tile, size), keys)


def mark_like(stats: DataFrame, size: tuple[int, int]) -> DataFrame:
    """Components of the size, shape and fill of an index mark."""
    short = min(size)
    low, high = short * MARK_MIN, short * MARK_MAX
    w, h = F.col("width"), F.col("height")
    aspect = F.greatest(w, h) / F.greatest(F.least(w, h), F.lit(1))
    return stats.where(w.between(low, high) & h.between(low, high) & (aspect <= MARK_ASPECT) & (F.col("area") >= w * h * MARK_FILL))


def box_centres(stats: DataFrame, keys: Sequence[str] = grid.FRAME) -> DataFrame:
    """Centre of each component's box, truncated."""
    x, y = (F.col("left") + F.col("width") / 2.0).cast("int"), (F.col("top") + F.col("height") / 2.0).cast("int")
    return stats.select(*keys, F.col("label").alias("id"), x.alias("x"), y.alias("y"))


def moment_centres(stats: DataFrame, min_area: int = MIN_AREA, keys: Sequence[str] = grid.FRAME) -> DataFrame:
    """Centroid of each component of enough area, truncated."""
    big = stats.where(F.col("area") >= min_area)
    return big.select(*keys, F.col("label").alias("id"), F.col("mean_x").cast("int").alias("x"), F.col("mean_y").cast("int").alias("y"))


def largest_centre(stats: DataFrame, frames: DataFrame, size: tuple[int, int], keys: Sequence[str] = grid.FRAME) -> DataFrame:
    """Box centre of the largest component of each frame, the image centre when there is none."""
    x = F.col("left") + F.floor(F.col("width") / 2).cast("int")
    y = F.col("top") + F.floor(F.col("height") / 2).cast("int")
    pick = F.max(F.struct(F.col("area"), (-F.col("label")).alias("minus"), x.alias("x"), y.alias("y"))).alias("top")
    best = stats.groupBy(*keys).agg(pick)
    out = frames.select(*keys).join(best, list(keys), "left")
    return out.select(*keys, F.coalesce("top.x", F.lit(size[1] // 2)).alias("x"), F.coalesce("top.y", F.lit(size[0] // 2)).alias("y"))


def _cells(df: DataFrame, side: int, reach: bool = False) -> DataFrame:
    """Add the square cell (cx, cy) of each centre, or with ``reach`` one row for its cell and each of the eight round it."""
    cx, cy = (F.floor(F.col(a) / side).cast("int") for a in ("x", "y"))
    if not reach:
        return df.withColumns({"cx": cx, "cy": cy})
    moves = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    return df.withColumn("_m", F.explode(moves)).withColumns({"cx": cx + F.col("_m.a"), "cy": cy + F.col("_m.b")}).drop("_m")


def _fold(x: list[int], y: list[int], radius: int, kept: dict[tuple[int, int], list[tuple[int, int]]]) -> list[bool]:
    """Whether each centre in turn is kept; ``kept`` (centres kept so far, by cell) grows."""
    side, out = radius + 1, []
    for a, b in zip(x, y):
        cx, cy = a // side, b // side
        for cell in ((cx, cy), (cx - 1, cy), (cx + 1, cy), (cx, cy - 1), (cx, cy + 1), (cx - 1, cy - 1), (cx + 1, cy - 1), (cx - 1, cy + 1), (cx + 1, cy + 1)):
            if cell in kept and any(-radius <= a - p <= radius and -radius <= b - q <= radius for p, q in kept[cell]):
                out.append(False)
                break
        else:
            kept.setdefault((cx, cy), []).append((a, b))
            out.append(True)
    return out


def _fold_few(x: list[int], y: list[int], radius: int) -> list[bool]:
    """``_fold`` of a short list, without cells."""
    kept, out = [], []
    for a, b in zip(x, y):
        for p, q in kept:
            if -radius <= a - p <= radius and -radius <= b - q <= radius:
                out.append(False)
                break
        else:
            kept.append((a, b))
            out.append(True)
    return out


def _places(centres: DataFrame, radius: int, on: list[str], size: tuple[int, int] | None) -> tuple[DataFrame, tuple[int, int]]:
    """The first centre on each pixel, and the cells of the largest frame along both axes; its ``size`` is read unless given."""
    first = centres.groupBy(*on, "x", "y").agg(F.min("id").alias("id"))
    if size is None:
        first = cut_lineage(first)
        row = first.agg(F.max("x").alias("x"), F.max("y").alias("y")).first()
        size = ((row["y"] or 0) + 1, (row["x"] or 0) + 1)
    side = radius + 1
    return first, (-(-size[0] // side), -(-size[1] // side))


def _kept_lists(first: DataFrame, radius: int, on: list[str]) -> DataFrame:
    """One row for each frame with ``kept``, the centres (id, x, y) that stay, in order; a frame is gone through in one pass."""

    @F.pandas_udf("array<boolean>")
    def fold(x: pd.Series, y: pd.Series) -> pd.Series:
        (_, xs), (_, ys) = _flat(x), _flat(y)
        xs, ys = xs.tolist(), ys.tolist()
        ends = np.cumsum(np.fromiter(map(len, x), np.int64, len(x))).tolist()
        lines = ((xs[p:q], ys[p:q]) for p, q in zip([0, *ends], ends))
        return pd.Series([_fold_few(a, b, radius) if len(a) <= FEW else _fold(a, b, radius, {}) for a, b in lines])

    rows = first.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct("id", "x", "y"))).alias("p"))
    rows = rows.withColumn("_k", fold("p.x", "p.y"))
    return rows.select(*on, F.filter("p", lambda e, k: F.get("_k", k)).alias("kept"))


def suppress_near(centres: DataFrame, radius: int = NEAR_PX, keys: Sequence[str] = grid.FRAME, size: tuple[int, int] | None = None, tile: int = CELL_TILE) -> DataFrame:
    """Go through the centres of a frame in order of id and drop those within ``radius`` of a kept one on both axes.

    Centres fall into cells as wide as the reach; only those of touching cells can meet. Frames of at most ``tile`` cells a side are gone
    through in one pass each. In larger ones the connected groups of occupied cells are found (``label_components`` over the cells),
    and each group is gone through on its own, as a stream sorted by id that holds the kept centres alone. Neither needs more steps for
    longer chains of centres. ``size`` (height, width) is the size of the largest frame, read from the centres unless given; centres lie
    inside their frame. Of centres on one pixel the first stands for all.
    """
    on = list(keys)
    first, cells = _places(centres, radius, on, size)
    if _levels(cells, tile, FAN) == 0:
        return _kept_lists(first, radius, on).select(*on, F.inline("kept"))
    return _suppress_in_groups(first, radius, on, cells, tile)


def _suppress_in_groups(first: DataFrame, radius: int, on: list[str], cells: tuple[int, int], tile: int) -> DataFrame:
    """``suppress_near`` by connected groups of occupied cells."""
    side = radius + 1
    first = cut_lineage(first)
    cell = first.withColumns({"r": F.floor(F.col("y") / side).cast("int"), "c": F.floor(F.col("x") / side).cast("int")})
    groups = label_components(cell.select(*on, "r", "c", F.lit(1).alias("v")).distinct(), on, 8, tile, cells)
    rows = cell.join(groups, [*on, "r", "c"]).select(*on, "label", "id", "x", "y")
    columns = [*on, "label"]

    def stream(batches):
        group, kept = None, {}
        for pdf in batches:
            names = list(zip(*(pdf[c] for c in columns)))
            starts = [k for k, name in enumerate(names) if k == 0 or name != names[k - 1]]
            keep = []
            for low, high in zip(starts, [*starts[1:], len(names)]):
                if names[low] != group:
                    group, kept = names[low], {}
                keep += _fold(pdf["x"].iloc[low:high].tolist(), pdf["y"].iloc[low:high].tolist(), radius, kept)
            yield pdf.loc[keep, [*on, "id", "x", "y"]]

    ordered = rows.repartition(*columns).sortWithinPartitions(*columns, "id", "x", "y")
    return ordered.mapInPandas(stream, ordered.select(*on, "id", "x", "y").schema)


def _near(xa: Column, ya: Column, xb: Column, yb: Column, reach: int) -> Column:
    return (F.abs(xa - xb) <= reach) & (F.abs(ya - yb) <= reach)


def near_pairs(centres: DataFrame, reach: int, keys: Sequence[str] = grid.FRAME) -> DataFrame:
    """Pairs of centres of a frame at most ``reach`` apart on both axes, the one with the smaller id first.

    Centres meet by cell, so a centre is only compared with those of nine cells; after ``suppress_near`` a cell holds a bounded number.
    """
    on = list(keys)
    a = _cells(centres, reach, reach=True).select(*on, "cx", "cy", F.col("id").alias("id_a"), F.col("x").alias("x_a"), F.col("y").alias("y_a"))
    b = _cells(centres, reach).select(*on, "cx", "cy", F.col("id").alias("id_b"), F.col("x").alias("x_b"), F.col("y").alias("y_b"))
    near = _near(F.col("x_a"), F.col("y_a"), F.col("x_b"), F.col("y_b"), reach)
    before = F.struct("id_a", "x_a", "y_a") < F.struct("id_b", "x_b", "y_b")
    return a.join(b, [*on, "cx", "cy"]).where(near & before).drop("cx", "cy")


def _pairs_of(kept: str, reach: int) -> Column:
    """The ``near_pairs`` of a sorted list of centres, as an array."""

    def pairs(a: Column, k: Column) -> Column:
        later = F.filter(F.slice(kept, k + 2, F.size(kept)), lambda b: _near(a["x"], a["y"], b["x"], b["y"], reach))
        return F.transform(later, lambda b: F.struct(*[e[c].alias(f"{c}_{n}") for n, e in (("a", a), ("b", b)) for c in ("id", "x", "y")]))

    return F.flatten(F.transform(kept, pairs))


def kept_pairs(centres: DataFrame, reach: int, radius: int = NEAR_PX, keys: Sequence[str] = grid.FRAME, size: tuple[int, int] | None = None, tile: int = CELL_TILE) -> DataFrame:
    """``near_pairs`` of the centres that ``suppress_near`` keeps. In frames of at most ``tile`` cells a side they meet in the list of the
    frame, which holds at most one centre a cell; in larger ones by cell."""
    on = list(keys)
    first, cells = _places(centres, radius, on, size)
    if _levels(cells, tile, FAN) == 0:
        return _kept_lists(first, radius, on).select(*on, F.inline(_pairs_of("kept", reach)))
    return near_pairs(_suppress_in_groups(first, radius, on, cells, tile), reach, keys)


def _direction(xa: Column, ya: Column, xb: Column, yb: Column) -> Column:
    """Direction from one centre to another in degrees, folded into [0, 90)."""
    return F.pmod(F.degrees(F.atan2(-(yb - ya).cast("double"), (xb - xa).cast("double"))), F.lit(90.0))


def grid_rotation(
    centres: DataFrame, reach: int, radius: int = NEAR_PX, keys: Sequence[str] = grid.FRAME, size: tuple[int, int] | None = None, tile: int = CELL_TILE
) -> DataFrame:
    """Median direction between neighbouring marks of a frame, folded into [0, 90); frames without neighbours give null.

    Marks are thinned by ``suppress_near``; neighbours are at most ``reach`` apart on both axes (a little more than the pitch).
    As in ``kept_pairs``, marks of frames of few cells meet in the list of the frame.
    """
    on = list(keys)
    first, cells = _places(centres, radius, on, size)
    if _levels(cells, tile, FAN) == 0:
        turned = F.transform(_pairs_of("kept", reach), lambda p: _direction(p["x_a"], p["y_a"], p["x_b"], p["y_b"]))
        rows = _kept_lists(first, radius, on).select(*on, F.sort_array(turned).alias("_t")).withColumn("_n", F.size("_t"))
        low, high = F.get("_t", F.expr("(_n - 1) DIV 2").cast("int")), F.get("_t", F.expr("_n DIV 2").cast("int"))
        return rows.select(*on, F.when(F.col("_n") > 0, low * 0.5 + high * 0.5).alias("angle_deg"))
    kept = cut_lineage(_suppress_in_groups(first, radius, on, cells, tile))
    angle = _direction(F.col("x_a"), F.col("y_a"), F.col("x_b"), F.col("y_b"))
    turned = near_pairs(kept, reach, keys).groupBy(*on).agg(F.median(angle).alias("angle_deg"))
    return kept.select(*on).distinct().join(turned, on, "left")


def bright_clusters(pixels: DataFrame, size: tuple[int, int], tiles: tuple[int, int] = (8, 8), radius: int = NEAR_PX) -> DataFrame:
    """Centres (frame_id, id, x, y) of bright clusters of the size and shape of a mark in colour pixels, thinned by ``suppress_near``."""
    binary = mark_binary(pixels, size, tiles, CLUSTER_CLIP)
    grow = max(5, size[1] // 60)
    stats = components(grid.dilate(binary, grow, grow), size=size)
    return suppress_near(box_centres(mark_like(stats, size)), radius, size=size)


def crossing_centres(plane: DataFrame, size: tuple[int, int], tiles: tuple[int, int] = (8, 8), min_arm: int = MIN_ARM) -> DataFrame:
    """Centres (frame_id, id, x, y) of the places where two bright bars cross in a gray plane (frame_id, r, c, v)."""
    even = grid.tile_equalise(plane, size, tiles, CROSSING_CLIP)
    crossed = grid.line_crossings(binarise(even, otsu_threshold(even)), min_arm)
    return moment_centres(components(crossed, size=size))


def index_marks(pixels: DataFrame, size: tuple[int, int], tiles: tuple[int, int] = (8, 8), min_arm: int = MIN_ARM, radius: int = NEAR_PX) -> DataFrame:
    """Centres of the index marks of colour frames of one size (frame_id, stage, id, x, y).

    Frames with bright clusters are done with them (stage ``clusters``). Only the others go on, by an anti join: there bars that
    cross are looked for in the gray plane (``grey``) and in its negative (``inverted``); of the two, grey centres come first
    when near ones are dropped. Frames without any mark have no rows. What the first stage finds is stored, as the others depend on it.
    """
    clusters = cut_lineage(bright_clusters(pixels, size, tiles, radius))
    rest = pixels.join(clusters.select(*grid.FRAME).distinct(), list(grid.FRAME), "left_anti")
    gray = cut_lineage(rest.select(*grid.FRAME, "r", "c", units.to_gray(F.col("blue"), F.col("green"), F.col("red")).cast("int").alias("v")))
    later = 1 << 50  # ids of the second polarity follow all of the first
    found = crossing_centres(gray, size, tiles, min_arm)
    negative = crossing_centres(grid.invert(gray), size, tiles, min_arm)
    both = suppress_near(found.unionByName(negative.withColumn("id", F.col("id") + later)), radius, size=size)
    stage = F.when(F.col("id") < later, "grey").otherwise("inverted")
    crossed = both.select(*grid.FRAME, stage.alias("stage"), (F.col("id") % later).alias("id"), "x", "y")
    return clusters.select(*grid.FRAME, F.lit("clusters").alias("stage"), "id", "x", "y").unionByName(crossed)


def digit_boxes(marks: DataFrame, frame_width: int, crop: tuple[Column, Column]) -> DataFrame:
    """The four digit boxes of each mark centre (x, y) inside its crop (width, height); empty boxes are left out."""
    scale = frame_width / CALIBRATION_WIDTH
    offsets = F.array(
        *[F.struct(F.lit(name).alias("digit"), *[F.lit(v).alias(k) for k, v in zip(("x0", "y0", "x1", "y1"), box)]) for name, box in DIGIT_BOXES.items()]
    )
    rows = marks.withColumn("_b", F.explode(offsets))
    width, height = crop

    def at(axis: str, edge: str) -> Column:
        return (F.col(axis) + F.col(f"_b.{edge}") * scale).cast("int")

    x0, y0 = F.greatest(F.lit(0), at("x", "x0")), F.greatest(F.lit(0), at("y", "y0"))
    x1, y1 = F.least(width, at("x", "x1")), F.least(height, at("y", "y1"))
    out = rows.select(*marks.columns, F.col("_b.digit").alias("digit"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    return out.where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
