"""Per-frame statistics and colour work on pixels in long form.

Gray pixels are rows (frame_id, r, c, v); colour pixels carry blue, green and red; channel rows (frame_id, r, c, ch, v).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlake.operators import grid, ordered
from scanlake.session import cut_lineage

CHANNELS = ("blue", "green", "red")
# Darkest mean a frame may have, smallest metric of a good focus, box half-widths.
MIN_MEAN = 15.0
MIN_METRIC = 100.0
ROI_HALF = 6
PICK_HALF = 2
ZOOM_HALF = 20


class Layer(NamedTuple):
    """A colour class; a layer without colour is skipped."""

    name: str
    rgb: tuple[int, int, int] | None


def frame_intensity(pixels: DataFrame, frames: DataFrame | None = None, keys: Sequence[str] = grid.FRAME) -> DataFrame:
    """Mean gray of each frame; frames listed in ``frames`` without pixels get 0."""
    means = pixels.groupBy(*keys).agg(F.avg("v").alias("intensity"))
    if frames is None:
        return means
    return frames.select(*keys).join(means, list(keys), "left").fillna(0.0, ["intensity"])


def drop_dark_frames(intensity: DataFrame, min_mean: float = MIN_MEAN) -> DataFrame:
    return intensity.where(F.col("intensity") >= min_mean)


def min_metric(rows: DataFrame, threshold: float = MIN_METRIC) -> DataFrame:
    """Drop metrics below the threshold; an unknown metric passes."""
    return rows.where(F.col("metric").isNull() | (F.col("metric") >= threshold))


def min_improvement(rows: DataFrame, pct: float = 0.0) -> DataFrame:
    """Keep runs whose final metric beats the first by ``pct`` percent; no final metric counts as 0."""
    return rows.where(F.coalesce(F.col("m_final"), F.lit(0.0)) >= F.col("m0") * (1.0 + pct / 100.0))


def laplacian_variance(pixels: DataFrame) -> DataFrame:
    return grid.stencil(pixels, {"lap": grid.LAPLACIAN}).groupBy(*grid.FRAME).agg(F.var_pop("lap").alias("metric"))


def tenengrad(pixels: DataFrame) -> DataFrame:
    edges = grid.stencil(pixels, {"gx": grid.SOBEL_X, "gy": grid.SOBEL_Y})
    return edges.groupBy(*grid.FRAME).agg(F.avg(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).alias("metric"))


def brightness(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy(*grid.FRAME).agg(F.avg("v").alias("metric"))


def image_variance(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy(*grid.FRAME).agg(F.var_pop("v").alias("metric"))


METRICS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "LaplacianVariance": laplacian_variance,
    "Tenengrad": tenengrad,
    "Brightness": brightness,
    "ImageVariance": image_variance,
}


def register_metric(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    """Make ``fn`` (pixels to frame_id, metric) available to ``focus_metric``."""
    METRICS[name] = fn


def focus_metric(pixels: DataFrame, name: str = "LaplacianVariance") -> DataFrame:
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}, known: {sorted(METRICS)}")
    return METRICS[name](pixels)


def crop_roi(pixels: DataFrame, centre_r: Column | int, centre_c: Column | int, half: int = ROI_HALF, exclusive: bool = False) -> DataFrame:
    """Square round a centre, cut at the image border; ``exclusive`` leaves out its last row and column."""
    r, c = (v if isinstance(v, Column) else F.lit(v) for v in (centre_r, centre_c))
    last = half - 1 if exclusive else half
    return pixels.where(F.col("r").between(r - half, r + last) & F.col("c").between(c - half, c + last))


def roi_stats(pixels: DataFrame, size: tuple[int, int], half: int = ROI_HALF) -> DataFrame:
    """Mean over a square at the image centre, mean of the centre pixel and the pixels in reading order."""
    cy, cx = size[0] // 2, size[1] // 2
    total = F.col("blue") + F.col("green") + F.col("red")
    centre = (F.col("r") == cy) & (F.col("c") == cx)
    out = crop_roi(pixels, cy, cx, half).groupBy("frame_id").agg(
        F.avg(total / 3.0).alias("mean_intensity"),
        F.max(F.when(centre, total / 3.0)).alias("centre_intensity"),
        F.sort_array(F.collect_list(F.struct("r", "c", *CHANNELS))).alias("_px"),
    )
    shown = F.transform("_px", lambda e: F.struct(*[e[ch].alias(ch) for ch in CHANNELS]))
    return out.select("frame_id", "mean_intensity", "centre_intensity", shown.alias("pixels"))


def pick_colour(pixels: DataFrame, centre_r: Column | int, centre_c: Column | int, half: int = PICK_HALF) -> DataFrame:
    """Mean colour round a point, truncated."""
    near = crop_roi(pixels, centre_r, centre_c, half)
    return near.groupBy("frame_id").agg(*[F.floor(F.avg(ch)).cast("int").alias(ch) for ch in CHANNELS])


def mode_colour(pixels: DataFrame, subsample: int = 1) -> DataFrame:
    """Most frequent colour in 32 levels per channel, as the middle of its level; ties go to the darkest by blue, green, red.

    ``subsample=n`` counts only every n-th pixel of both axes.
    """
    kept = pixels if subsample == 1 else pixels.where((F.col("r") % subsample == 0) & (F.col("c") % subsample == 0))
    counts = kept.groupBy("frame_id", *[F.shiftright(ch, 3).alias(ch) for ch in CHANNELS]).agg(F.count(F.lit(1)).alias("n"))
    first = F.struct("n", *[(-F.col(ch)).alias(ch) for ch in ("blue", "green", "red")])
    top = counts.groupBy("frame_id").agg(F.max(first).alias("top"))
    return top.select("frame_id", *[(4 - 8 * F.col(f"top.{ch}")).cast("int").alias(ch) for ch in ("blue", "green", "red")])


def colour_mask(pixels: DataFrame, layers: Sequence[Layer], tol: int = 20) -> DataFrame:
    """Pixels within ``tol`` of a layer's colour in every channel, one row per layer matched."""
    classes = [
        F.struct(F.lit(layer.name).alias("layer"), *[F.lit(v).alias(ch) for ch, v in zip(("red", "green", "blue"), layer.rgb)])
        for layer in layers
        if layer.rgb is not None
    ]

    def close(e: Column) -> Column:
        return F.greatest(*[F.abs(F.col(ch) - e[ch]) for ch in CHANNELS]) <= tol

    hits = F.transform(F.filter(F.array(*classes), close), lambda e: e["layer"])
    return pixels.select("frame_id", "r", "c", F.explode(hits).alias("layer"))


def layer_masks(pixels: DataFrame, layers: Sequence[Layer], tol: int = 20, background: bool = True) -> DataFrame:
    """Dense mask (frame_id, layer, r, c, v) of each layer; with ``background`` also of each frame's most frequent colour."""
    targets = [
        F.struct(F.lit(layer.name).alias("layer"), *[F.lit(v).alias(ch) for ch, v in zip(("red", "green", "blue"), layer.rgb)])
        for layer in layers
        if layer.rgb is not None
    ]
    rows = pixels
    if background:
        mode = mode_colour(pixels).select("frame_id", F.struct(F.lit("Background").alias("layer"), "red", "green", "blue").alias("_mode"))
        rows, targets = pixels.join(mode, "frame_id"), [F.col("_mode"), *targets]
    rows = rows.withColumn("_t", F.explode(F.array(*targets)))
    far = F.greatest(*[F.abs(F.col(ch) - F.col(f"_t.{ch}")) for ch in CHANNELS])
    return rows.select("frame_id", F.col("_t.layer").alias("layer"), "r", "c", F.when(far <= tol, 255).otherwise(0).alias("v"))


def layer_outlines(pixels: DataFrame, layers: Sequence[Layer], tol: int = 20, background: bool = True, size: tuple[int, int] | None = None) -> DataFrame:
    """Outer outlines (frame_id, layer, r, c) of each layer, after a 3x3 opening has removed specks."""
    keys = ("frame_id", "layer")
    cleaned = cut_lineage(grid.opening(layer_masks(pixels, layers, tol, background), keys=keys))
    return grid.outer_outline(cleaned, keys=keys, size=size).select(*keys, "r", "c")


def channels_long(pixels: DataFrame) -> DataFrame:
    """Colour pixels as one row per channel (0 blue, 1 green, 2 red)."""
    return pixels.select("frame_id", "r", "c", F.posexplode(F.array(*CHANNELS)).alias("ch", "v"))


def flat_field(channel_rows: DataFrame) -> DataFrame:
    """Median over all frames for each pixel and channel.

    Equal values are counted first, with partial counts before the shuffle: what moves is bounded by the value range
    of a pixel (256, or 4096 at 12 bit), not by the number of frames.
    """
    on = ["r", "c", "ch"]
    counts = channel_rows.groupBy(*on, "v").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*on).agg(F.percentile("v", F.lit(0.5), F.col("n")).alias("flat"))


def apply_flat(channel_rows: DataFrame, flat: DataFrame) -> DataFrame:
    """Divide by the flat field (at least 1) and scale by its mean.

    The flat is read twice, so pass a stored or checkpointed one rather than the aggregation itself.
    """
    floored = flat.select("r", "c", "ch", F.greatest(F.lit(1.0), F.col("flat")).alias("flat"))
    mean = floored.agg(F.avg("flat")).scalar()
    rows = channel_rows.join(floored, ["r", "c", "ch"])
    return rows.select("frame_id", "r", "c", "ch", (F.col("v") / F.col("flat") * mean).alias("v"))


def global_stretch(channel_rows: DataFrame) -> DataFrame:
    """Stretch each frame to 0..255 with one scale for all channels; a flat frame is only clipped."""
    limits = channel_rows.groupBy("frame_id").agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    rows = channel_rows.join(limits, "frame_id")
    stretched = F.when(F.col("_hi") > F.col("_lo"), (F.col("v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 255.0)
    v = F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.coalesce(stretched, F.col("v").cast("double"))))
    return rows.select("frame_id", "r", "c", "ch", F.floor(v).cast("int").alias("v"))


def temporal_average(pixels: DataFrame, n: int, keys: Sequence[str] = ("camera", "r", "c"), index: str = "n", size: int = 4096) -> DataFrame:
    """Mean of each pixel over the last ``n`` frames of its camera, truncated. ``index`` counts frames without gaps."""
    if n <= 1:
        return pixels.withColumn("avg_v", F.col("v").cast("int"))
    rows = ordered.with_halo(pixels, index, n - 1, size)
    frame = ordered.halo_window(keys, index).rowsBetween(-(n - 1), 0)
    return ordered.drop_halo(rows.withColumn("avg_v", F.floor(F.avg("v").over(frame)).cast("int")))
