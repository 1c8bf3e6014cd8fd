"""Unit conversion, optics and geometry as Column builders.

Rounding is half-even (``rint``, ``bround``) and whole pixels and counts are truncated, as instrument logs have them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Calibration (pixels per um) and scale bar (um) of each objective.
PIXELS_PER_UM = {"5x": 1.015, "10x": 2.03, "20x": 4.06, "50x": 10.15, "100x": 20.3}
SCALE_BAR_UM = {"5x": 200, "10x": 100, "20x": 50, "50x": 20, "100x": 5}
DEFAULT_BAR_UM = 100
# Cross-hair tick and zoom bar ladders (um).
TICK_LADDER_UM = [1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 2000]
ZOOM_LADDER_UM = [1, 2, 5, 10, 20, 50, 100, 200]
# Exposure slider range (us).
EXPOSURE_MIN_US = 10.0
EXPOSURE_MAX_US = 1_000_000.0
# Autofocus window in steps each side of the start.
WINDOW_STEPS = {"map": 50, "coarse": 25, "fine": 10}

UM_PER_MM = 1000.0


def _d(value: float | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def clamp(value: Column, low: Column | float, high: Column | float) -> Column:
    return F.greatest(_d(low), F.least(value, _d(high)))


def counts_to_mm(counts: Column, step: Column, invert: Column) -> Column:
    return counts * step * invert


def mm_to_counts(mm: Column, step: Column, invert: Column) -> Column:
    return F.rint(mm / step * invert).cast("long")


def exposure_from_pos(pos: Column) -> Column:
    """Log-scale slider position (0 to 1000) to microseconds."""
    return F.rint(EXPOSURE_MIN_US * F.pow(F.lit(EXPOSURE_MAX_US / EXPOSURE_MIN_US), pos / 1000.0)).cast("long")


def pos_from_exposure(exposure_us: Column) -> Column:
    span = F.ln(F.lit(EXPOSURE_MAX_US / EXPOSURE_MIN_US))
    return F.rint(F.ln(F.greatest(F.lit(EXPOSURE_MIN_US), exposure_us) / EXPOSURE_MIN_US) / span * 1000).cast("long")


def legacy_exposure_us(value: Column) -> Column:
    """Values below 1000 are taken as units of 100 us."""
    return F.when(value < 1000, value * 100).otherwise(value)


def was_legacy(value: Column) -> Column:
    return value < 1000


def wb_ratios(kelvin: Column) -> tuple[Column, Column]:
    """Red and blue gain relative to green."""
    t = clamp((kelvin - 2800.0) / 4700.0, 0.0, 1.0)
    return 2.2 - t * 1.4, 0.7 + t * 1.3


def ppm_effective(ppm: Column, binning: Column) -> Column:
    return ppm / binning


def bar_um(mag: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in SCALE_BAR_UM.items() for x in pair])
    return F.coalesce(known[mag], F.lit(DEFAULT_BAR_UM))


def scale_bar_px(ppm_eff: Column, bar: Column) -> Column:
    return (ppm_eff * bar).cast("int")


def fov_mm(pixels: Column, ppm: Column, digits: int | None = None) -> Column:
    """Field of view of ``pixels`` pixels; the scan step uses 3 digits."""
    size = pixels / ppm / UM_PER_MM
    return size if digits is None else F.bround(size, digits)


def pixel_to_stage(px: Column, py: Column, width: Column | float, height: Column | float, ppm: Column) -> tuple[Column, Column]:
    """Stage move that centres pixel (px, py); image y points down, stage y up."""
    return (px - _d(width) / 2.0) / ppm / UM_PER_MM, -(py - _d(height) / 2.0) / ppm / UM_PER_MM


def map_to_mm(px: Column, py: Column, width: float, height: float, limits_um: Sequence[float]) -> tuple[Column, Column]:
    """Stage-map pixel to stage position, held inside the travel ``(x_min, x_max, y_min, y_max)`` in um."""
    x_lo, x_hi, y_lo, y_hi = (float(v) for v in limits_um)
    x = (px / float(width) * (x_hi - x_lo) + x_lo) / UM_PER_MM
    y = ((1.0 - py / float(height)) * (y_hi - y_lo) + y_lo) / UM_PER_MM
    return clamp(x, x_lo / UM_PER_MM, x_hi / UM_PER_MM), clamp(y, y_lo / UM_PER_MM, y_hi / UM_PER_MM)


def mm_to_map(x_um: Column, y_um: Column, width: float, height: float, limits_um: Sequence[float]) -> tuple[Column, Column]:
    x_lo, x_hi, y_lo, y_hi = (float(v) for v in limits_um)
    px = ((x_um - x_lo) / (x_hi - x_lo) * float(width)).cast("int")
    py = ((1.0 - (y_um - y_lo) / (y_hi - y_lo)) * float(height)).cast("int")
    return px, py


def measure(x1: Column, y1: Column, x2: Column, y2: Column, ppm: Column) -> dict[str, Column]:
    """Length and angle between two image points, each with its error for a one pixel slip."""
    dx, dy = x2 - x1, y2 - y1
    dist = F.sqrt(dx * dx + dy * dy)
    return {
        "dist_px": dist,
        "dist_um": dist / ppm,
        "dist_err_um": F.lit(1.0) / ppm,
        "angle_deg": F.degrees(F.atan2(dy, dx)),
        "angle_err_deg": F.when(dist != 0, F.degrees(F.atan2(F.lit(1.0), dist))).otherwise(F.lit(0.0)),
    }


def grid_to_stage(dxx: Column, dyy: Column, theta_deg: Column, spacing_mm: float = 0.5) -> tuple[Column, Column]:
    """Stage move for a move of (dxx, dyy) grid cells on a sample turned by ``theta_deg``."""
    cos, sin = F.cos(F.radians(theta_deg)), F.sin(F.radians(theta_deg))
    return (dxx * cos - dyy * sin) * spacing_mm, (dxx * sin + dyy * cos) * spacing_mm


def contrast_pct(colour: Sequence[Column], background: Sequence[Column]) -> Column:
    """Optical contrast in percent of the background, null on a black background."""
    col, back = sum(colour[1:], colour[0]) / 3.0, sum(background[1:], background[0]) / 3.0
    return F.when(back > 0, (col - back) / back * 100.0)


def colour_from_contrast(background: Column, contrast: Column) -> Column:
    """One channel of the colour that has ``contrast`` percent against ``background``."""
    return clamp(background * (1.0 + contrast / 100.0), 0.0, 255.0).cast("int")


def to_gray(blue: Column, green: Column, red: Column) -> Column:
    """Integer luma of 8-bit channels (weights in 1/32768)."""
    return F.shiftright(9798 * red + 19235 * green + 3735 * blue + 16384, 15).cast("int")


def scale_12_to_16(value: Column) -> Column:
    return value * 16


def first_nice(ladder: Sequence[int], test: Callable[[Column], Column], default: Column | int, descending: bool = False) -> Column:
    """First ladder value that passes ``test``, else ``default``."""
    steps = [F.lit(v) for v in (reversed(ladder) if descending else ladder)]
    default = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.get(F.filter(F.array(*steps), test), F.lit(0)), default)


def tick_interval_um(half_width_um: Column) -> Column:
    """Tick distance that gives at most ten ticks each side."""
    return first_nice(TICK_LADDER_UM, lambda v: half_width_um / v <= 10, TICK_LADDER_UM[-1])


def zoom_bar_um(ppm_zoom: Column) -> Column:
    """Largest bar of at most 200 px; one of at least 30 px if there is none."""
    wide = first_nice(ZOOM_LADDER_UM, lambda v: ppm_zoom * v >= 30, ZOOM_LADDER_UM[0])
    return first_nice(ZOOM_LADDER_UM, lambda v: ppm_zoom * v <= 200, wide, descending=True)


def focus_bar(laplacian: Column) -> Column:
    """Focus bar, 0 to 1000, logarithmic from 1 to 40."""
    return F.least(F.lit(1000), (F.log10(F.greatest(F.lit(1.0), laplacian)) / 1.6 * 1000).cast("int"))


def focus_class(laplacian: Column) -> Column:
    return F.when(laplacian > 20, "sharp").when(laplacian > 5, "fair").otherwise("poor")


def estimate_scan_s(n: Column, settle_s: Column | float, fps: Column) -> Column:
    frame_time = F.when(fps > 0, 1.0 / fps).otherwise(F.lit(0.1))
    return n * (_d(settle_s) + 0.3 + frame_time)


def autofocus_window(z0: Column, step_mm: Column, kind: str = "map", z_range_mm: Column | None = None) -> tuple[Column, Column]:
    """Lower and upper z of a search: a number of steps, or three times ``z_range_mm`` for ``kind='panel'``.

    ``coarse`` runs on doubled steps.
    """
    if kind == "panel":
        if z_range_mm is None:
            raise ValueError("the panel window needs z_range_mm")
        span = z_range_mm * 3
    else:
        span = step_mm * (2 if kind == "coarse" else 1) * WINDOW_STEPS[kind]
    return z0 - span, z0 + span
