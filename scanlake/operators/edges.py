"""Wafer edges from intensity traces: rows (scan_id, dir, i, step_mm, pos_mm, intensity)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlake.operators import ordered

TRACE = ("scan_id", "dir")
DIRECTIONS = ("x_negative", "x_positive", "y_negative", "y_positive")
# Fixed value: without a crossing, the last position counts as edge after more than 50 steps.
LIMIT_STEPS = 50


def auto_threshold(traces: DataFrame, keys: tuple[str, ...] = TRACE) -> DataFrame:
    """Dark threshold of each trace: half of its first intensity, at least 10."""
    first = traces.groupBy(*keys).agg(F.min_by("intensity", "i").alias("first"))
    return first.select(*keys, F.greatest(F.lit(10.0), 0.5 * F.col("first")).alias("threshold"))


def find_edge(traces: DataFrame, thresholds: DataFrame, k: int = 3, cap: int | None = None, size: int = ordered.INDEX_SLICE) -> DataFrame:
    """First place where ``k`` steps in a row are darker than the threshold.

    ``i`` numbers the steps of a trace without gaps. The whole trace takes part; with ``cap`` only its first ``cap`` steps, as in a
    search that gives up. ``edge_kind`` is ``crossed``, ``limit`` or ``none``. Slices of the index, each with the last steps of the
    one before, keep a long trace out of one task.
    """
    on = [c for c in TRACE if c in thresholds.columns]
    rows = traces.where(F.col("i") >= 0) if cap is None else traces.where((F.col("i") >= 0) & (F.col("i") < cap))
    rows = ordered.with_halo(rows.join(thresholds, on), "i", k - 1, size)
    w = ordered.halo_window(TRACE, "i").rowsBetween(-(k - 1), 0)
    dark = (F.col("intensity") < F.col("threshold")).cast("int")
    rows = rows.withColumn("_run", F.sum(dark).over(w))
    at = F.struct(F.col("i"), (F.col("pos_mm") - (k - 1) * F.col("step_mm")).alias("pos"))
    found = ordered.drop_halo(rows).groupBy(*TRACE).agg(
        F.min(F.when(F.col("_run") == k, at)).alias("hit"),
        F.count(F.lit(1)).alias("n"),
        F.max(F.struct(F.col("i"), F.col("pos_mm").alias("pos"))).alias("end"),
    )
    limit = F.col("n") > LIMIT_STEPS
    kind = F.when(F.col("hit").isNotNull(), "crossed").when(limit, "limit").otherwise("none")
    edge = F.when(F.col("hit").isNotNull(), F.col("hit.pos")).when(limit, F.col("end.pos"))
    return found.select(*TRACE, edge.alias("edge_mm"), kind.alias("edge_kind"))


def wafer_extents(edges: DataFrame) -> DataFrame:
    """The four edges of a scan as columns, with width and height (0 unless all four are known)."""
    cols = [F.max(F.when(F.col("dir") == d, F.col("edge_mm"))).alias(d) for d in DIRECTIONS]
    wide = edges.groupBy("scan_id").agg(*cols)
    whole = F.lit(True)
    for d in DIRECTIONS:
        whole = whole & F.col(d).isNotNull()
    width = F.when(whole, F.abs(F.col("x_positive") - F.col("x_negative"))).otherwise(F.lit(0.0))
    height = F.when(whole, F.abs(F.col("y_positive") - F.col("y_negative"))).otherwise(F.lit(0.0))
    return wide.select("*", width.alias("width_mm"), height.alias("height_mm"))


def complete_only(extents: DataFrame) -> DataFrame:
    """Scans with all four edges."""
    return extents.dropna(subset=list(DIRECTIONS))


def safe_zone(bounds: DataFrame, inset_mm: float) -> DataFrame:
    """Bounds moved inwards on each side; ``status`` is ``error`` where nothing is left.

    Expects x_lo, x_hi, y_lo, y_hi in either order.
    """
    lo = {a: F.least(f"{a}_lo", f"{a}_hi") + inset_mm for a in "xy"}
    hi = {a: F.greatest(f"{a}_lo", f"{a}_hi") - inset_mm for a in "xy"}
    rest = [c for c in bounds.columns if c not in ("x_lo", "x_hi", "y_lo", "y_hi")]
    out = bounds.select(*rest, lo["x"].alias("x_lo"), hi["x"].alias("x_hi"), lo["y"].alias("y_lo"), hi["y"].alias("y_hi"))
    bad = (F.col("x_lo") >= F.col("x_hi")) | (F.col("y_lo") >= F.col("y_hi"))
    return out.withColumn("status", F.when(bad, "error").otherwise("ok"))
