"""All registered queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlake.functions import units
from scanlake.operators import pixels
from scanlake.plans import frames_catalogue, logs_catalogue, marks_catalogue, sources_catalogue, stream_catalogue
from scanlake.plans import surface_catalogue, sweeps_catalogue, tables, units_catalogue

_PARTS = (
    units_catalogue, frames_catalogue, sweeps_catalogue, surface_catalogue, logs_catalogue, marks_catalogue,
    sources_catalogue, stream_catalogue,
)


def sharpest_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharpest frame of each label, with its focus bar and class."""
    frames = tables.frames(spark, sf_dir)
    metric = pixels.focus_metric(frames, "LaplacianVariance")
    labels = tables.load(spark, sf_dir, "embeddings").selectExpr("vec_id AS frame_id", "label")
    scored = metric.join(labels, "frame_id").groupBy("label").agg(
        F.max(F.struct("metric", (-F.col("frame_id")).alias("minus"))).alias("top")
    )
    m = F.col("top.metric")
    return scored.select(
        "label", (-F.col("top.minus")).alias("frame_id"), (F.round(m * 4096) / 4096).alias("metric"),
        units.focus_bar(m).alias("bar"), units.focus_class(m).alias("focus"),
    )


_LAPLACIAN = """SELECT frame_id, var_pop(lap) AS metric FROM (
  SELECT frame_id, coalesce(lag(v) OVER rw, lead(v) OVER rw) + coalesce(lead(v) OVER rw, lag(v) OVER rw)
       + coalesce(lag(v) OVER cw, lead(v) OVER cw) + coalesce(lead(v) OVER cw, lag(v) OVER cw) - 4 * v AS lap
  FROM fx_frames WINDOW rw AS (PARTITION BY frame_id, r ORDER BY c), cw AS (PARTITION BY frame_id, c ORDER BY r)) GROUP BY frame_id"""

SHARPEST_SQL = tables.sql(
    """SELECT label, frame_id, round(metric * 4096) / 4096 AS metric,
  least(1000, CAST(trunc(log10(greatest(1e0, metric)) / 16e-1 * 1000) AS INT)) AS bar,
  CASE WHEN metric > 20 THEN 'sharp' WHEN metric > 5 THEN 'fair' ELSE 'poor' END AS focus
FROM (SELECT e.label, m.frame_id, m.metric, row_number() OVER (PARTITION BY e.label ORDER BY metric DESC, frame_id) AS k
      FROM m JOIN embeddings e ON e.vec_id = m.frame_id) WHERE k = 1""",
    "fx_frames", extra=f"m AS ({_LAPLACIAN})",
)


def _all() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    out = {"sharpest_frame": (sharpest_frame, SHARPEST_SQL)}
    for part in _PARTS:
        out.update(part.QUERIES)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, (fn, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql is not None}
