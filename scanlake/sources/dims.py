"""Small look-up tables with fixed content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Objective -> pixels per um, scale bar um, exposure us, z jog um.
OBJECTIVES = [
    ("5x", 1.015, 200, 3500, 40),
    ("10x", 2.03, 100, 7000, 20),
    ("20x", 4.06, 50, 13000, 10),
    ("50x", 10.15, 20, 30000, 4),
    ("100x", 20.3, 5, 60000, 2),
]
# Stage axis -> mm per count, direction, travel in mm.
AXES = [
    ("X", 0.001, -1, -127.5, 127.5),
    ("Y", 0.001, 1, -107.5, 107.5),
    ("Z", 0.000025, -1, 0.0, 25.0),
]
# Built-in autofocus settings by magnification, in declared order.
AUTOFOCUS = [
    {"ord": 1, "mag": 5.0, "metric": "LaplacianVariance", "step_mm": 0.010, "settle_ms": 20, "coarse_factor": 4, "fine_factor": 0.25, "fine_range_factor": 1.0, "z_range_mm": 4.0, "trend_n": 10, "n_avg": 1},
    {"ord": 2, "mag": 10.0, "metric": "LaplacianVariance", "step_mm": 0.003, "settle_ms": 30, "coarse_factor": 6, "fine_factor": 0.20, "fine_range_factor": 0.75, "z_range_mm": 2.0, "trend_n": 10, "n_avg": 1},
    {"ord": 3, "mag": 20.0, "metric": "LaplacianVariance", "step_mm": 0.001, "settle_ms": 50, "coarse_factor": 10, "fine_factor": 0.10, "fine_range_factor": 0.5, "z_range_mm": 1.0, "trend_n": 10, "n_avg": 1},
    {"ord": 4, "mag": 40.0, "metric": "LaplacianVariance", "step_mm": 0.001, "settle_ms": 80, "coarse_factor": 10, "fine_factor": 0.10, "fine_range_factor": 0.5, "z_range_mm": 0.5, "trend_n": 10, "n_avg": 2},
    {"ord": 5, "mag": 100.0, "metric": "LaplacianVariance", "step_mm": 0.001, "settle_ms": 100, "coarse_factor": 10, "fine_factor": 0.10, "fine_range_factor": 0.5, "z_range_mm": 0.3, "trend_n": 10, "n_avg": 3},
]


def objectives(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(OBJECTIVES, "mag string, ppm double, bar_um int, exposure_us int, z_jog_um int")


def axis_config(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(AXES, "axis string, step double, invert int, min_mm double, max_mm double")
