"""Measuring grids, their visiting order and time estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanlake.operators import edges, ordered


def _snake(xi: Column, yi: Column, cols: Column) -> Column:
    """Visiting number on a full grid: left to right on even rows, right to left on odd ones."""
    return yi * cols + F.when(yi % 2 == 0, xi).otherwise(cols - 1 - xi)


def _mesh(df: DataFrame, cols: Column, rows: Column) -> DataFrame:
    df = df.select("*", cols.cast("long").alias("_cols"), rows.cast("long").alias("_rows")).where("_cols > 0 and _rows > 0")
    df = df.withColumn("yi", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_rows") - 1)))
    df = df.withColumn("xi", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_cols") - 1)))
    return df.withColumn("seq", _snake(F.col("xi"), F.col("yi"), F.col("_cols"))).drop("_cols", "_rows")


def focus_grid(bounds: DataFrame, cols: int, rows: int) -> DataFrame:
    """``cols`` x ``rows`` points inside the bounds, one grid period away from the rim, in serpentine order."""
    rest = [c for c in bounds.columns if c not in ("x_lo", "x_hi", "y_lo", "y_hi")]
    grid = _mesh(bounds, F.lit(cols), F.lit(rows))
    place = {}
    for axis, index, n in (("x", "xi", cols), ("y", "yi", rows)):
        lo, hi = F.least(f"{axis}_lo", f"{axis}_hi"), F.greatest(f"{axis}_lo", f"{axis}_hi")
        place[axis] = lo + (F.col(index) + 1) * (hi - lo) / (n + 1)
    return grid.select(*rest, "seq", place["x"].alias("x"), place["y"].alias("y"))


def scan_grid(bounds: DataFrame, step_x: float, step_y: float, inset_mm: float = 0.0) -> DataFrame:
    """Points of a wafer scan: from the inset lower bound in whole steps, the upper bound left out."""
    rest = [c for c in bounds.columns if c not in ("x_lo", "x_hi", "y_lo", "y_hi")]
    zone = edges.safe_zone(bounds, inset_mm).where("status = 'ok'").drop("status")
    n_x = F.ceil((F.col("x_hi") - F.col("x_lo")) / step_x)
    n_y = F.ceil((F.col("y_hi") - F.col("y_lo")) / step_y)
    grid = _mesh(zone, n_x, n_y)
    return grid.select(*rest, "seq", (F.col("x_lo") + F.col("xi") * step_x).alias("x"), (F.col("y_lo") + F.col("yi") * step_y).alias("y"))


def serpentine_order(points: DataFrame, keys: tuple[str, ...] = ("map_id",), xi: str = "xi", yi: str = "yi") -> DataFrame:
    """Add ``seq``, the visiting number of grid points that need not fill the grid. A grid row is one slice."""
    along = F.when(F.pmod(F.col(yi), F.lit(2)) == 0, F.col(xi)).otherwise(-F.col(xi))
    return ordered.dense_index(points.withColumn("_along", along), list(keys), [yi, "_along"], F.col(yi).cast("long"), "seq").drop("_along")


def limit_positions(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], n: int = 10) -> DataFrame:
    """First ``n`` rows of each key as slots 1 to n. Each task keeps at most n rows of a key before the shuffle."""
    slot = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("slot", slot).where(F.col("slot") <= n)


#: Prime modulus of the seeded numbers.
PRIME = 2_147_483_647


def random_offsets(starts: DataFrame, n: int, range_mm: float, key: str, seed: int = 0) -> DataFrame:
    """``n`` seeded uniform positions round each start point (x, y) with its integer ``key``.

    The numbers are squares and products modulo a prime: whole-number arithmetic that gives the same everywhere.
    """
    rows = starts.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    p = F.lit(PRIME).cast("long")

    def mixed(x: Column) -> Column:
        return (x * x + x * 1_103_515_245 + 12_345) % p

    def offset(salt: int) -> Column:
        start = F.pmod(F.col(key).cast("long"), p)
        first = (start * 48_271 + F.col("k") * 69_621 + F.lit(seed * 40_692 + salt * 16_807).cast("long")) % p
        return (2.0 * (mixed(mixed(first)) / float(PRIME)) - 1.0) * range_mm

    return rows.withColumn("x", F.col("x") + offset(1)).withColumn("y", F.col("y") + offset(2))
