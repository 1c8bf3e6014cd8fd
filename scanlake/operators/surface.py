"""Focus maps: weighted polynomial surfaces over stage positions, one per map.

Points are rows (map_id, seq, x, y, z, metric). A model row carries cx, sx, cy, sy, coeffs, degree, z_ref and n_points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlake.operators import ordered
from scanlake.operators.ordered import INDEX_SLICE, SLICE

KEY = "map_id"
# Smallest weight of a point, fewest points of a usable map, share of the best metric that counts as poor.
MIN_WEIGHT = 1e-6
MIN_POINTS = 3
POOR_SHARE = 0.3


def monomials(degree: int) -> list[tuple[int, int]]:
    """Powers (of x, of y) of the surface terms in their fixed order: by total degree, then by the power of x."""
    return [(i, total - i) for total in range(degree + 1) for i in range(total + 1)]


def _product(*factors: str) -> Column:
    return F.expr(" * ".join(factors))


def fit_surface(points: DataFrame, degree: int = 2, manual_weight: float | None = None) -> DataFrame:
    """Weighted least squares of z - mean(z) in scaled x and y, weights from the metric.

    Two aggregations with partial sums do all work that grows with the points: centre and scale, then weighted moments.
    What is left per map is one row of moments, and the 3 to 10 unknowns are solved on those rows in batches.
    Maps with fewer points than coefficients get no model. ``manual_weight`` replaces the weight of points with metric 0.
    """
    terms = monomials(degree)
    stats = points.groupBy(KEY).agg(
        F.avg("x").alias("cx"), F.stddev_pop("x").alias("sx"), F.avg("y").alias("cy"), F.stddev_pop("y").alias("sy"),
        F.avg("z").alias("z_ref"), F.max("metric").alias("_top"), F.count(F.lit(1)).alias("n_points"),
    ).where(F.col("n_points") >= len(terms))
    stats = stats.withColumns({s: F.when(F.col(s) == 0, F.lit(1.0)).otherwise(F.col(s)) for s in ("sx", "sy")})
    rows = points.select(KEY, "x", "y", "z", "metric").join(stats, KEY)
    weight = F.when(F.col("_top") > 0, F.greatest(F.lit(MIN_WEIGHT), F.col("metric") / F.col("_top"))).otherwise(F.lit(1.0))
    if manual_weight is not None:
        weight = F.when(F.col("metric") == 0, F.lit(float(manual_weight))).otherwise(weight)
    rows = rows.select(
        KEY, weight.alias("w"), ((F.col("x") - F.col("cx")) / F.col("sx")).alias("u"), ((F.col("y") - F.col("cy")) / F.col("sy")).alias("v"),
        (F.col("z") - F.col("z_ref")).alias("d"),
    )
    powers = [(i, j) for i in range(2 * degree + 1) for j in range(2 * degree + 1 - i)]
    moments = rows.groupBy(KEY).agg(
        *[F.sum(_product("w", *"u" * i, *"v" * j)).alias(f"m{i}_{j}") for i, j in powers],
        *[F.sum(_product("w", *"u" * i, *"v" * j, "d")).alias(f"d{i}_{j}") for i, j in terms],
    )
    normal = F.array(*[f"m{a[0] + b[0]}_{a[1] + b[1]}" for a in terms for b in terms]).alias("normal")
    right = F.array(*[f"d{i}_{j}" for i, j in terms]).alias("right")
    system = moments.select(KEY, normal, right).join(stats.drop("_top"), KEY)
    size = len(terms)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                a = np.stack(pdf["normal"].to_numpy()).reshape(-1, size, size)
                b = np.stack(pdf["right"].to_numpy())
                inverse = np.linalg.pinv(a, rcond=1e-13, hermitian=True)
                pdf = pdf.assign(coeffs=list(np.einsum("kij,kj->ki", inverse, b)), degree=degree)
                yield pdf.drop(columns=["normal", "right"])

    key_type = points.schema[KEY].dataType.simpleString()
    names = [KEY, "cx", "sx", "cy", "sy", "z_ref", "n_points"]
    solved = system.select(*names, "normal", "right").mapInPandas(
        solve, f"{KEY} {key_type}, cx double, sx double, cy double, sy double, z_ref double, n_points bigint, coeffs array<double>, degree int"
    )
    return solved.select(*names, "degree", "coeffs")


def surface_offset(x: str, y: str, max_degree: int = 3) -> Column:
    """Surface value of the model columns at columns x and y; terms a lower degree lacks count as 0."""
    u, v = f"((`{x}` - cx) / sx)", f"((`{y}` - cy) / sy)"
    parts = [" * ".join([f"coalesce(get(coeffs, {k}), 0D)", *[u] * i, *[v] * j]) for k, (i, j) in enumerate(monomials(max_degree))]
    return F.when(F.col("coeffs").isNotNull(), F.expr(" + ".join(parts)))


def predict_surface(points: DataFrame, models: DataFrame, reference: DataFrame | None = None, out: str = "z_pred") -> DataFrame:
    """Focus height at each point; null without a model or with fewer than three points behind it.

    ``reference`` (map_id, z_applied) re-anchors maps; a map with a null reference predicts null.
    """
    fit = models.select(KEY, "cx", "sx", "cy", "sy", "coeffs", "z_ref", "n_points")
    if reference is not None:
        fit = fit.drop("z_ref").join(reference.select(KEY, F.col("z_applied").alias("z_ref")), KEY, "left")
    rows = points.join(fit, KEY, "left")
    z = F.when(F.col("n_points") >= MIN_POINTS, F.col("z_ref") + surface_offset("x", "y"))
    return rows.select(*[rows[c] for c in points.columns], z.alias(out))


def grid_query(maps: DataFrame, models: DataFrame, res: int = 100) -> DataFrame:
    """Surface offsets in um on a res x res mesh over the bounds (x_lo, x_hi, y_lo, y_hi) of each map."""
    steps = F.sequence(F.lit(0), F.lit(res - 1))
    mesh = maps.withColumn("yi", F.explode(steps)).withColumn("xi", F.explode(steps))
    for axis, index in (("x", "xi"), ("y", "yi")):
        lo, hi = F.least(f"{axis}_lo", f"{axis}_hi"), F.greatest(f"{axis}_lo", f"{axis}_hi")
        mesh = mesh.withColumn(axis, lo + F.col(index) * (hi - lo) / (res - 1))
    rows = mesh.select(KEY, "xi", "yi", "x", "y").join(models.select(KEY, "cx", "sx", "cy", "sy", "coeffs"), KEY)
    return rows.select(KEY, "xi", "yi", "x", "y", (surface_offset("x", "y") * 1000.0).alias("offset_um"))


def map_stats(points: DataFrame) -> DataFrame:
    """Spread of the offsets in um and quality of the metrics of each map."""
    base = points.groupBy(KEY).agg(
        F.min("z").alias("_lo"), F.max("z").alias("_hi"), F.avg("z").alias("_mean"), F.stddev_pop("z").alias("_std"),
        F.min("metric").alias("metric_min"), F.max("metric").alias("metric_max"), F.count(F.lit(1)).alias("n_points"),
    )
    # equal metrics are counted before they meet the maximum
    tally = points.groupBy(KEY, "metric").agg(F.count(F.lit(1)).alias("_n"))
    poor = tally.join(base.select(KEY, "metric_max"), KEY).where(F.col("metric") < F.col("metric_max") * POOR_SHARE)
    poor = poor.groupBy(KEY).agg(F.sum("_n").alias("n_poor"))
    out = base.join(poor, KEY, "left")
    return out.select(
        KEY, "n_points", ((F.col("_lo") - F.col("_mean")) * 1000).alias("min_um"), ((F.col("_hi") - F.col("_mean")) * 1000).alias("max_um"),
        ((F.col("_hi") - F.col("_lo")) * 1000).alias("peak_to_valley_um"), (F.col("_std") * 1000).alias("std_um"),
        "metric_min", "metric_max", F.coalesce("n_poor", F.lit(0)).alias("n_poor"),
    )


def reference_track(points: DataFrame, anchors: DataFrame | None = None, min_points: int = 1, order: tuple[str, ...] = ("seq",), size: int = INDEX_SLICE) -> DataFrame:
    """Add the running mean z (z_ref) and the applied reference as points come in by ``seq`` (then by the rest of ``order``).

    Below ``min_points`` there is no reference. ``anchors`` (map_id, anchor_seq, z_anchor) sets the applied reference by hand
    at one point; from there it shifts with the running mean.
    """
    sliced = points.withColumn(SLICE, ordered.index_slice(F.col("seq"), size))
    seen = ordered.running(sliced, [KEY], list(order), _sum=("sum", F.col("z")), _n=("count", F.lit(1))).drop(SLICE)
    seen = seen.withColumn("z_ref", F.when(F.col("_n") >= min_points, F.col("_sum") / F.col("_n"))).drop("_sum", "_n")
    if anchors is None:
        return seen.withColumn("z_applied", F.col("z_ref"))
    known = points.join(anchors, [KEY]).where(F.col("seq") <= F.col("anchor_seq"))
    at = known.groupBy(KEY, "anchor_seq", "z_anchor").agg(F.when(F.count(F.lit(1)) >= min_points, F.avg("z")).alias("_then"))
    rows = seen.join(at, KEY, "left")
    z = F.when(F.col("seq") >= F.col("anchor_seq"), F.col("z_anchor") + F.col("z_ref") - F.col("_then")).otherwise(F.col("z_ref"))
    return rows.select(*[c for c in seen.columns], z.alias("z_applied"))


def map_points(measured: DataFrame, skipped: DataFrame) -> DataFrame:
    """Measured and skipped points as one set; metric 0 marks a point focused by hand."""
    kind = F.when(F.col("metric") == 0, "manual").otherwise("measured")
    done = measured.withColumn("status", kind)
    return done.unionByName(skipped.withColumn("status", F.lit("skipped")), allowMissingColumns=True)
