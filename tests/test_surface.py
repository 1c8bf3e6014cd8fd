"""Focus maps: exact surfaces, agreement with a least-squares solver, rank-deficient input and references."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanlake.operators import planning, surface

SCHEMA = "map_id long, seq long, x double, y double, z double, metric double"


def table(spark, maps):
    return spark.createDataFrame([(k, i, *map(float, row)) for k, rows in maps.items() for i, row in enumerate(rows)], SCHEMA)


def cloud(rng, n, fn, metric=None):
    xy = rng.uniform(-40, 60, (n, 2))
    m = rng.uniform(10, 900, n) if metric is None else np.full(n, metric)
    return np.column_stack([xy, fn(xy[:, 0], xy[:, 1]), m])


def lstsq(rows, degree, weights=None):
    x, y, z, m = rows.T
    sx, sy = x.std() or 1.0, y.std() or 1.0
    u, v = (x - x.mean()) / sx, (y - y.mean()) / sy
    w = np.maximum(m / m.max(), 1e-6) if m.max() > 0 else np.ones(len(m))
    w = w if weights is None else weights
    a = np.column_stack([u**i * v**j for i, j in surface.monomials(degree)])
    return np.linalg.lstsq(a * np.sqrt(w)[:, None], (z - z.mean()) * np.sqrt(w), rcond=None)[0]


@pytest.mark.parametrize("degree", [1, 2, 3])
def test_fit_agrees_with_solver(spark, degree):
    rng = np.random.default_rng(degree)
    maps = {k: cloud(rng, 60, lambda x, y: 3 + 0.01 * x - 0.02 * y + 1e-4 * x * y + rng.normal(0, 0.01, len(x))) for k in range(4)}
    maps[8] = cloud(rng, 20, lambda x, y: x * 0.1, metric=0.0)
    maps[9] = cloud(rng, 2, lambda x, y: x)
    got = {r["map_id"]: r["coeffs"] for r in surface.fit_surface(table(spark, maps), degree).collect()}
    assert got.keys() == maps.keys() - {9}
    for k, coeffs in got.items():
        assert coeffs == pytest.approx(lstsq(maps[k], degree).tolist(), abs=1e-9)


def test_plane_and_quadratic_are_recovered(spark):
    rng = np.random.default_rng(0)
    maps = {1: cloud(rng, 12, lambda x, y: 5 + 0.2 * x - 0.1 * y), 2: cloud(rng, 12, lambda x, y: 1 + 0.01 * x * x - 0.003 * x * y + 0.5 * y)}
    points = table(spark, maps)
    rows = surface.predict_surface(points, surface.fit_surface(points, 2)).collect()
    assert all(r["z_pred"] == pytest.approx(r["z"], abs=1e-8) for r in rows)


def test_collinear_points_take_the_smallest_solution(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(0, 9, 15)
    rows = np.column_stack([x, np.full(15, 4.0), 2 + 0.3 * x, np.full(15, 50.0)])
    got = surface.fit_surface(table(spark, {1: rows}), 2).first()
    assert got["sy"] == 1.0 and got["coeffs"] == pytest.approx(lstsq(rows, 2).tolist(), abs=1e-7)


def test_manual_points(spark):
    rng = np.random.default_rng(3)
    rows = cloud(rng, 20, lambda x, y: x * 0.1 + rng.normal(0, 1, len(x)))
    rows[:5, 3] = 0.0
    weights = np.where(rows[:, 3] == 0, 0.5, np.maximum(rows[:, 3] / rows[:, 3].max(), 1e-6))
    got = surface.fit_surface(table(spark, {1: rows}), 1, manual_weight=0.5).first()["coeffs"]
    assert got == pytest.approx(lstsq(rows, 1, weights).tolist(), abs=1e-9)


def test_prediction_without_model_or_reference(spark):
    rng = np.random.default_rng(1)
    points = table(spark, {1: cloud(rng, 9, lambda x, y: x), 2: cloud(rng, 9, lambda x, y: y)})
    models = surface.fit_surface(points.where("map_id < 3"), 1)
    asked = points.unionByName(points.where("map_id = 1").withColumn("map_id", F.lit(7).cast("long")))
    applied = spark.createDataFrame([(1, 100.0)], "map_id long, z_applied double")
    out = surface.predict_surface(asked, models, applied).groupBy("map_id").agg(F.count("z_pred").alias("n"), F.avg("z_pred").alias("z")).collect()
    by = {r["map_id"]: (r["n"], r["z"]) for r in out}
    assert by[1] == (9, pytest.approx(100.0)) and by[2][0] == 0 and by[7][0] == 0


def test_grid_query_matches_prediction(spark):
    rng = np.random.default_rng(2)
    points = table(spark, {1: cloud(rng, 30, lambda x, y: 2 + x * 0.1 + y * y * 0.01)})
    models = surface.fit_surface(points, 2)
    bounds = spark.createDataFrame([(1, 10.0, -5.0, 0.0, 20.0)], "map_id long, x_lo double, x_hi double, y_lo double, y_hi double")
    mesh = surface.grid_query(bounds, models, 5)
    both = surface.predict_surface(mesh, models).join(models.select("map_id", "z_ref"), "map_id").collect()
    assert len(both) == 25 and {r["x"] for r in both} == {-5.0, -1.25, 2.5, 6.25, 10.0}
    assert all((r["z_pred"] - r["z_ref"]) * 1000 == pytest.approx(r["offset_um"]) for r in both)


def test_reference_track(spark):
    points = table(spark, {1: [(0, 0, z, 1) for z in (1.0, 2.0, 6.0, 3.0)]})
    anchors = spark.createDataFrame([(1, 2, 50.0)], "map_id long, anchor_seq long, z_anchor double")
    rows = sorted((r["seq"], r["z_ref"], r["z_applied"]) for r in surface.reference_track(points, anchors, min_points=1, size=2).collect())
    assert rows == [(0, 1.0, 1.0), (1, 1.5, 1.5), (2, 3.0, 50.0), (3, 3.0, 50.0)]
    assert [r["z_ref"] for r in surface.reference_track(points, min_points=3).orderBy("seq").collect()] == [None, None, 3.0, 3.0]


def test_map_stats(spark):
    got = surface.map_stats(table(spark, {1: [(0, 0, 1.0, 10), (0, 1, 1.002, 2.9), (1, 0, 1.004, 3.0)]})).first()
    assert got["peak_to_valley_um"] == pytest.approx(4.0) and got["std_um"] == pytest.approx(np.std([0, 2, 4])) and got["n_poor"] == 1


BOUNDS = "map_id long, x_lo double, x_hi double, y_lo double, y_hi double"


def test_grids(spark):
    bounds = spark.createDataFrame([(1, 10.0, 0.0, 0.0, 3.0)], BOUNDS)
    grid = planning.focus_grid(bounds, 4, 2).orderBy("seq").collect()
    assert [r["x"] for r in grid] == pytest.approx([2, 4, 6, 8, 8, 6, 4, 2]) and [r["y"] for r in grid] == pytest.approx([1] * 4 + [2] * 4)
    scan = planning.scan_grid(bounds, 2.5, 1.0, 0.5).orderBy("seq").collect()
    assert [(r["x"], r["y"]) for r in scan] == [(x, y) for k, y in enumerate(np.arange(0.5, 2.5, 1.0)) for x in np.arange(0.5, 9.5, 2.5)[:: -1 if k % 2 else 1]]
    assert planning.scan_grid(bounds, 1.0, 1.0, 2.0).count() == 0


def test_random_offsets_are_seeded(spark):
    start = spark.createDataFrame([(1, 5.0, -5.0)], "id long, x double, y double")
    a, b = (planning.random_offsets(start, 200, 0.5, "id", seed=s).collect() for s in (1, 1))
    assert a == b and a != planning.random_offsets(start, 200, 0.5, "id", seed=2).collect()
    assert all(4.5 <= r["x"] <= 5.5 and -5.5 <= r["y"] <= -4.5 for r in a) and len({r["x"] for r in a}) == 200
