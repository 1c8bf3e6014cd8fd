"""Queries on focus maps and measuring grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanlake.operators import planning, surface
from scanlake.plans import tables

C = F.col


def _fit(spark, sf_dir, degree):
    return surface.fit_surface(tables.points(spark, sf_dir), degree)


def _coefficients(degree):
    def query(spark, sf_dir):
        return _fit(spark, sf_dir, degree).select("map_id", F.posexplode("coeffs").alias("k", "c")).select("map_id", "k", F.round("c", 6).alias("coeff"))

    return query


def _solve_sql(degree: int, manual: bool = False) -> str:
    """Tables st (centre, scale) and g<n> (coefficients a<k>_<n>): normal equations, eliminated one pivot at a time."""
    terms = surface.monomials(degree)
    n = len(terms)

    def power(i, j):
        return "*".join(["w"] + ["u"] * i + ["v"] * j)

    cells = [f"sum({power(a[0] + b[0], a[1] + b[1])}) AS a{i}_{j}" for i, a in enumerate(terms) for j, b in enumerate(terms)]
    cells += [f"sum({power(*a)}*d) AS a{i}_{n}" for i, a in enumerate(terms)]
    parts = [
        """st AS (SELECT map_id, avg(x) AS cx, coalesce(nullif(stddev_pop(x), 0), 1) AS sx, avg(y) AS cy, coalesce(nullif(stddev_pop(y), 0), 1) AS sy,
        avg(z) AS z_ref, max(metric) AS top, count(*) AS n_points FROM fx_points GROUP BY 1)""",
        """nm AS (SELECT map_id, CASE WHEN top > 0 THEN greatest(metric / top, 1e-6) ELSE 1 END AS w, (x - cx) / sx AS u, (y - cy) / sy AS v, z - z_ref AS d
        FROM fx_points JOIN st USING (map_id))""",
        f"g0 AS (SELECT map_id, {', '.join(cells)} FROM nm GROUP BY 1)",
    ]
    for p in range(n):
        cols = []
        for i in range(n):
            for j in range(p + 1, n + 1):
                pivot = f"a{p}_{j} / a{p}_{p}"
                cols.append(f"{pivot} AS a{p}_{j}" if i == p else f"a{i}_{j} - a{i}_{p} * ({pivot}) AS a{i}_{j}")
        parts.append(f"g{p + 1} AS (SELECT map_id, {', '.join(cols)} FROM g{p})")
    return ", ".join(parts)


def _coefficient_sql(degree: int) -> str:
    n = len(surface.monomials(degree))
    values = ", ".join(f"a{k}_{n}" for k in range(n))
    return tables.sql(
        f"SELECT map_id, CAST(k AS INT) AS k, round(c, 6) AS coeff FROM (SELECT map_id, unnest([{values}]) AS c, generate_subscripts([{values}], 1) - 1 AS k FROM g{n})",
        "fx_points", extra=_solve_sql(degree),
    )


def _poly_sql(degree: int, u: str, v: str) -> str:
    terms = surface.monomials(degree)
    return " + ".join(f"a{k}_{len(terms)}" + f" * ({u})" * i + f" * ({v})" * j for k, (i, j) in enumerate(terms))


def predict(spark, sf_dir):
    points = tables.points(spark, sf_dir)
    out = surface.predict_surface(points, surface.fit_surface(points, 2))
    return out.select("map_id", "seq", "x", "y", F.round("z_pred", 5).alias("z_pred"))


def _map_bounds(points):
    return points.groupBy("map_id").agg(F.min("x").alias("x_lo"), F.max("x").alias("x_hi"), F.min("y").alias("y_lo"), F.max("y").alias("y_hi"))


def mesh(spark, sf_dir):
    points = tables.points(spark, sf_dir)
    out = surface.grid_query(_map_bounds(points), surface.fit_surface(points, 2), 20)
    return out.select("map_id", "xi", "yi", F.round("offset_um", 3).alias("offset_um"))


def map_stats(spark, sf_dir):
    out = surface.map_stats(tables.points(spark, sf_dir))
    return out.select("map_id", "n_points", *[F.round(c, 3).alias(c) for c in ("min_um", "max_um", "peak_to_valley_um", "std_um")], "metric_min", "metric_max", "n_poor")


_ORDER = ("seq", "x", "y", "z")
STRETCH = 1.0471975511965976


def reference_track(spark, sf_dir):
    anchors = tables.load(spark, sf_dir, "supplier").selectExpr("s_suppkey AS map_id", "s_suppkey * 1000 AS anchor_seq", "s_acctbal / 100 AS z_anchor")
    points = tables.points(spark, sf_dir).withColumn("z", C("z") * STRETCH)  # no mean sits on a rounding tie
    out = surface.reference_track(points, anchors, min_points=3, order=_ORDER)
    return out.select("map_id", "seq", "x", "y", F.round("z_ref", 6).alias("z_ref"), F.round("z_applied", 6).alias("z_applied"))


def map_points(spark, sf_dir):
    points = tables.points(spark, sf_dir)
    measured = points.where("seq % 7 <> 0").withColumn("metric", F.when(C("seq") % 11 == 0, F.lit(0.0)).otherwise(C("metric")))
    return surface.map_points(measured, points.where("seq % 7 = 0").select("map_id", "seq", "x", "y"))


_BOUNDS_SQL = "SELECT s_suppkey AS map_id, s_acctbal / 1e3 AS x_lo, -(s_suppkey % 9) * 1e0 AS x_hi, -s_nationkey / 4e0 AS y_lo, 3 + s_acctbal / 2e3 AS y_hi FROM supplier"


def _bounds(spark, sf_dir):
    return tables.load(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS map_id", "s_acctbal / 1e3 AS x_lo", "-(s_suppkey % 9) * 1e0 AS x_hi", "-s_nationkey / 4e0 AS y_lo", "3 + s_acctbal / 2e3 AS y_hi"
    )


def focus_grid(spark, sf_dir):
    out = planning.focus_grid(_bounds(spark, sf_dir), 5, 4)
    return out.select("map_id", "seq", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def scan_grid(spark, sf_dir):
    out = planning.scan_grid(_bounds(spark, sf_dir), 0.31, 0.27, 0.25)
    return out.select("map_id", "seq", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def serpentine(spark, sf_dir):
    cells = tables.load(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS map_id", "CAST(l_partkey % 50 AS INT) AS xi", "CAST(l_orderkey % 40 AS INT) AS yi").distinct()
    return planning.serpentine_order(cells).select("map_id", "xi", "yi", "seq")


QUERIES = {
    "ag9_fit_surface_1": (_coefficients(1), _coefficient_sql(1)),
    "ag9_fit_surface_2": (_coefficients(2), _coefficient_sql(2)),
    "ag9_fit_surface_3": (_coefficients(3), _coefficient_sql(3)),
    "jn3_predict_surface": (
        predict,
        tables.sql(
            f"SELECT map_id, seq, x, y, round(z_ref + {_poly_sql(2, '(x - cx) / sx', '(y - cy) / sy')}, 5) AS z_pred FROM fx_points JOIN st USING (map_id) JOIN g6 USING (map_id)",
            "fx_points", extra=_solve_sql(2),
        ),
    ),
    "jn6_grid_query": (
        mesh,
        tables.sql(
            f"""SELECT map_id, xi, yi, round(({_poly_sql(2, '(x - cx) / sx', '(y - cy) / sy')}) * 1000, 3) AS offset_um FROM (
            SELECT map_id, xi, yi, x_lo + xi * (x_hi - x_lo) / 19 AS x, y_lo + yi * (y_hi - y_lo) / 19 AS y FROM (
            SELECT map_id, min(x) AS x_lo, max(x) AS x_hi, min(y) AS y_lo, max(y) AS y_hi FROM fx_points GROUP BY 1),
            (SELECT CAST(unnest(range(20)) AS INT) AS xi), (SELECT CAST(unnest(range(20)) AS INT) AS yi)) JOIN st USING (map_id) JOIN g6 USING (map_id)""",
            "fx_points", extra=_solve_sql(2),
        ),
    ),
    "ag10_map_stats": (
        map_stats,
        tables.sql(
            """SELECT map_id, count(*) AS n_points, round((min(z) - avg(z)) * 1000, 3) AS min_um, round((max(z) - avg(z)) * 1000, 3) AS max_um,
            round((max(z) - min(z)) * 1000, 3) AS peak_to_valley_um, round(stddev_pop(z) * 1000, 3) AS std_um, min(metric) AS metric_min, max(metric) AS metric_max,
            CAST(sum(CASE WHEN metric < top * 3e-1 THEN 1 ELSE 0 END) AS BIGINT) AS n_poor
            FROM (SELECT *, max(metric) OVER (PARTITION BY map_id) AS top FROM fx_points) GROUP BY 1""", "fx_points",
        ),
    ),
    "wn10_reference_track": (
        reference_track,
        tables.sql(
            """SELECT m.map_id, m.seq, m.x, m.y, round(m.z_ref, 6) AS z_ref, round(CASE WHEN m.seq >= a.anchor_seq THEN a.z_anchor + m.z_ref - a.then_ref ELSE m.z_ref END, 6) AS z_applied
            FROM means m LEFT JOIN at_anchor a ON a.map_id = m.map_id""",
            "fx_points",
            extra="""sums AS (SELECT map_id, seq, x, y, row_number() OVER w AS n, sum(z * 10471975511965976e-16) OVER w AS s FROM fx_points
              WINDOW w AS (PARTITION BY map_id ORDER BY seq, x, y, z ROWS UNBOUNDED PRECEDING)),
            means AS (SELECT map_id, seq, x, y, n, CASE WHEN n >= 3 THEN s / n END AS z_ref FROM sums),
            anchors AS (SELECT s_suppkey AS map_id, s_suppkey * 1000 AS anchor_seq, s_acctbal / 100 AS z_anchor FROM supplier),
            last_before AS (SELECT m.map_id, max(m.n) AS n FROM means m JOIN anchors a ON a.map_id = m.map_id WHERE m.seq <= a.anchor_seq GROUP BY m.map_id),
            at_anchor AS (SELECT a.map_id, a.anchor_seq, a.z_anchor, m.z_ref AS then_ref FROM last_before l JOIN means m ON m.map_id = l.map_id AND m.n = l.n JOIN anchors a ON a.map_id = l.map_id)""",
        ),
    ),
    "st3_map_points": (
        map_points,
        tables.sql(
            """SELECT map_id, seq, x, y, CASE WHEN seq % 7 <> 0 THEN z END AS z, CASE WHEN seq % 7 <> 0 THEN CASE WHEN seq % 11 = 0 THEN 0 ELSE metric END END AS metric,
            CASE WHEN seq % 7 = 0 THEN 'skipped' WHEN seq % 11 = 0 THEN 'manual' ELSE 'measured' END AS status FROM fx_points""", "fx_points",
        ),
    ),
    "tk2_focus_grid": (
        focus_grid,
        f"""WITH b AS ({_BOUNDS_SQL}) SELECT map_id, yi * 5 + CASE WHEN yi % 2 = 0 THEN xi ELSE 4 - xi END AS seq,
        round(least(x_lo, x_hi) + (xi + 1) * (greatest(x_lo, x_hi) - least(x_lo, x_hi)) / 6, 6) AS x, round(least(y_lo, y_hi) + (yi + 1) * (greatest(y_lo, y_hi) - least(y_lo, y_hi)) / 5, 6) AS y
        FROM b, (SELECT unnest(range(5)) AS xi), (SELECT unnest(range(4)) AS yi)""",
    ),
    "tk3_scan_grid": (
        scan_grid,
        f"""WITH b AS ({_BOUNDS_SQL}), z AS (SELECT map_id, least(x_lo, x_hi) + 25e-2 AS xl, greatest(x_lo, x_hi) - 25e-2 AS xh, least(y_lo, y_hi) + 25e-2 AS yl, greatest(y_lo, y_hi) - 25e-2 AS yh FROM b),
        n AS (SELECT *, CAST(ceil((xh - xl) / 31e-2) AS BIGINT) AS nx, CAST(ceil((yh - yl) / 27e-2) AS BIGINT) AS ny FROM z WHERE xl < xh AND yl < yh),
        g AS (SELECT *, unnest(range(nx)) AS xi FROM (SELECT *, unnest(range(ny)) AS yi FROM n))
        SELECT map_id, yi * nx + CASE WHEN yi % 2 = 0 THEN xi ELSE nx - 1 - xi END AS seq, round(xl + xi * 31e-2, 6) AS x, round(yl + yi * 27e-2, 6) AS y FROM g""",
    ),
    "wn7_serpentine_order": (
        serpentine,
        """SELECT map_id, xi, yi, row_number() OVER (PARTITION BY map_id ORDER BY yi, CASE WHEN yi % 2 = 0 THEN xi ELSE -xi END) - 1 AS seq
        FROM (SELECT DISTINCT l_suppkey AS map_id, CAST(l_partkey % 50 AS INT) AS xi, CAST(l_orderkey % 40 AS INT) AS yi FROM lineitem)""",
    ),
}
