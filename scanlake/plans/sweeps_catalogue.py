"""Queries on focus sweeps and edge traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanlake.operators import edges, sweeps
from scanlake.plans import tables

C = F.col


def metric_delta(spark, sf_dir):
    return sweeps.metric_delta(tables.sweep(spark, sf_dir)).select("sweep_id", "i", F.round("delta", 6).alias("delta"))


def smoothed_delta(spark, sf_dir):
    rows = sweeps.smoothed_delta(tables.sweep(spark, sf_dir), 10)
    return rows.select("sweep_id", "i", F.round("delta", 6).alias("delta"), F.round("smoothed", 6).alias("smoothed"))


def _peaks(rows, trend_n, fresh=False):
    out = sweeps.find_peak_crossing(rows, trend_n, fresh)
    return out.select("sweep_id", "peak_kind", C("peak_i").cast("long").alias("peak_i"), F.round("peak_z", 6).alias("peak_z"), F.round("noise_floor", 6).alias("noise_floor"))


def peak_crossing(spark, sf_dir):
    return _peaks(tables.sweep_with_length(spark, sf_dir), 10)


def peak_crossing_clean(spark, sf_dir):
    return _peaks(tables.focus_with_length(spark, sf_dir), 4)


def peak_crossing_fresh(spark, sf_dir):
    return _peaks(tables.sweep_with_length(spark, sf_dir), 10, fresh=True)


def _peak_sql(table: str, trend_n: int, fresh: bool = False) -> str:
    first = 0 if fresh else max(4, trend_n)
    half = sweeps.half_window(trend_n)
    extra = f"""d AS (SELECT sweep_id, i, z_mm, metric, metric - lag(metric) OVER w AS delta,
      (metric - coalesce(lag(metric, {half}) OVER w, first_value(metric) OVER w)) / nullif(least(i, {half}), 0) AS smoothed
      FROM {table} WINDOW w AS (PARTITION BY sweep_id ORDER BY i)),
    ups AS (SELECT sweep_id, min(CASE WHEN i BETWEEN 1 AND {first} AND smoothed > 0 THEN i END) AS up1 FROM d GROUP BY 1),
    early AS (SELECT d.sweep_id, min(d.i) AS early FROM d JOIN ups USING (sweep_id)
      WHERE d.i <= {first} AND d.smoothed < 0 AND d.i > up1 GROUP BY 1),
    rk AS (SELECT sweep_id, abs(delta) AS a, row_number() OVER (PARTITION BY sweep_id ORDER BY abs(delta)) AS k,
      count(*) OVER (PARTITION BY sweep_id) AS n FROM d WHERE i BETWEEN 1 AND {first}),
    nf AS (SELECT sweep_id, median(a) * 5 AS nf FROM rk WHERE n >= 3 AND k <= greatest(1, n // 2) GROUP BY 1),
    rise AS (SELECT sweep_id, max(CASE WHEN i BETWEEN 1 AND {first} THEN metric END) - max(CASE WHEN i = 0 THEN metric END) AS rise FROM d GROUP BY 1),
    st AS (SELECT ups.sweep_id, early, coalesce(nf, 0e0) AS nf, up1 IS NOT NULL AND NOT (coalesce(nf, 0) > 0 AND early IS NULL AND rise <= nf) AS was_up
      FROM ups LEFT JOIN early USING (sweep_id) LEFT JOIN nf USING (sweep_id) LEFT JOIN rise USING (sweep_id)),
    ph2 AS (SELECT d.*, nf, was_up, was_up OR coalesce(bool_or(smoothed > nf) OVER (PARTITION BY d.sweep_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS up
      FROM d JOIN st USING (sweep_id) WHERE i > {first}),
    late AS (SELECT sweep_id, min(CASE WHEN up AND (delta < -nf OR (NOT smoothed > nf AND smoothed < 0)) THEN i END) AS late, bool_or(smoothed > nf) AS late_up FROM ph2 GROUP BY 1),
    fin AS (SELECT st.sweep_id, nf, coalesce(early, late) AS peak, was_up OR coalesce(late_up, false) AS up,
      (SELECT max(i) FROM d WHERE d.sweep_id = st.sweep_id) AS last_i FROM st LEFT JOIN late USING (sweep_id))"""
    body = f"""SELECT fin.sweep_id, CASE WHEN peak IS NOT NULL THEN 'crossing' WHEN up THEN 'boundary' ELSE 'none' END AS peak_kind,
      CAST(at_i AS BIGINT) AS peak_i, round(z_mm, 6) AS peak_z, round(nf, 6) AS noise_floor
      FROM (SELECT *, CASE WHEN peak IS NOT NULL THEN peak WHEN up THEN last_i END AS at_i FROM fin) fin LEFT JOIN {table} t ON t.sweep_id = fin.sweep_id AND t.i = at_i"""
    return tables.sql(body, table, extra=extra) if table in tables.CTE else f"WITH {extra} {body}"


def noise_floor(spark, sf_dir):
    return sweeps.noise_floor(tables.sweep(spark, sf_dir), 10).select("sweep_id", F.round("noise_floor", 6).alias("noise_floor"))


def best_focus(spark, sf_dir):
    return sweeps.best_focus(tables.sweep(spark, sf_dir)).select("sweep_id", "best_i", F.round("z_best", 6).alias("z_best"), "m_best")


def best_so_far(spark, sf_dir):
    return sweeps.best_so_far(tables.sweep(spark, sf_dir)).select("sweep_id", "i", F.round("z_best", 6).alias("z_best"))


def nearest_k(spark, sf_dir):
    rows = sweeps.nearest_k(tables.sweep(spark, sf_dir), F.lit(0.06), 7)
    return rows.select("sweep_id", "i", "near_rank")


def parabolic_peak(spark, sf_dir):
    out = sweeps.parabolic_peak(tables.focus(spark, sf_dir), 3)
    return out.select("sweep_id", F.round("z_peak", 6).alias("z_peak"), F.round("z_argmax", 6).alias("z_argmax"), "fitted")


def _parabola_sql(table: str) -> str:
    body = """SELECT sweep_id, round(CASE WHEN n_z >= 3 AND a < 0 THEN greatest(lo, least(hi, zt - b / (2 * a))) ELSE zt END, 6) AS z_peak, round(zt, 6) AS z_argmax,
    coalesce(n_z >= 3 AND a < 0, false) AS fitted FROM ab"""
    extra = f"""top AS (SELECT sweep_id, z_mm AS zt FROM (SELECT *, row_number() OVER (PARTITION BY sweep_id ORDER BY metric DESC, i) AS k FROM {table}) WHERE k = 1),
    near AS (SELECT sweep_id, z_mm, metric AS m, zt, z_mm - zt AS u FROM (
      SELECT f.*, zt, row_number() OVER (PARTITION BY f.sweep_id ORDER BY abs(z_mm - zt), i) AS k FROM {table} f JOIN top USING (sweep_id)) WHERE k <= 7),
    s AS (SELECT sweep_id, max(zt) AS zt, min(z_mm) AS lo, max(z_mm) AS hi, count(DISTINCT z_mm) AS n_z, count(*) * 1e0 AS s0, sum(u) AS s1, sum(u*u) AS s2,
      sum(u*u*u) AS s3, sum(u*u*u*u) AS s4, sum(m) AS t0, sum(u*m) AS t1, sum(u*u*m) AS t2 FROM near GROUP BY 1),
    dd AS (SELECT *, s4*(s2*s0-s1*s1) - s3*(s3*s0-s1*s2) + s2*(s3*s1-s2*s2) AS det,
      t2*(s2*s0-s1*s1) - s3*(t1*s0-s1*t0) + s2*(t1*s1-s2*t0) AS da, s4*(t1*s0-s1*t0) - t2*(s3*s0-s1*s2) + s2*(s3*t0-t1*s2) AS db FROM s),
    ab AS (SELECT *, da / nullif(det, 0) AS a, db / nullif(det, 0) AS b FROM dd)"""
    return tables.sql(body, table, extra=extra) if table in tables.CTE else f"WITH {extra} {body}"


def _zigzag(spark, sf_dir):
    """Sweeps that turn round every few steps, as a search with restarts leaves them."""
    return tables.sweep_with_length(spark, sf_dir).selectExpr("sweep_id", "i", "abs((i % 17) - 8) * 3e-3 AS z_mm", "metric", "n")


def autofocus_log(spark, sf_dir):
    log = sweeps.autofocus_log(_zigzag(spark, sf_dir), 4, 3)
    places = [F.round(c, 6).alias(c) for c in ("peak_z", "noise_floor", "z_peak", "z_best")]
    return log.select("sweep_id", C("segment").cast("long").alias("segment"), "start_i", "steps", "peak_kind", "peak_i", *places)


_LOG_CTE = """zz AS (SELECT sweep_id, i, abs((i % 17) - 8) * 3e-3 AS z_mm, metric FROM fx_sweep),
wy AS (SELECT *, sign(z_mm - lag(z_mm) OVER w) AS way FROM zz WINDOW w AS (PARTITION BY sweep_id ORDER BY i)),
tn AS (SELECT *, CASE WHEN way <> lag(way) OVER w THEN 1 ELSE 0 END AS turn FROM wy WINDOW w AS (PARTITION BY sweep_id ORDER BY i)),
sg AS (SELECT sweep_id AS sweep, CAST(sum(turn) OVER (PARTITION BY sweep_id ORDER BY i) AS BIGINT) AS segment, i AS place, z_mm, metric FROM tn),
st AS (SELECT *, min(place) OVER (PARTITION BY sweep, segment) AS start_i FROM sg),
s_first AS (SELECT sweep * 1000000 + segment AS sweep_id, place - start_i AS i, z_mm, metric FROM st WHERE segment = 0),
s_later AS (SELECT sweep * 1000000 + segment AS sweep_id, place - start_i AS i, z_mm, metric FROM st WHERE segment > 0),
sizes AS (SELECT sweep * 1000000 + segment AS id, sweep, segment, min(place) AS start_i, count(*) AS steps FROM sg GROUP BY 1, 2, 3)"""


def _log_sql() -> str:
    found = " UNION ALL ".join(f"SELECT * FROM ({_peak_sql(table, 4, fresh)})" for table, fresh in (("s_first", False), ("s_later", True)))
    return tables.sql(
        f"""SELECT sweep AS sweep_id, segment, start_i, steps, peak_kind, start_i + peak_i AS peak_i, peak_z, noise_floor, z_peak, z_argmax AS z_best
        FROM sizes JOIN ({found}) f ON f.sweep_id = id JOIN ({_parabola_sql("zz")}) p ON p.sweep_id = sweep""", "fx_sweep", extra=_LOG_CTE,
    )


def segments(spark, sf_dir):
    return sweeps.sweep_segments(_zigzag(spark, sf_dir)).select("sweep_id", "i", C("segment").cast("long").alias("segment"))


def fine_plan(spark, sf_dir):
    plan = sweeps.fine_plan(sweeps.best_focus(tables.focus(spark, sf_dir)), "z_best", 0.02, 0.003, 0.75)
    return plan.select("sweep_id", "k", F.round("z_mm", 6).alias("z_mm"))


def average_metric(spark, sf_dir):
    rows = tables.sweep(spark, sf_dir).selectExpr("sweep_id", "i DIV 3 AS i", "CASE WHEN metric < 20 THEN CAST(NULL AS DOUBLE) ELSE metric END AS metric")
    return sweeps.average_metric(rows).select("sweep_id", "i", F.round("metric", 6).alias("metric"))


def clean_sweep(spark, sf_dir):
    rows = tables.sweep(spark, sf_dir).selectExpr("sweep_id", "i", "z_mm", "CASE WHEN metric < 20 THEN CAST(NULL AS DOUBLE) ELSE metric END AS metric")
    return sweeps.clean_sweep(rows).select("sweep_id", "i", F.round("z_mm", 6).alias("z_mm"), "metric")


def _edges(spark, sf_dir):
    traces = tables.edge(spark, sf_dir)
    return edges.find_edge(traces, edges.auto_threshold(traces), k=2)


def threshold(spark, sf_dir):
    return edges.auto_threshold(tables.edge(spark, sf_dir)).select("scan_id", "dir", F.round("threshold", 6).alias("threshold"))


def find_edge(spark, sf_dir):
    return _edges(spark, sf_dir).select("scan_id", "dir", F.round("edge_mm", 6).alias("edge_mm"), "edge_kind")


_EDGE_CTE = """th AS (SELECT scan_id, dir, greatest(1e1, 5e-1 * arg_min(intensity, i)) AS threshold FROM fx_edge GROUP BY 1, 2),
runs AS (SELECT *, sum(CASE WHEN intensity < threshold THEN 1 ELSE 0 END) OVER (PARTITION BY scan_id, dir ORDER BY i ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS run
  FROM fx_edge JOIN th USING (scan_id, dir)),
hit AS (SELECT scan_id, dir, min(CASE WHEN run = 2 THEN i END) AS hit_i, max(i) AS last, count(*) AS n FROM runs GROUP BY 1, 2),
e AS (SELECT scan_id, dir, CASE WHEN hit_i IS NOT NULL THEN r.pos_mm - r.step_mm WHEN n > 50 THEN r.pos_mm END AS edge_mm,
  CASE WHEN hit_i IS NOT NULL THEN 'crossed' WHEN n > 50 THEN 'limit' ELSE 'none' END AS edge_kind FROM hit JOIN runs r USING (scan_id, dir) WHERE r.i = coalesce(hit_i, last))"""

_EXTENT_CTE = (
    _EDGE_CTE
    + """, x AS (SELECT scan_id, max(CASE WHEN dir = 'x_negative' THEN edge_mm END) AS x_negative, max(CASE WHEN dir = 'x_positive' THEN edge_mm END) AS x_positive,
 max(CASE WHEN dir = 'y_negative' THEN edge_mm END) AS y_negative, max(CASE WHEN dir = 'y_positive' THEN edge_mm END) AS y_positive FROM e GROUP BY 1),
xx AS (SELECT *, coalesce(CASE WHEN y_negative + y_positive IS NOT NULL THEN abs(x_positive - x_negative) END, 0) AS width_mm,
 coalesce(CASE WHEN x_negative + x_positive IS NOT NULL THEN abs(y_positive - y_negative) END, 0) AS height_mm FROM x)"""
)
_EXTENT_COLS = ("x_negative", "x_positive", "y_negative", "y_positive", "width_mm", "height_mm")
_EXTENT_SELECT = "SELECT scan_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in _EXTENT_COLS) + " FROM xx"


def extents(spark, sf_dir):
    out = edges.wafer_extents(_edges(spark, sf_dir))
    return out.select("scan_id", *[F.round(c, 6).alias(c) for c in _EXTENT_COLS])


def complete_scans(spark, sf_dir):
    return edges.complete_only(extents(spark, sf_dir))


QUERIES = {
    "wn2_metric_delta": (
        metric_delta, tables.sql("SELECT sweep_id, i, round(metric - lag(metric) OVER (PARTITION BY sweep_id ORDER BY i), 6) AS delta FROM fx_sweep", "fx_sweep"),
    ),
    "wn3_smoothed_delta": (
        smoothed_delta,
        tables.sql(
            """SELECT sweep_id, i, round(metric - lag(metric) OVER w, 6) AS delta,
            round((metric - coalesce(lag(metric, 5) OVER w, first_value(metric) OVER w)) / nullif(least(i, 5), 0), 6) AS smoothed
            FROM fx_sweep WINDOW w AS (PARTITION BY sweep_id ORDER BY i)""", "fx_sweep",
        ),
    ),
    "autofocus_log": (autofocus_log, _log_sql()),
    "wn4_peak_crossing": (peak_crossing, _peak_sql("fx_sweep", 10)),
    "wn4_peak_crossing_clean": (peak_crossing_clean, _peak_sql("fx_focus", 4)),
    "wn4_peak_crossing_fresh": (peak_crossing_fresh, _peak_sql("fx_sweep", 10, True)),
    "wn5_find_edge": (find_edge, tables.sql("SELECT scan_id, dir, round(edge_mm, 6) AS edge_mm, edge_kind FROM e", "fx_edge", extra=_EDGE_CTE)),
    "wn6_auto_threshold": (
        threshold, tables.sql("SELECT scan_id, dir, round(greatest(1e1, 5e-1 * arg_min(intensity, i)), 6) AS threshold FROM fx_edge GROUP BY 1, 2", "fx_edge"),
    ),
    "wn11_sweep_segments": (
        segments,
        tables.sql(
            """SELECT sweep_id, i, CAST(sum(coalesce(CASE WHEN s <> p THEN 1 ELSE 0 END, 0)) OVER (PARTITION BY sweep_id ORDER BY i) AS BIGINT) AS segment FROM (
            SELECT *, lag(s) OVER (PARTITION BY sweep_id ORDER BY i) AS p FROM (
            SELECT *, sign(z - lag(z) OVER (PARTITION BY sweep_id ORDER BY i)) AS s FROM (SELECT sweep_id, i, abs((i % 17) - 8) * 3e-3 AS z FROM fx_sweep)))""", "fx_sweep",
        ),
    ),
    "wn14_best_so_far": (
        best_so_far,
        tables.sql(
            """SELECT sweep_id, i, round((max(struct_pack(m := metric, b := -i, z := z_mm)) OVER (PARTITION BY sweep_id ORDER BY i)).z, 6) AS z_best FROM fx_sweep""",
            "fx_sweep",
        ),
    ),
    "ag5_average_metric": (
        average_metric,
        tables.sql("SELECT sweep_id, i // 3 AS i, round(avg(CASE WHEN metric < 20 THEN NULL ELSE metric END), 6) AS metric FROM fx_sweep GROUP BY 1, 2", "fx_sweep"),
    ),
    "ag8_best_focus": (
        best_focus,
        tables.sql(
            """SELECT sweep_id, i AS best_i, round(z_mm, 6) AS z_best, metric AS m_best
            FROM (SELECT *, row_number() OVER (PARTITION BY sweep_id ORDER BY metric DESC, i) AS k FROM fx_sweep) WHERE k = 1""", "fx_sweep",
        ),
    ),
    "ag12_parabolic_peak": (parabolic_peak, _parabola_sql("fx_focus")),
    "ag13_noise_floor": (
        noise_floor,
        tables.sql(
            """SELECT sweep_id, round(CASE WHEN max(n) >= 3 THEN median(CASE WHEN k <= greatest(1, n // 2) THEN a END) * 5 ELSE 0 END, 6) AS noise_floor FROM (
            SELECT sweep_id, a, count(a) OVER (PARTITION BY sweep_id) AS n, row_number() OVER (PARTITION BY sweep_id ORDER BY a NULLS LAST) AS k FROM (
            SELECT sweep_id, i, abs(metric - lag(metric) OVER (PARTITION BY sweep_id ORDER BY i)) AS a FROM fx_sweep) WHERE i <= 10) GROUP BY 1""", "fx_sweep",
        ),
    ),
    "ag11_wafer_extents": (extents, tables.sql(_EXTENT_SELECT, "fx_edge", extra=_EXTENT_CTE)),
    "fl8_complete_only": (
        complete_scans, tables.sql(_EXTENT_SELECT + " WHERE x_negative + x_positive + y_negative + y_positive IS NOT NULL", "fx_edge", extra=_EXTENT_CTE),
    ),
    "tk1_nearest_k": (
        nearest_k,
        tables.sql(
            """SELECT * FROM (SELECT sweep_id, i, row_number() OVER (PARTITION BY sweep_id ORDER BY abs(z_mm - 6e-2), i) AS near_rank FROM fx_sweep) WHERE near_rank <= 7""", "fx_sweep"
        ),
    ),
    "tk4_fine_plan": (
        fine_plan,
        tables.sql(
            """SELECT sweep_id, k, round(lo + k * (hi - lo) / (n - 1), 6) AS z_mm FROM (
            SELECT sweep_id, lo, hi, n, CAST(unnest(range(n)) AS INT) AS k FROM (
            SELECT sweep_id, lo, hi, greatest(3, CAST(round_even((hi - lo) / 3e-3, 0) AS INT) + 1) AS n FROM (
            SELECT sweep_id, z_mm - 2e-2 * 75e-2 AS lo, z_mm + 2e-2 * 75e-2 AS hi
            FROM (SELECT *, row_number() OVER (PARTITION BY sweep_id ORDER BY metric DESC, i) AS k FROM fx_focus) WHERE k = 1)))""", "fx_focus",
        ),
    ),
    "wn4_clean_sweep": (
        clean_sweep,
        tables.sql(
            "SELECT sweep_id, row_number() OVER (PARTITION BY sweep_id ORDER BY i) - 1 AS i, round(z_mm, 6) AS z_mm, metric FROM fx_sweep WHERE metric >= 20", "fx_sweep"
        ),
    ),
}
