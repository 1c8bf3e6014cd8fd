"""Queries on instrument logs, look-ups and upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanlake.functions import naming
from scanlake.operators import logs, lookup
from scanlake.plans import tables
from scanlake.sources import dims

C = F.col


def calibration(spark, sf_dir):
    rows = tables.mags(spark, sf_dir).select("id", F.trim("mag_text").alias("mag"))
    out = lookup.with_calibration(rows, dims.objectives(spark), "mag", {"bar_um": 100})
    return out.select("id", "mag", "ppm", "bar_um", "exposure_us", "z_jog_um")


def nearest_defaults(spark, sf_dir):
    rows = tables.mags(spark, sf_dir).select("id", naming.parse_mag(C("mag_text")).alias("mag"))
    user = tables.load(spark, sf_dir, "region").selectExpr("r_regionkey * 7e0 + 3 AS mag", "r_regionkey / 1e3 AS step_mm", "CAST(r_regionkey AS INT) AS coarse_factor", "5e-1 AS fine_factor")
    out = lookup.nearest_defaults(rows, dims.AUTOFOCUS, user, ("step_mm", "coarse_factor", "fine_factor"))
    return out.select("id", "mag", "step_mm", "coarse_factor", "fine_factor", "source")


def latest_position(spark, sf_dir):
    readings = logs.parse_position_reply(tables.telemetry(spark, sf_dir)).where("x IS NOT NULL")
    out = lookup.latest_position(tables.captures(spark, sf_dir), readings, ("x", "y", "z"))
    return out.select("capture_id", "instrument_id", "x", "y", "z")


def choose_focus(spark, sf_dir):
    points = tables.load(spark, sf_dir, "orders").selectExpr("o_orderkey AS point_id", "o_totalprice / 1000 AS z_now")
    mapped = tables.load(spark, sf_dir, "customer").selectExpr("c_custkey * 3 AS point_id", "CASE WHEN c_custkey % 4 = 0 THEN CAST(NULL AS DOUBLE) ELSE c_acctbal END AS z_map")
    measured = tables.load(spark, sf_dir, "part").selectExpr("p_partkey * 4 AS point_id", "p_retailprice AS z_auto")
    return lookup.choose_focus(points, mapped, measured, ["point_id"]).select("point_id", F.round("z_mm", 6).alias("z_mm"), "focus_source")


def position_reply(spark, sf_dir):
    return logs.parse_position_reply(tables.telemetry(spark, sf_dir)).select("event_id", "x", "y", "z")


def forward_fill(spark, sf_dir):
    rows = logs.parse_position_reply(tables.telemetry(spark, sf_dir))
    return logs.forward_fill(rows, ("x", "y", "z")).select("event_id", "instrument_id", "x", "y", "z")


def every_nth(spark, sf_dir):
    return logs.every_nth(tables.telemetry(spark, sf_dir)).select("event_id", "instrument_id")


def rising_edges(spark, sf_dir):
    events = tables.load(spark, sf_dir, "events").withColumnRenamed("user_id", "instrument_id")
    return logs.rising_edges(events, C("value") > 40, C("event_type") == "click").select("event_id", "instrument_id")


def scan_eta(spark, sf_dir):
    points = tables.scan_points(spark, sf_dir).select("scan_id", "seq", "ts")
    totals = points.groupBy("scan_id").agg((F.count(F.lit(1)) + 100).alias("total"))
    out = logs.scan_eta(points, totals)
    return out.select("scan_id", "seq", "captured", "elapsed_s", F.round("remaining_s", 3).alias("remaining_s"), "pct")


def frame_rate(spark, sf_dir):
    return logs.frame_rate(tables.captures(spark, sf_dir), seconds=3600)


def scan_summary(spark, sf_dir):
    points = tables.load(spark, sf_dir, "orders").selectExpr(
        "o_custkey % 300 AS scan_id", "CASE WHEN o_orderstatus = 'F' THEN 'skipped' ELSE 'captured' END AS status",
        "o_totalprice > 490000 AS stopped", "o_totalprice > 499000 AS error",
    )
    return logs.scan_summary(points)


def merge_defaults(spark, sf_dir):
    base = tables.load(spark, sf_dir, "customer").selectExpr("c_custkey AS mag", "c_acctbal AS step_mm", "c_acctbal / 10 AS last_focus_z")
    over = tables.load(spark, sf_dir, "supplier").selectExpr("s_suppkey * 17 AS mag", "s_acctbal AS step_mm", "CASE WHEN s_suppkey % 2 = 0 THEN CAST(NULL AS DOUBLE) ELSE s_acctbal / 7 END AS last_focus_z")
    return lookup.merge_defaults(base, over).select("mag", "step_mm", F.round("last_focus_z", 6).alias("last_focus_z"))


def shift_presets(spark, sf_dir):
    presets = tables.load(spark, sf_dir, "part").selectExpr(
        "p_partkey DIV 5 AS instrument_id", "p_partkey % 5 AS mag", "CASE WHEN p_partkey % 23 = 0 THEN CAST(NULL AS DOUBLE) ELSE p_retailprice / 100 END AS z_mm", "p_size % 4 = 0 AS locked"
    )
    changes = tables.load(spark, sf_dir, "supplier").selectExpr("s_suppkey AS instrument_id", "s_nationkey % 5 AS mag", "s_acctbal / 100 AS z_new", "s_suppkey % 3 <> 0 AS lock_delta")
    return lookup.shift_presets(presets, changes).select("instrument_id", "mag", "locked", F.round("z_mm", 6).alias("z_mm"))


PARSED = r"""parsed AS (SELECT event_id, instrument_id, ts, CASE WHEN ok THEN TRY_CAST(p[1] AS BIGINT) END AS x, CASE WHEN ok THEN TRY_CAST(p[2] AS BIGINT) END AS y,
  CASE WHEN ok THEN TRY_CAST(p[3] AS BIGINT) END AS z FROM (
  SELECT *, len(p) >= 3 AND TRY_CAST(p[1] AS BIGINT) IS NOT NULL AND TRY_CAST(p[2] AS BIGINT) IS NOT NULL AND TRY_CAST(p[3] AS BIGINT) IS NOT NULL AS ok
  FROM (SELECT *, string_split(line, ',') AS p FROM fx_telemetry)))"""

LATEST_SQL = tables.sql(
    """SELECT c.capture_id, c.instrument_id, r.x, r.y, r.z FROM fx_captures c
    ASOF LEFT JOIN (SELECT * FROM parsed WHERE x IS NOT NULL) r ON c.instrument_id = r.instrument_id AND c.ts >= r.ts""",
    "fx_telemetry", "fx_captures", extra=PARSED,
)
RATE_SQL = """SELECT instrument_id, CAST(floor(epoch(ts) / {s}) * {s} AS BIGINT) AS window_start, count(*) AS frames, count(*) / {s}e0 AS fps FROM fx_captures GROUP BY 1, 2"""

def frame_ticks(spark, sf_dir):
    rows = tables.captures(spark, sf_dir).withColumnRenamed("capture_id", "frame_id")
    out = logs.frame_ticks(rows, seconds=3 * 86400)
    return out.select("instrument_id", "tick_us", "frames", F.round("fps", 9).alias("fps"))


_TICKS = """n AS (SELECT instrument_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY instrument_id ORDER BY ts, capture_id) - 1 AS n FROM fx_captures),
j AS (SELECT a.instrument_id, a.n, a.us, min(b.n) AS next FROM n a LEFT JOIN n b ON b.instrument_id = a.instrument_id AND b.us >= a.us + 259200000000 GROUP BY ALL),
t AS (SELECT instrument_id, n, us, next, CAST(NULL AS BIGINT) AS n_before, CAST(NULL AS BIGINT) AS us_before FROM j WHERE n = 0
  UNION ALL SELECT j.instrument_id, j.n, j.us, j.next, t.n, t.us FROM t JOIN j ON j.instrument_id = t.instrument_id AND j.n = t.next)"""

QUERIES = {
    "ag19_frame_ticks": (
        frame_ticks,
        tables.sql(
            "SELECT instrument_id, us AS tick_us, n - n_before AS frames, round((n - n_before) / ((us - us_before) / 1e6), 9) AS fps FROM t WHERE n_before IS NOT NULL", "fx_captures", extra=_TICKS, recursive=True
        ),
    ),
    "jn1_with_calibration": (
        calibration,
        tables.sql("SELECT id, mag, ppm, coalesce(bar_um, 100) AS bar_um, exposure_us, z_jog_um FROM (SELECT id, trim(mag_text) AS mag FROM fx_mags) LEFT JOIN fx_objectives USING (mag)", "fx_mags", "fx_objectives"),
    ),
    "jn2_nearest_defaults": (
        nearest_defaults,
        tables.sql(
            """SELECT id, mag, CASE WHEN u THEN us ELSE bs END AS step_mm, CASE WHEN u THEN uc ELSE bc END AS coarse_factor, CASE WHEN u THEN uf ELSE bf END AS fine_factor,
            CASE WHEN u THEN 'user' ELSE 'built-in' END AS source FROM (
            SELECT m.id, m.mag, b.step_mm AS bs, b.coarse_factor AS bc, b.fine_factor AS bf, uu.step_mm AS us, uu.coarse_factor AS uc, uu.fine_factor AS uf, uu.mag IS NOT NULL AS u,
            row_number() OVER (PARTITION BY m.id ORDER BY abs(b.mag - m.mag), b.ord) AS k
            FROM (SELECT id, coalesce(TRY_CAST(rtrim(mag_text, 'xX ') AS DOUBLE), 0e0) AS mag FROM fx_mags) m CROSS JOIN fx_af_builtin b
            LEFT JOIN (SELECT r_regionkey * 7e0 + 3 AS mag, r_regionkey / 1e3 AS step_mm, CAST(r_regionkey AS INT) AS coarse_factor, 5e-1 AS fine_factor FROM region) uu ON uu.mag = m.mag) WHERE k = 1""",
            "fx_mags", "fx_af_builtin",
        ),
    ),
    "jn7_latest_position": (latest_position, LATEST_SQL),
    "jn8_choose_focus": (
        choose_focus,
        """SELECT o_orderkey AS point_id, round(coalesce(z_map, z_auto, o_totalprice / 1000), 6) AS z_mm, CASE WHEN z_map IS NOT NULL THEN 'map' WHEN z_auto IS NOT NULL THEN 'autofocus' ELSE 'current' END AS focus_source
        FROM orders LEFT JOIN (SELECT c_custkey * 3 AS k, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS z_map FROM customer) m ON m.k = o_orderkey
        LEFT JOIN (SELECT p_partkey * 4 AS k, p_retailprice AS z_auto FROM part) a ON a.k = o_orderkey""",
    ),
    "src9_parse_position_reply": (position_reply, tables.sql("SELECT event_id, x, y, z FROM parsed", "fx_telemetry", extra=PARSED)),
    "wn8_forward_fill": (
        forward_fill,
        tables.sql(
            """SELECT event_id, instrument_id, coalesce(last_value(x IGNORE NULLS) OVER w, 0) AS x, coalesce(last_value(y IGNORE NULLS) OVER w, 0) AS y, coalesce(last_value(z IGNORE NULLS) OVER w, 0) AS z
            FROM parsed WINDOW w AS (PARTITION BY instrument_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", "fx_telemetry", extra=PARSED,
        ),
    ),
    "wn9_every_nth": (
        every_nth,
        tables.sql("SELECT event_id, instrument_id FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY ts, event_id) AS k FROM fx_telemetry) WHERE k % 10 = 1", "fx_telemetry"),
    ),
    "wn12_rising_edges": (
        rising_edges,
        """SELECT event_id, user_id AS instrument_id FROM (SELECT *, value > 40 AS a, coalesce(lag(value > 40) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS b FROM events)
        WHERE a AND (event_type = 'click' OR NOT b)""",
    ),
    "wn13_scan_eta": (
        scan_eta,
        tables.sql(
            """SELECT scan_id, seq, captured, elapsed_s, round(CASE WHEN elapsed_s > 0 THEN (total - captured) / (captured / elapsed_s) END, 3) AS remaining_s, CAST(10 + floor(captured / total * 85) AS INT) AS pct FROM (
            SELECT scan_id, seq, row_number() OVER w AS captured, CAST(epoch(ts) - epoch(first_value(ts) OVER w) AS DOUBLE) AS elapsed_s, count(*) OVER (PARTITION BY scan_id) + 100 AS total
            FROM fx_scan_points WINDOW w AS (PARTITION BY scan_id ORDER BY ts, seq))""", "fx_scan_points",
        ),
    ),
    "ag19_frame_rate": (frame_rate, tables.sql(RATE_SQL.format(s=3600), "fx_captures")),
    "ag20_scan_summary": (
        scan_summary,
        """SELECT o_custkey % 300 AS scan_id, count(*) FILTER (o_orderstatus <> 'F') AS captured, count(*) FILTER (o_orderstatus = 'F') AS skipped, count(*) AS total,
        CASE WHEN bool_or(o_totalprice > 499000) THEN 'error' WHEN bool_or(o_totalprice > 490000) THEN 'stopped' ELSE 'success' END AS status FROM orders GROUP BY 1""",
    ),
    "st1_merge_defaults": (
        merge_defaults,
        """SELECT coalesce(b.mag, o.mag) AS mag, CASE WHEN o.mag IS NOT NULL THEN o.step_mm ELSE b.step_mm END AS step_mm,
        round(CASE WHEN o.mag IS NOT NULL THEN coalesce(o.lz, b.lz) ELSE b.lz END, 6) AS last_focus_z
        FROM (SELECT c_custkey AS mag, c_acctbal AS step_mm, c_acctbal / 10 AS lz FROM customer) b
        FULL JOIN (SELECT s_suppkey * 17 AS mag, s_acctbal AS step_mm, CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE s_acctbal / 7 END AS lz FROM supplier) o ON b.mag = o.mag""",
    ),
    "st2_shift_presets": (
        shift_presets,
        """WITH p AS (SELECT p_partkey // 5 AS g, p_partkey % 5 AS mag, CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE p_retailprice / 100 END AS z, p_size % 4 = 0 AS locked FROM part),
        c AS (SELECT s_suppkey AS g, s_nationkey % 5 AS key, s_acctbal / 100 AS z_new, s_suppkey % 3 <> 0 AS ld FROM supplier),
        f AS (SELECT c.g, c.key, z_new, ld, bool_or(mag = key AND locked) AS held, coalesce(max(CASE WHEN mag = key THEN z_new - z END), 0) AS delta,
          sum(CASE WHEN mag <> key AND z IS NULL THEN 1 ELSE 0 END) AS unset FROM c JOIN p USING (g) GROUP BY ALL)
        SELECT p.g AS instrument_id, p.mag, locked, round(CASE WHEN f.g IS NULL OR held THEN z WHEN p.mag = f.key THEN z_new WHEN ld AND unset = 0 AND NOT locked THEN z + delta ELSE z END, 6) AS z_mm
        FROM p LEFT JOIN f ON f.g = p.g""",
    ),
}
