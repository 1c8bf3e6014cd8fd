"""Queries of the scalar projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanlake.functions import naming, units
from scanlake.operators import edges, lookup, pixels, planning
from scanlake.plans import tables
from scanlake.sources import dims

C = F.col


def _axis_counts(spark, sf_dir):
    counts = tables.load(spark, sf_dir, "events").selectExpr(
        "event_id", "CASE user_id % 3 WHEN 0 THEN 'X' WHEN 1 THEN 'Y' ELSE 'Z' END AS axis", "CAST(floor(value * 10) AS BIGINT) AS counts", "value"
    )
    return lookup.with_calibration(counts, dims.axis_config(spark), "axis")


_AXIS_SQL = """(SELECT event_id, CASE user_id % 3 WHEN 0 THEN 'X' WHEN 1 THEN 'Y' ELSE 'Z' END AS axis,
  CAST(floor(value * 10) AS BIGINT) AS counts, value FROM events) JOIN fx_axis USING (axis)"""


def counts_to_mm(spark, sf_dir):
    return _axis_counts(spark, sf_dir).select("event_id", F.round(units.counts_to_mm(C("counts"), C("step"), C("invert")), 6).alias("mm"))


def mm_to_counts(spark, sf_dir):
    rows = _axis_counts(spark, sf_dir)
    return rows.select("event_id", units.mm_to_counts(C("value") / 100.0, C("step"), C("invert")).alias("counts"))


def exposure_slider(spark, sf_dir):
    rows = tables.load(spark, sf_dir, "lineitem")
    pos = C("l_partkey") % 1001
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", units.exposure_from_pos(pos).alias("exposure_us"),
        units.pos_from_exposure(C("l_extendedprice")).alias("pos"),
    )


def white_balance(spark, sf_dir):
    red, blue = units.wb_ratios(2000.0 + C("o_totalprice") / 50.0)
    return tables.load(spark, sf_dir, "orders").select("o_orderkey", F.round(red, 6).alias("red"), F.round(blue, 6).alias("blue"))


def _calibrated(spark, sf_dir):
    mags = tables.mags(spark, sf_dir).withColumn("mag", F.trim("mag_text"))
    return lookup.with_calibration(mags.select("id", "mag"), dims.objectives(spark), "mag")


def scale_bar(spark, sf_dir):
    rows = _calibrated(spark, sf_dir).withColumn("ppm_eff", units.ppm_effective(C("ppm"), 1 + C("id") % 4))
    bar = units.bar_um(C("mag"))
    return rows.select("id", F.round("ppm_eff", 6).alias("ppm_eff"), bar.alias("bar_um"), units.scale_bar_px(C("ppm_eff"), bar).alias("bar_px"))


_MAGS_SQL = "(SELECT id, trim(mag_text) AS mag FROM fx_mags) LEFT JOIN fx_objectives USING (mag)"


def field_of_view(spark, sf_dir):
    rows = _calibrated(spark, sf_dir)
    return rows.select("id", units.fov_mm(F.lit(2464.0), C("ppm"), 3).alias("w_mm"), units.fov_mm(F.lit(2056.0), C("ppm"), 3).alias("h_mm"))


def click_to_stage(spark, sf_dir):
    dx, dy = units.pixel_to_stage(C("x"), C("y"), 640, 480, F.lit(2.03))
    return tables.marks(spark, sf_dir).select("frame_id", "id", "x", "y", F.round(dx, 9).alias("dx_mm"), F.round(dy, 9).alias("dy_mm"))


LIMITS_UM = (-127500.0, 127500.0, -107500.0, 107500.0)


def stage_map(spark, sf_dir):
    rows = tables.marks(spark, sf_dir)
    x, y = units.map_to_mm(C("x"), C("y"), 600, 450, LIMITS_UM)
    px, py = units.mm_to_map(C("x") * 300.0 - 90000.0, C("y") * 400.0 - 90000.0, 600, 450, LIMITS_UM)
    return rows.select("frame_id", "id", "x", "y", F.round(x, 6).alias("x_mm"), F.round(y, 6).alias("y_mm"), px.alias("px"), py.alias("py"))


def measure(spark, sf_dir):
    rows = tables.marks(spark, sf_dir)
    m = units.measure(C("x"), C("y"), F.lit(320), F.lit(240), F.lit(4.06))
    return rows.select("frame_id", "id", "x", "y", *[F.round(col, 6).alias(name) for name, col in m.items()])


def grid_move(spark, sf_dir):
    dx, dy = units.grid_to_stage(C("x") % 40, C("y") % 30, C("id") * 6.5)
    return tables.marks(spark, sf_dir).select("frame_id", "id", "x", "y", F.round(dx, 6).alias("dx_mm"), F.round(dy, 6).alias("dy_mm"))


def layer_contrast(spark, sf_dir):
    background = [F.lit(150), F.lit(140), F.lit(130)]
    pct = units.contrast_pct([C("blue"), C("green"), C("red")], background)
    back = units.colour_from_contrast(F.lit(150.0), pct)
    return tables.rgb(spark, sf_dir).select("frame_id", "r", "c", F.round(pct, 6).alias("contrast"), back.alias("back"))


def gray(spark, sf_dir):
    luma = units.to_gray(C("blue"), C("green"), C("red"))
    return tables.rgb(spark, sf_dir).select("frame_id", "r", "c", luma.alias("gray"), units.scale_12_to_16(luma).alias("wide"))


def image_name(spark, sf_dir):
    rows = tables.load(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_orderdate AS ts", "CASE WHEN o_orderkey % 7 = 0 THEN '  ' ELSE o_orderstatus END AS sample",
        "CASE WHEN o_orderkey % 5 = 0 THEN CAST(NULL AS STRING) ELSE concat(CAST(o_custkey % 50 AS STRING), 'x/a') END AS mag",
        "o_totalprice / 1000 AS ms", "o_custkey / 4e0 AS x", "CASE WHEN o_orderkey % 3 = 0 THEN CAST(NULL AS DOUBLE) ELSE o_orderkey / 8e0 END AS y",
    )
    return rows.select("o_orderkey", naming.build_filename(C("sample"), C("ts"), C("mag"), C("ms"), C("x"), C("y")).alias("name"))


def parse_name(spark, sf_dir):
    x, y = naming.parse_filename(C("filename"))
    return tables.scan_points(spark, sf_dir).select("scan_id", "seq", x.alias("x"), y.alias("y"))


def parse_mag(spark, sf_dir):
    return tables.mags(spark, sf_dir).select("id", naming.parse_mag(C("mag_text")).alias("mag"))


def digits(spark, sf_dir):
    return tables.digit_text(spark, sf_dir).select("doc_id", naming.normalise_digits(C("raw")).alias("digit"))


def grid_label(spark, sf_dir):
    rows = tables.load(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "CAST(l_partkey % 10 AS STRING) AS tl", "CAST(l_suppkey % 10 AS STRING) AS tr",
        "CASE WHEN l_linenumber = 4 THEN CAST(NULL AS STRING) ELSE CAST(l_linenumber % 10 AS STRING) END AS bl", "CAST(l_orderkey % 10 AS STRING) AS br",
    )
    xx, yy = naming.grid_label(C("tl"), C("tr"), C("bl"), C("br"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", xx.alias("xx"), yy.alias("yy"))


def ladders(spark, sf_dir):
    rows = tables.load(spark, sf_dir, "orders")
    return rows.select(
        "o_orderkey", units.tick_interval_um(C("o_totalprice") / 50.0).alias("tick_um"), units.zoom_bar_um(C("o_totalprice") / 2000.0).alias("bar_um")
    )


def focus_level(spark, sf_dir):
    m = C("metric") / 10.0
    return tables.sweep(spark, sf_dir).select("sweep_id", "i", units.focus_bar(m).alias("bar"), units.focus_class(m).alias("focus"))


def legacy_exposure(spark, sf_dir):
    v = F.floor(C("o_totalprice") / 100).cast("int")
    return tables.load(spark, sf_dir, "orders").select("o_orderkey", units.legacy_exposure_us(v).alias("us"), units.was_legacy(v).alias("was_legacy"))


def scan_time(spark, sf_dir):
    est = units.estimate_scan_s(C("o_custkey"), 0.5, C("o_orderkey") % 30)
    return tables.load(spark, sf_dir, "orders").select("o_orderkey", F.round(est, 6).alias("est_s"))


def search_window(spark, sf_dir):
    rows = tables.load(spark, sf_dir, "orders")
    z0, step = C("o_totalprice") / 1000.0, (1 + C("o_custkey") % 10) / 1000.0
    cols = []
    for kind in ("map", "coarse", "fine", "panel"):
        lo, hi = units.autofocus_window(z0, step, kind, C("o_custkey") / 100.0)
        cols += [F.round(lo, 6).alias(f"{kind}_lo"), F.round(hi, 6).alias(f"{kind}_hi")]
    return rows.select("o_orderkey", *cols)


def clamp(spark, sf_dir):
    rows = _axis_counts(spark, sf_dir)
    return rows.select("event_id", F.round(units.clamp(C("value") - 200.0, C("min_mm"), C("max_mm")), 6).alias("mm"))


def frame_intensity(spark, sf_dir):
    return pixels.frame_intensity(tables.frames(spark, sf_dir)).select("frame_id", F.round("intensity", 6).alias("intensity"))


def drop_dark(spark, sf_dir):
    scaled = tables.frames(spark, sf_dir).selectExpr("frame_id", "greatest(v - 110, 0) AS v")
    return pixels.drop_dark_frames(pixels.frame_intensity(scaled)).select("frame_id", F.round("intensity", 6).alias("intensity"))


def min_metric(spark, sf_dir):
    rows = tables.sweep(spark, sf_dir).selectExpr("sweep_id", "i", "CASE WHEN i % 9 = 0 THEN CAST(NULL AS DOUBLE) ELSE metric END AS metric")
    return pixels.min_metric(rows)


def min_improvement(spark, sf_dir):
    runs = tables.load(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_custkey * 20e0 AS m0", "CASE WHEN o_orderkey % 8 = 0 THEN CAST(NULL AS DOUBLE) ELSE o_totalprice / 10 END AS m_final"
    )
    return pixels.min_improvement(runs, 5.0).select("o_orderkey")


def safe_zone(spark, sf_dir):
    bounds = tables.load(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_totalprice / 1e4 AS x_lo", "o_custkey / 50e0 AS x_hi", "(o_orderkey % 40) * 1e0 AS y_lo", "(o_custkey % 60) * 1e0 AS y_hi"
    )
    out = edges.safe_zone(bounds, 2.0)
    return out.select("o_orderkey", *[F.round(c, 6).alias(c) for c in ("x_lo", "x_hi", "y_lo", "y_hi")], "status")


def crop(spark, sf_dir):
    return pixels.crop_roi(tables.frames(spark, sf_dir), 4, 4, 2)


def random_offsets(spark, sf_dir):
    starts = tables.load(spark, sf_dir, "supplier").selectExpr("s_suppkey", "s_acctbal AS x", "s_acctbal / 2 AS y")
    out = planning.random_offsets(starts, 10, 0.5, "s_suppkey", seed=7)
    return out.select("s_suppkey", "k", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


_CHARS = "".join(naming.DIGIT_LOOKALIKES)
_DIGITS = "".join(naming.DIGIT_LOOKALIKES.values())


def _ladder_sql(cond: str, ladder, default: str, desc: bool = False) -> str:
    cases = " ".join(f"WHEN {cond.format(v=v)} THEN {v}" for v in (reversed(ladder) if desc else ladder))
    return f"CASE {cases} ELSE {default} END"


_WIDE = _ladder_sql("o_totalprice / 2000.0::DOUBLE * {v} >= 30", units.ZOOM_LADDER_UM, "1")

QUERIES = {
    "fn1_counts_to_mm": (counts_to_mm, tables.sql(f"SELECT event_id, round(counts * step * invert, 6) AS mm FROM {_AXIS_SQL}", "fx_axis")),
    "fn2_mm_to_counts": (
        mm_to_counts, tables.sql(f"SELECT event_id, CAST(round_even(value / 1e2 / step * invert, 0) AS BIGINT) AS counts FROM {_AXIS_SQL}", "fx_axis"),
    ),
    "fn3_exposure_slider": (
        exposure_slider,
        """SELECT l_orderkey, l_linenumber, l_partkey, CAST(round_even(10 * power(1e5, (l_partkey % 1001) / 1e3), 0) AS BIGINT) AS exposure_us,
        CAST(round_even(ln(greatest(1e1, l_extendedprice) / 1e1) / ln(1e5) * 1000, 0) AS BIGINT) AS pos FROM lineitem""",
    ),
    "fn4_wb_ratios": (
        white_balance,
        """SELECT o_orderkey, round(22e-1 - t * 14e-1, 6) AS red, round(7e-1 + t * 13e-1, 6) AS blue
        FROM (SELECT o_orderkey, greatest(0e0, least((2e3 + o_totalprice / 5e1 - 28e2) / 47e2, 1e0)) AS t FROM orders)""",
    ),
    "fn5_scale_bar": (
        scale_bar,
        tables.sql(
            f"""SELECT id, round(ppm / (1 + id % 4), 6) AS ppm_eff, coalesce(bar_um, 100) AS bar_um,
            CAST(trunc(ppm / (1 + id % 4) * coalesce(bar_um, 100)) AS INT) AS bar_px FROM {_MAGS_SQL}""", "fx_mags", "fx_objectives",
        ),
    ),
    "fn6_fov_mm": (
        field_of_view,
        tables.sql(
            f"SELECT id, round_even(2464e0 / ppm / 1000, 3) AS w_mm, round_even(2056e0 / ppm / 1000, 3) AS h_mm FROM {_MAGS_SQL}", "fx_mags", "fx_objectives"
        ),
    ),
    "fn7_pixel_to_stage": (
        click_to_stage,
        tables.sql(
            "SELECT frame_id, id, x, y, round((x - 320e0) / 203e-2 / 1000, 9) AS dx_mm, round(-(y - 240e0) / 203e-2 / 1000, 9) AS dy_mm FROM fx_marks", "fx_marks"
        ),
    ),
    "fn8_stage_map": (
        stage_map,
        tables.sql(
            """SELECT frame_id, id, x, y, round(greatest(-1275e-1, least(1275e-1, (x / 6e2 * 255e3 - 1275e2) / 1e3)), 6) AS x_mm,
            round(greatest(-1075e-1, least(1075e-1, ((1 - y / 45e1) * 215e3 - 1075e2) / 1e3)), 6) AS y_mm,
            CAST(trunc((x * 3e2 - 9e4 + 1275e2) / 255e3 * 6e2) AS INT) AS px, CAST(trunc((1 - (y * 4e2 - 9e4 + 1075e2) / 215e3) * 45e1) AS INT) AS py FROM fx_marks""",
            "fx_marks",
        ),
    ),
    "fn9_measure": (
        measure,
        tables.sql(
            """SELECT frame_id, id, x, y, round(d, 6) AS dist_px, round(d / 406e-2, 6) AS dist_um, round(1 / 406e-2, 6) AS dist_err_um,
            round(degrees(atan2(240 - y, 320 - x)), 6) AS angle_deg, CASE WHEN d <> 0 THEN round(degrees(atan2(1, d)), 6) ELSE 0 END AS angle_err_deg
            FROM (SELECT *, sqrt((320e0 - x) * (320 - x) + (240 - y) * (240 - y)) AS d FROM fx_marks)""", "fx_marks",
        ),
    ),
    "fn10_grid_to_stage": (
        grid_move,
        tables.sql(
            """SELECT frame_id, id, x, y, round(((x % 40) * cos(t) - (y % 30) * sin(t)) * 5e-1, 6) AS dx_mm, round(((x % 40) * sin(t) + (y % 30) * cos(t)) * 5e-1, 6) AS dy_mm
            FROM (SELECT *, radians(id * 65e-1) AS t FROM fx_marks)""", "fx_marks",
        ),
    ),
    "fn11_contrast": (
        layer_contrast,
        tables.sql(
            """SELECT frame_id, r, c, round(p, 6) AS contrast, CAST(trunc(greatest(0e0, least(15e1 * (1 + p / 1e2), 255e0))) AS INT) AS back
            FROM (SELECT *, ((blue + green + red) / 3e0 - 14e1) / 14e1 * 1e2 AS p FROM fx_rgb)""", "fx_rgb",
        ),
    ),
    "fn12_to_gray": (
        gray,
        tables.sql(
            """SELECT frame_id, r, c, g AS gray, CAST(g * 16 AS INT) AS wide
            FROM (SELECT *, CAST((9798 * red + 19235 * green + 3735 * blue + 16384) // 32768 AS INT) AS g FROM fx_rgb)""", "fx_rgb",
        ),
    ),
    "fn13_build_filename": (
        image_name,
        """SELECT o_orderkey, concat_ws('_', CASE WHEN o_orderkey % 7 = 0 THEN 'capture' ELSE o_orderstatus END, strftime(o_orderdate, '%Y%m%d_%H%M%S'),
          CASE WHEN o_orderkey % 5 <> 0 THEN concat(CAST(o_custkey % 50 AS VARCHAR), 'x-a') END,
          concat(CAST(CAST(round_even(o_totalprice / 1000, 0) AS BIGINT) AS VARCHAR), 'ms'),
          CASE WHEN o_orderkey % 3 <> 0 THEN printf('X%+.3f_Y%+.3f', o_custkey / 4e0, o_orderkey / 8e0) END) || '.png' AS name FROM orders""",
    ),
    "fn14_parse_filename": (
        parse_name,
        tables.sql(
            r"""SELECT scan_id, seq, CAST(regexp_extract(filename, 'X([+-][0-9.]+)_Y([+-][0-9.]+)\.png', 1) AS DOUBLE) AS x,
            CAST(regexp_extract(filename, 'X([+-][0-9.]+)_Y([+-][0-9.]+)\.png', 2) AS DOUBLE) AS y FROM fx_scan_points""", "fx_scan_points",
        ),
    ),
    "fn15_parse_mag": (parse_mag, tables.sql("SELECT id, coalesce(TRY_CAST(rtrim(mag_text, 'xX ') AS DOUBLE), 0e0) AS mag FROM fx_mags", "fx_mags")),
    "fn16_normalise_digits": (
        digits,
        tables.sql(f"SELECT doc_id, nullif(regexp_extract(translate(replace(raw, ' ', ''), '{_CHARS}', '{_DIGITS}'), '[0-9]'), '') AS digit FROM fx_digit_text", "fx_digit_text"),
    ),
    "fn17_grid_label": (
        grid_label,
        """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
        CASE WHEN l_linenumber <> 4 THEN CAST((l_partkey % 10) * 10 + l_suppkey % 10 AS INT) END AS xx,
        CASE WHEN l_linenumber <> 4 THEN CAST((l_linenumber % 10) * 10 + l_orderkey % 10 AS INT) END AS yy FROM lineitem""",
    ),
    "fn18_first_nice": (
        ladders,
        f"""SELECT o_orderkey, {_ladder_sql('o_totalprice / 50.0::DOUBLE / {v} <= 10', units.TICK_LADDER_UM, '2000')} AS tick_um,
        {_ladder_sql('o_totalprice / 2000.0::DOUBLE * {v} <= 200', units.ZOOM_LADDER_UM, _WIDE, True)} AS bar_um FROM orders""",
    ),
    "fn19_focus_level": (
        focus_level,
        tables.sql(
            """SELECT sweep_id, i, least(1000, CAST(trunc(log10(greatest(1e0, m)) / 16e-1 * 1000) AS INT)) AS bar,
            CASE WHEN m > 20 THEN 'sharp' WHEN m > 5 THEN 'fair' ELSE 'poor' END AS focus FROM (SELECT sweep_id, i, metric / 1e1 AS m FROM fx_sweep)""", "fx_sweep",
        ),
    ),
    "fn20_legacy_exposure": (
        legacy_exposure,
        "SELECT o_orderkey, CASE WHEN v < 1000 THEN v * 100 ELSE v END AS us, v < 1000 AS was_legacy FROM (SELECT o_orderkey, CAST(floor(o_totalprice / 100) AS INT) AS v FROM orders)",
    ),
    "fn21_estimate_scan": (
        scan_time,
        "SELECT o_orderkey, round(o_custkey * (5e-1 + 3e-1 + CASE WHEN o_orderkey % 30 > 0 THEN 1e0 / (o_orderkey % 30) ELSE 1e-1 END), 6) AS est_s FROM orders",
    ),
    "fn22_autofocus_window": (
        search_window,
        """SELECT o_orderkey, round(z - s * 50, 6) AS map_lo, round(z + s * 50, 6) AS map_hi, round(z - s * 50, 6) AS coarse_lo, round(z + s * 50, 6) AS coarse_hi,
        round(z - s * 10, 6) AS fine_lo, round(z + s * 10, 6) AS fine_hi, round(z - p * 3, 6) AS panel_lo, round(z + p * 3, 6) AS panel_hi
        FROM (SELECT o_orderkey, o_totalprice / 1e3 AS z, (1 + o_custkey % 10) / 1e3 AS s, o_custkey / 1e2 AS p FROM orders)""",
    ),
    "fn23_clamp": (clamp, tables.sql(f"SELECT event_id, round(greatest(min_mm, least(value - 2e2, max_mm)), 6) AS mm FROM {_AXIS_SQL}", "fx_axis")),
    "fl1_drop_dark_frames": (
        drop_dark, tables.sql("SELECT frame_id, round(avg(greatest(v - 110, 0)), 6) AS intensity FROM fx_frames GROUP BY 1 HAVING avg(greatest(v - 110, 0)) >= 15", "fx_frames"),
    ),
    "fl2_min_metric": (
        min_metric,
        tables.sql("SELECT * FROM (SELECT sweep_id, i, CASE WHEN i % 9 = 0 THEN NULL ELSE metric END AS metric FROM fx_sweep) WHERE metric IS NULL OR metric >= 100", "fx_sweep"),
    ),
    "fl3_min_improvement": (
        min_improvement,
        "SELECT o_orderkey FROM orders WHERE CASE WHEN o_orderkey % 8 = 0 THEN 0 ELSE o_totalprice / 10 END >= o_custkey * 20e0 * (1 + 5e0 / 1e2)",
    ),
    "fl6_crop_roi": (crop, tables.sql("SELECT frame_id, r, c, v FROM fx_frames WHERE r BETWEEN 2 AND 6 AND c BETWEEN 2 AND 6", "fx_frames")),
    "fl7_safe_zone": (
        safe_zone,
        """SELECT o_orderkey, round(x_lo, 6) AS x_lo, round(x_hi, 6) AS x_hi, round(y_lo, 6) AS y_lo, round(y_hi, 6) AS y_hi,
        CASE WHEN x_lo >= x_hi OR y_lo >= y_hi THEN 'error' ELSE 'ok' END AS status
        FROM (SELECT o_orderkey, least(a, b) + 2 AS x_lo, greatest(a, b) - 2 AS x_hi, least(c, d) + 2 AS y_lo, greatest(c, d) - 2 AS y_hi
        FROM (SELECT o_orderkey, o_totalprice / 1e4 AS a, o_custkey / 50e0 AS b, (o_orderkey % 40) * 1e0 AS c, (o_custkey % 60) * 1e0 AS d FROM orders))""",
    ),
    "ag1_frame_intensity": (frame_intensity, tables.sql("SELECT frame_id, round(avg(v), 6) AS intensity FROM fx_frames GROUP BY 1", "fx_frames")),
    "tk7_random_offsets": (
        random_offsets,
        """WITH s AS (SELECT s_suppkey, CAST(unnest(range(10)) AS INT) AS k, s_acctbal AS x, s_acctbal / 2 AS y FROM supplier),
        f AS (SELECT *, (CAST(s_suppkey AS BIGINT) * 48271 + k * 69621 + 7 * 40692 + 16807) % 2147483647 AS a, (CAST(s_suppkey AS BIGINT) * 48271 + k * 69621 + 7 * 40692 + 2 * 16807) % 2147483647 AS b FROM s),
        g AS (SELECT *, (a * a + a * 1103515245 + 12345) % 2147483647 AS a1, (b * b + b * 1103515245 + 12345) % 2147483647 AS b1 FROM f),
        h AS (SELECT *, (a1 * a1 + a1 * 1103515245 + 12345) % 2147483647 AS a2, (b1 * b1 + b1 * 1103515245 + 12345) % 2147483647 AS b2 FROM g)
        SELECT s_suppkey, k, round(x + (2 * (a2 / 2147483647e0) - 1) * 5e-1, 9) AS x, round(y + (2 * (b2 / 2147483647e0) - 1) * 5e-1, 9) AS y FROM h""",
    ),
}
