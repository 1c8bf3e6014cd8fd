"""Scalar builders at their anchors and round trips."""

import pytest
from pyspark.sql import functions as F

from scanlake.functions import naming, units


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_white_balance_anchors(spark):
    for kelvin, red, blue in ((2800, 2.2, 0.7), (5500, 1.3957, 1.4468), (7500, 0.8, 2.0), (1000, 2.2, 0.7), (9000, 0.8, 2.0)):
        r, b = units.wb_ratios(F.lit(float(kelvin)))
        row = one(spark, r=r, b=b)
        assert row["r"] == pytest.approx(red, abs=1e-3) and row["b"] == pytest.approx(blue, abs=1e-3)


def test_counts_round_trip(spark):
    step, invert = F.lit(0.000025), F.lit(-1)
    df = spark.range(1000).select((F.col("id") * 0.00317 - 1).alias("mm"))
    back = df.select("mm", units.counts_to_mm(units.mm_to_counts(F.col("mm"), step, invert), step, invert).alias("b")).collect()
    assert all(abs(r["mm"] - r["b"]) <= 0.0000125 + 1e-12 for r in back)
    assert one(spark, a=units.mm_to_counts(F.lit(0.5), F.lit(1.0), F.lit(1)), b=units.mm_to_counts(F.lit(1.5), F.lit(1.0), F.lit(1))) == (0, 2)


def test_exposure_slider(spark):
    row = one(spark, lo=units.exposure_from_pos(F.lit(0)), hi=units.exposure_from_pos(F.lit(1000)), mid=units.pos_from_exposure(F.lit(1000.0)), low=units.pos_from_exposure(F.lit(1.0)))
    assert tuple(row) == (10, 1_000_000, 400, 0)
    assert tuple(one(spark, a=units.legacy_exposure_us(F.lit(35)), b=units.legacy_exposure_us(F.lit(1000)))) == (3500, 1000)


def test_focus_bar_and_class(spark):
    rows = spark.createDataFrame([(0.5,), (1.0,), (5.0,), (20.1,), (40.0,), (1e6,)], "m double")
    got = [(r["b"], r["c"]) for r in rows.select(units.focus_bar(F.col("m")).alias("b"), units.focus_class(F.col("m")).alias("c")).collect()]
    assert got[0] == (0, "poor") and got[2] == (436, "poor") and got[3][1] == "sharp" and got[5][0] == 1000


def test_measure_and_moves(spark):
    m = units.measure(F.lit(0.0), F.lit(0.0), F.lit(3.0), F.lit(4.0), F.lit(2.0))
    row = one(spark, **m)
    assert row["dist_px"] == 5 and row["dist_um"] == 2.5 and row["dist_err_um"] == 0.5 and row["angle_deg"] == pytest.approx(53.1301, abs=1e-4)
    same = units.measure(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(2.0))
    assert one(spark, e=same["angle_err_deg"])["e"] == 0
    x, y = units.grid_to_stage(F.lit(2), F.lit(0), F.lit(90.0))
    assert tuple(one(spark, x=x, y=y)) == pytest.approx((0.0, 1.0))
    x, y = units.pixel_to_stage(F.lit(350.0), F.lit(200.0), 600, 300, F.lit(2.0))
    assert tuple(one(spark, x=x, y=y)) == pytest.approx((0.025, -0.025))


def test_contrast_inverse(spark):
    back = [F.lit(100), F.lit(100), F.lit(100)]
    assert one(spark, c=units.contrast_pct([F.lit(90), F.lit(90), F.lit(90)], back))["c"] == pytest.approx(-10)
    assert one(spark, c=units.contrast_pct([F.lit(1)] * 3, [F.lit(0)] * 3))["c"] is None
    assert one(spark, c=units.colour_from_contrast(F.lit(100.0), F.lit(-10.0)), d=units.colour_from_contrast(F.lit(200.0), F.lit(90.0))) == (90, 255)


def test_filename_round_trip(spark):
    df = spark.createDataFrame([(" wafer 7 ", "10x", 7.0, -1.5, 22.125), ("", "a/b", None, None, 2.0)], "s string, m string, e double, x double, y double")
    name = naming.build_filename(F.col("s"), F.lit("2024-03-04 05:06:07").cast("timestamp"), F.col("m"), F.col("e"), F.col("x"), F.col("y"))
    x, y = naming.parse_filename(F.col("name"))
    rows = df.withColumn("name", name).select("name", x.alias("px"), y.alias("py")).collect()
    assert rows[0] == ("wafer 7_20240304_050607_10x_7ms_X-1.500_Y+22.125.png", -1.5, 22.125)
    assert rows[1] == ("capture_20240304_050607_a-b.png", None, None)
    tile = naming.parse_filename(F.concat(F.lit("file:/d/"), naming.tile_filename(F.lit(0.25), F.lit(-3.0))))
    assert tuple(one(spark, x=tile[0], y=tile[1])) == (0.25, -3.0)


def test_digits_and_labels(spark):
    for text, want in (("q", "9"), ("O l", "0"), ("x B", "8"), ("", None), ("abc"[:1], None), ("?|", "1"), ("7s", "7")):
        assert one(spark, d=naming.normalise_digits(F.lit(text)))["d"] == want
    xx, yy = naming.grid_label(F.lit("0"), F.lit("7"), F.lit("1"), F.lit("2"))
    assert tuple(one(spark, x=xx, y=yy)) == (7, 12)
    xx, yy = naming.grid_label(F.lit("0"), F.lit("7"), F.lit(None).cast("string"), F.lit("2"))
    assert tuple(one(spark, x=xx, y=yy)) == (None, None)
    assert [one(spark, m=naming.parse_mag(F.lit(t)))["m"] for t in ("20x", "2.5X ", "?x", "")] == [20.0, 2.5, 0.0, 0.0]


def test_ladders(spark):
    row = one(spark, t=units.tick_interval_um(F.lit(95.0)), u=units.tick_interval_um(F.lit(1e9)), z=units.zoom_bar_um(F.lit(12.0)), y=units.zoom_bar_um(F.lit(500.0)))
    assert tuple(row) == (10, 2000, 10, 1)


def test_stage_map_round_trip(spark):
    limits = (-1000.0, 1000.0, -500.0, 500.0)
    x, y = units.map_to_mm(F.lit(300), F.lit(50), 400, 100, limits)
    row = one(spark, x=x, y=y)
    assert tuple(row) == (0.5, 0.0)
    px, py = units.mm_to_map(F.lit(500.0), F.lit(0.0), 400, 100, limits)
    assert tuple(one(spark, x=px, y=py)) == (300, 50)
    far, _ = units.map_to_mm(F.lit(9999), F.lit(0), 400, 100, limits)
    assert one(spark, x=far)["x"] == 1.0


def test_optics(spark):
    row = one(
        spark, bar=units.scale_bar_px(units.ppm_effective(F.lit(2.03), F.lit(2)), units.bar_um(F.lit("10x"))), other=units.bar_um(F.lit("7x")),
        fov=units.fov_mm(F.lit(616.0), F.lit(2.03), 3), gray=units.to_gray(F.lit(255), F.lit(255), F.lit(255)), est=units.estimate_scan_s(F.lit(10), 0.5, F.lit(0)),
    )
    assert tuple(row) == (101, 100, 0.303, 255, pytest.approx(9.0))
