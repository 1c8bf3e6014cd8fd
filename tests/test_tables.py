"""Readers, writers, logs, look-ups and upserts on small hand-made rows, edge cases included."""

import json

import pytest
from pyspark.sql import functions as F

from scanlake import session
from scanlake.operators import logs, lookup, pixels, surface
from scanlake.sources import dims, files


def test_sweep_log_files(spark, tmp_path):
    log = {"timestamp": "20240101_000000", "result": "no_peak", "params": {"step_mm": 0.01}, "z_list": [0.1, 0.2], "m_list": [5.0, 6.5]}
    (tmp_path / "af_1_no_peak.json").write_text(json.dumps(log, indent=2))
    (tmp_path / "af_2_finished.json").write_text(json.dumps({**log, "result": "finished", "z_best": 0.2, "m_best": 6.5}, indent=2))
    rows = files.read_sweep_logs(spark, str(tmp_path)).orderBy("sweep_id", "i").collect()
    assert [(r["file"], r["i"], r["z_mm"], r["metric"], r["z_best"]) for r in rows] == [
        ("af_1_no_peak.json", 0, 0.1, 5.0, None), ("af_1_no_peak.json", 1, 0.2, 6.5, None), ("af_2_finished.json", 0, 0.1, 5.0, 0.2), ("af_2_finished.json", 1, 0.2, 6.5, 0.2)
    ]


def test_files_of_one_name_stay_apart(spark, tmp_path):
    for rig in ("a", "b"):
        (tmp_path / rig).mkdir()
        (tmp_path / rig / "log.json").write_text(json.dumps({"params": {}, "z_list": [0.1], "m_list": [5.0]}))
    logs_ = files.read_sweep_logs(spark, str(tmp_path / "*")).collect()
    assert len({r["sweep_id"] for r in logs_}) == 2 and {r["file"] for r in logs_} == {"log.json"}
    for rig, value in (("a", 1), ("b", 2)):
        (tmp_path / rig / "log.json").write_text(json.dumps({"5x": value, "10x": value}))
    assert len({(r["file"], r["key"], r["value"]) for r in files.read_presets(spark, str(tmp_path / "*"), "int").collect()}) == 4
    images = spark.createDataFrame([(f"file:/data/{rig}/wafer_scan_20240101_000000/img_X+1.000_Y-2.000.png", 1, 1, 1, b"0") for rig in "ab"] + [("x.png", 1, 1, 1, b"0")], "origin string, height int, width int, n_channels int, data binary")
    got = {r["scan_id"]: r["scan"] for r in files.scan_rows(images).collect()}
    assert got == {"file:/data/a/wafer_scan_20240101_000000": "wafer_scan_20240101_000000", "file:/data/b/wafer_scan_20240101_000000": "wafer_scan_20240101_000000", None: None}


def test_focus_map_files(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"z_ref": 2.0, "points": [{"x": 1, "y": 2, "z_offset": 0.5, "metric": 9}]}, indent=2))
    points, skipped = files.read_focus_maps(spark, str(tmp_path))
    assert [(r[0].rsplit("/", 1)[1], *r[1:]) for r in points.collect()] == [("m.json", 2, 1.0, 2.0, 2.5, 9.0)] and skipped.count() == 0


def test_focus_map_round_trip_in_parts(spark, tmp_path):
    points = spark.createDataFrame([(1, i, float(i), 0.0, 3.0 + i, 1.0) for i in range(25)], "map_id long, seq long, x double, y double, z double, metric double")
    models = spark.createDataFrame([(1, 15.0, 3)], "map_id long, z_ref double, degree int")
    skipped = spark.createDataFrame([(1, 99, 7.0, 8.0)], "map_id long, seq long, x double, y double")
    files.write_focus_maps(points, models, skipped, str(tmp_path / "maps"), limit=10)
    assert spark.read.json(str(tmp_path / "maps")).count() == 4
    got, left_out = files.read_focus_maps(spark, str(tmp_path / "maps"), multi_line=False)
    assert sorted((r["x"], r["z"], r["degree"]) for r in got.collect()) == [(float(i), 3.0 + i, 3) for i in range(25)]
    assert [tuple(r) for r in left_out.collect()] == [("1", 7.0, 8.0)]


def test_maps_without_a_model_are_written(spark, tmp_path):
    points = spark.createDataFrame([(1, 0, 0.0, 0.0, 3.0, 1.0), (1, 1, 1.0, 0.0, 5.0, 1.0)], "map_id long, seq long, x double, y double, z double, metric double")
    none = spark.createDataFrame([], "map_id long, z_ref double, degree int")
    files.write_focus_maps(points, none, spark.createDataFrame([], "map_id long, seq long, x double, y double"), str(tmp_path / "maps"))
    assert spark.read.json(str(tmp_path / "maps")).first()["z_ref"] == 4.0
    got, _ = files.read_focus_maps(spark, str(tmp_path / "maps"), multi_line=False)
    assert sorted(r["z"] for r in got.collect()) == [3.0, 5.0]


def test_intensity_keeps_odd_lines(spark):
    lines = spark.createDataFrame([("1,1,2,3,4,5,10,20,30,40,50",), ("ERR timeout",), ("time,stage_x,stage_y,stage_z,mean_intensity,centre_intensity",)], "value string")
    rows = files.parse_intensity(lines).orderBy("malformed").collect()
    assert len(rows) == 2 and rows[0]["rest"] == ["40", "50"] and len(rows[0]["pixels"]) == 1 and not rows[0]["malformed"]
    assert rows[1]["malformed"] and rows[1]["line"] == "ERR timeout" and rows[1]["time"] is None


def test_intensity_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time,stage_x,stage_y,stage_z,mean_intensity,centre_intensity,p0_B\n1.5,1,2,3,4,5,10,20,30,40,50,60\n2.5,1,2,3,4,5\n")
    rows = files.read_intensity_csv(spark, str(tmp_path)).orderBy("time").collect()
    assert [r["time"] for r in rows] == [1.5, 2.5] and [tuple(p) for p in rows[0]["pixels"]] == [(10, 20, 30), (40, 50, 60)] and rows[1]["pixels"] == []


def test_presets(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"_comment": "c", "X": {"step": 0.5}, "exposure_defaults": {"5x": 10, "_n": 1, "9x": "bad"}, "10x": 3}))
    axes = files.read_presets(spark, str(tmp_path), "struct<step:double>").where("value.step IS NOT NULL").collect()
    assert [(r["key"], r["value"]["step"]) for r in axes] == [("X", 0.5)]
    assert [tuple(r)[1:] for r in files.read_presets(spark, str(tmp_path), "int", "exposure_defaults").collect()] == [("5x", 10)]


def test_positions(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"Name": f"n{k}", "X": k, "Thumbnail": "zz"} for k in range(12)], indent=1))
    (tmp_path / "b.json").write_text("[]")
    rows = files.read_positions(spark, str(tmp_path)).orderBy("file", "slot").collect()
    assert len(rows) == 20 and rows[9]["name"] == "n9" and rows[9]["locked"] is False and rows[9]["y"] == 0 and rows[10]["name"] == "Pos 1" and rows[0]["n_given"] == 12 and rows[10]["n_given"] == 0
    files.write_positions(files.read_positions(spark, str(tmp_path)).drop("n_given"), str(tmp_path / "out"))
    saved = spark.read.text(str(tmp_path / "out")).collect()
    assert len(saved) == 2 and all("Thumbnail" not in r["value"] and len(json.loads(r["value"])) == 10 for r in saved)


def test_manifest_appends(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, "a"), (2, 1.5, "b")], "scan_id long, x double, filename string")
    for _ in range(2):
        files.write_scan_manifest(df, str(tmp_path / "m"))
    back = files.read_scan_manifest(spark, str(tmp_path / "m"))
    assert back.count() == 4 and "PartitionFilters: [isnotnull(scan_id" in back.where("scan_id = 1")._jdf.queryExecution().toString()


def test_position_reply_and_fill(spark):
    lines = [(0, "ERR"), (1, "10,20,30"), (2, "1,2"), (3, "5,x,7"), (4, "7,8,9,extra"), (5, "")]
    df = spark.createDataFrame([(1, k, line) for k, line in lines], "instrument_id long, event_id long, line string")
    df = df.withColumn("ts", F.timestamp_seconds(F.col("event_id") * 50_000))
    rows = logs.forward_fill(logs.parse_position_reply(df), ("x", "y", "z"), seconds=60_000).orderBy("event_id").collect()
    assert [(r["x"], r["y"], r["z"]) for r in rows] == [(0, 0, 0), (10, 20, 30), (10, 20, 30), (10, 20, 30), (7, 8, 9), (7, 8, 9)]


def test_latest_position_over_slices(spark):
    df = spark.createDataFrame([(1, t, k) for k, t in enumerate((0, 10, 90_000, 400_000))], "instrument_id long, s long, x long").withColumn("ts", F.timestamp_seconds("s"))
    caps = spark.createDataFrame([(7, 1, 10), (8, 1, 89_999), (9, 1, 900_000), (10, 2, 5), (11, 1, -1)], "capture_id long, instrument_id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    rows = {r["capture_id"]: r["x"] for r in lookup.latest_position(caps.drop("s"), df.drop("s"), ["x"], seconds=3600).collect()}
    assert rows == {7: 1, 8: 1, 9: 3, 10: None, 11: None}


def test_rising_edges(spark):
    states = [(0, False, False), (1, True, False), (2, True, False), (3, True, True), (4, False, False), (5, True, False)]
    df = spark.createDataFrame([(1, *s) for s in states], "instrument_id long, event_id long, a boolean, c boolean").withColumn("ts", F.timestamp_seconds(F.col("event_id") * 86_400))
    assert sorted(r["event_id"] for r in logs.rising_edges(df, F.col("a"), F.col("c")).collect()) == [1, 3, 5]


def test_scan_eta(spark):
    df = spark.createDataFrame([(1, k, 100 + 10 * k) for k in range(4)], "scan_id long, seq long, s long").withColumn("ts", F.timestamp_seconds("s"))
    totals = spark.createDataFrame([(1, 8)], "scan_id long, total long")
    rows = logs.scan_eta(df, totals).orderBy("seq").collect()
    assert rows[0]["remaining_s"] is None and rows[3]["remaining_s"] == pytest.approx(30.0) and [r["pct"] for r in rows] == [20, 31, 41, 52]


def test_nearest_defaults_ties_and_user(spark):
    df = spark.createDataFrame([(7.5,), (30.0,), (100.0,), (12.0,)], "mag double")
    user = spark.createDataFrame([(12.0, 9.9)], "mag double, step_mm double")
    rows = {r["mag"]: (r["step_mm"], r["source"]) for r in lookup.nearest_defaults(df, dims.AUTOFOCUS, user, ["step_mm"]).collect()}
    assert rows == {7.5: (0.01, "built-in"), 30.0: (0.001, "built-in"), 100.0: (0.001, "built-in"), 12.0: (9.9, "user")}
    assert lookup.nearest_defaults(df, dims.AUTOFOCUS).where("mag = 7.5").first()["z_range_mm"] == 4.0


def test_calibration_unknown_is_null(spark):
    df = spark.createDataFrame([("10x",), ("7x",)], "mag string")
    rows = {r["mag"]: (r["ppm"], r["bar_um"]) for r in lookup.with_calibration(df, dims.objectives(spark), defaults={"bar_um": 100}).collect()}
    assert rows == {"10x": (2.03, 100), "7x": (None, 100)}


def shift(spark, z, locked, target, z_new, lock_delta=True):
    presets = spark.createDataFrame([(1, k, zz, lk) for k, (zz, lk) in enumerate(zip(z, locked))], "instrument_id long, mag long, z_mm double, locked boolean")
    change = spark.createDataFrame([(1, target, z_new, lock_delta)], "instrument_id long, mag long, z_new double, lock_delta boolean")
    return [r["z_mm"] for r in lookup.shift_presets(presets, change).orderBy("mag").collect()]


def test_shift_presets(spark):
    free = [False] * 3
    assert shift(spark, [1.0, 2.0, 3.0], [False, True, False], 0, 1.5) == [1.5, 2.0, 3.5]
    assert shift(spark, [1.0, 2.0, 3.0], free, 0, 1.5, lock_delta=False) == [1.5, 2.0, 3.0]
    assert shift(spark, [1.0, None, 3.0], free, 0, 1.5) == [1.5, None, 3.0]
    assert shift(spark, [None, 2.0, 3.0], free, 0, 1.5) == [1.5, 2.0, 3.0]
    assert shift(spark, [1.0, 2.0, 3.0], [True, False, False], 0, 1.5) == [1.0, 2.0, 3.0]


def test_merge_defaults_keeps_focus(spark):
    base = spark.createDataFrame([(5, 0.1, 1.0), (10, 0.2, 2.0)], "mag long, step_mm double, last_focus_z double")
    over = spark.createDataFrame([(10, 0.3), (20, 0.4)], "mag long, step_mm double")
    assert sorted(map(tuple, lookup.merge_defaults(base, over).collect())) == [(5, 0.1, 1.0), (10, 0.3, 2.0), (20, 0.4, None)]


def test_gates(spark):
    df = spark.createDataFrame([(1, None), (2, 99.9), (3, 100.0)], "id long, metric double")
    assert sorted(r["id"] for r in pixels.min_metric(df).collect()) == [1, 3]
    runs = spark.createDataFrame([(1, 10.0, 10.4), (2, 10.0, 10.6), (3, 10.0, None), (4, 0.0, None)], "id long, m0 double, m_final double")
    assert sorted(r["id"] for r in pixels.min_improvement(runs, 5.0).collect()) == [2, 4]


def test_map_points_status(spark):
    done = spark.createDataFrame([(1, 1.0, 2.0, 3.0, 0.0), (1, 1.0, 2.0, 3.0, 8.0)], "map_id long, x double, y double, z double, metric double")
    gone = spark.createDataFrame([(1, 5.0, 6.0)], "map_id long, x double, y double")
    assert sorted(r["status"] for r in surface.map_points(done, gone).collect()) == ["manual", "measured", "skipped"]


def test_shared_folder_comes_from_the_session(spark):
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert session.shared_path(spark, "x").startswith(root) and session.shared_path(spark, "x") != session.shared_path(spark, "x")


def test_an_intensity_line_is_split_once(spark):
    lines = spark.createDataFrame([("1,2,3,4,5,6,7,8,9,10,11,12,13",)], "value string")
    out = files.parse_intensity(lines)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("transform(") == 2  # the numbers, and the triples that name them
    row = out.first()
    assert [tuple(p) for p in row["pixels"]] == [(7, 8, 9), (10, 11, 12)] and row["rest"] == ["13"]
