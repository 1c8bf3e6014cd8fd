"""Queries that write the given tables in a dataset's format and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanlake.functions import naming
from scanlake.operators import planning, surface, tiles
from scanlake.plans import tables
from scanlake.session import shared_path
from scanlake.sources import captures, files

C = F.col


def sweep_logs(spark, sf_dir):
    path = shared_path(spark, "sweep-logs")
    files.write_sweep_logs(tables.sweep(spark, sf_dir), path, limit=50)
    out = files.read_sweep_logs(spark, path, multi_line=False)
    return out.select(C("sweep_id").cast("long").alias("sweep_id"), "i", "z_mm", "metric")


def focus_maps(spark, sf_dir):
    path = shared_path(spark, "focus-maps")
    points = tables.points(spark, sf_dir)
    models = points.groupBy("map_id").agg(F.avg("z").alias("z_ref")).withColumn("degree", F.lit(2))
    files.write_focus_maps(points.where("seq % 7 <> 0"), models, points.where("seq % 7 = 0"), path, limit=20_000)
    kept, skipped = files.read_focus_maps(spark, path, multi_line=False)
    both = surface.map_points(kept, skipped)
    return both.select(C("map_id").cast("long").alias("map_id"), "x", "y", F.round("z", 6).alias("z"), F.round("metric", 6).alias("metric"), "status", "degree")


def intensity_log(spark, sf_dir):
    path = shared_path(spark, "intensity")
    lines = tables.load(spark, sf_dir, "orders").selectExpr(
        "concat_ws(',', o_orderkey, o_custkey, o_totalprice, 1.5, 2.25, 3.125, array_join(transform(CASE WHEN o_orderkey % 9 > 0 THEN sequence(1, CAST(o_orderkey % 9 AS INT) * 3) ELSE array() END, k -> CAST((o_custkey + k) % 256 AS STRING)), ',')) AS value"
    )
    lines.write.text(path)
    out = files.read_intensity_csv(spark, path)
    total = F.aggregate("pixels", F.lit(0), lambda acc, p: acc + p["b"] + 2 * p["g"] + 3 * p["r"])
    return out.select(C("time").cast("long").alias("o_orderkey"), "stage_x", "stage_y", "mean_intensity", F.size("pixels").alias("n"), total.alias("checksum"))


def presets(spark, sf_dir):
    rows = tables.load(spark, sf_dir, "part").selectExpr(
        "p_partkey",
        """concat('{"_comment": "x", "exposure_defaults": {"5x": ', p_size, ', "_note": 1, "20x": ', p_partkey, '}, "Z": {"step": ', p_retailprice, ', "invert": -1, "unit": "mm"}, "10x": 3}') AS doc""",
    )
    exposures = files.explode_presets(rows, "doc", "int", "exposure_defaults").select("p_partkey", "key", C("value").cast("double").alias("value"))
    axes = files.explode_presets(rows, "doc", "struct<step:double,invert:int,unit:string>").where("value.step IS NOT NULL").select("p_partkey", "key", C("value.step").alias("value"))
    return exposures.unionByName(axes)


def _slots(spark, sf_dir):
    return planning.limit_positions(tables.load(spark, sf_dir, "lineitem"), ("l_orderkey",), ("l_partkey", "l_suppkey", "l_linenumber"))


def limit_positions(spark, sf_dir):
    return _slots(spark, sf_dir).select("l_orderkey", "slot", "l_partkey", "l_suppkey")


def positions(spark, sf_dir):
    # all lines of two orders make a list, so that some lists are longer than the ten slots
    entry = """concat('{"Name": "m', l_linenumber, '", "Locked": ', l_tax > 0.04, ', "X": ', l_partkey, ', "Y": ', l_suppkey, '}')"""
    rows = tables.load(spark, sf_dir, "lineitem").selectExpr("l_orderkey DIV 8 AS file", f"struct(l_orderkey, l_partkey, l_suppkey, l_linenumber, {entry} AS e) AS s")
    rows = rows.groupBy("file").agg(F.sort_array(F.collect_list("s")).alias("l"))
    return files.explode_positions(rows.select("file", F.concat(F.lit("["), F.array_join(F.transform("l", lambda s: s["e"]), ","), F.lit("]")).alias("value")), "value")


def scan_rows(spark, sf_dir):
    points = tables.scan_points(spark, sf_dir)
    folder = F.concat(F.lit("/data/rig"), C("scan_id").cast("string"), F.lit("/wafer_scan_20240101_000000/"))
    packed = tables.packed_frames(spark, sf_dir).withColumnRenamed("frame_id", "seq")
    images = points.select("seq", F.concat(folder, "filename").alias("origin")).join(packed, "seq")
    rows = files.scan_rows(images)
    first = F.conv(F.hex(F.substring("data", 1, 1)), 16, 10).cast("int").alias("first_pixel")
    return rows.select("frame_id", "scan_id", "scan", "x", "y", "height", "width", first, F.octet_length("data").alias("bytes"))


def manifest(spark, sf_dir):
    path = shared_path(spark, "manifest")
    points = tables.scan_points(spark, sf_dir)
    x, y = naming.parse_filename(C("filename"))
    files.write_scan_manifest(points.select("scan_id", "seq", x.alias("x"), y.alias("y"), "filename"), path)
    out = files.read_scan_manifest(spark, path)
    return out.select("scan_id", "seq", "x", "y", "filename")


def manifest_upsert(spark, sf_dir):
    path = shared_path(spark, "versions")
    points = tables.scan_points(spark, sf_dir)
    x, y = naming.parse_filename(C("filename"))
    points = points.select("scan_id", "seq", x.alias("x"), y.alias("y"), "filename")
    files.upsert_manifest(points, path, 0)
    # some points are captured again, and their batch is written twice, as after a failure
    again = points.where("seq % 3 = 0").withColumn("x", C("x") + 1000)
    for _ in range(2):
        files.upsert_manifest(again, path, 1)
    compact = shared_path(spark, "compact")
    files.compact_manifest(spark, path, compact)
    files.upsert_manifest(points.where("seq % 5 = 0").withColumn("y", C("y") - 1000), compact, 1)
    return files.read_newest(spark, compact).select("scan_id", "seq", "x", "y", "filename")


def capture_files(spark, sf_dir):
    """16-bit frames written as PNG files of a scan and read back by place."""
    captures.register(spark)
    path = shared_path(spark, "captures")
    place = "format_string('wafer_scan_20240101_000000/img_X%+.3f_Y%+.3f.png', frame_id * 5e-1, -frame_id * 25e-2) AS file"
    wide = F.unhex(F.array_join(F.transform(F.sequence(F.lit(1), F.length("data")), lambda i: F.concat(*[F.hex(F.substring(C("data"), i, F.lit(1)))] * 2)), ""))
    captures.write_captures(tables.packed_mosaic(spark, sf_dir).withColumn("data", wide).selectExpr(place, "height", "width", "n_channels", "data"), path)
    found = spark.read.format("captures").option("tile", 16).load(path).where("x >= 1 AND scan = 'wafer_scan_20240101_000000'")
    found = found.withColumn("frame_id", F.rint(C("x") * 2).cast("long"))
    return tiles.pixels(found, (16, 16), keys=("frame_id", "x", "y"))


QUERIES = {
    "src1_captures": (
        capture_files,
        tables.sql("SELECT frame_id, frame_id * 5e-1 AS x, -frame_id * 25e-2 AS y, r, c, v * 257 AS v FROM fx_mosaic WHERE frame_id * 5e-1 >= 1", "fx_mosaic"),
    ),
    "src10_manifest_upsert": (
        manifest_upsert,
        tables.sql(
            r"""SELECT scan_id, seq, x + CASE WHEN seq % 3 = 0 AND seq % 5 <> 0 THEN 1000 ELSE 0 END AS x, y - CASE WHEN seq % 5 = 0 THEN 1000 ELSE 0 END AS y, filename FROM (
            SELECT *, CAST(regexp_extract(filename, 'X([+-][0-9.]+)_Y([+-][0-9.]+)\.png', 1) AS DOUBLE) AS x, CAST(regexp_extract(filename, 'X([+-][0-9.]+)_Y([+-][0-9.]+)\.png', 2) AS DOUBLE) AS y FROM fx_scan_points)""",
            "fx_scan_points",
        ),
    ),
    "src3_sweep_logs": (sweep_logs, tables.sql("SELECT sweep_id, i, round(z_mm, 6) AS z_mm, round(metric, 4) AS metric FROM fx_sweep", "fx_sweep")),
    "src4_src5_focus_maps": (
        focus_maps,
        tables.sql(
            """SELECT map_id, x, y, round(CASE WHEN seq % 7 <> 0 THEN z END, 6) AS z, round(CASE WHEN seq % 7 <> 0 THEN metric END, 6) AS metric,
            CASE WHEN seq % 7 = 0 THEN 'skipped' ELSE 'measured' END AS status, CASE WHEN seq % 7 <> 0 THEN 2 END AS degree FROM fx_points""", "fx_points",
        ),
    ),
    "src6_intensity_csv": (
        intensity_log,
        """SELECT o_orderkey, o_custkey * 1e0 AS stage_x, o_totalprice AS stage_y, 225e-2 AS mean_intensity, CAST(o_orderkey % 9 AS INT) AS n,
        CAST(coalesce(list_sum(list_transform(range(1, (o_orderkey % 9) * 3 + 1), lambda k: ((k - 1) % 3 + 1) * ((o_custkey + k) % 256))), 0) AS INT) AS checksum FROM orders WHERE o_orderkey % 9 > 0
        UNION ALL SELECT o_orderkey, o_custkey * 1e0, o_totalprice, 225e-2, 0, 0 FROM orders WHERE o_orderkey % 9 = 0""",
    ),
    "src7_presets": (
        presets,
        """SELECT p_partkey, '5x' AS key, p_size * 1e0 AS value FROM part UNION ALL SELECT p_partkey, '20x', p_partkey * 1e0 FROM part UNION ALL SELECT p_partkey, 'Z', p_retailprice FROM part""",
    ),
    "src8_positions": (
        positions,
        """WITH s AS (SELECT *, l_orderkey // 8 AS file, row_number() OVER (PARTITION BY l_orderkey // 8 ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_tax > 0.04) AS slot FROM lineitem),
        o AS (SELECT file, CAST(count(*) AS INT) AS n_given, CAST(unnest(range(1, 11)) AS INT) AS slot FROM s GROUP BY file)
        SELECT o.file, n_given, o.slot, coalesce('m' || l_linenumber, 'Pos ' || o.slot) AS name, coalesce(l_tax > 0.04, false) AS locked, coalesce(l_partkey, 0) AS x, coalesce(l_suppkey, 0) AS y,
        CAST(0 AS BIGINT) AS z, CAST(NULL AS VARCHAR) AS mag FROM o LEFT JOIN s ON s.file = o.file AND s.slot = o.slot""",
    ),
    "tk6_limit_positions": (
        limit_positions,
        """SELECT l_orderkey, CAST(slot AS INT) AS slot, l_partkey, l_suppkey FROM (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber) AS slot FROM lineitem) WHERE slot <= 10""",
    ),
    "src1_scan_rows": (
        scan_rows,
        tables.sql(
            r"""SELECT '/data/rig' || scan_id || '/wafer_scan_20240101_000000/' || filename AS frame_id, '/data/rig' || scan_id || '/wafer_scan_20240101_000000' AS scan_id, 'wafer_scan_20240101_000000' AS scan,
            CAST(regexp_extract(filename, 'X([+-][0-9.]+)_Y([+-][0-9.]+)\.png', 1) AS DOUBLE) AS x, CAST(regexp_extract(filename, 'X([+-][0-9.]+)_Y([+-][0-9.]+)\.png', 2) AS DOUBLE) AS y, 8 AS height, 8 AS width, v AS first_pixel, 64 AS bytes
            FROM fx_scan_points JOIN fx_frames b ON b.frame_id = seq AND r = 0 AND b.c = 0""", "fx_scan_points", "fx_frames",
        ),
    ),
    "src10_manifest": (
        manifest,
        tables.sql(
            r"""SELECT scan_id, seq, CAST(regexp_extract(filename, 'X([+-][0-9.]+)_Y([+-][0-9.]+)\.png', 1) AS DOUBLE) AS x,
            CAST(regexp_extract(filename, 'X([+-][0-9.]+)_Y([+-][0-9.]+)\.png', 2) AS DOUBLE) AS y, filename FROM fx_scan_points""", "fx_scan_points",
        ),
    ),
}
