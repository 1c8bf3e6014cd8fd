"""Streaming queries, run to the end of the given tables. Each has the result of its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanlake.operators import logs, ordered
from scanlake.plans import tables
from scanlake.plans.logs_catalogue import LATEST_SQL, RATE_SQL
from scanlake.plans.sweeps_catalogue import _EDGE_CTE, _peak_sql
from scanlake.session import cut_lineage, shared_path
from scanlake.streaming import stateful, windows

C = F.col
BATCHES = 3


#: Time by which a feed may be out of order: of the events, and of steps and frames a second apart. Time of the row that closes a feed.
DELAY, STEP_DELAY = "1 day", "10 seconds"
CLOSING = "timestamp'2100-01-01 00:00:00'"
#: Milliseconds after its last step at which a sweep or trace counts as finished.
REST_MS = 5_000
#: Second of step 0; a stream's first watermark is the epoch, and what is not later is too late.
START = 1_000_000_000
#: Added to the ids of rows that come too late, and the seconds by which they are older than the first batch's newest row.
LATE_ID, LATE_BY = 1_000_000_000, 2 * ordered.DAY


def _stream_of(rows, order, closing=None, late=None):
    """Write a table in ranges of a number or time, one after the other, and stream a range a batch.

    ``late`` are changes to the rows of the first range that are older than the delay (column to expression), which come again with
    them in the last batch, behind the watermark. ``closing`` are columns of one more row that moves the watermark past all others.
    """
    rows = cut_lineage(rows)
    spark, path = rows.sparkSession, shared_path(rows.sparkSession, "feed")
    place = C(order).cast("double")
    edges = rows.select(place.alias("p")).approxQuantile("p", [k / BATCHES for k in range(1, BATCHES)], 0.001)
    ends = [float("-inf"), *edges, float("inf")]
    files = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // BATCHES)
    for k, (low, high) in enumerate(zip(ends, ends[1:])):
        part = rows.where((place > low) & (place <= high))
        if late and k == BATCHES - 1:
            part = part.unionByName(rows.where(place <= edges[0] - LATE_BY).withColumns({c: F.expr(e) for c, e in late.items()}))
        # as many files in each batch, empty ones included
        part.repartition(files, F.rand(k)).write.mode("append").option("maxRecordsPerFile", 0).parquet(path)
    if closing:
        spark.range(1).selectExpr(*[f"CAST({closing.get(f.name, 'NULL')} AS {f.dataType.simpleString()}) AS {f.name}" for f in rows.schema]).write.mode("append").parquet(path)
    return windows.read_stream(spark, path, rows.schema, files_per_trigger=files)


def _events(spark, sf_dir, closing=None, late=None):
    """The events as a stream of several batches with a zoned time."""
    events = tables.load(spark, sf_dir, "events").withColumn("ts", C("ts").cast("timestamp")).drop("props")
    return _stream_of(events, "ts", closing, late).withColumnRenamed("user_id", "instrument_id")


def temporal_average(spark, sf_dir):
    frames = tables.load(spark, sf_dir, "embeddings")
    frames = ordered.dense_index(frames, ["label"], ["vec_id"], ordered.index_slice(C("vec_id")), "n")
    gray = F.transform("embedding", lambda e: F.floor(F.least(F.greatest((e.cast("double") + 0.6) / 1.2, F.lit(0.0)), F.lit(1.0)) * 255))
    rows = frames.select(C("label").cast("long").alias("camera"), F.lit(0).alias("tile"), "n", gray.cast("array<double>").alias("v"))
    # each camera loses one frame in 29
    rows = rows.where("n % 29 <> 13").withColumn("ts", F.timestamp_seconds(C("n") + START))
    feed = _stream_of(rows, "n", {"camera": "-1", "tile": "0", "n": "0", "v": "array(0)", "ts": CLOSING}).withWatermark("ts", STEP_DELAY)
    out = windows.run_available(stateful.stream_temporal_average(feed, 4, REST_MS)).where("camera >= 0")
    cells = out.select("camera", "n", F.posexplode("avg_v").alias("p", "avg_v"))
    return cells.selectExpr("camera", "CAST(p DIV 8 AS INT) AS r", "p % 8 AS c", "n", "avg_v")


def frame_rate(spark, sf_dir):
    events = _events(spark, sf_dir, late={"event_id": f"event_id + {LATE_ID}"}).withWatermark("ts", DELAY).where("event_type = 'purchase'")
    return windows.run_available(windows.stream_frame_rate(events, seconds=3600), "update", ["instrument_id", "window_start"])


def latest_frame(spark, sf_dir):
    events = _events(spark, sf_dir).where("event_type = 'purchase'").select("instrument_id", "ts", C("event_id").alias("frame_id"))
    return windows.run_available(windows.latest_frame(events), "update", ["instrument_id"]).select("instrument_id", "frame_id")


def progress(spark, sf_dir):
    stream = _stream_of(tables.load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").select((C("o_custkey") % 20).alias("scan_id"))
    totals = tables.scan_points(spark, sf_dir).groupBy("scan_id").agg((F.count(F.lit(1)) + 100).alias("total"))
    return windows.run_available(windows.stream_progress(stream, totals), "update", ["scan_id"])


def peak(spark, sf_dir):
    # one gap in 29 steps: by turns the row is missing, or only its metric
    rows = tables.sweep(spark, sf_dir).where("i % 58 <> 13").withColumn("metric", F.when(C("i") % 29 != 13, C("metric")))
    rows = rows.withColumn("ts", F.timestamp_seconds(C("i") + START))
    feed = _stream_of(rows, "i", {"sweep_id": "-1", "ts": CLOSING, "i": "0"}).withWatermark("ts", STEP_DELAY)
    out = windows.run_available(stateful.stream_peak(feed, 10, REST_MS))
    return out.select("sweep_id", "peak_kind", "peak_i", F.round("peak_z", 6).alias("peak_z"))


def edge(spark, sf_dir):
    rows = tables.edge(spark, sf_dir).withColumn("ts", F.timestamp_seconds(C("i") + START))
    feed = _stream_of(rows, "i", {"scan_id": "-1", "dir": "'end'", "ts": CLOSING, "i": "0"}).withWatermark("ts", STEP_DELAY)
    out = windows.run_available(stateful.stream_edge(feed, 2, rest_ms=REST_MS)).where("scan_id >= 0")
    return out.select("scan_id", "dir", F.round("edge_mm", 6).alias("edge_mm"), "edge_kind")


def latest_position(spark, sf_dir):
    events = _events(spark, sf_dir, {"user_id": "-1", "event_id": "-1", "ts": CLOSING, "value": "0", "event_type": "'click'"}, {"event_id": f"event_id + {LATE_ID}"})
    captures = events.where("event_type = 'purchase'").select(C("event_id").alias("capture_id"), "instrument_id", "ts")
    good = "concat(CAST(CAST(floor(value * 10) AS BIGINT) AS STRING), ',', CAST(event_id AS STRING), ',', CAST(instrument_id AS STRING))"
    lines = events.where("event_type <> 'purchase'").selectExpr("instrument_id", "ts", f"CASE WHEN event_type = 'error' THEN 'ERR' ELSE {good} END AS line")
    readings = logs.parse_position_reply(lines).where("x IS NOT NULL")
    return windows.run_available(stateful.stream_latest_position(captures, readings, DELAY, 5 * ordered.DAY))


QUERIES = {
    "sm1_stream_temporal_average": (
        temporal_average,
        tables.sql(
            """SELECT CAST(label AS BIGINT) AS camera, r, c, n, CAST(floor(avg(v) OVER (PARTITION BY label, r, c ORDER BY n ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) AS INT) AS avg_v
            FROM fx_frames JOIN (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS n FROM embeddings) e ON e.vec_id = frame_id WHERE n % 29 <> 13""", "fx_frames",
        ),
    ),
    "sm2_stream_frame_rate": (frame_rate, tables.sql(RATE_SQL.format(s=3600), "fx_captures")),
    "sm3_latest_frame": (
        latest_frame, tables.sql("SELECT instrument_id, arg_max(capture_id, (ts, capture_id)) AS frame_id FROM fx_captures GROUP BY 1", "fx_captures"),
    ),
    "sm4_stream_peak": (
        peak, "SELECT sweep_id, peak_kind, peak_i, peak_z FROM (" + _peak_sql("fx_gappy", 10) + ")",
    ),
    "sm5_stream_edge": (
        edge, tables.sql("SELECT scan_id, dir, round(edge_mm, 6) AS edge_mm, edge_kind FROM e", "fx_edge", extra=_EDGE_CTE),
    ),
    "sm6_stream_progress": (
        progress,
        "SELECT o_custkey % 20 AS scan_id, count(*) AS captured, count(*) + 100 AS total, CAST(10 + floor(count(*) / (count(*) + 100) * 85) AS INT) AS pct FROM orders GROUP BY 1",
    ),
    "sm7_stream_latest_position": (latest_position, LATEST_SQL),
}
