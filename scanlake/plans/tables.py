"""Scan-shaped tables derived from the test data, in Spark and as DuckDB common table expressions.

Both sides of a table give the same rows. Exponent literals keep every number DOUBLE in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlake.operators import ordered


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8x8 gray frames in long form."""
    gray = "CAST(floor(least(greatest((CAST(e AS DOUBLE) + 6e-1) / 12e-1, 0e0), 1e0) * 255) AS INT)"
    cells = load(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "e"))
    return cells.selectExpr("vec_id AS frame_id", "CAST(p DIV 8 AS INT) AS r", "CAST(p % 8 AS INT) AS c", f"{gray} AS v")


def mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64x64 gray frames, an embedding being one image row; the last frame may be shorter."""
    gray = "CAST(floor(least(greatest((CAST(e AS DOUBLE) + 6e-1) / 12e-1, 0e0), 1e0) * 255) AS INT)"
    cells = load(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "e"))
    return cells.selectExpr("vec_id DIV 64 AS frame_id", "CAST(vec_id % 64 AS INT) AS r", "p AS c", f"{gray} AS v")


def packed_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames of ``mosaic``, one row each with the bytes of the image."""
    rows = packed_frames(spark, sf_dir).selectExpr("frame_id DIV 64 AS frame_id", "frame_id % 64 AS r", "data AS line")
    lines = rows.groupBy("frame_id").agg(F.sort_array(F.collect_list(F.struct("r", "line"))).alias("l"))  # at most 64 lines
    data = F.aggregate("l", F.lit(b""), lambda a, x: F.concat(a, x["line"]))
    return lines.select("frame_id", F.size("l").alias("height"), F.lit(64).alias("width"), F.lit(1).alias("n_channels"), data.alias("data"))


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).selectExpr("frame_id", "r", "c", "v AS blue", "(v * 7 + 13) % 256 AS green", "(v * 3 + 29) % 256 AS red")


def packed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same gray frames, one row each with the bytes of the image."""
    gray = "transform(embedding, e -> CAST(floor(least(greatest((CAST(e AS DOUBLE) + 6e-1) / 12e-1, 0e0), 1e0) * 255) AS INT))"
    return load(spark, sf_dir, "embeddings").selectExpr(
        "vec_id AS frame_id", "8 AS height", "8 AS width", "1 AS n_channels",
        f"unhex(array_join(transform({gray}, x -> lpad(hex(x), 2, '0')), '')) AS data",
    )


def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy recorded sweeps, one per user, in time order."""
    return sweep_with_length(spark, sf_dir).drop("n")


def sweep_with_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sweep`` with ``n``, the steps of each."""
    events = load(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    seen = ordered.dense_index(ordered.time_sliced(events, "ts"), ["user_id"], ["ts", "event_id"], length="n")
    return seen.selectExpr("user_id AS sweep_id", "i", "i * 3e-3 AS z_mm", "value AS metric", "n")


def focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean focus curves with a known centre: one per customer, one step per order."""
    return focus_with_length(spark, sf_dir).drop("n")


def focus_with_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``focus`` with ``n``, the steps of each curve."""
    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    days = ordered.time_slice(orders, "o_orderdate", 365 * ordered.DAY)
    steps = ordered.dense_index(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], days, length="n")
    steps = steps.selectExpr("o_custkey AS sweep_id", "i", "i * 2e-2 AS z_mm", "1e-1 + (o_custkey % 20) * 1e-2 AS z_true", "n")
    return steps.selectExpr("sweep_id", "i", "z_mm", "z_true", "100 + 5000 * exp(-power((z_mm - z_true) / 5e-2, 2)) AS metric", "n")


def edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outward intensity traces in four directions."""
    return sweep(spark, sf_dir).selectExpr(
        "CAST(floor(sweep_id / 4e0) AS BIGINT) AS scan_id",
        "CASE sweep_id % 4 WHEN 0 THEN 'x_positive' WHEN 1 THEN 'x_negative' WHEN 2 THEN 'y_positive' ELSE 'y_negative' END AS dir",
        "i", "CASE WHEN sweep_id % 2 = 0 THEN 1e-1 ELSE -1e-1 END AS step_mm",
        "i * CASE WHEN sweep_id % 2 = 0 THEN 1e-1 ELSE -1e-1 END AS pos_mm", "metric AS intensity",
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey AS map_id", "l_orderkey * 10 + l_linenumber AS seq", "l_quantity AS x", "l_discount * 100 AS y",
        "l_extendedprice / 1000 AS z", "l_tax * 100 + 1 AS metric",
    )


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mark centres in reading order; the line number repeats in some frames, so the place breaks ties."""
    return load(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS frame_id", "l_linenumber AS id", "CAST(l_partkey % 640 AS INT) AS x", "CAST((l_suppkey * 37) % 480 AS INT) AS y"
    )


_SQUARE = "(frame_id % 3 = 0 AND ((abs(r - 9 - frame_id % 5) <= 2 AND abs(c - 12 - frame_id % 7) <= 2) OR (abs(r - 28) <= 2 AND abs(c - 45) <= 2)))"
_CROSS = "((abs(r - 20) <= 1 AND abs(c - 24 - frame_id % 9) <= 10) OR (abs(c - 24 - frame_id % 9) <= 1 AND abs(r - 20) <= 10))"
_DARK = "CAST(floor(v / 8e0) AS INT)"
#: Colours of the mark frames: squares bright in all channels, crosses bright or dark in blue and green alone, over noise.
_INDEX = f"""frame_id, r, c, CASE WHEN {_SQUARE} THEN 200 WHEN frame_id % 3 = 0 THEN 120 WHEN {_CROSS} THEN CASE WHEN frame_id % 3 = 1 THEN 250 ELSE {_DARK} END
  WHEN frame_id % 3 = 1 THEN {_DARK} ELSE 220 + {_DARK} END AS blue,
CASE WHEN {_SQUARE} THEN 240 WHEN frame_id % 3 = 0 THEN {_DARK} WHEN {_CROSS} THEN CASE WHEN frame_id % 3 = 1 THEN 250 ELSE {_DARK} END
  WHEN frame_id % 3 = 1 THEN {_DARK} ELSE 220 + {_DARK} END AS green,
CASE WHEN {_SQUARE} THEN 250 WHEN frame_id % 3 = 0 THEN {_DARK} ELSE v END AS red"""


def index_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40x64 colour frames with index marks over noise, an embedding being one image row: squares, bright crosses, dark crosses by turns."""
    gray = "CAST(floor(least(greatest((CAST(e AS DOUBLE) + 6e-1) / 12e-1, 0e0), 1e0) * 255) AS INT)"
    cells = load(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "e"))
    cells = cells.selectExpr("vec_id DIV 40 AS frame_id", "CAST(vec_id % 40 AS INT) AS r", "p AS c", f"{gray} AS v")
    cells.createOrReplaceTempView("_index_cells")
    return spark.sql(f"SELECT {_INDEX} FROM _index_cells")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position replies, bad lines included: every event that is not a capture."""
    good = "concat(CAST(CAST(floor(value * 10) AS BIGINT) AS STRING), ',', CAST(event_id AS STRING), ',', CAST(user_id AS STRING))"
    return load(spark, sf_dir, "events").where("event_type <> 'purchase'").selectExpr(
        "event_id", "user_id AS instrument_id", "ts", f"CASE WHEN event_type = 'error' THEN 'ERR' ELSE {good} END AS line"
    )


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").where("event_type = 'purchase'").selectExpr(
        "event_id AS capture_id", "user_id AS instrument_id", "ts", "value"
    )


def scan_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = "format_string('img_X%+.3f_Y%+.3f.png', (o_orderkey % 200 - 100) * 5e-1, (o_custkey % 100 - 50) * 25e-2)"
    return load(spark, sf_dir, "orders").selectExpr("o_custkey % 20 AS scan_id", "o_orderkey AS seq", "o_orderdate AS ts", f"{name} AS filename")


def mags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id", "CASE WHEN p_partkey % 11 = 0 THEN 'unknown' ELSE concat(CAST(p_size AS STRING), 'x ') END AS mag_text",
        "CAST(p_size AS DOUBLE) AS mag",
    )


def digit_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").selectExpr("doc_id", "text AS raw")


CTE = {
    "fx_frames": """SELECT vec_id AS frame_id, CAST(p // 8 AS INT) AS r, CAST(p % 8 AS INT) AS c,
       CAST(floor(least(greatest((CAST(e AS DOUBLE) + 6e-1) / 12e-1, 0e0), 1e0) * 255) AS INT) AS v
FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings)""",
    "fx_mosaic": """SELECT vec_id // 64 AS frame_id, CAST(vec_id % 64 AS INT) AS r, CAST(p AS INT) AS c,
       CAST(floor(least(greatest((CAST(e AS DOUBLE) + 6e-1) / 12e-1, 0e0), 1e0) * 255) AS INT) AS v
FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings)""",
    "fx_index": f"""SELECT {_INDEX} FROM (SELECT vec_id // 40 AS frame_id, CAST(vec_id % 40 AS INT) AS r, CAST(p AS INT) AS c,
       CAST(floor(least(greatest((CAST(e AS DOUBLE) + 6e-1) / 12e-1, 0e0), 1e0) * 255) AS INT) AS v
FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings))""",
    "fx_rgb": "SELECT frame_id, r, c, v AS blue, (v * 7 + 13) % 256 AS green, (v * 3 + 29) % 256 AS red FROM fx_frames",
    "fx_sweep": """SELECT user_id AS sweep_id, i, i * 3e-3 AS z_mm, value AS metric
FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)""",
    "fx_gappy": """SELECT sweep_id, row_number() OVER (PARTITION BY sweep_id ORDER BY i) - 1 AS i, z_mm, metric FROM fx_sweep WHERE i % 29 <> 13""",
    "fx_focus": """SELECT *, 100 + 5000 * exp(-power((z_mm - z_true) / 5e-2, 2)) AS metric
FROM (SELECT o_custkey AS sweep_id, i, i * 2e-2 AS z_mm, 1e-1 + (o_custkey % 20) * 1e-2 AS z_true
      FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i FROM orders))""",
    "fx_edge": """SELECT CAST(floor(sweep_id / 4e0) AS BIGINT) AS scan_id,
       CASE sweep_id % 4 WHEN 0 THEN 'x_positive' WHEN 1 THEN 'x_negative' WHEN 2 THEN 'y_positive' ELSE 'y_negative' END AS dir,
       i, CASE WHEN sweep_id % 2 = 0 THEN 1e-1 ELSE -1e-1 END AS step_mm,
       i * CASE WHEN sweep_id % 2 = 0 THEN 1e-1 ELSE -1e-1 END AS pos_mm, metric AS intensity
FROM fx_sweep""",
    "fx_points": """SELECT l_suppkey AS map_id, l_orderkey * 10 + l_linenumber AS seq, l_quantity AS x, l_discount * 100 AS y,
       l_extendedprice / 1000 AS z, l_tax * 100 + 1 AS metric FROM lineitem""",
    "fx_marks": """SELECT l_orderkey AS frame_id, l_linenumber AS id, CAST(l_partkey % 640 AS INT) AS x, CAST((l_suppkey * 37) % 480 AS INT) AS y
FROM lineitem""",
    "fx_telemetry": """SELECT event_id, user_id AS instrument_id, ts,
       CASE WHEN event_type = 'error' THEN 'ERR' ELSE concat(CAST(CAST(floor(value * 10) AS BIGINT) AS STRING), ',',
            CAST(event_id AS STRING), ',', CAST(user_id AS STRING)) END AS line
FROM events WHERE event_type <> 'purchase'""",
    "fx_captures": "SELECT event_id AS capture_id, user_id AS instrument_id, ts, value FROM events WHERE event_type = 'purchase'",
    "fx_scan_points": """SELECT o_custkey % 20 AS scan_id, o_orderkey AS seq, o_orderdate AS ts,
       printf('img_X%+.3f_Y%+.3f.png', (o_orderkey % 200 - 100) * 5e-1, (o_custkey % 100 - 50) * 25e-2) AS filename FROM orders""",
    "fx_mags": """SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN 'unknown' ELSE concat(CAST(p_size AS STRING), 'x ') END AS mag_text,
       CAST(p_size AS DOUBLE) AS mag FROM part""",
    "fx_digit_text": "SELECT doc_id, text AS raw FROM documents",
    "fx_objectives": """SELECT * FROM (VALUES ('5x', 1015e-3, 200, 3500, 40), ('10x', 203e-2, 100, 7000, 20), ('20x', 406e-2, 50, 13000, 10),
  ('50x', 1015e-2, 20, 30000, 4), ('100x', 203e-1, 5, 60000, 2)) AS t(mag, ppm, bar_um, exposure_us, z_jog_um)""",
    "fx_axis": """SELECT * FROM (VALUES ('X', 1e-3, -1, -1275e-1, 1275e-1), ('Y', 1e-3, 1, -1075e-1, 1075e-1), ('Z', 25e-6, -1, 0e0, 25e0))
  AS t(axis, step, invert, min_mm, max_mm)""",
    "fx_af_builtin": """SELECT * FROM (VALUES (1, 5e0, 1e-2, 4, 25e-2), (2, 10e0, 3e-3, 6, 2e-1), (3, 20e0, 1e-3, 10, 1e-1),
  (4, 40e0, 1e-3, 10, 1e-1), (5, 100e0, 1e-3, 10, 1e-1)) AS t(ord, mag, step_mm, coarse_factor, fine_factor)""",
    "fx_layers": """SELECT * FROM (VALUES ('Monolayer', 120, 100, 90), ('Bilayer', 160, 140, 130), ('Trilayer', 60, 220, 200))
  AS t(layer, red, green, blue)""",
}

_NEEDS = {"fx_rgb": ["fx_frames"], "fx_gappy": ["fx_sweep"], "fx_edge": ["fx_sweep"]}


def sql(body: str, *names: str, recursive: bool = False, extra: str = "") -> str:
    """``body`` behind the common table expressions it names (and those they need)."""
    wanted: list[str] = []
    for name in names:
        for table in [*_NEEDS.get(name, []), name]:
            if table not in wanted:
                wanted.append(table)
    parts = [f"{name} AS ({CTE[name]})" for name in wanted]
    if extra:
        parts.append(extra)
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {body}"
