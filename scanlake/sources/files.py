"""Readers and writers of scan folders and of the JSON, CSV and text files that go with them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlake.functions import naming
from scanlake.operators import ordered

# Points of one focus-map document; larger maps are written as several documents that read back as one map.
DOCUMENT_POINTS = 100_000
# Fixed value: a position file holds ten slots.
SLOTS = 10

SWEEP_LOG = "timestamp string, result string, params map<string,string>, z_list array<double>, m_list array<double>, z_best double, m_best double"
FOCUS_MAP = (
    "map_id string, z_ref double, degree int, points array<struct<x:double,y:double,z_offset:double,metric:double>>, "
    "skipped array<struct<x:double,y:double>>"
)
POSITION = "struct<Name:string,Locked:boolean,X:bigint,Y:bigint,Z:bigint,Mag:string>"


def read_scan(spark: SparkSession, path: str) -> DataFrame:
    """Images of scan folders with the stage place from their names; ``data`` is in blue, green, red order, 8 bit."""
    images = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    return scan_rows(images.withColumnRenamed("nChannels", "n_channels"))


def scan_rows(images: DataFrame) -> DataFrame:
    """Frames of ``images`` (origin, height, width, n_channels, data) with what their paths say.

    ``scan_id`` is the whole path of the scan folder, since two instruments can start in one second; ``scan`` is its bare name. Both
    are null outside a scan folder.
    """
    x, y = naming.parse_filename(F.col("origin"))
    folder = F.regexp_extract("origin", "^(.*/)?(wafer_scan_[0-9]{8}_[0-9]{6})/", 0)
    name = F.regexp_extract("origin", "(?:^|/)(wafer_scan_[0-9]{8}_[0-9]{6})/", 1)
    return images.select(
        F.col("origin").alias("frame_id"), F.nullif(F.rtrim(folder, F.lit("/")), F.lit("")).alias("scan_id"), F.nullif(name, F.lit("")).alias("scan"),
        x.alias("x"), y.alias("y"), "height", "width", "n_channels", "data",
    )


def write_scan_manifest(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Append captured points (scan_id, x, y, filename, ts) to a manifest partitioned by scan."""
    rows.write.mode(mode).partitionBy("scan_id").parquet(path)


def read_scan_manifest(spark: SparkSession, path: str, scan_type: str = "bigint") -> DataFrame:
    out = spark.read.parquet(path)
    return out.withColumn("scan_id", F.col("scan_id").cast(scan_type))


def upsert_manifest(rows: DataFrame, path: str, version: int) -> None:
    """Add points (scan_id, seq, ...) to a manifest as one version; writing a version again replaces it, so a batch may run twice.

    Fits ``foreachBatch`` with its batch number as ``version``. Each version is a folder of its own, partitioned by scan.
    """
    newest = rows.withColumn("_tie", F.xxhash64(*rows.columns)).groupBy("scan_id", "seq")
    rows = newest.agg(F.max_by(F.struct(*rows.columns), "_tie").alias("row")).select("row.*")
    rows.write.mode("overwrite").partitionBy("scan_id").parquet(f"{path}/version={version:012d}")


def read_newest(spark: SparkSession, path: str, scan_type: str = "bigint") -> DataFrame:
    """The newest version of each (scan_id, seq) of a manifest written by ``upsert_manifest``."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/version=*").withColumn("scan_id", F.col("scan_id").cast(scan_type))
    columns = [c for c in rows.columns if c != "version"]
    newest = rows.groupBy("scan_id", "seq").agg(F.max_by(F.struct(*columns), F.col("version").cast("long")).alias("row"))
    return newest.select("row.*")


def compact_manifest(spark: SparkSession, path: str, target: str, scan_type: str = "bigint") -> None:
    """Write the newest versions as the one version 0 of a new manifest at ``target``; readers of the old one are not disturbed."""
    read_newest(spark, path, scan_type).write.mode("overwrite").partitionBy("scan_id").parquet(f"{target}/version={0:012d}")


def read_sweep_logs(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Sweep logs as steps: sweep_id, file, result, i, z_mm, metric, z_best, m_best.

    ``sweep_id`` is the log's own ``sweep_id`` parameter or else the path of its file; ``file`` is the bare file name.
    """
    logs = spark.read.schema(SWEEP_LOG).option("multiLine", multi_line).json(path)
    own = F.coalesce(F.col("params")["sweep_id"], F.col("_metadata.file_path"))
    first = F.coalesce(F.col("params")["first_i"].cast("long"), F.lit(0))
    logs = logs.select(own.alias("sweep_id"), F.col("_metadata.file_name").alias("file"), first.alias("_first"), "timestamp", "result", "z_best", "m_best", F.arrays_zip("z_list", "m_list").alias("_steps"))
    steps = logs.select("*", F.posexplode("_steps").alias("_k", "_step"))
    return steps.select(
        "sweep_id", "file", "timestamp", "result", (F.col("_first") + F.col("_k")).alias("i"), F.col("_step.z_list").alias("z_mm"), F.col("_step.m_list").alias("metric"),
        "z_best", "m_best",
    )


def read_focus_maps(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """Measured points (map_id, degree, x, y, z, metric) and skipped points (map_id, x, y) of saved focus maps.

    ``map_id`` is the document's own or else the path of its file.
    """
    maps = spark.read.schema(FOCUS_MAP).option("multiLine", multi_line).json(path)
    name = F.coalesce("map_id", F.col("_metadata.file_path")).alias("map_id")
    maps = maps.select(name, "z_ref", F.coalesce("degree", F.lit(2)).alias("degree"), "points", "skipped")
    points = maps.select("map_id", "z_ref", "degree", F.explode("points").alias("p"))
    points = points.select("map_id", "degree", F.col("p.x").alias("x"), F.col("p.y").alias("y"), (F.col("z_ref") + F.col("p.z_offset")).alias("z"), F.col("p.metric").alias("metric"))
    skipped = maps.select("map_id", F.explode("skipped").alias("p")).select("map_id", "p.x", "p.y")
    return points, skipped


def write_focus_maps(points: DataFrame, models: DataFrame, skipped: DataFrame, path: str, mode: str = "overwrite", limit: int = DOCUMENT_POINTS) -> None:
    """Write maps as JSON documents, heights as offsets from the model's z_ref, or from the mean of the points where there is no model.

    ``points`` and ``skipped`` carry a ``seq``. A document takes one range of ``limit`` seq values, so no task gathers a whole map.
    """
    part = ordered.index_slice(F.col("seq"), limit).alias("_part")
    none = F.lit(None).cast("struct<x:double,y:double,z_offset:double,metric:double>")
    gone = F.lit(None).cast("struct<x:double,y:double>")
    known = models.select("map_id", F.col("z_ref").alias("_z"), F.col("degree").alias("_degree"))
    means = points.groupBy("map_id").agg(F.avg("z").alias("_mean"))
    every = means.join(skipped.select("map_id").distinct(), "map_id", "full").join(known, "map_id", "left")
    models = every.select("map_id", F.coalesce("_z", "_mean").alias("z_ref"), F.coalesce("_degree", F.lit(2)).alias("degree"))
    kept = points.join(models, "map_id")
    kept = kept.select("map_id", part, "seq", "z_ref", "degree", F.struct("x", "y", (F.col("z") - F.col("z_ref")).alias("z_offset"), "metric").alias("p"), gone.alias("s"))
    left_out = skipped.join(models, "map_id")
    left_out = left_out.select("map_id", part, "seq", "z_ref", "degree", none.alias("p"), F.struct("x", "y").alias("s"))
    rows = kept.unionByName(left_out).groupBy("map_id", "_part", "z_ref", "degree").agg(
        F.sort_array(F.collect_list(F.when(F.col("p").isNotNull(), F.struct("seq", "p")))).alias("_p"),
        F.sort_array(F.collect_list(F.when(F.col("s").isNotNull(), F.struct("seq", "s")))).alias("_s"),
    )
    out = rows.select(
        F.col("map_id").cast("string").alias("map_id"), "z_ref", "degree", F.transform("_p", lambda e: e["p"]).alias("points"), F.transform("_s", lambda e: e["s"]).alias("skipped")
    )
    out.write.mode(mode).json(path)


def write_sweep_logs(sweep: DataFrame, path: str, mode: str = "overwrite", limit: int = DOCUMENT_POINTS) -> None:
    """Write recorded sweeps as log documents of at most ``limit`` steps, z to 6 and metrics to 4 digits."""
    rows = sweep.withColumn("_part", ordered.index_slice(F.col("i"), limit))
    rows = rows.groupBy("sweep_id", "_part").agg(F.sort_array(F.collect_list(F.struct("i", F.bround("z_mm", 6).alias("z"), F.bround("metric", 4).alias("m")))).alias("_s"))
    params = F.create_map(F.lit("sweep_id"), F.col("sweep_id").cast("string"), F.lit("first_i"), F.get("_s", F.lit(0))["i"].cast("string"))
    out = rows.select(
        F.lit("finished").alias("result"), params.alias("params"), F.transform("_s", lambda e: e["z"]).alias("z_list"), F.transform("_s", lambda e: e["m"]).alias("m_list")
    )
    out.write.mode(mode).json(path)


def parse_intensity(lines: DataFrame, line: str = "value") -> DataFrame:
    """Rows of an intensity log: six leading numbers, then as many blue, green, red triples as follow.

    ``rest`` has the values after the last whole triple. A line whose first field is no number is ``malformed`` and keeps its text in
    ``line``; only header lines are left out.
    """
    names = ("time", "stage_x", "stage_y", "stage_z", "mean_intensity", "centre_intensity")
    rest_columns = [c for c in lines.columns if c != line]
    # columns of their own: as expressions the split and the numbers would be made again for each value of a line
    rows = lines.where(~F.col(line).startswith("time,stage_x,")).withColumn("_parts", F.split(line, ","))
    rest = F.when(F.size("_parts") > 6, F.slice("_parts", F.lit(7), F.size("_parts"))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("_rest", rest).withColumn("_values", F.transform("_rest", lambda v: v.try_cast("int")))
    head = [F.get("_parts", F.lit(k)).try_cast("double").alias(name) for k, name in enumerate(names)]
    count = F.floor(F.size("_values") / 3).cast("int")
    pixels = F.when(
        count > 0,
        F.transform(
            F.sequence(F.lit(0), count - 1),
            lambda k: F.struct(*[F.get("_values", k * 3 + j).alias(c) for j, c in enumerate("bgr")]),
        ),
    ).otherwise(F.array().cast("array<struct<b:int,g:int,r:int>>"))
    left = F.slice("_rest", count * 3 + 1, F.greatest(F.size("_rest") - count * 3, F.lit(0)))
    bad = F.get("_parts", F.lit(0)).try_cast("double").isNull()
    return rows.select(*rest_columns, *head, pixels.alias("pixels"), left.alias("rest"), bad.alias("malformed"), F.when(bad, F.col(line)).alias("line"))


def read_intensity_csv(spark: SparkSession, path: str) -> DataFrame:
    """Intensity logs; read as text, because rows are longer than their header. The header line is dropped."""
    return parse_intensity(spark.read.text(path))


def read_presets(spark: SparkSession, path: str, value_type: str, section: str | None = None) -> DataFrame:
    """Dictionary files as rows (file, key, value), ``file`` being the path; names starting with _ and entries of another shape are skipped."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return explode_presets(text, "value", value_type, section)


def explode_presets(rows: DataFrame, text: str, value_type: str, section: str | None = None) -> DataFrame:
    """Entries of a dictionary in a text column, each parsed as ``value_type``."""
    whole = F.from_json(text, "map<string,string>")
    if section is not None:
        whole = F.from_json(whole[section], "map<string,string>")
    rest = [c for c in rows.columns if c != text]
    entries = rows.select(*rest, F.explode(whole).alias("key", "_raw")).where(~F.col("key").startswith("_"))
    if value_type.startswith(("struct", "map", "array")):
        value = F.from_json("_raw", value_type)
        entries = entries.where(F.col("_raw").startswith("{") | F.col("_raw").startswith("["))
    else:
        value = F.col("_raw").try_cast(value_type)
    return entries.select(*rest, "key", value.alias("value")).where(F.col("value").isNotNull())


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """Saved stage positions: exactly ten slots per file, ``file`` being its path."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return explode_positions(text, "value")


def explode_positions(rows: DataFrame, text: str) -> DataFrame:
    """First ten positions of a list in a text column, padded with empty ones to ten; ``n_given`` tells how many the list has.

    The lists are short, so no shuffle.
    """
    given = F.coalesce(F.from_json(text, f"array<{POSITION}>"), F.array().cast(f"array<{POSITION}>"))
    rest = [c for c in rows.columns if c != text]

    def slot(k: Column) -> Column:
        p = F.get(F.col("_given"), k)
        return F.struct(
            (k + 1).alias("slot"), F.coalesce(p["Name"], F.concat(F.lit("Pos "), (k + 1).cast("string"))).alias("name"), F.coalesce(p["Locked"], F.lit(False)).alias("locked"),
            *[F.coalesce(p[a], F.lit(0)).alias(a.lower()) for a in "XYZ"], p["Mag"].alias("mag"),
        )

    slots = F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), slot)
    return rows.withColumn("_given", given).select(*rest, F.size("_given").alias("n_given"), F.inline(slots))


def write_positions(positions: DataFrame, path: str, keys: Sequence[str] = ("file",), mode: str = "overwrite") -> None:
    """Write positions as one JSON list per key, thumbnails left out. All slots are written, also those that a reader of ten slots will not show."""
    entry = F.struct(
        "slot", F.col("name").alias("Name"), F.col("locked").alias("Locked"), F.col("x").alias("X"), F.col("y").alias("Y"), F.col("z").alias("Z"), F.col("mag").alias("Mag")
    )
    lists = positions.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("_p"))
    bare = F.transform("_p", lambda p: p.dropFields("slot"))
    # the key names a folder, so a path in it is escaped by Spark
    lists.select(*keys, F.to_json(bare).alias("value")).write.mode(mode).partitionBy(*keys).text(path)
