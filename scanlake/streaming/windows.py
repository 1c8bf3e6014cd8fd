"""Streaming twins that Spark's own aggregations express, and a sink for finite runs.

Times are event times in column ``ts``. Rows later than the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanlake.session import STATE_STORE, shared_path

WATERMARK = "10 seconds"


def read_stream(spark: SparkSession, path: str, schema: T.StructType | str, glob: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """A stream over the parquet files of a folder."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def with_event_time(stream: DataFrame, ts: str = "ts", delay: str = WATERMARK) -> DataFrame:
    """Zoned event time with a watermark (zone-free timestamps cannot carry one)."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def stream_frame_rate(stream: DataFrame, key: str = "instrument_id", seconds: int = 1) -> DataFrame:
    """Frames per second in tumbling windows."""
    counts = stream.groupBy(key, F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("frames"))
    start = F.unix_seconds(F.col("w.start")).alias("window_start")
    return counts.select(key, start, "frames", (F.col("frames") / float(seconds)).alias("fps"))


def latest_frame(stream: DataFrame, key: str = "instrument_id", order: Sequence[str] = ("ts",), fields: Sequence[str] = ("frame_id",)) -> DataFrame:
    """Newest frame of each camera; older ones are replaced. Use output mode ``update``."""
    newest = F.max(F.struct(*order, *fields)).alias("top")
    return stream.groupBy(key).agg(newest).select(key, "top.*")


def stream_progress(stream: DataFrame, totals: DataFrame, key: str = "scan_id") -> DataFrame:
    """Captured points of each scan against its plan, updated as they arrive. Use output mode ``update``."""
    counts = stream.groupBy(key).agg(F.count(F.lit(1)).alias("captured")).join(totals.select(key, "total"), key)
    pct = (F.lit(10) + F.floor(F.col("captured") / F.col("total") * 85)).cast("int")
    return counts.select(key, "captured", "total", pct.alias("pct"))


def run_available(stream: DataFrame, mode: str = "append", keys: Sequence[str] = ()) -> DataFrame:
    """Run a stream over all data there is and return what it wrote to the shared folder.

    In ``update`` mode the last version of each key is returned. A batch that is run again after a failure replaces its own output.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    root = shared_path(spark, "stream")
    out = f"{root}/out"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").start(out)
    else:
        def write(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch-{batch_id}")

        query = writer.foreachBatch(write).start()
    query.awaitTermination()
    schema = stream.schema
    if mode == "append":
        return spark.read.schema(schema).parquet(out)
    # the batch number is part of the path and orders the versions of a key
    version = F.regexp_extract(F.col("_metadata.file_path"), "/batch-([0-9]+)/", 1).cast("long")
    found = spark.read.schema(schema).parquet(f"{out}/*").withColumn("_version", version)
    rest = [c for c in schema.names if c not in keys]
    last = found.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_version").alias("row"))
    return last.select(*keys, "row.*").select(*schema.names)
