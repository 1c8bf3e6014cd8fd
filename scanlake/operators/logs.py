"""Instrument logs: bad readings, thinning, button edges, progress and rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanlake.operators import ordered
from scanlake.session import cut_lineage

# Fixed value: readings are refreshed on every tenth tick.
REFRESH_EVERY = 10


def parse_position_reply(lines: DataFrame, line: str = "line") -> DataFrame:
    """Add x, y, z counts of a position reply, all null unless its first three parts are whole numbers."""
    x, y, z = (F.split_part(F.col(line), F.lit(","), F.lit(k)).try_cast("long") for k in (1, 2, 3))
    good = x.isNotNull() & y.isNotNull() & z.isNotNull()
    return lines.select("*", *[F.when(good, n).alias(axis) for n, axis in zip((x, y, z), "xyz")])


def forward_fill(rows: DataFrame, fields: Sequence[str], key: str = "instrument_id", order: Sequence[str] = ("ts", "event_id"), start: object = 0, seconds: float = ordered.DAY) -> DataFrame:
    """Replace missing readings by the last good one of the instrument, ``start`` before the first."""
    sliced = ordered.time_sliced(rows, order[0], seconds)
    filled = ordered.running(sliced, [key], list(order), **{f"_fill_{f}": ("last", F.col(f)) for f in fields})
    value = {f: F.coalesce(F.col(f"_fill_{f}"), F.lit(start)).alias(f) for f in fields}
    return filled.select(*[value.get(c, F.col(c)) for c in rows.columns])


def every_nth(rows: DataFrame, n: int = REFRESH_EVERY, key: str = "instrument_id", order: Sequence[str] = ("ts", "event_id"), remainder: int = 1, seconds: float = ordered.DAY) -> DataFrame:
    """Rows whose number within their key, counted from 1, leaves ``remainder`` when divided by ``n``."""
    numbered = ordered.dense_index(ordered.time_sliced(rows, order[0], seconds), [key], list(order), name="_tick")
    return numbered.where(F.pmod(F.col("_tick") + 1, F.lit(n)) == remainder % n).drop("_tick")


def rising_edges(rows: DataFrame, active: Column, continuous: Column | None = None, key: str = "instrument_id", order: Sequence[str] = ("ts", "event_id"), seconds: float = ordered.DAY) -> DataFrame:
    """Rows that fire: active now and not on the row before, or active at all while ``continuous`` holds."""
    held = F.lit(False) if continuous is None else continuous
    sliced = ordered.time_sliced(rows.withColumn("_active", active).withColumn("_held", held), order[0], seconds)
    seen = ordered.previous(sliced, [key], list(order), _before=F.col("_active"))
    fires = F.col("_active") & (F.col("_held") | ~F.coalesce(F.col("_before"), F.lit(False)))
    return seen.where(fires).select(*rows.columns)


def scan_eta(points: DataFrame, totals: DataFrame, key: str = "scan_id", order: Sequence[str] = ("ts", "seq"), seconds: float = ordered.DAY) -> DataFrame:
    """Add captured, elapsed_s, remaining_s and pct to every captured point.

    ``totals`` holds the planned points per scan (total) and may hold its start time (started); without one the first
    capture starts the clock. ``remaining_s`` is null while no time has passed.
    """
    sliced = ordered.time_sliced(points, order[0], seconds)
    seen = ordered.running(sliced, [key], list(order), captured=("count", F.lit(1)), _first=("min", F.col(order[0])))
    seen = seen.join(totals, key)
    start = F.col("started") if "started" in totals.columns else F.col("_first")
    elapsed = (F.unix_micros(F.col(order[0]).cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6
    seen = seen.withColumn("elapsed_s", elapsed)
    remaining = F.when((F.col("elapsed_s") > 0) & (F.col("total") > 0), (F.col("total") - F.col("captured")) / (F.col("captured") / F.col("elapsed_s")))
    pct = (F.lit(10) + F.floor(F.col("captured") / F.col("total") * 85)).cast("int")
    return seen.select(*points.columns, "captured", "elapsed_s", remaining.alias("remaining_s"), pct.alias("pct"))


def frame_rate(rows: DataFrame, key: str = "instrument_id", ts: str = "ts", seconds: int = 1) -> DataFrame:
    """Frames per second in fixed windows of ``seconds``."""
    t = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / F.lit(seconds)) * seconds
    counts = rows.groupBy(key, t.alias("window_start")).agg(F.count(F.lit(1)).alias("frames"))
    return counts.select(key, "window_start", "frames", (F.col("frames") / float(seconds)).alias("fps"))


def frame_ticks(rows: DataFrame, key: str = "instrument_id", ts: str = "ts", order: str = "frame_id", seconds: float = 1.0) -> DataFrame:
    """Frame rates as a clock gives them that starts anew at each report: a report comes with the first frame that is ``seconds`` or
    more behind the last one, and counts the frames since then. Frames that share a time come in ``order``.

    Each frame points to the one that would report next if it had reported; the reports are what the first frame leads to. They are
    found by doubling the steps, so a chain of n reports takes log2(n) rounds over all instruments at once, each stored. Frames are
    numbered and looked up by slices of time, so a busy instrument is spread over tasks.
    """
    step = round(seconds * 1_000_000)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    frames = rows.select(key, us.alias("us"), F.col(order).alias("frame"))
    part = F.floor(F.col("us") / step).cast("long")
    numbered = cut_lineage(ordered.dense_index(frames, [key], ["us", "frame"], part, "n").withColumn("part", part))
    # slices are as wide as a step: what is a step later lies in the next slice, or else is the first frame of a slice behind that
    heads = numbered.groupBy(key, "part").agg(F.min("n").alias("head"))
    by_part = Window.partitionBy(key).orderBy("part")
    second = F.when(F.lead("part").over(by_part) > F.col("part") + 1, F.lead("head").over(by_part)).otherwise(F.lead("head", 2).over(by_part))
    heads = heads.select(key, "part", second.alias("_far"))
    copies = numbered.withColumn("_copy", F.lit(False)).unionByName(numbered.withColumns({"part": F.col("part") - 1, "_copy": F.lit(True)}))
    behind = Window.partitionBy(key, "part").orderBy("us").rangeBetween(step, Window.unboundedFollowing)
    near = copies.withColumn("_near", F.min("n").over(behind)).where("NOT _copy")
    jump = cut_lineage(near.join(heads, [key, "part"]).select(key, "n", "us", F.coalesce("_near", "_far").alias("next")))
    marked, steps = cut_lineage(jump.where("n = 0").select(key, "n")), jump.where("next IS NOT NULL").select(key, "n", "next")
    while not steps.isEmpty():
        reached = marked.join(steps, [key, "n"]).select(key, F.col("next").alias("n"))
        marked = cut_lineage(marked.unionByName(reached))
        onward = steps.select(key, F.col("n").alias("next"), F.col("next").alias("_next"))
        steps = cut_lineage(steps.join(onward, [key, "next"]).select(key, "n", F.col("_next").alias("next")))
    ticks = marked.join(jump.select(key, "n", "us"), [key, "n"]).withColumn(ordered.SLICE, ordered.index_slice(F.col("n")))
    ticks = ordered.previous(ticks, [key], ["n"], n_before=F.col("n"), us_before=F.col("us")).where("n_before IS NOT NULL")
    frames_, elapsed = F.col("n") - F.col("n_before"), (F.col("us") - F.col("us_before")) / 1e6
    return ticks.select(key, F.col("us").alias("tick_us"), frames_.alias("frames"), (frames_ / elapsed).alias("fps"))


def scan_summary(points: DataFrame, key: str = "scan_id") -> DataFrame:
    """Captured, skipped and total points per scan and its outcome.

    ``points`` carries status (captured or skipped) and may carry flags stopped and error.
    """
    def any_of(flag: str) -> Column:
        return F.max(F.col(flag)) if flag in points.columns else F.max(F.lit(False))

    out = points.groupBy(key).agg(
        F.count_if(F.col("status") == "captured").alias("captured"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count(F.lit(1)).alias("total"),
        any_of("stopped").alias("_stopped"), any_of("error").alias("_error"),
    )
    status = F.when(F.col("_error"), "error").when(F.col("_stopped"), "stopped").otherwise("success")
    return out.select(key, "captured", "skipped", "total", status.alias("status"))
