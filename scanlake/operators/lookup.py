"""Look-ups, defaults and upserts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlake.operators import ordered


def with_calibration(df: DataFrame, dim: DataFrame, key: str = "mag", defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Add the columns of a look-up table by key; unknown keys get the defaults, or null.

    No broadcast is forced: Spark broadcasts the table while its size is below the session's threshold.
    """
    out = df.join(dim, key, "left")
    return out.fillna(dict(defaults)) if defaults else out


def _literal(row: Mapping[str, object]) -> Column:
    return F.struct(*[F.lit(value).alias(name) for name, value in row.items()])


def nearest_defaults(df: DataFrame, builtin: Sequence[Mapping[str, object]], user: DataFrame | None = None, fields: Sequence[str] = (), mag: str = "mag") -> DataFrame:
    """Settings for a magnification: the user's row for exactly it, else the nearest built-in one.

    The built-in rows travel as an array literal, so nothing is joined for them; equal distances go to the first declared.
    """
    fields = list(fields) or [name for name in builtin[0] if name not in ("ord", "mag")]
    choices = F.array(*[_literal(row) for row in builtin])
    ranked = F.transform(choices, lambda e: F.struct(F.abs(e["mag"] - F.col(mag)).alias("gap"), e["ord"].alias("ord"), e.alias("row")))
    out = df.withColumn("_near", F.array_min(ranked)["row"])
    if user is None:
        return out.select(*df.columns, *[F.col(f"_near.{f}").alias(f) for f in fields], F.lit("built-in").alias("source"))
    own = user.select(F.col("mag").alias("_mag"), F.struct(*fields).alias("_own"))
    out = out.join(own, out[mag] == own["_mag"], "left")
    picked = [F.when(F.col("_own").isNotNull(), F.col(f"_own.{f}")).otherwise(F.col(f"_near.{f}")).alias(f) for f in fields]
    source = F.when(F.col("_own").isNotNull(), "user").otherwise("built-in").alias("source")
    return out.select(*df.columns, *picked, source)


def latest_position(captures: DataFrame, telemetry: DataFrame, fields: Sequence[str], key: str = "instrument_id", ts: str = "ts", seconds: float = ordered.DAY) -> DataFrame:
    """Each capture with the newest reading of its instrument at or before its time.

    Captures and readings are merged into one time line per instrument, cut into time slices.
    """
    payload = [c for c in captures.columns if c not in (key, ts)]
    reading = F.struct(*fields)
    kind = telemetry.select(reading.alias("x")).schema["x"].dataType.simpleString()
    event = captures.select(F.struct(*payload).alias("x")).schema["x"].dataType.simpleString()
    left = captures.select(key, ts, F.lit(1).alias("_late"), F.struct(*payload).alias("_capture"), F.lit(None).cast(kind).alias("_reading"))
    right = telemetry.select(key, ts, F.lit(0).alias("_late"), F.lit(None).cast(event).alias("_capture"), reading.alias("_reading"))
    line = left.unionByName(right)
    line = ordered.time_sliced(line, ts, seconds)
    seen = ordered.running(line, [key], [ts, "_late"], _latest=("last", F.col("_reading"))).where("_late = 1")
    return seen.select(key, ts, "_capture.*", *[F.col(f"_latest.{f}").alias(f) for f in fields])


def choose_focus(points: DataFrame, mapped: DataFrame, measured: DataFrame, on: Sequence[str]) -> DataFrame:
    """Focus height per point: map prediction, else autofocus result, else the current height.

    ``points`` carries z_now, ``mapped`` z_map and ``measured`` z_auto.
    """
    out = points.join(mapped.select(*on, "z_map"), list(on), "left").join(measured.select(*on, "z_auto"), list(on), "left")
    source = F.when(F.col("z_map").isNotNull(), "map").when(F.col("z_auto").isNotNull(), "autofocus").otherwise("current")
    return out.select(*points.columns, F.coalesce("z_map", "z_auto", "z_now").alias("z_mm"), source.alias("focus_source"))


def merge_defaults(base: DataFrame, override: DataFrame, key: str = "mag", keep: Sequence[str] = ("last_focus_z",)) -> DataFrame:
    """Rows of ``override`` replace those of ``base``; columns in ``keep`` survive when the override leaves them null."""
    fields = [c for c in base.columns if c != key]
    b = base.select(key, F.struct(*fields).alias("_base"))
    o = override.select(key, F.struct(*[F.col(f) if f in override.columns else F.lit(None).alias(f) for f in fields]).alias("_over"))
    joined = b.join(o, key, "full_outer")
    out = []
    for f in fields:
        over = F.col(f"_over.{f}")
        if f in keep:
            over = F.coalesce(over, F.col(f"_base.{f}"))
        out.append(F.when(F.col("_over").isNotNull(), over).otherwise(F.col(f"_base.{f}")).alias(f))
    return joined.select(key, *out)


def shift_presets(presets: DataFrame, changes: DataFrame, group: str = "instrument_id", key: str = "mag") -> DataFrame:
    """Apply one new preset per group.

    ``presets``: group, key, z_mm, locked. ``changes``: group, key, z_new, lock_delta. A locked target changes nothing. With
    lock_delta on and every other preset set, all unlocked presets of the group move along; else only the target does.
    """
    target = changes.select(group, F.col(key).alias("_key"), "z_new", "lock_delta")
    rows = presets.join(target, group, "left")
    is_target = F.col(key) == F.col("_key")
    facts = rows.groupBy(group).agg(
        F.max(F.when(is_target, F.col("locked"))).alias("_held"),
        F.max(F.when(is_target, F.col("z_new") - F.col("z_mm"))).alias("_delta"),
        F.count_if(~is_target & F.col("z_mm").isNull()).alias("_unset"),
    )
    rows = rows.join(facts, group, "left")
    active = F.col("_key").isNotNull() & ~F.coalesce(F.col("_held"), F.lit(False))
    together = active & F.col("lock_delta") & (F.col("_unset") == 0)
    z = (
        F.when(active & is_target, F.col("z_new"))
        .when(together & ~F.col("locked"), F.col("z_mm") + F.coalesce(F.col("_delta"), F.lit(0.0)))
        .otherwise(F.col("z_mm"))
    )
    return rows.select(*[c for c in presets.columns if c != "z_mm"], z.alias("z_mm"))
