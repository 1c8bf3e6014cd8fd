"""Ordered computations that never put a whole key into one task.

A plain ``Window.partitionBy(key)`` sorts all rows of a key in one task, so one hot instrument or
sweep stalls the job. Here every key is cut into *slices*, ranges of its order column, and windows run
per (key, slice). What a slice needs from the ones before it comes in one of two ways:

* ``running`` and ``previous``: each slice is reduced to one summary row, the summaries are scanned per
  key, and the carried-in value is joined back on (key, slice). The rows are already partitioned that
  way by their window, so only the summaries are shuffled again.
* ``with_halo``: for frames of at most ``back`` rows over a gapless index, the last ``back`` rows of a slice
  are copied into the next one. The copy is decided by arithmetic on the index, before the only shuffle.

Slices are pure functions of the order column, so retries and recomputation give the same cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = "_slice"
HALO = "_halo"
INDEX_SLICE = 65_536
DAY = 86_400
# Width of a time slice unless one is given; give instruments with hundreds of rows a second a narrower one.


def index_slice(index: Column, size: int = INDEX_SLICE) -> Column:
    """Slice of an integer order column: at most ``size`` distinct values in each."""
    return F.floor(index / F.lit(size)).cast("long")


def _micros(df: DataFrame, column: str) -> Column:
    """Microseconds of a time column. Zone-free timestamps are never cast to zoned ones, which keeps them monotone."""
    col = F.col(column)
    if df.schema[column].dataType.typeName() == "timestamp_ntz":
        minutes = F.unix_date(col.cast("date")) * F.lit(DAY // 60).cast("long") + F.hour(col) * 60 + F.minute(col)
        return minutes * 60_000_000 + (F.extract(F.lit("SECOND"), col) * 1_000_000).cast("long")
    return F.unix_micros(col)


def time_slice(df: DataFrame, column: str, seconds: float = DAY) -> Column:
    """Number of the slice of a time column, ``seconds`` wide (a fraction if need be)."""
    return F.floor(_micros(df, column) / F.lit(round(seconds * 1_000_000))).cast("long")


def time_sliced(df: DataFrame, column: str, seconds: float = DAY) -> DataFrame:
    """Add time slices of one fixed width: choose ``seconds`` so that the busiest key's rows of one slice fit a task."""
    return df.withColumn(SLICE, time_slice(df, column, seconds))


def _local(keys: Sequence[str], order: Sequence[str]) -> Window:
    return Window.partitionBy(*keys, SLICE).orderBy(*order)


_ROW = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], **measures: tuple[str, Column]) -> DataFrame:
    """Add running measures over (unbounded preceding, current row] of each key.

    ``df`` must carry the slice column. A measure is ``name=(kind, expression)`` with kind one of
    ``sum count max min last``; ``last`` skips nulls. ``total`` is the sum over all rows of the key.
    """
    frame = _local(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    position = F.struct(*order)
    local, totals, carried = [], [], []
    for name, (kind, expr) in measures.items():
        if kind == "total":
            totals.append(F.sum(expr).alias(f"_sum_{name}"))
            carried.append(F.sum(f"_sum_{name}").over(Window.partitionBy(*keys)).alias(f"_in_{name}"))
        elif kind == "last":
            local.append(F.last(expr, ignorenulls=True).over(frame).alias(f"_own_{name}"))
            totals.append(F.max_by(expr, F.when(expr.isNotNull(), position)).alias(f"_sum_{name}"))
            carried.append(F.last(f"_sum_{name}", ignorenulls=True).over(before).alias(f"_in_{name}"))
        else:
            local.append(_ROW[kind](expr).over(frame).alias(f"_own_{name}"))
            totals.append(_ROW[kind](expr).alias(f"_sum_{name}"))
            merge = F.sum if kind == "count" else _ROW[kind]
            carried.append(merge(f"_sum_{name}").over(before).alias(f"_in_{name}"))
    on = [*keys, SLICE]
    carry = df.groupBy(*on).agg(*totals).select(*on, *carried)
    joined = df.select("*", *local).join(carry, on, "left")
    result = [F.col(c) for c in df.columns]
    for name, (kind, _) in measures.items():
        own, into = F.col(f"_own_{name}"), F.col(f"_in_{name}")
        if kind == "total":
            value = into
        elif kind == "last":
            value = F.coalesce(own, into)
        elif kind == "max":
            value = F.greatest(own, into)
        elif kind == "min":
            value = F.least(own, into)
        elif kind == "count":
            value = own + F.coalesce(into, F.lit(0))
        else:
            value = F.coalesce(own + into, own, into)
        result.append(value.alias(name))
    return joined.select(*result)


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], **columns: Column) -> DataFrame:
    """Add the value each expression had on the row before, null on the first row of a key."""
    on = [*keys, SLICE]
    packed = F.struct(*[expr.alias(name) for name, expr in columns.items()])
    carry = df.groupBy(*on).agg(F.max_by(packed, F.struct(*order)).alias("_end"))
    carry = carry.select(*on, F.lag("_end").over(Window.partitionBy(*keys).orderBy(SLICE)).alias("_in"))
    local = df.withColumn("_own", F.lag(packed).over(_local(keys, order)))
    joined = local.join(carry, on, "left")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[F.coalesce(F.col("_own"), F.col("_in"))[name].alias(name) for name in columns],
    )


def dense_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_col: Column | None = None, name: str = "i", length: str | None = None) -> DataFrame:
    """Number the rows of each key 0, 1, 2, ... in order. ``slice_col`` must grow with the order columns; none means ``df`` is sliced.

    ``length`` names a column for the number of rows of the key.
    """
    sliced = df if slice_col is None else df.withColumn(SLICE, slice_col)
    numbered = running(sliced, keys, order, **{name: ("count", F.lit(1))}, **({length: ("total", F.lit(1))} if length else {}))
    return numbered.withColumn(name, F.col(name) - 1).drop(SLICE)


def with_halo(df: DataFrame, index: str, back: int, size: int = INDEX_SLICE) -> DataFrame:
    """Slice by a gapless index and copy the last ``back`` rows of a slice into the next, flagged ``_halo``."""
    if back > size:
        raise ValueError("the frame is longer than a slice")
    own = index_slice(F.col(index), size)
    near_end = F.pmod(F.col(index), F.lit(size)) >= size - back
    homes = F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))
    return df.select("*", own.alias("_home"), F.explode(homes).alias(SLICE)).withColumn(HALO, F.col("_home") != F.col(SLICE)).drop("_home")


def halo_window(keys: Sequence[str], index: str) -> Window:
    """The window to use on the output of ``with_halo``."""
    return _local(keys, [index])


def drop_halo(df: DataFrame, keep_slice: bool = False) -> DataFrame:
    """Remove the copied rows."""
    out = df.where(~F.col(HALO)).drop(HALO)
    return out if keep_slice else out.drop(SLICE)


def attach(rows: DataFrame, per_key: DataFrame, keys: Sequence[str], last_index: str, size: int = INDEX_SLICE) -> DataFrame:
    """Join one-row-per-key values to rows that carry the slice column.

    The key rows are repeated once per slice (``last_index`` tells how many) and joined on (key, slice), so the rows
    keep their partitioning and a hot key stays spread out.
    """
    slices = F.sequence(F.lit(0).cast("long"), index_slice(F.col(last_index), size))
    per_slice = per_key.withColumn(SLICE, F.explode(slices))
    return rows.join(per_slice, [*keys, SLICE])
