"""Streaming twins that need their own state: rolling averages, peak and edge search, newest position.

State lives in Spark's state store per key. Rows carry a gapless index; a row that arrives before its predecessor waits in a map of the
state, so results do not depend on how the stream is cut into batches. What one task holds at a time is bounded by the
source's rate limit (``maxFilesPerTrigger``, ``maxBytesPerTrigger``).
"""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from scanlake.operators import edges, sweeps
from scanlake.streaming.windows import WATERMARK


#: Event time after a key's newest row at which it counts as finished.
REST_MS = 60_000


#: Waiting rows handed on at once when the row before them has come.
RUN = 1024


def _plain(row) -> tuple:
    """A pandas row as values that state can hold."""
    return tuple(None if v is None or isinstance(v, float) and np.isnan(v) else v.tolist() if hasattr(v, "tolist") else v for v in row)


#: Keys of streams with many short keys share a call and a piece of state; a task holds the rows of a bucket.
BUCKETS = 128


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets).cast("bigint"))


def _pack(rows: pd.DataFrame) -> bytes:
    """Rows as one value that state can hold."""
    table, sink = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(block: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(block).read_pandas()


class InOrder(StatefulProcessor):
    """Hands the rows of a key to ``advance`` in index order, and ends a key that has come to rest.

    ``memory`` is the state schema of the subclass; its first column is the next index due. Rows that are due go straight on. Those
    that came too early wait in a map by index; each is written once and taken out once, so what a batch costs follows its own rows
    and not those that wait. With event times a timer goes on past a row that is missing once the watermark has passed the rows behind it
    (their predecessor would be too late), and calls ``finish`` and forgets the key once it has passed the newest row by ``rest_ms``.
    Without event times rows behind a gap wait. Rows that come again are dropped.
    """

    index = "i"
    columns = ""
    memory = ""
    timed = False
    rest_ms = 0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("memory", self.memory)
        self.waiting = handle.getMapState("waiting", "place bigint", self.columns)
        self.lowest = handle.getValueState("lowest", "place bigint")  # smallest index that waits
        self.newest = handle.getValueState("newest", "us bigint")
        self.names = [part.split()[0] for part in self.columns.split(", ")]
        self.line: deque[int] | None = None  # indices that wait, in order, once this call has asked for them

    def start(self) -> tuple:
        raise NotImplementedError

    def advance(self, key: tuple, run: pd.DataFrame, memory: tuple) -> tuple[pd.DataFrame | None, tuple]:
        raise NotImplementedError

    def finish(self, key: tuple, memory: tuple) -> pd.DataFrame | None:
        """Last row of a key at rest, if it has one to give."""
        return None

    def _advance(self, key, run: pd.DataFrame, memory: tuple, out: list[pd.DataFrame]) -> tuple:
        rows, memory = self.advance(key, run, memory)
        if rows is not None and len(rows):
            out.append(rows)
        return (int(run[self.index].iat[-1]) + 1, *memory[1:])

    def _release(self, key, memory: tuple, out: list[pd.DataFrame]) -> tuple:
        """Advance over the waiting rows that have become due."""
        if not self.lowest.exists() or self.lowest.get()[0] != memory[0]:
            return memory
        if self.line is None:  # once a call, however many gaps there are
            self.line = deque(sorted(k[0] for k in self.waiting.keys()))
        while self.line and self.line[0] == memory[0]:
            run = []
            while len(run) < RUN and self.line and self.line[0] == memory[0] + len(run):
                place = (self.line.popleft(),)
                run.append(tuple(self.waiting.getValue(place)))
                self.waiting.removeKey(place)
            memory = self._advance(key, pd.DataFrame(run, columns=self.names), memory, out)
        if self.line:  # behind another gap
            self.lowest.update((self.line[0],))
        else:
            self.lowest.clear()
        return memory

    def _wait(self, rows: pd.DataFrame) -> None:
        self.line = None
        for row in rows.itertuples(index=False):
            values = _plain(row)
            self.waiting.updateValue((values[self.names.index(self.index)],), values)
        low = int(rows[self.index].min())
        if not self.lowest.exists() or low < self.lowest.get()[0]:
            self.lowest.update((low,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        memory, out, self.line = tuple(self.state.get()) if self.state.exists() else self.start(), [], None
        for chunk in rows:
            chunk = chunk[self.names].drop_duplicates(self.index).sort_values(self.index, ignore_index=True)
            if self.timed:
                self._see(int(chunk["us"].max()))
            while len(chunk):
                chunk = chunk[chunk[self.index] >= memory[0]]
                place = chunk[self.index].to_numpy()
                length = int((place == memory[0] + np.arange(len(place))).cumprod().sum())
                # a waiting row goes before one of the same index that comes again
                if self.lowest.exists():
                    length = min(length, max(0, self.lowest.get()[0] - memory[0]))
                if length:
                    memory = self._advance(key, chunk[:length], memory, out)
                    chunk = chunk[length:]
                    memory = self._release(key, memory, out)
                else:
                    if len(chunk):
                        self._wait(chunk)
                    break
            yield from out
            out.clear()
        self.state.update(memory)

    def _see(self, us: int) -> None:
        newest = max(us, self.newest.get()[0]) if self.newest.exists() else us
        self.newest.update((newest,))
        self.handle.registerTimer(newest // 1000 + self.rest_ms + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        passed, memory, out, self.line = timerValues.getCurrentWatermarkInMs(), tuple(self.state.get()), [], None
        while self.lowest.exists():
            place = self.lowest.get()
            if dict(zip(self.names, self.waiting.getValue(place)))["us"] > passed * 1000:
                break
            memory = self._release(key, (place[0], *memory[1:]), out)
        if out:
            yield pd.concat(out, ignore_index=True)
        self.state.update(memory)
        if self.lowest.exists() or self.newest.get()[0] // 1000 + self.rest_ms >= passed:
            return
        last = self.finish(key, memory)
        for state in (self.state, self.newest):
            state.clear()
        if last is not None:
            yield last

    def close(self) -> None:
        pass


class KeysInOrder(StatefulProcessor):
    """``InOrder`` for many short keys: those of a bucket share calls and state, and ``advance`` gets numpy columns.

    Memories of the keys are one value; rows that came too early wait in packed blocks, which are read only when one of them is due.
    """

    keys, index, columns = (), "i", ()
    out = ()
    timed = False
    rest_ms = 0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.members = handle.getValueState("members", "held binary")  # key to its memory, newest time, smallest index that waits and its time
        self.waiting = handle.getListState("waiting", "block binary")

    def start(self) -> tuple:
        raise NotImplementedError

    def advance(self, key: tuple, run: dict[str, np.ndarray], memory: tuple) -> tuple[tuple | None, tuple]:
        """A row to give, if there is one, and the new memory; its first value is set to the next index due."""
        raise NotImplementedError

    def finish(self, key: tuple, memory: tuple) -> tuple | None:
        """Last row of a key at rest, if it has one to give."""
        return None

    def table(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=list(self.out))

    def _load(self) -> dict:
        return pickle.loads(self.members.get()[0]) if self.members.exists() else {}

    def _store(self, members: dict) -> None:
        if not members:
            self.members.clear()
            return
        self.members.update((pickle.dumps(members),))
        if self.timed:
            self.handle.registerTimer(min(newest for _, newest, _, _ in members.values()) // 1000 + self.rest_ms + 1)

    def _take(self) -> list[pd.DataFrame]:
        held = [_unpack(r[0]) for r in self.waiting.get()]
        self.waiting.clear()
        return held

    def _groups(self, rows: pd.DataFrame) -> Iterator[tuple[tuple, dict[str, np.ndarray]]]:
        """Each key with its rows in index order; of rows that come again the first."""
        group = rows.groupby(list(self.keys), sort=False, dropna=False).ngroup().to_numpy()
        place = rows[self.index].to_numpy()
        order = np.lexsort((np.arange(len(rows)), place, group))
        group, place = group[order], place[order]
        fresh = np.append(True, (group[1:] != group[:-1]) | (place[1:] != place[:-1]))
        order, group = order[fresh], group[fresh]
        values = {c: rows[c].to_numpy()[order] for c in self.columns}
        bounds = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        names = rows[list(self.keys)].iloc[order[bounds]].itertuples(index=False, name=None)
        for name, low, high in zip(names, bounds, [*bounds[1:], len(group)]):
            yield _plain(name), {c: v[low:high] for c, v in values.items()}

    def _advance(self, members: dict, rows: pd.DataFrame, passed_us: int | None, out: list[tuple]) -> None:
        """Advance over the rows that are due, past gaps whose next row the watermark has passed; the others wait."""
        early = []
        for key, run in self._groups(rows):
            memory, newest, low, low_us = members.get(key) or (self.start(), None, None, None)
            if len(run["us"]):
                newest = int(run["us"].max()) if newest is None else max(newest, int(run["us"].max()))
            ahead = run[self.index] >= memory[0]
            run = run if ahead.all() else {c: v[ahead] for c, v in run.items()}
            place = run[self.index]
            due = place == np.append(memory[0], place[:-1] + 1)[: len(place)]
            if passed_us is not None:
                due |= run["us"] <= passed_us
            n = len(place) if due.all() else int(due.argmin())
            if n:
                row, memory = self.advance(key, {c: v[:n] for c, v in run.items()}, memory)
                memory = (int(place[n - 1]) + 1, *memory[1:])
                if row is not None:
                    out.append(row)
            if n < len(place):
                if low is None or place[n] < low:
                    low, low_us = int(place[n]), int(run["us"][n])
                early.append(pd.DataFrame({**dict(zip(self.keys, key)), **{c: v[n:] for c, v in run.items()}}))
            members[key] = (memory, newest, low, low_us)
        if early:
            self.waiting.appendValue((_pack(pd.concat(early, ignore_index=True)),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        members, out = self._load(), []
        new = pd.concat([chunk[[*self.keys, *self.columns]] for chunk in rows], ignore_index=True)
        if any(low is not None for _, _, low, _ in members.values()):
            if any(members[k][2] is not None and members[k][0][0] in run[self.index] for k, run in self._groups(new) if k in members):
                members = {k: (memory, newest, None, None) for k, (memory, newest, _, _) in members.items()}
                new = pd.concat([*self._take(), new], ignore_index=True)  # what waits goes before a row that comes again
        self._advance(members, new, None, out)
        self._store(members)
        if out:
            yield self.table(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        members, passed, out = self._load(), timerValues.getCurrentWatermarkInMs(), []
        if any(low is not None and low_us <= passed * 1000 for _, _, low, low_us in members.values()):
            members = {k: (memory, newest, None, None) for k, (memory, newest, _, _) in members.items()}
            self._advance(members, pd.concat(self._take(), ignore_index=True), passed * 1000, out)
        for name, (memory, newest, low, _) in list(members.items()):
            if low is None and newest // 1000 + self.rest_ms < passed:
                last = self.finish(name, memory)
                del members[name]
                if last is not None:
                    out.append(last)
        self._store(members)
        if out:
            yield self.table(out)

    def close(self) -> None:
        pass


def _timed(processor: InOrder | KeysInOrder, stream: DataFrame, columns: list, rest_ms: int) -> tuple[DataFrame, str]:
    """The columns of a stream with its event time ``ts`` (watermarked by the caller) if it has one, and the time mode."""
    if "ts" not in stream.columns:
        return stream.select(*columns, F.lit(0).cast("long").alias("us")), "none"
    processor.timed, processor.rest_ms = True, rest_ms
    return stream.select(*columns, F.unix_micros("ts").alias("us"), "ts"), "EventTime"


class TemporalAverage(InOrder):
    index = "n"
    columns = "n bigint, us bigint, v array<double>"
    memory = "due bigint, tail array<array<double>>"

    def __init__(self, depth: int):
        self.depth = depth

    def start(self):
        return 0, []

    def advance(self, key, run, memory):
        tail = [np.asarray(t, dtype=float) for t in memory[1]]
        values = np.stack(tail + [np.asarray(v, dtype=float) for v in run["v"]])
        sums = np.concatenate([np.zeros_like(values[:1]), np.cumsum(values, axis=0)])
        end = np.arange(len(tail), len(values)) + 1
        begin = np.maximum(end - self.depth, 0)
        mean = np.floor((sums[end] - sums[begin]) / (end - begin)[:, None]).astype(np.int32)
        out = pd.DataFrame({"camera": key[0], "tile": key[1], "n": run["n"].to_numpy(), "avg_v": list(mean)})
        keep = values[max(0, len(values) - self.depth + 1):] if self.depth > 1 else values[:0]
        return out, (memory[0], keep.tolist())


def stream_temporal_average(stream: DataFrame, n: int, rest_ms: int = REST_MS) -> DataFrame:
    """Rolling mean of the last ``n`` frames of every pixel.

    A row is one tile of one frame, (camera, tile, n, v) with the tile's values in ``v``, so a busy camera spreads over its tiles
    and numpy averages whole tiles. Gives (camera, tile, n, avg_v). With an event time ``ts`` a lost frame is passed over.
    """
    schema = stream.schema
    types = {c: schema[c].dataType.simpleString() for c in ("camera", "tile")}
    search = TemporalAverage(n)
    rows, mode = _timed(search, stream, ["camera", "tile", F.col("n").cast("long").alias("n"), F.col("v").cast("array<double>").alias("v")], rest_ms)
    out = f"camera {types['camera']}, tile {types['tile']}, n bigint, avg_v array<int>"
    return rows.groupBy("camera", "tile").transformWithStateInPandas(search, out, "append", mode)


class PeakSearch(KeysInOrder):
    """The search of ``sweeps.find_peak_crossing``, which see; steps without a metric are passed over and not counted.

    Memory: index due, steps counted, the first and the last metrics, whether it rose, noise floor, whether it was reported, last z.
    """

    keys, columns = ("sweep_id",), ("i", "us", "z_mm", "metric")
    out = ("sweep_id", "peak_kind", "peak_i", "peak_z")

    def __init__(self, trend_n: int):
        self.first = max(4, trend_n)
        self.half = sweeps.half_window(trend_n)

    def start(self):
        return 0, 0, [], [], False, 0.0, False, 0.0

    def noise_floor(self, head: np.ndarray) -> float:
        return sweeps.noise_floor_from(np.abs(np.diff(head)))

    def after_head(self, head: list, up: bool, done: bool) -> tuple[float, bool]:
        """Noise floor, and whether the sweep still counts as rising, once its first steps are known."""
        floor = self.noise_floor(np.array(head))
        lost = floor > 0 and not done and len(head) > 1 and max(head[1:]) - head[0] <= floor
        return floor, up and not lost

    @staticmethod
    def crossing(rises: np.ndarray, falls: np.ndarray, up: bool) -> tuple[int | None, bool]:
        """First place that falls after a rise (``up``: there was one before), and whether there was a rise in all."""
        before = np.concatenate(([up], up | np.logical_or.accumulate(rises)))
        hit = np.flatnonzero(falls & before[:-1])
        return (int(hit[0]) if len(hit) else None), bool(before[-1])

    def advance(self, key, run, memory):
        due, n, head, recent, up, floor, done, last_z = memory
        value, z = run["metric"].astype(float), run["z_mm"].astype(float)
        if np.isnan(value).any():
            value, z = value[~np.isnan(value)], z[~np.isnan(value)]
        if not len(value):
            return None, memory
        head, recent, size = list(head), list(recent), len(value)
        count = n + np.arange(size)
        whole = np.concatenate((recent, value))
        span = np.minimum(self.half, count)
        at = len(recent) + np.arange(size)
        delta = value - whole[np.maximum(at - 1, 0)]
        smoothed = np.divide(value - whole[at - span], span, out=np.zeros(size), where=span > 0)
        early, found = count <= self.first, None
        head += value[early].tolist()
        if not done and early.any():
            found, up = self.crossing(smoothed[early] > 0, smoothed[early] < 0, up)
        if n <= self.first < n + size:
            floor, up = self.after_head(head, up, done or found is not None)
        if not done and found is None and not early.all():
            late = ~early
            rises = smoothed[late] > floor
            found, up = self.crossing(rises, (delta[late] < -floor) | (~rises & (smoothed[late] < 0)), up)
            found = None if found is None else found + int(early.sum())
        out = None
        if found is not None:
            done, out = True, self.row(key, "crossing", int(count[found]), z[found])
        return out, (due, n + size, head, whole[-self.half:].tolist(), bool(up), floor, bool(done), float(z[-1]))

    @staticmethod
    def row(key, kind, i, z):
        return key[0], kind, i, z

    def table(self, rows):
        return super().table(rows).astype({"peak_i": "Int64", "peak_z": float})

    def finish(self, key, memory):
        _, n, head, _, up, _, done, last_z = memory
        if done or not n:
            return None
        if n <= self.first:
            _, up = self.after_head(list(head), up, done)
        return self.row(key, "boundary", n - 1, last_z) if up else self.row(key, "none", None, None)


def stream_peak(stream: DataFrame, trend_n: int = 10, rest_ms: int = REST_MS, buckets: int = BUCKETS) -> DataFrame:
    """Reports how a sweep ends (sweep_id, peak_kind, peak_i, peak_z): a ``crossing`` when its step arrives.

    With an event time ``ts`` gaps are passed over, and ``boundary`` or ``none`` follows once the sweep has been at rest for ``rest_ms``.
    """
    key = stream.schema["sweep_id"].dataType.simpleString()
    search = PeakSearch(trend_n)
    rows, mode = _timed(search, stream, ["sweep_id", F.col("i").cast("long").alias("i"), "z_mm", "metric"], rest_ms)
    return rows.withColumn("bucket", _bucket(["sweep_id"], buckets)).groupBy("bucket").transformWithStateInPandas(search, f"sweep_id {key}, peak_kind string, peak_i bigint, peak_z double", "append", mode)


class EdgeSearch(KeysInOrder):
    """The search of ``edges.find_edge`` below half of the first intensity, which see.

    Memory: index due, steps counted, threshold, dark steps at the end, whether it was reported, last position.
    """

    keys, columns = ("scan_id", "dir"), ("i", "us", "step_mm", "pos_mm", "intensity")
    out = ("scan_id", "dir", "edge_mm", "edge_kind")

    def __init__(self, k: int):
        self.k = k

    def start(self):
        return 0, 0, -1.0, 0, False, 0.0

    def advance(self, key, run, memory):
        due, n, threshold, dark, done, _ = memory
        value, pos = run["intensity"].astype(float), run["pos_mm"].astype(float)
        if n == 0:
            threshold = max(10.0, 0.5 * float(value[0]))
        below = value < threshold
        place = np.arange(1, len(value) + 1)
        lit = np.maximum.accumulate(np.where(below, 0, place))  # last place that is not dark
        length = np.where(lit > 0, place - lit, place + dark)
        hit = np.flatnonzero(below & (length >= self.k))
        out = None
        if not done and len(hit):
            done = True
            out = self.row(key, pos[hit[0]] - (self.k - 1) * float(run["step_mm"][hit[0]]), "crossed")
        return out, (due, n + len(value), float(threshold), int(length[-1]) if below[-1] else 0, bool(done), float(pos[-1]))

    @staticmethod
    def row(key, edge, kind):
        return *key, edge, kind

    def table(self, rows):
        return super().table(rows).astype({"edge_mm": float})

    def finish(self, key, memory):
        _, n, _, _, done, last_pos = memory
        if done or not n:
            return None
        return self.row(key, last_pos, "limit") if n > edges.LIMIT_STEPS else self.row(key, None, "none")


def stream_edge(stream: DataFrame, k: int = 3, cap: int | None = None, rest_ms: int = REST_MS, buckets: int = BUCKETS) -> DataFrame:
    """Reports a trace's edge (scan_id, dir, edge_mm, edge_kind): ``crossed`` when the ``k``-th dark step in a row arrives.

    With an event time ``ts`` gaps are passed over, and ``limit`` or ``none`` follows once the trace has been at rest for ``rest_ms``.
    """
    key = stream.schema["scan_id"].dataType.simpleString()
    search = EdgeSearch(k)
    stream = stream if cap is None else stream.where(F.col("i") < cap)
    rows, mode = _timed(search, stream, ["scan_id", "dir", F.col("i").cast("long").alias("i"), "step_mm", "pos_mm", "intensity"], rest_ms)
    return rows.withColumn("bucket", _bucket(["scan_id", "dir"], buckets)).groupBy("bucket").transformWithStateInPandas(search, f"scan_id {key}, dir string, edge_mm double, edge_kind string", "append", mode)


def _last(marked: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Place of the newest marked row up to each row inside its group, -1 without one; rows are sorted by group."""
    place = np.arange(len(marked))
    start = np.maximum.accumulate(np.where(np.append(True, group[1:] != group[:-1])[: len(group)], place, 0))
    at = np.maximum.accumulate(np.where(marked, place, -1))
    return np.where(at >= start, at, -1)


def _grouped(rows: pd.DataFrame, order: list[str]) -> tuple[pd.DataFrame, np.ndarray]:
    """Rows sorted by instrument, then ``order``, and the number of each row's instrument."""
    rows = rows.assign(_group=pd.factorize(rows["instrument_id"], use_na_sentinel=False)[0])
    rows = rows.sort_values(["_group", *order], kind="stable", ignore_index=True)
    return rows.drop(columns="_group"), rows["_group"].to_numpy()


def _ends(group: np.ndarray) -> np.ndarray:
    """Whether each row is the last of its group."""
    return np.append(group[1:] != group[:-1], True)[: len(group)]


class SlicePositions(StatefulProcessor):
    """Matches the captures and readings of some instruments in one slice of time once the watermark has passed the slice.

    Gives captures with the newest reading of the slice before them (kind 0), captures before its first reading (1), and the last reading of each instrument (2).
    """

    NAMES = ["instrument_id", "us", "late", "capture_id", "x", "y", "z"]
    OUT = "bucket bigint, instrument_id {key}, route bigint, kind int, part bigint, us bigint, capture_id bigint, x bigint, y bigint, z bigint, at timestamp"

    def __init__(self, width_us: int):
        self.width = width_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.line = handle.getListState("line", "block binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for chunk in rows:
            self.line.appendValue((_pack(chunk[self.NAMES]),))
        self.handle.registerTimer((int(key[1]) + 1) * self.width // 1000)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        line, group = _grouped(pd.concat([_unpack(r[0]) for r in self.line.get()], ignore_index=True), ["us", "late"])
        self.line.clear()
        reading = (line["late"] == 0).to_numpy(bool)
        at = _last(reading, group)
        found = line[["x", "y", "z"]].astype("Int64").iloc[np.maximum(at, 0)].reset_index(drop=True)
        found[at < 0] = pd.NA
        matched = pd.concat([line[["instrument_id", "us", "capture_id"]], found], axis=1)
        matched = matched.assign(kind=np.where(at < 0, 1, 0), route=np.where(at < 0, -1, int(key[1])))[~reading]
        newest = line.iloc[at[_ends(group) & (at >= 0)]].astype({c: "Int64" for c in "xyz"}).assign(kind=2, route=-1, capture_id=0)
        out = pd.concat([part for part in (matched, newest) if len(part)], ignore_index=True)
        # what comes out is as old as the watermark, so that the next step does not take it for late
        now = pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms", tz="UTC")
        out = out.assign(bucket=key[0], part=int(key[1]), at=now).astype({c: "Int64" for c in ("capture_id", "x", "y", "z")})
        yield out[["bucket", "instrument_id", "route", "kind", "part", "us", "capture_id", "x", "y", "z", "at"]]

    def close(self) -> None:
        pass


class CarriedPositions(StatefulProcessor):
    """Gives captures before the first reading of their slice the last reading of the slices before.

    Slices arrive in order of time, as their timers run out in that order; the state is one reading of each instrument. Matched captures
    have routes of their own and only pass through.
    """

    NAMES = ["instrument_id", "x", "y", "z"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "block binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[1] >= 0:
            for chunk in rows:
                yield self._out(chunk)
            return
        line = pd.concat(list(rows), ignore_index=True)
        if self.last.exists():
            before = _unpack(self.last.get()[0]).assign(part=np.iinfo(np.int64).min, kind=2, us=0)
            line = pd.concat([before, line], ignore_index=True)
        line, group = _grouped(line, ["part", "kind", "us"])
        ends = (line["kind"] == 2).to_numpy()
        at = _last(ends, group)
        self.last.update((_pack(line[self.NAMES].iloc[at[_ends(group) & (at >= 0)]]),))
        if not ends.all():
            found = line[["x", "y", "z"]].astype("Int64").iloc[np.maximum(at, 0)].reset_index(drop=True)
            found[at < 0] = pd.NA
            yield self._out(pd.concat([line[["capture_id", "instrument_id"]], found], axis=1)[~ends])

    @staticmethod
    def _out(rows: pd.DataFrame) -> pd.DataFrame:
        return rows[["capture_id", "instrument_id", "x", "y", "z"]].astype({c: "Int64" for c in ("capture_id", "x", "y", "z")})

    def close(self) -> None:
        pass


def stream_latest_position(captures: DataFrame, readings: DataFrame, delay: str = WATERMARK, slice_seconds: int = 3600, buckets: int = BUCKETS) -> DataFrame:
    """Each capture with the newest reading of its instrument at or before its time, once the watermark has passed its slice.

    Captures: capture_id, instrument_id, ts. Readings: instrument_id, ts, x, y, z. Times are zoned; the watermark is set here,
    on both streams together. Two stateful steps: the first is keyed by (bucket of instruments, slice of ``slice_seconds``), so a busy
    instrument spreads over its slices, instruments with few rows share a call, and each row is read back once; the second carries the
    last readings from slice to slice. A task holds the rows of a bucket in a slice. A capture comes out once the watermark has passed the
    end of its slice: narrower slices answer sooner, and give the second step more to carry.
    """
    none = F.lit(0).cast("bigint")  # not null: pandas would make the numbers of the other side floating
    key = captures.schema["instrument_id"].dataType.simpleString()
    left = captures.select("instrument_id", "ts", F.lit(1).alias("late"), F.col("capture_id").cast("bigint").alias("capture_id"), none.alias("x"), none.alias("y"), none.alias("z"))
    right = readings.select("instrument_id", "ts", F.lit(0).alias("late"), none.alias("capture_id"), "x", "y", "z")
    width = slice_seconds * 1_000_000
    line = left.unionByName(right).withWatermark("ts", delay).withColumn("us", F.unix_micros("ts")).withColumn("part", F.floor(F.col("us") / width).cast("long"))
    matched = line.withColumn("bucket", _bucket(["instrument_id"], buckets)).groupBy("bucket", "part").transformWithStateInPandas(
        SlicePositions(width), SlicePositions.OUT.format(key=key), "append", "EventTime", eventTimeColumnName="at"
    )
    out = f"capture_id bigint, instrument_id {key}, x bigint, y bigint, z bigint"
    return matched.groupBy("bucket", "route").transformWithStateInPandas(CarriedPositions(), out, "append", "EventTime")
