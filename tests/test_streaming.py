"""Streams give the batch results however the rows are cut into batches."""

import random

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from scanlake.operators import edges, logs, lookup, sweeps
from scanlake.streaming import stateful, windows


def feed(spark, df, path, parts):
    """Write the rows in files by ``parts`` (a column), shuffled in time: later rows may come first."""
    for k in parts:
        df.where(F.col("_file") == k).drop("_file").coalesce(1).write.mode("append").parquet(path)
    return windows.read_stream(spark, path, df.drop("_file").schema, files_per_trigger=1)


@pytest.fixture(scope="module")
def sweep(spark):
    rnd = random.Random(1)
    data = []
    for key in range(12):
        top = rnd.randint(3, 25)
        data += [(key, i, i * 0.01, 100.0 - abs(i - top) * 3 + rnd.random(), (i * 7 + key) % 3) for i in range(30)]
    return spark.createDataFrame(data, "sweep_id long, i long, z_mm double, metric double, _file int").cache()


def test_peak_with_rows_out_of_order(spark, sweep, tmp_path):
    out = windows.run_available(stateful.stream_peak(feed(spark, sweep, str(tmp_path / "in"), (2, 0, 1)), 10))
    want = sweeps.find_peak_crossing(sweep.drop("_file"), 10).where("peak_kind = 'crossing'")
    assert sorted(map(tuple, out.collect())) == sorted(tuple(r) for r in want.select("sweep_id", "peak_kind", "peak_i", "peak_z").collect())


def closed(spark, df, path, parts, **closing):
    """``feed`` of rows timed by their index, with a last file that moves the watermark past them all."""
    df = df.withColumn("ts", F.timestamp_seconds(F.col("i") + 1_000_000))
    stream = feed(spark, df, path, parts)
    last = {"i": 0, "ts": "timestamp'2100-01-01'", **closing}
    rows = spark.range(1).selectExpr(*[f"CAST({last.get(f.name, 'NULL')} AS {f.dataType.simpleString()}) AS {f.name}" for f in df.drop("_file").schema])
    rows.coalesce(1).write.mode("append").parquet(path)
    return stream.withWatermark("ts", "1 hour")


def test_peak_over_gaps_and_to_the_end(spark, tmp_path):
    rnd = random.Random(6)
    data = []
    for key in range(60):
        n, top = rnd.choice([1, 3, 9, 30, 45]), rnd.choice([-5, 10, 20, 99])
        for i in range(n):
            if rnd.random() > 0.1:
                data.append((key, i, i * 0.01, None if rnd.random() < 0.1 else 100.0 - abs(i - top) * rnd.choice([0.1, 3]) + rnd.random(), rnd.randrange(3)))
    df = spark.createDataFrame(data, "sweep_id long, i long, z_mm double, metric double, _file int")
    out = windows.run_available(stateful.stream_peak(closed(spark, df, str(tmp_path / "in"), (2, 0, 1), sweep_id=-1), 10))
    want = sweeps.find_peak_crossing(sweeps.clean_sweep(df.drop("_file")), 10).select("sweep_id", "peak_kind", "peak_i", "peak_z")
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == sorted(map(tuple, want.collect()), key=str) and {r[1] for r in got} == {"crossing", "boundary", "none"}


def test_edge_kinds_and_gaps(spark, tmp_path):
    rnd = random.Random(7)
    data = []
    for scan in range(30):
        n, cut = rnd.choice([2, 40, 52, 120, 400]), rnd.randint(0, 500)
        values = [100.0] + [rnd.choice([90.0, 90.0, 10.0] if scan % 3 else [90.0]) if k < cut else 10.0 for k in range(1, n)]
        data += [(scan, "x_positive", i, 0.1, i * 0.1, v, i % 3) for i, v in enumerate(values)]
    df = spark.createDataFrame(data, "scan_id long, dir string, i long, step_mm double, pos_mm double, intensity double, _file int")
    gappy = df.where("i = 0 OR i % 7 <> 3")
    out = windows.run_available(stateful.stream_edge(closed(spark, gappy, str(tmp_path / "in"), (1, 0, 2), scan_id=-1, dir="'end'"))).where("scan_id >= 0")
    dense = gappy.drop("_file").withColumn("i", F.row_number().over(Window.partitionBy("scan_id").orderBy("i")) - 1)
    want = edges.find_edge(dense, edges.auto_threshold(dense))
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == sorted(map(tuple, want.collect()), key=str) and {r[3] for r in got} == {"crossed", "limit", "none"}


def test_edge_and_limit(spark, tmp_path):
    data = [(s, "x_positive", i, 0.1, i * 0.1, 10.0 if s == 1 and i > 40 else 90.0, i % 2) for s in (1, 2) for i in range(310)]
    df = spark.createDataFrame(data, "scan_id long, dir string, i long, step_mm double, pos_mm double, intensity double, _file int")
    out = windows.run_available(stateful.stream_edge(feed(spark, df, str(tmp_path / "in"), (1, 0))))
    rows = df.drop("_file")
    want = edges.find_edge(rows, edges.auto_threshold(rows)).where("edge_kind = 'crossed'")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_temporal_average_per_tile(spark, tmp_path):
    rnd = random.Random(3)
    values = {(cam, t, n): [rnd.randint(0, 255) for _ in range(4)] for cam in (1, 2) for t in (0, 1) for n in range(9)}
    df = spark.createDataFrame([(*k, [float(x) for x in v], k[2] % 3) for k, v in values.items()], "camera int, tile int, n long, v array<double>, _file int")
    out = windows.run_available(stateful.stream_temporal_average(feed(spark, df, str(tmp_path / "in"), (1, 2, 0)), 3)).collect()
    assert len(out) == len(values)
    for r in out:
        last = [values[(r["camera"], r["tile"], n)] for n in range(max(0, r["n"] - 2), r["n"] + 1)]
        assert r["avg_v"] == [int(sum(col) / len(last)) for col in zip(*last)]


@pytest.mark.parametrize("slice_seconds", [3600, 40])
def test_latest_position_waits_for_the_watermark(spark, tmp_path, slice_seconds):
    rnd = random.Random(4)
    data = [(k, rnd.randint(1, 3), t, rnd.random() < 0.4, k % 2) for k, t in enumerate(sorted(rnd.sample(range(1000), 120)))]
    df = spark.createDataFrame(data, "event_id long, instrument_id long, s long, cap boolean, _file int").withColumn("ts", F.timestamp_seconds("s"))
    stream = feed(spark, df, str(tmp_path / "in"), (0, 1))
    closing = spark.createDataFrame([(10**6, 9, 10**6, False, 7)], "event_id long, instrument_id long, s long, cap boolean, _file int").withColumn("ts", F.timestamp_seconds("s"))
    closing.drop("_file").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # moves the watermark past all rows
    caps = stream.where("cap").select(F.col("event_id").alias("capture_id"), "instrument_id", "ts")
    reads = stream.where("NOT cap").selectExpr("instrument_id", "ts", "event_id AS x", "event_id AS y", "event_id AS z")
    out = windows.run_available(stateful.stream_latest_position(caps, reads, "2000 seconds", slice_seconds))
    c = df.where("cap").select(F.col("event_id").alias("capture_id"), "instrument_id", "ts")
    r = df.where("NOT cap").selectExpr("instrument_id", "ts", "event_id AS x")
    want = lookup.latest_position(c, r, ["x"]).select("capture_id", "instrument_id", "x")
    assert sorted(map(str, out.select("capture_id", "instrument_id", "x").collect())) == sorted(map(str, want.collect()))


class Held:
    """A state variable in memory that counts how often it is used."""

    used = 0

    def __init__(self):
        self.value = None

    def count(self, n=1):
        Held.used += n

    def exists(self):
        self.count()
        return bool(self.value)

    def get(self):
        self.count()
        return self.value

    def update(self, value):
        self.count()
        self.value = value

    def clear(self):
        self.count()
        self.value = None

    def containsKey(self, key):
        self.count()
        return key in (self.value or {})

    def getValue(self, key):
        self.count()
        return self.value[key]

    def updateValue(self, key, value):
        self.count()
        self.value = {**self.value, key: value} if self.value and len(self.value) < 3 else (self.value or {})
        self.value[key] = value

    def removeKey(self, key):
        self.count()
        del self.value[key]

    def keys(self):
        self.count(len(self.value or {}))
        return list(self.value or {})


class Handle:
    def __init__(self):
        self.timers = set()

    def getValueState(self, *_):
        return Held()

    getMapState = getValueState

    def registerTimer(self, ms):
        self.timers.add(ms)


class Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_a_batch_costs_its_own_rows_however_many_wait():
    search = stateful.TemporalAverage(3)
    search.timed, search.rest_ms = True, 1000
    search.init(Handle())
    key, costs, rnd = ("cam", 0), [], random.Random(2)
    for batch in range(50):
        n = [1 + batch * 200 + k for k in range(200)]  # frame 0 never comes
        rnd.shuffle(n)
        rows = pd.DataFrame({"n": n, "us": [i * 1_000_000 for i in n], "v": [[float(i)] for i in n]})
        Held.used = 0
        assert list(search.handleInputRows(key, iter([rows]), Watermark(0))) == []
        assert list(search.handleExpiredTimer(key, Watermark(500), None)) == []  # nothing has been passed yet
        costs.append(Held.used)
    assert len(search.waiting.value) == 10_000 and max(costs) <= min(costs) + 5 < 300
    out = pd.concat(search.handleExpiredTimer(key, Watermark(20_000_000), None))
    assert out["n"].tolist() == list(range(1, 10_001)) and out["avg_v"].map(lambda v: v[0]).tolist()[:4] == [1, 1, 2, 3]
    assert not search.state.exists() and not search.waiting.exists()


def test_rows_that_come_again_and_fill_gaps():
    search = stateful.TemporalAverage(1)
    search.init(Handle())
    seen = []
    for n in ([3, 1], [1, 5], [0, 3], [2], [2, 6, 4], [7, 0]):
        rows = pd.DataFrame({"n": n, "us": 0, "v": [[float(i)] for i in n]})
        seen += [v for out in search.handleInputRows(("cam", 0), iter([rows]), Watermark(0)) for v in out["n"]]
    assert seen == list(range(8)) and not search.waiting.exists()


def test_rates_progress_and_newest(spark, tmp_path):
    data = [(k, k % 3, k * 7, k % 2) for k in range(60)]
    df = spark.createDataFrame(data, "frame_id long, instrument_id long, s long, _file int").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    stream = feed(spark, df, str(tmp_path / "in"), (0, 1))
    rows = df.drop("_file")
    rate = windows.run_available(windows.stream_frame_rate(windows.with_event_time(stream, delay="1 hour"), seconds=10), "update", ["instrument_id", "window_start"])
    assert sorted(map(tuple, rate.collect())) == sorted(map(tuple, logs.frame_rate(rows, seconds=10).collect()))
    newest = windows.run_available(windows.latest_frame(stream), "update", ["instrument_id"])
    assert {(r["instrument_id"], r["frame_id"]) for r in newest.collect()} == {(0, 57), (1, 58), (2, 59)}
    totals = spark.createDataFrame([(k, 40) for k in range(3)], "instrument_id long, total long")
    done = windows.run_available(windows.stream_progress(stream, totals, "instrument_id"), "update", ["instrument_id"])
    assert {(r["captured"], r["pct"]) for r in done.collect()} == {(20, 52)}


def test_late_rows_are_dropped(spark, tmp_path):
    data = [(1, 1, 1000, 0), (2, 1, 1001, 1), (3, 1, 5, 2), (4, 1, 1002, 2)]  # the watermark acts one batch later
    df = spark.createDataFrame(data, "frame_id long, instrument_id long, s long, _file int").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    stream = windows.with_event_time(feed(spark, df, str(tmp_path / "in"), (0, 1, 2)))
    out = windows.run_available(windows.stream_frame_rate(stream), "update", ["instrument_id", "window_start"])
    assert sorted(r["window_start"] for r in out.collect()) == [1000, 1001, 1002]


class Listed(Held):
    """A list state."""

    def get(self):
        return iter(super().get() or [])

    def appendValue(self, value):
        self.update([*(self.value or []), value])


def test_instruments_of_a_bucket_share_calls_and_state():
    rnd, costs = random.Random(5), []
    for instruments in (3, 400):
        handle = Handle()
        handle.getListState = lambda *_: Listed()
        matching, carrying = stateful.SlicePositions(100), stateful.CarriedPositions()
        matching.init(handle)
        carrying.init(handle)
        Held.used, got, want = 0, [], []
        for part in range(4):
            rows, taken = [], rnd.sample(range(100), 9)
            for k in range(instruments):
                for us in sorted(rnd.sample(taken, rnd.randrange(6))):
                    late = rnd.randrange(2)
                    n = part * 100 + us
                    rows.append((k, n, late, n if late else 0, 0 if late else n, 0 if late else n, 0 if late else n))
            rows = pd.DataFrame(rows, columns=matching.NAMES)
            want += [(r.capture_id, r.instrument_id) for r in rows.itertuples() if r.late]
            list(matching.handleInputRows((7, part), iter([rows[::2], rows[1::2]]), Watermark(0)))
            out = pd.concat(matching.handleExpiredTimer((7, part), Watermark(1000), None))
            for route, some in out.groupby("route"):
                got += [r for done in carrying.handleInputRows((7, route), iter([some]), Watermark(1000)) for r in done.itertuples(index=False)]
            got_reads = rows[rows["late"] == 0]
            reads = got_reads if part == 0 else pd.concat([reads, got_reads])
        costs.append(Held.used)
        assert sorted((r.capture_id, r.instrument_id) for r in got) == sorted(want)
        for r in got[:300]:
            before = reads[(reads["instrument_id"] == r.instrument_id) & (reads["us"] <= r.capture_id)]["x"]
            assert (None if pd.isna(r.x) else r.x) == (before.max() if len(before) else None)
    assert costs[0] == costs[1]


class Seen(stateful.KeysInOrder):
    """Gives the rows of each advance."""

    keys, columns, out = ("k",), ("i", "us"), ("k", "seen")

    def start(self):
        return (0,)

    def advance(self, key, run, memory):
        return (key[0], run["i"].tolist()), memory

    def finish(self, key, memory):
        return key[0], ["end"]


def keyed(search):
    handle = Handle()
    handle.getListState = lambda *_: Listed()
    search.timed, search.rest_ms = True, 5
    search.init(handle)
    return handle


def test_keys_of_a_bucket_wait_go_on_and_end_each_on_their_own():
    search, rnd = Seen(), random.Random(8)
    handle, seen = keyed(search), {}

    def gather(frames):
        for frame in frames:
            for k, some in frame.itertuples(index=False):
                seen.setdefault(k, []).extend(some)

    places = {k: [i for i in range(40) if i % 7 != k] for k in range(6)}  # key k loses every seventh row, from row k on
    feed_rows = [(k, i, i * 1000) for k, line in places.items() for i in line]
    rnd.shuffle(feed_rows)
    for part in range(4):
        rows = pd.DataFrame(feed_rows[part::4] + feed_rows[:3], columns=["k", "i", "us"])  # some come again
        gather(search.handleInputRows((0,), iter([rows[:20], rows[20:]]), Watermark(0)))
    assert seen[5] == [0, 1, 2, 3, 4] and 0 not in seen
    gather(search.handleExpiredTimer((0,), Watermark(20), None))  # rows up to 20 have been passed
    assert seen[5] == [i for i in places[5] if i <= 25] and seen[0] == [i for i in places[0] if i < 21]
    gather(search.handleExpiredTimer((0,), Watermark(45), None))
    assert seen == {k: [*line, "end"] for k, line in places.items()}
    assert not search.members.exists() and not search.waiting.exists() and max(handle.timers) == 38 + 5 + 1  # of the key that ends first


def test_sweeps_of_a_bucket_share_calls_and_state():
    costs = []
    for sweeps_ in (3, 300):
        search = stateful.PeakSearch(10)
        keyed(search)
        Held.used = 0
        for part in range(2):
            rows = [(k, i, i * 1000, i * 0.1, float(i if k % 3 else -i)) for k in range(sweeps_) for i in range(part * 20, part * 20 + 20) if i != 25]
            assert not list(search.handleInputRows((0,), iter([pd.DataFrame(rows, columns=["sweep_id", "i", "us", "z_mm", "metric"])]), Watermark(0)))
        out = pd.concat(search.handleExpiredTimer((0,), Watermark(100), None))
        costs.append(Held.used)
        assert out["peak_kind"].value_counts().to_dict() == {"boundary": sweeps_ - len(range(0, sweeps_, 3)), "none": len(range(0, sweeps_, 3))}
        assert set(out["peak_i"].dropna()) == {38}
    assert costs[0] == costs[1]


def test_traces_of_a_bucket_share_calls_and_state():
    costs = []
    for scans in (3, 300):
        search = stateful.EdgeSearch(2)
        keyed(search)
        Held.used = 0
        out = []
        for part in range(2):
            rows = [(k, d, i, i * 1000, 0.1, i * 0.1, 10.0 if d == "up" and i > 22 else 90.0) for k in range(scans) for d in ("up", "down") for i in range(part * 20, part * 20 + 20)]
            out += search.handleInputRows((0,), iter([pd.DataFrame(rows, columns=[*search.keys, *search.columns])]), Watermark(0))
        out += search.handleExpiredTimer((0,), Watermark(100), None)
        costs.append(Held.used)
        got = {(r.scan_id, r.dir): (None if pd.isna(r.edge_mm) else round(r.edge_mm, 6), r.edge_kind) for r in pd.concat(out).itertuples()}
        assert got == {(k, d): (2.3, "crossed") if d == "up" else (None, "none") for k in range(scans) for d in ("up", "down")}
    assert costs[0] == costs[1]


def test_gaps_are_passed_without_asking_for_all_that_waits_again():
    costs = []
    for gap in (1000, 5):  # frames between two lost ones
        search = stateful.TemporalAverage(2)
        search.timed, search.rest_ms = True, 1000
        search.init(Handle())
        n = [i for i in range(1, 2001) if i % gap != 3]
        rows = pd.DataFrame({"n": n, "us": [i * 1000 for i in n], "v": [[float(i)] for i in n]})
        assert not list(search.handleInputRows(("cam", 0), iter([rows]), Watermark(0)))
        Held.used = 0
        out = pd.concat(search.handleExpiredTimer(("cam", 0), Watermark(20_000), None))
        assert out["n"].tolist() == n and not search.waiting.exists()
        costs.append(Held.used)
    assert costs[1] < 2 * costs[0]
