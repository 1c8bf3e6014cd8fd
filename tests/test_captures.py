"""Capture files, manifests that are written again, and rates by a clock that restarts."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanlake.operators import logs
from scanlake.sources import captures, files


def filtered_png(image, rng):
    """PNG bytes whose lines use all five filters."""
    h, w, n = image.shape
    wide = image[:, :, ::-1].astype(">u2" if image.dtype.itemsize == 2 else np.uint8)
    step = n * image.dtype.itemsize
    lines = np.frombuffer(wide.tobytes(), np.uint8).reshape(h, -1).astype(int)
    out = b""
    for r in range(h):
        kind, line = rng.randrange(5), lines[r]
        up = lines[r - 1] if r else np.zeros(len(line), int)
        left, corner = (np.concatenate((np.zeros(step, int), v[:-step])) for v in (line, up))
        p = left + up - corner
        near = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        guess = [0, left, up, (left + up) // 2, near][kind]
        out += bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes()
    whole = captures.encode_png(image)
    at = whole.index(b"IDAT") - 4
    data = zlib.compress(out)
    return whole[:at] + len(data).to_bytes(4, "big") + b"IDAT" + data + zlib.crc32(b"IDAT" + data).to_bytes(4, "big") + whole[whole.index(b"IEND") - 4 :]


@pytest.mark.parametrize("shape,dtype", [((7, 9, 1), np.uint8), ((5, 6, 3), np.uint8), ((8, 5, 1), "<u2"), ((4, 7, 3), "<u2")])
def test_png_values_come_back(shape, dtype):
    image = np.random.default_rng(3).integers(0, 256 if np.dtype(dtype).itemsize == 1 else 65536, shape).astype(dtype)
    for data in (captures.encode_png(image), filtered_png(image, random.Random(4))):
        back = captures.decode_png(data)
        assert back.dtype == np.dtype(dtype) and np.array_equal(back, image)
    with pytest.raises(ValueError):
        captures.decode_png(b"GIF89a")


def test_filters_decide_which_files_are_opened(spark, tmp_path):
    captures.register(spark)
    rng = np.random.default_rng(5)
    images = {(k, s): rng.integers(0, 65536, (6, 5, 1)).astype("<u2") for k in range(6) for s in (1, 2)}
    rows = [(f"wafer_scan_2024010{s}_000000/img_X{k * 0.5:+.3f}_Y{-k:+.3f}.png", 6, 5, 1, im.tobytes()) for (k, s), im in images.items()]
    captures.write_captures(spark.createDataFrame(rows, "file string, height int, width int, n_channels int, data binary"), str(tmp_path))
    (tmp_path / "wafer_scan_20240101_000000/img_X+9.000_Y+0.000.png").write_bytes(b"broken")
    (tmp_path / "notes.txt").write_text("x")
    df = spark.read.format("captures").option("tile", 4).option("filesPerTask", 2).load(str(tmp_path))
    some = df.where("scan = 'wafer_scan_20240101_000000' AND x >= 1 AND x < 2 AND height = 6").collect()  # the broken file is never opened
    assert {r["x"] for r in some} == {1.0, 1.5} and len(some) == 8
    for r in some:
        part = images[round(r["x"] * 2), 1][r["tr"] * 4 : r["tr"] * 4 + 4, r["tc"] * 4 : r["tc"] * 4 + 4, 0]
        assert np.array_equal(np.frombuffer(r["data"], r["kind"]).reshape(part.shape), part) and r["y"] == -r["x"] * 2
    assert df.where("x > 100").count() == 0
    with pytest.raises(Exception, match="not a PNG"):
        df.where("x > 5").collect()


def test_manifest_written_again(spark, tmp_path):
    path = str(tmp_path / "manifest")
    points = spark.createDataFrame([(1, k, float(k)) for k in range(5)] + [(2, 0, 9.0), (2, 0, 9.0)], "scan_id long, seq long, x double")
    changed = spark.createDataFrame([(1, 2, 7.5), (3, 1, 1.0)], "scan_id long, seq long, x double")
    stream_batches = [(points, 0), (changed, 1), (changed, 1), (points.where("scan_id = 2"), 12)]
    for rows, number in stream_batches:
        files.upsert_manifest(rows, path, number)
    want = {(1, 0, 0.0), (1, 1, 1.0), (1, 2, 7.5), (1, 3, 3.0), (1, 4, 4.0), (2, 0, 9.0), (3, 1, 1.0)}
    assert sorted(map(tuple, files.read_newest(spark, path).select("scan_id", "seq", "x").collect())) == sorted(want)
    files.compact_manifest(spark, path, str(tmp_path / "compact"))
    assert sorted(map(tuple, files.read_newest(spark, str(tmp_path / "compact")).select("scan_id", "seq", "x").collect())) == sorted(want)


def test_ticks_equal_a_clock(spark):
    rnd = random.Random(6)
    times = {k: sorted(rnd.choice([rnd.uniform(0, 20), rnd.uniform(0, 400), rnd.randint(0, 30)]) for _ in range(rnd.choice([1, 2, 30, 150]))) for k in range(12)}
    times[20] = [float(k) for k in range(40)]
    rows = [(k, n, round(t * 1_000_000)) for k, ts in times.items() for n, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "instrument_id long, frame_id long, us long").withColumn("ts", F.timestamp_micros("us")).repartition(4)
    for seconds in (1.0, 2.5, 7.0):
        want = set()
        for k, ts in times.items():
            us, last = [round(t * 1_000_000) for t in ts], 0
            for n in range(1, len(us)):
                if us[n] - us[last] >= seconds * 1_000_000:
                    want.add((k, us[n], n - last, round((n - last) / ((us[n] - us[last]) / 1e6), 9)))
                    last = n
        got = {(r["instrument_id"], r["tick_us"], r["frames"], round(r["fps"], 9)) for r in logs.frame_ticks(df, seconds=seconds).collect()}
        assert got == want
