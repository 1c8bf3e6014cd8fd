"""Packed frames, pixels and grid operators on small images with known results."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanlake.operators import frames, grid, pixels
from scanlake.sources import files


def table(spark, images, columns="frame_id long, r int, c int, v int"):
    data = [(k, r, c, int(v)) for k, image in images.items() for (r, c), v in np.ndenumerate(image)]
    return spark.createDataFrame(data, columns)


def packed(spark, images):
    data = [(k, *im.shape, bytearray(im.tobytes())) for k, im in images.items()]
    return spark.createDataFrame(data, "frame_id long, height int, width int, n_channels int, data binary")


def back(df, shape, value="v"):
    out = {}
    for row in df.collect():
        out.setdefault(row["frame_id"], np.full(shape, np.nan))[row["r"], row["c"]] = row[value]
    return out


@pytest.fixture(scope="module")
def noise():
    rng = np.random.default_rng(4)
    return {k: rng.integers(0, 256, (9, 7)) for k in range(5)}


def convolve(image, kernel):
    p = np.pad(image, 1, mode="reflect")
    h, w = image.shape
    return sum(kernel[j][i] * p[j : j + h, i : i + w] for j in range(3) for i in range(3))


def test_stencil(spark, noise):
    kernels = {"a": grid.LAPLACIAN, "b": grid.SOBEL_X, "d": grid.SOBEL_Y, "e": ((1, 2, 3), (4, 5, 6), (7, 8, 9))}
    out = grid.stencil(table(spark, noise), kernels).cache()
    for name, kernel in kernels.items():
        for k, image in back(out, (9, 7), name).items():
            assert np.array_equal(image, convolve(noise[k], kernel))


def test_metrics_of_both_forms(spark, noise):
    images = {**noise, 90: np.full((6, 6), 80), 91: np.indices((6, 6)).sum(axis=0) % 2 * 255, 92: np.array([[3, 9, 4]])}
    long, rows = table(spark, images), packed(spark, {k: v.astype(np.uint8)[:, :, None] for k, v in images.items()})
    for name in frames.PLANE_METRICS:
        a = {r["frame_id"]: r["metric"] for r in pixels.focus_metric(long, name).collect()}
        b = {r["frame_id"]: r["metric"] for r in frames.frame_metric(rows, name).collect()}
        assert a == pytest.approx(b)
        if name in ("LaplacianVariance", "Tenengrad"):
            assert a[90] == 0.0
        if name == "LaplacianVariance":
            assert a[91] == pytest.approx((4 * 255) ** 2)
    with pytest.raises(ValueError):
        pixels.focus_metric(long, "nope")


def test_explode_pixels_8_and_16_bit(spark):
    a = np.arange(5 * 4 * 3, dtype=np.uint8).reshape(5, 4, 3)
    b = (np.arange(5 * 4 * 3) * 900).astype("<u2").reshape(5, 4, 3)
    rows = frames.explode_pixels(packed(spark, {1: a, 2: b})).collect()
    assert len(rows) == 2 * a.size
    for r in rows:
        assert r["v"] == (a if r["frame_id"] == 1 else b)[r["r"], r["c"], r["ch"]]
    colours = frames.colour_pixels(frames.explode_pixels(packed(spark, {1: a}))).where("r = 2 AND c = 3").first()
    assert (colours["blue"], colours["green"], colours["red"]) == tuple(a[2, 3])


def test_flat_field_median(spark):
    rng = np.random.default_rng(9)
    stack = rng.integers(0, 256, (6, 3, 2))
    rows = table(spark, dict(enumerate(stack))).withColumn("ch", F.lit(0))
    flat = pixels.flat_field(rows)
    got = back(flat.withColumn("frame_id", F.lit(0)), (3, 2), "flat")[0]
    assert np.array_equal(got, np.median(stack, axis=0))
    fixed = pixels.apply_flat(rows, flat.where("r < 3"))
    want = stack / np.clip(np.median(stack, axis=0), 1, None) * np.clip(np.median(stack, axis=0), 1, None).mean()
    for k, image in back(fixed, (3, 2)).items():
        assert image == pytest.approx(want[k])


def test_global_stretch(spark):
    rows = table(spark, {1: np.array([[10, 20], [30, 60]]), 2: np.array([[7, 7], [7, 7]])}).withColumn("ch", F.lit(0))
    out = back(pixels.global_stretch(rows), (2, 2))
    assert out[1].tolist() == [[0, 51], [102, 255]] and out[2].tolist() == [[7, 7], [7, 7]]


def test_morphology(spark):
    rng = np.random.default_rng(2)
    mask = (rng.random((10, 11)) < 0.6) * 255
    rows = table(spark, {1: mask})

    def slide(image, kh, kw, pick, fill):
        out = np.zeros_like(image)
        for r, c in np.ndindex(image.shape):
            box = [
                image[r + i, c + j] if 0 <= r + i < image.shape[0] and 0 <= c + j < image.shape[1] else fill
                for i in range(-(kh // 2), kh - kh // 2) for j in range(-(kw // 2), kw - kw // 2)
            ]
            out[r, c] = pick(box)
        return out

    for kh, kw in ((3, 3), (1, 5), (4, 2)):
        assert np.array_equal(back(grid.dilate(rows, kh, kw), mask.shape)[1], slide(mask, kh, kw, max, 0))
        assert np.array_equal(back(grid.erode(rows, kh, kw), mask.shape)[1], slide(mask, kh, kw, min, 255))
    once = grid.opening(rows)
    assert np.array_equal(back(once, mask.shape)[1], back(grid.opening(once), mask.shape)[1])
    speck = np.zeros((9, 9), int)
    speck[4, 4] = 255
    assert back(grid.opening(table(spark, {1: speck})), (9, 9))[1].sum() == 0


def test_resampling_keeps_constant_and_identity(spark, noise):
    rows = table(spark, {1: np.full((6, 8), 40)})
    for out in (grid.resample_bilinear(rows, (6, 8), (5, 11)), grid.resample_nearest(rows, (6, 8), (5, 11))):
        assert np.allclose(back(out, (5, 11))[1], 40)
    same = back(grid.resample_bilinear(table(spark, noise), (9, 7), (9, 7)), (9, 7))
    assert all(np.allclose(same[k], noise[k]) for k in noise)
    tall = back(grid.resample_nearest(table(spark, noise), (9, 7), (18, 14)), (18, 14))
    assert all(np.array_equal(tall[k], noise[k].repeat(2, 0).repeat(2, 1)) for k in noise)


def test_gaussian_blur(spark, noise):
    weights = np.array(grid.gaussian_weights(0.8))
    radius = len(weights) // 2
    out = back(grid.gaussian_blur(table(spark, noise), 0.8), (9, 7))
    for k, image in noise.items():
        p = np.pad(image.astype(float), radius, mode="reflect")
        rows = np.apply_along_axis(lambda v: np.convolve(v, weights, "valid"), 1, p)
        assert np.allclose(out[k], np.apply_along_axis(lambda v: np.convolve(v, weights, "valid"), 0, rows))
    copy = back(grid.gaussian_blur(table(spark, {1: np.array([[0, 5]])}), 0, floor=1.0), (1, 2))
    assert copy[1].tolist() == [[1, 5]]


def test_outlines(spark):
    ring = np.zeros((9, 9), int)
    ring[1:8, 1:8] = 255
    ring[3:6, 3:6] = 0
    rows = table(spark, {1: ring})
    rim = {(r["r"], r["c"]) for r in grid.mask_outline(rows).collect()}
    outer = {(r["r"], r["c"]) for r in grid.outer_outline(rows).collect()}
    edge = {(r, c) for r in range(1, 8) for c in range(1, 8) if r in (1, 7) or c in (1, 7)}
    assert outer == edge and outer < rim


def test_rotate_quarter(spark):
    image = np.arange(25).reshape(5, 5)
    out = back(grid.rotate(table(spark, {1: image}), 90, (4, 4)), (5, 5))[1]  # about pixel (2, 2)
    assert np.array_equal(out, np.rot90(image))


def test_equalise_constant_and_range(spark):
    rng = np.random.default_rng(1)
    out = back(grid.tile_equalise(table(spark, {1: rng.integers(90, 110, (16, 16))}), (16, 16), (2, 2), 40.0), (16, 16))[1]
    assert out.max() - out.min() > 150 and out.min() >= 0 and out.max() <= 255


def test_temporal_average_small_slices(spark):
    rng = np.random.default_rng(7)
    values = rng.integers(0, 256, 30)
    df = spark.createDataFrame([(1, 0, 0, n, int(v)) for n, v in enumerate(values)], "camera int, r int, c int, n long, v int")
    got = {r["n"]: r["avg_v"] for r in pixels.temporal_average(df, 5, size=6).collect()}
    assert got == {n: int(values[max(0, n - 4) : n + 1].mean()) for n in range(30)}


def test_mode_colour_ties(spark):
    data = [(1, 0, 0, 200, 0, 0), (1, 0, 4, 8, 0, 0), (1, 4, 0, 200, 1, 0), (1, 4, 4, 9, 0, 0), (1, 1, 1, 77, 7, 7)]
    df = spark.createDataFrame(data, "frame_id long, r int, c int, blue int, green int, red int")
    for out in (pixels.mode_colour(df, 4).first(), pixels.mode_colour(df).first()):
        assert (out["blue"], out["green"], out["red"]) == (12, 4, 4)


def test_specks_do_not_survive_an_opening(spark):
    specks = spark.createDataFrame([(1, 3 * k, 5 * (k % 4), 255) for k in range(9)] + [(2, r, c, 255) for r in range(4, 8) for c in range(5, 8)], "frame_id long, r int, c int, v int")
    sizes = spark.createDataFrame([(1, 30, 30), (2, 20, 20)], "frame_id long, height int, width int")
    dense = grid.densify(specks, sizes)
    assert dense.count() == 30 * 30 + 20 * 20
    left = {(r["frame_id"], r["r"], r["c"]) for r in grid.opening(dense).where("v > 0").collect()}
    assert left == {(2, r, c) for r in range(4, 8) for c in range(5, 8)}


def test_shrink_keeps_the_far_edge(spark):
    image = np.arange(81, dtype=np.uint8).reshape(9, 9)
    df = spark.createDataFrame([(1, 9, 9, 1, bytes(image.tobytes()))], "frame_id long, height int, width int, n_channels int, data binary")
    blocks = [[image[r : r + 2, c : c + 2].mean() for c in range(0, 9, 2)] for r in range(0, 9, 2)]
    assert frames.frame_metric(df, "ImageVariance", 2).first()["metric"] == pytest.approx(np.var(blocks))


def png(image):
    h, w, _ = image.shape
    raw = b"".join(b"\0" + image[r].tobytes() for r in range(h))

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_read_scan(spark, tmp_path):
    rng = np.random.default_rng(3)
    folder = tmp_path / "wafer_scan_20240102_030405"
    folder.mkdir()
    images = {}
    for x, y in ((1.5, -2.25), (-0.125, 3.0)):
        images[(x, y)] = rng.integers(0, 256, (4, 5, 3)).astype(np.uint8)
        (folder / f"img_X{x:+.3f}_Y{y:+.3f}.png").write_bytes(png(images[(x, y)]))
    scan = files.read_scan(spark, str(folder)).cache()
    rows = scan.collect()
    assert {(r["x"], r["y"]) for r in rows} == set(images) and {r["scan"] for r in rows} == {"wafer_scan_20240102_030405"}
    for r in rows:
        got = frames.as_array(bytes(r["data"]), r["height"], r["width"], r["n_channels"])
        assert np.array_equal(got[:, :, ::-1], images[(r["x"], r["y"])])
    want = {r["frame_id"]: float(frames.gray_of(frames.as_array(bytes(r["data"]), 4, 5, 3)).mean()) for r in rows}
    assert {r["frame_id"]: r["metric"] for r in frames.frame_metric(scan, "Brightness").collect()} == pytest.approx(want)


def test_register_metric(spark, noise):
    pixels.register_metric("Peak", lambda px: px.groupBy("frame_id").agg(F.max("v").cast("double").alias("metric")))
    got = {r["frame_id"]: r["metric"] for r in pixels.focus_metric(table(spark, noise), "Peak").collect()}
    assert got == {k: float(v.max()) for k, v in noise.items()}


def test_roi_is_clipped(spark):
    rows = [(1, r, c, r, c, 0) for r in range(5) for c in range(5)]
    df = spark.createDataFrame(rows, "frame_id long, r int, c int, blue int, green int, red int")
    out = pixels.roi_stats(df, (5, 5), half=6).first()
    assert len(out["pixels"]) == 25 and out["mean_intensity"] == pytest.approx(4 / 3) and out["centre_intensity"] == pytest.approx(4 / 3)
    assert pixels.crop_roi(df, 2, 2, 2, exclusive=True).count() == 16


def test_missing_frames_have_no_intensity(spark):
    rnd = random.Random(0)
    px = table(spark, {1: np.array([[rnd.randint(0, 9) for _ in range(4)]])})
    listed = spark.createDataFrame([(1,), (2,)], "frame_id long")
    out = {r["frame_id"]: r["intensity"] for r in pixels.frame_intensity(px, listed).collect()}
    assert out[2] == 0.0 and out[1] > 0
