"""Tiles with halo against whole planes: borders, halos wider than a tile, colour and 16-bit frames, merged counts."""

import numpy as np
import pytest

from scanlake.operators import grid, planes, tiles


def frames(spark, images):
    rows = [(k, *im.shape, np.ascontiguousarray(im).tobytes()) for k, im in images.items()]
    return spark.createDataFrame(rows, "frame_id long, height int, width int, n_channels int, data binary")


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(5)
    sizes = {1: (20, 33, 1), 2: (7, 5, 1), 3: (16, 16, 3), 4: (1, 40, 1), 5: (23, 1, 1)}
    return {k: rng.integers(0, 256, s).astype(np.uint8) for k, s in sizes.items()} | {6: rng.integers(0, 65536, (18, 19, 1)).astype("<u2")}


def planes_of(df, key="v"):
    out = {}
    for r in df.collect():
        out.setdefault((r["frame_id"], r["ch"]), {})[r["r"], r["c"]] = r[key]
    return {k: np.array([[v[r, c] for c in range(max(c for _, c in v) + 1)] for r in range(max(r for r, _ in v) + 1)]) for k, v in out.items()}


STEPS = {
    "laplacian": ([tiles.stencil(grid.LAPLACIAN)], planes.stencil(grid.LAPLACIAN)),
    "gaussian": ([tiles.gaussian(1.5)], planes.gaussian(1.5)),
    "opening": ([(0, planes.above(120)), tiles.box(planes.opening, 5, 2, 2)], lambda p: planes.opening(5, 2)(planes.above(120)(p))),
    "two": ([tiles.stencil(grid.SOBEL_X), tiles.box(planes.dilate, 3, 4)], lambda p: planes.dilate(3, 4)(planes.stencil(grid.SOBEL_X)(p))),
}


@pytest.mark.parametrize("name", STEPS)
@pytest.mark.parametrize("side", [(8, 8), (3, 5), (64, 64)])
def test_tiles_equal_whole_planes(spark, images, name, side):
    steps, whole = STEPS[name]
    out = tiles.apply(tiles.split(frames(spark, images), side), *steps, side=side)
    got = planes_of(tiles.pixels(out, side, "double"))
    want = {(k, ch): whole(im[:, :, ch].astype(np.int64)) for k, im in images.items() for ch in range(im.shape[2])}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], atol=1e-9) for k in want)


def test_one_exchange(spark, images):
    plan = tiles.apply(tiles.split(frames(spark, images), (8, 8)), tiles.gaussian(1.0), side=(8, 8))._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange ") == 1


@pytest.mark.parametrize("limit", [64_000_000, 20_000])
def test_flat_field_and_its_use(spark, monkeypatch, limit):
    monkeypatch.setattr(tiles, "COUNT_BYTES", limit)
    rng = np.random.default_rng(8)
    images = {k: rng.integers(0, 30, (11, 13, 2)).astype(np.uint8) for k in range(9)} | {9: rng.integers(200, 256, (6, 13, 2)).astype(np.uint8)}
    rows = tiles.split(frames(spark, images).repartition(3), (4, 6))
    flat = tiles.flat_field(rows, (4, 6)).cache()
    got = {(r["ch"], r["r"], r["c"]): r["flat"] for r in tiles.flat_pixels(flat, (4, 6)).collect()}
    want = {(ch, r, c): float(np.median([im[r, c, ch] for im in images.values() if r < im.shape[0]])) for ch in range(2) for r in range(11) for c in range(13)}
    assert got == want
    mean = np.mean([max(v, 1.0) for v in want.values()])
    even = planes_of(tiles.pixels(tiles.apply_flat(rows, flat, (4, 6)), (4, 6), "double"))
    assert all(np.allclose(v, [[images[k][r, c, ch] / max(want[ch, r, c], 1.0) * mean for c in range(v.shape[1])] for r in range(v.shape[0])]) for (k, ch), v in even.items())


def test_stretch_and_temporal_mean(spark):
    rng = np.random.default_rng(9)
    images = {k: rng.integers(10, 100 + k, (9, 10, 1)).astype(np.uint8) for k in range(7)} | {7: np.full((9, 10, 1), 60, np.uint8)}
    df = frames(spark, images)
    got = planes_of(tiles.pixels(tiles.global_stretch(tiles.split(df, (4, 4)), (4, 4)), (4, 4)))
    for (k, _), v in got.items():
        p = images[k][:, :, 0].astype(float)
        assert np.array_equal(v, np.floor((p - p.min()) / (p.max() - p.min()) * 255) if p.max() > p.min() else p)
    rows = tiles.split(df.selectExpr("*", "frame_id % 2 AS camera", "frame_id DIV 2 AS n").repartition(3), (4, 4))
    for size in (4096, 3):
        mean = planes_of(tiles.pixels(tiles.temporal_average(rows, 3, (4, 4), size=size), (4, 4)))
        for (k, _), v in mean.items():
            assert np.array_equal(v, np.floor(np.mean([images[j][:, :, 0] for j in range(k, max(k - 6, -1), -2)], axis=0)))


def test_equalise_equals_the_long_form(spark):
    rng = np.random.default_rng(10)
    images = {k: rng.integers(0, 256, (16, 24, 1)).astype(np.uint8) // (k + 1) for k in range(3)}
    got = planes_of(tiles.pixels(tiles.equalise(frames(spark, images), (8, 6), 3.0), (8, 6)))
    long = spark.createDataFrame([(k, int(r), int(c), int(v)) for k, im in images.items() for (r, c), v in np.ndenumerate(im[:, :, 0])], "frame_id long, r int, c int, v int")
    want = {}
    for r in grid.tile_equalise(long, (16, 24), (2, 4), 3.0).collect():
        want.setdefault((r["frame_id"], 0), np.zeros((16, 24), int))[r["r"], r["c"]] = r["v"]
    assert all(np.array_equal(got[k], want[k]) for k in want)


def test_no_frames(spark):
    none = tiles.split(frames(spark, {1: np.zeros((2, 2, 1), np.uint8)}).limit(0), (8, 8))
    assert none.count() == 0 and tiles.apply(none, tiles.gaussian(1.0), side=(8, 8)).count() == 0 and tiles.flat_field(none, (8, 8)).count() == 0
