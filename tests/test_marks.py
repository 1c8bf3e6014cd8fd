"""Marks: components across tile borders, suppression, rotation and thresholds against plain loops."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from scanlake.operators import grid, marks
from scanlake.plans import marks_catalogue


def as_rows(spark, masks):
    data = [(k, r, c, int(v)) for k, m in masks.items() for (r, c), v in np.ndenumerate(m)]
    return spark.createDataFrame(data, "frame_id long, r int, c int, v int")


def flood(mask, connectivity):
    label = {}
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (connectivity == 8 or not (a and b))]
    for r, c in zip(*np.nonzero(mask)):
        if (r, c) in label:
            continue
        code, todo = int(r) * (1 << 20) + int(c), [(r, c)]
        label[(r, c)] = code
        while todo:
            y, x = todo.pop()
            for dy, dx in steps:
                p = (y + dy, x + dx)
                if 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p] and p not in label:
                    label[p] = code
                    todo.append(p)
    return label


def snake(n):
    m = np.zeros((n, n), int)
    m[::2] = 1
    for k, r in enumerate(range(1, n - 1, 2)):
        m[r, -1 if k % 2 == 0 else 0] = 1
    return m


def spiral(n):
    """One line that winds from the corner to the centre, with a gap of one pixel between its turns."""
    m = np.zeros((n, n), int)
    r, c, dr, dc = 0, 0, 0, 1
    m[0, 0] = 1
    while True:
        for _ in range(2):
            ahead, after = (r + dr, c + dc), (r + 2 * dr, c + 2 * dc)
            if all(0 <= v < n for v in ahead) and not (all(0 <= v < n for v in after) and m[after]) and not m[ahead]:
                break
            dr, dc = dc, -dr
        else:
            return m
        r, c = ahead
        m[r, c] = 1


@pytest.mark.parametrize("fan,size", [(2, None), (2, (32, 32)), (4, None), (16, (32, 32))])
def test_components_of_a_spiral_over_many_tiles(spark, fan, size):
    masks = {1: spiral(32), 2: np.random.default_rng(3).integers(0, 2, (32, 32)), 3: spiral(31)}
    for connectivity in (4, 8):
        got = {k: {} for k in masks}
        for row in marks.label_components(as_rows(spark, masks), connectivity=connectivity, tile=2, size=size, fan=fan).collect():
            got[row["frame_id"]][(row["r"], row["c"])] = row["label"]
        assert got == {k: flood(m, connectivity) for k, m in masks.items()}
    assert set(flood(masks[1], 4).values()) == {0} and marks._levels((32, 32), 2, 2) == 4


@pytest.mark.parametrize("tile,connectivity", [(5, 8), (4, 4), (64, 8)])
def test_components(spark, tile, connectivity):
    rng = np.random.default_rng(6)
    masks = {k: (rng.random((13, 17)) < p).astype(int) for k, p in enumerate((0.2, 0.45, 0.6))}
    masks[10] = snake(17)
    masks[11] = np.zeros((4, 4), int)
    got = marks.label_components(as_rows(spark, masks), connectivity=connectivity, tile=tile).collect()
    seen = {}
    for row in got:
        seen.setdefault(row["frame_id"], {})[(row["r"], row["c"])] = row["label"]
    assert seen == {k: flood(m, connectivity) for k, m in masks.items() if m.any()}


def test_component_boxes_and_centres(spark):
    m = np.zeros((12, 20), int)
    m[2:5, 3:9] = 255
    m[8, 15] = 255
    stats = marks.components(as_rows(spark, {1: m}), tile=4)
    box = {(r["left"], r["top"], r["width"], r["height"], r["area"]) for r in stats.collect()}
    assert box == {(3, 2, 6, 3, 18), (15, 8, 1, 1, 1)}
    assert {(r["x"], r["y"]) for r in marks.box_centres(stats).collect()} == {(6, 3), (15, 8)}
    assert [(r["x"], r["y"]) for r in marks.moment_centres(stats, 10).collect()] == [(5, 3)]
    listed = spark.createDataFrame([(1,), (2,)], "frame_id long")
    assert {r["frame_id"]: (r["x"], r["y"]) for r in marks.largest_centre(stats, listed, m.shape).collect()} == {1: (6, 3), 2: (10, 6)}


def test_mark_like(spark):
    data = [(1, 1, 10, 10, 60), (1, 2, 1, 10, 10), (1, 3, 10, 60, 300), (1, 4, 20, 4, 80), (1, 5, 20, 20, 19), (1, 6, 14, 4, 50)]
    df = spark.createDataFrame(data, "frame_id long, label long, width int, height int, area int")
    assert sorted(r["label"] for r in marks.mark_like(df, (200, 100)).collect()) == [1, 6]


def greedy(points, radius):
    kept = []
    for _, x, y in sorted(points):
        if all(abs(x - a) > radius or abs(y - b) > radius for a, b in kept):
            kept.append((x, y))
    return kept


def test_suppress_near_with_a_hot_frame(spark):
    rnd = random.Random(2)
    points = {k: [(i, rnd.randint(0, 200), rnd.randint(0, 150)) for i in range(rnd.randint(1, 40))] for k in range(30)}
    points[99] = [(i, rnd.randint(0, 60), rnd.randint(0, 60)) for i in range(4000)]  # many candidates on the same pixels
    df = spark.createDataFrame([(k, *p) for k, ps in points.items() for p in ps], "frame_id long, id long, x int, y int")
    got = {}
    for r in marks.suppress_near(df).collect():
        got.setdefault(r["frame_id"], set()).add((r["x"], r["y"]))
    assert got == {k: set(greedy(ps, 20)) for k, ps in points.items()}


def test_suppress_near_in_a_wide_frame(spark):
    rnd = random.Random(4)
    points = [(i, rnd.randint(0, 1500), rnd.randint(0, 1000)) for i in range(5000)]
    got = {(r["x"], r["y"]) for r in marks.suppress_near(spark.createDataFrame([(1, *p) for p in points], "frame_id long, id long, x int, y int")).collect()}
    assert got == set(greedy(points, 20))


@pytest.mark.parametrize("tile", [marks.CELL_TILE, 4])
def test_suppress_near_along_chains(spark, tile):
    rnd = random.Random(7)
    chain = [(i, 15 * (i % 250), 300 * (i // 250) + 7 * (i % 3)) for i in range(5000)]
    back = [(5000 - i, x, y) for i, x, y in chain]
    mixed = [(rnd.randrange(10**6), x, y) for _, x, y in chain[:1500]]
    points = {1: chain, 2: back, 3: mixed, 4: [(1, 5, 5)]}
    df = spark.createDataFrame([(k, *p) for k, ps in points.items() for p in ps], "frame_id long, id long, x int, y int")
    for size in (None, (6000, 4000)):
        got = {k: set() for k in points}
        for r in marks.suppress_near(df, 20, size=size, tile=tile).collect():
            got[r["frame_id"]].add((r["id"], r["x"], r["y"]))
        assert {k: {(x, y) for _, x, y in v} for k, v in got.items()} == {k: set(greedy(ps, 20)) for k, ps in points.items()}
    assert marks.suppress_near(df.limit(0)).count() == 0 and marks.label_components(df.selectExpr("frame_id", "y AS r", "x AS c", "0 AS v")).count() == 0


def test_components_join_over_borders_and_refuse_wide_frames(spark):
    bar = spark.createDataFrame([(1, 0, c, 1) for c in range(12)], "frame_id long, r int, c int, v int")
    assert marks.components(bar, tile=8).count() == 1
    with pytest.raises(Exception, match="not below"):
        marks.components(bar.withColumn("c", F.col("c") + (1 << 20))).collect()


def test_grid_rotation(spark):
    turn = math.radians(17)
    centres = [(100 * a, 100 * b) for a in range(4) for b in range(3)]
    data = [(1, i, round(1000 + x * math.cos(turn) + y * math.sin(turn)), round(1000 - x * math.sin(turn) + y * math.cos(turn))) for i, (x, y) in enumerate(centres)]
    data.append((2, 0, 5, 5))
    reach = 150
    out = {r["frame_id"]: r["angle_deg"] for r in marks.grid_rotation(spark.createDataFrame(data, "frame_id long, id long, x int, y int"), reach).collect()}
    pts = [row[2:] for row in data if row[0] == 1]
    angles = [math.degrees(math.atan2(-(q[1] - p[1]), q[0] - p[0])) % 90 for i, p in enumerate(pts) for q in pts[i + 1 :] if max(abs(q[0] - p[0]), abs(q[1] - p[1])) <= reach]
    assert out[1] == pytest.approx(float(np.median(angles))) and out[2] is None


def clusters_of_points(seed):
    rnd = random.Random(seed)
    points = {k: [(rnd.randint(0, 9), rnd.randint(0, 400), rnd.randint(0, 300)) for _ in range(rnd.randint(1, 25))] for k in range(40)}
    points[50] = [(i // 2, rnd.randint(0, 400), rnd.randint(0, 300)) for i in range(3000)]
    points[51] = [(1, 5, 5), (2, 300, 5)]
    return points


def kept_brute(points):
    kept = []
    for p in sorted(set(points)):
        if all(abs(p[1] - q[1]) > 20 or abs(p[2] - q[2]) > 20 for q in kept):
            kept.append(p)
    return kept


def near_brute(points, reach):
    kept = kept_brute(points)
    return [(p, q) for i, p in enumerate(kept) for q in kept[i + 1 :] if max(abs(p[1] - q[1]), abs(p[2] - q[2])) <= reach]


@pytest.mark.parametrize("tile", [marks.CELL_TILE, 4])
def test_grid_rotation_of_small_and_large_frames(spark, tile):
    points = clusters_of_points(11)
    df = spark.createDataFrame([(k, *p) for k, ps in points.items() for p in ps], "frame_id long, id long, x int, y int")
    got = {r["frame_id"]: r["angle_deg"] for r in marks.grid_rotation(df, 60, size=(301, 401), tile=tile).collect()}
    angles = {k: [math.degrees(math.atan2(-(q[2] - p[2]), q[1] - p[1])) % 90 for p, q in near_brute(ps, 60)] for k, ps in points.items()}
    assert got == {k: pytest.approx(float(np.median(a))) if a else None for k, a in angles.items()} and got[51] is None


@pytest.mark.parametrize("size, tile", [((301, 401), marks.CELL_TILE), ((301, 401), 4), (None, marks.CELL_TILE)])
def test_kept_pairs(spark, size, tile):
    points = clusters_of_points(12)
    df = spark.createDataFrame([(k, *p) for k, ps in points.items() for p in ps], "frame_id long, id long, x int, y int")
    rows = marks.kept_pairs(df, 60, size=size, tile=tile)
    assert rows.columns == ["frame_id", "id_a", "x_a", "y_a", "id_b", "x_b", "y_b"]
    assert sorted(tuple(r) for r in rows.collect()) == sorted((k, *p, *q) for k, ps in points.items() for p, q in near_brute(ps, 60))
    assert marks.kept_pairs(df.limit(0), 60, size=size, tile=tile).count() == 0


def test_otsu(spark):
    rng = np.random.default_rng(0)
    images = {1: np.array([[10, 10, 200, 200]]), 2: rng.integers(0, 256, (9, 9)), 3: np.full((2, 2), 7)}
    got = {r["frame_id"]: r["threshold"] for r in marks.otsu_threshold(as_rows(spark, images)).collect()}

    def best(image):
        v, top = image.ravel(), (-1.0, None)
        for t in np.unique(v):
            low, high = v[v <= t], v[v > t]
            b = len(low) * len(high) * (low.mean() - high.mean()) ** 2 if len(high) else 0.0
            if b > top[0] + 1e-9:
                top = (b, t)
        return top[1]

    assert got == {k: best(v) for k, v in images.items()}


def test_digit_boxes(spark):
    df = spark.createDataFrame([(1, 0, 60, 80), (1, 1, 5, 5)], "frame_id long, id long, x int, y int")
    rows = {(r["id"], r["digit"]): (r["x0"], r["y0"], r["x1"], r["y1"]) for r in marks.digit_boxes(df, 850, (F.lit(120), F.lit(160))).collect()}
    assert rows[(0, "TL")] == (13, 12, 51, 72) and (1, "TL") not in rows and rows[(1, "BR")] == (13, 13, 52, 74)


@pytest.mark.parametrize("height", [40, 18, 16, 1])
def test_frames_cut_short_equalise_like_the_sql(spark, height):
    rng = np.random.default_rng(height)
    data = [(7, r, c, int(v)) for (r, c), v in np.ndenumerate(rng.integers(0, 256, (height, 64)) // 3)]
    got = grid.tile_equalise(spark.createDataFrame(data, "frame_id long, r int, c int, v int"), (40, 64), (5, 8), 4.0).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE src (frame_id BIGINT, r INT, c INT, v INT)")
    con.executemany("INSERT INTO src VALUES (?, ?, ?, ?)", data)
    want = con.execute(f"WITH {marks_catalogue._equal_sql('src', 'out', '4e0')} SELECT frame_id, r, c, v FROM out").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == height * 64
