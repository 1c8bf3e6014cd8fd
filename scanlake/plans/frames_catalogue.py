"""Queries on frames: metrics, colour, flat field and grid operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanlake.operators import frames, grid, ordered, pixels, planes, tiles
from scanlake.plans import tables
from scanlake.session import cut_lineage

C = F.col
LAYERS = [pixels.Layer("Monolayer", (120, 100, 90)), pixels.Layer("Bilayer", (160, 140, 130)), pixels.Layer("Trilayer", (60, 220, 200)), pixels.Layer("Background", None)]
STRETCH = 1.0471975511965976
_ROW = "(PARTITION BY frame_id, r ORDER BY c)"
_COL = "(PARTITION BY frame_id, c ORDER BY r)"


def in_steps(column):
    """A statistic of 64 whole numbers in its exact steps of 1/4096."""
    return (F.round(C(column) * 4096) / 4096).alias(column)


def _metric(name):
    def query(spark, sf_dir):
        return pixels.focus_metric(tables.frames(spark, sf_dir), name).select("frame_id", in_steps("metric"))

    return query


def _packed_metric(name, shrink=1):
    def query(spark, sf_dir):
        out = frames.frame_metric(tables.packed_frames(spark, sf_dir), name, shrink)
        return out.select("frame_id", in_steps("metric"))

    return query


# neighbours of a pixel with the border mirrored
_NEAR = f"""nb AS (SELECT *, coalesce(lag(v) OVER rw, lead(v) OVER rw) AS l, coalesce(lead(v) OVER rw, lag(v) OVER rw) AS rt FROM fx_frames WINDOW rw AS {_ROW}),
st AS (SELECT *, coalesce(lag(v) OVER cw, lead(v) OVER cw) + coalesce(lead(v) OVER cw, lag(v) OVER cw) + l + rt - 4 * v AS lap,
  coalesce(lag(rt - l) OVER cw, lead(rt - l) OVER cw) + 2 * (rt - l) + coalesce(lead(rt - l) OVER cw, lag(rt - l) OVER cw) AS gx,
  coalesce(lead(l + 2 * v + rt) OVER cw, lag(l + 2 * v + rt) OVER cw) - coalesce(lag(l + 2 * v + rt) OVER cw, lead(l + 2 * v + rt) OVER cw) AS gy
  FROM nb WINDOW cw AS {_COL})"""
_METRIC_SQL = {
    "LaplacianVariance": tables.sql("SELECT frame_id, round(var_pop(lap) * 4096) / 4096 AS metric FROM st GROUP BY 1", "fx_frames", extra=_NEAR),
    "Tenengrad": tables.sql("SELECT frame_id, round(avg(gx * gx + gy * gy) * 4096) / 4096 AS metric FROM st GROUP BY 1", "fx_frames", extra=_NEAR),
    "Brightness": tables.sql("SELECT frame_id, round(avg(v) * 4096) / 4096 AS metric FROM fx_frames GROUP BY 1", "fx_frames"),
    "ImageVariance": tables.sql("SELECT frame_id, round(var_pop(v) * 4096) / 4096 AS metric FROM fx_frames GROUP BY 1", "fx_frames"),
}


def stencil(spark, sf_dir):
    out = grid.stencil(tables.frames(spark, sf_dir), {"lap": grid.LAPLACIAN, "gx": grid.SOBEL_X, "gy": grid.SOBEL_Y})
    return out.select("frame_id", "r", "c", *[C(k).cast("long").alias(k) for k in ("lap", "gx", "gy")])


def roi_stats(spark, sf_dir):
    out = pixels.roi_stats(tables.rgb(spark, sf_dir), (8, 8), 2)
    flat = F.array_join(F.transform("pixels", lambda e: F.concat_ws(",", e["blue"].cast("string"), e["green"].cast("string"), e["red"].cast("string"))), ";")
    return out.select("frame_id", F.round("mean_intensity", 6).alias("mean_intensity"), F.round("centre_intensity", 6).alias("centre_intensity"), flat.alias("pixels"))


def pick_colour(spark, sf_dir):
    return pixels.pick_colour(tables.rgb(spark, sf_dir), 3, 6)


def flat_field(spark, sf_dir):
    return pixels.flat_field(pixels.channels_long(tables.rgb(spark, sf_dir)))


def mode_colour(spark, sf_dir):
    return pixels.mode_colour(tables.rgb(spark, sf_dir))


def mode_colour_thin(spark, sf_dir):
    return pixels.mode_colour(tables.rgb(spark, sf_dir), 4)


def colour_mask(spark, sf_dir):
    return pixels.colour_mask(tables.rgb(spark, sf_dir), LAYERS, 40)


def _corrected(spark, sf_dir):
    rows = pixels.channels_long(tables.rgb(spark, sf_dir))
    return pixels.apply_flat(rows, cut_lineage(pixels.flat_field(rows)))


def apply_flat(spark, sf_dir):
    # stretched so that no value sits on a rounding tie
    return _corrected(spark, sf_dir).select("frame_id", "r", "c", "ch", F.round(C("v") * STRETCH, 6).alias("v"))


def global_stretch(spark, sf_dir):
    return pixels.global_stretch(pixels.channels_long(tables.rgb(spark, sf_dir)))


def temporal_average(spark, sf_dir):
    order = tables.load(spark, sf_dir, "embeddings").select("vec_id", C("label").alias("camera"))
    order = ordered.dense_index(order, ["camera"], ["vec_id"], ordered.index_slice(C("vec_id")), "n")
    rows = tables.frames(spark, sf_dir).join(order.withColumnRenamed("vec_id", "frame_id"), "frame_id")
    return pixels.temporal_average(rows, 4).select("frame_id", "r", "c", "avg_v")


def downsample(spark, sf_dir):
    return grid.downsample(tables.frames(spark, sf_dir), 2)


def nearest(spark, sf_dir):
    return grid.resample_nearest(tables.frames(spark, sf_dir), (8, 8), (12, 5))


def bilinear(spark, sf_dir):
    out = grid.resample_bilinear(tables.frames(spark, sf_dir), (8, 8), (12, 5))
    return out.select("frame_id", "r", "c", F.round("v", 5).alias("v"))


def gaussian(spark, sf_dir):
    out = grid.gaussian_blur(tables.frames(spark, sf_dir), 1.0, floor=1.0)
    return out.select("frame_id", "r", "c", F.round("v", 5).alias("v"))


def _mask(spark, sf_dir):
    return tables.frames(spark, sf_dir).select("frame_id", "r", "c", F.when(C("v") > 120, 255).otherwise(0).alias("v"))


_MASK = "mk AS (SELECT frame_id, r, c, CASE WHEN v > 120 THEN 255 ELSE 0 END AS v FROM fx_frames)"


def slide_sql(src: str, out: str, agg: str, kh: int, kw: int) -> str:
    """Two tables that slide ``agg`` along rows, then columns."""
    def box(k):
        return f"ROWS BETWEEN {k // 2} PRECEDING AND {k - 1 - k // 2} FOLLOWING"

    return (
        f"{out}_h AS (SELECT frame_id, r, c, {agg}(v) OVER (PARTITION BY frame_id, r ORDER BY c {box(kw)}) AS v FROM {src}), "
        f"{out} AS (SELECT frame_id, r, c, {agg}(v) OVER (PARTITION BY frame_id, c ORDER BY r {box(kh)}) AS v FROM {out}_h)"
    )


def dilate(spark, sf_dir):
    return grid.dilate(_mask(spark, sf_dir), 3, 4)


def opening(spark, sf_dir):
    return grid.opening(_mask(spark, sf_dir))


def crossings(spark, sf_dir):
    return grid.line_crossings(grid.invert(_mask(spark, sf_dir)), 3, 3)


_CROSS = ", ".join(
    [
        _MASK, "iv AS (SELECT frame_id, r, c, 255 - v AS v FROM mk)", slide_sql("iv", "he", "min", 1, 3), slide_sql("he", "ho", "max", 1, 3),
        slide_sql("iv", "ve", "min", 3, 1), slide_sql("ve", "vo", "max", 3, 1),
        "an AS (SELECT ho.frame_id, ho.r, ho.c, least(ho.v, vo.v) AS v FROM ho JOIN vo USING (frame_id, r, c))", slide_sql("an", "dl", "max", 3, 3),
    ]
)


def outline(spark, sf_dir):
    return grid.mask_outline(_mask(spark, sf_dir))


def outer_outline(spark, sf_dir):
    return grid.outer_outline(_mask(spark, sf_dir), size=(8, 8)).select("frame_id", "r", "c", "v")


_OUTER = (
    _MASK
    + """, open_px AS (SELECT frame_id, r, c FROM mk WHERE v = 0 AND (r IN (0, 7) OR c IN (0, 7))
  UNION SELECT m.frame_id, m.r, m.c FROM open_px o JOIN mk m ON m.frame_id = o.frame_id AND m.v = 0 AND abs(m.r - o.r) + abs(m.c - o.c) = 1)"""
)


def layer_outlines(spark, sf_dir):
    rows = tables.mosaic(spark, sf_dir).selectExpr("frame_id", "r", "c", "v AS blue", "v AS green", "v AS red")
    return pixels.layer_outlines(rows, [pixels.Layer("Mid", (120, 120, 120))], 50, size=(64, 64))


_LAYERS = ", ".join(
    [
        """mo AS (SELECT frame_id, q * 8 + 4 AS m FROM (SELECT frame_id, v >> 3 AS q, row_number() OVER (PARTITION BY frame_id ORDER BY count(*) DESC, v >> 3) AS k FROM fx_mosaic GROUP BY 1, 2) WHERE k = 1)""",
        """mk AS (SELECT frame_id * 2 + k AS frame_id, r, c, CASE WHEN abs(v - CASE WHEN k = 0 THEN m ELSE 120 END) <= 50 THEN 255 ELSE 0 END AS v FROM fx_mosaic JOIN mo USING (frame_id) CROSS JOIN (VALUES (0), (1)) AS t(k))""",
        slide_sql("mk", "er", "min", 3, 3), slide_sql("er", "op", "max", 3, 3),
        "sz AS (SELECT frame_id, max(r) AS r1 FROM op GROUP BY 1)",
        """open_px AS (SELECT frame_id, r, c FROM op JOIN sz USING (frame_id) WHERE v = 0 AND (r IN (0, r1) OR c IN (0, 63))
  UNION SELECT m.frame_id, m.r, m.c FROM open_px o JOIN op m ON m.frame_id = o.frame_id AND m.v = 0 AND abs(m.r - o.r) + abs(m.c - o.c) = 1)""",
    ]
)


def _planes(*steps, kind="int", source=tables.packed_mosaic, digits=None):
    def query(spark, sf_dir):
        out = planes.plane_pixels(planes.plane_fn(source(spark, sf_dir), *steps), kind)
        return out if digits is None else out.withColumn("v", F.round("v", digits))

    return query


def _on_mosaic(body, *extra):
    return tables.sql(body, "fx_mosaic", extra=", ".join(extra).replace("fx_frames", "fx_mosaic") or None)


def tile_equalise(spark, sf_dir):
    return grid.tile_equalise(tables.frames(spark, sf_dir), (8, 8), (2, 2), 40.0)


EQUALISE = """hs AS (SELECT frame_id, r // 4 AS tr, c // 4 AS tc, v AS b, count(*) AS n FROM fx_frames GROUP BY ALL),
kp AS (SELECT *, least(n, greatest(1, 40e0 * 16 / 256)) AS kept FROM hs),
ex AS (SELECT frame_id, tr, tc, sum(n - kept) AS excess FROM kp GROUP BY ALL),
cn AS (SELECT frame_id, r, c, v AS b, (r + 5e-1) / 4 - 5e-1 AS pr, (c + 5e-1) / 4 - 5e-1 AS pc FROM fx_frames),
bl AS (SELECT frame_id, r, c, b, CAST(least(1, greatest(0, floor(pr) + dr)) AS BIGINT) AS tr, CAST(least(1, greatest(0, floor(pc) + dc)) AS BIGINT) AS tc,
  CASE WHEN dr = 1 THEN pr - floor(pr) ELSE 1 - (pr - floor(pr)) END * CASE WHEN dc = 1 THEN pc - floor(pc) ELSE 1 - (pc - floor(pc)) END AS w
  FROM cn, (SELECT unnest([0, 1]) AS dr), (SELECT unnest([0, 1]) AS dc)),
mp AS (SELECT bl.frame_id, r, c, w, (coalesce((SELECT sum(kept) FROM kp WHERE kp.frame_id = bl.frame_id AND kp.tr = bl.tr AND kp.tc = bl.tc AND kp.b <= bl.b), 0)
  + excess * (bl.b + 1) / 256e0) * 255 / 16 AS m FROM bl JOIN ex USING (frame_id, tr, tc)),
eq AS (SELECT frame_id, r, c, CAST(round_even(least(255, greatest(0, sum(w * m))), 0) AS INT) AS v FROM mp GROUP BY 1, 2, 3)"""


def rotate(spark, sf_dir):
    return grid.rotate(tables.frames(spark, sf_dir), 30.0, (8, 8))


def explode_pixels(spark, sf_dir):
    return frames.explode_pixels(tables.packed_frames(spark, sf_dir))


def frame_fn(spark, sf_dir):
    spread = frames.frame_fn(tables.packed_frames(spark, sf_dir), lambda image: float(image.max()) - float(image.min()), "spread")
    return spread


def register_metric(spark, sf_dir):
    pixels.register_metric("Range", lambda px: px.groupBy("frame_id").agg((F.max("v") - F.min("v")).cast("double").alias("metric")))
    return pixels.focus_metric(tables.frames(spark, sf_dir), "Range")


_LONG = "ch3 AS (SELECT frame_id, r, c, CAST(unnest([0, 1, 2]) AS INT) AS ch, unnest([blue, green, red]) AS v FROM fx_rgb)"
_FLAT = _LONG + ", fl AS (SELECT r, c, ch, median(v) AS flat FROM ch3 GROUP BY ALL)"
_MODE = """SELECT frame_id, CAST(((code >> 16) & 31) * 8 + 4 AS INT) AS blue, CAST(((code >> 8) & 31) * 8 + 4 AS INT) AS green, CAST((code & 31) * 8 + 4 AS INT) AS red FROM (
SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY n DESC, code) AS k FROM (
SELECT frame_id, (CAST(blue AS INT) >> 3) * 65536 + (CAST(green AS INT) >> 3) * 256 + (CAST(red AS INT) >> 3) AS code, count(*) AS n FROM fx_rgb {where} GROUP BY ALL)) WHERE k = 1"""
_TAPS = ", ".join(repr(w) + "::DOUBLE" for w in grid.gaussian_weights(1.0))
_GAUSS = f"""tp AS (SELECT unnest([{_TAPS}]) AS w, unnest(range(9)) - 4 AS k),
g1 AS (SELECT f.frame_id, f.r, o.c, sum(w * f.v) AS v FROM (SELECT DISTINCT frame_id, r, c FROM fx_frames) o CROSS JOIN tp
  JOIN fx_frames f ON f.frame_id = o.frame_id AND f.r = o.r AND f.c = CASE WHEN ((o.c + k) % 14 + 14) % 14 > 7 THEN 14 - ((o.c + k) % 14 + 14) % 14 ELSE ((o.c + k) % 14 + 14) % 14 END GROUP BY 1, 2, 3),
g2 AS (SELECT f.frame_id, o.r, f.c, sum(w * f.v) AS v FROM (SELECT DISTINCT frame_id, r, c FROM fx_frames) o CROSS JOIN tp
  JOIN g1 f ON f.frame_id = o.frame_id AND f.c = o.c AND f.r = CASE WHEN ((o.r + k) % 14 + 14) % 14 > 7 THEN 14 - ((o.r + k) % 14 + 14) % 14 ELSE ((o.r + k) % 14 + 14) % 14 END GROUP BY 1, 2, 3)"""

SIDE = (16, 16)


def _tiled(*steps, kind="int", digits=None):
    """Planes of the mosaic, tile by tile."""
    def query(spark, sf_dir):
        out = tiles.pixels(tiles.apply(tiles.split(tables.packed_mosaic(spark, sf_dir), SIDE), *steps, side=SIDE), SIDE, kind, ("frame_id",))
        return out if digits is None else out.withColumn("v", F.round("v", digits))

    return query


def equalise_tiled(spark, sf_dir):
    return tiles.pixels(tiles.equalise(tables.packed_mosaic(spark, sf_dir), SIDE, 4.0), SIDE, keys=("frame_id",))


def _mosaic_tiles(spark, sf_dir):
    return tiles.split(tables.packed_mosaic(spark, sf_dir), SIDE)


def flat_field_tiled(spark, sf_dir):
    return tiles.flat_pixels(tiles.flat_field(_mosaic_tiles(spark, sf_dir), SIDE), SIDE)


def apply_flat_tiled(spark, sf_dir):
    rows = _mosaic_tiles(spark, sf_dir)
    out = tiles.apply_flat(rows, cut_lineage(tiles.flat_field(rows, SIDE)), SIDE)
    return tiles.pixels(out, SIDE, "double").withColumn("v", F.round(C("v") * STRETCH, 6))


def global_stretch_tiled(spark, sf_dir):
    return tiles.pixels(tiles.global_stretch(_mosaic_tiles(spark, sf_dir), SIDE), SIDE)


def temporal_average_tiled(spark, sf_dir):
    # two cameras in turn; complete frames and the short last one are told apart, as the frames of a camera are of one size
    whole = F.when(C("height") == 64, C("frame_id") % 2).otherwise(2)
    frames_ = tables.packed_mosaic(spark, sf_dir).withColumns({"camera": whole, "n": F.when(C("height") == 64, F.floor(C("frame_id") / 2)).otherwise(0)})
    return tiles.pixels(tiles.temporal_average(tiles.split(frames_, SIDE), 4, SIDE), SIDE, keys=("frame_id",)).withColumnRenamed("v", "avg_v")


# borders mirrored at the frame's own size
_MOSAIC_GAUSS = f"""tp AS (SELECT unnest([{_TAPS}]) AS w, unnest(range(9)) - 4 AS k),
hs AS (SELECT frame_id, max(r) AS r1 FROM fx_mosaic GROUP BY 1),
g1 AS (SELECT f.frame_id, f.r, o.c, sum(w * f.v) AS v FROM fx_mosaic o CROSS JOIN tp JOIN fx_mosaic f ON f.frame_id = o.frame_id AND f.r = o.r AND f.c = 63 - abs(63 - abs(o.c + k)) GROUP BY 1, 2, 3),
g2 AS (SELECT f.frame_id, o.r, f.c, sum(w * f.v) AS v FROM fx_mosaic o JOIN hs USING (frame_id) CROSS JOIN tp JOIN g1 f ON f.frame_id = o.frame_id AND f.c = o.c AND f.r = r1 - abs(r1 - abs(o.r + k)) GROUP BY 1, 2, 3)"""
_MOSAIC_EQUALISE = """hs AS (SELECT frame_id, r // 16 AS tr, c // 16 AS tc, v AS b, count(*) AS n FROM fx_mosaic GROUP BY ALL),
ar AS (SELECT frame_id, tr, tc, sum(n) AS area FROM hs GROUP BY ALL),
kp AS (SELECT hs.*, area, least(n, greatest(1, 4e0 * area / 256)) AS kept FROM hs JOIN ar USING (frame_id, tr, tc)),
ex AS (SELECT frame_id, tr, tc, area, sum(n - kept) AS excess FROM kp GROUP BY ALL),
lm AS (SELECT frame_id, max(tr) AS tr1 FROM ar GROUP BY 1),
cn AS (SELECT frame_id, r, c, v AS b, (r + 5e-1) / 16 - 5e-1 AS pr, (c + 5e-1) / 16 - 5e-1 AS pc FROM fx_mosaic),
bl AS (SELECT frame_id, r, c, b, CAST(least(tr1, greatest(0, floor(pr) + dr)) AS BIGINT) AS tr, CAST(least(3, greatest(0, floor(pc) + dc)) AS BIGINT) AS tc,
  CASE WHEN dr = 1 THEN pr - floor(pr) ELSE 1 - (pr - floor(pr)) END * CASE WHEN dc = 1 THEN pc - floor(pc) ELSE 1 - (pc - floor(pc)) END AS w
  FROM cn JOIN lm USING (frame_id), (SELECT unnest([0, 1]) AS dr), (SELECT unnest([0, 1]) AS dc)),
lv AS (SELECT frame_id, tr, tc, b AS level, sum(kept) OVER (PARTITION BY frame_id, tr, tc ORDER BY b) AS upto, coalesce(lead(b) OVER (PARTITION BY frame_id, tr, tc ORDER BY b), 256) AS above FROM kp),
mp AS (SELECT bl.frame_id, r, c, w, (coalesce(upto, 0) + excess * (bl.b + 1) / 256e0) * 255 / area AS m FROM bl JOIN ex USING (frame_id, tr, tc)
  LEFT JOIN lv ON lv.frame_id = bl.frame_id AND lv.tr = bl.tr AND lv.tc = bl.tc AND bl.b >= level AND bl.b < above),
eq AS (SELECT frame_id, r, c, CAST(round_even(least(255, greatest(0, sum(w * m))), 0) AS INT) AS v FROM mp GROUP BY 1, 2, 3)"""
_MOSAIC_FLAT = "fl AS (SELECT r, c, median(v) AS flat FROM fx_mosaic GROUP BY ALL)"

QUERIES = {
    "gr2_laplacian_tiled": (_tiled(tiles.stencil(grid.LAPLACIAN), kind="bigint"), _on_mosaic("SELECT frame_id, r, c, CAST(lap AS BIGINT) AS v FROM st", _NEAR)),
    "gr3_gaussian_blur_tiled": (
        _tiled(tiles.gaussian(1.0), (0, lambda plane: plane.clip(1.0)), kind="double", digits=5),
        tables.sql("SELECT frame_id, r, c, round(greatest(1, v), 5) AS v FROM g2", "fx_mosaic", extra=_MOSAIC_GAUSS),
    ),
    "gr4_opening_tiled": (
        _tiled((0, planes.above(120)), tiles.box(planes.opening, 3, 3, 2)), _on_mosaic("SELECT frame_id, r, c, v FROM op", _MASK, slide_sql("mk", "er", "min", 3, 3), slide_sql("er", "op", "max", 3, 3)),
    ),
    "gr4_dilate_tiled": (_tiled((0, planes.above(120)), tiles.box(planes.dilate, 3, 4)), _on_mosaic("SELECT frame_id, r, c, v FROM dl", _MASK, slide_sql("mk", "dl", "max", 3, 4))),
    "gr7_tile_equalise_tiled": (equalise_tiled, tables.sql("SELECT frame_id, r, c, v FROM eq", "fx_mosaic", extra=_MOSAIC_EQUALISE)),
    "ag6_flat_field_tiled": (flat_field_tiled, tables.sql("SELECT CAST(0 AS INT) AS ch, r, c, CAST(flat AS DOUBLE) AS flat FROM fl", "fx_mosaic", extra=_MOSAIC_FLAT)),
    "jn4_apply_flat_tiled": (
        apply_flat_tiled,
        tables.sql(
            "SELECT frame_id, CAST(0 AS INT) AS ch, r, c, round(v / greatest(flat, 1) * (SELECT avg(greatest(flat, 1)) FROM fl) * 10471975511965976e-16, 6) AS v FROM fx_mosaic JOIN fl USING (r, c)",
            "fx_mosaic", extra=_MOSAIC_FLAT,
        ),
    ),
    "ag14_global_stretch_tiled": (
        global_stretch_tiled,
        tables.sql(
            """SELECT frame_id, CAST(0 AS INT) AS ch, r, c, CAST(floor(least(255e0, greatest(0e0, CASE WHEN hi > lo THEN (v - lo) / CAST(hi - lo AS DOUBLE) * 255 ELSE v END))) AS INT) AS v
            FROM fx_mosaic JOIN (SELECT frame_id, min(v) AS lo, max(v) AS hi FROM fx_mosaic GROUP BY 1) USING (frame_id)""", "fx_mosaic",
        ),
    ),
    "wn1_temporal_average_tiled": (
        temporal_average_tiled,
        tables.sql(
            """SELECT frame_id, r, c, CAST(floor(avg(v) OVER (PARTITION BY camera, r, c ORDER BY frame_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) AS INT) AS avg_v
            FROM (SELECT *, CASE WHEN max(r) OVER (PARTITION BY frame_id) = 63 THEN frame_id % 2 ELSE 2 END AS camera FROM fx_mosaic)""", "fx_mosaic",
        ),
    ),
    **{f"ag4_{name.lower()}": (_metric(name), _METRIC_SQL[name]) for name in _METRIC_SQL},
    **{f"ag4_packed_{name.lower()}": (_packed_metric(name), _METRIC_SQL[name]) for name in _METRIC_SQL},
    "ag4_packed_shrunk": (
        _packed_metric("ImageVariance", 2),
        tables.sql("SELECT frame_id, round(var_pop(v) * 4096) / 4096 AS metric FROM (SELECT frame_id, avg(v) AS v FROM fx_frames GROUP BY frame_id, r // 2, c // 2) GROUP BY 1", "fx_frames"),
    ),
    "gr2_stencil": (stencil, tables.sql("SELECT frame_id, r, c, CAST(lap AS BIGINT) AS lap, CAST(gx AS BIGINT) AS gx, CAST(gy AS BIGINT) AS gy FROM st", "fx_frames", extra=_NEAR)),
    "ag2_roi_stats": (
        roi_stats,
        tables.sql(
            """SELECT frame_id, round(avg((blue + green + red) / 3e0), 6) AS mean_intensity, round(max(CASE WHEN r = 4 AND c = 4 THEN (blue + green + red) / 3e0 END), 6) AS centre_intensity,
            string_agg(concat_ws(',', blue, green, red), ';' ORDER BY r, c) AS pixels FROM fx_rgb WHERE r BETWEEN 2 AND 6 AND c BETWEEN 2 AND 6 GROUP BY 1""", "fx_rgb",
        ),
    ),
    "ag3_pick_colour": (
        pick_colour,
        tables.sql(
            "SELECT frame_id, CAST(floor(avg(blue)) AS INT) AS blue, CAST(floor(avg(green)) AS INT) AS green, CAST(floor(avg(red)) AS INT) AS red FROM fx_rgb WHERE r BETWEEN 1 AND 5 AND c BETWEEN 4 AND 8 GROUP BY 1",
            "fx_rgb",
        ),
    ),
    "ag6_flat_field": (flat_field, tables.sql("SELECT * FROM fl", "fx_rgb", extra=_FLAT)),
    "ag7_mode_colour_thinned": (mode_colour_thin, tables.sql(_MODE.format(where="WHERE r % 4 = 0 AND c % 4 = 0"), "fx_rgb")),
    "ag7_mode_colour": (mode_colour, tables.sql(_MODE.format(where=""), "fx_rgb")),
    "fl4_colour_mask": (
        colour_mask,
        tables.sql(
            "SELECT frame_id, r, c, layer FROM fx_rgb p CROSS JOIN fx_layers l WHERE greatest(abs(p.red - l.red), abs(p.green - l.green), abs(p.blue - l.blue)) <= 40", "fx_rgb", "fx_layers"
        ),
    ),
    "jn4_apply_flat": (
        apply_flat,
        tables.sql(
            "SELECT frame_id, r, c, ch, round(v / greatest(flat, 1) * (SELECT avg(greatest(flat, 1)) FROM fl) * 10471975511965976e-16, 6) AS v FROM ch3 JOIN fl USING (r, c, ch)", "fx_rgb", extra=_FLAT
        ),
    ),
    "ag14_global_stretch": (
        global_stretch,
        tables.sql(
            """SELECT frame_id, r, c, ch, CAST(floor(least(255e0, greatest(0e0, CASE WHEN hi > lo THEN (v - lo) / CAST(hi - lo AS DOUBLE) * 255 ELSE v END))) AS INT) AS v
            FROM ch3 JOIN (SELECT frame_id, min(v) AS lo, max(v) AS hi FROM ch3 GROUP BY 1) USING (frame_id)""", "fx_rgb", extra=_LONG,
        ),
    ),
    "wn1_temporal_average": (
        temporal_average,
        tables.sql(
            """SELECT frame_id, r, c, CAST(floor(avg(v) OVER (PARTITION BY label, r, c ORDER BY frame_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) AS INT) AS avg_v
            FROM fx_frames JOIN embeddings e ON e.vec_id = frame_id""", "fx_frames",
        ),
    ),
    "gr1_downsample": (downsample, tables.sql("SELECT frame_id, r // 2 AS r, c // 2 AS c, avg(v) AS v FROM fx_frames GROUP BY 1, 2, 3", "fx_frames")),
    "gr1_nearest": (
        nearest,
        tables.sql(
            """SELECT frame_id, CAST(orr AS INT) AS r, CAST(oc AS INT) AS c, v FROM (SELECT unnest(range(12)) AS orr), (SELECT unnest(range(5)) AS oc), fx_frames f
            WHERE f.r = (orr * 8) // 12 AND f.c = (oc * 8) // 5""", "fx_frames",
        ),
    ),
    "gr1_bilinear": (
        bilinear,
        tables.sql(
            """SELECT frame_id, CAST(orr AS INT) AS r, CAST(oc AS INT) AS c, round(sum(greatest(0, 1 - abs(pr - f.r)) * greatest(0, 1 - abs(pc - f.c)) * v), 5) AS v FROM (
            SELECT orr, oc, greatest(0e0, least(7e0, (orr + 5e-1) * 8 / 12 - 5e-1)) AS pr, greatest(0e0, least(7e0, (oc + 5e-1) * 8 / 5 - 5e-1)) AS pc
            FROM (SELECT unnest(range(12)) AS orr), (SELECT unnest(range(5)) AS oc)) o JOIN fx_frames f ON abs(pr - f.r) < 1 AND abs(pc - f.c) < 1 GROUP BY 1, 2, 3""", "fx_frames",
        ),
    ),
    "gr3_gaussian_blur": (gaussian, tables.sql("SELECT frame_id, r, c, round(greatest(1, v), 5) AS v FROM g2", "fx_frames", extra=_GAUSS)),
    "gr1_downsample_packed": (
        _planes(planes.downsample(5), kind="double", digits=9), _on_mosaic("SELECT frame_id, r // 5 AS r, c // 5 AS c, round(avg(v), 9) AS v FROM fx_mosaic GROUP BY 1, 2, 3"),
    ),
    "gr2_laplacian_packed": (_planes(planes.stencil(grid.LAPLACIAN), kind="bigint"), _on_mosaic("SELECT frame_id, r, c, CAST(lap AS BIGINT) AS v FROM st", _NEAR)),
    "gr3_gaussian_blur_packed": (
        _planes(planes.gaussian(1.0), lambda plane: plane.clip(1.0), kind="double", source=tables.packed_frames, digits=5),
        tables.sql("SELECT frame_id, r, c, round(greatest(1, v), 5) AS v FROM g2", "fx_frames", extra=_GAUSS),
    ),
    "gr4_opening_packed": (
        _planes(planes.above(120), planes.opening()), _on_mosaic("SELECT frame_id, r, c, v FROM op", _MASK, slide_sql("mk", "er", "min", 3, 3), slide_sql("er", "op", "max", 3, 3)),
    ),
    "gr4_dilate_packed": (_planes(planes.above(120), planes.dilate(3, 4)), _on_mosaic("SELECT frame_id, r, c, v FROM dl", _MASK, slide_sql("mk", "dl", "max", 3, 4))),
    "ag16_binarise_packed": (
        _planes(planes.otsu), _on_mosaic(
            """SELECT frame_id, r, c, CASE WHEN v > threshold THEN 255 ELSE 0 END AS v FROM fx_mosaic JOIN (SELECT frame_id, t AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY
            CASE WHEN w > w0 THEN (s * w0 - w * s0) * (s * w0 - w * s0) / (w0 * (w - w0)) ELSE 0 END DESC, t) AS k FROM (
            SELECT frame_id, t, sum(n) OVER u AS w0, sum(n * t) OVER u AS s0, sum(n) OVER (PARTITION BY frame_id) AS w, sum(n * t) OVER (PARTITION BY frame_id) AS s
            FROM (SELECT frame_id, v AS t, CAST(count(*) AS DOUBLE) AS n FROM fx_mosaic GROUP BY ALL) WINDOW u AS (PARTITION BY frame_id ORDER BY t))) WHERE k = 1) USING (frame_id)"""
        ),
    ),
    "gr4_dilate": (dilate, tables.sql("SELECT frame_id, r, c, v FROM dl", "fx_frames", extra=_MASK + ", " + slide_sql("mk", "dl", "max", 3, 4))),
    "gr4_opening": (
        opening, tables.sql("SELECT frame_id, r, c, v FROM op", "fx_frames", extra=", ".join([_MASK, slide_sql("mk", "er", "min", 3, 3), slide_sql("er", "op", "max", 3, 3)])),
    ),
    "gr5_line_crossings": (crossings, tables.sql("SELECT frame_id, r, c, v FROM dl", "fx_frames", extra=_CROSS)),
    "gr6_mask_outline": (
        outline,
        tables.sql(
            f"""SELECT frame_id, r, c, v FROM (SELECT *, coalesce(lag(v) OVER {_ROW}, 0) + coalesce(lead(v) OVER {_ROW}, 0) + coalesce(lag(v) OVER {_COL}, 0) + coalesce(lead(v) OVER {_COL}, 0) AS s FROM mk)
            WHERE v > 0 AND s < 4 * 255""", "fx_frames", extra=_MASK,
        ),
    ),
    "gr6_outer_outline": (
        outer_outline,
        tables.sql(
            """SELECT DISTINCT m.frame_id, m.r, m.c, m.v FROM mk m WHERE v > 0 AND (r IN (0, 7) OR c IN (0, 7)
            OR EXISTS (SELECT 1 FROM open_px o WHERE o.frame_id = m.frame_id AND abs(m.r - o.r) + abs(m.c - o.c) = 1))""", "fx_frames", extra=_OUTER, recursive=True,
        ),
    ),
    "layer_outlines": (
        layer_outlines,
        tables.sql(
            """SELECT DISTINCT m.frame_id // 2 AS frame_id, CASE m.frame_id % 2 WHEN 0 THEN 'Background' ELSE 'Mid' END AS layer, m.r, m.c FROM op m JOIN sz USING (frame_id) WHERE v > 0
            AND (m.r IN (0, r1) OR m.c IN (0, 63) OR EXISTS (SELECT 1 FROM open_px o WHERE o.frame_id = m.frame_id AND abs(m.r - o.r) + abs(m.c - o.c) = 1))""", "fx_mosaic", extra=_LAYERS, recursive=True,
        ),
    ),
    "gr7_tile_equalise": (tile_equalise, tables.sql("SELECT frame_id, r, c, v FROM eq", "fx_frames", extra=EQUALISE)),
    "gr8_rotate": (
        rotate,
        tables.sql(
            """SELECT o.frame_id, o.r, o.c, coalesce(f.v, 0) AS v FROM (SELECT *, CAST(round_even((r - 4) * cos(radians(-3e1)) - (c - 4) * sin(radians(-3e1)) + 4, 0) AS INT) AS sr,
            CAST(round_even((c - 4) * cos(radians(-3e1)) + (r - 4) * sin(radians(-3e1)) + 4, 0) AS INT) AS sc FROM fx_frames) o
            LEFT JOIN fx_frames f ON f.frame_id = o.frame_id AND f.r = sr AND f.c = sc""", "fx_frames",
        ),
    ),
    "src2_explode_pixels": (explode_pixels, tables.sql("SELECT frame_id, r, c, CAST(0 AS INT) AS ch, v FROM fx_frames", "fx_frames")),
    "ud1_register_metric": (register_metric, tables.sql("SELECT frame_id, CAST(max(v) - min(v) AS DOUBLE) AS metric FROM fx_frames GROUP BY 1", "fx_frames")),
    "ud2_frame_fn": (frame_fn, tables.sql("SELECT frame_id, CAST(max(v) - min(v) AS DOUBLE) AS spread FROM fx_frames GROUP BY 1", "fx_frames")),
}
