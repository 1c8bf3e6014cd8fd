"""Queries on thresholds, components and mark centres."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanlake.operators import marks
from scanlake.plans import tables
from scanlake.plans.frames_catalogue import EQUALISE, slide_sql

C = F.col
# Height and width of the gray frames, and of the field that the marks lie in.
SIZE, FIELD = (8, 8), (480, 640)
REACH = 240


def otsu(spark, sf_dir):
    return marks.otsu_threshold(tables.frames(spark, sf_dir))


def _otsu_sql(src: str, out: str) -> str:
    return f"""{out}_h AS (SELECT frame_id, v AS t, CAST(count(*) AS DOUBLE) AS n FROM {src} GROUP BY ALL),
{out}_c AS (SELECT frame_id, t, sum(n) OVER w AS w0, sum(n * t) OVER w AS s0, sum(n) OVER (PARTITION BY frame_id) AS w, sum(n * t) OVER (PARTITION BY frame_id) AS s
  FROM {out}_h WINDOW w AS (PARTITION BY frame_id ORDER BY t)),
{out} AS (SELECT frame_id, t AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY
  CASE WHEN w > w0 THEN (s * w0 - w * s0) * (s * w0 - w * s0) / (w0 * (w - w0)) ELSE 0 END DESC, t) AS k FROM {out}_c) WHERE k = 1)"""


def _binary(spark, sf_dir):
    gray = tables.frames(spark, sf_dir)
    return marks.binarise(gray, marks.otsu_threshold(gray))


def binary(spark, sf_dir):
    return _binary(spark, sf_dir)


def mark_binary(spark, sf_dir):
    rows = tables.frames(spark, sf_dir).withColumnRenamed("v", "red")
    return marks.mark_binary(rows, SIZE, (2, 2), 40.0)


_BINARY = _otsu_sql("fx_frames", "ot") + ", bn AS (SELECT frame_id, r, c, CASE WHEN v > threshold THEN 255 ELSE 0 END AS v FROM fx_frames JOIN ot USING (frame_id))"
_LABELS = (
    _BINARY
    + """, px AS (SELECT frame_id, r, c, CAST(r AS BIGINT) * 1048576 + c AS code FROM bn WHERE v > 0),
reach AS (SELECT frame_id, r, c, code AS label FROM px
  UNION SELECT p.frame_id, p.r, p.c, q.label FROM reach q JOIN px p ON p.frame_id = q.frame_id AND abs(p.r - q.r) <= 1 AND abs(p.c - q.c) <= 1 AND p.code > q.label),
lb AS (SELECT frame_id, r, c, min(label) AS label FROM reach GROUP BY 1, 2, 3),
cs AS (SELECT frame_id, label, min(c) AS "left", min(r) AS top, max(c) - min(c) + 1 AS width, max(r) - min(r) + 1 AS height, count(*) AS area, avg(c) AS mean_x, avg(r) AS mean_y FROM lb GROUP BY 1, 2)"""
)


def _stats(spark, sf_dir, tile):
    # a tile smaller than the frame makes components cross tile borders, as on full-size frames
    return marks.components(_binary(spark, sf_dir), tile=tile, size=SIZE)


def components(spark, sf_dir):
    return _stats(spark, sf_dir, 4).select("frame_id", "label", "left", "top", "width", "height", "area")


def mark_like(spark, sf_dir):
    return marks.mark_like(_stats(spark, sf_dir, 8), (20, 24)).select("frame_id", "label", "width", "height", "area")


def box_centres(spark, sf_dir):
    return marks.box_centres(marks.components(_binary(spark, sf_dir), tile=4, size=SIZE))


def moment_centres(spark, sf_dir):
    return marks.moment_centres(marks.components(_binary(spark, sf_dir), tile=4, size=SIZE), 10)


def largest_centre(spark, sf_dir):
    frames = tables.load(spark, sf_dir, "embeddings").selectExpr("vec_id AS frame_id")
    return marks.largest_centre(marks.components(_binary(spark, sf_dir), tile=4, size=SIZE), frames, SIZE)


def suppress(spark, sf_dir):
    return marks.suppress_near(tables.marks(spark, sf_dir), 40, size=FIELD)


_KEPT = """fm AS (SELECT frame_id, min(id) AS id, x, y FROM fx_marks GROUP BY frame_id, x, y),
al AS (SELECT frame_id, list(struct_pack(id := id, x := x, y := y) ORDER BY id, x, y) AS a FROM fm GROUP BY 1),
gr AS (SELECT frame_id, a, 1 AS k, [a[1]] AS kept FROM al
  UNION ALL SELECT frame_id, a, k + 1, CASE WHEN len(list_filter(kept, lambda e: abs(e.x - a[k + 1].x) <= {r} AND abs(e.y - a[k + 1].y) <= {r})) > 0 THEN kept ELSE list_append(kept, a[k + 1]) END
  FROM gr WHERE k < len(a)),
kp AS (SELECT frame_id, unnest(kept, recursive := true) FROM gr WHERE k = len(a))"""
_PAIRS = f"""pr AS (SELECT a.frame_id, a.id AS id_a, a.x AS x_a, a.y AS y_a, b.id AS id_b, b.x AS x_b, b.y AS y_b FROM kp a JOIN kp b ON a.frame_id = b.frame_id AND (a.id, a.x, a.y) < (b.id, b.x, b.y)
  AND abs(a.x - b.x) <= {REACH} AND abs(a.y - b.y) <= {REACH})"""


def pairs(spark, sf_dir):
    return marks.kept_pairs(tables.marks(spark, sf_dir), REACH, size=FIELD)


def rotation(spark, sf_dir):
    return marks.grid_rotation(tables.marks(spark, sf_dir), REACH, size=FIELD).select("frame_id", F.round("angle_deg", 5).alias("angle_deg"))


def digit_boxes(spark, sf_dir):
    return marks.digit_boxes(tables.marks(spark, sf_dir), 640, (F.lit(640), F.lit(480)))


def _box_sql() -> str:
    values = ", ".join(f"('{name}', {', '.join(str(v) + '::DOUBLE' for v in box)})" for name, box in marks.DIGIT_BOXES.items())
    s = "(640 / 850e0)"
    return tables.sql(
        f"""SELECT * FROM (SELECT frame_id, id, x, y, digit, greatest(0, CAST(trunc(x + bx0 * {s}) AS INT)) AS x0, greatest(0, CAST(trunc(y + by0 * {s}) AS INT)) AS y0,
        least(640, CAST(trunc(x + bx1 * {s}) AS INT)) AS x1, least(480, CAST(trunc(y + by1 * {s}) AS INT)) AS y1
        FROM fx_marks CROSS JOIN (VALUES {values}) AS t(digit, bx0, by0, bx1, by1)) WHERE x1 > x0 AND y1 > y0""", "fx_marks",
    )


def _labels(body: str) -> str:
    return tables.sql(body, "fx_frames", extra=_LABELS, recursive=True)


def index_marks(spark, sf_dir):
    return marks.index_marks(tables.index_frames(spark, sf_dir), (40, 64), (5, 8)).select("frame_id", "stage", "id", "x", "y")


def _equal_sql(src: str, out: str, clip: str) -> str:
    """Equalisation of 40x64 planes over tiles of 8x8 pixels."""
    return f"""{out}_h AS (SELECT frame_id, r // 8 AS tr, c // 8 AS tc, v AS b, least(count(*), greatest(1, {clip} * 64 / 256)) AS kept, count(*) AS n FROM {src} GROUP BY ALL),
{out}_x AS (SELECT frame_id, tr, tc, sum(n - kept) AS excess FROM {out}_h GROUP BY ALL),
{out}_l AS (SELECT frame_id, tr, tc, b AS level, sum(kept) OVER w AS upto, coalesce(lead(b) OVER w, 256) AS above FROM {out}_h WINDOW w AS (PARTITION BY frame_id, tr, tc ORDER BY b)),
{out}_p AS (SELECT frame_id, r, c, v AS b, (r + 5e-1) / 8 - 5e-1 AS pr, (c + 5e-1) / 8 - 5e-1 AS pc FROM {src}),
{out}_b AS (SELECT frame_id, r, c, b, CAST(least(4, greatest(0, floor(pr) + dr)) AS BIGINT) AS tr, CAST(least(7, greatest(0, floor(pc) + dc)) AS BIGINT) AS tc,
  CASE WHEN dr = 1 THEN pr - floor(pr) ELSE 1 - (pr - floor(pr)) END * CASE WHEN dc = 1 THEN pc - floor(pc) ELSE 1 - (pc - floor(pc)) END AS w
  FROM {out}_p, (SELECT unnest([0, 1]) AS dr), (SELECT unnest([0, 1]) AS dc)),
{out}_m AS (SELECT q.frame_id, r, c, w, (coalesce(upto, 0) + excess * (q.b + 1) / 256e0) * 255 / 64 AS m FROM {out}_b q JOIN {out}_x x ON x.frame_id = q.frame_id AND x.tr = q.tr AND x.tc = q.tc
  LEFT JOIN {out}_l l ON l.frame_id = q.frame_id AND l.tr = q.tr AND l.tc = q.tc AND q.b >= level AND q.b < above),
{out} AS (SELECT frame_id, r, c, CAST(round_even(least(255, greatest(0, sum(w * m))), 0) AS INT) AS v FROM {out}_m GROUP BY 1, 2, 3),
{_otsu_sql(out, out + "_t")},
{out}_n AS (SELECT frame_id, r, c, CASE WHEN v > threshold THEN 255 ELSE 0 END AS v FROM {out} JOIN {out}_t USING (frame_id))"""


def _components_sql(src: str, out: str) -> str:
    return f"""{out}_l(frame_id, r, c, label) USING KEY (frame_id, r, c) AS (SELECT frame_id, r, c, CAST(r AS BIGINT) * 1048576 + c FROM {src} WHERE v > 0
  UNION SELECT p.frame_id, p.r, p.c, min(q.label) FROM recurring.{out}_l p JOIN (SELECT frame_id, r + dr AS r, c + dc AS c, label FROM {out}_l, (SELECT unnest([-1, 0, 1]) AS dr), (SELECT unnest([-1, 0, 1]) AS dc)) q
  ON q.frame_id = p.frame_id AND q.r = p.r AND q.c = p.c WHERE q.label < p.label GROUP BY 1, 2, 3),
{out} AS (SELECT frame_id, label, min(c) AS "left", min(r) AS top, max(c) - min(c) + 1 AS width, max(r) - min(r) + 1 AS height, count(*) AS area, avg(c) AS mean_x, avg(r) AS mean_y FROM {out}_l GROUP BY 1, 2)"""


def _greedy_sql(src: str, out: str) -> str:
    return f"""{out}_a AS (SELECT frame_id, list(struct_pack(id := id, x := x, y := y) ORDER BY id, x, y) AS a FROM (SELECT frame_id, min(id) AS id, x, y FROM {src} GROUP BY frame_id, x, y) GROUP BY 1),
{out}_g AS (SELECT frame_id, a, 1 AS k, [a[1]] AS kept FROM {out}_a
  UNION ALL SELECT frame_id, a, k + 1, CASE WHEN len(list_filter(kept, lambda e: abs(e.x - a[k + 1].x) <= 20 AND abs(e.y - a[k + 1].y) <= 20)) > 0 THEN kept ELSE list_append(kept, a[k + 1]) END
  FROM {out}_g WHERE k < len(a)),
{out} AS (SELECT frame_id, unnest(kept, recursive := true) FROM {out}_g WHERE k = len(a))"""


def _crossing_sql(src: str, out: str, order: int) -> str:
    return ", ".join(
        [
            _equal_sql(src, f"{out}_e", "2e0"), slide_sql(f"{out}_e_n", f"{out}_he", "min", 1, 12), slide_sql(f"{out}_he", f"{out}_ho", "max", 1, 12),
            slide_sql(f"{out}_e_n", f"{out}_ve", "min", 12, 1), slide_sql(f"{out}_ve", f"{out}_vo", "max", 12, 1),
            f"{out}_an AS (SELECT h.frame_id, h.r, h.c, least(h.v, o.v) AS v FROM {out}_ho h JOIN {out}_vo o ON o.frame_id = h.frame_id AND o.r = h.r AND o.c = h.c)",
            slide_sql(f"{out}_an", f"{out}_dl", "max", 7, 7), _components_sql(f"{out}_dl", f"{out}_cs"),
            f"{out} AS (SELECT frame_id, label + {order} * 1125899906842624 AS id, CAST(trunc(mean_x) AS INT) AS x, CAST(trunc(mean_y) AS INT) AS y FROM {out}_cs WHERE area >= 20)",
        ]
    )


_INDEX_MARKS = ", ".join(
    [
        "rd AS (SELECT frame_id, r, c, red AS v FROM fx_index)", _equal_sql("rd", "ca", "4e0"), slide_sql("ca_n", "cd", "max", 5, 5), _components_sql("cd", "cc"),
        """cl AS (SELECT frame_id, label AS id, CAST(trunc("left" + width / 2e0) AS INT) AS x, CAST(trunc(top + height / 2e0) AS INT) AS y FROM cc
        WHERE width BETWEEN 8e-1 AND 10 AND height BETWEEN 8e-1 AND 10 AND greatest(width, height) <= 35e-1 * least(width, height) AND area >= width * height * 5e-2)""",
        _greedy_sql("cl", "ck"),
        "gy AS (SELECT frame_id, r, c, (9798 * red + 19235 * green + 3735 * blue + 16384) >> 15 AS v FROM fx_index WHERE frame_id NOT IN (SELECT frame_id FROM ck))",
        "iv AS (SELECT frame_id, r, c, 255 - v AS v FROM gy)", _crossing_sql("gy", "pa", 0), _crossing_sql("iv", "pb", 1),
        "pc AS (SELECT * FROM pa UNION ALL SELECT * FROM pb)", _greedy_sql("pc", "pk"),
    ]
)

QUERIES = {
    "index_marks": (
        index_marks,
        tables.sql(
            """SELECT frame_id, 'clusters' AS stage, id, x, y FROM ck
            UNION ALL SELECT frame_id, CASE WHEN id < 1125899906842624 THEN 'grey' ELSE 'inverted' END, id % 1125899906842624, x, y FROM pk""", "fx_index", extra=_INDEX_MARKS, recursive=True,
        ),
    ),
    "ag16_otsu_threshold": (otsu, tables.sql("SELECT * FROM ot", "fx_frames", extra=_otsu_sql("fx_frames", "ot"))),
    "ag16_binarise": (binary, tables.sql("SELECT * FROM bn", "fx_frames", extra=_BINARY)),
    "gr9_mark_binary": (
        mark_binary,
        tables.sql("SELECT frame_id, r, c, CASE WHEN v > threshold THEN 255 ELSE 0 END AS v FROM eq JOIN ot USING (frame_id)", "fx_frames", extra=EQUALISE + ", " + _otsu_sql("eq", "ot")),
    ),
    "ag17_components": (components, _labels('SELECT frame_id, label, "left", top, width, height, area FROM cs')),
    "fl5_mark_like": (
        mark_like,
        _labels("SELECT frame_id, label, width, height, area FROM cs WHERE width BETWEEN 4e-1 AND 5 AND height BETWEEN 4e-1 AND 5 AND greatest(width, height) <= 35e-1 * least(width, height) AND area >= width * height * 5e-2"),
    ),
    "ag18_box_centres": (
        box_centres, _labels('SELECT frame_id, label AS id, CAST(trunc("left" + width / 2e0) AS INT) AS x, CAST(trunc(top + height / 2e0) AS INT) AS y FROM cs'),
    ),
    "ag18_moment_centres": (moment_centres, _labels("SELECT frame_id, label AS id, CAST(trunc(mean_x) AS INT) AS x, CAST(trunc(mean_y) AS INT) AS y FROM cs WHERE area >= 10")),
    "ag18_largest_centre": (
        largest_centre,
        _labels(
            """SELECT vec_id AS frame_id, CAST(coalesce("left" + width // 2, 4) AS INT) AS x, CAST(coalesce(top + height // 2, 4) AS INT) AS y
            FROM embeddings LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY area DESC, label) AS k FROM cs) b ON b.frame_id = vec_id AND k = 1"""
        ),
    ),
    "tk5_suppress_near": (suppress, tables.sql("SELECT frame_id, id, x, y FROM kp", "fx_marks", extra=_KEPT.format(r=40), recursive=True)),
    "jn5_near_pairs": (pairs, tables.sql("SELECT * FROM pr", "fx_marks", extra=_KEPT.format(r=20) + ", " + _PAIRS, recursive=True)),
    "ag15_grid_rotation": (
        rotation,
        tables.sql(
            """SELECT frame_id, round(median(CASE WHEN id_a IS NOT NULL THEN (degrees(atan2(-(y_b - y_a), x_b - x_a)) % 90e0 + 90e0) % 90e0 END), 5) AS angle_deg
            FROM (SELECT DISTINCT frame_id FROM kp) LEFT JOIN pr USING (frame_id) GROUP BY 1""",
            "fx_marks", extra=_KEPT.format(r=20) + ", " + _PAIRS, recursive=True,
        ),
    ),
    "gr10_digit_boxes": (digit_boxes, _box_sql()),
}
