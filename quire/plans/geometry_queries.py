"""Box arithmetic over pairs of boxes of one page."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.functions.geometry import Box
from quire.operators import spatial
from quire.plans import fixtures as fx
from quire.plans.registry import query

_KEYS = ("page_idx",)
#: Neighbours in det_id: every box with the three after it, so the number of pairs grows with the boxes.
_AFTER = (1, 2, 3)
_W, _H = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0))", "greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
_INTER, _AREA_A, _AREA_B = f"({_W} * {_H})", "((a.x1 - a.x0) * (a.y1 - a.y0))", "((b.x1 - b.x0) * (b.y1 - b.y0))"


def _a() -> Box:
    return Box.named("a_")


def _b() -> Box:
    return Box.named("b_")


def _near(spark, sf_dir):
    boxes = fx.boxes(spark, sf_dir)
    each = boxes.withColumn("near_id", F.explode(F.array(*[F.col("det_id") + k for k in _AFTER])))
    return spatial.pairs(each, boxes.withColumn("near_id", F.col("det_id")), (*_KEYS, "near_id"), F.lit(True))


def _sql(**columns: str) -> str:
    picked = ", ".join(f"{v} AS {k}" for k, v in columns.items())
    parts = [f"SELECT a.page_idx, a.det_id AS a_det_id, b.det_id AS b_det_id, {picked} FROM boxes a JOIN boxes b ON b.page_idx = a.page_idx AND b.det_id = a.det_id + {k}" for k in _AFTER]
    return f"WITH {fx.BOXES_SQL} " + " UNION ALL ".join(parts)


def _out(spark, sf_dir, **columns):
    return _near(spark, sf_dir).select("page_idx", "a_det_id", "b_det_id", *[c.alias(k) for k, c in columns.items()])


@query(_sql(inter=_INTER, iou=f"round({_INTER} / ({_AREA_A} + {_AREA_B} - {_INTER}), 6)"))
def bbox_iou(spark, sf_dir):
    return _out(spark, sf_dir, inter=g.intersection_area(_a(), _b()), iou=F.round(g.iou(_a(), _b()), 6))


@query(_sql(of_first=f"round({_INTER} / {_AREA_A}, 6)", of_smaller=f"round({_INTER} / least({_AREA_A}, {_AREA_B}), 6)"))
def bbox_overlap_ratios(spark, sf_dir):
    return _out(spark, sf_dir, of_first=F.round(g.overlap_of_first(_a(), _b()), 6), of_smaller=F.round(g.overlap_of_smaller(_a(), _b()), 6))


@query(_sql(edge="round(sqrt(pow(greatest(0, a.x0 - b.x1, b.x0 - a.x1), 2) + pow(greatest(0, a.y0 - b.y1, b.y0 - a.y1), 2)), 6)", center="round(sqrt(pow((a.x0 + a.x1 - b.x0 - b.x1) / 2, 2) + pow((a.y0 + a.y1 - b.y0 - b.y1) / 2, 2)), 6)"))
def bbox_distances(spark, sf_dir):
    return _out(spark, sf_dir, edge=F.round(g.edge_distance(_a(), _b()), 6), center=F.round(g.center_distance(_a(), _b()), 6))


@query(_sql(inside="a.x0 >= b.x0 AND a.y0 >= b.y0 AND a.x1 <= b.x1 AND a.y1 <= b.y1", meets=f"{_W} > 0 AND {_H} > 0", at_left="b.x1 < a.x0", at_right="a.x1 < b.x0", at_bottom="b.y1 < a.y0", at_top="a.y1 < b.y0"))
def bbox_relations(spark, sf_dir):
    at = g.relative_position(_a(), _b())
    return _out(spark, sf_dir, inside=g.is_in(_a(), _b()), meets=g.is_overlapping(_a(), _b()), at_left=at["left"], at_right=at["right"], at_bottom=at["bottom"], at_top=at["top"])


@query(_sql(narrow=f"round({_W} / least(a.x1 - a.x0, b.x1 - b.x0), 6)", low=f"round({_H} / least(a.y1 - a.y0, b.y1 - b.y0), 6)", projected=f"round({_W} / (a.x1 - a.x0), 6)", same_line=f"{_H} / least(a.y1 - a.y0, b.y1 - b.y0) > 0.8", same_column=f"{_W} / least(a.x1 - a.x0, b.x1 - b.x0) > 0.8"))
def bbox_axis_overlaps(spark, sf_dir):
    return _out(
        spark, sf_dir, narrow=F.round(g.x_overlap_of_narrower(_a(), _b()), 6), low=F.round(g.y_overlap_of_lower(_a(), _b()), 6), projected=F.round(g.x_overlap_of_first(_a(), _b()), 6), same_line=g.is_same_line(_a(), _b()), same_column=g.is_same_column(_a(), _b())
    )


@query(_sql(smaller_area=f"CASE WHEN {_INTER} / least({_AREA_A}, {_AREA_B}) > 0.3 THEN least({_AREA_A}, {_AREA_B}) END", smaller_is_first=f"CASE WHEN {_INTER} / least({_AREA_A}, {_AREA_B}) > 0.3 THEN {_AREA_A} <= {_AREA_B} END"))
def bbox_smaller_of_overlapping(spark, sf_dir):
    rows = _near(spark, sf_dir).withColumn("small", g.smaller_if_overlapping(_a(), _b(), 0.3))
    small, found = Box.of_struct(F.col("small")), F.col("small").isNotNull()
    return rows.select("page_idx", "a_det_id", "b_det_id", F.when(found, small.width * small.height).alias("smaller_area"), F.when(found, _a().area <= _b().area).alias("smaller_is_first"))


@query(_sql(gap_top="CASE WHEN a.y1 <= b.y0 THEN a.y1 WHEN b.y1 <= a.y0 THEN b.y1 END", gap_bottom="CASE WHEN a.y1 <= b.y0 THEN b.y0 WHEN b.y1 <= a.y0 THEN a.y0 END"))
def bbox_vertical_gap(spark, sf_dir):
    gap = g.vertical_gap(_a(), _b())
    return _out(spark, sf_dir, gap_top=gap["top"], gap_bottom=gap["bottom"])


@query(_sql(u_x0="least(a.x0, b.x0)", u_y0="least(a.y0, b.y0)", u_x1="greatest(a.x1, b.x1)", u_y1="greatest(a.y1, b.y1)"))
def bbox_union(spark, sf_dir):
    u = Box.of_struct(g.union_box(_a(), _b()))
    return _out(spark, sf_dir, u_x0=u.x0, u_y0=u.y0, u_x1=u.x1, u_y1=u.y1)


@query(
    f"WITH {fx.BOXES_SQL} SELECT page_idx, det_id, CAST(trunc(x0 * 1000 / 620) AS INT) AS gx0, CAST(trunc(y0 * 1000 / 760) AS INT) AS gy0, CAST(trunc(x1 * 1000 / 620) AS INT) AS gx1, CAST(trunc(y1 * 1000 / 760) AS INT) AS gy1, (x1 - x0) * (y1 - y0) AS area FROM boxes"
)
def bbox_grid1000(spark, sf_dir):
    grid = g.to_grid(Box.named(), F.lit(620.0), F.lit(760.0))
    return fx.boxes(spark, sf_dir).select("page_idx", "det_id", *[F.get(grid, F.lit(i)).alias(k) for i, k in enumerate(("gx0", "gy0", "gx1", "gy1"))], Box.named().area.alias("area"))


@query(
    f"""WITH {fx.BOXES_SQL}, s AS (SELECT page_idx, det_id, x0 / 3 AS x0, y0 / 3 AS y0, x1 / 3 AS x1, y1 / 3 AS y1 FROM boxes)
SELECT page_idx, det_id, CAST(greatest(0, floor(x0)) AS INT) AS wx0, CAST(greatest(0, floor(y0)) AS INT) AS wy0, CAST(least(200, ceil(x1)) AS INT) AS wx1, CAST(least(200, ceil(y1)) AS INT) AS wy1
FROM s WHERE greatest(0, floor(x0)) < least(200, ceil(x1)) AND greatest(0, floor(y0)) < least(200, ceil(y1))"""
)
def bbox_to_int(spark, sf_dir):
    third = Box(*[F.col(k) / 3 for k in ("x0", "y0", "x1", "y1")])
    whole = g.whole_box(third, F.lit(200.0), F.lit(200.0))
    return fx.boxes(spark, sf_dir).withColumn("w", whole).where(F.col("w").isNotNull()).select("page_idx", "det_id", *[F.get("w", F.lit(i)).alias(k) for i, k in enumerate(("wx0", "wy0", "wx1", "wy1"))])


@query(
    f"""WITH {fx.BOXES_SQL} SELECT page_idx, det_id, CAST(trunc(least(x0, x1) / 620 * 310) AS INT) AS px0, CAST(trunc(least(y0, y1) / 760 * 380) AS INT) AS py0,
CAST(trunc(greatest(x0, x1) / 620 * 310) AS INT) AS px1, CAST(trunc(greatest(y0, y1) / 760 * 380) AS INT) AS py1 FROM boxes"""
)
def bbox_unit_to_page(spark, sf_dir):
    inverted = Box(F.col("x1") / 620, F.col("y1") / 760, F.col("x0") / 620, F.col("y0") / 760)
    page = g.to_page(inverted, F.lit(310.0), F.lit(380.0))
    return fx.boxes(spark, sf_dir).select("page_idx", "det_id", *[F.get(page, F.lit(i)).alias(k) for i, k in enumerate(("px0", "py0", "px1", "py1"))])
