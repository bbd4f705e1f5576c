"""Joins between boxes: spans to blocks, nesting, containment, nearest subjects, texts to cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import sequence, spatial
from quire.plans import fixtures as fx
from quire.plans.registry import query

_INTER = "(greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)))"
_AREA_A, _AREA_B = "((a.x1 - a.x0) * (a.y1 - a.y0))", "((b.x1 - b.x0) * (b.y1 - b.y0))"


def _spans(spark, sf_dir):
    return fx.blocks(spark, sf_dir).where("det_id % 3 <> 0").withColumnRenamed("det_id", "span_id")


def _hosts(spark, sf_dir):
    return fx.blocks(spark, sf_dir).where("det_id % 3 = 0").withColumnRenamed("det_id", "block_id")


_ASSIGN = f"""assigned AS (SELECT a.page_idx, a.det_id AS span_id, min(b.det_id) AS block_id FROM blocks a JOIN blocks b ON a.page_idx = b.page_idx
WHERE a.det_id % 3 <> 0 AND b.det_id % 3 = 0 AND {_INTER} / {_AREA_A} > 0.5 GROUP BY ALL)"""


@query(f"WITH {fx.BLOCKS_SQL}, {_ASSIGN} SELECT * FROM assigned")
def span_to_block(spark, sf_dir):
    return spatial.assign_spans(_spans(spark, sf_dir), _hosts(spark, sf_dir))


@query(f"WITH {fx.BLOCKS_SQL}, {_ASSIGN} SELECT b.page_idx, b.det_id AS span_id FROM blocks b ANTI JOIN assigned s ON s.page_idx = b.page_idx AND s.span_id = b.det_id WHERE b.det_id % 3 <> 0")
def span_unmatched(spark, sf_dir):
    return spatial.unassigned_spans(_spans(spark, sf_dir), _hosts(spark, sf_dir)).select("page_idx", "span_id")


@query(
    f"""WITH {fx.BLOCKS_SQL} SELECT a.page_idx, a.det_id AS char_id, min(b.det_id) AS span_id FROM blocks a JOIN blocks b ON a.page_idx = b.page_idx
WHERE b.det_id % 3 <> 0 AND a.det_id % 3 = 0 AND (a.x0 + a.x1) / 2 BETWEEN b.x0 AND b.x1 AND (a.y0 + a.y1) / 2 BETWEEN b.y0 AND b.y1 GROUP BY ALL"""
)
def char_in_span(spark, sf_dir):
    chars = fx.boxes(spark, sf_dir).where("det_id % 3 = 0").selectExpr("page_idx", "det_id as char_id", "(x0 + x1) / 2 as x", "(y0 + y1) / 2 as y")
    return spatial.points_in_boxes(chars, _spans(spark, sf_dir))


@query(
    f"""WITH {fx.BOXES_SQL} SELECT page_idx, det_id FROM boxes a WHERE NOT EXISTS
(SELECT 1 FROM boxes b WHERE a.page_idx = b.page_idx AND a.det_id <> b.det_id AND a.x0 >= b.x0 AND a.y0 >= b.y0 AND a.x1 <= b.x1 AND a.y1 <= b.y1)"""
)
def reduct_overlap(spark, sf_dir):
    return spatial.drop_contained(fx.boxes(spark, sf_dir)).select("page_idx", "det_id")


@query(
    f"""WITH {fx.BLOCKS_SQL} SELECT page_idx, det_id FROM blocks a WHERE type = 'text' AND NOT EXISTS
(SELECT 1 FROM blocks b WHERE b.page_idx = a.page_idx AND b.type <> 'text' AND {_INTER} >= 0.8 * {_AREA_A} AND {_AREA_B} > 1.01 * {_AREA_A})"""
)
def nested_text_removed(spark, sf_dir):
    blocks = fx.blocks(spark, sf_dir)
    return spatial.drop_nested_text(blocks.where("type = 'text'"), blocks.where("type <> 'text'")).select("page_idx", "det_id")


@query(
    f"""WITH {fx.BLOCKS_SQL} SELECT page_idx, det_id FROM blocks a WHERE type = 'formula_number' AND NOT EXISTS
(SELECT 1 FROM blocks b WHERE b.page_idx = a.page_idx AND b.type IN ('table', 'image') AND (a.x0 + a.x1) / 2 BETWEEN b.x0 AND b.x1 AND (a.y0 + a.y1) / 2 BETWEEN b.y0 AND b.y1)"""
)
def inline_formula_filtered(spark, sf_dir):
    blocks = fx.blocks(spark, sf_dir)
    return spatial.drop_with_center_in(blocks.where("type = 'formula_number'"), blocks.where("type in ('table', 'image')")).select("page_idx", "det_id")


@query(
    f"""WITH {fx.BLOCKS_SQL} SELECT page_idx, det_id, CASE WHEN EXISTS
(SELECT 1 FROM blocks b WHERE b.page_idx = a.page_idx AND b.type = 'caption' AND {_INTER} / least({_AREA_A}, {_AREA_B}) >= 0.8) THEN 'doc_title' ELSE 'paragraph_title' END AS title_type FROM blocks a WHERE type = 'title'"""
)
def title_split(spark, sf_dir):
    blocks = fx.blocks(spark, sf_dir)
    return spatial.split_titles(blocks.where("type = 'title'"), blocks.where("type = 'caption'")).select("page_idx", "det_id", "title_type")


_MEMBERS = f"""members AS (SELECT a.page_idx, min(b.det_id) AS list_id, a.det_id AS member_id, a.type FROM blocks a JOIN blocks b ON a.page_idx = b.page_idx
WHERE a.type IN ('text', 'footnote') AND b.type IN ('table', 'image', 'title') AND {_INTER} / {_AREA_A} >= 0.8 GROUP BY ALL)"""


def _members(spark, sf_dir):
    blocks = fx.blocks(spark, sf_dir)
    return spatial.list_members(blocks.where("type in ('table', 'image', 'title')"), blocks.where("type in ('text', 'footnote')"))


@query(f"WITH {fx.BLOCKS_SQL}, {_MEMBERS} SELECT page_idx, list_id, member_id, type FROM members")
def list_containment(spark, sf_dir):
    return _members(spark, sf_dir)


@query(
    f"""WITH {fx.BLOCKS_SQL}, {_MEMBERS}, by_type AS (SELECT page_idx, list_id, type, count(*) AS n, min(member_id) AS first FROM members GROUP BY ALL)
SELECT page_idx, list_id, arg_min(type, struct_pack(a := -n, b := first)) AS sub_type, CAST(sum(n) AS BIGINT) AS n FROM by_type GROUP BY ALL"""
)
def list_sub_type(spark, sf_dir):
    return spatial.list_kinds(_members(spark, sf_dir))


@query(
    f"""WITH {fx.BLOCKS_SQL}, met AS (SELECT a.page_idx, a.det_id AS member_id, b.det_id AS parent_id, {_INTER} / {_AREA_A} AS ratio, {_AREA_B} AS area
FROM blocks a JOIN blocks b ON a.page_idx = b.page_idx WHERE a.type = 'image' AND b.type = 'table' AND {_INTER} / {_AREA_A} >= 0.9)
SELECT page_idx, member_id, parent_id, round(ratio, 6) AS ratio FROM met QUALIFY row_number() OVER (PARTITION BY page_idx, member_id ORDER BY ratio DESC, area, parent_id) = 1"""
)
def absorb_images(spark, sf_dir):
    blocks = fx.blocks(spark, sf_dir)
    return spatial.absorb_members(blocks.where("type = 'image'"), blocks.where("type = 'table'"))


@query(
    f"""WITH {fx.BLOCKS_SQL}, met AS (SELECT a.page_idx, a.det_id AS item_id, b.det_id AS table_id, {_INTER} AS shared FROM blocks a JOIN blocks b ON a.page_idx = b.page_idx
WHERE a.type IN ('interline_equation', 'image') AND b.type = 'table' AND (a.x0 + a.x1) / 2 BETWEEN b.x0 AND b.x1 AND (a.y0 + a.y1) / 2 BETWEEN b.y0 AND b.y1)
SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY page_idx, item_id ORDER BY shared DESC, table_id) = 1"""
)
def table_inline_objects(spark, sf_dir):
    blocks = fx.blocks(spark, sf_dir)
    return spatial.inline_objects(blocks.where("type in ('interline_equation', 'image')"), blocks.where("type = 'table'"))


_IOU = f"({_INTER} / ({_AREA_A} + {_AREA_B} - {_INTER}))"


@query(
    f"""WITH {fx.BLOCKS_SQL}, met AS (SELECT a.page_idx, a.det_id AS text_id, b.det_id AS cell_id, {_IOU} AS iou, abs(a.x0 - b.x0) + abs(a.y0 - b.y0) + abs(a.x1 - b.x1) + abs(a.y1 - b.y1) AS apart
FROM blocks a JOIN blocks b ON a.page_idx = b.page_idx WHERE a.det_id % 3 <> 0 AND b.det_id % 3 = 0 AND {_IOU} > 1e-8)
SELECT page_idx, text_id, cell_id, round(iou, 6) AS iou FROM met QUALIFY row_number() OVER (PARTITION BY page_idx, text_id ORDER BY 1 - iou, apart, cell_id) = 1"""
)
def ocr_cell_match(spark, sf_dir):
    boxes = fx.boxes(spark, sf_dir)
    return spatial.best_cells(boxes.where("det_id % 3 <> 0"), boxes.where("det_id % 3 = 0"))


@query(
    f"""WITH {fx.BLOCKS_SQL}, tops AS (SELECT page_idx, min(y0) AS top FROM blocks WHERE type = 'table' GROUP BY ALL)
SELECT page_idx, det_id FROM blocks JOIN tops USING (page_idx) WHERE type = 'text' AND y1 >= top"""
)
def ocr_below_first_cell(spark, sf_dir):
    blocks = fx.blocks(spark, sf_dir)
    return spatial.texts_below_first_cell(blocks.where("type = 'text'"), blocks.where("type = 'table'")).select("page_idx", "det_id")


_EDGE = "sqrt(pow(greatest(0, a.x0 - b.x1, b.x0 - a.x1), 2) + pow(greatest(0, a.y0 - b.y1, b.y0 - a.y1), 2))"


@query(
    f"""WITH {fx.BLOCKS_SQL},
placed AS (SELECT *, det_id - count(*) FILTER (type IN ('caption', 'footnote')) OVER (PARTITION BY page_idx ORDER BY det_id) AS place FROM blocks),
met AS (SELECT a.page_idx, a.det_id AS child_id, a.type, b.det_id AS parent_id, b.place, abs(a.place - b.place) AS gap, {_EDGE} AS edge FROM placed a JOIN placed b ON a.page_idx = b.page_idx
  WHERE a.type IN ('caption', 'footnote') AND b.type IN ('table', 'image')),
near AS (SELECT * FROM met QUALIFY gap = min(gap) OVER (PARTITION BY page_idx, child_id)),
spread AS (SELECT *, max(edge) OVER w - min(edge) OVER w > 2 AS by_edge FROM near WINDOW w AS (PARTITION BY page_idx, child_id))
SELECT page_idx, child_id, parent_id FROM spread
QUALIFY row_number() OVER (PARTITION BY page_idx, child_id ORDER BY CASE WHEN by_edge THEN edge ELSE 0 END, CASE WHEN type = 'caption' THEN -place ELSE place END, parent_id) = 1"""
)
def caption_parent(spark, sf_dir):
    blocks = fx.blocks(spark, sf_dir)
    seen = F.sum(F.col("type").isin("caption", "footnote").cast("long")).over(sequence.running(sequence.reading_order()))
    placed = blocks.withColumn("place", F.col("det_id") - seen)
    return spatial.nearest_parents(placed.where("type in ('caption', 'footnote')"), placed.where("type in ('table', 'image')"))
