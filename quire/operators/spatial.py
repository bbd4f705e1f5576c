"""Joins between boxes of one page.

The page (or document and page) is always an equi-key, so a join is dealt by page and never a
cross product; a grid cell joins the key where a page can hold many boxes. A span that a block
covers by more than half has its centre in the block, so a span has one cell, that of its
centre, and only blocks are repeated over the cells they touch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.functions.geometry import Box

#: Height of a grid row in page units: a few text lines.
CELL = 64.0


def _prefixed(df: DataFrame, prefix: str, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(f"{prefix}{c}") for c in df.columns if c not in keys])


def _cells(low: Column, high: Column, cell: float) -> Column:
    first, last = F.floor(low / cell), F.floor(high / cell)
    return F.explode(F.sequence(first, F.greatest(first, last)))


def pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], predicate: Column, how: str = "inner") -> DataFrame:
    """Rows of left (columns a_*) with rows of right (b_*) on the same page where predicate holds."""
    a, b = _prefixed(left, "a_", keys), _prefixed(right, "b_", [])
    same = [F.col(k) == F.col(f"b_{k}") for k in keys]
    joined = a.join(b, [*same, predicate], how)
    return joined.drop(*[f"b_{k}" for k in keys]) if how not in ("left_anti", "left_semi") else joined


def _back(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Columns a_* under their own names again."""
    return df.select(*[F.col(c) if c in keys else F.col(f"a_{c}").alias(c) for c in columns])


def assign_spans(spans: DataFrame, blocks: DataFrame, keys: Sequence[str] = ("page_idx",), span_id: str = "span_id", block_order: str = "block_id", threshold: float = 0.5, cell: float = CELL) -> DataFrame:
    """keys, span_id, block_order: each span with the first block that covers more than threshold (0.5 or more) of it.

    Spans of no area, without such a block or with null coordinates have no row.
    """
    if threshold < 0.5:
        raise ValueError("a smaller threshold would need spans on several cells")
    s = spans.select(*keys, span_id, *"x0 y0 x1 y1".split()).withColumn("cell", F.floor((F.col("y0") + F.col("y1")) / 2 / cell))
    b = blocks.select(*keys, block_order, *[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")]).where("b_y0 <= b_y1").withColumn("cell", _cells(F.col("b_y0"), F.col("b_y1"), cell))
    hit = s.join(b, [*keys, "cell"]).where(g.overlap_of_first(Box.named(), Box.named("b_")) > threshold)
    return hit.groupBy(*keys, span_id).agg(F.min(block_order).alias(block_order))


def unassigned_spans(spans: DataFrame, blocks: DataFrame, keys: Sequence[str] = ("page_idx",), span_id: str = "span_id", **more) -> DataFrame:
    """The spans that assign_spans leaves out."""
    return spans.join(assign_spans(spans, blocks, keys, span_id, **more), [*keys, span_id], "left_anti")


def points_in_boxes(points: DataFrame, boxes: DataFrame, keys: Sequence[str] = ("page_idx",), point_id: str = "char_id", box_order: str = "span_id", cell: float = CELL) -> DataFrame:
    """keys, point_id, box_order: each point (x, y) with the first box that holds it, edges included."""
    p = points.select(*keys, point_id, "x", "y", F.floor(F.col("y") / cell).alias("cell"))
    b = boxes.select(*keys, box_order, "x0", "y0", "x1", "y1").where("y0 <= y1").withColumn("cell", _cells(F.col("y0"), F.col("y1"), cell))
    hit = p.join(b, [*keys, "cell"]).where(g.contains_point(Box.named(), F.col("x"), F.col("y")))
    return hit.groupBy(*keys, point_id).agg(F.min(box_order).alias(box_order))


def drop_contained(boxes: DataFrame, keys: Sequence[str] = ("page_idx",), box_id: str = "det_id") -> DataFrame:
    """Boxes that lie in no other box of their page. Of equal boxes none stays."""
    inside = (F.col(f"a_{box_id}") != F.col(f"b_{box_id}")) & g.is_in(Box.named("a_"), Box.named("b_"))
    return _back(pairs(boxes, boxes, keys, inside, "left_anti"), boxes.columns, keys)


def drop_nested_text(texts: DataFrame, blocks: DataFrame, keys: Sequence[str] = ("page_idx",), overlap: float = 0.8, larger: float = 1.01) -> DataFrame:
    """Text boxes, without those that lie by overlap or more in a block of over `larger` times their area."""
    a, b = Box.named("a_"), Box.named("b_")
    nested = g.is_mostly_inside(a, b, overlap) & (b.area > larger * a.area)
    return _back(pairs(texts, blocks, keys, nested, "left_anti"), texts.columns, keys)


def drop_with_center_in(items: DataFrame, containers: DataFrame, keys: Sequence[str] = ("page_idx",)) -> DataFrame:
    """Items whose centre lies in no container."""
    x, y = Box.named("a_").center
    return _back(pairs(items, containers, keys, g.contains_point(Box.named("b_"), x, y), "left_anti"), items.columns, keys)


def split_titles(titles: DataFrame, document_titles: DataFrame, keys: Sequence[str] = ("page_idx",), title_id: str = "det_id", overlap: float = 0.8) -> DataFrame:
    """titles with title_type: doc_title where a layout document title overlaps by `overlap` of the smaller box, else paragraph_title."""
    hit = pairs(titles, document_titles, keys, g.overlap_of_smaller(Box.named("a_"), Box.named("b_")) >= overlap, "left_semi")
    hit = hit.select(*keys, F.col(f"a_{title_id}").alias(title_id), F.lit(True).alias("hit"))
    return titles.join(hit, [*keys, title_id], "left").withColumn("title_type", F.when(F.col("hit"), "doc_title").otherwise("paragraph_title")).drop("hit")


def list_members(lists: DataFrame, texts: DataFrame, keys: Sequence[str] = ("page_idx",), overlap: float = 0.8) -> DataFrame:
    """keys, list_id, member_id, type: each text box with the first list that covers `overlap` of it or more."""
    a, b = Box.named("a_"), Box.named("b_")
    inside = (a.area > 0) & (g.overlap_of_first(a, b) >= overlap)
    met = pairs(texts, lists, keys, inside)
    return met.groupBy(*keys, F.col("a_det_id").alias("member_id"), F.col("a_type").alias("type")).agg(F.min("b_det_id").alias("list_id")).select(*keys, "list_id", "member_id", "type")


def list_kinds(members: DataFrame, keys: Sequence[str] = ("page_idx",)) -> DataFrame:
    """keys, list_id, sub_type, n: the commonest type of each list's members, the one met first on a tie."""
    by = members.groupBy(*keys, "list_id", "type").agg(F.count("*").alias("n"), F.min("member_id").alias("first"))
    return by.groupBy(*keys, "list_id").agg(F.min_by("type", F.struct(-F.col("n"), F.col("first"))).alias("sub_type"), F.sum("n").alias("n"))


def absorb_members(members: DataFrame, parents: DataFrame, keys: Sequence[str] = ("page_idx",), overlap: float = 0.9) -> DataFrame:
    """keys, member_id, parent_id, ratio: each member with the parent that covers most of it (0.9 or more), the smallest and first on ties."""
    a, b = Box.named("a_"), Box.named("b_")
    ratio = g.overlap_of_first(a, b)
    met = pairs(members, parents, keys, (a.area > 0) & (ratio >= overlap) & (F.col("a_det_id") != F.col("b_det_id")))
    met = met.withColumns({"ratio": ratio, "area": b.area})
    best = F.min_by(F.struct("b_det_id", "ratio"), F.struct(-F.col("ratio"), F.col("area"), F.col("b_det_id")))
    return met.groupBy(*keys, F.col("a_det_id").alias("member_id")).agg(best.alias("best")).select(*keys, "member_id", F.col("best.b_det_id").alias("parent_id"), F.round("best.ratio", 6).alias("ratio"))


def inline_objects(items: DataFrame, tables: DataFrame, keys: Sequence[str] = ("page_idx",)) -> DataFrame:
    """keys, item_id, table_id, area: items with their centre in a table go to the table they share most area with, the first on ties."""
    a, b = Box.named("a_"), Box.named("b_")
    x, y = a.center
    met = pairs(items, tables, keys, g.contains_point(b, x, y)).withColumn("shared", g.intersection_area(a, b))
    best = F.min_by(F.struct("b_det_id", "shared"), F.struct(-F.col("shared"), F.col("b_det_id")))
    return met.groupBy(*keys, F.col("a_det_id").alias("item_id")).agg(best.alias("best")).select(*keys, "item_id", F.col("best.b_det_id").alias("table_id"), F.col("best.shared").alias("shared"))


def best_cells(texts: DataFrame, cells: DataFrame, keys: Sequence[str] = ("page_idx",), least: float = 1e-8) -> DataFrame:
    """keys, text_id, cell_id, iou: each recognised text with its cell, by IoU, then the distance of corners, then position."""
    a, b = Box.named("a_"), Box.named("b_")
    apart = lambda p, q: F.abs(p.x0 - q.x0) + F.abs(p.y0 - q.y0) + F.abs(p.x1 - q.x1) + F.abs(p.y1 - q.y1)
    # Only cells that overlap can have an IoU at all: four comparisons in the join keep the others from the sums.
    meets = (a.x0 < b.x1) & (b.x0 < a.x1) & (a.y0 < b.y1) & (b.y0 < a.y1)
    shared = (F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)) * (F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0))
    met = pairs(texts, cells, keys, meets).withColumn("shared", shared)
    met = met.withColumns({"iou": F.try_divide("shared", a.width * a.height + b.width * b.height - F.col("shared")), "apart": apart(a, b)}).where(F.col("iou") > least)
    best = F.min_by(F.struct("b_det_id", "iou"), F.struct(1 - F.col("iou"), F.col("apart"), F.col("b_det_id")))
    return met.groupBy(*keys, F.col("a_det_id").alias("text_id")).agg(best.alias("best")).select(*keys, "text_id", F.col("best.b_det_id").alias("cell_id"), F.round("best.iou", 6).alias("iou"))


def texts_below_first_cell(texts: DataFrame, cells: DataFrame, keys: Sequence[str] = ("page_idx",)) -> DataFrame:
    """Texts, without those that end above the topmost cell."""
    top = cells.groupBy(*keys).agg(F.min("y0").alias("cells_top"))
    return texts.join(top, list(keys)).where("y1 >= cells_top").drop("cells_top")


def nearest_parents(children: DataFrame, parents: DataFrame, keys: Sequence[str] = ("page_idx",), spread: float = 2.0) -> DataFrame:
    """keys, child_id, parent_id: the subject of each caption or footnote.

    children and parents have det_id, type, place (position in reading order, without the other children of one kind) and a
    box. The least difference in place wins. Of two subjects at one difference the nearer edge wins where
    distances differ by more than `spread`; else a caption goes to the later one and a footnote to the earlier.
    """
    a, b = Box.named("a_"), Box.named("b_")
    met = pairs(children, parents, keys, F.col("a_det_id") != F.col("b_det_id"))
    met = met.withColumns({"gap": F.abs(F.col("a_place") - F.col("b_place")), "edge": g.edge_distance(a, b)})
    child = Window.partitionBy(*keys, "a_det_id")
    met = met.withColumn("least", F.min("gap").over(child)).where("gap = least")
    met = met.withColumns({"low": F.min("edge").over(child), "high": F.max("edge").over(child)})
    by_edge = F.col("high") - F.col("low") > spread
    rank = F.struct(
        F.when(by_edge, F.col("edge")).otherwise(0.0).alias("edge"), F.when(F.col("a_type") == "caption", -F.col("b_place")).otherwise(F.col("b_place")).alias("place"), F.col("b_det_id").alias("id")
    )
    return met.groupBy(*keys, F.col("a_det_id").alias("child_id")).agg(F.min_by("b_det_id", rank).alias("parent_id"))
