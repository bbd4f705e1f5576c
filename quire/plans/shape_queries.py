"""Corners, shares of a parent or page, gaps, crops, and small text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.functions import text as t
from quire.functions.geometry import Box
from quire.operators import tables
from quire.plans import fixtures as fx
from quire.plans.geometry_queries import _a, _b, _near, _sql
from quire.plans.grid_queries import sheets
from quire.plans.registry import query


@query(
    f"""WITH {fx.BOXES_SQL}, s AS (SELECT *, det_id % 3 * 4 AS s FROM boxes)
SELECT page_idx, det_id, x0 || ',' || y0 || ',' || x1 || ',' || y1 AS box, len(list_distinct([x0, x1])) = 2 AND len(list_distinct([y0, y0 + s, y1 + s, y1])) = 2 AS aligned,
NOT (y1 + s - y0 BETWEEN ((y1 - y0) + (y1 - y0)) / 2 * 0.8 AND ((y1 - y0) + (y1 - y0)) / 2 * 1.2) AS skewed FROM s"""
)
def bbox_corners(spark, sf_dir):
    box, s = Box.named(), F.col("det_id") % 3 * 4
    leaning = F.array(F.array(box.x0, box.y0), F.array(box.x1, box.y0 + s), F.array(box.x1, box.y1 + s), F.array(box.x0, box.y1))
    back = g.box_of_corners(g.corners(box))
    return fx.boxes(spark, sf_dir).select("page_idx", "det_id", F.array_join(back.cast("array<string>"), ",").alias("box"), g.is_aligned(leaning).alias("aligned"), g.is_skewed(leaning).alias("skewed"))


_SHARE = "round_even(least(greatest(({} - {}) / {}, 0), 1), 3)"


@query(f"WITH {fx.BOXES_SQL} SELECT page_idx, det_id, " + ", ".join(f"{_SHARE.format(k, low, whole)} AS r{k}" for k, low, whole in (("x0", 100, 300), ("y0", 100, 600), ("x1", 100, 300), ("y1", 100, 600))) + ", " + ", ".join(f"{_SHARE.format(k, 0, whole)} AS u{k}" for k, whole in (("x0", 620), ("y0", 760), ("x1", 620), ("y1", 760))) + " FROM boxes")
def bbox_shares(spark, sf_dir):
    parent = Box(F.lit(100.0), F.lit(100.0), F.lit(400.0), F.lit(700.0))
    relative, unit = g.relative_box(Box.named(), parent), g.to_unit(Box.named(), F.lit(620.0), F.lit(760.0))
    part = lambda c, prefix: [F.get(c, F.lit(i)).alias(prefix + k) for i, k in enumerate(("x0", "y0", "x1", "y1"))]
    return fx.boxes(spark, sf_dir).select("page_idx", "det_id", *part(relative, "r"), *part(unit, "u"))


@query(f"WITH {fx.BOXES_SQL} SELECT page_idx, det_id, CAST(trunc(x0 / 2.5) AS INT) AS sx0, CAST(trunc(y0 / 1.5) AS INT) AS sy0, CAST(trunc(x1 / 2.5) AS INT) AS sx1, CAST(trunc(y1 / 1.5) AS INT) AS sy1, x0 < x1 - 60 AND y0 < y1 - 20 AS crop FROM boxes")
def bbox_scaled(spark, sf_dir):
    box = g.scaled_box(Box.named(), F.lit(2.5), F.lit(1.5))
    small = Box(F.col("x0"), F.col("y0"), F.col("x1") - 60, F.col("y1") - 20)
    return fx.boxes(spark, sf_dir).select("page_idx", "det_id", *[F.get(box, F.lit(i)).alias(k) for i, k in enumerate(("sx0", "sy0", "sx1", "sy1"))], g.is_crop(small).alias("crop"))


@query(_sql(meets="CASE WHEN a.y1 <= b.y0 THEN a.y1 + 30 > a.y1 AND a.y0 + 10 < b.y0 WHEN b.y1 <= a.y0 THEN a.y1 + 30 > b.y1 AND a.y0 + 10 < a.y0 END"))
def bbox_in_gap(spark, sf_dir):
    moved = Box(F.col("a_x0"), F.col("a_y0") + 10, F.col("a_x1"), F.col("a_y1") + 30)
    rows = _near(spark, sf_dir).withColumn("gap", g.vertical_gap(_a(), _b()))
    return rows.select("page_idx", "a_det_id", "b_det_id", g.meets_gap(moved, F.col("gap")).alias("meets"))


@query("SELECT doc_id, md5(CASE WHEN doc_id % 3 < 2 THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') ELSE text END) AS code, md5(replace(text, chr(13) || chr(10), '') || 'a-b') AS fixed FROM documents")
def code_and_controls(spark, sf_dir):
    text, kind = F.col("text"), F.col("doc_id") % 3
    fenced = F.when(kind == 0, F.concat(F.lit("```py\n"), text, F.lit("\n```"))).when(kind == 1, F.concat(text, F.lit("\n```"))).otherwise(text)
    broken = F.concat(text, F.lit("a\x02\r\nb"))
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.md5(F.encode(t.bare_code(fenced), "utf-8")).alias("code"), F.md5(F.encode(t.drop_surrogates(t.fix_controls(broken)), "utf-8")).alias("fixed"))


@query(
    r"""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '[a' || o_orderkey || '] x [b]' ELSE '\[a' || o_orderkey || ' x \[b\]' END AS plain, o_orderkey % 4 < 3 AS token, '<details>' || chr(10) || '<summary>' || o_orderpriority || '</summary>' || chr(10) || chr(10) || o_orderkey || chr(10) || '</details>' AS details FROM orders"""
)
def brackets_and_details(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    brackets = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("\\[a"), key, F.lit("\\] x \\[b\\]"))).otherwise(F.concat(F.lit("\\[a"), key, F.lit(" x \\[b\\]")))
    token = F.when(F.col("o_orderkey") % 4 == 0, key).when(F.col("o_orderkey") % 4 == 1, "xiv").when(F.col("o_orderkey") % 4 == 2, "B").otherwise("p. 3")
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", t.plain_brackets(brackets).alias("plain"), t.is_page_token(token).alias("token"), t.details_block(key, F.col("o_orderpriority")).alias("details"))


@query(f"WITH {fx.CELLS_SQL}, w AS (SELECT sheet, r, sum(1 + (r + c) % 2) AS n FROM cells WHERE c % 3 <> 2 GROUP BY ALL) SELECT sheet, string_agg(n, ',' ORDER BY r) AS columns FROM w GROUP BY sheet")
def sheet_row_columns(spark, sf_dir):
    return sheets(spark, sf_dir).select("sheet", F.array_join(F.transform("rows", lambda r: tables.row_columns(r).cast("string")), ",").alias("columns"))
