"""Detections, titles, slides and captions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions.geometry import Box
from quire.operators import detections as d
from quire.operators import titles as ti
from quire.plans import fixtures as fx
from quire.plans.registry import query


@query(
    f"""WITH {fx.BOXES_SQL}, s AS (SELECT page_idx, det_id, CAST(trunc(x0 / 8) AS INT) AS x0, CAST(trunc(y0 / 8) AS INT) AS y0, CAST(trunc(x1 / 8) AS INT) AS x1, CAST(trunc(y1 / 8) AS INT) AS y1 FROM boxes)
SELECT * FROM s WHERE x1 - x0 > 2 AND y1 - y0 > 2"""
)
def detections_in_page_units(spark, sf_dir):
    return d.in_page_units(fx.boxes(spark, sf_dir), F.lit(8.0)).select("page_idx", "det_id", "x0", "y0", "x1", "y1")


_LABEL = "CASE det_id % 5 WHEN 0 THEN 'inline_formula' WHEN 1 THEN 'ocr_text' ELSE 'text' END"


@query(
    f"""WITH {fx.BOXES_SQL}, l AS (SELECT page_idx, det_id, {_LABEL} AS label, CASE WHEN score < 0.8 THEN det_id END AS idx FROM boxes),
r AS (SELECT *, CASE label WHEN 'inline_formula' THEN 'inline_equation' WHEN 'ocr_text' THEN 'text' ELSE 'block' END AS route FROM l)
SELECT page_idx, det_id, route, CASE WHEN route = 'block' AND idx IS NOT NULL THEN CAST(sum(CASE WHEN route = 'block' AND idx IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY page_idx ORDER BY det_id) AS BIGINT) END AS number FROM r"""
)
def detections_routed(spark, sf_dir):
    rows = fx.boxes(spark, sf_dir).select("page_idx", "det_id", F.expr(_LABEL).alias("label"), F.when(F.col("score") < 0.8, F.col("det_id")).alias("idx"))
    return d.routed(rows).select("page_idx", "det_id", "route", "number")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'ocr_text' ELSE 'text' END AS label FROM documents WHERE NOT (doc_id % 2 = 0 AND (doc_id % 4 = 0 OR regexp_full_match(text, '\\s*')))")
def detections_without_blank_text(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "ocr_text").otherwise("text").alias("label"), F.when(F.col("doc_id") % 4 == 0, " \n ").otherwise(F.col("text")).alias("text"))
    return d.without_blank_text(rows).select("doc_id", "label")


@query(
    f"""WITH {fx.BOXES_SQL}, m AS (SELECT page_idx, det_id, x0 - 90 AS x0, y0 - 180 AS y0, x1 - 90 AS x1, y1 - 180 AS y1 FROM boxes)
SELECT * FROM m WHERE x1 >= 0 AND y1 >= 0 AND x0 <= 220 AND y0 <= 330"""
)
def formulas_in_crops(spark, sf_dir):
    crop = F.struct(F.lit(100.0).alias("x0"), F.lit(200.0).alias("y0"), F.lit(10.0).alias("paste_x"), F.lit(20.0).alias("paste_y"), F.lit(220.0).alias("width"), F.lit(330.0).alias("height"))
    return d.in_crop(fx.boxes(spark, sf_dir).withColumn("crop", crop)).select("page_idx", "det_id", "x0", "y0", "x1", "y1")


@query(f"WITH {fx.BOXES_SQL} SELECT page_idx, det_id, 'box' AS kind FROM boxes WHERE det_id % 2 = 0 UNION ALL SELECT page_idx, det_id, 'formula' FROM boxes WHERE det_id % 2 = 1 AND score < 0.8")
def sidecar_rows(spark, sf_dir):
    rows = fx.boxes(spark, sf_dir)
    side = rows.where("det_id % 2 = 1").withColumn("x0", F.when(F.col("score") < 0.8, F.col("x0"))).withColumn("kind", F.lit("formula"))
    return d.with_sidecars(rows.where("det_id % 2 = 0").withColumn("kind", F.lit("box")), side).select("page_idx", "det_id", "kind")


@query(
    f"""WITH {fx.BOXES_SQL}, c AS (SELECT page_idx, det_id, x0, y0, lag(x0) OVER w AS px, lag(y0) OVER w AS py, lag(det_id % 3) OVER w = det_id % 3 AS same FROM (SELECT page_idx, det_id, CASE WHEN det_id % 2 = 0 THEN lag(x0) OVER (PARTITION BY page_idx ORDER BY det_id) + det_id % 4 ELSE x0 END AS x0,
CASE WHEN det_id % 2 = 0 THEN lag(y0) OVER (PARTITION BY page_idx ORDER BY det_id) + 1.5 ELSE y0 END AS y0 FROM boxes) WINDOW w AS (PARTITION BY page_idx ORDER BY det_id))
SELECT page_idx, det_id, abs(x0 - px) > 1 AND abs(x0 - px) <= 2.5 AND abs(y0 - py) > 1 AND abs(y0 - py) <= 2.5 AND greatest(0, 6 - abs(x0 - px)) * greatest(0, 10 - abs(y0 - py)) / 60 >= 0.45 AS shadow FROM c WHERE px IS NOT NULL"""
)
def shadow_chars(spark, sf_dir):
    order = Window.partitionBy("page_idx").orderBy("det_id")
    rows = fx.boxes(spark, sf_dir)
    moved = lambda k, off: F.when(F.col("det_id") % 2 == 0, F.lag(k).over(order) + off).otherwise(F.col(k))
    rows = rows.select("page_idx", "det_id", moved("x0", F.col("det_id") % 4).alias("x0"), moved("y0", F.lit(1.5)).alias("y0"))
    rows = rows.withColumns({"x1": F.col("x0") + 6, "y1": F.col("y0") + 10, "look": d.look(F.lit("a"), F.lit("Times"), F.lit(0.0))})
    rows = rows.withColumns({f"p_{k}": F.lag(k).over(order) for k in ("x0", "y0", "x1", "y1", "look")}).where("p_x0 is not null")
    return rows.select("page_idx", "det_id", d.is_shadow(Box.named("p_"), Box.named(), F.col("look") == F.col("p_look")).alias("shadow"))


@query("SELECT o_custkey AS doc_id, min(o_orderkey) AS page_idx, arg_min(round(greatest(o_totalprice / (1 + o_orderkey % 90000), (1 + o_orderkey % 90000) / o_totalprice), 6), o_orderkey) AS ratio FROM orders WHERE o_orderkey % 7 > 0 AND greatest(o_totalprice / (1 + o_orderkey % 90000), (1 + o_orderkey % 90000) / o_totalprice) > 10 GROUP BY o_custkey")
def extreme_pages(spark, sf_dir):
    pages = fx.table(spark, sf_dir, "orders").selectExpr("o_custkey as doc_id", "o_orderkey as page_idx", "o_totalprice as width", "case when o_orderkey % 7 = 0 then 0 else 1 + o_orderkey % 90000 end as height")
    return d.first_extreme_page(pages).select("doc_id", "page_idx", F.round("ratio", 6).alias("ratio"))


@query("SELECT conv_id AS doc_id, CAST(sum(length(text)) AS BIGINT) AS total, CAST(sum(length(text) - length(replace(text, 'e', ''))) AS BIGINT) AS errors, round(coalesce(sum(length(text) - length(replace(text, 'e', ''))) / nullif(sum(length(text)), 0), 0), 6) AS ratio FROM conversations GROUP BY conv_id")
def unmapped_chars(spark, sf_dir):
    samples = fx.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.length("text").alias("chars"), (F.length("text") - F.length(F.replace("text", F.lit("e"), F.lit("")))).alias("errors"))
    return d.map_errors(samples).select("doc_id", "total", "errors", F.round("ratio", 6).alias("ratio"))


@query(
    """WITH t AS (SELECT o_orderkey, CAST(1 + o_orderkey % 200 AS INT) AS pages, CAST(least(greatest(1, o_orderkey % 9), greatest(1, o_orderkey % 5), 3, greatest(1, (1 + o_orderkey % 200) // 30)) AS INT) AS k FROM orders),
p AS (SELECT *, unnest(range(0, k)) AS i FROM t)
SELECT o_orderkey, k AS tasks, CAST(3 + i * (pages // k) + least(i, pages % k) AS INT) AS first, CAST(3 + (i + 1) * (pages // k) + least(i + 1, pages % k) - 1 AS INT) AS last FROM p"""
)
def render_ranges(spark, sf_dir):
    number = lambda m: (F.col("o_orderkey") % m).cast("int")
    rows = fx.table(spark, sf_dir, "orders").select("o_orderkey", (1 + number(200)).alias("pages"), number(5).alias("wanted"), number(9).alias("cpus"))
    rows = rows.withColumn("tasks", d.render_tasks(F.col("pages"), F.col("wanted"), F.col("cpus")))
    return rows.select("o_orderkey", "tasks", F.inline(d.page_ranges(F.lit(3), 2 + F.col("pages"), F.col("tasks"))))


@query(f"WITH {fx.BOXES_SQL} SELECT page_idx, string_agg(det_id, ',' ORDER BY CASE WHEN det_id % 4 = 0 THEN NULL ELSE CAST(x0 AS BIGINT) % 7 END NULLS LAST, det_id) AS ids FROM boxes GROUP BY page_idx")
def blocks_by_index(spark, sf_dir):
    rows = fx.boxes(spark, sf_dir).groupBy("page_idx").agg(F.array_sort(F.collect_list(F.struct("det_id", F.when(F.col("det_id") % 4 != 0, F.col("x0").cast("long") % 7).alias("idx")))).alias("blocks"))
    return rows.select("page_idx", F.array_join(F.transform(d.in_index_order(F.col("blocks")), lambda b: b["det_id"].cast("string")), ",").alias("ids"))


# -- titles -----------------------------------------------------------------------------------


@query(
    f"""WITH {fx.BOXES_SQL}, g AS (SELECT page_idx, list(y1 - y0 - 20 ORDER BY det_id) AS h, max(y1 - y0) AS box FROM boxes GROUP BY page_idx)
SELECT page_idx, round(CASE WHEN page_idx % 3 = 0 THEN 12.5 WHEN len(list_filter(h, lambda x: x > 0)) > 0 THEN list_avg(list_transform(list_filter(h, lambda x: x > 0), lambda x: CAST(trunc(x) AS INT))) ELSE trunc(box) END, 6) AS height,
CASE WHEN page_idx % 5 = 0 AND len(list_filter(h, lambda x: x > 8)) > 0 THEN round_even(list_avg(list_filter(h, lambda x: x > 8)), 0) WHEN len(list_filter(h, lambda x: x > 0)) > 0 THEN round_even(list_avg(list_filter(h, lambda x: x > 0)), 0) ELSE box END AS whole FROM g"""
)
def title_heights(spark, sf_dir):
    rows = fx.boxes(spark, sf_dir).groupBy("page_idx").agg(F.collect_list(F.col("y1") - F.col("y0") - 20).alias("h"), F.max(F.col("y1") - F.col("y0")).alias("box"))
    preset = F.when(F.col("page_idx") % 3 == 0, 12.5)
    detected = F.when(F.col("page_idx") % 5 == 0, F.filter("h", lambda x: x > 8)).otherwise(F.array().cast("array<double>"))
    return rows.select("page_idx", F.round(ti.line_height(preset, F.col("h"), F.col("box")), 6).alias("height"), ti.rounded_line_height(detected, F.col("h"), F.col("box")).alias("whole"))


_KIND = "CASE (c_custkey + o_orderkey) % 4 WHEN 0 THEN 'doc_title' WHEN 1 THEN 'paragraph_title' WHEN 2 THEN CASE WHEN c_custkey % 3 = 0 THEN 'title' ELSE 'text' END ELSE 'text' END"


def _titled(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "orders").withColumn("c_custkey", F.col("o_custkey"))
    return rows.select(F.col("c_custkey").alias("doc_id"), F.expr("cast(o_orderkey % 5 as int)").alias("page_idx"), F.col("o_orderkey").alias("block_id"), F.expr(_KIND).alias("type"), F.col("o_orderpriority").alias("text"), F.expr("cast(o_orderkey % 9 as int)").alias("height"), F.lit(None).cast("int").alias("level"))


_TITLED = f"t AS (SELECT c_custkey AS doc_id, CAST(o_orderkey % 5 AS INT) AS page_idx, o_orderkey AS block_id, {_KIND} AS type, o_orderpriority AS text, o_orderkey % 9 AS height FROM (SELECT *, o_custkey AS c_custkey FROM orders)), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_idx, block_id) - 1 AS place FROM t WHERE type <> 'text')"


@query(f"WITH {_TITLED} SELECT doc_id, string_agg(place || ':' || text || ':' || height || ':' || (page_idx + 1), ';' ORDER BY place) AS titles, bool_or(type = 'doc_title') AND bool_or(type = 'paragraph_title') AND NOT bool_or(type = 'title') AS grouped FROM n GROUP BY doc_id")
def titles_of_documents(spark, sf_dir):
    line = F.transform(F.map_entries("titles"), lambda e: F.concat_ws(":", e["key"], e["value"]["text"], e["value"]["height"].cast("string"), e["value"]["page"].cast("string")))
    return ti.numbered_titles(_titled(spark, sf_dir)).select("doc_id", F.array_join(line, ";").alias("titles"), "grouped")


@query(f"WITH {_TITLED} SELECT doc_id, block_id, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN 1 + place % 3 = 1 THEN 2 ELSE CAST(1 + place % 3 AS INT) END END AS level FROM n")
def titles_with_levels(spark, sf_dir):
    titles = _titled(spark, sf_dir).where("type <> 'text'")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_idx", "block_id")) - 1
    levels = titles.withColumn("place", place).where("doc_id % 2 = 0").select("doc_id", "place", (1 + F.col("place") % 3).cast("int").alias("level"))
    return ti.with_levels(titles, levels, offset=True).select("doc_id", "block_id", "level")


_SLIDE = "b AS (SELECT page_idx AS slide, det_id, CASE WHEN det_id % 9 = 0 THEN 'image' ELSE 'text' END AS type, CAST(10 + CAST(x0 AS INT) % 3 + CASE WHEN det_id % 11 = 0 THEN 14 WHEN det_id % 7 = 0 THEN 5 ELSE 0 END AS DOUBLE) AS size, det_id % 7 = 0 OR det_id % 11 = 0 AS bold FROM boxes)"


@query(
    f"""WITH {fx.BOXES_SQL}, {_SLIDE}, p AS (SELECT slide, size, count(*) AS n FROM b WHERE type = 'text' AND NOT bold GROUP BY ALL), body AS (SELECT slide, arg_min(size, (-n, size)) AS body FROM p GROUP BY slide),
h AS (SELECT slide, size, count(*) AS n, row_number() OVER (PARTITION BY slide ORDER BY size DESC) AS k FROM b WHERE type = 'text' AND bold GROUP BY slide, size),
s AS (SELECT b1.slide, b1.size AS a, b1.n AS an, b2.size AS c, body FROM h b1 LEFT JOIN h b2 ON b2.slide = b1.slide AND b2.k = 2 LEFT JOIN body ON body.slide = b1.slide WHERE b1.k = 1),
t AS (SELECT *, an = 1 AND (body IS NULL OR a >= body + 4) AND (c IS NULL OR a >= c + 2) AS two FROM s)
SELECT b.slide, det_id, CASE WHEN type = 'text' AND bold AND two AND size = a THEN 2 WHEN type = 'text' AND bold AND two AND size = c AND c >= body + 2 AND a >= c + 2 THEN 3 END AS level FROM b LEFT JOIN t ON t.slide = b.slide"""
)
def slide_titles(spark, sf_dir):
    size = 10 + F.col("x0").cast("int") % 3 + F.when(F.col("det_id") % 11 == 0, 14).when(F.col("det_id") % 7 == 0, 5).otherwise(0)
    rows = fx.boxes(spark, sf_dir).select(F.col("page_idx").alias("slide"), "det_id", F.when(F.col("det_id") % 9 == 0, "image").otherwise("text").alias("type"), size.cast("double").alias("size"), ((F.col("det_id") % 7 == 0) | (F.col("det_id") % 11 == 0)).alias("bold"), F.lit(None).cast("int").alias("level"))
    return ti.slide_titles(rows).select("slide", "det_id", "level")


@query(f"WITH {fx.BOXES_SQL} SELECT page_idx, det_id, (x1 - x0) > 0 AND (y1 - y0) > 0 AND ((x1 - x0) < 0.1 * 700 OR (y1 - y0) < 0.1 * 300 OR (x1 - x0) * (y1 - y0) / 210000 < 0.01) AS small FROM boxes")
def small_pictures(spark, sf_dir):
    return fx.boxes(spark, sf_dir).select("page_idx", "det_id", ti.is_small_picture(Box.named(), F.lit(700.0), F.lit(300.0)).alias("small"))


@query(f"WITH {fx.BOXES_SQL} SELECT page_idx, round(least(1, sum((x1 - x0) * (y1 - y0)) / ((max(x1) - min(x0)) * (max(y1) - min(y0)))), 6) AS density FROM boxes GROUP BY page_idx")
def page_density(spark, sf_dir):
    return ti.density(fx.boxes(spark, sf_dir)).select("page_idx", F.round("density", 6).alias("density"))


# -- captions ---------------------------------------------------------------------------------

_STACK = "CASE det_id % 6 WHEN 0 THEN 'table' WHEN 1 THEN 'header' WHEN 2 THEN 'text' WHEN 3 THEN 'caption' WHEN 4 THEN 'page_number' ELSE 'text' END"
#: Six blocks to a group: a header, a text, a caption, a page number, a text beside the caption (even pages) or below it, and a table.
_TOP = "120 * ((det_id + 5) // 6) + CASE det_id % 6 WHEN 2 THEN 10 WHEN 3 THEN 30 WHEN 5 THEN CASE WHEN page_idx % 2 = 0 THEN 32 ELSE 44 END WHEN 0 THEN 58 ELSE 0 END"
CAPTIONED_SQL = f"captioned AS (SELECT page_idx, det_id AS idx, {_STACK} AS type, CAST(CAST(x0 AS BIGINT) % 60 * 4 AS DOUBLE) AS x0, CAST({_TOP} AS DOUBLE) AS y0, CAST(CAST(x0 AS BIGINT) % 60 * 4 + 100 AS DOUBLE) AS x1, CAST({_TOP} + 12 AS DOUBLE) AS y1 FROM boxes)"


def captioned(spark, sf_dir):
    left, top = F.col("x0").cast("long") % 60 * 4, F.expr(_TOP.replace("//", "div"))
    return fx.boxes(spark, sf_dir).select(
        "page_idx", F.col("det_id").alias("idx"), F.expr(_STACK).alias("type"), left.cast("double").alias("x0"), top.cast("double").alias("y0"), (left + 100).cast("double").alias("x1"), (top + 12).cast("double").alias("y1"),
        F.when(F.col("det_id") % 10 == 0, 2).otherwise(1).alias("n_lines"), F.when(F.col("det_id") % 4 == 3, "Table 1 (continued)").otherwise("text").alias("text"),
    )


@query(
    f"""WITH {fx.BOXES_SQL}, {CAPTIONED_SQL}, e AS (SELECT *, lag(type) OVER w AS pt, lag(y0) OVER w AS py0, lag(y1) OVER w AS py1, lead(type) OVER w AS nt, lead(y0) OVER w AS ny0 FROM captioned WHERE type NOT IN ('header', 'page_number') WINDOW w AS (PARTITION BY page_idx ORDER BY idx))
SELECT page_idx, idx FROM e WHERE type = 'text' AND pt = 'caption' AND nt = 'table' AND ((least(py1, y1) - greatest(py0, y0)) / least(py1 - py0, y1 - y0) >= 0.6 OR abs((py0 + py1) / 2 - (y0 + y1) / 2) <= greatest(py1 - py0, y1 - y0) * 0.5)
AND ny0 - greatest(py1, y1) BETWEEN 0 AND greatest(12, greatest(py1 - py0, y1 - y0) * 1.5)"""
)
def caption_fragments(spark, sf_dir):
    rows = captioned(spark, sf_dir)
    return ti.inline_fragments(rows).where("fragment").select("page_idx", "idx")


@query()
def caption_stacks(spark, sf_dir):
    return ti.stacked_captions(captioned(spark, sf_dir))


@query()
def leading_captions(spark, sf_dir):
    return ti.leading_continuations(captioned(spark, sf_dir).where("idx >= 11"))


@query(f"WITH {fx.BOXES_SQL}, {CAPTIONED_SQL} SELECT a.page_idx, a.idx, b.idx AS table_idx, NOT (a.x1 < b.x0 - greatest(12, (b.x1 - b.x0) * 0.03) OR a.x0 > b.x1 + greatest(12, (b.x1 - b.x0) * 0.03)) AS near FROM captioned a JOIN captioned b ON b.page_idx = a.page_idx AND b.idx = a.idx + 1 AND b.type = 'table'")
def blocks_near_tables(spark, sf_dir):
    rows = captioned(spark, sf_dir)
    tables = rows.where("type = 'table'").select("page_idx", F.col("idx").alias("table_idx"), *[F.col(k).alias(f"t_{k}") for k in ("x0", "y0", "x1", "y1")], (F.col("idx") - 1).alias("idx"))
    return rows.join(tables, ["page_idx", "idx"]).select("page_idx", "idx", "table_idx", ti.is_near_table(Box.named(), Box.named("t_")).alias("near"))
