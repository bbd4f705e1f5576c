"""Layout, tables, spreadsheets and tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.geometry import Box
from quire.operators import cells as xl
from quire.operators import layout, tables
from quire.plans import fixtures as fx
from quire.plans.registry import query
from quire.streaming import tasks

_INTER = "(greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)))"


@query()
def nms_dedup(spark, sf_dir):
    return layout.suppress(fx.boxes(spark, sf_dir), most=0.3).select("page_idx", "det_id")


@query()
def nested_formulas_merged(spark, sf_dir):
    return layout.merge_nested_formulas(fx.blocks(spark, sf_dir).where("type in ('interline_equation', 'formula_number')"))


@query(
    f"""WITH {fx.BLOCKS_SQL} SELECT page_idx, det_id, CASE WHEN EXISTS (SELECT 1 FROM blocks b WHERE a.page_idx = b.page_idx AND b.type IN ('text', 'table', 'image') AND {_INTER} / ((a.x1 - a.x0) * (a.y1 - a.y0)) >= 0.7)
THEN 'inline_formula' ELSE 'display_formula' END AS formula_type FROM blocks a WHERE type = 'interline_equation'"""
)
def formula_relabel(spark, sf_dir):
    blocks = fx.blocks(spark, sf_dir)
    return layout.relabel_formulas(blocks.where("type = 'interline_equation'"), blocks.where("type in ('text', 'table', 'image')")).select("page_idx", "det_id", "formula_type")


@query(
    f"""WITH {fx.BOXES_SQL}, t AS (SELECT *, CASE det_id % 3 WHEN 0 THEN 'header' WHEN 1 THEN 'footer' ELSE 'text' END AS type FROM boxes)
SELECT page_idx, det_id, CASE WHEN type = 'header' AND (y0 + y1) / 2 > 380 THEN 'footer' WHEN type = 'footer' AND (y0 + y1) / 2 < 380 THEN 'header' ELSE type END AS type FROM t"""
)
def header_footer_by_half(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("header"), F.lit("footer"), F.lit("text")), (F.col("det_id") % 3 + 1).cast("int"))
    return fx.boxes(spark, sf_dir).select("page_idx", "det_id", layout.header_or_footer(kind, Box.named(), F.lit(760.0)).alias("type"))


@query()
def sorted_boxes(spark, sf_dir):
    return layout.rows_first(fx.boxes(spark, sf_dir)).select("page_idx", "det_id", "place")


@query()
def xycut_order(spark, sf_dir):
    return layout.reading_places(fx.boxes(spark, sf_dir)).select("page_idx", "det_id", "place")


@query()
def page_union_area(spark, sf_dir):
    return layout.union_area(fx.boxes(spark, sf_dir))


# -- tables -----------------------------------------------------------------------------------

_HTML = """vals AS (SELECT l_orderkey // 64 AS t, CAST(l_linenumber AS INT) AS r, CAST(l_partkey % 5 AS INT) AS c, 'v<' || max(l_suppkey) AS value FROM lineitem GROUP BY ALL),
ext AS (SELECT t, min(c) AS c0, max(c) AS c1, min(r) AS r0 FROM vals GROUP BY t),
grid AS (SELECT t, r, r0, unnest(range(c0, c1 + 1)) AS c FROM (SELECT DISTINCT t, r FROM vals) JOIN ext USING (t)),
full_rows AS (SELECT t, r, '<tr>' || string_agg(CASE WHEN r = r0 THEN '<th>' || coalesce(replace(value, '<', '&lt;'), '') || '</th>' ELSE '<td>' || coalesce(replace(value, '<', '&lt;'), '') || '</td>' END, '' ORDER BY c) || '</tr>' AS h FROM grid LEFT JOIN vals USING (t, r, c) GROUP BY t, r),
html AS (SELECT t, '<table>' || string_agg(h, '' ORDER BY r) || '</table>' AS html FROM full_rows GROUP BY t)"""


def _html(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey div 64 as t", "cast(l_linenumber as int) as r", "cast(l_partkey % 5 as int) as c", "l_suppkey")
    values = rows.groupBy("t", "r", "c").agg(F.concat(F.lit("v<"), F.max("l_suppkey").cast("string")).alias("value"))
    return tables.build(values, ("t",))


@query(f"WITH {_HTML} SELECT t, html FROM html")
def table_html_build(spark, sf_dir):
    return _html(spark, sf_dir)


@query(f"WITH {_HTML} SELECT t, CAST(count(*) AS INT) AS n_rows, CAST(max(c1 - c0 + 1) AS INT) AS n_columns FROM (SELECT DISTINCT t, r FROM vals) JOIN ext USING (t) GROUP BY t")
def table_cols(spark, sf_dir):
    parsed = _html(spark, sf_dir).select("t", tables.parse(F.col("html")).alias("rows"))
    return parsed.select("t", F.size("rows").alias("n_rows"), tables.occupancy(F.col("rows"))["width"].alias("n_columns"))


@query(
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS shared, CASE o_orderkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 5 ELSE 6 END AS merged, 3 AS width FROM orders"""
)
def header_prefix(spark, sf_dir):
    upper = '<table><tr><td rowspan="2">A</td><td colspan="2">B</td></tr><tr><td>c</td><td>d</td></tr><tr><td>1</td><td>2</td><td>3</td></tr></table>'
    lower = [upper.replace("1<", "7<"), upper.replace("1<", "7<").replace("c<", "x<"), upper.replace("A<", "Z<")]
    second = F.element_at(F.array(*map(F.lit, lower)), (F.col("o_orderkey") % 3 + 1).cast("int"))
    rows = fx.table(spark, sf_dir, "orders").select("o_orderkey", tables.parse(F.lit(upper)).alias("a"), tables.parse(second).alias("b"))
    return rows.select("o_orderkey", tables.header_rows(F.col("a"), F.col("b")).alias("shared"), F.size(tables.merged_rows(F.col("a"), F.col("b"))).alias("merged"), tables.occupancy(F.col("a"))["width"].alias("width"))


@query(
    f"""WITH {fx.BLOCKS_SQL}, p AS (SELECT page_idx // 16 AS doc_id, page_idx, det_id, CASE WHEN type IN ('table', 'image', 'text', 'title') THEN 'table' ELSE type END AS type, 0 AS x0, CASE WHEN det_id % 2 = 0 THEN 100 + det_id ELSE 110 END AS x1 FROM blocks),
e AS (SELECT doc_id, page_idx, arg_min(struct_pack(b := det_id, t := type, w := x1 - x0), det_id) AS f, arg_max(struct_pack(b := det_id, t := type, w := x1 - x0), det_id) AS l FROM p GROUP BY ALL),
n AS (SELECT *, lag(l) OVER w AS a, lag(page_idx) OVER w AS pa FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY page_idx))
SELECT doc_id, page_idx, a.b AS upper_id, f.b AS lower_id FROM n WHERE pa = page_idx - 1 AND f.t = 'table' AND a.t = 'table' AND abs(f.w - a.w) < 0.1 * least(f.w, a.w)"""
)
def table_merge_candidates(spark, sf_dir):
    blocks = fx.blocks(spark, sf_dir).selectExpr(
        "page_idx div 16 as doc_id", "page_idx", "det_id as block_id", "if(type in ('table', 'image', 'text', 'title'), 'table', type) as type", "0D as x0", "if(det_id % 2 = 0, 100D + det_id, 110D) as x1"
    )
    return tables.merge_candidates(blocks)


# -- spreadsheets -----------------------------------------------------------------------------


@query()
def xlsx_components(spark, sf_dir):
    return xl.tables(xl.components(fx.cells(spark, sf_dir), gap=0))


@query()
def gap_choice(spark, sf_dir):
    return xl.best_gap(fx.cells(spark, sf_dir))


@query(f"WITH {fx.CELLS_SQL} SELECT sheet, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM cells GROUP BY sheet")
def sheet_bounds(spark, sf_dir):
    return xl.bounds(fx.cells(spark, sf_dir))


@query(f"WITH {fx.CELLS_SQL}, g AS (SELECT sheet, r - lag(r, 1, r - 1) OVER (PARTITION BY sheet ORDER BY r) - 1 AS gap FROM (SELECT DISTINCT sheet, r FROM cells)) SELECT sheet, CAST(sum(gap) AS BIGINT) AS blank_rows, CAST(max(gap) AS BIGINT) AS longest FROM g GROUP BY sheet")
def sheet_blank_rows(spark, sf_dir):
    return xl.longest_blank_rows(fx.cells(spark, sf_dir))


@query(f"WITH {fx.CELLS_SQL}, n AS (SELECT *, lag(r) OVER (PARTITION BY sheet, c ORDER BY r) AS u, lag(c) OVER (PARTITION BY sheet, r ORDER BY c) AS l FROM cells) SELECT sheet, r, c, CASE WHEN r - u <= 2 THEN u END AS up, CASE WHEN c - l <= 2 THEN l END AS \"left\" FROM n")
def sheet_neighbours(spark, sf_dir):
    return xl.neighbours(fx.cells(spark, sf_dir), 1)


# -- tasks ------------------------------------------------------------------------------------

_LOG = "log AS (SELECT event_id % 3000 AS task_id, event_id AS submit_order, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'completed' WHEN 'view' THEN 'processing' ELSE 'pending' END AS status, ts, user_id % 7 AS worker FROM events)"
_LAST = "last AS (SELECT task_id, arg_max(struct_pack(s := status, t := ts), struct_pack(a := ts, b := status)) AS n, min(submit_order) AS submit_order FROM log GROUP BY task_id)"


def _log(spark, sf_dir):
    kind = F.col("event_type")
    status = F.when(kind == "error", "failed").when(kind == "click", "completed").when(kind == "view", "processing").otherwise("pending")
    return fx.table(spark, sf_dir, "events").select((F.col("event_id") % 3000).alias("task_id"), F.col("event_id").alias("submit_order"), status.alias("status"), "ts", (F.col("user_id") % 7).alias("worker"))


@query(f"WITH {_LOG}, {_LAST} SELECT n.s AS status, count(*) AS n FROM last GROUP BY 1")
def task_stats(spark, sf_dir):
    return tasks.status_counts(tasks.last_status(_log(spark, sf_dir)))


@query(f"WITH {_LOG}, {_LAST} SELECT task_id, n.s AS status, submit_order FROM last WHERE NOT (n.s IN ('completed', 'failed') AND epoch(TIMESTAMP '2024-03-01') - floor(epoch(n.t)) >= 86400)")
def task_ttl(spark, sf_dir):
    return tasks.live(tasks.last_status(_log(spark, sf_dir)), F.lit("2024-03-01").cast("timestamp")).select("task_id", "status", "submit_order")


@query(f"WITH {_LOG} SELECT worker, submit_order, CAST(coalesce(sum(CASE WHEN status = 'pending' THEN 1 ELSE 0 END) OVER (PARTITION BY worker ORDER BY submit_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead FROM log")
def queued_ahead(spark, sf_dir):
    return tasks.queued_ahead(_log(spark, sf_dir)).select("worker", "submit_order", "ahead")


@query(
    """WITH d AS (SELECT lang, doc_id, n_chars // 700 AS pages FROM documents), s AS (SELECT *, CAST(sum(pages) OVER (PARTITION BY lang ORDER BY doc_id) - pages AS BIGINT) AS start FROM d WHERE pages > 0),
w AS (SELECT *, unnest(range(start // 64, (start + pages - 1) // 64 + 1)) AS w FROM s) SELECT lang, doc_id, w AS "window", greatest(0, w * 64 - start) AS first_page, least(pages, (w + 1) * 64 - start) - 1 AS last_page FROM w"""
)
def page_windows(spark, sf_dir):
    return tasks.page_windows(fx.table(spark, sf_dir, "documents").selectExpr("lang", "doc_id", "n_chars div 700 as pages"), ("lang",))


@query()
def bin_pack(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").selectExpr("doc_id div 200 as batch", "doc_id", "cast(n_chars div 400 + 1 as int) as pages")
    return tasks.pack_documents(docs, "batch")
