"""Titles, lists, recognised texts, rich text, anchors, page ranges and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import render
from quire.operators import assembly as a
from quire.plans import fixtures as fx
from quire.plans.registry import query
from quire.sources import files

_TYPES = ("doc_title", "paragraph_title", "vertical_text", "table")
_KIND = "CASE turn % 4 WHEN 0 THEN 'doc_title' WHEN 1 THEN 'paragraph_title' WHEN 2 THEN 'vertical_text' ELSE 'table' END"


def _turns(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("turn") % 4 + 1).cast("int"))
    return fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", "role", kind.alias("type"))


@query(f"SELECT conv_id, turn, CASE WHEN k IN ('doc_title', 'paragraph_title') THEN 'title' WHEN k = 'vertical_text' THEN 'text' ELSE k END AS type, CASE k WHEN 'doc_title' THEN 1 WHEN 'paragraph_title' THEN 2 END AS level FROM (SELECT *, {_KIND} AS k FROM conversations)")
def title_types(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", a.title_kind(F.col("type")).alias("k")).select("conv_id", "turn", "k.type", "k.level")


@query("SELECT conv_id, turn, CASE WHEN l IS NULL THEN 1 WHEN l < 1 THEN 0 ELSE l END AS level, CASE WHEN l IS NULL THEN 1 WHEN l < 1 THEN 0 ELSE least(l, 4) END AS capped FROM (SELECT conv_id, turn, CAST(CASE WHEN length(text) % 9 = 8 THEN NULL ELSE length(text) % 9 - 1 END AS INT) AS l FROM conversations)")
def title_levels(spark, sf_dir):
    n = F.length("text") % 9
    level = F.when(n == 8, None).otherwise(n - 1).cast("int")
    return fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", a.title_level(level).alias("level"), a.title_level(level, 4).alias("capped"))


@query(
    """WITH s AS (SELECT doc_id, 't' || doc_id AS text, CASE WHEN doc_id % 4 = 0 THEN 'fb' END AS fallback FROM documents), r AS (SELECT doc_id, 'ocr' || doc_id AS text, (doc_id % 10) / 10 AS score FROM documents WHERE doc_id % 3 <> 0)
SELECT s.doc_id, CASE WHEN r.doc_id IS NULL THEN s.text WHEN score > 0.5 THEN r.text ELSE coalesce(fallback, '') END AS text FROM s LEFT JOIN r USING (doc_id)"""
)
def post_ocr(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents")
    spans = docs.selectExpr("doc_id", "concat('t', doc_id) as text", "if(doc_id % 4 = 0, 'fb', null) as fallback")
    found = docs.where("doc_id % 3 <> 0").selectExpr("doc_id", "concat('ocr', doc_id) as text", "(doc_id % 10) / 10 as score")
    return a.apply_recognised(spans, found, ("doc_id",)).select("doc_id", "text")


@query(
    """WITH t AS (SELECT conv_id, arg_max(length(text) % 5, turn) AS l FROM conversations WHERE turn % 2 = 1 GROUP BY conv_id)
SELECT conv_id, turn, CAST(coalesce(t.l, turn) AS BIGINT) AS level FROM conversations LEFT JOIN t USING (conv_id)"""
)
def synced_titles(spark, sf_dir):
    talk = fx.table(spark, sf_dir, "conversations")
    titles = talk.where("turn % 2 = 1").select("conv_id", F.col("turn").alias("seq"), (F.length("text") % 5).cast("long").alias("level"))
    return a.copy_levels(talk.select("conv_id", "turn", F.col("turn").alias("level")), titles, ("conv_id",)).select("conv_id", "turn", "level")


@query(
    """WITH e AS (SELECT o_custkey AS doc_id, o_orderkey, 'a' || o_orderkey % 50 AS anchor FROM orders), b AS (SELECT DISTINCT o_custkey AS doc_id, 'a' || o_orderkey % 50 AS anchor FROM orders WHERE o_orderkey % 2 = 0)
SELECT doc_id, o_orderkey, CASE WHEN b.anchor IS NOT NULL THEN e.anchor END AS anchor FROM e LEFT JOIN b USING (doc_id, anchor)"""
)
def toc_anchors(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "orders").selectExpr("o_custkey as doc_id", "o_orderkey", "concat(' a', o_orderkey % 50, ' ') as anchor")
    return a.keep_known_anchors(rows, rows.where("o_orderkey % 2 = 0")).select("doc_id", "o_orderkey", "anchor")


@query(
    """WITH i AS (SELECT conv_id, turn, CAST(length(text) % 3 AS BIGINT) AS level, length(text) % 2 = 0 AS ordered, text FROM conversations),
o AS (SELECT *, CASE level WHEN 0 THEN 0 WHEN 1 THEN sum(CASE WHEN level < 1 THEN 1 ELSE 0 END) OVER w ELSE sum(CASE WHEN level < 2 THEN 1 ELSE 0 END) OVER w END AS parent FROM i WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, level, parent ORDER BY turn) AS k FROM o)
SELECT conv_id, turn, repeat('    ', level) || CASE WHEN ordered THEN k || '.' ELSE '-' END || ' ' || text AS line FROM n"""
)
def list_flatten(spark, sf_dir):
    n = F.length("text")
    items = fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", (n % 3).cast("long").alias("level"), (n % 2 == 0).alias("ordered"), "text")
    return a.flatten_lists(items, ("conv_id",), "turn").select("conv_id", "turn", "line")


@query(
    """WITH s AS (SELECT conv_id AS doc_id, turn AS seq, CASE WHEN length(text) % 7 = 0 THEN '' ELSE text END AS text, CASE WHEN length(text) % 3 = 0 THEN 'bold' ELSE 'italic' END AS style, CASE WHEN length(text) % 5 = 0 THEN 'u' END AS link FROM conversations),
k AS (SELECT *, CASE WHEN link IS NOT NULL THEN 'link:' || link ELSE 'style:' || style END AS kind FROM s WHERE text <> ''),
f AS (SELECT *, CASE WHEN lag(kind) OVER w = kind THEN 0 ELSE 1 END AS b FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY seq)), r AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY seq) AS run FROM f)
SELECT doc_id, min(seq) AS first, arg_min(style, seq) AS style, any_value(link) AS link, string_agg(text, '' ORDER BY seq) AS text FROM r GROUP BY doc_id, run"""
)
def rich_text_segments(spark, sf_dir):
    n = F.length("text")
    rows = fx.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), F.when(n % 7 == 0, "").otherwise(F.col("text")).alias("text"), F.when(n % 3 == 0, "bold").otherwise("italic").alias("style"), F.when(n % 5 == 0, "u").alias("link")
    )
    return a.merge_segments(rows)


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '**x' || o_orderkey || '**' WHEN 1 THEN '***x' || o_orderkey || '***' WHEN 2 THEN '<u><sup>x' || o_orderkey || '</sup></u>' ELSE 'x' || o_orderkey END AS out FROM orders")
def styled_text(spark, sf_dir):
    style = F.element_at(F.array(F.lit("bold"), F.lit("bold,italic"), F.lit("underline,superscript"), F.lit("")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", a.styled(F.concat(F.lit("x"), F.col("o_orderkey").cast("string")), style).alias("out"))


@query(f"WITH {fx.BOXES_SQL}, k AS (SELECT page_idx, CAST(y1 - y0 AS BIGINT) AS size, count(*) AS n FROM boxes GROUP BY ALL) SELECT page_idx, size, n FROM k QUALIFY row_number() OVER (PARTITION BY page_idx ORDER BY n DESC, size) = 1")
def common_size(spark, sf_dir):
    return a.commonest(fx.boxes(spark, sf_dir).select("page_idx", (F.col("y1") - F.col("y0")).cast("long").alias("size")), ("page_idx",), "size")


@query(
    f"""WITH {fx.BOXES_SQL}, m AS (SELECT page_idx, median((y0 + y1) / 2) AS c, median(y1 - y0) AS h FROM boxes GROUP BY page_idx)
SELECT page_idx, det_id, CASE WHEN (y0 + y1) / 2 - c < -0.2 * h THEN 'sup' WHEN (y0 + y1) / 2 - c > 0.2 * h THEN 'sub' ELSE 'body' END AS role FROM boxes JOIN m USING (page_idx)"""
)
def char_script_roles(spark, sf_dir):
    return a.script_roles(fx.boxes(spark, sf_dir), ("page_idx",)).select("page_idx", "det_id", "role")


@query(f"WITH {fx.BOXES_SQL} SELECT page_idx, avg(CASE WHEN (y1 - y0) * 6 / (x1 - x0) > 2 THEN 1 ELSE 0 END) > 0.8 AS vertical FROM boxes GROUP BY page_idx")
def vertical_text_share(spark, sf_dir):
    tall = fx.boxes(spark, sf_dir).withColumn("y1", F.col("y0") + (F.col("y1") - F.col("y0")) * 6)
    return a.is_vertical(tall)


@query("SELECT s_suppkey AS server_id, s_suppkey % 7 AS pending, s_suppkey % 5 AS capacity, s_suppkey % 2 = 0 AS local, round((s_suppkey % 7) / greatest(s_suppkey % 5, 1), 6) AS score FROM supplier ORDER BY (s_suppkey % 7) / greatest(s_suppkey % 5, 1), s_suppkey % 7, (s_suppkey % 2 = 0) DESC, s_suppkey LIMIT 1")
def next_server(spark, sf_dir):
    servers = fx.table(spark, sf_dir, "supplier").selectExpr("s_suppkey as server_id", "s_suppkey % 7 as pending", "s_suppkey % 5 as capacity", "s_suppkey % 2 = 0 as local")
    return a.least_loaded(servers).withColumn("score", F.round("score", 6))


@query("SELECT p_partkey, s AS stem, CASE WHEN k = 0 THEN s ELSE s || '_' || k END AS task_stem FROM (SELECT p_partkey, s, row_number() OVER (PARTITION BY lower(s) ORDER BY p_partkey) - 1 AS k FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE lower(p_brand) END AS s FROM part))")
def unique_stems(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "part").selectExpr("p_partkey", "if(p_partkey % 2 = 0, upper(p_brand), lower(p_brand)) as stem")
    return files.unique_stems(rows, "stem", "p_partkey")


@query("SELECT o_orderkey, CASE WHEN w IS NULL OR w < 0 THEN n - 1 ELSE least(w, n - 1) END AS last, greatest(0, CASE WHEN w IS NULL OR w < 0 THEN n - 1 ELSE least(w, n - 1) END - f + 1) AS pages FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 40 - 3 END AS w, o_orderkey % 30 + 1 AS n, o_orderkey % 11 AS f FROM orders)")
def page_ranges(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "orders").selectExpr("o_orderkey", "if(o_orderkey % 5 = 0, null, o_orderkey % 40 - 3) as w", "o_orderkey % 30 + 1 as n", "o_orderkey % 11 as f")
    return rows.select("o_orderkey", files.last_page(F.col("w"), F.col("n")).alias("last"), files.effective_pages(F.col("f"), F.col("w"), F.col("n")).alias("pages"))


@query("SELECT o_orderkey, 'd' || o_orderkey || '/' || CASE o_orderkey % 4 WHEN 0 THEN 'office' WHEN 1 THEN 'vlm' WHEN 2 THEN 'hybrid_txt' ELSE 'ocr' END AS folder FROM orders")
def result_folders(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    backend, method = F.when(k == 1, "vlm-engine").when(k == 2, "hybrid-engine").otherwise("pipeline"), F.when(k == 2, "txt").otherwise("ocr")
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", files.result_folder(F.concat(F.lit("d"), F.col("o_orderkey").cast("string")), backend, method, k == 0).alias("folder"))


@query("SELECT o_orderkey, 'cap' || CASE o_orderkey % 3 WHEN 0 THEN chr(10) || '<table/>' || chr(10) || chr(10) || 'foot' WHEN 1 THEN '  ' || chr(10) || 'img' || '  ' || chr(10) || 'foot' ELSE '  ' || chr(10) || 'foot' END AS out FROM orders")
def visual_segments(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    part = lambda text, kind: F.struct(text.alias("text"), kind.alias("kind"))
    body = part(F.when(k == 0, "<table/>").when(k == 1, "img").otherwise(""), F.when(k == 0, "html_block").otherwise("markdown_line"))
    line = F.lit("markdown_line")
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", render.segments(F.array(part(F.lit("cap"), line), body, part(F.lit("foot"), line))).alias("out"))


@query("SELECT page_id, replace(html, '</body>', '<img src=\"images/' || sha256('data:image/png;base64,aGk=') || '.png\"></body>') AS html FROM pages")
def inline_images_replaced(spark, sf_dir):
    html = F.replace(F.col("html"), F.lit("</body>"), F.lit('<img src="data:image/png;base64,aGk="></body>'))
    return fx.table(spark, sf_dir, "pages").select("page_id", files.without_data_uris(html).alias("html"))
