"""Office texts, captions and cells over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import rich
from quire.plans import fixtures as fx
from quire.plans.registry import query

_TAILS = ("(续)", "（续表）", "continued", " Continued", "(CONT.)", "(continued) b", "", "x", "discontinued", "续表 ")
_TAILS_SQL = "[" + ", ".join(f"'{x}'" for x in _TAILS) + "]"
_ENDS = " OR ".join(f"ends_with(p, '{m}')" for m in rich.CONTINUED if m != "continued")


@query(
    rf"""WITH t AS (SELECT doc_id, lower(translate(trim(text || {_TAILS_SQL}[1 + doc_id % {len(_TAILS)}], chr(32) || chr(9) || chr(10) || chr(13)), '（）', '()')) AS p FROM documents)
SELECT doc_id, p <> '' AND ({_ENDS} OR regexp_matches(p, '(^|[^\p{{L}}])continued$') OR contains(p, '(continued)')) AS goes_on FROM t"""
)
def table_continuations(spark, sf_dir):
    tail = F.element_at(F.array(*map(F.lit, _TAILS)), (1 + F.col("doc_id") % len(_TAILS)).cast("int"))
    return fx.table(spark, sf_dir, "documents").select("doc_id", rich.is_continuation(F.concat("text", tail)).alias("goes_on"))


@query(
    """WITH t AS (SELECT conv_id, turn, text, CASE turn % 4 WHEN 0 THEN NULL WHEN 1 THEN '.' WHEN 2 THEN ' ' ELSE 'https://x/' || conv_id END AS link, list_filter([CASE WHEN length(text) % 2 = 0 THEN 'bold' END, CASE WHEN length(text) % 3 = 0 THEN 'italic' END, CASE WHEN length(text) % 5 = 0 THEN 'underline' END], lambda x: x IS NOT NULL) AS names FROM conversations)
SELECT conv_id, turn, CASE WHEN len(names) > 0 THEN list_aggregate(names, 'string_agg', ',') END AS style, CASE WHEN text = '' THEN text
 WHEN turn % 4 = 3 THEN '<hyperlink>' || CASE WHEN len(names) > 0 THEN '<text style="' || list_aggregate(names, 'string_agg', ',') || '">' || text || '</text>' ELSE '<text>' || text || '</text>' END || '<url>' || link || '</url></hyperlink>'
 WHEN len(names) > 0 THEN '<text style="' || list_aggregate(names, 'string_agg', ',') || '">' || text || '</text>' ELSE text END AS tagged FROM t"""
)
def tagged_texts(spark, sf_dir):
    n = F.length("text")
    style = rich.style_names(bold=n % 2 == 0, italic=n % 3 == 0, underline=n % 5 == 0)
    link = F.when(F.col("turn") % 4 == 1, ".").when(F.col("turn") % 4 == 2, " ").when(F.col("turn") % 4 == 3, F.concat(F.lit("https://x/"), F.col("conv_id").cast("string")))
    rows = fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", style.alias("style"), link.alias("link"))
    return rows.select("conv_id", "turn", "style", rich.tagged_text(F.col("text"), F.col("link"), F.col("style")).alias("tagged"))


_HEADING = "CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN ' ' || o_orderkey WHEN 2 THEN (o_orderkey % 9) || '.' || (o_orderkey % 7) WHEN 3 THEN '1.' || (o_orderkey % 9) || '.' || (o_orderkey % 7) || '. ' ELSE '2.3.4.' || (o_orderkey % 5) END || CASE WHEN o_orderkey % 2 = 0 THEN '中文' ELSE ' of ' END || o_orderpriority"


@query(
    rf"""WITH h AS (SELECT o_orderkey, CAST(1 + o_orderkey % 4 AS INT) AS level, {_HEADING} AS t FROM orders),
n AS (SELECT *, regexp_extract(trim(t), '^(\d+(?:\.\d+)*)', 1) AS a, regexp_extract(trim(t), '^(\d+(?:\.\d+)+)(?:[^\d.]|$)', 1) AS b FROM h)
SELECT o_orderkey, CASE WHEN a <> '' AND len(string_split(a, '.')) = level THEN list_aggregate(list_transform(string_split(a, '.'), lambda x: CAST(CAST(x AS INT) AS VARCHAR)), 'string_agg', '.') END AS parts,
CASE WHEN b <> '' AND len(string_split(b, '.')) - 1 < level - 1 THEN CAST(len(string_split(b, '.')) - 1 AS INT) ELSE level - 1 END AS contents_level FROM n"""
)
def section_numbers_of_titles(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "orders").select("o_orderkey", F.expr("cast(1 + o_orderkey % 4 as int)").alias("level"), F.expr(_HEADING).alias("t"))
    parts = F.array_join(rich.section_parts(F.col("t"), F.col("level")).cast("array<string>"), ".")
    return rows.select("o_orderkey", parts.alias("parts"), rich.contents_level(F.col("level") - 1, F.col("t")).alias("contents_level"))


_ENTRY = "'Chapter ' || o_orderkey || chr(9) || CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey % 300 AS VARCHAR) WHEN 1 THEN 'xiv' WHEN 2 THEN 'two words' ELSE 'A' END"


@query(
    rf"""WITH e AS (SELECT o_orderkey, {_ENTRY} AS t, string_split({_ENTRY}, chr(9))[2] AS tail FROM orders)
SELECT o_orderkey, 'a b' || CASE WHEN regexp_full_match(tail, '\d+|[ivxlcdmIVXLCDM]+|[A-Za-z]') THEN string_split(t, chr(9))[1] ELSE replace(t, chr(9), ' ') END || 'x' || chr(9) AS entry FROM e"""
)
def contents_entries(spark, sf_dir):
    entry = F.concat(F.lit("Chapter "), F.col("o_orderkey").cast("string"), F.lit("\t"), F.when(F.col("o_orderkey") % 4 == 0, (F.col("o_orderkey") % 300).cast("string")).when(F.col("o_orderkey") % 4 == 1, "xiv").when(F.col("o_orderkey") % 4 == 2, "two words").otherwise("A"))
    span = lambda text, formula: F.struct(text.alias("content"), F.lit(formula).alias("formula"))
    spans = rich.without_page_tail(F.array(span(F.lit("a\tb"), False), span(entry, False), span(F.lit("x\t"), True)))
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.transform(spans, lambda s: s["content"]), "").alias("entry"))


@query(
    """SELECT o_orderkey, CASE WHEN o_totalprice < 1000 THEN '' WHEN o_orderkey % 3 = 0 THEN strftime(DATE '1899-12-30' + CAST(o_orderkey % 50000 + 100 AS INT), '%Y-%m-%d') WHEN o_orderkey % 3 = 1 THEN CAST(o_orderkey AS VARCHAR) ELSE CAST(o_orderkey + 0.5 AS VARCHAR) END AS cell FROM orders"""
)
def cell_texts(spark, sf_dir):
    kind = F.col("o_orderkey") % 3
    value = F.when(F.col("o_totalprice") < 1000, None).when(kind == 0, F.col("o_orderkey") % 50000 + 100).when(kind == 1, F.col("o_orderkey")).otherwise(F.col("o_orderkey") + 0.5).cast("double")
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", rich.cell_text(value, kind == 0).alias("cell"))


@query(
    """WITH c AS (SELECT o_orderkey, 1 + o_orderkey % 26 AS a, 27 + o_orderkey % 26 AS b, 1 + o_orderkey % 90 AS r FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL WHEN o_orderkey % 4 = 0 THEN 'It''s' ELSE 'Data' END AS sheet, CASE WHEN o_orderkey % 4 < 3 THEN CAST(a AS INT) END AS min_col, CASE WHEN o_orderkey % 4 < 3 THEN CAST(r AS INT) END AS min_row,
CASE WHEN o_orderkey % 4 = 2 THEN CAST(a AS INT) WHEN o_orderkey % 4 < 2 THEN CAST(b AS INT) END AS max_col, CASE WHEN o_orderkey % 4 = 2 THEN CAST(r AS INT) WHEN o_orderkey % 4 < 2 THEN CAST(r + 4 AS INT) END AS max_row FROM c"""
)
def cell_ranges(spark, sf_dir):
    key = F.col("o_orderkey")
    first = F.concat(F.lit("$"), F.chr(65 + key % 26), F.lit("$"), (1 + key % 90).cast("string"))
    last = F.concat(F.lit(":$A"), F.chr(65 + key % 26), F.lit("$"), (5 + key % 90).cast("string"))
    formula = F.when(key % 4 == 0, F.concat(F.lit("='It''s'!"), first, last)).when(key % 4 == 1, F.concat(F.lit(" Data!"), first, last)).when(key % 4 == 2, F.concat(F.lit("Data!"), first)).otherwise(F.concat(F.lit("Data!#REF"), last))
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", rich.cell_range(formula).alias("r")).select("o_orderkey", "r.*")


@query(
    """WITH c AS (SELECT o_custkey, list(o_orderpriority || '<&' ORDER BY o_orderkey) AS a, list(CAST(o_orderkey AS VARCHAR) ORDER BY o_orderkey) AS b FROM orders GROUP BY o_custkey)
SELECT o_custkey, '<table><thead><tr><th>p&amp;</th><th>k</th></tr></thead><tbody>' || list_aggregate(list_transform(range(1, len(a) + 2), lambda i: '<tr><td>' || coalesce(replace(replace(a[i], '&', '&amp;'), '<', '&lt;'), '') || '</td><td>' || coalesce(b[i], '') || '</td></tr>'), 'string_agg', '') || '</tbody></table>' AS html FROM c"""
)
def chart_tables(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("s"))
    columns = F.array(F.transform("s", lambda x: F.concat(x["o_orderpriority"], F.lit("<&"))), F.transform("s", lambda x: x["o_orderkey"].cast("string")))
    return rows.select("o_custkey", rich.table_of_columns(F.array(F.lit("p&"), F.lit("k")), columns, F.size("s") + 1).alias("html"))


@query(
    """WITH t AS (SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM conversations)
SELECT conv_id, turn, role = 'user' AND regexp_matches(text, '[\\p{P}\\p{S}]$') AND regexp_matches(after, '^[^\\p{P}\\p{S}\\s]') AS apart FROM t WHERE after IS NOT NULL""".replace("\\\\", "\\")
)
def spaces_between_styles(spark, sf_dir):
    order = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = fx.table(spark, sf_dir, "conversations").withColumn("after", order).where("after is not null")
    return rows.select("conv_id", "turn", rich.needs_space(F.col("text"), F.col("after"), F.col("role") == "user", F.lit("text")).alias("apart"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '(' || p_partkey || ')' ELSE 'ab' || p_partkey END AS number, CASE p_partkey % 4 WHEN 0 THEN '否' WHEN 1 THEN CAST(p_partkey % 10 AS VARCHAR) WHEN 2 THEN '1' || (p_partkey % 10) || '號' ELSE '哦' END AS cell FROM part")
def recognised_cells(spark, sf_dir):
    key = F.col("p_partkey")
    span = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("content"))
    own = F.when(key % 3 == 0, F.concat(F.lit(" ("), key.cast("string"), F.lit(") "))).when(key % 3 == 1, " ")
    number = rich.formula_number(own, F.array(span("text", F.lit(" ab")), span("image", F.lit("zz")), span("text", key.cast("string"))))
    digit = (key % 10).cast("string")
    cell = F.when(key % 4 == 0, "香").when(key % 4 == 1, F.concat(digit, F.lit("號"))).when(key % 4 == 2, F.concat(F.lit("1"), digit, F.lit("號"))).otherwise("哦樂")
    return fx.table(spark, sf_dir, "part").select("p_partkey", number.alias("number"), rich.recognised_cell(cell).alias("cell"))


@query("""SELECT p_partkey, md5('{"brand": "' || p_brand || '", "name": "' || replace(p_name, '"', '\\"') || '", "q\\"": "中"}') AS md5, CAST(CASE WHEN p_partkey % 3 = 1 THEN p_partkey ELSE 64 END AS INT) AS setting FROM part""")
def map_hashes(spark, sf_dir):
    values = F.create_map(F.lit("name"), F.col("p_name"), F.lit('q"'), F.lit("中"), F.lit("brand"), F.col("p_brand"))
    key = F.col("p_partkey")
    setting = F.when(key % 3 == 0, "no number").when(key % 3 == 1, F.concat(F.lit(" "), key.cast("string"))).otherwise("-5")
    return fx.table(spark, sf_dir, "part").select("p_partkey", rich.map_md5(values).alias("md5"), rich.positive_setting(setting, 64).alias("setting"))


@query(
    f"""WITH {fx.BOXES_SQL}, c AS (SELECT page_idx, det_id, CASE CAST(round(score * 100) AS BIGINT) % 3 WHEN 0 THEN 'sup' WHEN 1 THEN 'sub' ELSE 'body' END AS role, CAST(det_id % 10 AS VARCHAR) AS ch FROM boxes),
f AS (SELECT *, CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS b FROM c WINDOW w AS (PARTITION BY page_idx ORDER BY det_id)), r AS (SELECT *, sum(b) OVER (PARTITION BY page_idx ORDER BY det_id) AS run FROM f),
g AS (SELECT page_idx, run, any_value(role) AS role, string_agg(ch, '' ORDER BY det_id) AS t FROM r GROUP BY page_idx, run)
SELECT page_idx, string_agg(CASE WHEN role = 'body' THEN t ELSE '<' || role || '>' || t || '</' || role || '>' END, '' ORDER BY run) AS text FROM g GROUP BY page_idx"""
)
def script_runs(spark, sf_dir):
    kind = F.expr("cast(round(score * 100) as bigint) % 3")
    chars = fx.boxes(spark, sf_dir).select("page_idx", F.col("det_id").alias("char_idx"), F.when(kind == 0, "sup").when(kind == 1, "sub").otherwise("body").alias("role"), (F.col("det_id") % 10).cast("string").alias("char"))
    return rich.script_runs(chars, ("page_idx",))
