"""String functions over documents, with cases put in by doc_id that the corpus lacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as t
from quire.plans import fixtures as fx
from quire.plans.registry import query

#: Prefixes by doc_id % 8; DuckDB and Spark both take them as literals.
CASES = ("Ａ１（ｂ）", "# ", "ﬁx ﬃ ", "  - ", "x\\*a*b`c$ \\\\_", "中文*a* ", "+ plus ", "a\\_b ~s~ ")
_QUOTED = ["'" + c.replace("'", "''") + "'" for c in CASES]
CASES_SQL = f"cases AS (SELECT doc_id, CASE doc_id % 8 {' '.join(f'WHEN {i} THEN {q}' for i, q in enumerate(_QUOTED))} END || text AS text FROM documents)"

_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(chr(ord(c) - 0xFEE0) for c in _WIDE).replace("'", "''")
_WIDE_L = "".join(c for c in _WIDE if chr(ord(c) - 0xFEE0).isalnum())
_NARROW_L = "".join(chr(ord(c) - 0xFEE0) for c in _WIDE_L)


def cases(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents")
    prefix = F.element_at(F.array(*map(F.lit, CASES)), (F.col("doc_id") % 8 + 1).cast("int"))
    return docs.select("doc_id", F.concat(prefix, F.col("text")).alias("text"))


def _each(spark, sf_dir, f):
    return cases(spark, sf_dir).select("doc_id", f(F.col("text")).alias("out"))


def _sql(expression: str) -> str:
    return f"WITH {CASES_SQL} SELECT doc_id, {expression} AS out FROM cases"


@query(_sql(f"translate(text, '{_WIDE}', '{_NARROW}')"))
def full_to_half(spark, sf_dir):
    return _each(spark, sf_dir, t.half_width)


@query(_sql(f"translate(text, '{_WIDE_L}', '{_NARROW_L}')"))
def half_keep_marks(spark, sf_dir):
    return _each(spark, sf_dir, t.half_width_letters)


@query(_sql("replace(replace(text, 'ﬁ', 'fi'), 'ﬃ', 'ffi')"))
def ligatures(spark, sf_dir):
    return _each(spark, sf_dir, t.expand_ligatures)


# RE2 has no look-behind: the text is cut into characters and escaped pairs, and bare characters are escaped.
@query(_sql(r"array_to_string(list_transform(regexp_extract_all(text, '(?s)\\.|.'), lambda x: CASE WHEN x IN ('*', '_', '`', '~', '$') THEN '\' || x ELSE x END), '')"))
def md_escape(spark, sf_dir):
    return _each(spark, sf_dir, t.escape_markdown)


@query(_sql(r"regexp_replace(text, '^([ \t]{0,3})(#{1,6}|[+-])([ \t])', '\1\\\2\3')"))
def md_prefix_escape(spark, sf_dir):
    return _each(spark, sf_dir, t.escape_prefix)


@query(_sql("replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"))
def html_escape(spark, sf_dir):
    return _each(spark, sf_dir, t.escape_html)


@query(
    rf"""WITH {fx.LINES_SQL}, h AS (SELECT doc_id, line_no, line || CASE WHEN line_no % 3 = 0 AND line <> '' THEN '- ' ELSE '' END AS line FROM lines)
SELECT doc_id, line_no, regexp_matches(line, '[A-Za-z]+[-\x{{AD}}\x{{2010}}\x{{2011}}\x{{2043}}]\s*$') AS hyphen, regexp_replace(line, '[-\x{{AD}}\x{{2010}}\x{{2011}}\x{{2043}}]\s*$', '') AS line FROM h"""
)
def dehyphenate(spark, sf_dir):
    rows = fx.lines(spark, sf_dir).withColumn("line", F.concat("line", F.when((F.col("line_no") % 3 == 0) & (F.col("line") != ""), "- ").otherwise("")))
    return rows.select("doc_id", "line_no", t.ends_with_hyphen(F.col("line")).alias("hyphen"), t.without_line_hyphen(F.col("line")).alias("line"))


@query("SELECT doc_id, upper(md5(text)) AS md5_upper, md5(text) AS md5_lower, sha256(text) AS sha256_hex FROM documents")
def text_hashes(spark, sf_dir):
    text = F.col("text")
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.upper(F.md5(text)).alias("md5_upper"), F.md5(text).alias("md5_lower"), F.sha2(text, 256).alias("sha256_hex"))


@query(
    f"""WITH {fx.BOXES_SQL} SELECT page_idx, det_id, sha256('image/' || md5(CAST(page_idx AS VARCHAR)) || '_' || page_idx || '_' || CAST(x0 AS BIGINT) || '_' || CAST(y0 AS BIGINT) || '_' || CAST(x1 AS BIGINT) || '_' || CAST(y1 AS BIGINT)) || '.jpg' AS image_path FROM boxes"""
)
def image_paths(spark, sf_dir):
    box = F.array(*[F.col(k).cast("long") for k in ("x0", "y0", "x1", "y1")])
    return fx.boxes(spark, sf_dir).select("page_idx", "det_id", t.image_name(F.lit("image"), F.md5(F.col("page_idx").cast("string")), F.col("page_idx"), box).alias("image_path"))


@query(
    r"""SELECT s_suppkey, regexp_extract('s3://b' || s_nationkey || '/k/' || s_name || '?bytes=' || s_suppkey || ',9', '^s3a?://([^/]+)/', 1) AS bucket, 'k/' || s_name AS key, s_suppkey AS first_byte FROM supplier"""
)
def s3_paths(spark, sf_dir):
    path = F.concat(F.lit("s3://b"), F.col("s_nationkey").cast("string"), F.lit("/k/"), F.col("s_name"), F.lit("?bytes="), F.col("s_suppkey").cast("string"), F.lit(",9"))
    rows = fx.table(spark, sf_dir, "supplier").select("s_suppkey", path.alias("path"))
    at = t.bucket_and_key(t.without_arguments(F.col("path")))
    return rows.select("s_suppkey", at["bucket"].alias("bucket"), at["key"].alias("key"), F.get(t.byte_range(F.col("path")), F.lit(0)).alias("first_byte"))


@query(
    """SELECT p_partkey, CASE WHEN n >= 702 THEN chr(CAST(65 + (n // 26 - 1) // 26 - 1 AS INT)) ELSE '' END || CASE WHEN n >= 26 THEN chr(CAST(65 + (n // 26 - 1) % 26 AS INT)) ELSE '' END || chr(CAST(65 + n % 26 AS INT)) AS letters, CAST(n + 1 AS INT) AS number
FROM (SELECT p_partkey, (p_partkey * 13) % 16384 AS n FROM part)"""
)
def column_letters(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "part").select("p_partkey", F.expr("(p_partkey * 13) % 16384 + 1").alias("n"))
    return rows.select("p_partkey", t.column_letters(F.col("n")).alias("letters"), t.column_number(t.column_letters(F.col("n"))).alias("number"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(DATE '1899-12-30' + CAST(30000 + o_orderkey % 20000 AS INT), '%Y-%m-%d')
ELSE strftime(CAST(DATE '1904-01-01' + CAST(30000 + o_orderkey % 20000 AS INT) AS TIMESTAMP) + INTERVAL 12 HOUR, '%Y-%m-%dT%H:%M:%S') END AS iso FROM orders"""
)
def excel_dates(spark, sf_dir):
    odd = F.col("o_orderkey") % 2 == 1
    serial = (30000 + F.col("o_orderkey") % 20000).cast("double") + F.when(odd, 0.5).otherwise(0.0)
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", t.excel_date(serial, odd).alias("iso"))


@query(
    r"""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'x_' || o_orderkey || ' \tag{' || o_orderkey % 90 || '}' END AS tagged FROM orders""".replace(" \\tag", "\\tag")
)
def formula_tags(spark, sf_dir):
    key = F.col("o_orderkey")
    formula = F.when(key % 7 == 0, "").otherwise(F.concat(F.lit("\\[ x_"), key.cast("string"), F.lit(" \\]")))
    number = F.concat(F.lit(" （"), (key % 90).cast("string"), F.lit("） "))
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", t.tagged_formula(formula, number).alias("tagged"))


@query(r"""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'a  $x' || o_orderkey || '$  b' ELSE '<img src="img/p.png"><img src="data:x">' END AS html FROM orders""")
def table_html_links(spark, sf_dir):
    key = F.col("o_orderkey")
    html = F.when(key % 2 == 0, F.concat(F.lit("a <eq>x"), key.cast("string"), F.lit("</eq> b"))).otherwise('<img src="p.png"><img src="data:x">')
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", t.equations_in_table(t.with_image_prefix(html, "img")).alias("html"))
