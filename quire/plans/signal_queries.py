"""Signals of the text layer over documents as pages of forty lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import signals as s
from quire.plans import fixtures as fx
from quire.plans.registry import query

_PUNCT = r"[!-/:-@\[-`{-~]"
#: Lines joined back into pages; marks are put in so that odd pages occur.
PAGES_SQL = rf"""{fx.LINES_SQL}, samples AS (SELECT doc_id, page_idx AS page_index, string_agg(line, ' ' ORDER BY line_no) || CASE WHEN doc_id % 9 = 0 THEN repeat('#$%^&*', 40) WHEN doc_id % 9 = 1 THEN repeat(chr(57344), 20) ELSE '' END AS text FROM lines GROUP BY doc_id, page_idx),
clean AS (SELECT *, regexp_replace(text, '\s+', '', 'g') AS c FROM samples)"""


def samples(spark, sf_dir):
    pages = fx.lines(spark, sf_dir).groupBy("doc_id", F.col("page_idx").alias("page_index")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " ").alias("text"))
    more = F.when(F.col("doc_id") % 9 == 0, F.repeat(F.lit("#$%^&*"), F.lit(40))).when(F.col("doc_id") % 9 == 1, F.repeat(F.lit(""), F.lit(20))).otherwise("")
    return pages.withColumn("text", F.concat("text", more))


_PAGE_SIGNALS = rf"""page_signals AS (SELECT doc_id, page_index, length(c) AS chars, len(regexp_extract_all(c, '{_PUNCT}')) AS punct, runs FROM (SELECT *, regexp_extract_all(c, '{_PUNCT}{{4,}}') AS runs FROM clean)),
counted AS (SELECT doc_id, page_index, chars, punct, length(array_to_string(runs, '')) AS run_chars, CASE WHEN len(runs) = 0 THEN 0 ELSE len(list_distinct(string_split(array_to_string(runs, ''), ''))) END AS run_kinds FROM page_signals),
page_out AS (SELECT *, chars >= 100 AND punct >= 0.25 * chars AND run_chars >= 0.1 * chars AND run_kinds > 1 AS odd_punct FROM counted)"""


@query(f"WITH {PAGES_SQL}, {_PAGE_SIGNALS} SELECT doc_id, page_index, chars, punct, run_chars, CAST(run_kinds AS BIGINT) AS run_kinds, odd_punct FROM page_out")
def punct_run_signal(spark, sf_dir):
    return s.page_signals(samples(spark, sf_dir))


_QUALITY = r"""quality AS (SELECT doc_id, CAST(sum(length(c)) AS BIGINT) AS total, CAST(sum(len(regexp_extract_all(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]')) + len(regexp_extract_all(text, '\x{fffd}')) + len(regexp_extract_all(text, '[\x{e000}-\x{f8ff}]'))) AS BIGINT) AS abnormal FROM clean GROUP BY doc_id),
quality_out AS (SELECT *, round(CASE WHEN total = 0 THEN 0 ELSE abnormal / total END, 6) AS abnormal_ratio, total >= 300 AND abnormal >= 0.03 * total AS bad_quality FROM quality)"""


@query(f"WITH {PAGES_SQL}, {_QUALITY} SELECT * FROM quality_out")
def text_quality_signal(spark, sf_dir):
    return s.quality_signals(samples(spark, sf_dir))


@query(
    f"""WITH {PAGES_SQL}, {_PAGE_SIGNALS}, {_QUALITY}, p AS (SELECT doc_id, avg(chars) AS avg_chars, bool_or(odd_punct) AS odd FROM page_out GROUP BY doc_id)
SELECT doc_id, round(avg_chars, 6) AS avg_chars, CASE WHEN avg_chars < 50 OR odd OR bad_quality THEN 'ocr' ELSE 'txt' END AS method FROM p JOIN quality_out USING (doc_id)"""
)
def classify_txt_ocr(spark, sf_dir):
    return s.classify(samples(spark, sf_dir))


_SCRIPTS = {"latin": r"[A-Za-z]", "latin_marks": r"[À-ɏ]", "digits": r"[0-9]"}


@query(
    rf"""WITH {PAGES_SQL}, k AS (SELECT doc_id, CAST(sum(length(c)) AS BIGINT) AS total, CAST(sum(len(regexp_extract_all(c, '[\x{{4e00}}-\x{{9fff}}]'))) AS BIGINT) AS cjk, sum(len(regexp_extract_all(c, '[A-Za-z]'))) AS a, sum(len(regexp_extract_all(c, '[\x{{c0}}-\x{{24f}}]'))) AS b, sum(len(regexp_extract_all(c, '[0-9]'))) AS d FROM clean GROUP BY doc_id),
n AS (SELECT doc_id, unnest([struct_pack(n := -a, name := 'latin'), struct_pack(n := -b, name := 'latin_marks'), struct_pack(n := -d, name := 'digits')]) AS x FROM k),
t AS (SELECT doc_id, string_agg(x.name, ',' ORDER BY x.n, x.name) AS top FROM n WHERE x.n < 0 GROUP BY doc_id)
SELECT k.doc_id, total, cjk, CAST(a + b + d AS BIGINT) AS "foreign", CAST(CASE WHEN a >= 5 THEN 1 ELSE 0 END + CASE WHEN b >= 5 THEN 1 ELSE 0 END + CASE WHEN d >= 5 THEN 1 ELSE 0 END AS BIGINT) AS dense_scripts, coalesce(top, '') AS top_scripts, false AS odd_scripts FROM k LEFT JOIN t USING (doc_id)"""
)
def cross_script_signal(spark, sf_dir):
    return s.script_signals(samples(spark, sf_dir), _SCRIPTS)


@query(
    r"""SELECT doc_id, n, round(CASE WHEN l = 0 THEN 0 ELSE n / l END, 6) AS ratio, run, n >= 2 AND (run >= 2 OR n >= 0.05 * l) AS odd FROM
(SELECT doc_id, len(regexp_extract_all(t, '[\x{e000}-\x{f8ff}]')) AS n, coalesce(list_max(list_transform(regexp_extract_all(t, '[\x{e000}-\x{f8ff}]+'), lambda x: length(x))), 0) AS run, length(regexp_replace(t, '\s+', '', 'g')) AS l
 FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN chr(57344) || chr(57345) WHEN 1 THEN chr(57344) || 'a' || chr(57400) ELSE '' END || text AS t FROM documents))"""
)
def pua_signal(spark, sf_dir):
    kind = F.col("doc_id") % 4
    text = F.concat(F.when(kind == 0, "").when(kind == 1, "a").otherwise(""), F.col("text"))
    return fx.table(spark, sf_dir, "documents").select("doc_id", s.private_use(text).alias("p")).select("doc_id", "p.n", "p.ratio", "p.run", "p.odd")


@query(
    """WITH d AS (SELECT o_orderkey, o_orderkey % 70 AS n FROM orders),
e AS (SELECT o_orderkey, n, unnest(CASE WHEN n = 0 THEN CAST([] AS BIGINT[]) WHEN n <= 10 THEN range(0, n) ELSE list_transform(range(0, 10), lambda i: CAST(round_even(i * (n - 1) / 9, 0) AS BIGINT)) END) AS page FROM d)
SELECT o_orderkey, CAST(page AS INT) AS page FROM e"""
)
def sample_pages(spark, sf_dir):
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", F.explode(s.sample_pages((F.col("o_orderkey") % 70).cast("int"))).alias("page"))


@query(
    """WITH u AS (SELECT l_orderkey % 500 AS doc_id, l_orderkey // 500 % 3 AS page_index, 'f' || l_partkey % 6 AS font, l_suppkey % 40 AS chars, CASE WHEN l_partkey % 6 = 2 THEN l_suppkey % 40 ELSE 0 END AS cjk, l_partkey % 6 = 1 AND l_orderkey % 3 = 0 AS cid, l_partkey % 6 = 2 AND l_orderkey % 5 = 0 AS latin FROM lineitem),
p AS (SELECT doc_id, page_index, sum(chars) AS all_chars, coalesce(sum(chars) FILTER (cid), 0) AS cid_chars FROM u GROUP BY ALL), f AS (SELECT doc_id, page_index, font, sum(chars) AS n, sum(cjk) AS c, bool_or(latin) AS latin FROM u GROUP BY ALL)
SELECT doc_id, bool_or(cid_chars >= 30 AND cid_chars >= 0.01 * all_chars) AS odd_cid, bool_or(latin AND n >= 30 AND n >= 0.01 * all_chars AND c >= 0.8 * n) AS odd_latin FROM f JOIN p USING (doc_id, page_index) GROUP BY doc_id"""
)
def font_signal(spark, sf_dir):
    usage = fx.table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey % 500 as doc_id", "(l_orderkey div 500) % 3 as page_index", "concat('f', l_partkey % 6) as font", "l_suppkey % 40 as chars", "if(l_partkey % 6 = 2, l_suppkey % 40, 0) as cjk",
        "l_partkey % 6 = 1 and l_orderkey % 3 = 0 as cid", "l_partkey % 6 = 2 and l_orderkey % 5 = 0 as latin",
    )
    return s.font_signals(usage)


@query(
    f"""WITH {fx.BLOCKS_SQL}, i AS (SELECT page_idx, sum((x1 - x0) * (y1 - y0)) AS a FROM blocks WHERE type = 'image' GROUP BY ALL), p AS (SELECT DISTINCT page_idx // 4 AS doc_id, page_idx FROM blocks)
SELECT doc_id, round(avg(CASE WHEN least(coalesce(a, 0) / 8000, 1) >= 0.8 THEN 1 ELSE 0 END), 6) AS covered, round(avg(CASE WHEN least(coalesce(a, 0) / 8000, 1) >= 0.8 THEN 1 ELSE 0 END), 6) >= 0.8 AS odd_images FROM p LEFT JOIN i USING (page_idx) GROUP BY doc_id"""
)
def image_coverage_signal(spark, sf_dir):
    blocks = fx.blocks(spark, sf_dir).selectExpr("page_idx div 4 as doc_id", "page_idx as page_index", "type", "(x1 - x0) * (y1 - y0) as area")
    return s.image_coverage(blocks.where("type = 'image'"), blocks.select("doc_id", "page_index", F.lit(8000.0).alias("area")).distinct())
