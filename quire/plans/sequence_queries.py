"""Operators on reading order: formula numbers, paragraph groups, runs, lines, intervals, merges, sections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.operators import sequence as q
from quire.plans import fixtures as fx
from quire.plans.registry import query

_ORDER = "OVER (PARTITION BY page_idx ORDER BY det_id)"


@query(
    f"""WITH {fx.BLOCKS_SQL}, n AS (SELECT *, lag(type, 1, '') {_ORDER} AS p1, lag(type, 2, '') {_ORDER} AS p2, lead(type, 1, '') {_ORDER} AS f1, lead(type, 2, '') {_ORDER} AS f2 FROM blocks)
SELECT page_idx, det_id, CASE WHEN type = 'interline_equation' AND f1 = 'formula_number' THEN 1 WHEN type = 'interline_equation' AND p1 = 'formula_number' AND p2 <> 'interline_equation' THEN -1 END AS tag_from,
CASE WHEN type <> 'formula_number' THEN type WHEN p1 = 'interline_equation' OR (f1 = 'interline_equation' AND f2 <> 'formula_number') THEN 'used' ELSE 'text' END AS new_type FROM n"""
)
def formula_number_tag(spark, sf_dir):
    return q.tag_formulas(fx.blocks(spark, sf_dir), q.reading_order()).select("page_idx", "det_id", "tag_from", "new_type")


@query(
    f"""WITH {fx.BLOCKS_SQL}, g AS (SELECT *, CAST(sum(CASE WHEN type IN ('title', 'interline_equation') THEN 1 ELSE 0 END) {_ORDER} AS BIGINT) AS para_group FROM blocks)
SELECT page_idx, det_id, para_group FROM g WHERE type IN ('text', 'footnote')"""
)
def para_groups(spark, sf_dir):
    return q.paragraph_groups(fx.blocks(spark, sf_dir), q.reading_order(), ("text", "footnote"), ("title", "interline_equation")).select("page_idx", "det_id", "para_group")


@query(
    f"""WITH {fx.BOXES_SQL}, t AS (SELECT page_idx, det_id, CASE WHEN score < 0.75 THEN 'ref_text' ELSE 'text' END AS type FROM boxes),
r AS (SELECT *, sum(CASE WHEN type = 'ref_text' THEN 0 ELSE 1 END) {_ORDER} AS run FROM t)
SELECT page_idx, min(det_id) AS first_id, count(*) AS n, string_agg(det_id, ',' ORDER BY det_id) AS members FROM r WHERE type = 'ref_text' GROUP BY page_idx, run"""
)
def ref_runs(spark, sf_dir):
    typed = fx.boxes(spark, sf_dir).withColumn("type", F.when(F.col("score") < 0.75, "ref_text").otherwise("text"))
    return q.merge_runs(typed, "ref_text").withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


@query(
    f"""WITH {fx.BLOCKS_SQL}, g AS (SELECT *, CAST(sum(CASE WHEN type = 'title' AND det_id % 2 = 0 THEN 1 ELSE 0 END) {_ORDER} AS BIGINT) AS grp FROM blocks WHERE type = 'title')
SELECT page_idx, grp, count(*) FILTER (det_id % 2 = 1) AS n, min(det_id) FILTER (det_id % 2 = 1) AS first_id FROM g GROUP BY ALL HAVING n > 0"""
)
def title_groups(spark, sf_dir):
    titles = fx.blocks(spark, sf_dir).where("type = 'title'").withColumn("grp", F.sum((F.col("det_id") % 2 == 0).cast("long")).over(q.running(q.reading_order())))
    return titles.where("det_id % 2 = 1").groupBy("page_idx", "grp").agg(F.count("*").alias("n"), F.min("det_id").alias("first_id"))


@query(
    f"""WITH {fx.BLOCKS_SQL}, s AS (SELECT *, max(CASE WHEN type IN ('text', 'title') THEN det_id END) OVER (PARTITION BY page_idx ORDER BY det_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM blocks)
SELECT s.page_idx, s.det_id, CASE WHEN b.type = 'text' THEN b.det_id END AS previous FROM s LEFT JOIN blocks b ON b.page_idx = s.page_idx AND b.det_id = s.last WHERE s.type = 'text'"""
)
def previous_text_block(spark, sf_dir):
    order = q.reading_order()
    rows = fx.blocks(spark, sf_dir)
    return rows.withColumn("previous", q.previous_of_type("text", "det_id", order, ("title",))).where("type = 'text'").select("page_idx", "det_id", "previous")


_LINE_BREAK = """CASE WHEN lag(y0) OVER o IS NULL THEN 1
WHEN greatest(0, least(lag(y1) OVER o, y1) - greatest(lag(y0) OVER o, y0)) / least(lag(y1) OVER o - lag(y0) OVER o, y1 - y0) > 0.6 {alone} THEN 0 ELSE 1 END"""


@query(
    f"""WITH {fx.BLOCKS_SQL}, f AS (SELECT *, {_LINE_BREAK.format(alone="AND type NOT IN ('table', 'image', 'interline_equation') AND lag(type) OVER o NOT IN ('table', 'image', 'interline_equation')")} AS b FROM blocks WINDOW o AS (PARTITION BY page_idx ORDER BY y0, det_id)),
g AS (SELECT *, CAST(sum(b) OVER (PARTITION BY page_idx ORDER BY y0, det_id) AS BIGINT) AS line FROM f)
SELECT page_idx, line, string_agg(det_id, ',' ORDER BY x0, det_id) AS spans, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM g GROUP BY page_idx, line"""
)
def merge_lines(spark, sf_dir):
    got = q.merge_lines(fx.blocks(spark, sf_dir), alone=("table", "image", "interline_equation"))
    return got.withColumn("spans", F.array_join(F.col("spans").cast("array<string>"), ","))


_COLUMN_BREAK = """CASE WHEN lag(x0) OVER o IS NULL THEN 1
WHEN greatest(0, least(lag(x1) OVER o, x1) - greatest(lag(x0) OVER o, x0)) / least(lag(x1) OVER o - lag(x0) OVER o, x1 - x0) > 0.6 THEN 0 ELSE 1 END"""


@query(
    f"""WITH {fx.BOXES_SQL}, f AS (SELECT *, {_COLUMN_BREAK} AS b FROM boxes WINDOW o AS (PARTITION BY page_idx ORDER BY x1 DESC, det_id)),
g AS (SELECT *, CAST(sum(b) OVER (PARTITION BY page_idx ORDER BY x1 DESC, det_id) AS BIGINT) AS line FROM f)
SELECT page_idx, line, string_agg(det_id, ',' ORDER BY y0, det_id) AS spans, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM g GROUP BY page_idx, line"""
)
def merge_vertical_lines(spark, sf_dir):
    got = q.merge_lines(fx.boxes(spark, sf_dir), vertical=True)
    return got.withColumn("spans", F.array_join(F.col("spans").cast("array<string>"), ","))


_UNION = """m AS (SELECT *, max({hi}) OVER (PARTITION BY page_idx ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM boxes),
r AS (SELECT *, sum(CASE WHEN reached IS NULL OR {lo} > reached THEN 1 ELSE 0 END) OVER (PARTITION BY page_idx ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS run FROM m)"""


@query(f"WITH {fx.BOXES_SQL}, {_UNION.format(lo='y0', hi='y1', order='y0, y1')} SELECT page_idx, min(y0) AS y0, max(y1) AS y1 FROM r GROUP BY page_idx, run")
def merge_intervals(spark, sf_dir):
    return q.interval_union(fx.boxes(spark, sf_dir), "y0", "y1")


@query(f"WITH {fx.BOXES_SQL}, {_UNION.format(lo='x0', hi='x1', order='x0, x1, y0, y1')} SELECT page_idx, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM r GROUP BY page_idx, run")
def merge_overlapping_spans(spark, sf_dir):
    return q.merge_overlapping(fx.boxes(spark, sf_dir))


@query(
    f"""WITH {fx.BOXES_SQL}, {_UNION.format(lo='y0', hi='y1', order='y0, y1')}, u AS (SELECT page_idx, CAST(min(y0) AS BIGINT) AS low, CAST(max(y1) AS BIGINT) AS high FROM r GROUP BY page_idx, run),
e AS (SELECT page_idx, low, high, lag(high, 1, -1) OVER (PARTITION BY page_idx ORDER BY low) + 1 AS free, lead(low) OVER (PARTITION BY page_idx ORDER BY low) AS next FROM u)
SELECT page_idx, free AS low, low - 1 AS high FROM e WHERE free <= low - 1 UNION ALL SELECT page_idx, high + 1 AS low, CAST(800 AS BIGINT) AS high FROM e WHERE next IS NULL AND high < 800"""
)
def remove_intervals(spark, sf_dir):
    masks = q.interval_union(fx.boxes(spark, sf_dir), "y0", "y1").groupBy("page_idx").agg(F.array_sort(F.collect_list(F.struct(F.col("y0").alias("low"), F.col("y1").alias("high")))).alias("masks"))
    left = q.interval_difference(F.struct(F.lit(0).alias("low"), F.lit(800).alias("high")), F.col("masks"))
    return masks.select("page_idx", F.explode(left).alias("s")).select("page_idx", "s.low", "s.high")


_CAN = "coalesce(prev_len > 20 AND ascii(line) >= 97 AND line <> '', false)"


@query(
    rf"""WITH {fx.LINES_SQL}, p AS (SELECT doc_id, line_no, line, length(lag(line) OVER (PARTITION BY doc_id ORDER BY line_no)) AS prev_len, length(line) % 5 = 0 AS long FROM lines),
c AS (SELECT *, {_CAN} AS can, lag(long) OVER (PARTITION BY doc_id ORDER BY line_no) AS prev_long FROM p),
h AS (SELECT *, sum(CASE WHEN can THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS chain FROM c)
SELECT doc_id, line_no, can AND (coalesce(prev_long, false) OR bool_or(long) OVER (PARTITION BY doc_id, chain ORDER BY line_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS joins FROM h"""
)
def paragraph_merge(spark, sf_dir):
    order = q.reading_order(("doc_id",), ("line_no",))
    rows = fx.lines(spark, sf_dir).withColumn("prev_len", F.length(F.lag("line").over(order)))
    can = (F.col("prev_len") > 20) & (F.ascii("line") >= 97) & (F.col("line") != "")
    return q.paragraph_merges(rows, can, F.length("line") % 5 == 0, ("doc_id",), ("line_no",)).select("doc_id", "line_no", "joins")


@query(
    """WITH t AS (SELECT conv_id, turn, length(text) % 3 + 1 AS level FROM conversations),
l AS (SELECT *, sum(CASE WHEN level < 2 THEN 1 ELSE 0 END) OVER w AS o2, sum(CASE WHEN level < 3 THEN 1 ELSE 0 END) OVER w AS o3, sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER w AS c1, first_value(level) OVER w > 1 AS f1 FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
m AS (SELECT *, sum(CASE WHEN level = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, o2 ORDER BY turn) AS c2, first_value(CASE WHEN level >= 2 THEN level END IGNORE NULLS) OVER (PARTITION BY conv_id, o2 ORDER BY turn) > 2 AS f2,
  sum(CASE WHEN level = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, o3 ORDER BY turn) AS c3 FROM l)
SELECT conv_id, turn, level, CAST(c1 + CASE WHEN f1 THEN 1 ELSE 0 END AS VARCHAR) || CASE WHEN level >= 2 THEN '.' || CAST(c2 + CASE WHEN f2 THEN 1 ELSE 0 END AS VARCHAR) ELSE '' END || CASE WHEN level >= 3 THEN '.' || CAST(c3 AS VARCHAR) ELSE '' END AS section FROM m"""
)
def section_numbers(spark, sf_dir):
    titles = fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length("text") % 3 + 1).cast("long").alias("level"))
    return q.section_numbers(titles, ("conv_id",), ("turn",), depth=3)


@query(
    f"""WITH {fx.BOXES_SQL}, f AS (SELECT *, det_id % 4 = 1 AND det_id > 1 AS opens FROM boxes)
SELECT page_idx, CAST(sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY page_idx ORDER BY det_id) AS BIGINT) AS item, det_id FROM f"""
)
def list_items(spark, sf_dir):
    opens = (F.col("det_id") % 4 == 1) & (F.col("det_id") > 1)
    return fx.boxes(spark, sf_dir).select("page_idx", F.sum(opens.cast("long")).over(q.running(q.reading_order())).alias("item"), "det_id")


@query(f"WITH {fx.BOXES_SQL} SELECT page_idx, det_id, CAST(row_number() OVER (PARTITION BY page_idx ORDER BY score DESC, x0, det_id) AS INT) AS new_index, CAST(ntile(3) OVER (PARTITION BY page_idx ORDER BY det_id) AS INT) AS part FROM boxes WHERE score >= 0.6")
def renumbered_detections(spark, sf_dir):
    kept = fx.boxes(spark, sf_dir).where("score >= 0.6")
    by_score = Window.partitionBy("page_idx").orderBy(F.col("score").desc(), "x0", "det_id")
    return kept.select("page_idx", "det_id", F.row_number().over(by_score).alias("new_index"), F.ntile(3).over(q.reading_order()).alias("part"))
