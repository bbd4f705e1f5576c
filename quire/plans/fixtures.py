"""Layout relations made from the driver's tables by integer arithmetic that Spark and SQL share.

The tables have no coordinates, so pages, boxes, typed blocks, lines and cells are derived from
`lineitem` and `documents`. A page holds about thirty boxes at every scale factor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Types of the blocks, by det_id % 8, and a second order that puts other types side by side.
TYPES = ("text", "title", "table", "caption", "interline_equation", "formula_number", "footnote", "image")

_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate"

BOXES_SQL = f"""
boxes AS (
  SELECT l_orderkey // 8 AS page_idx, row_number() OVER (PARTITION BY l_orderkey // 8 ORDER BY {_ORDER}) AS det_id,
         CAST((l_partkey * 37) % 500 AS DOUBLE) AS x0, CAST((l_suppkey * 53 + l_linenumber * 11) % 700 AS DOUBLE) AS y0,
         CAST((l_partkey * 37) % 500 + 20 + 3 * CAST(l_quantity AS INT) AS DOUBLE) AS x1,
         CAST((l_suppkey * 53 + l_linenumber * 11) % 700 + 8 + 4 * l_linenumber AS DOUBLE) AS y1,
         round(0.5 + 4 * l_discount, 4) AS score
  FROM lineitem)"""

_KIND_SQL = "CASE {} % 8 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TYPES)) + " END"
BLOCKS_SQL = BOXES_SQL + f", blocks AS (SELECT *, {_KIND_SQL.format('(det_id * 7 + page_idx)')} AS type FROM boxes)"

LINES_SQL = r"""
lines AS (
  SELECT doc_id, line_no, line_no // 40 AS page_idx, line, CAST(50 + 15 * (line_no % 3) AS DOUBLE) AS x0, CAST(20 * (line_no % 40) AS DOUBLE) AS y0,
         CAST(50 + 15 * (line_no % 3) + 6 * length(line) AS DOUBLE) AS x1, CAST(20 * (line_no % 40) + 14 AS DOUBLE) AS y1
  FROM (SELECT doc_id, generate_subscripts(parts, 1) - 1 AS line_no, unnest(parts) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)))"""

CELLS_SQL = """
cells AS (SELECT DISTINCT l_orderkey // 32 AS sheet, CAST(l_partkey % 40 AS INT) AS r, CAST(l_suppkey % 12 AS INT) AS c FROM lineitem WHERE l_suppkey % 3 <> 0)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_idx, det_id, x0, y0, x1, y1, score"""
    rows = table(spark, sf_dir, "lineitem").withColumn("page_idx", F.expr("l_orderkey div 8"))
    order = Window.partitionBy("page_idx").orderBy(*_ORDER.split(", "))
    x0, y0 = F.expr("(l_partkey * 37) % 500"), F.expr("(l_suppkey * 53 + l_linenumber * 11) % 700")
    return rows.select(
        "page_idx", F.row_number().over(order).cast("long").alias("det_id"), x0.cast("double").alias("x0"), y0.cast("double").alias("y0"),
        (x0 + 20 + 3 * F.col("l_quantity").cast("int")).cast("double").alias("x1"), (y0 + 8 + 4 * F.col("l_linenumber")).cast("double").alias("y1"), F.round(0.5 + 4 * F.col("l_discount"), 4).alias("score"),
    )


def kind_of(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TYPES)), (F.pmod(number, F.lit(8)) + 1).cast("int"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """boxes with a type"""
    return boxes(spark, sf_dir).withColumn("type", kind_of(F.col("det_id") * 7 + F.col("page_idx")))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no, page_idx, line, x0, y0, x1, y1: the lines of each document on pages of forty"""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    x0, y0 = 50 + 15 * (F.col("line_no") % 3), 20 * (F.col("line_no") % 40)
    return rows.select(
        "doc_id", F.col("line_no").cast("long").alias("line_no"), F.expr("cast(line_no div 40 as long)").alias("page_idx"), "line",
        x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), (x0 + 6 * F.length("line")).cast("double").alias("x1"), (y0 + 14).cast("double").alias("y1"),
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sheet, r, c: cells with a value"""
    rows = table(spark, sf_dir, "lineitem").where("l_suppkey % 3 <> 0")
    cells = rows.select(F.expr("l_orderkey div 32").alias("sheet"), F.expr("cast(l_partkey % 40 as int)").alias("r"), F.expr("cast(l_suppkey % 12 as int)").alias("c"))
    return cells.repartition("sheet").distinct()  # dealt by sheet, so that whatever works on a sheet moves nothing again
