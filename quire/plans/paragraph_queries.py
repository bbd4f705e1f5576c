"""Paragraphs of documents whose lines are set in blocks of up to five on pages of forty lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import paragraphs
from quire.plans import fixtures as fx
from quire.plans.registry import query


def line_blocks(spark, sf_dir):
    """doc_id, page_idx, block_id, type, box, page_width, lines: neighbouring lines of a document; every seventh block is a title, every eleventh vertical."""
    rows = fx.lines(spark, sf_dir)
    left = 50 + F.when(F.col("line_no") % 4 == 3, 30).otherwise(0)
    right = F.least(left + 6 * F.length("line"), F.lit(550)) - F.when(F.col("line_no") % 9 == 8, 200).otherwise(0)
    rows = rows.select("doc_id", "page_idx", "line_no", (F.expr("line_no div 5")).alias("block_id"), left.cast("double").alias("x0"), F.col("y0"), F.greatest(right, left + 10).cast("double").alias("x1"), F.col("y1"), F.col("line").alias("text"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "x0", "y0", "x1", "y1", "text"))), lambda x: F.struct(x["x0"].alias("x0"), x["y0"].alias("y0"), x["x1"].alias("x1"), x["y1"].alias("y1"), x["text"].alias("text")))
    got = rows.groupBy("doc_id", "page_idx", "block_id").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), lines.alias("lines"))
    kind = F.when(F.col("block_id") % 7 == 6, "paragraph_title").when(F.col("block_id") % 11 > 8, "vertical_text").otherwise("text")
    return got.withColumns({"type": kind, "page_width": F.lit(600.0)})


@query()
def paragraphs_of_documents(spark, sf_dir):
    flags = lambda c: F.array_join(F.transform(c, lambda x: x.cast("int").cast("string")), "")
    return paragraphs.merged_paragraphs(line_blocks(spark, sf_dir)).select("doc_id", "page_idx", "block_id", "kind", flags("starts").alias("starts"), flags("ends").alias("ends"), "para_group", "joins", "cross_page")
