"""Grids of tables made from the cells of sheets, with spans by row and column."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import grids
from quire.plans import fixtures as fx
from quire.plans.registry import query


def sheets(spark, sf_dir):
    """sheet, rows: the cells of a sheet that lie in every third column, row after row, with spans of one to three."""
    cells = fx.cells(spark, sf_dir).where("c % 3 <> 2")
    colspan, rowspan = 1 + (F.col("r") + F.col("c")) % 2, 1 + F.when((F.col("r") * F.col("c")) % 5 == 3, 2).when(F.col("c") % 4 == 1, 1).otherwise(0)
    cell = F.struct(F.concat(F.lit(" ｒ"), F.col("r").cast("string"), F.lit("c"), F.col("c").cast("string")).alias("text"), colspan.cast("int").alias("colspan"), rowspan.cast("int").alias("rowspan"))
    rows = cells.groupBy("sheet", "r").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", cell.alias("cell")))), lambda x: x["cell"]).alias("row"))
    return rows.groupBy("sheet").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "row"))), lambda x: x["row"]).alias("rows"))


@query()
def table_grids(spark, sf_dir):
    rows = sheets(spark, sf_dir).withColumn("g", grids.grid(F.col("rows")))
    line = lambda x: F.array_join(F.transform(x, lambda v: F.coalesce(v.cast("string"), F.lit("-"))), ",")
    return rows.select("sheet", F.array_join(F.transform("g", line), ";").alias("grid"), grids.width(F.col("g")).alias("width"))


@query()
def table_segments(spark, sf_dir):
    rows = sheets(spark, sf_dir).withColumn("g", grids.grid(F.col("rows"))).select("sheet", "rows", "g", F.explode(F.sequence(F.lit(0), F.size("rows") - 1)).alias("row"))
    shown = F.transform(grids.segments(F.col("rows"), F.col("g"), F.col("row")), lambda s: F.concat_ws(":", s["text"], s["first"].cast("string"), s["last"].cast("string")))
    return rows.select("sheet", "row", F.array_join(shown, ";").alias("segments"), grids.segment_count(F.col("g"), F.col("row")).alias("n"), F.array_join(grids.first_columns(F.col("g"), F.col("row")).cast("array<string>"), ",").alias("firsts"))


def _pairs(spark, sf_dir):
    rows = sheets(spark, sf_dir)
    # A table goes on in the one whose sheet is next; every second one repeats the first two rows.
    lower = rows.select((F.col("sheet") - 1).alias("sheet"), F.col("rows").alias("own"))
    rows = rows.join(lower, "sheet")
    return rows.select("sheet", F.col("rows").alias("upper"), F.when(F.col("sheet") % 2 == 0, F.concat(F.slice("rows", 1, 2), F.col("own"))).otherwise(F.col("own")).alias("lower"))


@query()
def table_continuity(spark, sf_dir):
    rows = _pairs(spark, sf_dir).withColumns({"a": grids.grid(F.col("upper")), "b": grids.grid(F.col("lower"))})
    tables = F.col("upper"), F.col("lower"), F.col("a"), F.col("b")
    rows, head = rows.withColumn("header", grids.shared_header(*tables)), F.col("header")
    return rows.select("sheet", "header", grids.whole_header(F.col("lower"), head).alias("whole"), grids.rows_meet(*tables, shared=head).alias("meet"), grids.fits_below(*tables, shared=head).alias("fits"))


@query()
def table_rows_widened(spark, sf_dir):
    rows = sheets(spark, sf_dir).withColumn("g", grids.grid(F.col("rows")))
    model = F.transform(F.get("rows", F.lit(0)), lambda c: F.struct(c["colspan"].alias("colspan"), (c["colspan"] + 1).alias("wanted")))
    wide = grids.widened(F.col("rows"), F.col("g"), F.lit(1), F.size("rows"), model, grids.width(F.col("g")))
    line = lambda r: F.array_join(F.transform(r, lambda c: c["colspan"].cast("string")), ",")
    return rows.select("sheet", F.array_join(F.transform(wide, line), ";").alias("colspans"))


def tokens_of(rows):
    """The tokens in which a structure model writes rows."""
    span = lambda c, k: F.when(c[k] > 1, F.array(F.concat(F.lit(f' {k}="'), c[k].cast("string"), F.lit('"')))).otherwise(F.array().cast("array<string>"))
    plain = lambda c: (c["colspan"] == 1) & (c["rowspan"] == 1)
    cell = lambda c: F.when(plain(c), F.array(F.lit("<td></td>"))).otherwise(F.concat(F.array(F.lit("<td")), span(c, "rowspan"), span(c, "colspan"), F.array(F.lit(">"), F.lit("</td>"))))
    return F.flatten(F.transform(rows, lambda r: F.concat(F.array(F.lit("<tr>")), F.flatten(F.transform(r, cell)), F.array(F.lit("</tr>")))))


@query()
def table_structures(spark, sf_dir):
    rows = sheets(spark, sf_dir).select("sheet", "rows", F.concat(F.array(F.lit("<thead>")), tokens_of(F.col("rows")), F.array(F.lit("</thead>"))).alias("tokens"))
    back = grids.rows_of_tokens(F.col("tokens"))
    texts = F.transform(F.flatten("rows"), lambda c, i: F.when(i % 3 > 0, c["text"]))
    points = F.array_join(F.transform(grids.logic_points(back), lambda p: F.array_join(p.cast("array<string>"), ",")), ";")
    return rows.select("sheet", points.alias("points"), grids.filled_structure(F.col("tokens"), texts).alias("html"))


@query(
    """WITH s AS (SELECT l_orderkey // 32 AS sheet, CAST(l_linenumber % 3 AS BIGINT) AS table_id, CAST(l_partkey % 3 AS INT) AS r, CAST(l_suppkey % 3 AS INT) AS c FROM lineitem), d AS (SELECT DISTINCT * FROM s), n AS (SELECT sheet, table_id, count(*) AS n FROM d GROUP BY ALL)
SELECT sheet, table_id FROM n a WHERE NOT EXISTS (SELECT 1 FROM n b WHERE b.sheet = a.sheet AND b.table_id <> a.table_id AND b.n > a.n AND a.n = (SELECT count(*) FROM d x JOIN d y ON y.sheet = x.sheet AND y.r = x.r AND y.c = x.c WHERE x.sheet = a.sheet AND x.table_id = a.table_id AND y.table_id = b.table_id))"""
)
def tables_that_are_no_subset(spark, sf_dir):
    cells = fx.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey div 32 as sheet", "cast(l_linenumber % 3 as bigint) as table_id", "cast(l_partkey % 3 as int) as r", "cast(l_suppkey % 3 as int) as c")
    return grids.without_subsets(cells)
