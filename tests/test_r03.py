"""Formula repair, layout in many pages at once, grids and tables: cases behind the findings of round 3."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.functions import latex
from quire.functions import text as t
from quire.operators import cells, grids, layout, sequence, tables
from quire.plans import QUERIES, document_queries
from quire.plans.text_queries import cases


def test_repair_works_out_each_step_once(spark):
    texts = spark.range(1).select(F.col("id").cast("string").alias("f"))
    plan = texts.select(latex.repaired(F.col("f")).alias("g"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("lefteqn") == 1 and plan.count("textunderscore") == 1


def test_repair_of_braces_and_delimiters(spark):
    texts = [r"}{\left\{ a{b}\right) c{", r"{\left( x}\right) y", r"\left< a\right>", r"\left( a", r"\{}{\}", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, f string")
    got = [tuple(r) for r in df.orderBy("i").select(latex.balanced_braces(F.col("f")), latex.matched_delimiters(F.col("f"))).collect()]
    assert [g[0] for g in got] == [r"\left\{ a{b}\right) c", r"{\left( x}\right) y", r"\left< a\right>", r"\left( a", r"\{\}", "", None]
    assert [g[1] for g in got] == [r"}{\left\{ a{b}\right) c{", r"{\left( x\right)} y", r"\left. a\right.", "( a", r"\{}{\}", "", None]


def test_equal_intervals_that_open_a_run_stay_in_it(spark):
    rows = [(p, lo, lo + 9.0) for p in range(50) for lo in (0.0, 20.0, 20.0, 20.0, 25.0, 40.0, 40.0) for _ in range(3)]
    got = sequence.interval_union(spark.createDataFrame(rows, "page_idx long, y0 double, y1 double").repartition(7), "y0", "y1").collect()
    assert sorted(map(tuple, got)) == [(p, a, b) for p in range(50) for a, b in ((0.0, 9.0), (20.0, 34.0), (40.0, 49.0))]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def pages_of(rng, n=60):
    """Pages of 1 to 90 boxes with equal, touching, empty and turned boxes: {page: [(det_id, x0, y0, x1, y1, score)]}."""
    edge = lambda: float(rng.randrange(0, 60))
    return {p: [(k, x, y, x + rng.randrange(-1, 25), y + rng.randrange(-1, 25), rng.randrange(5) / 5) for k in range(rng.choice([1, 2, 3, 8, 30, 90])) for x, y in [(edge(), edge())]] for p in range(n)}


@pytest.fixture(scope="module")
def pages(spark):
    made = pages_of(random.Random(3))
    rows = [(p, *b) for p, boxes in made.items() for b in boxes]
    random.Random(4).shuffle(rows)
    return made, spark.createDataFrame(rows, "page_idx long, det_id long, x0 double, y0 double, x1 double, y1 double, score double").repartition(5).cache()


def test_area_of_many_pages(pages, spark, sf):
    made, df = pages
    got = {r["page_idx"]: r["area"] for r in layout.union_area(df).collect()}
    want = {p: len({(x, y) for _, x0, y0, x1, y1, _ in boxes for x in range(int(x0), int(x1)) for y in range(int(y0), int(y1))}) for p, boxes in made.items()}
    assert got == want
    assert exchanges(QUERIES["page_union_area"](spark, sf)) == 1


def test_gap_choice_deals_sheets_once(spark, sf):
    assert exchanges(QUERIES["gap_choice"](spark, sf)) == 1
    assert exchanges(QUERIES["xlsx_components"](spark, sf)) == 2


def test_components_of_winding_tables(spark):
    """One table that winds over the sheet and a second one inside it, beside sheets of one cell."""
    spiral = [(0, c) for c in range(9)] + [(r, 8) for r in range(1, 9)] + [(8, c) for c in range(8)] + [(r, 0) for r in range(2, 8)] + [(2, c) for c in range(1, 7)]
    rows = [(1, r, c) for r, c in spiral] + [(1, 5, 4)] + [(s, s, s) for s in range(2, 40)]
    got = {(r["sheet"], r["r"], r["c"]): (r["table_r"], r["table_c"]) for r in cells.components(spark.createDataFrame(rows, "sheet int, r int, c int").repartition(4)).collect()}
    assert got == {(1, r, c): (0, 0) for r, c in spiral} | {(1, 5, 4): (5, 4)} | {(s, s, s): (s, s) for s in range(2, 40)}


def test_cuts_of_many_pages(pages, spark, sf):
    made, df = pages
    got = {}
    for r in layout.reading_places(df).collect():
        got.setdefault(r["page_idx"], {})[r["place"]] = r["det_id"]
    for p, boxes in made.items():
        assert [got[p][i] for i in range(len(boxes))] == layout.cut_order(np.array([b[1:5] for b in boxes])), p
    assert exchanges(QUERIES["xycut_order"](spark, sf)) == 1


def test_cuts_of_narrow_bridges_and_missing_edges():
    xy = np.array([[0, 0, 40, 10], [60, 0, 100, 10], [0, 20, 40, 30], [60, 20, 100, 30], [38, 12, 44, 18], [np.nan, 0, 1, 1], [0, 0, 9, 9], [0, 20, 9, 29]], float)
    starts, sizes = np.array([0, 5, 6]), np.array([5, 1, 2])
    want = [a + k for a, n in zip(starts, sizes) for k in layout.cut_order(xy[a : a + n])]
    assert layout.cut_orders(xy, starts, sizes).tolist() == want


def test_rows_first_of_many_pages(pages, spark, sf):
    made, df = pages
    got = {}
    for r in layout.rows_first(df).collect():
        got.setdefault(r["page_idx"], {})[r["place"]] = r["det_id"]
    for p, boxes in made.items():
        order = sorted(boxes, key=lambda b: (b[2], b[1], b[0]))
        for i in range(len(order) - 1):
            for j in range(i, -1, -1):
                a, b = order[j], order[j + 1]
                if abs(b[2] - a[2]) >= layout.SAME_ROW or b[1] >= a[1]:
                    break
                order[j], order[j + 1] = b, a
        assert [got[p][i] for i in range(len(order))] == [b[0] for b in order], p
    assert exchanges(QUERIES["sorted_boxes"](spark, sf)) == 1


def test_suppression_in_many_pages(pages, spark, sf):
    made, df = pages
    kept = {p: set() for p in made}
    for r in layout.suppress(df, most=0.3).collect():
        kept[r["page_idx"]].add(r["det_id"])
    for p, boxes in made.items():
        want = []
        for b in sorted(boxes, key=lambda b: (-b[5], b[0])):
            if not any(layout._iou(np.array(o[1:5]), np.array([b[1:5]]))[0] > 0.3 for o in want):
                want.append(b)
        assert kept[p] == {b[0] for b in want}, p
    assert exchanges(QUERIES["nms_dedup"](spark, sf)) == 1


def test_nested_formulas_of_many_pages(spark, sf):
    alone = [(p, k, 10.0 * k, 0.5, 10.0 * k + 8, 5.5, 0.5) for p in range(40) for k in range(p % 5)]
    chain = [(100, 0, 0.0, 0.0, 10.0, 10.0, 0.2), (100, 1, 1.5, 1.0, 9.0, 9.0, 0.9), (100, 2, 0.0, 2.0, 10.4, 11.0, 0.5), (100, 3, 50.0, 50.0, 60.5, 60.0, 0.9)]
    df = spark.createDataFrame(alone + chain, "page_idx long, det_id long, x0 double, y0 double, x1 double, y1 double, score double").repartition(4)
    want = {*alone, (100, 1, 0.0, 0.0, 11.0, 11.0, 0.9), chain[3]}
    assert {tuple(r) for r in layout.merge_nested_formulas(df).collect()} == want
    assert exchanges(QUERIES["nested_formulas_merged"](spark, sf)) == 1


def test_grid_of_many_tables(spark):
    """More tables than are worked on at once, nulls and empty ones among them; wide cells meet cells that reach below."""
    cell = lambda c, r: ("", c, r)
    some = [[[cell(1, 3), cell(2, 1)], [cell(1, 1)], [cell(3, 2), cell(1, 1)], [], [cell(1, 1)]], [], None, [[]]]
    df = spark.createDataFrame([(i, some[i % 4]) for i in range(2000)], f"i int, rows {tables.ROWS}").coalesce(1)
    n = 100_000
    want = [[[0, 1, 1], [0, n], [0, 2 * n, 2 * n, 2 * n, 2 * n + 1], [None, 2 * n, 2 * n, 2 * n], [4 * n]], [], None, [[]]]
    assert all(r["g"] == want[r["i"] % 4] for r in df.select("i", grids.grid(F.col("rows")).alias("g")).collect())


def test_texts_of_a_structure_are_worked_out_once(spark):
    texts = F.transform(F.sequence(F.lit(1), "n"), lambda k: F.concat(F.lit("marked"), k.cast("string")))
    df = spark.createDataFrame([("<tr> <td></td> <td></td> </tr>", 2)], "t string, n int")
    made = df.select(grids.filled_structure(F.split("t", " "), texts).alias("html"))
    assert made.first()["html"] == "<tr><td>marked1</td><td>marked2</td></tr>"
    assert made._jdf.queryExecution().analyzed().toString().count("marked") == 1
    assert grids.cells_of_tokens(["<td></td>", "<tr>", "<td", ' rowspan="2"', " colspan='x'", ">", "</td>", None]) == [[(1, 1)], [(None, 2)]]


def test_slices_bound_what_is_held(spark):
    seen = []
    values = pa.array(list(range(1000)) + [None])
    got = tables.by_slices(values, lambda v: (seen.append(len(v)), v)[1])
    assert got.equals(values) and max(seen) <= 256
    assert tables.by_slices(values.slice(0, 0), lambda v: v).equals(values.slice(0, 0))
    html = [f"<table><tr><td>{i % 300}</td></tr></table>" if i % 7 else None for i in range(1500)]
    rows = spark.createDataFrame(list(enumerate(html)), "i int, h string").coalesce(1).select("i", tables.parse(F.col("h")).alias("r")).collect()
    assert all((r["r"] is None) == (r["i"] % 7 == 0) and (r["r"] is None or r["r"][0][0]["text"] == str(r["i"] % 300)) for r in rows)


def test_text_steps_at_the_edges(spark):
    """White space of Unicode at both ends, wide letters, hyphens, scripts: against plain Python."""
    odd = [t.WHITE + "a b" + t.WHITE, t.WHITE, "", None, "\u200ba\u200b", "Ａ１（ｂ）", "ab\u00ad", "a-  ", "-", "中文中ab", "中文 abcdefg", "カー・!", "\\*a_\\\\~", "x\n\u2028", "1" * 50]
    f = F.col("f")
    rows = spark.createDataFrame([(x,) for x in odd], "f string").select("f", t.strip(f).alias("s"), t.half_width_letters(f).alias("w"), t.ends_with_hyphen(f).alias("h"), t.cjk_share(f).alias("c"), t.escape_markdown(f).alias("e")).collect()
    cjk = re.compile(r"[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af]")
    for x, s, w, h, c, e in rows:
        if x is None:
            assert s is w is h is e is None
            continue
        letters = sum(k.isalpha() for k in x)
        assert s == x.strip(t.WHITE) and h == bool(re.search(r"[A-Za-z]+[-\u00ad\u2010\u2011\u2043]\s*$", x))
        assert w == "".join(chr(ord(k) - 0xFEE0) if "！" <= k <= "～" and chr(ord(k) - 0xFEE0).isalnum() else k for k in x)
        assert abs(c - (len(cjk.findall(x)) / letters if letters else 0)) < 1e-9
        assert e == re.sub(r"(?<!\\)((?:\\\\)*)([*_`~$])", r"\1\\\2", x)
    assert all(re.fullmatch(r"\s", k) for k in t.WHITE)


@pytest.mark.parametrize("name", ["content_list", "content_list_v2"])
def test_documents_are_rendered_once(spark, sf, name):
    count = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("is_list_start_line")
    once = cases(spark, sf).select("doc_id", F.transform(document_queries._blocks(F.col("text")), document_queries._body).alias("b"))
    assert count(QUERIES[name](spark, sf)) == count(once)
