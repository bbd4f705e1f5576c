"""Grids against a painted page in plain Python, on sheets and on rows made at random."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import grids
from quire.plans import grid_queries

ROWS = "array<array<struct<text:string,colspan:int,rowspan:int>>>"


def paint(rows):
    """{(row, column): (row, cell)}, painted cell after cell; of two that reach below, the one that reaches further keeps the column."""
    page, reach = {}, {}
    for r, row in enumerate(rows):
        at = 0
        for k, c in enumerate(row):
            while (r, at) in page:
                at += 1
            for col in range(at, at + c["colspan"]):
                for below in range(c["rowspan"]):
                    old = page.get((r + below, col))
                    if below and old is not None and reach[old] > r + c["rowspan"]:
                        continue
                    page[r + below, col] = (r, k)
            reach[r, k] = r + c["rowspan"]
            at += c["colspan"]
    return page


def lines(rows):
    page = paint(rows)
    out = []
    for r in range(len(rows)):
        own = [c for (y, c) in page if y == r]
        out.append([page.get((r, c)) for c in range(max(own) + 1)] if own else [])
    return out


def runs(line):
    out = []
    for c, x in enumerate(line):
        if x is not None and (c == 0 or line[c - 1] != x):
            end = c
            while end < len(line) and line[end] == x:
                end += 1
            out.append((x, c, end))
    return out


def narrow(text):
    return "".join(chr(ord(c) - 0xFEE0) if "！" <= c <= "～" else c for c in text).strip()


@pytest.fixture(scope="module")
def tables(spark, sf):
    rng = random.Random(8)
    cell = lambda: (rng.choice(["a", " ｂ ", "c d", ""]), rng.choice([1, 1, 2, 3]), rng.choice([1, 1, 2, 3]))
    made = [(i, [[cell() for _ in range(rng.randrange(5))] for _ in range(rng.randrange(7))]) for i in range(300)]
    df = spark.createDataFrame(made, f"sheet bigint, rows {ROWS}")
    return df.unionByName(grid_queries.sheets(spark, sf).withColumn("sheet", F.col("sheet") + 1000)).cache()


def test_grids_and_segments(tables):
    g = tables.withColumn("g", grids.grid(F.col("rows")))
    each = F.transform(F.slice(F.sequence(F.lit(0), F.size("rows")), 1, F.size("rows")), lambda i: F.struct(grids.segments(F.col("rows"), F.col("g"), i).alias("s"), grids.segment_count(F.col("g"), i).alias("n"), grids.first_columns(F.col("g"), i).alias("f")))
    for r in g.select("rows", "g", grids.width(F.col("g")).alias("w"), each.alias("each")).collect():
        want = lines(r["rows"])
        assert [[None if x is None else divmod(x, 100_000) for x in line] for line in r["g"]] == want
        assert r["w"] == max(map(len, want), default=0)
        for y, (line, e) in enumerate(zip(want, r["each"], strict=True)):
            assert [(s["text"], s["first"], s["last"]) for s in e["s"]] == [(narrow(r["rows"][x[0]][x[1]]["text"]), a, b) for x, a, b in runs(line)]
            assert e["n"] == len(runs(line)) and e["f"] == [line.index((y, k)) for k in range(len(r["rows"][y])) if (y, k) in line]


def brute_header(a, b):
    n = min(len(a), len(b), 5)
    la, lb = lines(a), lines(b)
    texts = [["".join(narrow(c["text"]).split()) for c in row] for row in a[:n]], [["".join(narrow(c["text"]).split()) for c in row] for row in b[:n]]
    spans = lambda row: [(c["colspan"], c["rowspan"]) for c in row]
    lead = lambda fs: next((i for i, f in enumerate(fs) if not f), len(fs))
    same = [texts[0][i] == texts[1][i] for i in range(n)]
    exact = lead([same[i] and spans(a[i]) == spans(b[i]) and len(la[i]) == len(lb[i]) for i in range(n)])
    return exact or lead([same[i] and len(runs(la[i])) == len(runs(lb[i])) for i in range(n)])


def test_headers_and_continuity(spark, tables):
    pairs = tables.select("sheet", F.col("rows").alias("upper")).join(tables.select((F.col("sheet") - 1).alias("sheet"), F.col("rows").alias("own")), "sheet")
    pairs = pairs.withColumn("lower", F.when(F.col("sheet") % 2 == 0, F.concat(F.slice("upper", 1, 2), F.col("own"))).otherwise(F.col("own")))
    pairs = pairs.withColumns({"a": grids.grid(F.col("upper")), "b": grids.grid(F.col("lower"))})
    args = [F.col(k) for k in ("upper", "lower", "a", "b")]
    head = grids.shared_header(*args)
    met = set()
    for r in pairs.select("upper", "lower", head.alias("h"), grids.whole_header(F.col("lower"), head).alias("w"), grids.rows_meet(*args).alias("m"), grids.fits_below(*args[:2]).alias("f")).collect():
        a, b = r["upper"], r["lower"]
        assert r["h"] == brute_header(a, b)
        whole, i = min(r["h"], len(b)), 0
        while i < whole:
            whole = min(max([whole, *(i + c["rowspan"] for c in b[i])]), len(b))
            i += 1
        assert r["w"] == whole
        last = max((i for i, row in enumerate(a) if row), default=None)
        meet = False
        if last is not None and whole < min(len(b), 6):
            x, y = lines(a)[last], lines(b)[whole]
            meet = len(x) == len(y) or sum(c["colspan"] for c in a[last]) == sum(c["colspan"] for c in b[whole]) or len(runs(x)) == len(runs(y))
        assert r["m"] == meet
        full = lambda t: max(map(len, lines(t)), default=0)
        assert r["f"] == (full(a) == full(b) or meet)
        met.add((r["h"] > 0, r["m"], r["f"]))
    assert len(met) >= 4


def test_structures_come_back_from_their_tokens(tables):
    t = tables.withColumn("tokens", grid_queries.tokens_of(F.col("rows")))
    back = grids.rows_of_tokens(F.col("tokens"))
    for r in t.select("rows", back.alias("back"), grids.logic_points(back).alias("points")).collect():
        bare = lambda rows: [[(c["colspan"], c["rowspan"]) for c in row] for row in rows]
        assert bare(r["back"]) == bare(r["rows"])
        want = lines(r["rows"])
        if all((y, k) in line for y, line in enumerate(want) for k in range(len(r["rows"][y]))):
            assert r["points"] == [[y, y + c["rowspan"] - 1, want[y].index((y, k)), want[y].index((y, k)) + c["colspan"] - 1] for y, row in enumerate(r["rows"]) for k, c in enumerate(row)]


def test_filled_structures_and_cells(spark):
    df = spark.createDataFrame([(["<thead>", "<tr>", "<td></td>", "<td", ' colspan="2"', ">", "</td>", "</tr>", "</thead>"], ["x", "y"], ["<b>", " b</b>", "c "], [" lone"])], "t array<string>, s array<string>, m array<string>, o array<string>")
    r = df.select(grids.filled_structure(df["t"], df["s"]), grids.joined_cell(df["m"]), grids.joined_cell(df["o"])).first()
    assert r[0] == '<tr><td>x</td><td colspan="2">y</td></tr>' and r[1] == "<b>b c </b>" and r[2] == " lone"


def test_rows_are_widened(spark):
    cell = lambda *s: [("", c, 1) for c in s]
    rows = [cell(1, 1, 2), cell(1, 1), cell(1, 1, 1), cell(2, 2), []]
    df = spark.createDataFrame([(rows, [(1, 1), (1, 3)])], f"rows {ROWS}, model array<struct<colspan:int,wanted:int>>")
    wide = grids.widened(df["rows"], grids.grid(df["rows"]), F.lit(1), F.lit(5), df["model"], F.lit(4))
    assert [[c["colspan"] for c in row] for row in df.select(wide.alias("w")).first()["w"]] == [[1, 1, 2], [1, 3], [1, 1, 2], [2, 2], []]
