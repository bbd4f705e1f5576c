"""Operators whose queries have no SQL: captions above tables, batches of formulas, formula repair."""

import re
from collections import Counter, defaultdict

import pytest

from quire.functions import latex
from quire.operators import detections, titles
from quire.plans import latex_queries, page_queries


def pages_of(df):
    pages = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: r["idx"]):
        if r["type"] not in titles.PASSED_OVER:
            pages[r["page_idx"]].append(r)
    return pages


def near(block, table):
    slack = max(12, 0.03 * (table["x1"] - table["x0"]))
    return table["x0"] - slack <= block["x1"] and block["x0"] <= table["x1"] + slack


def test_stacks_on_tables(spark, sf):
    rows = page_queries.captioned(spark, sf)
    want = {}
    for page, blocks in pages_of(rows).items():
        for table in (b for b in blocks if b["type"] == "table"):
            stack, top, tall = [], table["y0"], 1
            for b in sorted((b for b in blocks if b["type"] != "table" and b["y1"] <= table["y0"] and near(b, table)), key=lambda b: (-b["y0"], -b["idx"])):
                tall = max(tall, b["y1"] - b["y0"])
                if not 0 <= top - b["y1"] <= max(12, 1.5 * tall):
                    break
                stack.insert(0, b)
                top = b["y0"]
            captions = [i for i, b in enumerate(stack) if b["type"] == "caption"]
            if captions:
                want[page, table["idx"]] = ([b["idx"] for b in stack], [b["idx"] for b in stack[captions[-1] + 1 :] if b["n_lines"] <= 1])
    got = {(r["page_idx"], r["table_idx"]): (r["stack"], r["fragments"]) for r in titles.stacked_captions(rows).collect()}
    assert got == want and any(f for _, f in want.values()) and any(len(s) > 1 for s, _ in want.values())


def test_leading_continuations(spark, sf):
    rows = page_queries.captioned(spark, sf).where("idx >= 11")
    want = set()
    for page, blocks in pages_of(rows).items():
        lead = []
        while len(lead) < len(blocks) and blocks[len(lead)]["type"] == "text" and blocks[len(lead)]["n_lines"] == 1 and blocks[len(lead)]["text"].endswith("(continued)"):
            lead.append(blocks[len(lead)])
        if lead and len(lead) < len(blocks) and blocks[len(lead)]["type"] == "table":
            top, fits = blocks[len(lead)]["y0"], True
            for b in reversed(lead):
                gap = top - b["y1"]
                fits = fits and near(b, blocks[len(lead)]) and -3.6 <= gap <= 18
                top = b["y0"]
            want |= {(page, b["idx"]) for b in lead if fits}
    got = {(r["page_idx"], r["idx"]) for r in titles.leading_continuations(rows).collect()}
    assert got == want and want


@pytest.mark.parametrize(("areas", "wanted", "sizes"), [([], 64, []), ([5], 64, [1]), ([1] * 10, 64, [8, 2]), ([1] * 64, 64, [64]), ([1] * 100, 64, [64, 36]), ([1] * 65, 16, [16, 16, 16, 17]), ([1] * 64 + [4] * 64, 64, [64, 32, 32]), ([1] * 64 + [100] * 64, 64, [64, 16, 16, 16, 16]), ([1] * 70, 64, [64, 6])])
def test_formula_batches(areas, wanted, sizes):
    assert detections.formula_batches(areas, wanted) == sizes and sum(sizes) == len(areas)


def test_delimiters_by_hand(spark):
    texts = [r"\left ( a \right )", r"\left| a \right|", r"\left\{ a \right\} b", r"\left x \right", r"\left| a", r"a \right. b", r"{ \left| a } \right| b", r"\frac{ \left| a }{ b \right| }", r"{ { \left| a } \right| b }", "no command", ""]
    want = [r"\left. ( a \right. )", r"\left| a \right|", r"\left\{ a \right\} b", r"\left. x \right.", "| a", "a  b", r"{ \left| a \right|}  b", r"\frac{ \left| a }{ b \right| }", r"{ { \left| a \right|}  b }", "no command", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, f string")
    got = [r["g"] for r in df.select("i", latex.matched_delimiters(df["f"]).alias("g")).orderBy("i").collect()]
    assert got == want


def test_delimiters_are_balanced_and_nothing_else_is_lost(spark, sf):
    bare = lambda f: Counter(re.sub(r"\\left\S*|\\right\S*|\s", "", f))
    rows = latex_queries.formulas(spark, sf)
    for r in rows.select("f", latex.matched_delimiters(rows["f"]).alias("g")).collect():
        count = lambda c: len(re.findall(rf"\\{c}(?![a-zA-Z])", r["g"]))  # noqa: E731, B023
        assert count("left") == count("right")
        if "\\left" not in r["f"] and "\\right" not in r["f"]:
            assert r["f"] == r["g"]
        assert bare(r["f"]) - bare(r["g"]) == Counter() or "\\left" in r["f"] or "\\right" in r["f"]


def test_repair_by_hand(spark):
    texts = [r"\upalpha { x", r"\a1 \emph y\\", r"\begin{array}{l} a", r"b \end{cases}", r"c\qquad d\qquade", r"\Bar x \Hat y \textperthousand", r"\uparrow \upsilon", r"\# \{ \1", None]
    want = [r"\alpha  x", r"\ a1  y", r"\begin{array}{l} a \end{array}", r"\begin{cases} b \end{cases}", r"c\qquad d\qquad e", r"\hat x \hat y ‰", r"\uparrow \upsilon", r"\# \{ \ 1", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, f string")
    assert [r["g"] for r in df.select("i", latex.repaired(df["f"]).alias("g")).orderBy("i").collect()] == want
