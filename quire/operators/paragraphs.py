"""Paragraphs: lists and indexes told from plain text by the shape of their lines, and blocks that go on across columns and pages.

A block carries its lines as an array of structs (x0, y0, x1, y1, text). Telling kinds is an expression on one block; merging
compares neighbours in reading order of a document, with no barrier between them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import is_cjk, strip
from quire.operators.sequence import paragraph_groups, paragraph_merges, reading_order

# What ends a line for good, what ends an item of a list, and what ends a group of texts.
LINE_STOPS = (".", "!", "?", "。", "！", "？", ")", "）", '"', "”", ":", "：", ";", "；")
ITEM_STOPS = (".", "。", ";", "；")
BARRIERS = ("abstract", "interline_equation", "doc_title", "paragraph_title")
TEXTS = ("text", "index", "vertical_text")
#: Lines of a block in a group of list items at most.
ITEM_LINES = 3


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hull(lines: Column, box: Column) -> Column:
    """The box around the lines, or the block's own where it has none."""
    edge = lambda k, f: f(F.transform(lines, lambda x: x[k]))
    around = F.struct(edge("x0", F.array_min).alias("x0"), edge("y0", F.array_min).alias("y0"), edge("x1", F.array_max).alias("x1"), edge("y1", F.array_max).alias("y1"))
    return F.when(F.size(lines) > 0, around).otherwise(box)


def _count(flags: Column) -> Column:
    return F.size(F.filter(flags, lambda x: x))


def _shifted(flags: Column) -> Column:
    """Each flag one place later."""
    return F.transform(flags, lambda x, i: F.coalesce(F.get(flags, i - 1), F.lit(False)) & (i > 0))


def list_kind(kind: Column, lines: Column, page_width: Column) -> Column:
    """struct(kind, starts, ends): text becomes list or index by its lines, with a flag for each line that begins or ends an item.

    An index has lines that mostly touch one margin and begin or end in digits. A list has all lines centred and most of them apart from both
    margins, or several at the left margin and several that are ragged, indented or end in a stop.
    """
    none = F.transform(lines, lambda x: F.lit(False))
    every = F.transform(lines, lambda x: F.lit(True))
    result = lambda k, starts, ends: F.struct(F.lit(k).alias("kind") if isinstance(k, str) else k.alias("kind"), starts.alias("starts"), ends.alias("ends"))

    def measured(b: Column) -> Column:
        first, last = F.get(lines, F.lit(0)), F.element_at(lines, -1)
        height, width, n = first["y1"] - first["y0"], b["x1"] - b["x0"], F.size(lines)
        texts = F.transform(lines, lambda x: strip(F.coalesce(x["text"], F.lit(""))))
        wide = F.when(page_width == 0, 0.0).otherwise(width / page_width)
        ragged = F.when(is_cjk(F.array_join(texts, "")) | (wide >= 0.5), 0.26).otherwise(0.36) * width
        left = F.transform(lines, lambda x: F.abs(b["x0"] - x["x0"]) < height / 2)
        right = F.transform(lines, lambda x: F.abs(b["x1"] - x["x1"]) < height)
        return F.struct(
            height.alias("height"), width.alias("width"), (b["y1"] - b["y0"]).alias("tall"), n.alias("n"), b["x1"].alias("x1"), left.alias("left"), right.alias("right"),
            F.transform(lines, lambda x: ~(F.abs(b["x0"] - x["x0"]) < height / 2) & (x["x0"] - b["x0"] > height)).alias("indented"),
            F.transform(lines, lambda x: ~(F.abs(b["x1"] - x["x1"]) < height) & (b["x1"] - x["x1"] > ragged)).alias("ragged"),
            F.transform(lines, lambda x: (x["x0"] - b["x0"] > 0.7 * height) & (b["x1"] - x["x1"] > 0.7 * height)).alias("apart"),
            F.transform(lines, lambda x: F.abs((x["x0"] + x["x1"]) / 2 - (b["x0"] + b["x1"]) / 2) < height / 2).alias("centred"),
            F.transform(texts, lambda t: t.rlike(r"^\p{Nd}")).alias("digit_first"), F.transform(texts, lambda t: t.rlike(r"\p{Nd}$")).alias("digit_last"),
            F.transform(texts, lambda t: F.substring(t, -1, 1).isin(*ITEM_STOPS)).alias("stopped"),
            ((first["x0"] - b["x0"] > height / 2) & (F.abs(last["x0"] - b["x0"]) < height / 2) & (b["x1"] - last["x1"] > height)).alias("prose"),
        )

    def told(m: Column) -> Column:
        share = lambda f: _count(m[f]) / m["n"]
        numbered = (share("digit_first") >= 0.8) | (share("digit_last") >= 0.8)
        ends_stop = share("stopped") >= 0.8
        index = ((share("left") >= 0.8) | (share("right") >= 0.8)) & numbered
        centred = (_count(m["apart"]) >= 2) & (_count(m["centred"]) == m["n"]) & (share("apart") >= 0.5) & (m["tall"] / m["width"] > 0.4)
        listed = (_count(m["left"]) >= 2) & ((_count(m["ragged"]) >= 2) | ends_stop | (_count(m["indented"]) >= 2)) & ~m["prose"]
        short = F.transform(lines, lambda x: F.abs(m["x1"] - x["x1"]) > 0.1 * m["width"])
        open_right = F.transform(lines, lambda x: F.abs(m["x1"] - x["x1"]) > m["height"])
        flush = (
            F.when((_count(m["stopped"]) == 0) & (share("right") < 0.5), result("list", m["left"], none))
            .when(ends_stop, result("list", _shifted(m["stopped"]), m["stopped"]))
            .otherwise(result("list", _shifted(short), short))
        )
        counted = (_count(m["digit_first"]) >= 2) & (_count(m["digit_first"]) == _count(m["stopped"]))
        hanging = F.when(counted, result("list", m["digit_first"], m["stopped"])).otherwise(result("list", m["left"], open_right))
        return F.when(index, result("index", every, none)).when(centred, result("list", every, none)).when(listed, F.when(share("left") > 0.8, flush).otherwise(hanging)).otherwise(result("text", none, none))

    shaped = _let(_let(hull(lines, F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>")), measured), told)
    plain = F.when(kind == "index", result("index", every, none)).otherwise(result(kind, none, none))
    return F.when((kind == "text") & (F.size(lines) >= 2), shaped).otherwise(plain)


def merged_paragraphs(blocks: DataFrame, keys: Sequence[str] = ("doc_id",), order: Sequence[str] = ("page_idx", "block_id")) -> DataFrame:
    """Text blocks with their kind, line flags, para_group, joins (taken into the block before) and cross_page (joins from another page).

    blocks: keys, page_idx, block_id, type, x0, y0, x1, y1, page_width, lines. A barrier or any title between two blocks keeps them apart. Vertical texts
    join by their columns, texts by their lines unless all blocks of the group are short, lists join lists and indexes indexes.
    """
    spec = reading_order(keys, order)
    rows = paragraph_groups(blocks, spec, TEXTS, BARRIERS)
    rows = rows.withColumn("hull", hull(F.col("lines"), F.struct(*[F.col(k).cast("double").alias(k) for k in ("x0", "y0", "x1", "y1")])))
    rows = rows.withColumn("told", list_kind(F.col("type"), F.col("lines"), F.col("page_width"))).withColumns({"kind": F.col("told.kind"), "starts": F.col("told.starts"), "ends": F.col("told.ends")}).drop("told")
    group = Window.partitionBy(*keys, "para_group")
    rows = rows.withColumn("_items", F.min((F.col("kind") != "vertical_text") & (F.size("lines") <= ITEM_LINES)).over(group))
    near = group.orderBy(*order)
    me = F.struct("kind", "hull", "lines", "x0", "y0", "x1", "y1", "page_idx")
    rows = rows.withColumn("_p", F.lag(me).over(near))
    first, last = F.get("lines", F.lit(0)), F.try_element_at("_p.lines", F.lit(-1))
    begins, stops = F.coalesce(first["text"], F.lit("")), F.coalesce(last["text"], F.lit(""))
    goes_on = (begins != "") & ~begins.rlike(r"^[\p{Nd}\p{Lu}]") & ~F.substring(stops, -1, 1).isin(*LINE_STOPS)

    def along(a: str, b: str, c: str, d: str) -> Column:
        """The tests on one axis: a, b are the sides that lines run along, c, d those across."""
        size, before = first[d] - first[c], last[d] - last[c]
        mine, other = F.col(b) - F.col(a), F.col(f"_p.{b}") - F.col(f"_p.{a}")
        return (F.abs(F.col(f"hull.{a}") - first[a]) < size / 2) & (F.abs(F.col(f"_p.hull.{b}") - last[b]) < before) & (F.abs(mine - other) < F.least(mine, other))

    both = lambda k: (F.col("kind") == k) & (F.col("_p.kind") == k)
    text = both("text") & ~F.col("_items") & goes_on & along("x0", "x1", "y0", "y1") & (F.col("y0") < F.col("_p.y1"))
    tall = both("vertical_text") & goes_on & along("y0", "y1", "x0", "x1") & (first["x1"] > first["x0"]) & (last["x1"] > last["x0"]) & (F.col("x1") > F.col("_p.x0"))
    rows = paragraph_merges(rows, text, F.size("lines") > 1, [*keys, "para_group"], order)
    joins = F.col("joins") | F.coalesce(tall, F.lit(False)) | F.coalesce(both("list") | both("index"), F.lit(False))
    rows = rows.withColumn("joins", F.coalesce(joins, F.lit(False)))
    return rows.withColumn("cross_page", F.col("joins") & (F.col("page_idx") != F.col("_p.page_idx"))).drop("_p", "_items", "hull")
