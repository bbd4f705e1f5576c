"""Titles of a document, slide titles, and captions above tables and beside pictures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.geometry import Box
from quire.functions.rich import is_continuation

# How much larger than body text, and than the next bold size, a slide's titles are, in points.
OVER_BODY, OVER_NEXT, OVER_BODY_3 = 4, 2, 2
# Pictures below these shares of the slide are small; one covered so far by text is a background.
SMALL_SIDE, SMALL_AREA, BACKGROUND = 0.1, 0.01, 0.1
# Blocks that stand between others without counting.
PASSED_OVER = ("header", "footer", "page_number", "page_footnote", "aside_text")


def line_height(preset: Column, heights: Column, box_height: Column) -> Column:
    """The preset height if positive, else the mean of the lines' heights, each cut to a whole number, else the block's own."""
    known = F.transform(F.filter(heights, lambda h: h > 0), lambda h: h.cast("int"))
    mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0), lambda n, h: n + h) / F.size(known))
    return F.when(preset > 0, preset.cast("double")).otherwise(F.coalesce(mean, F.greatest(F.lit(0), box_height.cast("int")).cast("double"), F.lit(0.0)))


def rounded_line_height(detected: Column, own: Column, box_height: Column) -> Column:
    """The mean height of the detected lines, else of the block's own, rounded half to even; else the block's height."""
    def mean(heights: Column) -> Column:
        known = F.filter(heights, lambda h: h > 0)
        return F.when(F.size(known) > 0, F.bround(F.aggregate(known, F.lit(0.0), lambda n, h: n + h) / F.size(known), 0))

    return F.coalesce(mean(detected), mean(own), box_height)


def numbered_titles(blocks: DataFrame, keys: Sequence[str] = ("doc_id",), order: Sequence[str] = ("page_idx", "block_id")) -> DataFrame:
    """keys, titles (map from the place of a title to struct(text, height, page)), types, grouped.

    grouped: document and paragraph titles are levelled each for themselves, since both occur and no plain title does.
    """
    rows = blocks.where(F.col("type").isin("title", "doc_title", "paragraph_title"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    rows = rows.withColumn("_place", place)
    entry = F.struct(F.col("_place").cast("string").alias("key"), F.struct("text", "height", (F.col("page_idx") + 1).alias("page")).alias("value"))
    got = rows.groupBy(*keys).agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("_place", entry.alias("e")))), lambda x: x["e"])).alias("titles"), F.array_sort(F.collect_set("type")).alias("types"))
    return got.withColumn("grouped", F.col("types") == F.array(F.lit("doc_title"), F.lit("paragraph_title")))


def with_levels(titles: DataFrame, levels: DataFrame, keys: Sequence[str] = ("doc_id",), order: Sequence[str] = ("page_idx", "block_id"), offset: bool = False) -> DataFrame:
    """titles with the level that levels(keys, place, level) has for their place; with offset, level 1 becomes 2. Documents without levels keep their own."""
    rows = titles.withColumn("place", (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))
    new = levels.select(*keys, F.col("place").cast("long").alias("place"), F.col("level").alias("_level"))
    level = F.when(F.col("_level") == 1, 2).otherwise(F.col("_level")) if offset else F.col("_level")
    return rows.join(new, [*keys, "place"], "left").withColumn("level", F.coalesce(level, F.col("level"))).drop("_level")


def slide_titles(blocks: DataFrame, keys: Sequence[str] = ("slide",)) -> DataFrame:
    """blocks(type, size, bold) of slides with level: 2 for the one largest bold text, 3 for the next bold size, where they stand out.

    Body size is the commonest size of texts that are not bold, the smaller on a tie. Blocks that are titles of level 2 already count as such.
    """
    text = (F.col("type") == "text") & F.col("size").isNotNull()
    plain = blocks.where(text & ~F.col("bold")).groupBy(*keys, "size").agg(F.count("*").alias("n"))
    body = plain.groupBy(*keys).agg(F.min_by("size", F.struct(-F.col("n"), F.col("size"))).alias("_body"))
    bold = blocks.where(text & F.col("bold")).groupBy(*keys, "size").agg(F.count("*").alias("n"))
    sizes = bold.groupBy(*keys).agg(F.reverse(F.array_sort(F.collect_list(F.struct("size", "n")))).alias("_bold"))
    given = blocks.where((F.col("type") == "title") & (F.col("level") == 2)).groupBy(*keys).agg(F.max("size").alias("_given"))
    rows = blocks.join(body, list(keys), "left").join(sizes, list(keys), "left").join(given, list(keys), "left")
    first, second = F.get("_bold", F.lit(0)), F.get("_bold", F.lit(1))
    two = (first["n"] == 1) & (F.col("_body").isNull() | (first["size"] >= F.col("_body") + OVER_BODY)) & (second.isNull() | (first["size"] >= second["size"] + OVER_NEXT))
    rows = rows.withColumn("_two", F.when(F.coalesce(two, F.lit(False)), first["size"])).withColumn("_top", F.greatest("_given", "_two"))
    below = F.array_max(F.transform(F.filter("_bold", lambda b: (b["size"] < F.col("_top")) & ~b["size"].eqNullSafe(F.col("_two"))), lambda b: b["size"]))
    rows = rows.withColumn("_three", below)
    three = (F.col("_three") >= F.col("_body") + OVER_BODY_3) & (F.col("_top") >= F.col("_three") + OVER_NEXT)
    level = F.when(text & F.col("bold") & (F.col("size") == F.col("_two")), 2).when(text & F.col("bold") & three & (F.col("size") == F.col("_three")), 3)
    rows = rows.withColumn("_new", level).withColumn("type", F.when(F.col("_new").isNotNull(), "title").otherwise(F.col("type")))
    return rows.withColumn("level", F.coalesce("_new", "level")).drop("_body", "_bold", "_given", "_two", "_top", "_three", "_new")


def is_small_picture(box: Box, width: Column, height: Column) -> Column:
    """A picture below SMALL_SIDE of the slide in a side or SMALL_AREA in area; sizes that are not positive are not small."""
    w, h = box.x1 - box.x0, box.y1 - box.y0
    real = (w > 0) & (h > 0) & (width * height > 0)
    return F.coalesce(real & ((w < SMALL_SIDE * width) | (h < SMALL_SIDE * height) | (w * h / (width * height) < SMALL_AREA)), F.lit(False))


def density(boxes: DataFrame, keys: Sequence[str] = ("page_idx",)) -> DataFrame:
    """keys, density: the boxes' areas together as a share of the region around them, 1 at most; 1 for a region of no area."""
    sums = boxes.groupBy(*keys).agg(
        F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("_a"), ((F.max("x1") - F.min("x0")) * (F.max("y1") - F.min("y0"))).alias("_r")
    )
    return sums.select(*keys, F.when(F.col("_r") > 0, F.least(F.lit(1.0), F.col("_a") / F.col("_r"))).otherwise(1.0).alias("density"))


def is_near_table(block: Box, table: Box) -> Column:
    """Not further to the side of the table than 3 in 100 of its width, or 12."""
    slack = F.greatest(F.lit(12.0), F.greatest(table.x1 - table.x0, F.lit(1)) * 0.03)
    return ~((block.x1 < table.x0 - slack) | (block.x0 > table.x1 + slack))


def is_inline_fragment(caption: Box, text: Box, visual: Box) -> Column:
    """Whether a text goes on with the caption before it: on one line with it, and the visual follows closely below both."""
    tall = lambda b: F.greatest(b.y1 - b.y0, F.lit(1))
    low, high = F.greatest(F.least(tall(caption), tall(text)), F.lit(1)), F.greatest(tall(caption), tall(text))
    shared = (F.least(caption.y1, text.y1) - F.greatest(caption.y0, text.y0)) / low
    middle = F.abs((caption.y0 + caption.y1) / 2 - (text.y0 + text.y1) / 2)
    gap = visual.y0 - F.greatest(caption.y1, text.y1)
    return ((shared >= 0.6) | (middle <= high * 0.5)) & (gap >= 0) & (gap <= F.greatest(F.lit(12.0), high * 1.5))


def inline_fragments(blocks: DataFrame, keys: Sequence[str] = ("page_idx",), order: str = "idx", visuals: Sequence[str] = ("table", "image")) -> DataFrame:
    """blocks with fragment: texts and footnotes between a caption and a visual that go on with the caption. Blocks that don't count are passed over."""
    counted = F.when(~F.col("type").isin(*PASSED_OVER), F.struct("type", *[F.col(k).cast("double").alias(k) for k in ("x0", "y0", "x1", "y1")]))
    spec = Window.partitionBy(*keys).orderBy(order)
    rows = blocks.withColumn("_me", counted)
    rows = rows.withColumn("_before", F.last("_me", ignorenulls=True).over(spec.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_after", F.first("_me", ignorenulls=True).over(spec.rowsBetween(1, Window.unboundedFollowing)))
    box = lambda c: Box.of_struct(F.col(c))
    fits = F.col("type").isin("text", "footnote") & (F.col("_before.type") == "caption") & F.col("_after.type").isin(*visuals) & is_inline_fragment(box("_before"), Box.named(), box("_after"))
    return rows.withColumn("fragment", F.coalesce(fits, F.lit(False))).drop("_me", "_before", "_after")


_BLOCK = ("idx", "type", "x0", "y0", "x1", "y1")


def page_blocks(blocks: DataFrame, keys: Sequence[str], *more: str) -> DataFrame:
    """keys, blocks: the blocks of a page that count, in order, as an array of structs; a page is bounded."""
    one = F.struct(F.col("idx").cast("long").alias("idx"), "type", *[F.col(k).cast("double").alias(k) for k in _BLOCK[2:]], *more)
    return blocks.where(~F.col("type").isin(*PASSED_OVER)).groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("blocks"))


def leading_continuations(blocks: DataFrame, keys: Sequence[str] = ("page_idx",)) -> DataFrame:
    """keys, idx of the texts that begin a page, say that a table goes on, and stand in a stack on the table that follows them.

    blocks: idx, type, text, n_lines and a box. Only texts and footnotes of one line count.
    """
    says = F.col("type").isin("text", "footnote") & (F.col("n_lines") <= 1) & is_continuation(F.col("text"))
    pages = page_blocks(blocks.withColumn("says", says), keys, "says")
    n = F.coalesce(F.array_min(F.transform("blocks", lambda b, i: F.when(~b["says"], i))), F.lit(0))
    pages = pages.withColumn("n", n).withColumn("table", F.get("blocks", F.col("n"))).where("n > 0 and table.type = 'table'")
    zero = F.struct(F.col("table.y0").alias("top"), F.lit(1.0).alias("tall"), F.lit(True).alias("on"))

    def step(s: Column, b: Column) -> Column:
        height = F.greatest(b["y1"] - b["y0"], F.lit(1.0))
        gap, tall = s["top"] - b["y1"], F.greatest(s["tall"], height)
        fits = is_near_table(Box.of_struct(b), Box.of_struct(F.col("table"))) & (gap <= F.greatest(F.lit(12.0), tall * 1.5)) & (gap >= -F.greatest(F.lit(2.0), height * 0.3))
        return F.struct(b["y0"].alias("top"), tall.alias("tall"), (s["on"] & fits).alias("on"))

    lead = F.slice("blocks", F.lit(1), F.col("n"))
    near = F.aggregate(F.reverse(lead), zero, step, lambda s: s["on"])
    return pages.where(near).select(*keys, F.explode(F.transform(lead, lambda b: b["idx"])).alias("idx"))


def stacked_captions(blocks: DataFrame, keys: Sequence[str] = ("page_idx",)) -> DataFrame:
    """keys, table_idx, stack, fragments: for each table with a caption in the stack on it, the stack's blocks and the single lines after its last caption.

    blocks: idx, type, n_lines and a box.
    """
    above = page_blocks(blocks.where(F.col("type").isin("caption", "text", "footnote")), keys)
    short = blocks.groupBy(*keys).agg(F.collect_set(F.when(F.col("n_lines") <= 1, F.col("idx").cast("long"))).alias("_short"))
    tables = blocks.where("type = 'table'").select(*keys, F.col("idx").alias("table_idx"), F.struct(*[F.col(k).cast("double").alias(k) for k in ("x0", "y0", "x1", "y1")]).alias("table"))
    met = tables.join(above, list(keys)).join(short, list(keys)).withColumn("stack", stacked_above(F.col("table"), F.col("blocks")))
    last = F.array_max(F.transform("stack", lambda b, i: F.when(b["type"] == "caption", i)))
    met = met.withColumn("last", last).where("last is not null")
    after = F.filter(F.slice("stack", F.col("last") + 2, F.size("stack")), lambda b: b["type"].isin("text", "footnote") & F.array_contains("_short", b["idx"]))
    ids = lambda xs: F.transform(xs, lambda b: b["idx"])
    return met.select(*keys, "table_idx", ids(F.col("stack")).alias("stack"), ids(after).alias("fragments"))


def stacked_above(table: Column, above: Column) -> Column:
    """The blocks (array of structs idx, type, x0, y0, x1, y1) that stand in a stack on a table, from the top.

    Walking up from the table, a block belongs to the stack while the gap below it is no more than 1.5 times the tallest block so far, or 12.
    """
    near = F.filter(above, lambda b: (b["y1"] <= table["y0"]) & is_near_table(Box.of_struct(b), Box.of_struct(table)))
    ordered = F.reverse(F.array_sort(F.transform(near, lambda b: F.struct(b["y0"].alias("top"), b["idx"].alias("at"), b.alias("block")))))
    kind = "array<struct<idx:bigint,type:string,x0:double,y0:double,x1:double,y1:double>>"
    zero = F.struct(table["y0"].cast("double").alias("top"), F.lit(1.0).alias("tall"), F.lit(True).alias("on"), F.array().cast(kind).alias("out"))

    def step(s: Column, x: Column) -> Column:
        b = x["block"]
        height = F.greatest(b["y1"] - b["y0"], F.lit(1.0))
        most, gap = F.greatest(F.lit(12.0), F.greatest(s["tall"], height) * 1.5), s["top"] - b["y1"]
        joins = s["on"] & (gap >= 0) & (gap <= most)
        return F.struct(
            F.when(joins, b["y0"]).otherwise(s["top"]).alias("top"), F.when(joins, F.greatest(s["tall"], height)).otherwise(s["tall"]).alias("tall"), joins.alias("on"),
            F.when(joins, F.concat(F.array(b), s["out"])).otherwise(s["out"]).alias("out"),
        )

    return F.aggregate(ordered, zero, step, lambda s: s["out"])
