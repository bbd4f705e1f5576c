"""Detections of a page before they are blocks: page units, routing, crops, sidecar rows, duplicated characters, batches, page ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.geometry import Box, overlap_of_smaller

# Sides up to this are dropped; shadows of characters lie this far off, move as one and overlap so much; rendering takes so many tasks and pages.
LEAST_SIDE = 2
NEAR, SHADOW, RIGID, OVERLAP = 1.0, 2.5, 0.1, 0.45
RENDER_TASKS, RENDER_PAGES = 3, 30
# Fixed value: pages longer or wider than this are not measured.
MOST_ASPECT = 10.0


def in_page_units(detections: DataFrame, scale: Column) -> DataFrame:
    """detections(x0, y0, x1, y1) divided by the scale, cut to whole numbers; boxes of a side of LEAST_SIDE or less are dropped."""
    cut = lambda c: (F.col(c) / scale).cast("int")
    rows = detections.withColumns({c: cut(c) for c in ("x0", "y0", "x1", "y1")})
    return rows.where((F.col("x1") - F.col("x0") > LEAST_SIDE) & (F.col("y1") - F.col("y0") > LEAST_SIDE))


def routed(detections: DataFrame, keys: Sequence[str] = ("page_idx",), order: str = "det_id") -> DataFrame:
    """detections with route (inline_equation, text or block) and number: blocks that have an index are numbered from 1 in order."""
    route = F.when(F.col("label") == "inline_formula", "inline_equation").when(F.col("label") == "ocr_text", "text").otherwise("block")
    rows = detections.withColumn("route", route)
    counted = (F.col("route") == "block") & F.col("idx").isNotNull()
    running = F.sum(counted.cast("int")).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("number", F.when(counted, running))


def without_blank_text(detections: DataFrame, ocr: bool = True) -> DataFrame:
    """Recognised texts that are empty or blank are dropped where recognition is on."""
    blank = F.coalesce(F.regexp_replace("text", r"\s+", "") == "", F.lit(True))
    return detections.where(~((F.col("label") == "ocr_text") & blank)) if ocr else detections


def in_crop(boxes: DataFrame) -> DataFrame:
    """boxes(x0.., crop struct(x0, y0, paste_x, paste_y, width, height)) moved into the crop's own place; those outside are dropped."""
    dx, dy = F.col("crop.paste_x") - F.col("crop.x0"), F.col("crop.paste_y") - F.col("crop.y0")
    rows = boxes.withColumns({"x0": F.col("x0") + dx, "x1": F.col("x1") + dx, "y0": F.col("y0") + dy, "y1": F.col("y1") + dy})
    return rows.where((F.col("x1") >= 0) & (F.col("y1") >= 0) & (F.col("x0") <= F.col("crop.width")) & (F.col("y0") <= F.col("crop.height")))


def with_sidecars(rows: DataFrame, *sidecars: DataFrame) -> DataFrame:
    """rows and the rows of each sidecar that have a box."""
    for s in sidecars:
        rows = rows.unionByName(s.where("x0 is not null"), allowMissingColumns=True)
    return rows


def is_shadow(before: Box, now: Box, same_look: Column) -> Column:
    """Whether a character is the shadow of the one before: the same look, a rigid diagonal shift of NEAR to SHADOW, and enough overlap."""
    moved = lambda a, b: F.abs(b - a)
    rigid = (F.abs((now.x0 - before.x0) - (now.x1 - before.x1)) <= RIGID) & (F.abs((now.y0 - before.y0) - (now.y1 - before.y1)) <= RIGID)
    shift = lambda a, b: (moved(a, b) > NEAR) & (moved(a, b) <= SHADOW)
    return same_look & rigid & shift(before.x0, now.x0) & shift(before.y0, now.y0) & (F.coalesce(overlap_of_smaller(before, now), F.lit(0.0)) >= OVERLAP)


def look(char: Column, font: Column, rotation: Column) -> Column:
    """What two characters must share to look the same: the character, its font and its rotation to three places."""
    return F.struct(char.alias("char"), font.alias("font"), F.bround(F.coalesce(rotation, F.lit(0.0)), 3).alias("rotation"))


def without_line_breaks(chars: DataFrame) -> DataFrame:
    return chars.where(~F.col("char").isin("\r", "\n"))


def first_extreme_page(pages: DataFrame, keys: Sequence[str] = ("doc_id",), most: float = MOST_ASPECT) -> DataFrame:
    """keys, page_idx, ratio: the first sampled page with a longer side over `most` times the other; pages without size are passed over."""
    ratio = F.greatest(F.col("width") / F.col("height"), F.col("height") / F.col("width"))
    far = pages.where("width > 0 and height > 0").withColumn("ratio", ratio).where(F.col("ratio") > most)
    return far.groupBy(*keys).agg(F.min_by(F.struct("page_idx", "ratio"), "page_idx").alias("p")).select(*keys, "p.page_idx", "p.ratio")


def map_errors(samples: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """keys, total, errors, ratio: characters without a Unicode mapping in all samples of a document."""
    sums = samples.groupBy(*keys).agg(F.sum("chars").alias("total"), F.sum("errors").alias("errors"))
    return sums.withColumn("ratio", F.coalesce(F.try_divide("errors", "total"), F.lit(0.0)))


def render_tasks(pages: Column, wanted: Column, cpus: Column) -> Column:
    """How many tasks render so many pages."""
    one = F.lit(1)
    return F.least(F.greatest(one, cpus), F.greatest(one, wanted), F.lit(RENDER_TASKS), F.greatest(one, F.floor(pages / RENDER_PAGES).cast("int")))


def page_ranges(first: Column, last: Column, tasks: Column) -> Column:
    """array<struct<first, last>>: pages cut evenly, the first ranges one page longer where they don't come out even."""
    pages = last - first + 1
    base, more = F.floor(pages / tasks).cast("int"), pages % tasks
    begin = lambda k: (first + k * base + F.least(k, more)).cast("int")
    return F.transform(F.sequence(F.lit(0), tasks - 1), lambda k: F.struct(begin(k).alias("first"), (begin(k + 1) - 1).alias("last")))


def in_index_order(blocks: Column) -> Column:
    """blocks (array of structs with idx) by index, those without one last, ties as they stand."""
    placed = F.transform(blocks, lambda b, i: F.struct(b["idx"].isNull().alias("none"), b["idx"].alias("idx"), i.alias("at"), b.alias("block")))
    return F.transform(F.array_sort(placed), lambda p: p["block"])


def _power_at_most(n: int) -> int:
    return 1 << (n.bit_length() - 1) if n > 0 else 0


def formula_batches(areas: Sequence[int], wanted: int) -> list[int]:
    """Sizes of the batches of formulas that are sorted by area.

    A batch is a power of two; it is halved once for each doubling from four on of its mean area over the first batch's, but not under a quarter of
    what is wanted (16 at least). A last batch smaller than the one before joins it, and a single batch smaller than wanted is cut in two.
    """
    n, least = len(areas), max(16, wanted // 4)
    size = min(wanted, _power_at_most(max(1, n)))
    if not n or size < 1:
        return []
    sizes: list[int] = []
    at = 0
    while at < n:
        left = n - at
        if left < least:
            sizes.append(left)
            break
        probe = min(size, left)
        base = sum(areas[:size]) / size
        ratio = sum(areas[at : at + probe]) / probe / base if base > 0 else 1
        now, bound = size, 4
        while ratio >= bound and now // 2 >= least:
            now, bound = now // 2, bound * 2
        sizes.append(min(now, _power_at_most(left)))
        at += sizes[-1]
    if len(sizes) == 1:
        head = _power_at_most(n - 1) if 1 < n < wanted else 0
        return [head, n - head] if head else sizes
    while len(sizes) >= 3 and sizes[-1] < sizes[-2]:
        sizes[-2:] = [sizes[-2] + sizes[-1]]
    return sizes
