"""Putting documents together: titles, lists, recognised texts, rich text, anchors and choices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.sequence import islands

# Fixed value: recognised text counts from this score on.
OCR_SCORE = 0.5


def title_kind(kind: Column) -> Column:
    """struct(type, level): document titles are titles of level 1, paragraph titles of level 2, vertical text is text."""
    named = F.when(kind.isin("doc_title", "paragraph_title"), "title").when(kind == "vertical_text", "text").otherwise(kind)
    return F.struct(named.alias("type"), F.when(kind == "doc_title", 1).when(kind == "paragraph_title", 2).alias("level"))


def title_level(level: Column, most: int | None = None) -> Column:
    """Level 1 where none is given, 0 below 1, at most `most` where that is set."""
    known = F.coalesce(level, F.lit(1))
    known = F.when(known < 1, 0).otherwise(known)
    return F.least(known, F.lit(most)) if most else known


def apply_recognised(spans: DataFrame, recognised: DataFrame, keys: Sequence[str], least: float = OCR_SCORE) -> DataFrame:
    """spans(keys, text, fallback) with text replaced: a recognised text of a score above `least`, else the fallback, else nothing.

    Spans that were not sent to recognition keep their text.
    """
    r = recognised.select(*keys, F.col("text").alias("_text"), F.col("score").alias("_score"), F.lit(True).alias("_sent"))
    text = F.when(F.col("_sent").isNull(), F.col("text")).when(F.col("_score") > least, F.col("_text")).otherwise(F.coalesce("fallback", F.lit("")))
    return spans.join(r, list(keys), "left").withColumn("text", text).drop("_text", "_score", "_sent")


def copy_levels(blocks: DataFrame, titles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """blocks with the level of the title of the same key, the last one where there are several; others keep their own."""
    last = titles.groupBy(*keys).agg(F.max_by("level", "seq").alias("_level"))
    return blocks.join(last, list(keys), "left").withColumn("level", F.coalesce("_level", "level")).drop("_level")


def keep_known_anchors(entries: DataFrame, blocks: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """entries with anchor set to null where no block of the document has it."""
    known = blocks.select(*keys, F.trim("anchor").alias("anchor")).where("anchor <> ''").distinct().withColumn("_known", F.lit(True))
    rows = entries.withColumn("anchor", F.trim("anchor"))
    return rows.join(known, [*keys, "anchor"], "left").withColumn("anchor", F.when(F.col("_known"), F.col("anchor"))).drop("_known")


def flatten_lists(items: DataFrame, keys: Sequence[str] = ("doc_id",), order: str = "seq") -> DataFrame:
    """items(level, ordered, text) with line: indented by level, marked by - or by their number.

    Numbers count items of one level since the last item of a shallower one.
    """
    spec = Window.partitionBy(*keys).orderBy(order)
    levels = range(0, 8)
    rows = items
    for k in levels:
        rows = rows.withColumn(f"_o{k}", F.sum((F.col("level") < k).cast("long")).over(spec.rowsBetween(Window.unboundedPreceding, 0)))
    parent = F.element_at(F.array(*[F.col(f"_o{k}") for k in levels]), (F.least(F.col("level"), F.lit(levels[-1])) + 1).cast("int"))
    rows = rows.withColumn("_parent", parent)
    number = F.row_number().over(Window.partitionBy(*keys, "level", "_parent").orderBy(order))
    mark = F.when(F.col("ordered"), F.concat(number.cast("string"), F.lit("."))).otherwise("-")
    return rows.withColumn("line", F.concat(F.repeat(F.lit("    "), F.col("level").cast("int")), mark, F.lit(" "), F.col("text"))).drop("_parent", *[f"_o{k}" for k in levels])


def merge_segments(segments: DataFrame, keys: Sequence[str] = ("doc_id",), order: str = "seq") -> DataFrame:
    """keys, first, style, link, text: neighbouring segments of one style, or of one link, as one; empty ones are passed over."""
    rows = segments.where(F.coalesce("text", F.lit("")) != "")
    spec = Window.partitionBy(*keys).orderBy(order)
    # Segments of one link are one, whatever their styles; others need the same style and no link.
    kind = F.when(F.col("link").isNotNull(), F.concat(F.lit("link:"), F.col("link"))).otherwise(F.concat(F.lit("style:"), F.coalesce("style", F.lit(""))))
    rows = rows.withColumn("_kind", kind).withColumn("_run", islands((F.lag("_kind").over(spec) != F.col("_kind")) | F.lag("_kind").over(spec).isNull(), spec))
    got = rows.groupBy(*keys, "_run").agg(F.array_sort(F.collect_list(F.struct(order, "text", "style"))).alias("_parts"), F.first("link").alias("link"))
    return got.select(*keys, F.get("_parts", F.lit(0))[order].alias("first"), F.get("_parts", F.lit(0))["style"].alias("style"), "link", F.array_join(F.transform("_parts", lambda p: p["text"]), "").alias("text"))


def styled(text: Column, style: Column) -> Column:
    """Markdown marks for bold, italic and struck text; other styles as HTML tags around."""
    has = lambda s: F.array_contains(F.split(F.coalesce(style, F.lit("")), ","), s)
    wrap = lambda t, on, a, b: F.when(on, F.concat(F.lit(a), t, F.lit(b))).otherwise(t)
    text = wrap(text, has("superscript"), "<sup>", "</sup>")
    text = wrap(text, has("subscript"), "<sub>", "</sub>")
    text = wrap(text, has("underline"), "<u>", "</u>")
    text = wrap(text, has("strikethrough"), "~~", "~~")
    return wrap(wrap(text, has("italic"), "*", "*"), has("bold"), "**", "**")


def commonest(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, value, n: the commonest value, the smallest on a tie."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), F.col(value))).alias("b")).select(*keys, f"b.{value}", "b.n")


def script_roles(chars: DataFrame, keys: Sequence[str] = ("line_id",), tolerance: float = 0.2) -> DataFrame:
    """chars(y0, y1) with role: body, sup or sub, by the distance of the centre from the line's median centre in median heights."""
    center, height = (F.col("y0") + F.col("y1")) / 2, F.col("y1") - F.col("y0")
    line = chars.groupBy(*keys).agg(F.median(center).alias("_c"), F.median(height).alias("_h"))
    off = center - F.col("_c")
    return chars.join(line, list(keys)).withColumn("role", F.when(off < -tolerance * F.col("_h"), "sup").when(off > tolerance * F.col("_h"), "sub").otherwise("body")).drop("_c", "_h")


def is_vertical(spans: DataFrame, keys: Sequence[str] = ("page_idx",), ratio: float = 2.0, share: float = 0.8) -> DataFrame:
    """keys, vertical: more than `share` of the spans are over `ratio` times as high as wide."""
    tall = F.coalesce(F.try_divide(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")) > ratio, F.lit(False))
    return spans.groupBy(*keys).agg((F.avg(tall.cast("double")) > share).alias("vertical"))


def least_loaded(servers: DataFrame) -> DataFrame:
    """The server to take the next task: by load for its capacity, then pending tasks, then local ones first, then id."""
    score = F.col("pending") / F.greatest(F.col("capacity"), F.lit(1))
    return servers.withColumn("score", score).orderBy("score", "pending", F.col("local").desc(), "server_id").limit(1)

