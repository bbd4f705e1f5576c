"""Operators on the reading order: islands, neighbours, barriers and running extremes.

One window over (document, page) gives neighbours and running sums; everything that shares it is planned as one
sort. Groups are numbered by cumulative sums of breaks, so they need no loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.functions.geometry import Box


def reading_order(keys: Sequence[str] = ("page_idx",), order: Sequence[str | Column] = ("det_id",)) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def running(order: WindowSpec) -> WindowSpec:
    return order.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before(order: WindowSpec) -> WindowSpec:
    return order.rowsBetween(Window.unboundedPreceding, -1)


def islands(starts: Column, order: WindowSpec) -> Column:
    """Number (from 1) of the run that a row belongs to; starts marks the first row of each."""
    return F.sum(F.coalesce(starts, F.lit(True)).cast("long")).over(running(order))


def runs_of(value: Column, order: WindowSpec) -> Column:
    """Number of the run of equal neighbours."""
    return islands(~value.eqNullSafe(F.lag(value).over(order)) | (F.row_number().over(order) == 1), order)


def tag_formulas(blocks: DataFrame, order: WindowSpec, equation: str = "interline_equation", number: str = "formula_number") -> DataFrame:
    """blocks with tag_from and new_type.

    A formula number goes to the equation right before it, else to the one right after it, unless a number follows that one;
    a number that goes nowhere becomes text, one that is used is `used`. tag_from of an equation: -1 if its number comes before it,
    1 if after, null without one.
    """
    is_eq = lambda c: F.coalesce(c == equation, F.lit(False))
    is_no = lambda c: F.coalesce(c == number, F.lit(False))
    kind = F.col("type")
    at = lambda n: F.lag(kind, n).over(order) if n > 0 else F.lead(kind, -n).over(order)
    follows = is_no(at(-1))
    # The number before an equation is its own only if that number has no equation before it and no number comes next.
    precedes = is_no(at(1)) & ~is_eq(at(2)) & ~follows
    tag = F.when(is_eq(kind) & follows, 1).when(is_eq(kind) & precedes, -1)
    used = is_no(kind) & (is_eq(at(1)) | (is_eq(at(-1)) & ~is_no(at(-2))))
    return blocks.withColumns({"tag_from": tag, "new_type": F.when(used, "used").when(is_no(kind), "text").otherwise(kind)})


def paragraph_groups(blocks: DataFrame, order: WindowSpec, members: Sequence[str], barriers: Sequence[str]) -> DataFrame:
    """Member blocks with their group: a barrier ends a group, all other types are passed over."""
    group = F.sum(F.col("type").isin(*barriers).cast("long")).over(running(order))
    return blocks.withColumn("para_group", group).where(F.col("type").isin(*members))


def previous_of_type(kind: str, value: str | Column, order: WindowSpec, barriers: Sequence[str]) -> Column:
    """The value of the last block of a kind before this one, with no barrier between."""
    seen = F.when(F.col("type") == kind, F.struct(F.lit(True).alias("hit"), (F.col(value) if isinstance(value, str) else value).alias("v")))
    stop = F.when(F.col("type").isin(*barriers), F.struct(F.lit(False).alias("hit"), F.lit(None).cast("long").alias("v")))
    return F.last(F.coalesce(seen, stop), ignorenulls=True).over(before(order))["v"]


def merge_runs(blocks: DataFrame, kind: str, keys: Sequence[str] = ("page_idx",), order: Sequence[str] = ("det_id",)) -> DataFrame:
    """keys, run, first_id, n, members: each run of neighbouring blocks of one kind, in order."""
    spec = reading_order(keys, order)
    rows = blocks.withColumn("run", runs_of(F.col("type") == kind, spec)).where(F.col("type") == kind)
    first, *_ = order
    got = rows.groupBy(*keys, "run").agg(F.min(first).alias("first_id"), F.count("*").alias("n"), F.array_sort(F.collect_list(first)).alias("members"))
    return got.drop("run")


def line_breaks(order: WindowSpec, threshold: float = 0.6, alone: Sequence[str] = ()) -> Column:
    """True where a span opens a line: it shares too little height with the span before it, or one of both stands alone."""
    box = Box.named()
    prev = Box(*[F.lag(F.col(k)).over(order) for k in ("x0", "y0", "x1", "y1")])
    opens = ~(g.y_overlap_of_lower(prev, box) > threshold)
    if alone:
        opens = opens | F.col("type").isin(*alone) | F.lag(F.col("type")).over(order).isin(*alone)
    return opens


def column_breaks(order: WindowSpec, threshold: float = 0.6) -> Column:
    box = Box.named()
    prev = Box(*[F.lag(F.col(k)).over(order) for k in ("x0", "y0", "x1", "y1")])
    return ~(g.x_overlap_of_narrower(prev, box) > threshold)


def merge_lines(spans: DataFrame, keys: Sequence[str] = ("page_idx",), span_id: str = "det_id", threshold: float = 0.6, alone: Sequence[str] = (), vertical: bool = False) -> DataFrame:
    """keys, line, spans (ids in reading order), x0, y0, x1, y1: spans by lines, or by columns from right to left."""
    order = reading_order(keys, ["y0", span_id] if not vertical else [F.col("x1").desc(), span_id])
    rows = spans.withColumn("line", islands(column_breaks(order, threshold) if vertical else line_breaks(order, threshold, alone), order))
    along = "y0" if vertical else "x0"
    got = rows.groupBy(*keys, "line").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(along, span_id))), lambda s: s[span_id]).alias("spans"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")
    )
    return got


def interval_union(rows: DataFrame, low: str, high: str, keys: Sequence[str] = ("page_idx",)) -> DataFrame:
    """keys, low, high: disjoint intervals with the same points; intervals that touch become one."""
    order = reading_order(keys, [low, high])
    reached = F.max(high).over(before(order))
    found = rows.where(F.col(low).isNotNull() & F.col(high).isNotNull()).withColumn("run", islands(F.col(low) > reached, order))
    return found.groupBy(*keys, "run").agg(F.min(low).alias(low), F.max(high).alias(high)).drop("run")


def interval_difference(whole: Column, masks: Column) -> Column:
    """array<struct<low,high>> of what disjoint, ascending masks (structs low, high of whole numbers) leave of whole (struct low, high)."""
    kind = "array<struct<low:bigint,high:bigint>>"
    start = F.struct(whole["low"].cast("long").alias("at"), F.array().cast(kind).alias("out"))

    def cut(s: Column, m: Column) -> Column:
        low, high = m["low"].cast("long"), m["high"].cast("long")
        apart = (high < s["at"]) | (low > whole["high"])
        piece = F.when((low > s["at"]) & ~apart, F.array(F.struct(s["at"].alias("low"), (low - 1).alias("high")))).otherwise(F.array().cast(kind))
        return F.struct(F.when(apart, s["at"]).otherwise(F.greatest(s["at"], high + 1)).alias("at"), F.concat(s["out"], piece.cast(kind)).alias("out"))

    def end(s: Column) -> Column:
        rest = F.when(s["at"] <= whole["high"], F.array(F.struct(s["at"].alias("low"), whole["high"].cast("long").alias("high")))).otherwise(F.array().cast(kind))
        return F.concat(s["out"], rest.cast(kind))

    return F.aggregate(masks, start, cut, end)


def merge_overlapping(spans: DataFrame, keys: Sequence[str] = ("page_idx",)) -> DataFrame:
    """Boxes that overlap along x, in order of x, as one box each."""
    order = reading_order(keys, ["x0", "x1", "y0", "y1"])
    reached = F.max("x1").over(before(order))
    rows = spans.withColumn("run", islands(F.col("x0") > reached, order))
    return rows.groupBy(*keys, "run").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n")).drop("run")


def foldable_chain(can_merge: Column, several_lines: Column, order: WindowSpec) -> Column:
    """True where a block joins the block before it.

    can_merge: all conditions but one hold for (previous, this). The last one asks that either block has more than one line, and
    a block has so once its successor has joined it; so within a chain of mergeable neighbours a block joins
    if it or the previous one has several lines, or if its successor joins it. Read from the right this is: some block from this
    one's predecessor on, up to the end of the chain, has several lines, or two blocks have met already.
    """
    # In a chain b0 b1 .. bn of mergeable neighbours the pair (i-1, i) merges iff a pair further right merges or one of both is long,
    # so it merges iff any of b(i-1) .. bn is long.
    chain = F.sum((~F.coalesce(can_merge, F.lit(False))).cast("long")).over(running(order))
    return chain


def paragraph_merges(blocks: DataFrame, can_merge: Column, several_lines: Column, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """blocks with joins: whether a block is taken into the one before it (see foldable_chain)."""
    spec = reading_order(keys, order)
    rows = blocks.withColumns({"_can": F.coalesce(can_merge, F.lit(False)), "_long": several_lines})
    rows = rows.withColumn("_chain", foldable_chain(F.col("_can"), F.col("_long"), spec))
    rest = Window.partitionBy(*keys, "_chain").orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumns({"_after": F.max("_long").over(rest), "_prev_long": F.lag("_long").over(spec)})
    return rows.withColumn("joins", F.col("_can") & (F.col("_after") | F.coalesce("_prev_long", F.lit(False)))).drop("_can", "_long", "_chain", "_after", "_prev_long")


def section_numbers(titles: DataFrame, keys: Sequence[str] = ("doc_id",), order: Sequence[str] = ("pos",), depth: int = 6) -> DataFrame:
    """titles(level) with section: '1.2.3'. A title counts up its level, starts deeper ones again, and ancestors that were never counted are 1.

    A counter restarts when a shallower title comes, so the count at level k is a running count within the island of shallower titles;
    every level is one window over the same order.
    """
    spec = reading_order(keys, order)
    rows, parts = titles, []
    for k in range(1, depth + 1):
        outer = F.sum((F.col("level") < k).cast("long")).over(running(spec))
        rows = rows.withColumn(f"_outer{k}", outer)
    for k in range(1, depth + 1):
        own = Window.partitionBy(*keys, f"_outer{k}").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # A deeper title met first sets its missing ancestors to 1; a title of level k after that counts on from there.
        first_is_deeper = F.first((F.when(F.col("level") >= k, F.col("level"))), ignorenulls=True).over(own) > k
        seen = F.sum((F.col("level") == k).cast("long")).over(own)
        rows = rows.withColumn(f"_n{k}", seen + F.coalesce(first_is_deeper, F.lit(False)).cast("long"))
        parts.append(F.when(F.col("level") >= k, F.col(f"_n{k}").cast("string")))
    rows = rows.withColumn("section", F.array_join(F.array_compact(F.array(*parts)), "."))
    return rows.drop(*[f"_outer{k}" for k in range(1, depth + 1)], *[f"_n{k}" for k in range(1, depth + 1)])
