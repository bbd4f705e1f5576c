"""HTML tables: building, parsing, the grid behind spans, header detection and merging across pages.

Parsing is an Arrow function (the standard library's parser); the grid, headers and merge tests work on arrays of rows. A table is one value, so nothing is
shuffled but the neighbours in page order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from quire.functions.text import escape_html, half_width, no_space
from quire.operators.sequence import reading_order

CELL = "struct<text:string,colspan:int,rowspan:int>"
ROWS = f"array<array<{CELL}>>"
#: Rows of a header at most, and how much two tables' widths may differ.
HEADER_ROWS, WIDTH_SHARE = 5, 0.1


class _Rows(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[dict]] = []
        self.cell: dict | None = None
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.depth += 1
        if self.depth > 1:  # a table inside a cell is text of that cell
            return
        if tag == "tr":
            self.close()
            self.rows.append([])
        elif tag in ("td", "th"):
            self.close()
            if not self.rows:
                self.rows.append([])
            span = lambda k: next((max(1, int(v)) for a, v in attrs if a == k and v and v.strip().isdigit()), 1)
            self.cell = {"text": "", "colspan": span("colspan"), "rowspan": span("rowspan")}

    def handle_endtag(self, tag):
        if tag == "table":
            self.depth -= 1
        if tag in ("td", "th", "tr", "table") and self.depth <= 1:
            self.close()

    def handle_data(self, data):
        if self.cell is not None:
            self.cell["text"] += data

    def close(self):
        if self.cell is not None:
            self.rows[-1].append(self.cell)
            self.cell = None


def rows_of_html(html: str) -> list[list[dict]]:
    parser = _Rows()
    parser.feed(html)
    parser.close()
    return parser.rows


#: Tables that are Python objects at once.
_AT_ONCE = 256


def by_slices(values: pa.Array, work: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """work on a few values at a time, so that what a batch takes in Python does not grow with the batch."""
    return pa.concat_arrays([work(values.slice(i, _AT_ONCE)) for i in range(0, max(len(values), 1), _AT_ONCE)])


def parse(html: Column) -> Column:
    """Rows of cells (text, colspan, rowspan) of an HTML table; null for null."""

    cell = pa.struct([("text", pa.string()), ("colspan", pa.int32()), ("rowspan", pa.int32())])

    @arrow_udf(ROWS)
    def cells(values: pa.Array) -> pa.Array:
        return by_slices(values, some)

    def some(values: pa.Array) -> pa.Array:
        # A text that stands in the slice again is parsed once.
        coded = values.dictionary_encode()
        return pa.array([rows_of_html(v) for v in coded.dictionary.to_pylist()], pa.list_(pa.list_(cell))).take(coded.indices)

    return cells(html)


def build(cells: DataFrame, keys: Sequence[str], row: str = "r", column: str = "c", text: str = "value", header: bool = True) -> DataFrame:
    """keys, html: cells as a table, all columns of the table's width, the first row as th where header is set."""
    extent = cells.groupBy(*keys).agg(F.min(column).alias("_c0"), F.max(column).alias("_c1"), F.min(row).alias("_first"))
    rows = cells.groupBy(*keys, row).agg(F.map_from_entries(F.collect_list(F.struct(F.col(column).cast("int"), escape_html(F.coalesce(F.col(text), F.lit("")))))).alias("_cells")).join(extent, list(keys))
    tag = F.when((F.col(row) == F.col("_first")) & F.lit(header), "th").otherwise("td")
    one = F.transform(F.sequence(F.col("_c0").cast("int"), F.col("_c1").cast("int")), lambda c: F.concat(F.lit("<"), tag, F.lit(">"), F.coalesce(F.try_element_at("_cells", c), F.lit("")), F.lit("</"), tag, F.lit(">")))
    rows = rows.select(*keys, F.col(row).alias("_r"), F.concat(F.lit("<tr>"), F.array_join(one, ""), F.lit("</tr>")).alias("_row"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_row"))), lambda x: x["_row"]), "")
    return rows.groupBy(*keys).agg(F.concat(F.lit("<table>"), body, F.lit("</table>")).alias("html"))


def row_columns(row: Column) -> Column:
    """Sum of the colspans of a row's own cells."""
    return F.aggregate(row, F.lit(0), lambda n, c: n + c["colspan"])


def same_structure(a: Column, b: Column) -> Column:
    """As many cells with the same colspans."""
    return F.transform(a, lambda c: c["colspan"]) == F.transform(b, lambda c: c["colspan"])


def signature(row: Column) -> Column:
    """Texts of a row in half width without white space."""
    return F.transform(row, lambda c: no_space(half_width(c["text"])))


def occupancy(rows: Column) -> Column:
    """struct(held, width, widths): the grid behind rows.

    held: for each column the number of rows below that a rowspan still holds; widths: columns of each row, those held from above among them.
    Cells take free columns from the left.
    """
    zero = F.struct(F.array().cast("array<int>").alias("held"), F.lit(0).alias("width"), F.array().cast("array<int>").alias("widths"))

    def step(state: Column, row: Column) -> Column:
        def put(s: Column, cell: Column) -> Column:
            # s: at (next column), held (as left by rows above), new (what this row adds)
            free = F.coalesce(F.array_min(F.filter(F.sequence(s["at"], F.greatest(F.size(s["held"]), s["at"])), lambda k: F.coalesce(F.get(s["held"], k), F.lit(0)) == 0)), s["at"])
            added = F.concat(s["new"], F.array_repeat(F.lit(0), F.greatest(free - F.size(s["new"]), F.lit(0))), F.array_repeat(cell["rowspan"] - 1, cell["colspan"]))
            return F.struct((free + cell["colspan"]).alias("at"), s["held"].alias("held"), added.alias("new"))

        start = F.struct(F.lit(0).alias("at"), state["held"].alias("held"), F.array().cast("array<int>").alias("new"))

        def close(s: Column) -> Column:
            taken = F.greatest(F.size(s["new"]), F.coalesce(F.array_max(F.transform(s["held"], lambda h, i: F.when(h > 0, i + 1).otherwise(0))), F.lit(0)))
            held = F.zip_with(s["held"], s["new"], lambda h, n: F.greatest(F.coalesce(h, F.lit(0)) - 1, F.coalesce(n, F.lit(0)), F.lit(0)))
            return F.struct(held.alias("held"), F.greatest(state["width"], taken).alias("width"), F.concat(state["widths"], F.array(taken)).alias("widths"))

        return F.aggregate(row, start, put, close)

    return F.aggregate(rows, zero, step)


def header_rows(first: Column, second: Column, most: int = HEADER_ROWS) -> Column:
    """How many leading rows two tables share (structure and texts), `most` at the most."""
    same = F.zip_with(F.slice(first, 1, most), F.slice(second, 1, most), lambda a, b: F.coalesce(same_structure(a, b) & (signature(a) == signature(b)), F.lit(False)))
    return F.aggregate(same, F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), lambda s, x: F.struct((s["on"] & x).alias("on"), F.when(s["on"] & x, s["n"] + 1).otherwise(s["n"]).alias("n")), lambda s: s["n"])


def merge_candidates(blocks: DataFrame, keys: Sequence[str] = ("doc_id",), share: float = WIDTH_SHARE) -> DataFrame:
    """keys, page_idx, upper_id, lower_id: tables that end one page and begin the next, with widths within `share` of each other.

    blocks: keys, page_idx, block_id (in reading order), type, x0, x1. Chains over several pages give one row for each pair.
    """
    ends = blocks.groupBy(*keys, "page_idx").agg(F.min_by(F.struct("block_id", "type", "x0", "x1"), "block_id").alias("first"), F.max_by(F.struct("block_id", "type", "x0", "x1"), "block_id").alias("last"))
    order = reading_order(keys, ("page_idx",))
    met = ends.withColumns({"above": F.lag("last").over(order), "page_above": F.lag("page_idx").over(order)})
    width = lambda c: F.col(f"{c}.x1") - F.col(f"{c}.x0")
    fits = (F.col("page_above") == F.col("page_idx") - 1) & (F.col("first.type") == "table") & (F.col("above.type") == "table") & (F.abs(width("first") - width("above")) < share * F.greatest(F.least(width("first"), width("above")), F.lit(1e-9)))
    return met.where(fits).select(*keys, "page_idx", F.col("above.block_id").alias("upper_id"), F.col("first.block_id").alias("lower_id"))


def merged_rows(upper: Column, lower: Column) -> Column:
    """Rows of a table with those of its continuation, without the header that both share."""
    return F.concat(upper, F.slice(lower, header_rows(upper, lower) + 1, F.greatest(F.size(lower), F.lit(1))))


def to_html(rows: Column) -> Column:
    """Rows as an HTML table."""
    span = lambda c, k: F.when(c[k] > 1, F.concat(F.lit(f' {k}="'), c[k].cast("string"), F.lit('"'))).otherwise(F.lit(""))
    cell = lambda c: F.concat(F.lit("<td"), span(c, "colspan"), span(c, "rowspan"), F.lit(">"), escape_html(c["text"]), F.lit("</td>"))
    return F.concat(F.lit("<table>"), F.array_join(F.transform(rows, lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, cell), ""), F.lit("</tr>"))), ""), F.lit("</table>"))
