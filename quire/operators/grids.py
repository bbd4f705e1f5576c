"""The grid behind rows of cells with spans: which cell covers which column of which row, and what follows from it.

Rows are arrays of cells (structs with text, colspan, rowspan). The grid and the rows of recognised tokens are made cell after cell, by Arrow functions;
everything else are expressions that read the grid. A lambda must not name an Arrow function, so what such a function gives is bound first.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from quire.functions.text import half_width, strip
from quire.operators.tables import HEADER_ROWS, ROWS, by_slices, row_columns, signature

#: A cell's number is its row times this plus its place in the row.
_PER_ROW = 100_000


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def covered(rows: list[list[tuple[int, int]]]) -> list[list[int | None]]:
    """The grid of rows of (colspan, rowspan)."""
    reach, source, out = [], [], []  # by column: rows below that a cell still covers, and its number
    for number, row in enumerate(rows):
        new, at = {}, 0
        for i, (colspan, rowspan) in enumerate(row):
            while at < len(reach) and reach[at]:
                at += 1
            for at in range(at, at + colspan):
                new[at] = (rowspan - 1, number * _PER_ROW + i)
            at += colspan > 0
        more = max(new, default=-1) + 1 - len(reach)
        reach += [0] * more
        source += [None] * more
        line = [source[k] if n else None for k, n in enumerate(reach)]
        reach = [n - 1 if n else 0 for n in reach]
        for k, (n, cell) in new.items():
            line[k] = cell
            if n >= reach[k]:
                reach[k], source[k] = n, cell
        while line and line[-1] is None:
            line.pop()
        out.append(line)
    return out


def _nested(tables: list[list[list] | None], items: pa.Array) -> pa.Array:
    """Rows of tables over their items, which follow each other."""
    of_row, of_table, n = [0], [0], 0
    for table in tables:
        for row in table or ():
            n += len(row)
            of_row.append(n)
        of_table.append(len(of_row) - 1)
    rows = pa.ListArray.from_arrays(pa.array(of_row, pa.int32()), items)
    return pa.ListArray.from_arrays(pa.array(of_table, pa.int32()), rows, mask=pa.array([t is None for t in tables], pa.bool_()))


def _spans(tables: pa.Array) -> list[list[list[tuple[int, int]]] | None]:
    """Rows of (colspan, rowspan), without the texts; a span that is missing counts as 1."""
    of_table, of_row = tables.offsets.to_pylist(), tables.values.offsets.to_pylist()
    first, last = of_row[of_table[0]], of_row[of_table[-1]]
    cells = tables.values.values.slice(first, last - first)
    pairs = list(zip(*(pc.fill_null(pc.struct_field(cells, k), 1).to_pylist() for k in ("colspan", "rowspan"))))
    return [[pairs[of_row[r] - first : of_row[r + 1] - first] for r in range(a, b)] if known else None for a, b, known in zip(of_table, of_table[1:], tables.is_valid().to_pylist())]


def grid(rows: Column) -> Column:
    """For each row, by column, the number of the cell that covers it; null where none does.

    A cell takes the first free column at or after the end of the one before. A wide cell covers what it meets; of two cells that reach below,
    the one that reaches further holds the column.
    """

    def some(tables: pa.Array) -> pa.Array:
        grids = [None if t is None else covered(t) for t in _spans(tables)]
        return _nested(grids, pa.array([x for g in grids for line in g or () for x in line], pa.int32()))

    @arrow_udf("array<array<int>>")
    def of_batch(values: pa.Array) -> pa.Array:
        return by_slices(values, some)

    return of_batch(rows)


def width(of: Column) -> Column:
    """Columns of a grid."""
    return F.coalesce(F.array_max(F.transform(of, lambda line: F.size(line))), F.lit(0))


def first_columns(of: Column, row: Column) -> Column:
    """The column in which each of the row's own cells begins."""
    line = F.get(of, row)
    own = F.filter(F.array_distinct(line), lambda x: x >= row * _PER_ROW)
    return F.transform(own, lambda x: (F.array_position(line, x) - 1).cast("int"))


def segments(rows: Column, of: Column, row: Column) -> Column:
    """array<struct<text, first, last>>: the runs of columns that one cell covers in a row, cells from above among them; last is excluded."""
    line = F.get(of, row)
    begins = F.filter(F.transform(line, lambda x, i: F.when(x.isNotNull() & ~x.eqNullSafe(F.get(line, i - 1)), i)), lambda i: i.isNotNull())
    ends = lambda i: F.coalesce(F.array_min(F.transform(line, lambda x, j: F.when((j > i) & ~x.eqNullSafe(F.get(line, i)), j))), F.size(line))
    cell = lambda x: F.get(F.get(rows, F.floor(x / _PER_ROW).cast("int")), x % _PER_ROW)
    return F.transform(begins, lambda i: F.struct(strip(half_width(cell(F.get(line, i))["text"])).alias("text"), i.alias("first"), ends(i).alias("last")))


def segment_count(of: Column, row: Column) -> Column:
    line = F.get(of, row)
    return F.size(F.filter(F.transform(line, lambda x, i: x.isNotNull() & ~x.eqNullSafe(F.get(line, i - 1))), lambda b: b))


def _leading(flags: Column) -> Column:
    """How many flags are set before the first that isn't."""
    return _let(flags, lambda known: F.coalesce(F.array_min(F.transform(known, lambda x, i: F.when(~F.coalesce(x, F.lit(False)), i))), F.size(known)))


def shared_header(first: Column, second: Column, grid1: Column, grid2: Column, most: int = HEADER_ROWS) -> Column:
    """How many leading rows two tables share: in texts, spans and width, or, where not even the first does, in texts and the number of segments."""
    n = F.least(F.size(first), F.size(second), F.lit(most))
    places = F.slice(F.sequence(F.lit(0), F.lit(most)), F.lit(1), n)
    row = lambda t, i: F.get(t, i)
    texts = lambda i: signature(row(first, i)) == signature(row(second, i))
    spans = lambda i: F.transform(row(first, i), lambda c: F.struct(c["colspan"], c["rowspan"])) == F.transform(row(second, i), lambda c: F.struct(c["colspan"], c["rowspan"]))
    exact = F.transform(places, lambda i: texts(i) & spans(i) & (F.size(row(grid1, i)) == F.size(row(grid2, i))))
    seen = F.transform(places, lambda i: texts(i) & (segment_count(grid1, i) == segment_count(grid2, i)))
    return _let(_leading(exact), lambda k: F.when(k > 0, k).otherwise(_leading(seen)))


def whole_header(rows: Column, count: Column) -> Column:
    """count rows and all rows that their rowspans reach into."""
    reach = F.transform(rows, lambda r, i: F.struct(i.alias("at"), (i + F.coalesce(F.array_max(F.transform(r, lambda c: c["rowspan"])), F.lit(1))).alias("to")))
    most = lambda n: F.aggregate(reach, F.least(n, F.size(rows)), lambda e, x: F.when(x["at"] < e, F.least(F.greatest(e, x["to"]), F.size(rows))).otherwise(e))
    return _let(count, lambda n: F.when(n > 0, most(n)).otherwise(n))


def rows_meet(upper: Column, lower: Column, grid1: Column, grid2: Column, most: int = HEADER_ROWS, shared: Column | None = None) -> Column:
    """Whether the last row of a table with cells and the first row of the next one behind the shared header have as many columns or segments.

    shared: shared_header of both where it is known.
    """
    last = F.array_max(F.transform(upper, lambda r, i: F.when(F.size(r) > 0, i)))
    head = whole_header(lower, shared_header(upper, lower, grid1, grid2, most) if shared is None else shared)

    def compare(a: Column, b: Column) -> Column:
        same = (F.size(F.get(grid1, a)) == F.size(F.get(grid2, b))) | (row_columns(F.get(upper, a)) == row_columns(F.get(lower, b))) | (segment_count(grid1, a) == segment_count(grid2, b))
        return F.coalesce(same, F.lit(False)) & (b < F.least(F.size(lower), F.lit(most + 1)))

    return _let(last, lambda a: F.when(a.isNull(), False).otherwise(_let(head, lambda b: compare(a, b))))


def fits_below(upper: Column, lower: Column, grid1: Column | None = None, grid2: Column | None = None, shared: Column | None = None) -> Column:
    """Whether a table can go on in another by structure: as many columns in all, or rows that meet. The grids and shared_header are given where they are known."""
    both = F.struct((grid(upper) if grid1 is None else grid1).alias("a"), (grid(lower) if grid2 is None else grid2).alias("b"))
    return _let(both, lambda g: (width(g["a"]) == width(g["b"])) | rows_meet(upper, lower, g["a"], g["b"], shared=shared))


def widened(rows: Column, of: Column, begin: Column, end: Column, model: Column, target: Column) -> Column:
    """rows with those from begin on, before end, made as wide as target where they are narrower.

    A row with as many cells as the model row, and its colspans, takes the model's spans (array of struct(colspan, wanted)); in others the last cell grows.
    """
    known = F.struct(rows.alias("rows"), of.alias("of"), begin.alias("begin"), end.alias("end"), model.alias("model"), target.alias("target"))
    return _let(known, lambda s: _widened(*(s[k] for k in ("rows", "of", "begin", "end", "model", "target"))))


def _widened(rows: Column, of: Column, begin: Column, end: Column, model: Column, target: Column) -> Column:
    def fit(row: Column, i: Column) -> Column:
        narrow = (i >= begin) & (i < end) & (F.size(row) > 0) & (F.size(F.get(of, i)) < target) & (row_columns(row) < target)
        alike = F.transform(row, lambda c: c["colspan"]) == F.transform(model, lambda m: m["colspan"])
        spread = F.transform(row, lambda c, k: F.struct(c["text"].alias("text"), F.when(F.get(model, k)["wanted"] > 1, F.get(model, k)["wanted"]).otherwise(c["colspan"]).alias("colspan"), c["rowspan"].alias("rowspan")))
        grown = F.transform(row, lambda c, k: F.struct(c["text"].alias("text"), (c["colspan"] + F.when(k == F.size(row) - 1, target - F.size(F.get(of, i))).otherwise(0)).alias("colspan"), c["rowspan"].alias("rowspan")))
        return F.when(~narrow, row).when(alike, spread).otherwise(grown)

    return F.transform(rows, fit)


_SPAN = re.compile(r"span=[\"']?([0-9]+)")


def cells_of_tokens(tokens: list[str | None]) -> list[list[tuple[int | None, int | None]]]:
    """Rows of (colspan, rowspan)."""
    rows, inside, colspan, rowspan = [], False, 1, 1

    def number(token: str) -> int | None:
        found = _SPAN.search(token)
        return int(found[1]) if found and int(found[1]) < 1 << 31 else None

    for t in tokens:
        t = t or ""
        closes = inside and t.startswith(">")
        if t == "<tr>":
            rows.append([])
        elif t == "<td></td>" or closes:
            if not rows:
                rows.append([])
            rows[-1].append((colspan, rowspan) if closes else (1, 1))
        if closes or t.startswith("<td") and t != "<td></td>":
            inside, colspan, rowspan = not closes, 1, 1
        elif inside and "span=" in t:
            colspan, rowspan = number(t) if "colspan=" in t else colspan, number(t) if "rowspan=" in t else rowspan
    return rows


def rows_of_tokens(tokens: Column) -> Column:
    """Rows of cells from the tokens of a recognised table structure: <tr>, <td></td>, and <td with its spans up to >."""

    def some(values: pa.Array) -> pa.Array:
        tables = [None if v is None else cells_of_tokens(v) for v in values.to_pylist()]
        cells = [c for t in tables for row in t or () for c in row]
        made = [pa.array([""] * len(cells), pa.string()), *(pa.array([c[k] for c in cells], pa.int32()) for k in (0, 1))]
        return _nested(tables, pa.StructArray.from_arrays(made, ["text", "colspan", "rowspan"]))

    @arrow_udf(ROWS)
    def of_batch(values: pa.Array) -> pa.Array:
        return by_slices(values, some)

    return of_batch(tokens)


def logic_points(rows: Column) -> Column:
    """array<array<int>>: first and last row, first and last column of each cell, in order."""
    def points(table: Column) -> Column:
        def of_row(row: Column, i: Column) -> Column:
            point = lambda c, at: F.array(i, i + c["rowspan"] - 1, at, at + c["colspan"] - 1)
            return F.zip_with(row, first_columns(table["of"], i), point)

        return F.flatten(F.transform(table["rows"], of_row))

    return _let(F.struct(rows.alias("rows"), grid(rows).alias("of")), points)


def filled_structure(tokens: Column, texts: Column) -> Column:
    """The HTML of recognised tokens with each cell's text (texts: array of strings by cell, null for none); heads and bodies are left out."""
    def made(table: Column, ends: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            text = F.coalesce(F.get(table["texts"], (F.array_position(ends, i) - 1).cast("int")), F.lit(""))
            return F.when(~t.contains("</td>"), t).when(t == "<td></td>", F.concat(F.lit("<td>"), text, F.lit("</td>"))).otherwise(F.concat(text, t))

        return F.transform(table["tokens"], one)

    ends = lambda table: F.array_compact(F.transform(table["tokens"], lambda t, i: F.when(t.contains("</td>"), i)))
    filled = _let(F.struct(tokens.alias("tokens"), texts.alias("texts")), lambda table: _let(ends(table), lambda e: made(table, e)))
    return F.array_join(F.filter(filled, lambda t: ~t.isin("<thead>", "</thead>", "<tbody>", "</tbody>")), "")


def joined_cell(contents: Column) -> Column:
    """The texts matched to one cell as its text: of several, each loses a leading blank and bold marks and gets a blank behind it where it lacks one."""
    def one(x: Column, i: Column) -> Column:
        plain = F.regexp_replace(x, r"\A ", "")
        plain = F.when(plain.contains("<b>"), F.substring(plain, 4, 1 << 30)).otherwise(plain)
        plain = F.when(plain.contains("</b>"), F.substring(plain, F.lit(1), F.length(plain) - 4)).otherwise(plain)
        return F.when((plain != "") & (i < F.size(contents) - 1) & ~plain.endswith(" "), F.concat(plain, F.lit(" "))).otherwise(plain)

    several = F.array_join(F.transform(contents, one), "")
    return F.when(F.size(contents) > 1, F.when(F.get(contents, F.lit(0)) == "<b>", F.concat(F.lit("<b>"), several, F.lit("</b>"))).otherwise(several)).otherwise(F.get(contents, F.lit(0)))


def without_subsets(tables: DataFrame, keys: tuple[str, ...] = ("sheet",), table: str = "table_id") -> DataFrame:
    """keys, table of the tables whose filled cells are no strict part of another table's on the sheet. tables: keys, table, r, c of each filled cell.

    A table that holds all cells of another shares each of them, so only tables that share a cell are compared, by counts.
    """
    cells = tables.select(*keys, table, "r", "c").distinct()
    sizes = cells.groupBy(*keys, table).agg(F.count("*").alias("n"))
    other = cells.withColumnRenamed(table, "_other")
    shared = cells.join(other, [*keys, "r", "c"]).where(F.col(table) != F.col("_other")).groupBy(*keys, table, "_other").agg(F.count("*").alias("shared"))
    inside = shared.join(sizes, [*keys, table]).where("shared = n").join(sizes.withColumnsRenamed({table: "_other", "n": "_n"}), [*keys, "_other"]).where("_n > n")
    return sizes.select(*keys, table).join(inside.select(*keys, table).distinct(), [*keys, table], "left_anti")
