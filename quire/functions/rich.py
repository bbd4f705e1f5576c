"""Texts of Office documents and captions: continuation marks, links, styles, section numbers, cell values, ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import column_number, escape_html, excel_date, half_width, is_page_token, strip
from quire.operators.sequence import islands

# What the caption of a continued table ends with, in half width and lower case.
CONTINUED = ("(续)", "(续表)", "(续上表)", "(continued)", "(cont.)", "(cont’d)", "(…continued)", "continued", "续表")
# Fixed value: what it may hold anywhere.
CONTINUED_INSIDE = "(continued)"
# Cells that recognition reads wrong, and the sign behind a single digit.
MISREAD = {"香": "否", "哦樂": "哦"}
NUMBER_SIGN = "號"


def is_continuation(text: Column) -> Column:
    """Whether a text is the caption of a table that goes on; the bare word counts where no letter stands before it."""
    plain = F.lower(half_width(strip(F.coalesce(text, F.lit("")))))
    marked = F.lit(False)
    for m in CONTINUED:
        at_end = plain.endswith(m)
        marked = marked | (at_end & ~plain.rlike(r"\p{L}continued$") if m == "continued" else at_end)
    return (plain != "") & (marked | plain.contains(CONTINUED_INSIDE))


def is_link(target: Column) -> Column:
    """A target that is neither missing, blank nor a lone dot."""
    return F.coalesce((strip(target) != "") & (target != "."), F.lit(False))


def style_names(**flags: Column) -> Column:
    """The names of the flags that are set, in the order given, comma-joined; null where none is."""
    names = F.array_compact(F.array(*[F.when(F.coalesce(on, F.lit(False)), name) for name, on in flags.items()]))
    return F.when(F.size(names) > 0, F.array_join(names, ","))


def tagged_text(text: Column, target: Column, style: Column) -> Column:
    """text with its style as a tag, and with its link around both; an empty text as it is."""
    has_style = F.coalesce(style, F.lit("")) != ""
    plain = F.when(has_style, F.concat(F.lit('<text style="'), style, F.lit('">'), text, F.lit("</text>")))
    linked = F.concat(F.lit("<hyperlink>"), F.coalesce(plain, F.concat(F.lit("<text>"), text, F.lit("</text>"))), F.lit("<url>"), target, F.lit("</url></hyperlink>"))
    return F.when(F.coalesce(text, F.lit("")) == "", text).when(is_link(target), linked).otherwise(F.coalesce(plain, text))


def section_parts(text: Column, level: Column) -> Column:
    """The numbers of a leading 1.2.3 where there are as many as the level; else null."""
    found = F.regexp_extract(strip(text), r"^(\d+(?:\.\d+)*)", 1)
    parts = F.transform(F.split(found, r"\."), lambda x: x.cast("int"))
    return F.when((found != "") & (F.size(parts) == level), parts)


def contents_level(level: Column, text: Column) -> Column:
    """The level of an entry of a table of contents: no deeper than its number of several parts says."""
    number = F.regexp_extract(strip(text), r"^(\d+(?:\.\d+)+)(?![\d.])", 1)
    depth = F.size(F.split(number, r"\.")) - 1
    return F.when((level != 0) & (number != "") & (depth < level), depth).otherwise(level)


def without_page_tail(spans: Column) -> Column:
    """spans (array of struct(content, formula)) of an entry: the page number behind the last tab goes, other tabs are blanks; formulas stay."""
    tabbed = F.transform(spans, lambda s, i: F.when(~s["formula"] & s["content"].contains("\t"), i))
    last = F.array_max(tabbed)
    tail = lambda x: F.substring_index(x, "\t", -1)
    head = lambda x: F.regexp_replace(x, "(?s)\t[^\t]*\\z", "")

    def one(s: Column, i: Column) -> Column:
        cut = F.coalesce(i == last, F.lit(False)) & is_page_token(tail(s["content"]))
        text = F.regexp_replace(F.when(cut, head(s["content"])).otherwise(s["content"]), "\t", " ")
        return F.struct(F.when(s["formula"], s["content"]).otherwise(text).alias("content"), s["formula"].alias("formula"))

    return F.transform(spans, one)


def positive_setting(value: Column, default: int) -> Column:
    """A setting as a whole number above zero, else the default."""
    number = strip(value).try_cast("int")
    return F.when(number > 0, number).otherwise(default)


def cell_text(value: Column, is_date: Column, date_1904: Column | bool = False) -> Column:
    """A number of a sheet as text: a date where it is meant as one, else whole numbers without a fraction."""
    whole = value == F.floor(value)
    number = F.when(whole, F.floor(value).cast("long").cast("string")).otherwise(value.cast("string"))
    return F.when(value.isNull(), "").when(is_date, F.coalesce(excel_date(value, date_1904), number)).otherwise(number)


def cell_range(formula: Column) -> Column:
    """struct(sheet, min_col, min_row, max_col, max_row) of a reference such as =Sheet!$A$1:$B$2; null if it is none."""
    pattern = r"^=?(?:'((?:[^']|'')+)'|([^'!]+))!\$?([A-Za-z]{1,3})\$?(\d+)(?::\$?([A-Za-z]{1,3})\$?(\d+))?$"
    plain = strip(formula)
    part = lambda i: F.regexp_extract(plain, pattern, i)
    or_first = lambda i: F.when(part(i) != "", part(i)).otherwise(part(i - 2))
    sheet = F.when(part(1) != "", F.replace(part(1), F.lit("''"), F.lit("'"))).otherwise(part(2))
    number = lambda x: column_number(F.upper(x)).cast("int")
    found = F.struct(sheet.alias("sheet"), number(part(3)).alias("min_col"), part(4).try_cast("int").alias("min_row"), number(or_first(5)).alias("max_col"), or_first(6).try_cast("int").alias("max_row"))
    return F.when(plain.rlike(pattern), found)


def table_of_columns(headers: Column, columns: Column, rows: Column) -> Column:
    """An HTML table of columns (arrays of texts) under headers; short columns end in empty cells. Nothing without rows or where the numbers differ."""
    head = F.array_join(F.transform(headers, lambda h: F.concat(F.lit("<th>"), escape_html(h), F.lit("</th>"))), "")
    cell = lambda c, i: F.concat(F.lit("<td>"), escape_html(F.coalesce(F.get(c, i), F.lit(""))), F.lit("</td>"))
    line = lambda i: F.concat(F.lit("<tr>"), F.array_join(F.transform(columns, lambda c: cell(c, i)), ""), F.lit("</tr>"))
    body = F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(rows - 1, F.lit(0))), line), "")
    table = F.concat(F.lit("<table><thead><tr>"), head, F.lit("</tr></thead><tbody>"), body, F.lit("</tbody></table>"))
    return F.when((rows > 0) & (F.size(headers) == F.size(columns)), table).otherwise("")


def needs_space(before: Column, after: Column, wrapped: Column, kind: Column) -> Column:
    """Whether a blank has to keep Markdown marks apart: the part before is wrapped and ends in punctuation, the next begins with text."""
    ends, begins = before.rlike(r"(?s)[\p{P}\p{S}]\z"), after.rlike(r"(?s)\A[^\p{P}\p{S}\s]")
    return wrapped & ~kind.isin("hyperlink", "inline_equation", "interline_equation") & ends & begins


def formula_number(content: Column, spans: Column) -> Column:
    """The number of a formula: the block's own content, else its text spans (array of struct(type, content)) joined."""
    own = strip(F.coalesce(content, F.lit("")))
    texts = F.transform(F.filter(spans, lambda s: s["type"] == "text"), lambda s: F.coalesce(s["content"], F.lit("")))
    return F.when(own != "", own).otherwise(strip(F.array_join(texts, "")))


def recognised_cell(text: Column) -> Column:
    """A recognised cell with known misreadings put right; only whole cells count."""
    out = F.regexp_replace(text, rf"\A([0-9]){NUMBER_SIGN}\z", "$1")
    for wrong, right in MISREAD.items():
        out = F.when(text == wrong, right).otherwise(out)
    return out


def map_md5(values: Column) -> Column:
    """md5 of a map of texts as JSON: keys in order, a blank behind colons and commas."""
    quoted = lambda x: F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1)
    entries = F.transform(F.array_sort(F.map_entries(values)), lambda e: F.concat(quoted(e["key"]), F.lit(": "), quoted(e["value"])))
    return F.md5(F.encode(F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}")), "utf-8"))


def script_runs(chars: DataFrame, keys: tuple[str, ...] = ("line_id",), order: str = "char_idx") -> DataFrame:
    """keys, text: the characters of a line joined, runs of raised or lowered ones (role sup or sub) in tags."""
    spec = Window.partitionBy(*keys).orderBy(order)
    before = F.lag("role").over(spec)
    runs = chars.withColumn("_run", islands(before.isNull() | (before != F.col("role")), spec))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "char"))), lambda x: x["char"]), "")
    runs = runs.groupBy(*keys, "_run").agg(F.first("role").alias("role"), text.alias("text"))
    tag = F.when(F.col("role").isin("sup", "sub") & (F.col("text") != ""), F.concat(F.lit("<"), F.col("role"), F.lit(">"), F.col("text"), F.lit("</"), F.col("role"), F.lit(">"))).otherwise(F.col("text"))
    parts = F.array_sort(F.collect_list(F.struct("_run", tag.alias("tag"))))
    return runs.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["tag"]), "").alias("text"))
