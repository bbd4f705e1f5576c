"""Paragraphs as Markdown, in expressions over nested arrays.

A paragraph's lines are array<struct<spans:array<struct<type,content>>, is_list_start_line>>. A page or a document is one row, so
rendering needs no shuffle; only blocks that arrive as rows are gathered, by document.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import text as t

SPAN = "struct<type:string,content:string>"
LINE = f"struct<spans:array<{SPAN}>,is_list_start_line:boolean>"

INLINE, DISPLAY = ("$", "$"), ("$$", "$$")


def lines_of_text(lines: Column) -> Column:
    """array<string> as lines of one text span each."""
    return F.transform(lines, lambda x: F.struct(F.array(F.struct(F.lit("text").alias("type"), x.alias("content"))).alias("spans"), F.lit(False).alias("is_list_start_line")))


def _rendered(span: Column, escape: bool) -> Column:
    content = F.coalesce(span["content"], F.lit(""))
    plain = t.half_width_letters(content)
    kind = span["type"]
    body = F.when(kind == "text", t.escape_markdown(plain) if escape else plain)
    body = body.when((kind == "inline_equation") & (content != ""), F.concat(F.lit(INLINE[0]), content, F.lit(INLINE[1])))
    body = body.when((kind == "interline_equation") & (content != ""), F.concat(F.lit(f"\n{DISPLAY[0]}\n"), content, F.lit(f"\n{DISPLAY[1]}\n")))
    return t.strip(F.coalesce(body, F.lit("")))


def _opens_lower(line: Column) -> Column:
    """The line begins with a text span that begins with a lower-case letter."""
    span = F.get(line["spans"], F.lit(0))
    first = t.half_width_letters(F.substring(F.coalesce(span["content"], F.lit("")), 1, 1))
    return F.coalesce((span["type"] == "text") & first.rlike(r"^\p{Ll}"), F.lit(False))


def _bound(value: Column, body) -> Column:
    """body(value) with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def paragraph(lines: Column, cjk: Column, escape: bool = True, list_break: str = "  \n") -> Column:
    """The text of a paragraph.

    Western spans are followed by a space, unless a hyphen ends the line; the hyphen goes where the next line begins with a
    lower-case letter. In CJK text only inline formulas and spans inside a line are followed by one. Displayed formulas are never.
    """
    # Bound, so that neither is worked out again for every span.
    return _bound(lines, lambda known: _bound(cjk, lambda is_cjk: _paragraph(known, is_cjk, escape, list_break)))


def _paragraph(lines: Column, cjk: Column, escape: bool, list_break: str) -> Column:
    def span_part(span: Column, last: Column, lower: Column) -> Column:
        def joined(body: Column) -> Column:
            kind = span["type"]
            hyphen = last & (kind == "text") & t.ends_with_hyphen(F.substring(body, -2, 2))  # no white space stands at its end
            western = F.when(hyphen & lower, F.substring(body, F.lit(1), F.length(body) - 1)).when(hyphen, body).otherwise(F.concat(body, F.lit(" ")))
            eastern = F.when(last & (kind != "inline_equation"), body).otherwise(F.concat(body, F.lit(" ")))
            return F.when(body == "", F.lit("")).when(kind == "interline_equation", body).when(cjk, eastern).otherwise(western)

        return _bound(_rendered(span, escape), joined)

    def line_part(line: Column, i: Column) -> Column:
        mark = F.when((i >= 1) & F.coalesce(line["is_list_start_line"], F.lit(False)), F.lit(list_break)).otherwise(F.lit(""))
        lower = _opens_lower(F.get(lines, i + 1))
        spans = F.transform(line["spans"], lambda s, j: span_part(s, j == F.size(line["spans"]) - 1, lower))
        return F.concat(mark, F.array_join(spans, ""))

    return F.rtrim(F.array_join(F.transform(lines, line_part), ""), F.lit(t.WHITE))


def title(text: Column, level: Column) -> Column:
    """# marks by level (none below 1)."""
    return F.concat(F.repeat(F.lit("#"), F.greatest(level, F.lit(0))), F.lit(" "), text)


def text_block(text: Column) -> Column:
    return t.escape_prefix(text)


def fenced(code: Column, language: Column) -> Column:
    lines = F.transform(F.split(code, "\n", -1), lambda x: F.regexp_replace(x, r"(?U:\s)+$", ""))
    return F.when(code == "", F.lit("")).otherwise(F.concat(F.lit("```"), F.coalesce(F.nullif(language, F.lit("")), F.lit("txt")), F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n```")))


def separator(before: Column, after: Column) -> Column:
    """Between two segments of a figure or table, by kind: html, details or a line."""
    return F.when(before == "html_block", "\n\n").when(before == "details_block", "\n\n").when(after == "html_block", "\n").otherwise("  \n")


def segments(parts: Column) -> Column:
    """array<struct<text,kind>> as one text; empty ones are passed over."""
    some = F.filter(parts, lambda p: F.coalesce(p["text"], F.lit("")) != "")
    start = F.struct(F.lit("").alias("text"), F.lit(None).cast("string").alias("kind"))
    join = lambda s, p: F.struct(F.when(s["kind"].isNull(), p["text"]).otherwise(F.concat(s["text"], separator(s["kind"], p["kind"]), p["text"])).alias("text"), p["kind"].alias("kind"))
    return F.aggregate(some, start, join, lambda s: s["text"])


def page_markdown(blocks: Column) -> Column:
    """array<string> as a page or document: blank blocks go, the others stand a blank line apart."""
    return F.array_join(F.filter(F.transform(blocks, t.strip), lambda b: b != ""), "\n\n")
