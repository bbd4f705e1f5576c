"""String functions of the document engine as column expressions.

Java's `\\s` is ASCII, so white space is matched with `(?U)`. No function changes a null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points and characters that the results depend on.
HYPHENS = "-\u00ad\u2010\u2011\u2043"
LIGATURES = (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "ft"), ("ﬆ", "st"))
MARKDOWN_SPECIALS = "*_`~$"
WIDE_FIRST, WIDE_LAST, WIDE_SHIFT = 0xFF01, 0xFF5E, 0xFEE0
#: What (?U:\s) matches.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ends_with_hyphen(text: Column) -> Column:
    """Ends with letters and a hyphen that breaks a word (white space may follow)."""
    return text.rlike(r"[A-Za-z][-\u00ad\u2010\u2011\u2043](?U:\s)*$")


def without_line_hyphen(text: Column) -> Column:
    """The text without the hyphen and white space at its end."""
    return F.regexp_replace(text, r"[-\u00ad\u2010\u2011\u2043](?U:\s)*$", "")


def _narrow(text: Column, codes) -> Column:
    wide = "".join(map(chr, codes))
    # Most texts have no such character, and to look for one costs far less than to translate.
    return _let(text, lambda t: F.when(t.rlike(f"[{chr(WIDE_FIRST)}-{chr(WIDE_LAST)}]"), F.translate(t, wide, "".join(chr(c - WIDE_SHIFT) for c in codes))).otherwise(t))


def half_width(text: Column) -> Column:
    """Full-width characters as their ASCII counterparts."""
    return _narrow(text, range(WIDE_FIRST, WIDE_LAST + 1))


def half_width_letters(text: Column) -> Column:
    """The same for letters and digits alone; marks stay wide."""
    return _narrow(text, [c for c in range(WIDE_FIRST, WIDE_LAST + 1) if chr(c - WIDE_SHIFT).isalnum()])


def expand_ligatures(text: Column) -> Column:
    for one, letters in LIGATURES:
        text = F.replace(text, F.lit(one), F.lit(letters))
    return text


def fix_controls(text: Column) -> Column:
    """CR LF pairs go, U+0002 is a hyphen."""
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("")), F.lit("\x02"), F.lit("-"))


def drop_surrogates(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x{D800}-\x{DFFF}]", "")


def escape_markdown(text: Column) -> Column:
    """A backslash before each * _ ` ~ $ that has an even number of backslashes before it."""
    return _let(text, lambda t: F.when(t.rlike("[*_`~$]"), F.regexp_replace(t, r"(?<!\\)((?:\\\\)*)([*_`~$])", r"$1\\$2")).otherwise(t))


def escape_prefix(text: Column) -> Column:
    """A backslash before a heading or list mark that opens the text."""
    return F.regexp_replace(text, r"^([ \t]{0,3})(#{1,6}|[+-])(?=[ \t])", r"$1\\$2")


def escape_html(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def unescape_html(text: Column) -> Column:
    for entity, raw in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(raw))
    return text


def strip(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.btrim(text, F.lit(WHITE))


def no_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U:\s)+", "")


_CJK = r"\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af"


def cjk_share(text: Column) -> Column:
    """Share of CJK, kana and hangul among letters; 0 without letters."""
    without = lambda some: F.length(F.regexp_replace(text, some, ""))
    # Counted by what goes with them: the class of all other characters is slow to match.
    return F.when(text.rlike(f"[{_CJK}]"), F.coalesce(F.try_divide(F.length(text) - without(f"[{_CJK}]+"), without(r"\P{L}+")), F.lit(0.0))).otherwise(0.0)


def is_cjk(text: Column, share: float = 0.3) -> Column:
    """Whether text is Chinese, Japanese or Korean, by script. Other languages are told apart nowhere in the engine."""
    return cjk_share(text) >= share


# -- formulas and code ------------------------------------------------------------------------


def bare_formula(text: Column) -> Column:
    r"""Without an outer \[ \]."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"^\\\[", ""), r"\\\]$", ""))


def bare_code(text: Column) -> Column:
    """Without the lines of a fence of three backticks."""
    lines = F.split(text, "\n", -1)
    opened = F.get(lines, F.lit(0)).startswith("```")
    closed = F.element_at(lines, -1) == "```"
    first = F.when(opened, 2).otherwise(1)
    count = F.greatest(F.size(lines) - F.when(opened, 1).otherwise(0) - F.when(closed, 1).otherwise(0), F.lit(0))
    return F.when(opened | closed, strip(F.array_join(F.slice(lines, first, count), "\n"))).otherwise(text)


def plain_brackets(text: Column) -> Column:
    r"""\[x\] becomes [x] where such brackets are balanced."""
    count = lambda mark: F.regexp_count(text, F.lit(mark))
    balanced = (count(r"\\\[") > 0) & (count(r"\\\[") == count(r"\\\]"))
    return F.when(balanced, F.regexp_replace(text, r"(?s)\\\[(.*?)\\\]", "[$1]")).otherwise(text)


def formula_tag(text: Column) -> Column:
    """The number in a formula's tag: half width, without one pair of outer brackets."""
    plain = strip(half_width(text))
    return F.when(plain.rlike(r"(?s)^\(.*\)$"), strip(F.regexp_replace(plain, r"(?s)^\((.*)\)$", "$1"))).otherwise(plain)


def tagged_formula(formula: Column, number: Column) -> Column:
    r"""formula\tag{number}; null without a formula."""
    body = bare_formula(F.coalesce(formula, F.lit("")))
    return F.when(body != "", F.concat(body, F.lit("\\tag{"), formula_tag(F.coalesce(number, F.lit(""))), F.lit("}")))


# -- tables and links -------------------------------------------------------------------------


def with_image_prefix(html: Column, folder: str) -> Column:
    """Every src that is no data URI, in folder."""
    return F.regexp_replace(html, r'src="(?!data:)([^"]+)"', f'src="{folder}/$1"') if folder else html


def equations_in_table(html: Column, left: str = "$", right: str = "$") -> Column:
    """<eq>x</eq> as inline formulas."""
    mark = lambda d: d.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(html, r"(?s)<eq>(.*?)</eq>", f" {mark(left)}$1{mark(right)} ")


def details_block(content: Column, summary: Column) -> Column:
    return F.concat(F.lit("<details>\n<summary>"), summary, F.lit("</summary>\n\n"), content, F.lit("\n</details>"))


def is_page_token(text: Column) -> Column:
    """A page number at the end of an entry: digits, Roman numerals or a single letter, twelve characters at most."""
    return (F.length(text) <= 12) & text.rlike(r"^(\d+|[ivxlcdmIVXLCDM]+|[A-Za-z])$")


def image_name(kind: Column, page_md5: Column, page: Column, box: Column) -> Column:
    """The file name of a crop."""
    place = F.concat_ws("_", page.cast("string"), F.transform(box, lambda v: v.cast("string")))
    return F.concat(F.sha2(F.concat(kind, F.lit("/"), page_md5, F.lit("_"), place), 256), F.lit(".jpg"))


# -- places -----------------------------------------------------------------------------------


def bucket_and_key(path: Column) -> Column:
    """struct(bucket, key) of an s3:// or s3a:// path; anything else is an error."""
    bad = ~path.rlike(r"^s3a?://[^/]+/.+")
    part = lambda i: F.regexp_extract(path, r"^s3a?://([^/]+)/(.+)$", i)
    return F.when(bad, F.raise_error(F.concat(F.lit("no bucket and key in "), path)).cast("struct<bucket:string,key:string>")).otherwise(F.struct(part(1).alias("bucket"), part(2).alias("key")))


def without_arguments(path: Column) -> Column:
    return F.substring_index(path, "?", 1)


def byte_range(path: Column) -> Column:
    """array(offset, length) of ?bytes=a,b, else null."""
    found = F.regexp_extract(path, r"\?bytes=(-?\d+),(-?\d+)", 0) != ""
    part = lambda i: F.regexp_extract(path, r"\?bytes=(-?\d+),(-?\d+)", i).cast("long")
    return F.when(found, F.array(part(1), part(2)))


def column_number(letters: Column) -> Column:
    """A..XFD as 1..16384."""
    return F.aggregate(F.split(letters, ""), F.lit(0), lambda n, c: n * 26 + F.ascii(c) - 64)


def column_letters(number: Column) -> Column:
    """1.. as A, B, .. Z, AA, .. XFD (three letters at most)."""
    n = number - 1
    letter = lambda v: F.chr((v % 26 + 65).cast("long"))
    two, three = F.expr("0") + F.floor(n / 26) - 1, F.floor((F.floor(n / 26) - 1) / 26) - 1
    return F.concat(F.when(n >= 702, letter(three)).otherwise(""), F.when(n >= 26, letter(two)).otherwise(""), letter(n))


def excel_date(serial: Column, date_1904: Column | bool = False) -> Column:
    """An Excel serial number as ISO text: a date, or date and time to the second where there is a fraction; null if not finite."""
    old = F.lit(date_1904) if isinstance(date_1904, bool) else date_1904
    days = F.floor(serial)
    seconds = F.round((serial - days) * 86400).cast("long")
    start = F.when(old, F.lit("1904-01-01").cast("date")).otherwise(F.lit("1899-12-30").cast("date"))
    day = F.date_add(start, days.cast("int"))
    moment = F.timestamp_seconds(F.unix_date(day).cast("long") * 86400 + seconds)
    finite = ~F.isnan(serial) & (F.abs(serial) < 1e7)
    return F.when(finite, F.when(seconds == 0, F.date_format(day, "yyyy-MM-dd")).otherwise(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")))
