"""Secret scans (native): three patterns, and sliding-window entropy over other long strings.

Patterns give spans by summing the lengths of what lies between matches. For entropy, a
candidate is a run of one character class (hexadecimal, or base64 with - and _) of at least one window
that contains letters and digits; a fold over its characters keeps a count for each
symbol, twelve counts packed in a long, and the sum of c*log2(c), adding the entering and taking off the leaving character,
so that each window costs one update of two counts. Every run of windows above the class's threshold becomes a
span unless the allow-list knows the string or a pattern's span meets it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm._common import documents, text_or_empty

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: (characters of the class, bits that a window must reach). 20 symbols have log2(20) = 4.32 bits at most.
CLASSES = ((r"A-Fa-f0-9", 3.0), (r"A-Za-z0-9+/_-", 3.75))
#: Strings that look random but are known, each as a whole: digits only, words with separators, dates and versions, one character again and
#: again, alphabets in order, sample keys that say so at their end.
ALLOW = (r"^[0-9_/+-]*$", r"^[A-Za-z]+([-_/+][A-Za-z]+)*$", r"^([A-Za-z]+|[0-9]{1,4})([-_/+]([A-Za-z]+|[0-9]{1,4}))*$", r"^[A-Za-z0-9/+_-]*EXAMPLE(KEY)?$", r"^(.)\1*$", r"^(0123456789|abcdef|ABCDEF)+$")
#: The symbols of both classes, and how many counts of at most WINDOW + 1 share a long.
SYMBOLS, PACKED = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_-", 12
#: Matches of one text that are placed together, so that a text with very many costs little more for each.
PLACED = 256


def _found(text: Column, pattern: str, kind: int) -> Column:
    """Spans (start, kind, end, match) of all matches."""
    between, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    each = F.zip_with(between, F.concat(matches, F.array(F.lit(""))), lambda a, b: F.struct(F.length(a).alias("gap"), F.length(b).alias("size"), b.alias("match")))
    return F.flatten(_let(each, lambda xs: F.transform(_chunks(xs), lambda c: _placed(c["items"], c["at"], kind))))


def _chunks(each: Column) -> Column:
    """array<struct<at, items>>: PLACED items each, and the length of all before them."""
    number = F.ceil(F.size(each) / PLACED).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.greatest(number - 1, F.lit(0))), lambda k: F.slice(each, k * PLACED + 1, F.lit(PLACED)))
    length = lambda part: F.aggregate(part, F.lit(0), lambda n, x: n + x["gap"] + x["size"])
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    begins = lambda ps: F.aggregate(ps, zero, lambda s, p: F.struct((s["at"] + length(p)).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])
    return _let(parts, lambda ps: F.zip_with(begins(ps), ps, lambda at, items: F.struct(at.alias("at"), items.alias("items"))))


def _placed(items: Column, at: Column, kind: int) -> Column:
    none = F.array().cast("array<struct<start:int,kind:int,end:int,match:string>>")

    def step(state, x):
        start = state["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + x["size"]).alias("end"), x["match"].alias("match"))
        return F.struct((start + x["size"]).alias("at"), F.when(x["size"] > 0, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    return F.aggregate(items, F.struct(at.alias("at"), none.alias("out")), step, lambda s: s["out"])


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))


_NONE = "array<struct<start:int,kind:int,end:int>>"


def base_spans(text: Column) -> list[Column]:
    """Spans of the three patterns, each in order."""
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2))
    none = F.array().cast(_NONE)
    assign = _plain(F.filter(_found(text, ASSIGN, 0), lambda x: value(x["match"]) >= 6))
    access = _plain(F.filter(_found(text, ACCESS, 1), lambda x: x["end"] - x["start"] >= 20))
    # Runs are maximal, so asking for the length in the pattern finds the same spans.
    hexes = _plain(_found(text, r"[0-9a-f]{24,}", 2))
    gate = lambda pattern, spans: F.when(F.rlike(text, F.lit(pattern)), spans).otherwise(none)
    return [gate(ASSIGN, assign), F.when(F.contains(text, F.lit("AKIA")), access).otherwise(none), gate(r"[0-9a-f]{24,}", hexes)]


def hot_runs(string: Column, bits: float, window: int = WINDOW) -> Column:
    """array<struct<first, last>>: the runs of characters that windows of at least `bits` of Shannon entropy cover."""
    table = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    most = window * (math.log2(window) - bits) + 1e-9  # sum of c*log2(c) must not be above this
    width = 60 // PACKED
    lanes = -(-len(SYMBOLS) // PACKED)
    number = F.array(*[F.lit(max(SYMBOLS.find(chr(c)), 0)) for c in range(128)])
    codes = F.transform(F.split(string, ""), lambda c: F.get(number, F.ascii(c)))
    shift = lambda code: (code % PACKED) * width
    lane = lambda s, code: _choose([s[f"c{k}"] for k in range(lanes)], F.floor(code / PACKED))
    count = lambda s, code: F.call_function("shiftright", lane(s, code), shift(code)).bitwiseAND(F.lit((1 << width) - 1)).cast("int")
    fields = lambda s, code, by: [(s[f"c{k}"] + F.when(F.floor(code / PACKED) == k, F.call_function("shiftleft", F.lit(1).cast("long"), shift(code)) * by).otherwise(F.lit(0).cast("long"))).alias(f"c{k}") for k in range(lanes)]
    runs = "array<struct<first:int,last:int>>"
    zero = F.struct(*[F.lit(0).cast("long").alias(f"c{k}") for k in range(lanes)], F.lit(0.0).alias("sum"), F.array().cast(runs).alias("runs"), F.lit(0).alias("i"))

    def add(s, code):
        c = count(s, code)
        return F.struct(*fields(s, code, 1), (s["sum"] + F.get(table, c + 1) - F.get(table, c)).alias("sum"), s["runs"].alias("runs"), s["i"].alias("i"))

    def drop(s, all_codes):
        leaving = F.get(all_codes, s["i"] - window)
        c = count(s, leaving)
        gone = F.struct(*fields(s, leaving, -1), (s["sum"] + F.get(table, c - 1) - F.get(table, c)).alias("sum"), s["runs"].alias("runs"), s["i"].alias("i"))
        return F.when(s["i"] >= window, gone).otherwise(s)

    def test(s):
        hot = (s["i"] >= window - 1) & (s["sum"] <= most)
        last = F.try_element_at(s["runs"], F.lit(-1))
        begin = s["i"] - window + 1
        joins = (F.size(s["runs"]) > 0) & (last["last"] >= begin - 1)
        first = F.when(joins, last["first"]).otherwise(begin)
        kept = F.when(joins, F.slice(s["runs"], F.lit(1), F.size(s["runs"]) - 1)).otherwise(s["runs"])
        now = F.concat(kept, F.array(F.struct(first.cast("int").alias("first"), s["i"].alias("last"))))
        return F.struct(*[s[f"c{k}"].alias(f"c{k}") for k in range(lanes)], s["sum"].alias("sum"), F.when(hot, now).otherwise(s["runs"]).alias("runs"), (s["i"] + 1).alias("i"))

    step = lambda all_codes: lambda s, code: _let(_let(add(s, code), lambda t: drop(t, all_codes)), test)
    # The array is bound once, so it isn't split again for every character.
    return _let(codes, lambda all_codes: F.aggregate(all_codes, zero, step(all_codes), lambda s: s["runs"]))


def _choose(options: list[Column], which: Column) -> Column:
    out = options[-1]
    for k in range(len(options) - 2, -1, -1):
        out = F.when(which == k, options[k]).otherwise(out)
    return out


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def entropy_spans(text: Column, base: Column) -> Column:
    spans = None
    for chars, bits in CLASSES:
        pattern = rf"(?<![{chars}])[{chars}]{{{WINDOW},}}"
        known = lambda m: F.lit(False) if not ALLOW else _any([F.rlike(m, F.lit(p)) for p in ALLOW])
        found = F.filter(_found(text, pattern, 3), lambda x: F.rlike(x["match"], F.lit("[0-9]")) & F.rlike(x["match"], F.lit("[A-Za-z]")) & ~known(x["match"]))
        span = lambda x, r: F.struct((x["start"] + r["first"]).alias("start"), F.lit(3).alias("kind"), (x["start"] + r["last"] + 1).alias("end"))
        hot = F.flatten(F.transform(found, lambda x: F.transform(hot_runs(x["match"], bits), lambda r: span(x, r))))
        some = F.when(F.rlike(text, F.lit(pattern)), hot).otherwise(F.array().cast(_NONE))
        apart = _apart(some, base)
        spans = apart if spans is None else F.concat(spans, _apart(apart, spans))
    return spans


def _apart(spans: Column, others: Column) -> Column:
    """The spans that meet none of the others."""
    return F.filter(spans, lambda x: ~F.exists(others, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))


def _any(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out | c
    return out


def _line(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy of every row.

    Offsets are code points, ends exclusive. A null or empty text has no spans (base_sha256 of the empty text). No shuffle:
    rows stay where they are, repeated rows give repeated results. Columns besides doc_id and text are not read.
    """
    text = F.col("text")
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    assign, access, hexes = base_spans(text)
    rows = rows.select("doc_id", "text", assign.alias("a"), access.alias("k"), hexes.alias("h"))
    rows = rows.withColumn("base", F.concat("a", "k", "h"))
    rows = rows.withColumn("e", entropy_spans(text, F.col("base")))
    return rows.select(
        "doc_id", *[F.size(c).cast("long").alias(n) for c, n in (("a", "n_assign"), ("k", "n_access"), ("h", "n_hex"))],
        F.sha2(_line(F.col("base")).cast("binary"), 256).alias("base_sha256"), _line(F.concat("base", "e")).alias("spans"), F.size("e").cast("long").alias("n_entropy"),
    )


def op4(spark, sf_dir):
    return scan_secrets(documents(spark, sf_dir))
