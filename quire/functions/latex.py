r"""Repair of recognised formulas.

Steps read marks of the text (an escape with its character, a brace, or a run of anything else), so that no step looks at a brace or
command behind an odd number of backslashes. Braces and delimiters need a stack, so they are Arrow functions; the other steps are column
expressions. A step names its text more than once, so `repaired` binds the text between steps; else each step would work out all
steps before it several times over.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

# What may stand behind \left and \right.
DELIMITERS = ("(", ")", "[", "]", "{", "}", "/", "|", r"\{", r"\}", r"\lceil", r"\rceil", r"\lfloor", r"\rfloor", r"\backslash", r"\uparrow", r"\downarrow", r"\Uparrow", r"\Downarrow", r"\|", r"\.")
# Environments that may lack an end or a beginning. The names are regular expressions, so the last one means alig and any n.
ENVIRONMENTS = ("array", "matrix", "pmatrix", "bmatrix", "vmatrix", "Bmatrix", "Vmatrix", "cases", "aligned", "gathered", "align", "align*")
# Commands that are dropped.
UNSUPPORTED = ("lefteqn", "boldmath", "ensuremath", "centering", "textsubscript", "sides", "textsl", "textcent", "emph", "protect", "null")
# Names behind \up that stay.
UP_NAMES = ("arrow", "downarrow", "lus", "silon")
# Commands and what they become, in this order.
REPLACED = (
    (r"\underbar", r"\underline"), (r"\Bar", r"\hat"), (r"\Hat", r"\hat"), (r"\Tilde", r"\tilde"), (r"\slash", "/"), (r"\textperthousand", "‰"), (r"\sun", "☉"), (r"\textunderscore", r"\_"), (r"\fint", "⨏"),
    (r"\up ", r"\ "), (r"\vline = ", r"\models "), (r"\vDash ", r"\models "), (r"\sq \sqcup ", r"\square "), (r"\copyright", "©"), (r"\Dot", r"\dot"),
)
#: Characters that may follow a backslash alone.
SPECIAL = "#$%&~_^|\\{} \t\n\r\x0b\f"


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _each_text(f: Callable[[str], str], text: Column) -> Column:
    @arrow_udf("string")
    def of_batch(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f(v) for v in values.to_pylist()], pa.string())

    return of_batch(text)


_MARKS = re.compile(r"(?s)\\.|[{}]")


def balanced(text: str) -> str:
    """Without the braces that have no partner."""
    opened, lone = [], []
    for m in _MARKS.finditer(text):
        if m[0] == "{":
            opened.append(m.start())
        elif m[0] == "}":
            if opened:
                opened.pop()
            else:
                lone.append(m.start())
    if not opened and not lone:
        return text
    ends = [-1, *sorted(lone + opened), len(text)]
    return "".join(text[a + 1 : b] for a, b in zip(ends, ends[1:]))


def balanced_braces(text: Column) -> Column:
    """Without the braces that have no partner."""
    return _each_text(balanced, text)


_KNOWN = "|".join(re.escape(d) for d in DELIMITERS)
#: White space is ASCII here, as in the column expressions.
_UNKNOWN_DELIMITERS = [(re.compile(rf"(?a)\\{c}(?!(?:{_KNOWN})(?!\S))\S*"), rf"\\{c}.") for c in ("left", "right")]
_LEFTS, _RIGHTS, _BOTH = re.compile(r"\\left(?![a-zA-Z])"), re.compile(r"\\right(?![a-zA-Z])"), re.compile(r"\\left\.?|\\right\.?")


def _group_end(text: str, begin: int, depth: int) -> int:
    """Where the group that holds begin closes; -1 if it doesn't. Counting starts from depth."""
    now = depth
    for m in _MARKS.finditer(text, begin):
        if m[0] in "{}":
            now += 1 if m[0] == "{" else -1
            if now < depth:
                return m.start()
    return -1


def paired(text: str) -> str:
    r"""The text with each \right, and the character after it, in the group of its \left."""
    depth, open_lefts, moves = 0, [], []
    marks = re.compile(r"(?s)\\left(?=.)|\\right(?=.)|\\.|[{}]")
    at = 0
    while m := marks.search(text, at):
        at = m.end()
        if m[0] == "\\left":
            open_lefts.append((m.start(), depth))
            at += 1
        elif m[0] == "\\right":
            if open_lefts:
                begin, inside = open_lefts.pop()
                target = _group_end(text, begin, inside) if inside != depth else -1
                if target >= 0:
                    moves.append((m.start(), target))
            at += 1
        elif m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth = max(0, depth - 1)
    for begin, target in reversed(moves):
        part, rest = text[begin : begin + 7], text[:begin] + text[begin + 7 :]
        text = rest[:target] + part + rest[target:]
    return text


def delimited(text: str) -> str:
    r"""Known delimiters behind \left and \right (others become a dot), as many of one as of the other, each pair in one group; all are dropped where numbers differ."""
    for unknown, dot in _UNKNOWN_DELIMITERS:
        text = unknown.sub(dot, text)
    if len(_LEFTS.findall(text)) != len(_RIGHTS.findall(text)):
        return _BOTH.sub("", text)
    return paired(text) if "\\left" in text else text


def matched_delimiters(text: Column) -> Column:
    r"""Known delimiters behind \left and \right, as many of one as of the other, each pair in one group; all are dropped where numbers differ."""
    return _each_text(delimited, text)


def balance_environments(text: Column) -> Column:
    r"""Adds the \begin or \end that an environment lacks, one name after the other; an added \begin takes the column format that one of its name has."""

    def one(name: str):
        begin, shown = rf"\\begin\{{{name}\}}", f"{{{name}}}"
        stem = "{" + name.removesuffix("n*")  # every begin or end of the name holds it

        def fix(t: Column) -> Column:
            lacking = F.regexp_count(t, F.lit(begin)) - F.regexp_count(t, F.lit(rf"\\end\{{{name}\}}"))
            given = F.regexp_extract(t, begin + r"(\{[^}]*\})", 1)
            form = F.when(given != "", given).otherwise("{c}" if name == "array" else "")
            opening = F.concat(F.lit("\\begin" + shown), form, F.lit(" "))
            closing = F.lit(" \\end" + shown)
            whole = _let(lacking, lambda n: F.concat(F.repeat(opening, F.greatest(-n, F.lit(0))), t, F.repeat(closing, F.greatest(n, F.lit(0)))))
            return F.when(t.contains(stem), whole).otherwise(t)

        return fix

    out = text
    for name in ENVIRONMENTS:
        out = _let(out, one(name))
    return F.when(text.rlike(r"\\(begin|end)\{"), out).otherwise(text)


def plain_greek(text: Column) -> Column:
    r"""\upX as \X, but for the names that begin with up themselves."""
    return F.regexp_replace(text, rf"\\up(?!(?:{'|'.join(UP_NAMES)})(?![a-zA-Z]))([a-zA-Z]+)", r"\\$1")


def without_unsupported(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\(?:{'|'.join(UNSUPPORTED)})", "")


def replaced_commands(text: Column) -> Column:
    for command, other in REPLACED:
        text = F.replace(text, F.lit(command), F.lit(other))
    return text


def spaced_commands(text: Column) -> Column:
    r"""A blank behind each backslash that stands before one letter, a digit or the like, as in \a1 and \1."""
    marks = F.regexp_extract_all(text, F.lit(r"(?s)\\[^\n]|[^\\]+|\\"), F.lit(0))

    def spaced(ms: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            second = F.substring(x, 2, 1)
            word = second.rlike("^[a-zA-Z]$") & F.coalesce(F.get(ms, i + 1), F.lit("")).rlike("^[a-zA-Z]")
            stays = ~x.startswith("\\") | (F.length(x) < 2) | F.lit(SPECIAL).contains(second) | word
            return F.when(stays, x).otherwise(F.concat(F.lit("\\ "), second))

        return F.array_join(F.transform(ms, one), "")

    return F.when(text.contains("\\"), _let(marks, spaced)).otherwise(text)


def repaired(text: Column) -> Column:
    """A recognised formula after all repairs; a null stays null."""
    text = _let(matched_delimiters(balanced_braces(text)), balance_environments)
    text = _let(replaced_commands(without_unsupported(plain_greek(text))), spaced_commands)
    return F.regexp_replace(F.regexp_replace(text, r"\\qquad(?!\s)", r"\\qquad "), r"\\+\z", "")
