"""Office packages as typed blocks, with the standard library alone.

`read(spark, path)` gives one row for each block: path, kind, page_idx, seq, type, level, text, html. A file that can't be parsed gives one row of
type `error` with the reason as text, so that one broken file fails no job. Files are spread over tasks; a file is parsed in one.
"""

from __future__ import annotations

import html as markup
import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from quire.operators.layout import cut_order
from quire.sources.files import OFFICE, inputs, kind_of_bytes

SCHEMA = "path string, kind string, page_idx int, seq int, type string, level int, text string, html string"


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _get(node: ET.Element, key: str) -> str | None:
    """An attribute by its local name."""
    return next((v for k, v in node.attrib.items() if _name(k) == key), None)


def _find(node: ET.Element, *path: str) -> ET.Element | None:
    for step in path:
        node = next((x for x in node if _name(x.tag) == step), None)
        if node is None:
            return None
    return node


def _all(node: ET.Element, name: str) -> Iterator[ET.Element]:
    return (x for x in node.iter() if _name(x.tag) == name)


def _relations(package: zipfile.ZipFile, part: str) -> dict[str, str]:
    folder, file = posixpath.split(part)
    try:
        root = ET.fromstring(package.read(f"{folder}/_rels/{file}.rels"))
    except KeyError:
        return {}
    return {r.get("Id", ""): posixpath.normpath(posixpath.join(folder, r.get("Target", ""))) if not r.get("Target", "").startswith("/") else r.get("Target", "")[1:] for r in root if r.get("TargetMode") != "External"}


def table_html(rows: list[list[tuple[str, int, int]]]) -> str:
    """Rows of (text, colspan, rowspan)."""
    span = lambda k, n: f' {k}="{n}"' if n > 1 else ""
    return "<table>" + "".join("<tr>" + "".join(f"<td{span('colspan', c)}{span('rowspan', r)}>{markup.escape(t, quote=False)}</td>" for t, c, r in row) + "</tr>" for row in rows) + "</table>"


# -- formulas ---------------------------------------------------------------------------------


def latex(node: ET.Element) -> str:
    """Office math as LaTeX: runs, fractions, scripts, radicals, delimiters, n-ary operators, matrices, limits and functions."""
    part = lambda n, k: "".join(map(latex, x)) if (x := _find(n, k)) is not None else ""
    kind = _name(node.tag)
    if kind == "t":
        return node.text or ""
    if kind == "f":
        return rf"\frac{{{part(node, 'num')}}}{{{part(node, 'den')}}}"
    if kind == "sSup":
        return f"{part(node, 'e')}^{{{part(node, 'sup')}}}"
    if kind == "sSub":
        return f"{part(node, 'e')}_{{{part(node, 'sub')}}}"
    if kind == "sSubSup":
        return f"{part(node, 'e')}_{{{part(node, 'sub')}}}^{{{part(node, 'sup')}}}"
    if kind == "rad":
        degree = part(node, "deg")
        return rf"\sqrt[{degree}]{{{part(node, 'e')}}}" if degree else rf"\sqrt{{{part(node, 'e')}}}"
    if kind == "d":
        mark = lambda k, d: _get(x, "val") or d if (x := _find(node, "dPr", k)) is not None else d
        inner = ",".join("".join(map(latex, e)) for e in node if _name(e.tag) == "e")
        return rf"\left{mark('begChr', '(')}{inner}\right{mark('endChr', ')')}"
    if kind == "nary":
        sign = _find(node, "naryPr", "chr")
        names = {"∑": r"\sum", "∏": r"\prod", "∫": r"\int", "⋃": r"\bigcup", "⋂": r"\bigcap"}
        head = names.get((_get(sign, "val") or "∫") if sign is not None else "∫", r"\int")
        low, high = part(node, "sub"), part(node, "sup")
        return head + (f"_{{{low}}}" if low else "") + (f"^{{{high}}}" if high else "") + f"{{{part(node, 'e')}}}"
    if kind == "m":
        rows = [" & ".join("".join(map(latex, e)) for e in r if _name(e.tag) == "e") for r in node if _name(r.tag) == "mr"]
        return r"\begin{matrix}" + r" \\ ".join(rows) + r"\end{matrix}"
    if kind == "func":
        name = part(node, "fName").strip()
        return (f"\\{name}" if name.isalpha() else name) + f"{{{part(node, 'e')}}}"
    if kind == "limLow":
        return f"{part(node, 'e')}_{{{part(node, 'lim')}}}"
    if kind in ("rPr", "ctrlPr", "fPr", "sSupPr", "sSubPr", "radPr", "dPr", "naryPr", "mPr", "funcPr", "limLowPr"):
        return ""
    return "".join(map(latex, node))


# -- docx -------------------------------------------------------------------------------------


def _paragraph_text(p: ET.Element) -> str:
    out = []

    def walk(node: ET.Element) -> None:
        kind = _name(node.tag)
        if kind in ("oMath", "oMathPara"):
            formula = latex(node).strip()
            if formula:
                out.append(f"${formula}$")
            return
        if kind == "t":
            out.append(node.text or "")
        elif kind == "tab":
            out.append("\t")
        elif kind in ("br", "cr"):
            out.append("\n")
        elif kind in ("pPr", "rPr", "del", "instrText"):
            return
        for x in node:
            walk(x)

    walk(p)
    return "".join(out)


def _docx_table(tbl: ET.Element) -> str:
    grid: list[list[list]] = []
    open_: dict[int, list] = {}
    for tr in (x for x in tbl if _name(x.tag) == "tr"):
        row, column = [], 0
        for tc in (x for x in tr if _name(x.tag) == "tc"):
            span = _find(tc, "tcPr", "gridSpan")
            width = int(_get(span, "val") or 1) if span is not None else 1
            merge = _find(tc, "tcPr", "vMerge")
            text = "\n".join(_paragraph_text(p) for p in tc if _name(p.tag) == "p").strip()
            if merge is not None and _get(merge, "val") != "restart" and column in open_:
                open_[column][2] += 1
            else:
                cell = [text, width, 1]
                row.append(cell)
                open_.pop(column, None)
                if merge is not None:
                    open_[column] = cell
            column += width
        grid.append(row)
    return table_html([[tuple(c) for c in row] for row in grid])


def docx_blocks(package: zipfile.ZipFile) -> Iterator[tuple[int, str, int, str, str]]:
    """(page, type, level, text, html): the body is one page."""
    body = _find(ET.fromstring(package.read("word/document.xml")), "body")
    outline = {}
    if "word/styles.xml" in package.namelist():
        for style in _all(ET.fromstring(package.read("word/styles.xml")), "style"):
            name = _find(style, "name")
            found = re.fullmatch(r"heading (\d)", (_get(name, "val") or "").lower()) if name is not None else None
            if found:
                outline[_get(style, "styleId")] = int(found[1])

    def walk(nodes):
        for node in nodes:
            kind = _name(node.tag)
            if kind == "sdt":
                content = _find(node, "sdtContent")
                if content is not None:
                    yield from walk(content)
            elif kind == "tbl":
                yield 0, "table", 0, "", _docx_table(node)
            elif kind == "p":
                text = _paragraph_text(node).strip()
                if not text:
                    continue
                style = _find(node, "pPr", "pStyle")
                name = _get(style, "val") if style is not None else None
                item = _find(node, "pPr", "numPr")
                heading = outline.get(name) or (int(m[1]) if name and (m := re.fullmatch(r"Heading(\d)", name)) else 1 if name == "Title" else 0)
                if heading:
                    yield 0, "title", heading, text, ""
                elif item is not None:
                    level = _find(item, "ilvl")
                    yield 0, "list", int(_get(level, "val") or 0) if level is not None else 0, text, ""
                elif text.startswith("$") and text.endswith("$") and text.count("$") == 2:
                    yield 0, "interline_equation", 0, text[1:-1], ""
                else:
                    yield 0, "text", 0, text, ""

    if body is not None:
        yield from walk(body)


# -- pptx -------------------------------------------------------------------------------------


def pptx_blocks(package: zipfile.ZipFile) -> Iterator[tuple[int, str, int, str, str]]:
    """Slides are pages; shapes come in reading order by recursive cuts."""
    main = "ppt/presentation.xml"
    relations, root = _relations(package, main), ET.fromstring(package.read(main))
    slides = [relations.get(_get_rel(x), "") for x in _all(root, "sldId")]
    for page, part in enumerate(p for p in slides if p in package.namelist()):
        found = []
        for shape in _all(ET.fromstring(package.read(part)), "spTree"):
            for x in shape:
                if _name(x.tag) not in ("sp", "graphicFrame"):
                    continue
                offset, extent = next(_all(x, "off"), None), next(_all(x, "ext"), None)
                box = [float(offset.get("x", 0)), float(offset.get("y", 0))] if offset is not None else [0.0, 0.0]
                size = [float(extent.get("cx") or 0), float(extent.get("cy") or 0)] if extent is not None else [0.0, 0.0]
                table = next(_all(x, "tbl"), None)
                holder = next(_all(x, "ph"), None)
                if table is not None:
                    rows = [[("\n".join(_runs(tc)), int(tc.get("gridSpan") or 1), int(tc.get("rowSpan") or 1)) for tc in tr if _name(tc.tag) == "tc" and not (tc.get("hMerge") or tc.get("vMerge"))] for tr in table if _name(tr.tag) == "tr"]
                    found.append(([*box, box[0] + size[0], box[1] + size[1]], "table", 0, "", table_html(rows)))
                else:
                    text = "\n".join(t for t in _runs(x) if t.strip())
                    title = holder is not None and holder.get("type") in ("title", "ctrTitle")
                    if text:
                        found.append(([*box, box[0] + size[0], box[1] + size[1]], "title" if title else "text", 1 if title else 0, text, ""))
        order = cut_order(np.array([f[0] for f in found])) if found else []
        for i in order:
            yield page, *found[i][1:]


def _get_rel(node: ET.Element) -> str:
    return next((v for k, v in node.attrib.items() if k.endswith("}id")), "")


def _runs(node: ET.Element) -> list[str]:
    return ["".join((r.text or "") if _name(r.tag) == "t" else "\n" if _name(r.tag) == "br" else "" for r in p.iter()) for p in _all(node, "p")]


# -- xlsx -------------------------------------------------------------------------------------


def sheet_cells(package: zipfile.ZipFile) -> Iterator[tuple[int, str, dict[tuple[int, int], str], list[tuple[int, int, int, int]]]]:
    """(sheet number, name, values by (row, column), merged ranges) of the visible sheets."""
    main = "xl/workbook.xml"
    relations, shared = _relations(package, main), []
    if "xl/sharedStrings.xml" in package.namelist():
        shared = ["".join(t.text or "" for t in _all(si, "t")) for si in ET.fromstring(package.read("xl/sharedStrings.xml")) if _name(si.tag) == "si"]
    visible = [s for s in _all(ET.fromstring(package.read(main)), "sheet") if s.get("state", "visible") == "visible"]
    for number, sheet in enumerate(visible):
        part = relations.get(_get_rel(sheet), "")
        if part not in package.namelist():
            continue
        root, values = ET.fromstring(package.read(part)), {}
        for c in _all(root, "c"):
            at, kind = c.get("r", ""), c.get("t", "n")
            value = _find(c, "v")
            text = "".join(t.text or "" for t in _all(c, "t")) if kind == "inlineStr" else (value.text or "") if value is not None else ""
            if kind == "s" and text.isdigit() and int(text) < len(shared):
                text = shared[int(text)]
            if kind == "b":
                text = {"1": "TRUE", "0": "FALSE"}.get(text, text)
            if text and (place := _cell(at)):
                values[place] = text
        merged = [(*_cell(a), *_cell(b)) for m in _all(root, "mergeCell") if ":" in (m.get("ref") or "") for a, b in [m.get("ref").split(":")]]
        yield number, sheet.get("name", ""), values, merged


def _cell(name: str) -> tuple[int, int] | None:
    found = re.fullmatch(r"\$?([A-Z]{1,3})\$?(\d+)", name)
    if not found:
        return None
    column = 0
    for c in found[1]:
        column = column * 26 + ord(c) - 64
    return int(found[2]) - 1, column - 1


def sheet_tables(values: dict[tuple[int, int], str], merged: list[tuple[int, int, int, int]], gap: int = 1) -> Iterator[list[list[tuple[str, int, int]]]]:
    """Rows of each table of a sheet: cells within gap of each other, merged ranges filled."""
    filled = set(values)
    for r0, c0, r1, c1 in merged:
        filled |= {(r, c) for r in range(r0, r1 + 1) for c in range(c0, c1 + 1)}
    spans = {(r0, c0): (r1 - r0 + 1, c1 - c0 + 1) for r0, c0, r1, c1 in merged}
    seen: set = set()
    for start in sorted(values):
        if start in seen:
            continue
        todo, group = [start], {start}
        while todo:
            r, c = todo.pop()
            for step in range(1, gap + 2):
                for near in ((r + step, c), (r - step, c), (r, c + step), (r, c - step)):
                    if near in filled and near not in group:
                        group.add(near)
                        todo.append(near)
        seen |= group
        rows, columns = [r for r, _ in group], [c for _, c in group]
        out, covered = [], set()
        for r in range(min(rows), max(rows) + 1):
            row = []
            for c in range(min(columns), max(columns) + 1):
                if (r, c) in covered:
                    continue
                high, wide = spans.get((r, c), (1, 1))
                covered |= {(y, x) for y in range(r, r + high) for x in range(c, c + wide)}
                row.append((values.get((r, c), ""), wide, high))
            out.append(row)
        yield out


def xlsx_blocks(package: zipfile.ZipFile) -> Iterator[tuple[int, str, int, str, str]]:
    for number, _, values, merged in sheet_cells(package):
        for rows in sheet_tables(values, merged):
            yield number, "table", 0, "", table_html(rows)


_PARSERS = {"docx": docx_blocks, "pptx": pptx_blocks, "xlsx": xlsx_blocks}


def blocks_of(data: bytes) -> list[tuple[int, str, int, str, str]]:
    kind = kind_of_bytes(data)
    if kind not in _PARSERS:
        raise ValueError("no Office package")
    return list(_PARSERS[kind](zipfile.ZipFile(io.BytesIO(data))))


def parse(files: DataFrame) -> DataFrame:
    """files(path, kind, content) -> blocks."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, kind, data in zip(batch["path"], batch["kind"], batch["content"], strict=True):
                try:
                    rows = [(path, kind, page, i, *rest) for i, (page, *rest) in enumerate(blocks_of(bytes(data)))]
                except Exception as e:  # a broken file is a row, not a failed job
                    rows = [(path, kind, 0, 0, "error", 0, f"{type(e).__name__}: {e}", "")]
                yield pd.DataFrame(rows, columns=["path", "kind", "page_idx", "seq", "type", "level", "text", "html"])

    return files.select("path", "kind", "content").mapInPandas(work, SCHEMA)


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(inputs(spark, path, OFFICE))
