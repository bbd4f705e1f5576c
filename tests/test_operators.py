"""Operators without SQL, Office packages, streams and renderers against small cases and brute force."""

import io
import random
import zipfile
from collections import defaultdict
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import render
from quire.operators import cells, layout, tables
from quire.sources import files, office
from quire.streaming import tasks


def boxes(spark, rows):
    return spark.createDataFrame([(0, i, *map(float, r)) for i, r in enumerate(rows)], "page_idx long, det_id long, x0 double, y0 double, x1 double, y1 double, score double")


def test_suppression_keeps_the_better_of_overlapping_boxes(spark):
    df = boxes(spark, [(0, 0, 10, 10, 0.5), (0, 0, 10, 10, 0.9), (0, 0, 10, 9.5, 0.8), (50, 50, 60, 60, 0.1), (5, 5, 5, 5, 0.4)])
    assert {r["det_id"] for r in layout.suppress(df).collect()} == {1, 3, 4}


def test_suppression_is_maximal(spark, sf):
    from quire.plans import fixtures as fx

    pages = defaultdict(list)
    for r in fx.boxes(spark, sf).collect():
        pages[r["page_idx"]].append(r)
    kept = {(r["page_idx"], r["det_id"]) for r in layout.suppress(fx.boxes(spark, sf), most=0.3).collect()}
    box = lambda r: np.array([r["x0"], r["y0"], r["x1"], r["y1"]])
    for page, rows in pages.items():
        for r in rows:
            better = [o for o in rows if (page, o["det_id"]) in kept and (-o["score"], o["det_id"]) < (-r["score"], r["det_id"])]
            covered = any(layout._iou(box(r), box(o)[None])[0] > 0.3 for o in better)
            assert covered != ((page, r["det_id"]) in kept)


def test_nested_formulas_become_one(spark):
    df = boxes(spark, [(0, 0, 10, 10, 0.5), (1, 1, 9.5, 9, 0.9), (20, 20, 30, 30, 0.3), (9, 9, 40, 40, 0.2)])
    got = {(r["det_id"], r["x0"], r["y1"]) for r in layout.merge_nested_formulas(df).collect()}
    assert got == {(1, 0.0, 10.0), (2, 9.0, 40.0)} or got == {(1, 0.0, 10.0), (2, 9.0, 40.0), (3, 9.0, 40.0)}


def test_rows_of_boxes(spark):
    df = boxes(spark, [(50, 0, 60, 10, 1), (0, 5, 10, 15, 1), (30, 3, 40, 13, 1), (0, 40, 9, 50, 1)])
    assert [r["det_id"] for r in layout.rows_first(df).orderBy("place").collect()] == [1, 2, 0, 3]


def test_cuts_read_columns_one_after_the_other():
    xy = np.array([(0, 0, 100, 10), (0, 30, 40, 50), (0, 60, 40, 80), (60, 30, 100, 50), (60, 60, 100, 80)], float)
    assert layout.cut_order(xy) in ([0, 1, 2, 3, 4], [0, 1, 3, 2, 4])
    xy[:, 1::2] += np.array([[0], [0], [0], [7], [7]]) * 1.7
    assert sorted(layout.cut_order(xy)) == [0, 1, 2, 3, 4] and layout.cut_order(xy)[0] == 0
    assert layout.cut_order(np.zeros((0, 4))) == [] and layout.cut_order(np.zeros((3, 4))) == [0, 1, 2]


def test_union_area_equals_a_raster(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(25):
        x, y = rng.randrange(40), rng.randrange(40)
        rows.append((x, y, x + rng.randrange(12), y + rng.randrange(12), 1))
    grid = np.zeros((60, 60), bool)
    for x0, y0, x1, y1, _ in rows:
        grid[x0:x1, y0:y1] = True
    assert layout.union_area(boxes(spark, rows)).first()["area"] == grid.sum()


@pytest.mark.parametrize("gap", [0, 1, 2])
def test_components_equal_flood_fill(spark, gap):
    rng = random.Random(gap)
    data = {(s, rng.randrange(12), rng.randrange(12)) for s in range(4) for _ in range(40)}
    got = {(r["sheet"], r["r"], r["c"]): (r["table_r"], r["table_c"]) for r in cells.components(spark.createDataFrame(sorted(data), "sheet int, r int, c int"), gap).collect()}
    want = {}
    for start in sorted(data):
        if start in want:
            continue
        todo, group = [start], {start}
        while todo:
            s, r, c = todo.pop()
            for d in range(1, gap + 2):
                for near in ((s, r + d, c), (s, r - d, c), (s, r, c + d), (s, r, c - d)):
                    if near in data and near not in group:
                        group.add(near)
                        todo.append(near)
        want |= {x: start[1:] for x in group}
    assert got == want


def test_table_grid(spark):
    html = '<table><tr><td rowspan="3">a</td><td colspan="2">b &amp; c</td></tr><tr><td>d</td></tr><tr><td>e</td><td>f</td><td>g</td></tr></table>'
    row = spark.range(1).select(tables.parse(F.lit(html)).alias("rows")).select("rows", tables.occupancy(F.col("rows")).alias("o"), tables.to_html(F.col("rows")).alias("html")).first()
    assert [[c["text"] for c in r] for r in row["rows"]] == [["a", "b & c"], ["d"], ["e", "f", "g"]]
    assert (row["o"]["width"], row["o"]["widths"]) == (4, [3, 2, 4])
    assert row["html"] == html
    assert spark.range(1).select(tables.parse(F.lit(None).cast("string")).alias("r")).first()["r"] is None
    assert office.table_html([[("a<b", 2, 1)]]) == '<table><tr><td colspan="2">a&lt;b</td></tr></table>'


def test_grid_equals_a_loop(spark):
    rng = random.Random(8)
    cases = [[[{"text": "", "colspan": rng.choice([1, 1, 2, 3]), "rowspan": rng.choice([1, 1, 2, 4])} for _ in range(rng.randrange(1, 5))] for _ in range(rng.randrange(1, 7))] for _ in range(60)]
    got = spark.createDataFrame([(c,) for c in cases], f"rows {tables.ROWS}").select("rows", tables.occupancy(F.col("rows"))["widths"].alias("w")).collect()
    for r in got:
        held, want = [], []
        for row in r["rows"]:
            new, at = [0] * len(held), 0
            for cell in row:
                while at < len(held) and held[at]:
                    at += 1
                new += [0] * (at - len(new))
                for _ in range(cell["colspan"]):
                    if at < len(new):
                        new[at] = max(new[at], cell["rowspan"] - 1)
                    else:
                        new.append(cell["rowspan"] - 1)
                    at += 1
            taken = max([at] + [i + 1 for i, h in enumerate(held) if h])
            held += [0] * (max(len(new), len(held)) - len(held))
            new += [0] * (len(held) - len(new))
            held = [max(h - 1, n, 0) for h, n in zip(held, new, strict=True)]
            want.append(taken)
        assert r["w"] == want


def test_packing_fills_the_least_filled_bin(spark):
    docs = spark.createDataFrame([(0, 1, 100), (0, 2, 40), (0, 3, 30), (0, 4, 24), (0, 5, 10)], "batch int, doc_id int, pages int")
    assert {r["doc_id"]: r["bin"] for r in tasks.pack_documents(docs, "batch").collect()} == {1: 0, 2: 1, 3: 2, 4: 2, 5: 1}


def lines(*texts):
    return [([("text", t)], False) for t in texts]


def rendered(spark, blocks, cjk=False, **more):
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(blocks)], f"i int, lines array<{render.LINE}>")
    return [r["t"] for r in rows.select("i", render.paragraph(F.col("lines"), F.lit(cjk), **more).alias("t")).orderBy("i").collect()]


def test_paragraphs(spark):
    got = rendered(spark, [
        lines("exam-", "ple text", "end"), lines("Anglo-", "Saxon"), lines("a*b", "", "c"), [([("text", "x"), ("inline_equation", "y"), ("text", "z")], False)],
        [([("text", "first")], True), ([("text", "second")], True)], [([("interline_equation", "E")], False)], [], [([("table", "t")], False)],
    ])
    assert got == ["example text end", "Anglo-Saxon", "a\\*b c", "x $y$ z", "first   \nsecond", "$$\nE\n$$", "", ""]
    assert rendered(spark, [lines("中文", "文字")], cjk=True) == ["中文文字"]


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def docx():
    body = """<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Some </w:t></w:r><w:r><w:t>text</w:t></w:r><m:oMath><m:f><m:num><m:r><m:t>1</m:t></m:r></m:num><m:den><m:r><m:t>x</m:t></m:r></m:den></m:f></m:oMath></w:p>
<w:p><w:pPr><w:numPr><w:ilvl w:val="1"/></w:numPr></w:pPr><w:r><w:t>item</w:t></w:r></w:p><w:p/>
<w:tbl><w:tr><w:tc><w:tcPr><w:vMerge w:val="restart"/></w:tcPr><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"""
    return package({"word/document.xml": f'<w:document xmlns:w="w" xmlns:m="m"><w:body>{body}</w:body></w:document>'})


def xlsx():
    sheet = '<worksheet xmlns="s"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1"><v>2</v></c></row><row><c r="A2" t="inlineStr"><is><t>in</t></is></c></row><row><c r="H9"><v>7</v></c></row></sheetData><mergeCells><mergeCell ref="A2:B2"/></mergeCells></worksheet>'
    return package({
        "xl/workbook.xml": '<workbook xmlns="s" xmlns:r="r"><sheets><sheet name="one" r:id="rId1"/><sheet name="two" state="hidden" r:id="rId2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": '<sst xmlns="s"><si><t>one</t></si></sst>', "xl/worksheets/sheet1.xml": sheet,
    })


def pptx():
    shape = lambda text, x, y, kind="": f'<p:sp><p:nvSpPr><p:nvPr>{kind}</p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="{x}" y="{y}"/><a:ext cx="100" cy="20"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'
    slide = f'<p:sld xmlns:p="p" xmlns:a="a"><p:cSld><p:spTree>{shape("below", 0, 100)}{shape("Top", 0, 0, "<p:ph type=%stitle%s/>" % (chr(34), chr(34)))}</p:spTree></p:cSld></p:sld>'
    return package({
        "ppt/presentation.xml": '<p:presentation xmlns:p="p" xmlns:r="r"><p:sldIdLst><p:sldId id="1" r:id="rId1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": '<Relationships><Relationship Id="rId1" Target="slides/slide1.xml"/></Relationships>', "ppt/slides/slide1.xml": slide,
    })


def test_kinds_of_files():
    assert [files.kind_of_bytes(b) for b in (b"%PDF-1.7", b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff\xe0", b"RIFF0000WEBP", b"", None, b"PKxx", docx(), xlsx(), pptx())] == ["pdf", "png", "jpg", "webp", "", "", "", "docx", "xlsx", "pptx"]


def test_office_packages(spark, tmp_path):
    for name, data in {"a/One.docx": docx(), "b/one.xlsx": xlsx(), "c.pptx": pptx(), "d.docx": docx()[:200] + b"broken", "e.txt": b"text"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    stems = {r["task_stem"] for r in files.inputs(spark, str(tmp_path)).collect()}
    assert {s.lower() for s in stems} == {"one", "one_1", "c"}
    got = defaultdict(list)
    for r in office.read(spark, str(tmp_path)).orderBy("path", "seq").collect():
        got[r["kind"]].append((r["page_idx"], r["type"], r["level"], r["text"] or r["html"]))
    assert got["docx"] == [(0, "title", 2, "Head"), (0, "text", 0, r"Some text$\frac{1}{x}$"), (0, "list", 1, "item"), (0, "table", 0, '<table><tr><td rowspan="2">a</td><td>b</td></tr><tr><td>c</td></tr></table>')]
    assert got["xlsx"] == [(0, "table", 0, '<table><tr><td>one</td><td>2</td></tr><tr><td colspan="2">in</td></tr></table>'), (0, "table", 0, "<table><tr><td>7</td></tr></table>")]
    assert got["pptx"] == [(0, "title", 1, "Top"), (0, "text", 0, "below")]
    broken = spark.createDataFrame([("x", "docx", bytearray(b"PK broken"))], "path string, kind string, content binary")
    assert office.parse(broken).first()["type"] == "error"


def test_images_in_html(spark):
    df = spark.createDataFrame([(1, '<img src="data:image/png;base64,aGk="><img src="data:image/png;base64,aGk="><img src="x.png">')], "doc_id int, html string")
    rows = files.data_uri_images(df).collect()
    assert len(rows) == 1 and bytes(rows[0]["content"]) == b"hi"
    out = df.select(files.without_data_uris(F.col("html")).alias("h")).first()["h"]
    assert out.count(f"images/{rows[0]['image_path']}") == 2 and "base64" not in out


def run_stream(spark, tmp_path, schema, batches, build, mode):
    source, out = tmp_path / "in", []
    source.mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source / f"b{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
    q = build(stream).writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, _: out.extend(map(tuple, df.collect()))).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return out


def test_documents_come_when_complete(spark, tmp_path):
    schema = "doc_id long, page_idx int, page_count int"
    out = run_stream(spark, tmp_path, schema, [[(1, 0, 3), (2, 0, 1), (3, None, 0)], [(1, 2, 3), (1, 2, 3)], [(1, 1, 3)]], tasks.complete_documents, "append")
    assert sorted(out) == [(1, 3), (2, 1), (3, 0)]


def test_task_stream_tells_changes(spark, tmp_path):
    t = lambda s: datetime(2024, 1, 1, 0, 0, s)
    out = run_stream(spark, tmp_path, "task_id long, status string, ts timestamp", [[(1, "pending", t(1)), (2, "pending", t(1))], [(1, "completed", t(5)), (2, "pending", t(6))]], tasks.task_stream, "update")
    assert sorted((a, b) for a, b, _ in out) in ([(1, "completed"), (1, "pending"), (2, "pending")], [(1, "completed"), (2, "pending")])


def test_best_gap_takes_the_tables_of_one_gap(spark):
    rng = random.Random(3)
    data = sorted({(s, rng.randrange(9), rng.randrange(9)) for s in range(30) for _ in range(rng.randrange(5, 40))})
    df = spark.createDataFrame(data, "sheet int, r int, c int")
    tried = {}
    for rank, gap in enumerate((1, 0, 2)):
        tables_of = {}
        for r in cells.components(df, gap).collect():
            tables_of.setdefault(r["sheet"], {}).setdefault((r["table_r"], r["table_c"]), []).append((r["r"], r["c"]))
        for sheet, found in tables_of.items():
            span = lambda xs: max(xs) - min(xs) + 1
            area = sum(span([a for a, _ in t]) * span([b for _, b in t]) for t in found.values())
            tried.setdefault(sheet, []).append((1 - sum(map(len, found.values())) / area, rank, gap, len(found)))
    want = {s: min((x for x in t if x[0] <= min(t)[0] + 0.15 + 1e-12), key=lambda x: x[1])[2:] for s, t in tried.items()}
    assert {r["sheet"]: (r["gap"], r["n_tables"]) for r in cells.best_gap(df).collect()} == want
