"""Paragraphs against a plain Python version, on the documents' lines and on blocks made at random."""

import random
from collections import Counter, defaultdict

from quire.operators import paragraphs
from quire.plans import paragraph_queries

CJK = [(0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF)]


def brute_kind(kind, lines, page_width):
    n = len(lines)
    no, yes = [False] * n, [True] * n
    if kind != "text" or n < 2:
        return kind, yes if kind == "index" else no, no
    x0, x1 = min(a["x0"] for a in lines), max(a["x1"] for a in lines)
    y0, y1 = min(a["y0"] for a in lines), max(a["y1"] for a in lines)
    h, w = lines[0]["y1"] - lines[0]["y0"], x1 - x0
    texts = [a["text"].strip() for a in lines]
    letters = [c for c in "".join(texts) if c.isalpha()]
    cjk = bool(letters) and sum(any(lo <= ord(c) <= hi for lo, hi in CJK) for c in letters) / len(letters) >= 0.3
    area = (0.26 if cjk or (page_width and w / page_width >= 0.5) else 0.36) * w
    left = [abs(x0 - a["x0"]) < h / 2 for a in lines]
    right = [abs(x1 - a["x1"]) < h for a in lines]
    ind = [not c and a["x0"] - x0 > h for c, a in zip(left, lines)]
    rag = [not c and x1 - a["x1"] > area for c, a in zip(right, lines)]
    apart = [a["x0"] - x0 > 0.7 * h and x1 - a["x1"] > 0.7 * h for a in lines]
    mid = [abs((a["x0"] + a["x1"]) / 2 - (x0 + x1) / 2) < h / 2 for a in lines]
    df, dl, st = [t[:1].isdigit() for t in texts], [t[-1:].isdigit() for t in texts], [t[-1:] in (".", "。", ";", "；") for t in texts]
    later = lambda f: [False, *f[:-1]]
    if (sum(left) / n >= 0.8 or sum(right) / n >= 0.8) and (sum(df) / n >= 0.8 or sum(dl) / n >= 0.8):
        return "index", yes, no
    if sum(apart) >= 2 and all(mid) and sum(apart) / n >= 0.5 and (y1 - y0) / w > 0.4:
        return "list", yes, no
    prose = lines[0]["x0"] - x0 > h / 2 and abs(lines[-1]["x0"] - x0) < h / 2 and x1 - lines[-1]["x1"] > h
    if sum(left) >= 2 and (sum(rag) >= 2 or sum(st) / n >= 0.8 or sum(ind) >= 2) and not prose:
        if sum(left) / n > 0.8:
            if not any(st) and sum(right) / n < 0.5:
                return "list", left, no
            ends = st if sum(st) / n >= 0.8 else [abs(x1 - a["x1"]) > 0.1 * w for a in lines]
            return "list", later(ends), ends
        if sum(df) >= 2 and sum(df) == sum(st):
            return "list", df, st
        return "list", left, [abs(x1 - a["x1"]) > h for a in lines]
    return "text", no, no


def brute_document(blocks):
    """{block_id: (kind, starts, ends, joins, cross_page)} of one document's blocks in reading order."""
    out, groups = {}, [[]]
    for b in blocks:
        if b["type"] in paragraphs.BARRIERS:
            groups.append([])
        elif b["type"] in paragraphs.TEXTS:
            kind, starts, ends = brute_kind(b["type"], b["lines"], b["page_width"])
            groups[-1].append(dict(b.asDict(), kind=kind, starts=starts, ends=ends, held=len(b["lines"])))
    for group in groups:
        short = all(b["kind"] != "vertical_text" and len(b["lines"]) <= 3 for b in group)
        joins = {}
        for b, p in reversed(list(zip(group[1:], group))):
            joined = False
            if b["kind"] == p["kind"] and b["lines"] and p["lines"]:
                f, z = b["lines"][0], p["lines"][-1]
                flows = f["text"] != "" and not f["text"][0].isdigit() and not f["text"][0].isupper() and not z["text"].endswith(paragraphs.LINE_STOPS)
                side = lambda x, k, g: g(a[k] for a in x["lines"])
                if b["kind"] in ("list", "index"):
                    joined = True
                elif b["kind"] == "text" and not short:
                    wb, wp = b["x1"] - b["x0"], p["x1"] - p["x0"]
                    joined = flows and abs(side(b, "x0", min) - f["x0"]) < (f["y1"] - f["y0"]) / 2 and abs(side(p, "x1", max) - z["x1"]) < z["y1"] - z["y0"] and abs(wb - wp) < min(wb, wp) and b["y0"] < p["y1"] and (b["held"] > 1 or p["held"] > 1)
                elif b["kind"] == "vertical_text":
                    wb, wp = b["y1"] - b["y0"], p["y1"] - p["y0"]
                    joined = flows and abs(side(b, "y0", min) - f["y0"]) < (f["x1"] - f["x0"]) / 2 and abs(side(p, "y1", max) - z["y1"]) < z["x1"] - z["x0"] and abs(wb - wp) < min(wb, wp) and b["x1"] > p["x0"]
            joins[id(b)] = joined
            if joined:
                p["held"] += b["held"]
        for i, b in enumerate(group):
            j = joins.get(id(b), False)
            out[b["block_id"]] = (b["kind"], b["starts"], b["ends"], j, j and b["page_idx"] != group[i - 1]["page_idx"])
    return out


def check(df):
    docs = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["page_idx"], r["block_id"])):
        docs[r["doc_id"]].append(r)
    want = {(d, b): v for d, blocks in docs.items() for b, v in brute_document(blocks).items()}
    got = {(r["doc_id"], r["block_id"]): (r["kind"], r["starts"], r["ends"], r["joins"], r["cross_page"]) for r in paragraphs.merged_paragraphs(df).collect()}
    assert got == want
    return got


def test_paragraphs_of_documents(spark, sf):
    check(paragraph_queries.line_blocks(spark, sf))


def test_paragraphs_of_random_blocks(spark):
    rng = random.Random(2)
    rows = []
    for doc in range(400):
        style = rng.choice(["flush", "ragged", "hang", "centre", "prose"])
        often = rng.choice(["text", "text", "text", "vertical_text", "index"])
        for b in range(rng.randrange(1, 8)):
            top, lines = 60.0 * b if rng.random() < 0.7 else 300.0 - 20 * b, []
            kind = rng.choices([often, "vertical_text", "paragraph_title", "index", "image"], [14, 1, 1, 1, 1])[0]
            for k in range(rng.choice([1, 1, 2, 3, 4, 6])):
                x0, x1 = 100.0, 400.0
                if style == "ragged":
                    x1 -= rng.choice([0, 0, 90, 150])
                elif style == "hang" and k % 2:
                    x0 += 25
                elif style == "centre":
                    off = rng.choice([0, 20, 40])
                    x0, x1 = x0 + off, x1 - off
                elif style == "prose":
                    x0 += 20 * (k == 0)
                y0, y1 = (top + 14 * k, top + 14 * k + 12) if kind != "vertical_text" else (100.0, 300.0 - rng.choice([0, 0, 60]))
                if kind == "vertical_text":
                    x0, x1 = 200.0 - 20 * b, 224.0 - 20 * b
                text = rng.choice(["some words here", "1. item one.", "2 items", "Upper case", "ends here.", "中文文字", "目录 12", "word,", "x", ""])
                lines.append((x0, y0, x1, y1, text))
            rows.append((doc, b // 3, b, kind, min(a[0] for a in lines), min(a[1] for a in lines), max(a[2] for a in lines), max(a[3] for a in lines), 600.0, lines))
    df = spark.createDataFrame(rows, "doc_id int, page_idx int, block_id int, type string, x0 double, y0 double, x1 double, y1 double, page_width double, lines array<struct<x0:double,y0:double,x1:double,y1:double,text:string>>")
    kinds = Counter((v[0], v[3]) for v in check(df).values())
    assert all(kinds[k, True] for k in ("text", "list", "index", "vertical_text")) and kinds["list", False]
