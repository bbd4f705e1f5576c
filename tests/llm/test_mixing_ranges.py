"""The words that mixed_documents writes are those of the blocks that mix_slots takes."""

import re
from collections import Counter

from quire.llm import mixing
from tests.llm.conftest import rows_of

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_mixed_documents_write_the_words_of_the_taken_blocks(frame):
    # Three equal sources, one document of 900 words and two of one id and size each; every word occurs once.
    texts = [" ".join(f"s{s}d{d}w{i}" for i in range(n)) for s in range(3) for d, n in enumerate((900, 150, 150))]
    rows = [(r[0] - r[0] % 3 + min(r[0] % 3, 1), *r[1:]) for r in rows_of(texts, sources=[f"src{i // 3}" for i in range(9)])]
    docs, block = frame(rows), 32
    sources = mixing.sources_of(mixing.sized(docs))
    slots = mixing.mix_slots(sources, block).collect()
    out = mixing.mixed_documents(docs, block).collect()
    got = Counter(w for r in out for w in WORDS.findall(r["text"]))
    texts_of = Counter(r["text"] for r in out)
    for s in range(3):
        mine = [r[1].split() for r in rows if r[3] == f"src{s}"]
        # The order of documents within a source is the operator's own: it is read from the pieces.
        placed = mixing.pieces_of(mixing.sized(docs), block).where(f"key = 'asrc{s}'").select("doc_id", "size", "start").distinct().collect()
        starts = {(r["doc_id"], r["size"]): [] for r in placed}
        for r in placed:
            starts[r["doc_id"], r["size"]].append(r["start"])
        line = [None] * sum(map(len, mine))
        for (doc, size), at in starts.items():
            if len(at) == 1:
                line[at[0] : at[0] + size] = next(r[1] for r in rows if r[0] == doc and r[3] == f"src{s}").split()
        want, known = Counter(), Counter()
        for x in slots:
            if x["key"] == f"asrc{s}":
                for w in line[x["block"] * block : x["block"] * block + x["words"]]:
                    known[w is not None] += 1
                    want[w] += 1
        del want[None]
        big = {w: n for w, n in got.items() if w.startswith(f"s{s}d0")}
        assert big == dict(want)
        # Words of the rows that share id and size are counted, in either order.
        assert sum(n for w, n in got.items() if w.startswith((f"s{s}d1", f"s{s}d2"))) == known[False]
    # Some document is cut in the middle, and every row is a run of neighbouring words of one document.
    assert any(not t.split()[0].endswith("w0") for t in texts_of)
    assert all(any(t in whole for whole in texts) for t in texts_of)


def test_mixed_documents_take_rows_of_one_id_apart(frame, awkward_rows):
    size = lambda t: len(WORDS.findall(t or ""))
    taken = Counter()
    for r in mixing.mix(frame(awkward_rows)).collect():
        taken[r["doc_id"], r["source"]] += r["taken"]
    words = Counter()
    for r in mixing.mixed_documents(frame(awkward_rows, clash=True)).collect():
        words[r["doc_id"], r["source"]] += size(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert {k: v for k, v in taken.items() if v} == dict(words)
