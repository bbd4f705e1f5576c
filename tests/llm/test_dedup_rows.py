"""The dedup stages keep exactly one row of each group, whatever ids its rows have."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from quire.llm import _text, exact_dedup, simhash_dedup
from tests.llm.conftest import rows_of
from tests.llm.test_text_ops import near_rows

WORDS = re.compile(r"[^\x20\x09-\x0D]+")

SPACE = re.compile(r"[\x20\x09-\x0D]")


def crowded(awkward_rows):
    """Null ids with copies and unique texts, one id with different texts, repeated rows."""
    extra = [(None, awkward_rows[3][1], "en", "a", 1), (None, "only here, without an id", "en", "a", 1), (None, "and another of these", "en", "b", 1)]
    extra += [(700, "two texts under one id", "en", "a", 1), (700, awkward_rows[3][1], "en", "a", 1), (701, "nulls  and spaces", "en", "a", 1), (701, "nulls and spaces", "en", "a", 1)]
    return awkward_rows + extra + extra[1:2] * 3 + rows_of(["one more unique text"], first=800) * 2


def test_exact_stage_keeps_one_row_of_each_text(frame, awkward_rows):
    rows = crowded(awkward_rows)
    kept = exact_dedup.kept_documents(frame(rows, clash=True)).collect()
    bare = lambda t: SPACE.sub("", t or "")
    assert Counter(bare(r["text"]) for r in kept) == Counter({bare(r[1]) for r in rows})
    best = {}
    for r in rows:
        best.setdefault(bare(r[1]), []).append((-len(r[1] or ""), r[0] is None, r[0] or 0))
    assert all((-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0) == min(best[bare(r["text"])]) for r in kept)


def word_prints(text):
    """Fingerprints of words in three tables, of five-word shingles, and the band of the number of words."""
    ws = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    hashes = [[xxhash.xxh64_intdigest(" ".join(ws[i : i + k]).encode(), seed=42) for i in range(max(len(ws) - k + 1, min(1, len(ws))))] for k in (1, 5)]
    more = [[int(x) for x in _text.mix64(np.array(hashes[0], np.uint64) + np.uint64(t))] for t in (1, 2)]
    out = [sum((2 * sum(h >> b & 1 for h in hs) > len(hs)) << b for b in range(64)) for hs in (hashes[0], *more, hashes[1])]
    return tuple(out[:3]), out[3], math.floor(math.log(len(ws) + 1) / math.log(1.25))


def brute_groups(texts):
    prints, group = [word_prints(t) for t in texts], list(range(len(texts)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, (f, g, n) in enumerate(prints):
        for j, (f2, g2, n2) in enumerate(prints[:i]):
            if (f[0], g) == (f2[0], g2) or min((x ^ y).bit_count() for x, y in zip(f, f2, strict=True)) <= 2 and (g ^ g2).bit_count() <= 13 and abs(n - n2) <= 1:
                group[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("limit", [2, 512])
def test_near_stage_keeps_one_row_of_each_group(frame, awkward_rows, limit):
    rows = crowded(awkward_rows) + near_rows()
    comps = brute_groups([r[1] for r in rows])
    of = {word_prints(r[1])[:2]: c for r, c in zip(rows, comps, strict=True)}
    kept = simhash_dedup.representatives(frame(rows, clash=True), limit).collect()
    assert Counter(of[word_prints(r["text"])[:2]] for r in kept) == Counter(set(comps))
    assert len(kept) < len(set(r[1] for r in rows)) - 30
    for r in kept:
        ids = [x[0] for x, c in zip(rows, comps, strict=True) if c == of[word_prints(r["text"])[:2]] and x[0] is not None]
        assert r["doc_id"] == min(ids, default=None)


def test_near_stage_on_parquet_finds_planted_copies(spark, tmp_path, frame):
    """Texts of 200 words, drawn as in prose from common and rare ones, in which three are changed: 0.86 of the five-word shingles stay."""
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for rng in [random.Random(5)] for _ in range(20_000)]
    rng = random.Random(4)
    rows, n = [], 0
    for base in range(60):
        ws = [words[int(20_000 ** rng.random()) - 1] for _ in range(200)]
        for _ in range(3):
            copy = list(ws)
            for _ in range(3 * (n % 3 > 0)):
                copy[rng.randrange(200)] = "changed"
            rows.append((n, " ".join(copy), "en", "a", None))
            n += 1
    frame(rows).write.parquet(str(tmp_path / "d.parquet"))
    kept = {r["doc_id"] for r in simhash_dedup.representatives(spark.read.parquet(str(tmp_path / "d.parquet"))).collect()}
    assert {3 * k for k in range(60)} <= kept and len(kept) - 60 <= 12
