"""op3, op5, op6, op7 and the pipeline: properties, exact round trips, held-out accuracy."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quire.llm import language_id, licenses, mixing, packing
from tests.llm.conftest import rows_of

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def is_held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0 if doc_id is not None else True


# -- op3 --------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    out = language_id.op3(spark, path).collect()
    assert len(out) == len(truth)
    held = [r for r in out if r["held_out"]]
    assert held and all(r["held_out"] == is_held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in out)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    assert sum(r["rejected"] for r in out) < 0.03 * len(out)


def test_language_awkward(frame, awkward_rows):
    out = language_id.identify(frame(awkward_rows, clash=True)).collect()
    assert Counter((r["doc_id"], r["held_out"]) for r in out) == Counter((r[0], is_held_out(r[0])) for r in awkward_rows)
    texts = defaultdict(list)
    for r in awkward_rows:
        texts[r[0]].append(r[1])
    for r in out:
        if all(not any(c.isalpha() for c in t or "") for t in texts[r["doc_id"]]):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
    kept = language_id.recognised(frame(awkward_rows)).collect()
    assert all(r["text"] and any(c.isalpha() for c in r["text"]) for r in kept)


def test_nothing_to_learn_from(frame):
    rows = rows_of(["some text", "other"], langs=[None, None])
    assert {r["lang_pred"] for r in language_id.identify(frame(rows)).collect()} == {"und"}


def test_probabilities_of_a_context_sum_to_one():
    model = language_id.fit({"x": ["abab abba baab"] * 4, "y": ["cdcd dccd"] * 4}, order=3)
    symbols = [ord(c) for c in "abcd"]
    # After "a" in language x: the probabilities of all seen letters and the end mark, plus the reserved rest, stay within 1.
    points, starts, ends, _ = language_id.letter_words(["aa", "ab", "ac", "ad", "a"])
    scores = model.word_scores(points, starts, ends)[:, 0]
    assert len(symbols) == 4 and (scores < 0).all()
    assert scores[1] > scores[2] and scores[1] > scores[3]


# -- op5 --------------------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted((k for k in sizes if k is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    total, open_, done = sum(sizes.values()), set(names), {}
    while open_:
        level = (total - sum(done.values())) / sum(weight[k] for k in open_)
        over = {k for k in open_ if weight[k] * level > 3 * sizes[k]}
        if not over:
            done |= {k: weight[k] * level for k in open_}
            break
        done |= {k: 3.0 * sizes[k] for k in over}
        open_ -= over
    return done


def check_mix(rows, out):
    n = lambda t: len(WORDS.findall(t or ""))
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += n(r[1])
    sizes = {k: sizes[k] for k in {r[3] for r in rows}}
    target = brute_targets(sizes)
    assert Counter((r["doc_id"], r["source"], r["size"], r["source_size"]) for r in out) == Counter((r[0], r[3], n(r[1]), sizes[r[3]]) for r in rows)
    took = Counter()
    for r in out:
        assert math.isclose(r["target"], target[r["source"]], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"]
        took[r["source"]] += r["taken"]
    for k, v in target.items():
        assert abs(took[k] - v) <= 1


@pytest.mark.parametrize("block", [1, 7, 128])
def test_mix(frame, awkward_rows, block):
    first = mixing.mix(frame(awkward_rows, clash=True), block).collect()
    check_mix(awkward_rows, first)
    again = mixing.mix(frame(awkward_rows, parts=5), block).collect()
    assert Counter(map(tuple, first)) == Counter(map(tuple, again))


def test_mix_of_documents(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    check_mix(rows, mixing.mix(spark.read.parquet(f"{sf}/documents.parquet")).collect())


def test_mixed_documents_hold_the_taken_words(frame, awkward_rows):
    rows = [r for r in {r[0]: r for r in awkward_rows}.values() if r[0] is not None]
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(frame(rows)).collect()}
    out = mixing.mixed_documents(frame(rows)).collect()
    words = Counter()
    for r in out:
        words[r["doc_id"]] += len(WORDS.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert {k: v for k, v in taken.items() if v} == dict(words)


def test_permutation_has_an_inverse(spark):
    from pyspark.sql import functions as F

    for size in (1, 2, 17, 100):
        df = spark.range(size).select("id", mixing.permuted(F.col("id"), F.lit(size).cast("long"), F.lit(7).cast("long")).alias("p"))
        df = df.withColumn("back", mixing.permuted(F.col("p"), F.lit(size).cast("long"), F.lit(7).cast("long"), inverse=True))
        rows = df.collect()
        assert sorted(r["p"] for r in rows) == list(range(size)) and all(r["back"] == r["id"] for r in rows)


def test_output_shards_follow_the_targets(frame):
    rows = rows_of([" ".join(f"w{i}" for i in range(400)) for _ in range(300)])
    docs = frame(rows)
    sources = mixing.targets(mixing.sized(docs).groupBy("key").agg({"size": "sum"}).withColumnRenamed("sum(size)", "source_size"))
    slots = mixing.mix_slots(sources, block=16, shard_slots=2000).collect()
    by = defaultdict(Counter)
    for r in slots:
        by[r["out_shard"]][r["key"]] += 1
    whole = sum(by.values(), Counter())
    for counts in by.values():
        n = sum(counts.values())
        for k, v in whole.items():
            p = v / sum(whole.values())
            assert abs(counts[k] - n * p) < 6 * math.sqrt(n * p * (1 - p)) + 1


# -- op6 --------------------------------------------------------------------------------------


def test_pack(frame, awkward_rows):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    extra = rows_of(["\n" * 5000, "  " * 3000 + "x", "<|endoftext|> and <s>", "🙂🙃 é́ ﬁ", "'s 't don't 12345"], first=500)
    rows = awkward_rows + extra
    ids = Counter()
    for r in rows:
        ids[(r[0], *tok.encode(r[1] or "", add_special_tokens=False).ids, 1)] += 1
    out = packing.pack(frame(rows, clash=True)).collect()
    seqs = defaultdict(list)
    for r in out:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for k, pieces in seqs.items():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:], strict=False))
        total = sum(n for _, n in pieces)
        assert total == 2048 or k == max(seqs) and total < 2048
    assert sorted(seqs) == list(range(len(seqs)))
    # Each row's pieces, put together again, are its ids: pieces are matched by their checksums.
    want = Counter()
    for key, n in ids.items():
        want[(key[0], len(key) - 1)] += n
    whole = Counter()
    for r in out:
        if r["start"] == 0:
            whole[(r["doc_id"], r["doc_tokens"])] += 1
    assert whole == want
    spans = defaultdict(list)
    for r in out:
        spans[(r["doc_id"], r["doc_tokens"])].append(r)
    for key, n in ids.items():
        mine = spans[(key[0], len(key) - 1)]
        if n == 1 and want[(key[0], len(key) - 1)] == 1:
            mine = sorted(mine, key=lambda r: r["start"])
            at = 0
            for r in mine:
                assert r["start"] == at
                part = np.array(key[1:], "<u4")[at : at + r["length"]]
                assert zlib.crc32(part.tobytes()) == r["ids_crc32"]
                at += r["length"]
            assert at == len(key) - 1


# -- op7 --------------------------------------------------------------------------------------


def test_licences(frame):
    cases = {
        "Released under the MIT License.": "mit", "filler words here\nLicensed under the Apache License, Version 2.0.\nmore": "apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0",
        "SPDX-License-Identifier: BSD-3-Clause": "bsd", "Licensed under CC BY 4.0.": "cc-by", "Licensed under CC BY-SA 4.0.": "cc-by-sa", "No part of this publication may be reproduced without prior written permission; all rights reserved.": "proprietary",
        "He renewed his driver's license last week.": "", "The Apache people lived here.": "", "": "", "nothing at all": "",
    }
    rows = rows_of([*cases, None, "word " * 4000 + "\nReleased under the MIT License.\n" + "word " * 4000])
    out = {r["doc_id"]: r for r in licenses.scan_licenses(frame(rows, clash=True)).collect()}
    assert len(out) == len(rows)
    for i, (text, family) in enumerate(cases.items()):
        assert out[i]["families"] == family, (text, out[i])
    assert out[len(cases)]["families"] == "" and out[len(cases) + 1]["families"] == "mit"


def brute_licences(text):
    """(n_licence, n_unknown, families) by the model's weights in Python."""
    classes, weights, bias, least = licenses.trained()
    n_sure = n_unknown = 0
    families, best = set(), 0.0
    for body in re.split(licenses.BLANK_LINE, text or ""):
        lines = [x for x in re.split(r"[\r\n]+", body) if x]
        found = []
        for unit in [body, *lines] if len(lines) > 1 else [body]:
            p = licenses.probabilities(unit, weights, bias)
            k = int(p.argmax())
            if k and 1 - p[0] >= least:
                pairs = {g for g in licenses.grams_of(licenses.words_of(unit)) if g.count(" ") == 1}
                own = [{g for g in licenses.grams_of(licenses.words_of(t)) if g.count(" ") == 1} for t in licenses.TEMPLATES[classes[k]]]
                sure = p[k] >= 0.5 * (1 - p[0]) and max(len(pairs & o) / len(o) for o in own) >= licenses.CONFIRM
                found.append((sure, classes[k], p[k]))
        if any(x[0] for x in found):
            names = {x[1] for x in found if x[0]}
            families |= names
            n_sure += len(names)
            best = max(best, *(x[2] for x in found if x[0]))
        elif found:
            n_unknown += 1
    return n_sure, n_unknown, ",".join(sorted(families)), best


WRAPPED = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:",
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "gpl-2.0": "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.",
}


def test_wrapped_notices_are_found(frame):
    texts = [f"Some words before.\n\n{t}\n\nAnd some after." for t in WRAPPED.values()] + list(WRAPPED.values()) + ["\r\n".join(t.split("\n")) for t in WRAPPED.values()]
    out = {r["doc_id"]: r["families"] for r in licenses.scan_licenses(frame(rows_of(texts))).collect()}
    assert [out[i] for i in range(len(texts))] == 3 * list(WRAPPED)


def test_notices_of_no_known_family_are_unknown(frame):
    texts = ["Licensed under terms that were never published.", "Released under a custom license.", "Licensed under the Frob Public License, version 7."]
    out = licenses.scan_licenses(frame(rows_of(texts))).collect()
    assert [(r["n_licence"], r["n_unknown"]) for r in out] == [(0, 1)] * 3


def test_licences_equal_brute_force(spark, sf, frame, awkward_rows):
    texts = [t for ts in licenses.TEMPLATES.values() for t in ts] + licenses.LOOK_ALIKE + ["two notices\nReleased under the MIT License.\nLicensed under CC BY 4.0.\n\n \n\nLicensed under the GPLv3. \n\n\nLicensed under the Frob License."]
    rows = awkward_rows + rows_of(texts, first=1000)
    want = Counter((r[0], *brute_licences(r[1])[:3]) for r in rows)
    out = licenses.scan_licenses(frame(rows, clash=True)).collect()
    assert Counter((r["doc_id"], r["n_licence"], r["n_unknown"], r["families"]) for r in out) == want
    docs = {r["doc_id"]: brute_licences(r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in licenses.op7(spark, sf).collect():
        assert (r["n_licence"], r["n_unknown"], r["families"]) == docs[r["doc_id"]][:3] and abs(r["score"] - docs[r["doc_id"]][3]) < 1e-3
    assert sum(x[0] > 0 for x in docs.values()) > 3 and sum(x[1] > 0 for x in docs.values()) < 0.05 * len(docs)


# -- pipeline ---------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = {"input": {r["doc_id"]: r["text"] for r in docs.collect()}}
    for name, stage in cp.STAGES:
        docs = cp.materialise(stage(spark, docs, sf))
        if name != "packing":
            assert docs.columns == columns
            kept[name] = docs.collect()
    ids = {k: [r["doc_id"] for r in v] for k, v in kept.items() if k != "input"}
    assert set(ids["language"]) <= set(kept["input"]) and len(ids["language"]) > 0.95 * len(kept["input"])
    bare = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    assert len(ids["exact_dedup"]) == len({bare(r["text"]) for r in kept["language"]}) == len({bare(r["text"]) for r in kept["exact_dedup"]})
    from tests.llm.test_dedup_rows import brute_groups

    comps = brute_groups([r["text"] for r in kept["exact_dedup"]])
    least = {}
    for c, r in zip(comps, kept["exact_dedup"], strict=True):
        least[c] = min(least.get(c, r["doc_id"]), r["doc_id"])
    assert sorted(ids["near_dedup"]) == sorted(least.values())
    n = lambda t: len(WORDS.findall(t or ""))
    sizes, took = Counter(), Counter()
    for r in kept["near_dedup"]:
        sizes[r["source"]] += n(r["text"])
    for r in kept["mixing"]:
        took[r["source"]] += n(r["text"])
    for k, v in brute_targets(dict(sizes)).items():
        assert abs(took[k] - v) <= 1
    pieces = docs.collect()
    assert Counter(r["doc_id"] for r in pieces if r["start"] == 0) == Counter(ids["mixing"])
    assert sum(r["length"] for r in pieces) == sum(r["doc_tokens"] for r in pieces if r["start"] == 0)
