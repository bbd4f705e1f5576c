"""op1, op2, op4, op8, op9 and op10 against brute force on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
import xxhash

from quire.llm import exact_dedup, fingerprints, queries, secrets, sharding, simhash_dedup, substring_dedup
from tests.llm.conftest import rows_of

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = re.compile(r"[\x20\x09-\x0D]")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def got(df):
    return Counter(tuple(r) for r in df.collect())


# -- op1 --------------------------------------------------------------------------------------


def brute_substrings(rows, window=35):
    words = [WORDS.findall(r[1] or "") for r in rows]
    seen = Counter(tuple(ws[i : i + window]) for ws in words for i in range(len(ws) - window + 1))
    out = Counter()
    for r, ws in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(ws) - window + 1):
            if seen[tuple(ws[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out[(r[0], len(ws), len(gone), sha(" ".join(w for i, w in enumerate(ws) if i not in gone)))] += 1
    return out


@pytest.mark.parametrize("crowd", [1, 256])
def test_substrings(frame, awkward_rows, crowd):
    assert got(substring_dedup.substring_dedup(frame(awkward_rows, clash=True), crowd=crowd).drop("kept_text")) == brute_substrings(awkward_rows)


@pytest.mark.parametrize("seed", range(3))
def test_substrings_of_few_words(frame, seed):
    """Small alphabets repeat inside one text, with every period."""
    rng = random.Random(seed)
    texts = ["a " * rng.randrange(30, 80), "a b " * 30, "a b c " * 30] + [" ".join(rng.choice("ab") for _ in range(rng.randrange(20, 300))) for _ in range(20)]
    block = [rng.choice("xyzuvw") * 3 for _ in range(60)]
    for _ in range(30):
        i, j = sorted(rng.sample(range(61), 2))
        texts.append(" ".join([*(rng.choice("pqrs") for _ in range(rng.randrange(9))), *block[i:j], *(rng.choice("pqrs") for _ in range(rng.randrange(9)))]))
    rows = rows_of(texts)
    assert got(substring_dedup.substring_dedup(frame(rows), crowd=8).drop("kept_text")) == brute_substrings(rows)


def test_kept_text_is_what_was_hashed(frame, awkward_rows):
    for r in substring_dedup.substring_dedup(frame(awkward_rows)).collect():
        assert sha(r["kept_text"]) == r["kept_sha256"]


def test_fm_index_counts_occurrences():
    import numpy as np

    rng = np.random.default_rng(0)
    text = rng.integers(1, 4, 200)
    text[::17] = 0
    index = substring_dedup.FMIndex(text.astype(np.int64), 6)
    lasts = np.array([i for i in range(5, 200) if (text[i - 5 : i + 1] > 0).all()])
    found = index.matching(text.astype(np.int64), lasts, 6)
    for last, n in zip(lasts, found, strict=True):
        best = 0
        for k in range(1, 7):
            piece = tuple(text[last - k + 1 : last + 1])
            if sum(tuple(text[i : i + k]) == piece for i in range(200 - k + 1)) >= 2:
                best = k
            else:
                break
        assert n == best


# -- op2 --------------------------------------------------------------------------------------


def brute_fingerprint_bits(text, of):
    """The votes by Python over the operator's own term hashes (of: text -> [(h0, h1, w)])."""
    total, sums = 0, [0] * 128
    for h0, h1, w in of(text):
        total += w
        for k in range(64):
            sums[k] += w * (h0 >> k & 1)
            sums[64 + k] += w * (h1 >> k & 1)
    bits = [2 * s > total for s in sums]
    return sum(b << k for k, b in enumerate(bits[:64])), sum(b << k for k, b in enumerate(bits[64:]))


def _xx(data: bytes, seed):
    return xxhash.xxh64_intdigest(data, seed=seed & (2**64 - 1))


def _xx_long(x, seed):
    return _xx((x & (2**64 - 1)).to_bytes(8, "little"), seed)


def _terms(text):
    """Spark's xxhash64 of a string is XXH64 with seed 42; of several columns the hash so far is the next seed."""
    ws = WORDS.findall(text)
    hs = [_xx(w.encode(), 42) for w in ws]
    out = []
    for i, w in enumerate(ws):
        h = _xx_long(hs[i], 42)
        if i + 1 < len(ws):
            h = _xx_long(hs[i + 1], h)
        h1 = _xx((1).to_bytes(4, "little"), _xx_long(h, 42))
        out.append((h, h1, 2 if len(w.encode()) > 3 else 1))
    return out


def test_fingerprints(frame, awkward_rows):
    found = fingerprints.fingerprints(frame(awkward_rows, clash=True)).collect()
    order = sorted(awkward_rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = Counter()
    print_of = lambda t: "%016x%016x" % brute_fingerprint_bits(t, _terms)
    for i, r in enumerate(order):
        text, ahead = r[1] or "", order[(i + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + ahead[:third]
        want[(r[0], len(text), sha(edited), print_of(text), print_of(edited))] += 1
    assert Counter(tuple(r)[:5] for r in found) == want
    bits = [int(r["fingerprint"], 16) for r in found]
    for r, x in zip(found, bits, strict=True):
        near = sum((x ^ y).bit_count() <= 3 for y in bits) - 1
        assert r["n_near"] == (near if r["doc_id"] is not None and r["doc_id"] % 20 == 0 else None)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)


def test_fingerprints_tell_edits_from_strangers(spark):
    rows = fingerprints.op2(spark, "/root/testdata/sf0.01").where("n_chars > 400").collect()
    edited, ahead = [r["near_edited"] for r in rows], [r["near_next"] for r in rows]
    assert sorted(edited)[len(edited) // 20] > sorted(ahead)[len(ahead) // 2]
    assert sum(edited) / len(edited) > 0.6 > sum(ahead) / len(ahead) + 0.15


def test_block_tables_find_every_near_fingerprint(spark):
    rng = random.Random(3)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    base = [rng.getrandbits(128) for _ in range(40)]
    all_fps = set(base)
    for b in base:
        for k in (1, 2, 3, 4):
            x = b
            for bit in rng.sample(range(128), k):
                x ^= 1 << bit
            all_fps.add(x)
    halves = lambda x: (signed(x & (2**64 - 1)), signed(x >> 64))
    fps = spark.createDataFrame([halves(x) for x in all_fps], "f0 long, f1 long")
    q = spark.createDataFrame([halves(x) for x in base], "f0 long, f1 long")
    name = lambda x: "%016x%016x" % (x & (2**64 - 1), x >> 64)
    want = {(name(a), name(b), (a ^ b).bit_count()) for a in base for b in all_fps if (a ^ b).bit_count() <= 3}
    assert {tuple(r) for r in fingerprints.near_fingerprints(fps, q).collect()} == want
    times = {x: 1 + i % 3 for i, x in enumerate(sorted(all_fps))}
    counted = spark.createDataFrame([(*halves(x), n, x in base) for x, n in times.items()], "f0 long, f1 long, n long, asks boolean")
    totals = {(halves(a)): sum(times[b] for b in all_fps if (a ^ b).bit_count() <= 3) for a in base}
    for listed in (2, 1024):
        assert {(r["q0"], r["q1"]): r["n_near"] for r in fingerprints.near_counts(counted, listed=listed).collect()} == totals


def test_fingerprints_of_text_ids(spark):
    rows = [(f"id{i // 2:03d}", f"some words of row {i}") for i in range(50)] + [(None, "no id"), ("", "empty id")]
    found = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id string, text string").repartition(3)).collect()
    order = sorted(rows, key=lambda r: r[1])
    order = sorted([r for r in order if r[0] is not None], key=lambda r: r[0], reverse=True) + [r for r in order if r[0] is None]
    want = Counter()
    for i, r in enumerate(order):
        third = len(r[1]) // 3
        want[r[0], sha(r[1][: len(r[1]) - third] + order[(i + 1) % len(order)][1][:third])] += 1
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in found) == want


# -- op4 --------------------------------------------------------------------------------------

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_base(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def entropy(s):
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())


def known(s):
    """Strings of the allow-list, by rules of its own."""
    parts = re.split("[-_/+]", s)
    if not re.search("[A-Za-z]", s) or len(set(s)) == 1 or s.endswith(("EXAMPLE", "EXAMPLEKEY")):
        return True
    if all(p.isalpha() or p.isdigit() and len(p) < 5 for p in parts):
        return True
    rest = s
    while rest.startswith(("0123456789", "abcdef", "ABCDEF")):
        rest = rest[10 if rest[0] == "0" else 6 :]
    return not rest


def brute_entropy(text, base):
    out = []
    for chars, bits in secrets.CLASSES:
        own = []
        for m in re.finditer(rf"[{chars}]+", text):
            s = m[0]
            if len(s) < 20 or not re.search("[0-9]", s) or not re.search("[A-Za-z]", s) or known(s):
                continue
            runs = []
            for i in range(len(s) - 19):
                if entropy(s[i : i + 20]) >= bits - 1e-9:
                    if runs and runs[-1][1] >= i - 1:
                        runs[-1][1] = i + 19
                    else:
                        runs.append([i, i + 19])
            own += [(m.start() + a, 3, m.start() + b + 1) for a, b in runs]
        apart = lambda xs, others: [x for x in xs if not any(b[0] < x[2] and x[0] < b[2] for b in others)]
        out += apart(apart(own, base), out)
    return out


def line(spans):
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def secret_rows():
    rng = random.Random(5)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    rand = lambda n, alphabet=b64: "".join(rng.choice(alphabet) for _ in range(n))
    texts = [
        None, "", "password: hunter", "password=hunter2", 'PassWord" : "abc123def', "𝒳𝒳 token= a.b/c=d-e_f token:short", "api_key=123456apikey:abcdefg", "AKIA" + "A" * 15, "AKIAAKIA" + "Q1" * 10,
        "AKIA" + rand(16, "ABCDEFGH01234567"), "é" * 5 + rand(24, "0123456789abcdef"), rand(23, "0123456789abcdef"), "secret secret=secret=secretsecret", "paſſword=abcdefgh", "toKen=abcdefgh",
        "see " + rand(40) + " and " + rand(30, "0123456789ABCDEF") + ".", "1234567890" * 4, "some-long-path/with_words/and-more", "aaaaaaaaaaaaaaaaaaaaaaaa1", "x" * 5000 + rand(64) + "y" * 5000,
        "2024-01-01-2025-02-02-rest-of-name", "abcdef0123456789" * 3, rand(20), rand(19), "EXAMPLE" + rand(30), rand(30) + "EXAMPLE", "x abcdef9Kq3ZpLw81TnVbR7yUeX2 y", "x " + rand(24) + "a" * 50 + rand(24) + " y", "\n".join(f"token = {rand(12)}" for _ in range(300)),
        "password:   'x'  password==''abcdefgh", "key AKIA" + rand(20, "ABCDEF0123456789") + rand(30, "0123456789abcdef"),
    ]
    return rows_of(texts) + rows_of(texts[2:4], first=2)


def test_secrets(frame, awkward_rows):
    rows = secret_rows() + awkward_rows
    want = Counter()
    for r in rows:
        text = r[1] or ""
        base = brute_base(text)
        count = Counter(k for _, k, _ in base)
        more = brute_entropy(text, base)
        want[(r[0], count[0], count[1], count[2], sha(line(base)), line(base + more), len(more))] += 1
    assert got(secrets.scan_secrets(frame(rows, clash=True))) == want


def test_secrets_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: line(brute_base(r["text"])) for r in docs}
    for r in secrets.op4(spark, sf).collect():
        assert r["base_sha256"] == sha(want[r["doc_id"]])
        assert set(filter(None, want[r["doc_id"]].split(","))) <= set(filter(None, r["spans"].split(",")))


# -- op8 --------------------------------------------------------------------------------------


def brute_simhash(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = WORDS.findall(low)
    grams = [" ".join(ws[i : i + 3]) for i in range(max(len(ws) - 2, min(1, len(ws))))]
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum((2 * sum(h >> k & 1 for h in hs) > len(hs)) << k for k in range(64))


def brute_components(rows, fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        ids[find(i)].append(r[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return [least[find(i)] for i in range(len(rows))]


def near_rows(n=60):
    rng = random.Random(9)
    texts = []
    for _ in range(n // 6):
        ws = [rng.choice("abcdefghij") + str(rng.randrange(300)) for _ in range(rng.randrange(5, 400))]
        for _ in range(6):
            vs = list(ws)
            for _ in range(rng.randrange(3)):
                vs[rng.randrange(len(vs))] = "Changed"
            texts.append(" ".join(vs))
    return rows_of(texts, first=1000)


def test_simhash(frame, awkward_rows):
    rows = awkward_rows + near_rows()
    fps = [brute_simhash(r[1]) for r in rows]
    want = Counter((r[0], f"{fp:016x}", c) for r, fp, c in zip(rows, fps, brute_components(rows, fps), strict=True))
    assert got(simhash_dedup.near_dedup(frame(rows, clash=True))) == want


@pytest.mark.parametrize("limit", [1, 4, 512])
def test_near_links_lose_nothing(spark, limit):
    rng = random.Random(11)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for x in list(fps)[:25]:  # chains of up to six steps of one to three bits
        for _ in range(rng.randrange(7)):
            for bit in rng.sample(range(64), rng.choice([1, 2, 2, 3])):
                x ^= 1 << bit
            fps.add(x)
    fps |= {0, 1, 3, 1 << 63, 2**64 - 1}
    fps = sorted(fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    links = simhash_dedup.near_links(spark.createDataFrame([(signed(x),) for x in fps], "fp long").repartition(3), limit)
    pairs = [(r["a"] % 2**64, r["b"] % 2**64) for r in links.collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in pairs)
    number = {x: i for i, x in enumerate(fps)}
    rows = [(i,) for i in range(len(fps))]
    want = brute_components(rows, fps)
    parent = list(range(len(fps)))
    for _ in range(len(fps)):
        for a, b in pairs:
            low = min(parent[number[a]], parent[number[b]])
            parent[number[a]] = parent[number[b]] = low
    assert parent == want


# -- op9 --------------------------------------------------------------------------------------


def test_exact_dedup(frame, awkward_rows):
    groups = defaultdict(list)
    for r in awkward_rows:
        groups[SPACE.sub("", r[1] or "")].append(r)
    want = Counter()
    for norm, rows in groups.items():
        rows.sort(key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        for i, r in enumerate(rows):
            want[(r[0], rows[0][0], len(rows), i == 0, sha(norm))] += 1
    assert got(exact_dedup.exact_dedup(frame(awkward_rows, clash=True))) == want


@pytest.mark.parametrize("capacity", [1, 40])
def test_index_splits_until_every_bucket_fits(spark, capacity):
    # Small integers as keys share their first fifty bits: the directory has to double far beyond its first size.
    n = 5000 if capacity > 1 else 200
    rows = spark.range(n).selectExpr("xxhash64(id) as key").unionByName(spark.range(300).selectExpr("id as key")).unionByName(spark.range(50).selectExpr("id as key"))
    index = exact_dedup.build_index(rows, capacity).collect()
    keys = Counter(r["key"] for r in rows.collect())
    assert {r["key"]: r["n"] for r in index} == keys and len(index) == len(keys)
    buckets = defaultdict(set)
    for r in index:
        assert (r["key"] % 2**64) >> (64 - r["depth"]) == r["prefix"] % 2**64 if r["depth"] else r["prefix"] == 0
        buckets[r["depth"], r["prefix"]].add(r["key"])
    assert max(map(len, buckets.values())) <= capacity and max(r["depth"] for r in index) > 50
    # A bucket is no deeper than it has to be: its parent was overfull, or it is as deep as the directory began.
    first = min(r["depth"] for r in index)
    for depth, prefix in buckets:
        inside = sum((k % 2**64) >> (65 - depth) == (prefix % 2**64) >> 1 for k in keys)
        assert depth == first or inside > capacity


@pytest.mark.parametrize("capacity", [1, 3, 4096])
def test_exact_dedup_keeps_one_row_of_each_text(frame, awkward_rows, capacity):
    rows = awkward_rows + [(1, "hello world", "en", "a", 1), (2, "hello world", "en", "a", 1), (2, "unique other text", "en", "a", 1), (5, "same row", "en", "a", 1), (5, "same row", "en", "a", 1)]
    out = exact_dedup.exact_dedup(frame(rows), capacity).collect()
    assert Counter(r["text_sha256"] for r in out if r["kept"]) == Counter({sha(SPACE.sub("", r[1] or "")) for r in rows})
    for r in out:
        if r["kept"]:
            assert r["doc_id"] == r["keep_id"]


def test_kept_documents_keep_one_of_each(frame, awkward_rows):
    rows = [r for r in awkward_rows if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    kept = exact_dedup.kept_documents(frame(rows)).collect()
    norms = [SPACE.sub("", r["text"] or "") for r in kept]
    assert len(norms) == len(set(norms)) == len({SPACE.sub("", r[1] or "") for r in rows})


# -- op10 -------------------------------------------------------------------------------------


def test_sharding(frame, awkward_rows):
    out = sharding.shard_documents(frame(awkward_rows, clash=True), sharding.standard(8), sharding.standard(9)).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in awkward_rows)
    assert Counter(tuple(r)[:3] for r in out) == want
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
        assert r["law"] == "key" and 0 <= r["shard"] < 8 and r["grown_shard"] in (r["shard"], 8)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert len({(r["doc_id"], r["shard"]) for r in out}) == len({r["doc_id"] for r in out})


def test_placement_follows_weights_and_moves_little(spark):
    from pyspark.sql import functions as F

    tree = [sharding.Shard(f"r{i // 4}", f"k{i // 2}", i, [1, 2, 1, 4, 1, 1, 1, 1][i]) for i in range(8)]
    heavier = [sharding.Shard(x.region, x.rack, x.shard, x.weight + (x.shard == 5)) for x in tree]
    rows = spark.range(24_000).select(sharding.place(F.col("id"), tree).alias("a"), sharding.place(F.col("id"), heavier).alias("b")).collect()
    count, total = Counter(r["a"] for r in rows), sum(x.weight for x in tree)
    for x in tree:
        assert abs(count[x.shard] / 24_000 - x.weight / total) < 0.02
    moved = [r for r in rows if r["a"] != r["b"]]
    # On each level rows only move into the child that holds shard 5: its region, its rack, itself.
    assert moved and all(r["b"] >= 4 for r in moved)
    assert all(r["b"] in (4, 5) for r in moved if r["a"] >= 4)
    assert all(r["b"] == 5 for r in moved if r["a"] in (4, 5))


# -- all --------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_no_rows(spark, folder, name):
    assert queries.QUERIES[name](spark, folder([])).collect() == []


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    found = queries.QUERIES[name](spark, sf)
    assert sorted(found.columns) == sorted(want.columns)
    assert got(found.select(*want.columns)) == Counter(map(tuple, want.fetchall()))
