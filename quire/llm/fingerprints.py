"""SimHash document fingerprints (native).

Terms are pairs of neighbouring words; a pair that begins with a longer word weighs twice. Every
occurrence votes with its weight on 128 signed bits. Votes are counted 32 bits apart, two
counters in a long, by ordinary sums, so the whole count is generated code with map-side combine.
Block tables find fingerprints within a radius: 128 bits are cut into blocks, each table
puts another choice of blocks first as its key, and two fingerprints that differ in no more bits than blocks are
left out agree on one key at least. In the query, fingerprints of every row whose id is divisible by QUERIES ask the tables of all rows:
members of a key are listed in lists of bounded length, and each asking fingerprint passes over the lists of its keys.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm._common import NOT_SPACE, documents, materialise, root_of, text_or_empty

BITS, RADIUS, BLOCKS = 128, 3, 5
#: Rows whose id is divisible by this ask for near fingerprints; most fingerprints that one list of a block key holds.
QUERIES, LISTED = 20, 1024
#: Ranges of ids at most: their bounds are literals in the plan. A range of more rows is sorted with spilling.
MOST_RANGES = 4096
_PAIR = (1 << 32) + 1


def terms(text: Column) -> Column:
    """array<struct<h1,h2,w>>: hashes and weight of each pair of neighbouring words (the last word stands alone)."""
    words = F.transform(F.regexp_extract_all(text, F.lit(NOT_SPACE), F.lit(0)), lambda w: F.struct(F.xxhash64(w).alias("h"), F.when(F.octet_length(w) > 3, 2).otherwise(1).alias("w")))

    def pairs(ws):
        return F.transform(ws, lambda x, i: F.struct(F.xxhash64(x["h"], F.get(ws, i + 1)["h"]).alias("h"), x["w"].cast("long").alias("w")))

    return F.get(F.transform(F.array(words), pairs), F.lit(0))


def vote(rows: DataFrame, keys: list[str], term: str = "term") -> DataFrame:
    """rows(keys, term struct<h,w>, null for no term) -> keys, f0, f1: the two halves of the fingerprint."""
    w = F.coalesce(F.col(f"{term}.w"), F.lit(0).cast("long"))
    flat = rows.select(*keys, F.coalesce(F.col(f"{term}.h"), F.lit(0).cast("long")).alias("h0"), F.xxhash64(F.col(f"{term}.h"), F.lit(1)).alias("h1"), w.alias("w"))
    lane = lambda h, k: (F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_PAIR)) * F.col("w"))
    sums = flat.groupBy(*keys).agg(F.sum("w").alias("total"), *[F.sum(lane(f"h{j}", k)).alias(f"s{j}_{k}") for j in (0, 1) for k in range(32)])

    def half(j: int) -> Column:
        low = [F.when(F.col(f"s{j}_{k}").bitwiseAND(F.lit((1 << 32) - 1)) * 2 > F.col("total"), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")) for k in range(32)]
        high = [F.when(F.shiftrightunsigned(f"s{j}_{k}", 32) * 2 > F.col("total"), F.lit((1 << (k + 32)) - (1 << 64 if k == 31 else 0)).cast("long")).otherwise(F.lit(0).cast("long")) for k in range(32)]
        out = low[0]
        for x in low[1:] + high:
            out = out.bitwiseOR(x)
        return out

    return sums.select(*keys, half(0).alias("f0"), half(1).alias("f1"))


def hex_of(a: str, b: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))


def distance(a0, a1, b0, b1) -> Column:
    return F.bit_count(F.col(a0).bitwiseXOR(F.col(b0))) + F.bit_count(F.col(a1).bitwiseXOR(F.col(b1)))


def likeness(bits: Column) -> Column:
    """The cosine that a share of differing bits stands for; 0 where it would be negative."""
    return F.greatest(F.lit(0.0), F.cos(F.lit(math.pi / BITS) * bits))


def block_keys(f0: Column, f1: Column, radius: int = RADIUS, blocks: int = BLOCKS) -> list[Column]:
    """One key for each table: the bits of blocks - radius chosen blocks."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]

    def masks(chosen) -> tuple[int, int]:
        bits = sum(((1 << edges[i + 1]) - (1 << edges[i])) for i in chosen)
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        return signed(bits & ((1 << 64) - 1)), signed(bits >> 64)

    out = []
    for chosen in combinations(range(blocks), blocks - radius):
        m0, m1 = masks(chosen)
        out.append(F.struct(f0.bitwiseAND(F.lit(m0)).alias("k0"), f1.bitwiseAND(F.lit(m1)).alias("k1")))
    return out


def near_fingerprints(fps: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """All (query, found, bits) within radius bits: queries(f0, f1) against fps(f0, f1), both distinct fingerprints.

    Every table is one equi-join on its key; all tables share one exchange.
    """
    def keyed(df: DataFrame, side: str) -> DataFrame:
        keys = block_keys(F.col("f0"), F.col("f1"), radius, blocks)
        return df.select(F.col("f0").alias(f"{side}0"), F.col("f1").alias(f"{side}1"), F.posexplode(F.array(*keys)).alias("t", "k")).withColumns({"k0": F.col("k.k0"), "k1": F.col("k.k1")}).drop("k")

    met = keyed(queries, "q").join(keyed(fps, "p"), ["t", "k0", "k1"]).withColumn("bits", distance("q0", "q1", "p0", "p1"))
    met = met.where(F.col("bits") <= radius).groupBy("q0", "q1", "p0", "p1").agg(F.min("bits").alias("bits"))
    return met.select(hex_of("q0", "q1").alias("query"), hex_of("p0", "p1").alias("found"), "bits")


def near_counts(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, listed: int = LISTED) -> DataFrame:
    """q0, q1, n_near of each asking fingerprint: rows within radius bits. fps(f0, f1, n, asks): distinct fingerprints, their rows, and whether they ask.

    A pair is counted in the first table in which it agrees, which is the one of its lowest equal blocks, so no pair is made into a row. A
    key with many members has many lists: an asking fingerprint passes over each of them, none is left out.
    """
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    keys = F.posexplode(F.array(*block_keys(F.col("f0"), F.col("f1"), radius, blocks))).alias("t", "k")
    members = fps.select("f0", "f1", "n", "asks", keys)
    # One exchange deals the members of a key; only keys of two fingerprints or more of which one asks go on.
    one = Window.partitionBy("t", "k")
    members = members.withColumns({"size": F.count("*").over(one), "asked": F.max("asks").over(one)}).where((F.col("size") > 1) & F.col("asked"))
    lists = members.withColumn("list", F.pmod(F.xxhash64("f0", "f1"), F.ceil(F.col("size") / listed)))
    lists = lists.groupBy("t", "k", "list").agg(F.collect_list(F.struct("f0", "f1", "n")).alias("members"))
    met = members.where("asks").select("t", "k", "f0", "f1").join(lists, ["t", "k"])

    def same(block: int, x0: Column, x1: Column) -> Column:
        bits = (1 << edges[block + 1]) - (1 << edges[block])
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        return (x0.bitwiseAND(F.lit(signed(bits & ((1 << 64) - 1)))) == 0) & (x1.bitwiseAND(F.lit(signed(bits >> 64))) == 0)

    def first_table(x0: Column, x1: Column) -> Column:
        out = F.lit(-1)
        for t, chosen in reversed(list(enumerate(combinations(range(blocks), blocks - radius)))):
            agrees = same(chosen[0], x0, x1)
            for b in chosen[1:]:
                agrees = agrees & same(b, x0, x1)
            out = F.when(agrees, t).otherwise(out)
        return out

    def add(total: Column, m: Column) -> Column:
        x0, x1 = m["f0"].bitwiseXOR(F.col("f0")), m["f1"].bitwiseXOR(F.col("f1"))
        bits = F.bit_count(x0) + F.bit_count(x1)
        near = (bits > 0) & (bits <= radius) & (first_table(x0, x1) == F.col("t"))
        return total + F.when(near, m["n"]).otherwise(F.lit(0).cast("long"))

    counts = met.select("f0", "f1", F.aggregate("members", F.lit(0).cast("long"), add).alias("near")).groupBy("f0", "f1").agg(F.sum("near").alias("near"))
    # Its own rows are counted here, since a key of one fingerprint has no list.
    own = fps.where("asks").select("f0", "f1", "n")
    return own.join(counts, ["f0", "f1"], "left").select(F.col("f0").alias("q0"), F.col("f1").alias("q1"), (F.coalesce("near", F.lit(0)) + F.col("n")).alias("n_near"))


def order_number(column: Column, kind: T.DataType) -> Column:
    """A long that never falls where the value rises: numbers themselves, else the first seven bytes of the text."""
    if isinstance(kind, T.NumericType):
        return F.floor(column).cast("long") if not isinstance(kind, T.IntegralType) else column.cast("long")
    head = F.substring(F.encode(column.cast("string"), "utf-8"), 1, 7)
    return F.conv(F.rpad(F.hex(head), 14, "0"), 16, 10).cast("long")


def range_bucket(column: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at or below the value (null: 0), in two steps of about the root of their number."""
    step = root_of(len(bounds))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    if not parts:
        return F.lit(0)
    low = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    top = F.size(F.filter(low([p[0] for p in parts]), lambda x: x <= column))
    inside = F.size(F.filter(F.get(F.array(*map(low, parts)), top - 1), lambda x: x <= column))
    return F.when(column.isNull() | (top == 0), 0).otherwise((top - 1) * step + inside).cast("int")


def with_next(docs: DataFrame) -> DataFrame:
    """at, doc_id, text, next_at, next_text: rows in descending doc_id (null last, ties by text); after the last row comes the first.

    Ids are cut at their quantiles into about as many ranges as a range has rows; texts are dealt once, by range. A
    range's last row takes the first row of the range below, found from ids alone.
    """
    number = order_number(F.col("doc_id"), docs.schema["doc_id"].dataType)
    rows = docs.select("doc_id", text_or_empty().alias("text"), number.alias("number"))
    n = rows.count()
    ranges = min(root_of(n), MOST_RANGES)
    shares = [i / ranges for i in range(1, ranges)]
    cuts = (rows.agg(F.percentile_approx("number", shares, max(10_000, 20 * ranges)).alias("q")).first()[0] if shares else None) or []
    rows = rows.withColumn("bucket", range_bucket(F.col("number"), sorted(set(cuts)))).drop("number")
    within = Window.partitionBy("bucket").orderBy(F.col("doc_id").desc_nulls_last(), "text")
    order = Window.orderBy(F.col("bucket").desc())
    # One row for each range: its largest id, and where the range above it goes on.
    heads = rows.groupBy("bucket").agg(F.max("doc_id").alias("head"))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select(
        F.lead("bucket").over(order).alias("nb"), F.lead("head").over(order).alias("nh"), F.first("bucket").over(whole).alias("fb"), F.first("head").over(whole).alias("fh"), F.col("bucket").alias("b")
    ).select("b", F.coalesce("nb", "fb").alias("nb"), F.when(F.col("nb").isNotNull(), F.col("nh")).otherwise(F.col("fh")).alias("nh"))
    # A head for each range: the square root of the rows, two integers each, so it may be sent to every task.
    firsts = rows.join(F.broadcast(heads), (F.col("bucket") == F.col("nb")) & F.col("doc_id").eqNullSafe(F.col("nh")))
    firsts = firsts.groupBy("b", "nb").agg(F.min("text").alias("head_text"))
    placed = rows.select("bucket", "doc_id", "text", F.row_number().over(within).alias("rn"), F.lead("text").over(within).alias("follows"))
    placed = placed.join(firsts, placed["bucket"] == firsts["b"], "left")
    last = F.col("follows").isNull()
    return placed.select(
        F.struct("bucket", "rn").alias("at"), "doc_id", "text",
        F.when(last, F.struct(F.col("nb").alias("bucket"), F.lit(1).alias("rn"))).otherwise(F.struct("bucket", (F.col("rn") + 1).alias("rn"))).alias("next_at"),
        F.when(last, F.col("head_text")).otherwise(F.col("follows")).alias("next_text"),
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near of every row.

    n_near: other rows whose fingerprint is within RADIUS bits, for rows whose id is divisible by QUERIES; else null. A null text is empty; a
    text without words has the fingerprint of no votes, all zero. Repeated rows are rows of their own. No rows: no
    rows. Columns besides doc_id and text are not read.
    """
    rows = with_next(docs)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    rows = rows.select("at", "next_at", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    keys = ["at", "next_at", "doc_id", "n_chars", "edited_sha256", "which"]
    both = rows.select("at", "next_at", "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.posexplode(F.array("text", "edited")).alias("which", "body"))
    votes = vote(both.select(*keys, F.explode_outer(terms(F.col("body"))).alias("term")), keys)
    pick = lambda which, f: F.max(F.when(F.col("which") == which, F.col(f)))
    prints = votes.groupBy(*keys[:-1]).agg(pick(0, "f0").alias("f0"), pick(0, "f1").alias("f1"), pick(1, "f0").alias("e0"), pick(1, "f1").alias("e1"))
    prints = materialise(prints)
    ahead = prints.select(F.col("at").alias("next_at"), F.col("f0").alias("n0"), F.col("f1").alias("n1"))
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        asks = F.coalesce(F.col("doc_id") % QUERIES == 0, F.lit(False))
    else:
        asks = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(QUERIES)) == 0, F.lit(False))
    counts = prints.groupBy("f0", "f1").agg(F.count("*").alias("n"), F.max(asks).alias("asks"))
    counts = materialise(counts)
    near = near_counts(counts)
    out = prints.join(ahead, "next_at").withColumn("asks", asks)
    # Only rows that ask move to their counts; fingerprints of copies are one row each, so no key is hot on that side.
    asking = out.where("asks").join(near, (F.col("f0") == F.col("q0")) & (F.col("f1") == F.col("q1"))).drop("q0", "q1")
    out = asking.unionByName(out.where(~F.col("asks")).withColumn("n_near", F.lit(None).cast("long")))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", hex_of("f0", "f1").alias("fingerprint"), hex_of("e0", "e1").alias("edited_fingerprint"),
        likeness(distance("f0", "f1", "e0", "e1")).alias("near_edited"), likeness(distance("f0", "f1", "n0", "n1")).alias("near_next"), (F.col("n_near") - 1).alias("n_near"),
    )


def op2(spark, sf_dir):
    return fingerprints(documents(spark, sf_dir))
