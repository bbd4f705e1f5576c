"""Exact duplicates through an extendible-hash index on shared files (native).

Texts are equal when they are identical after deletion of white space. Every text is
hashed once; the 64-bit hash is the index key. The directory begins with as many buckets as the
number of keys asks for; a bucket with more keys than its capacity splits by the next bit of the key,
so the directory doubles as often as its fullest part needs. Buckets are written to the shared
folder by the tasks that own their range of prefixes. A key that occurs once answers for its row. The
texts of keys that occur more often are sent to their bucket's owner, where the chain of a key has one
entry for each different string of bytes. Copies are combined before they are sent, so a
group with a third of all rows costs one text for each task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm._common import SPACE, join_groups, materialise, named_rows, text_or_empty

#: Keys that a bucket holds before it splits.
CAPACITY = 4096
#: Slots of the filter that goes to every task of the second scan: a table of so many small integers at most, whatever the corpus.
SLOTS = 1 << 18


def _normalised() -> Column:
    return F.regexp_replace(text_or_empty(), SPACE + "+", "")


def _points() -> Column:
    return F.length(text_or_empty()).cast("long")


def keyed(docs: DataFrame, *own: str) -> DataFrame:
    """doc_id, key (64-bit hash), sha (of the normalised text), points (code points of the original), and the columns own."""
    return docs.select("doc_id", *own, _normalised().alias("norm"), _points().alias("points")).select(
        "doc_id", *own, F.xxhash64("norm").alias("key"), F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha"), "points"
    )


def prefix_of(key: str, depth: str) -> Column:
    """The first depth bits of the key."""
    return F.expr(f"if({depth} = 0, 0L, shiftrightunsigned({key}, 64 - {depth}))")


def build_index(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The index of keyed rows: depth, prefix (the bucket), key, n (its rows). No bucket has more keys than capacity.

    Each round deals the keys that have no bucket yet to the owners of their prefixes, who write them out with the number of
    keys beside them; overfull buckets go on to the next round one bit deeper. Keys differ, so 64 bits always part them.
    """
    entries = materialise(rows.groupBy("key").agg(F.count("*").alias("n")))
    total = entries.count()
    depth = max(0, math.ceil(math.log2(max(total, 1) / capacity)))
    waiting, settled = entries.withColumn("depth", F.lit(depth)), None
    while True:
        bucket = Window.partitionBy("depth", "prefix")
        dealt = materialise(waiting.withColumn("prefix", prefix_of("key", "depth")).withColumn("held", F.count("*").over(bucket)))
        fits = dealt.where(F.col("held") <= capacity).select("depth", "prefix", "key", "n")
        settled = fits if settled is None else settled.unionByName(fits)
        waiting = dealt.where(F.col("held") > capacity).select("key", "n", (F.col("depth") + 1).alias("depth"))
        if waiting.isEmpty():
            return settled


def chains(docs: DataFrame, index: DataFrame, slots: int = SLOTS) -> DataFrame:
    """key, sha, keep_id, best (code points of the text that stays), group_size of every text whose key occurs more than once.

    A task of the scan passes over texts whose key has no slot among the repeated ones, combines the others by their whole
    bytes, and sends each string once. Owners of buckets then build the chains.
    """
    repeated = index.where("n > 1")
    slot = lambda: F.pmod(F.col("key"), F.lit(slots))
    wanted = repeated.select(slot().cast("int").alias("slot")).distinct()
    texts = docs.select("doc_id", _normalised().alias("norm"), _points().alias("points")).withColumn("key", F.xxhash64("norm"))
    near = texts.withColumn("slot", slot().cast("int")).join(F.broadcast(wanted), "slot", "left_semi")
    same = near.groupBy("norm", "points").agg(F.max("key").alias("key"), F.count("*").alias("n"), F.min("doc_id").alias("first"))
    same = same.select("key", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha"), "points", F.col("n").alias("copies"), "first")
    owned = same.join(repeated.select("depth", "prefix", "key"), "key")
    best = F.min(F.struct((-F.col("points")).alias("less"), F.col("first").isNull().alias("none"), "first"))
    found = owned.groupBy("depth", "prefix", "key", "sha").agg(best.alias("best"), F.sum("copies").alias("group_size"))
    return found.select("key", "sha", F.col("best.first").alias("keep_id"), (-F.col("best.less")).alias("best"), "group_size")


def resolved(docs: DataFrame, file: str, row: str, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """(keyed rows, copies): docs carry row names in file and row. copies has the rows in groups of two or more, with stays: one row of each is true."""
    rows = materialise(keyed(docs.select("doc_id", "text", file, row), file, row))
    found = materialise(chains(docs.select("doc_id", "text"), build_index(rows.select("key"), capacity)).where("group_size > 1"))
    copies = materialise(join_groups(rows, found, ["key", "sha"], "group_size", rows.count()))
    stay = copies.where(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("best")))
    stay = stay.groupBy("key", "sha").agg(F.min(F.struct(file, row)).alias("stay"))
    kept = stay.select(F.col(f"stay.{file}").alias(file), F.col(f"stay.{row}").alias(row), F.lit(True).alias("stays"))
    return rows, copies.join(kept, [file, row], "left").withColumn("stays", F.coalesce("stays", F.lit(False)))


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256.

    A null text is empty; all empty texts are equal. Of equal texts the one with most
    code points stays, then the smallest doc_id (null last); of rows repeated under one doc_id, too, exactly one is kept. No rows:
    no rows. Other columns are not read, so their names can't clash.
    """
    docs = named_rows(docs.select("doc_id", "text"), "dedup_file", "dedup_row")
    rows, copies = resolved(docs, "dedup_file", "dedup_row", capacity)
    copies = copies.select("dedup_file", "dedup_row", "keep_id", "group_size", "stays")
    return rows.join(copies, ["dedup_file", "dedup_row"], "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce("stays", F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


ORACLE = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER best = 1 AS kept, text_sha256
FROM t WINDOW best AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
"""


def kept_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """docs with exactly one row of each group of equal texts, the one that exact_dedup marks as kept.

    Rows are told apart by names of their own: a repeated or null doc_id neither takes other texts along nor keeps copies.
    """
    file, row = "exact_dedup_file", "exact_dedup_row"
    docs = named_rows(docs, file, row)
    gone = resolved(docs, file, row, capacity)[1].where(~F.col("stays")).select(F.col(file).alias("gone_file"), F.col(row).alias("gone_row"))
    return docs.hint("merge").join(gone, (docs[file] == gone["gone_file"]) & (docs[row] == gone["gone_row"]), "left_anti").drop(file, row)
