"""Placement by a hierarchical weighted hash tree (DataFrame expressions only).

Every node of the tree region > rack > shard has a weight, the sum of its leaves.
A key descends from the root; at each level every child draws -ln(u) / weight from a
hash of (key, child) and the smallest draw wins, so a child gets its share by
weight. A changed weight alters only that child's draw: rows move into or out of that
subtree alone. Placement needs no shuffle; gapless slots take two levels of counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm._common import bucket_of, documents, materialise, root_of, text_or_empty


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def tree(shards: list[Shard]) -> dict:
    """Nested {name: (weight, children or shard)}."""
    regions: dict = {}
    for x in shards:
        regions.setdefault(x.region, {}).setdefault(x.rack, {})[x.shard] = (x.weight, x.shard)
    weigh = lambda kids: sum(w for w, _ in kids.values())
    racks = {r: {k: (weigh(v), v) for k, v in sub.items()} for r, sub in regions.items()}
    return {r: (weigh(sub), sub) for r, sub in racks.items()}


def standard(count: int, first: int = 8) -> list[Shard]:
    """Two shards to a rack and two racks to a region for the first shards; each later shard is a region of its own.

    So growth by one adds a subtree and changes no other weight: rows move only into the new shard.
    """
    return [Shard(f"r{i // 4}", f"k{i // 2}", i) if i < first else Shard(f"r+{i}", f"k+{i}", i) for i in range(count)]


def _draw(key: Column, node: str, weight: float) -> Column:
    unit = (F.shiftrightunsigned(F.xxhash64(key, F.lit(node)), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(unit) / F.lit(float(weight))


def place(key: Column, shards: list[Shard]) -> Column:
    """The shard of a key. Shards of weight 0 or less get none; a null key is a key like any other."""

    def descend(level: dict, path: str) -> Column:
        level = {k: v for k, v in level.items() if v[0] > 0}
        if not level:
            raise ValueError("the tree has no shard of positive weight")
        if len(level) == 1:
            ((name, (_, below)),) = level.items()
            return descend(below, f"{path}/{name}") if isinstance(below, dict) else F.lit(below)
        best = F.array_min(F.array(*[F.struct(_draw(key, f"{path}/{name}", w).alias("draw"), F.lit(i).alias("child")) for i, (name, (w, _)) in enumerate(level.items())]))["child"]
        out = None
        for i, (name, (_, below)) in enumerate(level.items()):
            value = descend(below, f"{path}/{name}") if isinstance(below, dict) else F.lit(below)
            out = F.when(best == i, value) if out is None else out.when(best == i, value)
        return out

    return descend(tree(shards), "").cast("int")


def shard_documents(docs: DataFrame, shards: list[Shard], grown: list[Shard] | None = None) -> DataFrame:
    """doc_id, size (bytes + 1), text_crc32, law, shard, slot, grown_shard of every row.

    A null or empty text has size 1 and checksum 0. Rows with one doc_id share a shard
    and have slots of their own; a null doc_id is placed like any key. Slots count from 0
    without gaps: rows are numbered within (shard, hash bucket), about the square root of
    the rows to each, and buckets are then offset. Columns besides doc_id and text are not read.
    """
    size = (F.octet_length(text_or_empty()) + F.lit(1)).cast("long")
    rows = docs.select("doc_id", size.alias("size"), F.crc32(text_or_empty().cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("shard", place(F.col("doc_id"), shards))
    rows = rows.withColumn("grown_shard", place(F.col("doc_id"), grown) if grown else F.lit(None).cast("int"))
    rows = materialise(rows)
    buckets = root_of(rows.count())
    rows = rows.withColumn("bucket", bucket_of(F.col("doc_id"), buckets))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")
    rows = rows.withColumn("at", F.row_number().over(within)).join(counts, ["shard", "bucket"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("at") - 1).cast("long").alias("slot"), "grown_shard")


def op10(spark, sf_dir):
    return shard_documents(documents(spark, sf_dir), standard(8), standard(9))
