"""Mixing sources to target weights (native).

Each source's words, in a fixed order, are packed into blocks of a fixed length. The mix is written in output
shards of a fixed number of words; every shard draws how many words it takes of each source. The counts of a shard are a
low-variance multinomial draw: one uniform number for each shard cuts the running shares of the sources, so that a count has
the mean of the multinomial and is off by less than a word. What a source gives is the sum of its draws, up to the most passes over
it. A shard's words of a source are slots of that source's stream; slots are mapped to blocks by a pseudorandom permutation of the
source's block numbers (swap-or-not rounds, one permutation for each pass over the source), and blocks join documents by number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm._common import NOT_SPACE, bucket_of, materialise, named_rows, root_of, text_or_empty

#: Words in a block, slots in an output shard, passes over a source at most, weights by rank.
BLOCK, SHARD_SLOTS, PASSES, WEIGHTS, ROUNDS = 128, 8192, 3, (5.0, 2.0, 1.0), 24
#: Slots that one task makes.
TASK_SLOTS = 50_000


def word_count() -> Column:
    return F.regexp_count(text_or_empty(), F.lit(NOT_SPACE)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, passes: int = PASSES) -> DataFrame:
    """sizes(key, source_size) with target: shares by weight in key order, each at most passes times its size.

    The level L at which sum(min(weight * L, cap)) equals the sum of all sizes is found from running sums over
    sources ordered by cap / weight. The work is on one row for each source.
    """
    every = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("rank", F.row_number().over(every.orderBy("key")) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("rank") % len(weights) + 1))
    ranked = ranked.withColumn("cap", F.lit(float(passes)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    ordered = every.orderBy("ratio", "key")
    spent = F.coalesce(F.sum("cap").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(ordered.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(every) - spent) / rest
    found = ranked.withColumn("level", level).withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio") * (1 + 1e-12), F.col("level"))).over(every))
    return found.select("key", "source_size", F.least("cap", F.col("weight") * F.col("level")).alias("target"))


def permuted(index: Column, size: Column, seed: Column, inverse: bool = False) -> Column:
    """Swap-or-not permutation of 0..size-1, by seed; the inverse runs the rounds backwards."""
    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))

    def step(x, i):
        partner = F.pmod(F.pmod(F.xxhash64(seed, i), size) - x, size)
        swap = F.xxhash64(F.greatest(x, partner), seed, i).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, partner).otherwise(x)

    return F.aggregate(rounds, index.cast("long"), step)


def draws(sources: DataFrame, shard_words: int, seed: int = 0) -> DataFrame:
    """key, shard, begin, end: the words [begin, end) of its source's stream that an output shard takes.

    sources: key, source_size, target. All shards but the last have shard_words words. A shard's uniform number u cuts the running
    shares f of the sources, in key order: a source gets floor(n * f + u) - floor(n * f_before + u) of n words.
    """
    # One row for each source, then one for each source and shard.
    order = Window.partitionBy(F.lit(0)).orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(F.lit(0))
    s = sources.withColumn("all", F.sum("target").over(whole)).where("all > 0")
    s = s.withColumn("upto", F.least(F.lit(1.0), F.sum("target").over(order) / F.col("all"))).withColumn("before", F.lag("upto", 1, 0.0).over(whole.orderBy("key")))
    s = s.withColumn("upto", F.when(F.lead("key").over(whole.orderBy("key")).isNull(), 1.0).otherwise(F.col("upto")))
    s = s.withColumn("all", F.round("all").cast("long")).withColumn("shard", F.explode(F.expr(f"sequence(0L, (greatest(all, 1) - 1) div {shard_words})")))
    n = F.least(F.lit(shard_words), F.col("all") - F.col("shard") * shard_words)
    u = F.shiftrightunsigned(F.xxhash64("shard", F.lit(seed + 1)), 11) / F.lit(float(1 << 53))
    s = s.withColumn("count", (F.floor(n * F.col("upto") + u) - F.floor(n * F.col("before") + u)).cast("long"))
    so_far = Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("end", F.sum("count").over(so_far)).withColumn("most", F.lit(PASSES) * F.col("source_size"))
    return s.select("key", "source_size", "shard", F.least("most", F.col("end") - F.col("count")).alias("begin"), F.least("most", "end").alias("end"))


def mix_slots(sources: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """The slots of the mix: key, slot, out_shard, block, words (taken from the block's start).

    sources: key, source_size, target. A slot belongs to the shard that its first word was drawn for; the last slot of a source ends
    with the last word drawn.
    """
    s = materialise(draws(sources.where("source_size > 0"), shard_slots * block, seed))
    total = s.agg(F.sum(F.expr("end - begin"))).first()[0] or 0
    ends = s.groupBy("key").agg(F.max("end").alias("wanted"))
    s = s.where("end > begin").withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}"))
    s = s.withColumn("short", F.col("source_size") - (F.col("blocks") - 1) * block)
    # A draw is one small row before its slots are made, so the number of tasks is set by the slots and not by bytes.
    s = s.join(ends, "key").repartition(max(1, -(-total // (block * TASK_SLOTS))), "key", "shard")
    short_rank = lambda at: permuted(F.col("blocks") - 1, F.col("blocks"), F.xxhash64("key", at, F.lit(seed)), inverse=True)
    # The first slot that begins at or after a word of the stream; in each pass the short last block stands at a rank of its own.
    for name in ("begin", "end"):
        s = s.withColumns({"pass": F.expr(f"{name} div source_size"), "rest": F.expr(f"{name} % source_size")}).withColumn("short_rank", short_rank(F.col("pass")))
        late = F.col("rest") > F.col("short_rank") * block
        rank = F.expr(f"(rest + {block - 1}) div {block}")
        after = F.expr(f"(rest + {block} - short + {block - 1}) div {block}")
        s = s.withColumn(f"slot_{name}", F.col("pass") * F.col("blocks") + F.when(late, after).otherwise(rank))
    s = s.withColumns({"last_pass": F.expr("(wanted - 1) div source_size")}).withColumn("short_rank", short_rank(F.col("last_pass")))
    s = s.where("slot_end > slot_begin").withColumn("slot", F.explode(F.expr("sequence(slot_begin, slot_end - 1)")))
    s = s.withColumn("pass", F.expr("slot div blocks")).withColumn("rank", F.expr("slot % blocks"))
    s = s.withColumn("draw", F.xxhash64("key", "pass", F.lit(seed)))
    s = s.withColumn("block", permuted(F.col("rank"), F.col("blocks"), F.col("draw")))
    s = s.withColumn("length", F.when(F.col("block") == F.col("blocks") - 1, F.col("short")).otherwise(F.lit(block)))
    early = F.col("last_pass") * F.col("source_size") + F.col("rank") * block - F.when(F.col("short_rank") < F.col("rank"), block - F.col("short")).otherwise(F.lit(0))
    words = F.when(F.col("pass") < F.col("last_pass"), F.col("length")).otherwise(F.greatest(F.lit(0), F.least(F.col("length"), F.col("wanted") - early)))
    return s.withColumn("words", words).where("words > 0").select("key", "slot", F.col("shard").alias("out_shard"), "block", F.col("words").cast("long").alias("words"))


def sized(docs: DataFrame, *own: str) -> DataFrame:
    """doc_id, key (source, null last), size and the columns own of every row, on the shared folder."""
    key = F.when(F.col("source").isNull(), F.lit("b")).otherwise(F.concat(F.lit("a"), F.col("source")))
    return materialise(docs.select("doc_id", key.alias("key"), word_count().alias("size"), *own))


def pieces_of(rows: DataFrame, block: int, *own: str) -> DataFrame:
    """doc_id, key, size, start, own, block, lo, hi: every row with words, once for each block of its source that it stands in.

    start is the row's first word within its source; lo and hi bound its words within the block. Rows that are equal in
    doc_id, size and own may take each other's place.
    """
    buckets = root_of(rows.count())
    rows = rows.withColumn("bucket", bucket_of(F.col("doc_id"), buckets))
    sums = rows.groupBy("key", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("key", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("key", "bucket").orderBy("doc_id", "size", *own).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.where("size > 0").withColumn("start", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(sums, ["key", "bucket"]).select("doc_id", "key", "size", *own, (F.col("base") + F.col("start")).alias("start"))
    pieces = placed.withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
    pieces = pieces.withColumn("lo", F.greatest(F.lit(0), F.col("start") - F.col("block") * block))
    return pieces.withColumn("hi", F.least(F.lit(block), F.col("start") + F.col("size") - F.col("block") * block))


def uses_of(sources: DataFrame, block: int, seed: int) -> DataFrame:
    """key, block, uses (struct of words and shard): what each pass takes of a block, from its start, and for which output shard.

    A pass has one slot for each block and only the last one takes less than whole blocks, so falling order is theirs.
    """
    return mix_slots(sources, block, seed=seed).groupBy("key", "block").agg(F.sort_array(F.collect_list(F.struct("words", F.col("out_shard").alias("shard"))), asc=False).alias("uses"))


def sources_of(rows: DataFrame) -> DataFrame:
    return materialise(targets(rows.groupBy("key").agg(F.sum("size").alias("source_size"))))


def mix(docs: DataFrame, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, first_shard, last_shard of every row.

    taken counts words, repeats included; it is at most three times size, and a source's sum is what the output shards drew of it:
    within a word for each shard of its target. first_shard and last_shard bound the output shards that take of the row (null where none
    does). A null or wordless text has size 0 and nothing is taken; a null source is a source of its own and comes last. Repeated rows are documents of their own. Columns besides doc_id, text and source are not read.
    """
    rows = sized(docs.select("doc_id", "text", "source"))
    sources = sources_of(rows)
    pieces, uses = pieces_of(rows, block), uses_of(sources, block, seed)
    took = F.aggregate(F.col("uses"), F.lit(0).cast("long"), lambda n, u: n + F.greatest(F.lit(0), F.least(u["words"], F.col("hi")) - F.col("lo")))
    met = F.transform(F.filter("uses", lambda u: u["words"] > F.col("lo")), lambda u: u["shard"])
    # The slots grow with the corpus, though they are made from one small row for each source.
    taken = pieces.join(uses.hint("merge"), ["key", "block"], "left")
    taken = taken.select("doc_id", "key", "size", "start", F.coalesce(took, F.lit(0)).alias("took"), F.array_min(met).alias("low"), F.array_max(met).alias("high"))
    taken = taken.groupBy("doc_id", "key", "size", "start").agg(F.sum("took").alias("taken"), F.min("low").alias("first_shard"), F.max("high").alias("last_shard")).drop("start")
    none = F.lit(None).cast("long")
    taken = taken.unionByName(rows.where("size = 0").select("doc_id", "key", "size", F.lit(0).cast("long").alias("taken"), none.alias("first_shard"), none.alias("last_shard")))
    return taken.join(sources, "key").select("doc_id", F.expr("if(key = 'b', null, substring(key, 2))").alias("source"), "size", "source_size", "target", "taken", "first_shard", "last_shard")


def taken_ranges(rows: DataFrame, block: int, seed: int, *own: str) -> DataFrame:
    """own, pass, first, last: the runs of neighbouring words that a pass of the mix takes of a row, last excluded.

    rows: doc_id, key, size, own (the row's name). A block is taken from its start, so a run ends where a block is cut or not taken.
    """
    pieces = pieces_of(rows, block, *own)
    met = pieces.join(uses_of(sources_of(rows), block, seed).hint("merge"), ["key", "block"])
    met = met.select(*own, "start", "block", "lo", "hi", F.posexplode("uses").alias("pass", "use")).withColumn("end", F.least("use.words", "hi")).where("end > lo")
    begin = F.col("block") * block - F.col("start")
    met = met.select(*own, "pass", (begin + F.col("lo")).alias("first"), (begin + F.col("end")).alias("last"))
    order = Window.partitionBy(*own, "pass").orderBy("first")
    met = met.withColumn("fresh", F.coalesce(F.lag("last").over(order) != F.col("first"), F.lit(True)).cast("int"))
    met = met.withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return met.groupBy(*own, "pass", "run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("run")


def mixed_documents(docs: DataFrame, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """docs as the mix takes them, in the columns of docs.

    Every pass of the mix over a document gives a row for each run of neighbouring words that its slots take: the text as it
    is where that is the whole document, else those words one space apart. Words in blocks that the mix leaves out are
    gone. n_chars, where there is such a column, follows the text.
    """
    file, row = "mixing_file", "mixing_row"
    columns, kinds = docs.columns, {f.name: f.dataType for f in docs.schema.fields}
    docs = named_rows(docs, file, row)
    ranges = taken_ranges(sized(docs.select("doc_id", "text", "source", file, row), file, row), block, seed, file, row)
    ranges = ranges.groupBy(F.col(file).alias("mix_file"), F.col(row).alias("mix_row")).agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(file).alias("own_file"), F.col(row).alias("own_row")).hint("merge")
    rows = rows.join(ranges, (F.col("own_file") == F.col("mix_file")) & (F.col("own_row") == F.col("mix_row")))
    size = F.size("all_words")
    rows = rows.withColumn("all_words", F.regexp_extract_all(F.col("row.text"), F.lit(NOT_SPACE), F.lit(0)))
    part = lambda r: F.array_join(F.slice("all_words", (r["first"] + 1).cast("int"), (r["last"] - r["first"]).cast("int")), " ")
    cuts = F.transform("runs", lambda r: F.when(r["last"] - r["first"] == size, F.col("row.text")).otherwise(part(r)))
    rows = rows.select("row", F.explode(cuts).alias("cut"))
    new = {"text": F.col("cut"), "n_chars": F.length("cut")}
    return rows.select(*[(new[c].cast(kinds[c]) if c in new else F.col(f"row.`{c}`")).alias(c) for c in columns])
