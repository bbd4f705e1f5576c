"""SimHash near-duplicates by anchor points of a covering code.

Fingerprints are 64 majority bits over XXH64 hashes of word shingles. Anchors are the
words of a covering code: two perfect Golay [23,12] blocks (covering radius 3 each) over bits
0-45, the other 18 bits free. Two fingerprints within two bits have a point between them
within one bit of both, and that point lies within the covering radius of its anchor. So each
fingerprint goes to the anchor of every point within one bit of it (the anchors in covering radius
plus threshold that can matter, about ten), and comparing members of one anchor
loses no link. An anchor with many members is refined by the code of radius 0: members go to
the 65 points around them, where no more than 65 distinct fingerprints can ever meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import _text
from quire.llm._common import documents, materialise, named_rows, with_package
from quire.llm.components import components

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Members above which an anchor is refined.
ANCHOR_LIMIT = 512
#: Members above which an anchor of word fingerprints is refined: one task compares so many.
COPY_LIMIT = 1 << 16
#: Near copies of the pipeline: one of TABLES fingerprints of single words within RADIUS bits, those of five-word shingles within APART
#: bits (a similarity of 0.8 is 9.7 bits on average), and numbers of words within a factor of BAND.
TABLES, SHINGLES, APART, BAND = 3, 5, 13, 1.25

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64_ranges(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of each byte range, all ranges a step at a time."""
    padded = np.concatenate([raw, np.zeros(40, np.uint8)])
    eights = np.lib.stride_tricks.as_strided(padded, (len(raw) + 8, 8), (1, 1))
    fours = np.lib.stride_tricks.as_strided(padded, (len(raw) + 8, 4), (1, 1))
    read8 = lambda at: eights[at].view("<u8")[:, 0]
    read4 = lambda at: fours[at].view("<u4")[:, 0].astype(np.uint64)
    seed64, n, at = np.uint64(seed), lengths.astype(np.int64), starts.astype(np.int64).copy()
    out = np.full(len(n), seed64 + _P5, np.uint64)
    mix = lambda acc, lane: _rotl(acc + lane * _P2, 31) * _P1
    with np.errstate(over="ignore"):
        if len(long := np.flatnonzero(n >= 32)):
            acc = [np.full(len(long), v, np.uint64) for v in (seed64 + _P1 + _P2, seed64 + _P2, seed64, seed64 - _P1)]
            blocks, live, k = n[long] // 32, np.arange(len(long)), 0
            while len(live):
                for j in range(4):
                    acc[j][live] = mix(acc[j][live], read8(starts[long[live]] + 32 * k + 8 * j))
                k += 1
                live = live[blocks[live] > k]
            h = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for a in acc:
                h = (h ^ mix(np.zeros(len(long), np.uint64), a)) * _P1 + _P4
            out[long] = h
            at[long] += 32 * blocks
        out += n.astype(np.uint64)
        rest = n - (at - starts)
        for need in (8, 16, 24):
            if len(live := np.flatnonzero(rest >= need)):
                out[live] = _rotl(out[live] ^ mix(np.zeros(len(live), np.uint64), read8(at[live] + need - 8)), 27) * _P1 + _P4
        at += rest // 8 * 8
        rest %= 8
        if len(live := np.flatnonzero(rest >= 4)):
            out[live] = _rotl(out[live] ^ (read4(at[live]) * _P1), 23) * _P2 + _P3
            at[live] += 4
        rest %= 4
        for k in range(3):
            if len(live := np.flatnonzero(rest > k)):
                out[live] = _rotl(out[live] ^ (padded[at[live] + k].astype(np.uint64) * _P5), 11) * _P1
        out ^= out >> np.uint64(33)
        out *= _P2
        out ^= out >> np.uint64(29)
        out *= _P3
        out ^= out >> np.uint64(32)
    return out


#: Hashes that are counted at once: their counts fit in 16 bits.
STEP = (1 << 16) - 1


def _bit_sums(hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Per document (runs of at most STEP hashes that begin at firsts, none empty) how many hashes have each bit, most significant first.

    Four bits are counted in one running sum, 16 bits apart; differences of running sums are counts whatever overflows between.
    """
    ends = np.append(firsts[1:], len(hashes))
    out = np.empty((len(firsts), 64), np.int64)
    total = np.zeros(len(hashes) + 1, np.uint64)
    for k in range(16):
        np.cumsum((hashes >> np.uint64(k)) & np.uint64(0x0001000100010001), out=total[1:])
        found = total[ends] - total[firsts]
        for lane in range(4):
            out[:, 63 - k - 16 * lane] = ((found >> np.uint64(16 * lane)) & np.uint64(0xFFFF)).astype(np.int64)
    return out


def _lower_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words in lower case (A-Z), one space apart, and where each begins there."""
    keep = ~_text.is_space(raw)
    size = ends - starts
    at = np.cumsum(size + 1) - size - 1
    out = np.full(int(size.sum()) + len(size), 32, np.uint8)
    low = raw[keep]
    low = np.where((low >= 65) & (low <= 90), low + np.uint8(32), low)
    place = np.ones(len(out), bool)
    place[at + size] = False
    out[place] = low
    return out, at


def fingerprints_of(raw: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE, tables: int = 1) -> np.ndarray:
    """Unsigned 64-bit fingerprints of the documents in a byte buffer; of more than one table a row for each, by other hashes."""
    out = np.zeros((tables, len(offsets) - 1), np.uint64)
    for first, last in _text.slices(offsets):
        lo, hi = offsets[first], offsets[last]
        part = raw[lo:hi]
        starts, ends, index = _text.words(part, offsets[first : last + 1] - lo)
        count = np.diff(index)
        sums = np.zeros((tables, last - first, 64), np.int64)
        joined, at = _lower_words(part, starts, ends)
        size = ends - starts
        shingles = np.where(count > 0, np.maximum(count - shingle + 1, 1), 0)
        ordinal = np.arange(int(shingles.sum())) - np.repeat(np.cumsum(shingles) - shingles, shingles)
        begin = np.repeat(index[:-1], shingles) + ordinal
        end = np.minimum(begin + shingle, np.repeat(index[1:], shingles)) - 1
        owner = np.repeat(np.arange(last - first), shingles)
        for k in range(0, len(begin), STEP):  # a very long document is counted a part at a time
            b, e, o = begin[k : k + STEP], end[k : k + STEP], owner[k : k + STEP]
            h = xxh64_ranges(joined, at[b], at[e] + size[e] - at[b], SEED)
            runs = np.flatnonzero(np.append(True, o[1:] != o[:-1]))
            for t in range(tables):
                sums[t][o[runs]] += _bit_sums(h if not t else _text.mix64(h + np.uint64(t)), runs)
        bits = (2 * sums > shingles[:, None]).astype(np.uint8)
        out[:, first:last] = np.packbits(bits, axis=2).view(">u8")[:, :, 0]
    return out if tables > 1 else out[0]


def simhash(docs: DataFrame, *own: str) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and the long columns own of every row; a null, empty or wordless text has 0."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprints_of(*_text.string_buffer(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", *own])

    return with_package(docs.select("doc_id", F.col("text").cast("string").alias("text"), *own)).mapInArrow(_text.lean(compute), ", ".join([f"doc_id {kind}", "fp long", *(f"{x} long" for x in own)]))


def _golay() -> np.ndarray:
    """For each 11-bit syndrome the one error pattern of weight 3 or less."""
    def syndrome(x: int) -> int:
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= 0b110001110101 << (i - 11)
        return x

    table = np.full(2048, -1, np.int64)
    unit = [syndrome(1 << i) for i in range(23)]
    for a in range(-1, 23):
        for b in range(-1, a if a >= 0 else 0):
            for c in range(-1, b if b >= 0 else 0):
                chosen = [i for i in (a, b, c) if i >= 0]
                s, e = 0, 0
                for i in chosen:
                    s, e = s ^ unit[i], e ^ (1 << i)
                table[s] = e
    table[0] = 0
    for a in range(23):
        table[unit[a]] = 1 << a
        for b in range(a):
            table[unit[a] ^ unit[b]] = 1 << a | 1 << b
    assert (table >= 0).all()
    return table


class _Code:
    """Nearest word of the Golay code, by syndrome."""

    def __init__(self) -> None:
        self.errors = _golay()
        low, high = np.arange(1 << 12), np.arange(1 << 11) << 12
        self.low, self.high = self._syndromes(low), self._syndromes(high)

    @staticmethod
    def _syndromes(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.int64)
        for i in range(22, 10, -1):
            x = np.where(x >> i & 1, x ^ (0b110001110101 << (i - 11)), x)
        return x

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return x ^ self.errors[self.low[x & 0xFFF] ^ self.high[x >> 12]]


_code: list[_Code] = []


def anchors_near(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor): for each fingerprint the distinct anchors of all points within one bit of it."""
    if not _code:
        _code.append(_Code())
    mask = (1 << 23) - 1
    halves = [(fp & np.uint64(mask)).astype(np.int64), ((fp >> np.uint64(23)) & np.uint64(mask)).astype(np.int64)]
    home = [_code[0].nearest(x) for x in halves]
    anchors = [home[1] << 23 | home[0]]
    for bit in range(23):
        anchors.append(home[1] << 23 | _code[0].nearest(halves[0] ^ (1 << bit)))
        anchors.append(_code[0].nearest(halves[1] ^ (1 << bit)) << 23 | home[0])
    table = np.sort(np.stack(anchors, axis=1), axis=1)
    fresh = np.ones(table.shape, bool)
    fresh[:, 1:] = table[:, 1:] != table[:, :-1]
    row, column = np.nonzero(fresh)
    return row, table[row, column]


def _chains(cell: np.ndarray, prints: list[np.ndarray], radii: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) as row numbers: in each cell a spanning forest of the members whose prints are all within their radii. Rows come grouped by cell."""
    edges = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    outs_a, outs_b = [], []
    for lo, hi in zip(edges, np.append(edges[1:], len(cell)), strict=True):
        if hi - lo == 1:
            continue
        left, frontier = np.arange(lo + 1, hi), [int(lo)]
        while True:
            if not frontier:
                if not len(left):
                    break
                frontier, left = [int(left[0])], left[1:]
                continue
            u = frontier.pop()
            if not len(left):
                break
            near = np.bitwise_count(prints[0][left] ^ prints[0][u]) <= radii[0]
            for x, radius in zip(prints[1:], radii[1:], strict=True):
                near[near] = np.bitwise_count(x[left[near]] ^ x[u]) <= radius
            if near.any():
                found = left[near]
                outs_a.append(np.full(len(found), u)), outs_b.append(found)
                frontier.extend(found.tolist())
                left = left[~near]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *outs_a]), np.concatenate([none, *outs_b])


def _compare(cells: DataFrame, radii: list[int]) -> DataFrame:
    """cells(cell, one long for each radius), dealt and sorted by cell -> links(a0, .., b0, ..) between members."""
    width = len(radii)
    names = [f"{side}{k}" for side in "ab" for k in range(width)]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64) for _ in range(width + 1)]

        def emit(columns):
            a, b = _chains(columns[0], [x.view(np.uint64) for x in columns[1:]], radii)
            return pa.RecordBatch.from_arrays([pa.array(x[side]) for side in (a, b) for x in columns[1:]], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            held = [np.concatenate([rest, batch.column(k).to_numpy()]) for k, rest in enumerate(held)]
            last = int(np.searchsorted(held[0], held[0][-1]))
            yield emit([x[:last] for x in held])
            held = [x[last:] for x in held]
        if len(held[0]):
            yield emit(held)

    return cells.mapInArrow(_text.lean(compare), ", ".join(f"{n} long" for n in names))


def _counted(spread: DataFrame, *order: str) -> DataFrame:
    """spread dealt and sorted by cell and order, with members: the rows of its cell.

    One order everywhere lets a group's trees grow from the same member in all cells, so that most of their links are the same.
    """
    cell = Window.partitionBy("cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return spread.withColumn("members", F.count("*").over(cell))


def _points(fp: Column) -> Column:
    """The 65 points within one bit of a fingerprint."""
    return F.concat(F.array(fp), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: fp.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))


def _spread(fingerprints: DataFrame) -> DataFrame:
    """fingerprints(fp, other longs) -> cell, fp, the others: every row once for each anchor near it."""
    names = fingerprints.columns

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for k in range(0, len(fp), 20_000):
                row, anchor = anchors_near(fp[k : k + 20_000])
                part = batch.slice(k, 20_000).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(anchor), *part.columns], ["cell", *names])

    return fingerprints.mapInArrow(_text.lean(replicate), ", ".join(["cell long", *(f"{n} long" for n in names)]))


def near_links(fingerprints: DataFrame, limit: int = ANCHOR_LIMIT) -> DataFrame:
    """fingerprints(fp), distinct -> links(a, b) whose components are those of all pairs within two bits."""

    spread = _counted(_spread(fingerprints), "fp")
    crowded = F.col("members") > limit
    normal = _compare(spread.where(~crowded).drop("members"), [RADIUS]).toDF("a", "b")
    # Radius 0 around members of crowded anchors: the points are the cells, and a pair within two bits shares one.
    hot = spread.where(crowded).select("fp").distinct()
    met = hot.select(F.explode(_points(F.col("fp"))).alias("cell"), "fp")
    # Every member of a point is within two bits of every other: the smallest stands for all.
    met = met.groupBy("cell").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("members")).where(F.size("members") > 1)
    return normal.union(met.select("a", F.explode("members").alias("b")).where("a <> b").distinct())


def _named(rows: DataFrame) -> DataFrame:
    """rows(doc_id, fp) -> fp, root (one for each component), component_id."""
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(near_links(classes.select("fp")))
    grouped = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    return grouped.join(least, "root").select("fp", "root", "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row.

    Texts without words have fingerprint 0 and link like any other. Rows of one fingerprint are one class, so copies of
    any number cost one entry. A null doc_id is never the smallest unless a component has no other. No rows: no rows.
    Columns besides doc_id and text are not read.
    """
    rows = materialise(simhash(docs))
    return rows.join(_named(rows).drop("root"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_prints(docs: DataFrame, *own: str) -> DataFrame:
    """doc_id, f0, f1, .. (fingerprints of the words), g (of the five-word shingles), band (of the number of words), and the long columns own of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [*(f"f{t}" for t in range(TABLES)), "g", "band"]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = _text.string_buffer(batch.column(1))
            prints = [*fingerprints_of(raw, offsets, 1, TABLES), fingerprints_of(raw, offsets, SHINGLES)]
            count = np.zeros(batch.num_rows, np.int64)
            for a, b in _text.slices(offsets):
                count[a:b] = np.diff(_text.words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])[2])
            band = np.floor(np.log(count + 1) / np.log(BAND)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x.view(np.int64)) for x in prints), pa.array(band), *batch.columns[2:]], ["doc_id", *names, *own])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), *own)
    return with_package(rows).mapInArrow(_text.lean(compute), ", ".join([f"doc_id {kind}", *(f"{x} long" for x in (*names, *own))]))


def copy_links(nodes: DataFrame, limit: int = COPY_LIMIT) -> DataFrame:
    """nodes(f0, .., g, band), distinct -> links(a, b), structs of f0 and g, whose components are those of all near copies.

    A node stands in its own band and the next, so that neighbouring bands meet, and once for each table; its cells are the anchors of that
    table's fingerprint within a band. A crowded anchor is refined to the points within one bit of the fingerprint.
    """
    tables = F.array(*[F.struct(F.lit(t).cast("long").alias("t"), F.col(f"f{t}").alias("f")) for t in range(TABLES)])
    each = nodes.select("f0", "g", F.explode(F.array("band", F.col("band") + 1)).alias("band"), tables.alias("tables"))
    each = each.select("f0", "g", "band", F.explode("tables").alias("one")).select("one.f", "g", "f0", (F.col("band") * TABLES + F.col("one.t")).alias("lane"))
    spread = _counted(_spread(each).select(F.col("cell").bitwiseOR(F.call_function("shiftleft", F.col("lane"), F.lit(46))).alias("cell"), "f", "g", "f0", "lane"), "f0", "g")
    crowded = F.col("members") > limit
    radii = [RADIUS, APART, 64]  # f0 comes along as a name
    normal = _compare(spread.where(~crowded).select("cell", "f", "g", "f0"), radii)
    hot = spread.where(crowded).select("f", "g", "f0", "lane").distinct()
    hot = hot.select(F.explode(_points(F.col("f"))).alias("point"), "f", "g", "f0", "lane").select(F.xxhash64("point", "lane").alias("cell"), "f", "g", "f0").repartition("cell").sortWithinPartitions("cell", "f0", "g")
    side = lambda x: F.struct(F.col(f"{x}2").alias("f0"), F.col(f"{x}1").alias("g")).alias(x)
    return normal.unionByName(_compare(hot, radii)).select(side("a"), side("b"))


def representatives(docs: DataFrame, limit: int = COPY_LIMIT) -> DataFrame:
    """docs with exactly one row of each group of near copies, one of those with its smallest doc_id (null last).

    Near copies have word fingerprints within two bits in one table, five-word shingle fingerprints within APART bits (similarity 0.8 or more, as
    fingerprints tell it) and about the same length; a group is what such links connect. Texts without words are one group. Rows are told apart by
    names of their own, so rows of other groups under the same or a null doc_id stay.
    """
    file, row = "near_dedup_file", "near_dedup_row"
    docs = named_rows(docs, file, row)
    rows = materialise(near_prints(docs.select("doc_id", "text", file, row), file, row))
    # Rows of equal fingerprints are one node, so copies of any number cost one entry.
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", file, row)).alias("best")
    nodes = rows.groupBy(F.struct("f0", "g").alias("node")).agg(best)
    roots = components(copy_links(rows.drop("doc_id", file, row).distinct(), limit))
    grouped = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best"))
    stay = grouped.select(F.col(f"best.{file}").alias("stay_file"), F.col(f"best.{row}").alias("stay_row"))
    return docs.hint("merge").join(stay, (docs[file] == stay["stay_file"]) & (docs[row] == stay["stay_row"]), "left_semi").drop(file, row)


def op8(spark, sf_dir):
    return near_dedup(documents(spark, sf_dir))
