"""Repeated passages across documents, found with compressed full-text indexes.

A window is a run of `window` consecutive words. Equal windows hold equal minimizers (the
smallest hash among their runs of 8 words), so runs of windows with one minimizer are the unit of
work: only minimizers that occur twice or more can hold a repeat, and all pieces of one minimizer
meet in one shard. A shard builds an FM-index of its distinct pieces (suffix array, Burrows-Wheeler
transform, wavelet matrix over word numbers) and streams pieces against it: backward search from
each window's last word narrows the suffix interval, and a window whose whole length still has two
occurrences is reported. Pieces of a very frequent minimizer are not gathered: equal texts and equal pieces are
summed, and the windows of the distinct pieces are counted by a 128-bit hash with map-side sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import _text
from quire.llm._common import documents, join_top, with_package

WINDOW, GRAM = 35, 8
#: Pieces of one minimizer above which its windows are counted instead of indexed; bytes of text in one index.
CROWD, SHARD_BYTES = 4096, 3 << 20
#: In place of a number of windows: every one of the document.
ALL = -1


class BitVector:
    """A succinct bit vector: 64 bits to a word and one running count for each word, so a bit takes a bit and a half."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits.astype(np.uint8), bitorder="little")
        self.words = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view(np.uint64)
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    """Rank over a sequence of small integers: one succinct bit vector for each bit of the alphabet."""

    def __init__(self, values: np.ndarray, bits: int) -> None:
        self.bits, self.zeros, self.ones = bits, [], []
        for b in range(bits - 1, -1, -1):
            bit = values >> b & 1
            self.ones.append(BitVector(bit))
            self.zeros.append(len(values) - int(bit.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences of each symbol before lo and before hi: returned as ends of a range, and the range's origin."""
        origin = np.zeros(len(symbols), np.int64)
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            ones, zero = self.ones[level], self.zeros[level]
            one = (symbols >> b & 1).astype(bool)
            lo1, hi1, or1 = (ones.rank(x).astype(np.int64) for x in (lo, hi, origin))
            lo, hi, origin = np.where(one, zero + lo1, lo - lo1), np.where(one, zero + hi1, hi - hi1), np.where(one, zero + or1, origin - or1)
        return lo - origin, hi - origin, origin


def suffix_array(values: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of the (cyclic) sequence in the order of their first depth items at least, by prefix doubling."""
    rank, width, n = values.astype(np.int64), 1, len(values)
    while True:
        key = rank * (int(rank.max()) + 1) + np.roll(rank, -width) if width <= depth else rank
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        fresh = np.append(False, ranked[1:] != ranked[:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        width *= 2
        if width >= depth or rank[order[-1]] == n - 1:
            return order


class FMIndex:
    """Counts occurrences of word sequences in a text of word numbers (1 and up; 0 separates) by backward search."""

    def __init__(self, values: np.ndarray, depth: int) -> None:
        self.size = len(values)
        order = suffix_array(values, depth)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(values))])
        self.wavelet = WaveletMatrix(values[order - 1], max(1, int(values.max()).bit_length()))

    def matching(self, words: np.ndarray, lasts: np.ndarray, length: int, least: int = 2) -> np.ndarray:
        """Matching statistics, up to length: how many words ending at each of lasts still occur least times."""
        lo, hi = np.zeros(len(lasts), np.int64), np.full(len(lasts), self.size, np.int64)
        matched, live = np.zeros(len(lasts), np.int64), np.arange(len(lasts))
        for step in range(length):
            symbol = words[lasts[live] - step]
            a, b, _ = self.wavelet.rank(symbol, lo[live], hi[live])
            lo[live], hi[live] = self.before[symbol] + a, self.before[symbol] + b
            going = b - a >= least
            live = live[going]
            matched[live] += 1
            if not len(live):
                break
        return matched


def _minimizer_runs(hashes: np.ndarray, index: np.ndarray, window: int, gram: int):
    """(minimizer, document, first window within the document, windows, places) of each run of windows with one minimizer.

    places: how often the minimizer stands in the run's words; twice or more where a text repeats within itself.
    """
    grams = _text.gram_hashes(hashes, gram)
    low = _text.sliding_min(grams, window - gram + 1)
    n = np.maximum(np.diff(index) - window + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    value = low[np.repeat(index[:-1], n) + at] if len(doc) else low[:0]
    first = np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, np.int64)
    value, doc, at, n = value[first], doc[first], at[first], np.diff(np.append(first, len(doc)))
    span = n + window - gram
    edge = np.cumsum(span) - span
    where = np.repeat(index[:-1][doc] + at - edge, span) + np.arange(int(span.sum()))
    same = (grams[where] == np.repeat(value, span)).astype(np.int64)
    return value, doc, at, n, np.add.reduceat(same, edge) if len(edge) else edge


def occurrences(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs(doc, text) -> m, doc, first, n, places: the minimizer runs of every document."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = _text.string_buffer(batch.column(1))
            for a, b in _text.slices(offsets):
                part = raw[offsets[a] : offsets[b]]
                starts, ends, index = _text.words(part, offsets[a : b + 1] - offsets[a])
                m, doc, first, n, places = _minimizer_runs(_text.word_hashes(part, starts, ends), index, window, gram)
                yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), batch.column(0).slice(a, b - a).take(pa.array(doc)), pa.array(first), pa.array(n), pa.array(places)], ["m", "doc", "first", "n", "places"])

    return with_package(docs).mapInArrow(_text.lean(scan), "m long, doc long, first long, n long, places long")


def _pieces(docs: DataFrame, window: int) -> DataFrame:
    """docs(doc, doc_id, text, runs, copies) -> m, doc, first, n, piece, copies: the text of each run, words one space apart."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = _text.string_buffer(batch.column(2))
            for a, b in _text.slices(offsets):
                part, runs = raw[offsets[a] : offsets[b]], batch.column(3).slice(a, b - a)
                starts, ends, index = _text.words(part, offsets[a : b + 1] - offsets[a])
                doc = np.repeat(np.arange(b - a), runs.value_lengths().to_numpy())
                flat = runs.flatten()
                m, first, n = (flat.field(k) for k in range(3))
                lo = index[doc] + first.to_numpy()
                hi = lo + n.to_numpy() + window - 2
                joined, at = _joined(part, starts, ends)
                begin, end = at[lo], at[hi] + (ends - starts)[hi]
                offs = np.concatenate([[0], np.cumsum(end - begin)])
                data = np.empty(int(offs[-1]), np.uint8)
                view, out = memoryview(joined), memoryview(data)
                for i in range(len(begin)):
                    out[offs[i] : offs[i + 1]] = view[begin[i] : end[i]]
                text = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
                whose = pa.array(a + doc)
                yield pa.RecordBatch.from_arrays([m, batch.column(0).take(whose), first, n, text, batch.column(4).take(whose)], ["m", "doc", "first", "n", "piece", "copies"])

    return docs.mapInArrow(_text.lean(cut), "m long, doc long, first long, n long, piece string, copies long")


def _joined(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words one space apart, and where each begins there."""
    size = ends - starts
    at = np.cumsum(size + 1) - size - 1
    out = np.full(int(size.sum()) + len(size), 32, np.uint8)
    place = np.ones(len(out), bool)
    place[at + size] = False
    out[place] = raw[~_text.is_space(raw)]
    return out, at


def _spans(doc: np.ndarray, first: np.ndarray, flags: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of set flags in pieces of n windows each, as (document, first window, windows)."""
    piece = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
    hit = np.flatnonzero(flags)
    if not len(hit):
        return doc[:0], first[:0], first[:0]
    new = np.append(True, (np.diff(hit) != 1) | (np.diff(piece[hit]) != 0))
    start = np.flatnonzero(new)
    return doc[piece[hit[start]]], first[piece[hit[start]]] + at[hit[start]], np.diff(np.append(start, len(hit)))


def search_shard(pieces: pa.Array, doc: np.ndarray, first: np.ndarray, n: np.ndarray, window: int):
    """Index the distinct pieces of a shard, stream them against it, report runs of repeated windows of every row."""
    coded = pieces.dictionary_encode()
    code = coded.indices.to_numpy()
    copies = np.bincount(code, minlength=len(coded.dictionary))
    raw, offsets = _text.string_buffer(coded.dictionary)
    starts, ends, index = _text.words(raw, offsets)
    words = _word_numbers(raw, starts, ends)
    length = np.diff(index)
    # A separator before each piece: it matches nothing that is searched.
    text = np.zeros(len(words) + len(length), np.int64)
    shift = np.repeat(np.arange(1, len(length) + 1), length)
    place = np.arange(len(words)) + shift
    text[place] = words
    windows = length - window + 1
    flags = np.repeat(copies > 1, windows)
    owner = np.repeat(np.arange(len(length)), windows)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    asked = np.flatnonzero(~flags)
    if len(asked):
        index_of = FMIndex(text, window)
        lasts = index[:-1][owner[asked]] + owner[asked] + 1 + at[asked] + window - 1
        flags[asked] = index_of.matching(text, lasts, window) >= window
    begin = np.cumsum(windows) - windows
    of_row = windows[code]
    spread = np.repeat(begin[code], of_row) + np.arange(int(of_row.sum())) - np.repeat(np.cumsum(of_row) - of_row, of_row)
    return _spans(doc, first, flags[spread], of_row)


def _word_numbers(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers from 1 for the distinct words."""
    gap = np.empty(len(starts) + 1, np.int64)
    data, at = _joined(raw, starts, ends)
    gap[:-1], gap[-1] = at, len(data)
    # Each entry keeps the space behind it, so ranges are gapless; that changes no equality.
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(gap), pa.py_buffer(data)]).dictionary_encode().indices.to_numpy().astype(np.int64) + 1


def _indexed(pieces: DataFrame, window: int) -> DataFrame:
    """pieces dealt and sorted by minimizer -> doc, first, n of repeated windows."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def run(table: pa.Table) -> pa.RecordBatch:
            doc, first, n = (table.column(k).to_numpy() for k in (1, 2, 3))
            found = search_shard(table.column(4).combine_chunks(), doc, first, n, window)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["doc", "first", "n"])

        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                held.append(part)
                size += part.column(4).nbytes
                if size >= SHARD_BYTES:
                    table = pa.Table.from_batches(held)
                    m = table.column(0).to_numpy()
                    last = int(np.searchsorted(m, m[-1]))
                    if last:
                        yield run(table.slice(0, last))
                        held = table.slice(last).combine_chunks().to_batches()
                        size = sum(x.column(4).nbytes for x in held)
        if held:
            yield run(pa.Table.from_batches(held))

    return pieces.mapInArrow(_text.lean(search), "doc long, first long, n long")


def _counted(pieces: DataFrame, window: int) -> DataFrame:
    """Repeated windows of crowded minimizers: doc, spans.

    Equal pieces are summed before anything else, so a group of copies costs one piece. The windows of the distinct pieces are
    counted by 128-bit hashes, and every occurrence of a piece takes the piece's runs of repeated windows.
    """

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4000):
                part = batch.slice(k, 4000)
                raw, offsets = _text.string_buffer(part.column(0))
                starts, ends, index = _text.words(raw, offsets)
                h = _text.word_hashes(raw, starts, ends)
                n = np.maximum(np.diff(index) - window + 1, 0)
                piece = np.repeat(np.arange(len(n)), n)
                at = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
                go = index[:-1][piece] + at
                one, two = _text.gram_hashes(h, window)[go], _text.gram_hashes(_text.mix64(h ^ np.uint64(0x5851F42D4C957F2D)), window)[go]
                # A piece that repeats itself has one row for each distinct window.
                order = np.lexsort((at, two, one, piece))
                piece, at, one, two = piece[order], at[order], one[order], two[order]
                new = np.flatnonzero(np.append(len(piece) > 0, (piece[1:] != piece[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1]))[: len(piece)])
                times = np.diff(np.append(new, len(piece)))
                whose = pa.array(piece[new])
                ats = pa.ListArray.from_arrays(pa.array(np.append(new, len(piece)).astype(np.int32)), pa.array(at))
                copies = pa.array(part.column(3).to_numpy()[piece[new]] * times)
                yield pa.RecordBatch.from_arrays([part.column(1).take(whose), part.column(2).take(whose), copies, ats, pa.array(one[new].view(np.int64)), pa.array(two[new].view(np.int64))], ["p1", "p2", "copies", "ats", "h1", "h2"])

    named = pieces.withColumns({"p1": F.xxhash64("piece"), "p2": F.xxhash64("piece", F.lit(1))})
    distinct = named.groupBy("piece", "p1", "p2").agg(F.sum("copies").alias("copies"))
    each = distinct.mapInArrow(_text.lean(windows), "p1 long, p2 long, copies long, ats array<long>, h1 long, h2 long")
    often = each.groupBy("h1", "h2").agg(F.sum("copies").alias("c")).where("c > 1")
    hits = join_top(each, often, ["h1", "h2"], "c").groupBy("p1", "p2").agg(F.array_sort(F.flatten(F.collect_list("ats"))).alias("ats"))
    none = F.array().cast("array<struct<at:bigint,n:bigint>>")

    def extend(runs, at):
        last = F.element_at(runs, -1)
        return F.when((F.size(runs) > 0) & (F.try_element_at(runs, F.lit(-1))["at"] + F.try_element_at(runs, F.lit(-1))["n"] == at), F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(F.struct(last["at"].alias("at"), (last["n"] + 1).alias("n"))))).otherwise(F.concat(runs, F.array(F.struct(at.alias("at"), F.lit(1).cast("long").alias("n")))))

    hits = hits.select("p1", "p2", F.aggregate("ats", none, extend).alias("found"))
    met = named.select("doc", "first", "p1", "p2").join(hits, ["p1", "p2"])
    return met.select("doc", F.transform("found", lambda r: F.struct((F.col("first") + r["at"]).alias("first"), r["n"].alias("n"))).alias("spans"))


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text of every row.

    A null or empty text has no words and keeps the empty text. Rows repeated under one doc_id have each other's
    windows as repeats only if their texts are separate rows: each row counts. Texts of fewer words than a window are kept
    whole. No rows: no rows. Columns besides doc_id and text are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    # A row is known by its id where ids are unique, else by a number made of its id and text: equal ids stay apart, and a lost task makes the same number again.
    rows, ids = plain.agg(F.count("*"), F.countDistinct("doc_id")).first()
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")) if rows == ids and isinstance(docs.schema["doc_id"].dataType, T.IntegralType) else F.xxhash64("doc_id", "text")
    named = plain.select(own.alias("doc"), "doc_id", "text")
    runs = occurrences(named.select("doc", "text"), window, gram)
    often = runs.groupBy("m").agg(F.sum("places").alias("c")).where("c > 1")
    marked = runs.join(often, "m").select("doc", F.struct("m", "first", "n", (F.col("c") > crowd).alias("crowded")).alias("run"))
    marked = marked.groupBy("doc").agg(F.collect_set("run").alias("runs"))
    # Always the same three columns, so that the texts are dealt once and that exchange is used again.
    met = named.join(marked, "doc").select("doc", "doc_id", "text", "runs", F.lit(1).cast("long").alias("copies"))
    of = lambda crowded: F.filter("runs", lambda r: r["crowded"] == F.lit(crowded))
    quiet = _pieces(met.withColumn("runs", of(False)).where(F.size("runs") > 0), window)
    spans = _indexed(quiet.select("m", "doc", "first", "n", "piece").repartition("m").sortWithinPartitions("m"), window)
    # Of equal texts in a crowd one stands for all, and all their windows repeat.
    hashed = named.select("doc", F.xxhash64("text").alias("t1"), F.xxhash64("text", F.lit(1)).alias("t2"))
    crowds = hashed.join(marked.where(F.exists("runs", lambda r: r["crowded"])).select("doc"), "doc")
    alike = crowds.groupBy("t1", "t2").agg(F.min("doc").alias("doc"), F.count("*").alias("copies"))
    whole = crowds.join(alike.where("copies > 1").select("t1", "t2"), ["t1", "t2"], "left_semi")
    whole = whole.select("doc", F.array(F.struct(F.lit(0).cast("long").alias("first"), F.lit(ALL).cast("long").alias("n"))).alias("spans"))
    chosen = met.drop("copies").withColumn("runs", of(True)).where(F.size("runs") > 0).join(alike.select("doc", "copies"), "doc").select("doc", "doc_id", "text", "runs", "copies")
    counted = _counted(_pieces(chosen, window), window)
    spans = spans.select("doc", F.array(F.struct("first", "n")).alias("spans")).unionByName(counted).unionByName(whole)
    spans = spans.groupBy("doc").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digests, texts = [], [], [], []
            raw, offsets = _text.string_buffer(batch.column(1))
            lists = batch.column(2)
            for a, b in _text.slices(offsets):
                part, found = raw[offsets[a] : offsets[b]], lists.slice(a, b - a)
                starts, ends, index = _text.words(part, offsets[a : b + 1] - offsets[a])
                joined, at = _joined(part, starts, ends)
                flat, lengths = found.flatten(), found.value_lengths().fill_null(0).to_numpy()
                whose, n = np.repeat(np.arange(b - a), lengths), flat.field(1).to_numpy()
                base = index[whose] + flat.field(0).to_numpy()
                change = np.zeros(len(starts) + 1, np.int64)
                np.add.at(change, base, 1)
                np.add.at(change, np.where(n == ALL, index[whose + 1], base + n + window - 1), -1)
                kept = np.cumsum(change)[:-1] == 0
                tail = np.append(at[1:], len(joined))
                byte = np.repeat(kept, tail - at)
                for i in range(b - a):
                    lo, hi = index[i], index[i + 1]
                    n_words.append(int(hi - lo))
                    left = int(kept[lo:hi].sum())
                    n_removed.append(n_words[-1] - left)
                    if left:
                        x, y = at[lo], tail[hi - 1]
                        text = joined[x:y][byte[x:y]].tobytes()[:-1]
                    else:
                        text = b""
                    digests.append(hashlib.sha256(text).hexdigest())
                    texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    done = named.join(spans, "doc", "left").select("doc_id", "text", "spans")
    return done.mapInArrow(_text.lean(keep), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string")


def op1(spark, sf_dir):
    return substring_dedup(documents(spark, sf_dir)).drop("kept_text")


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
dup AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY k) > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM dup, range(0, 35) AS r(j)),
pos AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY p) AS t FROM pos ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
