"""Packing by concatenate and cut.

Documents become token ids in scan order. The first pass writes ids with their place
inside the scan partition to the shared folder; a prefix sum over partition totals, one row for
each partition, turns places into global offsets; the second pass cuts the stream every
`length` tokens. A document that crosses a cut has a boundary record on either side. No
document is shuffled and only the very last sequence is short.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import _text
from quire.llm._common import documents, materialise, with_package

LENGTH, END_ID = 2048, 1


def ranked_encoder(json_path: str, ranks_path: str, pattern: str):
    """str -> ids of the byte-level BPE in json_path, by its rank file; texts that the fast way refuses take the other."""
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    slow: list = []

    def encode(text: str) -> list[int]:
        try:
            return fast.encode_ordinary(text)
        except BaseException as e:  # a panic of the regular expression engine on extreme white space
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            if not slow:
                slow.append(Tokenizer.from_file(json_path))
                slow[0].encode_special_tokens = True
            return slow[0].encode(text, add_special_tokens=False).ids

    return encode


def public_encoder():
    import public_tokenizers as public

    return ranked_encoder(public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)


def token_table(docs: DataFrame, make_encoder=public_encoder, end_id: int = END_ID) -> DataFrame:
    """part, start, doc_id, n, ids (little-endian unsigned 32-bit) of each row; start is the place in its partition."""
    kind = docs.schema["doc_id"].dataType

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, start, end = make_encoder(), TaskContext.get().partitionId(), 0, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            texts = batch.column(1)
            for first in range(0, batch.num_rows, 256):
                ids = [np.array(encoder(t.as_py() or ""), dtype="<u4").tobytes() + end for t in texts[first : first + 256]]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                starts = start + np.cumsum(n) - n
                start += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part, np.int64)), pa.array(starts), batch.column(0)[first : first + 256], pa.array(n), pa.array(ids, pa.binary())], ["part", "start", "doc_id", "n", "ids"]
                )

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return with_package(rows).mapInArrow(_text.lean(encode), f"part long, start long, doc_id {kind.simpleString()}, n long, ids binary")


def pack(docs: DataFrame, make_encoder=public_encoder, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Repeated rows are packed as often as they occur. No rows: no pieces.
    Columns besides doc_id and text are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    tokens = materialise(token_table(docs, make_encoder, end_id))
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).cast("long").alias("base"))
    # Two integers for each scan partition of the corpus: bounded, and tokens stay where they are.
    placed = tokens.join(F.broadcast(bases), "part").select("doc_id", "n", "ids", (F.col("base") + F.col("start")).alias("at"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, start, size, crc, total, seq, off = [], [], [], [], [], [], []
            for i, (n, ids, at) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True)):
                view, a = ids.as_buffer(), 0
                view = memoryview(view)
                while a < n:
                    take = min(n - a, length - (at + a) % length)
                    doc.append(i), start.append(a), size.append(take), total.append(n)
                    crc.append(zlib.crc32(view[4 * a : 4 * (a + take)]))
                    seq.append((at + a) // length), off.append((at + a) % length)
                    a += take
            longs = [pa.array(x, pa.int64()) for x in (start, size, crc, total, seq, off)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc, pa.int64())), *longs], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return placed.mapInArrow(_text.lean(cut), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op6(spark, sf_dir):
    return pack(documents(spark, sf_dir))
