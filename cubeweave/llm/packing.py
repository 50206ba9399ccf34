"""Packing token sequences by power-of-two decomposition (op 10)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cubeweave.llm._scratch import materialise, released_shuffles
from cubeweave.llm.tokens import VOCABULARY, WORD_SLICE_BYTES, slices, table, vocabulary_path

SEQUENCE_TOKENS = 2048
#: A table of so many rows of three numbers, a few MB, is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000
#: Closes each document.
END_ID = 1


def piece_lengths(n: int, longest: int) -> list[int]:
    """A length as whole sequences and, for the rest, one power of two for each bit set, longest first."""
    full, rest = divmod(n, longest)
    return [longest] * full + [1 << b for b in range(longest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, longest: int = SEQUENCE_TOKENS, vocabulary: str = VOCABULARY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Cut each document's ids into pieces of power-of-two length, each of which is a sequence.

    A document is the ids of its whole text followed by ``end_id``; ``longest`` is
    a power of two.  Pieces of equal length share a bucket, and a bucket's pieces
    are numbered without gaps, so a batch of equal sequences is a range of
    sequence ids: no sequence crosses documents and none needs padding.

    Returns per piece: ``id_col``, start (ids of the document before it), length,
    ids_crc32 (of little-endian unsigned 32-bit ids), doc_tokens, sequence_id
    (dense over all pieces, shortest bucket first), offset (always 0) and bucket
    (log2 of the length); with ``with_ids`` also ``ids``, the piece itself.

    A null or empty text is one piece that holds ``end_id``.  Repeated rows are
    packed as often as they occur; an empty table gives no pieces.  Other columns
    are not read.
    """
    if longest & (longest - 1):
        raise ValueError("longest has to be a power of two")
    path_of = vocabulary_path
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "part", "nth"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table(path_of(vocabulary))
        part, seen = TaskContext.get().partitionId(), [0] * (longest + 1)
        for batch in batches:
            for first, texts in slices(batch, size=WORD_SLICE_BYTES):
                ids, ends = known.joined_ids(texts, end_id)
                ids = ids.astype("<u4")
                rows, start, length, crc, total, nth = [], [], [], [], [], []
                view, begin = memoryview(ids).cast("B"), 0
                for row, end in enumerate(ends.tolist(), first):
                    at = begin
                    for n in piece_lengths(end - begin, longest):
                        rows.append(row)
                        start.append(at - begin)
                        length.append(n)
                        crc.append(zlib.crc32(view[4 * at : 4 * (at + n)]))
                        total.append(end - begin)
                        nth.append(seen[n])
                        seen[n] += 1
                        at += n
                    begin = end
                own = batch.column("id").take(pa.array(rows, pa.int64()))
                cols = [own, *(pa.array(x, pa.int64()) for x in (start, length, crc, total)), pa.array([part] * len(rows), pa.int64()), pa.array(nth, pa.int64())]
                if with_ids:
                    # Pieces follow one another as the ids do.
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length))), pa.int32()), pa.array(ids.view("<i4"))))
                yield pa.RecordBatch.from_arrays(cols, names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, part bigint, nth bigint" + ", ids array<int>" * with_ids
    with released_shuffles(docs.sparkSession):
        pieces = materialise(rows.mapInArrow(run, schema), "pieces")
        # A task has numbered its pieces within each length; what the tasks before it have is a row for each task and length.
        made = materialise(pieces.groupBy("length", "part").agg((F.max("nth") + 1).alias("n")), "piece-counts")
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # There are at most log2(longest) + 1 lengths.
    lengths = made.groupBy("length").agg(F.sum("n").alias("n"))
    bases = lengths.select("length", F.coalesce(F.sum("n").over(Window.orderBy("length").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    first = made.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")).join(F.broadcast(bases), "length").select(F.col("length").alias("f_length"), F.col("part").alias("f_part"), (F.col("base") + F.col("before")).alias("first"))
    # The pieces are wide: they stay where they are unless tasks are very many.
    first = F.broadcast(first) if made.count() <= BROADCAST_ROWS else first
    numbered = pieces.join(first, (F.col("length") == F.col("f_length")) & (F.col("part") == F.col("f_part")))
    bucket = F.log2(F.col("length").cast("double")).cast("int")
    out = numbered.select(F.col(f"`{id_col}`"), "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("nth")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"), bucket.alias("bucket"), *(["ids"] * with_ids))
    return out
