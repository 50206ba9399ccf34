"""Media columns by content-defined chunking (op 5)."""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeweave.llm._scratch import fresh_path, materialise, released_shuffles
from cubeweave.llm.tokens import slices

#: A payload's length is a positive multiple of this.
UNIT = 192
PAD = 32
#: Samples a second of the 8-bit mono stream.
RATE = 8000
#: A cut follows a byte where the gear hash of the last WINDOW bytes has MASK_BITS zero bits.
WINDOW, MASK_BITS = 16, 10
LEAST_CHUNK, MOST_CHUNK = 256, 8192

_GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)


def payload(text: bytes) -> bytes:
    """A text's bytes, padded with spaces to a positive multiple of UNIT."""
    short = -len(text) % UNIT if text else UNIT
    return text + bytes([PAD]) * short


def wave(samples: bytes) -> bytes:
    """A RIFF WAVE stream: one channel of unsigned 8-bit PCM samples."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples))
    return head + samples


def samples_of(media: bytes) -> bytes:
    """The samples of a stream that :func:`wave` has made; raises if it is no such stream."""
    riff, size, kind, fmt, _, code, channels, _, _, _, bits, tag, n = struct.unpack_from("<4sI4s4sIHHIIHH4sI", media)
    if (riff, kind, fmt, code, channels, bits, tag) != (b"RIFF", b"WAVE", b"fmt ", 1, 1, 8, b"data") or n != len(media) - 44 or size != n + 36:
        raise ValueError("no 8-bit PCM stream")
    return media[44:]


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling gear hash at each byte: the sum of its window's gears, each shifted by its distance.

    Shifts of WINDOW and more leave the bits in question, so sums of 1, 2, 4, ...
    bytes, each made of two of the ones before, give the hash at all bytes at once.
    """
    h, span = _GEAR[data], 1
    while span < WINDOW:
        wider = h.copy()
        wider[span:] += h[:-span] << np.uint32(span)
        h, span = wider, span * 2
    return h


def cuts(data: bytes) -> list[int]:
    """Where the chunks of a stream end."""
    n = len(data)
    if n <= LEAST_CHUNK:
        return [n]
    h = gear(np.frombuffer(data, np.uint8))
    mask = np.uint32(((1 << MASK_BITS) - 1) << (WINDOW - MASK_BITS))
    ends, at = [], 0
    for c in (np.flatnonzero((h & mask) == 0) + 1).tolist():
        while c - at > MOST_CHUNK:
            at += MOST_CHUNK
            ends.append(at)
        if c - at >= LEAST_CHUNK:
            at = c
            ends.append(at)
    while n - at > MOST_CHUNK:
        at += MOST_CHUNK
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def feature(samples: bytes) -> str:
    """A digest of the samples as JSON: peak, mean and power in integers, and the counts of eight equal ranges."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    levels = np.arange(256)
    return json.dumps({"n": len(x), "min": int(x.min()), "max": int(x.max()), "sum": int(counts @ levels), "power": int(counts @ (levels - 128) ** 2), "crossings": int(np.count_nonzero(np.diff((x >= 128).view(np.int8)))), "levels": counts.reshape(8, 32).sum(1).tolist()}, separators=(",", ":"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text (null: empty) as bytes and key, the text's digest; equal texts are one stream."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("key"), text.cast("binary").alias("text"))


def chunk_lists(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, key, n_bytes of the text and the digests of its stream's chunks, in order."""
    rows = _rows(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch):
                lists = []
                for t in texts:
                    media = wave(payload(t))
                    ends = cuts(media)
                    lists.append([hashlib.sha256(media[a:b]).digest() for a, b in zip([0, *ends], ends)])
                cols = [batch.column(c).slice(first, len(texts)) for c in ("id", "key")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([len(t) for t in texts], pa.int64()), pa.array(lists, pa.list_(pa.binary()))], ["id", "key", "n_bytes", "digests"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, key binary, n_bytes bigint, digests array<binary>")


def shared_chunks(lists: DataFrame) -> DataFrame:
    """Per stream that has any: its chunks whose digest occurs more than once among all streams.

    ``at`` holds structs (pos, owner_key, owner_pos): the place in this stream and
    the one whose bytes are stored, the least of all.
    """
    streams = lists.select("key", "digests").dropDuplicates(["key"])
    places = streams.select("key", F.posexplode("digests").alias("pos", "digest"))
    owners = places.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "pos")).alias("owner")).where("n > 1")
    owners = owners.select(F.col("digest").alias("o_digest"), F.col("owner.key").alias("owner_key"), F.col("owner.pos").alias("owner_pos"))
    found = places.join(owners, F.col("digest") == F.col("o_digest"))
    return found.groupBy("key").agg(F.collect_list(F.struct("pos", "owner_key", "owner_pos")).alias("at"))


STORE_SCHEMA = (
    "key binary, media_sha256 string, n_chunks int, own array<struct<pos:int,bytes:binary>>, "
    "shared array<struct<pos:int,bytes:binary>>, refs array<struct<pos:int,owner_key:binary,owner_pos:int>>"
)


def write_store(docs: DataFrame, shared: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write one row per distinct stream: its chunk list, and the bytes of the chunks that it owns.

    own: chunks that no other stream has; shared: chunks whose bytes are here and
    which others refer to; refs: chunks whose bytes another place owns.  So each
    distinct chunk's bytes are stored once, beside most of their neighbours.
    Texts travel compressed to the task that writes them.
    """
    pair = pa.struct([("pos", pa.int32()), ("bytes", pa.binary())])
    ref = pa.struct([("pos", pa.int32()), ("owner_key", pa.binary()), ("owner_pos", pa.int32())])

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeezer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for first, texts in slices(batch):
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(first, len(texts)), pa.array([squeezer.compress(t) for t in texts], pa.binary())], ["key", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        opener = zstandard.ZstdDecompressor()
        for batch in batches:
            for first, packed in slices(batch):
                keys = batch.column("key").slice(first, len(packed)).to_pylist()
                places = batch.column("at").slice(first, len(packed)).to_pylist()
                cols: list[list] = [[], [], [], [], []]
                for key, text, at in zip(keys, packed, places, strict=True):
                    media = wave(payload(opener.decompress(text)))
                    ends = cuts(media)
                    own, lent, refs = [], [], []
                    known = {p["pos"]: p for p in at or ()}
                    for pos, (a, b) in enumerate(zip([0, *ends], ends)):
                        p = known.get(pos)
                        if p is None:
                            own.append((pos, media[a:b]))
                        elif (p["owner_key"], p["owner_pos"]) == (key, pos):
                            lent.append((pos, media[a:b]))
                        else:
                            refs.append((pos, p["owner_key"], p["owner_pos"]))
                    for c, x in zip(cols, (hashlib.sha256(media).hexdigest(), len(ends), own, lent, refs), strict=True):
                        c.append(x)

                def listed(rows: list[list[tuple]], kind: pa.StructType) -> pa.Array:
                    flat = [x for r in rows for x in r]
                    parts = [pa.array([x[k] for x in flat], kind.field(k).type) for k in range(kind.num_fields)]
                    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(r) for r in rows]))), pa.int32()), pa.StructArray.from_arrays(parts, fields=list(kind)))

                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(first, len(packed)), pa.array(cols[0]), pa.array(cols[1], pa.int32()), listed(cols[2], pair), listed(cols[3], pair), listed(cols[4], ref)],
                    ["key", "media_sha256", "n_chunks", "own", "shared", "refs"],
                )

    texts = _rows(docs, id_col, text_col).select("key", "text").mapInArrow(squeeze, "key binary, text binary").dropDuplicates(["key"])
    placed = texts.join(shared.withColumnRenamed("key", "s_key"), F.col("key") == F.col("s_key"), "left").select("key", "text", "at")
    placed.mapInArrow(run, STORE_SCHEMA).write.option("compression", "zstd").parquet(path)


MEDIA_SCHEMA = "key binary, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def read_streams(stored: DataFrame) -> DataFrame:
    """Put each stream together again from its chunk list, verify its digest and describe what was read.

    Most streams own all their chunks and need no exchange.  For the others,
    refs meet the shared chunks of their owners in a join and travel to the
    stream; no other bytes move.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                parts = {p["pos"]: p["bytes"] for c in ("own", "shared", "fetched") for p in row[c] or ()}
                media = b"".join(parts[k] for k in range(row["n_chunks"]))
                if hashlib.sha256(media).hexdigest() != row["media_sha256"]:
                    raise ValueError(f"stream {row['key'].hex()} differs from what was stored")
                samples = samples_of(media)
                cols = [[row["key"]], [len(samples)], [hashlib.sha256(samples).hexdigest()], [zlib.crc32(samples[-16:])], [len(media)], [row["media_sha256"]], [feature(samples)]]
                kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["key", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    whole = stored.where(F.size("refs") == 0).select("key", "media_sha256", "n_chunks", "own", "shared", F.lit(None).cast("array<struct<pos:int,bytes:binary>>").alias("fetched"))
    parted = stored.where(F.size("refs") > 0)
    wanted = parted.select("key", F.explode("refs").alias("r")).select("key", "r.*")
    lent = stored.where(F.size("shared") > 0).select(F.col("key").alias("l_key"), F.explode("shared").alias("s")).select("l_key", F.col("s.pos").alias("l_pos"), F.col("s.bytes").alias("bytes"))
    fetched = wanted.join(lent, (F.col("owner_key") == F.col("l_key")) & (F.col("owner_pos") == F.col("l_pos")))
    lists = fetched.groupBy(F.col("key").alias("f_key")).agg(F.collect_list(F.struct("pos", "bytes")).alias("fetched"))
    joined = parted.join(lists, F.col("key") == F.col("f_key")).select("key", "media_sha256", "n_chunks", "own", "shared", "fetched")
    return whole.unionByName(joined).mapInArrow(run, MEDIA_SCHEMA)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Store every text as a media stream in a deduplicated chunk store, read it back and describe it.

    The payload is the text's UTF-8 bytes with spaces up to a positive multiple of
    192 bytes; the stream is those bytes as 8-bit PCM samples after a RIFF WAVE
    header.  A rolling gear hash cuts streams into chunks where their content says
    so, so texts that share passages share chunks.  The store is written to
    ``path`` (by default a new folder in the shared folder).

    Returns per row ``id_col``, n_bytes (of the text), and of what was read back:
    payload_bytes, payload_sha256, tail_crc32 (of the last 16 payload bytes),
    media_bytes and media_sha256 (of the stream) and feature (JSON).

    A null text is an empty one: 192 spaces.  Equal texts, equal values; repeated
    rows give repeated results, an empty table an empty one.  Other columns are
    not read.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "media")
    with released_shuffles(spark):
        lists = materialise(chunk_lists(docs, id_col, text_col), "chunk-lists")
        write_store(docs, materialise(shared_chunks(lists), "shared-chunks"), path, id_col, text_col)
        streams = materialise(read_streams(spark.read.schema(STORE_SCHEMA).parquet(path)), "streams")
    found = lists.select("id", "n_bytes", F.col("key").alias("d_key")).join(streams, F.col("d_key") == F.col("key"))
    return found.select(F.col("id").alias(id_col), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
