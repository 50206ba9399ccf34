"""Near-duplicate documents by consistent weighted sampling (op 1)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cubeweave.llm._clusters import classes
from cubeweave.llm._scratch import materialise, released_shuffles
from cubeweave.llm._shingles import mixed, window_hashes, word_hashes
from cubeweave.llm.tokens import HASH_SLICE_BYTES, slices

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: A band is ROWS samples; documents that agree in one of BANDS bands are candidates.
#: At a similarity of 0.8 a pair is missed with probability (1 - 0.8**3)**10 < 0.001.
BANDS, ROWS = 10, 3
#: Document frequencies are counted in 2**SKETCH_BITS cells, in parts of PART cells.
SKETCH_BITS, PART = 20, 1 << 14
#: A shingle's weight is its count times 1 + IDF * (1 - ln(df) / ln(documents)).
IDF = 0.1
TABLE_BITS = 16
#: Buckets are compared, beyond the pivots, in blocks of about so many documents and compressed bytes.
BLOCK_DOCS, BLOCK_BYTES = 384, 4_000_000
#: Columns of a block's matrix at once.
MATRIX_COLUMNS = 4096


@cache
def samples() -> tuple[np.ndarray, ...]:
    """Tables of the random variables of improved consistent weighted sampling, and a multiplier pair for each sample.

    r and c follow Gamma(2, 1), beta is uniform.  A hash of shingle and sample picks
    the entry, so equal shingles draw equal variables in all documents.
    """
    rng = np.random.default_rng(20100101)
    n = 1 << TABLE_BITS
    u = rng.random((5, n))
    r = -np.log(u[0] * u[1])
    odd = rng.integers(1 << 62, 1 << 63, (2, BANDS * ROWS), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    return r.astype(np.float32), (1 / r).astype(np.float32), u[4].astype(np.float32), np.log(-np.log(u[2] * u[3])).astype(np.float32), odd[0], odd[1]


def shingle_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: its distinct shingles in ascending order and their counts; and the texts' bounds in these."""
    words, bounds = word_hashes(texts)
    hashes, owner = window_hashes(words, bounds, SHINGLE_WORDS)
    # 48 bits of hash below 16 bits of text; slices hold fewer texts.
    out_hash, out_count, sizes = [], [], []
    for a in range(0, len(texts), 1 << 16):
        own = (owner >= a) & (owner < a + (1 << 16)) if len(texts) > 1 << 16 else slice(None)
        key = ((owner[own] - a).astype(np.uint64) << np.uint64(48)) | (hashes[own] >> np.uint64(16))
        key.sort()
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        out_count.append(np.diff(np.concatenate((first, [len(key)]))))
        out_hash.append(key[first] & np.uint64((1 << 48) - 1))
        sizes.append(np.bincount((key[first] >> np.uint64(48)).astype(np.int64), minlength=min(1 << 16, len(texts) - a)))
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(1, np.int64)
    return np.concatenate(out_hash), np.concatenate(out_count), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))


class Weights:
    """Weights of shingles from the sketch of document frequencies."""

    def __init__(self, cells: np.ndarray, documents: int) -> None:
        noise = cells.sum(dtype=np.float64) / len(cells)
        # What other shingles add to a cell is the mean, give or take three of its standard deviations.
        df = np.clip(cells - noise - 3 * math.sqrt(noise), 1, max(2, documents))
        self.of_cell = (1 + IDF * (1 - np.log(df) / math.log(max(2, documents)))).astype(np.float32)

    def __call__(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return counts.astype(np.float32) * self.of_cell[(hashes >> np.uint64(48 - SKETCH_BITS)).astype(np.int64)]


def band_keys(hashes: np.ndarray, weights: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Keys of all bands of each text that has a shingle: a row per such text."""
    r_of, inverse_of, beta_of, log_c_of, odd_r, odd_c = samples()
    has = np.diff(bounds) > 0
    starts = bounds[:-1][has]
    if not len(starts):
        return np.zeros((0, BANDS), np.int64)
    owner = np.repeat(np.arange(len(starts)), np.diff(bounds)[has])
    spread = mixed(hashes)
    log_w = np.log(weights)
    shift = np.uint64(64 - TABLE_BITS)
    keys = np.zeros((len(starts), BANDS), np.uint64)
    for d in range(BANDS * ROWS):
        i = ((spread * odd_r[d]) >> shift).astype(np.int64)
        r, beta = r_of[i], beta_of[i]
        t = np.floor(log_w * inverse_of[i] + beta)
        log_a = log_c_of[((spread * odd_c[d]) >> shift).astype(np.int64)] - r * (t - beta + 1)
        low = np.minimum.reduceat(log_a, starts)
        at = np.flatnonzero(log_a == low[owner])
        at = at[np.searchsorted(owner[at], np.arange(len(starts)))]
        sample = mixed(hashes[at] * np.uint64(0x9E3779B97F4A7C15) + t[at].astype(np.int64).astype(np.uint64))
        keys[:, d // ROWS] = mixed(keys[:, d // ROWS] * np.uint64(31) + sample + np.uint64(d + 1))
    return keys.view(np.int64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the lesser weights over sum of the greater, of two texts' ascending shingles and weights."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    high = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64)) - low
    return low / high if high else 0.0


def sketch(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Cells of document frequencies over all texts of ``rows`` (text as bytes), and the number of texts.

    Each task counts its texts in one array of fixed size; arrays are added part by
    part in two levels, so no task adds more than about the root of their number.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, n = np.zeros(1 << SKETCH_BITS, np.int64), 0
        for batch in batches:
            for _, texts in slices(batch, size=HASH_SLICE_BYTES):
                hashes, _, _ = shingle_counts(texts)
                cells += np.bincount((hashes >> np.uint64(48 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
                n += len(texts)
        task = TaskContext.get().partitionId()
        parts = [cells[k : k + PART].astype("<i8").tobytes() for k in range(0, len(cells), PART)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([task] * len(parts), pa.int32()), pa.array([n] + [0] * (len(parts) - 1), pa.int64()), pa.array(parts, pa.binary())], ["part", "task", "n", "cells"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(PART, np.int64)
        for c in table.column("cells"):
            total += np.frombuffer(c.as_py(), "<i8")
        return pa.table({"part": table.column("part")[:1], "task": pa.array([0], pa.int32()), "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "cells": pa.array([total.tobytes()], pa.binary())})

    schema = "part int, task int, n bigint, cells binary"
    counted = rows.select("text").mapInArrow(count, schema)
    groups = max(1, math.isqrt(rows.rdd.getNumPartitions() or 1))
    some = counted.groupBy("part", (F.col("task") % groups).alias("group")).applyInArrow(lambda _, t: add(t), schema)
    whole = sorted(some.groupBy("part").applyInArrow(lambda _, t: add(t), schema).collect(), key=lambda r: r["part"])
    if not whole:
        return np.zeros(1 << SKETCH_BITS, np.int64), 0
    return np.concatenate([np.frombuffer(r["cells"], "<i8") for r in whole]), sum(r["n"] for r in whole)


def near_duplicate_classes(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The class of near-duplicates of each document.

    Documents are multisets of windows of five words, weighted by count and
    (damped) inverse document frequency.  Improved consistent weighted sampling
    draws 30 samples of each; documents that agree in all samples of a band are
    candidates, and a link is a weighted Jaccard similarity of ``similarity`` or
    more, computed on whole texts.  A class is a component of links; equal texts
    are one node from the start, whatever their number.

    Returns per row ``id_col``, node (the text's digest), comp (the least node of
    its class, which names the class even where ids are null or repeat), class_id
    (the least id of its class) and class_size (its rows).

    A null text is in a class of its own (by its id).  Texts without a word have no
    windows: only equal ones share a class.  A text of one to four words is one
    window.  Repeated rows are copies of each other; an empty table gives an empty
    one.  Other columns are not read.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(text)).alias("node"), text.cast("binary").alias("text"))
    with released_shuffles(spark):
        full = rows.where("text IS NOT NULL")
        weigh = spark.sparkContext.broadcast(Weights(*sketch(full)))

        def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, texts in slices(batch, size=HASH_SLICE_BYTES):
                    hashes, counts, bounds = shingle_counts(texts)
                    keys = band_keys(hashes, weigh.value(hashes, counts), bounds)
                    n = np.where(np.diff(bounds) > 0, BANDS, 0)
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(keys.ravel()))
                    own = batch.slice(first, len(texts))
                    yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), lists], ["id", "node", "keys"])

        kind = rows.schema["id"].dataType.simpleString()
        signed = materialise(full.mapInArrow(sign, f"id {kind}, node binary, keys array<bigint>"), "signatures")
        nodes = signed.groupBy("node").agg(F.min("id").alias("id"), F.first("keys").alias("keys"))
        buckets = nodes.select(F.explode("keys").alias("key"), "node")
        kept: list[DataFrame] = []

        def fetch(wanted: DataFrame) -> None:
            """Keep the candidates' texts, compressed, once for each node."""
            holders = signed.select("node", "id").join(wanted.withColumnRenamed("node", "w_node"), F.col("node") == F.col("w_node")).groupBy("node").agg(F.min("id").alias("h_id")).withColumnRenamed("node", "h_node")
            found = squeezed(full).join(holders, (F.col("node") == F.col("h_node")) & F.col("id").eqNullSafe(F.col("h_id")))
            kept.append(materialise(found.select("node", "text"), "candidates", "uncompressed"))

        def verify(pairs: DataFrame) -> DataFrame:
            texts = kept[0]
            first = texts.select(F.col("node").alias("a_node"), F.col("text").alias("a_text"))
            second = texts.select(F.col("node").alias("b_node"), F.col("text").alias("b_text"))
            both = pairs.join(second, F.col("v") == F.col("b_node")).join(first, F.col("u") == F.col("a_node")).select("u", "v", "a_text", "b_text")
            return materialise(both.mapInArrow(linker(weigh, similarity), "u binary, v binary"), "links")

        def finish(rest: DataFrame) -> DataFrame:
            """Compare each bucket in pairs of blocks; a task returns no more links than it has documents."""
            held = rest.select(F.col("key").alias("g"), "node", "comp")
            sized = held.join(kept[0].select(F.col("node").alias("t_node"), F.octet_length("text").alias("bytes")), F.col("node") == F.col("t_node")).select("g", "node", "comp", "bytes")
            blocks = sized.groupBy(F.col("g").alias("b_g")).agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_DOCS, F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
            own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int")
            dealt = sized.join(blocks, F.col("g") == F.col("b_g")).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            dealt = dealt.select("g", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "node", "comp")
            texts = kept[0].select(F.col("node").alias("t_node"), "text")
            full = dealt.join(texts, F.col("node") == F.col("t_node")).select("g", "a", "b", "node", "comp", "text")
            return materialise(full.groupBy("g", "a", "b").applyInArrow(block_linker(weigh, similarity), "u binary, v binary"), "block-links")

        found = materialise(classes(buckets, verify, finish, "near", fetch), "near-classes")
        known = found.select(F.col("node").alias("c_node"), "comp")
        nulls = rows.where("text IS NULL").select("id", "node")
        placed = signed.select("id", "node").join(known, F.col("node") == F.col("c_node"), "left").select("id", "node", F.coalesce("comp", "node").alias("comp"))
        # Written first, so that the join is of two plain shuffles, whose hot classes Spark can split.
        sizes = materialise(placed.groupBy(F.col("comp").alias("s_comp")).agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size")), "near-sizes")
        out = placed.join(sizes, F.col("comp") == F.col("s_comp")).select("id", "node", "comp", "class_id", "class_size")
        alone = nulls.groupBy(F.col("id").alias("n_id")).agg(F.count(F.lit(1)).alias("class_size"))
        empty = nulls.join(alone, F.col("id").eqNullSafe(F.col("n_id"))).select("id", "node", F.lit(None).cast("binary").alias("comp"), F.col("id").alias("class_id"), "class_size")
        return materialise(out.unionByName(empty), "near-result").withColumnRenamed("id", id_col)


def squeezed(rows: DataFrame) -> DataFrame:
    """Rows of id, node and text with the text compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeezer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for first, texts in slices(batch, size=HASH_SLICE_BYTES):
                own = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array([squeezer.compress(t) for t in texts], pa.binary())], ["id", "node", "text"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, node binary, text binary")


def linker(weigh, similarity: float):
    """Keeps the pairs whose texts' weighted Jaccard similarity reaches ``similarity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        opener = zstandard.ZstdDecompressor()
        known: dict[bytes, tuple] = {}
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                names = [part.column(0).to_pylist(), part.column(1).to_pylist()]
                lacking: dict[bytes, int] = {}
                for ids, column in zip(names, (2, 3)):
                    for k, node in enumerate(ids):
                        if node not in known:
                            lacking.setdefault(node, column << 32 | k)
                texts = [opener.decompress(part.column(w >> 32)[w & 0xFFFFFFFF].as_py()) for w in lacking.values()]
                hashes, counts, bounds = shingle_counts(texts)
                weights = weigh.value(hashes, counts)
                for node, x, y in zip(lacking, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    known[node] = (hashes[x:y], weights[x:y])
                linked = [weighted_jaccard(known[u], known[v]) >= similarity for u, v in zip(*names, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["u", "v"]).filter(pa.array(linked))
                # Only the last pivot is likely to come again.
                known = {names[0][-1]: known[names[0][-1]]}

    return run


def block_linker(weigh, similarity: float):
    """Links among the documents of one pair of blocks that join components, by exact weighted Jaccard similarity."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        import zstandard

        opener = zstandard.ZstdDecompressor()
        nodes, comps = table.column("node").to_pylist(), table.column("comp").to_pylist()
        hashes, counts, bounds = shingle_counts([opener.decompress(t.as_py()) for t in table.column("text")])
        n = len(nodes)
        # A shingle that occurs k times is k columns, so the sum of lesser weights is a product of zero-one rows.
        row = np.repeat(np.repeat(np.arange(n), np.diff(bounds)), counts)
        copy = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        name = np.repeat(hashes, counts) * np.uint64(0x9E3779B97F4A7C15) + copy.astype(np.uint64)
        weight = np.repeat(weigh.value(hashes, np.ones(len(hashes), np.int64)), counts).astype(np.float64)
        total = np.bincount(row, weight, n)
        _, column, times = np.unique(name, return_inverse=True, return_counts=True)
        shared = times[column] > 1
        row, column, weight = row[shared], np.unique(column[shared], return_inverse=True)[1], weight[shared]
        common = np.zeros((n, n), np.float32)
        for a in range(0, int(column.max()) + 1 if len(column) else 0, MATRIX_COLUMNS):
            own = (column >= a) & (column < a + MATRIX_COLUMNS)
            part = np.zeros((n, min(MATRIX_COLUMNS, int(column.max()) + 1 - a)), np.float32)
            part[row[own], column[own] - a] = np.sqrt(weight[own])
            common += part @ part.T
        close = common >= similarity * (total[:, None] + total[None, :] - common) * (1 - 1e-6)
        at = {c: k for k, c in enumerate(dict.fromkeys(comps))}
        label = np.array([at[c] for c in comps])
        us, vs = [], []
        for i in range(n):
            for j in np.flatnonzero(close[i] & (label != label[i])).tolist():
                if label[j] != label[i]:
                    us.append(nodes[i])
                    vs.append(nodes[j])
                    label[label == label[j]] = label[i]
        return pa.table({"u": pa.array(us, pa.binary()), "v": pa.array(vs, pa.binary())})

    return run


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, less all but one of each near-duplicate class: the one of the least id.

    A null id is the last choice, and of texts of that id in one class the least
    node stays.  Of repeated rows one is kept; rows of null text stay.  All columns
    of ``docs`` are returned.
    """
    found = near_duplicate_classes(docs, similarity, id_col, text_col)
    # Ids may be null or repeat in several classes, so a class is known by its least node and its survivor by id and node.
    least = found.where(F.col("node").isNotNull() & F.col(id_col).eqNullSafe(F.col("class_id")))
    held = least.groupBy("comp").agg(F.min("node").alias("nd_node"), F.min("class_id").alias("nd_id")).select("nd_id", "nd_node")
    marked = docs.withColumn("nd_own", F.unhex(F.md5(F.col(text_col).cast("string"))))
    joined = marked.where("nd_own IS NOT NULL").join(held, F.col(id_col).eqNullSafe(F.col("nd_id")) & (F.col("nd_own") == F.col("nd_node")))
    first = joined.withColumn("nd_rank", F.row_number().over(Window.partitionBy(F.col(id_col), "nd_own").orderBy(F.lit(0)))).where("nd_rank = 1")
    return first.select(*docs.columns).unionByName(marked.where("nd_own IS NULL").select(*docs.columns))
