"""Ordinal quality classifier on hashed text (op 2)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeweave.llm._shingles import mixed, word_hashes
from cubeweave.llm.tokens import HASH_SLICE_BYTES, slices

#: Hashed features, as a power of two.
BITS = 20
#: Labelled documents that training takes at most: those of the lowest hash of their id.
TRAINING_DOCS = 12_000
EPOCHS, BATCH, RATE, RIDGE = 14, 64, 0.15, 1e-4
#: A feature is learnt if so many training documents have it; a word of one or two documents only fits their noise.
LEAST_DOCS = 20
GRADES = 3
#: A document is kept if the probability of the top grade reaches this.
LEAST_TAIL = 0.6

_TAIL = np.uint64(0x51ED270B9F2A6E3D)


def grade(quality: F.Column, toxic: F.Column) -> F.Column:
    """Graded rating: 0 poor text, 1 proper text that is toxic, 2 proper text that isn't."""
    return F.when(quality == 0, 0).when(toxic == 1, 1).otherwise(2)


def features(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of texts as sparse rows: row bounds, columns, values.

    Of each text: its words in lower case, the last two bytes of its words, and
    whether a word repeats the one before it.  The value is the logarithm of one
    plus the count for a word, and the share of words for the two others; a
    common word can't outweigh a rare one by its length of text alone.
    """
    low = [t.lower() for t in texts]
    words, bounds = word_hashes(low)
    n = np.diff(bounds)
    owner = np.repeat(np.arange(len(texts)), n)
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    ends = np.flatnonzero(space[1:] & ~space[:-1]) + 1 if len(data) > 1 else np.zeros(0, np.int64)
    last = data[ends - 1].astype(np.uint64) << np.uint64(8) | data[np.maximum(ends - 2, 0)].astype(np.uint64)
    upper = (data[ends - 1] >= 65) & (data[ends - 1] <= 90)
    tails = mixed((last + upper.astype(np.uint64) * np.uint64(1 << 20)) ^ _TAIL)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    mask = np.uint64((1 << bits) - 1)
    width = 1 << bits
    out_rows, out_cols, out_values = [], [], []
    for hashes, share in ((words, False), (tails, True), (mixed(same.astype(np.uint64) + np.uint64(77)), True)):
        key, count = np.unique(owner * width + (hashes & mask).astype(np.int64), return_counts=True)
        row = key // width
        out_rows.append(row)
        out_cols.append(key % width)
        out_values.append(4 * count / n[row] if share else np.log1p(count))
    rows = np.concatenate(out_rows)
    order = np.argsort(rows, kind="stable")
    starts = np.searchsorted(rows[order], np.arange(len(texts) + 1))
    return starts, np.concatenate(out_cols)[order], np.concatenate(out_values)[order].astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def row_sums(starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return total[starts[1:]] - total[starts[:-1]]


@dataclass
class OrdinalModel:
    """P(grade > k) = sigmoid(weights . features - thresholds[k]), thresholds in order; the weights are shared."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, texts: list[bytes]) -> np.ndarray:
        """P(grade > k) for k = 0, 1, ...: a column for each threshold."""
        starts, cols, values = features(texts, int(len(self.weights)).bit_length() - 1)
        scores = row_sums(starts, self.weights[cols] * values)
        return sigmoid(scores[:, None] - self.thresholds[None, :])


def fit(texts: list[bytes], grades: np.ndarray, n_grades: int = GRADES, bits: int = BITS, epochs: int = EPOCHS) -> OrdinalModel:
    """Maximum likelihood of the cumulative-link model by AdaGrad over small batches, in a fixed order.

    P(grade = k) is the difference of two neighbouring tails.  Thresholds are the
    first one plus exponentials, so they stay in order.  Grades weigh by the
    square root of their rarity.
    """
    weights = np.zeros(1 << bits)
    gaps = np.array([-2.0, *[0.0] * (n_grades - 2)])
    if not len(texts):
        return OrdinalModel(weights, np.cumsum(np.concatenate((gaps[:1], np.exp(gaps[1:])))))
    parts = [features(texts[k : k + 256], bits) for k in range(0, len(texts), 256)]
    sizes = np.concatenate([np.diff(p[0]) for p in parts])
    starts = np.concatenate(([0], np.cumsum(sizes)))
    cols, values = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
    values = np.where(np.bincount(cols, minlength=1 << bits)[cols] >= LEAST_DOCS, values, np.float32(0))
    times = np.bincount(grades, minlength=n_grades)
    rarity = np.sqrt(len(grades) / np.maximum(times, 1) / n_grades)
    seen, seen_gaps = np.full(1 << bits, 1e-6), np.full(n_grades - 1, 1e-6)
    turn = np.random.default_rng(7)
    for _ in range(epochs):
        order = turn.permutation(len(texts))
        for a in range(0, len(order), BATCH):
            rows = order[a : a + BATCH]
            n = sizes[rows]
            own = np.concatenate(([0], np.cumsum(n)))
            at = np.repeat(starts[rows] - own[:-1], n) + np.arange(own[-1])
            c, v, y = cols[at], values[at], grades[rows]
            thresholds = np.cumsum(np.concatenate((gaps[:1], np.exp(gaps[1:]))))
            score = row_sums(own, weights[c] * v)
            tail = np.concatenate((np.ones((len(rows), 1)), sigmoid(score[:, None] - thresholds), np.zeros((len(rows), 1))), 1)
            slope = tail * (1 - tail)
            pick = np.arange(len(rows))
            p = np.maximum(tail[pick, y] - tail[pick, y + 1], 1e-9)
            w = rarity[y] / len(rows)
            d_score = -(slope[pick, y] - slope[pick, y + 1]) / p * w
            d_threshold = np.zeros(n_grades - 1)
            np.add.at(d_threshold, np.maximum(y - 1, 0), np.where(y > 0, slope[pick, y] / p * w, 0))
            np.add.at(d_threshold, np.minimum(y, n_grades - 2), np.where(y < n_grades - 1, -slope[pick, y + 1] / p * w, 0))
            d_gaps = np.cumsum(d_threshold[::-1])[::-1] * np.concatenate(([1.0], np.exp(gaps[1:])))
            touched, inverse = np.unique(c, return_inverse=True)
            g = np.bincount(inverse, np.repeat(d_score, n) * v, len(touched)) + RIDGE * weights[touched]
            seen[touched] += g * g
            weights[touched] -= RATE * g / np.sqrt(seen[touched])
            seen_gaps += d_gaps * d_gaps
            gaps -= RATE * d_gaps / np.sqrt(seen_gaps)
    return OrdinalModel(weights, np.cumsum(np.concatenate((gaps[:1], np.exp(gaps[1:])))))


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = TRAINING_DOCS) -> list:
    """At most ``bound`` labelled documents: those whose id has the lowest hash.

    Labels without a quality or whose document is missing or null are left out.
    """
    rated = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min(grade(F.col("quality"), F.col("toxic"))).alias("grade"))
    some = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    # Its size is bounded by ``bound``.
    own = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(some), "doc_id").where("text IS NOT NULL")
    return sorted(own.select("doc_id", "grade", "text").collect(), key=lambda r: (r["doc_id"], bytes(r["text"])))


def score(docs: DataFrame, model: OrdinalModel, least: float = LEAST_TAIL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Expected grade and tail probabilities of each whole text.

    Returns per row ``id_col``, expected_grade, p_above_0 and p_above_1
    (probabilities of a grade above 0, and above 1) and kept: the probability of
    the top grade is ``least`` or more.  A null or empty text is scored as one
    without any feature.  Repeated rows give repeated results, an empty table an
    empty one; other columns are not read.
    """
    top = len(model.thresholds)
    sent = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))
    names = [id_col, "expected_grade", *(f"p_above_{k}" for k in range(top)), "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = OrdinalModel(*sent.value)
        for batch in batches:
            for first, texts in slices(batch, size=HASH_SLICE_BYTES):
                tails = known.tails(texts)
                cols = [batch.column("id").slice(first, len(texts)), pa.array(tails.sum(1)), *(pa.array(t) for t in tails.T), pa.array(tails[:, -1] >= least)]
                yield pa.RecordBatch.from_arrays(cols, names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, expected_grade double, " + ", ".join(f"p_above_{k} double" for k in range(top)) + ", kept boolean")


def classify(docs: DataFrame, labels: DataFrame, least: float = LEAST_TAIL, bound: int = TRAINING_DOCS) -> DataFrame:
    """Fit on at most ``bound`` labelled documents, then :func:`score` all documents."""
    rows = training_rows(docs, labels, bound)
    model = fit([bytes(r["text"]) for r in rows], np.array([r["grade"] for r in rows], np.int64))
    return score(docs, model, least)
