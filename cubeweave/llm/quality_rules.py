"""Quality rules as weak supervision (op 4): rules vote or abstain, EM weighs them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeweave.llm._scratch import materialise
from cubeweave.llm._shingles import SPACE
from cubeweave.llm.tokens import slices

SYMBOLS = b"#*$%&|<>"
#: Frequent short words of four languages.
STOP_WORDS = (
    "the and of to in that is for with on as are this "
    "der die das und von mit ist den zu ein eine des für "
    "le la les de des et que un une dans pour qui est "
    "el los y en por con del se las una para"
).split()
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_letter_words", "n_upper", "n_letters", "n_shouts", "n_pipes", "n_symbol_words", "n_odd_ends"]


@dataclass(frozen=True)
class Rule:
    """Votes +1 (good) or -1 (bad) by a ratio of two measures, or abstains between the bounds and where the divisor is 0."""

    name: str
    part: str
    whole: str | None
    good_from: float
    good_to: float
    bad_below: float
    bad_above: float

    def vote(self, m: dict[str, float]) -> int:
        if self.whole is not None and not m[self.whole]:
            return 0
        x = m[self.part] / (m[self.whole] if self.whole else 1)
        if x < self.bad_below or x > self.bad_above:
            return -1
        return 1 if self.good_from <= x <= self.good_to else 0


NEVER = math.inf
RULES = (
    Rule("length", "n_words", None, 80, NEVER, 50, NEVER),
    Rule("word_length", "word_chars", "n_words", 2.5, 12, 2, 16),
    Rule("symbols", "n_symbols", "n_words", 0, 0.05, -1, 0.2),
    Rule("pipes", "n_pipes", "n_words", 0, 0.02, -1, 0.15),
    Rule("dup_lines", "n_dup_lines", "n_lines", 0, 0.15, -1, 0.3),
    Rule("repeats", "n_repeat_words", "n_words", 0, 0.2, -1, 0.4),
    Rule("stop_words", "n_stop_words", "n_words", 0.05, 1, 0.02, 1),
    Rule("letters", "n_letter_words", "n_words", 0.85, 1, 0.7, 1),
    Rule("capitals", "n_upper", "n_letters", 0, 0.2, -1, 0.5),
    Rule("shouts", "n_shouts", "n_words", 0, 0.05, -1, 0.3),
    Rule("symbol_words", "n_symbol_words", "n_words", 0, 0.05, -1, 0.2),
    Rule("odd_ends", "n_odd_ends", "n_words", 0, 0.08, -1, 0.25),
)
#: Bounds for what EM finds: of a rule's votes on good documents, the share for good; of those on bad ones, the
#: share for bad; and the share of good documents.
GOOD_RIGHT, BAD_RIGHT, SHARE = (0.7, 0.98), (0.1, 0.9), (0.5, 0.98)
#: Where EM begins, and the weight of that beginning in votes.
START, WEIGHT = (0.8, 0.95, 0.4), 5.0


def repeated_words(ids: np.ndarray, size: int = 3) -> int:
    """Words that lie in a window of ``size`` words that the text has twice or more, the first one included."""
    n = len(ids) - size + 1
    if n < 2:
        return 0
    base = int(ids.max()) + 1
    if base**size < 1 << 62:
        key = np.zeros(n, np.int64)
        for k in range(size):
            key = key * base + ids[k : k + n]
    else:
        key = np.unique(np.stack([ids[k : k + n] for k in range(size)], 1), axis=0, return_inverse=True)[1].ravel()
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    held = np.zeros(len(ids), bool)
    for k in range(size):
        held[k : k + n] |= twice
    return int(held.sum())


_STOP = {w.encode() for w in STOP_WORDS}


def measure(text: bytes) -> list[int]:
    """The MEASURES of one text."""
    words = text.split()
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    times = np.bincount(ids, minlength=len(known)).tolist()
    data = np.frombuffer(text, np.uint8)
    spaces = int(SPACE[data].sum()) if len(data) else 0
    points = len(data) - int(((data & 0xC0) == 0x80).sum())
    lines = [line for line in text.split(b"\n") if line.strip(b" \t\n\r\x0b\x0c")]
    stop = letters = shouts = symbols = odd = 0
    for w, t in zip(known, times, strict=True):
        if w.lower().rstrip(b".,;:!?") in _STOP:
            stop += t
        if any(c >= 128 or 65 <= (c & 0xDF) <= 90 for c in w):
            letters += t
        if w.endswith((b"!!", b"??", b"...")):
            shouts += t
        if len(w.translate(None, SYMBOLS)) < len(w):
            symbols += t
        if not (w[-1] >= 128 or w[-1:].isalnum() or w[-1:] in b".,;:!?\"')]}"):
            odd += t
    upper = int(((data >= 65) & (data <= 90)).sum())
    lower = int(((data >= 97) & (data <= 122)).sum())
    return [len(words), points - spaces, sum(text.count(bytes([c])) for c in SYMBOLS), len(lines) - len(set(lines)), repeated_words(ids), len(lines), stop, letters, upper, upper + lower, shouts, text.count(b"|"), symbols, odd]


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id and the MEASURES of its whole text; a null text has none of anything."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch):
                cols = np.array([measure(t) for t in texts], np.int64).T
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, len(texts)), *map(pa.array, cols)], [id_col, *MEASURES])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{m} bigint" for m in MEASURES))


def votes(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``votes``: one character per rule, + good, - bad, 0 abstains."""
    parts = []
    for r in rules:
        x = F.col(r.part) / F.nullif(F.col(r.whole), F.lit(0)) if r.whole else F.col(r.part).cast("double")
        bad = (x < r.bad_below) if r.bad_above == NEVER else (x < r.bad_below) | (x > r.bad_above)
        good = (x >= r.good_from) if r.good_to == NEVER else (x >= r.good_from) & (x <= r.good_to)
        parts.append(F.when(bad, "-").when(good, "+").otherwise("0"))
    return measured.withColumn("votes", F.concat(*parts))


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class LabelModel:
    """What EM has found: the share of good documents and how often each rule votes rightly on good and on bad ones."""

    share: float
    good_right: tuple[float, ...]
    bad_right: tuple[float, ...]

    def posterior(self, pattern: str) -> float:
        """Probability that a document with these votes is good."""
        odds = math.log(self.share / (1 - self.share))
        for v, g, b in zip(pattern, self.good_right, self.bad_right, strict=True):
            if v == "+":
                odds += math.log(g / (1 - b))
            elif v == "-":
                odds += math.log((1 - g) / b)
        return 1 / (1 + math.exp(-odds)) if odds > -700 else 0.0


def bounded(x: float, by: tuple[float, float]) -> float:
    return min(by[1], max(by[0], x))


def fit(patterns: dict[str, int], rules: tuple[Rule, ...] = RULES, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over counts of vote patterns.

    A rule that votes is right with one accuracy on good documents and another on
    bad ones: most rules find nothing wrong with most bad documents.  Whether it
    abstains tells nothing.  A vote can lose its weight but, by the bounds, not
    turn around: good_right + bad_right is kept at 1 at least.
    """
    model = LabelModel(START[0], (START[1],) * len(rules), (START[2],) * len(rules))
    total = sum(patterns.values())
    for _ in range(rounds):
        good = 0.0
        agree = [[WEIGHT * START[1], WEIGHT * START[2]] for _ in rules]
        said = [[WEIGHT, WEIGHT] for _ in rules]
        for pattern in sorted(patterns):
            n, p = patterns[pattern], model.posterior(pattern)
            good += n * p
            for j, v in enumerate(pattern):
                if v != "0":
                    said[j][0] += n * p
                    said[j][1] += n * (1 - p)
                    agree[j][v == "-"] += n * (p if v == "+" else 1 - p)
        g = tuple(bounded(a[0] / s[0], GOOD_RIGHT) for a, s in zip(agree, said, strict=True))
        b = tuple(max(1 - x, bounded(a[1] / s[1], BAD_RIGHT)) for a, s, x in zip(agree, said, g, strict=True))
        found = LabelModel(bounded(good / total if total else START[0], SHARE), g, b)
        moved = max(abs(x - y) for x, y in zip((found.share, *g, *b), (model.share, *model.good_right, *model.bad_right), strict=True))
        model = found
        if moved < 1e-9:
            break
    return model


def score(docs: DataFrame, least: float = 0.5, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Posterior quality of each document by weak supervision.

    One pass measures whole texts; the counts of the vote patterns of all
    documents that pass the base go to EM.  There are at most 3**len(rules)
    patterns, whatever the input, so the driver gets a table of bounded size.

    Returns per row ``id_col``, the measures of the base (n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words), base_failed, kept (not base_failed,
    and quality >= ``least``), quality (the posterior probability) and votes.

    A null or empty text has no words and fails the base.  Repeated rows give
    repeated results; an empty table gives an empty one.  Other columns are not read.
    """
    spark = docs.sparkSession
    voted = materialise(votes(measures(docs, id_col, text_col), rules), "votes")
    counted = voted.where(~base_failed()).groupBy("votes").count().collect()
    model = fit({r["votes"]: r["count"] for r in counted}, rules)
    every = [r["votes"] for r in voted.select("votes").distinct().collect()]
    known = spark.createDataFrame([(p, model.posterior(p)) for p in every], "v string, quality double")
    scored = voted.join(F.broadcast(known), F.col("votes") == F.col("v"))
    return scored.select(
        F.col(f"`{id_col}`"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & (F.col("quality") >= least)).alias("kept"), "quality", "votes",
    )
