"""Fuzzy line deduplication (op 6).

DataFrame functions only: nothing here runs Python on the executors.  What costs
most, the hash of every shingle and its part in every sample, is one generated
loop: an explode over places and a hash aggregation of minima.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubeweave.llm._clusters import classes, components
from cubeweave.llm._scratch import discard, materialise, released_shuffles, resting_on
from cubeweave.llm._shingles import mixed

#: Characters of a shingle, and the least share of shingles that two lines must have in common.
SHINGLE_CHARS, SIMILARITY = 8, 0.8
#: Lines of both fewer words and fewer characters are too short to tell a copy from chance; they are always kept.
LEAST_WORDS, LEAST_CHARS = 5, 2 * SHINGLE_CHARS
#: At a similarity of 0.8 a pair shares no band with probability (1 - 0.8**3)**9 < 0.0016.
BANDS, ROWS = 9, 3
#: Of all samples (those of the bands come first) a pair has to agree in LEAST_AGREEING or so to be compared exactly.
#: That is judged by the low bytes, of which half the bits differ where samples do: at a similarity of 0.8 more than
#: MOST_BITS bits of all differ with probability 0.00003, as much as P(Binomial(32, 0.8) < 16).
SAMPLES, LEAST_AGREEING, MOST_BITS = 32, 16, 72
#: The same for lines beyond the pivots, where pairs are many: with probability 0.000005.
FINE_SAMPLES, MOST_FINE_BITS = 96, 160
#: Lines beyond the pivots are compared in blocks of about so many lines and characters.
BLOCK_LINES, BLOCK_CHARS = 512, 800_000
SPACES = " \t\n\x0b\x0c\r"
#: Scripts that write without spaces: each character counts as a word of a short line.
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
#: Bytes of a character as the shingles are cut.
WIDTH = 4
_BASE = 0x9E3779B97F4A7C15
_MIXED = mixed(np.arange(1, FINE_SAMPLES + 1, dtype=np.uint64) * np.uint64(_BASE))
#: One random order of all shingle hashes for each sample: exclusive or with a fixed number.
XORS = _MIXED.view(np.int64).tolist()


def documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, th (a hash of the text) and text; rows of both equal are one document."""
    return docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("string").alias("text"))


def counted_lines(base: DataFrame, least_words: int) -> DataFrame:
    """A row for each line that counts: id, th, pos (from 0), the trimmed line, node (its 64-bit hash) and at, a hash of its place.

    A line counts if it has LEAST_CHARS characters, or ``least_words`` words.
    """
    lines = base.select("id", "th", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    # A line of n words has 2 n - 1 bytes at least: short ones need no look.
    some = lines.where(F.octet_length("line") >= max(1, min(2 * least_words - 1, LEAST_CHARS)))
    # Trimming looks at each character, so only lines that need it are trimmed.
    loose = F.lit(False)
    for space in SPACES:
        loose = loose | F.startswith("line", F.lit(space)) | F.endswith("line", F.lit(space))
    trimmed = some.withColumn("line", F.when(loose, F.btrim("line", F.lit(SPACES))).otherwise(F.col("line")))
    words = F.regexp_count("line", F.lit(f"[{UNSPACED}]|[^ \\t\\n\\x0b\\x0c\\r{UNSPACED}]+"))
    enough = (F.octet_length("line") >= 4 * LEAST_CHARS) | F.when(F.char_length("line") >= LEAST_CHARS, True).otherwise((F.octet_length("line") > 0) & (words >= least_words))
    return trimmed.where(enough).select("id", "th", "pos", F.xxhash64("line").alias("node"), "line", F.xxhash64("id", "th", "pos").alias("at"))


def places_of(units: Column) -> Column:
    """Where the shingles of a line begin, in its bytes; a shorter line is one shingle."""
    return F.sequence(F.lit(1), F.greatest(F.octet_length(units) - (WIDTH * SHINGLE_CHARS - 1), F.lit(1)), F.lit(WIDTH))


def shingle_at(units: Column, place: Column, hashed: Callable[..., Column] = F.xxhash64) -> Column:
    """The hash of a shingle, of 64 bits if not said otherwise."""
    return hashed(F.substring(units, place, F.lit(WIDTH * SHINGLE_CHARS)))


def sampled(lines: DataFrame, n: int, *more: Column) -> DataFrame:
    """The first ``n`` MinHash samples m0, m1, ... of each node, over all shingles of its line."""
    units = lines.withColumn("units", F.encode("line", "UTF-32")).drop("line")
    each = units.withColumn("place", F.explode(places_of(F.col("units"))))
    hashed = each.withColumn("h", shingle_at(F.col("units"), F.col("place"))).drop("units", "place")
    return hashed.groupBy("node").agg(*more, *[F.min(F.col("h").bitwiseXOR(F.lit(x))).alias(f"m{k}") for k, x in enumerate(XORS[:n])])


def key_columns() -> Column:
    """The keys of a line's bands, from its first samples; keys of different bands differ."""
    return F.array(*[F.xxhash64(F.lit(b), *[F.col(f"m{b * ROWS + r}") for r in range(ROWS)]) for b in range(BANDS)])


def packed_samples(n: int) -> list[Column]:
    """The low bytes of ``n`` samples, eight to a number."""
    out = []
    for k in range(0, n, 8):
        packed = F.lit(0).cast("bigint")
        for j in range(8):
            packed = packed.bitwiseOR(F.shiftleft(F.col(f"m{k + j}").bitwiseAND(F.lit(255).cast("bigint")), 8 * j))
        out.append(packed.alias(f"s{k // 8}"))
    return out


def differing(first: str, second: str, n: int = SAMPLES) -> Column:
    """How many bits of the low bytes of ``n`` samples of two lines differ; of samples that differ half the bits do."""
    total = F.lit(0)
    for k in range(n // 8):
        total = total + F.bit_count(F.col(f"{first}s{k}").bitwiseXOR(F.col(f"{second}s{k}")))
    return total


def shingles(line: Column, hashed: Callable[..., Column] = F.xxhash64) -> Column:
    """Hashes of all distinct shingles of a line."""
    # As a variable of a function, the encoded line is made once and not again at each place.
    return F.get(F.transform(F.array(F.encode(line, "UTF-32")), lambda units: F.array_distinct(F.transform(places_of(units), lambda i: shingle_at(units, i, hashed)))), F.lit(0))


def alike(a: Column, b: Column, similarity: float) -> Column:
    """Whether two lines' Jaccard similarity over all shingles reaches ``similarity``; each set is made once."""

    def enough(s: Column) -> Column:
        shared = F.transform(F.array(F.size(F.array_intersect(s["a"], s["b"]))), lambda n: n >= similarity * (F.size(s["a"]) + F.size(s["b"]) - n))
        # The smaller set bounds what two sets can share.
        return (F.least(F.size(s["a"]), F.size(s["b"])) >= similarity * F.greatest(F.size(s["a"]), F.size(s["b"]))) & F.get(shared, F.lit(0))

    return F.get(F.transform(F.array(F.struct(shingles(a).alias("a"), shingles(b).alias("b"))), enough), F.lit(0))


def exact(pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) of (u, v, x_line, y_line) that are links.

    As a generator, the comparison stays out of the join below it, which then is generated code.
    """
    return pairs.select(F.inline(F.when(alike(F.col("x_line"), F.col("y_line"), similarity), F.array(F.struct("u", "v")))))


def prefixed(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.select(*[F.col(c).alias(f"{prefix}{c}") for c in rows.columns])


def links(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose samples agree enough and whose exact similarity reaches ``similarity``."""
    known = texts.drop("keys")
    both = pairs.join(prefixed(known, "y_"), F.col("v") == F.col("y_node")).join(prefixed(known, "x_"), F.col("u") == F.col("x_node"))
    return materialise(exact(both.where(differing("x_", "y_") <= MOST_BITS).select("u", "v", "x_line", "y_line"), similarity), "line-links")


def block_links(rest: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links that make all components of (key, node, comp), found in pairs of blocks of each bucket.

    Pairs of lines are made by a join that lets through those of different
    components whose samples agree enough.  At first each line is compared with
    three of its partners (the most like it, the least and the greatest), over and
    over while that links one in 32, so that a family of copies becomes one
    component.  Then all pairs that are still of different components are compared
    inside the join by sets of 32-bit hashes, each in the first bucket that it
    shares; only pairs that these don't part are written, and compared exactly.
    """
    sized = rest.select(F.col("key").alias("g"), "node").join(texts.select(F.col("node").alias("t_node"), F.octet_length("line").alias("size")), F.col("node") == F.col("t_node")).select("g", "node", "size")
    blocks = sized.groupBy(F.col("g").alias("b_g")).agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_LINES, F.sum("size") / BLOCK_CHARS)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int")
    dealt = sized.join(blocks, F.col("g") == F.col("b_g")).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = materialise(dealt.select("g", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "node", "own"), "line-blocks")
    comp = materialise(rest.select("node", "comp").distinct(), "line-block-comp")
    sketch = [f"s{k}" for k in range(SAMPLES // 8)]

    def pairs(lines: DataFrame) -> DataFrame:
        known = lines.withColumnRenamed("node", "t_node").join(comp.withColumnRenamed("node", "c_node"), F.col("t_node") == F.col("c_node")).drop("c_node")
        full = dealt.join(known, F.col("node") == F.col("t_node")).drop("t_node").repartition("g", "a", "b")
        met = prefixed(full, "x_").join(prefixed(full, "y_"), [F.col(f"x_{c}") == F.col(f"y_{c}") for c in ("g", "a", "b")] + [F.col("x_node") < F.col("y_node")])
        new = (F.col("x_comp") != F.col("y_comp")) & ((F.col("x_a") == F.col("x_b")) | (F.col("x_own") != F.col("y_own")))
        return met.where(new & (differing("x_", "y_") <= MOST_BITS))

    found: list[DataFrame] = []
    while True:
        met = pairs(texts.select("node", *sketch)).select(F.col("x_node").alias("u"), F.col("y_node").alias("v"), (-differing("x_", "y_")).alias("n"))
        some = met.groupBy("u").agg(F.max(F.struct("n", "v"))["v"].alias("near"), F.min("v").alias("low"), F.max("v").alias("high"))
        tried = materialise(some.select("u", F.explode(F.array("near", "low", "high")).alias("v")).distinct(), "line-block-tried")
        n = tried.count()
        if not n:
            discard(tried)
            break
        found.append(links(tried, texts, similarity))
        discard(tried)
        linked = found[-1].count()
        if linked:
            joined = components(found[-1].unionByName(comp.select(F.col("node").alias("u"), F.col("comp").alias("v"))), "line-block")
            known = joined.select(F.col("node").alias("j_node"), F.col("comp").alias("j_comp"))
            before, comp = comp, materialise(comp.join(known, F.col("node") == F.col("j_node"), "left").select("node", F.coalesce("j_comp", "comp").alias("comp")), "line-block-comp")
            discard(before, joined)
        if 32 * linked < n:
            wanted = comp.select(F.col("node").alias("w_node"))
            open_ = texts.join(wanted, F.col("node") == F.col("w_node"), "left_semi")
            fine = sampled(open_.select("node", "line"), FINE_SAMPLES).select(F.col("node").alias("f_node"), *packed_samples(FINE_SAMPLES))
            lines = materialise(open_.select("node", "keys", shingles(F.col("line"), F.hash).alias("set")).join(fine, F.col("node") == F.col("f_node")).drop("f_node"), "line-block-sets")
            first = F.get(F.array_intersect("x_keys", "y_keys"), F.lit(0)) == F.col("x_g")
            x, y = F.col("x_set"), F.col("y_set")
            shared, total = F.size(F.array_intersect(x, y)), F.size(x) + F.size(y)
            # Sets of 32-bit hashes are smaller by what collides; one in 500 and one more is far above that.
            enough = shared * (1 + similarity) >= similarity * total - total / 500 - 1
            sizes = F.least(F.size(x), F.size(y)) * 1.01 + 1 >= similarity * F.greatest(F.size(x), F.size(y))
            last = pairs(lines).where((differing("x_", "y_", FINE_SAMPLES) <= MOST_FINE_BITS) & sizes & first & enough)
            near = materialise(last.select(F.col("x_node").alias("u"), F.col("y_node").alias("v")), "line-block-near")
            discard(lines)
            found.append(links(near, texts, similarity))
            discard(near)
            break
    discard(dealt, comp)
    out = rest.select(F.col("node").alias("u"), F.col("node").alias("v")).limit(0)
    for part in found:
        out = out.unionByName(part)
    return resting_on(out, *found)


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove from all texts the lines that near-copy an earlier one.

    MinHash samples of character shingles put lines into bands' buckets; lines of
    one bucket are compared exactly, and distributed union-find makes components
    of those alike in ``similarity`` of their shingles or more.  Of all
    occurrences of a component's lines the first stays: that of the least id, and
    there the first.  Lines that are equal but for white space at their ends are
    one node from the start.

    Returns the columns of ``docs``, with the text rewritten, and n_lines and
    n_removed; columns of ``docs`` of these names are replaced.  Lines of both
    fewer than ``least_words`` words (parted by white space; in scripts without
    spaces each character is one) and fewer than LEAST_CHARS characters stay, exact
    copies too, as do all newlines between kept lines.  A null
    text stays null and has 0 lines; a text all of whose lines go is empty.
    Repeated rows (of one id and text) are one document: each row keeps what that
    keeps.  A null id comes before all others.  An empty table gives an empty one.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_removed")
    base = documents(docs, id_col, text_col)
    with released_shuffles(spark):
        # Texts are split in each pass that reads lines: a table of all lines would be as large as the input.
        places = counted_lines(base, least_words)
        # A line's samples are the same at all its places.
        signed = materialise(sampled(places.select("node", "at", "line"), BANDS * ROWS, F.min("at").alias("at")).select("node", "at", key_columns().alias("keys")), "line-signatures")
        # A node's keys differ, for each hash begins with its band.
        buckets = signed.select("node", F.explode("keys").alias("key"))
        kept: list[DataFrame] = []

        def fetch(wanted: DataFrame) -> None:
            """Keep the candidates' lines, once for each."""
            some = signed.join(wanted, "node", "left_semi").select("node", F.col("at").alias("w_at"), "keys")
            # Repeated rows have a place in common; the join has dealt and sorted by it.
            there = places.select("at", "line").join(some, F.col("at") == F.col("w_at")).dropDuplicates(["at"])
            held = materialise(there.select("node", "line", "keys"), "line-texts")
            discard(signed)
            sketches = sampled(held.select("node", "line"), SAMPLES).select(F.col("node").alias("w_node"), *packed_samples(SAMPLES))
            kept.append(materialise(held.join(sketches, F.col("node") == F.col("w_node")).drop("w_node"), "line-sketches"))
            discard(held)

        found = classes(buckets, lambda pairs: links(pairs, kept[0], similarity), lambda rest: block_links(rest, kept[0], similarity), "line", fetch)
        discard(*kept)
        known = found.select(F.col("node").alias("c_node"), "comp")
        placed = materialise(places.select("id", "th", "pos", "node").join(known, F.col("node") == F.col("c_node"), "left").select("id", "th", "pos", F.coalesce("comp", "node").alias("comp")), "line-placed")
        discard(found)
        # Written first, so that the join is of two plain shuffles, whose hot components Spark can split.
        firsts = materialise(placed.groupBy(F.col("comp").alias("f_comp")).agg(F.min(F.struct("id", "th", "pos")).alias("at"), F.count(F.lit(1)).alias("n")).where("n > 1").select("f_comp", "at"), "line-firsts")
        later = placed.join(firsts, F.col("comp") == F.col("f_comp")).where(~F.struct("id", "th", "pos").eqNullSafe(F.col("at")))
        gone = materialise(later.groupBy(F.col("id").alias("ld__id"), F.col("th").alias("ld__th")).agg(F.collect_set("pos").alias("ld__gone")), "line-gone")
        discard(placed, firsts)
    marked = docs.withColumn("ld__own", F.xxhash64(text_col))
    joined = marked.join(gone.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col("ld__id")) & (F.col("ld__own") == F.col("ld__th")), "left")
    ls = F.split(F.col(text_col), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), "ld__gone")
    # As a variable of a function, the text is split once and not again for each line.
    rest = F.get(F.transform(F.array(ls), lambda own: F.array_join(F.transform(left, lambda i: F.get(own, i)), "\n")), F.lit(0))
    text = F.when(F.col("ld__gone").isNull(), F.col(text_col)).otherwise(rest)
    # Newlines and one: only texts that change are split.
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.octet_length(text_col) - F.octet_length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1)
    return joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns], n_lines.cast("bigint").alias("n_lines"), F.when(F.col("ld__gone").isNull(), 0).otherwise(F.size("ld__gone")).cast("bigint").alias("n_removed"))


# The same samples and comparison in numpy, on which tests measure how many pairs are missed.
#: Keeps the last window of one line off the next.
GAP = "\0" * (SHINGLE_CHARS - 1)
ORDERS = (_MIXED[:SAMPLES] >> np.uint64(32)).astype(np.uint32)


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of all lines, and alternately where each line's begin and end; a shorter line is one shingle.

    Between two lines stand windows that cross from one to the next and belong to none.
    """
    chars = np.frombuffer((GAP.join(lines) + GAP + GAP).encode("utf-32-le", "surrogatepass"), "<u4")
    x = chars.astype(np.uint64) + np.uint64(1)
    for width in (1, 2, 4):
        # Hashes of windows of 2, 4 and 8 characters, each from two of half the width.
        x = x[:-width] * np.uint64(pow(_BASE, width, 1 << 64)) + x[width:]
    n = np.fromiter(map(len, lines), np.int64, len(lines))
    starts = np.concatenate(([0], np.cumsum(n[:-1] + len(GAP)))) if len(n) else n
    limits = np.empty(2 * len(n), np.int64)
    limits[::2], limits[1::2] = starts, starts + np.maximum(1, n - SHINGLE_CHARS + 1)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x, limits


def samples(hashes: np.ndarray, limits: np.ndarray, n: int = SAMPLES) -> np.ndarray:
    """The first ``n`` MinHash samples: a row for each line."""
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(limits) // 2, n), np.uint32)
    for k, c in enumerate(ORDERS[:n]):
        out[:, k] = np.minimum.reduceat(high ^ c, limits)[::2]
    return out


def band_keys(found: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each line, from its first samples; keys of different bands differ."""
    keys = np.zeros((len(found), BANDS), np.uint64)
    for k in range(BANDS * ROWS):
        b = k // ROWS
        keys[:, b] = mixed(keys[:, b] * np.uint64(31) + found[:, k] + np.uint64(b + 1))
    return keys.view(np.int64)


def jaccard_reaches(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two ascending arrays of distinct hashes share ``similarity`` of their union."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared >= similarity * (len(both) - shared)


class Shingles(dict):
    """The distinct shingles of a line, ascending; made when first asked for."""

    def __init__(self, hashes: np.ndarray, limits: np.ndarray) -> None:
        self.hashes, self.limits = hashes, limits

    def __missing__(self, line: int) -> np.ndarray:
        own = self[line] = np.unique(self.hashes[self.limits[2 * line] : self.limits[2 * line + 1]])
        return own
