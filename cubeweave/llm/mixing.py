"""Mixing sources to target weights by Poisson replication (op 7).

Only DataFrame functions: nothing here runs Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A table of rates is broadcast up to so many sources; beyond it the join deals documents out with a salt.
BROADCAST_SOURCES = 50_000
SALTS = 64
SEED = "mix-1"


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) that a hash of the parts fixes: 52 bits of their MD5."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))


def poisson_table(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... as an array, up to where the rest is below any 52-bit number.

    In logarithms, so a large rate doesn't underflow.  Its length follows the
    rate, which is also the number of copies that a document gets.
    """
    top = F.ceil(rate + 12 * F.sqrt(rate) + 25).cast("int")
    start = F.struct(F.lit(0.0).alias("log_factorial"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("below"))

    def step(acc: Column, k: Column) -> Column:
        log_factorial = acc["log_factorial"] + F.ln(k.cast("double"))
        total = acc["sum"] + F.exp(-rate + k * F.ln(rate) - log_factorial)
        return F.struct(log_factorial.alias("log_factorial"), total.alias("sum"), F.concat(acc["below"], F.array(total)).alias("below"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), top), start, step, lambda acc: acc["below"])).otherwise(F.array(F.lit(1.0)))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, source_col: str = "source") -> DataFrame:
    """Per source: mix_source, n documents, and rate, its documents' mean number of copies.

    A source's share of ``total`` rows (the number of documents, if None) is its
    weight over the sum of weights.  Without ``weights``, all sources weigh the
    same; sources that ``weights`` lacks weigh nothing.  A null source is a source.
    """
    counted = docs.groupBy(F.col(source_col).alias("mix_source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighed = counted.withColumn("weight", F.lit(1.0))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "w_source string, weight double")
        weighed = counted.join(given, F.col("mix_source").eqNullSafe(F.col("w_source")), "left").select("mix_source", "n", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    sums = weighed.agg(F.sum("weight").alias("weights"), F.sum("n").alias("documents"))
    wanted = F.lit(float(total)) if total is not None else F.col("documents").cast("double")
    return weighed.crossJoin(F.broadcast(sums)).select("mix_source", "n", F.coalesce(F.try_divide(wanted * F.col("weight"), F.col("weights") * F.col("n")), F.lit(0.0)).alias("rate"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Repeat each document a Poisson number of times and shuffle all copies.

    The number of copies of a document is the inverse of its source's Poisson
    distribution at a uniform number that a hash of ``seed`` and the document's
    id fixes, so a rerun or another cluster draws the same.  Mean copies times
    documents is the source's share of ``total``.  The copies are then dealt out
    and sorted by a hash of seed, id and copy: a global shuffle.

    Returns the columns of ``docs`` and mix_copy (1, 2, ...), mix_rate (the
    source's rate) and mix_key (the hash).  Columns of ``docs`` of these names
    are replaced, and none may begin with mix_ otherwise.  Null texts and empty texts are documents like others; a null
    source is a source; repeated rows with one id draw alike; an empty table
    gives an empty one.
    """
    docs = docs.drop("mix_copy", "mix_rate", "mix_key", "mix_source", "mix_below", "mix_draw", "mix_n", "mix_own", "mix_salt")
    rates = source_rates(docs, weights, total, source_col).select("mix_source", F.col("rate").alias("mix_rate"), poisson_table(F.col("rate")).alias("mix_below"))
    n_sources = docs.select(source_col).distinct().count()
    if n_sources <= BROADCAST_SOURCES:
        joined = docs.join(F.broadcast(rates), F.col(source_col).eqNullSafe(F.col("mix_source")))
    else:
        salted = rates.withColumn("mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own = docs.withColumn("mix_own", F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int"))
        joined = own.join(salted, F.col(source_col).eqNullSafe(F.col("mix_source")) & (F.col("mix_own") == F.col("mix_salt")))
    draw = uniform(F.lit(seed), F.col(id_col))
    drawn = joined.withColumn("mix_draw", draw).withColumn("mix_n", F.size(F.filter("mix_below", lambda c: c < F.col("mix_draw"))))
    copies = drawn.where("mix_n > 0").select(*docs.columns, "mix_rate", F.explode(F.sequence(F.lit(1), F.col("mix_n"))).alias("mix_copy"))
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed + "-order"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col("mix_copy").cast("string"))), 1, 15), 16, 10).cast("bigint")
    return copies.withColumn("mix_key", key).repartition("mix_key").sortWithinPartitions("mix_key")
