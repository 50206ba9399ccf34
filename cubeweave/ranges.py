"""Order across partitions: rows dealt out by range once, and blocks of positions that hand over to the next.

A range's number must mean the same wherever it is read.  A shuffle by range
samples its bounds anew each time that its plan runs, so a plan that names
partitions is run once and kept (:func:`kept`); whatever joins on these numbers
reads the kept rows.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Frames of at most so many bytes by Catalyst's own estimate are put in order by one task.
SMALL_BYTES = 8 << 20
#: Positions of a block, where a long series is cut.
BLOCK_ROWS = 1 << 20


def is_small(frame: DataFrame, limit: int | None = None) -> bool:
    """Whether Catalyst's estimate bounds the frame; generators, whose rows it can't foresee, are never small."""
    plan = frame._jdf.queryExecution().optimizedPlan()
    if int(str(plan.stats().sizeInBytes())) > (SMALL_BYTES if limit is None else limit):
        return False
    return "Generate " not in plan.toString()


def kept(frame: DataFrame) -> DataFrame:
    """The frame, run once and held in the checkpoint folder, which outlives executors.  Runs a job.

    The folder is ``spark.checkpoint.dir``; a local session without one gets a
    temporary folder of its own.  Spark removes the files with the last reference
    to them where spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="cubeweave-"))
    return frame.checkpoint()


def dealt(frame: DataFrame, by: Sequence[Column | str]) -> DataFrame:
    """The rows in ranges by ``by``, kept: ``__part`` numbers the ranges in order, ``__at`` a range's rows from 0.  Runs a job."""
    spread = frame.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__id", F.monotonically_increasing_id())
    held = kept(spread)
    inside = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return held.withColumn("__part", F.shiftright("__id", 33)).withColumn("__at", inside).drop("__id")


def number(frame: DataFrame, by: Sequence[Column | str], name: str) -> DataFrame:
    """Adds ``name``: each row's place, from 0, in the order of ``by``.

    A small frame is numbered by one window.  Beyond that rows are dealt out by
    range, once (a job), and a table of one row for each range tells how many rows
    stand before it; nothing then passes through a single task.
    """
    if is_small(frame):
        return frame.withColumn(name, (F.row_number().over(Window.orderBy(*by)) - 1).cast("bigint"))
    held = dealt(frame, by)
    counted = held.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    # One row for each range: shuffle partitions bound it.
    return held.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__off") + F.col("__at")).drop("__part", "__at", "__off")


def in_blocks(frame: DataFrame, pos: str = "__pos") -> DataFrame:
    """``__block``: the block of positions that a row is in; a plain function of its position."""
    return frame.withColumn("__block", F.floor(F.col(pos) / F.lit(BLOCK_ROWS)))


def scan(frame: DataFrame, series: Sequence[str], totals: dict[str, Column], over_blocks: Callable[[str], Column], order: Sequence[Column | str] = ("__block",), reverse: bool = False, block: str = "__block") -> DataFrame:
    """What the blocks before a row's own hold, beside the row.

    ``totals`` are aggregates of a block of a series; ``over_blocks`` turns the
    name of one into an aggregate over all earlier blocks (later ones if
    ``reverse``).  There is one row for each block of a series, so the window over
    them is a BLOCK_ROWS-th of the frame.
    """
    each = frame.groupBy(*series, block).agg(*[c.alias(f"__t_{n}") for n, c in totals.items()])
    w = Window.partitionBy(*series).orderBy(F.col(block).desc() if reverse else F.col(block)).rowsBetween(Window.unboundedPreceding, -1)
    ahead = each.select(*[F.col(s).alias(f"__s{k}") for k, s in enumerate(series)], F.col(block).alias("__b"), *[over_blocks(f"__t_{n}").over(w).alias(n) for n in totals])
    same = F.col(block) == F.col("__b")
    for k, s in enumerate(series):
        same = same & F.col(s).eqNullSafe(F.col(f"__s{k}"))
    return frame.join(ahead, same).drop("__b", *[f"__s{k}" for k in range(len(series))])


def halo(frame: DataFrame, pos: str, block: int, back: int, ahead: int = 0) -> DataFrame:
    """Rows dealt to blocks of positions, each with ``back`` rows of the block before it and ``ahead`` of the one after.

    A window over ``partitionBy("block")`` that reaches no further then runs in as
    many tasks as there are blocks; rows with ``own`` false only serve their neighbours.
    """
    if max(back, ahead) > block:
        raise ValueError("a block has to be as long as its halo")
    at = F.floor(F.col(pos) / F.lit(block))
    place = F.col(pos) - at * F.lit(block)
    copies = F.concat(F.array(at), F.when(place >= block - back, F.array(at + 1)).otherwise(F.array().cast("array<bigint>")), F.when((place < ahead) & (at > 0), F.array(at - 1)).otherwise(F.array().cast("array<bigint>")))
    out = frame.withColumn("block", F.explode(copies))
    return out.withColumn("own", F.floor(F.col(pos) / F.lit(block)) == F.col("block"))
