"""Shared working storage and session settings for the multi-pass operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir`` where the session has it; only where that is
    unset (a local session, as in tests) a temporary folder takes its place.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _OWN.setdefault(context.applicationId, tempfile.mkdtemp(prefix="cubeweave-"))


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/cubeweave/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    The files outlive any executor, so later passes neither recompute the plan
    nor depend on one copy of a cached block.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", codec).parquet(path)
    return resting_on(spark.read.schema(df.schema).parquet(path), path)


def resting_on(df: DataFrame, *below: DataFrame | str) -> DataFrame:
    """Notes on ``df`` the folders that it reads: paths, or those noted on other frames."""
    df._passes = [path for x in below for path in ([x] if isinstance(x, str) else x.__dict__.get("_passes", []))]
    return df


def discard(*frames: DataFrame) -> None:
    """Delete the files of materialised frames that no later pass reads; others are left alone."""
    for df in frames:
        spark = df.sparkSession
        for path in df.__dict__.get("_passes", []):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def released_shuffles(spark: SparkSession):
    """Within the block, Spark removes a query's shuffle files when the query ends.

    Each pass of a multi-pass operator ends in :func:`materialise`, so its
    shuffle files are of no further use and would only add up on disk.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
