"""Cubes over streams: an extension, with the batch operators' semantics where both exist."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def resample_stream(rows: DataFrame, time: str, width: str, aggregates: dict[str, Column], by: Sequence[str] = (), late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Tumbling (or sliding) windows of event time; rows later than ``late`` are left out and finished windows leave the state."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    out = rows.withWatermark(time, late).groupBy(window.alias("__w"), *by).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(F.col("__w.start").alias(time), *by, *aggregates)


def sessions_stream(rows: DataFrame, time: str, gap: str, by: Sequence[str], aggregates: dict[str, Column], late: str = "10 minutes") -> DataFrame:
    """Sessions: runs of rows of one key no further apart than ``gap``."""
    out = rows.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("__w"), *by).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(F.col("__w.start").alias("start"), F.col("__w.end").alias("end"), *by, *aggregates)


def deduplicate_stream(rows: DataFrame, time: str, keys: Sequence[str], late: str = "10 minutes") -> DataFrame:
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def append_to(frame: DataFrame, path: str, checkpoint: str, each: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Append finished windows to a Parquet cube, exactly once."""
    out = each(frame) if each else frame
    return out.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
