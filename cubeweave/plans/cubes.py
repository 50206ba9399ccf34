"""The cubes that the queries work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeweave.cube import Cube


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def daily(spark: SparkSession, sf: str) -> Cube:
    """Revenue and quantity by day and line status."""
    rows = table(spark, sf, "lineitem")
    value = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    frame = rows.groupBy(F.date_trunc("day", "l_shipdate").alias("day"), F.col("l_linestatus").alias("status")).agg(F.sum(value).alias("revenue"), F.sum("l_quantity").alias("quantity"))
    return Cube.from_spark(frame, ["day", "status"], check=False)


DAILY = "daily AS (SELECT date_trunc('day', l_shipdate) AS day, l_linestatus AS status, sum(l_extendedprice * (1 - l_discount)) AS revenue, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2)"


def gappy(spark: SparkSession, sf: str) -> Cube:
    """Daily quantity with every seventh day of the year missing."""
    c = daily(spark, sf)["quantity"]
    return c.map(lambda x: F.when(F.dayofyear("day") % 7 != 0, x))


GAPPY = DAILY + ", gappy AS (SELECT day, status, CASE WHEN dayofyear(day) % 7 <> 0 THEN quantity END AS quantity FROM daily)"


def nation_segment(spark: SparkSession, sf: str) -> Cube:
    """Mean balance by nation and market segment."""
    frame = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return Cube.from_spark(frame.groupBy(F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("segment")).agg(F.avg("c_acctbal").alias("bal")), ["nation", "segment"], check=False)


NATION = "ns AS (SELECT n_name AS nation, c_mktsegment AS segment, avg(c_acctbal) AS bal FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"


def orders(spark: SparkSession, sf: str) -> Cube:
    frame = table(spark, sf, "orders")
    return Cube.from_spark(frame.select("o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority", "o_orderstatus", "o_custkey"), ["o_orderkey"], check=False)


def part(spark: SparkSession, sf: str) -> Cube:
    return Cube.from_spark(table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"), ["p_partkey"], check=False)


def events(spark: SparkSession, sf: str) -> Cube:
    return Cube.from_spark(table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value", "props"), ["event_id"], check=False)


def hourly(spark: SparkSession, sf: str) -> Cube:
    """Sum of values by hour and event type; hours without events are absent."""
    frame = table(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").alias("hour"), F.col("event_type").alias("kind")).agg(F.sum("value").alias("value"))
    return Cube.from_spark(frame, ["hour", "kind"], check=False)


HOURLY = "hourly AS (SELECT date_trunc('hour', ts) AS hour, event_type AS kind, sum(value) AS value FROM events GROUP BY 1, 2)"


def rounded(frame: DataFrame, digits: int = 4) -> DataFrame:
    """Floats rounded, so results compare by value: the order in which sums are taken differs between engines."""
    cols = [F.round(F.col(c), digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in frame.dtypes]
    return frame.select(*cols)
