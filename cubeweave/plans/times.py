"""Queries of dates, times and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from cubeweave.cube import Cube
from cubeweave.functions import dates as D
from cubeweave.operators import group as G
from cubeweave.operators import window as W
from cubeweave.plans import query
from cubeweave.plans import cubes as C
from cubeweave.plans.cubes import DAILY, HOURLY, rounded

_FIELDS = {
    "year": "year(t)", "month": "month(t)", "day": "day(t)", "hour": "hour(t)", "minute": "minute(t)", "second": "second(t)", "weekofyear": "week(t)", "weekday": "isodow(t) - 1", "dayofyear": "dayofyear(t)",
    "quarter": "quarter(t)", "days_in_month": "day(last_day(t))", "is_month_start": "day(t) = 1", "is_month_end": "CAST(t AS DATE) = last_day(t)", "is_year_start": "dayofyear(t) = 1",
    "is_quarter_start": "CAST(t AS DATE) = CAST(date_trunc('quarter', t) AS DATE)", "is_year_end": "month(t) = 12 AND day(t) = 31", "is_quarter_end": "month(t) % 3 = 0 AND CAST(t AS DATE) = last_day(t)",
    "is_leap_year": "(year(t) % 4 = 0 AND year(t) % 100 <> 0) OR year(t) % 400 = 0", "iso_year": "isoyear(t)", "iso_weekday": "isodow(t)",
    "season": "CASE WHEN month(t) IN (12, 1, 2) THEN 'DJF' WHEN month(t) IN (3, 4, 5) THEN 'MAM' WHEN month(t) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END",
    "days_in_year": "CASE WHEN (year(t) % 4 = 0 AND year(t) % 100 <> 0) OR year(t) % 400 = 0 THEN 366 ELSE 365 END",
}
_FLAGS = {k for k in _FIELDS if k.startswith("is_")} | {"season"}


@query("SELECT event_id, " + ", ".join(f"{s} AS {k}" if k in _FLAGS else f"CAST({s} AS INTEGER) AS {k}" for k, s in _FIELDS.items()) + " FROM (SELECT event_id, ts AS t FROM events)")
def dt_fields_events(spark, sf):
    e = C.table(spark, sf, "events")
    return e.select("event_id", *[(D.FIELDS[k](F.col("ts")) if k in _FLAGS else D.FIELDS[k](F.col("ts")).cast("int")).alias(k) for k in _FIELDS])


@query("SELECT o_orderkey, " + ", ".join(f"{s} AS {k}" if k in _FLAGS else f"CAST({s} AS INTEGER) AS {k}" for k, s in _FIELDS.items()) + " FROM (SELECT o_orderkey, o_orderdate AS t FROM orders)")
def dt_fields_orders(spark, sf):
    e = C.table(spark, sf, "orders")
    return e.select("o_orderkey", *[(D.FIELDS[k](F.col("o_orderdate")) if k in _FLAGS else D.FIELDS[k](F.col("o_orderdate")).cast("int")).alias(k) for k in _FIELDS])


@query("SELECT event_id, make_timestamp(CAST(floor(epoch_us(ts) / 900000000.0::DOUBLE) AS BIGINT) * 900000000) AS low, make_timestamp(CAST(ceil(epoch_us(ts) / 900000000.0::DOUBLE) AS BIGINT) * 900000000) AS high FROM events")
def dt_floor_ceil(spark, sf):
    return C.table(spark, sf, "events").select("event_id", D.snap(F.col("ts"), "15min").alias("low"), D.snap(F.col("ts"), "15min", "ceil").alias("high"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d %H-%M') AS text FROM orders")
def dt_strftime(spark, sf):
    return C.table(spark, sf, "orders").select("o_orderkey", D.strftime(F.col("o_orderdate"), "%Y/%m/%d %H-%M").alias("text"))


@query("SELECT o_orderkey, round(year(o_orderdate) + date_diff('microsecond', date_trunc('year', o_orderdate), o_orderdate) / date_diff('microsecond', date_trunc('year', o_orderdate), date_trunc('year', o_orderdate) + INTERVAL 1 YEAR)::DOUBLE, 9) AS y FROM orders")
def dt_decimal_year(spark, sf):
    return C.table(spark, sf, "orders").select("o_orderkey", F.round(D.decimal_year(F.col("o_orderdate")), 9).alias("y"))


@query("WITH d AS (SELECT event_id, date_diff('microsecond', TIMESTAMP '2024-01-10 00:00:00', ts) AS n FROM events) SELECT event_id, CAST(floor(n / 86400000000.0::DOUBLE) AS BIGINT) AS days, round(n / 1e6, 6) AS total_seconds FROM d")
def timedelta_fields(spark, sf):
    n = D.us(F.col("ts")) - D.us(F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))
    return C.table(spark, sf, "events").select("event_id", D.DURATION["days"](n).alias("days"), F.round(D.DURATION["total_seconds"](n), 6).alias("total_seconds"))


@query("SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-12-01', INTERVAL 1 MONTH)) AS time")
def date_range_months(spark, sf):
    return D.date_range(spark, "2024-01-01 00:00:00", "2024-12-01 00:00:00", "MS")


@query("SELECT o_orderkey FROM orders WHERE NOT (month(o_orderdate) = 2 AND day(o_orderdate) = 29)")
def convert_calendar_noleap(spark, sf):
    return D.to_noleap(C.table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate").select("o_orderkey")


@query("SELECT 'D' AS freq")
def infer_freq_daily(spark, sf):
    axis = D.date_range(spark, "2024-01-01 00:00:00", "2024-03-01 00:00:00", "D")
    return spark.createDataFrame([(D.infer_freq(axis, "time"),)], "freq string")


# -- resampling ----------------------------------------------------------------
def _event_cube(spark, sf):
    return Cube(C.table(spark, sf, "events").select("ts", "event_type", "value"), ("ts", "event_type"), ("value",))


def _spined(step: str, trunc: str, agg: str) -> str:
    return (
        f"WITH b AS (SELECT {trunc} AS ts, event_type, {agg} AS value FROM events GROUP BY 1, 2), s AS (SELECT unnest(generate_series((SELECT min(ts) FROM b), (SELECT max(ts) FROM b), INTERVAL {step})) AS ts), "
        "g AS (SELECT s.ts, t.event_type FROM s, (SELECT DISTINCT event_type FROM events) t) SELECT g.ts, g.event_type, round(b.value, 3) AS value FROM g LEFT JOIN b USING (ts, event_type)"
    )


@query(_spined("1 DAY", "date_trunc('day', ts)", "avg(value)"))
def resample_day_mean(spark, sf):
    return rounded(G.resample(_event_cube(spark, sf), "ts", "D").reduce("mean").frame, 3)


@query(_spined("48 HOUR", "TIMESTAMP '2024-01-01' + to_hours(CAST(48 * floor(date_diff('microsecond', (SELECT date_trunc('day', min(ts)) FROM events), ts) / 172800000000.0::DOUBLE) AS INTEGER)) + ((SELECT date_trunc('day', min(ts)) FROM events) - TIMESTAMP '2024-01-01')", "sum(value)"))
def resample_48h_sum(spark, sf):
    return rounded(G.resample(_event_cube(spark, sf), "ts", "48h").reduce("sum").frame, 3)


@query("WITH b AS (SELECT date_trunc('month', o_orderdate) AS o_orderdate, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2), s AS (SELECT unnest(generate_series((SELECT min(o_orderdate) FROM b), (SELECT max(o_orderdate) FROM b), INTERVAL 1 MONTH)) AS o_orderdate), g AS (SELECT o_orderdate, o_orderpriority FROM s, (SELECT DISTINCT o_orderpriority FROM orders)) SELECT g.o_orderdate, g.o_orderpriority, CAST(b.n AS DOUBLE) AS o_totalprice FROM g LEFT JOIN b USING (o_orderdate, o_orderpriority)")
def resample_month_count(spark, sf):
    c = Cube(C.table(spark, sf, "orders").select("o_orderdate", "o_orderpriority", "o_totalprice"), ("o_orderdate", "o_orderpriority"), ("o_totalprice",))
    return G.resample(c, "o_orderdate", "MS").reduce("count").astype("double").frame


@query("SELECT date_trunc('quarter', o_orderdate) AS o_orderdate, o_orderstatus, round(max(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY 1, 2")
def resample_quarter_max(spark, sf):
    c = Cube(C.table(spark, sf, "orders").select("o_orderdate", "o_orderstatus", "o_totalprice"), ("o_orderdate", "o_orderstatus"), ("o_totalprice",))
    return rounded(G.resample(c, "o_orderdate", "QS").reduce("max", fill=False).frame, 2)


@query(f"WITH {HOURLY}, k AS (SELECT DISTINCT kind FROM hourly), s AS (SELECT unnest(generate_series((SELECT min(hour) FROM hourly), (SELECT max(hour) FROM hourly), INTERVAL 30 MINUTE)) AS hour), g AS (SELECT hour, kind FROM s, k) SELECT g.hour, g.kind, round(h.value, 4) AS value FROM g ASOF JOIN (SELECT * FROM hourly WHERE value IS NOT NULL) h ON g.kind = h.kind AND g.hour >= h.hour")
def upsample_pad_by_kind(spark, sf):
    c = C.hourly(spark, sf)
    grid = G.resample(c, "hour", "30min", origin="epoch").reduce("sum")
    return rounded(W.ffill(grid, "hour").frame.where("value IS NOT NULL"))


@query("WITH m AS (SELECT *, CASE WHEN month(o_orderdate) = 12 THEN make_timestamp(year(o_orderdate), 12, 1, 0, 0, 0) WHEN month(o_orderdate) < 3 THEN make_timestamp(year(o_orderdate) - 1, 12, 1, 0, 0, 0) ELSE make_timestamp(year(o_orderdate), 3 * ((month(o_orderdate)) // 3), 1, 0, 0, 0) END AS s FROM orders), c AS (SELECT s, count(DISTINCT month(o_orderdate)) AS have FROM m GROUP BY 1), k AS (SELECT s FROM c WHERE have = 3 OR (s <> (SELECT min(s) FROM c) AND s <> (SELECT max(s) FROM c))) SELECT s AS o_orderdate, round(avg(o_totalprice), 3) AS o_totalprice FROM m WHERE s IN (SELECT s FROM k) GROUP BY 1")
def season_resample_mean(spark, sf):
    c = Cube(C.table(spark, sf, "orders").select("o_orderdate", "o_totalprice"), ("o_orderdate",), ("o_totalprice",))
    return rounded(G.season_resample(c, "o_orderdate").frame, 3)


@query(f"WITH {DAILY}, m AS (SELECT date_trunc('month', day) AS month, status, sum(revenue) AS revenue FROM daily GROUP BY 1, 2), s AS (SELECT unnest(generate_series((SELECT min(month) FROM m), (SELECT max(month) FROM m), INTERVAL 1 MONTH)) AS month), g AS (SELECT month, status FROM s, (SELECT DISTINCT status FROM m)), f AS (SELECT g.month, g.status, m.revenue FROM g LEFT JOIN m USING (month, status)) SELECT month AS day, status, CASE WHEN count(revenue) OVER w >= 3 THEN round(avg(revenue) OVER w, 2) END AS revenue FROM f WINDOW w AS (PARTITION BY status ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def monthly_revenue_rolling(spark, sf):
    """The flagship: daily cube, monthly resampling with empty months, three-month rolling mean."""
    monthly = G.resample(C.daily(spark, sf)["revenue"], "day", "MS").reduce("sum")
    empty = monthly.map(lambda c: F.nullif(c, F.lit(0.0)))
    return rounded(W.rolling(empty, "day", 3, "mean").frame, 2)
