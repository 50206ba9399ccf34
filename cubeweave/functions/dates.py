"""Dates and times: fields, frequencies, rounding, axes and calendars."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cubeweave import ranges
from cubeweave.ranges import halo, is_small, number

#: Microseconds of each fixed unit.
MICROS = {"us": 1, "ms": 1_000, "s": 1_000_000, "min": 60_000_000, "h": 3_600_000_000, "D": 86_400_000_000, "W": 604_800_000_000}
#: Months of each calendar unit.
MONTHS = {"MS": 1, "ME": 1, "M": 1, "QS": 3, "QE": 3, "Q": 3, "YS": 12, "YE": 12, "Y": 12}
EPOCH = "1970-01-01 00:00:00"


def us(time: Column) -> Column:
    """Microseconds since the epoch, without a detour through the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit(EPOCH).cast("timestamp_ntz"), time.cast("timestamp_ntz"))


def from_us(n: Column) -> Column:
    return F.timestamp_add("MICROSECOND", n.cast("bigint"), F.lit(EPOCH).cast("timestamp_ntz"))


@dataclass(frozen=True)
class Frequency:
    """A step in time: whole months, or microseconds."""

    months: int = 0
    micros: int = 0

    @classmethod
    def parse(cls, text: str) -> Frequency:
        m = re.fullmatch(r"(\d*)\s*([A-Za-z]+)(?:-[A-Z]{3})?", text)
        n, unit = int(m[1] or 1), m[2] if m else ""
        if unit in MONTHS:
            return cls(months=n * MONTHS[unit])
        unit = {"H": "h", "T": "min", "S": "s", "d": "D"}.get(unit, unit)
        if unit not in MICROS:
            raise ValueError(f"no frequency {text}")
        return cls(micros=n * MICROS[unit])

    def interval(self) -> Column:
        if self.months:
            return F.expr(f"INTERVAL {self.months} MONTH")
        return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(self.micros / 1e6).cast("decimal(18,6)"))

    def after(self, time: Column) -> Column:
        return time + self.interval()


def snap(time: Column, freq: str, how: str = "floor") -> Column:
    """Floor, ceil or round (half to even) to a fixed frequency."""
    step = Frequency.parse(freq).micros
    x = us(time) / F.lit(step)
    whole = F.floor(x) if how == "floor" else F.ceil(x) if how == "ceil" else F.rint(x)
    return from_us(whole.cast("bigint") * step)


#: C format codes and this engine's letters for them.
STRFTIME = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%p": "a", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%j": "DDD", "%%": "%"}


def strftime(time: Column, text: str) -> Column:
    parts = re.split(r"(%.)", text)
    out = "".join(STRFTIME[p] if p in STRFTIME and p != "%%" else "'" + p.replace("'", "''") + "'" if p and p != "%%" else "'%'" if p else "" for p in parts)
    return F.date_format(time, out)


def _first_of(time: Column, unit: str) -> Column:
    return F.to_date(time) == F.to_date(F.date_trunc(unit, time))


def _last_of(time: Column, unit: str, months: int) -> Column:
    return F.to_date(time) == F.date_sub(F.add_months(F.to_date(F.date_trunc(unit, time)), months), 1)


def decimal_year(time: Column) -> Column:
    start = F.date_trunc("year", time)
    end = F.add_months(start, 12).cast("timestamp_ntz")
    return F.year(time) + (us(time) - us(start)) / (us(end) - us(start))


def _leap(time: Column) -> Column:
    return F.dayofmonth(F.last_day(F.make_date(F.year(time), F.lit(2), F.lit(1)))) == 29


FIELDS: dict[str, Callable[[Column], Column]] = {
    "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": lambda t: F.floor(F.second(t)).cast("int"),
    "microsecond": lambda t: F.pmod(us(t), F.lit(1_000_000)), "nanosecond": lambda t: F.when(t.isNotNull(), 0), "weekofyear": F.weekofyear, "week": F.weekofyear,
    "weekday": F.weekday, "dayofweek": F.weekday, "day_of_week": F.weekday, "dayofyear": F.dayofyear, "day_of_year": F.dayofyear, "quarter": F.quarter,
    "days_in_month": lambda t: F.dayofmonth(F.last_day(t)), "daysinmonth": lambda t: F.dayofmonth(F.last_day(t)),
    "season": lambda t: F.element_at(F.array(*[F.lit(s) for s in ("DJF", "MAM", "JJA", "SON")]), (F.floor(F.month(t) / 3) % 4 + 1).cast("int")),
    "date": F.to_date, "time": lambda t: F.date_format(t, "HH:mm:ss.SSSSSS"), "is_month_start": lambda t: F.dayofmonth(t) == 1, "is_month_end": lambda t: F.last_day(t) == F.to_date(t),
    "is_quarter_start": lambda t: _first_of(t, "quarter"), "is_quarter_end": lambda t: _last_of(t, "quarter", 3), "is_year_start": lambda t: _first_of(t, "year"),
    "is_year_end": lambda t: _last_of(t, "year", 12), "is_leap_year": _leap, "days_in_year": lambda t: F.when(_leap(t), 366).otherwise(365), "decimal_year": decimal_year,
    "iso_year": lambda t: F.extract(F.lit("YEAROFWEEK"), t), "iso_week": F.weekofyear, "iso_weekday": lambda t: F.weekday(t) + 1, "calendar": lambda t: F.lit("proleptic_gregorian"),
}


def isocalendar(time: Column) -> Column:
    return F.struct(FIELDS["iso_year"](time).alias("year"), F.weekofyear(time).alias("week"), (F.weekday(time) + 1).alias("weekday"))


#: Fields of a duration given in microseconds.
DURATION: dict[str, Callable[[Column], Column]] = {
    "days": lambda n: F.floor(n / MICROS["D"]), "seconds": lambda n: F.floor(F.pmod(n, F.lit(MICROS["D"])) / 1_000_000), "microseconds": lambda n: F.pmod(n, F.lit(1_000_000)),
    "nanoseconds": lambda n: F.when(n.isNotNull(), 0), "total_seconds": lambda n: n / 1e6,
}


def date_range(spark: SparkSession, start: str, end: str, freq: str, name: str = "time", inclusive: str = "both") -> DataFrame:
    """A time axis."""
    step = Frequency.parse(freq).interval()
    axis = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"), step)).alias(name))
    if inclusive in ("right", "neither"):
        axis = axis.where(F.col(name) > F.lit(start).cast("timestamp_ntz"))
    if inclusive in ("left", "neither"):
        axis = axis.where(F.col(name) < F.lit(end).cast("timestamp_ntz"))
    return axis


def infer_freq(index: DataFrame, name: str) -> str | None:
    """The frequency of an axis, or None if its steps differ.  Runs a job on the index."""
    labels = index.select(name).distinct()
    if is_small(labels):
        steps = labels.withColumn("__p", F.lag(name).over(Window.orderBy(name))).where("__p IS NOT NULL")
    else:
        held = halo(number(labels, [F.col(name)], "__place"), "__place", ranges.BLOCK_ROWS, 1)
        steps = held.withColumn("__p", F.lag(name).over(Window.partitionBy("block").orderBy("__place"))).where("own AND __p IS NOT NULL")
    both = steps.select((us(F.col(name)) - us(F.col("__p"))).alias("u"), ((F.year(name) - F.year("__p")) * 12 + F.month(name) - F.month("__p")).alias("m"), (F.dayofmonth(name) == F.dayofmonth("__p")).alias("same"))
    r = both.agg(F.min("u"), F.max("u"), F.min("m"), F.max("m"), F.every("same")).first()
    if r[0] is None:
        return None
    if r[0] == r[1]:
        for unit in ("D", "h", "min", "s", "ms", "us"):
            if r[0] % MICROS[unit] == 0:
                n = r[0] // MICROS[unit]
                return unit if n == 1 else f"{n}{unit}"
    if r[2] == r[3] and r[4] and r[2] > 0:
        for unit, months in (("YS", 12), ("QS", 3), ("MS", 1)):
            if r[2] % months == 0:
                n = r[2] // months
                return unit if n == 1 else f"{n}{unit}"
    return None


def to_noleap(frame: DataFrame, name: str) -> DataFrame:
    """Convert to a calendar without leap days: 29 February goes."""
    return frame.where(~((F.month(name) == 2) & (F.dayofmonth(name) == 29)))


def to_360_day(time: Column) -> Column:
    """A date in the calendar of twelve months of 30 days, by its share of the year: (year, month, day)."""
    place = F.floor((F.dayofyear(time) - 1) * 360 / F.when(_leap(time), 366).otherwise(365)).cast("int")
    return F.struct(F.year(time).alias("year"), (F.floor(place / 30) + 1).cast("int").alias("month"), (place % 30 + 1).alias("day"))
