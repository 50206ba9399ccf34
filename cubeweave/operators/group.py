"""Split-apply-combine: grouping by value, bin, season, several keys, and calendar resampling."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubeweave.cube import Cube
from cubeweave.functions.dates import Frequency, us
from cubeweave.operators.reduce import aggregate


@dataclass(frozen=True)
class Key:
    """A grouping key: a name, the column that gives each cell its group, and, if known, all group labels."""

    name: str
    column: Column
    labels: DataFrame | None = None
    explode: bool = False


def unique(name: str, column: Column | None = None, labels: Sequence[Any] | None = None) -> Key:
    """Groups of equal values; missing values, and with ``labels`` all but these, belong to none."""
    column = F.col(name) if column is None else column
    return Key(name, column if labels is None else F.when(column.isin(list(labels)), column))


def bins(name: str, column: Column, edges: Sequence[float], labels: Sequence[Any] | None = None, right: bool = True, include_lowest: bool = False) -> Key:
    """Half-open intervals between edges, closed on the right by default; values outside belong to none."""
    chain = None
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        low = column >= a if not right or include_lowest and k == 0 else column > a
        high = column <= b if right else column < b
        text = labels[k] if labels is not None else f"({a}, {b}]" if right else f"[{a}, {b})"
        chain = F.when(low & high, F.lit(text)) if chain is None else chain.when(low & high, F.lit(text))
    return Key(name, chain)


def equal_bins(frame: DataFrame, name: str, column: str, n: int) -> Key:
    """``n`` bins of equal width over the values' range, the lowest edge moved out by a thousandth of it.  Runs a job for the range."""
    low, high = frame.agg(F.min(column), F.max(column)).first()
    width = (high - low) / n
    edges = [low + k * width for k in range(n)] + [high]
    edges[0] -= (high - low) * 0.001
    return bins(name, F.col(column), edges)


#: The months' initials, twice, in which season names are looked up.
MONTHS = "JFMAMJJASONDJFMAMJJASOND"


def season_months(name: str) -> list[int]:
    at = MONTHS.find(name)
    if at < 0 or len(name) > 12:
        raise ValueError(f"{name} is no season")
    return [(at + k) % 12 + 1 for k in range(len(name))]


def seasons(name: str, time: Column, wanted: Sequence[str] = ("DJF", "MAM", "JJA", "SON")) -> Key:
    """Groups of months named by their initials; they may overlap, and a cell then counts in each."""
    hits = F.array(*[F.when(F.month(time).isin(season_months(s)), F.lit(s)) for s in wanted])
    return Key(name, F.explode(F.array_compact(hits)), explode=True)


@dataclass(frozen=True)
class Grouped:
    """A cube with grouping keys."""

    cube: Cube
    keys: tuple[Key, ...]
    over: tuple[str, ...] = field(default=())

    @property
    def names(self) -> list[str]:
        return [k.name for k in self.keys]

    @property
    def keep(self) -> list[str]:
        """The dimensions that stay: those that the groups don't reduce."""
        return [d for d in self.cube.dims if d not in self.over and d not in self.names]

    def rows(self) -> DataFrame:
        frame = self.cube.frame
        for k in self.keys:
            frame = frame.withColumn(f"__g_{k.name}", k.column)
            frame = frame.where(F.col(f"__g_{k.name}").isNotNull())
        return frame

    def _result(self, aggregated: DataFrame, names: Sequence[str]) -> Cube:
        dims = [*self.names, *self.keep]
        frame = aggregated.select(*[F.col(f"__g_{n}").alias(n) for n in self.names], *self.keep, *names)
        return Cube(frame, tuple(dims), tuple(names), {}, self.cube.attrs)

    def reduce(self, name: str, ddof: int = 0, min_count: int | None = None) -> Cube:
        """Any reducer for each group: a partial and a final aggregation."""
        out = self.rows().groupBy(*[f"__g_{n}" for n in self.names], *self.keep).agg(*[aggregate(name, F.col(n), ddof, min_count).alias(n) for n in self.cube.names])
        return self._result(out, self.cube.names)

    def agg(self, **named: Column) -> Cube:
        out = self.rows().groupBy(*[f"__g_{n}" for n in self.names], *self.keep).agg(*[c.alias(n) for n, c in named.items()])
        return self._result(out, list(named))

    def quantile(self, q: float) -> Cube:
        return self.agg(**{n: F.percentile(n, F.lit(float(q))) for n in self.cube.names})

    def first(self, order: Column) -> Cube:
        """The first value present, by position."""
        return self.agg(**{n: F.min_by(F.col(n), F.when(F.col(n).isNotNull(), order)) for n in self.cube.names})

    def last(self, order: Column) -> Cube:
        return self.agg(**{n: F.max_by(F.col(n), F.when(F.col(n).isNotNull(), order)) for n in self.cube.names})

    def dense(self, result: Cube) -> Cube:
        """All combinations of group labels, those without cells missing."""
        return result.densify()

    def transform(self, func: Callable[[Column, Column], Column], name: str = "mean") -> Cube:
        """Combine each cell with its group's reduction, e.g. ``lambda x, m: x - m`` for anomalies.

        The reduction is joined back on the key, so a group need not meet in one task.
        """
        groups = [f"__g_{n}" for n in self.names]
        rows = self.rows()
        small = rows.groupBy(*groups, *self.keep).agg(*[aggregate(name, F.col(n)).alias(f"__r_{n}") for n in self.cube.names])
        both = rows.join(small, [*groups, *self.keep])
        return self.cube.with_frame(both.withColumns({n: func(F.col(n), F.col(f"__r_{n}")) for n in self.cube.names}))

    def fillna(self, values: Cube) -> Cube:
        """Fill each group's missing values from a cube over the groups."""
        return self._with(values, lambda x, y: F.coalesce(x, y))

    def where(self, cond: Cube) -> Cube:
        """Keep the cells of groups for which a boolean cube over the groups holds."""
        return self._with(cond, lambda x, y: F.when(y, x))

    def _with(self, other: Cube, func: Callable[[Column, Column], Column]) -> Cube:
        right = other.frame.select(*[F.col(n).alias(f"__g_{n}") for n in self.names], *[F.col(n).alias(f"__o_{n}") for n in other.names])
        both = self.rows().join(right, [f"__g_{n}" for n in self.names], "left")
        pick = lambda n: F.col(f"__o_{n}") if n in other.names else F.col(f"__o_{other.names[0]}")
        return self.cube.with_frame(both.withColumns({n: func(F.col(n), pick(n)) for n in self.cube.names}))

    def assign(self, **new: tuple[str, str]) -> Cube:
        """Each cell's group reduction beside it: ``assign(total=("sum", "v"))``; the reduction is joined back."""
        groups = [f"__g_{n}" for n in self.names]
        rows = self.rows()
        small = rows.groupBy(*groups, *self.keep).agg(*[aggregate(r, F.col(n)).alias(f"__r_{k}") for k, (r, n) in new.items()])
        both = rows.join(small, [*groups, *self.keep]).withColumns({k: F.col(f"__r_{k}") for k in new})
        return self.cube.with_frame(both, names=[*self.cube.names, *[k for k in new if k not in self.cube.names]])

    def assign_coords(self, **new: tuple[str, str]) -> Cube:
        """As :meth:`assign`, as coords."""
        return self.assign(**new).set_coords(*new)

    def map(self, func: Callable[..., Any], schema: str) -> DataFrame:
        """A pandas function for each group; a group has to fit in one task, so this suits small groups."""
        groups = [f"__g_{n}" for n in self.names]
        return self.rows().groupBy(*groups).applyInPandas(func, schema)

    def labels(self) -> list[Any]:
        """The group labels, on the driver, for iteration."""
        return [tuple(r) for r in self.rows().select(*[f"__g_{n}" for n in self.names]).distinct().orderBy(*[f"__g_{n}" for n in self.names]).collect()]

    def __iter__(self):
        for label in self.labels():
            frame = self.rows()
            for n, x in zip(self.names, label):
                frame = frame.where(F.col(f"__g_{n}") == F.lit(x))
            yield label, self.cube.with_frame(frame)

    def shuffle(self) -> Cube:
        """Each group's cells in one partition."""
        return self.cube.with_frame(self.rows().repartition(*[f"__g_{n}" for n in self.names]))


def groupby(cube: Cube, *keys: Key | str, over: Sequence[str] | str | None = None) -> Grouped:
    """Group cells by keys; ``over`` names the dimensions that the groups reduce (all, by default)."""
    made = tuple(unique(k) if isinstance(k, str) else k for k in keys)
    over = cube.dims if over is None else (over,) if isinstance(over, str) else tuple(over)
    return Grouped(cube, made, tuple(over))


def cube_rollup(frame: DataFrame, keys: Sequence[str], aggregates: Mapping[str, Column], kind: str = "cube") -> DataFrame:
    """Grouping sets; ``level`` tells which keys a row has summed over."""
    grouped = frame.cube(*keys) if kind == "cube" else frame.rollup(*keys)
    return grouped.agg(F.grouping_id().alias("level"), *[c.alias(n) for n, c in aggregates.items()])


# -- resampling ------------------------------------------------------------
def bin_start(time: Column, freq: Frequency, origin: Column | None = None, closed: str = "left") -> Column:
    """The start of a time's bin: by calendar unit, or by a fixed length from ``origin``."""
    if freq.months:
        index = F.year(time) * 12 + F.month(time) - 1
        start = F.floor(index / freq.months) * freq.months
        return F.make_timestamp_ntz(F.floor(start / 12).cast("int"), (F.pmod(start, F.lit(12)) + 1).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)"))
    base = us(origin) if origin is not None else F.lit(0)
    offset = us(time) - base
    if closed == "right":
        offset = offset - 1
    step = F.floor(offset / freq.micros).cast("bigint")
    return F.timestamp_add("MICROSECOND", (base + step * freq.micros).cast("bigint"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


@dataclass(frozen=True)
class Resampled:
    """A cube whose time is cut into bins of a frequency."""

    cube: Cube
    dim: str
    freq: Frequency
    closed: str = "left"
    label: str = "left"
    origin: str | None = "start_day"

    def origin_column(self) -> Column:
        """The origin of fixed bins: midnight of the first day, the first time, or the epoch.  Runs a job for the first two."""
        if self.origin == "epoch":
            return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        first = self.cube.frame.agg(F.min(self.dim)).first()[0]
        if self.origin == "start_day" and first is not None:
            first = first.replace(hour=0, minute=0, second=0, microsecond=0)
        return F.lit(first).cast("timestamp_ntz")

    def bins(self) -> DataFrame:
        origin = None if self.freq.months else self.origin_column()
        start = bin_start(F.col(self.dim), self.freq, origin, self.closed)
        return self.cube.frame.withColumn("__bin", start if self.label == "left" else self.freq.after(start))

    def spine(self, binned: DataFrame) -> DataFrame:
        """All bins from the first to the last, with cells or without."""
        ends = binned.agg(F.min("__bin").alias("a"), F.max("__bin").alias("b"))
        return ends.where("a IS NOT NULL").select(F.explode(F.sequence("a", "b", self.freq.interval())).alias(self.dim))

    def reduce(self, name: str, ddof: int = 0, fill: bool = True) -> Cube:
        """A reducer for each bin; empty bins are missing for every reducer, counts included."""
        rest = self.cube.rest(self.dim)
        binned = self.bins()
        out = binned.groupBy("__bin", *rest).agg(*[aggregate(name, F.col(n), ddof).alias(n) for n in self.cube.names]).withColumnRenamed("__bin", self.dim)
        spine = self.spine(binned)
        if fill:
            grid = spine.crossJoin(self.cube.frame.select(*rest).distinct()) if rest else spine
            out = grid.join(out, [self.dim, *rest], "left")
        return self.cube.with_frame(out.select(self.dim, *rest, *self.cube.names), dims=[self.dim, *rest], spines={self.dim: spine}, orders={})

    def agg(self, fill: bool = True, **named: Column) -> Cube:
        """Any aggregates for each bin."""
        rest, binned = self.cube.rest(self.dim), self.bins()
        out = binned.groupBy("__bin", *rest).agg(*[c.alias(n) for n, c in named.items()]).withColumnRenamed("__bin", self.dim)
        spine = self.spine(binned)
        if fill:
            grid = spine.crossJoin(self.cube.frame.select(*rest).distinct()) if rest else spine
            out = grid.join(out, [self.dim, *rest], "left")
        return self.cube.with_frame(out.select(self.dim, *rest, *named), dims=[self.dim, *rest], names=list(named), spines={self.dim: spine}, orders={})

    def asfreq(self) -> Cube:
        return self.reduce("mean")

    def upsample(self, method: str, tolerance: Any = None) -> Cube:
        """pad, backfill or nearest onto the bins of a higher frequency."""
        from cubeweave.operators.align import reindex

        return reindex(self.cube, method, tolerance, **{self.dim: self.spine(self.bins())})

    def interpolate(self) -> Cube:
        """Linear interpolation onto the bins of a higher frequency."""
        from cubeweave.operators.fit import interp

        return interp(self.cube, self.dim, self.spine(self.bins()))

    def map(self, func: Callable[..., Any], schema: str) -> DataFrame:
        return self.bins().groupBy("__bin").applyInPandas(func, schema)


def resample(cube: Cube, dim: str, freq: str, closed: str = "left", label: str = "left", origin: str | None = "start_day") -> Resampled:
    cube.rest(dim)
    return Resampled(cube, dim, Frequency.parse(freq), closed, label, origin)


def season_resample(cube: Cube, dim: str, name: str = "mean", wanted: Sequence[str] = ("DJF", "MAM", "JJA", "SON"), drop_incomplete: bool = True) -> Cube:
    """Consecutive seasons, labelled by the first day of their first month.

    A season that goes over the year's end belongs to the year it began in.  With
    ``drop_incomplete``, the first and the last season go unless all their months
    have cells.
    """
    month, year = F.month(dim), F.year(dim)
    start = None
    for s in wanted:
        ms = season_months(s)
        for m in ms:
            began = year - 1 if m < ms[0] else year
            value = F.struct(F.make_timestamp_ntz(began.cast("int"), F.lit(ms[0]), F.lit(1), F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)")).alias("start"), F.lit(len(ms)).alias("months"))
            start = F.when(month == m, value) if start is None else start.when(month == m, value)
    rest = cube.rest(dim)
    placed = cube.frame.withColumn("__s", start).where("__s IS NOT NULL").withColumn("__start", F.col("__s.start")).withColumn("__need", F.col("__s.months"))
    out = placed.groupBy("__start", *rest).agg(*[aggregate(name, F.col(n)).alias(n) for n in cube.names])
    if drop_incomplete:
        held = placed.groupBy("__start").agg(F.countDistinct(F.month(dim)).alias("__have"), F.max("__need").alias("__need"))
        # Few rows: one for each season of the whole time.
        w = Window.orderBy("__start")
        edge = (F.lag("__start").over(w).isNull()) | (F.lead("__start").over(w).isNull())
        whole = held.withColumn("__edge", edge).where(~F.col("__edge") | (F.col("__have") >= F.col("__need"))).select("__start")
        out = out.join(F.broadcast(whole), "__start", "left_semi")
    return cube.with_frame(out.withColumnRenamed("__start", dim), dims=[dim, *rest], orders={}, spines={})
