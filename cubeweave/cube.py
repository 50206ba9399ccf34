"""The labelled cube: named dimensions, coordinate labels and variables in one long frame."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubeweave.functions.math import nn
from cubeweave.operators.arithmetic import Arithmetic
from cubeweave.ranges import number


class AlignmentError(ValueError):
    """Indexes that had to agree don't."""


@dataclass(frozen=True)
class Cube(Arithmetic):
    """Variables over named dimensions, as one row for each cell that is present.

    ``frame`` holds a key column for each of ``dims`` (its labels), a column for
    each of ``names`` and, beside them, any ``coords``: columns that follow from
    keys.  Missing is NULL, or a row that isn't there.  The order of a dimension
    is that of its labels unless ``orders`` names a frame (label, pos) for it.
    Plans are lazy; nothing here runs a job unless its description says so.
    """

    frame: DataFrame
    dims: tuple[str, ...]
    names: tuple[str, ...]
    coords: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    attrs: Mapping[str, Any] = field(default_factory=dict)
    var_attrs: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)
    orders: Mapping[str, DataFrame] = field(default_factory=dict)
    spines: Mapping[str, DataFrame] = field(default_factory=dict)
    #: Indexes made so far: a plan that is named twice is planned, or run, once.
    _made: dict[str, DataFrame] = field(default_factory=dict, init=False, repr=False, compare=False)

    # -- making and leaving ------------------------------------------------
    @classmethod
    def from_spark(cls, frame: DataFrame, dims: Sequence[str], names: Sequence[str] | None = None, coords: Mapping[str, Sequence[str]] | None = None, check: bool = True, **attrs: Any) -> Cube:
        """A cube from a tidy frame.  With ``check`` one job raises if two rows share a key."""
        coords = {k: tuple(v) for k, v in (coords or {}).items()}
        names = tuple(names) if names is not None else tuple(c for c in frame.columns if c not in dims and c not in coords)
        # Missing means NULL: NaN of float columns is turned into it once, here.
        floats = {f.name for f in frame.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
        frame = frame.select(*dims, *[nn(F.col(c)).alias(c) if c in floats else F.col(c) for c in (*names, *coords)])
        if check and dims and not frame.groupBy(*dims).count().where("count > 1").isEmpty():
            raise ValueError("two rows have the same key")
        return cls(frame, tuple(dims), names, coords, attrs)

    @classmethod
    def from_dict(cls, spark: SparkSession, data: Mapping[str, Any]) -> Cube:
        """Inverse of :meth:`to_dict`."""
        rows = [tuple(r) for r in data["rows"]]
        return cls(spark.createDataFrame(rows, data["schema"]), tuple(data["dims"]), tuple(data["names"]), {k: tuple(v) for k, v in data["coords"].items()}, data["attrs"])

    @classmethod
    def from_series(cls, spark: SparkSession, series: Any, name: str | None = None) -> Cube:
        """A pandas series, whose index levels become dimensions."""
        name = name or series.name or "value"
        frame = series.rename(name).reset_index()
        return cls.from_spark(spark.createDataFrame(frame), [c for c in frame.columns if c != name], [name])

    def to_spark(self) -> DataFrame:
        return self.frame

    def to_dict(self) -> dict[str, Any]:
        """Everything as plain values; collects the cells."""
        return {"dims": list(self.dims), "names": list(self.names), "coords": {k: list(v) for k, v in self.coords.items()}, "attrs": dict(self.attrs), "schema": self.frame.schema.simpleString().removeprefix("struct<").removesuffix(">"), "rows": [list(r) for r in self.frame.orderBy(*self.dims).collect()]}

    def to_pandas(self, pivot: str | None = None):
        """A pandas frame; with ``pivot``, that dimension's labels become columns."""
        if pivot:
            rest = [d for d in self.dims if d != pivot]
            return self.frame.groupBy(*rest).pivot(pivot).agg(F.first(self.names[0])).toPandas().set_index(rest)
        return self.frame.toPandas()

    def to_series(self, name: str | None = None):
        return self.frame.toPandas().set_index(list(self.dims))[name or self.names[0]]

    def to_arrow(self):
        return self.densify().frame.toArrow()

    def to_numpy(self, name: str | None = None):
        """A dense array in dimension order, on the driver."""
        import numpy as np

        name = name or self.names[0]
        table = self.densify().frame.orderBy(*self.dims).select(name).toPandas()[name]
        return np.asarray(table, dtype=float).reshape([self.sizes[d] for d in self.dims])

    def to_masked_array(self, name: str | None = None):
        import numpy as np

        return np.ma.masked_invalid(self.to_numpy(name))

    # -- metadata ----------------------------------------------------------
    @property
    def sizes(self) -> dict[str, int]:
        """Labels of each dimension; runs a count for each."""
        return {d: self.index(d).count() for d in self.dims}

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(self.sizes.values())

    @property
    def ndim(self) -> int:
        return len(self.dims)

    @property
    def dtypes(self) -> dict[str, str]:
        return {n: t for n, t in self.frame.dtypes if n in self.names}

    def with_frame(self, frame: DataFrame, dims: Sequence[str] | None = None, names: Sequence[str] | None = None, **more: Any) -> Cube:
        dims = self.dims if dims is None else tuple(dims)
        names = self.names if names is None else tuple(names)
        coords = {c: ds for c, ds in self.coords.items() if c in frame.columns and set(ds) <= set(dims)}
        keep = lambda m: {d: v for d, v in m.items() if d in dims}
        base = {"coords": coords, "orders": keep(self.orders), "spines": keep(self.spines)} | more
        return replace(self, frame=frame.select(*dims, *names, *[c for c in base["coords"] if c not in names and c not in dims]), dims=dims, names=names, **base)

    def rest(self, *dims: str) -> list[str]:
        """The dimensions but these; raises on unknown ones."""
        for d in dims:
            if d not in self.dims:
                raise KeyError(f"no dimension {d}")
        return [d for d in self.dims if d not in dims]

    # -- indexes -----------------------------------------------------------
    def labels(self, dim: str) -> DataFrame:
        """The distinct labels of a dimension, and those of its spine if it has one."""
        own = self.frame.select(dim).distinct()
        return self.spines[dim].select(dim) if dim in self.spines else own

    def index(self, dim: str) -> DataFrame:
        """(label, pos): the order of a dimension.  Runs a job if labels are many (:func:`cubeweave.ranges.number`)."""
        if dim in self.orders:
            return self.orders[dim]
        if dim not in self._made:
            self._made[dim] = number(self.labels(dim), [F.col(dim)], "pos").select(dim, "pos")
        return self._made[dim]

    def with_pos(self, dim: str, name: str = "__pos") -> DataFrame:
        """The frame with each row's place along a dimension."""
        return self.frame.join(self.index(dim).withColumnRenamed("pos", name), dim)

    def densify(self) -> Cube:
        """A row for every combination of labels; absent cells become NULL."""
        if len(self.dims) < 2:
            grid = self.labels(self.dims[0]) if self.dims else None
        else:
            grid = self.labels(self.dims[0])
            for d in self.dims[1:]:
                # A grid is what is asked for; its sides are indexes, not facts.
                grid = grid.crossJoin(self.labels(d))
        return self if grid is None else self.with_frame(grid.join(self.frame, list(self.dims), "left"))

    # -- projection --------------------------------------------------------
    def __getitem__(self, key: str | Sequence[str]) -> Cube:
        names = [key] if isinstance(key, str) else list(key)
        for n in names:
            if n not in self.names and n not in self.coords:
                raise KeyError(n)
        return self.with_frame(self.frame, names=names)

    def assign(self, **new: Column | Callable[[Cube], Column]) -> Cube:
        cols = {k: v(self) if callable(v) and not isinstance(v, Column) else v for k, v in new.items()}
        cols = {k: v if isinstance(v, Column) else F.lit(v) for k, v in cols.items()}
        return self.with_frame(self.frame.withColumns(cols), names=[*self.names, *[k for k in cols if k not in self.names]])

    def assign_coords(self, _dims: Mapping[str, Sequence[str]] | None = None, **new: Column) -> Cube:
        coords = dict(self.coords) | {k: tuple((_dims or {}).get(k, self.dims)) for k in new if k not in self.dims}
        return self.with_frame(self.frame.withColumns(new), coords=coords)

    def assign_attrs(self, **attrs: Any) -> Cube:
        return replace(self, attrs={**self.attrs, **attrs})

    def copy(self, data: Mapping[str, Column] | None = None) -> Cube:
        """Another cube with the same cells, or other ``data`` in them; attributes are its own."""
        frame = self.frame.withColumns(dict(data)) if data else self.frame
        return replace(self.with_frame(frame), attrs=dict(self.attrs), var_attrs={k: dict(v) for k, v in self.var_attrs.items()})

    def drop_encoding(self) -> Cube:
        """Without the attributes that only tell how values were stored."""
        stored = ("_FillValue", "missing_value", "scale_factor", "add_offset", "dtype", "units_stored", "chunks")
        return replace(self, var_attrs={n: {k: v for k, v in a.items() if k not in stored} for n, a in self.var_attrs.items()})

    def drop_attrs(self) -> Cube:
        return replace(self, attrs={}, var_attrs={})

    def filter_by_attrs(self, **wanted: Any) -> Cube:
        def fits(n: str) -> bool:
            own = self.var_attrs.get(n, {})
            return all(v(own.get(k)) if callable(v) else own.get(k) == v for k, v in wanted.items())

        return self[[n for n in self.names if fits(n)]]

    def drop_vars(self, names: str | Iterable[str], errors: str = "raise") -> Cube:
        names = [names] if isinstance(names, str) else list(names)
        lost = [n for n in names if n not in self.names and n not in self.coords]
        if lost and errors == "raise":
            raise ValueError(f"no variables {lost}")
        kept = {c: d for c, d in self.coords.items() if c not in names}
        return self.with_frame(self.frame.drop(*[n for n in names if n not in self.dims]), names=[n for n in self.names if n not in names], coords=kept)

    def rename(self, **names: str) -> Cube:
        """Rename dimensions, variables and coords."""
        to = lambda n: names.get(n, n)
        return replace(
            self, frame=self.frame.withColumnsRenamed(names), dims=tuple(map(to, self.dims)), names=tuple(map(to, self.names)),
            coords={to(c): tuple(map(to, d)) for c, d in self.coords.items()},
            orders={to(d): f.withColumnsRenamed(names) for d, f in self.orders.items()}, spines={to(d): f.withColumnsRenamed(names) for d, f in self.spines.items()},
        )

    rename_dims = rename_vars = rename

    def set_coords(self, *names: str) -> Cube:
        return replace(self, names=tuple(n for n in self.names if n not in names), coords={**self.coords, **{n: self.dims for n in names}})

    def reset_coords(self, *names: str, drop: bool = False) -> Cube:
        names = names or tuple(self.coords)
        kept = {c: d for c, d in self.coords.items() if c not in names}
        return self.with_frame(self.frame, names=self.names if drop else [*self.names, *names], coords=kept)

    def swap_dims(self, old: str, new: str) -> Cube:
        """Make a coord along ``old`` the key instead; the old labels become a coord."""
        if new not in self.coords:
            raise KeyError(new)
        dims = [new if d == old else d for d in self.dims]
        coords = {c: d for c, d in self.coords.items() if c != new} | {old: (new,)}
        return replace(self, dims=tuple(dims), coords=coords, orders={d: f for d, f in self.orders.items() if d != old}, spines={d: f for d, f in self.spines.items() if d != old})

    set_index = swap_dims

    def reset_index(self, dim: str, name: str = "pos") -> Cube:
        """Positions become the key; the labels become a coord."""
        frame = self.frame.join(self.index(dim).withColumnRenamed("pos", name), dim)
        dims = [name if d == dim else d for d in self.dims]
        return replace(self, frame=frame, dims=tuple(dims), coords={**self.coords, dim: (name,)}, orders={}, spines={})

    def astype(self, kind: str, *names: str) -> Cube:
        names = names or self.names
        return self.with_frame(self.frame.withColumns({n: F.col(n).try_cast(kind) for n in names}))

    def map(self, func: Callable[[Column], Column], *names: str) -> Cube:
        """Apply a column function to each variable."""
        return self.with_frame(self.frame.withColumns({n: func(F.col(n)) for n in names or self.names}))

    def pipe(self, func: Callable[..., Any], *args: Any, **kwargs: Any) -> Any:
        return func(self, *args, **kwargs)

    def full_like(self, value: Any) -> Cube:
        return self.map(lambda c: F.lit(value))

    def zeros_like(self) -> Cube:
        return self.full_like(0)

    def ones_like(self) -> Cube:
        return self.full_like(1)

    def squeeze(self, *dims: str) -> Cube:
        """Drop dimensions of one label (a count for each); they stay as coords."""
        sizes = self.sizes
        gone = [d for d in dims or self.dims if sizes[d] == 1]
        if dims and set(gone) != set(dims):
            raise ValueError("a dimension has more than one label")
        kept = [d for d in self.dims if d not in gone]
        return self.with_frame(self.frame, dims=kept, coords={**self.coords, **{d: () for d in gone}})

    def expand_dims(self, dim: str, labels: Sequence[Any] = (0,)) -> Cube:
        """A new dimension over which all variables repeat."""
        new = F.explode(F.array(*[F.lit(x) for x in labels]))
        return self.with_frame(self.frame.withColumn(dim, new), dims=[dim, *self.dims])

    def transpose(self, *dims: str) -> Cube:
        """The order of dimensions is only that of key columns."""
        dims = dims or self.dims[::-1]
        if set(dims) != set(self.dims):
            raise ValueError("all dimensions are needed")
        return self.with_frame(self.frame, dims=dims)

    def to_dataarray(self, dim: str = "variable", name: str = "value") -> Cube:
        """Stack the variables along a new dimension of their names."""
        long = self.frame.select(*self.dims, *[F.col(n).cast("double").alias(n) for n in self.names]).unpivot(list(self.dims), list(self.names), dim, name)
        return Cube(long, (dim, *self.dims), (name,), {}, self.attrs)

    def to_dataset(self, dim: str, labels: Sequence[Any], name: str | None = None) -> Cube:
        """Split along a dimension: a variable for each label."""
        name = name or self.names[0]
        rest = self.rest(dim)
        wide = self.frame.groupBy(*rest).pivot(dim, list(labels)).agg(F.first(name))
        return Cube(wide, tuple(rest), tuple(map(str, labels)), {}, self.attrs)

    def eval(self, statement: str) -> Cube:
        """``"c = a + b * 2"``: a new variable from an expression over variables."""
        from cubeweave.functions.expressions import translate

        assigned = re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=(?!=)(.*)", statement, re.S)
        target, text = assigned.groups() if assigned else ("result", statement)
        return self.assign(**{target: translate(text, {*self.names, *self.dims, *self.coords})})

    def fillna(self, value: Any) -> Cube:
        values = value if isinstance(value, Mapping) else dict.fromkeys(self.names, value)
        return self.with_frame(self.frame.withColumns({n: F.coalesce(F.col(n), v if isinstance(v, Column) else F.lit(v)) for n, v in values.items()}))

    def isnull(self) -> Cube:
        return self.map(lambda c: c.isNull())

    def notnull(self) -> Cube:
        return self.map(lambda c: c.isNotNull())

    def isin(self, values: Sequence[Any]) -> Cube:
        return self.map(lambda c: F.coalesce(c.isin(list(values)), F.lit(False)))

    def clip(self, low: Any = None, high: Any = None) -> Cube:
        def bound(c: Column) -> Column:
            out = c
            if high is not None:
                out = F.least(out, F.lit(high))
            if low is not None:
                out = F.greatest(out, F.lit(low))
            return F.when(c.isNotNull(), out)

        return self.map(bound)

    def equals(self, other: Cube) -> bool:
        """Same dimensions, labels and values; missing equals missing.  Runs a job."""
        if set(self.dims) != set(other.dims) or set(self.names) != set(other.names):
            return False
        cols = [*self.dims, *self.names]
        a, b = self.frame.select(*cols), other.frame.select(*cols)
        return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()

    def identical(self, other: Cube) -> bool:
        return self.attrs == other.attrs and self.equals(other)

    def persist(self) -> Cube:
        return replace(self, frame=self.frame.persist())

    def chunk(self, *dims: str, parts: int | None = None) -> Cube:
        """Deal cells out by dimensions, so each label's cells lie together."""
        cols = [F.col(d) for d in dims or self.dims]
        return replace(self, frame=self.frame.repartition(parts, *cols) if parts else self.frame.repartition(*cols))

    def __repr__(self) -> str:
        return f"<Cube dims={self.dims} variables={self.names} coords={list(self.coords)}>"
