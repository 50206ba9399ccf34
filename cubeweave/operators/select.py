"""Selection by label, position, condition and membership."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubeweave.cube import Cube, number
from cubeweave.functions.expressions import translate
from cubeweave.operators.align import asof

#: Lists of labels or positions up to this length become a filter that reaches the scan; longer ones a join.
INLINE = 1000


def _index_after(cube: Cube, dim: str, kept: DataFrame, key: Column) -> Cube:
    """Facts at the kept (label, pos), with a new order by ``key``."""
    renumbered = number(kept.withColumn("__key", key).drop("pos"), [F.col("__key")], "pos").select(dim, "pos")
    frame = cube.frame.join(kept.select(dim).distinct(), dim, "left_semi")
    return replace(cube.with_frame(frame), orders={**cube.orders, dim: renumbered}, spines={d: s for d, s in cube.spines.items() if d != dim})


def isel(cube: Cube, missing_dims: str = "raise", drop: bool = False, **indexers: int | slice | Sequence[int] | Sequence[bool]) -> Cube:
    """Select by position: an integer drops the dimension, a slice or a list keeps it.

    Slices with negative bounds or steps and integers below zero count from the
    end (one count).  A list keeps its own order.
    """
    for dim, at in indexers.items():
        if dim not in cube.dims:
            if missing_dims == "raise":
                raise ValueError(f"no dimension {dim}")
            continue
        index = cube.index(dim)
        if isinstance(at, int):
            at = at + index.count() if at < 0 else at
            frame = cube.frame.join(index.where(F.col("pos") == at).select(dim), dim, "left_semi")
            dims = cube.rest(dim)
            coords = cube.coords if drop else {**cube.coords, dim: ()}
            cube = cube.with_frame(frame, dims=dims, coords=coords)
        elif isinstance(at, slice):
            negative = (at.start or 0) < 0 or (at.stop or 0) < 0 or (at.step or 1) < 0
            start, stop, step = at.indices(index.count()) if negative else (at.start or 0, at.stop, at.step or 1)
            pos = F.col("pos")
            if step > 0:
                hit = (pos >= start) & ((pos - start) % step == 0) & (F.lit(True) if stop is None else pos < stop)
            else:
                hit = (pos <= start) & (pos > stop) & ((start - pos) % -step == 0)
            cube = _index_after(cube, dim, index.where(hit), F.col("pos") * (1 if step > 0 else -1))
        else:
            places = [k for k, b in enumerate(at) if b] if len(at) and all(isinstance(b, bool) for b in at) else list(at)
            if any(p < 0 for p in places):
                n = index.count()
                places = [p + n if p < 0 else p for p in places]
            wanted = cube.frame.sparkSession.createDataFrame([(p, k) for k, p in enumerate(places)], "pos long, __order long")
            cube = _index_after(cube, dim, index.join(F.broadcast(wanted), "pos"), F.col("__order"))
    return cube


def isel_points(cube: Cube, points: DataFrame, **pos_columns: str) -> Cube:
    """Vectorised (pointwise) selection: ``points`` has a ``point`` column and a position column for each dimension named."""
    frame, wanted = cube.frame, points
    for dim, column in pos_columns.items():
        wanted = wanted.join(cube.index(dim).withColumnRenamed("pos", column), column)
    frame = frame.join(wanted, list(pos_columns))
    return Cube(frame.select("point", *cube.rest(*pos_columns), *pos_columns, *cube.names), ("point", *cube.rest(*pos_columns)), cube.names, {d: ("point",) for d in pos_columns}, cube.attrs)


def sel(cube: Cube, method: str | None = None, tolerance: Any = None, drop: bool = False, **indexers: Any) -> Cube:
    """Select by label: a value drops the dimension, a slice includes both ends, a list keeps its labels.

    With ``method`` (pad, backfill, nearest) a missing label takes its neighbour's
    cells, within ``tolerance``.  Filters are plain comparisons and reach the scan.
    """
    for dim, at in indexers.items():
        cube.rest(dim)
        key = F.col(dim)
        if isinstance(at, slice):
            if method:
                raise NotImplementedError("a slice takes no method")
            hit = F.lit(True)
            if at.start is not None:
                hit = hit & (key >= F.lit(at.start))
            if at.stop is not None:
                hit = hit & (key <= F.lit(at.stop))
            cube = _where_index(cube, dim, hit)
        elif isinstance(at, (list, tuple)):
            if method:
                wanted = cube.frame.sparkSession.createDataFrame([(x,) for x in at], cube.frame.select(dim).schema)
                found = asof(wanted, cube.labels(dim), dim, method, tolerance)
                frame = cube.frame.withColumnRenamed(dim, "__found").join(found, "__found").drop("__found")
                cube = replace(cube.with_frame(frame), orders={}, spines={})
            else:
                cube = _where_index(cube, dim, key.isin(list(at)))
        else:
            if method:
                wanted = cube.frame.sparkSession.createDataFrame([(at,)], cube.frame.select(dim).schema)
                found = asof(wanted, cube.labels(dim), dim, method, tolerance).select(F.col("__found").alias(dim))
                frame = cube.frame.join(F.broadcast(found), dim, "left_semi")
            else:
                frame = cube.frame.where(key == F.lit(at))
            coords = cube.coords if drop else {**cube.coords, dim: ()}
            cube = cube.with_frame(frame, dims=cube.rest(dim), coords=coords)
    return cube


loc = sel


def _where_index(cube: Cube, dim: str, hit: Column) -> Cube:
    out = cube.with_frame(cube.frame.where(hit))
    orders = {d: f for d, f in cube.orders.items() if d != dim}
    if dim in cube.orders:
        orders[dim] = number(cube.orders[dim].where(hit).withColumnRenamed("pos", "__old"), [F.col("__old")], "pos").select(dim, "pos")
    spines = {d: (s.where(hit) if d == dim else s) for d, s in cube.spines.items()}
    return replace(out, orders=orders, spines=spines)


def partial_date(cube: Cube, dim: str, text: str) -> Cube:
    """``"2024"``, ``"2024-03"`` or ``"2024-03-05"``: all labels in that year, month or day."""
    unit = {0: "YEAR", 1: "MONTH", 2: "DAY"}[text.count("-")]
    start = F.lit(text + "-01" * (2 - text.count("-"))).cast("timestamp_ntz")
    end = start + F.expr(f"INTERVAL 1 {unit}")
    return _where_index(cube, dim, (F.col(dim) >= start) & (F.col(dim) < end))


def head(cube: Cube, n: int = 5, **sizes: int) -> Cube:
    return isel(cube, **{d: slice(0, k) for d, k in (sizes or dict.fromkeys(cube.dims, n)).items()})


def tail(cube: Cube, n: int = 5, **sizes: int) -> Cube:
    return isel(cube, **{d: slice(-k, None) for d, k in (sizes or dict.fromkeys(cube.dims, n)).items()})


def thin(cube: Cube, n: int | None = None, **steps: int) -> Cube:
    return isel(cube, **{d: slice(0, None, k) for d, k in (steps or dict.fromkeys(cube.dims, n)).items()})


def query(cube: Cube, **conditions: str) -> Cube:
    """``dim="x > 3 and label < 5"``: an expression over keys, coords and variables."""
    for text in conditions.values():
        cube = cube.with_frame(cube.frame.where(translate(text, {*cube.dims, *cube.names, *cube.coords})))
    return cube


def where(cube: Cube, cond: Column, other: Any = None, drop: bool = False) -> Cube:
    """Keep values where ``cond`` holds, else ``other`` (missing).  ``drop`` removes labels for which it never holds."""
    kept = cube.map(lambda c: F.when(cond, c).otherwise(F.lit(other) if not isinstance(other, Column) else other))
    if not drop:
        return kept
    frame = kept.frame
    for d in cube.dims:
        hits = cube.frame.where(cond).select(d).distinct()
        frame = frame.join(hits, d, "left_semi")
    return kept.with_frame(frame)


def choose(cond: Column, x: Any, y: Any) -> Column:
    """Ternary selection as a function."""
    return F.when(cond, x).otherwise(y)


def drop_sel(cube: Cube, errors: str = "raise", **labels: Sequence[Any]) -> Cube:
    for dim, gone in labels.items():
        gone = list(gone) if isinstance(gone, (list, tuple)) else [gone]
        if errors == "raise" and cube.labels(dim).where(F.col(dim).isin(gone)).count() < len(set(gone)):
            raise KeyError(f"labels of {dim} are missing")
        cube = _where_index(cube, dim, ~F.col(dim).isin(gone))
    return cube


def drop_isel(cube: Cube, **places: Sequence[int]) -> Cube:
    for dim, gone in places.items():
        index = cube.index(dim)
        cube = _index_after(cube, dim, index.where(~F.col("pos").isin(list(gone))), F.col("pos"))
    return cube


def semi(cube: Cube, keys: DataFrame) -> Cube:
    """Only cells whose key is in ``keys``."""
    return cube.with_frame(cube.frame.join(keys, [d for d in cube.dims if d in keys.columns], "left_semi"))


def anti(cube: Cube, keys: DataFrame) -> Cube:
    """Only cells whose key isn't in ``keys``."""
    return cube.with_frame(cube.frame.join(keys, [d for d in cube.dims if d in keys.columns], "left_anti"))


def dropna(cube: Cube, dim: str, how: str = "any", thresh: int | None = None, subset: Sequence[str] | None = None) -> Cube:
    """Remove labels by how many values they have over the other dimensions; absent cells count as missing."""
    names = list(subset or cube.names)
    counted = cube.frame.groupBy(dim).agg(sum((F.count(n) for n in names[1:]), F.count(names[0])).alias("__n"))
    if thresh is not None:
        need = F.lit(thresh)
    elif how == "all":
        need = F.lit(1)
    else:
        other = 1
        for d in cube.rest(dim):
            other *= cube.labels(d).count()
        need = F.lit(other * len(names))
    return cube.with_frame(cube.frame.join(counted.where(F.col("__n") >= need).select(dim), dim, "left_semi"))


def drop_duplicates(frame: DataFrame, dim: str, order: str, keep: str | bool = "first") -> DataFrame:
    """Of rows with one label, keep the first or last in ``order``, or none of a repeated label (False)."""
    if keep is False:
        w = Window.partitionBy(dim)
        return frame.withColumn("__n", F.count(F.lit(1)).over(w)).where("__n = 1").drop("__n")
    w = Window.partitionBy(dim).orderBy(F.col(order) if keep == "first" else F.col(order).desc())
    return frame.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def set_where(cube: Cube, cond: Column, values: Mapping[str, Any]) -> Cube:
    """Masked assignment."""
    return cube.with_frame(cube.frame.withColumns({n: F.when(cond, F.lit(v)).otherwise(F.col(n)) for n, v in values.items()}))
