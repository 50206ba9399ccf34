"""Reshaping: sorting, stacking, padding and moving between variables and dimensions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubeweave.cube import Cube, number


def sortby(cube: Cube, dim: str, *keys: str, ascending: bool = True) -> Cube:
    """A new order of a dimension by columns that follow from its label; missing last, ties by label."""
    held = cube.frame.select(dim, *keys).distinct()
    order = [F.col(k).asc_nulls_last() if ascending else F.col(k).desc_nulls_last() for k in keys]
    return replace(cube, orders={**cube.orders, dim: number(held, [*order, F.col(dim)], "pos").select(dim, "pos")})


def argsort(frame: DataFrame, column: str, order: str, by: Sequence[str] = ()) -> DataFrame:
    """Each row's place in the order of a column."""
    if not by:
        return number(frame, [F.col(column), F.col(order)], "place")
    return frame.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(column, order)) - 1)


def topk(frame: DataFrame, k: int, value: str, tie: str, by: Sequence[str] = ()) -> DataFrame:
    """The k greatest of each group, or of all."""
    if not by:
        return frame.orderBy(F.col(value).desc(), tie).limit(k)
    w = Window.partitionBy(*by).orderBy(F.col(value).desc(), tie)
    return frame.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def stack(cube: Cube, new: str, *dims: str) -> Cube:
    """Several dimensions as one whose labels are structs of theirs."""
    rest = cube.rest(*dims)
    frame = cube.frame.withColumn(new, F.struct(*dims))
    return cube.with_frame(frame, dims=[new, *rest], coords={**cube.coords, **{d: (new,) for d in dims}}, orders={}, spines={})


def unstack(cube: Cube, dim: str, fill_value: Any = None) -> Cube:
    """A dimension of structs as one for each field; absent combinations are missing, or ``fill_value``."""
    parts = cube.frame.schema[dim].dataType.names
    rest = cube.rest(dim)
    frame = cube.frame.select(*[F.col(f"{dim}.{p}").alias(p) for p in parts], *rest, *cube.names)
    out = Cube(frame, (*parts, *rest), cube.names, {}, cube.attrs)
    return out if fill_value is None else out.densify().fillna(fill_value)


def reorder_levels(cube: Cube, dim: str, *levels: str) -> Cube:
    frame = cube.frame.withColumn(dim, F.struct(*[F.col(f"{dim}.{p}").alias(p) for p in levels]))
    return cube.with_frame(frame, orders={}, spines={})


def to_stacked_array(cube: Cube, new: str, sample_dims: Sequence[str], name: str = "value") -> Cube:
    """Variables and the other dimensions as one feature dimension: structs of variable and labels."""
    others = [d for d in cube.dims if d not in sample_dims]
    long = cube.to_dataarray("variable", name).frame
    frame = long.withColumn(new, F.struct("variable", *others)).select(*sample_dims, new, name)
    return Cube(frame, (*sample_dims, new), (name,), {}, cube.attrs)


def to_unstacked_dataset(cube: Cube, dim: str, names: Sequence[str]) -> Cube:
    """Inverse: a variable for each name."""
    (value,) = cube.names
    kind = cube.frame.schema[dim].dataType
    others = [p for p in kind.names if p != "variable"]
    flat = cube.frame.select(*cube.rest(dim), *[F.col(f"{dim}.{p}").alias(p) for p in kind.names], value)
    dims = [*cube.rest(dim), *others]
    return Cube(flat.groupBy(*dims).pivot("variable", list(names)).agg(F.first(value)), tuple(dims), tuple(names), {}, cube.attrs)


def pad(cube: Cube, dim: str, before: int, after: int, mode: str = "constant", value: Any = None, stat_length: int | None = None, end_values: tuple[float, float] = (0.0, 0.0), reflect_type: str = "even") -> Cube:
    """Positions added before and after a dimension, keyed by position from -before on.

    constant (missing unless given), edge, linear_ramp, maximum, mean, median,
    minimum, reflect, symmetric or wrap.  New positions look up the position that
    they repeat; statistics come from one aggregation.
    """
    rest = cube.rest(dim)
    index = cube.index(dim)
    n = index.count()
    pos_frame = cube.frame.join(index, dim).select("pos", *rest, *cube.names)
    spark = cube.frame.sparkSession
    new = spark.range(-before, n + after).select(F.col("id").alias("new"))
    p = F.col("new")
    inside = (p >= 0) & (p < n)
    if mode == "edge":
        source: Column = F.least(F.greatest(p, F.lit(0)), F.lit(n - 1))
    elif mode == "wrap":
        source = F.pmod(p, F.lit(n))
    elif mode == "symmetric":
        r = F.pmod(p, F.lit(2 * n))
        source = F.when(r < n, r).otherwise(2 * n - 1 - r)
    elif mode == "reflect" and n > 1:
        r = F.pmod(p, F.lit(2 * n - 2))
        source = F.when(r < n, r).otherwise(2 * n - 2 - r)
    else:
        source = F.when(inside, p)
    grid = new.withColumn("pos", source.cast("bigint"))
    if rest:
        grid = grid.crossJoin(cube.frame.select(*rest).distinct())
    out = grid.join(pos_frame, ["pos", *rest], "left")
    names = cube.names
    if mode == "reflect" and reflect_type == "odd":
        ends = pos_frame.groupBy(*rest).agg(*[F.min_by(c, "pos").alias(f"__a_{c}") for c in names], *[F.max_by(c, "pos").alias(f"__b_{c}") for c in names])
        out = out.join(ends, rest) if rest else out.crossJoin(ends)
        out = out.withColumns({c: F.when(p < 0, 2 * F.col(f"__a_{c}") - F.col(c)).when(p >= n, 2 * F.col(f"__b_{c}") - F.col(c)).otherwise(F.col(c)) for c in names})
    elif mode in ("maximum", "minimum", "mean", "median", "linear_ramp"):
        kind = {"maximum": F.max, "minimum": F.min, "mean": F.avg, "median": lambda c: F.percentile(c, F.lit(0.5))}.get(mode, F.max)
        k = stat_length or n
        stats = pos_frame.groupBy(*rest).agg(*[kind(F.when(F.col("pos") < k, F.col(c))).alias(f"__l_{c}") for c in names], *[kind(F.when(F.col("pos") >= n - k, F.col(c))).alias(f"__r_{c}") for c in names], *[F.min_by(c, "pos").alias(f"__a_{c}") for c in names], *[F.max_by(c, "pos").alias(f"__b_{c}") for c in names])
        out = out.join(stats, rest) if rest else out.crossJoin(stats)
        if mode == "linear_ramp":
            low, high = end_values
            out = out.withColumns({c: F.when(p < 0, low + (F.col(f"__a_{c}") - low) * (p + before) / max(before, 1)).when(p >= n, high + (F.col(f"__b_{c}") - high) * (n - 1 + after - p) / max(after, 1)).otherwise(F.col(c)) for c in names})
        else:
            out = out.withColumns({c: F.when(p < 0, F.col(f"__l_{c}")).when(p >= n, F.col(f"__r_{c}")).otherwise(F.col(c)) for c in names})
    elif mode == "constant" and value is not None:
        out = out.withColumns({c: F.when(inside, F.col(c)).otherwise(F.lit(value)) for c in names})
    return Cube(out.select(F.col("new").alias(dim), *rest, *names), (dim, *rest), names, {}, cube.attrs)
