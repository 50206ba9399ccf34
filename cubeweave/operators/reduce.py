"""Reductions over dimensions, weighted ones, moments of pairs, quantiles and extremes."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce as fold
from typing import Any

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from cubeweave.cube import Cube
from cubeweave.functions.math import ratio


def _scaled(c: Column, how: Callable[[Column], Column], population: Callable[[Column], Column], ddof: int) -> Column:
    if ddof == 0:
        return population(c)
    n = F.count(c)
    scale = F.try_divide(n.cast("double"), (n - ddof).cast("double"))
    return how(population(c), scale)


REDUCERS: dict[str, Callable[[Column], Column]] = {
    "count": F.count,
    "all": lambda c: F.coalesce(F.every(c.cast("boolean")), F.lit(True)),
    "any": lambda c: F.coalesce(F.some(c.cast("boolean")), F.lit(False)),
    "max": F.max,
    "min": F.min,
    "mean": F.avg,
    # A sum of nothing is 0, a product of nothing 1.
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "prod": lambda c: F.coalesce(F.product(c), F.lit(1.0)),
    "median": lambda c: F.percentile(c, F.lit(0.5)),
}


def aggregate(name: str, c: Column, ddof: int = 0, min_count: int | None = None) -> Column:
    """The aggregate of a reducer; with ``min_count``, missing below so many values."""
    if name == "std":
        out = _scaled(c, lambda v, s: v * F.sqrt(F.when(s > 0, s)), F.stddev_pop, ddof)
    elif name == "var":
        out = _scaled(c, lambda v, s: v * F.when(s > 0, s), F.var_pop, ddof)
    else:
        out = REDUCERS[name](c)
    return out if min_count is None else F.when(F.count(c) >= min_count, out)


def reduce(cube: Cube, name: str, dims: str | Sequence[str] | None = None, skipna: bool = True, ddof: int = 0, min_count: int | None = None) -> Cube:
    """Reduce over ``dims`` (all by default): one partial and one final aggregation.

    With ``skipna=False`` a missing cell, or an absent one, makes the result missing.
    """
    dims = cube.dims if dims is None else [dims] if isinstance(dims, str) else list(dims)
    keep = cube.rest(*dims)
    cells = 1
    if not skipna:
        for d in dims:
            cells *= cube.labels(d).count()

    def one(n: str) -> Column:
        out = aggregate(name, F.col(n), ddof, min_count)
        return out if skipna else F.when(F.count(n) == cells, out)

    return cube.with_frame(cube.frame.groupBy(*keep).agg(*[one(n).alias(n) for n in cube.names]), dims=keep)


def cumulate(cube: Cube, name: str, dim: str) -> Cube:
    """cumsum or cumprod along a dimension; missing counts as 0 or 1."""
    from cubeweave.operators.window import running

    none = F.lit(0 if name == "cumsum" else 1)
    frame, values, _ = running(cube, dim, "sum" if name == "cumsum" else "prod", {n: F.coalesce(F.col(n), none) for n in cube.names})
    return cube.with_frame(frame.withColumns(values))


def quantile(cube: Cube, q: float | Sequence[float], dims: str | Sequence[str] | None = None, method: str = "linear") -> Cube:
    """Quantiles; several give a ``quantile`` dimension.

    linear interpolates between neighbours.  lower, higher, nearest and midpoint
    pick among the two neighbours; the other methods place q by their own rule.
    """
    dims = cube.dims if dims is None else [dims] if isinstance(dims, str) else list(dims)
    keep = cube.rest(*dims)
    qs = [q] if isinstance(q, (int, float)) else list(q)
    if method == "linear":
        cols = [F.percentile(n, F.array(*[F.lit(float(x)) for x in qs])).alias(n) for n in cube.names]
    else:
        cols = [F.array(*[_placed(F.array_sort(F.collect_list(n)), F.lit(float(x)), method) for x in qs]).alias(n) for n in cube.names]
    frame = cube.frame.groupBy(*keep).agg(*cols)
    if isinstance(q, (int, float)):
        return cube.with_frame(frame.withColumns({n: F.get(n, F.lit(0)) for n in cube.names}), dims=keep)
    zipped = F.posexplode(F.arrays_zip(*cube.names))
    long = frame.select(*keep, zipped.alias("__k", "__v")).select(F.get(F.array(*[F.lit(float(x)) for x in qs]), "__k").alias("quantile"), *keep, *[F.col(f"__v.{n}").alias(n) for n in cube.names])
    return cube.with_frame(long, dims=["quantile", *keep])


#: Alpha and beta of the continuous quantile definitions.
CONTINUOUS = {"linear": (1, 1), "weibull": (0, 0), "hazen": (0.5, 0.5), "median_unbiased": (1 / 3, 1 / 3), "normal_unbiased": (3 / 8, 3 / 8), "interpolated_inverted_cdf": (0, 1)}


def _placed(sorted_: Column, q: Column, method: str) -> Column:
    n = F.size(sorted_)
    at = lambda k: F.get(sorted_, F.greatest(F.lit(0), F.least(n - 1, k)).cast("int"))
    if method in CONTINUOUS:
        a, b = CONTINUOUS[method]
        place = n * q + (a + q * (1 - a - b)) - 1
        low = F.floor(place)
        share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), place - low))
        return at(low) + (at(low + 1) - at(low)) * share
    place = q * (n - 1)
    if method == "lower":
        return at(F.floor(place))
    if method == "higher":
        return at(F.ceil(place))
    if method == "midpoint":
        return (at(F.floor(place)) + at(F.ceil(place))) / 2
    if method == "nearest":
        return at(F.rint(place))
    if method == "inverted_cdf":
        return at(F.ceil(n * q) - 1)
    if method == "averaged_inverted_cdf":
        return F.when(n * q == F.floor(n * q), (at(n * q - 1) + at(n * q)) / 2).otherwise(at(F.ceil(n * q) - 1))
    if method == "closest_observation":
        return at(F.rint(n * q) - 1)
    raise ValueError(f"no quantile method {method}")


def extreme(cube: Cube, dim: str, which: str = "max", label: bool = True, fill_value: Any = None) -> Cube:
    """idxmax, idxmin (labels) or argmax, argmin (positions, ``label=False``): of the first extreme along a dimension."""
    keep = cube.rest(dim)
    frame = cube.with_pos(dim)
    cols = []
    for n in cube.names:
        key = F.struct(F.col(n), -F.col("__pos")) if which == "max" else F.struct(F.col(n), F.col("__pos"))
        pick = F.max_by if which == "max" else F.min_by
        value = F.col(dim) if label else F.col("__pos")
        out = pick(F.when(F.col(n).isNotNull(), value), F.when(F.col(n).isNotNull(), key))
        cols.append((out if fill_value is None else F.coalesce(out, F.lit(fill_value))).alias(n))
    return cube.with_frame(frame.groupBy(*keep).agg(*cols), dims=keep)


# -- weights ---------------------------------------------------------------
def weighted(cube: Cube, weights: Cube, name: str, dims: Sequence[str] | str, q: float | None = None) -> Cube:
    """sum_of_weights, sum, mean, sum_of_squares, var, std or quantile under weights, joined on shared dimensions."""
    dims = [dims] if isinstance(dims, str) else list(dims)
    keep = cube.rest(*dims)
    w = weights.frame.select(*weights.dims, F.col(weights.names[0]).cast("double").alias("__w"))
    joined = cube.frame.join(w, list(weights.dims))
    if name == "quantile":
        return _weighted_quantile(cube, joined, keep, float(q))
    cols = []
    for n in cube.names:
        x, held = F.col(n), F.when(F.col(n).isNotNull(), F.col("__w"))
        total = F.nullif(F.sum(held), F.lit(0.0))
        sum_x, sum_xx = F.sum(F.col("__w") * x), F.sum(F.col("__w") * x * x)
        squares = sum_xx - ratio(sum_x * sum_x, F.sum(held))
        out = {"sum_of_weights": total, "sum": F.coalesce(sum_x, F.lit(0.0)), "mean": ratio(sum_x, F.sum(held)), "sum_of_squares": squares, "var": ratio(squares, F.sum(held)), "std": F.sqrt(F.greatest(F.lit(0.0), ratio(squares, F.sum(held))))}[name]
        cols.append(out.alias(n))
    return cube.with_frame(joined.groupBy(*keep).agg(*cols), dims=keep)


def _weighted_quantile(cube: Cube, joined, keep: list[str], q: float) -> Cube:
    """Type 7 by the effective sample size: each value spans a part of the cumulated weights, and overlaps with the place of q give its share."""
    (n,) = cube.names
    held = joined.where(F.col(n).isNotNull() & (F.col("__w") > 0))
    part = Window.partitionBy(*keep)
    order = part.orderBy(n).rowsBetween(Window.unboundedPreceding, 0)
    w = F.col("__w")
    total, squares = F.sum(w).over(part), F.sum(w * w).over(part)
    placed = held.withColumn("__size", total * total / squares).withColumn("__to", F.sum(w).over(order) / total)
    placed = placed.withColumn("__from", F.col("__to") - w / total)
    h = F.col("__size") * q - q + 1
    clip = lambda c: F.greatest((h - 1) / F.col("__size"), F.least(h / F.col("__size"), c))
    share = F.col("__size") * (clip(F.col("__to")) - clip(F.col("__from")))
    return cube.with_frame(placed.withColumn("__share", share).groupBy(*keep).agg(F.sum(F.col("__share") * F.col(n)).alias(n)), dims=keep)


# -- pairs -----------------------------------------------------------------
def pair(a: Cube, b: Cube, name: str, dims: Sequence[str] | str, ddof: int = 1) -> Cube:
    """cov or corr of two one-variable cubes over ``dims``, on cells that both have."""
    dims = [dims] if isinstance(dims, str) else list(dims)
    keep = a.rest(*dims)
    x = a.frame.select(*a.dims, F.col(a.names[0]).cast("double").alias("__x"))
    y = b.frame.select(*b.dims, F.col(b.names[0]).cast("double").alias("__y"))
    both = x.join(y, [d for d in a.dims if d in b.dims]).where("__x IS NOT NULL AND __y IS NOT NULL")
    if name == "corr":
        out = F.corr("__x", "__y")
    else:
        n = F.count(F.lit(1))
        out = F.covar_pop("__x", "__y") * F.try_divide(n.cast("double"), (n - ddof).cast("double"))
    return Cube(both.groupBy(*keep).agg(out.alias(name)), tuple(keep), (name,), {}, a.attrs)


def dot(a: Cube, b: Cube, dims: Sequence[str] | None = None) -> Cube:
    """Sum of products over ``dims``, by default all that both have."""
    shared = [d for d in a.dims if d in b.dims]
    dims = shared if dims is None else list(dims)
    out = [d for d in dict.fromkeys([*a.dims, *b.dims]) if d not in dims]
    x = a.frame.select(*a.dims, F.col(a.names[0]).alias("__x"))
    y = b.frame.select(*b.dims, F.col(b.names[0]).alias("__y"))
    both = x.join(y, shared) if shared else x.crossJoin(y)
    return Cube(both.groupBy(*out).agg(F.sum(F.col("__x") * F.col("__y")).alias("dot")), tuple(out), ("dot",), {}, a.attrs)


def cross(a: Cube, b: Cube, dim: str, axes: Sequence[Any]) -> Cube:
    """Vector product along a dimension of three labels."""
    keep = a.rest(dim)
    wide = lambda c, s: c.frame.groupBy(*keep).agg(*[F.coalesce(F.max(F.when(F.col(dim) == F.lit(x), F.col(c.names[0]))), F.lit(0.0)).alias(f"{s}{k}") for k, x in enumerate(axes)])
    both = wide(a, "a").join(wide(b, "b"), keep)
    col = lambda i, j: F.col(f"a{i}") * F.col(f"b{j}") - F.col(f"a{j}") * F.col(f"b{i}")
    parts = F.array(*[F.struct(F.lit(x).alias(dim), v.alias("cross")) for x, v in zip(axes, (col(1, 2), col(2, 0), col(0, 1)))])
    return Cube(both.select(*keep, F.inline(parts)), (*keep, dim), ("cross",), {}, a.attrs)


def norm(a: Cube, dims: Sequence[str]) -> Cube:
    keep = a.rest(*dims)
    return Cube(a.frame.groupBy(*keep).agg(F.sqrt(F.sum(F.col(a.names[0]) ** 2)).alias("norm")), tuple(keep), ("norm",))


def any_of(conditions: Sequence[Column]) -> Column:
    return fold(lambda x, y: x | y, conditions)
