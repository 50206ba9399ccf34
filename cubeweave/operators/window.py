"""Operators along an ordered dimension: rolling, expanding and exponential windows, blocks, shifts, ranks and fills."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubeweave.cube import Cube
from cubeweave.functions.dates import us
from cubeweave.operators.reduce import aggregate
from cubeweave import ranges
from cubeweave.ranges import halo, in_blocks, is_small, number, scan  # noqa: F401

#: Rows that an exponential window folds at once.
FOLD_ROWS = 1024


def reaching(cube: Cube, dim: str, back: int, ahead: int, make: Callable[[Any], dict[str, Column]]) -> Cube:
    """Columns over windows that reach at most so many positions back and ahead; ``make`` gets the ordered series.

    Series beyond a small frame are cut into blocks of positions that borrow their
    neighbours' rows, so a long series runs in many tasks.
    """
    frame, rest = cube.with_pos(dim), cube.rest(dim)
    if is_small(cube.frame):
        return cube.with_frame(frame.withColumns(make(Window.partitionBy(*rest).orderBy("__pos"))))
    held = halo(frame, "__pos", max(ranges.BLOCK_ROWS, back, ahead), back, ahead)
    return cube.with_frame(held.withColumns(make(Window.partitionBy(*rest, "block").orderBy("__pos"))).where("own"))


def nearest_values(frame: DataFrame, rest: list[str], held: dict[str, Column], whole: bool, forward: bool = True, backward: bool = True) -> DataFrame:
    """The last present of each of ``held`` up to a row (``__last_n``), and the first from it on (``__next_n``).

    Each of ``held`` is a struct that begins with the position, null where missing.
    Unless the frame is ``whole`` enough for one window, each block of positions takes
    over what the blocks around it hold.
    """
    if not whole:
        frame = in_blocks(frame)
    part = Window.partitionBy(*rest, *([] if whole else ["__block"]))
    # Looking ahead is looking back in reverse order: frames that end unbounded are computed anew for each row.
    w, back = part.orderBy("__pos"), part.orderBy(F.col("__pos").desc())
    out = {f"__h_{n}": c for n, c in held.items()}
    frame = frame.withColumns(out)
    sides = [("last", F.last, w.rowsBetween(Window.unboundedPreceding, 0), F.max, False)] * forward + [("next", F.last, back.rowsBetween(Window.unboundedPreceding, 0), F.min, True)] * backward
    for name, pick, over, best, reverse in sides:
        frame = frame.withColumns({f"__{name}_{n}": pick(f"__h_{n}", ignorenulls=True).over(over) for n in held})
        if not whole:
            frame = scan(frame, rest, {f"__c_{name}_{n}": best(f"__h_{n}") for n in held}, best, reverse=reverse)
            frame = frame.withColumns({f"__{name}_{n}": F.coalesce(f"__{name}_{n}", f"__c_{name}_{n}") for n in held})
    return frame


def running(cube: Cube, dim: str, name: str, values: dict[str, Column]) -> tuple[DataFrame, dict[str, Column], dict[str, Column]]:
    """Each variable's aggregate over all up to a row, and its count of values; blocks of positions add up what stands before them."""
    frame, rest = cube.with_pos(dim), cube.rest(dim)
    plain = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count, "prod": F.product, "std": F.stddev_pop, "var": F.var_pop}
    if is_small(cube.frame):
        w = Window.partitionBy(*rest).orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
        return frame, {n: plain[name](c).over(w) for n, c in values.items()}, {n: F.count(c).over(w) for n, c in values.items()}
    frame = in_blocks(frame)
    w = Window.partitionBy(*rest, "__block").orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    best = {"min": F.min, "max": F.max}.get(name)
    whole, over = {}, {}
    for n, c in values.items():
        whole[f"n_{n}"], over[f"__t_n_{n}"] = F.count(c), F.sum
        if best:
            whole[f"v_{n}"], over[f"__t_v_{n}"] = best(c), best
        elif name == "prod":
            whole[f"v_{n}"], over[f"__t_v_{n}"] = F.product(c), F.product
        else:
            whole[f"v_{n}"], over[f"__t_v_{n}"] = F.sum(c), F.sum
        if name in ("std", "var"):
            # A block's squares about its own mean, and what the means' spread adds.
            whole[f"m_{n}"], over[f"__t_m_{n}"] = F.var_pop(c) * F.count(c), F.sum
            whole[f"q_{n}"], over[f"__t_q_{n}"] = F.try_divide(F.sum(c) * F.sum(c), F.count(c).cast("double")), F.sum
    frame = scan(frame, rest, whole, lambda t: over[t](t))

    def one(n: str, c: Column) -> Column:
        k, v = F.count(c).over(w), F.col(f"v_{n}")
        before = F.coalesce(F.col(f"n_{n}"), F.lit(0))
        if name == "count":
            return before + k
        if best:
            return (F.least if name == "min" else F.greatest)(best(c).over(w), v)
        if name == "prod":
            return F.coalesce(F.product(c).over(w) * F.coalesce(v, F.lit(1.0)), v)
        total = F.coalesce(F.sum(c).over(w) + v, F.sum(c).over(w), v)
        if name == "sum":
            return total
        every = (before + k).cast("double")
        if name == "mean":
            return F.try_divide(total.cast("double"), every)
        inside = F.coalesce(F.var_pop(c).over(w) * k, F.lit(0.0))
        own = F.coalesce(F.try_divide(F.sum(c).over(w) * F.sum(c).over(w), k.cast("double")), F.lit(0.0))
        squares = F.coalesce(F.col(f"m_{n}"), F.lit(0.0)) + inside + F.coalesce(F.col(f"q_{n}"), F.lit(0.0)) + own - F.try_divide(total * total, every)
        var = F.try_divide(F.greatest(squares, F.lit(0.0)), every)
        return F.sqrt(var) if name == "std" else var

    return frame, {n: one(n, c) for n, c in values.items()}, {n: F.coalesce(F.col(f"n_{n}"), F.lit(0)) + F.count(c).over(w) for n, c in values.items()}


def rolling(cube: Cube, dim: str, window: int, name: str, min_periods: int | None = None, center: bool = False, ddof: int = 0) -> Cube:
    """A reducer over each window of ``window`` positions, missing below ``min_periods`` values.

    A window ends at its label, or is centred on it: an even one reaches one
    further back.
    """
    if window < 1 or (min_periods is not None and min_periods < 1):
        raise ValueError("window and min_periods have to be positive")
    need = window if min_periods is None else min_periods
    back, ahead = (window // 2, (window - 1) // 2) if center else (window - 1, 0)

    def one(c: Column, w) -> Column:
        if name in ("argmin", "argmax"):
            key = F.when(c.isNotNull(), F.struct(c.alias("v"), (F.col("__pos") if name == "argmin" else -F.col("__pos")).alias("p")))
            best = (F.min if name == "argmin" else F.max)(key).over(w)
            at = best["p"] if name == "argmin" else -best["p"]
            return at - (F.col("__pos") - back)
        if name in ("std", "var"):
            n = F.count(c).over(w)
            v = F.var_pop(c).over(w) * F.try_divide(n.cast("double"), (n - ddof).cast("double"))
            return F.sqrt(v) if name == "std" else v
        plain = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count, "prod": F.product, "median": lambda x: F.percentile(x, F.lit(0.5))}
        return plain[name](c).over(w)

    def make(order) -> dict[str, Column]:
        w = order.rangeBetween(-back, ahead)
        return {n: F.when(F.count(n).over(w) >= need, one(F.col(n), w)) for n in cube.names}

    return reaching(cube, dim, back, ahead, make)


def rolling_values(cube: Cube, dim: str, back: Any, name: str, ahead: Any = None, min_periods: int = 1) -> Cube:
    """A window over a dimension's values, not its places: cells at most ``back`` before and ``ahead`` after a label.

    Numbers, or timedeltas for times.  Rows are dealt to blocks of values, each with
    its neighbours' ends, so a long or hot series runs in many tasks and a window
    never reaches beyond its block's.
    """
    time = dict(cube.frame.dtypes)[dim].startswith(("timestamp", "date"))
    span = lambda x: 0 if x is None else int(x.total_seconds() * 1e6) if time else x
    back, ahead, rest = span(back), span(ahead), cube.rest(dim)
    if min(back, ahead) < 0:
        raise ValueError("a window can't end before it begins")
    width = max(back + ahead, 1) * 8
    x = us(F.col(dim)) if time else F.col(dim)
    frame = cube.frame.where(F.col(dim).isNotNull()).withColumn("__x", x)
    at = F.floor(F.col("__x") / F.lit(width)).cast("bigint")
    held = frame.withColumn("__own", at).withColumn("__block", F.explode(F.sequence(F.floor((F.col("__x") - F.lit(ahead)) / F.lit(width)).cast("bigint"), F.floor((F.col("__x") + F.lit(back)) / F.lit(width)).cast("bigint"))))
    w = Window.partitionBy(*rest, "__block").orderBy("__x").rangeBetween(-back, ahead)
    plain = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count, "std": F.stddev_pop, "var": F.var_pop}
    out = held.withColumns({n: F.when(F.count(n).over(w) >= min_periods, plain[name](F.col(n)).over(w)) for n in cube.names})
    return cube.with_frame(out.where(F.col("__own") == F.col("__block")))


def rolling_windows(cube: Cube, dim: str, window: int):
    """Iterates over (label, cube of the window that ends there); a filter for each, labels on the driver."""
    labels = [r[0] for r in cube.index(dim).orderBy("pos").select(dim).toLocalIterator()]
    for k, x in enumerate(labels):
        yield x, cube.with_frame(cube.frame.where(F.col(dim).isin(labels[max(0, k - window + 1) : k + 1])))


def rolling_nd(cube: Cube, windows: dict[str, int], name: str, min_periods: int | None = None) -> Cube:
    """A window over several dimensions: each cell goes to all windows that hold it, then one aggregation."""
    need = 1
    frame, sizes = cube.frame, {}
    for d, w in windows.items():
        need *= w
        index = cube.index(d)
        sizes[d] = index.withColumnRenamed(d, f"__to_{d}")
        frame = frame.join(index.withColumnRenamed("pos", f"__pos_{d}"), d).withColumn(f"__at_{d}", F.explode(F.sequence(F.lit(0), F.lit(w - 1)))).withColumn("pos", F.col(f"__pos_{d}") + F.col(f"__at_{d}"))
        frame = frame.join(sizes[d], "pos").drop("pos")
    rest = [d for d in cube.dims if d not in windows]
    out = frame.groupBy(*rest, *[f"__to_{d}" for d in windows]).agg(*[F.when(F.count(n) >= (min_periods or need), aggregate(name, F.col(n))).alias(n) for n in cube.names])
    out = out.select(*[F.col(f"__to_{d}").alias(d) if d in windows else F.col(d) for d in cube.dims], *cube.names)
    grid = cube.densify().frame.select(*cube.dims)
    return cube.with_frame(grid.join(out, list(cube.dims), "left"))


def construct(cube: Cube, dim: str, window: int, window_dim: str, stride: int = 1, fill_value: Any = None) -> Cube:
    """Windows as a new dimension: entry k of a window is the value window-1-k places back."""
    index = cube.index(dim)
    targets = index.where(F.col("pos") % stride == 0).withColumn(window_dim, F.explode(F.sequence(F.lit(0), F.lit(window - 1)))).withColumn("__src", F.col("pos") - (window - 1) + F.col(window_dim))
    facts = cube.frame.join(index.withColumnRenamed("pos", "__src"), dim).drop(dim)
    rest = cube.rest(dim)
    grid = targets.crossJoin(cube.frame.select(*rest).distinct()) if rest else targets
    frame = grid.join(facts, ["__src", *rest], "left").select(dim, *rest, window_dim, *cube.names)
    out = cube.with_frame(frame, dims=[dim, *rest, window_dim])
    return out if fill_value is None else out.fillna(fill_value)


def rolling_reduce(cube: Cube, dim: str, window: int, func: Callable[[Column], Column]) -> Cube:
    """Any column function of the array of a window's values, in order."""

    def make(order) -> dict[str, Column]:
        w = order.rangeBetween(-(window - 1), 0)
        values = lambda n: F.transform(F.array_sort(F.collect_list(F.struct("__pos", n)).over(w)), lambda s: s[n])
        return {n: F.when(F.count(n).over(w) >= window, func(values(n))) for n in cube.names}

    return reaching(cube, dim, window - 1, 0, make)


def expanding(cube: Cube, dim: str, name: str, min_periods: int = 1) -> Cube:
    """A reducer over everything up to each label."""
    frame, values, counts = running(cube, dim, name, {n: F.col(n) for n in cube.names})
    return cube.with_frame(frame.withColumns({n: F.when(counts[n] >= min_periods, values[n]) for n in cube.names}))


def alpha(**window: float) -> float:
    """The weight of exponential windows, from com, span, halflife or alpha."""
    ((kind, v),) = window.items()
    return {"alpha": lambda: v, "com": lambda: 1 / (1 + v), "span": lambda: 2 / (v + 1), "halflife": lambda: 1 - 0.5 ** (1 / v)}[kind]()


def rolling_exp(cube: Cube, dim: str, name: str = "mean", other: str | None = None, **window: float) -> Cube:
    """Exponentially weighted mean, sum, var, std, and cov or corr with another variable.

    A fold over the ordered values of each block of FOLD_ROWS rows of a series keeps
    only the weighted sums, so no power of the weight can overflow.  A second fold,
    over a series' blocks, gives each block what the ones before it hand over.
    """
    keep = 1 - alpha(**window)
    rest = cube.rest(dim)
    sums = ("w", "ww", "x", "y", "xx", "yy", "xy")
    #: The weight that one step leaves, and the square of it for the squared weights.
    decay = {k: keep * keep if k == "ww" else keep for k in sums}
    names = [n for n in cube.names if n != other]
    state = "struct<" + ",".join(f"{k}:double" for k in sums) + ">"
    zero = F.struct(*[F.lit(0.0).alias(k) for k in sums])

    def add(s: Column, v: Column, n: str) -> Column:
        a, b = v[n].cast("double"), v[other or n].cast("double")
        held = a.isNotNull() & b.isNotNull()
        terms = {"w": F.lit(1.0), "ww": F.lit(1.0), "x": a, "y": b, "xx": a * a, "yy": b * b, "xy": a * b}
        return F.struct(*[(s[k] * decay[k] + F.when(held, terms[k]).otherwise(0.0)).alias(k) for k in sums])

    def value(s: Column) -> Column:
        w = s["w"]
        mean = F.try_divide(s["x"], w)
        cov = (F.try_divide(s["xy"], w) - mean * F.try_divide(s["y"], w)) * F.try_divide(w * w, w * w - s["ww"])
        vx, vy = F.try_divide(s["xx"], w) - F.pow(mean, F.lit(2)), F.try_divide(s["yy"], w) - F.pow(F.try_divide(s["y"], w), F.lit(2))
        corr = F.try_divide(F.try_divide(s["xy"], w) - mean * F.try_divide(s["y"], w), F.sqrt(F.greatest(vx * vy, F.lit(0.0))))
        return {"mean": mean, "sum": s["x"], "var": cov, "std": F.sqrt(F.greatest(cov, F.lit(0.0))), "cov": cov, "corr": corr}[name]

    def states(n: str) -> Column:
        """The sums after each row of a block, as if nothing stood before it."""
        none = F.array().cast(f"array<{state}>")
        return F.aggregate("__series", none, lambda done, v: F.concat(done, F.array(add(F.coalesce(F.try_element_at(done, F.lit(-1)), zero), v, n))))

    frame = cube.with_pos(dim).withColumn("__block", F.floor(F.col("__pos") / F.lit(FOLD_ROWS)))
    series = frame.groupBy(*rest, "__block").agg(F.array_sort(F.collect_list(F.struct("__pos", dim, *cube.names))).alias("__series"))
    folded = series.select(*rest, "__block", "__series", F.size("__series").alias("__n"), *[states(n).alias(f"__s_{n}") for n in names])
    # One row for each block of a series: its length and its last sums; a fold over the earlier ones that still weigh.
    reach = 1 if keep <= 0 else min(1 << 30, 1 + math.ceil(math.log(1e-40) / (FOLD_ROWS * math.log(keep)))) if keep < 1 else 1 << 30
    ends = folded.select(*rest, "__block", F.struct("__block", "__n", *[F.element_at(f"__s_{n}", -1).alias(n) for n in names]).alias("__end"))
    earlier = F.array_sort(F.collect_list("__end").over(Window.partitionBy(*rest).orderBy("__block").rowsBetween(-reach, -1)))

    def carried(n: str) -> Column:
        def step(s: Column, e: Column) -> Column:
            return F.struct(*[(s[k] * F.pow(F.lit(decay[k]), e["__n"].cast("double")) + e[n][k]).alias(k) for k in sums])

        return F.aggregate("__earlier", zero, step)

    before = ends.withColumn("__earlier", earlier)
    before = before.select(*[F.col(d).alias(f"__r{k}") for k, d in enumerate(rest)], F.col("__block").alias("__b"), *[F.when(F.size("__earlier") > 0, carried(n)).otherwise(zero).alias(f"__c_{n}") for n in names])
    same = F.col("__block") == F.col("__b")
    for k, d in enumerate(rest):
        same = same & F.col(d).eqNullSafe(F.col(f"__r{k}"))
    joined = folded.join(before, same)
    each = joined.select(*rest, F.posexplode("__series").alias("__k", "__v"), *[f"__s_{n}" for n in names], *[f"__c_{n}" for n in names])

    def whole(n: str) -> Column:
        own = F.get(f"__s_{n}", "__k")
        s = F.struct(*[(F.col(f"__c_{n}")[k] * F.pow(F.lit(decay[k]), (F.col("__k") + 1).cast("double")) + own[k]).alias(k) for k in sums])
        held = F.col(f"__v.{n}").isNotNull() & F.col(f"__v.{other or n}").isNotNull()
        return F.when(held, F.get(F.transform(F.array(s), value), F.lit(0)))

    return cube.with_frame(each.select(F.col(f"__v.{dim}").alias(dim), *rest, *[whole(n).alias(n) for n in names]), dims=[dim, *rest], names=names)


def coarsen(cube: Cube, dim: str, window: int, name: str, boundary: str = "exact", side: str = "left", coord: str = "min") -> Cube:
    """A reducer over blocks of ``window`` positions.

    exact needs a whole number of blocks (one count), trim drops the rest, pad
    keeps a short block.  ``side`` tells from which end blocks are counted; the
    block's label is the least of its labels, or their mean.
    """
    rest = cube.rest(dim)
    size = cube.labels(dim).count() if boundary != "pad" or side == "right" else 0
    over = size % window if size else 0
    if boundary == "exact" and over:
        raise ValueError(f"{size} labels don't make blocks of {window}")
    shift = (over if boundary == "trim" else over - window if over else 0) if side == "right" else 0
    frame = cube.with_pos(dim).withColumn("__block", F.floor((F.col("__pos") - shift) / window))
    if boundary == "trim":
        frame = frame.where((F.col("__block") >= 0) & (F.col("__block") < size // window))
    label = F.min(dim) if coord == "min" else F.avg(dim)
    labels = frame.groupBy("__block").agg(label.alias(dim))
    out = frame.groupBy("__block", *rest).agg(*[aggregate(name, F.col(n)).alias(n) for n in cube.names]).join(labels, "__block")
    return cube.with_frame(out, dims=[dim, *rest], orders={}, spines={})


def coarsen_construct(cube: Cube, dim: str, window: int, block_dim: str, inner_dim: str) -> Cube:
    """The dimension as two: block, and place in it."""
    frame = cube.with_pos(dim).withColumn(block_dim, F.floor(F.col("__pos") / window)).withColumn(inner_dim, F.col("__pos") % window)
    return cube.with_frame(frame, dims=[block_dim, inner_dim, *cube.rest(dim)], coords={**cube.coords, dim: (block_dim, inner_dim)})


def shift(cube: Cube, dim: str, n: int, fill_value: Any = None) -> Cube:
    """Move values along positions; labels stay."""
    index = cube.index(dim)
    moved = cube.frame.join(index, dim).withColumn("pos", F.col("pos") + n).drop(dim).join(index, "pos").select(*cube.dims, *cube.names)
    out = cube.frame.select(*cube.dims).join(moved, list(cube.dims), "left")
    return cube.with_frame(out) if fill_value is None else cube.with_frame(out).fillna(fill_value)


def roll(cube: Cube, dim: str, n: int) -> Cube:
    """Move values around a dimension, the last ones to its beginning."""
    index = cube.index(dim)
    size = index.count()
    moved = cube.frame.join(index, dim).withColumn("pos", F.pmod(F.col("pos") + n, F.lit(size))).drop(dim)
    return cube.with_frame(moved.join(index, "pos").select(*cube.dims, *cube.names))


def diff(cube: Cube, dim: str, n: int = 1, label: str = "upper") -> Cube:
    """n-th difference along positions; each step leaves one label out, the lower or the upper."""
    for _ in range(n):
        index = cube.index(dim)
        step = 1 if label == "upper" else -1
        near = cube.frame.join(index, dim).withColumn("pos", F.col("pos") + step).drop(dim).join(index, "pos").select(*cube.dims, *[F.col(c).alias(f"__{c}") for c in cube.names])
        both = cube.frame.join(near, list(cube.dims))
        cube = cube.with_frame(both.withColumns({c: (F.col(c) - F.col(f"__{c}")) * step for c in cube.names}), orders={}, spines={})
    return cube


def rank(cube: Cube, dim: str, pct: bool = False) -> Cube:
    """Average rank from 1 along a dimension; missing stays missing; ``pct`` divides by the number of values."""
    rest = cube.rest(dim)
    if not is_small(cube.frame):
        return cube.with_frame(_ranked(cube.frame, rest, cube.names, pct))
    out = {}
    for n in cube.names:
        w = Window.partitionBy(*rest).orderBy(F.col(n).asc_nulls_last())
        ties = Window.partitionBy(*rest, n)
        r = F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2
        if pct:
            r = r / F.count(n).over(Window.partitionBy(*rest))
        out[n] = F.when(F.col(n).isNotNull(), r.cast("double"))
    return cube.with_frame(cube.frame.withColumns(out))


def _beside(frame: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """``frame`` with the columns of ``small``, a row for each combination of ``keys``, nulls among them."""
    named = small.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[c for c in small.columns if c not in keys])
    if not keys:
        return frame.crossJoin(F.broadcast(named))  # one row
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return frame.join(named, same).drop(*[f"__k{i}" for i in range(len(keys))])


def _ranked(frame: DataFrame, rest: list[str], names: tuple[str, ...], pct: bool) -> DataFrame:
    """Average ranks from the place of each value's first copy in the order of all; no series meets in one task."""
    for n in names:
        placed = number(frame.where(F.col(n).isNotNull()).select(*rest, n), [*rest, F.col(n)], "__place")
        values = placed.groupBy(*rest, n).agg(F.min("__place").alias("__first"), F.count(F.lit(1)).alias("__ties"))
        starts = values.groupBy(*rest).agg(F.min("__first").alias("__start"), F.sum("__ties").alias("__n"))
        r = F.col("__first") - F.col("__start") + (F.col("__ties") + 1) / 2
        ranks = _beside(values, starts, rest).select(*rest, F.col(n).alias("__value"), (r / F.col("__n") if pct else r).cast("double").alias("__rank"))
        named = ranks.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(rest)], "__value", "__rank")
        same = F.col(n) == F.col("__value")
        for i, k in enumerate(rest):
            same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
        others = [c for c in frame.columns if c != n]
        frame = frame.join(named, same, "left").select(*others, F.col("__rank").alias(n))
    return frame


def ranking(cube: Cube, dim: str, name: str) -> Cube:
    """row_number, dense_rank, percent_rank, cume_dist or ntile:n of each variable along a dimension, ties by label."""
    kind, _, arg = name.partition(":")
    func = {"row_number": F.row_number, "dense_rank": F.dense_rank, "percent_rank": F.percent_rank, "cume_dist": F.cume_dist, "ntile": lambda: F.ntile(int(arg))}[kind]
    rest = cube.rest(dim)
    if is_small(cube.frame):
        return cube.with_frame(cube.frame.withColumns({n: func().over(Window.partitionBy(*rest).orderBy(F.col(n), F.col(dim))) for n in cube.names}))
    frame = cube.frame
    for n in cube.names:
        # No two rows of a series tie, so all of these follow from a row's place and the series' length.
        frame = number(frame, [*rest, F.col(n), F.col(dim)], "__place")
        starts = frame.groupBy(*rest).agg(F.min("__place").alias("__start"), F.count(F.lit(1)).alias("__n"))
        frame = _beside(frame, starts, rest)
        at, size = F.col("__place") - F.col("__start"), F.col("__n")
        if kind == "ntile":
            short, more = F.floor(size / int(arg)), size % int(arg)
            out = F.when(at < more * (short + 1), F.floor(at / (short + 1))).otherwise(more + F.floor((at - more * (short + 1)) / F.greatest(short, F.lit(1)))) + 1
        else:
            out = {"row_number": at + 1, "dense_rank": at + 1, "percent_rank": F.coalesce(F.try_divide(at.cast("double"), size - 1), F.lit(0.0)), "cume_dist": (at + 1) / size}[kind]
        frame = frame.withColumn(n, out if kind in ("percent_rank", "cume_dist") else out.cast("int")).drop("__place", "__start", "__n")
    return cube.with_frame(frame)


def fill(cube: Cube, dim: str, forward: bool = True, limit: int | None = None) -> Cube:
    """Carry the last (or next) value along a dimension, over at most ``limit`` positions."""
    held = {n: F.when(F.col(n).isNotNull(), F.struct("__pos", F.col(n).alias("v"))) for n in cube.names}
    frame = nearest_values(cube.with_pos(dim), cube.rest(dim), held, is_small(cube.frame), forward, not forward)
    side = "last" if forward else "next"
    out = {}
    for n in cube.names:
        found = F.col(f"__{side}_{n}")
        out[n] = found["v"] if limit is None else F.when(F.abs(F.col("__pos") - found["__pos"]) <= limit, found["v"])
    return cube.with_frame(frame.withColumns(out))


def ffill(cube: Cube, dim: str, limit: int | None = None) -> Cube:
    return fill(cube, dim, True, limit)


def bfill(cube: Cube, dim: str, limit: int | None = None) -> Cube:
    return fill(cube, dim, False, limit)
