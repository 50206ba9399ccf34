"""Interpolation, calculus along a coordinate and curve fitting."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubeweave.cube import Cube
from cubeweave.functions.dates import us
from cubeweave.functions.math import ratio
from cubeweave.operators.window import nearest_values, running
from cubeweave import ranges
from cubeweave.ranges import dealt, halo, is_small, number, scan


def axis(cube: Cube, dim: str) -> Column:
    """A dimension's labels as numbers: times in seconds."""
    return us(F.col(dim)) / 1e6 if dict(cube.frame.dtypes)[dim].startswith(("timestamp", "date")) else F.col(dim).cast("double")


def interp(cube: Cube, dim: str, targets: DataFrame | Sequence[Any], method: str = "linear") -> Cube:
    """Values at new labels: linear between the labels around them, or nearest; missing outside.

    Targets and labels go through an ordered window per series, which carries the
    last value before and the next one after; beyond small frames, through ranges
    of it (a job).
    """
    spark = cube.frame.sparkSession
    wanted = targets.select(dim) if isinstance(targets, DataFrame) else spark.createDataFrame([(x,) for x in targets], cube.frame.select(dim).schema)
    rest = cube.rest(dim)
    grid = wanted.crossJoin(cube.frame.select(*rest).distinct()) if rest else wanted
    both = cube.frame.select(dim, *rest, *cube.names).withColumn("__t", F.lit(0)).unionByName(grid.withColumn("__t", F.lit(1)), allowMissingColumns=True)
    both = both.withColumn("__x", axis(cube, dim))
    held = {n: F.when(F.col(n).isNotNull(), F.struct(F.col("__x").alias("x"), F.col(n).cast("double").alias("y"))) for n in cube.names}
    part = rest
    whole = is_small(cube.frame) and is_small(wanted)
    if not whole:
        # Ranges of a series, dealt out once, hand over their last and first values.
        both = dealt(both, [*rest, "__x", "__t"])
        part = [*rest, "__part"]
    w = Window.partitionBy(*part)
    back, ahead = w.orderBy("__x", "__t").rowsBetween(Window.unboundedPreceding, 0), w.orderBy(F.col("__x").desc(), "__t").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({f"__h_{n}": c for n, c in held.items()})
    both = both.withColumns({f"__a_{n}": F.last(f"__h_{n}", ignorenulls=True).over(back) for n in held} | {f"__b_{n}": F.last(f"__h_{n}", ignorenulls=True).over(ahead) for n in held})
    if not whole:
        both = scan(both, rest, {f"__ca_{n}": F.max(f"__h_{n}") for n in held}, F.max, block="__part")
        both = scan(both, rest, {f"__cb_{n}": F.min(f"__h_{n}") for n in held}, F.min, block="__part", reverse=True)
        both = both.withColumns({f"__a_{n}": F.coalesce(f"__a_{n}", f"__ca_{n}") for n in held} | {f"__b_{n}": F.coalesce(f"__b_{n}", f"__cb_{n}") for n in held})

    def value(n: str) -> Column:
        a, b, x = F.col(f"__a_{n}"), F.col(f"__b_{n}"), F.col("__x")
        inside = a.isNotNull() & b.isNotNull()
        if method == "nearest":
            return F.when(inside, F.when(x - a["x"] <= b["x"] - x, a["y"]).otherwise(b["y"]))
        if method == "zero":
            return F.when(inside, a["y"])
        line = a["y"] + (b["y"] - a["y"]) * F.coalesce(F.try_divide(x - a["x"], b["x"] - a["x"]), F.lit(0.0))
        return F.when(inside, line)

    return cube.with_frame(both.where("__t = 1").withColumns({n: value(n) for n in cube.names}).select(dim, *rest, *cube.names), dims=[dim, *rest], orders={}, spines={})


def interp_like(cube: Cube, other: Cube, method: str = "linear") -> Cube:
    """Onto another cube's labels, one dimension after the other."""
    for d in cube.dims:
        if d in other.dims:
            cube = interp(cube, d, other.labels(d), method)
    return cube


def interp_smooth(cube: Cube, dim: str, targets: Sequence[float], method: str = "cubic") -> DataFrame:
    """Cubic spline (not-a-knot), pchip, akima, quadratic, polynomial or barycentric interpolation of each series.

    A series is fitted as a whole in one Arrow task, so this suits series that fit
    in memory.
    """
    import numpy as np

    from cubeweave.functions.splines import evaluate

    rest, names = cube.rest(dim), list(cube.names)
    points = np.asarray(list(targets), float)
    schema = ", ".join([f"`{dim}` double", *[f"`{d}` {dict(cube.frame.dtypes)[d]}" for d in rest], *[f"`{n}` double" for n in names]])

    def run(key: tuple, pdf):
        import pandas as pd

        pdf = pdf.sort_values(dim)
        out = {dim: points}
        for d, k in zip(rest, key):
            out[d] = k
        for n in names:
            ok = pdf[n].notna()
            out[n] = evaluate(pdf.loc[ok, dim].to_numpy(float), pdf.loc[ok, n].to_numpy(float), points, method)
        return pd.DataFrame(out)[[dim, *rest, *names]]

    frame = cube.frame if rest else cube.frame.withColumn("__all", F.lit(0))
    return frame.groupBy(*(rest or ["__all"])).applyInPandas(lambda k, p: run(k if rest else (), p), schema)


def interpolate_na(cube: Cube, dim: str, method: str = "linear", limit: int | None = None, max_gap: float | None = None, use_coordinate: bool = True) -> Cube:
    """Fill missing values between present ones; at most ``limit`` in a row, and only gaps of up to ``max_gap`` along the coordinate."""
    rest = cube.rest(dim)
    frame = cube.with_pos(dim).withColumn("__x", axis(cube, dim) if use_coordinate else F.col("__pos").cast("double"))
    held = {n: F.when(F.col(n).isNotNull(), F.struct(F.col("__pos").alias("p"), F.col("__x").alias("x"), F.col(n).cast("double").alias("y"))) for n in cube.names}
    frame = nearest_values(frame, rest, held, is_small(cube.frame))
    out = {}
    for n in cube.names:
        a, b = F.col(f"__last_{n}"), F.col(f"__next_{n}")
        x = F.col("__x")
        share = F.try_divide(x - a["x"], b["x"] - a["x"])
        value = a["y"] + (b["y"] - a["y"]) * share if method == "linear" else F.when(x - a["x"] <= b["x"] - x, a["y"]).otherwise(b["y"])
        ok = a.isNotNull() & b.isNotNull()
        if limit is not None:
            ok = ok & (F.col("__pos") - a["p"] <= limit)
        if max_gap is not None:
            ok = ok & (b["x"] - a["x"] <= max_gap)
        out[n] = F.when(F.col(n).isNotNull(), F.col(n).cast("double")).when(ok, value)
    return cube.with_frame(frame.withColumns(out))


def differentiate(cube: Cube, dim: str, edge_order: int = 1) -> Cube:
    """Second-order differences on uneven labels; one-sided at the ends, of first or second order."""
    rest = cube.rest(dim)
    frame, w = _rows(cube, dim, 2)
    x = F.col("__x")
    lag = lambda c, k=1: F.lag(c, k).over(w)
    lead = lambda c, k=1: F.lead(c, k).over(w)
    out = {}
    for n in cube.names:
        f = F.col(n).cast("double")
        hs, hd = x - lag("__x"), lead("__x") - x
        middle = (hs * hs * lead(f) + (hd * hd - hs * hs) * f - hd * hd * lag(f)) / (hs * hd * (hd + hs))
        if edge_order == 1:
            first, last = (lead(f) - f) / (lead("__x") - x), (f - lag(f)) / (x - lag("__x"))
        else:
            h1, h2 = lead("__x") - x, lead("__x", 2) - lead("__x")
            first = -(2 * h1 + h2) / (h1 * (h1 + h2)) * f + (h1 + h2) / (h1 * h2) * lead(f) - h1 / (h2 * (h1 + h2)) * lead(f, 2)
            g1, g2 = lag("__x") - lag("__x", 2), x - lag("__x")
            last = g2 / (g1 * (g1 + g2)) * lag(f, 2) - (g2 + g1) / (g1 * g2) * lag(f) + (2 * g2 + g1) / (g2 * (g1 + g2)) * f
        out[n] = F.when(lag("__x").isNull(), first).when(lead("__x").isNull(), last).otherwise(middle)
    return cube.with_frame(frame.withColumns(out).where("own"))


def _rows(cube: Cube, dim: str, reach: int) -> tuple[DataFrame, Any]:
    """The frame with its axis as ``__x``, and a window for lag and lead of up to ``reach`` rows of a series; rows with ``own`` false go after it.

    Neighbours are those among a series' rows, however far their positions are, so
    beyond small frames blocks are of numbered rows.
    """
    rest = cube.rest(dim)
    if is_small(cube.frame):
        frame = cube.with_pos(dim).withColumn("__x", axis(cube, dim)).withColumn("own", F.lit(True))
        return frame, Window.partitionBy(*rest).orderBy("__pos")
    held, order = (cube.with_pos(dim, "__old"), "__old") if dim in cube.orders else (cube.frame, dim)
    frame = number(held.withColumn("__x", axis(cube, dim)), [*rest, F.col(order)], "__pos")
    return halo(frame, "__pos", ranges.BLOCK_ROWS, reach, reach), Window.partitionBy(*rest, "block").orderBy("__pos")


def _trapezoids(cube: Cube, dim: str) -> DataFrame:
    frame, w = _rows(cube, dim, 1)
    step = F.col("__x") - F.lag("__x").over(w)
    return frame.withColumns({n: F.coalesce((F.col(n) + F.lag(n).over(w)) / 2 * step, F.lit(0.0)) for n in cube.names}).where("own")


def integrate(cube: Cube, dim: str) -> Cube:
    """Trapezoid rule along a coordinate."""
    rest = cube.rest(dim)
    return cube.with_frame(_trapezoids(cube, dim).groupBy(*rest).agg(*[F.sum(n).alias(n) for n in cube.names]), dims=rest)


def cumulative_integrate(cube: Cube, dim: str) -> Cube:
    """Running trapezoid rule, from 0."""
    frame, values, _ = running(cube.with_frame(_trapezoids(cube, dim)), dim, "sum", {n: F.col(n) for n in cube.names})
    return cube.with_frame(frame.withColumns(values))


def polyfit(cube: Cube, dim: str, degree: int) -> Cube:
    """Least-squares polynomial of each series, coefficients along ``degree`` from the highest down.

    Degree 1 is two aggregates.  Higher ones sum the moments of the scaled and
    centred coordinate in one pass and solve the small system for each series.
    """
    rest = cube.rest(dim)
    (n,) = cube.names
    frame = cube.frame.where(F.col(n).isNotNull()).select(*rest, axis(cube, dim).alias("__x"), F.col(n).cast("double").alias("__y"))
    if degree == 1:
        fit = frame.groupBy(*rest).agg(F.regr_slope("__y", "__x").alias("b"), F.regr_intercept("__y", "__x").alias("a"))
        parts = F.array(F.struct(F.lit(1).alias("degree"), F.col("b").alias(n)), F.struct(F.lit(0).alias("degree"), F.col("a").alias(n)))
        return Cube(fit.select(*rest, F.inline(parts)), ("degree", *rest), (n,), {}, cube.attrs)
    centre = frame.groupBy(*rest).agg(F.avg("__x").alias("__m"), F.coalesce(F.nullif(F.stddev_pop("__x"), F.lit(0.0)), F.lit(1.0)).alias("__s"))
    scaled = (frame.join(centre, rest) if rest else frame.crossJoin(centre)).withColumn("__z", (F.col("__x") - F.col("__m")) / F.col("__s"))
    moments = scaled.groupBy(*rest).agg(F.first("__m").alias("__m"), F.first("__s").alias("__s"), F.array(*[F.sum(F.pow("__z", F.lit(k))) for k in range(2 * degree + 1)]).alias("__xx"), F.array(*[F.sum(F.pow("__z", F.lit(k)) * F.col("__y")) for k in range(degree + 1)]).alias("__xy"))
    schema = ", ".join(["degree int", *[f"`{d}` {dict(cube.frame.dtypes)[d]}" for d in rest], f"`{n}` double"])

    def solve(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                r = r._asdict() if hasattr(r, "_asdict") else dict(zip(pdf.columns, r))
                m, s, xx, xy = (r[c] for c in ("m_", "s_", "xx_", "xy_"))
                system = np.array([[xx[i + j] for j in range(degree + 1)] for i in range(degree + 1)])
                z = np.linalg.lstsq(system, np.asarray(xy), rcond=None)[0]
                # From powers of (x - m) / s to powers of x.
                poly = np.zeros(1)
                for k in range(degree, -1, -1):
                    poly = np.polynomial.polynomial.polyadd(np.polynomial.polynomial.polymul(poly, [-m / s, 1 / s]), [z[k]])
                for k in range(degree, -1, -1):
                    rows.append([k, *[r[d] for d in rest], float(poly[k]) if k < len(poly) else 0.0])
            yield pd.DataFrame(rows, columns=["degree", *rest, n])

    small = moments.select(*rest, F.col("__m").alias("m_"), F.col("__s").alias("s_"), F.col("__xx").alias("xx_"), F.col("__xy").alias("xy_"))
    return Cube(small.mapInPandas(solve, schema), ("degree", *rest), (n,), {}, cube.attrs)


def polyval(x: Column, coefficients: Sequence[float | Column]) -> Column:
    """A polynomial by Horner's rule; coefficients from the highest degree down."""
    out = F.lit(0.0)
    for c in coefficients:
        out = out * x + c
    return out


def curvefit(cube: Cube, dim: str, func: Callable[..., Any], params: dict[str, float], steps: int = 60) -> DataFrame:
    """Nonlinear least squares of each series by damped Gauss-Newton steps; ``func(x, *params)`` works on arrays."""
    rest = cube.rest(dim)
    (n,) = cube.names
    names, start = list(params), list(params.values())
    schema = ", ".join([*[f"`{d}` {dict(cube.frame.dtypes)[d]}" for d in rest], *[f"`{p}` double" for p in names]])
    frame = cube.frame.where(F.col(n).isNotNull()).select(*rest, axis(cube, dim).alias("x_"), F.col(n).cast("double").alias("y_"))

    def run(key: tuple, pdf):
        import numpy as np
        import pandas as pd

        x, y, p, damp = pdf["x_"].to_numpy(), pdf["y_"].to_numpy(), np.array(start, float), 1e-3
        loss = float(((func(x, *p) - y) ** 2).sum())
        for _ in range(steps):
            base = func(x, *p)
            jac = np.stack([(func(x, *(p + np.eye(len(p))[k] * (h := 1e-6 * max(1, abs(p[k]))))) - base) / h for k in range(len(p))], 1)
            normal = jac.T @ jac
            step = np.linalg.lstsq(normal + damp * np.diag(np.diag(normal) + 1e-12), jac.T @ (y - base), rcond=None)[0]
            new = float(((func(x, *(p + step)) - y) ** 2).sum())
            if new < loss:
                p, loss, damp = p + step, new, damp / 3
            else:
                damp *= 4
        return pd.DataFrame([[*key, *p]], columns=[*rest, *names])

    grouped = frame if rest else frame.withColumn("all_", F.lit(0))
    return grouped.groupBy(*(rest or ["all_"])).applyInPandas(lambda k, pdf: run(k if rest else (), pdf), schema)


def slope(x: Column, y: Column) -> Column:
    return ratio(F.covar_pop(x, y), F.var_pop(x))
