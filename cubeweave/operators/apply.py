"""User functions over cubes: on aligned cells, along core dimensions, and by block."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeweave.cube import Cube

HOW = {"inner": "inner", "outer": "full", "left": "left", "right": "right"}


def _together(cubes: Sequence[Cube], join: str) -> tuple[DataFrame, list[str]]:
    """All cubes' one variable, as ``__0``, ``__1`` …, on common labels."""
    for c in cubes:
        if len(c.names) != 1:
            raise ValueError("each cube has to have one variable")
    if join == "exact":
        from cubeweave.operators.align import align

        align(*cubes, join="exact")
    sides = [(c.frame.select(*c.dims, F.col(c.names[0]).alias(f"__{k}")), list(c.dims)) for k, c in enumerate(cubes)]

    def two(a: tuple, b: tuple) -> tuple:
        shared = [d for d in a[1] if d in b[1]]
        both = a[0].join(b[0], shared, HOW.get(join, "inner")) if shared else a[0].crossJoin(b[0])
        return both, [*a[1], *[d for d in b[1] if d not in a[1]]]

    return reduce(two, sides)


def apply_ufunc(
    func: Callable[..., Any], *cubes: Cube, core: Sequence[str] = (), out_core: str | None = None, join: str = "inner",
    vectorize: bool = False, name: str = "result", kind: str = "double", kwargs: Mapping[str, Any] | None = None,
) -> Cube:
    """A function of arrays over cubes of one variable each, joined on their shared dimensions.

    Without ``core`` the function gets pandas series of aligned cells, an Arrow
    batch at a time, and returns as many values.  With ``core`` it gets, for each
    combination of the other dimensions, arrays in the order of the core labels:
    stacked along a first axis for series of equal length, or one at a time with
    ``vectorize``.  It returns a number for each, or, with ``out_core``, an array:
    along a core dimension of that name its labels return, along a new one there
    are positions from 0.  A missing value is NaN.

    What shares the other dimensions' labels is one row of arrays: a series has to
    fit in a task, as it does in memory for whoever calls such a function at all.
    A cube without any core dimension gives its one value.  No cells, no rows.
    """
    extra = dict(kwargs or {})
    frame, dims = _together(cubes, join)
    values = [f"__{k}" for k in range(len(cubes))]
    if not core:
        plain = F.pandas_udf(lambda *cols: pd.Series(func(*cols, **extra)), kind)
        return Cube(frame.select(*dims, plain(*values).alias(name)), tuple(dims), (name,))
    for d in core:
        if d not in dims:
            raise KeyError(f"no dimension {d}")
    loop = [d for d in dims if d not in core]
    cells = F.array_sort(F.collect_list(F.struct(*core, *values)))
    whole = frame.groupBy(*loop).agg(cells.alias("__cells"), F.count(F.lit(1)).alias("__n")).where("__n > 0")
    along = [bool(set(c.dims) & set(core)) for c in cubes]
    column = lambda n: F.transform("__cells", lambda x: x[n].cast("double"))
    inputs = [column(v) if a else F.get("__cells", F.lit(0))[v].cast("double") for v, a in zip(values, along)]

    def run(*cols: pd.Series) -> pd.Series:
        arrays = [[np.asarray(x, float) for x in c] if a else c.to_numpy(float) for c, a in zip(cols, along)]
        out: list[Any] = [None] * len(cols[0])
        if vectorize:
            for k in range(len(out)):
                out[k] = func(*[a[k] for a in arrays], **extra)
        else:
            lengths = np.array([len(x) for x in arrays[along.index(True)]], int)
            for n in np.unique(lengths):
                rows = np.flatnonzero(lengths == n)
                got = func(*[np.stack([a[k] for k in rows]) for a in arrays], **extra)
                for k, x in zip(rows, got):
                    out[k] = x
        return pd.Series([np.asarray(x, float) for x in out] if out_core else out)

    done = F.pandas_udf(run, f"array<{kind}>" if out_core else kind)
    if not out_core:
        return Cube(whole.select(*loop, done(*inputs).alias(name)), tuple(loop), (name,))
    if out_core not in core:
        long = whole.select(*loop, F.posexplode(done(*inputs)).alias(out_core, name))
        return Cube(long, (*loop, out_core), (name,))
    if len(core) > 1:
        raise ValueError("labels return along one core dimension only")
    pairs = whole.select(*loop, F.transform("__cells", lambda x: x[out_core]).alias(out_core), done(*inputs).alias(name))
    long = pairs.select(*loop, F.explode(F.arrays_zip(out_core, name)).alias("__z")).select(*loop, f"__z.{out_core}", f"__z.{name}")
    return Cube(long, (*loop, out_core), (name,))


def map_blocks(func: Callable[..., pd.DataFrame], cube: Cube, template: Cube | None = None, by: Sequence[str] = (), kwargs: Mapping[str, Any] | None = None) -> Cube:
    """A function of pandas frames over blocks: Arrow batches, or with ``by`` all cells of these dimensions' labels.

    The result has the dimensions, variables and types of ``template`` (of the cube
    itself by default); a block whose columns differ raises.  A block by ``by``
    has to fit in a task.
    """
    like = template or cube
    wanted = [*like.dims, *like.names]
    schema, extra = like.frame.select(*wanted).schema, dict(kwargs or {})

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out = func(pdf, **extra)
        if set(out.columns) != set(wanted):
            raise ValueError(f"a block has columns {sorted(out.columns)}, the template {sorted(wanted)}")
        return out[wanted]

    cells = cube.frame.select(*cube.dims, *cube.names)
    if by:
        cube.rest(*by)
        frame = cells.groupBy(*by).applyInPandas(one, schema)
    else:
        frame = cells.mapInPandas(lambda parts: (one(p) for p in parts), schema)
    return Cube(frame, like.dims, like.names, {}, like.attrs, like.var_attrs)
