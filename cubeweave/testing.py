"""Assertions on cubes; each compares by joins in Spark and shows only the first rows that differ."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cubeweave.cube import Cube


def _shape(a: Cube, b: Cube) -> None:
    if set(a.dims) != set(b.dims):
        raise AssertionError(f"dimensions {a.dims} and {b.dims} differ")
    if set(a.names) != set(b.names):
        raise AssertionError(f"variables {a.names} and {b.names} differ")


def _compare(a: Cube, b: Cube, same) -> None:
    """Cells on all labels of either; ``same`` tells whether two values agree."""
    _shape(a, b)
    left = a.frame.select(*a.dims, F.lit(True).alias("__in_a"), *[F.col(n).alias(f"__a_{n}") for n in a.names])
    right = b.frame.select(*a.dims, F.lit(True).alias("__in_b"), *[F.col(n).alias(f"__b_{n}") for n in a.names])
    both = left.join(right, list(a.dims), "full") if a.dims else left.crossJoin(right)
    tests = [F.col("__in_a").isNotNull() & F.col("__in_b").isNotNull(), *[F.coalesce(same(F.col(f"__a_{n}"), F.col(f"__b_{n}")), F.lit(False)) for n in a.names]]
    wrong = both.where(~reduce(lambda x, y: x & y, tests)).take(5)
    if wrong:
        raise AssertionError("cells differ, among them:\n" + "\n".join(map(str, wrong)))


def assert_equal(a: Cube, b: Cube) -> None:
    """Same dimensions, labels and values; missing equals missing."""
    _compare(a, b, lambda x, y: x.eqNullSafe(y))


def assert_identical(a: Cube, b: Cube) -> None:
    """Equal, with the same attributes."""
    if dict(a.attrs) != dict(b.attrs) or {k: dict(v) for k, v in a.var_attrs.items()} != {k: dict(v) for k, v in b.var_attrs.items()}:
        raise AssertionError("attributes differ")
    assert_equal(a, b)


def assert_allclose(a: Cube, b: Cube, rtol: float = 1e-5, atol: float = 1e-8) -> None:
    """Numbers within ``atol + rtol * |b|``, all else equal."""

    def near(x: Column, y: Column) -> Column:
        x_, y_ = x.try_cast("double"), y.try_cast("double")
        return x.eqNullSafe(y) | F.coalesce(F.abs(x_ - y_) <= atol + rtol * F.abs(y_), F.lit(False))

    _compare(a, b, near)
