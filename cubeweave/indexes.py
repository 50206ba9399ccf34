"""Indexes whose labels follow from positions by a formula, so that no label is stored or looked up."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeweave.cube import Cube


@dataclass(frozen=True)
class RangeIndex:
    """``size`` labels from ``start`` at a distance of ``step``."""

    start: float
    step: float
    size: int

    @classmethod
    def arange(cls, start: float, stop: float, step: float = 1.0) -> RangeIndex:
        """From ``start`` up to, but without, ``stop``."""
        if step == 0:
            raise ValueError("a step can't be 0")
        return cls(float(start), float(step), max(0, math.ceil((stop - start) / step)))

    @classmethod
    def linspace(cls, start: float, stop: float, num: int = 50, endpoint: bool = True) -> RangeIndex:
        """``num`` labels between two ends."""
        parts = num - 1 if endpoint else num
        return cls(float(start), (stop - start) / parts if parts > 0 else 0.0, num)

    def label(self, pos: Column) -> Column:
        return F.when((pos >= 0) & (pos < self.size), F.lit(self.start) + pos * F.lit(self.step))

    def position(self, label: Column, method: str | None = None, tolerance: float | None = None) -> Column:
        """The place of a label; with ``method`` nearest that of the closest one, the ends for labels beyond them.

        Without it only labels that are there up to rounding (a millionth of a step) have a place.
        """
        if not self.size:
            return F.lit(None).cast("bigint")
        at = (label - F.lit(self.start)) / F.lit(self.step or 1.0)
        pos = F.when(at.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(self.size - 1), F.rint(at).cast("bigint"))))
        off = F.abs(at - pos)
        limit = 1e-6 if method is None else None if tolerance is None else tolerance / abs(self.step or 1.0)
        return pos if limit is None else F.when(off <= limit, pos)

    def __getitem__(self, part: slice) -> RangeIndex:
        a, b, s = part.indices(self.size)
        return RangeIndex(self.start + a * self.step, self.step * s, len(range(a, b, s)))

    def frame(self, spark: SparkSession, name: str) -> DataFrame:
        """(label, pos), made in Spark."""
        return spark.range(self.size).select(self.label(F.col("id")).alias(name), F.col("id").alias("pos"))

    def equals(self, rest: Any, rounds: int = 6) -> bool:
        """Whether another index has the same labels, to so many digits."""
        return isinstance(rest, RangeIndex) and self.size == rest.size and (round(self.start, rounds), round(self.step, rounds)) == (round(rest.start, rounds), round(rest.step, rounds))

    def to_cube(self, cube: Cube, dim: str, name: str) -> Cube:
        """Labels as the key in place of positions ``dim``: a projection, without a join."""
        labelled = cube.frame.withColumn(name, self.label(F.col(dim))).drop(dim)
        return cube.with_frame(labelled, dims=[name if d == dim else d for d in cube.dims])

    def select(self, cube: Cube, dim: str, low: float, high: float) -> Cube:
        """Cells of a cube over positions whose labels are in [low, high]: a filter on positions that reaches the scan."""
        ends = sorted(((low - self.start) / (self.step or 1.0), (high - self.start) / (self.step or 1.0)))
        a, b = max(0, math.ceil(round(ends[0], 9))), min(self.size - 1, math.floor(round(ends[1], 9)))
        return cube.with_frame(cube.frame.where(F.col(dim).between(a, b)))


@dataclass(frozen=True)
class TransformIndex:
    """Coordinates of several dimensions by a formula: ``forward`` turns positions into labels, ``reverse`` labels into positions."""

    dims: tuple[str, ...]
    forward: Callable[..., dict[str, Column]]
    reverse: Callable[..., dict[str, Column]]

    def label(self, cube: Cube) -> Cube:
        """The cube with its coordinates beside the positions."""
        new = self.forward(*[F.col(d) for d in self.dims])
        return cube.assign_coords({n: self.dims for n in new}, **new)

    def nearest(self, cube: Cube, points: DataFrame) -> DataFrame:
        """The cells nearest to points given by coordinates; points beyond the cube find missing cells.  A join on positions."""
        place = {f"__{d}": F.rint(c).cast("bigint") for d, c in self.reverse(points).items()}
        cells = cube.frame.select(*[F.col(d).cast("bigint").alias(f"__{d}") for d in self.dims], *cube.names)
        return points.withColumns(place).join(cells, [f"__{d}" for d in self.dims], "left").drop(*[f"__{d}" for d in self.dims])
