"""Nearest neighbours in several coordinates, by tiles of about as many points each."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cubeweave.ranges import kept, number

#: Points of a tile, and targets that are compared with a tile at a time, about.
TILE_POINTS, CHUNK_TARGETS = 1024, 2048
#: Distances of a comparison that are in memory at once.
MATRIX = 1 << 20


def first_with(a: np.ndarray, b: np.ndarray, holds) -> np.ndarray:
    """For each range [a, b) the first place at which ``holds``, which stays true from there on; b if nowhere."""
    a, b = a.copy(), b.copy()
    while (open_ := a < b).any():
        mid = np.where(open_, (a + b) // 2, 0)
        yes = holds(mid)
        b = np.where(open_ & yes, mid, b)
        a = np.where(open_ & ~yes, mid + 1, a)
    return a


class Tiles:
    """Boxes of tiles, and the tree over them: level j parts a node by ranks of coordinate j, so siblings are in order."""

    def __init__(self, tiles: np.ndarray, low: np.ndarray, high: np.ndarray, fan: int) -> None:
        order = np.argsort(tiles)
        self.tiles, self.box_low, self.box_high = tiles[order], low[order], high[order]
        self.low, self.high, self.first, self.last = [], [], [], []
        dims, above = low.shape[1], np.zeros(1, np.int64)
        for j in range(dims):
            nodes, starts = np.unique(self.tiles // fan ** (dims - 1 - j), return_index=True)
            self.low.append(np.minimum.reduceat(self.box_low[:, j], starts))
            self.high.append(np.maximum.reduceat(self.box_high[:, j], starts))
            self.first.append(np.searchsorted(nodes // fan, above))
            self.last.append(np.searchsorted(nodes // fan, above, "right"))
            above = nodes

    def own(self, at: np.ndarray) -> np.ndarray:
        """A tile for each place, near it."""
        node = np.zeros(len(at), np.int64)
        for j, high in enumerate(self.high):
            a, b = self.first[j][node], self.last[j][node]
            node = np.minimum(first_with(a, b, lambda k: high[k] >= at[:, j]), b - 1)
        return self.tiles[node]

    def within(self, at: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, tile) of all tiles whose box comes as near to the place as ``distance``."""
        reach = distance * (1 + 1e-9) + 1e-150
        row, node = np.arange(len(at)), np.zeros(len(at), np.int64)
        for j in range(at.shape[1]):
            a, b, x, r = self.first[j][node], self.last[j][node], at[row, j], reach[row]
            begin = first_with(a, b, lambda k: self.high[j][k] >= x - r)
            n = np.maximum(first_with(begin, b, lambda k: self.low[j][k] > x + r) - begin, 0)
            row, node = np.repeat(row, n), np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
        gap = np.maximum(np.maximum(self.box_low[node] - at[row], at[row] - self.box_high[node]), 0)
        near = np.sqrt((gap * gap).sum(axis=1)) <= reach[row]
        return row[near], self.tiles[node[near]]


def nearest_points(points: DataFrame, targets: DataFrame, coords: Sequence[str], cell: float, point_id: str = "point", target_id: str = "target") -> DataFrame:
    """Nearest neighbour in several coordinates: target, point and distance; of points as near, the least.

    Points are cut by ranks into tiles of about TILE_POINTS, however dense or far
    apart they are.  Each target is compared with one tile near it, and then with
    all tiles whose boxes come nearer than what it found there, so that the
    result is exact.  Targets of one tile are dealt out in chunks.  Targets that
    lack a coordinate, and all targets where no point has every one, find nothing:
    their point and distance are missing.  ``cell`` was the width of a grid; the
    result doesn't depend on it.  Runs jobs.
    """
    names = [f"__c{k}" for k in range(len(coords))]
    whole = reduce(lambda a, b: a & b, [F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False)) for c in coords])
    # Zeros of both signs are one place.
    places = [(F.col(c).cast("double") + F.lit(0.0)).alias(n) for c, n in zip(coords, names)]
    kind, own_kind = points.schema[point_id].dataType, targets.schema[target_id].dataType
    none = [F.lit(None).cast(kind).alias(point_id), F.lit(None).cast("double").alias("distance")]
    distinct = points.where(whole).select(*places, F.col(point_id).alias("__p")).groupBy(*names).agg(F.min("__p").alias("__p"))
    total = distinct.count()
    if not total:
        return targets.select(target_id, *none)
    fan = 1
    while fan ** len(names) * TILE_POINTS < total:
        fan += 1
    tiled = number(distinct, [F.col(n) for n in names], "__pos").withColumn("__tile", F.floor(F.col("__pos") * fan / F.lit(total)).cast("bigint"))
    for k in range(1, len(names)):
        inside = Window.partitionBy("__tile")
        ranked = tiled.withColumn("__pos", F.row_number().over(inside.orderBy(names[k], *names)) - 1).withColumn("__n", F.count(F.lit(1)).over(inside))
        tiled = ranked.withColumn("__tile", (F.col("__tile") * fan + F.floor(F.col("__pos") * fan / F.col("__n"))).cast("bigint"))
    tiled = kept(tiled.select("__tile", F.row_number().over(Window.partitionBy("__tile").orderBy("__p")).alias("__nth"), *names, "__p"))
    rows = tiled.groupBy("__tile").agg(*[F.min(n) for n in names], *[F.max(n) for n in names]).collect()
    boxes = np.array([tuple(r)[1:] for r in rows], np.float64)
    tiles = Tiles(np.array([r[0] for r in rows], np.int64), boxes[:, : len(names)], boxes[:, len(names) :], fan)

    @F.pandas_udf("bigint")
    def tile_of(*at: pd.Series) -> pd.Series:
        return pd.Series(tiles.own(np.column_stack(at)))

    @F.pandas_udf("array<bigint>")
    def tiles_within(*columns: pd.Series) -> pd.Series:
        *at, distance, own = [c.to_numpy() for c in columns]
        row, tile = tiles.within(np.column_stack(at), distance)
        other = tile != own[row]
        row, tile = row[other], tile[other]
        return pd.Series(np.split(tile, np.searchsorted(row, np.arange(1, len(own)))))

    def compare(there: pa.Table, looking: pa.Table) -> pa.Table:
        # In the order of ids the first of the least is the least of the first.
        there = there.take(pa.array(np.argsort(there["__nth"].to_numpy())))
        have, want = [np.column_stack([t[n].to_numpy() for n in names]) for t in (there, looking)]
        best, least = np.zeros(len(want), np.int64), np.zeros(len(want))
        step = max(1, MATRIX // max(1, len(have)))
        for k in range(0, len(want), step):
            squares = sum((want[k : k + step, None, j] - have[None, :, j]) ** 2 for j in range(len(names)))
            distance = np.sqrt(squares)
            best[k : k + step] = distance.argmin(axis=1)
            least[k : k + step] = distance.min(axis=1)
        return looking.select(["__t", *names, "__tile"]).append_column("__p", there["__p"].take(pa.array(best))).append_column("distance", pa.array(least))

    schema = f"__t {own_kind.simpleString()}, {', '.join(f'{n} double' for n in names)}, __tile bigint, __p {kind.simpleString()}, distance double"

    def compared(pairs: DataFrame) -> DataFrame:
        """The nearest point of its tile for each of (__t, coordinates, __tile); its rows are distinct."""
        # A row for each tile with targets.
        chunks = F.broadcast(pairs.groupBy("__tile").agg(F.ceil(F.count(F.lit(1)) / CHUNK_TARGETS).alias("__n")))
        looking = pairs.join(chunks, "__tile").withColumn("__chunk", F.pmod(F.xxhash64("__t", *names), F.col("__n"))).drop("__n")
        there = tiled.join(chunks, "__tile").withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__n") - 1))).drop("__n")
        return there.groupBy("__tile", "__chunk").cogroup(looking.groupBy("__tile", "__chunk")).applyInArrow(compare, schema)

    own = targets.where(whole).select(F.col(target_id).alias("__t"), *places).distinct()
    first = kept(compared(kept(own.withColumn("__tile", tile_of(*names)))))
    more = first.select("__t", *names, F.explode(tiles_within(*names, "distance", "__tile")).alias("__tile"))
    found = first.unionByName(compared(more)).select(F.col("__t").alias(target_id), F.col("__p").alias(point_id), "distance")
    least = F.min(F.when(F.col("distance").isNotNull(), F.struct("distance", point_id))).alias("best")
    return found.unionByName(targets.where(~whole).select(target_id, *none)).groupBy(target_id).agg(least).select(target_id, f"best.{point_id}", "best.distance")
