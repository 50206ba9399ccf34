"""Element-wise functions against NumPy, at signs, zeros, infinities and the ends of precision."""

import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubeweave.functions import math as M
from cubeweave.operators import align as A

INF = float("inf")
VALUES = [0.0, -0.0, 1.0, -1.0, 0.5, -0.5, 2.5, -2.5, 3.0, 4.0, 0.1, 1e19, -1e19, 1e300, -1e300, 2.0**52 + 1, 1.7976931348623157e308, 5e-324, 2.2250738585072014e-308, INF, -INF, 1 - 2**-53, 1 + 2**-52, 8.0 - 2**-50]
UNARY = ["ceil", "floor", "trunc", "signbit", "spacing", "rint"]
BINARY = ["divide", "floor_divide", "copysign", "nextafter", "logaddexp", "fmod"]


def same(got, want):
    if isinstance(want, (bool, np.bool_)):
        return got == bool(want)
    if math.isnan(want):
        return got is None or math.isnan(got)
    return got == pytest.approx(float(want), rel=1e-14, abs=0) if math.isfinite(want) else got == want


def test_unary(spark):
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(VALUES)], "k int, x double")
    rows = sorted(frame.select("k", *[M.UNARY[n](F.col("x")).alias(n) for n in UNARY]).collect())
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for r in rows:
            for n in UNARY:
                assert same(r[n], getattr(np, n)(np.float64(VALUES[r["k"]]))), (n, VALUES[r["k"]], r[n])


def test_binary(spark):
    pairs = [(a, b) for a in VALUES for b in VALUES]
    frame = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a double, b double")
    rows = sorted(frame.select("k", *[M.BINARY[n](F.col("a"), F.col("b")).alias(n) for n in BINARY]).collect())
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for r in rows:
            a, b = (np.float64(x) for x in pairs[r["k"]])
            for n in BINARY:
                if n in ("floor_divide", "fmod") and (np.isinf(a) or np.isinf(b) or b == 0 or abs(a / b) > 2.0**52 or n == "floor_divide" and abs(a / b) < 1e-15):
                    continue  # quotients beyond a double's precision
                assert same(r[n], getattr(np, n)(a, b)), (n, a, b, r[n])


def test_remainders_of_whole_numbers_are_exact(spark):
    rows = [(9007199254740993, 10), (-7, 3), (7, -3), (-9, 3), (5, 0)]
    got = [r[0] for r in spark.createDataFrame(rows, "a long, b long").select(M.mod(F.col("a"), F.col("b"))).collect()]
    assert got == [3, 2, -2, 0, None]
    assert spark.range(1).select(M.floordiv(F.lit(1.0), F.lit(0.0))).first()[0] == INF


def test_nearest_points_ends(spark):
    targets = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0)], "target int, x double, y double")
    points = spark.createDataFrame([(7, 9.0, 0.0), (8, None, 0.0)], "point int, x double, y double")
    got = {r["target"]: (r["point"], r["distance"]) for r in A.nearest_points(points, targets, ["x", "y"], 1.0).collect()}
    assert got == {1: (7, 9.0), 2: (None, None)}
    none = A.nearest_points(points.limit(0), targets, ["x", "y"], 1.0).collect()
    assert {(r["target"], r["point"]) for r in none} == {(1, None), (2, None)}


def test_nearest_points_compares_with_few_points_however_dense(spark, monkeypatch):
    from cubeweave.operators import nearest

    r = np.random.default_rng(3)
    # A cluster far tighter than a cell, points far apart, one vertical line, and repeats.
    at = np.vstack([r.normal(0, 1e-5, (700, 2)), r.normal(0, 50, (100, 2)), np.column_stack([np.full(100, 3.0), r.normal(0, 1, 100)])])
    at = np.vstack([at, at[:50]])
    look = np.vstack([r.normal(0, 1e-5, (300, 2)), r.normal(0, 60, (100, 2)), [[0.0, 1e6], [3.0, 0.0]], np.repeat(at[:1], 60, axis=0)])
    points = spark.createDataFrame([(int(k), float(x), float(y)) for k, (x, y) in enumerate(at)], "point long, x double, y double")
    targets = spark.createDataFrame([(int(k), float(x), float(y)) for k, (x, y) in enumerate(look)], "target long, x double, y double")
    monkeypatch.setattr(nearest, "TILE_POINTS", 16)
    monkeypatch.setattr(nearest, "CHUNK_TARGETS", 16)
    got = {row["target"]: (row["point"], row["distance"]) for row in A.nearest_points(points, targets, ["x", "y"], 1.0).collect()}
    all_ = np.sqrt((look[:, None, 0] - at[None, :, 0]) ** 2 + (look[:, None, 1] - at[None, :, 1]) ** 2)
    assert got == {k: (int(d.argmin()), float(d.min())) for k, d in enumerate(all_)}
    tiles = nearest.Tiles(np.arange(16), *[np.array([(i + z, j + z) for i in range(4) for j in range(4)], float) for z in (0, 0.9)], 4)
    row, tile = tiles.within(np.array([[1.5, 1.5], [9.0, 0.0]]), np.array([0.55, 1.0]))
    assert sorted(zip(row.tolist(), tile.tolist())) == [(0, 5), (0, 6), (0, 9)]
    assert tiles.own(np.array([[1.5, 2.5], [9.0, -1.0]])).tolist() == [6, 12]
