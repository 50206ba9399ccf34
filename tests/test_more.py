"""User functions, Python's operators, options, accessors, assertions, formula indexes, windows by value, netCDF round trips."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cubeweave import options, ranges, sources, testing
from cubeweave.cube import AlignmentError, Cube
from cubeweave.functions import codecs
from cubeweave.indexes import RangeIndex, TransformIndex
from cubeweave.operators import align as A
from cubeweave.operators import apply as U
from cubeweave.operators import group as G
from cubeweave.operators import window as W


def cube(spark, rows, dims=("x",), names=("v",)):
    kinds = ", ".join([f"{d} long" for d in dims] + [f"{n} double" for n in names])
    return Cube(spark.createDataFrame(rows, kinds), tuple(dims), tuple(names))


def cells(c):
    return {tuple(r[d] for d in c.dims): r[c.names[0]] for r in c.frame.collect()}


def test_apply_along_a_core_dimension(spark):
    rows = [(g, k, float(g * 10 + k * k)) for g in range(3) for k in range(4 + g)]
    c = cube(spark, rows, ("g", "k"))
    want = {(g,): float(sum(v for a, _, v in rows if a == g)) for g in range(3)}
    assert cells(U.apply_ufunc(lambda x: x.sum(-1), c, core=["k"])) == want
    assert cells(U.apply_ufunc(lambda x: x.sum(), c, core=["k"], vectorize=True)) == want
    back = cells(U.apply_ufunc(lambda x: np.cumsum(x, -1), c, core=["k"], out_core="k"))
    assert back == {(g, k): float(sum(v for a, b, v in rows if a == g and b <= k)) for g, k, _ in rows}
    ends = cells(U.apply_ufunc(lambda x: x[:, [0, -1]], c, core=["k"], out_core="end"))
    assert ends[(1, 0)] == 10.0 and ends[(1, 1)] == 26.0 and len(ends) == 6


def test_apply_with_missing_empty_and_unknown(spark):
    c = cube(spark, [(1, 1, 2.0), (1, 2, None)], ("g", "k"))
    assert cells(U.apply_ufunc(lambda x: np.nansum(x, -1), c, core=["k"])) == {(1,): 2.0}
    none = c.with_frame(c.frame.where("g > 5"))
    assert cells(U.apply_ufunc(lambda x: x.sum(-1), none, core=["k"])) == {}
    assert cells(U.apply_ufunc(lambda x: x.sum(-1), none, core=["g", "k"])) == {}
    with pytest.raises(KeyError):
        U.apply_ufunc(lambda x: x, c, core=["nothing"])


def test_apply_joins(spark):
    a, b = cube(spark, [(1, 1.0), (2, 2.0)]), cube(spark, [(2, 10.0), (3, 20.0)])
    assert cells(U.apply_ufunc(lambda x, y: x + y, a, b)) == {(2,): 12.0}
    assert set(cells(U.apply_ufunc(lambda x, y: x.fillna(0) + y.fillna(0), a, b, join="outer"))) == {(1,), (2,), (3,)}
    with pytest.raises(AlignmentError):
        U.apply_ufunc(lambda x, y: x + y, a, b, join="exact")


def test_map_blocks_keeps_to_its_template(spark):
    c = cube(spark, [(k, float(k)) for k in range(10)])
    assert cells(U.map_blocks(lambda p: p.assign(v=p.v * 2), c))[(4,)] == 8.0
    with pytest.raises(Exception, match="template"):
        U.map_blocks(lambda p: p.assign(w=1.0), c).frame.collect()


def test_python_operators(spark):
    a, b = cube(spark, [(1, 6.0), (2, 8.0)]), cube(spark, [(1, 2.0), (3, 4.0)])
    assert cells(a + b) == {(1,): 8.0} and cells(a / b) == {(1,): 3.0}
    assert cells(10 - a) == {(1,): 4.0, (2,): 2.0} and cells(-a) == {(1,): -6.0, (2,): -8.0}
    assert cells((a > 6) | (a < 0)) == {(1,): False, (2,): True} and cells(~(a > 6)) == {(1,): True, (2,): False}
    with options.set_options(arithmetic_join="outer"):
        assert cells(a + b) == {(1,): 8.0, (2,): None, (3,): None}
    assert options.get_options()["arithmetic_join"] == "inner"
    with pytest.raises(ValueError):
        options.set_options(arithmetic_join="sideways")
    c = a
    c += a
    assert cells(c) == {(1,): 12.0, (2,): 16.0} and cells(a) == {(1,): 6.0, (2,): 8.0}
    with pytest.raises(AlignmentError):
        c += b


def test_accessors(spark):
    @options.register_accessor("counted")
    class Counted:
        def __init__(self, c):
            self.n = len(c.dims)

    c = cube(spark, [(1, 1.0)])
    assert c.counted.n == 1 and c.counted is c.counted
    del Cube.counted


def test_assertions(spark):
    a = cube(spark, [(1, 1.0), (2, None)])
    testing.assert_equal(a, cube(spark, [(2, None), (1, 1.0)]))
    testing.assert_allclose(a, cube(spark, [(1, 1.0 + 1e-9), (2, None)]))
    for other in ([(1, 1.1), (2, None)], [(1, 1.0)], [(1, 1.0), (2, 0.0)], [(1, 1.0), (2, None), (3, None)]):
        with pytest.raises(AssertionError):
            testing.assert_allclose(a, cube(spark, other))
    with pytest.raises(AssertionError):
        testing.assert_identical(a.assign_attrs(unit="m"), a)


def test_range_index(spark):
    index = RangeIndex.arange(1.0, 3.0, 0.25)
    assert [r[0] for r in index.frame(spark, "x").orderBy("pos").collect()] == np.arange(1.0, 3.0, 0.25).tolist()
    line = RangeIndex.linspace(0.0, 1.0, 11)
    assert np.allclose([r[0] for r in line.frame(spark, "x").orderBy("pos").collect()], np.linspace(0, 1, 11))
    near = spark.createDataFrame([(1.1,), (9.0,), (None,), (1.5,)], "x double").select("x", index.position(F.col("x"), "nearest").alias("n"), index.position(F.col("x")).alias("e"))
    assert {r.x: (r.n, r.e) for r in near.collect()} == {1.1: (0, None), 9.0: (7, None), None: (None, None), 1.5: (2, 2)}
    assert index[2:6:2].equals(RangeIndex(1.5, 0.5, 2)) and index[::-1].start == 2.75
    c = cube(spark, [(k, float(k)) for k in range(index.size)], ("p",))
    assert set(cells(index.select(c, "p", 1.5, 2.0))) == {(2,), (3,), (4,)}
    assert set(cells(index.to_cube(c, "p", "x"))) == {(x,) for x in np.arange(1.0, 3.0, 0.25)}
    assert RangeIndex.arange(3, 3).frame(spark, "x").count() == 0


def test_transform_index(spark):
    c = cube(spark, [(i, j, float(i * 10 + j)) for i in range(4) for j in range(4)], ("i", "j"))
    t = TransformIndex(("i", "j"), lambda i, j: {"x": i * 2.0 + 1, "y": j * 0.5}, lambda p: {"i": (p.x - 1) / 2, "j": p.y / 0.5})
    assert t.label(c).frame.where("i = 3 AND j = 2").select("x", "y").first() == (7.0, 1.0)
    found = t.nearest(c, spark.createDataFrame([(7.1, 1.1), (99.0, 0.0)], "x double, y double")).collect()
    assert {r.x: r.v for r in found} == {7.1: 32.0, 99.0: None}


@pytest.mark.parametrize("back,ahead", [(5, 0), (0, 3), (4, 4)])
def test_windows_by_value_against_a_loop(spark, back, ahead):
    r = random.Random(back)
    rows = [(g, x, float(r.randint(0, 9)) if r.random() > 0.2 else None) for g in range(2) for x in r.sample(range(-150, 150), 80)]
    got = cells(W.rolling_values(cube(spark, rows, ("g", "x")), "x", back, "sum", ahead=ahead))
    for g, x, _ in rows:
        near = [v for h, y, v in rows if h == g and x - back <= y <= x + ahead and v is not None]
        assert got[(g, x)] == (sum(near) if near else None)
    assert len(got) == len(rows)


def test_looking_ahead_is_linear_and_null_keys_find_nothing(spark):
    n = 60_000
    s = spark.range(n).select((F.col("id") * 10).alias("t"))
    t = spark.range(n).select((F.col("id") * 10 - 3).alias("t"))
    assert ranges.is_small(t)
    found = A.asof(t, s, "t", "backfill")
    assert found.where(F.col("__found") != F.col("t") + 3).isEmpty() and found.count() == n
    assert "UnboundedFollowing" not in found._jdf.queryExecution().toString().replace(" ", "").replace("unboundedfollowing$()", "UnboundedFollowing")
    null = A.asof(spark.createDataFrame([(None,), (5,)], "t long"), s, "t", "nearest").collect()
    assert {r.t: r["__found"] for r in null} == {None: None, 5: 10}


def test_netcdf_round_trip(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(hours=6 * k), float(j), None if (k, j) == (2, 1) else k + j / 10) for k in range(7) for j in range(3)]
    frame = spark.createDataFrame(rows, "time timestamp_ntz, y double, v double")
    c = Cube(frame, ("time", "y"), ("v",), {}, {"title": "made up"}, {"v": {"units": "m", "valid": 3.0}})
    assert sources.to_netcdf(c, str(tmp_path / "one.nc")) == 1
    back = codecs.decode_cf(sources.open_cube(spark, str(tmp_path / "one.nc")))
    assert back.attrs == {"title": "made up"} and back.var_attrs["v"] == {"units": "m", "valid": 3.0}
    testing.assert_equal(back, c)
    assert sources.to_netcdf(c, str(tmp_path / "many"), "time", 3) == 3
    parts = [str(p) for p in sorted((tmp_path / "many").iterdir())]
    assert len(parts) == 3 and all(p.endswith(".nc") for p in parts)
    testing.assert_equal(codecs.decode_cf(sources.open_many(spark, parts)), c)


def test_small_additions(spark, tmp_path):
    s = pd.Series([1.0, 2.0], index=pd.Index([3, 4], name="k"), name="v")
    c = Cube.from_series(spark, s)
    assert cells(c) == {(3,): 1.0, (4,): 2.0} and cells(c.copy({"v": F.col("v") * 2})) == {(3,): 2.0, (4,): 4.0}
    sources.to_parquet(c, str(tmp_path / "c.parquet"))
    assert cells(sources.load_variable(spark, str(tmp_path / "c.parquet"))) == cells(c)
    assert [(x, sorted(cells(w))) for x, w in W.rolling_windows(c, "k", 2)] == [(3, [(3,)]), (4, [(3,), (4,)])]
    day = Cube(spark.createDataFrame([(datetime(2024, 1, 1, h), float(h)) for h in (0, 5, 13)], "t timestamp_ntz, v double"), ("t",), ("v",))
    got = G.resample(day, "t", "12h").agg(span=F.max("v") - F.min("v"))
    assert [r.span for r in got.frame.orderBy("t").collect()] == [5.0, 0.0]
