"""Order across partitions: many rows, and every ordered operator cut into ranges and blocks as for long series."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from cubeweave import ranges
from cubeweave.cube import Cube
from cubeweave.functions import dates as D
from cubeweave.operators import align as A
from cubeweave.operators import fit as T
from cubeweave.operators import reduce as R
from cubeweave.operators import reshape as H
from cubeweave.operators import window as W

ROWS = 3_000_000


@pytest.fixture
def many_partitions(spark):
    keys = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture
def long_series(monkeypatch):
    """Nothing counts as small, and blocks are short."""
    monkeypatch.setattr(ranges, "SMALL_BYTES", 0)
    monkeypatch.setattr(ranges, "BLOCK_ROWS", 64)


def test_number_of_millions_of_rows(spark, many_partitions, tmp_path):
    frame = spark.range(ROWS).select((F.col("id") * 7919 % ROWS).alias("k"), F.concat(F.lit("payload "), F.col("id")).alias("a"), (F.col("id") * 1.5).alias("b"))
    path = str(tmp_path / "numbered")
    ranges.number(frame, [F.col("k")], "pos").write.parquet(path)
    back = spark.read.parquet(path)
    assert back.agg(F.count(F.lit(1)), F.countDistinct("pos"), F.max("pos"), F.sum((F.col("k") != F.col("pos")).cast("int"))).first() == (ROWS, ROWS, ROWS - 1, 0)


@pytest.mark.parametrize("by", [[], ["g"]])
def test_asof_of_millions_of_rows(spark, many_partitions, tmp_path, by):
    # Sources at multiples of 10, targets beside them; the answer is known by arithmetic.
    group = [F.lit("hot").alias("g")] * len(by)
    sources = spark.range(ROWS).select((F.col("id") * 10).alias("t"), *group)
    targets = spark.range(300_000).select((F.col("id") * 97 % (ROWS * 10) + 3).alias("t"), F.concat(F.lit("note "), F.col("id")).alias("note"), *group)
    path = str(tmp_path / "found")
    A.asof(targets, sources.withColumn("more", F.lit("x")), "t", "pad", by=by).write.parquet(path)
    back = spark.read.parquet(path)
    assert back.agg(F.count(F.lit(1)), F.sum((F.col("__found") != F.floor(F.col("t") / 10) * 10).cast("int")), F.count("__found")).first() == (300_000, 0, 300_000)


def test_asof_by_key_in_ranges_equals_one_window(spark, long_series, many_partitions):
    r = random.Random(4)
    sources = {(r.choice("abc"), r.randrange(2000)) for _ in range(300)}
    targets = [(r.choice("abcd"), r.randrange(-50, 2050), k) for k in range(400)]
    s = spark.createDataFrame(sorted(sources), "g string, t long")
    t = spark.createDataFrame(targets, "g string, t long, n long")
    for method in ("pad", "backfill", "nearest"):
        got = {x["n"]: x["__found"] for x in A.asof(t, s, "t", method, by=["g"]).collect()}
        assert len(got) == 400
        for g, at, n in targets:
            own = sorted(k for h, k in sources if h == g)
            low = own[bisect.bisect_right(own, at) - 1] if own and own[0] <= at else None
            high = own[bisect.bisect_left(own, at)] if own and own[-1] >= at else None
            near = low if high is None or (low is not None and at - low < high - at) else high
            assert got[n] == {"pad": low, "backfill": high, "nearest": near}[method]


def series(spark, keyed):
    r = random.Random(8)
    rows = []
    for g in ("a", "b") if keyed else ("a",):
        at = 0
        for _ in range(500):
            at += r.choice((1, 1, 2, 7))
            rows.append((at, g, None if r.random() < 0.35 else round(r.uniform(0.5, 1.5), 3), round(r.uniform(-5, 5), 2)))
    frame = spark.createDataFrame(rows, "t long, g string, v double, u double")
    return Cube.from_spark(frame, ["t", "g"] if keyed else ["t"], ["v", "u"])


OPERATORS = {
    "rolling_sum": lambda c: W.rolling(c, "t", 5, "sum", min_periods=2),
    "rolling_center_max": lambda c: W.rolling(c, "t", 6, "max", min_periods=1, center=True),
    "rolling_wider_than_a_block": lambda c: W.rolling(c, "t", 100, "mean", min_periods=3),
    "rolling_argmin": lambda c: W.rolling(c, "t", 4, "argmin", min_periods=1),
    "rolling_reduce": lambda c: W.rolling_reduce(c, "t", 3, lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x * 2 + F.coalesce(y, F.lit(1.0)))),
    "expanding_mean": lambda c: W.expanding(c, "t", "mean"),
    "expanding_min": lambda c: W.expanding(c, "t", "min"),
    "expanding_std": lambda c: W.expanding(c, "t", "std", min_periods=3),
    "expanding_count": lambda c: W.expanding(c, "t", "count"),
    "expanding_prod": lambda c: W.expanding(c, "t", "prod"),
    "cumsum": lambda c: R.cumulate(c, "cumsum", "t"),
    "cumprod": lambda c: R.cumulate(c["v"], "cumprod", "t"),
    "ffill": lambda c: W.ffill(c, "t"),
    "bfill_limit": lambda c: W.bfill(c, "t", limit=2),
    "rank": lambda c: W.rank(c, "t"),
    "rank_pct": lambda c: W.rank(c, "t", pct=True),
    "row_number": lambda c: W.ranking(c, "t", "row_number"),
    "ntile": lambda c: W.ranking(c, "t", "ntile:7"),
    "cume_dist": lambda c: W.ranking(c, "t", "cume_dist"),
    "percent_rank": lambda c: W.ranking(c, "t", "percent_rank"),
    "interpolate_na": lambda c: T.interpolate_na(c, "t"),
    "interpolate_na_limit": lambda c: T.interpolate_na(c, "t", limit=1, max_gap=9.0),
    "interp": lambda c: T.interp(c, "t", [0, 3, 17, 555, 900, 10_000]),
    "differentiate": lambda c: T.differentiate(c, "t"),
    "differentiate_second_edges": lambda c: T.differentiate(c, "t", edge_order=2),
    "integrate": lambda c: T.integrate(c, "t"),
    "cumulative_integrate": lambda c: T.cumulative_integrate(c, "t"),
    "coarsen": lambda c: W.coarsen(c, "t", 7, "mean", boundary="pad"),
    "shift": lambda c: W.shift(c, "t", 3),
}


def cells(cube):
    out = {}
    for x in cube.frame.collect():
        out[tuple(x[d] for d in cube.dims)] = tuple(x[n] for n in cube.names)
    return out


KEYED = ("rolling_sum", "expanding_std", "cumsum", "ffill", "rank_pct", "ntile", "interpolate_na", "interp", "differentiate", "cumulative_integrate")


@pytest.mark.parametrize("keyed", [False, True])
def test_blocks_agree_with_one_window(spark, monkeypatch, keyed):
    operators = {k: OPERATORS[k] for k in KEYED} if keyed else OPERATORS
    cube = series(spark, keyed)
    monkeypatch.setattr(ranges, "SMALL_BYTES", 1 << 62)
    want = {k: cells(f(cube)) for k, f in operators.items()}
    cube = series(spark, keyed)
    monkeypatch.setattr(ranges, "SMALL_BYTES", 0)
    monkeypatch.setattr(ranges, "BLOCK_ROWS", 64)
    for k, f in operators.items():
        out = f(cube)
        lines = out.frame._jdf.queryExecution().executedPlan().toString().split("\n")
        # What meets in one task is a row for each range or block, never the facts.
        assert all("Aggregate" in below for line, below in zip(lines, lines[1:]) if "Exchange SinglePartition" in line), k
        got = cells(out)
        assert got.keys() == want[k].keys(), k
        for at, values in want[k].items():
            for x, y in zip(got[at], values, strict=True):
                assert (x is None) == (y is None) and (y is None or x == pytest.approx(y, rel=1e-9, abs=1e-9, nan_ok=True)), (k, at)


@pytest.mark.parametrize("name", ["mean", "sum", "var", "cov", "corr"])
def test_exponential_windows_over_several_folds(spark, monkeypatch, name):
    monkeypatch.setattr(W, "FOLD_ROWS", 50)
    cube = series(spark, True)
    other = "u" if name in ("cov", "corr") else None
    for alpha in (0.03, 0.9):
        got = cells(W.rolling_exp(cube, "t", name, other, alpha=alpha))
        rows = sorted((tuple(x) for x in cube.frame.select("g", "t", "v", "u").collect()))
        for g in "ab":
            own = [(t, v, u if other else v) for h, t, v, u in rows if h == g]
            for k in (0, 1, 49, 50, 51, 260, 499):
                t, v, u = own[k]
                ws = [((1 - alpha) ** (k - j), a, b) for j, (_, a, b) in enumerate(own[: k + 1]) if a is not None and b is not None]
                if v is None or u is None:
                    assert got[(t, g)][0] is None
                    continue
                w, ww = sum(x[0] for x in ws), sum(x[0] ** 2 for x in ws)
                ma, mb = sum(x[0] * x[1] for x in ws) / w, sum(x[0] * x[2] for x in ws) / w
                cov = sum(x[0] * (x[1] - ma) * (x[2] - mb) for x in ws) / w
                va, vb = (sum(x[0] * (x[i] - m) ** 2 for x in ws) / w for i, m in ((1, ma), (2, mb)))
                fair = w * w / (w * w - ww) if len(ws) > 1 else None
                want = {"mean": ma, "sum": w * ma, "var": fair and cov * fair, "cov": fair and cov * fair, "corr": cov / (va * vb) ** 0.5 if fair else None}[name]
                if want is None:
                    continue
                assert got[(t, g)][0] == pytest.approx(want, rel=1e-6, abs=1e-9), (name, alpha, g, k)


def test_argsort_and_frequency_in_ranges(spark, long_series):
    frame = spark.range(900).select((F.col("id") * 7 % 900).alias("k"), F.col("id").alias("o"))
    assert all(x["place"] == x["k"] for x in H.argsort(frame, "k", "o").collect())
    axis = D.date_range(spark, "2020-01-01", "2023-06-01", "D", "time")
    assert D.infer_freq(axis, "time") == "D"
