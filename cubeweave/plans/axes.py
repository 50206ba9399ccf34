"""Queries along an ordered dimension: windows, shifts, fills, calculus, interpolation, fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from cubeweave.cube import Cube
from cubeweave.operators import fit as T
from cubeweave.operators import reduce as R
from cubeweave.operators import window as W
from cubeweave.plans import query
from cubeweave.plans import cubes as C
from cubeweave.plans.cubes import DAILY, GAPPY, rounded

_P = "PARTITION BY status ORDER BY day"


def _rolling(name: str, sql: str, window: int = 5, center: bool = False, min_periods: int | None = None):
    def run(spark, sf):
        return rounded(W.rolling(C.gappy(spark, sf), "day", window, name, min_periods, center).astype("double").frame, 3)

    run.__name__ = f"rolling_{name}" + "_center" * center + (f"_min{min_periods}" if min_periods else "")
    back, ahead = (window // 2, (window - 1) // 2) if center else (window - 1, 0)
    # Positions are those of the days that the cube has, over both statuses.
    frame = f"PARTITION BY status ORDER BY pos RANGE BETWEEN {back} PRECEDING AND {ahead} FOLLOWING"
    need = min_periods or window
    query(f"WITH {GAPPY}, p AS (SELECT *, dense_rank() OVER (ORDER BY day) - 1 AS pos FROM gappy) SELECT day, status, CASE WHEN count(quantity) OVER w >= {need} THEN CAST(round({sql} OVER w, 3) AS DOUBLE) END AS quantity FROM p WINDOW w AS ({frame})")(run)


for _n, _s, _more in (
    ("sum", "sum(quantity)", {}), ("mean", "avg(quantity)", {"center": True}), ("min", "min(quantity)", {"min_periods": 1}), ("max", "max(quantity)", {"min_periods": 2, "center": True}),
    ("std", "stddev_pop(quantity)", {"min_periods": 3}), ("median", "quantile_cont(quantity, 0.5)", {"min_periods": 1}), ("count", "count(quantity)", {"min_periods": 1}),
):
    _rolling(_n, _s, **_more)


@query(f"WITH {DAILY}, p AS (SELECT *, dense_rank() OVER (ORDER BY day) - 1 AS pos FROM daily), j AS (SELECT a.day, a.status, arg_max(b.pos - (a.pos - 6), (b.quantity, -b.pos)) AS quantity, count(*) AS n FROM p a JOIN p b ON a.status = b.status AND b.pos BETWEEN a.pos - 6 AND a.pos GROUP BY 1, 2) SELECT day, status, CAST(CASE WHEN n >= 7 THEN quantity END AS DOUBLE) AS quantity FROM j")
def rolling_argmax(spark, sf):
    return W.rolling(C.daily(spark, sf)["quantity"], "day", 7, "argmax").astype("double").frame


@query(f"WITH {DAILY} SELECT day, status, round(sum(quantity) OVER ({_P}), 2) AS quantity FROM daily")
def cumulative_sum_expanding(spark, sf):
    return rounded(W.expanding(C.daily(spark, sf)["quantity"], "day", "sum").frame, 2)


@query(f"WITH {GAPPY} SELECT day, status, round(sum(coalesce(quantity, 0)) OVER ({_P}), 2) AS quantity FROM gappy")
def cumsum_skipna(spark, sf):
    return rounded(R.cumulate(C.gappy(spark, sf), "cumsum", "day").frame, 2)


@query("SELECT n_nationkey, round(ln(product(1 + n_regionkey / 10.0::DOUBLE) OVER (ORDER BY n_nationkey ROWS UNBOUNDED PRECEDING)), 6) AS v FROM nation")
def cumprod_logged(spark, sf):
    c = Cube.from_spark(C.table(spark, sf, "nation").select("n_nationkey", (1 + F.col("n_regionkey") / F.lit(10.0)).alias("v")), ["n_nationkey"])
    return R.cumulate(c, "cumprod", "n_nationkey").frame.select("n_nationkey", F.round(F.ln("v"), 6).alias("v"))


@query(f"WITH {DAILY}, p AS (SELECT *, dense_rank() OVER (ORDER BY day) - 1 AS pos FROM daily), l AS (SELECT pos // 7 AS b, min(day) AS day FROM p GROUP BY 1 HAVING count(DISTINCT pos) = 7) SELECT l.day, status, round(avg(quantity), 4) AS quantity FROM p JOIN l ON pos // 7 = b GROUP BY 1, 2")
def coarsen_trim(spark, sf):
    return rounded(W.coarsen(C.daily(spark, sf)["quantity"], "day", 7, "mean", "trim").frame)


@query(f"WITH {DAILY}, p AS (SELECT *, dense_rank() OVER (ORDER BY day) - 1 AS pos FROM daily), l AS (SELECT pos // 10 AS b, min(day) AS day FROM p GROUP BY 1) SELECT l.day, status, round(max(quantity), 4) AS quantity FROM p JOIN l ON pos // 10 = b GROUP BY 1, 2")
def coarsen_pad(spark, sf):
    return rounded(W.coarsen(C.daily(spark, sf)["quantity"], "day", 10, "max", "pad").frame)


@query("WITH p AS (SELECT n_nationkey, n_regionkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS pos FROM nation) SELECT pos // 4 AS block, pos % 4 AS place, n_regionkey FROM p")
def coarsen_construct_blocks(spark, sf):
    c = Cube.from_spark(C.table(spark, sf, "nation").select("n_nationkey", "n_regionkey"), ["n_nationkey"])
    return W.coarsen_construct(c, "n_nationkey", 4, "block", "place").frame.select("block", "place", "n_regionkey")


_POS = "p AS (SELECT *, dense_rank() OVER (ORDER BY day) - 1 AS pos FROM daily)"


@query(f"WITH {DAILY}, {_POS} SELECT a.day, a.status, round(b.quantity, 4) AS quantity FROM p a LEFT JOIN p b ON a.status = b.status AND b.pos = a.pos - 3")
def shift_positions(spark, sf):
    return rounded(W.shift(C.daily(spark, sf)["quantity"], "day", 3).frame)


@query(f"WITH {DAILY}, {_POS}, n AS (SELECT count(DISTINCT day) AS n FROM daily) SELECT l.day, p.status, round(quantity, 4) AS quantity FROM p, n, (SELECT DISTINCT day, pos FROM p) l WHERE l.pos = (p.pos + 10) % n.n")
def roll_positions(spark, sf):
    return rounded(W.roll(C.daily(spark, sf)["quantity"], "day", 10).frame)


@query(f"WITH {DAILY}, {_POS} SELECT a.day, a.status, round(a.quantity - b.quantity, 4) AS quantity FROM p a JOIN p b ON a.status = b.status AND b.pos = a.pos - 1")
def diff_upper(spark, sf):
    return rounded(W.diff(C.daily(spark, sf)["quantity"], "day").frame)


@query(f"WITH {DAILY}, {_POS} SELECT a.day, a.status, round(b.quantity - a.quantity, 4) AS quantity FROM p a JOIN p b ON a.status = b.status AND b.pos = a.pos + 1")
def diff_lower(spark, sf):
    return rounded(W.diff(C.daily(spark, sf)["quantity"], "day", label="lower").frame)


@query(f"WITH {GAPPY} SELECT day, status, CASE WHEN quantity IS NOT NULL THEN round((rank() OVER (PARTITION BY status ORDER BY quantity NULLS LAST) + (count(*) OVER (PARTITION BY status, quantity) - 1) / 2.0::DOUBLE) / count(quantity) OVER (PARTITION BY status), 6) END AS quantity FROM gappy")
def rank_pct(spark, sf):
    return rounded(W.rank(C.gappy(spark, sf), "day", pct=True).frame, 6)


@query("SELECT p_partkey, p_brand, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS INTEGER) AS p_retailprice FROM part")
def ranking_dense(spark, sf):
    c = Cube(C.table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice"), ("p_partkey", "p_brand"), ("p_retailprice",))
    return W.ranking(c, "p_partkey", "dense_rank").frame


@query("SELECT p_partkey, p_brand, CAST(ntile(4) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS INTEGER) AS p_retailprice FROM part")
def ranking_ntile(spark, sf):
    c = Cube(C.table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice"), ("p_partkey", "p_brand"), ("p_retailprice",))
    return W.ranking(c, "p_partkey", "ntile:4").frame


@query(f"WITH {GAPPY} SELECT day, status, last_value(quantity IGNORE NULLS) OVER ({_P}) AS quantity FROM gappy")
def ffill_unlimited(spark, sf):
    return W.ffill(C.gappy(spark, sf), "day").frame


@query(f"WITH {GAPPY}, p AS (SELECT *, dense_rank() OVER (ORDER BY day) - 1 AS pos FROM gappy), f AS (SELECT day, status, pos, first_value(quantity IGNORE NULLS) OVER w AS q, first_value(CASE WHEN quantity IS NOT NULL THEN pos END IGNORE NULLS) OVER w AS found FROM p WINDOW w AS (PARTITION BY status ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT day, status, CASE WHEN found - pos <= 1 THEN q END AS quantity FROM f")
def bfill_limit(spark, sf):
    return W.bfill(C.gappy(spark, sf), "day", 1).frame


@query(f"WITH RECURSIVE {DAILY}, p AS (SELECT status, day, quantity, row_number() OVER (PARTITION BY status ORDER BY day) AS k FROM daily), r AS (SELECT status, day, k, quantity AS s, 1.0::DOUBLE AS w FROM p WHERE k = 1 UNION ALL SELECT p.status, p.day, p.k, r.s * 0.75::DOUBLE + p.quantity, r.w * 0.75::DOUBLE + 1 FROM r JOIN p ON p.status = r.status AND p.k = r.k + 1) SELECT day, status, round(s / w, 4) AS quantity FROM r")
def rolling_exp_mean(spark, sf):
    return rounded(W.rolling_exp(C.daily(spark, sf)["quantity"], "day", "mean", alpha=0.25).frame)


@query("WITH p AS (SELECT n_nationkey, CAST(n_regionkey AS DOUBLE) AS v, row_number() OVER (ORDER BY n_nationkey) - 1 AS pos FROM nation), t AS (SELECT n_nationkey, pos, CAST(unnest(range(0, 3)) AS INTEGER) AS win FROM p) SELECT t.n_nationkey, win, p.v FROM t LEFT JOIN p ON p.pos = t.pos - 2 + win")
def rolling_construct(spark, sf):
    c = Cube.from_spark(C.table(spark, sf, "nation").select("n_nationkey", F.col("n_regionkey").cast("double").alias("v")), ["n_nationkey"])
    return W.construct(c, "n_nationkey", 3, "win").frame


# -- calculus and interpolation --------------------------------------------------
@query("WITH p AS (SELECT s_suppkey, s_acctbal AS v FROM supplier), w AS (SELECT *, lag(v) OVER o AS v0, lag(s_suppkey) OVER o AS x0 FROM p WINDOW o AS (ORDER BY s_suppkey)) SELECT round(sum(coalesce((v + v0) / 2 * (s_suppkey - x0), 0)), 3) AS v FROM w")
def integrate_trapezoid(spark, sf):
    c = Cube.from_spark(C.table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("v")), ["s_suppkey"])
    return rounded(T.integrate(c, "s_suppkey").frame, 3)


@query("WITH p AS (SELECT s_suppkey, s_acctbal AS v FROM supplier), w AS (SELECT *, lag(v) OVER o AS v0, lag(s_suppkey) OVER o AS x0 FROM p WINDOW o AS (ORDER BY s_suppkey)) SELECT s_suppkey, round(sum(coalesce((v + v0) / 2 * (s_suppkey - x0), 0)) OVER (ORDER BY s_suppkey), 3) AS v FROM w")
def cumulative_integrate_trapezoid(spark, sf):
    c = Cube.from_spark(C.table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("v")), ["s_suppkey"])
    return rounded(T.cumulative_integrate(c, "s_suppkey").frame, 3)


@query("WITH p AS (SELECT s_suppkey * s_suppkey * 1.0::DOUBLE AS x, s_acctbal AS f FROM supplier), w AS (SELECT x, f, lag(f) OVER o AS a, lead(f) OVER o AS b, x - lag(x) OVER o AS hs, lead(x) OVER o - x AS hd FROM p WINDOW o AS (ORDER BY x)) SELECT x, round(CASE WHEN a IS NULL THEN (b - f) / hd WHEN b IS NULL THEN (f - a) / hs ELSE (hs * hs * b + (hd * hd - hs * hs) * f - hd * hd * a) / (hs * hd * (hd + hs)) END, 6) AS v FROM w")
def differentiate_uneven(spark, sf):
    c = Cube.from_spark(C.table(spark, sf, "supplier").select((F.col("s_suppkey") * F.col("s_suppkey")).cast("double").alias("x"), F.col("s_acctbal").alias("v")), ["x"])
    return rounded(T.differentiate(c, "x").frame, 6)


@query("SELECT o_orderpriority, degree, round(v, 6) AS v FROM (SELECT o_orderpriority, CAST(1 AS INTEGER) AS degree, regr_slope(o_totalprice, o_orderkey) AS v FROM orders GROUP BY 1 UNION ALL SELECT o_orderpriority, 0, regr_intercept(o_totalprice, o_orderkey) FROM orders GROUP BY 1)")
def polyfit_line(spark, sf):
    c = Cube(C.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.col("o_totalprice").alias("v")), ("o_orderkey", "o_orderpriority"), ("v",))
    return rounded(T.polyfit(c, "o_orderkey", 1).frame, 6)


@query("SELECT CAST(2 - i AS INTEGER) AS degree, [3.0, -2.0, 0.5][i + 1]::DOUBLE AS v FROM range(0, 3) t(i)")
def polyfit_quadratic(spark, sf):
    x = F.col("n_nationkey").cast("double")
    c = Cube.from_spark(C.table(spark, sf, "nation").select("n_nationkey", (3 * x * x - 2 * x + 0.5).alias("v")), ["n_nationkey"])
    return rounded(T.polyfit(c, "n_nationkey", 2).frame, 4)


@query("SELECT p_partkey, round(2.0 * p_size * p_size - 3.0 * p_size + 1.0, 4)::DOUBLE AS v FROM part")
def polyval_horner(spark, sf):
    return C.table(spark, sf, "part").select("p_partkey", F.round(T.polyval(F.col("p_size").cast("double"), [2.0, -3.0, 1.0]), 4).alias("v"))


@query(f"WITH {GAPPY}, x AS (SELECT *, epoch_us(day) / 1e6 AS x FROM gappy), b AS (SELECT day, status, quantity, x, last_value(CASE WHEN quantity IS NOT NULL THEN x END IGNORE NULLS) OVER p AS x0, last_value(quantity IGNORE NULLS) OVER p AS y0, first_value(CASE WHEN quantity IS NOT NULL THEN x END IGNORE NULLS) OVER f AS x1, first_value(quantity IGNORE NULLS) OVER f AS y1 FROM x WINDOW p AS (PARTITION BY status ORDER BY day ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY status ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT day, status, round(CASE WHEN quantity IS NOT NULL THEN quantity WHEN x1 - x0 <= 432000 THEN y0 + (y1 - y0) * (x - x0) / (x1 - x0) END, 4) AS quantity FROM b")
def interpolate_na_max_gap(spark, sf):
    return rounded(T.interpolate_na(C.gappy(spark, sf), "day", max_gap=432000).frame)


@query("WITH p AS (SELECT CAST(s_suppkey AS DOUBLE) AS x, s_acctbal AS y FROM supplier), t(x) AS (VALUES (1.5::DOUBLE), (2.25), (7.0), (9.75), (-3.0)), b AS (SELECT t.x, (SELECT max(p.x) FROM p WHERE p.x <= t.x) AS a, (SELECT min(p.x) FROM p WHERE p.x >= t.x) AS b FROM t) SELECT b.x AS x, round(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN l.y + CASE WHEN b = a THEN 0 ELSE (h.y - l.y) * (b.x - a) / (b - a) END END, 6) AS v FROM b LEFT JOIN p l ON l.x = a LEFT JOIN p h ON h.x = b")
def interp_linear(spark, sf):
    c = Cube.from_spark(C.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("double").alias("x"), F.col("s_acctbal").alias("v")), ["x"])
    return rounded(T.interp(c, "x", [1.5, 2.25, 7.0, 9.75, -3.0]).frame, 6)


@query("SELECT x, round(x * x * x - 2 * x, 6) AS v FROM (VALUES (1.5::DOUBLE), (2.25), (7.5), (19.75)) t(x)")
def interp_cubic(spark, sf):
    x = F.col("n_nationkey").cast("double")
    c = Cube.from_spark(C.table(spark, sf, "nation").select(x.alias("x"), (x * x * x - 2 * x).alias("v")), ["x"])
    return rounded(T.interp_smooth(c, "x", [1.5, 2.25, 7.5, 19.75], "cubic"), 6)


@query("SELECT 2.5::DOUBLE AS a, -0.1::DOUBLE AS b")
def curvefit_exponential(spark, sf):
    x = F.col("n_nationkey").cast("double")
    c = Cube.from_spark(C.table(spark, sf, "nation").select("n_nationkey", (2.5 * F.exp(-0.1 * x)).alias("v")), ["n_nationkey"])

    def model(t, a, b):
        import numpy as np

        return a * np.exp(b * t)

    return rounded(T.curvefit(c, "n_nationkey", model, {"a": 1.0, "b": -0.05}), 4)


