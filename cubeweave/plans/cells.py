"""Queries of selection, projection, element-wise functions, alignment, joins and set operations."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from cubeweave.cube import Cube
from cubeweave.functions import math as M
from cubeweave.operators import align as A
from cubeweave.operators import select as S
from cubeweave.plans import query
from cubeweave.plans import cubes as C
from cubeweave.plans.cubes import DAILY, NATION, rounded


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 1000 AND 5000")
def sel_label_slice(spark, sf):
    return S.sel(C.orders(spark, sf)["o_totalprice"], o_orderkey=slice(1000, 5000)).frame


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 7, 33, 101, 999)")
def sel_points(spark, sf):
    return S.sel(C.orders(spark, sf)["o_totalprice"], o_orderkey=[1, 7, 33, 101, 999]).frame


@query(f"WITH {NATION} SELECT segment, round(bal, 4) AS bal FROM ns WHERE nation = (SELECT min(nation) FROM ns)")
def sel_scalar_drops_dim(spark, sf):
    c = C.nation_segment(spark, sf)
    return rounded(S.isel(c, nation=0, drop=True).frame.select("segment", "bal"))


@query("WITH k AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders) SELECT o_orderkey, o_totalprice FROM k WHERE pos >= 10 AND pos < 200 AND (pos - 10) % 7 = 0")
def isel_step(spark, sf):
    return S.isel(C.orders(spark, sf)["o_totalprice"], o_orderkey=slice(10, 200, 7)).frame


@query("WITH k AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders) SELECT o_orderkey, o_totalprice FROM k WHERE pos IN (5, 3, 250, (SELECT count(*) - 1 FROM orders))")
def isel_list_negative(spark, sf):
    return S.isel(C.orders(spark, sf)["o_totalprice"], o_orderkey=[5, 3, 250, -1]).frame


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25")
def head_positions(spark, sf):
    return S.head(C.orders(spark, sf)["o_totalprice"], o_orderkey=25).frame


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 25")
def tail_positions(spark, sf):
    return S.tail(C.orders(spark, sf)["o_totalprice"], o_orderkey=25).frame


@query("WITH k AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders) SELECT o_orderkey, o_totalprice FROM k WHERE pos % 11 = 0")
def thin_positions(spark, sf):
    return S.thin(C.orders(spark, sf)["o_totalprice"], o_orderkey=11).frame


@query("WITH k AS (SELECT p_partkey, p_retailprice, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part) SELECT CAST(0 AS INTEGER) AS point, p_partkey, p_retailprice FROM k WHERE pos = 3 UNION ALL SELECT 1, p_partkey, p_retailprice FROM k WHERE pos = 17")
def isel_pointwise(spark, sf):
    points = spark.createDataFrame([(0, 3), (1, 17)], "point int, at long")
    return S.isel_points(C.part(spark, sf)["p_retailprice"], points, p_partkey="at").frame


@query("SELECT p_partkey, p_size FROM part WHERE p_size > 10 AND p_size <= 30 AND p_brand IN ('Brand#11', 'Brand#22', 'Brand#33')")
def query_string(spark, sf):
    return S.query(C.part(spark, sf), p_partkey="10 < p_size <= 30 and p_brand in ['Brand#11', 'Brand#22', 'Brand#33']")["p_size"].frame


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN p_retailprice ELSE -1.0 END AS p_retailprice FROM part")
def where_other(spark, sf):
    return S.where(C.part(spark, sf)[["p_retailprice", "p_size"]], F.col("p_size") > 25, -1.0)["p_retailprice"].frame


@query(f"WITH {NATION} SELECT nation, segment, round(CASE WHEN bal > 4800 THEN bal END, 4) AS bal FROM ns WHERE nation IN (SELECT nation FROM ns WHERE bal > 4800) AND segment IN (SELECT segment FROM ns WHERE bal > 4800)")
def where_drop(spark, sf):
    return rounded(S.where(C.nation_segment(spark, sf), F.col("bal") > 4800, drop=True).frame)


@query("SELECT p_partkey, coalesce(p_brand IN ('Brand#11', 'Brand#45'), false) AS p_brand FROM part")
def isin_values(spark, sf):
    return C.part(spark, sf)["p_brand"].isin(["Brand#11", "Brand#45"]).frame


@query("SELECT p_partkey, least(greatest(p_retailprice, 950.0), 1200.0) AS p_retailprice FROM part")
def clip_values(spark, sf):
    return C.part(spark, sf)["p_retailprice"].clip(950.0, 1200.0).frame


@query(f"WITH {C.GAPPY} SELECT day, status, quantity IS NULL AS quantity FROM gappy")
def isnull_cells(spark, sf):
    return C.gappy(spark, sf).isnull().frame


@query(f"WITH {C.GAPPY} SELECT day, status, coalesce(quantity, -5.0) AS quantity FROM gappy")
def fillna_scalar(spark, sf):
    return C.gappy(spark, sf).fillna(-5.0).frame


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (1, 2, 3)")
def drop_sel_labels(spark, sf):
    return S.drop_sel(Cube.from_spark(C.table(spark, sf, "nation").select("n_nationkey", "n_name"), ["n_nationkey"]), n_nationkey=[1, 2, 3]).frame


@query("WITH k AS (SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS pos FROM nation) SELECT n_nationkey, n_name FROM k WHERE pos NOT IN (0, 4)")
def drop_isel_positions(spark, sf):
    return S.drop_isel(Cube.from_spark(C.table(spark, sf, "nation").select("n_nationkey", "n_name"), ["n_nationkey"]), n_nationkey=[0, 4]).frame


@query(f"WITH {C.GAPPY}, k AS (SELECT day FROM gappy GROUP BY day HAVING count(quantity) >= 2) SELECT day, status, round(quantity, 4) AS quantity FROM gappy WHERE day IN (SELECT day FROM k)")
def dropna_thresh(spark, sf):
    return rounded(S.dropna(C.gappy(spark, sf), "day", thresh=2).frame)


@query("SELECT p_size, p_partkey FROM (SELECT p_size, p_partkey, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS k FROM part) WHERE k = 1")
def drop_duplicates_first(spark, sf):
    return S.drop_duplicates(C.table(spark, sf, "part").select("p_size", "p_partkey"), "p_size", "p_partkey", "first")


@query("SELECT o_orderdate, o_orderkey FROM (SELECT o_orderdate, o_orderkey, count(*) OVER (PARTITION BY o_orderdate) AS n FROM orders) WHERE n = 1")
def drop_duplicates_none(spark, sf):
    return S.drop_duplicates(C.table(spark, sf, "orders").select("o_orderdate", "o_orderkey"), "o_orderdate", "o_orderkey", False)


@query("SELECT p_partkey, CASE WHEN p_size < 5 THEN 0.0 ELSE p_retailprice END AS p_retailprice FROM part")
def masked_assignment(spark, sf):
    return S.set_where(C.part(spark, sf), F.col("p_size") < 5, {"p_retailprice": 0.0})["p_retailprice"].frame


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1996-04-01'")
def sel_partial_date(spark, sf):
    c = C.orders(spark, sf)
    keyed = Cube(c.frame.select("o_orderdate", "o_orderkey"), ("o_orderdate",), ("o_orderkey",))
    return S.partial_date(keyed, "o_orderdate", "1996-03").frame


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_join_keys(spark, sf):
    c = Cube(C.table(spark, sf, "customer").select("c_custkey", "c_acctbal"), ("c_custkey",), ("c_acctbal",))
    return S.semi(c, C.table(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))).frame


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join_keys(spark, sf):
    c = Cube(C.table(spark, sf, "customer").select("c_custkey", "c_acctbal"), ("c_custkey",), ("c_acctbal",))
    return S.anti(c, C.table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))).frame


# -- projection --------------------------------------------------------------
@query("SELECT p_partkey, p_retailprice, p_retailprice * 2 + p_size AS score FROM part")
def eval_expression(spark, sf):
    return C.part(spark, sf).eval("score = p_retailprice * 2 + p_size")[["p_retailprice", "score"]].frame


@query("SELECT p_partkey AS part, p_retailprice AS price FROM part")
def rename_vars_dims(spark, sf):
    return C.part(spark, sf)["p_retailprice"].rename(p_partkey="part", p_retailprice="price").frame


@query("SELECT o_orderkey, CAST(o_totalprice AS BIGINT) AS whole FROM (SELECT o_orderkey, floor(o_totalprice) AS o_totalprice FROM orders)")
def astype_cast(spark, sf):
    return C.orders(spark, sf)["o_totalprice"].map(F.floor).astype("bigint").rename(o_totalprice="whole").frame


@query("SELECT p_brand, p_retailprice, p_partkey FROM part")
def swap_dims_coord(spark, sf):
    c = C.part(spark, sf)
    c = Cube(c.frame.select("p_partkey", "p_retailprice", "p_brand"), ("p_partkey",), ("p_retailprice",), {"p_brand": ("p_partkey",)})
    return c.swap_dims("p_partkey", "p_brand").frame


@query(f"WITH {DAILY} SELECT 'revenue' AS variable, day, status, round(revenue, 4) AS value FROM daily UNION ALL SELECT 'quantity', day, status, round(quantity, 4) FROM daily")
def to_dataarray_stack(spark, sf):
    return rounded(C.daily(spark, sf).to_dataarray().frame)


@query(f"WITH {DAILY} SELECT day, round(max(CASE WHEN status = 'F' THEN quantity END), 4) AS \"F\", round(max(CASE WHEN status = 'O' THEN quantity END), 4) AS \"O\" FROM daily GROUP BY day")
def to_dataset_pivot(spark, sf):
    return rounded(C.daily(spark, sf)["quantity"].to_dataset("status", ["F", "O"]).frame)


@query("SELECT x AS scenario, n_nationkey, n_regionkey FROM nation, (VALUES ('a'), ('b')) t(x)")
def expand_dims_labels(spark, sf):
    return Cube.from_spark(C.table(spark, sf, "nation").select("n_nationkey", "n_regionkey"), ["n_nationkey"]).expand_dims("scenario", ["a", "b"]).frame


@query(f"WITH {NATION} SELECT n.nation, s.segment, round(bal, 4) AS bal FROM (SELECT DISTINCT nation FROM ns) n CROSS JOIN (SELECT DISTINCT segment FROM ns) s LEFT JOIN ns USING (nation, segment)")
def densify_dataframe(spark, sf):
    return rounded(C.nation_segment(spark, sf).densify().frame)


# -- element-wise --------------------------------------------------------------
_UNARY = ["abs", "arcsin", "arctan", "cbrt", "ceil", "cos", "cosh", "degrees", "exp", "exp2", "expm1", "floor", "isfinite", "isinf", "isnan", "log", "log10", "log1p", "log2", "negative", "radians", "reciprocal", "rint", "sign", "signbit", "sin", "sinh", "sqrt", "square", "tan", "tanh", "trunc"]
_UNARY_SQL = {
    "abs": "abs(x)", "arcsin": "asin(x)", "arctan": "atan(x)", "cbrt": "cbrt(x)", "ceil": "ceil(x)", "cos": "cos(x)", "cosh": "cosh(x)", "degrees": "degrees(x)", "exp": "exp(x)",
    "exp2": "pow(2, x)", "expm1": "exp(x) - 1", "floor": "floor(x)", "isfinite": "isfinite(x)", "isinf": "isinf(x)", "isnan": "isnan(x)", "log": "ln(x)", "log10": "log10(x)",
    "log1p": "ln(1 + x)", "log2": "log2(x)", "negative": "-x", "radians": "radians(x)", "reciprocal": "1 / x", "rint": "CAST(round_even(x, 0) AS DOUBLE)", "sign": "CAST(sign(x) AS DOUBLE)",
    "signbit": "x < 0", "sin": "sin(x)", "sinh": "sinh(x)", "sqrt": "sqrt(x)", "square": "x * x", "tan": "tan(x)", "tanh": "tanh(x)", "trunc": "trunc(x)",
}
_BOOL = {"isfinite", "isinf", "isnan", "signbit"}


@query("SELECT p_partkey, " + ", ".join(f"{_UNARY_SQL[u]} AS f_{u}" if u in _BOOL else f"round({_UNARY_SQL[u]}, 6) AS f_{u}" for u in _UNARY) + " FROM (SELECT p_partkey, p_size / 60.0::DOUBLE AS x FROM part)")
def ufuncs_unary(spark, sf):
    frame = C.table(spark, sf, "part").select("p_partkey", (F.col("p_size") / F.lit(60.0)).alias("x"))
    return frame.select("p_partkey", *[M.UNARY[u](F.col("x")).alias(f"f_{u}") if u in _BOOL else F.round(M.UNARY[u](F.col("x")), 6).alias(f"f_{u}") for u in _UNARY])


_BINARY = ["add", "subtract", "multiply", "divide", "floor_divide", "mod", "fmod", "power", "arctan2", "hypot", "copysign", "maximum", "minimum", "fmax", "fmin", "heaviside", "ldexp", "logaddexp", "greater", "less_equal", "equal", "not_equal", "logical_and", "logical_xor"]
_BINARY_SQL = {
    "add": "x + y", "subtract": "x - y", "multiply": "x * y", "divide": "x / y", "floor_divide": "floor(x / y)", "mod": "x - y * floor(x / y)", "fmod": "x - y * trunc(x / y)", "power": "pow(x, y)",
    "arctan2": "atan2(x, y)", "hypot": "sqrt(x * x + y * y)", "copysign": "CASE WHEN y < 0 THEN -abs(x) ELSE abs(x) END", "maximum": "greatest(x, y)", "minimum": "least(x, y)",
    "fmax": "greatest(x, y)", "fmin": "least(x, y)", "heaviside": "CASE WHEN x < 0 THEN 0.0 WHEN x = 0 THEN y ELSE 1.0 END", "ldexp": "x * pow(2, y)", "logaddexp": "greatest(x, y) + ln(1 + exp(-abs(x - y)))",
    "greater": "x > y", "less_equal": "x <= y", "equal": "x = y", "not_equal": "x <> y", "logical_and": "(x <> 0) AND (y <> 0)", "logical_xor": "(x <> 0) <> (y <> 0)",
}
_BOOL2 = {"greater", "less_equal", "equal", "not_equal", "logical_and", "logical_xor"}


@query("SELECT p_partkey, " + ", ".join(f"{_BINARY_SQL[u]} AS f_{u}" if u in _BOOL2 else f"round({_BINARY_SQL[u]}, 4) AS f_{u}" for u in _BINARY) + " FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, CASE WHEN p_partkey % 2 = 0 THEN 3.5::DOUBLE ELSE -2.0::DOUBLE END AS y FROM part)")
def ufuncs_binary(spark, sf):
    y = F.when(F.col("p_partkey") % 2 == 0, F.lit(3.5)).otherwise(F.lit(-2.0))
    frame = C.table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), y.alias("y"))
    return frame.select("p_partkey", *[M.BINARY[u](F.col("x"), F.col("y")).alias(f"f_{u}") if u in _BOOL2 else F.round(M.BINARY[u](F.col("x"), F.col("y")), 4).alias(f"f_{u}") for u in _BINARY])


@query("SELECT p_partkey, p_size & 12 AS b_and, p_size | 12 AS b_or, xor(p_size, 12) AS b_xor, p_size << 2 AS b_left, p_size >> 1 AS b_right, ~p_size AS b_not, CAST(bit_count(p_size) AS INTEGER) AS b_count, CAST(gcd(p_size, 12) AS BIGINT) AS b_gcd, CAST(lcm(p_size, 12) AS BIGINT) AS b_lcm FROM part")
def ufuncs_bits(spark, sf):
    x, k = F.col("p_size"), F.lit(12)
    B = M.BINARY
    return C.table(spark, sf, "part").select(
        "p_partkey", B["bitwise_and"](x, k).alias("b_and"), B["bitwise_or"](x, k).alias("b_or"), B["bitwise_xor"](x, k).alias("b_xor"), B["left_shift"](x, F.lit(2)).alias("b_left"), B["right_shift"](x, F.lit(1)).alias("b_right"),
        M.UNARY["invert"](x).alias("b_not"), M.UNARY["bitwise_count"](x).alias("b_count"), B["gcd"](x, k).alias("b_gcd"), B["lcm"](x, k).alias("b_lcm"),
    )


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN CASE WHEN p_retailprice > 0 THEN 'Infinity'::DOUBLE END ELSE p_retailprice / (p_size % 3) END AS q FROM part")
def ieee_division(spark, sf):
    return C.table(spark, sf, "part").select("p_partkey", M.divide(F.col("p_retailprice"), F.col("p_size") % 3).alias("q"))


# -- alignment, joins, sets ------------------------------------------------------
# Two whole tables whose keys overlap in part: parts, and customers by twice their key.
_A = "a AS (SELECT p_partkey, p_retailprice AS v FROM part), b AS (SELECT c_custkey * 2 AS p_partkey, c_acctbal AS v FROM customer)"


def _two(spark, sf):
    a = Cube(C.table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("v")), ("p_partkey",), ("v",))
    b = Cube(C.table(spark, sf, "customer").select((F.col("c_custkey") * 2).alias("p_partkey"), F.col("c_acctbal").alias("v")), ("p_partkey",), ("v",))
    return a, b


@query(f"WITH {_A} SELECT p_partkey, a.v + b.v AS v FROM a JOIN b USING (p_partkey)")
def arith_inner(spark, sf):
    return A.binary(*_two(spark, sf), lambda x, y: x + y).frame


@query(f"WITH {_A} SELECT p_partkey, a.v - b.v AS v FROM a FULL JOIN b USING (p_partkey)")
def arith_outer(spark, sf):
    return A.binary(*_two(spark, sf), lambda x, y: x - y, "outer").frame


@query(f"WITH {_A} SELECT p_partkey, a.v * b.v AS v FROM a LEFT JOIN b USING (p_partkey)")
def arith_left(spark, sf):
    return A.binary(*_two(spark, sf), lambda x, y: x * y, "left").frame


@query(f"WITH {NATION}, m AS (SELECT segment, avg(bal) AS bal FROM ns GROUP BY segment) SELECT nation, segment, round(ns.bal - m.bal, 4) AS bal FROM ns JOIN m USING (segment)")
def arith_broadcast(spark, sf):
    from cubeweave.operators.reduce import reduce

    c = C.nation_segment(spark, sf)
    return rounded(A.binary(c, reduce(c, "mean", "nation"), lambda x, y: x - y).frame)


@query(f"WITH {_A} SELECT p_partkey, v FROM a WHERE p_partkey IN (SELECT p_partkey FROM b)")
def align_inner(spark, sf):
    return A.align(*_two(spark, sf), join="inner")[0].frame


@query(f"WITH {_A} SELECT p_partkey, coalesce(v, 0.0) AS v FROM (SELECT p_partkey FROM a UNION SELECT p_partkey FROM b) LEFT JOIN a USING (p_partkey)")
def align_outer_fill(spark, sf):
    return A.align(*_two(spark, sf), join="outer", fill_value=0.0)[0].frame


@query(f"WITH {_A} SELECT p_partkey, v FROM b WHERE p_partkey IN (SELECT p_partkey FROM a)")
def align_left(spark, sf):
    return A.align(*_two(spark, sf), join="left")[1].frame


@query("SELECT k AS p_partkey, p_retailprice FROM (VALUES (3), (5), (999999), (7)) t(k) LEFT JOIN part ON k = p_partkey")
def reindex_missing(spark, sf):
    return A.reindex(C.part(spark, sf)["p_retailprice"], p_partkey=[3, 5, 999999, 7]).frame


@query(f"WITH {_A} SELECT p_partkey, coalesce(a.v, -1.0) AS v FROM b LEFT JOIN a USING (p_partkey)")
def reindex_like_fill(spark, sf):
    a, b = _two(spark, sf)
    return A.reindex_like(a, b, fill_value=-1.0).frame


# All events look for a neighbour among all events, seven minutes after their own time.
_T = "t AS (SELECT ts + INTERVAL 7 MINUTE AS k FROM events), s AS (SELECT DISTINCT ts AS k FROM events)"


def _later(name):
    return F.col(name) + F.expr("INTERVAL '7' MINUTE")


def _asof(spark, sf, method, tolerance=None):
    e = C.table(spark, sf, "events")
    return A.asof(e.select(_later("ts").alias("k")), e.select(F.col("ts").alias("k")), "k", method, tolerance).withColumnRenamed("__found", "found")


@query(f"WITH {_T} SELECT t.k, s.k AS found FROM t ASOF LEFT JOIN s ON t.k >= s.k")
def asof_pad(spark, sf):
    return _asof(spark, sf, "pad")


@query(f"WITH {_T} SELECT t.k, s.k AS found FROM t ASOF LEFT JOIN s ON t.k <= s.k")
def asof_backfill(spark, sf):
    return _asof(spark, sf, "backfill")


@query(f"WITH {_T}, l AS (SELECT t.k, s.k AS lo FROM t ASOF LEFT JOIN s ON t.k >= s.k), n AS (SELECT l.k, l.lo, s.k AS hi FROM l ASOF LEFT JOIN s ON l.k <= s.k), f AS (SELECT k, CASE WHEN lo IS NOT NULL AND (hi IS NULL OR date_diff('microsecond', lo, k) < date_diff('microsecond', k, hi)) THEN lo ELSE hi END AS found FROM n) SELECT k, CASE WHEN abs(date_diff('microsecond', found, k)) <= 600000000 THEN found END AS found FROM f")
def asof_nearest_tolerance(spark, sf):
    from datetime import timedelta

    return _asof(spark, sf, "nearest", timedelta(minutes=10))


@query("WITH t AS (SELECT user_id, ts + INTERVAL 7 MINUTE AS ts FROM events), s AS (SELECT DISTINCT user_id, ts FROM events) SELECT t.user_id, t.ts, s.ts AS found FROM t ASOF LEFT JOIN s ON t.user_id = s.user_id AND t.ts >= s.ts")
def asof_by_key(spark, sf):
    e = C.table(spark, sf, "events")
    return A.asof(e.select("user_id", _later("ts").alias("ts")), e.select("user_id", "ts"), "ts", "pad", by=["user_id"]).withColumnRenamed("__found", "found")


@query("WITH d AS (SELECT o_orderdate, count(*) AS n FROM orders GROUP BY 1) SELECT TIMESTAMP '1996-02-03 05:00:00' AS o_orderdate, n FROM d WHERE o_orderdate >= TIMESTAMP '1996-02-03 05:00:00' ORDER BY d.o_orderdate LIMIT 1")
def sel_method_backfill(spark, sf):
    c = Cube(C.table(spark, sf, "orders").groupBy("o_orderdate").agg(F.count(F.lit(1)).alias("n")), ("o_orderdate",), ("n",))
    return S.sel(c, method="backfill", o_orderdate=[datetime(1996, 2, 3, 5)]).frame


@query(f"WITH {_A} SELECT p_partkey, a.v AS v, b.v AS w FROM a FULL JOIN b USING (p_partkey)")
def merge_outer(spark, sf):
    a, b = _two(spark, sf)
    return A.merge(a, b.rename(v="w")).frame


@query(f"WITH {_A} SELECT p_partkey, coalesce(a.v, b.v) AS v FROM a FULL JOIN b USING (p_partkey)")
def combine_first_cells(spark, sf):
    return A.combine_first(*_two(spark, sf)).frame


@query(f"WITH {_A} SELECT p_partkey, a.v AS v, b.v AS w FROM a LEFT JOIN b USING (p_partkey)")
def update_variables(spark, sf):
    a, b = _two(spark, sf)
    return A.update(a, b.rename(v="w")).frame


@query("SELECT p_partkey, p_size FROM part")
def concat_dim(spark, sf):
    c = C.part(spark, sf)["p_size"]
    return A.concat([S.sel(c, p_partkey=slice(None, 50)), S.sel(c, p_partkey=slice(51, None))], "p_partkey").frame


@query("SELECT 'low' AS run, n_nationkey, n_regionkey FROM nation WHERE n_nationkey < 13 UNION ALL SELECT 'high', n_nationkey, n_regionkey FROM nation WHERE n_nationkey >= 13")
def concat_new_dim(spark, sf):
    c = Cube.from_spark(C.table(spark, sf, "nation").select("n_nationkey", "n_regionkey"), ["n_nationkey"])
    return A.concat([S.sel(c, n_nationkey=slice(None, 12)), S.sel(c, n_nationkey=slice(13, None))], "run", ["low", "high"]).frame


@query("SELECT p_partkey, p_size FROM part")
def combine_by_coords_tiles(spark, sf):
    c = C.part(spark, sf)["p_size"]
    return A.combine_by_coords([S.sel(c, p_partkey=slice(61, None)), S.sel(c, p_partkey=slice(None, 30)), S.sel(c, p_partkey=slice(31, 60))], "p_partkey").frame


@query(f"WITH {_A} SELECT p_partkey FROM a UNION SELECT p_partkey FROM b")
def index_union(spark, sf):
    return A.joined_labels(_two(spark, sf), "p_partkey", "outer")


@query(f"WITH {_A} SELECT p_partkey FROM a INTERSECT SELECT p_partkey FROM b")
def index_intersection(spark, sf):
    return A.joined_labels(_two(spark, sf), "p_partkey", "inner")


@query("SELECT s.s_suppkey, n.n_nationkey FROM supplier s JOIN nation n ON s.s_acctbal < n.n_nationkey * 100")
def theta_join(spark, sf):
    s, n = C.table(spark, sf, "supplier"), C.table(spark, sf, "nation")
    return s.join(n, F.col("s_acctbal") < F.col("n_nationkey") * 100).select("s_suppkey", "n_nationkey")


@query("WITH s AS (SELECT CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), t AS (SELECT vec_id, CAST(embedding[3] AS DOUBLE) AS x, CAST(embedding[4] AS DOUBLE) AS y FROM embeddings) SELECT t.vec_id AS target, round(min(sqrt((t.x - s.x) * (t.x - s.x) + (t.y - s.y) * (t.y - s.y))), 6) AS distance FROM t, s GROUP BY 1")
def nearest_in_plane(spark, sf):
    """All vectors' third and fourth numbers look among all vectors' first two."""
    plane = lambda name, k: C.table(spark, sf, "embeddings").select(F.col("vec_id").alias(name), *[F.get("embedding", F.lit(k + j)).cast("double").alias(c) for j, c in enumerate("xy")])
    out = A.nearest_points(plane("point", 0), plane("target", 2), ["x", "y"], 0.25)
    return out.select("target", F.round("distance", 6).alias("distance"))
