"""Queries of reductions, weights, pairs, grouping and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from cubeweave.cube import Cube
from cubeweave.operators import group as G
from cubeweave.operators import reduce as R
from cubeweave.operators import reshape as H
from cubeweave.plans import query
from cubeweave.plans import cubes as C
from cubeweave.plans.cubes import DAILY, NATION, rounded

_V = "l_extendedprice * (1 - l_discount)"


def _lines(spark, sf):
    frame = C.table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_shipdate", "l_suppkey", F.monotonically_increasing_id().alias("row"))
    return Cube(frame, ("row", "l_returnflag", "l_linestatus"), ("l_quantity", "l_extendedprice"))


def _by(spark, sf, name, **more):
    return rounded(R.reduce(_lines(spark, sf), name, "row", **more).frame, 3)


def _reducer(name: str, sql: str, **more):
    def run(spark, sf):
        return _by(spark, sf, name, **more)

    run.__name__ = f"reduce_{name}" + "".join(f"_{k}{v}" for k, v in more.items())
    query(f"SELECT l_returnflag, l_linestatus, {sql.replace('?', 'l_quantity')} AS l_quantity, {sql.replace('?', 'l_extendedprice')} AS l_extendedprice FROM lineitem GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY 1, 2"))(run)


for _name, _sql, _more in (
    ("count", "count(?)", {}), ("sum", "round(sum(?), 3)", {}), ("mean", "round(avg(?), 3)", {}), ("min", "min(?)", {}), ("max", "max(?)", {}), ("median", "round(quantile_cont(?, 0.5), 3)", {}),
    ("std", "round(stddev_pop(?), 3)", {}), ("var", "round(var_pop(?) * (count(*) / (count(*) - 1.0::DOUBLE)), 3)", {"ddof": 1}),
):
    _reducer(_name, _sql, **_more)


@query("SELECT o_orderpriority, bool_and(o_totalprice > 1000) AS every, bool_or(o_totalprice > 400000) AS some FROM orders GROUP BY 1")
def reduce_all_any(spark, sf):
    frame = C.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_totalprice") > 1000).alias("every"), (F.col("o_totalprice") > 400000).alias("some"))
    c = Cube(frame, ("o_orderkey", "o_orderpriority"), ("every", "some"))
    a, b = R.reduce(c["every"], "all", "o_orderkey").frame, R.reduce(c["some"], "any", "o_orderkey").frame
    return a.join(b, "o_orderpriority")


@query("SELECT p_brand, round(ln(product(1 + p_size / 100.0::DOUBLE)), 6) AS growth FROM part GROUP BY 1")
def reduce_prod(spark, sf):
    frame = C.table(spark, sf, "part").select("p_partkey", "p_brand", (1 + F.col("p_size") / F.lit(100.0)).alias("growth"))
    out = R.reduce(Cube(frame, ("p_partkey", "p_brand"), ("growth",)), "prod", "p_partkey").frame
    return out.select("p_brand", F.round(F.ln("growth"), 6).alias("growth"))


@query(f"WITH {C.GAPPY} SELECT status, CASE WHEN count(quantity) >= 2000 THEN round(sum(quantity), 2) END AS quantity FROM gappy GROUP BY 1")
def sum_min_count(spark, sf):
    return rounded(R.reduce(C.gappy(spark, sf), "sum", "day", min_count=2000).frame, 2)


@query(f"WITH {C.GAPPY} SELECT day, CASE WHEN count(quantity) = (SELECT count(DISTINCT status) FROM gappy) THEN round(avg(quantity), 4) END AS quantity FROM gappy GROUP BY 1")
def mean_skipna_false(spark, sf):
    return rounded(R.reduce(C.gappy(spark, sf), "mean", "status", skipna=False).frame)


@query("SELECT 0.1::DOUBLE AS quantile, p_brand, round(quantile_cont(p_retailprice, 0.1), 4) AS p_retailprice FROM part GROUP BY 2 UNION ALL SELECT 0.9::DOUBLE, p_brand, round(quantile_cont(p_retailprice, 0.9), 4) FROM part GROUP BY 2")
def quantile_vector(spark, sf):
    c = Cube(C.table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice"), ("p_partkey", "p_brand"), ("p_retailprice",))
    return rounded(R.quantile(c, [0.1, 0.9], "p_partkey").frame)


@query("WITH k AS (SELECT p_brand, p_retailprice AS v, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice) - 1 AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part) SELECT p_brand, max(CASE WHEN r = floor(0.3::DOUBLE * (n - 1)) THEN v END) AS p_retailprice FROM k GROUP BY 1")
def quantile_lower(spark, sf):
    c = Cube(C.table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice"), ("p_partkey", "p_brand"), ("p_retailprice",))
    return R.quantile(c, 0.3, "p_partkey", "lower").frame


@query(f"WITH {NATION} SELECT nation, arg_max(segment, (bal, segment)) AS bal FROM (SELECT nation, segment, bal FROM ns) GROUP BY 1")
def idxmax_label(spark, sf):
    return R.extreme(C.nation_segment(spark, sf), "segment", "max").frame


@query(f"WITH {NATION}, k AS (SELECT nation, bal, dense_rank() OVER (ORDER BY segment) - 1 AS pos FROM ns) SELECT nation, arg_min(pos, bal) AS bal FROM k GROUP BY 1")
def argmin_position(spark, sf):
    return R.extreme(C.nation_segment(spark, sf), "segment", "min", label=False).frame


_W = "w AS (SELECT l_partkey AS p_partkey, sum(l_quantity) AS w FROM lineitem GROUP BY 1), j AS (SELECT p_brand, p_retailprice AS x, w FROM part JOIN w USING (p_partkey))"


def _weighted(spark, sf, name, q=None):
    p = Cube(C.table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice"), ("p_partkey", "p_brand"), ("p_retailprice",))
    w = Cube(C.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("w")), ("p_partkey",), ("w",))
    return rounded(R.weighted(p, w, name, "p_partkey", q).frame, 3)


@query(f"WITH {_W} SELECT p_brand, round(sum(w * x) / sum(w), 3) AS p_retailprice FROM j GROUP BY 1")
def weighted_mean(spark, sf):
    return _weighted(spark, sf, "mean")


@query(f"WITH {_W} SELECT p_brand, round(sum(w * x), 3) AS p_retailprice FROM j GROUP BY 1")
def weighted_sum(spark, sf):
    return _weighted(spark, sf, "sum")


@query(f"WITH {_W} SELECT p_brand, round(sum(w), 3) AS p_retailprice FROM j GROUP BY 1")
def weighted_sum_of_weights(spark, sf):
    return _weighted(spark, sf, "sum_of_weights")


@query(f"WITH {_W} SELECT p_brand, round((sum(w * x * x) - sum(w * x) * sum(w * x) / sum(w)) / sum(w), 3) AS p_retailprice FROM j GROUP BY 1")
def weighted_var(spark, sf):
    return _weighted(spark, sf, "var")


@query(f"WITH {_W} SELECT p_brand, round(sqrt((sum(w * x * x) - sum(w * x) * sum(w * x) / sum(w)) / sum(w)), 3) AS p_retailprice FROM j GROUP BY 1")
def weighted_std(spark, sf):
    return _weighted(spark, sf, "std")


@query(
    f"WITH {_W}, t AS (SELECT p_brand, x, w, sum(w) OVER (PARTITION BY p_brand) AS tw, sum(w * w) OVER (PARTITION BY p_brand) AS sw, sum(w) OVER (PARTITION BY p_brand ORDER BY x ROWS UNBOUNDED PRECEDING) AS cw FROM j), "
    "u AS (SELECT p_brand, x, tw * tw / sw AS n, cw / tw AS b, (cw - w) / tw AS a FROM t), h AS (SELECT *, n * 0.25::DOUBLE - 0.25::DOUBLE + 1 AS h FROM u), "
    "s AS (SELECT p_brand, x, n * (greatest((h - 1) / n, least(h / n, b)) - greatest((h - 1) / n, least(h / n, a))) AS share FROM h) SELECT p_brand, round(sum(share * x), 3) AS p_retailprice FROM s GROUP BY 1"
)
def weighted_quantile(spark, sf):
    return _weighted(spark, sf, "quantile", 0.25)


def _pairs(spark, sf):
    c = C.daily(spark, sf)
    return c["revenue"], c["quantity"]


@query(f"WITH {DAILY} SELECT status, round(covar_samp(revenue, quantity), 2) AS cov FROM daily GROUP BY 1")
def cov_pair(spark, sf):
    return rounded(R.pair(*_pairs(spark, sf), "cov", "day").frame, 2)


@query(f"WITH {DAILY} SELECT status, round(corr(revenue, quantity), 6) AS corr FROM daily GROUP BY 1")
def corr_pair(spark, sf):
    return rounded(R.pair(*_pairs(spark, sf), "corr", "day").frame, 6)


@query("WITH e AS (SELECT vec_id, unnest(range(0, 64)) AS k, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), q AS (SELECT k, x FROM e WHERE vec_id = 0) SELECT vec_id, round(sum(e.x * q.x), 5) AS dot FROM e JOIN q USING (k) GROUP BY 1")
def dot_product(spark, sf):
    e = C.table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "x")).withColumn("x", F.col("x").cast("double"))
    a = Cube(e, ("vec_id", "k"), ("x",))
    b = Cube(e.where("vec_id = 0").select("k", "x"), ("k",), ("x",))
    return rounded(R.dot(a, b).frame, 5)


@query("WITH e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) a0, CAST(embedding[2] AS DOUBLE) a1, CAST(embedding[3] AS DOUBLE) a2, CAST(embedding[4] AS DOUBLE) b0, CAST(embedding[5] AS DOUBLE) b1, CAST(embedding[6] AS DOUBLE) b2 FROM embeddings) SELECT vec_id, CAST(0 AS INTEGER) AS axis, round(a1 * b2 - a2 * b1, 6) AS \"cross\" FROM e UNION ALL SELECT vec_id, 1, round(a2 * b0 - a0 * b2, 6) FROM e UNION ALL SELECT vec_id, 2, round(a0 * b1 - a1 * b0, 6) FROM e")
def cross_product(spark, sf):
    e = C.table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "x")).withColumn("x", F.col("x").cast("double"))
    a = Cube(e.where("k < 3").withColumnRenamed("k", "axis"), ("vec_id", "axis"), ("x",))
    b = Cube(e.where("k >= 3 AND k < 6").select("vec_id", (F.col("k") - 3).alias("axis"), "x"), ("vec_id", "axis"), ("x",))
    return rounded(R.cross(a, b, "axis", [0, 1, 2]).frame, 6)


# -- grouping ----------------------------------------------------------------
@query("SELECT l_suppkey, round(sum(l_quantity), 2) AS l_quantity, round(sum(l_extendedprice), 2) AS l_extendedprice FROM lineitem GROUP BY 1")
def groupby_unique(spark, sf):
    return rounded(G.groupby(_lines(spark, sf), "l_suppkey").reduce("sum").frame, 2)


@query("WITH b AS (SELECT CASE WHEN o_totalprice > 0 AND o_totalprice <= 50000 THEN '(0, 50000]' WHEN o_totalprice > 50000 AND o_totalprice <= 150000 THEN '(50000, 150000]' WHEN o_totalprice > 150000 AND o_totalprice <= 500000 THEN '(150000, 500000]' END AS price_bins, o_totalprice FROM orders) SELECT price_bins, count(o_totalprice) AS o_totalprice FROM b WHERE price_bins IS NOT NULL GROUP BY 1")
def groupby_bins(spark, sf):
    c = C.orders(spark, sf)["o_totalprice"]
    return G.groupby(c, G.bins("price_bins", F.col("o_totalprice"), [0, 50000, 150000, 500000])).reduce("count").frame


@query("SELECT month(o_orderdate) AS month, round(avg(o_totalprice), 3) AS o_totalprice FROM orders GROUP BY 1")
def groupby_month(spark, sf):
    return rounded(G.groupby(C.orders(spark, sf)[["o_totalprice", "o_orderdate"]], G.unique("month", F.month("o_orderdate"))).agg(o_totalprice=F.avg("o_totalprice")).frame, 3)


@query("SELECT CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'DJF' WHEN month(o_orderdate) IN (3, 4, 5) THEN 'MAM' WHEN month(o_orderdate) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END AS season, round(sum(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY 1")
def groupby_season(spark, sf):
    c = C.orders(spark, sf)
    return rounded(G.groupby(Cube(c.frame.select("o_orderkey", "o_totalprice", "o_orderdate"), ("o_orderkey",), ("o_totalprice",)), G.seasons("season", F.col("o_orderdate"))).reduce("sum").frame, 2)


@query("SELECT season, count(*) AS o_totalprice FROM orders, (VALUES ('DJFM', [12, 1, 2, 3]), ('MAMJ', [3, 4, 5, 6])) t(season, ms) WHERE list_contains(ms, month(o_orderdate)) GROUP BY 1")
def groupby_season_overlap(spark, sf):
    c = C.orders(spark, sf)
    return G.groupby(Cube(c.frame.select("o_orderkey", "o_totalprice", "o_orderdate"), ("o_orderkey",), ("o_totalprice",)), G.seasons("season", F.col("o_orderdate"), ["DJFM", "MAMJ"])).reduce("count").frame


@query("WITH g AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2) SELECT p_brand, p_size, CAST(n AS DOUBLE) AS n FROM (SELECT DISTINCT p_brand FROM g) CROSS JOIN (SELECT DISTINCT p_size FROM g) LEFT JOIN g USING (p_brand, p_size)")
def groupby_multi_dense(spark, sf):
    c = C.part(spark, sf)
    g = G.groupby(c, "p_brand", "p_size")
    return g.dense(g.agg(n=F.count(F.lit(1)))).astype("double").frame


@query(f"WITH {DAILY} SELECT day, status, round(quantity - avg(quantity) OVER (PARTITION BY month(day), status), 4) AS quantity FROM daily")
def groupby_anomaly(spark, sf):
    c = C.daily(spark, sf)["quantity"]
    return rounded(G.groupby(c, G.unique("month", F.month("day")), over="day").transform(lambda x, m: x - m).frame)


@query("SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS head, arg_max(o_totalprice, o_orderkey) AS tail FROM orders GROUP BY 1")
def groupby_first_last(spark, sf):
    g = G.groupby(C.orders(spark, sf)[["o_totalprice", "o_custkey"]], "o_custkey")
    order = F.col("o_orderkey")
    return g.agg(head=F.min_by("o_totalprice", order), tail=F.max_by("o_totalprice", order)).frame


@query("SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.75), 4) AS o_totalprice FROM orders GROUP BY 1")
def groupby_quantile(spark, sf):
    c = C.orders(spark, sf)
    return rounded(G.groupby(Cube(c.frame.select("o_orderkey", "o_totalprice", "o_orderpriority"), ("o_orderkey",), ("o_totalprice",)), "o_orderpriority").quantile(0.75).frame)


@query(f"WITH {C.GAPPY}, m AS (SELECT status, avg(quantity) AS q FROM gappy GROUP BY 1) SELECT day, status, round(coalesce(quantity, q), 4) AS quantity FROM gappy JOIN m USING (status)")
def groupby_fillna(spark, sf):
    c = C.gappy(spark, sf)
    g = G.groupby(c, "status", over="day")
    return rounded(g.fillna(g.reduce("mean")).frame)


@query("SELECT p_brand, round(sum(p_retailprice) - min(p_retailprice), 2) AS spread FROM part GROUP BY 1")
def groupby_map_pandas(spark, sf):
    def run(pdf):
        import pandas as pd

        v = pdf["p_retailprice"]
        return pd.DataFrame({"p_brand": [pdf["p_brand"].iloc[0]], "spread": [v.sum() - v.min()]})

    return rounded(G.groupby(C.part(spark, sf), "p_brand").map(run, "p_brand string, spread double"), 2)


@query("SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS level, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def grouping_cube(spark, sf):
    return rounded(G.cube_rollup(C.table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], {"q": F.sum("l_quantity")}), 2)


@query("SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS level, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def grouping_rollup(spark, sf):
    return G.cube_rollup(C.table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], {"n": F.count(F.lit(1))}, "rollup")


@query("SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1")
def distinct_count(spark, sf):
    return C.table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_suppkey").alias("suppliers"))


# -- reshaping and sorting ------------------------------------------------------
@query("SELECT p_partkey, row_number() OVER (ORDER BY p_size, p_retailprice, p_partkey) - 1 AS pos FROM part")
def sortby_multi(spark, sf):
    return H.sortby(C.part(spark, sf), "p_partkey", "p_size", "p_retailprice").orders["p_partkey"]


@query("SELECT p_brand, p_partkey, p_retailprice FROM (SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) WHERE k <= 3")
def topk_per_group(spark, sf):
    return H.topk(C.table(spark, sf, "part"), 3, "p_retailprice", "p_partkey", ["p_brand"]).select("p_brand", "p_partkey", "p_retailprice")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def topk_global(spark, sf):
    return H.topk(C.table(spark, sf, "customer").select("c_custkey", "c_acctbal"), 20, "c_acctbal", "c_custkey")


@query(f"WITH {NATION} SELECT n.nation, s.segment, coalesce(round(bal, 4), -1.0) AS bal FROM (SELECT DISTINCT nation FROM ns) n CROSS JOIN (SELECT DISTINCT segment FROM ns) s LEFT JOIN ns USING (nation, segment)")
def stack_unstack_fill(spark, sf):
    return rounded(H.unstack(H.stack(C.nation_segment(spark, sf), "z", "nation", "segment"), "z", -1.0).frame)


@query(f"WITH {DAILY} SELECT day, 'revenue' AS variable, status, round(revenue, 4) AS value FROM daily UNION ALL SELECT day, 'quantity', status, round(quantity, 4) FROM daily")
def to_stacked_array_features(spark, sf):
    out = H.to_stacked_array(C.daily(spark, sf), "feature", ["day"]).frame
    return rounded(out.select("day", "feature.variable", "feature.status", "value"))


def _pad(mode: str, source: str, extra: str = ""):
    def run(spark, sf):
        c = Cube.from_spark(C.table(spark, sf, "nation").select("n_nationkey", F.col("n_regionkey").cast("double").alias("v")), ["n_nationkey"])
        return H.pad(c, "n_nationkey", 4, 3, mode).frame

    run.__name__ = f"pad_{mode}"
    query(f"WITH k AS (SELECT CAST(n_regionkey AS DOUBLE) AS v, row_number() OVER (ORDER BY n_nationkey) - 1 AS pos FROM nation), n AS (SELECT count(*) AS n FROM k), p AS (SELECT unnest(range(-4, 28)) AS p), s AS (SELECT p, {source} AS src FROM p, n) SELECT p AS n_nationkey, {extra or 'v'} AS v FROM s LEFT JOIN k ON src = pos")(run)


for _mode, _source, _extra in (
    ("edge", "least(greatest(p, 0), n - 1)", ""),
    ("wrap", "((p % n) + n) % n", ""),
    ("reflect", "CASE WHEN ((p % (2*n-2)) + 2*n-2) % (2*n-2) < n THEN ((p % (2*n-2)) + 2*n-2) % (2*n-2) ELSE 2*n-2 - ((p % (2*n-2)) + 2*n-2) % (2*n-2) END", ""),
    ("symmetric", "CASE WHEN ((p % (2*n)) + 2*n) % (2*n) < n THEN ((p % (2*n)) + 2*n) % (2*n) ELSE 2*n-1 - ((p % (2*n)) + 2*n) % (2*n) END", ""),
    ("constant", "CASE WHEN p >= 0 AND p < n THEN p END", ""),
    ("maximum", "CASE WHEN p >= 0 AND p < n THEN p END", "CASE WHEN src IS NULL THEN (SELECT max(v) FROM k) ELSE v END"),
    ("mean", "CASE WHEN p >= 0 AND p < n THEN p END", "CASE WHEN src IS NULL THEN (SELECT avg(v) FROM k) ELSE v END"),
):
    _pad(_mode, _source, _extra)
