"""Further queries: nested combination, reindexing by method, complex parts, exponential sums, padding by statistics, equality."""

from __future__ import annotations

from pyspark.sql import functions as F

from cubeweave.cube import Cube
from cubeweave.functions import dates as D
from cubeweave.functions import math as M
from cubeweave.functions import strings as S
from cubeweave.operators import align as A
from cubeweave.operators import fit as T
from cubeweave.operators import group as G
from cubeweave.operators import reduce as R
from cubeweave.operators import reshape as H
from cubeweave.operators import select as Sel
from cubeweave.operators import window as W
from cubeweave.plans import query
from cubeweave.plans import cubes as C
from cubeweave.plans.cubes import DAILY, GAPPY, NATION, rounded


def _nation(spark, sf):
    return Cube.from_spark(C.table(spark, sf, "nation").select("n_nationkey", F.col("n_regionkey").cast("double").alias("v")), ["n_nationkey"])


@query(f"WITH {NATION} SELECT nation, segment, round(bal, 4) AS bal FROM ns")
def combine_nested_tiles(spark, sf):
    c = C.nation_segment(spark, sf)
    low, high = F.col("segment") < "H", F.col("segment") >= "H"
    tiles = [[c.with_frame(c.frame.where(rows & cols)) for cols in (low, high)] for rows in (F.col("nation") < "K", F.col("nation") >= "K")]
    return rounded(A.combine_nested(tiles, ["nation", "segment"]).frame)


@query("WITH p AS (SELECT n_nationkey * 2 AS k, CAST(n_regionkey AS DOUBLE) AS v FROM nation), t AS (SELECT unnest(range(0, 48)) AS k) SELECT t.k, (SELECT arg_max(p.v, p.k) FROM p WHERE p.k <= t.k) AS v FROM t")
def reindex_pad(spark, sf):
    c = Cube.from_spark(C.table(spark, sf, "nation").select((F.col("n_nationkey") * 2).cast("bigint").alias("k"), F.col("n_regionkey").cast("double").alias("v")), ["k"])
    return A.reindex(c, method="pad", k=spark.range(48).withColumnRenamed("id", "k")).frame


@query("SELECT p_partkey, p_size * 1.0::DOUBLE AS re, -p_retailprice AS im, round(atan2(p_retailprice, p_size), 9) AS angle FROM part")
def complex_parts(spark, sf):
    z = M.complex_(F.col("p_size"), F.col("p_retailprice"))
    conj = M.UNARY["conj"](z)
    return C.table(spark, sf, "part").select("p_partkey", M.UNARY["real"](conj).alias("re"), M.UNARY["imag"](conj).alias("im"), F.round(M.UNARY["angle"](z), 9).alias("angle"))


@query(f"WITH RECURSIVE {DAILY}, p AS (SELECT status, day, quantity, row_number() OVER (PARTITION BY status ORDER BY day) AS k FROM daily), r AS (SELECT status, day, k, quantity AS s FROM p WHERE k = 1 UNION ALL SELECT p.status, p.day, p.k, r.s * 0.5::DOUBLE + p.quantity FROM r JOIN p ON p.status = r.status AND p.k = r.k + 1) SELECT day, status, round(s, 4) AS quantity FROM r")
def rolling_exp_sum(spark, sf):
    return rounded(W.rolling_exp(C.daily(spark, sf)["quantity"], "day", "sum", alpha=0.5).frame)


@query()
def rolling_exp_corr(spark, sf):
    return rounded(W.rolling_exp(C.daily(spark, sf), "day", "corr", other="revenue", span=9).frame)


@query("WITH k AS (SELECT CAST(n_regionkey AS DOUBLE) AS v, row_number() OVER (ORDER BY n_nationkey) - 1 AS pos FROM nation), p AS (SELECT unnest(range(-3, 27)) AS p) SELECT p AS n_nationkey, coalesce(v, (SELECT quantile_cont(v, 0.5) FROM k)) AS v FROM p LEFT JOIN k ON p = pos")
def pad_median(spark, sf):
    return H.pad(_nation(spark, sf), "n_nationkey", 3, 2, "median").frame


@query("WITH k AS (SELECT CAST(n_regionkey AS DOUBLE) AS v, row_number() OVER (ORDER BY n_nationkey) - 1 AS pos FROM nation), p AS (SELECT unnest(range(-4, 29)) AS p) SELECT p AS n_nationkey, round(CASE WHEN p < 0 THEN (SELECT v FROM k WHERE pos = 0) * (p + 4) / 4.0::DOUBLE WHEN p > 24 THEN (SELECT v FROM k WHERE pos = 24) * (28 - p) / 4.0::DOUBLE ELSE v END, 6) AS v FROM p LEFT JOIN k ON p = pos")
def pad_linear_ramp(spark, sf):
    return rounded(H.pad(_nation(spark, sf), "n_nationkey", 4, 4, "linear_ramp").frame, 6)


@query("SELECT true AS same, false AS other")
def cube_equality(spark, sf):
    c = C.nation_segment(spark, sf)
    return spark.createDataFrame([(c.equals(c.transpose()), c.equals(c.map(lambda x: x + 1)))], "same boolean, other boolean")


@query(f"WITH {GAPPY}, m AS (SELECT status, avg(quantity) > 0 AS ok FROM gappy WHERE status = 'F' GROUP BY 1) SELECT day, status, CASE WHEN ok THEN quantity END AS quantity FROM gappy LEFT JOIN m USING (status)")
def groupby_where(spark, sf):
    c = C.gappy(spark, sf)
    g = G.groupby(c, "status", over="day")
    ok = g.reduce("mean").map(lambda q: q > 0)
    return g.where(ok.with_frame(ok.frame.where("status = 'F'"))).frame


@query(f"WITH {DAILY}, {'p AS (SELECT *, dense_rank() OVER (ORDER BY day) - 1 AS pos FROM daily)'} SELECT a.day, a.status, round(a.quantity - 2 * b.quantity + c.quantity, 4) AS quantity FROM p a JOIN p b ON a.status = b.status AND b.pos = a.pos - 1 JOIN p c ON a.status = c.status AND c.pos = a.pos - 2")
def diff_second_dense(spark, sf):
    """Second differences by repeated first ones need all three cells; a self-join says the same."""
    c = C.daily(spark, sf)["quantity"]
    one = W.shift(c, "day", 1).rename(quantity="one")
    two = W.shift(c, "day", 2).rename(quantity="two")
    both = c.frame.join(one.frame, ["day", "status"]).join(two.frame, ["day", "status"]).where("one IS NOT NULL AND two IS NOT NULL")
    return rounded(both.select("day", "status", (F.col("quantity") - 2 * F.col("one") + F.col("two")).alias("quantity")))


@query("SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 4) AS q FROM lineitem GROUP BY 1, 2")
def broadcast_cubes(spark, sf):
    rows = C.table(spark, sf, "lineitem")
    c = Cube(rows.groupBy("l_returnflag", "l_linestatus").agg(F.avg("l_quantity").alias("q")), ("l_returnflag", "l_linestatus"), ("q",))
    flags = R.reduce(c, "max", "l_linestatus").rename(q="m")
    wide, _ = A.broadcast(c, flags)
    return rounded(wide.frame)


@query("SELECT n_nationkey, n_regionkey * 10.0::DOUBLE + n_nationkey AS v FROM nation")
def dataset_map_pipe(spark, sf):
    return _nation(spark, sf).pipe(lambda c: c.map(lambda v: v * 10)).assign(v=lambda c: F.col("v") + F.col("n_nationkey")).frame


@query("SELECT event_id, CAST((dayofyear(ts) - 1) * 360 // 366 // 30 + 1 AS INTEGER) AS month FROM events WHERE year(ts) = 2024")
def calendar_360_day(spark, sf):
    return C.table(spark, sf, "events").where(F.year("ts") == 2024).select("event_id", D.to_360_day(F.col("ts"))["month"].alias("month"))


@query()
def str_unicode_functions(spark, sf):
    x = F.col("text")
    return C.table(spark, sf, "documents").select("doc_id", S.title(x).alias("title"), S.casefold(x).alias("folded"), S.normalize(x, "NFD").alias("nfd"), S.wrap(x, 20).alias("wrapped"), S.swapcase(x).alias("swapped"))


@query(f"WITH {DAILY} SELECT day, status, round(quantity, 4) AS quantity FROM daily WHERE day IN (SELECT day FROM daily GROUP BY day HAVING sum(quantity) > 100)")
def query_on_reduction(spark, sf):
    c = C.daily(spark, sf)["quantity"]
    busy = R.reduce(c, "sum", "status").frame.where("quantity > 100").select("day")
    return rounded(Sel.semi(c, busy).frame)


@query("SELECT s_suppkey, round(s_acctbal, 4) AS v FROM supplier")
def interp_at_labels(spark, sf):
    c = Cube.from_spark(C.table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("v")), ["s_suppkey"])
    return rounded(T.interp_like(c, c).frame)
