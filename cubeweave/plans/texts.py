"""Queries of string functions and user functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from cubeweave.cube import Cube
from cubeweave.functions import strings as S
from cubeweave.operators import apply as U
from cubeweave.operators import window as W
from cubeweave.plans import query
from cubeweave.plans import cubes as C
from cubeweave.plans.cubes import DAILY, HOURLY, rounded

_N = "p_name"
_SIMPLE = {
    "len": (lambda x: S.length(x), "length(x)", "bigint"), "get2": (lambda x: S.get(x, 2), "substr(x, 3, 1)", None), "last": (lambda x: S.get(x, -1), "right(x, 1)", None), "far": (lambda x: S.get(x, 500, "?"), "'?'", None),
    "slice": (lambda x: S.slice_(x, 1, 5), "substr(x, 2, 4)", None), "tail": (lambda x: S.slice_(x, -3), "right(x, 3)", None), "reverse": (lambda x: S.slice_(x, step=-1), "reverse(x)", None),
    "cut": (lambda x: S.slice_replace(x, 2, 4, "#"), "left(x, 2) || '#' || substr(x, 5)", None), "cat": (lambda x: S.cat(x, "z", sep="-"), "x || '-z'", None),
    "upper": (F.upper, "upper(x)", None), "lower": (F.lower, "lower(x)", None), "capitalize": (S.capitalize, "upper(left(x, 1)) || lower(substr(x, 2))", None),
    "left": (lambda x: S.pad(x, 40, "left", "*"), "CASE WHEN length(x) < 40 THEN lpad(x, 40, '*') ELSE x END", None), "right": (lambda x: S.pad(x, 40, "right", "."), "CASE WHEN length(x) < 40 THEN rpad(x, 40, '.') ELSE x END", None),
    "short": (lambda x: S.pad(x, 3), "x", None), "zfill": (lambda x: S.zfill(x, 30), "CASE WHEN length(x) < 30 THEN lpad(x, 30, '0') ELSE x END", None),
    "strip": (lambda x: S.strip(x, "pa"), "trim(x, 'pa')", None), "repeat": (lambda x: S.repeat(x, 2), "repeat(x, 2)", None), "find": (lambda x: S.find(x, "a"), "instr(x, 'a') - 1", "int"),
    "rfind": (lambda x: S.find(x, "a", side="right"), "CASE WHEN instr(reverse(x), 'a') = 0 THEN -1 ELSE length(x) - instr(reverse(x), 'a') END", "int"),
    "count": (lambda x: S.count(x, "[aeiou]"), "length(regexp_replace(x, '[^aeiou]', '', 'g'))", "int"), "starts": (lambda x: x.startswith("p"), "starts_with(x, 'p')", None), "ends": (lambda x: x.endswith("1"), "suffix(x, '1')", None),
    "contains": (lambda x: S.contains(x, "a.t"), "regexp_matches(x, 'a.t')", None), "icontains": (lambda x: S.contains(x, "PART", case=False), "contains(lower(x), 'part')", None), "literal": (lambda x: S.contains(x, ".", regex=False), "contains(x, '.')", None),
    "match": (lambda x: S.match(x, "[a-z]+"), "regexp_matches(x, '^(?:[a-z]+)')", None), "replace": (lambda x: S.replace(x, "[0-9]", "#"), "regexp_replace(x, '[0-9]', '#', 'g')", None),
    "replace1": (lambda x: S.replace(x, "[0-9]", "#", n=1), "regexp_replace(x, '[0-9]', '#')", None), "translate": (lambda x: S.translate(x, {"a": "4", "e": "3", "r": None}), "translate(x, 'aer', '43')", None),
    "isalpha": (lambda x: S.test(x, "isalpha"), "regexp_matches(x, '^[a-zA-Z]+$')", None), "isalnum": (lambda x: S.test(x, "isalnum"), "regexp_matches(x, '^[a-zA-Z0-9]+$')", None),
    "isdigit": (lambda x: S.test(F.substring(x, -1, 1), "isdigit"), "regexp_matches(right(x, 1), '^[0-9]+$')", None), "islower": (lambda x: S.test(x, "islower"), "x = lower(x) AND x <> upper(x)", None), "isupper": (lambda x: S.test(x, "isupper"), "x = upper(x) AND x <> lower(x)", None),
    "index": (lambda x: S.index(F.concat(x, F.lit("q")), "q", side="right"), "length(x)", "int"),
}


@query("SELECT p_partkey, " + ", ".join(f"CAST({s} AS {k}) AS s_{n}" if k else f"{s} AS s_{n}" for n, (_, s, k) in _SIMPLE.items()) + " FROM (SELECT p_partkey, p_name AS x FROM part)")
def str_functions(spark, sf):
    x = F.col(_N)
    return C.table(spark, sf, "part").select("p_partkey", *[(f(x).cast(k) if k else f(x)).alias(f"s_{n}") for n, (f, _, k) in _SIMPLE.items()])


@query("SELECT page_id, regexp_extract(url, '^(\\w+)://([^/]+)', 1) AS scheme, regexp_extract(url, '^(\\w+)://([^/]+)', 2) AS host FROM pages")
def str_extract_groups(spark, sf):
    got = S.extract(F.col("url"), r"^(\w+)://([^/]+)", 2)
    return C.table(spark, sf, "pages").select("page_id", F.get(got, F.lit(0)).alias("scheme"), F.get(got, F.lit(1)).alias("host"))


@query("SELECT page_id, CAST(unnest(range(0, len(m))) AS INTEGER) AS match, unnest(m) AS word FROM (SELECT page_id, regexp_extract_all(url, '[a-z]{3,}') AS m FROM pages)")
def str_findall_exploded(spark, sf):
    return C.table(spark, sf, "pages").select("page_id", F.posexplode(S.findall(F.col("url"), "[a-z]{3,}")).alias("match", "word"))


@query("SELECT page_id, CAST(unnest(range(0, len(m))) AS INTEGER) AS part, unnest(m) AS word FROM (SELECT page_id, string_split(url, '/') AS m FROM pages)")
def str_split_exploded(spark, sf):
    return C.table(spark, sf, "pages").select("page_id", F.posexplode(S.split(F.col("url"), "/")).alias("part", "word"))


@query("SELECT page_id, CASE WHEN instr(url, '?') = 0 THEN url ELSE left(url, instr(url, '?') - 1) END AS path, CASE WHEN instr(url, '?') = 0 THEN '' ELSE '?' END AS mark, CASE WHEN instr(url, '?') = 0 THEN '' ELSE substr(url, instr(url, '?') + 1) END AS rest FROM pages")
def str_partition(spark, sf):
    got = S.partition(F.col("url"), "?")
    return C.table(spark, sf, "pages").select("page_id", *[F.get(got, F.lit(k)).alias(n) for k, n in enumerate(("path", "mark", "rest"))])


@query("SELECT nation, string_agg(c, '|' ORDER BY k) AS names FROM (SELECT n_regionkey AS nation, n_name AS c, n_nationkey AS k FROM nation) GROUP BY 1")
def str_join_dim(spark, sf):
    return C.table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("nation")).agg(S.join("n_name", "n_nationkey", "|").alias("names"))


@query("WITH p AS (SELECT n_nationkey, unnest(list_distinct(string_split(lower(n_name), 'a'))) AS label FROM nation), l AS (SELECT DISTINCT label FROM p WHERE label <> '') SELECT n.n_nationkey, l.label, p.label IS NOT NULL AS value FROM nation n CROSS JOIN l LEFT JOIN p ON p.n_nationkey = n.n_nationkey AND p.label = l.label")
def str_get_dummies(spark, sf):
    return S.get_dummies(C.table(spark, sf, "nation").select("n_nationkey", F.lower("n_name").alias("x")), "x", ["n_nationkey"], "a")


@query("SELECT event_id, json_extract_string(props, '$.' || (json_keys(props)[1])) AS first_prop FROM events")
def json_first_property(spark, sf):
    keys = F.json_object_keys("props")
    parsed = F.from_json("props", "map<string,string>")
    return C.table(spark, sf, "events").select("event_id", F.element_at(parsed, F.get(keys, F.lit(0))).alias("first_prop"))


@query("SELECT p_partkey, round(sqrt(p_retailprice) + p_size, 6) AS v FROM part")
def apply_ufunc_vectorised(spark, sf):
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return a**0.5 + b

    return C.table(spark, sf, "part").select("p_partkey", F.round(run("p_retailprice", "p_size"), 6).alias("v"))


@query("WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT vec_id, round(sqrt(sum(x * x)), 5) AS norm FROM e GROUP BY 1")
def apply_ufunc_core_dim(spark, sf):
    """A core dimension is an array: reduced inside the row, without an exchange."""
    squares = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return C.table(spark, sf, "embeddings").select("vec_id", F.round(F.sqrt(squares), 5).alias("norm"))


@query("SELECT p_partkey, p_size * 10 + 1 AS v FROM part")
def map_blocks_pandas(spark, sf):
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"p_partkey": pdf["p_partkey"], "v": pdf["p_size"] * 10 + 1})

    return C.table(spark, sf, "part").select("p_partkey", "p_size").mapInPandas(run, "p_partkey long, v int")


def _spearman(x, y):
    """Correlation of ranks along the last axis; ties share their mean rank."""
    import numpy as np

    def ranks(a):
        return np.stack([np.searchsorted(np.sort(r), r, "left") + np.searchsorted(np.sort(r), r, "right") for r in a]) / 2.0

    x, y = ranks(x), ranks(y)
    x, y = x - x.mean(-1, keepdims=True), y - y.mean(-1, keepdims=True)
    return (x * y).sum(-1) / np.sqrt((x * x).sum(-1) * (y * y).sum(-1))


@query(f"WITH {DAILY}, r AS (SELECT status, rank() OVER (PARTITION BY status ORDER BY revenue) + (count(*) OVER (PARTITION BY status, revenue) - 1) / 2.0 AS x, rank() OVER (PARTITION BY status ORDER BY quantity) + (count(*) OVER (PARTITION BY status, quantity) - 1) / 2.0 AS y FROM daily) SELECT status, round(corr(x, y), 6) AS rho FROM r GROUP BY 1")
def apply_ufunc_spearman(spark, sf):
    c = C.daily(spark, sf)
    return rounded(U.apply_ufunc(_spearman, c["revenue"], c["quantity"], core=["day"], name="rho").frame, 6)


@query(f"WITH {DAILY} SELECT day, status, round(quantity - avg(quantity) OVER (PARTITION BY status), 4) AS quantity FROM daily")
def apply_ufunc_output_core_dim(spark, sf):
    """The function returns the core dimension; its labels come back."""
    c = C.daily(spark, sf)["quantity"]
    return rounded(U.apply_ufunc(lambda x: x - x.mean(-1, keepdims=True), c, core=["day"], out_core="day", name="quantity").frame)


@query("SELECT p_partkey, p_retailprice - coalesce(c_acctbal, 0.0) AS v FROM part LEFT JOIN customer ON c_custkey * 2 = p_partkey")
def apply_ufunc_joined(spark, sf):
    a = C.part(spark, sf)["p_retailprice"]
    b = Cube(C.table(spark, sf, "customer").select((F.col("c_custkey") * 2).alias("p_partkey"), "c_acctbal"), ("p_partkey",), ("c_acctbal",))
    return U.apply_ufunc(lambda x, y: x - y.fillna(0.0), a, b, join="left", name="v").frame


@query(f"WITH {DAILY} SELECT day, status, round(quantity / sum(quantity) OVER (PARTITION BY status), 9) AS quantity FROM daily")
def map_blocks_template(spark, sf):
    def share(pdf):
        return pdf.assign(quantity=pdf["quantity"].astype(float) / pdf["quantity"].astype(float).sum())

    return rounded(U.map_blocks(share, C.daily(spark, sf)["quantity"].astype("double"), by=["status"]).frame, 9)


@query(f"WITH {HOURLY} SELECT hour, kind, round(sum(value) OVER (PARTITION BY kind ORDER BY hour RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW), 4) AS value FROM hourly")
def rolling_by_value(spark, sf):
    from datetime import timedelta

    return rounded(W.rolling_values(C.hourly(spark, sf), "hour", timedelta(hours=6), "sum").frame)


@query(f"WITH {DAILY} SELECT day, status, round(2 * revenue - quantity, 4) AS v FROM daily")
def python_operators(spark, sf):
    c = C.daily(spark, sf)
    return rounded((2 * c["revenue"] - c["quantity"].rename(quantity="revenue")).rename(revenue="v").frame)


@query(f"WITH {HOURLY} SELECT hour, kind, round(value, 4) AS value, round(sum(value) OVER (PARTITION BY kind), 4) AS total FROM hourly")
def groupby_assign(spark, sf):
    from cubeweave.operators import group as G

    return rounded(G.groupby(C.hourly(spark, sf), "kind").assign(total=("sum", "value")).frame)
