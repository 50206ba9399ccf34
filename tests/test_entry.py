"""The driver's contract, and a sample of queries against DuckDB."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["sel_label_slice", "arith_outer", "asof_nearest_tolerance", "groupby_anomaly", "resample_day_mean", "rolling_mean_center", "weighted_quantile", "pad_reflect", "interp_linear", "str_functions"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = entry.queries()[name](spark, SF).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    key = lambda f: sorted(str(["-" if x != x or x is None else round(float(x), 6) if isinstance(x, float) else str(x) for x in r]) for r in f[cols].itertuples(index=False))
    assert key(got) == key(want)
