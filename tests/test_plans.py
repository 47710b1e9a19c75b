"""Every registered SQL plan against DuckDB on the smallest tables, and hand-computed cases."""

import math

import duckdb
import pytest

from pyspark.sql import functions as F

from riskloom.operators.statistics import beta_column, beta_share, log_gamma, mcnemar, mcnemar_column, t_column, t_two_sided
from riskloom.plans.registry import ORACLE, QUERIES
from riskloom.sources.tables import SHOP, TABLES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES + SHOP:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def same(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return str(v) if isinstance(v, list) else float(v) if hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_duckdb(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    want = duck.sql(ORACLE[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    got = sorted((tuple(same(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got == sorted((tuple(same(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_distributions():
    assert abs(t_two_sided(2.063899, 24) - 0.05) < 1e-6 and abs(t_two_sided(2.262157, 9) - 0.05) < 1e-6
    assert [mcnemar(*x) for x in ((0, 0), (0, 5), (1, 9), (4, 4))] == [1, 2 * 0.5**5, 22 / 1024, 1]


def test_distributions_as_expressions(spark):
    """Any counts, any degrees of freedom: against exact sums of integers and the scalar functions."""
    counts = [(b, c) for b in (0, 1, 2, 7, 40, 333) for c in (0, 1, 3, 8, 39, 400)] + [(2500, 2600), (2400, 2750), (9000, 9001)]
    got = spark.createDataFrame(counts, "b long, c long").select("b", "c", mcnemar_column(F.col("b"), F.col("c")).alias("p")).collect()
    assert all(abs(p - mcnemar(b, c)) < 1e-9 for b, c, p in got) and len(got) == len(counts)
    # beyond exact sums: a million pairs against the normal law with its continuity correction
    p = spark.createDataFrame([(499_000, 501_000)], "b long, c long").select(mcnemar_column(F.col("b"), F.col("c"))).first()[0]
    assert abs(p - math.erfc((2000 - 1) / 1000 / math.sqrt(2))) < 1e-4
    ts = [(t, df) for t in (-40.0, -2.0, -0.1, 0.0, 0.5, 1.96, 7.0, 1e5) for df in (1, 2, 3, 4, 9, 24, 100, 5000)]
    got = spark.createDataFrame(ts, "t double, df int").select("t", "df", t_column(F.col("t"), F.col("df")).alias("p")).collect()
    assert all(abs(p - t_two_sided(t, df)) < 1e-9 for t, df, p in got)
    odd = spark.createDataFrame([(None, 3), (float("nan"), 3), (float("inf"), 3), (1.0, None)], "t double, df int").select(t_column(F.col("t"), F.col("df"))).collect()
    assert [r[0] for r in odd] == [None, None, 0.0, None]
    ab = [(a, b, x) for a in (0.5, 1.0, 3.5, 80.0) for b in (0.5, 2.0, 19.0) for x in (0.0, 0.01, 0.5, 0.93, 1.0)]
    got = spark.createDataFrame(ab, "a double, b double, x double").select("a", "b", "x", beta_column(F.col("a"), F.col("b"), F.col("x")).alias("p"), log_gamma(F.col("a")).alias("g")).collect()
    assert all(abs(r["p"] - beta_share(r["a"], r["b"], r["x"])) < 1e-10 and abs(r["g"] - math.lgamma(r["a"])) < 1e-10 for r in got)


@pytest.mark.parametrize("name", ["cv_logistic_regression", "cv_kernel_machine"])
def test_rows_only(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0
