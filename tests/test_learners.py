"""Learners against first principles, held-out accuracy, and the shape of repeated folds."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.operators import learners as L


def blobs(n, seed=0, spread=1.0):
    r = np.random.default_rng(seed)
    y = r.integers(0, 3, n).astype(float)
    return r.normal(0, spread, (n, 6)) + np.eye(6)[y.astype(int)] * 4, y


def test_logistic_is_at_its_optimum_and_shrinks():
    x, y = blobs(300)
    m = L.Logistic(0.5).fit(x, y)
    z, t = np.c_[(x - m.mean) / m.sd, np.ones(len(x))], (y[:, None] == m.classes).astype(float)
    slope = z.T @ (L.balanced(y)[:, None] * (m.probabilities(x) - t)) + np.r_[np.full(6, 2.0), 0][:, None] * m.weights
    assert np.abs(slope).max() < 1e-3
    assert np.abs(L.Logistic(0.01).fit(x, y).weights[:-1]).sum() < np.abs(m.weights[:-1]).sum()
    assert (L.chosen(m.probabilities(x), m.classes) == y).mean() > 0.95


def test_smo_meets_the_conditions():
    x, y = blobs(120, 1, 2.0)
    at = y < 2
    k, s = np.exp(-0.1 * ((x[at][:, None] - x[at]) ** 2).sum(2)), np.where(y[at] == 0, 1.0, -1.0)
    a, b = L.smo(k, s, np.full(at.sum(), 2.0))
    margin = s * (k @ (a * s) + b)
    assert abs((a * s).sum()) < 1e-9 and (a >= 0).all() and (a <= 2).all()
    assert (margin[a < 1e-8] > 1 - 0.01).all() and (margin[a > 2 - 1e-8] < 1 + 0.01).all() and np.abs(margin[(a > 1e-6) & (a < 2 - 1e-6)] - 1).max() < 0.01


def test_kernel_machine_learns_a_ring():
    r = np.random.default_rng(2)
    x = r.normal(0, 1, (300, 2))
    y = (np.hypot(*x.T) > 1.1).astype(float)
    m = L.KernelMachine(10).fit(x[:200], y[:200])
    p = m.probabilities(x[200:])
    assert np.allclose(p.sum(1), 1) and (L.chosen(p, m.classes) == y[200:]).mean() > 0.9


def test_small_parts():
    assert (L.chosen(np.array([[0.4, 0.4, 0.2], [1 / 3] * 3, [0.2, 0.5, 0.3]]), np.arange(3)) == [1, 2, 1]).all()
    assert L.macro_f1(np.array([0, 0, 1]), np.array([0, 1, 1])) == pytest.approx((2 / 3 + 2 / 3) / 2)
    x, y = blobs(50, 3)
    m = L.Ridge(2.0).fit(x, y)
    z = x - x.mean(0)
    assert np.allclose(z.T @ (z @ m.weights - (y - y.mean())) + 2 * m.weights, 0, atol=1e-8)
    assert L.Tuned(grid=(1.0, 1.0000001)).fit(*blobs(90, 4, 0.1)).c == 1.0  # equals: the smaller


def test_repeated_folds_test_every_row_once(spark):
    x, y = blobs(120, 5)
    rows = spark.createDataFrame([(i, v.tolist(), float(c), i % 11) for i, (v, c) in enumerate(zip(x, y))], "id long, x array<double>, y double, series long")
    got = L.tested(rows.drop("series"), L.Logistic, repeats=2, k=3).toPandas()
    assert len(got) == 240 and (got.groupby(["repeat", "id"]).size() == 1).all() and (got.chosen == got.y).mean() > 0.9
    sizes = got.groupby(["repeat", "y", "fold"]).size()
    assert (sizes.groupby(level=[0, 1]).max() - sizes.groupby(level=[0, 1]).min()).max() <= 1
    assert L.folded(rows, 2, 3, "series").groupBy("repeat", "series").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    few = L.tested(rows.drop("series"), L.Majority, repeats=1, k=3, most=30).toPandas()
    assert len(few) == 120
    p = L.probes(rows, {"a": "y", "one": "1"}, repeats=1, k=3).toPandas()
    assert set(p.target) == {"a"} and p[p.kind == "learner"].macro_f1.mean() > p[p.kind == "majority"].macro_f1.mean() + 0.3


def test_a_forest_is_fitted_on_rows_dealt_over_parts(spark, monkeypatch):
    """Not on one part a class, as ranking by class leaves them; the folds are those of ranks over each whole class."""
    seen = []

    class Stop(Exception):
        pass

    class Forest:
        def __init__(self, **how):
            assert how["numTrees"] == 500

        def fit(self, rows):
            seen.extend(r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect())
            raise Stop

    monkeypatch.setattr(L, "PART_ROWS", 40, raising=False)
    monkeypatch.setattr(L, "RandomForestClassifier", Forest)
    rows = spark.range(400).select(F.col("id").alias("vec_id"), F.array(F.col("id") % 7.0, F.lit(1.0)).alias("embedding"), F.lit(1).alias("label"))
    with pytest.raises(Stop):
        L.cross_validated_forest(rows)
    assert len(seen) >= 8 and sum(seen) == 320
    whole = L.vectors(rows.unionByName(rows.where("vec_id < 9")).withColumn("vec_id", F.when(F.col("vec_id") > 3, F.col("vec_id"))))
    place = F.row_number().over(Window.partitionBy("repeat", "y").orderBy(F.md5(F.concat_ws(":", F.lit(L.SEED), "repeat", F.col("id").cast("string"))), "id")) - 1
    want = whole.withColumn("repeat", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("fold", F.pmod(place, F.lit(5)))
    ids = lambda d: sorted(map(str, d.select("repeat", "fold", "id").collect()))
    got = L.folded(whole, 2, 5)
    assert got.columns == want.columns and ids(got) == ids(want)
