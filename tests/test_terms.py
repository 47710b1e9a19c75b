"""Fitted top terms against TF-IDF in plain Python and Newton's method."""

import math
from collections import Counter

import numpy as np
from pyspark import SparkContext
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.learners import balanced, shares
from riskloom.operators.terms import fitted, fitted_top_terms, term_counts, vocabularies

WORDS = "alma barack citrom dinnye eper füge gomba hagyma".split()


def corpus(n=30):
    """Documents of three classes, each with a leaning to words of its own."""
    draw = np.random.default_rng(5)
    out = []
    for i in range(n):
        lean = np.ones(len(WORDS))
        lean[2 * (i % 3) : 2 * (i % 3) + 2] = 4
        out.append((i, " ".join(draw.choice(WORDS, 12, p=lean / lean.sum())), "abc"[i % 3]))
    return out


def plain_counts(text):
    words = text.split()
    return Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])


def newton(x, y, steps=40):
    """Weights of the penalised loss whose gradient is nought; the bias is free."""
    k, (n, d), w = 3, x.shape, balanced(y)
    z, t, pen = np.c_[x, np.ones(n)], np.eye(k)[y], np.r_[np.ones(d), 1e-9]
    b = np.zeros((d + 1, k))
    for _ in range(steps):
        p = shares(z @ b)
        slope = z.T @ (w[:, None] * (p - t)) + pen[:, None] * b
        bend = np.zeros((k, d + 1, k, d + 1))
        for i in range(k):
            for j in range(k):
                bend[i, :, j] = z.T @ (z * (w * p[:, i] * ((i == j) - p[:, j]))[:, None])
            bend[i, np.arange(d + 1), i, np.arange(d + 1)] += pen + 1e-9
        b = b - np.linalg.solve(bend.reshape(k * d + k, -1), slope.T.ravel()).reshape(k, d + 1).T
    return b[:-1].T


def brute(docs, split_of, size, splits=(0, 1, 2)):
    sums, held = {c: Counter() for c in "abc"}, Counter()
    for s in splits:
        train = [(plain_counts(t), c) for i, t, c in docs if split_of[i] != s]
        df, total = Counter(), Counter()
        for counts, _ in train:
            df.update(counts.keys())
            total.update(counts)
        names = sorted(sorted((t for t in df if 2 <= df[t] <= 0.9 * len(train)), key=lambda t: (-total[t], t))[:size])
        x = np.array([[(1 + math.log(c[t])) * (math.log((1 + len(train)) / (1 + df[t])) + 1) if c[t] else 0.0 for t in names] for c, _ in train])
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        w = newton(x, np.array(["abc".index(c) for _, c in train]))
        held.update(names)
        for k, c in enumerate("abc"):
            for t, v in zip(names, w[k]):
                sums[c][t] += v
    return {c: {t: v / len(splits) for t, v in sums[c].items()} for c in "abc"}, held


def frames(spark, docs):
    rows = spark.createDataFrame(docs, "doc_id long, text string, label string")
    splits = rows.where("label is not null").selectExpr("doc_id", "label", "0 rep", "cast(doc_id div 3 % 3 as int) split")
    return rows.select("doc_id", "text"), F.split("text", " "), splits


def test_terms_have_the_weights_of_an_exact_fit(spark):
    docs = corpus()
    rows, words, splits = frames(spark, docs)
    for size in (200_000, 17):
        got = fitted_top_terms(rows, words, splits, shown=5, size=size).collect()
        want, held = brute(docs, {i: i // 3 % 3 for i, _, _ in docs}, size)
        assert sorted((r["label"], r["place"]) for r in got) == [(c, p) for c in "abc" for p in range(1, 6)]
        for r in got:
            assert abs(r["mean"] - want[r["label"]][r["term"]]) < 2e-3 and r["folds"] == held[r["term"]]
            assert r["mean"] > sorted(want[r["label"]].values())[-r["place"]] - 4e-3


def test_a_vocabulary_is_cut_by_total_then_by_name(spark):
    docs = [(0, "x x y b", "a"), (1, "x y b c", "b"), (2, "x c y", "a"), (3, "q x b c", "b"), (4, "q q q q", "a"), (5, "z", "b")]
    rows, words, splits = frames(spark, docs)
    splits = splits.selectExpr("doc_id", "label", "rep", "cast(case when doc_id >= 4 then 1 else 0 end as int) split")
    counts = term_counts(rows, words)
    # split 1 trains on documents 0 to 3: x 5 (in all four, too many), b, c, y 3, then pairs
    names = {(r["term"], r["at"]) for r in vocabularies(counts, splits, size=2).where("split = 1").collect()}
    assert names == {("b", 0), ("c", 1)}


def test_odd_rows(spark):
    rows, words, splits = frames(spark, [(0, None, "a"), (1, "", "b"), (2, "x", "a"), (3, "y", None)])
    assert fitted_top_terms(rows, words, splits).collect() == []
    assert fitted_top_terms(rows.limit(0), words, splits.limit(0)).collect() == []
    docs = [(i, t, "a") for i, t, _ in corpus(12)]
    rows, words, splits = frames(spark, docs)
    assert {r["mean"] for r in fitted_top_terms(rows, words, splits).collect()} <= {0.0}  # one class: nothing to tell apart


def test_terms_are_counted_where_their_text_lies(spark):
    rows, words, _ = frames(spark, corpus())
    plan = term_counts(rows, words)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")  # texts move, not terms


def test_no_more_slopes_than_cores(spark):
    """Rows in many parts are met by as many tasks as there are cores; each gives slopes of all terms."""
    rows = spark.range(60).selectExpr("if(id % 2 = 0, 'a', 'b') label", "array(9) own", "array(1d) norms", "array(cast(id % 2 as int)) at", "array(1f) tf").repartition(50)
    parts = []
    real = DataFrame.mapInArrow
    DataFrame.mapInArrow = lambda self, *a, **k: parts.append(self.rdd.getNumPartitions()) or real(self, *a, **k)
    try:
        (w,) = fitted(rows, [(0, 0, {"a": (0, 1.0), "b": (1, 1.0)}, np.ones(2))], [60.0])
    finally:
        DataFrame.mapInArrow = real
    assert max(parts) <= spark.sparkContext.defaultParallelism and w[0, 0] > 1 > -1 > w[0, 1]


def test_a_fit_takes_few_steps(spark):
    """Common terms that stand in most rows don't make for many small steps; the minimum is that of an exact fit."""
    draw = np.random.default_rng(7)
    share = 1 / np.arange(1, 61)
    lean = {c: share * draw.uniform(0.7, 1.4, 60) for c in "abc"}
    counts = [np.bincount(draw.choice(60, 40, p=lean[c] / lean[c].sum()), minlength=60) for c in "abc" * 700]
    rows = [("abc"[i % 3], [9], [float(np.linalg.norm(x))], np.flatnonzero(x).tolist(), x[x > 0].astype(float).tolist()) for i, x in enumerate(counts)]
    rows = spark.createDataFrame(rows, "label string, own array<int>, norms array<double>, at array<int>, tf array<float>")
    asked = []
    real = SparkContext.broadcast
    SparkContext.broadcast = lambda self, x: asked.append(1) or real(self, x)
    try:
        (w,) = fitted(rows, [(0, 0, {c: (k, 1.0) for k, c in enumerate("abc")}, np.ones(60))], [2100.0])
    finally:
        SparkContext.broadcast = real
    x = np.array([c / np.linalg.norm(c) for c in counts])
    assert len(asked) <= 25 and np.abs(w[:, :-1] - newton(x, np.arange(2100) % 3)).max() < 0.02
