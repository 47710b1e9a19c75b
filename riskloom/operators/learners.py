"""Repeated cross-validation of learners over array features: logistic regression, RBF kernel machine, forest,
ridge regression; tuning inside the training fold; probes of several targets.

A fold's model is fitted in one task on at most MOST training rows (the lowest id hashes; a kernel is quadratic
in them). The models, bounded in size, then travel to the rows, wherever these lie: every row is tested once
in each repeat, and no row meets the training rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Repeats and folds, the seed, C values tried, inner folds, folds of the calibration.
REPEATS, FOLDS, SEED, GRID, INNER, CALIBRATION = 5, 5, 42, (0.01, 0.1, 1.0, 10.0, 100.0), 3, 5
MOST = 2000
#: Slices within which rows of a stratum are ranked; rows a part of the forest's table has, and its parts at most (each sends sums of all trees).
SLICES, PART_ROWS, PARTS = 256, 8192, 24


def folded(rows: DataFrame, repeats: int = REPEATS, k: int = FOLDS, series: str | None = None, strata: str = "y") -> DataFrame:
    """rows (id, x, y) with repeat and fold: stratified by `strata`, or with all rows of a series in one fold.

    Series are dealt in turn, largest first, there and back, so that folds stay level."""
    order = lambda key: F.md5(F.concat_ws(":", F.lit(SEED), "repeat", key))
    every = rows.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    if series is None:
        # ranks within slices of the order plus the rows of earlier slices, so that no task ranks a whole stratum
        every = every.withColumn("_order", order(F.col("id").cast("string"))).withColumn("_slice", F.coalesce(F.conv(F.substring("_order", 1, 2), 16, 10).cast("int"), F.lit(-1)))
        held = every.groupBy("repeat", strata, "_slice").agg(F.count(F.lit(1)).alias("_n"))  # SLICES rows a stratum and repeat
        gone = F.coalesce(F.sum("_n").over(Window.partitionBy("repeat", strata).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        held = held.select(F.col("repeat").alias("_repeat"), F.col(strata).alias("_strata"), F.col("_slice").alias("_of"), gone.alias("_gone"))
        rank = F.row_number().over(Window.partitionBy("repeat", strata, "_slice").orderBy("_order", "id")) - 1
        every = every.withColumn("_rank", rank).join(F.broadcast(held), (F.col("repeat") == F.col("_repeat")) & F.col(strata).eqNullSafe(F.col("_strata")) & (F.col("_slice") == F.col("_of")))
        return every.select(*rows.columns, "repeat", F.pmod((F.col("_gone") + F.col("_rank")).cast("int"), F.lit(k)).alias("fold"))
    sizes = every.groupBy("repeat", series).agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("repeat").orderBy(F.desc("n"), order(F.col(series).cast("string")))) - 1
    turn = F.pmod(place, F.lit(k))
    dealt = sizes.withColumn("fold", F.when(F.floor(place / k) % 2 == 0, turn).otherwise(k - 1 - turn)).drop("n")
    return every.join(dealt, ["repeat", series])


def standard(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of each column; a constant column keeps its scale."""
    sd = x.std(0)
    return x.mean(0), np.where(sd > 0, sd, 1.0)


def balanced(y: np.ndarray) -> np.ndarray:
    """Row weights under which all classes count alike and the mean is 1."""
    classes, at, n = np.unique(y, return_inverse=True, return_counts=True)
    return (len(y) / (len(classes) * n))[at]


def shares(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Logistic:
    """Multinomial logistic regression with an L2 penalty of 1 / C, by Newton's method with halved steps."""

    def __init__(self, c: float = 1.0, steps: int = 50):
        self.c, self.steps = c, steps

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        self.mean, self.sd = standard(x)
        z = np.c_[(x - self.mean) / self.sd, np.ones(len(x))]
        self.classes = np.unique(y)
        t, w, (n, d), k = (y[:, None] == self.classes).astype(float), balanced(y), z.shape, len(self.classes)
        penalty = np.r_[np.full(d - 1, 1 / self.c), 1e-9]  # the bias is free

        def loss(b):
            p = shares(z @ b)
            return -(w * np.log(np.maximum((p * t).sum(1), 1e-300))).sum() + 0.5 * (penalty[:, None] * b * b).sum(), p

        b = np.zeros((d, k))
        best, p = loss(b)
        for _ in range(self.steps):
            slope = z.T @ (w[:, None] * (p - t)) + penalty[:, None] * b
            if np.abs(slope).max() < 1e-7 * n:
                break
            bend = np.zeros((k, d, k, d))
            for i in range(k):
                for j in range(k):
                    bend[i, :, j, :] = z.T @ (z * (w * p[:, i] * ((i == j) - p[:, j]))[:, None])
                bend[i, np.arange(d), i, np.arange(d)] += penalty + 1e-8
            step = np.linalg.solve(bend.reshape(k * d, k * d), slope.T.ravel()).reshape(k, d).T
            rate = 1.0
            while rate > 1e-6 and (now := loss(b - rate * step))[0] > best:
                rate /= 2
            if rate <= 1e-6:
                break
            b, (best, p) = b - rate * step, now
        self.weights = b
        return self

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return shares(np.c_[(x - self.mean) / self.sd, np.ones(len(x))] @ self.weights)


def smo(kernel: np.ndarray, sign: np.ndarray, limit: np.ndarray, tolerance: float = 1e-3, most: int = 20_000) -> tuple[np.ndarray, float]:
    """Multipliers and bias of a soft-margin machine: the pair that violates optimality most is solved exactly."""
    a, slope = np.zeros(len(sign)), -np.ones(len(sign))
    for _ in range(most):
        gain = -sign * slope
        up, down = np.where(sign > 0, a < limit, a > 0), np.where(sign > 0, a > 0, a < limit)
        i, j = int(np.argmax(np.where(up, gain, -np.inf))), int(np.argmin(np.where(down, gain, np.inf)))
        if gain[i] - gain[j] < tolerance:
            break
        bend = max(kernel[i, i] + kernel[j, j] - 2 * kernel[i, j], 1e-12)
        step = (gain[i] - gain[j]) / bend
        step = min(step, limit[i] - a[i] if sign[i] > 0 else a[i], a[j] if sign[j] > 0 else limit[j] - a[j])
        a[i] += sign[i] * step
        a[j] -= sign[j] * step
        slope += sign * step * (kernel[:, i] - kernel[:, j])
    gain = -sign * slope
    free = (a > 1e-8) & (a < limit - 1e-8)
    return a, float(gain[free].mean() if free.any() else (gain[i] + gain[j]) / 2)


def sigmoid(score: np.ndarray, hit: np.ndarray) -> tuple[float, float]:
    """Slope and offset of Platt's sigmoid, fitted to smoothed targets by Newton's method."""
    n, m = hit.sum(), (~hit).sum()
    target = np.where(hit, (n + 1) / (n + 2), 1 / (m + 2))
    z, b = np.c_[score, np.ones(len(score))], np.array([0.0, np.log((n + 1) / (m + 1))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -35, 35)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + 1e-9 * np.eye(2), z.T @ (p - target))
        b -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), float(b[1])


class KernelMachine:
    """RBF support vector machine, one against one, with Platt's calibration by cross-validation."""

    def __init__(self, c: float = 1.0, calibration: int = CALIBRATION):
        self.c, self.calibration = c, calibration

    def _kernel(self, x: np.ndarray, other: np.ndarray) -> np.ndarray:
        return np.exp(-self.gamma * np.maximum((x * x).sum(1)[:, None] + (other * other).sum(1) - 2 * x @ other.T, 0))

    def _machines(self, kernel: np.ndarray, y: np.ndarray):
        limit = self.c * balanced(y)
        for i in range(len(self.classes)):
            for j in range(i + 1, len(self.classes)):
                at = np.flatnonzero((y == self.classes[i]) | (y == self.classes[j]))
                sign = np.where(y[at] == self.classes[i], 1.0, -1.0)
                if not len(at) or abs(sign.sum()) == len(at):
                    yield i, j, at, np.zeros(len(at)), float(np.sign(sign.sum()))
                    continue
                a, bias = smo(kernel[np.ix_(at, at)], sign, limit[at])
                yield i, j, at, a * sign, bias

    @staticmethod
    def _scores(kernel: np.ndarray, machines, classes: int) -> np.ndarray:
        """Votes of the pairs, ordered within equal votes by the sum of their bounded confidences."""
        votes, sure = np.zeros((len(kernel), classes)), np.zeros((len(kernel), classes))
        for i, j, at, a, bias in machines:
            f = kernel[:, at] @ a + bias
            votes[:, i] += f > 0
            votes[:, j] += f <= 0
            sure[:, i] += f
            sure[:, j] -= f
        return votes + sure / (3 * (np.abs(sure) + 1))

    def fit(self, x: np.ndarray, y: np.ndarray) -> KernelMachine:
        self.mean, self.sd = standard(x)
        self.x = (x - self.mean) / self.sd
        self.gamma = 1 / (self.x.shape[1] * self.x.var()) if self.x.var() else 1.0
        self.classes = np.unique(y)
        k = len(self.classes)
        kernel, out = self._kernel(self.x, self.x), np.zeros((len(y), k))
        rank = np.zeros(len(y), int)
        for c in self.classes:
            at = np.flatnonzero(y == c)
            rank[at] = np.arange(len(at))
        for part in range(self.calibration):
            test, train = np.flatnonzero(rank % self.calibration == part), np.flatnonzero(rank % self.calibration != part)
            if len(test) and len(train):
                out[test] = self._scores(kernel[np.ix_(test, train)], self._machines(kernel[np.ix_(train, train)], y[train]), k)
        self.platt = [sigmoid(out[:, i], y == c) for i, c in enumerate(self.classes)]
        self.machines = [*self._machines(kernel, y)]
        return self

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        s = self._scores(self._kernel((x - self.mean) / self.sd, self.x), self.machines, len(self.classes))
        p = np.column_stack([1 / (1 + np.exp(-(a * s[:, i] + b))) for i, (a, b) in enumerate(self.platt)])
        return p / np.maximum(p.sum(1, keepdims=True), 1e-300)


class Ridge:
    """Least squares with a penalty on all but the offset; `probabilities` has its one prediction."""

    classes = np.array([0])

    def __init__(self, penalty: float = 1.0):
        self.penalty = penalty

    def fit(self, x: np.ndarray, y: np.ndarray) -> Ridge:
        self.mean, self.level = x.mean(0), y.mean()
        z = x - self.mean
        self.weights = np.linalg.solve(z.T @ z + self.penalty * np.eye(x.shape[1]), z.T @ (y - self.level))
        return self

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) @ self.weights + self.level)[:, None]


class Majority:
    """Class shares of the training rows."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Majority:
        self.classes, n = np.unique(y, return_counts=True)
        self.shares = n / n.sum()
        return self

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return np.tile(self.shares, (len(x), 1))


def macro_f1(true: np.ndarray, said: np.ndarray) -> float:
    """Mean F1 of the classes that are true or said; of a class without either there is none."""
    f1 = [2 * ((true == c) & (said == c)).sum() / ((true == c).sum() + (said == c).sum()) for c in np.union1d(true, said)]
    return float(np.mean(f1))


def chosen(model: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The likeliest class, the higher one of equals."""
    return classes[len(classes) - 1 - np.argmax(model[:, ::-1], axis=1)]


class Tuned:
    """A learner with the C of GRID that does best in inner stratified folds; of equals the smaller C."""

    def __init__(self, make: Callable = Logistic, grid: tuple[float, ...] = GRID, inner: int = INNER):
        self.make, self.grid, self.inner = make, grid, inner

    def fit(self, x: np.ndarray, y: np.ndarray) -> Tuned:
        rank = np.zeros(len(y), int)
        for c in np.unique(y):
            at = np.flatnonzero(y == c)
            rank[at] = np.arange(len(at)) % self.inner

        def worth(c: float) -> float:
            got = []
            for part in range(self.inner):
                m = self.make(c).fit(x[rank != part], y[rank != part])
                got.append(macro_f1(y[rank == part], chosen(m.probabilities(x[rank == part]), m.classes)))
            return round(float(np.mean(got)), 12)

        self.c = max(self.grid, key=lambda c: (worth(c), -c))
        self.model = self.make(self.c).fit(x, y)
        self.classes = self.model.classes
        return self

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self.model.probabilities(x)


TESTED = "repeat int, fold int, id long, y double, chosen double, p array<double>, c double"


def tested(rows: DataFrame, make: Callable, repeats: int = REPEATS, k: int = FOLDS, most: int = MOST, series: str | None = None, strata: str = "y") -> DataFrame:
    """rows (id long, x array<double>, y double) tested once in each repeat by a model of the other folds.

    chosen: the likeliest class (a ridge's prediction); p by class in ascending order; c: the tuned C."""
    data = folded(rows, repeats, k, series, strata)
    lows = rows.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(most)
    spread = data.join(F.broadcast(lows), "id").select("repeat", "fold", "x", "y", "id").withColumn("left_out", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).where("left_out <> fold")

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        model = make().fit(np.array(part["x"].tolist(), float), part["y"].to_numpy(float))
        return pd.DataFrame({"repeat": [key[0]], "left_out": [key[1]], "model": [pickle.dumps(model)]})

    fits = spread.groupBy("repeat", "left_out").applyInPandas(fit, "repeat int, left_out int, model binary")
    models = {(r["repeat"], r["left_out"]): bytes(r["model"]) for r in fits.collect()}  # a model a fold, bounded by `most`

    def run(batches):
        held = {}
        for pdf in batches:
            out = []
            for key, part in pdf.groupby(["repeat", "fold"]):
                if key not in models:
                    continue
                if key not in held:
                    held[key] = pickle.loads(models[key])
                m = held[key]
                p = m.probabilities(np.array(part["x"].tolist(), float))
                said = p[:, 0] if isinstance(m, Ridge) else chosen(p, m.classes)
                out.append(pd.DataFrame({"repeat": key[0], "fold": key[1], "id": part["id"], "y": part["y"], "chosen": said, "p": p.round(6).tolist(), "c": getattr(m, "c", None)}))
            if out:
                yield pd.concat(out).astype({"chosen": float, "c": float})

    return data.select("repeat", "fold", "id", "x", "y").mapInPandas(run, TESTED)


def probes(rows: DataFrame, targets: dict[str, str], make: Callable = Logistic, **how) -> DataFrame:
    """Macro-F1 by target and fold of a learner and of the majority; rows: id, x; targets: name -> expression of a class.

    A row without a target's value isn't asked about it; a target of one class has no probe."""
    out = None
    for name, expression in targets.items():
        own = rows.select("id", "x", F.expr(expression).cast("double").alias("y")).where("y is not null")
        if own.select("y").distinct().limit(2).count() < 2:
            continue
        for kind, learner in (("learner", make), ("majority", Majority)):
            got = tested(own, learner, **how)
            sides = got.select("repeat", "fold", F.explode(F.array(F.struct(F.col("y").alias("cls"), F.lit(1).alias("t"), F.lit(0).alias("s")), F.struct(F.col("chosen").alias("cls"), F.lit(0).alias("t"), F.lit(1).alias("s")))).alias("v"), (F.col("y") == F.col("chosen")).cast("int").alias("hit"))
            f1 = sides.groupBy("repeat", "fold", "v.cls").agg((F.sum("hit") / F.count(F.lit(1))).alias("f1")).groupBy("repeat", "fold").agg(F.avg("f1").alias("macro_f1"))
            f1 = f1.select(F.lit(name).alias("target"), F.lit(kind).alias("kind"), "repeat", "fold", F.round("macro_f1", 9).alias("macro_f1"))
            out = f1 if out is None else out.unionByName(f1)
    return out


def vectors(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("x"), (F.col("label") % 3).cast("double").alias("y"))


def cross_validated_logreg(embeddings: DataFrame) -> DataFrame:
    return tested(vectors(embeddings), Logistic)


def cross_validated_tuned(embeddings: DataFrame) -> DataFrame:
    return tested(vectors(embeddings), Tuned, repeats=1)


def cross_validated_kernel(embeddings: DataFrame) -> DataFrame:
    return tested(vectors(embeddings), KernelMachine, repeats=1, most=600)


def cross_validated_ridge(embeddings: DataFrame) -> DataFrame:
    rows = vectors(embeddings).withColumnRenamed("y", "third")
    return tested(rows.withColumn("y", F.col("third") * 10 + F.aggregate("x", F.lit(0.0), lambda a, v: a + v)), Ridge, strata="third")


def grouped_logreg(embeddings: DataFrame) -> DataFrame:
    """Folds of whole series (ids alike modulo 37)."""
    return tested(vectors(embeddings).withColumn("series", F.col("id") % 37), Logistic, repeats=1, series="series").drop("series")


def factor_probes(embeddings: DataFrame) -> DataFrame:
    rows = embeddings.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("x"), "label")
    return probes(rows, {"third": "label % 3", "half": "label div 5", "some": "case when id % 2 = 0 then label % 2 end", "one": "0"}, repeats=1)


def cross_validated_forest(embeddings: DataFrame, trees: int = 500, k: int = FOLDS) -> DataFrame:
    """Spark's forest, one fit a fold over all rows, classes weighed alike.

    Rows are dealt by id and sorted, so that a fit uses all cores and draws the same rows on any cluster."""
    rows = folded(vectors(embeddings), 1, k)
    n = rows.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    parts = max(1, min(PARTS, embeddings.count() // PART_ROWS))
    rows = rows.join(F.broadcast(n), "y").select("id", "fold", "y", array_to_vector("x").alias("v"), (1.0 / F.col("n")).alias("w"))  # n: a row for each class
    rows = rows.repartition(parts, "id").sortWithinPartitions("id", "y", "v").cache()
    out = None
    for fold in range(k):
        model = RandomForestClassifier(featuresCol="v", labelCol="y", weightCol="w", numTrees=trees, seed=SEED).fit(rows.where(F.col("fold") != fold))
        part = model.transform(rows.where(F.col("fold") == fold)).select("fold", "id", "y", F.transform(vector_to_array("probability"), lambda p: F.round(p, 6)).alias("p"))
        out = part if out is None else out.unionByName(part)
    return out
