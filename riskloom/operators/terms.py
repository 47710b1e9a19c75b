"""Terms that speak for a class: weights of a multinomial logistic regression on TF-IDF fitted inside each fold.

A split is one fold of one repeat; its training documents are those of the other folds of its repeat. Words are
counted once a document, and what a split's training part holds of a term follows by subtraction from totals,
so no split reads the texts again. Losses and slopes are summed where the documents lie; weights of classes
times at most VOCABULARY terms a split come to the driver, and nothing that grows with the documents.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from riskloom.operators.evidence import small, stored

# Least documents, largest share of documents, size of a vocabulary, terms shown a class, inverse strength of the penalty.
LEAST, LARGEST, VOCABULARY, SHOWN, C = 2, 0.9, 200_000, 30, 1.0
CLEARED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Terms a block of slopes; steps at most, those remembered, the largest slope that counts as flat.
BLOCK, STEPS, MEMORY, FLAT = 4096, 300, 6, 1e-5
#: Terms of rows that a task meets at a time.
MET = 1_000_000
#: Terms whose products straighten the steps, the curvature of a score they are first taken for (at even odds of three classes 1 / 3), and the step at which they are taken once more, for the curvature found by then.
HEAVY, CURVE, AGAIN = 700, 0.15, 12


def grams(words: Column) -> Column:
    """Words and pairs of neighbours, in an array; repeats stay."""
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(words, pairs)


def term_counts(docs: DataFrame, words: Column, *carried: str) -> DataFrame:
    """(doc_id, carried columns, term, c) of every document; null texts and texts without words give no rows.

    Texts are dealt by document first, so terms are counted where their text lies."""
    own = docs.repartition("doc_id").select("doc_id", *carried, F.explode(grams(words)).alias("term"))
    return own.groupBy("doc_id", *carried, "term").agg(F.count(F.lit(1)).alias("c"))


def vocabularies(counts: DataFrame, splits: DataFrame, least: int = LEAST, largest: float = LARGEST, size: int = VOCABULARY, folds: int = 0) -> DataFrame:
    """(split, term, df, n, at): the terms of each split's training documents, at most `size`, placed by name from 0.

    Terms in fewer than `least` or in more than a share of `largest` of them are out; of the rest the most
    frequent stay, ties by name. The cut follows from how many terms have each total, so no task sorts a
    vocabulary to find it. counts: with `own`, the splits that hold a document back, where they are known; folds: splits from 0 that
    have a vocabulary though no document is held back."""
    held = splits.groupBy("rep", "split").agg(F.count(F.lit(1)).alias("own")).collect()  # a row a split
    held += [Row(rep=0, split=k, own=0) for k in range(folds) if k not in {r["split"] for r in held}]
    per_rep: dict = defaultdict(int)
    for r in held:
        per_rep[r["rep"]] += r["own"]
    if "own" not in counts.columns:
        counts = counts.join(small(splits.groupBy("doc_id").agg(F.collect_list("split").alias("own"))), "doc_id")
    sums = [F.count(F.lit(1)).alias("d"), F.sum("c").alias("s")]
    for i, r in enumerate(held):
        mine = F.array_contains("own", F.lit(r["split"]))
        sums += [F.count(F.when(mine, 1)).alias(f"d{i}"), F.sum(F.when(mine, F.col("c")).otherwise(0)).alias(f"s{i}")]
    total = counts.groupBy("term").agg(*sums).where(F.col("d") >= least)
    each = [F.struct(F.lit(r["split"]).alias("split"), F.lit(per_rep[r["rep"]] - r["own"]).cast("long").alias("n"), (F.col("d") - F.col(f"d{i}")).alias("df"), (F.col("s") - F.col(f"s{i}")).alias("total")) for i, r in enumerate(held)]
    trained = total.select("term", F.explode(F.array(*each)).alias("x")).select("x.split", "term", "x.n", "x.df", "x.total")
    trained = stored(trained.where((F.col("df") >= least) & (F.col("df") <= F.lit(largest) * F.col("n"))))
    tally = trained.groupBy("split", "total").agg(F.count(F.lit(1)).alias("m"))
    down = Window.partitionBy("split").orderBy(F.desc("total"))
    tally = tally.select("split", "total", "m", (F.sum("m").over(down) - F.col("m")).alias("above"))
    cuts = tally.where((F.col("above") < size) & (F.col("above") + F.col("m") >= size)).select("split", F.col("total").alias("cut"), "above").collect()  # a row a split at most
    out = trained
    for row in cuts:
        own, edge = F.col("split") == row["split"], F.col("total") == row["cut"]
        ties = trained.where(own & edge).orderBy("term").limit(size - row["above"]).select("split", "term")
        out = out.where(~own | (F.col("total") > row["cut"])).unionByName(trained.where(own & edge).join(ties, ["split", "term"], "left_semi"))
    # at most `size` rows a split
    return out.withColumn("at", F.row_number().over(Window.partitionBy("split").orderBy("term")) - 1).select("split", "term", "df", "n", "at")


def vectors(counts: DataFrame, splits: DataFrame, numbers: DataFrame) -> DataFrame:
    """(label, own, at, tf): a row a document, with the splits that hold it back and 1 + ln c by number of term
    (numbers: term, no).

    A document without a known term has empty arrays; it is trained on, too."""
    known = counts.join(small(numbers.select("term", "no")), "term").select("doc_id", F.struct("no", (1 + F.log("c")).cast("float").alias("tf")).alias("x"))
    own = splits.groupBy("doc_id").agg(F.min("label").alias("label"), F.collect_list("split").alias("own"))
    v = own.join(known.groupBy("doc_id").agg(F.collect_list("x").alias("a")), "doc_id", "left")
    v = v.withColumn("a", F.coalesce("a", F.array().cast("array<struct<no:int,tf:float>>")))
    return v.select("label", "own", F.col("a.no").alias("at"), F.col("a.tf").alias("tf"))


def _packed(sent):
    """Per task: its rows in blocks of some MET terms, as bytes. lengths: terms of a row; y, own, norm: class, weight
    (nought where held back) and length of the TF-IDF vector of each row, problem by problem."""

    def packed(batches):
        at, tf = ([x.column(name) for x in batches] for name in ("at", "tf"))
        lengths = np.concatenate([x.value_lengths().to_numpy(zero_copy_only=False) for x in at]).astype(np.int32)
        at, tf = (np.concatenate([x.flatten().to_numpy() for x in parts]) for parts in (at, tf))
        doc = np.repeat(np.arange(len(lengths)), lengths)
        labels, owns = ([v for x in batches for v in x.column(name).to_pylist()] for name in ("label", "own"))
        y, own, norm = (np.zeros((len(sent.value), len(lengths)), kind) for kind in (np.int32, float, float))
        for i, (split, _, classes, idf) in enumerate(sent.value):
            place = [classes.get(label, (0, 0.0)) for label in labels]
            y[i], own[i] = [k for k, _ in place], [x if split not in out else 0.0 for (_, x), out in zip(place, owns)]
            norm[i] = np.sqrt(np.bincount(doc, (tf * idf[at]) ** 2, len(lengths)))
        norm[norm == 0] = 1
        block = {"lengths": lengths, "at": at.astype(np.int32), "tf": tf.astype(np.float32), "y": y, "own": own, "norm": norm}
        return pa.RecordBatch.from_pydict({name: pa.array([x.tobytes()], pa.binary()) for name, x in block.items()})

    def run(batches):
        waiting, size = [], 0
        for batch in batches:
            step = max(1, batch.num_rows * MET // max(MET, len(batch.column("at").flatten())))
            for start in range(0, batch.num_rows, step):
                waiting.append(batch.slice(start, step))
                size += len(waiting[-1].column("at").flatten())
                if size >= MET:
                    yield packed(waiting)
                    waiting, size = [], 0
        if waiting:
            yield packed(waiting)

    return run


def _blocks(batches, problems: int):
    """Lengths, at, tf, y, own and norm of each block that `_packed` made."""
    kinds = {"lengths": np.int32, "at": np.int32, "tf": np.float32, "y": np.int32, "own": float, "norm": float}
    for batch in batches:
        for i in range(batch.num_rows):
            x = {name: np.frombuffer(batch.column(name)[i].as_buffer(), kind) for name, kind in kinds.items()}
            yield x["lengths"], x["at"].astype(np.int64), x["tf"], *(x[name].reshape(problems, -1) for name in ("y", "own", "norm"))


def _ranges(sums: np.ndarray):
    """Columns of sums by BLOCK, where there is anything; single floats, as they are added in double by few tasks."""
    for start in range(0, sums.shape[1], BLOCK):
        part = sums[:, start : start + BLOCK]
        if part.any():
            yield start, part.astype(np.float32).tobytes()


def _sums(rows):
    """Numbers by their place: 64-bit floats below 0, 32-bit floats from 0 on."""
    return pa.RecordBatch.from_pydict({"start": pa.array([k for k, _ in rows], pa.int32()), "g": pa.array([x for _, x in rows], pa.binary())})


def _logs(lengths, at, tf, w, bias, norm) -> np.ndarray:
    """Log probabilities of a block's rows by class; the weights of the last class are minus the others' sum."""
    full, scores = lengths > 0, np.zeros((len(lengths), len(w) + 1))
    starts = (np.cumsum(lengths, dtype=np.int64) - lengths)[full]
    for k in range(len(w)):
        if len(starts):
            scores[full, k] = np.add.reduceat(w[k].take(at) * tf, starts)
        scores[:, k] = scores[:, k] / norm + bias[k]
    scores[:, -1] = -scores[:, :-1].sum(1)
    top = scores.max(1)
    return scores - (top + np.log(np.exp(scores - top[:, None]).sum(1)))[:, None]


def _slopes(sent, problems: int):
    """Per task: sums of loss and slope over its rows, in blocks of BLOCK terms; only blocks that rows touch.

    sent: (problem, weights times idf by class and term, biases) of each problem that still goes down. All classes'
    weights and slopes add up to nought, so those of the last class are left out."""

    def run(batches):
        asked = [(p, w.astype(float), bias) for p, w, bias in sent.value]
        edges = np.cumsum([0] + [len(w) for _, w, _ in asked])
        loss, biases, slope = np.zeros(len(asked)), np.zeros(edges[-1]), np.zeros((edges[-1], asked[0][1].shape[1]))
        for lengths, at, tf, y, own, norm in _blocks(batches, problems):
            n = np.arange(len(lengths))
            for i, (p, w, bias) in enumerate(asked):
                logs = _logs(lengths, at, tf, w, bias, norm[p])
                loss[i] -= own[p] @ logs[n, y[p]]
                left = own[p][:, None] * (np.exp(logs) - (y[p][:, None] == np.arange(len(w) + 1)))
                for k in range(len(w)):
                    slope[edges[i] + k] += np.bincount(at, np.repeat(left[:, k] / norm[p], lengths) * tf, slope.shape[1])
                biases[edges[i] : edges[i + 1]] += left[:, :-1].sum(0)
        yield _sums([(-1, np.append(loss, biases).tobytes()), *_ranges(slope)])

    return run


def _bends(heavy: np.ndarray, width: int, problems: int, sums: list[float], sent=None):
    """Per task: sums of products of the `heavy` terms and of a column of ones, over its rows, and of squares of
    each term. Rows weigh as they do on average over all problems, without idf, times the curvature of their
    scores; sent: where that is taken, as `_slopes` has it, or CURVE stands for it."""

    def run(batches):
        place = np.full(width, -1)
        place[heavy] = np.arange(len(heavy))
        products, squares = np.zeros((len(heavy) + 1, len(heavy) + 1)), np.zeros((1, width))
        asked = [(p, w.astype(float), bias) for p, w, bias in sent.value] if sent else []
        for lengths, at, tf, _, own, norm in _blocks(batches, problems):
            doc = np.repeat(np.arange(len(lengths)), lengths)
            if asked:
                curved = [own[p] / sums[p] * (1 - np.exp(2 * _logs(lengths, at, tf, w, bias, norm[p])).sum(1)) / len(w) for p, w, bias in asked]
                weight = np.mean(curved, 0)
            else:
                weight = CURVE * (own / np.array(sums)[:, None]).mean(0)
            v = tf * (1 / norm).mean(0)[doc]
            squares[0] += np.bincount(at, weight[doc] * v**2, width)
            for start in range(0, len(lengths), 1000):  # a thousand rows are made dense at a time
                own_terms = slice(*np.searchsorted(doc, (start, start + 1000)))
                known = place[at[own_terms]] >= 0
                dense = np.zeros((min(1000, len(lengths) - start), len(heavy) + 1))
                dense[doc[own_terms][known] - start, place[at[own_terms][known]]] = v[own_terms][known]
                dense[:, -1] = 1
                products += dense.T @ (weight[start : start + 1000, None] * dense)
        yield _sums([*((-1 - i, x.tobytes()) for i, x in enumerate(products)), *_ranges(squares)])

    return run


def _added(batches):
    total: dict = {}
    for batch in batches:
        for start, g in zip(batch.column("start").to_pylist(), batch.column("g")):
            x = np.frombuffer(g.as_buffer(), float if start < 0 else np.float32).astype(float)
            total[start] = total[start] + x if start in total else x
    if total:
        yield _sums([(k, x.tobytes() if k < 0 else x.astype(np.float32).tobytes()) for k, x in total.items()])


def _summed(rows: DataFrame, run) -> dict[int, np.ndarray]:
    """Sums of what `run` gives a task, by place: added in the cluster, a row a place comes to the driver. Shuffle
    files go when the job is over, as a fit has many."""
    spark, schema = rows.sparkSession, "start int, g binary"
    before = spark.conf.get(CLEARED, "false")
    spark.conf.set(CLEARED, "true")
    try:
        tasks = rows.mapInArrow(run, schema).repartition(max(1, spark.sparkContext.defaultParallelism), "start")
        return {r["start"]: np.frombuffer(r["g"], float if r["start"] < 0 else np.float32) for r in tasks.mapInArrow(_added, schema).collect()}
    finally:
        spark.conf.set(CLEARED, before)


def _spread(found: dict[int, np.ndarray], height: int, width: int) -> np.ndarray:
    out = np.zeros((height, width), np.float32)
    for start, g in found.items():
        if start >= 0:
            out[:, start : start + BLOCK] = g.reshape(height, -1)
    return out


def _inner(a: np.ndarray, b: np.ndarray) -> float:
    """The inner product over all classes, of which the last one is minus the others' sum."""
    return float((a * b).sum(dtype=float) + (a.sum(0) * b.sum(0)).sum(dtype=float))


def _descent(shape: tuple, straight: dict, p: int):
    """L-BFGS: yields places, is sent the loss and slope there, returns the last place. straight[p]: slopes times a
    guess at the inverse curvature, that is right for the commonest terms and so saves most steps."""
    x = np.zeros(shape, np.float32)
    now, slope = yield x
    history: list = []
    for _ in range(STEPS):
        if max(np.abs(slope).max(), np.abs(slope.sum(0)).max()) < FLAT:
            break
        way, taken = slope.copy(), []
        for s, y, sy in reversed(history):
            taken.append(_inner(s, way) / sy)
            way -= taken[-1] * y
        way = straight[p](way) * (history[-1][2] / _inner(history[-1][1], straight[p](history[-1][1])) if history else 1.0)
        for (s, y, sy), a in zip(history, reversed(taken)):
            way += (a - _inner(y, way) / sy) * s
        rate, down = 1.0, _inner(slope, way)
        while True:
            there = yield x - rate * way
            if there[0] <= now - 1e-4 * rate * down or rate < 1e-8:
                break
            rate *= min(0.5, max(0.1, rate * down / (2 * (there[0] - now + rate * down))))  # the least of a parabola
        if there[0] >= now:  # no lower at the precision of sums
            break
        s, y = -rate * way, there[1] - slope
        x, (now, slope) = x + s, there
        if (sy := _inner(s, y)) > 0:
            history = [*history[1 - MEMORY :], (s, y, sy)]
        del s, y, way, there  # this waits beside the other problems for its turn
    return x


def _inverses(sent, heavy: np.ndarray):
    """Per task: inverse curvatures of `heavy` terms and the bias, for the problems it is given by number. In tasks,
    as threads of a linear algebra library may stop in a driver that forks."""

    def run(batches):
        problems, products, ridges = sent.value
        for batch in batches:
            for p in batch.column("problem").to_pylist():
                scale, ridge = np.append(problems[p][3][heavy], 1.0), np.append(np.full(len(heavy), ridges[p]), 0.0) + 1e-9
                yield _sums([(p, np.linalg.inv(products * scale * scale[:, None] + np.diag(ridge)).astype(np.float32).tobytes())])

    return run


def _straightened(heavy: np.ndarray, inverse: np.ndarray, rest: np.ndarray):
    at = np.append(heavy, len(rest))

    def run(slope):
        out = slope * np.append(rest, np.float32(0))
        out[:, at] = np.einsum("ij,jk->ik", slope[:, at], inverse)
        return out

    return run


def fitted(rows: DataFrame, problems: list[tuple], sums: list[float], c: float = C) -> list[np.ndarray]:
    """Weights (classes x terms, and a last column of biases) of each problem: multinomial logistic regression
    with a penalty of weight 1 / (2 c) beside the weighted losses, biases free.

    rows as `vectors` gives them; problems: split, a number, classes with place and weight, idf by term, nought
    outside the split's vocabulary; sums: weights of each one's rows. Rows are packed once. Each problem goes down by
    L-BFGS of its own until its slope is flat; a step of all of them is one job that adds slopes by block of terms,
    with no more tasks than cores, as each gives a slope. The products of the HEAVY commonest terms, of one more job,
    straighten the steps; they don't touch the minimum. Spark ML's learner scales rare terms up first, and with a
    penalty on the terms as they are it took 400 steps a problem."""
    context, width = rows.sparkSession.sparkContext, len(problems[0][3])
    few, ridges = max(1, context.defaultParallelism), [1 / (c * n) for n in sums]
    given = context.broadcast(problems)  # five or so times VOCABULARY numbers
    packed = rows.select("label", "own", "at", "tf").coalesce(few).mapInArrow(_packed(given), ", ".join(f"{x} binary" for x in ("lengths", "at", "tf", "y", "own", "norm")))
    rows = stored(packed).coalesce(few)
    given.destroy()
    common = sum(idf**2 * np.exp(-idf) for _, _, _, idf in problems)  # exp(-idf) is as the share of documents
    heavy = np.sort(np.argsort(-common, kind="stable")[:HEAVY])
    numbers = rows.sparkSession.range(0, len(problems), 1, min(len(problems), few)).selectExpr("cast(id as int) problem")
    places: dict = {p: np.zeros((len(classes) - 1, width + 1), np.float32) for p, (_, _, classes, _) in enumerate(problems)}
    straight: dict = {}

    def bend(sent=None):
        found = _summed(rows, _bends(heavy, width, len(problems), sums, sent))
        products, squares = np.stack([found[-1 - i] for i in range(len(heavy) + 1)]), _spread(found, 1, width)[0]
        given = context.broadcast((problems, products, ridges))
        for p, x in _summed(numbers, _inverses(given, heavy)).items():
            straight[p] = _straightened(heavy, x.reshape(products.shape), (1 / (squares * problems[p][3] ** 2 + ridges[p])).astype(np.float32))
        given.destroy()

    bend()
    ways, out = [_descent(x.shape, straight, p) for p, x in places.items()], [None] * len(problems)
    for way in ways:
        next(way)
    for step in itertools.count():
        sent = context.broadcast([(p, (x[:, :-1] * problems[p][3]).astype(np.float32), x[:, -1]) for p, x in places.items()])
        if step == AGAIN:
            bend(sent)
        found = _summed(rows, _slopes(sent, len(problems)))
        sent.destroy()
        edges = np.cumsum([0] + [len(x) for x in places.values()])
        losses, biases, slopes = found[-1][: len(places)], found[-1][len(places) :], _spread(found, edges[-1], width)
        for i, (p, x) in enumerate(list(places.items())):
            n, w = sums[p], x[:, :-1]
            slope = np.c_[slopes[edges[i] : edges[i + 1]] * problems[p][3] / n + w * ridges[p], biases[edges[i] : edges[i + 1]] / n].astype(np.float32)
            try:
                places[p] = ways[p].send((losses[i] / n + _inner(w, w) * ridges[p] / 2, slope))
            except StopIteration as end:
                out[p] = np.r_[end.value, -end.value.sum(0, keepdims=True)].astype(float)
                del places[p]
        if not places:
            return out


def fitted_top_terms(docs: DataFrame, words: Column, splits: DataFrame, shown: int = SHOWN, **limits) -> DataFrame:
    """label, term, mean, folds, place: per class the `shown` terms of the largest mean weight over all splits.

    splits: doc_id, label, rep, split, a document once a repeat; other documents take no part. A term that a
    split's vocabulary lacks counts as weight 0 there; folds says how many have it. Ties in weight go by term.
    A class without training documents in a split has weight 0 there; without two classes nothing is fitted,
    and without any fitted split there are no rows."""
    spark = docs.sparkSession
    splits = stored(splits.where("label is not null").select("doc_id", "label", "rep", "split"))
    own = splits.groupBy("doc_id").agg(F.collect_list("split").alias("own"))
    counts = stored(term_counts(docs.join(own, "doc_id"), words, "own"))
    empty = spark.createDataFrame([], "label string, term string, mean double, folds long, place long")
    if splits.isEmpty() or counts.isEmpty():
        return empty
    vocabulary = stored(vocabularies(counts, splits, **limits).drop("at"))
    # one number a term over all splits; splits times VOCABULARY terms at most
    places_of = [r["split"] for r in splits.select("split").distinct().orderBy("split").collect()]  # a number a split
    idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1
    by_split = F.array(*(F.coalesce(F.max(F.when(F.col("split") == s, idf)), F.lit(0.0)) for s in places_of)).alias("idf")
    numbers = stored(vocabulary.groupBy("term").agg(F.count(F.lit(1)).alias("folds"), by_split).withColumn("no", F.row_number().over(Window.orderBy("term")) - 1))
    by_term = numbers.select("no", "idf").toArrow()
    width = by_term.num_rows
    if not width:
        return empty
    known = np.zeros((len(places_of), width))
    known[:, by_term["no"].to_numpy()] = by_term["idf"].combine_chunks().flatten().to_numpy().reshape(width, -1).T
    del by_term
    held = splits.groupBy("rep", "split", "label").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a split and class
    each = sorted({(r["rep"], r["split"]) for r in held})
    problems, sums, means = [], [], {r["label"]: np.zeros(width) for r in held}
    for rep, split in each:
        sizes: dict = defaultdict(int)
        for r in held:
            if r["rep"] == rep and r["split"] != split:
                sizes[r["label"]] += r["n"]
        n = sum(sizes.values())
        place = places_of.index(split)
        if len(sizes) > 1 and known[place].any():
            problems.append((split, place, {label: (i, n / (len(sizes) * sizes[label])) for i, label in enumerate(sorted(sizes))}, known[place]))
            sums.append(float(n))
    if problems:
        for (_, _, classes, _), w in zip(problems, fitted(vectors(counts, splits, numbers), problems, sums)):
            for label, (i, _) in classes.items():
                means[label] += w[i, :-1]
    best = []
    for label, m in means.items():
        m /= len(each)
        least = np.sort(m)[-min(shown, len(m))]
        best += [(label, int(i), float(m[i])) for i in np.flatnonzero(m >= least)]
    named = spark.createDataFrame(best, "label string, no int, mean double").join(numbers, "no")
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("mean"), "term"))
    return named.withColumn("place", place.cast("long")).where(F.col("place") <= shown).select("label", "term", "mean", F.col("folds").cast("long").alias("folds"), "place")
