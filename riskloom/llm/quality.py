"""Operator 2: quality classifier - hashed word n-gram logistic regression, FTRL-proximal updates.

Features of a text: its words and word pairs as written, the shape of each word (last two bytes and
kind of first byte) and shape pairs, each word's last byte, and whether a word pair is one word twice,
all hashed into one table. A count c in a text of n words weighs c / sqrt(n). Learning reads at most
FIT_ROWS labelled documents and FIT_BYTES of their text (the smallest id hashes of those that the
caller lets learn); scoring is a sparse dot product over Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.base import fold, lean, released, text_or_empty
from riskloom.llm.kernels import SPACE, chunks, mix, span_hashes, words

BITS, FIT_ROWS, FIT_BYTES, EPOCHS, CUT = 18, 5000, 32 << 20, 5, 0.3
U = np.uint64


def features(data: np.ndarray, at: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed feature of every word n-gram, its row, and the number of words of each row."""
    s, e, row = words(data, at, ~SPACE)
    n = np.bincount(row, minlength=len(at) - 1)
    if not len(s):
        return np.zeros(0, np.int64), row, n
    w = span_hashes(data, s, e)
    kind = np.select([(data[s] >= 65) & (data[s] <= 90), data[s] >= 128, (data[s] >= 97) & (data[s] <= 122)], [1, 2, 3], 4)
    tail = data[e - 1].astype(U) * U(256) + data[np.maximum(e - 2, s)]
    shape = mix(tail * U(8) + kind.astype(U) + U(1 << 40))
    pair = np.flatnonzero(row[1:] == row[:-1])
    both = [mix(x[pair] * U(31) + x[pair + 1] + U(7 + i)) for i, x in enumerate((w, shape))]
    end = mix(data[e - 1].astype(U) + U(1 << 41))
    twice = mix((w[pair] == w[pair + 1]).astype(U) + U(1 << 42))
    idx = np.concatenate([w, shape, *both, end, twice]) >> U(64 - bits)
    return idx.astype(np.int64), np.concatenate([row, row, row[pair], row[pair], row, row[pair]]), n


def examples(rows: DataFrame, bits: int = BITS) -> DataFrame:
    """(label, indices, weights) of labelled rows, hashed on the executors; 4-byte numbers in binary."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, at in chunks(batch.column("text")):
                idx, row, n = features(data, at, bits)
                key, count = np.unique(row.astype(np.int64) << bits | idx, return_counts=True)
                edge = np.searchsorted(key, np.arange(hi - lo + 1, dtype=np.int64) << bits)
                scale = 1 / np.sqrt(np.maximum(n, 1))
                cols = [((key[a:b] & ((1 << bits) - 1)).astype(np.int32).tobytes(), (count[a:b] * scale[r]).astype(np.float32).tobytes()) for r, (a, b) in enumerate(zip(edge, edge[1:]))]
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(lo, hi - lo), pa.array([c[0] for c in cols], pa.binary()), pa.array([c[1] for c in cols], pa.binary())], names=["label", "idx", "x"])

    return rows.select("label", "text").mapInArrow(lean(run), "label int, idx binary, x binary")


def labelled(docs: DataFrame, labels: DataFrame, label: str, learns, most: int, largest: int = FIT_BYTES) -> DataFrame:
    """(doc_id, label, text) of at most `most` labelled documents that may be learnt from, and at most
    `largest` bytes of text: those whose ids hash lowest, one text for each id (of several the smallest
    hash), a label for each id (1 if any says so)."""
    marks = labels.where(F.col(label).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(learns).groupBy("doc_id").agg(F.max("label").alias("label"))
    return bounded(docs, marks, most, largest)


def bounded(docs: DataFrame, marks: DataFrame, most: int, largest: int) -> DataFrame:
    """The window that adds up bytes holds ids and lengths of at most `most` rows; only the texts that fit are fetched."""
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = text_or_empty(docs)
    own = F.struct(F.xxhash64("text").alias("hash"), F.octet_length("text").alias("bytes"))
    sizes = texts.join(F.broadcast(marks), "doc_id").select("doc_id", "label", own.alias("own")).groupBy("doc_id", "label").agg(F.min("own").alias("own")).select("doc_id", "label", "own.*")
    room = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    fits = sizes.withColumn("room", F.sum("bytes").over(room)).where((F.col("room") <= largest) | (F.col("room") == F.col("bytes"))).select("doc_id", "label", "hash")
    held = texts.join(F.broadcast(fits), "doc_id").where(F.xxhash64("text") == F.col("hash"))
    return held.groupBy("doc_id", "label").agg(F.min("text").alias("text")).repartition(16, "doc_id")


class Ftrl:
    """Per-coordinate follow-the-regularised-leader for logistic loss; index `size` is the bias."""

    def __init__(self, size: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.05, l2: float = 0.5):
        self.z, self.n, self.a, self.b, self.l1, self.l2 = np.zeros(size + 1), np.zeros(size + 1), alpha, beta, l1, l2

    def weights(self, i=slice(None)) -> np.ndarray:
        z = self.z[i]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.b + np.sqrt(self.n[i])) / self.a + self.l2))

    def learn(self, i: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(i)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
        self.z[i] += g - (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / self.a * w
        self.n[i] += g * g


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", learns=None, bits: int = BITS, most: int = FIT_ROWS) -> np.ndarray:
    """Weights of the hashed table and the bias; zeros (score 0.5) where no row is labelled."""
    learns = F.lit(True) if learns is None else learns
    model = Ftrl(1 << bits)
    data = [(np.append(np.frombuffer(r["idx"], np.int32), np.int32(1 << bits)), np.append(np.frombuffer(r["x"], np.float32), np.float32(1)), r["label"]) for r in examples(labelled(docs, labels, label, learns, most), bits).coalesce(4).toLocalIterator()]  # a task's share at a time
    data.sort(key=lambda d: (len(d[0]), d[0][:3].tolist(), d[2]))  # the order of arrival doesn't count
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for k in order.permutation(len(data)):
            i, x, y = data[k]
            model.learn(i, x.astype(np.float64), y)
    del data
    released()
    return model.weights().astype(np.float32)


def scored(docs: DataFrame, weights: np.ndarray, bits: int = BITS) -> DataFrame:
    """doc_id and score of every whole text."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, at in chunks(batch.column("text")):
                idx, row, n = features(data, at, bits)
                dot = np.bincount(row, weights[idx], minlength=hi - lo) / np.sqrt(np.maximum(n, 1))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(1 / (1 + np.exp(-np.clip(dot + float(weights[-1]), -30, 30))))], names=["doc_id", "score"])

    return text_or_empty(docs).mapInArrow(lean(run), "doc_id long, score double")


def passing(docs: DataFrame, weights: np.ndarray, cut: float = CUT, bits: int = BITS) -> DataFrame:
    """docs whose text scores `cut` or more, all columns as they are; a null text scores as an empty one."""

    def run(batches):
        for batch in batches:
            keep = []
            for lo, hi, data, at in chunks(batch.column(batch.schema.get_field_index("text"))):
                idx, row, n = features(data, at, bits)
                dot = np.bincount(row, weights[idx], minlength=hi - lo) / np.sqrt(np.maximum(n, 1))
                keep.append(1 / (1 + np.exp(-np.clip(dot + float(weights[-1]), -30, 30))) >= cut)
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return docs.mapInArrow(lean(run), docs.schema)


def classify(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """Score every document for quality, learning only from ids whose crc32 mod 5 isn't 0.

    Null and empty texts have no feature: they get the bias's score. A null id is held out (its text
    form is empty, crc32 0) and never joins a label. Several labels of one id count as 1 if any is.
    Repeated rows get equal scores; no labels give 0.5 everywhere; an empty table gives no rows."""
    weights = fit(docs, labels, learns=fold("doc_id", 5) != 0)
    return scored(docs, weights).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
