"""Operator 8: toxicity - factorization machine over hashed terms.

score = sigmoid(b + sum w_t + sum over pairs <v_t, v_u>) over the distinct terms of a text; the pair
sum is taken as half of (sum v)^2 - sum v^2. Linear weights learn by FTRL (most stay exactly zero),
factors by AdaGrad with decay. Terms are runs of letters and digits, A-Z lowered, so punctuation
doesn't hide them, and each one's first 4 to 8 bytes where more follow, so that forms of one stem share
what is learnt. At most FIT_ROWS labelled documents of each class, and FIT_BYTES of their text, are
learnt from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.base import fold, lean, released, text_or_empty
from riskloom.llm.kernels import LOWER, chunks, mix, span_hashes, words
from riskloom.llm.quality import FIT_BYTES, Ftrl, bounded

BITS, FACTORS, FIT_ROWS, EPOCHS, CUT = 20, 4, 6000, 10, 0.5
#: Lengths of the stems in bytes.
STEMS = range(4, 9)
TERM = np.zeros(256, bool)
TERM[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def terms(data: np.ndarray, at: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed terms and stems with their rows."""
    data = LOWER[data]
    s, e, row = words(data, at, TERM)
    h, rows = [span_hashes(data, s, e)], [row]
    for n in STEMS:
        longer = np.flatnonzero(e - s > n)
        h.append(mix(span_hashes(data, s[longer], s[longer] + n) + np.uint64(n)))
        rows.append(row[longer])
    return (np.concatenate(h) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(rows)


def distinct(idx: np.ndarray, row: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(row.astype(np.int64) << bits | idx)
    return key & ((1 << bits) - 1), key >> bits


def examples(rows: DataFrame, bits: int = BITS) -> DataFrame:
    def run(batches):
        for batch in batches:
            for lo, hi, data, at in chunks(batch.column("text")):
                idx, row = distinct(*terms(data, at, bits), bits)
                edge = np.searchsorted(row, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(lo, hi - lo), pa.array([idx[a:b].astype(np.int32).tobytes() for a, b in zip(edge, edge[1:])], pa.binary())], names=["label", "idx"])

    return rows.select("label", "text").mapInArrow(lean(run), "label int, idx binary")


class Machine:
    def __init__(self, size: int, factors: int = FACTORS, rate: float = 0.03, decay: float = 0.02):
        self.linear = Ftrl(size, alpha=1.0, l1=3.0, l2=0.0)
        self.v = np.random.default_rng(3).normal(0, 0.01, (size + 1, factors)).astype(np.float32)
        self.v[size] = 0
        self.seen, self.rate, self.decay = np.full((size + 1, factors), 1e-2, np.float32), rate, decay

    def learn(self, i: np.ndarray, y: int, pairs: bool = True) -> None:
        """i: distinct terms, the bias last. Only terms that have earned a linear weight interact, so
        that the pair sum of a long text isn't made of rare terms' start values."""
        f = self.linear
        w = f.weights(i)
        live = i[:-1][w[:-1] != 0] if pairs else i[:0]
        v = self.v[live]
        total = v.sum(0)
        p = 1 / (1 + np.exp(-np.clip(w.sum() + 0.5 * float((total * total).sum() - (v * v).sum()), -30, 30)))
        g = p - y
        f.z[i] += g - (np.sqrt(f.n[i] + g * g) - np.sqrt(f.n[i])) / f.a * w
        f.n[i] += g * g
        if len(live) > 1 and abs(g) > 1e-3:
            gv = g * (total - v) + self.decay * abs(g) * v
            self.seen[live] += gv * gv
            self.v[live] -= self.rate * gv / np.sqrt(self.seen[live])

    def frozen(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights, and factors of the terms that learnt any; untouched start values are dropped."""
        w = self.linear.weights().astype(np.float32)
        v = self.v[:-1].copy()
        v[w[:-1] == 0] *= 0
        return w, v


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", learns=None, bits: int = BITS, most: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Weights (bias last) and factors; a balanced share of both classes is learnt from."""
    learns = F.lit(True) if learns is None else learns
    one = labels.where(F.col(label).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(learns).groupBy("doc_id").agg(F.max("label").alias("label"))
    both = [bounded(docs, one.where(F.col("label") == y), most, FIT_BYTES) for y in (0, 1)]
    rows = examples(both[0].unionByName(both[1]), bits).coalesce(4).toLocalIterator()  # a task's share at a time
    data = sorted(((np.append(np.frombuffer(r["idx"], np.int32), np.int32(1 << bits)), r["label"]) for r in rows), key=lambda d: (len(d[0]), d[0][:3].tolist(), d[1]))
    machine, order = Machine(1 << bits), np.random.default_rng(5)
    for epoch in range(EPOCHS):
        for k in order.permutation(len(data)):
            machine.learn(*data[k], pairs=epoch >= EPOCHS // 2)
    del data
    released()
    return machine.frozen()


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], bits: int = BITS) -> DataFrame:
    w, v = model
    live = np.flatnonzero((w[:-1] != 0) | (v != 0).any(1))
    w, v, bias = w[live], v[live], float(w[-1])

    def run(batches):
        place = np.zeros(1 << bits, np.int64)
        place[live] = np.arange(1, len(live) + 1)
        for batch in batches:
            for lo, hi, data, at in chunks(batch.column("text")):
                idx, row = terms(data, at, bits)
                keep = place[idx] > 0
                idx, row = distinct(place[idx[keep]] - 1, row[keep], bits)
                m = hi - lo
                out = np.bincount(row, w[idx], minlength=m) + bias
                for f in range(v.shape[1]):
                    x = v[idx, f].astype(np.float64)
                    out += 0.5 * (np.bincount(row, x, minlength=m) ** 2 - np.bincount(row, x * x, minlength=m))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, m), pa.array(1 / (1 + np.exp(-np.clip(out, -30, 30))))], names=["doc_id", "score"])

    return text_or_empty(docs).mapInArrow(lean(run), "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """Score every document for toxicity, learning only from ids whose crc32 mod 5 isn't 0.

    Null and empty texts get the bias's score; a null id is held out and joins no label; several
    labels of one id count as 1 if any is; no labels give 0.5; an empty table gives no rows."""
    model = fit(docs, labels, learns=fold("doc_id", 5) != 0)
    return scored(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
