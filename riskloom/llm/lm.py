"""Operator 10: log-bilinear language model, trained by noise-contrastive estimation.

Every word falls into one of CLASSES classes - the end, the most frequent words of the training texts
one each, and classes of words with the same last two bytes, which tell languages and word forms apart - and
there into one of SLOTS slots by its hash: 16,384 outputs. A bilinear network over the two words before
(their outputs' vectors) gives P(class | context) and P(slot | class, context); both levels are learnt by
NCE from noise that a batch shares, in numpy, on every training token, and normalised by batched matrix
products. Which of its slot's words a word is (mostly one, for the frequent ones) follows from counts
that are gathered over the whole corpus, with one share for a word never seen:
P(word) = P(class | context) P(slot | class, context) P(word | slot).

Training starts from a network fitted on a pilot of about PILOT documents (chosen by hash), which each
task goes on training over its own share of all training texts; the results are averaged by tokens.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.base import fold, lean, saved, text_or_empty
from riskloom.llm.kernels import LOWER, SPACE, chunks, mix, span_hashes, words

CLASSES, TOP, SLOTS, WIDTH = 256, 64, 64, 16
OUTPUTS = CLASSES * SLOTS
BATCH, NOISE, SLOT_NOISE, RATE = 8192, 64, 12, 0.2
#: Documents the pilot is trained on, and training tokens that make a trainer of their own worth while.
PILOT, SHARE = 2000, 800_000
#: Stands for the end token; a word's hash is moved off it.
END = np.uint64(0)
U = np.uint64
#: Shapes of the parameters in their flat order: vectors of the word two before, one before, classes, slots; biases.
SHAPES = ((OUTPUTS, WIDTH), (OUTPUTS, WIDTH), (CLASSES, WIDTH), (OUTPUTS, WIDTH), (CLASSES,), (OUTPUTS,))
_EDGES = np.cumsum([0, *(math.prod(s) for s in SHAPES)])
#: Parameters a row carries when they are added up.
PART = 1 << 14


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes in order with an end after each text, their endings' classes from 0, and each
    text's first token (plus the total)."""
    data = LOWER[data]
    s, e, row = words(data, at, ~SPACE)
    h = span_hashes(data, s, e)
    h[h == END] = U(1)
    n = np.bincount(row, minlength=len(at) - 1)
    first = np.concatenate([[0], np.cumsum(n + 1)])
    out, tail = np.zeros(int(first[-1]), U), np.zeros(int(first[-1]), np.int64)
    place = np.arange(len(h)) + row
    out[place] = h
    last = data[e - 1].astype(U) << U(8) | np.where(e - s > 1, data[np.maximum(e - 2, 0)], 0).astype(U)
    tail[place] = (mix(last) % U(CLASSES - 1 - TOP)).astype(np.int64)
    return out, tail, first


def outputs(h: np.ndarray, tail: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class and output (class and slot) of each token: class 0 is the end, then the top words
    (sorted hashes), then endings."""
    c = 1 + TOP + tail
    slot = (h >> U(20) & U(SLOTS - 1)).astype(np.int64)
    if len(top):
        place = np.minimum(np.searchsorted(top, h), len(top) - 1)
        hit = top[place] == h
        c[hit] = 1 + place[hit]
        slot[hit] = 0
    end = h == END
    c[end] = slot[end] = 0
    return c, c * SLOTS + slot


def contexts(w: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Outputs one and two before each token; before a text there are ends."""
    one = np.concatenate([[0], w[:-1]]) if len(w) else w
    two = np.concatenate([[0], one[:-1]]) if len(w) else w
    one[first[:-1]] = 0
    two[first[:-1]] = 0
    return one, two  # the token after a text's first already has that text's start (the end) two before


def tally(h: np.ndarray, tail: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes with an ending's class and summed counts."""
    order = np.argsort(h, kind="stable")
    h = h[order]
    edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[edge], tail[order][edge], (np.add.reduceat(count[order], edge) if len(h) else np.zeros(0, np.int64))


def _flags(batch, lo: int, hi: int) -> np.ndarray:
    return batch.column("learn").slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(bool)


def counts(docs: DataFrame) -> DataFrame:
    """(word, tail, block, many): each block's distinct words with their occurrences in its training texts."""

    def run(batches):
        held, size, block = [], 0, None

        def rows():
            h, tail, c = tally(*map(np.concatenate, zip(*held)))
            for k in range(0, len(h), 50_000):
                n = len(h[k : k + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(h[k : k + n].view(np.int64)), pa.array(tail[k : k + n].astype(np.int16)), pa.array(np.full(n, block, np.int32)), pa.array(c[k : k + n])], names=["word", "tail", "block", "many"])

        for batch in batches:
            of = batch.column("block").to_numpy()
            edge = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for a, b in zip(edge, edge[1:]):
                if a == b:
                    continue
                if held and of[a] != block:
                    yield from rows()
                    held, size = [], 0
                block, part = of[a], batch.slice(a, b - a)
                for lo, hi, data, at in chunks(part.column("text")):
                    h, tail, first = tokens(data, at)
                    held.append(tally(h, tail, np.repeat(_flags(part, lo, hi), np.diff(first)).astype(np.int64)))
                    size += len(held[-1][0])
                    if size > 4 << 20:
                        held = [tally(*map(np.concatenate, zip(*held)))]
                        size = len(held[0][0]) // 2
        if held:
            yield from rows()

    return docs.select("text", "learn", "block").mapInArrow(lean(run), "word long, tail short, block int, many long")


def _sums(index: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct indices (under 2**16, so that they are sorted by radix) with the sums of their rows."""
    index = index.astype(np.uint16)
    order = np.argsort(index, kind="stable")
    i = index[order]
    edge = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
    return i[edge], np.add.reduceat(grad[order], edge, axis=0)


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Net:
    """score(class) = (A[two] + B[one]) . C[class] + bias, and likewise of the slots within a class."""

    def __init__(self, sizes: np.ndarray, state: tuple[np.ndarray, np.ndarray] | None = None):
        """sizes: training tokens of each output; state: parameters and their sums of squared gradients."""
        sizes = sizes.reshape(CLASSES, SLOTS).astype(np.float64)
        self.noise = (sizes.sum(1) + 1) / (sizes.sum(1) + 1).sum()
        q = (sizes + 0.1) / (sizes + 0.1).sum(1, keepdims=True)
        self.log_noise, self.log_slots = np.log(self.noise).astype(np.float32), np.log(q).astype(np.float32).ravel()
        self.cumulated = (np.cumsum(q, axis=1) / q.sum(1, keepdims=True) + np.arange(CLASSES)[:, None]).ravel()
        if state is None:
            r = np.random.default_rng(2)
            n = OUTPUTS * WIDTH
            flat = np.concatenate([r.normal(0, 0.1, 2 * n + CLASSES * WIDTH), np.zeros(n), self.log_noise, self.log_slots])
            state = flat, np.ones(len(flat))
        self.flat, self.squares = (x.astype(np.float32).copy() for x in state)
        shaped = lambda x: [x[a:b].reshape(s) for a, b, s in zip(_EDGES, _EDGES[1:], SHAPES)]
        self.parts, self.sums = shaped(self.flat), shaped(self.squares) if len(self.squares) else None  # without sums it only scores

    def _step(self, k: int, index, grad: np.ndarray) -> None:
        self.sums[k][index] += grad * grad
        self.parts[k][index] += RATE * grad / np.sqrt(self.sums[k][index])

    def train(self, stream) -> int:
        """One pass over batches (two before, one before, class, output); AdaGrad."""
        random, seen = np.random.default_rng(4), 0
        for two, one, c, w in stream:
            A, B, C, S, cb, sb = self.parts
            ctx, rc = A[two] + B[one], C[c]
            noise = random.choice(CLASSES, NOISE, p=self.noise)
            rn = C[noise]
            true = (1 - _squash(np.einsum("ij,ij->i", ctx, rc) + cb[c] - self.log_noise[c] - math.log(NOISE))).astype(np.float32)
            false = -_squash(ctx @ rn.T + (cb[noise] - self.log_noise[noise] - math.log(NOISE))).astype(np.float32)
            back = true[:, None] * rc + false @ rn
            dc, db = np.zeros_like(C), np.bincount(c, true, CLASSES).astype(np.float32)
            i, v = _sums(c, true[:, None] * ctx)
            dc[i] = v
            np.add.at(dc, noise, false.T @ ctx)
            np.add.at(db, noise, false.sum(0))
            # within the classes of endings: a few noise slots for each class of the batch
            at = np.flatnonzero(c > TOP)
            if len(at):
                at = at[np.argsort(c[at].astype(np.uint16), kind="stable")]
                k, out, x = c[at], w[at], ctx[at]
                edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
                drawn = np.searchsorted(self.cumulated, k[edge][:, None] + random.random((len(edge), SLOT_NOISE)))
                drawn = np.minimum(drawn, (k[edge][:, None] + 1) * SLOTS - 1)
                own = S[out]
                true = (1 - _squash(np.einsum("ij,ij->i", x, own) + sb[out] - self.log_slots[out] - math.log(SLOT_NOISE))).astype(np.float32)
                inner = true[:, None] * own
                grads, where = [np.concatenate([true[:, None] * x, true[:, None]], 1)], [out]
                for a, b, d in zip(edge, np.append(edge[1:], len(k)), drawn):
                    rows = S[d]
                    false = -_squash(x[a:b] @ rows.T + (sb[d] - self.log_slots[d] - math.log(SLOT_NOISE))).astype(np.float32)
                    inner[a:b] += false @ rows
                    grads.append(np.concatenate([false.T @ x[a:b], false.sum(0)[:, None]], 1))
                    where.append(d)
                back[at] += inner
                i, v = _sums(np.concatenate(where), np.concatenate(grads))
                self._step(3, i, v[:, :-1])
                self._step(5, i, v[:, -1])
            self._step(0, *_sums(two, back))
            self._step(1, *_sums(one, back))
            self._step(2, slice(None), dc)
            self._step(4, slice(None), db)
            seen += len(c)
        return seen

    def logs(self, two: np.ndarray, one: np.ndarray, c: np.ndarray, w: np.ndarray) -> np.ndarray:
        """log10 P(output | context) of each token, normalised over classes and over a class's slots."""
        A, B, C, S, cb, sb = self.parts
        ctx, out = A[two] + B[one], np.zeros(len(c))
        for lo in range(0, len(c), 1024):  # stays in a core's cache
            part = slice(lo, lo + 1024)
            out[part] = _log_share(ctx[part] @ C.T + cb, c[part])
        at = np.flatnonzero(c > TOP)
        at = at[np.argsort(c[at].astype(np.uint16), kind="stable")]
        edge = np.searchsorted(c[at], np.arange(TOP + 1, CLASSES + 1))
        for k, (a, b) in enumerate(zip(edge, edge[1:])):
            base = (TOP + 1 + k) * SLOTS
            for lo in range(a, b, 4096):
                rows = at[lo : min(b, lo + 4096)]
                out[rows] += _log_share(ctx[rows] @ S[base : base + SLOTS].T + sb[base : base + SLOTS], w[rows] - base)
        return out / math.log(10)


def _log_share(scores: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """Log of the picked one's share of each row's exponentials."""
    with np.errstate(over="ignore"):
        total = np.exp(scores).sum(1)
    if not ((total > 1e-30) & (total < 1e30)).all():
        scores = scores - scores.max(1, keepdims=True)
        total = np.exp(scores).sum(1)
    return scores[np.arange(len(pick)), pick].astype(np.float64) - np.log(total.astype(np.float64))


def trained(docs: DataFrame, top: np.ndarray, sizes: np.ndarray, state=None) -> tuple[np.ndarray, np.ndarray] | None:
    """State averaged over tasks by tokens, every training token learnt from once; None without any.

    The sums of squares are only given where there was no state to start from (the pilot). What a task gives is as large as the network, whatever its text; parts are added up as they stream
    by, so no task holds them together."""

    def run(batches):
        net = Net(sizes, state)

        def stream():
            for batch in batches:
                for lo, hi, data, at in chunks(batch.column("text")):
                    h, tail, first = tokens(data, at)
                    c, w = outputs(h, tail, top)
                    one, two = contexts(w, first)
                    keep = np.repeat(_flags(batch, lo, hi), np.diff(first))
                    c, w, one, two = c[keep], w[keep], one[keep], two[keep]
                    for k in range(0, len(c), BATCH):
                        yield two[k : k + BATCH], one[k : k + BATCH], c[k : k + BATCH], w[k : k + BATCH]

        seen = net.train(stream())
        if seen:
            both = np.concatenate([net.flat, net.squares]) if state is None else net.flat
            for k in range(0, len(both), PART):
                yield pa.RecordBatch.from_arrays([pa.array([k // PART], pa.int32()), pa.array([both[k : k + PART].tobytes()], pa.binary()), pa.array([seen], pa.int64())], names=["part", "x", "n"])

    def add(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            for part, x, n in zip(*(batch.column(c).to_pylist() for c in ("part", "x", "n"))):
                own = sums.setdefault(part, [0.0, 0])
                own[0] = own[0] + np.frombuffer(x, np.float32).astype(np.float64) * n
                own[1] += n
        for part, (x, n) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([(x / n).astype(np.float32).tobytes()], pa.binary())], names=["part", "x"])

    size = int(_EDGES[-1]) * (2 if state is None else 1)
    each = docs.select("text", "learn").mapInArrow(lean(run), "part int, x binary, n long")
    rows = each.repartition(min(32, -(-size // PART)), "part").mapInArrow(lean(add), "part int, x binary")
    got = sorted((r["part"], bytes(r["x"])) for r in rows.collect())  # as large as the network
    if not got:
        return None
    both = np.frombuffer(b"".join(x for _, x in got), np.float32)
    return both[: _EDGES[-1]], both[_EDGES[-1] :]


def fit(docs: DataFrame, top: np.ndarray, sizes: np.ndarray, rows: int, n: int) -> Net:
    """docs: text, learn, doc_id; rows of them, n training tokens. Trainers are coalesced partitions."""
    pilot = docs.where(F.col("learn") & (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(max(1, rows // PILOT))) == 0)).coalesce(1)
    state = trained(pilot, top, sizes)
    many = docs.rdd.getNumPartitions()
    return Net(sizes, trained(docs.coalesce(max(1, min(many, n // SHARE))), top, sizes, state) or state)


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame) -> DataFrame:
    """Base score and model score (log10 probability, the end included) of every whole text.

    Texts whose crc32(doc_id) mod 7 isn't 2 are learnt from. Null and empty texts are one end token; a
    null doc_id learns (crc32 0); repeated rows each count; with nothing to learn from every count is 0;
    an empty table gives no rows. Words are told apart by 64-bit hashes.

    Texts get a block number and are saved with it. A block's scorer is sent the corpus totals of its
    words first and then its texts one after another, so it holds its distinct words alone."""
    docs = text_or_empty(docs).withColumn("learn", fold("doc_id", 7) != 2)
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < cores:  # too few to keep the cluster busy
        docs = docs.repartition(cores)
    docs = saved(docs.withColumn("block", F.spark_partition_id()), "lm-docs")
    rows = saved(counts(docs), "word-counts")
    total = saved(rows.groupBy("word").agg(F.sum("many").alias("total"), F.min("tail").alias("tail")), "word-totals")
    known = total.where("total > 0")
    n, v = known.agg(F.sum("total"), F.count(F.lit(1))).first()
    n, v = int(n or 0), int(v)
    top = np.sort(np.array([r["word"] for r in known.where("word <> 0").orderBy(F.desc("total"), "word").limit(TOP).collect()], np.int64).view(U))
    sizes, kinds = np.zeros(OUTPUTS), np.zeros(OUTPUTS)
    slot = F.when(F.col("word").isin([0, *top.view(np.int64).tolist()]), F.col("word")).otherwise(F.shiftrightunsigned("word", 20).bitwiseAND(F.lit(SLOTS - 1)))
    alone = F.col("word").isin([0, *top.view(np.int64).tolist()])
    for r in known.groupBy(alone.alias("alone"), F.when(~alone, F.col("tail")).alias("tail"), slot.alias("slot")).agg(F.sum("total").alias("n"), F.count(F.lit(1)).alias("v")).collect():  # a row for each output
        word = np.array([r["slot"]], np.int64).view(U)
        at = int(outputs(word, np.zeros(1, np.int64), top)[1][0]) if r["alone"] else (1 + TOP + r["tail"]) * SLOTS + r["slot"]
        sizes[at], kinds[at] = r["n"], r["v"]
    net = fit(docs, top, sizes, docs.count(), n)
    state = net.flat, net.squares[:0]
    empty = {"word": "long", "total": "long", "doc_id": "long", "text": "string", "learn": "boolean"}
    none = lambda *names: [F.lit(None).cast(empty[c]).alias(c) for c in names]
    wanted = rows.select("word", "block").join(total.select("word", "total"), "word").select("block", F.lit(0).alias("kind"), "word", "total", *none("doc_id", "text", "learn"))
    texts = docs.select("block", F.lit(1).alias("kind"), *none("word", "total"), "doc_id", "text", "learn")
    many = max(1, int(docs.agg(F.max("block")).first()[0] or 0) + 1)
    both = wanted.unionByName(texts).repartitionById(many, F.col("block")).sortWithinPartitions("kind")
    floor, slot_sizes = math.log10(n + v + 1), np.log10(sizes + kinds + 1)

    def run(batches):
        net = Net(sizes, state)
        known = own = logs = None
        words_, totals = [], []
        for batch in batches:
            cut = int(np.searchsorted(batch.column("kind").to_numpy(), 1))
            if cut:
                words_.append(batch.column("word").slice(0, cut).to_numpy().astype(np.int64).view(U))
                totals.append(batch.column("total").slice(0, cut).to_numpy().astype(np.int64))
            if cut == batch.num_rows:
                continue
            if known is None:
                known, own = np.concatenate(words_), np.concatenate(totals)
                order = np.argsort(known)
                known, own = known[order], own[order]
                logs = np.log10(own + 1.0)
                words_ = totals = None
            rest = batch.slice(cut)
            for lo, hi, data, at in chunks(rest.column("text")):
                h, tail, first = tokens(data, at)
                place = np.minimum(np.searchsorted(known, h), len(known) - 1)
                if (known[place] != h).any():
                    raise RuntimeError("a block's text has a word that wasn't counted")
                c, w = outputs(h, tail, top)
                one, two = contexts(w, first)
                base = np.add.reduceat(logs[place] - floor, first[:-1])
                word = np.where(c <= TOP, 0.0, logs[place] - slot_sizes[w])  # the only word of its class, or one of its slot's
                model = np.add.reduceat(net.logs(two, one, c, w) + word, first[:-1])
                size = np.diff(first)
                yield pa.RecordBatch.from_arrays([rest.column("doc_id").slice(lo, hi - lo), pa.array(~_flags(rest, lo, hi)), pa.array(size), pa.array(np.add.reduceat((own[place] > 0).astype(np.int64), first[:-1])), pa.array(np.full(len(size), n, np.int64)), pa.array(base), pa.array(model)], names=[f.split()[0] for f in OUT.split(", ")])

    return both.select("kind", "word", "total", "doc_id", "text", "learn").mapInArrow(lean(run), OUT)
