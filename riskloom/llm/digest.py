"""Operator 7: improbable-feature digests with chained Bloom filters.

Each 64-byte window is ranked by its collision entropy -log2(sum p^2): the fewer equal byte pairs, the
rarer among texts. Every run of 64 neighbouring windows votes for its rarest (leftmost on ties), and
windows with enough votes are features. A feature sets 5 of 2048 bits; after 160 features the next
filter of the chain begins. Two digests are as alike as the best overlaps of the shorter chain's
filters, less what chance would give, on a scale from 0 to 1.
"""



import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.base import lean, text_or_empty
from riskloom.llm.kernels import chunks, span_hashes

WINDOW, RUN, VOTES, BITS, HASHES, FEATURES = 64, 64, 16, 2048, 5, 160
#: Windows with more equal pairs than this (of 2016) are runs of filler and never features.
FILLER = 800
U = np.uint64
_MAX = np.iinfo(np.uint64).max


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the selected windows of consecutive texts in order, and their rows."""
    n, m = len(data), len(at) - 1
    size = np.diff(at)
    short = np.flatnonzero((size > 0) & (size < WINDOW))
    row, h = short, span_hashes(data, at[short], at[short + 1])
    if n >= WINDOW and (size >= WINDOW).any():
        before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
        for d in range(1, WINDOW):
            same = (data[d:] == data[:-d]).view(np.uint8)
            before[d:] += same
            after[:-d] += same
        w = n - WINDOW + 1
        pairs = np.empty(w, np.int32)
        pairs[0] = before[:WINDOW].sum(dtype=np.int64)
        np.cumsum(before[WINDOW:].astype(np.int32) - after[: w - 1], out=pairs[1:])
        pairs[1:] += pairs[0]
        valid = np.zeros(w + 1, np.int8)
        long = np.flatnonzero(size >= WINDOW)
        valid[at[long]] += 1
        valid[at[long + 1] - WINDOW + 1] -= 1
        valid = np.cumsum(valid[:w], dtype=np.int8) > 0
        key = np.full(w + RUN, _MAX, U)
        key[:w] = np.where(valid & (pairs <= FILLER), pairs.astype(U) << U(40) | np.arange(w, dtype=U), _MAX)
        step = 1
        while step < RUN:
            np.minimum(key[:-step], key[step:], out=key[:-step])
            step *= 2
        best = key[:w][valid & (key[:w] != _MAX)]
        votes = np.bincount((best & U((1 << 40) - 1)).astype(np.int64), minlength=w)
        s = np.flatnonzero(votes)
        r = np.searchsorted(at, s, "right") - 1
        enough = votes[s] >= np.minimum(VOTES, np.maximum(1, (size[r] - WINDOW + 1) // 4))
        s, r = s[enough], r[enough]
        row, h = np.concatenate([row, r]), np.concatenate([h, span_hashes(data, s, s + WINDOW)])
        order = np.argsort(row, kind="stable")
        row, h = row[order], h[order]
    return h, row


def digests(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The filters of each text: a (filters, 256) array of bytes; none for an empty text."""
    m = len(at) - 1
    h, row = features(data, at)
    count = np.bincount(row, minlength=m)
    chain = -(-count // FEATURES)
    base = np.cumsum(chain) - chain
    nth = np.arange(len(row)) - (np.cumsum(count) - count)[row]
    out = []
    lo = 0
    while lo < m:  # stretches of texts with a bounded number of filters
        hi = max(lo + 1, int(np.searchsorted(np.cumsum(chain[lo:]), 4096, "right")) + lo)
        pick = slice(int(np.searchsorted(row, lo)), int(np.searchsorted(row, hi)))
        bits = np.zeros((int(chain[lo:hi].sum()), BITS), np.uint8)
        f = base[row[pick]] - base[lo] + nth[pick] // FEATURES
        for k in range(HASHES):
            bits[f, (h[pick] >> U(11 * k) & U(BITS - 1)).astype(np.int64)] = 1
        packed = np.packbits(bits, axis=1)
        out += [packed[base[i] - base[lo] : base[i] - base[lo] + chain[i]] for i in range(lo, hi)]
        lo = hi
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1 from two chains; two empty chains are alike, an empty and another aren't."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    nb = np.bitwise_count(b).sum(1, dtype=np.int64)
    total = 0.0
    for x in a:
        na = int(np.bitwise_count(x).sum(dtype=np.int64))
        both = np.bitwise_count(b & x).sum(1, dtype=np.int64)
        chance = na * nb / BITS
        room = np.minimum(na, nb) - chance
        total += float(np.max(np.where(room > 0, (both - chance) / np.where(room > 0, room, 1), 0.0)).clip(0, 1))
    return total / len(a)


def written(d: np.ndarray) -> str:
    return f"{len(d)}:{base64.b64encode(d.tobytes()).decode()}"


def edited(text: str, follower: str) -> str:
    """text whose last half (rounded down, code points) gives way to the first as many of follower."""
    half = len(text) // 2
    return text[: len(text) - half] + follower[:half]


def _of(texts: list[str]) -> list[np.ndarray]:
    return [d for _, _, data, at in chunks(pa.array(texts, pa.large_string())) for d in digests(data, at)]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches):
    """Rows come in order; the last row of a bucket is followed by a copy of the next one's head."""
    waiting = None  # (doc_id, text, digest) whose follower hasn't come yet
    for batch in batches:
        for lo, hi, data, at in chunks(batch.column("text"), 1 << 20):
            ids, tail = (batch.column(c).slice(lo, hi - lo).to_pylist() for c in ("doc_id", "tail"))
            own = batch.column("text").slice(lo, hi - lo).to_pylist()
            mine = digests(data, at)
            done = []
            for i, text, d, last in zip(ids, own, mine, tail):
                if waiting:
                    done.append((waiting, text, d))
                waiting = None if last else (i, text, d)
                if last:
                    break
            if done:
                after = [edited(w[1], t) for w, t, _ in done]
                second = _of(after)
                rows = [(w[0], len(w[1]), hashlib.sha256(x.encode()).hexdigest(), written(w[2]), written(e), likeness(w[2], e), likeness(w[2], d)) for (w, _, d), x, e in zip(done, after, second)]
                c = list(zip(*rows))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds)], names=[f.split()[0] for f in OUT.split(", ")])
            if tail and any(tail):
                waiting = None
                break


def buckets(ids: np.ndarray, missing: np.ndarray, h: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Bucket of each (id, text hash), in their order; a null id comes first.

    An id that fills several quantiles is spread over their buckets by ranges of the hash."""
    ids = np.where(missing, np.iinfo(np.int64).min, ids)
    lo, hi = np.searchsorted(cuts, ids, "left"), np.searchsorted(cuts, ids, "right")
    part = (h.view(U) ^ U(1 << 63)) >> U(32)  # rises with the signed hash
    return (lo + (part.astype(np.int64) * (hi - lo + 1) >> 32)).astype(np.int32)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Digest of every text and of its edited text, with how alike they and the next text's are.

    The next document is the next in order of (doc_id, text hash), a null doc_id first; after the last
    comes the first, so a lone document follows itself. Null texts are empty; an empty text has no
    filter and is alike (1) only to another empty one. Repeated rows are separate documents; an empty
    table gives no rows. Rows are cut into buckets at approximate quantiles of the ids and, where one id
    fills several, of the hash; buckets are read as sorted streams, and each also gets a copy of the row
    that begins the next one."""
    spark = docs.sparkSession
    docs = text_or_empty(docs)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_ = F.coalesce("doc_id", F.lit(int(np.iinfo(np.int64).min)))
    cuts = docs.select(F.percentile_approx(id_, [i / n for i in range(1, n)] or [0.5], 1000).alias("q")).first()["q"]  # n values
    cuts = np.array(sorted(cuts or []), np.int64)

    @F.pandas_udf("int")
    def bucket(ids: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(buckets(ids.fillna(0).to_numpy(np.int64), ids.isna().to_numpy(), h.to_numpy(np.int64), cuts))

    rows = docs.select("doc_id", "text", F.col("doc_id").isNotNull().alias("some"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("h"))
    rows = rows.withColumn("bucket", bucket("doc_id", "h"))
    heads = sorted((r["bucket"], r["head"]) for r in rows.groupBy("bucket").agg(F.min(F.struct("some", "id", "h")).alias("head")).collect())  # a row for each bucket
    copies = [(h["some"], h["id"], h["h"], heads[k - 1][0]) for k, (_, h) in enumerate(heads)]
    copies = spark.createDataFrame(copies, "hsome boolean, hid long, hh long, to int")  # likewise, so small enough to broadcast
    again = rows.join(F.broadcast(copies), (F.col("some") == F.col("hsome")) & (F.col("id") == F.col("hid")) & (F.col("h") == F.col("hh"))).select("doc_id", "text", "some", "id", "h", F.col("to").alias("bucket"), F.lit(True).alias("tail"))
    rows = rows.select("doc_id", "text", "some", "id", "h", "bucket", F.lit(False).alias("tail")).unionByName(again)
    rows = rows.repartitionById(max(1, len(cuts) + 1), F.col("bucket")).sortWithinPartitions("tail", "some", "id", "h")
    return rows.select("doc_id", "text", "tail").mapInArrow(lean(_compare), OUT)
