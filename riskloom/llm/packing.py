"""Operator 1: bulk-synchronous best-fit packing of token pieces into sequences.

State is run-length coded by size, so a superstep moves whole runs. Pieces are ranked inside
their length by distributed counts (task, then length), which range-sorts them; a superstep takes
the longest unplaced length, sweeps its successors (the smallest gaps that hold it) in order,
hands gap runs to rank intervals so that no two pieces contend for a gap, shrinks those gaps, and
the next superstep repeats with the new gaps. What the supersteps exchange is at most `capacity`
lengths and a few runs of equal gaps per step, whatever the number of pieces; pieces themselves
stay distributed and are placed by (length, rank).
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm import bpe
from riskloom.llm.base import lean, saved, text_or_empty
from riskloom.llm.kernels import chunks

CAPACITY, END = 1024, 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def cut(total: int, capacity: int) -> np.ndarray:
    """Borders of a document's pieces: only the first may be shorter than the capacity."""
    first = total % capacity or capacity
    return np.concatenate([[0], np.arange(first, total + 1, capacity)])


def tokenized(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece, numbered within its task and length (nth)."""

    def run(batches):
        from pyspark import TaskContext

        code, task = bpe.load(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for lo, hi, data, at in chunks(batch.column("text")):
                ids, n = code.encode(data, at)
                edge = np.concatenate([[0], np.cumsum(n)])
                doc, piece, start, length, crc = [], [], [], [], []
                keys = batch.column("doc_id").slice(lo, hi - lo).to_pylist()
                for r, key in enumerate(keys):
                    raw = np.append(ids[edge[r] : edge[r + 1]], np.uint32(end)).astype("<u4").tobytes()
                    b = cut(len(raw) // 4, capacity).tolist()
                    for k, (x, y) in enumerate(zip(b, b[1:])):
                        doc.append(key), piece.append(k), start.append(x), length.append(y - x)
                        crc.append(zlib.crc32(raw[4 * x : 4 * y]))
                size = np.array(length, np.int64)
                order = np.argsort(size, kind="stable")
                run_at = np.searchsorted(size[order], size[order], "left")
                nth = np.empty(len(size), np.int64)
                nth[order] = seen[size[order]] + np.arange(len(size)) - run_at
                seen += np.bincount(size, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size), pa.array(crc, pa.int64()), pa.array(np.full(len(size), task, np.int32)), pa.array(nth)], names=[f.split()[0] for f in PIECES.split(", ")])
        bpe.unload()

    return docs.mapInArrow(lean(run), PIECES)


def supersteps(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Match every length's pieces to gaps: (length, first rank, first sequence, per sequence, offset).

    Gaps are runs (gap, first sequence, number). Each step serves one length, longest first; its
    successor sweep goes from the smallest gap that holds it upwards."""
    gaps: list[tuple[int, int, int]] = []
    plan: list[tuple[int, int, int, int, int]] = []
    fresh = 0
    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            i = bisect_left(gaps, (size, -1, -1))
            if i < len(gaps):
                gap, first, many = gaps.pop(i)
            else:  # no successor: open what the rest of this length needs
                gap, first, many = capacity, fresh, -(-left // (capacity // size))
                fresh += many
            each = gap // size
            full, rest = divmod(min(left, many * each), each)
            plan.append((size, rank, first, each, capacity - gap))
            if full and gap % size:
                insort(gaps, (gap % size, first, full))
            if rest:
                insort(gaps, (gap - rest * size, first + full, 1))
            if (over := many - full - bool(rest)) > 0:
                insort(gaps, (gap, first + full + bool(rest), over))
            rank += full * each + rest
            left -= full * each + rest
    return plan


def placed(pieces: DataFrame, plan: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """Add sequence_id and offset to pieces with a rank; the plan is bounded by the capacity."""
    steps = np.array(sorted(plan), np.int64).reshape(-1, 5)
    shift = np.int64(1 << 44)  # ranks stay under 2**44
    key = steps[:, 0] * shift + steps[:, 1]

    def run(batches):
        for batch in batches:
            size, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            step = steps[np.searchsorted(key, size * shift + rank, "right") - 1]
            r = rank - step[:, 1]
            seq, off = step[:, 2] + r // step[:, 3], step[:, 4] + r % step[:, 3] * size
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(seq), pa.array(off)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return pieces.mapInArrow(lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pack every text's ids (plus the end id) into as few sequences of `capacity` as best fit needs.

    docs: doc_id, text, any other columns. Null and empty texts give one piece, the end id alone; a
    null doc_id stays null; repeated rows are separate documents; an empty table gives no rows. A
    text longer than the capacity is cut, its first piece taking the remainder. Equal lengths are
    interchangeable, so ties need no order."""
    pieces = saved(tokenized(text_or_empty(docs), tokenizer, capacity, end), "pieces")
    per_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("many"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    per_task = saved(per_task.withColumn("base", F.coalesce(F.sum("many").over(before), F.lit(0))), "piece-counts")
    counts = {int(r["length"]): int(r["many"]) for r in per_task.groupBy("length").agg(F.sum("many").alias("many")).collect()}  # at most `capacity` rows
    ranked = pieces.join(per_task.select("task", "length", "base"), ["task", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return placed(ranked, supersteps(counts, capacity))
