"""Operator 11: exact top-k search by inner product, term at a time.

A vector is a sparse row: its components, scaled and floored to integers, are weights of terms (their
places). Query rows are dealt into blocks and all rows into shards; a block meets a shard in one cell,
and the cells tile the whole grid, so every query meets every row. In a cell each term has a posting
list over the rows at hand. A query clears a dense array of scores, and for each of its terms scatters
weight x posting into it; a partition selection keeps its k best, which are merged with those of the
rows before. What leaves a cell is k rows a query, and one window a query merges the cells.

A task holds one block of queries and ROWS candidates, whatever the input; rows are dealt by a number of
their own, never by content, so equal vectors don't meet in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.base import released, saved, table

K, SCALE, EVERY = 20, 64, 20
#: Queries of a block; candidates scored at once; candidates of a shard, and shards that are made if there are rows for them.
QUERIES, ROWS, SHARD, SHARDS = 4096, 8192, 1 << 16, 16
#: Scaled components stay within this (|x| of 2**24 at scale 64); a larger one counts as this large.
LARGEST = 1 << 30


def postings(weights: list[np.ndarray]) -> list[tuple[np.ndarray | None, np.ndarray]]:
    """For each term the rows that have it and their weights; no rows are named where every row has it."""
    wide = max(map(len, weights), default=0)
    dense = np.zeros((wide, len(weights)), np.int64)
    sizes = np.array([len(w) for w in weights], np.int64)
    if len(weights) and (sizes == wide).all():
        dense[:] = np.stack(weights).T
    else:
        for i, w in enumerate(weights):
            dense[: len(w), i] = w
    out = []
    for row in dense:
        at = np.flatnonzero(row)
        # a list that names over half of the rows is cheaper as a run over all of them, its gaps weighing 0
        out.append((None, row) if 2 * len(at) > len(row) else (at, row[at]))
    return out


def accumulate(query: np.ndarray, lists: list, scores: np.ndarray, scratch: np.ndarray) -> None:
    """Scores of all rows for one query, one term after another."""
    scores[:] = 0
    for term in np.flatnonzero(query[: len(lists)]).tolist():
        at, weights = lists[term]
        if at is None:
            np.multiply(weights, query[term], out=scratch)
            scores += scratch
        else:
            scores[at] += weights * query[term]


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids; ids rise."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    return np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])


class _Cell:
    """The queries of one cell, and the best rows that each has met so far."""

    def __init__(self, k: int):
        self.k, self.number, self.queries, self.found = k, [], [], []
        self.waiting, self.held = [], 0

    def query(self, number, weights) -> None:
        self.number.append(number), self.queries.append(weights), self.found.append(None)

    def rows(self, number, ids, weights) -> None:
        self.waiting.append((number, ids, weights))
        self.held += len(ids)
        if self.held >= ROWS:
            self.score()

    def score(self) -> None:
        if not self.held:
            return
        number, ids = (np.concatenate([w[i] for w in self.waiting]) for i in (0, 1))
        weights = [x for w in self.waiting for x in w[2]]
        self.waiting, self.held = [], 0
        order = np.lexsort((number, ids))
        number, ids, weights = number[order], ids[order], [weights[i] for i in order]
        lists = postings(weights)
        widest = max((np.abs(w).max() for w in weights if len(w)), default=0)
        for q, query in enumerate(self.queries):
            if not q or small != (len(query) * int(widest) * int(np.abs(query).max(initial=0)) < 1 << 31):
                small = len(query) * int(widest) * int(np.abs(query).max(initial=0)) < 1 << 31  # then 32 bits hold every sum
                kind = np.int32 if small else np.int64
                typed = [(at, w.astype(kind)) for at, w in lists]
                scores, scratch = np.zeros(len(ids), kind), np.zeros(len(ids), kind)
            accumulate(query.astype(kind), typed, scores, scratch)
            top = best(scores, ids, self.k + 1)  # the query's own row may be among them
            top = top[number[top] != self.number[q]]
            s, i, n = scores[top].astype(np.int64), ids[top], number[top]
            if self.found[q] is not None:
                s, i, n = (np.concatenate(x) for x in zip(self.found[q], (s, i, n)))
            top = np.lexsort((n, i, -s))[: self.k]
            self.found[q] = s[top], i[top], n[top]

    def result(self) -> pd.DataFrame | None:
        self.score()
        full = [(q, f) for q, f in zip(self.number, self.found) if f is not None and len(f[0])]
        if not full:
            return None
        return pd.DataFrame({"query": np.repeat([q for q, _ in full], [len(f[0]) for _, f in full]), "candidate": np.concatenate([f[2] for _, f in full]), "id": np.concatenate([f[1] for _, f in full]), "score": np.concatenate([f[0] for _, f in full])})


def _scored(k: int):
    """Runs over partitions sorted by cell, queries before candidates."""

    def run(frames):
        cell, at = None, None
        try:
            for frame in frames:
                cells, asks, number = (frame[c].to_numpy() for c in ("cell", "asks", "number"))
                ids, weights = frame["id"].to_numpy(), frame["weights"].to_numpy()
                edge = np.flatnonzero((np.diff(cells, prepend=cells[:1] - 1) != 0) | (np.diff(asks, prepend=asks[:1]) != 0))
                for lo, hi in zip(edge, [*edge[1:], len(cells)]):
                    if cells[lo] != at:
                        if cell is not None and (rows := cell.result()) is not None:
                            yield rows
                        cell, at = _Cell(k), cells[lo]
                    if asks[lo] == 0:
                        for n, w in zip(number[lo:hi].tolist(), weights[lo:hi]):
                            cell.query(n, w)
                    else:
                        cell.rows(number[lo:hi], ids[lo:hi], list(weights[lo:hi]))
            if cell is not None and (rows := cell.result()) is not None:
                yield rows
        finally:
            released()

    return run


def rows_of(vectors: DataFrame, asks, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """number (its own for each row), id (null ids become the largest), null_id, asks, weights; unusable vectors are left out."""
    x = F.col(vector)
    usable = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) != F.lit(float("inf"))))
    scaled = F.transform(x, lambda v: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(v.cast("double") * F.lit(float(scale))))).cast("int"))
    return vectors.where(usable).select(F.monotonically_increasing_id().alias("number"), F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.col(key).isNull().alias("null_id"), F.coalesce(asks, F.lit(False)).alias("asks"), scaled.alias("weights"))


def search(vectors: DataFrame, asks, k: int = K, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows of highest integer inner product for every row where the condition `asks` holds.

    vectors: `key` (an integer), `vector` (an array of numbers) and any other columns, which `asks` may
    use. Gives query_id, rank (from 1), vec_id, score; all other rows if there are fewer than k. Ties go to
    smaller ids, then to either row. Vectors that are null or hold a null, NaN or infinity take no part,
    neither as query nor as candidate. A repeated row is another candidate, also of its copies, and asks
    for itself. A null id never asks unless `asks` says so, and as a candidate it stands after all ids. An
    empty vector scores 0; vectors of unequal length count as ending in zeros. An empty table, or one
    without queries, gives no rows. Scaled components are held within 2**30."""
    spark = vectors.sparkSession
    held = saved(rows_of(vectors, asks, scale, key, vector), "vectors")
    n, wanted = held.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    blocks, shards = max(1, -(-wanted // QUERIES)), max(1, -(-n // SHARD), min(SHARDS, n // 1024))
    deal = lambda name, parts: F.pmod(F.xxhash64("number", F.lit(name)), F.lit(parts)).cast("int")
    to = lambda parts: F.sequence(F.lit(0), F.lit(parts - 1))
    common = ("number", "id", "weights")
    queries = held.where("asks").select(*common, deal("block", blocks).alias("block"), F.explode(to(shards)).alias("shard"), F.lit(0).alias("asks"))
    rows = held.select(*common, F.explode(to(blocks)).alias("block"), deal("shard", shards).alias("shard"), F.lit(1).alias("asks"))
    cells = queries.unionByName(rows).select((F.col("block").cast("long") * shards + F.col("shard")).alias("cell"), "asks", *common)
    spread = cells.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(blocks * shards, 20_000)), "cell").sortWithinPartitions("cell", "asks")
    met = spread.mapInPandas(_scored(k), "query long, candidate long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id", "candidate")).alias("rank")
    top = met.select("query", "candidate", "id", "score", rank).where(F.col("rank") <= k)
    names = held.where("asks").select(F.col("number").alias("query"), F.when(~F.col("null_id"), F.col("id")).alias("query_id"))
    # a null id and the largest id are one number in the cells: only rows there have to ask which it was
    last = held.where("null_id").select(F.col("number").alias("candidate"), F.lit(True).alias("nameless"))
    found = top.join(names, "query").join(last, "candidate", "left")
    return found.select("query_id", "rank", F.when(F.col("nameless").isNull(), F.col("id")).alias("vec_id"), "score")


def nearest(spark, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by EVERY against all rows of `embeddings`."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


ORACLE = f"""with usable as (select row_number() over () n, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)) w from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
met as (select q.n, q.vec_id query_id, c.vec_id, cast(list_inner_product(q.w, c.w) as bigint) score from usable q join usable c on q.vec_id % {EVERY} = 0 and q.n <> c.n),
ranked as (select *, row_number() over (partition by n order by score desc, vec_id nulls last) rank from met)
select query_id, cast(rank as int) rank, vec_id, score from ranked where rank <= {K}"""
