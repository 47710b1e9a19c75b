"""Operator 5: benchmark decontamination by latent semantic retrieval.

Passages are made of blocks of BLOCK words. Passage frequencies are counted over all
documents for the words of a block of items (a word of no item can't bring a passage nearer to one);
the latent space comes from a randomised SVD (range finder with one power step) of TF-IDF
blocks, fitted on all documents plus the benchmark by how much each two words meet in a block. Every
passage of every document, two and four blocks wide, is projected and compared by cosine with every
item of a block of items; a longer item is searched for by its windows of four blocks, since no passage
holds enough of it. Candidates are then judged on their words: a longest common subsequence
covering most of the item, and the item's answer (its `answer` column, or else its last third) found
as a subsequence too, so that paraphrases count and shared topics don't.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.base import lean, saved, text_or_empty
from riskloom.llm.kernels import LOWER, chunks, span_hashes, words
from riskloom.llm.toxicity import TERM

RANK, EXTRA, BLOCK = 192, 16, 12
#: Terms in more than this share of passages are stop words of the retrieval (not of the checks).
COMMON = 0.004
#: A candidate's cosine with the item, and its dot product as a share of the item's own, at least.
COSINE, CONTAINED = 0.5, 0.4
#: Share of the item's words in the longest common subsequence, and of its answer's.
COVER, ANSWER = 0.6, 0.5
#: Weight of all documents together against an item's 20 in the fit of the latent space, and bound: items (a long one counts by its windows) searched for in one pass.
FIT_DOCS, ITEMS = 2000, 1000
#: Terms a row of a task's sum holds.
ROWS = 512
#: Leading bits of a word's hash that rule out most words of no item.
PREFIX = 18
#: Words of a window of a long item, and of the longest item searched for whole: COVER of it in the widest passage still exceeds CONTAINED.
WINDOW, WHOLE = 4 * BLOCK, 5 * BLOCK
U = np.uint64


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = LOWER[data]
    s, e, row = words(data, at, TERM)
    return span_hashes(data, s, e), row


def blocks(row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First token of each block, and the block's row."""
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.searchsorted(row, np.arange(rows))
    start = np.flatnonzero((np.arange(len(row)) - first[row]) % BLOCK == 0)
    return start, row[start]


def term_ids(h: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """The place of a word hash in the sorted vocabulary, or -1."""
    out = np.full(len(h), -1)
    if len(vocabulary):
        may = np.zeros(1 << PREFIX, bool)
        may[vocabulary >> U(64 - PREFIX)] = True
        at = np.flatnonzero(may[h >> U(64 - PREFIX)])
        place = np.minimum(np.searchsorted(vocabulary, h[at]), len(vocabulary) - 1)
        out[at] = np.where(vocabulary[place] == h[at], place, -1)
    return out


def frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """Number of passages (four blocks) that hold each term, and of passages, over all documents."""
    size = len(vocabulary)

    def run(batches):
        total = np.zeros(size + 1, np.int64)
        for batch in batches:
            for lo, hi, data, at in chunks(batch.column("text"), 1 << 20):
                h, row = tokens(data, at)
                start, _ = blocks(row, hi - lo)
                which = np.zeros(len(h), np.int64)
                which[start] = 1
                idx = term_ids(h, vocabulary)
                known = np.flatnonzero(idx >= 0)
                key = np.sort((np.cumsum(which) // 4)[known] * size + idx[known])
                total[:size] += np.bincount(key[np.flatnonzero(np.diff(key, prepend=-1))] % max(1, size), minlength=size)
                total[size] += len(start) // 4 + 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1)), pa.array(total)], names=["term", "many"])

    got = docs.select("text").mapInArrow(lean(run), "term long, many long").groupBy("term").agg(F.sum("many").alias("many")).toPandas()  # one row per term of a bounded set
    out = np.zeros(size + 1, np.int64)
    out[got["term"]] = got["many"]
    return out[:-1], int(out[-1])


def vectors(idx: np.ndarray, row: np.ndarray, rows: int, weighted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Projected TF-IDF sums of the blocks that hold a known word, these blocks, and all blocks' first tokens and rows."""
    start, brow = blocks(row, rows)
    at = np.flatnonzero(idx >= 0)
    of = np.searchsorted(start, at, "right") - 1
    edge = np.flatnonzero(np.diff(of, prepend=-1))
    many = np.diff(edge, append=len(of))
    out = weighted[idx[at[edge]]]
    for k in range(1, int(many.max(initial=0))):
        more = np.flatnonzero(many > k)
        out[more] += weighted[idx[at[edge[more] + k]]]
    return out, of[edge], start, brow


def known_terms(data: np.ndarray, at: np.ndarray, rows: int, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Block and place in the vocabulary of each known word of a piece of texts; blocks don't cross texts."""
    h, row = tokens(data, at)
    start, _ = blocks(row, rows)
    idx = term_ids(h, vocabulary)
    known = np.flatnonzero(idx >= 0)
    return np.searchsorted(start, known, "right") - 1, idx[known]


def known_blocks(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(block, term): the known words of all documents, a row a piece of texts."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, at in chunks(batch.column("text"), 1 << 20):
                of, idx = known_terms(data, at, hi - lo, vocabulary)
                if len(idx):
                    yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for x in (of, idx)], names=["block", "term"])

    return docs.select("text").mapInArrow(lean(run), "block array<int>, term array<int>")


def together(of: np.ndarray, idx: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, g), each i and j once: g adds up 1 / |block|**2 over the pairs of words i and j in a block; a word meets itself too."""
    size = len(idf)
    block = np.cumsum(np.diff(of, prepend=-1) != 0) - 1
    weight = 1 / np.bincount(block, idf[idx].astype(float) ** 2).clip(1e-6)
    keys, g = [idx.astype(np.int64) * (size + 1)], [weight[block]]
    for d in range(1, BLOCK):
        x = np.flatnonzero(block[d:] == block[:-d])
        i, j = idx[x].astype(np.int64), idx[x + d].astype(np.int64)
        keys += [i * size + j, j * size + i]
        g += [weight[block[x]]] * 2
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return key // max(1, size), key % max(1, size), np.bincount(at, np.concatenate(g), minlength=len(key))


def pairs_met(known: DataFrame, idf: np.ndarray) -> DataFrame:
    """(i, j, g) as `together` gives them, over all rows of `known_blocks`."""

    def run(batches):
        for batch in batches:
            for of, idx in zip(batch.column("block"), batch.column("term")):
                i, j, g = together(of.values.to_numpy(), idx.values.to_numpy(), idf)
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(g)], names=["i", "j", "g"])

    return known.mapInArrow(lean(run), "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g"))


def _added(group):
    import pandas as pd

    return pd.DataFrame({"start": group["start"][:1], "z": [np.sum([np.frombuffer(z) for z in group["z"]], 0).tobytes()]})


def latent(known: DataFrame, weight: float, items: list[str], vocabulary: np.ndarray, idf: np.ndarray, seed: int = 11) -> np.ndarray:
    """Randomised SVD: orthonormal basis (terms x RANK) of the strongest right directions.

    known: all documents' words as `known_blocks` gives them, each counting `weight`. They are read once:
    both steps multiply by the sums over pairs of words that meet in a block."""
    met = saved(pairs_met(known, idf), "latent-pairs")
    size = len(idf)
    width = min(size, RANK + EXTRA)
    base = np.random.default_rng(seed).normal(size=(size, width)).astype(np.float32)

    def product(i: np.ndarray, j: np.ndarray, g: np.ndarray, weighted: np.ndarray, out: np.ndarray) -> None:
        """Adds A'(A omega) of word pairs to out, blocks as rows of unit length."""
        order = np.argsort(i, kind="stable")
        i, j, g = i[order], j[order], (g * idf[i])[order].astype(np.float32)
        edge = np.flatnonzero(np.diff(i, prepend=-1))
        if len(edge):
            out[i[edge]] += np.add.reduceat(g[:, None] * weighted[j], edge, axis=0)

    for _ in range(2):
        weighted = base * idf[:, None]

        def run(batches):
            total = np.zeros((size, width))
            for batch in batches:
                product(*(batch.column(k).to_numpy() for k in ("i", "j", "g")), weighted, total)
            for start in range(0, size, ROWS):
                yield pa.RecordBatch.from_pydict({"start": pa.array([start], pa.int32()), "z": [total[start : start + ROWS].tobytes()]})

        total = np.zeros((size, width))
        for lo, hi, data, at in chunks(pa.array(items, pa.string()), 1 << 19):
            product(*together(*known_terms(data, at, hi - lo, vocabulary), idf), weighted, total)
        total *= 20.0
        for r in met.mapInArrow(lean(run), "start int, z binary").groupBy("start").applyInPandas(_added, "start int, z binary").collect():  # a bounded matrix
            total[r["start"] : r["start"] + ROWS] += weight * np.frombuffer(r["z"]).reshape(-1, width)
        base = np.linalg.qr(total + 1e-6 * base)[0].astype(np.float32)
    return np.ascontiguousarray(base[:, :RANK])


def subsequence(masks: dict[int, int], n: int, passage: list[int]) -> int:
    """Length of the longest common subsequence of a passage and an item of n words, bit-parallel."""
    v = full = (1 << n) - 1
    for w in passage:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


class Item:
    def __init__(self, key: int, text: str, answer: str | None):
        self.key = key
        self.words = self._words(text)
        self.n = len(self.words)
        self.masks = self._masks(self.words)
        self.own, self.times = np.unique(np.array(self.words, U), return_counts=True)
        given = self._words(answer or "")
        self.answer = given or self.words[-max(3, self.n // 3) :]
        self.answer_masks = self._masks(self.answer)
        #: Words around a passage that may belong to the item, or to an answer that stands beside it.
        self.reach = self.n + len(given)

    def windows(self) -> list[list[int]]:
        """The item's words whole, or in windows that cover a long item (the last one ends with it)."""
        if self.n <= WHOLE:
            return [self.words]
        return [self.words[min(a, self.n - WINDOW) :][:WINDOW] for a in range(0, self.n, WINDOW)]

    @staticmethod
    def _words(text: str) -> list[int]:
        data = np.frombuffer(text.encode(), np.uint8)
        return tokens(data, np.array([0, len(data)]))[0].tolist()

    @staticmethod
    def _masks(ws: list[int]) -> dict[int, int]:
        out: dict[int, int] = {}
        for i, w in enumerate(ws):
            out[w] = out.get(w, 0) | 1 << i
        return out

    def judge(self, passage: np.ndarray) -> tuple[int, float] | None:
        """(common words, share of the answer) if the passage leaks this item."""
        place = np.minimum(np.searchsorted(self.own, passage), len(self.own) - 1)
        mine = self.own[place] == passage
        if np.minimum(np.bincount(place[mine], minlength=len(self.own)), self.times).sum() < COVER * self.n:  # an upper bound of the subsequence
            return None
        common = subsequence(self.masks, self.n, passage[mine].tolist())
        if common < COVER * self.n:
            return None
        share = subsequence(self.answer_masks, len(self.answer), passage.tolist()) / len(self.answer)  # an answer's words needn't be the item's
        return (common, share) if share >= ANSWER else None


class Search:
    """The latent space of one block of items, ready to judge texts."""

    def __init__(self, items: list[Item], vocabulary: np.ndarray, idf: np.ndarray, base: np.ndarray, cosine: float = COSINE, contained: float = CONTAINED):
        self.items, self.vocabulary, self.cosine, self.contained = items, vocabulary, cosine, contained
        self.weighted = np.ascontiguousarray(base * idf[:, None])
        parts = [(k, w) for k, i in enumerate(items) for w in i.windows()]
        self.of = np.array([k for k, _ in parts], np.int64)
        q = np.stack([self.weighted[k[k >= 0]].sum(0) for k in (term_ids(np.array(w, U), vocabulary) for _, w in parts)]) if items else np.zeros((0, base.shape[1]), np.float32)
        self.size = np.maximum(np.linalg.norm(q, axis=1), 1e-9)
        self.q = np.ascontiguousarray((q / self.size[:, None]).T)

    def candidates(self, h: np.ndarray, row: np.ndarray, rows: int) -> set[tuple[int, int, int, int]]:
        """(row, item, first token, end token) of passages close to an item."""
        b, held, start, brow = vectors(term_ids(h, self.vocabulary), row, rows, self.weighted)
        n = len(start)
        if not len(held) or not self.items:
            return set()
        end = np.append(start[1:], len(h))
        last = np.searchsorted(brow, brow, "right") - 1
        before = np.searchsorted(held, np.arange(n + 1))  # blocks with a known word before a block
        first, until = np.tile(np.arange(n), 2), np.concatenate([np.minimum(np.arange(n) + wide - 1, last) for wide in (2, 4)])
        a, many = before[first], before[until + 1] - before[first]
        # passages that hold the same blocks with known words are alike: each such run of blocks is compared once
        of = np.flatnonzero(many)
        order = of[np.argsort(a[of] * 5 + many[of], kind="stable")]
        edge = np.flatnonzero(np.diff(a[order] * 5 + many[order], prepend=-1))
        size = np.diff(edge, append=len(order))
        a, many = a[order[edge]], many[order[edge]]
        scores = b @ self.q
        out = set()
        for lo in range(0, len(edge), 2048):
            at, k = a[lo : lo + 2048], many[lo : lo + 2048]
            v, dot = b[at], scores[at]
            for j in range(1, 4):
                more = np.flatnonzero(k > j)
                v[more] += b[at[more] + j]
                dot[more] += scores[at[more] + j]
            norm = np.sqrt(np.einsum("ij,ij->i", v, v))
            able = np.flatnonzero(norm >= self.contained * self.size.min())  # no dot product exceeds the norm
            w, i = np.nonzero(dot[able] >= np.maximum(self.cosine * norm[able, None], self.contained * self.size))
            w = able[w] + lo
            i = np.repeat(self.of[i], size[w])
            w = order[np.repeat(edge[w] - np.cumsum(size[w]) + size[w], size[w]) + np.arange(len(i))]
            out.update(zip(brow[first[w]].tolist(), i.tolist(), start[first[w]].tolist(), end[until[w]].tolist()))
        return out

    def leaks(self, data: np.ndarray, at: np.ndarray) -> dict[tuple[int, int], tuple[int, float, int]]:
        """(row, item) -> (common words, share of the answer, first word) of the passage that covers most."""
        rows = len(at) - 1
        h, row = tokens(data, at)
        first = np.searchsorted(row, np.arange(rows + 1))
        found: dict[tuple[int, int], tuple[int, float, int]] = {}
        for r, i, a, b in sorted(self.candidates(h, row, rows)):
            item = self.items[i]
            if (r, i) in found and found[r, i][0] == item.n:
                continue
            a, b = max(int(first[r]), a - item.reach), min(int(first[r + 1]), b + item.reach)
            got = item.judge(h[a:b])
            if got and got > found.get((r, i), (0, 0.0, 0))[:2]:
                found[r, i] = (*got, a - int(first[r]))
        return found


def _blocks(rows):
    """Lists of (item, text) with ITEMS queries at most, or of one item with more."""
    block, many = [], 0
    for r in rows:
        item = Item(r["item_id"], r["text"], r["answer"])
        size = len(item.windows())
        if block and many + size > ITEMS:
            yield block
            block, many = [], 0
        block.append((item, r["text"]))
        many += size
    if block:
        yield block


def prepared(docs: DataFrame, benchmark: DataFrame) -> list[Search]:
    """A search for each block of at most ITEMS items; every block is searched for in all documents."""
    docs = text_or_empty(docs)
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    rows = benchmark.where(F.col("text").isNotNull()).select("item_id", "text", answer.alias("answer")).orderBy("item_id", "text").toLocalIterator()
    total = max(1, docs.count())
    out = []
    for block in _blocks(rows):
        items = [i for i, _ in block if i.n]
        vocabulary = np.unique(np.array([w for i in items for w in i.words], U))
        df, n = frequencies(docs, vocabulary)
        rare = df <= COMMON * n
        keep = rare | np.isin(vocabulary, np.array([w for i in items if rare[term_ids(i.own, vocabulary)].sum() < 3 for w in i.words], U))
        vocabulary, df = vocabulary[keep], df[keep]
        idf = np.log((1 + n) / (1 + df)).astype(np.float32)
        out.append(Search(items, vocabulary, idf, latent(known_blocks(docs, vocabulary), min(1.0, FIT_DOCS / total), [text for _, text in block], vocabulary, idf)))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, common_words, item_words, answer_share, first_word) for each leak found.

    Null and empty texts, and items without a word, never match. A null doc_id keeps its rows; repeated
    rows and items repeat theirs. An empty benchmark or table gives no rows."""
    searches = prepared(docs, benchmark)
    kinds = {"doc_id": pa.int64(), "item_id": pa.int64(), "common_words": pa.int64(), "item_words": pa.int64(), "answer_share": pa.float64(), "first_word": pa.int64()}

    def run(batches):
        for batch in batches:
            for lo, hi, data, at in chunks(batch.column("text"), 1 << 20):
                ids = batch.column("doc_id").slice(lo, hi - lo).to_pylist()
                rows = [(ids[r], s.items[i].key, c, s.items[i].n, share, w) for s in searches for (r, i), (c, share, w) in s.leaks(data, at).items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds.values())], names=list(kinds))

    return text_or_empty(docs).mapInArrow(lean(run), "doc_id long, item_id long, common_words long, item_words long, answer_share double, first_word long")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that leak an item; columns and the other rows stay as they are."""
    searches = prepared(docs, benchmark)

    def run(batches):
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for lo, hi, data, at in chunks(batch.column(batch.schema.get_field_index("text")), 1 << 20):
                for s in searches:
                    for r, _ in s.leaks(data, at):
                        keep[lo + r] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(lean(run), docs.schema)
