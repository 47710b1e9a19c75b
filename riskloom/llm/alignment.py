"""Operator 12: alignment of two tokenizers' tokens by their byte ends.

Both tokenizers are run over the same bytes. Two pointers run over the cumulative ends of their tokens:
where both stand at one offset a group closes, and the pairs of tokens that end there are links. Spark
counts the pairs over all documents, finds each side's largest counts, and joins them back to the links.

A text is cut before each single space between two other characters. Neither vocabulary has a token
across such a place (the byte-level pattern starts a new word at it, no piece holds a space after
another character; `Pair` looks through the pieces), so parts are tokenized and aligned by themselves,
each distinct one once while a worker remembers it. Groups of a text are those of its parts in order.

Linked tokens end together over the same bytes, so one is the other's suffix: the pairs that can occur
are bounded by the two vocabularies alone (`bound`), and their counts may be broadcast.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.base import released, saved, table
from riskloom.llm.bpe import _byte_letters

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Parts that a worker remembers, the longest that the quick merges take, and the characters of texts worked on at once.
REMEMBERED, SHORT, OUT = 300_000, 64, 1 << 20
#: What stands after an id of side a, of the last one of a group on either side, and of the last one of a part.
SEPARATORS = (",", "|", ";", "")
ALIGNED = "number long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<bigint>, times array<int>"
_HIGH = 1 << 32
_loaded: dict[tuple[str, str], "Pair"] = {}


def merged(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b of the ends that both have; both rise.

    The stable sort merges two rising runs with one pointer in each; an end of both then stands twice, a's first."""
    order = np.argsort(np.concatenate([ends_a, ends_b]), kind="stable")
    ends = np.concatenate([ends_a, ends_b])[order]
    first = np.flatnonzero(ends[1:] == ends[:-1])
    return order[first], order[first + 1] - len(ends_a)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All values, and where each list starts (and the last one ends)."""
    return np.fromiter(chain.from_iterable(lists), np.int64), np.concatenate([[0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))])


class Pair:
    """Both vocabularies, their tokens' bytes, and the parts aligned so far."""

    def __init__(self, byte_bpe: str, piece_bpe: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(byte_bpe)
        self.whole.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_bpe)
        letters = _byte_letters()
        spec = json.load(open(byte_bpe, encoding="utf-8"))
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.quick = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        named = {i: t for t, i in ranks.items()} | {i: t.encode() for t, i in special.items()}
        self.bytes_a = [named.get(i, b"") for i in range(max(named) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)
        self.forget()

    def forget(self) -> None:
        """Remembered parts: their place, whether they have tokens, counts of a, b and links, their links, their groups as text."""
        self.place: dict[str, int] = {}
        self.counts, self.at, self.links = np.zeros((0, 4), np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64)
        self.texts: list[bytes] = []

    def bound(self) -> int:
        """Pairs of tokens of which one is a suffix of the other: no more can ever be linked."""
        a, b = Counter(self.bytes_a), Counter(self.bytes_b)
        longer = lambda x, y: sum(n * y[t[i:]] for t, n in x.items() for i in range(1, len(t)))
        return longer(a, b) + longer(b, a) + sum(n * b[t] for t, n in a.items())

    def ids_a(self, text: str) -> list[int]:
        """As `tokenizers` gives them. The same merges run quicker on short Latin text, where both know every character."""
        return self.quick(text) if len(text) <= SHORT and max(text) < "\u0250" else self.whole.encode(text, add_special_tokens=False).ids

    def learn(self, parts: list[str]) -> None:
        """Tokenize and align parts (each with a space before it) that aren't remembered."""
        wholes = [(" " + p).encode() for p in parts]
        ids_a, ids_b = [self.ids_a(" " + p) for p in parts], self.b.encode(parts, num_threads=1)
        same = [b"".join([self.bytes_a[i] for i in a]) == w == b"".join([self.bytes_b[i] for i in b]) for w, a, b in zip(wholes, ids_a, ids_b)]
        ids_a, ids_b = ([x if ok else [] for ok, x in zip(same, ids)] for ids in (ids_a, ids_b))
        (a, at_a), (b, at_b) = _flat(ids_a), _flat(ids_b)
        i, j = merged(np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]))  # parts end together, so no group spans two
        # a group's text: its a ids, "|" after the last, then its b ids; ";" follows, or nothing at the part's end
        marks_a, marks_b = np.zeros(len(a), np.int8), np.zeros(len(b), np.int8)
        marks_a[i], marks_b[j] = 1, 2
        marks_b[at_b[1:][at_b[1:] > at_b[:-1]] - 1] = 3
        group_a, group_b = np.searchsorted(i, np.arange(len(a))), np.searchsorted(j, np.arange(len(b)))
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        ids, marks = np.concatenate([a, b])[order].tolist(), np.concatenate([marks_a, marks_b])[order].tolist()
        words = [f"{n}{SEPARATORS[m]}" for n, m in zip(ids, marks)]
        cut = (at_a + at_b).tolist()
        n_links = np.searchsorted(i, at_a)
        base = len(self.place)
        self.place.update((p, base + k) for k, p in enumerate(parts))
        self.texts.extend("".join(words[x:y]).encode() for x, y in zip(cut, cut[1:]))
        self.counts = np.concatenate([self.counts, np.stack([np.array(same, np.int64), np.diff(at_a), np.diff(at_b), np.diff(n_links)], axis=1)])
        self.at = np.concatenate([self.at, self.at[-1] + n_links[1:]])
        self.links = np.concatenate([self.links, a[i] * _HIGH + b[j]])

    def documents(self, texts: list[str | None]):
        """Yield (n_a, n_b, n_groups, n_links, groups_sha256, distinct links, times each occurs) for each text, None where it has no tokens."""
        if len(self.place) > REMEMBERED or len(self.links) > 8 * REMEMBERED:
            self.forget()
        split = [(CUT.split(t) if self.cuts else [t]) if t else [] for t in texts]
        if new := [p for p in dict.fromkeys(chain.from_iterable(split)) if p not in self.place]:
            self.learn(new)
        for parts in split:
            at = [self.place[p] for p in parts]
            rows = np.array(at, np.int64)
            ok, n_a, n_b, n_links = (self.counts[rows, k] for k in range(4))
            if not parts or not ok.all():
                yield None
                continue
            ends = np.cumsum(n_links)
            keys, times = np.unique(self.links[np.repeat(self.at[rows] - (ends - n_links), n_links) + np.arange(ends[-1])], return_counts=True)
            digest = hashlib.sha256(b";".join([self.texts[k] for k in at])).hexdigest()
            yield int(n_a.sum()), int(n_b.sum()), int(ends[-1]), int(ends[-1]), digest, keys, times.astype(np.int32)


def load(byte_bpe: str, piece_bpe: str) -> Pair:
    if (byte_bpe, piece_bpe) not in _loaded:
        _loaded[byte_bpe, piece_bpe] = Pair(byte_bpe, piece_bpe)
    return _loaded[byte_bpe, piece_bpe]


def aligned(docs: DataFrame, byte_bpe: str, piece_bpe: str) -> DataFrame:
    """A row for each document: its counts, the digest of its groups, its distinct links and how often each occurs."""
    none = (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int32))

    def run(frames):
        pair = load(byte_bpe, piece_bpe)
        try:
            for frame in frames:
                size = np.cumsum(frame["text"].str.len().fillna(0).to_numpy(np.int64))
                lo = 0
                while lo < len(frame):
                    hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + OUT, "right")))
                    some, lo = frame.iloc[lo:hi], hi
                    got = [x or none for x in pair.documents([t if isinstance(t, str) else None for t in some["text"]])]
                    out = pd.DataFrame({"number": some["number"].to_numpy(), "doc_id": some["doc_id"].astype("Int64").array})
                    for i, name in enumerate(("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times")):
                        out[name] = pd.Series([g[i] for g in got], dtype=object if i > 3 else np.int64)
                    yield out
        finally:
            pair.forget()
            released()

    rows = docs.select(F.monotonically_increasing_id().alias("number"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, ALIGNED)


def links(held: DataFrame) -> DataFrame:
    """number, a, b, times: a document's distinct links."""
    one = held.select("number", F.explode(F.arrays_zip("pairs", "times")).alias("l"))
    return one.select("number", F.shiftright("l.pairs", 32).cast("int").alias("a"), F.col("l.pairs").bitwiseAND(F.lit(_HIGH - 1)).cast("int").alias("b"), F.col("l.times").alias("times"))


def pair_counts(held: DataFrame) -> DataFrame:
    """a, b, pair_count (links of the pair in all documents), best_of_a and best_of_b: whether it is its id's highest."""
    counts = links(held).groupBy("a", "b").agg(F.sum("times").alias("pair_count"))
    highest = lambda side: F.max("pair_count").over(Window.partitionBy(side))
    return counts.select("a", "b", "pair_count", (F.col("pair_count") == highest("a")).alias("best_of_a"), (F.col("pair_count") == highest("b")).alias("best_of_b"))


def align(docs: DataFrame, byte_bpe: str | None = None, piece_bpe: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best (links that are their b id's most frequent pair, ties
    included), count_sum (the pair counts of its links, added up), groups_sha256, and n_best_a, the same for the a id.

    docs: doc_id, text, any other columns. Null and empty texts, and texts whose tokens of either side don't
    give back a space and the text byte by byte, have no tokens: zeros and an empty digest. A null doc_id
    stays null; repeated rows are documents of their own and count each; an empty table gives no rows."""
    byte_bpe, piece_bpe = byte_bpe or public_tokenizers.path(BYTE_BPE), piece_bpe or public_tokenizers.path(PIECE_BPE)
    held = saved(aligned(docs, byte_bpe, piece_bpe), "aligned")
    counts = saved(pair_counts(held), "pair-counts")  # at most `Pair.bound` rows, whatever the documents
    with_counts = links(held).join(F.broadcast(counts), ["a", "b"])
    times = F.col("times").cast("long")
    sums = with_counts.groupBy("number").agg(F.sum(F.when(F.col("best_of_b"), times)).alias("n_best"), F.sum(F.when(F.col("best_of_a"), times)).alias("n_best_a"), F.sum(times * F.col("pair_count")).alias("count_sum"))
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name)
    return held.select("number", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "number", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256", zero("n_best_a"))


def documents(spark, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
