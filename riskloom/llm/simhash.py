"""Operator 4: SimHash near-duplicates by multi-index hashing.

Fingerprints are 64-bit majority votes over XXH64 of word shingles. Distinct fingerprints are cut
into two 32-bit segments. Two fingerprints that differ in at most 3 bits differ in at most 1 bit in
one of them, so each probes the 33 values of the Hamming ball of radius 1 in each segment, fetches
the table's entries there, and keeps those whose complete distance is small enough. A segment value
has 2**32 places, so the entries met by chance stay far below one per probe; copies are one entry.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.base import lean, saved, text_or_empty
from riskloom.llm.components import components
from riskloom.llm.kernels import buffers

WORDS, SEED, DISTANCE = 3, 42, 3
#: Texts above this many bytes are shingled in stretches, so their words are never all in memory.
STRETCH = 1 << 22


def _votes(w: list[bytes], words: int) -> tuple[np.ndarray, int]:
    """Set bits by position over the hashes of all shingles of w, and the number of shingles."""
    from xxhash import xxh64_intdigest

    n = len(w) - words + 1
    if n <= 0:
        return np.zeros(64, np.int64), 0
    h = np.fromiter(map(xxh64_intdigest, map(b" ".join, zip(*(w[i:] for i in range(words)))), repeat(SEED)), np.uint64, n)
    lanes = h.view(np.uint8).reshape(n, 8)
    if n < 2000:
        return np.unpackbits(lanes, axis=1, bitorder="little").sum(0, dtype=np.int64), n
    table = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
    return np.concatenate([np.bincount(lanes[:, k], minlength=256) @ table for k in range(8)]), n


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Signed 64-bit fingerprint of one UTF-8 text; 0 where it has no word."""
    text = text.lower() if len(text) <= STRETCH else text
    if len(text) <= STRETCH:
        w = text.split()
        votes, n = _votes(w, words) if len(w) >= words else _votes([b" ".join(w)], 1) if w else (np.zeros(64, np.int64), 0)
    else:
        votes, n, tail, seen, at = np.zeros(64, np.int64), 0, b"", [], 0
        while at < len(text):
            block = tail + text[at : at + STRETCH].lower()
            at += STRETCH
            cut = len(block)
            if at < len(text):  # the last word may go on
                while cut and block[cut - 1] not in b" \t\n\r\x0b\x0c":
                    cut -= 1
            tail = block[cut:]
            seen = seen + block[:cut].split()
            v, m = _votes(seen, words)
            votes, n = votes + v, n + m
            seen = seen[-(words - 1) :] if words > 1 else []
        if not n and seen:
            votes, n = _votes([b" ".join(seen)], 1)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    def run(batches):
        for batch in batches:
            data, at = buffers(batch.column("text"))
            got = [fingerprint(data[a:b].tobytes(), words) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got, pa.int64())], names=["doc_id", "fp"])

    return text_or_empty(docs).mapInArrow(lean(run), "doc_id long, fp long")


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs (a > b) of different fingerprints fp at most `distance` (3 at most) bits apart."""
    if not 0 <= distance <= 3:
        raise ValueError("two segments with balls of radius 1 find distances up to 3")
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    second = F.lit(1 << 32)
    entries = prints.select("fp", F.explode(F.array(high, low.bitwiseOR(second))).alias("place"))
    ball = F.array(F.lit(0).cast("long"), *(F.lit(1 << b).cast("long") for b in range(32)))
    probes = entries.select(F.col("fp").alias("probe"), "place").select("probe", F.explode(F.transform(ball, lambda m: F.col("place").bitwiseXOR(m))).alias("place"))
    close = F.bit_count(F.col("probe").bitwiseXOR(F.col("fp"))) <= distance
    return probes.join(entries, (probes["place"] == entries["place"]) & (F.col("probe") > F.col("fp")) & close).select(F.col("probe").alias("a"), F.col("fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links).

    Null and empty texts and texts of white space have fingerprint zero and link like any other; a
    null doc_id is never the smallest unless its component has no other; repeated rows stay; an empty
    table gives no rows."""
    prints = saved(fingerprints(docs, words), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(nodes.select("fp"), distance))
    roots = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    roots = saved(roots, "roots")
    smallest = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(roots.select("fp", "root").join(smallest, "root"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
