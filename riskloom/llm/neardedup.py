"""Near-dedup by similarity: MinHash bands over shingle sets, then exact Jaccard.

The pipeline's form of operator 4. A text's node is the text itself (its 64-bit hash); its distinct
five-word shingles give BANDS keys of ROWS minima each, and texts that share a key are candidates: a
pair of Jaccard similarity s shares one with probability 1 - (1 - s**ROWS)**BANDS, whatever its
length, 0.998 at SIMILARITY. Every candidate pair is either compared by its shingle sets or already
known to be in one group or surely not similar: in turns, each text meets one leader for each of its
keys, and the groups of what is similar are formed; then all texts of different groups that share a key
meet each other, whatever a leader said of them. So a group of thousands of copies gives stars of links,
not all its pairs. Texts alike but under SIMILARITY, which never form a group, are told apart within the
join by their sketches: bit h mod SKETCH of a text's sketch is the parity of its distinct shingles there,
so two sketches differ in no more bits than the sets in shingles. A pair whose sketches differ in more
bits than SIMILARITY allows is ruled out without loss and makes no row.

Before the bands operator 4 links texts by its fingerprints, with the same exact check. Alone these can't
do this stage's job: at a similarity of 0.8 a 64-bit fingerprint differs in some 10 bits, far beyond balls
that can be enumerated (measured: 0.76 to 0.79 of such pairs found with three fingerprints and balls of
radius 1). The bands are the way for the rest.
"""

from functools import reduce
from itertools import count
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import simhash
from riskloom.llm.base import discard, lean, saved, text_or_empty
from riskloom.llm.components import components
from riskloom.llm.kernels import LOWER, SPACE, chunks, mix, span_hashes, words
from riskloom.llm.membership import possibly_in

WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 12, 4
#: Leaders are met in turn until the pairs left (met by their sketches first) are this many times the entries, or no longer grow fewer.
LINEAR = 128
#: Bits of a sketch, a power of two.
SKETCH = 1024
U = np.uint64
#: One odd multiplier for each minimum.
FACTORS = np.random.default_rng(6).integers(0, 1 << 64, BANDS * ROWS, dtype=U) | U(1)


def shingles(data: np.ndarray, at: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of word shingles (A-Z lowered) in order, with rows; a shorter text is one shingle."""
    data = LOWER[data]
    s, e, row = words(data, at, ~SPACE)
    h = span_hashes(data, s, e)
    n = np.bincount(row, minlength=len(at) - 1)
    first = np.cumsum(n) - n
    out = np.zeros(len(h), U)
    k = np.minimum(size, n[row])
    for j in range(size):
        use = np.minimum(np.arange(len(h)) + j, len(h) - 1)
        out = np.where(j < k, mix(out + h[use] + U(j + 1)), out)
    keep = (np.arange(len(h)) - first[row]) < np.maximum(1, n[row] - size + 1)
    return out[keep], row[keep]


def band_keys(h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """BANDS x rows hashes of ROWS minima each; texts without a word share all theirs."""
    out = np.zeros((BANDS, rows), U)
    edge = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    for k, factor in enumerate(FACTORS):
        band = out[k // ROWS]
        least = np.full(rows, ~U(0))
        if len(edge):
            least[row[edge]] = np.minimum.reduceat(h * factor, edge)
        band[:] = mix((band ^ mix(least)) + U(k + 1))
    return out


def distinct(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct hashes, sorted."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], row[new]


def sketches(h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """rows x SKETCH / 64 words: parity of the distinct hashes that fall on each bit."""
    odd = (np.bincount(row * SKETCH + (h >> U(64 - SKETCH.bit_length() + 1)).astype(np.int64), minlength=rows * SKETCH) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(rows, SKETCH), axis=1, bitorder="little").view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, node, BANDS keys, number of distinct shingles (size) and sketch (marks) of each text."""

    def lists(x: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(np.ascontiguousarray(x).ravel()))

    def run(batches):
        for batch in batches:
            for lo, hi, data, at in chunks(batch.column("text"), 1 << 20):
                h, row = distinct(*shingles(data, at))
                for a in range(0, hi - lo, 1000):
                    n = min(1000, hi - lo - a)
                    x, y = np.searchsorted(row, [a, a + n])
                    hs, of = h[x:y], row[x:y] - a
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo + a, n), batch.column("node").slice(lo + a, n), lists(np.ascontiguousarray(band_keys(hs, of, n).T).view(np.int64)), pa.array(np.bincount(of, minlength=n)), lists(sketches(hs, of, n))], names=["doc_id", "node", "keys", "size", "marks"])

    return docs.select("doc_id", "node", "text").mapInArrow(lean(run), "doc_id long, node long, keys array<long>, size long, marks array<long>")


def meetings(nodes: DataFrame) -> DataFrame:
    """(key, node) of every key that more than one node has."""
    entries = nodes.select("node", F.explode("keys").alias("key"))
    shared = entries.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("key")
    return entries.join(shared, "key")


def mixed(met: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, node, root, lo) of keys with several groups (node, root); lo is their smallest root."""
    held = met.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    several = held.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key", "lo")
    return held.join(several, "key")


def _pairs(x, y) -> list:
    return [F.greatest(x, y).alias("a"), F.least(x, y).alias("b")]


def star(held: DataFrame, turn: int) -> DataFrame:
    """Distinct pairs (a > b) of a node and its key's leader, if in different groups; each turn and key has another leader."""
    lead = F.min(F.struct(F.xxhash64("node", "key", F.lit(turn)).alias("turn"), F.col("node").alias("node"), F.col("root").alias("root")))
    led = held.groupBy("key").agg(lead.alias("lead"))
    return held.join(led, "key").where("root <> lead.root").select(*_pairs("node", "lead.node")).distinct()


def across(held: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Distinct pairs (a > b) of all nodes that share a key, are in different groups and may be similar.

    The group of the smallest root in a key, mostly the largest one, only stands on the other side,
    so its members don't meet each other. Sets of sizes m and n can only reach the similarity s if they
    differ in at most (m + n)(1 - s) / (1 + s) shingles, and their sketches in no more bits."""
    held = held.join(nodes.select("node", "size", "marks"), "node")
    x = held.where("root > lo").select("key", F.col("node").alias("x"), F.col("root").alias("xr"), F.col("size").alias("xs"), F.col("marks").alias("xm"))
    y = held.select(F.col("key").alias("ykey"), F.col("node").alias("y"), F.col("root").alias("yr"), F.col("size").alias("ys"), F.col("marks").alias("ym"))
    differ = reduce(add, (F.bit_count(F.get("xm", F.lit(i)).bitwiseXOR(F.get("ym", F.lit(i)))) for i in range(SKETCH // 64)))
    may = (differ * (1 + similarity) <= (F.col("xs") + F.col("ys")) * (1 - similarity) + 1e-6) & (F.least("xs", "ys") >= F.greatest("xs", "ys") * similarity - 1e-6)
    return x.join(y, (F.col("key") == F.col("ykey")) & (F.col("xr") > F.col("yr")) & may).select(*_pairs("x", "y")).distinct()


def printed(own: DataFrame) -> DataFrame:
    """Distinct pairs (a > b) of nodes that operator 4 links: of equal fingerprints each with the smallest node, which meets those of linked fingerprints."""
    prints = saved(simhash.fingerprints(own.select(F.col("node").alias("doc_id"), "text").dropDuplicates(["doc_id"])), "prints")
    first = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "first-prints")
    equal = prints.join(first, "fp").where(F.col("doc_id") > F.col("node")).select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    end = lambda fp: first.select(F.col("fp").alias(fp), F.col("node").alias(fp + "_node"))
    linked = simhash.links(first.select("fp")).join(end("a"), "a").join(end("b"), "b").select(*_pairs("a_node", "b_node"))
    out = saved(equal.unionByName(linked), "print-pairs")
    discard(prints, first)
    return out


def to_come(held: DataFrame) -> int:
    """At most so many pairs would be met by `across`."""
    one = held.groupBy("key").agg((F.count(F.lit(1)) * F.count_if(F.col("root") > F.col("lo"))).alias("n"))
    return int(one.agg(F.sum("n")).first()[0] or 0)


def similar(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Distinct pairs whose texts (node, text) have shingle sets of Jaccard `similarity` or more.

    Nodes are dealt into buckets, and a pair is compared in the block of its two buckets: a text goes
    once to each block that needs it, not to each of its pairs."""

    def run(batches):
        block, sets = None, {}
        for batch in batches:
            of, kind, a, b = (batch.column(k).to_numpy() for k in ("block", "kind", "a", "b"))
            keep = np.zeros(batch.num_rows, bool)
            for lo, hi, data, at in chunks(batch.column("text"), 1 << 20):
                h, row = shingles(data, at)
                edge = np.searchsorted(row, np.arange(hi - lo + 1))
                for r in range(lo, hi):
                    if of[r] != block:
                        block, sets = of[r], {}
                    if not kind[r]:
                        sets[a[r]] = np.unique(h[edge[r - lo] : edge[r - lo + 1]])
                        continue
                    x, y = sets[a[r]], sets[b[r]]
                    least, most = sorted((len(x), len(y)))
                    if least >= similarity * most:
                        both = np.sort(np.concatenate([x, y]), kind="stable")
                        same = int((both[1:] == both[:-1]).sum())
                        keep[r] = same >= similarity * (least + most - same)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    buckets = max(16, texts.count() // 1000)
    block = lambda a, b: F.pmod(a, F.lit(buckets)) * buckets + F.pmod(b, F.lit(buckets))
    dealt = pairs.select(block("a", "b").alias("block"), F.lit(1).alias("kind"), "a", "b")
    needed = dealt.select("block", F.explode(F.array("a", "b")).alias("node")).distinct()
    held = needed.join(texts, "node").select("block", F.lit(0).alias("kind"), F.col("node").alias("a"), F.col("node").alias("b"), "text")
    parts = max(1, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = held.unionByName(dealt.withColumn("text", F.lit(""))).repartition(parts, "block").sortWithinPartitions("block", "kind")
    return rows.mapInArrow(lean(run), "a long, b long")


def dedup(docs: DataFrame) -> DataFrame:
    """docs with one document of each group of near-duplicates, that of the smallest doc_id.

    Equal texts are one node; all links between nodes are verified; groups are their connected
    components. Null and empty texts are alike; a null doc_id comes last; of rows alike in doc_id and
    text one stays; other columns pass through; an empty table gives no rows."""
    own = text_or_empty(docs).withColumn("node", F.xxhash64("text"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    nodes = signatures(own).groupBy("node").agg(F.min(F.struct("keys", "size", "marks")).alias("own"), F.min(order).alias("least")).select("node", "own.*", "least")
    nodes = saved(nodes, "nodes")
    met = saved(meetings(nodes), "meetings")

    def verified(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        holders = saved(nodes.select("node", "least").join(ends, "node").select(F.col("node").alias("hnode"), F.col("least.id").alias("hid")), "holders")
        held = possibly_in(own, ["doc_id", "node"], holders, ["hid", "hnode"])
        texts = held.join(holders, held["doc_id"].eqNullSafe(holders["hid"]) & (held["node"] == holders["hnode"])).select("node", "text").dropDuplicates(["node"])
        texts = saved(texts, "pair-texts")
        found = saved(similar(pairs, texts), "similar")
        discard(holders, texts)
        return found

    left = None
    done = printed(own)
    links = verified(done)
    roots = components(links)
    most = LINEAR * met.count()
    for turn in count():
        held = saved(mixed(met, roots), "mixed")
        before, left = left, to_come(held) if turn else None
        last = left is not None and (left <= most or before is not None and left > 0.9 * before)  # few pairs are left, or leaders bring no more together
        pairs = across(held, nodes) if last else star(held, turn)
        pairs = saved(pairs.join(done, ["a", "b"], "left_anti"), "pairs")
        discard(held)
        if pairs.isEmpty():
            if last:
                break
            continue
        found = verified(pairs)
        done, links = done.unionByName(pairs), links.unionByName(found)
        roots = components(links)
        if last:
            break
    least = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct("least.none", "least.id", F.col("node").alias("th"))).alias("least"))
    place = lambda i, t: F.struct(F.isnull(i).alias("none"), F.coalesce(i.cast("long"), F.lit(0).cast("long")).alias("id"), F.coalesce(t, F.lit(0).cast("long")).alias("th"))
    mark = "_nd_own"
    while mark in docs.columns:
        mark = "_" + mark
    stay = least.select(place(F.col("least.id"), F.col("least.th")).alias(mark))
    kept = docs.withColumn(mark, place(F.col("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit("")))))
    return kept.join(stay, mark).dropDuplicates([mark]).drop(mark)  # stay has a key once; one key, so one shuffle for both
