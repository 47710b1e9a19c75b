"""Operator 9: removal of byte strings of LENGTH that occur more than once, by suffix order.

One suffix array over the whole corpus can't be built on one machine, so equal strings are first
brought together, losslessly, and sorted there:

1. Each window of LENGTH bytes is owned by its anchor, the smallest-hash GRAM in it (leftmost on
   ties), so equal windows have equal anchors at equal places. An owner's windows form a run; the
   hash of all the run's bytes is its context. Equal contexts elsewhere settle whole runs.
2. Where an anchor has several contexts, each distinct one is cut into aligned slices of SLICE
   windows. What all windows of a slice share is its core; at most SLICE - 1 bytes stand on each
   side. Equal slices settle; a core met once settles too (its windows are unique).
3. What is left differs only around a shared core. With the core as one symbol, every window is
   SLICE symbols long; suffixes of these strings are ordered by linear grouping (suffix.py), and
   windows whose first SLICE symbols equal a neighbour's occur more than once. Groups of a core
   with over HOT members go window by window through a plain group count instead, so that no task
   gathers them.

Strings are told apart by 64-bit hashes up to step 3, and there by their symbols.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.base import lean, saved, text_or_empty
from riskloom.llm.kernels import buffers, chunks, mix, span_hashes
from riskloom.llm.suffix import suffix_order

LENGTH, GRAM, SLICE, HOT, SYMBOLS = 400, 64, 16, 4096, 20_000
U = np.uint64
_AT = U((1 << 24) - 1)


def owners(data: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Runs of windows with one anchor: (anchor hash, row, anchor, first window, last window)."""
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    size = np.diff(at)
    if not (size >= length).any():
        return none
    n, wide = len(data), length - gram + 1
    starts = np.arange(n - gram + 1)
    g = span_hashes(data, starts, starts + gram)
    key = (g & ~_AT) | starts.astype(U)
    step = 1
    while step * 2 <= wide:
        np.minimum(key[:-step], key[step:], out=key[:-step])
        step *= 2
    w = n - length + 1
    anchor = (np.minimum(key[:w], key[wide - step : wide - step + w]) & _AT).astype(np.int64)
    mark = np.zeros(n + 1, np.int32)
    long = np.flatnonzero(size >= length)
    np.add.at(mark, at[long], 1)
    np.add.at(mark, at[long + 1] - length + 1, -1)
    s = np.flatnonzero(np.cumsum(mark[:w]) > 0)
    a = anchor[s]
    edge = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1)]))
    lo, hi, a = s[edge], s[np.append(edge[1:], len(s)) - 1], a[edge]
    return g[a], np.searchsorted(at, lo, "right") - 1, a, lo, hi


def pieces(data: np.ndarray, at: np.ndarray, most: int = 1 << 21, lap: int = LENGTH):
    """Texts longer than `most` in overlapping stretches that share no window: (bytes, offsets, row shift, byte shift)."""
    if len(data) <= most or len(at) > 2:
        yield data, at, 0
        return
    p = 0
    while p < len(data):
        part = data[p : p + most + lap - 1]
        yield part, np.array([0, len(part)]), p
        p += most


def _spread(symbols: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """span_hashes for spans that are long next to their number, in any order of ends."""
    return span_hashes(symbols, s, e)


ANCHORS = "id long, th long, g long, full long, pos int, lo int, hi int"


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids, ths = (batch.column(c).to_numpy() for c in ("id", "th"))
            for r0, _, data, at in chunks(batch.column("text"), 1 << 20):
                for part, pat, shift in pieces(data, at, 1 << 20, length):
                    g, row, a, lo, hi = owners(part, pat, length, gram)
                    if not len(g):
                        continue
                    full = mix(_spread(part, lo, hi + length) ^ mix((a - lo).astype(U) * U(1 << 20) + (hi - lo).astype(U)))
                    base = pat[row] - shift
                    yield pa.RecordBatch.from_arrays([pa.array(ids[r0 + row]), pa.array(ths[r0 + row]), pa.array(g.view(np.int64)), pa.array(full.view(np.int64)), *(pa.array((x - base).astype(np.int32)) for x in (a, lo, hi))], names=[f.split()[0] for f in ANCHORS.split(", ")])

    return docs.mapInArrow(lean(run), ANCHORS)


SLICES = "core long, sub long, around binary, q1 int, q2 int, id long, th long, base int, need boolean"


def slices(held: DataFrame, length: int, width: int) -> DataFrame:
    """Aligned slices of each listed run; `around` is the bytes left of the core, then right of it."""

    def run(batches):
        for batch in batches:
            data, at = buffers(batch.column("text"))
            ids, ths = (batch.column(c).to_numpy() for c in ("id", "th"))
            lists = batch.column("runs")
            flat, off = lists.flatten(), lists.offsets.to_numpy()
            off = off - off[0]
            lo, hi, pos = (flat.field(c).to_numpy().astype(np.int64) for c in ("lo", "hi", "pos"))
            g, need = flat.field("g").to_numpy().view(U), flat.field("need").to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(len(ids)), np.diff(off))
            j1, j2 = (lo - pos) // width, (hi - pos) // width
            many = j2 - j1 + 1
            k = np.repeat(np.arange(len(lo)), many)
            base = pos[k] + (j1[k] + np.arange(len(k)) - np.repeat(np.cumsum(many) - many, many)) * width
            q1, q2 = np.maximum(0, lo[k] - base), np.minimum(width - 1, hi[k] - base)
            d = at[of[k]] + base
            order = np.argsort(d, kind="stable")
            k, base, q1, q2, d = k[order], base[order], q1[order], q2[order], d[order]
            core = mix(span_hashes(data, d + width - 1, d + length) ^ mix(g[k] + (base - pos[k] + (1 << 20)).astype(U)))
            around = [data[x + a : x + width - 1].tobytes() + data[x + length : x + length + b].tobytes() for x, a, b in zip(d.tolist(), q1.tolist(), q2.tolist())]
            sub = [int.from_bytes(hashlib.blake2b(t + bytes((a, b)), digest_size=8).digest(), "little", signed=True) for t, a, b in zip(around, q1.tolist(), q2.tolist())]
            r = of[k]
            for x in range(0, len(k), 20_000):
                y = slice(x, x + 20_000)
                yield pa.RecordBatch.from_arrays([pa.array(core[y].view(np.int64)), pa.array(sub[y], pa.int64()), pa.array(around[y], pa.binary()), pa.array(q1[y].astype(np.int32)), pa.array(q2[y].astype(np.int32)), pa.array(ids[r[y]]), pa.array(ths[r[y]]), pa.array(base[y].astype(np.int32)), pa.array(need[k[y]])], names=[f.split()[0] for f in SLICES.split(", ")])

    return held.mapInArrow(lean(run), SLICES)


def repeated_windows(groups: list[list[tuple[bytes, int, int]]], width: int) -> list[list[list[int]]]:
    """For groups of (around, q1, q2) with one core each: each member's repeated windows (q values)."""
    s: list[int] = []
    window: dict[int, tuple[int, int, int]] = {}
    for n, members in enumerate(groups):
        for m, (around, q1, q2) in enumerate(members):
            left = width - 1 - q1
            for q in range(q1, q2 + 1):
                window[len(s) + q - q1] = (n, m, q)
            s += [b + 2 for b in around[:left]]
            s.append(258 + n)
            s += [b + 2 for b in around[left:]]
            s.append(1)
    out = [[[] for _ in members] for members in groups]
    last, last_at = None, -1
    for p in suffix_order(s):
        if p in window:
            text = s[p : p + width]
            if text == last:
                for x in {p, last_at}:
                    n, m, q = window[x]
                    out[n][m].append(q)
            last, last_at = text, p
    return [[sorted(set(q)) for q in members] for members in out]


SPANS = "id long, th long, start int, stop int"


def _spans(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    c = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.int32())], names=["id", "th", "start", "stop"])


def sorted_spans(members: DataFrame, length: int, width: int) -> DataFrame:
    """Step 3 over members sorted by core within each partition."""

    def run(batches):
        groups, owner, size, core = [], [], 0, None

        def flush():
            rows = []
            for own, got in zip(owner, repeated_windows(groups, width)):
                rows += [(i, t, base + q, base + q + length) for (i, t, base, need), qs in zip(own, got) if need for q in qs]
            return rows

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("core", "around", "q1", "q2", "id", "th", "base", "need")]
            for c, around, q1, q2, i, t, base, need in zip(*cols):
                if c != core:
                    if size > SYMBOLS:
                        if rows := flush():
                            yield _spans(rows)
                        groups, owner, size = [], [], 0
                    groups.append([]), owner.append([])
                    core = c
                groups[-1].append((around, q1, q2)), owner[-1].append((i, t, base, need))
                size += len(around) + 2
        if groups and (rows := flush()):
            yield _spans(rows)

    return members.mapInArrow(lean(run), SPANS)


def counted_spans(members: DataFrame, length: int, width: int) -> DataFrame:
    """Step 3 of hot cores: every window by itself, grouped by its exact bytes around the core."""
    one = members.select("*", F.explode(F.sequence("q1", "q2")).alias("q"))
    left = F.lit(width - 1) - F.col("q1")
    text = F.substring("around", F.col("q") - F.col("q1") + 1, left - (F.col("q") - F.col("q1")) + F.col("q"))
    one = one.select("core", "q", F.sha2(text, 256).alias("w"), "id", "th", "base", "need")
    twice = one.groupBy("core", "q", "w").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    start = F.col("base") + F.col("q")
    return one.where("need").join(twice, ["core", "q", "w"]).select("id", "th", start.alias("start"), (start + length).alias("stop"))


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, width: int = SLICE, hot: int = HOT) -> DataFrame:
    """(id, th, start, stop): byte ranges covered by strings that occur again; ranges may overlap."""
    found = saved(anchors(docs, length, gram), "anchors")
    rep = F.struct("id", "th", "pos", "lo", "hi")
    contexts = saved(found.groupBy("g", "full").agg(F.count(F.lit(1)).alias("m"), F.min(rep).alias("at")), "contexts")
    whole = found.join(contexts.where("m > 1").select("g", "full"), ["g", "full"]).select("id", "th", F.col("lo").alias("start"), (F.col("hi") + length).alias("stop"))
    mixed = contexts.groupBy("g").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("g")
    runs = contexts.join(mixed, "g").groupBy("at.id", "at.th").agg(F.collect_list(F.struct("at.lo", "at.hi", "at.pos", "g", (F.col("m") == 1).alias("need"))).alias("runs"))
    runs = runs.withColumnsRenamed({"id": "rid", "th": "rth"})
    held = docs.join(runs, (docs["id"] == runs["rid"]) & (docs["th"] == runs["rth"])).select("id", "th", "text", "runs")
    cut = saved(slices(held, length, width), "slices")
    by_core = cut.groupBy("core", "sub").agg(F.countDistinct("id", "th", "base").alias("times"), F.max("need").alias("open"))
    by_core = saved(by_core, "slice-groups")
    same = cut.where("need").join(by_core.where("times > 1").select("core", "sub"), ["core", "sub"]).select("id", "th", (F.col("base") + F.col("q1")).alias("start"), (F.col("base") + F.col("q2") + length).alias("stop"))
    open_ = by_core.groupBy("core").agg(F.count(F.lit(1)).alias("subs"), F.max((F.col("times") == 1) & F.col("open")).alias("open")).where("subs > 1 and open")
    members = cut.join(open_.select("core", "subs"), "core").groupBy("core", "sub", "subs").agg(F.min(F.struct("around", "q1", "q2", "id", "th", "base", "need")).alias("x")).select("core", "subs", "x.*")
    members = saved(members, "slice-members")
    few = members.where(F.col("subs") <= hot).drop("subs")
    few = few.repartition(max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "core").sortWithinPartitions("core")
    return whole.unionByName(same).unionByName(sorted_spans(few, length, width)).unionByName(counted_spans(members.where(F.col("subs") > hot).drop("subs"), length, width))


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _apply(batches):
    for batch in batches:
        data, at = buffers(batch.column("text"))
        rows = []
        for doc, a, b, cover in zip(batch.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), batch.column("cover").to_pylist()):
            text = data[a:b].tobytes()
            kept, end, removed, runs, p = [], -1, 0, 0, 0
            for x, y in sorted((c["start"], c["stop"]) for c in cover or ()):
                if x > end:
                    kept.append(text[max(p, 0) : x])
                    runs += 1
                    removed += y - x
                elif y > end:
                    removed += y - end
                end = p = max(end, y)
            kept = b"".join(kept) + text[p:]
            rows.append((doc, b - a, removed, runs, hashlib.sha256(kept).hexdigest(), kept))
        if rows:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[f.split()[0] for f in OUT.split(", ")])


def remove(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, width: int = SLICE, hot: int = HOT) -> DataFrame:
    """Each document without the bytes covered by strings of `length` bytes that start anywhere else too.

    Strings are judged on the input. Null and empty texts, and texts shorter than `length`, keep all;
    rows alike repeat each other and lose all such bytes; a null doc_id is kept as null; an empty table
    gives no rows. `kept` has the bytes that stay (a cut may fall inside a character)."""
    docs = text_or_empty(docs).select("doc_id", "text", F.coalesce("doc_id", F.lit(-1)).alias("id"), F.xxhash64("text").alias("th"))
    found = spans(docs.select("id", "th", "text"), length, gram, width, hot).distinct()
    cover = found.groupBy("id", "th").agg(F.collect_list(F.struct("start", "stop")).alias("cover")).withColumnsRenamed({"id": "rid", "th": "rth"})
    out = docs.join(cover, (docs["id"] == cover["rid"]) & (docs["th"] == cover["rth"]), "left")
    return out.select("doc_id", "text", "cover").mapInArrow(lean(_apply), OUT)
