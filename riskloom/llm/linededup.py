"""Operator 3 (native): repeated multi-line chunks with content-defined borders.

Only DataFrame functions run here. A line hashes to 32 bits of its MD5; a rolling hash over the last
two line hashes ends a chunk where it is divisible by DIVISOR, so borders move with the text and an
inserted line shifts nothing behind it. Chunk hashes (no text) are grouped to find repeats; the
chunks that repeat are then fetched, compared byte by byte with their first occurrence, and removed
where equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.base import saved
from riskloom.llm.membership import possibly_in

DIVISOR, LEAST_LINES = 4, 2


def chunk_array(text: Column, divisor: int = DIVISOR) -> Column:
    """Array of (n lines, chunk text) that joins back to the text with line feeds."""

    def build(s: Column) -> Column:
        lines, hashes = s["lines"], s["hashes"]
        last = F.size(lines) - 1
        rolling = lambda i: F.coalesce(F.get(hashes, i - 1), F.lit(0).cast("long")) * 31 + F.get(hashes, i)
        ends = F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | (rolling(i) % divisor == 0))
        starts = F.concat(F.array(F.lit(0)), F.transform(ends, lambda e: e + 1))
        return F.transform(ends, lambda e, k: F.struct((e - F.get(starts, k) + 1).alias("n"), F.array_join(F.slice(lines, F.get(starts, k) + 1, e - F.get(starts, k) + 1), "\n").alias("chunk")))

    lines = F.split(text, "\n", -1)
    # one-element transforms bind the split lines and their hashes, so that neither is computed again for each use
    one = F.transform(F.array(lines), lambda x: F.struct(x.alias("lines"), F.transform(x, lambda v: F.conv(F.substring(F.md5(v.cast("binary")), 1, 8), 16, 10).cast("long")).alias("hashes")))
    return F.get(F.transform(one, build), F.lit(0))


def dedup(docs: DataFrame, divisor: int = DIVISOR, least_lines: int = LEAST_LINES) -> DataFrame:
    """docs with repeated chunks of `least_lines` or more lines gone from `text`, plus n_lines and
    n_removed (lines). The first occurrence in order of doc_id, text and place stays.

    A null text stays null with 0 lines; an empty text is one empty line; a text that loses all its
    chunks becomes empty. Rows alike in doc_id and text are one document and get the same result; a
    null doc_id counts as the smallest. Other columns pass through, whatever their names; an empty
    table gives no rows."""
    names = docs.columns
    pre = "_ld_"
    while any(n.startswith(pre) for n in names):
        pre = "_" + pre
    k, t, at, rep, mk, mt = (pre + x for x in ("key", "text", "at", "repeats", "marked_key", "marked_text"))
    own = docs.withColumns({k: F.col("doc_id"), t: F.xxhash64(F.col("text"))})
    base = docs.where(F.col("text").isNotNull() & F.col("text").contains("\n")).select(F.col("doc_id").alias(k), F.xxhash64("text").alias(t), "text")
    piece = base.select(k, t, F.posexplode(chunk_array(F.col("text"), divisor)).alias("pos", "c"))
    keys = piece.where(F.col("c.n") >= least_lines).select(k, t, "pos", F.xxhash64("c.chunk").alias("hash"))
    keys = saved(keys, "line-chunks")
    place = F.struct(k, t, "pos")
    repeated = keys.groupBy("hash").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("hash", "first")
    marked = keys.join(repeated, "hash").groupBy(k, t).agg(F.collect_set(F.struct("pos", "hash", (place == F.col("first")).alias("is_first"))).alias(rep))
    marked = saved(marked, "line-repeats").withColumnsRenamed({k: mk, t: mt})
    same = lambda a, b: F.col(a[0]).eqNullSafe(F.col(b[0])) & (F.col(a[1]) == F.col(b[1]))
    held = possibly_in(base, [k, t], marked, [mk, mt]).join(marked, same((k, t), (mk, mt)))  # rows alike do no harm below
    held = held.select(k, t, F.col(rep), F.transform(chunk_array(F.col("text"), divisor), lambda c: c["chunk"]).alias("all"))
    texts = held.select(k, t, F.explode(F.transform(rep, lambda r: F.struct(r["pos"].alias("pos"), r["hash"].alias("hash"), r["is_first"].alias("is_first"), F.get(F.col("all"), r["pos"]).alias("chunk")))).alias("r")).select(k, t, "r.*")
    texts = saved(texts, "line-texts")
    firsts = texts.where("is_first").groupBy("hash").agg(F.min("chunk").alias("kept"))
    gone = texts.where(~F.col("is_first")).join(firsts, "hash").where("chunk = kept").groupBy(k, t).agg(F.sort_array(F.collect_set("pos")).alias(at)).withColumnsRenamed({k: mk, t: mt})
    out = own.join(gone, same((k, t), (mk, mt)), "left")
    chunks = chunk_array(F.when(F.col(at).isNotNull(), F.col("text")), divisor)
    left = F.array_join(F.transform(F.filter(chunks, lambda c, i: ~F.array_contains(F.col(at), i)), lambda c: c["chunk"]), "\n")
    dropped = F.aggregate(F.filter(chunks, lambda c, i: F.array_contains(F.col(at), i)), F.lit(0), lambda a, c: a + c["n"])
    old = [F.col(f"`{n}`") for n in names if n not in ("text", "n_lines", "n_removed")]
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"))) + 1).cast("long")
    return out.select(*old, F.when(F.col(at).isNull(), F.col("text")).otherwise(left).alias("text"), n_lines.alias("n_lines"), F.when(F.col(at).isNull(), 0).otherwise(dropped).cast("long").alias("n_removed"))


ORACLE = """
with l as (select doc_id, text, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) i from documents where text is not null),
h as (select *, ('0x' || substr(md5(line), 1, 8))::bigint h, max(i) over (partition by doc_id, text) n from l),
b as (select *, case when i = n or (coalesce(lag(h) over (partition by doc_id, text order by i), 0) * 31 + h) % 4 = 0 then 1 else 0 end ends from h),
c as (select *, coalesce(sum(ends) over (partition by doc_id, text order by i rows between unbounded preceding and 1 preceding), 0) k from b),
p as (select doc_id, text, k, count(*) lines, string_agg(line, chr(10) order by i) chunk from c group by all),
f as (select *, row_number() over (partition by chunk, lines >= 2 order by doc_id, text, k) nth from p)
select doc_id, coalesce(string_agg(chunk, chr(10) order by k) filter (where lines < 2 or nth = 1), '') as text, sum(lines)::bigint n_lines, coalesce(sum(lines) filter (where lines >= 2 and nth > 1), 0)::bigint n_removed from f group by doc_id, f.text
union all select doc_id, null, 0, 0 from documents where text is null
"""
