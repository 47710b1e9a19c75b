"""Evidence search: where quotes stand in paged texts, by an inverted index of word n-grams; as-of joins.

A quote's first piece gives word n-grams; those that occur anywhere are looked up by an equi-join with the
n-grams of all texts, and the one with the fewest occurrences becomes its seed. At each occurrence of a
seed the pieces are held against the text in order, as expressions, each within the allowed gap. So the work
follows the occurrences of rare n-grams, not quotes times texts, and every occurrence is found.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Unicode white space; what stands for left-out words; least length of a piece, most an ellipsis skips.
WHITE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
ELLIPSIS = rf"{WHITE}*[\[(]?{WHITE}*(?:[.][.][.]|…){WHITE}*[\])]?{WHITE}*"
LEAST_PIECE, MOST_SKIPPED = 20, 300
#: Words of an n-gram; words of a piece whose inner words give one.
GRAM = 3
_ENOUGH = GRAM + 2


def _folder(spark) -> str:
    """The checkpoint folder all executors share; a private one in local mode alone."""
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="riskloom-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """Written once to the checkpoint folder."""
    _folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Written once to a new table in the checkpoint folder and read from there: packed, and by column."""
    path = f"{_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a bounded width that may be broadcast.
FEW = 500_000


def small(df: DataFrame) -> DataFrame:
    """Marked for a broadcast where its rows, which are counted, are few; as it is beyond."""
    return F.broadcast(df) if df.count() <= FEW else df


def normalised(text: Column) -> Column:
    """Without emphasis, table pipes and headings as blanks, one blank between words, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[*_`]", ""), r"[|#]", " "), WHITE + "+", " ")))


def worded(documents: DataFrame, key: str = "doc_id", pages: str = "pages") -> DataFrame:
    """key, words of all pages (normalised, in order), starts (the first word's place of each page, from 0)."""
    by_page = F.transform(pages, lambda p: F.filter(F.split(normalised(F.coalesce(p, F.lit(""))), " "), lambda w: w != ""))
    cut = documents.where(F.size(pages) > 0).select(F.col(key).alias("key"), by_page.alias("held"))
    starts = F.transform(F.sequence(F.lit(1), F.size("held")), lambda i: F.aggregate(F.slice("held", 1, i - 1), F.lit(0), lambda n, p: n + F.size(p)))
    return cut.select("key", F.flatten("held").alias("words"), starts.alias("starts"))


def pieces(quotes: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """key and pieces of each quote: as it is (shortened = false) and, where an ellipsis cuts it into long enough pieces, those."""
    whole = quotes.select(F.col(key).alias("quote"), F.lit(False).alias("shortened"), F.array(normalised(F.col(text))).alias("pieces"))
    cut = F.filter(F.transform(F.split(F.col(text), ELLIPSIS), normalised), lambda p: p != "")
    parts = quotes.select(F.col(key).alias("quote"), F.lit(True).alias("shortened"), cut.alias("pieces"))
    parts = parts.where((F.size("pieces") > 1) & F.forall("pieces", lambda p: F.length(p) >= LEAST_PIECE))
    return whole.where(F.col("pieces")[0] != "").unionByName(parts)


def _grams(words: Column, width: int, first: Column | int = 1, short: Column | int = 0) -> Column:
    """(place from 0, hash) of each n-gram of `width` words from the `first`-th word on, leaving `short` words at the end."""
    last = F.size(words) - short - width + 1
    return F.when(last >= first, F.transform(F.sequence(F.lit(first), last), lambda i: F.struct((i - 1).alias("at"), F.xxhash64(*(F.element_at(words, i + k) for k in range(width))).alias("gram"))))


def seeds(quotes: DataFrame) -> DataFrame:
    """The n-grams of each first piece: inner words, for a quote may start and end within words; of one or two words, those."""
    words = F.split(F.col("pieces")[0], " ")
    n = F.size(words)
    grams = F.when(n >= _ENOUGH, _grams(words, GRAM, 2, 1)).when(n > 2, _grams(words, 1, 2, 1)).otherwise(_grams(words, 1))
    return quotes.select("*", words.alias("first"), F.explode(grams).alias("g")).select("quote", "shortened", "pieces", "first", F.col("g.at").alias("inside"), F.col("g.gram").alias("gram"))


def found(text: Column, rest: Column, most: int = MOST_SKIPPED) -> Column:
    """Whether the pieces of `rest` follow in order at the start of text, each the nearest, at most `most` + 1 characters on."""

    def step(at: Column, piece: Column) -> Column:
        near = F.substr(text, at, F.lit(most + 1) + F.length(piece))
        next_ = F.instr(near, piece)
        return F.when((at > 0) & (next_ > 0), at + next_ - 1 + F.length(piece)).otherwise(F.lit(0))

    return F.aggregate(rest, F.lit(1), step) > 0


def search(documents: DataFrame, quotes: DataFrame) -> DataFrame:
    """key, quote, shortened, place (of the word it starts in, from 0), page (from 1): every occurrence of every quote.

    documents: doc_id, pages (array of texts); quotes: item_id, text; both may have other columns. Texts are
    compared normalised, across page breaks. A quote of three words or more may start and end within words;
    shorter ones stand for whole words. A quote with an ellipsis is also looked for as it is, and is reported
    as shortened only where it isn't there whole in that text. Null and empty texts, pages and quotes find
    nothing; equal documents and equal quotes find the same each; null ids are ids of their own."""
    texts = worded(documents)
    sown = kept(seeds(pieces(quotes)))
    needed = small(kept(sown.select("gram").distinct()))
    widths = [GRAM, *([1] if not sown.where(F.size("first") < _ENOUGH).isEmpty() else [])]
    grams = F.flatten(F.filter(F.array(*(_grams(F.col("words"), w) for w in widths)), lambda g: g.isNotNull()))
    hits = texts.select("key", F.explode(grams).alias("g")).select("key", F.col("g.at").alias("at"), F.col("g.gram").alias("gram"))
    hits = kept(hits.join(needed, "gram").distinct())
    # an n-gram that occurs nowhere rules its quote out
    often = hits.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    ranked = sown.join(often, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = ranked.groupBy("quote", "shortened", "pieces").agg(F.min_by(F.struct("gram", "inside", "first", "n"), F.struct("n", "inside")).alias("s"))
    rarest = rarest.where("s.n > 0").select("quote", "shortened", "pieces", F.col("s.gram").alias("gram"), F.col("s.inside").alias("inside"), F.col("s.first").alias("first"))
    candidates = hits.join(rarest, "gram").select("key", "quote", "shortened", "pieces", "first", (F.col("at") - F.col("inside")).alias("place")).where("place >= 0").distinct()
    # only texts with a candidate are normalised again and moved
    keys = small(kept(candidates.select(F.col("key").alias("_met")).distinct()))
    texts = worded(documents.join(keys, F.col("doc_id").eqNullSafe(F.col("_met")), "left_semi"))
    met = candidates.join(texts.withColumnRenamed("key", "own"), F.col("key").eqNullSafe(F.col("own")))
    n = F.size("first")
    reach = n + F.aggregate(F.slice("pieces", 2, 1 << 30), F.lit(0), lambda s, p: s + F.length(p) + MOST_SKIPPED + 2)  # words that the pieces can span
    head = F.element_at("words", F.col("place") + 1)
    start = F.length(head) - F.length(F.col("first")[0])  # where in its word the quote starts
    near = F.array_join(F.slice("words", F.col("place") + 1, reach), " ")
    one = F.col("pieces")[0]
    sound = F.when(n > 2, (start >= 0) & F.endswith(head, F.col("first")[0]) & F.startswith(F.substr(near, start + 1), one)).otherwise(F.slice("words", F.col("place") + 1, n) == F.col("first"))
    after = F.substr(near, F.greatest(start, F.lit(0)) + 1 + F.length(one))
    sure = met.where(F.col("place") + n <= F.size("words")).where(sound).where(found(after, F.slice("pieces", 2, 1 << 30)))
    page = F.size(F.filter("starts", lambda s: s <= F.col("place")))
    rows = sure.select("key", "quote", "shortened", "place", page.alias("page"))
    there = rows.where(~F.col("shortened")).select(F.col("key").alias("k"), F.col("quote").alias("q")).distinct()
    return rows.join(there, F.col("shortened") & F.col("key").eqNullSafe(F.col("k")) & F.col("quote").eqNullSafe(F.col("q")), "left_anti")


def as_of(rows: DataFrame, marks: DataFrame, key: str, at: str, value: str, width: int) -> DataFrame:
    """rows with `value` of the last mark of the same key at or before `at` (null if there is none); ties take the largest value.

    Keys are cut into slices of `width` along `at`, so a window holds one slice of one key, however many
    rows a key has; a slice without an earlier mark of its own takes the last one of the slices before, which
    goes by one row a slice. Null keys are a key of their own; rows without `at` keep a null value."""
    slice_ = F.floor(F.col(at) / width).cast("long").alias("_slice")
    names = rows.columns
    marked = marks.where(F.col(at).isNotNull()).groupBy(F.col(key).alias("_key"), F.col(at).alias("_at"), slice_).agg(F.max(value).alias("_mark"))
    last = marked.groupBy("_key", "_slice").agg(F.max_by("_mark", "_at").alias("_last"))
    # what a slice starts with: slices that have rows or marks, each with the last mark of those before it
    present = rows.where(F.col(at).isNotNull()).select(F.col(key).alias("_key"), slice_).unionByName(last.select("_key", "_slice")).distinct()
    a, b = present.alias("a"), last.alias("b")
    line = a.join(b, F.col("a._key").eqNullSafe(F.col("b._key")) & (F.col("a._slice") == F.col("b._slice")), "left").select("a._key", "a._slice", "_last")
    carried = line.select("_key", "_slice", F.last("_last", ignorenulls=True).over(Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    every = rows.select(F.struct(*names).alias("_row"), F.col(key).alias("_key"), F.col(at).alias("_at"), slice_, F.lit(None).cast(marked.schema["_mark"].dataType).alias("_mark"), F.lit(1).alias("_kind"))
    every = every.unionByName(marked.select(F.lit(None).cast(every.schema["_row"].dataType).alias("_row"), "_key", "_at", "_slice", "_mark", F.lit(0).alias("_kind")))
    within = F.last("_mark", ignorenulls=True).over(Window.partitionBy("_key", "_slice").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    seen = every.withColumn("_own", within).where("_kind = 1").drop("_mark").alias("s")
    c = carried.alias("c")
    out = seen.join(c, F.col("s._key").eqNullSafe(F.col("c._key")) & (F.col("s._slice") == F.col("c._slice")), "left")
    got = F.when(F.col("s._at").isNotNull(), F.coalesce("_own", "_before"))
    return out.select("_row.*", got.alias(value))
