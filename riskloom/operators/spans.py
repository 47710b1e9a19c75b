"""Texts cut into chunks of a token budget with character spans, and periods between dates found in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A token is a run of other characters than these; it takes the white space behind it along.
WHITE = r"\x20\x09-\x0D"
PIECE = rf"[^{WHITE}]+[{WHITE}]*"


def chunked(docs: DataFrame, budget: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, chunk (from 0), first_token, tokens, start, stop (characters, end exclusive) and body.

    Consecutive chunks of at most `budget` tokens; a chunk runs to the next one's first token and the first
    takes leading white space, so bodies joined give the text back. A text without tokens, null and empty
    ones too, is one chunk of none. Rows alike are cut alike; other columns don't get further."""
    if budget < 1:
        raise ValueError(f"no room for tokens (budget {budget})")
    own = docs.select(F.col(key).alias(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    own = own.select(key, F.regexp_extract_all("_text", F.lit(PIECE), F.lit(0)).alias("_pieces"), F.regexp_extract("_text", f"^[{WHITE}]*", 0).alias("_head"))
    n = F.size("_pieces")
    begins = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(budget))

    def chunk(i: Column) -> Column:
        own_pieces = F.slice("_pieces", i + 1, budget)
        body = F.concat(F.when(i == 0, F.col("_head")).otherwise(F.lit("")), F.array_join(own_pieces, ""))
        return F.struct(i.alias("first_token"), F.size(own_pieces).alias("tokens"), body.alias("body"))

    cut = own.select(key, F.transform(begins, chunk).alias("_chunks"))
    ends = F.aggregate(F.transform("_chunks", lambda c: F.length(c["body"])), F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    cut = cut.select(key, "_chunks", ends.alias("_ends"))
    rows = cut.select(key, "_ends", F.posexplode("_chunks").alias("chunk", "_c"))
    return rows.select(key, "chunk", "_c.first_token", "_c.tokens", F.get("_ends", F.col("chunk")).alias("start"), F.get("_ends", F.col("chunk") + 1).alias("stop"), "_c.body")


# What a date looks like; what joins two dates into a period, what closes one before it, how far apart they may stand.
DATE = r"([0-9]{4})[.-] ?([0-9]{1,2})[.-] ?([0-9]{1,2})"
JOINS = r"(?iu)[-–—]|t[óő]l\b|határid"
CLOSES = r"(?iu)ig\b"
REACH = 80


def periods(text: Column) -> Column:
    """Array of (days, first, last): dates that follow each other, joined by a dash, '-tól' or a deadline.

    One fold over the dates in order: the state is the last date that no period has used and the text since,
    so a date belongs to one period at most. Impossible dates are text. Null and empty texts have none."""
    # years, months and days of all dates at once: a pattern a date would be met anew for each part of each date
    year, month, day, found = (F.regexp_extract_all(text, F.lit(DATE), F.lit(i)) for i in (1, 2, 3, 0))
    each = F.arrays_zip(year.alias("y"), month.alias("m"), day.alias("d"), found.alias("date"), F.split(text, DATE, -1).alias("before"))
    dated = F.transform(F.filter(each, lambda x: x["date"].isNotNull()), lambda x: F.struct(F.when(x["y"] > "0000", F.concat_ws("-", x["y"], x["m"], x["d"]).try_cast("date")).alias("day"), x["date"].alias("date"), x["before"].alias("before")))
    none = F.array().cast("array<struct<days:int,first:date,last:date>>")
    state = lambda last, since, out: F.struct(last.alias("last"), since.alias("since"), out.alias("out"))
    no_day, no_text = F.lit(None).cast("date"), F.lit("")

    def step(s: Column, x: Column) -> Column:
        since = F.concat(s["since"], x["before"])
        joined = F.coalesce(x["day"] > s["last"], F.lit(False)) & (F.length(since) <= REACH) & since.rlike(JOINS) & ~since.rlike(CLOSES)
        period = F.struct(F.datediff(x["day"], s["last"]).alias("days"), s["last"].alias("first"), x["day"].alias("last"))
        kept_text = F.when(s["last"].isNull(), no_text).otherwise(F.substr(F.concat(since, x["date"]), F.lit(1), F.lit(REACH + 1)))  # beyond the reach nothing joins
        return F.when(x["day"].isNull(), state(s["last"], kept_text, s["out"])).when(joined, state(no_day, no_text, F.concat(s["out"], F.array(period)))).otherwise(state(x["day"], no_text, s["out"]))

    return F.when(text.isNull(), none).otherwise(F.aggregate(dated, state(no_day, no_text, none), step, lambda s: s["out"]))
