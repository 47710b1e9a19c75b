"""One document a call out of several versions: pins first, then overrides, then the latest version that can be read.

A version that can't be read is dropped once it is chosen, and the rest is tried again; names of different kinds
or of equal rank can't be ordered, so their call goes to review. That loop has a closed form: with `top` the
highest rank that has a readable version and `tie` the highest rank held twice, a call is unclear if its tie is
at or above its top. Both are maxima over counts by rank, so a call of any size is aggregated before it is
shuffled, and no task holds a call's versions. Decisions go back by joins on the call; those of calls above LARGE
versions, few in number, are repeated for each of SALTS parts, over which the versions of such calls are dealt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.evidence import kept

# Accents taken off; a date in a file name; numbered changes, in the order in which they count; a change without a number.
ACCENTED, PLAIN = "áéíóöőúüű", "aeiooouuu"
DATE = r"(?<![0-9])(20[0-9]{2})(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])(?![0-9])"
NUMBERED = (r"(?<![0-9.])([0-9]+)-?sz-?mod", r"mod-?([0-9]+)", r"(?:^|[-_])([0-9]+)mod", r"(?:^|[-_])v([0-9]+)(?=[-_.]|$)")
UNNUMBERED = r"(?:^|[-_])(?:mod|modositas|modositott\w*)(?=[-_.]|$)"
#: Longest error listing.
LISTED = 20
#: Versions from which a call is dealt over parts, and how many.
LARGE, SALTS = 10_000, 256


def marker(name: Column) -> Column:
    """struct(kind, rank) of a file name: its date, or the number of its change; 1 without a number, 0 without a change.

    An impossible date counts as none. A null name has no change."""
    plain = F.translate(F.lower(F.coalesce(name, F.lit(""))), ACCENTED, PLAIN)
    part = lambda i: F.regexp_extract(plain, DATE, i)
    day = F.concat_ws("-", part(1), part(2), part(3)).try_cast("date")
    number = F.when(plain.rlike(UNNUMBERED), F.lit("1")).otherwise(F.lit("0"))
    for pattern in reversed(NUMBERED):
        number = F.when(plain.rlike(pattern), F.regexp_extract(plain, pattern, 1)).otherwise(number)
    dated = F.struct(F.lit("date").alias("kind"), F.date_format(day, "yyyyMMdd").try_cast("decimal(38,0)").alias("rank"))
    return F.when(day.isNotNull(), dated).otherwise(F.struct(F.lit("number").alias("kind"), number.try_cast("decimal(38,0)").alias("rank")))


def _marked(candidates: DataFrame, pins: DataFrame, overrides: DataFrame) -> DataFrame:
    flag = lambda df, name: df.select("call", "id", F.lit(True).alias(name)).distinct()
    own = candidates.select("call", "id", F.coalesce("readable", F.lit(False)).alias("readable"), marker(F.col("name")).alias("m"))
    own = own.select("call", "id", "readable", "m.kind", "m.rank")
    return own.join(flag(pins, "pinned"), ["call", "id"], "left").join(flag(overrides, "named"), ["call", "id"], "left").fillna(False, ["pinned", "named"])


def _decisions(marked: DataFrame, overrides: DataFrame) -> DataFrame:
    """A row a call: what there is of it, and how it is decided."""
    some = lambda c: F.max(F.when(c, F.col("rank")))
    ranks = marked.where("call is not null").groupBy("call", "kind", "rank").agg(
        F.count(F.lit(1)).alias("n"), F.max("readable").alias("ok"), F.count_if("pinned").alias("pins"), F.count_if(F.col("pinned") & F.col("readable")).alias("pins_ok"),
        F.count_if("named").alias("names"), F.count_if(F.col("named") & F.col("readable")).alias("names_ok"))
    calls = ranks.groupBy("call").agg(
        F.sum("n").alias("all"), (F.min("kind") != F.max("kind")).alias("mixed"), some(F.col("n") > 1).alias("tie"), some(F.col("ok")).alias("top"), F.min("rank").alias("low"),
        *(F.sum(c).alias(c) for c in ("pins", "pins_ok", "names", "names_ok")))
    calls = calls.join(overrides.select("call", F.lit(True).alias("overridden")).distinct(), "call", "left").fillna(False, ["overridden"])
    unclear = F.col("mixed") | F.coalesce(F.col("tie") >= F.col("top"), F.col("tie").isNotNull())
    how = F.when(F.col("pins") > 0, "gold_pin").when(F.col("overridden"), "override").when(unclear, "unclear").when(F.col("top").isNull(), "none").when(F.col("top") == F.col("low"), "only").otherwise("version")
    return calls.withColumn("how", how)


def chosen(candidates: DataFrame, pins: DataFrame, overrides: DataFrame) -> DataFrame:
    """call, id, fate (included, excluded, needs_review), reason, chosen_by of every candidate.

    candidates: call, id, name, readable (null: no); pins and overrides: call, id. Rows alike are two candidates.
    A null call goes to review. Where a pin or an override can't be kept (`problems` says why) its call goes
    to review as a whole."""
    marked = _marked(candidates, pins, overrides)
    calls = _decisions(marked, overrides).select("call", "all", "how", "mixed", "tie", "top", F.when(F.col("how") == "gold_pin", (F.col("pins") == 1) & (F.col("pins_ok") == 1)).when(F.col("how") == "override", (F.col("names") == 1) & (F.col("names_ok") == 1)).otherwise(True).alias("sound"))
    fate = lambda name, reason=None: F.struct(F.lit(name).alias("fate"), F.lit(reason).cast("string").alias("reason"))
    by = lambda flag, other: F.when(flag, fate("included")).otherwise(fate("excluded", other))
    rank, how = F.col("rank"), F.col("how")
    latest = F.when(rank > F.col("top"), fate("excluded", "unreadable")).otherwise(by(rank == F.col("top"), "older_version"))
    out = (
        F.when(F.col("call").isNull(), fate("needs_review", "call_unknown"))
        .when(~F.col("sound"), fate("needs_review", "choice_lost"))
        .when(how == "gold_pin", by(F.col("pinned"), "not_the_gold_version"))
        .when(how == "override", by(F.col("named"), "older_version"))
        .when(how == "unclear", F.when(F.col("mixed") | (rank <= F.col("tie")), fate("needs_review", "version_unclear")).otherwise(fate("excluded", "unreadable")))
        .when(how == "none", fate("excluded", "unreadable"))
        .otherwise(latest)
    )
    calls = kept(calls.select("call", "all", F.struct("how", "mixed", "tie", "top", "sound").alias("d")))
    large = calls.where(F.col("all") > LARGE).select("call", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"), F.col("d").alias("big"))
    rows = marked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(large, ["call", "part"], "left")
    # what has its decision keeps its part and meets nothing
    rows = rows.withColumn("part", F.when(F.col("big").isNull() & F.col("call").isNotNull(), F.lit(-1)).otherwise(F.col("part")))
    rows = rows.join(calls.select("call", F.lit(-1).alias("part"), "d"), ["call", "part"], "left")
    rows = rows.select("call", "id", "rank", "pinned", "named", F.inline_outer(F.array(F.coalesce("big", "d")))).withColumn("out", out)
    return rows.select("call", "id", "out.fate", "out.reason", F.when(F.col("out.fate") == "included", how).alias("chosen_by"))


def problems(candidates: DataFrame, pins: DataFrame, overrides: DataFrame) -> DataFrame:
    """call, problem: pins and overrides that can't be kept."""
    calls = _decisions(_marked(candidates, pins, overrides), overrides)
    own = F.when(F.col("pins") > 1, "more than one pin").when((F.col("pins") == 1) & (F.col("pins_ok") == 0), "the pinned version can't be read")
    own = own.when((F.col("how") == "override") & (F.col("names") == 0), "the override is no candidate").when((F.col("how") == "override") & (F.col("names") > 1), "more than one override")
    own = own.when((F.col("how") == "override") & (F.col("names_ok") == 0), "the overriding version can't be read")
    lost = pins.select("call", "id").distinct().join(candidates.select("call", "id"), ["call", "id"], "left_anti").select("call", F.lit("the pinned version is no candidate").alias("problem"))
    return calls.select("call", own.alias("problem")).where("problem is not null").unionByName(lost)


def checked(candidates: DataFrame, pins: DataFrame, overrides: DataFrame) -> DataFrame:
    """`chosen`, or a ValueError that lists the first problems."""
    found = problems(candidates, pins, overrides).orderBy("call", "problem").limit(LISTED).collect()
    if found:
        raise ValueError("; ".join(f"{r['call']}: {r['problem']}" for r in found))
    return chosen(candidates, pins, overrides)
