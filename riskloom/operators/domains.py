"""Typed values held against their domains: every violation of every record is listed, in one pass of expressions.

Values are variants, so a type is what the record says, not what a column was cast to: true is not 1, "5" is not
5, null is not absent, and 3.0 is a whole number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"


@dataclass(frozen=True)
class Domain:
    """What a field may hold: numbers within bounds (`over`: above it), or one of `words`, or with `members` a list of these.

    A field may allow numbers and words both (a number of days, or "until funds run out")."""

    numbers: bool = False
    least: float | None = None
    over: float | None = None
    most: float | None = None
    whole: bool = False
    words: tuple[str, ...] = ()
    members: tuple[str, ...] = ()
    needed: bool = True


FLAG = Domain(numbers=True, least=0, most=1, whole=True)


def _is(value: Column, kind: str) -> Column:
    return F.schema_of_variant(value).rlike(kind)


def violation(value: Column, domain: Domain) -> Column:
    """Why a variant is outside the domain; null if it is inside, or absent where it may be."""
    number = F.try_variant_get(value, "$", "double")
    outside = F.when(F.isnan(number) | (F.abs(number) == float("inf")), "not finite")
    if domain.whole:
        outside = outside.when(number != F.floor(number), "not whole")
    if domain.least is not None:
        outside = outside.when(number < domain.least, "too small")
    if domain.over is not None:
        outside = outside.when(number <= domain.over, "too small")
    if domain.most is not None:
        outside = outside.when(number > domain.most, "too large")
    out = F.when(value.isNull(), "missing" if domain.needed else None).when(_is(value, "^VOID$"), "null")
    if domain.numbers:
        out = out.when(_is(value, NUMBER), outside)
    if domain.words:
        out = out.when(_is(value, "^STRING$"), F.when(~F.try_variant_get(value, "$", "string").isin(*domain.words), "unknown word"))
    if domain.members:
        each = F.try_variant_get(value, "$", "array<variant>")
        known = F.forall(each, lambda m: F.coalesce(_is(m, "^STRING$") & F.try_variant_get(m, "$", "string").isin(*domain.members), F.lit(False)))
        out = out.when(_is(value, "^ARRAY"), F.when(F.size(each) == 0, "empty list").when(~known, "unknown member"))
    return out.otherwise("wrong type")


def violations(rows: DataFrame, key: str, record: str, domains: dict[str, Domain], alone: bool = True) -> DataFrame:
    """key, field, violation of every record (JSON text or variant); rows alike are listed alike.

    domains: by field, nested ones with dots. Top-level fields without a domain are "unknown field". A record
    that is null, can't be parsed or is no object has one violation of its own, with field null. With `alone`
    a key of several rows is one more violation, once a key. Column names of `rows` don't matter."""
    text = dict(rows.dtypes)[record] == "string"
    own = rows.select(F.col(key).alias("key"), F.col(record).alias("given"), (F.try_parse_json(F.col(record)) if text else F.col(record)).alias("v"))
    paths = {f: F.try_variant_get("v", "$." + f, "variant") for f in domains}
    named = F.array(*(F.lit(n) for n in sorted({f.split(".")[0] for f in domains})))
    found = F.array(*(F.struct(F.lit(f).alias("field"), violation(paths[f], d).alias("violation")) for f, d in domains.items()))
    names = F.coalesce(F.json_object_keys(F.col("given") if text else F.to_json("v")), F.array().cast("array<string>"))
    unknown = F.transform(F.array_sort(F.array_except(names, named)), lambda n: F.struct(n.alias("field"), F.lit("unknown field").alias("violation")))
    whole = lambda why: F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit(why).alias("violation")))
    every = F.when(F.col("given").isNull(), whole("no record")).when(F.col("v").isNull(), whole("broken record")).when(~_is(F.col("v"), "^OBJECT"), whole("not an object")).otherwise(F.concat(found, unknown))
    out = own.select("key", F.inline(F.filter(every, lambda x: x["violation"].isNotNull())))
    if alone:
        twice = rows.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        out = out.unionByName(twice.select("key", F.lit(None).cast("string").alias("field"), F.lit("several records").alias("violation")))
    return out.select(F.col("key").alias(key), "field", "violation")
