"""A bounded filter that spares texts a shuffle: rows whose key is surely not among the members stay put."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The filter has 64 bits a word, so 2 MB whatever the data; beyond some ten million members more rows pass, none is lost.
WORDS = 1 << 18


def possibly_in(rows: DataFrame, keys: list[str], members: DataFrame, member_keys: list[str], words: int = WORDS) -> DataFrame:
    """Rows of `rows` whose keys may be among those of `members`; an exact join has to follow.

    Every true member passes (null keys too, if null-safe equality follows); no members, no rows."""

    def slot(names):
        return F.pmod(F.xxhash64(*names), F.lit(64 * words))

    at = slot(member_keys)
    marks = members.select(F.shiftright(at, 6).alias("id"), F.expr("1L").alias("one"), (at % 64).cast("int").alias("bit"))
    marks = marks.groupBy("id").agg(F.bit_or(F.call_function("shiftleft", "one", "bit")).alias("word"))
    dense = rows.sparkSession.range(words).join(marks, "id", "left").select("id", F.coalesce("word", F.lit(0).cast("long")).alias("word"))
    filled = dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "word"))), lambda x: x["word"]).alias("filter")).scalar()
    word = F.get(filled, F.shiftright(slot(keys), 6).cast("int"))
    return rows.where(F.call_function("shiftrightunsigned", word, (slot(keys) % 64).cast("int")) % 2 != 0)
