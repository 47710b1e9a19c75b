"""Stratified folds that keep each group (a series of calls) whole.

Groups with equal class counts are interchangeable: as many as fill all folds evenly are dealt in turn, by
distributed ranks. What is left of each kind, fewer groups than folds, goes to a greedy balance: largest
first, each into the fold whose shares of the group's own classes are smallest. The greedy state is a count
a fold and class. It takes the MOST largest of them. The smaller ones go before it starts, in order of size among those with the same largest
class, forth and back over the folds, so that it evens out what they leave.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.evidence import kept

#: Groups a repeat that the greedy balance takes, all of them in memory.
MOST = 2000


def cost(held: list[int], vector: list[int], totals: list[int]) -> float:
    """How full a fold is already of the classes that the group adds."""
    out = 0.0
    for h, v, t in zip(held, vector, totals):
        out += (h * v) / max(t * t, 1)
    return out


def balanced(groups: list[list[int]], start: list[list[int]], totals: list[int]) -> list[int]:
    """Fold of each class vector, in order; ties go to the lower fold. `start` grows by what is placed."""
    out = []
    for vector in groups:
        fold = min(range(len(start)), key=lambda f: (cost(start[f], vector, totals), f))
        start[fold] = [h + v for h, v in zip(start[fold], vector)]
        out.append(fold)
    return out


def ranked(groups: DataFrame, kind: list[str], order: list[str]) -> DataFrame:
    """groups with nth (from 1, in `order`, then by tie) among those of their kind, and m, how many these are.

    Ranks come from counts by 4,096 buckets of ties, so a kind or size that most groups share is no one task's work."""
    every = Window.partitionBy(*kind)
    sizes = groups.groupBy(*kind, *order, "bucket").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select(*kind, *order, "bucket", F.sum("n").over(every).alias("m"), (F.sum("n").over(every.orderBy(*order, "bucket")) - F.col("n")).alias("before"))
    inside = Window.partitionBy(*kind, *order, "bucket").orderBy("tie", "group")
    return groups.join(sizes, [*kind, *order, "bucket"]).withColumn("nth", F.col("before") + F.row_number().over(inside))


def grouped_folds(rows: DataFrame, group: str, label: str, classes: tuple[str, ...], folds: int = 5, repeats: int = 5, seed: int = 42, most: int = MOST) -> DataFrame:
    """(rep, group, fold) of every group and repeat; no group is ever in two folds of one repeat.

    Labels outside `classes`, null among them, count as one more class. A null group is a group of its own.
    Repeats differ in how ties between equal class counts fall. An empty table gives no rows."""
    named = [F.count(F.when(F.col(label) == c, 1)) for c in classes]
    rest = F.count(F.lit(1)) - reduce(lambda a, b: a + b, named)
    series = kept(rows.groupBy(F.col(group).alias("group")).agg(F.array(*named, rest).alias("vector")))
    width = len(classes) + 1
    sums = series.agg(*(F.sum(F.get("vector", F.lit(i))).alias(f"n{i}") for i in range(width))).first()
    totals = [n or 0 for n in sums]
    tie = F.md5(F.concat(F.lit(f"{seed}:"), F.col("rep").cast("string"), F.lit(":"), F.coalesce(F.col("group").cast("string"), F.lit(""))).cast("binary"))
    keyed = series.select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("rep")).withColumn("tie", tie).withColumn("bucket", F.substr("tie", F.lit(1), F.lit(3)))
    size = F.aggregate("vector", F.lit(0).cast("long"), lambda a, v: a + v)
    equal = ranked(keyed, ["rep", "vector"], [])
    equal = kept(equal.select("rep", "group", "vector", "tie", "bucket", size.alias("size"), (F.col("nth") > F.col("m") - F.col("m") % folds).alias("left"), ((F.col("nth") - 1) % folds).cast("int").alias("fold")))
    left = equal.where("left").drop("fold")
    tops = [left.where(F.col("rep") == r).orderBy(F.desc("size"), "tie", "group").limit(most).select("rep", "group", "vector", "size", "tie").collect() for r in range(repeats)]
    # the last group taken parts the smaller ones from the rest by its place in the same order
    last = {r: t[-1] for r, t in enumerate(tops) if len(t) == most}
    after = reduce(lambda a, b: a | b, [(F.col("rep") == r) & ((F.col("size") < x["size"]) | (F.col("size") == x["size"]) & (F.col("tie") > x["tie"])) for r, x in last.items()], F.lit(False))
    small = left.where(after).withColumns({"main": F.array_position("vector", F.array_max("vector")), "less": -F.col("size")})
    small = ranked(small, ["rep", "main"], ["less"]).withColumns({"turn": F.floor((F.col("nth") - 1) / folds), "at": (F.col("nth") - 1) % folds})
    small = small.withColumn("fold", F.when(F.col("turn") % 2 == 0, F.col("at")).otherwise(folds - 1 - F.col("at")).cast("int"))
    columns = ["rep", "group", "vector", "fold"]
    dealt = equal.where(~F.col("left")).select(columns).unionByName(small.select(columns))
    begun = dealt.groupBy("rep", "fold").agg(*(F.sum(F.get("vector", F.lit(i))).alias(f"n{i}") for i in range(width))).collect()  # a row a fold
    start = {r: [[0] * width for _ in range(folds)] for r in range(repeats)}
    for row in begun:
        start[row["rep"]][row["fold"]] = list(row[2:])
    placed = [(r, g["group"], f) for r, t in enumerate(tops) for g, f in zip(t, balanced([g["vector"] for g in t], start[r], totals))]
    out = dealt.select("rep", "group", "fold")
    return out.unionByName(rows.sparkSession.createDataFrame(placed, out.schema))


def assigned(rows: DataFrame, group: str, dealt: DataFrame) -> DataFrame:
    """rows once a repeat, with rep and fold of their group."""
    other = dealt.withColumnRenamed("group", "_group")
    return rows.join(other, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")
