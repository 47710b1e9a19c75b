"""Distributions that Spark lacks: Student's t and the exact binomial test."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - math.lgamma(a) - math.lgamma(b) + math.lgamma(a + b)) / a
    c, d, out = 1.0, 1 / (1 - (a + b) * x / (a + 1)), 1 / (1 - (a + b) * x / (a + 1))
    for m in range(1, 400):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + up * d), 1 + up / c
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def t_two_sided(t: float, df: int) -> float:
    return 1.0 if t == 0 else beta_share(df / 2, 0.5, df / (df + t * t))


def mcnemar(b: int, c: int) -> float:
    """Two-sided exact binomial p of b against c, at most 1."""
    n = b + c
    return 1.0 if not n else min(1.0, 2 * sum(math.comb(n, k) for k in range(min(b, c) + 1)) / 2**n)


def t_table(spark: SparkSession) -> DataFrame:
    rows = [(float(df), t / 4, t_two_sided(t / 4, df)) for df in (5, 9, 24) for t in range(0, 17)]
    return spark.createDataFrame(rows, "df double, t double, p double")


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0: Stirling's series at x + 8, carried back."""
    z = x + 8
    series = 1 / (12 * z) - 1 / (360 * F.pow(z, F.lit(3))) + 1 / (1260 * F.pow(z, F.lit(5))) - 1 / (1680 * F.pow(z, F.lit(7)))
    back = F.log(x)
    for i in range(1, 8):
        back = back + F.log(x + i)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - back


def beta_column(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function for any a, b > 0 and x of 0 to 1, as one expression.

    Its continued fraction runs as a fold; the steps it needs grow with the root of a + b."""
    turn = x > (a + 1) / (a + b + 2)
    p, q, y = F.when(turn, b).otherwise(a), F.when(turn, a).otherwise(b), F.when(turn, 1 - x).otherwise(x)
    front = F.exp(p * F.log(y) + q * F.log1p(-y) - log_gamma(p) - log_gamma(q) + log_gamma(p + q)) / p
    given = F.struct(p.cast("double").alias("p"), q.cast("double").alias("q"), y.cast("double").alias("y"))

    def folded(s: Column) -> Column:
        p, q, y = s["p"], s["q"], s["y"]
        first = 1 / (1 - (p + q) * y / (p + 1))

        def step(state: Column, m: Column) -> Column:
            up = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
            d, c = 1 / (1 + up * state["d"]), 1 + up / state["c"]
            down = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
            d2, c2 = 1 / (1 + down * d), 1 + down / c
            return F.struct(c2.alias("c"), d2.alias("d"), (state["out"] * c * d * c2 * d2).alias("out"))

        steps = F.sequence(F.lit(1), (100 + 6 * F.sqrt(p + q)).cast("int"))
        return F.aggregate(steps, F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("out")), step)["out"]

    share = front * F.transform(F.array(given), folded)[0]
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise(F.when(turn, 1 - share).otherwise(share))


def t_column(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t with any degrees of freedom; infinite t gives 0, null or NaN null."""
    p = beta_column(df / 2, F.lit(0.5), df / (df + t * t))
    return F.when(t.isNull() | F.isnan(t) | df.isNull(), F.lit(None)).when(F.abs(t) == F.lit(float("inf")), F.lit(0.0)).when(t == 0, F.lit(1.0)).otherwise(p)


def mcnemar_column(b: Column, c: Column) -> Column:
    """Two-sided exact binomial p of b against c for any counts, at most 1: twice the lower tail, an incomplete beta at one half."""
    least, most = F.least(b, c), F.greatest(b, c)
    return F.when(b + c == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * beta_column(most, least + 1, F.lit(0.5))))
