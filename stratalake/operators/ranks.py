"""Ranks, quantiles and normal scores over a few keys with many values: no key's values meet in one task."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F


def beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Both tables' columns for equal keys, null keys included."""
    other = right.select(*(F.col(k).alias(f"__{k}") for k in keys), *(c for c in right.columns if c not in keys))
    met = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys), F.lit(True))
    return left.join(other, met).drop(*(f"__{k}" for k in keys))


def ranked_values(rows: DataFrame, keys: list[str], value: str, weight: Column | None = None, parts: int = 256) -> DataFrame:
    """(keys, value, n, upto, total): each distinct value with its weight, the weight up to and with it, and its key's; nulls take no part.

    Equal values are counted first. The rest are parted at about even shares of the column, so that each sorted stretch
    holds a small share of the values; stretches start at the sums of those before. Where the cuts lie changes no result.
    """
    known = rows.where(F.col(value).isNotNull())
    cuts = known.agg(F.percentile_approx(F.col(value).cast("double"), [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    edges = [float("-inf"), *sorted({c for c in cuts if math.isfinite(c)}), float("inf")]
    if len(edges) < 3:
        edges.insert(1, 0.0)  # the bucketizer asks for two stretches at least
    counts = known.groupBy(*keys, F.col(value).alias("value")).agg(F.sum(F.lit(1) if weight is None else weight).alias("n")).withColumn("at", F.col("value").cast("double"))
    counts = Bucketizer(splits=edges, inputCol="at", outputCol="part", handleInvalid="keep").transform(counts)
    w = Window.partitionBy(*keys).orderBy("part")
    sums = counts.groupBy(*keys, "part").agg(F.sum("n").alias("held"))  # at most `parts` rows a key
    starts = sums.select(*keys, "part", (F.sum("held").over(w) - F.col("held")).alias("before"), F.sum("held").over(Window.partitionBy(*keys)).alias("total"))
    inside = Window.partitionBy(*keys, "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return beside(counts, starts, [*keys, "part"]).select(*keys, "value", "n", (F.col("before") + F.sum("n").over(inside)).alias("upto"), "total")


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float], higher: bool = False) -> DataFrame:
    """(keys, a column for each share): exact quantiles, linear between ranks, or the value at the next whole rank."""
    ranked = ranked_values(rows, keys, value)
    last = F.col("total") - 1

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto")), F.col("value")))

    found = {}
    for name, q in shares.items():
        low, high = at(F.floor(q * last)), at(F.ceil(q * last))
        rest = F.max(q * last - F.floor(q * last))
        found[name] = high if higher else low + (high - low) * rest
    return ranked.groupBy(*keys).agg(*(c.alias(name) for name, c in found.items()))


#: Fixed values of the published rational approximation of the inverse normal distribution: centre and tails.
CENTRE = ((-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.357751867269, -30.66479806614716, 2.506628277459239), (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0))
TAIL = ((-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783), (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0))
TAIL_SHARE = 0.02425


def inverse_normal(p: Column) -> Column:
    """The standard normal quantile of p, within 1.2e-9 of its size; null outside (0, 1)."""

    def ratio(x: Column, form: tuple) -> Column:
        over, under = (reduce(lambda acc, c: acc * x + c, side[1:], F.lit(side[0])) for side in form)
        return over / under

    q = p - 0.5
    tail = lambda share: ratio(F.sqrt(-2 * F.ln(share)), TAIL)
    return F.when((p <= 0) | (p >= 1), None).when(p < TAIL_SHARE, tail(p)).when(p > 1 - TAIL_SHARE, -tail(1 - p)).otherwise(q * ratio(q * q, CENTRE))


def normal_scores(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n, score): the table of a normal-score transform, the score of the middle of each value's ranks.

    Both ways read the table by `calibration.interpolated`, which stays constant beyond its ends.
    """
    return ranked_values(rows, keys, value).select(*keys, "value", "n", inverse_normal((F.col("upto") - F.col("n") / 2) / F.col("total")).alias("score"))
