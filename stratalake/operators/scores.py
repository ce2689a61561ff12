"""Evaluation: error scores, probability and ensemble scores, quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stratalake.operators.ranks import beside, quantiles, ranked_values


def error_scores(rows: DataFrame, keys: list[str]) -> DataFrame:
    """n, holes, bias, MAE, RMSE and absolute-error quantiles of (truth, estimate, hole) rows."""
    known = rows.where("truth IS NOT NULL AND estimate IS NOT NULL").withColumn("error", F.col("estimate") - F.col("truth")).withColumn("miss", F.abs("error"))
    sums = known.groupBy(*keys).agg(
        F.count("*").alias("n"), F.countDistinct("hole").alias("holes"), F.avg("error").alias("bias"), F.avg("miss").alias("mae"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse")
    )
    return beside(sums, quantiles(known, keys, "miss", {"p50": 0.5, "p90": 0.9}), keys)


def fair_crps(truth: Column, members: Column) -> Column:
    """Continuous ranked probability score of an ensemble, unbiased in its size (two members at least)."""
    m = F.size(members)
    ranked = F.array_sort(members)
    miss = F.aggregate(members, F.lit(0.0), lambda acc, x: acc + F.abs(x - truth)) / m
    spread = F.aggregate(F.transform(ranked, lambda x, i: (2 * i + 1 - m) * x), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(m > 1, miss - spread / (m * (m - 1)))


def brier(probability: Column, outcome: Column) -> Column:
    return F.pow(probability - outcome, 2)


def log_score(probability: Column, outcome: Column, floor: float = 1e-3) -> Column:
    p = F.least(F.greatest(probability, F.lit(floor)), F.lit(1 - floor))
    return -(outcome * F.ln(p) + (1 - outcome) * F.ln(1 - p))


def quantile_higher(rows: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """The value at the next whole rank from q."""
    return quantiles(rows, keys, value, {"quantile": q}, higher=True)


def weighted_deciles(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """(keys, decile, value): the first value whose share of cumulated weight reaches each tenth."""
    share = F.col("upto") / F.col("total")
    reached = F.filter(F.array(*map(F.lit, range(1, 10))), lambda d: share * 10 >= d)
    return ranked_values(rows, keys, value, F.col(weight)).select(*keys, F.explode(reached).alias("decile"), "value").groupBy(*keys, "decile").agg(F.min("value").alias("value"))
