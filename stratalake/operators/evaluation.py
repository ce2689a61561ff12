"""Evaluation tables: weighted and hole-wise scores, convergence, review metrics, choices, bases. Rows without a truth or an estimate take no part."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from stratalake.functions.parsing import wendland
from stratalake.operators.ranks import beside, quantiles
from stratalake.operators.scores import brier, error_scores, fair_crps, log_score


def weighted_scores(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Length-weighted bias, MAE and RMSE, and the mean over holes of their RMSE, of rows (truth, estimate, length, hole). Lengths not above 0 weigh 1."""
    e, w = F.col("estimate") - F.col("truth"), F.when(F.col("length") > 0, F.col("length")).otherwise(1.0)
    by_hole = rows.where("truth IS NOT NULL AND estimate IS NOT NULL").groupBy(*keys, "hole").agg(F.count("*").alias("n"), F.sum(w).alias("w"), F.sum(w * e).alias("we"), F.sum(w * F.abs(e)).alias("wa"), F.sum(w * e * e).alias("ww"), F.sqrt(F.avg(e * e)).alias("own"))
    total = F.sum("w")
    return by_hole.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum("we") / total).alias("bias"), (F.sum("wa") / total).alias("mae"), F.sqrt(F.sum("ww") / total).alias("rmse"), F.avg("own").alias("hole_rmse"))


def paired_difference(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(n, holes, difference): mean of absolute errors of a less those of b, over targets (hole, error_a, error_b) of both."""
    met = rows.where("error_a IS NOT NULL AND error_b IS NOT NULL")
    return met.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct("hole").alias("holes"), F.avg(F.abs("error_a") - F.abs("error_b")).alias("difference"))


def _quantile(members: Column, q: float) -> Column:
    """Linear interpolation between order statistics of an array."""
    ranked, at = F.array_sort(members), q * (F.size(members) - 1)
    low = F.floor(at).cast("int")
    a, b = F.element_at(ranked, low + 1), F.element_at(ranked, F.least(low + 2, F.size(members)))
    return a + (b - a) * (at - low)


def convergence(rows: DataFrame, sizes: tuple[int, ...] = (8, 16, 32)) -> DataFrame:
    """(realizations, targets, rmse, crps, coverage) of the first 8, 16 and 32 members of rows (truth, members) that have so many."""
    each = rows.withColumn("m", F.explode(F.array(*map(F.lit, sizes)))).where(F.size("members") >= F.col("m")).withColumn("some", F.slice("members", F.lit(1), F.col("m")))
    mean = F.aggregate("some", F.lit(0.0), lambda a, x: a + x) / F.col("m")
    inside = (_quantile(F.col("some"), 0.1) <= F.col("truth")) & (F.col("truth") <= _quantile(F.col("some"), 0.9))
    return each.groupBy(F.col("m").alias("realizations")).agg(F.count("*").alias("targets"), F.sqrt(F.avg(F.pow(mean - F.col("truth"), 2))).alias("rmse"), F.avg(fair_crps(F.col("truth"), F.col("some"))).alias("crps"), F.avg(inside.cast("double")).alias("coverage"))


def review_metrics(rows: DataFrame, threshold: float) -> DataFrame:
    """(kind, altered, recall, false_flags): shares of altered and of unaltered records (kind, altered, score) above the threshold."""
    over = (F.col("score") > threshold).cast("double")
    return rows.groupBy("kind").agg(F.count_if("altered").alias("altered"), F.avg(F.when(F.col("altered"), over)).alias("recall"), F.avg(F.when(~F.col("altered"), over)).alias("false_flags"))


def chosen_configuration(rows: DataFrame) -> DataFrame:
    """The configuration of the least mean objective over seeds, ties to fewer parameters and then to the first, of rows (configuration, seed, parameters, objective)."""
    mean = rows.groupBy("configuration").agg(F.min("parameters").alias("parameters"), F.avg("objective").alias("objective"))
    return mean.agg(F.min(F.struct("objective", "parameters", "configuration")).alias("best")).where("best IS NOT NULL").select("best.*")


def stopping(history: DataFrame, patience: int) -> DataFrame:
    """(run, best, stopped): the first epoch of the least loss before training stops, which is `patience` epochs without a lower one."""
    up_to = Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    lows = history.withColumn("best", F.min(F.struct("loss", "epoch")).over(up_to))
    stop = lows.groupBy("run").agg(F.coalesce(F.min(F.when(F.col("epoch") - F.col("best.epoch") >= patience, F.struct("epoch", F.col("best.epoch").alias("best")))), F.max(F.struct("epoch", F.col("best.epoch").alias("best")))).alias("at"))
    return stop.select("run", F.col("at.best").alias("best"), F.col("at.epoch").alias("stopped"))


def value_summary(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(n, low, middle, high, mean) of a nullable column; keys without values have n = 0."""
    sums = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"))
    # keys without values are kept: the sums meet their medians as rows of one table
    middle = quantiles(rows, keys, value, {"middle": 0.5})
    none = sums.where("n = 0").select(*keys, F.lit(None).cast("double").alias("middle"))
    return beside(sums, middle.unionByName(none), keys).select(*keys, "n", "low", "middle", "high", "mean")


def registration(rows: DataFrame, least: float) -> DataFrame:
    """(hole, compared, share, status): how many values embedded in a second table equal the first's, and what that makes of a hole."""
    both = F.col("own").isNotNull() & F.col("embedded").isNotNull()
    met = rows.groupBy("hole").agg(F.count_if(both).alias("compared"), F.avg(F.when(both, (F.col("own") == F.col("embedded")).cast("double"))).alias("share"))
    return met.select("hole", "compared", "share", F.when(F.col("compared") == 0, "unregistered").when(F.col("share") >= least, "confirmed").otherwise("conflicting").alias("status"))


def informed_share(truth: DataFrame, realizations: DataFrame, hard: DataFrame) -> DataFrame:
    """(informed, cells, agreement): how often realizations (realization, cell, category) hold the truth's category, in cells with and without hard data."""
    flag = hard.select("cell").distinct().withColumn("informed", F.lit(True))
    met = realizations.join(truth.withColumnRenamed("category", "true_category"), "cell").join(flag, "cell", "left").withColumn("informed", F.coalesce("informed", F.lit(False)))
    return met.groupBy("informed").agg(F.countDistinct("cell").alias("cells"), F.avg((F.col("category") == F.col("true_category")).cast("double")).alias("agreement"))


def knot_basis(x: Column, y: Column, knots: list[tuple[float, float]], reach: float) -> Column:
    """Array of Wendland values of a point at each knot, a declared few."""
    at = F.array(*(F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in knots))
    return F.transform(at, lambda k: wendland(F.sqrt(F.pow(x - k.x, 2) + F.pow(y - k.y, 2)) / reach))


def live_columns(rows: DataFrame, basis: str, count: int) -> list[int]:
    """Indices of the basis columns that are not 0 in all rows."""
    found = rows.agg(*(F.max(F.abs(F.element_at(basis, i + 1))).alias(f"c{i}") for i in range(count))).first()
    return [i for i in range(count) if found[i]]


def principal_axes(rows: DataFrame, columns: list[str], rank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, axes, variances) of the first principal axes, from sums of products; a few columns, so that the driver decomposes a small matrix."""
    complete = rows.dropna(subset=columns)
    n, *mean = complete.agg(F.count("*"), *(F.avg(c) for c in columns)).first()
    if not n:
        raise ValueError("no complete row")
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    found = complete.agg(*(F.avg((F.col(columns[i]) - mean[i]) * (F.col(columns[j]) - mean[j])) for i, j in pairs)).first()
    matrix = np.zeros((len(columns),) * 2)
    for (i, j), value in zip(pairs, found):
        matrix[i, j] = matrix[j, i] = value
    variances, axes = np.linalg.eigh(matrix)
    order = np.argsort(-variances)[:rank]
    return np.array(mean), axes[:, order].T, variances[order]


def reconstruction_score(columns: list[str], means: np.ndarray, axes: np.ndarray) -> Column:
    """Mean squared residual of a row off the plane of the axes."""
    centred = [F.col(c) - float(m) for c, m in zip(columns, means)]
    weights = [sum((x * float(a) for x, a in zip(centred, axis)), F.lit(0.0)) for axis in axes]
    residuals = [x - sum((w * float(axis[i]) for w, axis in zip(weights, axes)), F.lit(0.0)) for i, x in enumerate(centred)]
    return sum((r * r for r in residuals), F.lit(0.0)) / len(columns)


def evaluation_table(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, value): all scores of continuous estimates (truth, estimate, length, hole) as one long table; metrics without a value are left out."""
    plain = error_scores(rows, keys)
    weighted = weighted_scores(rows, keys).select(*keys, *(F.col(c).alias(f"weighted_{c}") for c in ("bias", "mae", "rmse")), "hole_rmse")
    wide = beside(plain, weighted, keys)
    metrics = [c for c in wide.columns if c not in keys]
    return wide.select(*keys, *(F.col(c).cast("double").alias(c) for c in metrics)).unpivot(keys, metrics, "metric", "value").where("value IS NOT NULL")


def categorical_evaluation(rows: DataFrame) -> DataFrame:
    """(category, n, brier, log_score, reference, skill, hits) of chances (target, category, probability, truth).

    Hits are the targets whose likeliest category (ties to the first name) is this one and true. The reference always
    gives the category's own share.
    """
    known = rows.where("probability IS NOT NULL AND truth IS NOT NULL").withColumn("outcome", (F.col("category") == F.col("truth")).cast("double"))
    best = known.groupBy("target").agg(F.min(F.struct((-F.col("probability")).alias("p"), "category", "outcome")).alias("best"))
    hits = best.groupBy(F.col("best.category").alias("category")).agg(F.sum("best.outcome").cast("long").alias("hits"))
    p, o = F.col("probability"), F.col("outcome")
    each = known.groupBy("category").agg(F.count("*").alias("n"), F.avg(brier(p, o)).alias("brier"), F.avg(log_score(p, o)).alias("log_score"), (F.avg(o) * (1 - F.avg(o))).alias("reference"))
    skill = F.when(F.col("reference") > 0, 1 - F.col("brier") / F.col("reference"))
    return each.join(hits, "category", "left").select("category", "n", "brier", "log_score", "reference", skill.alias("skill"), F.coalesce("hits", F.lit(0)).alias("hits"))
