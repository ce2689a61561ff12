"""Calibration and comparison: interpolation on fitted points, skill, declustering weights, distances of frequencies. Nulls take no part."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def tie_means(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x, y, weight): mean and number of y for each distinct x, the input of a rising fit."""
    return rows.where("x IS NOT NULL AND y IS NOT NULL").groupBy(*keys, "x").agg(F.avg("y").alias("y"), F.count("*").alias("weight"))


def interpolated(values: DataFrame, fitted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, x, estimate): values (keys, id, x) on the line through fitted points (keys, x, fitted), constant beyond the first and last; null without points.

    Both tables are merged in one window pass, so no value meets more than its two points.
    """
    point = F.struct("x", "fitted")
    both = fitted.select(*keys, "x", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), point.alias("point")).unionByName(values.select(*keys, "x", F.lit(1).alias("kind"), F.col("id").cast("long").alias("id"), F.lit(None).cast("struct<x:double,fitted:double>").alias("point")))
    order = Window.partitionBy(*keys).orderBy("x", "kind")
    met = both.withColumn("low", F.last("point", True).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("high", F.first("point", True).over(order.rowsBetween(0, Window.unboundedFollowing)))
    share = (F.col("x") - F.col("low.x")) / (F.col("high.x") - F.col("low.x"))
    line = F.col("low.fitted") + (F.col("high.fitted") - F.col("low.fitted")) * share
    estimate = F.when(F.col("low").isNull(), F.col("high.fitted")).when(F.col("high").isNull() | (F.col("low.x") == F.col("x")), F.col("low.fitted")).otherwise(line)
    return met.where("kind = 1").select(*keys, "id", "x", estimate.alias("estimate"))


def brier_skill(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(n, brier, reference, skill) of rows (probability, outcome): the reference is the outcomes' own share; without spread there is no skill."""
    p, o = F.col("probability"), F.col("outcome")
    met = rows.where("probability IS NOT NULL AND outcome IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("n"), F.avg((p - o) * (p - o)).alias("brier"), (F.avg(o) * (1 - F.avg(o))).alias("reference"))
    return met.withColumn("skill", F.when(F.col("reference") > 0, 1 - F.col("brier") / F.col("reference")))


def decluster_weights(points: DataFrame, cell: float, offsets: int = 4) -> DataFrame:
    """(id, weight): one over the points of a point's cell and the cells, averaged over diagonal grid offsets, with mean 1."""
    shifted = points.select("id", "x", "y", F.explode(F.sequence(F.lit(0), F.lit(offsets - 1))).alias("o"))
    shift = F.col("o") * (cell / offsets)
    keyed = shifted.select("id", "o", F.floor((F.col("x") + shift) / cell).alias("cx"), F.floor((F.col("y") + shift) / cell).alias("cy"))
    cells = keyed.groupBy("o", "cx", "cy").agg(F.count("*").alias("held"))
    total = cells.groupBy("o").agg(F.count("*").alias("cells"), F.sum("held").alias("points"))  # a row an offset
    each = keyed.join(cells, ["o", "cx", "cy"]).join(total, "o")
    return each.groupBy("id").agg((F.sum(F.col("points") / (F.col("held") * F.col("cells"))) / offsets).alias("weight"))


def total_variation(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """(distance): half the sum of the absolute differences of two tables' frequencies (key, n)."""
    a, b = (t.groupBy(key).agg(F.sum("n").alias("n")) for t in (one, two))
    na, nb = (t.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for t in (a, b))
    both = a.select(key, (F.col("n") / max(1, na)).alias("p")).join(b.select(key, (F.col("n") / max(1, nb)).alias("q")), key, "full_outer")
    return both.agg((F.coalesce(F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))), F.lit(0.0)) / 2).alias("distance"))


def histogram(rows: DataFrame, keys: list[str], value: str, origin: float, width: float) -> DataFrame:
    """(keys, bin, n, share) of a column by bins of one width."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.floor((F.col(value) - origin) / width).alias("bin")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def record_faults(rows: DataFrame) -> DataFrame:
    """(id, fault) of rows (id, role, support, kind, from_md, to_md): controls with a support, others without one, events with a length, intervals without."""
    control = F.col("role") == "control"
    length = F.col("to_md") > F.col("from_md")
    faults = F.array(
        F.when(control & F.col("support").isNotNull(), "control with a support"), F.when(~control & F.col("support").isNull(), "result without a support"),
        F.when((F.col("kind") == "event") & F.coalesce(length, F.lit(False)), "event with a length"), F.when((F.col("kind") == "interval") & ~F.coalesce(length, F.lit(False)), "interval without a length"),
    )
    return rows.select("id", F.explode(F.filter(faults, lambda x: x.isNotNull())).alias("fault"))
