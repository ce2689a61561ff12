"""All estimation methods of a population side by side, with a row for every method and target, whatever becomes of it."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratalake.operators.modelling import cokriging, indicator_kriging
from stratalake.operators.spatial import inverse_distance, kriging, neighbourhoods
from stratalake.storage import written

#: Fixed names of the methods, in the order in which they are reported.
METHODS = ("nearest-neighbour", "inverse-distance", "simple-kriging", "ordinary-kriging", "universal-kriging", "ordinary-cokriging", "multiple-indicator", "sequential-gaussian")


@dataclass(frozen=True)
class Fitted:
    """What was fitted for a population; what is None makes its methods fail with the reason given by method, or a plain one.

    point and residual are (sill, range, nugget); coregionalization (structures, nugget) as `cokriging` takes them; indicators
    (sill, range, nugget) by threshold.
    """

    point: tuple[float, float, float] | None = None
    mean: float | None = None
    residual: tuple[float, float, float] | None = None
    coregionalization: tuple[list, list] | None = None
    indicators: dict[float, tuple[float, float, float]] | None = None
    reasons: dict[str, str] = field(default_factory=dict)


ROW = ["method", "target", "samples", "holes", "estimate", "variance", "probabilities", "status", "reason"]


def _rows(method: str, targets: DataFrame, met: DataFrame, found: DataFrame, least: int, reason: Column) -> DataFrame:
    """A row a target: the method's where at least `least` neighbours inform it, else uninformed. found: (target, estimate, variance, probabilities, status)."""
    both = targets.select(F.col("id").alias("target")).join(met, "target", "left").join(found, "target", "left")
    samples = F.coalesce("samples", F.lit(0))
    enough = samples >= least
    status = F.when(~enough, "uninformed").otherwise(F.coalesce("status", F.lit("failed")))
    shown = lambda c: F.when(status == "estimated", F.col(c)).alias(c)
    return both.select(
        F.lit(method).alias("method"), "target", samples.alias("samples"), F.coalesce("holes", F.lit(0)).alias("holes"), shown("estimate"), shown("variance"), shown("probabilities"),
        status.alias("status"), F.when(status == "uninformed", "too few neighbours").when(status == "failed", reason).alias("reason"),
    )


def _failed(method: str, targets: DataFrame, reason: str) -> DataFrame:
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    return targets.select(F.lit(method).alias("method"), F.col("id").alias("target"), F.lit(0).cast("long").alias("samples"), F.lit(0).cast("long").alias("holes"), null("double", "estimate"), null("double", "variance"), null("array<double>", "probabilities"), F.lit("failed").alias("status"), F.lit(reason).alias("reason"))


def run_methods(targets: DataFrame, observations: DataFrame, fitted: Fitted, per_hole: int, most: int, first_radius: float, radius: float | None = None, least: int = 1, secondary: DataFrame | None = None) -> DataFrame:
    """(method, target, samples, holes, estimate, variance, probabilities, status, reason): eight rows a target.

    Status is estimated, uninformed (fewer than `least` neighbours), prior-only (simple kriging without any neighbour: the
    mean and the whole sill) or failed (no model, or a singular system). One neighbourhood serves all methods of one
    variable; cokriging also takes that of `secondary` (id, hole, x, y, value, variable from 1 on). Simulation is no part of
    this library, so its method fails.
    """
    near = written(neighbourhoods(targets, observations, per_hole, most, first_radius, radius))
    met = written(near.groupBy("target").agg(F.count("*").alias("samples"), F.countDistinct("hole").alias("holes")))
    none, no_chances = F.lit(None).cast("double"), F.lit(None).cast("array<double>").alias("probabilities")
    singular = F.lit("singular system")
    why = lambda method, plain: fitted.reasons.get(method, plain)

    def rows(method: str, found: DataFrame) -> DataFrame:
        return _rows(method, targets, met, found, least, singular)

    first = Window.partitionBy("target").orderBy("distance", "id")
    nearest = near.withColumn("nth_near", F.row_number().over(first)).where("nth_near = 1")
    out = [
        rows("nearest-neighbour", nearest.select("target", F.col("value").cast("double").alias("estimate"), none.alias("variance"), no_chances, F.lit("estimated").alias("status"))),
        rows("inverse-distance", inverse_distance(near).select("target", "estimate", none.alias("variance"), no_chances, F.lit("estimated").alias("status"))),
    ]

    def kriged(method: str, model: tuple[float, float, float] | None, kind: str, plain: str, mean: float | None = 0.0) -> DataFrame:
        if model is None or mean is None:
            return _failed(method, targets, why(method, plain))
        found = rows(method, kriging(near, *model, kind, mean).select("target", "estimate", "variance", no_chances, "status"))
        if kind != "simple":
            return found
        alone = (F.col("status") == "uninformed") & (F.col("samples") == 0)
        told = {"estimate": F.lit(float(mean)), "variance": F.lit(float(model[0] + model[2])), "status": F.lit("prior-only"), "reason": F.lit("no neighbour; the mean and the whole sill")}
        return found.select(*(F.when(alone, told[c]).otherwise(F.col(c)).alias(c) if c in told else F.col(c) for c in ROW))

    out += [
        kriged("simple-kriging", fitted.point, "simple", "no covariance model", fitted.mean),
        kriged("ordinary-kriging", fitted.point, "ordinary", "no covariance model"),
        kriged("universal-kriging", fitted.residual, "universal", "no covariance of residuals"),
    ]
    if fitted.coregionalization and secondary is not None:
        both = near.select("target", "tx", "ty", "id", "x", "y", F.col("value").cast("double").alias("value"), F.lit(0).alias("variable"))
        for r in secondary.select("variable").distinct().collect():  # a declared few
            part = neighbourhoods(targets, secondary.where(F.col("variable") == r["variable"]).drop("variable"), per_hole, most, first_radius, radius)
            both = both.unionByName(part.select("target", "tx", "ty", "id", "x", "y", F.col("value").cast("double").alias("value"), F.lit(int(r["variable"])).alias("variable")))
        out.append(rows("ordinary-cokriging", cokriging(both, *fitted.coregionalization).select("target", "estimate", "variance", no_chances, "status")))
    else:
        out.append(_failed("ordinary-cokriging", targets, why("ordinary-cokriging", "no secondary variables")))
    if fitted.indicators:
        found = indicator_kriging(near, fitted.indicators)
        out.append(rows("multiple-indicator", found.select("target", none.alias("estimate"), none.alias("variance"), "probabilities", "status")))
    else:
        out.append(_failed("multiple-indicator", targets, why("multiple-indicator", "no fitted threshold")))
    out.append(_failed("sequential-gaussian", targets, why("sequential-gaussian", "simulation is not run here")))
    return reduce(DataFrame.unionByName, (x.select(*ROW) for x in out))


def method_summary(rows: DataFrame) -> DataFrame:
    """(method, status, targets) of `run_methods`."""
    return rows.groupBy("method", "status").agg(F.count("*").alias("targets"))
