"""Hole paths by minimum curvature over survey stations, from collar to the depths asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratalake.functions.parsing import direction

#: Angles in radians below which a segment is straight, and from which its ends are opposite and have no arc.
STRAIGHT, OPPOSITE = 1e-6, 3.141592


def _angle(one: str, two: str) -> Column:
    """Between two directions, in columns or struct fields that end in e, n, u."""
    cosine = sum((F.col(one.format(c)) * F.col(two.format(c)) for c in "enu"), F.lit(0.0))
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine)))


def _path(stations: DataFrame) -> DataFrame:
    """Stations (hole, md, azimuth, dip) with direction e, n, u, the angle to the one before, and position x, y, z."""
    e, n, u = direction(F.col("azimuth"), F.col("dip"))
    w = Window.partitionBy("hole").orderBy("md")
    t = stations.select("hole", "md", e.alias("e"), n.alias("n"), u.alias("u"))
    t = t.select("*", *(F.lag(c).over(w).alias(f"{c}0") for c in ("md", "e", "n", "u"))).withColumn("angle", _angle("{}", "{}0"))
    half = F.when(F.col("angle") < STRAIGHT, F.lit(0.5)).when(F.col("angle") < OPPOSITE, F.tan(F.col("angle") / 2) / F.col("angle"))
    length = F.col("md") - F.col("md0")
    for axis, c in (("x", "e"), ("y", "n"), ("z", "u")):
        t = t.withColumn(axis, F.sum(F.coalesce(length * half * (F.col(c) + F.col(f"{c}0")), F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return t


def minimum_curvature(stations: DataFrame) -> DataFrame:
    """(hole, md, dogleg, x, y, z): positions of stations (hole, md, azimuth, dip) relative to the first one.

    A segment between equal directions is straight. Opposite directions have no arc: their displacement is null.
    """
    return _path(stations).select("hole", "md", F.degrees("angle").alias("dogleg"), "x", "y", "z")


def full_stations(collars: DataFrame, stations: DataFrame, decisions: DataFrame) -> DataFrame:
    """(hole, md, azimuth, dip) from depth 0 of holes that are not blocked, as `trajectory_decisions` decided.

    Above its first station a hole follows its collar's direction, or that station's (tangent). A hole without stations
    has its collar's direction, or is vertical where that is declared.
    """
    open_holes = decisions.where(~F.col("blocked")).select("hole", "kind", "start")
    measured = stations.join(open_holes.where("kind = 'measured-stations'"), "hole")
    rows = measured.select("hole", "md", "azimuth", "dip")
    top = measured.where("start = 'tangent'").groupBy("hole").agg(F.min(F.struct("md", "azimuth", "dip")).alias("s")).select("hole", F.lit(0.0).alias("md"), "s.azimuth", "s.dip")
    aimed = collars.join(open_holes.where("kind = 'collar-orientation' OR start = 'collar'"), "hole").select("hole", F.lit(0.0).alias("md"), "azimuth", "dip")
    vertical = open_holes.where("kind = 'assumed-vertical'").select("hole", F.lit(0.0).alias("md"), F.lit(0.0).alias("azimuth"), F.lit(-90.0).alias("dip"))
    return rows.unionByName(top).unionByName(aimed).unionByName(vertical)


def positions_at(stations: DataFrame, depths: DataFrame) -> DataFrame:
    """(hole, id, md, x, y, z, extended): places of depths (hole, id, md) on the paths of stations, relative to the first one.

    Inside a segment the place is on its arc; below the last station the hole goes on straight and is marked. Depths
    above the first station, or in holes without any, have no place. Stations and depths meet in one window over a hole.
    """
    point = F.struct("md", "x", "y", "z", "e", "n", "u")
    marks = _path(stations).select("hole", "md", F.lit(0).alias("kind"), F.lit(None).cast(depths.schema["id"].dataType).alias("id"), point.alias("point"))
    both = marks.unionByName(depths.select("hole", F.col("md").cast("double").alias("md"), F.lit(1).alias("kind"), "id", F.lit(None).cast(marks.schema["point"].dataType).alias("point")))
    order = Window.partitionBy("hole").orderBy("md", "kind")
    met = both.withColumn("low", F.last("point", True).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("high", F.first("point", True).over(order.rowsBetween(0, Window.unboundedFollowing)))
    run = F.col("md") - F.col("low.md")
    met = met.where("kind = 1").withColumn("run", run).withColumn("angle", _angle("low.{}", "high.{}"))
    part = F.col("angle") * F.col("run") / (F.col("high.md") - F.col("low.md"))
    met = met.withColumn("part", part).withColumn("extended", F.col("low").isNotNull() & F.col("high").isNull())

    def place(axis: str, c: str) -> Column:
        here, a, b = F.col(f"low.{axis}"), F.col(f"low.{c}"), F.col(f"high.{c}")
        turned = (F.sin(F.col("angle") - F.col("part")) * a + F.sin("part") * b) / F.sin("angle")
        arc = F.col("run") / F.col("part") * F.tan(F.col("part") / 2) * (a + turned)
        return F.when(F.col("run") == 0, here).when(F.col("extended"), here + F.col("run") * a).when(F.col("angle") < STRAIGHT, here + F.col("run") * (a + b) / 2).when(F.col("angle") < OPPOSITE, here + arc)

    return met.select("hole", "id", "md", *(place(axis, c).alias(axis) for axis, c in (("x", "e"), ("y", "n"), ("z", "u"))), "extended")
