"""Neighbours, distances, declustering, variograms and simple estimators over points."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from stratalake.storage import written


def cell_pairs(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Pairs within `radius` in x and y, by grid cells: an equi-join on the cells around each left point."""
    cell = lambda c: F.floor(F.col(c) / radius)
    around = left.withColumn("dx", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("dy", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
    keyed = around.withColumn("cx", cell("x") + F.col("dx")).withColumn("cy", cell("y") + F.col("dy")).drop("dx", "dy")
    other = right.select(F.col("id").alias("id_2"), F.col("x").alias("x_2"), F.col("y").alias("y_2"), F.floor(F.col("x") / radius).alias("cx"), F.floor(F.col("y") / radius).alias("cy"))
    d = F.sqrt(F.pow(F.col("x") - F.col("x_2"), 2) + F.pow(F.col("y") - F.col("y_2"), 2))
    return keyed.join(other, ["cx", "cy"]).withColumn("distance", d).where(F.col("distance") <= radius).drop("cx", "cy")


def only_neighbour(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """(id, neighbours, id_2): how many points lie within the radius, and which if it is one."""
    met = cell_pairs(left, right, radius).groupBy("id").agg(F.count("*").alias("neighbours"), F.min("id_2").alias("one"))
    return left.select("id").join(met, "id", "left").select("id", F.coalesce("neighbours", F.lit(0)).alias("neighbours"), F.when(F.col("neighbours") == 1, F.col("one")).alias("id_2"))


def capped_neighbours(pairs: DataFrame, per_hole: int, most: int) -> DataFrame:
    """The nearest `most` observations of each target, at most `per_hole` of a hole; pairs: (target, hole, id, distance, ...)."""
    in_hole = Window.partitionBy("target", "hole").orderBy("distance", "id")
    in_all = Window.partitionBy("target").orderBy("distance", "id")
    capped = pairs.withColumn("nth", F.row_number().over(in_hole)).where(F.col("nth") <= per_hole).drop("nth")
    return capped.withColumn("nth", F.row_number().over(in_all)).where(F.col("nth") <= most)


def informed(rows: DataFrame) -> DataFrame:
    """Rows whose x, y and value are numbers: null and NaN inform nothing."""
    return rows.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan(cast({c} AS double))" for c in ("x", "y", "value")))


#: Halvings of the first radius down to the finest cells, and targets of a task of the neighbour search.
DEPTH, TARGETS = 16, 8192


def _first_of_places(observations: DataFrame, per_hole: int, most: int) -> DataFrame:
    """Observations that can be neighbours at all: of those at one place, the least ids, with spares for a target and a hole that are left out."""
    in_hole, before = Window.partitionBy("x", "y", "hole").orderBy("id"), Window.partitionBy("x", "y").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    near = observations.withColumn("_nth", F.row_number().over(in_hole)).where(F.col("_nth") <= per_hole + 1)
    ahead = F.coalesce(F.sum((F.col("_nth") <= per_hole).cast("int")).over(before), F.lit(0))
    return near.withColumn("_ahead", ahead).where(F.col("_ahead") <= most + per_hole).drop("_nth", "_ahead")


def _with_levels(goals: DataFrame, known: DataFrame, per_hole: int, most: int, unit: float) -> DataFrame:
    """`goals` with the level of the finest cell, `unit` times a power of two wide, that holds over half of `most` of the known, or DEPTH."""
    cells = [F.floor(F.col(c) / (unit * F.pow(F.lit(2.0), F.col("level")))).alias(f"c{c}") for c in "xy"]
    levels = F.explode(F.sequence(F.lit(0), F.lit(DEPTH - 1))).alias("level")
    spread = lambda df: df.repartition(max(1, -(-df.count() // TARGETS)), "x", "y").select("*", levels)  # noqa: E731  else one task counts the cells of a small file
    held = spread(known.select("hole", "x", "y")).groupBy("level", *cells, "hole").count().groupBy("level", "cx", "cy").agg(F.sum(F.least("count", F.lit(per_hole))).alias("n"))
    crowded = held.where(F.col("n") > max(1, most // 2)).drop("n")  # one may be the target itself
    finest = spread(goals.select("id", "x", "y")).select("id", "level", *cells).join(crowded, ["level", "cx", "cy"]).groupBy("id").agg(F.min("level").alias("level"))
    return goals.join(finest, "id", "left").withColumn("level", F.coalesce("level", F.lit(DEPTH)))


def neighbourhoods(targets: DataFrame, observations: DataFrame, per_hole: int, most: int, first_radius: float, radius: float | None = None, other_holes: bool = False) -> DataFrame:
    """The capped neighbours of each target (id, x, y) among observations (id, hole, x, y, value) of other ids, within `radius` where one is declared.

    With `other_holes`, targets (id, hole, x, y) take none of their own hole. Each target starts with the finest cell around
    it, of at most the first radius, that holds half its number, and meets the observations of this and the eight cells
    around it. Those with too few within a cell's width try again with cells of twice the width, until it covers the radius
    or all points; nothing farther can displace the neighbours of a target that has its number. A target's candidates meet in
    one task of some `TARGETS` targets, so that pairs are never shuffled. Observations without x, y or value are none, and
    targets without x or y have no neighbours, nor have infinite places.
    """
    placed = " AND ".join(f"{c} IS NOT NULL AND abs(cast({c} AS double)) < double('infinity')" for c in "xy")  # NaN is above infinity
    known = written(_first_of_places(informed(observations).where(placed).select("id", "hole", "x", "y", "value"), per_hole, most))
    goals = targets.where(placed).select("id", "x", "y", *(["hole"] if other_holes else []))
    box = goals.select("x", "y").union(known.select("x", "y")).agg(*(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in "xy")).first()
    last = radius if radius is not None else 2 * max(box["max_x"] - box["min_x"], box["max_y"] - box["min_y"]) + first_radius if box["min_x"] is not None else 0.0
    unit = (first_radius if radius is None else radius) / 2**DEPTH
    width = unit * F.pow(F.lit(2.0), F.col("level"))
    cell = lambda c: F.floor(F.col(c) / width).alias(f"c{c}")
    left = written(_with_levels(goals, known, per_hole, most, unit))
    held = known.groupBy("hole").count().agg(F.least(F.sum(F.least("count", F.lit(per_hole))), F.lit(most)).alias("enough"), F.sum("count").alias("rows")).first()
    enough, rows = held["enough"] or 0, held["rows"] or 0
    around = F.array(*(F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    found = None
    while True:
        asked = {r["level"]: r["count"] for r in left.groupBy("level").count().collect()}  # a few dozen levels at most
        if not asked and found is not None:
            return found
        parts = -(-sum(asked.values()) // TARGETS)
        own = left.select(F.col("id").alias("target"), F.col("x").alias("tx"), F.col("y").alias("ty"), *([F.col("hole").alias("own_hole")] if other_holes else []), "level", width.alias("reach"), cell("x"), cell("y"))
        key, place = ["level", "cx", "cy"], ["level", "px", "py"]
        asking = own.select(*key).distinct().select(*key, F.explode(around).alias("_at")).select(*key, (F.col("cx") + F.col("_at.dx")).alias("px"), (F.col("cy") + F.col("_at.dy")).alias("py"))
        each = known.withColumn("level", F.explode(F.array(*map(F.lit, asked or [0])))).select("*", cell("x").alias("px"), cell("y").alias("py"))
        if parts > 1:  # only what lies around a target goes on, in tasks of bounded numbers of both sides
            most_rows = max(parts, -(-rows * len(asked) // (16 * TARGETS)))
            each = each.repartition(most_rows, *place).join(asking.repartition(most_rows, *place).hint("merge"), place)
        else:
            each = each.join(F.broadcast(asking), place)  # nine cells of each of TARGETS targets at most
        each = each.drop("px", "py")
        d = F.sqrt(F.pow(F.col("tx") - F.col("x"), 2) + F.pow(F.col("ty") - F.col("y"), 2))
        if parts > 1:  # small as the tables are, their pairs are many
            own, each = own.repartition(parts, *key), each.repartition(parts, *key)
        met = own.join(each.hint("merge"), key).where("target <> id" + (" AND hole <> own_hole" if other_holes else "")).withColumn("distance", d)
        met = met.where(F.col("distance") <= (F.col("reach") if radius is None else F.least("reach", F.lit(radius)))).withColumn("distance", F.round("distance", 9))
        one, order = [*key, "target"], ["distance", "id"]
        capped = met.withColumn("nth", F.row_number().over(Window.partitionBy(*one, "hole").orderBy(*order))).where(F.col("nth") <= per_hole)
        capped = capped.withColumn("nth", F.row_number().over(Window.partitionBy(*one).orderBy(*order))).where(F.col("nth") <= most)
        all_of = Window.partitionBy(*one)
        full = (F.count("*").over(all_of) >= enough) & (F.max("distance").over(all_of) < F.col("reach") - 1e-8)  # none that rounds alike lies beyond
        near = written(capped.select("id", "target", "tx", "ty", "x", "y", "distance", "hole", "value", "nth", (full | (F.col("reach") >= last)).alias("settled")))
        settled = near.where("settled").drop("settled")
        found = settled if found is None else found.unionByName(settled)
        done = settled.select(F.col("target").alias("id")).distinct()
        left = written(left.where(width < last).join(done, "id", "left_anti").withColumn("level", F.col("level") + 1))  # else plans double each round


def with_uninformed(targets: DataFrame, estimates: DataFrame, neighbours: DataFrame, min_samples: int) -> DataFrame:
    """Every target (id) with its estimate and status; uninformed, of 0 samples and holes, with fewer than `min_samples` neighbours."""
    met = neighbours.groupBy("target").agg(F.count("*").alias("samples"), F.countDistinct("hole").alias("holes")).where(F.col("samples") >= min_samples)
    own = [c for c in estimates.columns if c not in ("target", "samples", "holes", "status")]
    status = F.col("status") if "status" in estimates.columns else F.lit("estimated").alias("status")
    known = met.join(estimates.select("target", *own, status), "target")
    rows = targets.select(F.col("id").alias("target")).join(known, "target", "left")
    return rows.select("target", F.coalesce("samples", F.lit(0)).alias("samples"), F.coalesce("holes", F.lit(0)).alias("holes"), *own, F.coalesce("status", F.lit("uninformed")).alias("status"))


def inverse_distance(neighbours: DataFrame, power: float = 2.0) -> DataFrame:
    """(target, samples, holes, estimate): weighted means; an exact hit takes the observed mean there."""
    w = F.when(F.col("distance") > 0, 1 / F.pow("distance", F.lit(power)))
    g = neighbours.groupBy("target").agg(F.count("*").alias("samples"), F.countDistinct("hole").alias("holes"), F.avg(F.when(F.col("distance") == 0, F.col("value"))).alias("hit"), (F.sum(w * F.col("value")) / F.sum(w)).alias("blend"))
    return g.select("target", "samples", "holes", F.coalesce("hit", "blend").alias("estimate"))


def declustered_mean(points: DataFrame, cell: float, offsets: int = 4) -> DataFrame:
    """One row: the mean with weights of one over the points of a cell, averaged over diagonal grid offsets."""
    shifted = points.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(offsets - 1))))
    shift = F.col("o") * (cell / offsets)
    keyed = shifted.withColumn("cx", F.floor((F.col("x") + shift) / cell)).withColumn("cy", F.floor((F.col("y") + shift) / cell))
    cells = keyed.groupBy("o", "cx", "cy").agg(F.avg("value").alias("m"))
    return cells.groupBy("o").agg(F.avg("m").alias("m")).agg(F.avg("m").alias("declustered"), F.count("*").alias("offsets"))


def downhole_variogram(samples: DataFrame, lag: float, lags: int) -> DataFrame:
    """(bin, pairs, gamma): half the mean squared difference of pairs in a hole, by distance rounded half to even.

    Samples meet those of their own and the neighbouring stretch of a hole, a stretch being as long as the farthest lag.
    """
    stretch = F.floor(F.col("depth") / (lag * (lags + 1)))
    a = samples.select("hole", "id", "depth", "value", stretch.alias("stretch"))
    b = a.select("hole", *(F.col(c).alias(f"{c}_2") for c in ("id", "depth", "value")), F.explode(F.array(*(F.col("stretch") + i for i in (-1, 0, 1)))).alias("stretch"))
    met = a.join(b, ["hole", "stretch"]).where("id < id_2").withColumn("bin", F.bround(F.abs(F.col("depth") - F.col("depth_2")) / lag).cast("long"))
    return _gammas(met.where((F.col("bin") >= 1) & (F.col("bin") <= lags)), ["bin"])


def _gammas(pairs: DataFrame, keys: list[str]) -> DataFrame:
    return pairs.groupBy(*keys).agg(F.count("*").alias("pairs"), (F.avg(F.pow(F.col("value") - F.col("value_2"), 2)) / 2).alias("gamma"))


#: Azimuths of the four horizontal directions, in degrees from north.
DIRECTIONS = {"azimuth-0": 0.0, "azimuth-45": 45.0, "azimuth-90": 90.0, "azimuth-135": 135.0}


def spatial_variograms(points: DataFrame, lag: float, lags: int, tolerance: float = 22.5, bandwidth: float | None = None) -> DataFrame:
    """(direction, bin, pairs, gamma) of points (id, x, y, value): omnidirectional and by four azimuths.

    A pair is of a direction if the angle between them is within `tolerance` degrees and its offset across the direction
    within `bandwidth`. Pairs at one place have no direction. Pairs meet in grid cells of the farthest lag.
    """
    a = points.select("id", "x", "y", "value")
    met = cell_pairs(a, points, lag * (lags + 0.5)).where("id < id_2").join(points.select(F.col("id").alias("id_2"), F.col("value").alias("value_2")), "id_2")
    met = met.withColumn("bin", F.bround(F.col("distance") / lag).cast("long")).where((F.col("bin") >= 1) & (F.col("bin") <= lags))
    dx, dy = F.col("x_2") - F.col("x"), F.col("y_2") - F.col("y")
    fits = [F.lit("omni")]
    for name, azimuth in DIRECTIONS.items():
        east, north = float(np.sin(np.radians(azimuth))), float(np.cos(np.radians(azimuth)))
        along, across = F.abs(dx * east + dy * north), F.abs(dx * north - dy * east)
        near = F.col("distance") > 0
        near &= along >= F.col("distance") * float(np.cos(np.radians(tolerance)))
        fits.append(F.when(near if bandwidth is None else near & (across <= bandwidth), F.lit(name)))
    held = F.explode(F.filter(F.array(*fits), lambda d: d.isNotNull())).alias("direction")
    return _gammas(met.select("bin", "value", "value_2", held), ["direction", "bin"])


def neighbour_summary(neighbours: DataFrame, least_holes: int) -> DataFrame:
    """(target, samples, holes, scale): median neighbour distance of targets whose neighbours come from enough holes."""
    met = neighbours.groupBy("target").agg(F.count("*").alias("samples"), F.countDistinct("hole").alias("holes"), F.percentile("distance", 0.5).alias("scale"))
    return met.where(F.col("holes") >= least_holes)


def other_hole_pairs(points: DataFrame, radius: float) -> DataFrame:
    """(target, hole, id, distance, value): observations within `radius` of each point that are of other holes."""
    met = cell_pairs(points.select("id", "x", "y", F.col("hole").alias("own_hole")), points, radius)
    rows = met.join(points.select(F.col("id").alias("id_2"), "hole", "value"), "id_2").where("id <> id_2 AND hole <> own_hole")
    return rows.select(F.col("id").alias("target"), "hole", F.col("id_2").alias("id"), F.round("distance", 9).alias("distance"), "value")


def _spherical(h: np.ndarray, sill: float, reach: float, nugget: float) -> np.ndarray:
    r = np.minimum(h / reach, 1)
    return np.where(h == 0, sill + nugget, sill * (1 - 1.5 * r + 0.5 * r**3))


#: Columns of the drift at a point, relative to the target: none, the mean, the mean and a plane.
DRIFT = {"simple": 0, "ordinary": 1, "universal": 3}


def _solved(xy: np.ndarray, goal: np.ndarray, value: np.ndarray, kind: str, sill: float, reach: float, nugget: float, mean: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(estimate, variance, failed) of systems of one size: xy (g, n, 2), goal (g, 2), value (g, n)."""
    g, n = value.shape
    k = DRIFT[kind]
    system, right = np.zeros((g, n + k, n + k)), np.zeros((g, n + k))
    system[:, :n, :n] = _spherical(np.linalg.norm(xy[:, :, None] - xy[:, None], axis=3), sill, reach, nugget)
    right[:, :n] = _spherical(np.linalg.norm(xy - goal[:, None], axis=2), sill, reach, nugget)
    drift = np.concatenate([np.ones((g, n, 1)), (xy - goal[:, None]) / reach], axis=2)[:, :, :k]
    system[:, :n, n:], system[:, n:, :n] = drift, drift.transpose(0, 2, 1)
    right[:, n : n + min(k, 1)] = 1
    failed = (np.linalg.cond(system) > 1e12) | (n < k)
    system[failed] = np.eye(n + k)
    weight = np.linalg.solve(system, right[..., None])[..., 0]
    shift = mean if kind == "simple" else 0.0
    return shift + (weight[:, :n] * (value - shift)).sum(1), sill + nugget - (weight * right).sum(1), failed


def kriging(neighbours: DataFrame, sill: float, reach: float, nugget: float, kind: str = "ordinary", mean: float = 0.0) -> DataFrame:
    """(target, estimate, variance, status) from neighbours (target, tx, ty, id, x, y, value), a capped few a target.

    A target's neighbours become one row of arrays, and systems of one size are solved together. Singular systems are
    reported as failed, never replaced by another method. Neighbours without a place or value weigh nothing.
    """
    rows = informed(neighbours).groupBy("target").agg(F.first("tx").alias("tx"), F.first("ty").alias("ty"), F.array_sort(F.collect_list(F.struct("id", "x", "y", "value"))).alias("near"))

    def solve(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            near = batch.column("near")
            size = near.value_lengths().to_numpy()
            start = near.offsets.to_numpy()[:-1]
            flat = near.values
            x, y, value = (flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y", "value"))
            goal = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("tx", "ty")], 1)
            estimate, variance, failed = np.zeros(len(size)), np.zeros(len(size)), np.zeros(len(size), bool)
            for n in np.unique(size).tolist():
                group = np.flatnonzero(size == n)
                at = start[group][:, None] + np.arange(n)
                estimate[group], variance[group], failed[group] = _solved(np.stack([x[at], y[at]], 2), goal[group], value[at], kind, sill, reach, nugget, mean)
            status = np.where(failed, "failed", "estimated")
            yield pa.RecordBatch.from_arrays([batch.column("target").cast(pa.int64()), pa.array(estimate, mask=failed), pa.array(variance, mask=failed), pa.array(status)], names=["target", "estimate", "variance", "status"])

    return rows.mapInArrow(solve, "target long, estimate double, variance double, status string")


def ordinary_kriging(neighbours: DataFrame, sill: float, reach: float, nugget: float) -> DataFrame:
    """Kriging with an unknown constant mean."""
    return kriging(neighbours, sill, reach, nugget)


def labelled_cells(cells: DataFrame) -> DataFrame:
    """(realization, category, node, label) of cells (realization, category, i, j, k): the least cell of the 6-connected component of each cell.

    Neighbours meet by equi-joins along each axis. Every round takes the least label around a cell and the label of that
    label, until none changes; no grid is gathered in one task.
    """
    keys = ["realization", "category"]
    nodes = written(cells.select(*keys, F.struct("i", "j", "k").alias("node")).distinct())
    steps = [nodes.select(*keys, F.col("node").alias("a"), F.struct(*((F.col(f"node.{c}") + (1 if c == axis else 0)).cast(nodes.schema["node"].dataType[c].dataType).alias(c) for c in "ijk")).alias("node")) for axis in "ijk"]
    ahead = reduce(DataFrame.union, (s.join(nodes, [*keys, "node"]).select(*keys, "a", F.col("node").alias("b")) for s in steps))
    edges = written(ahead.union(ahead.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = nodes.withColumn("label", F.col("node"))
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = written(labels.join(near, [*keys, "node"], "left").select(*keys, "node", F.least("label", "near").alias("label"), F.col("label").alias("was")))
        far = lower.select(*keys, F.col("node").alias("label"), F.col("label").alias("far"))
        moved = written(lower.join(far, [*keys, "label"], "left").select(*keys, "node", F.least("label", "far").alias("label"), "was"))
        labels = moved.drop("was")
        if moved.where("label <> was").isEmpty():
            return labels


def grid_components(cells: DataFrame) -> DataFrame:
    """(realization, category, cluster, cells): sizes of the 6-connected components of each category grid, the largest first."""
    sizes = labelled_cells(cells).groupBy("realization", "category", "label").agg(F.count("*").alias("cells"))
    w = Window.partitionBy("realization", "category").orderBy(F.desc("cells"), "label")
    return sizes.select("realization", "category", (F.row_number().over(w) - 1).cast("long").alias("cluster"), "cells")


def hole_connections(labels: DataFrame, hole_cells: DataFrame) -> DataFrame:
    """(category, hole, hole_2, share): of all realizations, those in which cells (hole, node) of two holes meet in one component of labelled cells."""
    realizations = labels.select("realization").distinct().count()
    own = labels.join(hole_cells, "node").select("realization", "category", "label", "hole").distinct()
    other = own.withColumnRenamed("hole", "hole_2")
    met = own.join(other, ["realization", "category", "label"]).where("hole < hole_2").select("realization", "category", "hole", "hole_2").distinct()
    return met.groupBy("category", "hole", "hole_2").agg((F.count("*") / F.lit(max(1, realizations))).alias("share"))
