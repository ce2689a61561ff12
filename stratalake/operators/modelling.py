"""Variogram fits, indicator and repeated kriging, resampling, surfaces and graphs over points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from stratalake.operators.spatial import informed, kriging, neighbourhoods
from stratalake.operators.surfaces import weighted_heights
from stratalake.storage import written

#: Share of the sill reached at a distance, as a share of the range.
FAMILIES = {
    "spherical": lambda r: np.where(r < 1, 1.5 * r - 0.5 * r**3, 1.0),
    "exponential": lambda r: 1 - np.exp(-3 * r),
    "gaussian": lambda r: 1 - np.exp(-3 * r * r),
}


def _sills(shape: np.ndarray, gamma: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """(loss, nugget, sill): the weighted least squares fit of both, neither below 0."""
    best = None
    for columns in (np.stack([np.ones_like(shape), shape], 1), np.stack([np.zeros_like(shape), shape], 1), np.stack([np.ones_like(shape), 0 * shape], 1)):
        root = np.sqrt(weight)
        found = np.linalg.lstsq(columns * root[:, None], gamma * root, rcond=None)[0]
        if (found >= -1e-12).all():
            found = np.maximum(found, 0)
            loss = float((weight * (columns @ found - gamma) ** 2).sum())
            if best is None or loss < best[0] - 1e-15:
                best = (loss, float(found[0]), float(found[1]))
    return best


def fit_variograms(gammas: DataFrame, keys: list[str], families: tuple[str, ...] = ("spherical", "exponential", "gaussian"), widest: float = 5.0) -> DataFrame:
    """(keys, family, nugget, sill, reach, loss): the model of least squared error, weighted by pairs, of each key's variogram.

    `gammas` holds (keys, distance, pairs, gamma), a few bins a key. Ranges are searched from the least distance to
    `widest` times the largest, then between the neighbours of the best. Bins without pairs or values take no part; a
    key needs three, else it has no model.
    """

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        h, gamma, weight = (rows[c].to_numpy(float) for c in ("distance", "gamma", "pairs"))
        reaches = np.geomspace(h.min(), widest * h.max(), 60)
        best = None
        for family in families:
            grid = reaches
            for _ in range(4):
                losses = [_sills(FAMILIES[family](h / reach), gamma, weight) + (float(reach),) for reach in grid]
                at = min(range(len(grid)), key=lambda i: losses[i][0])
                if best is None or losses[at][0] < best[1][0]:
                    best = (family, losses[at])
                grid = np.linspace(grid[max(0, at - 1)], grid[min(len(grid) - 1, at + 1)], 21)
        family, (loss, nugget, sill, reach) = best
        return pd.DataFrame([[*(rows[k].iloc[0] for k in keys), family, nugget, sill, reach, loss]], columns=[*keys, *FIT])

    known = gammas.where("pairs > 0 AND gamma IS NOT NULL AND distance > 0")
    enough = known.withColumn("bins", F.count("*").over(Window.partitionBy(*keys))).where("bins >= 3").drop("bins")
    schema = ", ".join([*(f"{k} {gammas.schema[k].dataType.simpleString()}" for k in keys), "family string, nugget double, sill double, reach double, loss double"])
    return enough.groupBy(*keys).applyInPandas(fit, schema)


FIT = ["family", "nugget", "sill", "reach", "loss"]


def coregionalization(gammas: DataFrame, structures: list[tuple[str, float]], rounds: int = 200) -> DataFrame:
    """(structure, a, b, sill) of a linear model of (a, b, distance, pairs, gamma), a <= b, with every sill matrix positive semidefinite.

    Structure 0 is the nugget, the others are (family, range). Each round fits one structure's matrix to what the others
    leave and clips its negative eigenvalues. The input has a row a pair of variables and bin, and the driver fits it.
    """
    rows = gammas.where("pairs > 0 AND gamma IS NOT NULL").toPandas()  # variables squared times bins
    names = sorted(set(rows["a"]) | set(rows["b"]))
    lags = sorted(set(rows["distance"]))
    p, index, lag = len(names), {v: i for i, v in enumerate(names)}, {h: i for i, h in enumerate(lags)}
    target, weight = np.zeros((len(lags), p, p)), np.zeros((len(lags), p, p))
    for a, b, h, n, g in rows[["a", "b", "distance", "pairs", "gamma"]].itertuples(index=False):
        for i, j in ((index[a], index[b]), (index[b], index[a])):
            target[lag[h], i, j], weight[lag[h], i, j] = g, n
    h = np.array(lags, float)
    shapes = [np.ones_like(h), *(FAMILIES[f](h / reach) for f, reach in structures)]
    sills = [np.zeros((p, p)) for _ in shapes]
    for _ in range(rounds):
        for s, shape in enumerate(shapes):
            rest = target - sum((shapes[o][:, None, None] * sills[o] for o in range(len(shapes)) if o != s), np.zeros_like(target))
            under = (weight * shape[:, None, None] ** 2).sum(0)
            raw = np.divide((weight * shape[:, None, None] * rest).sum(0), under, out=np.zeros((p, p)), where=under > 0)
            values, vectors = np.linalg.eigh((raw + raw.T) / 2)
            sills[s] = (vectors * np.maximum(values, 0)) @ vectors.T
    found = [(s, names[i], names[j], float(m[i, j])) for s, m in enumerate(sills) for i in range(p) for j in range(i, p)]
    kind = gammas.schema["a"].dataType.simpleString()
    return gammas.sparkSession.createDataFrame(found, f"structure int, a {kind}, b {kind}, sill double")


def indicator_kriging(neighbours: DataFrame, models: dict[float, tuple[float, float, float]]) -> DataFrame:
    """(target, probabilities, status): for thresholds in rising order, the chance that a target's value is at most each.

    The indicator of each threshold is kriged by its own (sill, range, nugget). Chances are cut to [0, 1] and put in
    order as the mean of the running largest from below and the running least from above. A target with a failed system
    at any threshold is failed, without chances.
    """
    each = None
    for i, (threshold, model) in enumerate(sorted(models.items())):  # a declared few
        below = neighbours.withColumn("value", (F.col("value") <= threshold).cast("double"))
        one = kriging(below, *model).select("target", F.struct(F.lit(i).alias("i"), F.when(F.col("status") == "estimated", F.least(F.greatest("estimate", F.lit(0.0)), F.lit(1.0))).alias("p")).alias("step"))
        each = one if each is None else each.unionByName(one)
    met = each.groupBy("target").agg(F.transform(F.array_sort(F.collect_list("step")), lambda x: x.p).alias("p"))
    whole = ~F.exists("p", lambda x: x.isNull())
    at = F.sequence(F.lit(1), F.size("p"))
    up = F.transform(at, lambda i: F.array_max(F.slice("p", F.lit(1), i)))
    down = F.transform(at, lambda i: F.array_min(F.slice("p", i, F.size("p"))))
    return met.select("target", F.when(whole, F.zip_with(up, down, lambda a, b: (a + b) / 2)).alias("probabilities"), F.when(whole, "estimated").otherwise("failed").alias("status"))


def universal_with_retry(targets: DataFrame, observations: DataFrame, per_hole: int, most: int, first_radius: float, sill: float, reach: float, nugget: float) -> DataFrame:
    """(target, estimate, variance, status, retried): targets whose drift is singular try once more with neighbourhoods of twice the size; those without neighbours are uninformed."""
    near = neighbourhoods(targets, observations, per_hole, most, first_radius)
    first = written(kriging(near, sill, reach, nugget, "universal").withColumn("retried", F.lit(False)))  # else solved again for each use
    open_targets = targets.join(first.where("status = 'failed'").select(F.col("target").alias("id")), "id", "left_semi")
    wider = neighbourhoods(open_targets, observations, 2 * per_hole, 2 * most, first_radius)
    second = kriging(wider, sill, reach, nugget, "universal").withColumn("retried", F.lit(True))
    met = first.where("status = 'estimated'").unionByName(second)
    rows = targets.select(F.col("id").alias("target")).join(met, "target", "left")
    return rows.select("target", "estimate", "variance", F.coalesce("status", F.lit("uninformed")).alias("status"), F.coalesce("retried", F.lit(False)).alias("retried"))


def neighbour_diagnostics(neighbours: DataFrame) -> DataFrame:
    """(target, samples, holes, from_one_hole): neighbours, their holes, and the most that one hole gives."""
    by_hole = neighbours.groupBy("target", "hole").agg(F.count("*").alias("n"))
    return by_hole.groupBy("target").agg(F.sum("n").alias("samples"), F.count("*").alias("holes"), F.max("n").alias("from_one_hole"))


def graph_edges(neighbours: DataFrame) -> DataFrame:
    """(a, b, weight): the symmetric graph of (target, id) with loops, each edge over the root of both ends' degrees."""
    one = neighbours.select(F.col("target").alias("a"), F.col("id").alias("b"))
    both = one.union(one.select("b", "a"))
    loops = both.select("a", F.col("a").alias("b"))
    edges = both.union(loops).distinct()
    degree = edges.groupBy("a").agg(F.count("*").alias("n"))
    met = edges.join(degree, "a").join(degree.select(F.col("a").alias("b"), F.col("n").alias("m")), "b")
    return met.select("a", "b", (1 / F.sqrt(F.col("n") * F.col("m"))).alias("weight"))


#: Pairs of cells and collars that are all computed one by one.
PAIRS = 10**9


def collar_surface(cells: DataFrame, collars: DataFrame, power: float = 2.0, block: int = 2048) -> DataFrame:
    """(id, z): height at cells (id, x, y) from all collars (x, y, z), inverse to the distance; at a collar, its own (the mean of several).

    Every collar weighs on every cell. Both are dealt to blocks of about `block` rows by hash; each block of cells meets
    each block of collars in a row of its own, which adds up z and 1 over the powers of the distances, and the sums meet by
    cell. So neither the cells nor the collars are ever in one task. Collars without x, y or z take no part; a cell without
    x or y, or without any collar, has no height. Cells of one id and place are one. Where their pairs pass `PAIRS`, far
    collars weigh through interpolated fields (`weighted_heights`), equal to rounding, as all pairs would never end.
    """
    kind = cells.schema["id"].dataType.simpleString()
    known = collars.select(*(F.col(c).cast("double").alias(c) for c in "xyz")).where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in "xyz"))
    points = cells.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).distinct()
    placed = points.where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    collars_held, cells_held = known.count(), placed.count()
    blocks = -(-collars_held // block)
    if not blocks:
        return points.select("id", F.lit(None).cast("double").alias("z"))
    finite = "abs(x) < double('infinity') AND abs(y) < double('infinity')"
    if collars_held * cells_held > PAIRS:
        return points.join(weighted_heights(placed.where(finite), known.where(finite), power, block), "id", "left").select("id", "z")
    held = known.groupBy(F.pmod(F.xxhash64("x", "y", "z", F.monotonically_increasing_id()), F.lit(blocks)).alias("block")).agg(F.array_sort(F.collect_list(F.struct("x", "y", "z"))).alias("collars"))
    asked = placed.groupBy(F.pmod(F.xxhash64("id", "x", "y"), F.lit(max(1, -(-cells_held // block)))).alias("part")).agg(F.collect_list(F.struct("id", "x", "y")).alias("cells"))
    met = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(held, "block").select("cells", "collars")

    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for k in range(batch.num_rows):
                cell, collar = batch.column("cells")[k].values, batch.column("collars")[k].values
                at, by = ([g.field(c).to_numpy(zero_copy_only=False) for c in "xy"] for g in (cell, collar))
                z = collar.field("z").to_numpy(zero_copy_only=False)
                d = np.hypot(at[0][:, None] - by[0], at[1][:, None] - by[1])
                hit = d == 0
                w = np.where(hit, 0.0, np.where(hit, 1.0, d) ** -power)
                columns = [(w @ z), w.sum(1), hit @ z, hit.sum(1).astype(float)]
                yield pa.RecordBatch.from_arrays([cell.field("id"), *map(pa.array, columns)], names=["id", "wz", "w", "hz", "h"])

    each = met.mapInArrow(sums, f"id {kind}, wz double, w double, hz double, h double").groupBy("id").agg(*(F.sum(c).alias(c) for c in ("wz", "w", "hz", "h")))
    heights = each.select("id", F.when(F.col("h") > 0, F.col("hz") / F.col("h")).otherwise(F.col("wz") / F.col("w")).alias("z"))
    return points.join(heights, "id", "left").select("id", "z")


def bootstrap_difference(rows: DataFrame, replicates: int = 1000, seed: int = 0, block: int = 4096) -> DataFrame:
    """(replicate, difference): mean of |error_a| - |error_b| over whole holes drawn with replacement, of rows (hole, error_a, error_b).

    Sums by hole are dealt to blocks by hash. Each replicate first deals its draws to the blocks, by one seed that all
    tasks share, then to the holes of a block: together a draw of all holes, although no task sees more than a block.
    """
    gap = F.abs("error_a") - F.abs("error_b")
    held = rows.where("hole IS NOT NULL AND error_a IS NOT NULL AND error_b IS NOT NULL").groupBy("hole").agg(F.sum(gap).alias("s"), F.count("*").alias("n"))
    holes = held.count()
    if not holes:
        return held.sparkSession.createDataFrame([], "replicate int, difference double")
    dealt = held.withColumn("block", F.pmod(F.xxhash64("hole"), F.lit(-(-holes // block))))
    sizes = {r["block"]: r["count"] for r in dealt.groupBy("block").count().collect()}  # a row for each `block` holes
    order = sorted(sizes)
    shares = np.array([sizes[b] for b in order]) / holes

    def draw(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("hole")
        at, even = order.index(part["block"].iloc[0]), np.full(len(part), 1 / len(part))
        both = part[["s", "n"]].to_numpy(float)
        out = []
        for r in range(replicates):
            drawn = np.random.default_rng([seed, r]).multinomial(holes, shares)[at]
            out.append((r, *(np.random.default_rng([seed, r, at]).multinomial(drawn, even) @ both)))
        return pd.DataFrame(out, columns=["replicate", "s", "n"])

    sums = dealt.groupBy("block").applyInPandas(draw, "replicate int, s double, n double")
    return sums.groupBy("replicate").agg((F.sum("s") / F.sum("n")).alias("difference"))


def cokriging(neighbours: DataFrame, structures: list[tuple[str, float, list[list[float]]]], nugget: list[list[float]]) -> DataFrame:
    """(target, estimate, variance, primary, status) of variable 0 from neighbours (target, tx, ty, id, x, y, value, variable), a capped few a target.

    `structures` hold (family, range, sills by variables). Weights of variable 0 sum to 1, those of each other variable to
    0. Targets of one pattern of variables are solved together; one without variable 0 or with a singular system failed.
    """
    steps, noise = [(f, reach, np.array(b, float)) for f, reach, b in structures], np.array(nugget, float)
    rows = informed(neighbours).groupBy("target").agg(F.first("tx").alias("tx"), F.first("ty").alias("ty"), F.array_sort(F.collect_list(F.struct("variable", "id", "x", "y", "value"))).alias("near"))

    def covariance(d: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return sum((m[a, b] * (1 - FAMILIES[f](d / reach)) for f, reach, m in steps), noise[a, b] * (d == 0))

    def solved(xy: np.ndarray, goal: np.ndarray, value: np.ndarray, variable: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        g, n = value.shape
        kinds = np.unique(variable)
        k, zero = len(kinds), np.zeros_like(variable)
        system, right = np.zeros((g, n + k, n + k)), np.zeros((g, n + k))
        system[:, :n, :n] = covariance(np.linalg.norm(xy[:, :, None] - xy[:, None], axis=3), variable[:, None], variable[None])
        system[:, :n, n:] = variable[:, None] == kinds
        system[:, n:, :n] = (variable[:, None] == kinds).T
        right[:, :n] = covariance(np.linalg.norm(xy - goal[:, None], axis=2), variable, zero)
        right[:, n:] = kinds == 0
        failed = (np.linalg.cond(system) > 1e12) | (0 not in kinds)
        system[failed] = np.eye(n + k)
        weight = np.linalg.solve(system, right[..., None])[..., 0]
        top = sum(m[0, 0] for _, _, m in steps) + noise[0, 0]
        return (weight[:, :n] * value).sum(1), top - (weight * right).sum(1), failed

    def solve(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            near, goal = batch.column("near").to_pylist(), np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("tx", "ty")], 1)
            patterns: dict[tuple, list[int]] = {}
            for i, rows in enumerate(near):
                patterns.setdefault(tuple(r["variable"] for r in rows), []).append(i)
            estimate, variance, failed = np.zeros(len(near)), np.zeros(len(near)), np.zeros(len(near), bool)
            for pattern, group in patterns.items():
                xy = np.array([[(r["x"], r["y"]) for r in near[i]] for i in group], float)
                value = np.array([[r["value"] for r in near[i]] for i in group], float)
                estimate[group], variance[group], failed[group] = solved(xy, goal[group], value, np.array(pattern))
            primary = [sum(r["variable"] == 0 for r in rows) for rows in near]
            columns = [batch.column("target").cast(pa.int64()), pa.array(estimate, mask=failed), pa.array(variance, mask=failed), pa.array(primary, pa.int32()), pa.array(np.where(failed, "failed", "estimated"))]
            yield pa.RecordBatch.from_arrays(columns, names=["target", "estimate", "variance", "primary", "status"])

    return rows.mapInArrow(solve, "target long, estimate double, variance double, primary int, status string")


def variants(targets: DataFrame, observations: DataFrame, plans: dict[str, dict], first_radius: float, model: tuple[float, float, float]) -> DataFrame:
    """(variant, target, samples, estimate, variance, status) of each plan: per_hole, most, and `every`, which keeps observations whose id it divides."""
    found = None
    for name, plan in plans.items():  # a declared few
        kept = observations.where(F.pmod(F.col("id"), F.lit(plan.get("every", 1))) == 0)
        near = neighbourhoods(targets, kept, plan["per_hole"], plan["most"], first_radius)
        held = near.groupBy("target").agg(F.count("*").alias("samples"))
        one = kriging(near, *model).join(held, "target").select(F.lit(name).alias("variant"), "target", "samples", "estimate", "variance", "status")
        found = one if found is None else found.unionByName(one)
    return found
