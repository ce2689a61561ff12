"""Nested variogram models with frames: bounded fits of declared candidates, kriging by several models, choice by validation, line supports."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stratalake.operators.modelling import FAMILIES
from stratalake.operators.spatial import DIRECTIONS, informed


@dataclass(frozen=True)
class Nested:
    """A nugget and structures (family, sill, range along the azimuth, range across); heights count as along."""

    nugget: float
    azimuth: float
    steps: tuple[tuple[str, float, float, float], ...]

    @property
    def sill(self) -> float:
        return sum(s for _, s, _, _ in self.steps)

    def covariance(self, delta: np.ndarray) -> np.ndarray:
        """Of the structures, without the nugget, at offsets (..., 2 or 3) east, north, up."""
        a = np.radians(self.azimuth)
        along, across = delta[..., 0] * np.sin(a) + delta[..., 1] * np.cos(a), delta[..., 0] * np.cos(a) - delta[..., 1] * np.sin(a)
        up = delta[..., 2] if delta.shape[-1] == 3 else 0.0
        return sum(sill * (1 - FAMILIES[f](np.sqrt((along**2 + up**2) / major**2 + across**2 / minor**2))) for f, sill, major, minor in self.steps)


@dataclass(frozen=True)
class Candidate:
    """What is tried: families of the structures, and the azimuth of their frame, None for one range in all directions."""

    families: tuple[str, ...]
    azimuth: float | None = None

    @property
    def name(self) -> str:
        return "+".join(self.families) + (" isotropic" if self.azimuth is None else f" at {self.azimuth:g}")


#: Declared candidates: one and two structures without a frame, and both in four frames.
FRAMES = (0.0, 45.0, 90.0, 135.0)
SETS = (("spherical",), ("exponential",), ("spherical", "spherical"))
CANDIDATES = [*(Candidate(s) for s in SETS), *(Candidate(s, f) for f in FRAMES for s in SETS)]
#: Ranges reach from half the least distance to so many times the largest; a validation must estimate so much of its rows.
WIDEST, LEAST_COVERAGE = 5.0, 0.5


def nonnegative(columns: np.ndarray, goal: np.ndarray) -> tuple[np.ndarray, float]:
    """Least squares with no coefficient below 0, over all choices of columns (a few), and its loss."""
    best, loss = np.zeros(columns.shape[1]), float(goal @ goal)
    for size in range(1, columns.shape[1] + 1):
        for chosen in itertools.combinations(range(columns.shape[1]), size):
            part = columns[:, chosen]
            found = np.linalg.lstsq(part, goal, rcond=None)[0]
            if (found >= 0).all() and (rest := float(((part @ found - goal) ** 2).sum())) < loss - 1e-14:
                best, loss = np.zeros(columns.shape[1]), rest
                best[list(chosen)] = found
    return best, loss


def bounded_fit(residual: Callable[[np.ndarray], np.ndarray], start: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 80) -> tuple[np.ndarray, float, bool]:
    """(place, loss, converged) of a damped Gauss-Newton search between bounds, slopes by differences."""
    at = np.clip(start, low, high)
    r = residual(at)
    loss, damping = float(r @ r), 1e-2
    for _ in range(rounds):
        steps = np.where(at + 1e-5 <= high, 1e-5, -1e-5)
        slope = np.stack([(residual(at + np.eye(len(at))[k] * steps[k]) - r) / steps[k] for k in range(len(at))], 1)
        gradient, curve = slope.T @ r, slope.T @ slope
        for _ in range(12):
            moved = np.clip(at - np.linalg.lstsq(curve + damping * np.diag(np.diag(curve) + 1e-12), gradient, rcond=None)[0], low, high)
            there = residual(moved)
            if (lower := float(there @ there)) < loss:
                break
            damping *= 4
        else:
            return at, loss, True
        done = loss - lower <= 1e-12 * max(loss, 1e-300) or np.abs(moved - at).max() < 1e-9
        at, r, loss, damping = moved, there, lower, damping / 3
        if done:
            return at, loss, True
    return at, loss, False


def fit_candidate(candidate: Candidate, azimuth: np.ndarray, h: np.ndarray, gamma: np.ndarray, pairs: np.ndarray) -> dict:
    """The nested model of least error, weighted by pairs. azimuth: of each bin, unused without a frame.

    Sills follow from the ranges by least squares that stay nonnegative, so only logarithms of ranges are searched, from
    several starts.
    """
    root, framed = np.sqrt(pairs / pairs.sum()), candidate.azimuth is not None
    turn = np.radians(azimuth - candidate.azimuth) if framed else np.zeros_like(h)
    n = len(candidate.families)
    low, high = np.log(h.min() / 2), np.log(WIDEST * h.max())

    def shapes(logs: np.ndarray) -> np.ndarray:
        reach = np.exp(logs.reshape(n, -1))
        columns = [np.ones_like(h)]
        for f, r in zip(candidate.families, reach):
            columns.append(FAMILIES[f](h * np.sqrt((np.cos(turn) / r[0]) ** 2 + (np.sin(turn) / r[-1]) ** 2)))
        return np.stack(columns, 1) * root[:, None]

    def residual(logs: np.ndarray) -> np.ndarray:
        columns = shapes(logs)
        return columns @ nonnegative(columns, gamma * root)[0] - gamma * root

    size = 2 if framed else 1
    best = None
    for shares in itertools.combinations((0.08, 0.25, 0.6, 1.2, 2.5), n):
        start = np.log(np.repeat(np.array(shares) * h.max(), size) * np.tile([1.0, 0.8][:size], n))
        found = bounded_fit(residual, start, np.full(n * size, low), np.full(n * size, high))
        if best is None or found[1] < best[1]:
            best = found
    logs, loss, converged = best
    sills = nonnegative(shapes(logs), gamma * root)[0]
    reach = np.exp(logs.reshape(n, size))
    order = np.argsort(reach[:, 0], kind="stable")
    steps = [{"family": candidate.families[i], "sill": float(sills[1 + i]), "major": float(reach[i, 0]), "minor": float(reach[i, -1]), "at_bound": bool((logs.reshape(n, size)[i] >= high - 0.01).any())} for i in order]
    return {"nugget": float(sills[0]), "steps": steps, "objective": loss, "converged": converged}


STEPS = "array<struct<family:string,sill:double,major:double,minor:double,at_bound:boolean>>"
FITS = f"candidate string, kind string, azimuth double, nugget double, steps {STEPS}, objective double, converged boolean, status string, reason string"


def fit_candidates(gammas: DataFrame, keys: list[str], candidates: list[Candidate] = CANDIDATES) -> DataFrame:
    """A row for each key and candidate: its fitted model or why there is none. gammas: (keys, direction, distance, pairs, gamma), a few bins a direction.

    Candidates without a frame are fitted on direction `omni`, the others on the four azimuths together. Each fit is a
    group of its own. Fewer bins with pairs than parameters plus one: failed.
    """
    plan = F.explode(F.array(*(F.lit(i) for i in range(len(candidates))))).alias("number")
    rows = gammas.where("pairs > 0 AND gamma IS NOT NULL AND NOT isnan(gamma) AND distance > 0").select(*keys, plan, "direction", "distance", "pairs", "gamma")
    names = [*keys, *(c.split()[0] for c in FITS.split(", "))]
    schema = ", ".join([*(f"`{k}` {gammas.schema[k].dataType.simpleString()}" for k in keys), FITS])

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        candidate = candidates[int(part["number"].iloc[0])]
        framed = candidate.azimuth is not None
        used = part[part["direction"].isin(list(DIRECTIONS))] if framed else part[part["direction"] == "omni"]
        head = [part[k].iloc[0] for k in keys] + [candidate.name, "anisotropic" if framed else "isotropic", candidate.azimuth]
        if len(used) < 2 + len(candidate.families) * (3 if framed else 2):
            return pd.DataFrame([[*head, None, None, None, None, "failed", f"{len(used)} bins"]], columns=names)
        used = used.sort_values(["direction", "distance"])
        azimuth = np.array([DIRECTIONS.get(d, 0.0) for d in used["direction"]])
        found = fit_candidate(candidate, azimuth, *(used[c].to_numpy(float) for c in ("distance", "gamma", "pairs")))
        return pd.DataFrame([[*head, found["nugget"], found["steps"], found["objective"], found["converged"], "fitted", None]], columns=names)

    return rows.groupBy(*keys, "number").applyInPandas(fit, schema)


def fitted_models(fits: DataFrame) -> dict[str, Nested]:
    """Models by candidate of one key's fits, a row for each declared candidate."""
    rows = fits.where("status = 'fitted'").select("candidate", "azimuth", "nugget", "steps").collect()
    return {r["candidate"]: Nested(r["nugget"], r["azimuth"] or 0.0, tuple((s["family"], s["sill"], s["major"], s["minor"]) for s in r["steps"])) for r in rows}


#: Places and weights of four Gauss-Legendre nodes on [0, 1].
NODES, WEIGHTS = (np.polynomial.legendre.leggauss(4)[0] + 1) / 2, np.polynomial.legendre.leggauss(4)[1] / 2


def between(model: Nested, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mean covariance of supports a (..., q, d) and b (..., q, d), q nodes each: 1 for points, 4 for lines."""
    wa, wb = (WEIGHTS if x.shape[-2] == 4 else np.ones(1) for x in (a, b))
    return np.einsum("...ij,i,j->...", model.covariance(a[..., :, None, :] - b[..., None, :, :]), wa, wb)


def solve_supports(model: Nested, nodes: np.ndarray, goal: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(estimate, variance, failed) of ordinary kriging: nodes (g, n, q, d), goal (g, q, d), value (g, n).

    Structures are integrated over both supports. The nugget holds between a support and itself: on the diagonal, for the
    target, and for an observation whose support is the target's.
    """
    g, n = value.shape
    system, right = np.zeros((g, n + 1, n + 1)), np.ones((g, n + 1))
    system[:, :n, :n] = between(model, nodes[:, :, None], nodes[:, None])
    same = (nodes[:, :, None] == nodes[:, None]).all((-1, -2))
    system[:, :n, :n] += model.nugget * same
    system[:, :n, n] = system[:, n, :n] = 1
    right[:, :n] = between(model, nodes, goal[:, None]) + model.nugget * (nodes == goal[:, None]).all((-1, -2))
    failed = np.linalg.cond(system) > 1e12
    system[failed] = np.eye(n + 1)
    weight = np.linalg.solve(system, right[..., None])[..., 0]
    own = between(model, goal, goal) + model.nugget
    return (weight[:, :n] * value).sum(1), own - (weight * right).sum(1), failed


def _nodes(ends: np.ndarray) -> np.ndarray:
    """Nodes (..., 4, d) of lines (..., 2, d)."""
    return ends[..., :1, :] + NODES[:, None] * (ends[..., 1:, :] - ends[..., :1, :])


def _krige(rows: DataFrame, models: dict[str, Nested], place: Callable[[list[np.ndarray]], np.ndarray], fields: list[str], goals: list[str]) -> DataFrame:
    """Rows (target, goals, near: array of (id, fields, value)) solved by every model; systems of one size together."""

    def solve(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            near = batch.column("near")
            size, start, flat = near.value_lengths().to_numpy(), near.offsets.to_numpy()[:-1], near.values
            parts = place([flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in fields])
            value = flat.field("value").to_numpy(zero_copy_only=False).astype(float)
            goal = place([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in goals])
            for name, model in models.items():
                estimate, variance, failed = np.zeros(len(size)), np.zeros(len(size)), np.zeros(len(size), bool)
                for n in np.unique(size).tolist():
                    group = np.flatnonzero(size == n)
                    at = start[group][:, None] + np.arange(n)
                    estimate[group], variance[group], failed[group] = solve_supports(model, parts[at], goal[group], value[at])
                columns = [pa.array([name] * len(size)), batch.column("target").cast(pa.int64()), pa.array(size.astype(np.int64)), pa.array(estimate, mask=failed), pa.array(variance, mask=failed), pa.array(np.where(failed, "failed", "estimated"))]
                yield pa.RecordBatch.from_arrays(columns, names=["model", "target", "samples", "estimate", "variance", "status"])

    return rows.mapInArrow(solve, "model string, target long, samples long, estimate double, variance double, status string")


def point_kriging(neighbours: DataFrame, models: dict[str, Nested]) -> DataFrame:
    """(model, target, samples, estimate, variance, status) of ordinary kriging by each model, from neighbours (target, tx, ty, id, x, y, value)."""
    rows = informed(neighbours).groupBy("target").agg(F.first("tx").alias("tx"), F.first("ty").alias("ty"), F.array_sort(F.collect_list(F.struct("id", "x", "y", "value"))).alias("near"))
    return _krige(rows, models, lambda c: np.stack(c, -1)[..., None, :], ["x", "y"], ["tx", "ty"])


ENDS = ["x0", "y0", "z0", "x1", "y1", "z1"]


def line_kriging(neighbours: DataFrame, targets: DataFrame, observations: DataFrame, models: dict[str, Nested]) -> DataFrame:
    """Ordinary kriging with targets and observations integrated over their intervals, from neighbours (target, id, value) and ends (id, x0, ..., z1) of both.

    A support whose ends are one point is that point. Supports without all six ends take no part; a target without any
    neighbour left is not in the result.
    """
    known = " AND ".join(f"{e} IS NOT NULL AND NOT isnan({e})" for e in ENDS)
    goals = targets.where(known).select(F.col("id").alias("target"), *(F.col(e).cast("double").alias(f"t{e}") for e in ENDS))
    lines = observations.where(known).select("id", *(F.col(e).cast("double").alias(e) for e in ENDS))
    met = neighbours.where("value IS NOT NULL AND NOT isnan(cast(value AS double))").select("target", "id", "value").join(lines, "id").join(goals, "target")
    rows = met.groupBy("target").agg(*(F.first(f"t{e}").alias(f"t{e}") for e in ENDS), F.array_sort(F.collect_list(F.struct("id", *ENDS, "value"))).alias("near"))
    return _krige(rows, models, lambda c: _nodes(np.stack([np.stack(c[:3], -1), np.stack(c[3:], -1)], -2)), ENDS, [f"t{e}" for e in ENDS])


def validated(fits: DataFrame, estimates: DataFrame, truths: DataFrame) -> DataFrame:
    """Fits with `rmse` and `coverage` of their model's estimates (model, target, estimate) at truths (target, truth)."""
    known = truths.where("truth IS NOT NULL")
    errors = known.join(estimates.where("status = 'estimated'"), "target").select(F.col("model").alias("candidate"), (F.col("estimate") - F.col("truth")).alias("e"))
    whole = known.agg(F.count("*").alias("n"))
    scores = errors.groupBy("candidate").agg(F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.count("*").alias("met")).join(F.broadcast(whole), F.lit(True))
    return fits.join(scores.select("candidate", "rmse", (F.col("met") / F.col("n")).alias("coverage")), "candidate", "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))


def selected(scored: DataFrame, least_coverage: float = LEAST_COVERAGE, kind: str | None = None) -> DataFrame:
    """The admissible fit of least (rmse, objective), ties by name; no row if none is admissible. kind: of this kind alone."""
    fits = scored.where("status = 'fitted' AND rmse IS NOT NULL").where(F.col("coverage") >= least_coverage)
    if kind:
        fits = fits.where(F.col("kind") == kind)
    return fits.orderBy("rmse", "objective", "candidate").limit(1)


def support_variants(neighbours: DataFrame, targets: DataFrame, observations: DataFrame, scored: DataFrame) -> DataFrame:
    """(variant, target, samples, estimate, variance, status): the selected model at points, the best one without a frame at points, the selected one over lines."""
    best, plain = fitted_models(selected(scored)), fitted_models(selected(scored, kind="isotropic"))
    parts = [(name, point_kriging(neighbours, models)) for name, models in (("base", best), ("isotropic", plain)) if models]
    if best:
        parts.append(("integrated-support", line_kriging(neighbours, targets, observations, best)))
    if not parts:
        return neighbours.sparkSession.createDataFrame([], "variant string, target long, samples long, estimate double, variance double, status string")
    out = None
    for name, rows in parts:
        rows = rows.select(F.lit(name).alias("variant"), "target", "samples", "estimate", "variance", "status")
        out = rows if out is None else out.unionByName(rows)
    return out
