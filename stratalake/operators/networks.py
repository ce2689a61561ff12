"""Small networks with their own forward and backward passes, fitted side by side: a task for each configuration and seed.

Training and validation rows are bounded (`MOST` of each, by a hash of the id, beyond which rows are left out and counted)
and go to every task; what is predicted is a table of any size, scored by batches.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stratalake.operators.ranks import quantiles

MOST = 100_000
# Fixed values of the optimiser: step, decay of weights, both momenta, the term below the root, rows of a step.
RATE, DECAY, BETAS, TINY, BATCH = 1e-3, 1e-4, (0.9, 0.999), 1e-8, 64
SEEDS = (11, 23, 47)

Weights = list[np.ndarray]


@dataclass(frozen=True)
class Dense:
    """Layers of the given widths, rectified but for those in `linear` and the last one."""

    widths: tuple[int, ...]
    linear: bool = False
    bends: tuple[int, ...] | None = None  # layers that are rectified; None: all but the last

    def _bent(self, i: int) -> bool:
        return not self.linear and (i in self.bends if self.bends is not None else i < len(self.widths) - 2)

    def start(self, rng: np.random.Generator) -> Weights:
        out = []
        for a, b in zip(self.widths, self.widths[1:]):
            bound = 1 / math.sqrt(a)
            out += [rng.uniform(-bound, bound, (a, b)), rng.uniform(-bound, bound, b)]
        return out

    def run(self, w: Weights, x: tuple[np.ndarray, ...]) -> tuple[np.ndarray, list]:
        at, kept = x[0], []
        for i in range(len(w) // 2):
            z = at @ w[2 * i] + w[2 * i + 1]
            kept.append((at, z))
            at = np.maximum(z, 0) if self._bent(i) else z
        return at, kept

    def slopes(self, w: Weights, x: tuple[np.ndarray, ...], kept: list, slope: np.ndarray) -> Weights:
        out: Weights = [np.empty(0)] * len(w)
        for i in reversed(range(len(w) // 2)):
            at, z = kept[i]
            if self._bent(i):
                slope = slope * (z > 0)
            out[2 * i], out[2 * i + 1] = at.T @ slope, slope.sum(0)
            slope = slope @ w[2 * i].T
        return out


@dataclass(frozen=True)
class Graph:
    """Two graph convolutions of one width over (features (n, k, f), adjacency (n, k, k)) and a head on node 0."""

    features: int
    width: int

    def start(self, rng: np.random.Generator) -> Weights:
        return Dense((self.features, self.width, self.width, 1)).start(rng)

    def run(self, w: Weights, x: tuple[np.ndarray, ...]) -> tuple[np.ndarray, list]:
        f, a = x
        p = a @ f
        z = p @ w[0] + w[1]
        q = a @ np.maximum(z, 0)
        y = q @ w[2] + w[3]
        top = np.maximum(y[:, 0], 0)
        return top @ w[4] + w[5], [p, z, q, y, top]

    def slopes(self, w: Weights, x: tuple[np.ndarray, ...], kept: list, slope: np.ndarray) -> Weights:
        p, z, q, y, top = kept
        first = (slope @ w[4].T) * (y[:, 0] > 0)
        back = x[1][:, 0, :, None] * (first @ w[2].T)[:, None, :] * (z > 0)  # only node 0 of the second layer matters
        return [np.einsum("nki,nkj->ij", p, back), back.sum((0, 1)), q[:, 0].T @ first, first.sum(0), top.T @ slope, slope.sum(0)]


def autoencoder(features: int, latent: int, linear: bool = False) -> Dense:
    """features-32-8-latent-8-32-features, straight at the bottleneck and the end."""
    if latent >= features:
        raise ValueError("a bottleneck has fewer units than there are features")
    return Dense((features, latent, features), True) if linear else Dense((features, 32, 8, latent, 8, 32, features), bends=(0, 1, 3, 4))


class AdamW:
    """Steps with decayed weights; biases decay like weights."""

    def __init__(self, w: Weights, rate: float = RATE, decay: float = DECAY):
        self.rate, self.decay, self.t = rate, decay, 0
        self.m, self.v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]

    def step(self, w: Weights, slopes: Weights) -> None:
        self.t += 1
        for i, g in enumerate(slopes):
            self.m[i] = BETAS[0] * self.m[i] + (1 - BETAS[0]) * g
            self.v[i] = BETAS[1] * self.v[i] + (1 - BETAS[1]) * g * g
            w[i] *= 1 - self.rate * self.decay
            w[i] -= self.rate * (self.m[i] / (1 - BETAS[0] ** self.t)) / (np.sqrt(self.v[i] / (1 - BETAS[1] ** self.t)) + TINY)


def hole_rmse(error: np.ndarray, holes: np.ndarray) -> float:
    """Mean over holes of the root mean squared error of a hole."""
    _, at = np.unique(holes, return_inverse=True)
    square = (error.reshape(len(error), -1) ** 2).mean(1)
    return float(np.sqrt(np.bincount(at, square) / np.bincount(at)).mean())


def fit(net: Dense | Graph, x: tuple[np.ndarray, ...], y: np.ndarray, vx: tuple[np.ndarray, ...], vy: np.ndarray, holes: np.ndarray, seed: int, epochs: int, patience: int, rate: float = RATE, batch: int = BATCH) -> dict:
    """The weights of the epoch with the least validation error by holes; ends `patience` epochs after it."""
    rng = np.random.default_rng(seed)
    w = net.start(rng)
    optimiser, best, best_w, best_epoch, history = AdamW(w, rate), math.inf, [a.copy() for a in w], 0, []
    for epoch in range(1, epochs + 1):
        order, loss = rng.permutation(len(y)), 0.0
        for start in range(0, len(y), batch):
            rows = order[start : start + batch]
            part = tuple(a[rows] for a in x)
            out, kept = net.run(w, part)
            error = out - y[rows]
            loss += float((error**2).sum())
            optimiser.step(w, net.slopes(w, part, kept, 2 * error / error.size))
        if not math.isfinite(loss):
            raise ArithmeticError(f"the loss of epoch {epoch} is no number")
        score = hole_rmse(net.run(w, vx)[0] - vy, holes)
        history.append(score)
        if score < best:
            best, best_w, best_epoch = score, [a.copy() for a in w], epoch
        elif epoch - best_epoch >= patience:
            break
    return {"weights": best_w, "objective": best, "best_epoch": best_epoch, "history": history}


def packed(w: Weights) -> bytes:
    out = io.BytesIO()
    np.savez(out, *w)
    return out.getvalue()


def unpacked(raw: bytes) -> Weights:
    with np.load(io.BytesIO(raw)) as held:
        return [held[f"arr_{i}"] for i in range(len(held.files))]


@dataclass(frozen=True)
class Split:
    """Bounded rows of one part: features x (n, f), targets y (n, outputs), holes; for graphs also adjacency."""

    x: tuple[np.ndarray, ...]
    y: np.ndarray
    holes: np.ndarray
    left_out: int = 0


def bounded_rows(rows: DataFrame, features: str = "features", target: str = "target", most: int = MOST) -> Split:
    """Rows (id, hole, features array, target) of whole numbers, at most `most` by a hash of the id."""
    sound = rows.where(F.col(target).isNotNull() & ~F.isnan(target) & F.forall(features, lambda v: v.isNotNull() & ~F.isnan(v)))
    held = sound.orderBy(F.xxhash64("id"), "id").limit(most).select("id", F.col("hole").cast("string").alias("hole"), features, target).toPandas().sort_values("id", kind="stable")
    left = max(0, sound.count() - most) if len(held) == most else 0
    x = np.array(held[features].tolist(), float) if len(held) else np.zeros((0, 0))
    return Split((x,), held[target].to_numpy(float)[:, None], held["hole"].to_numpy(), left)


FITS = "configuration string, seed long, labels string, weights binary, parameters long, best_epoch long, epochs long, objective double, history array<double>"


def fit_all(spark, nets: dict[str, Dense | Graph], train: Split, validation: Split, seeds: tuple[int, ...] = SEEDS, epochs: int = 400, patience: int = 40, shuffled: int | None = None, rate: float = RATE) -> DataFrame:
    """A row for each configuration and seed: weights and history. shuffled: seed that permutes the training labels, as a control.

    Each fit is one row of the plan and one task's work, and gives the same numbers wherever it runs.
    """
    y = train.y if shuffled is None else train.y[np.random.default_rng(shuffled).permutation(len(train.y))]
    shared = spark.sparkContext.broadcast((nets, train.x, y, validation))
    plan = spark.createDataFrame([(c, s) for c in nets for s in seeds], "configuration string, seed long").repartition(max(1, len(nets) * len(seeds)), "configuration", "seed")
    labels = "observed" if shuffled is None else "shuffled"

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nets_, x, y_, v = shared.value
        for rows in it:
            out = []
            for c, s in rows.itertuples(index=False):
                f = fit(nets_[c], x, y_, v.x, v.y, v.holes, int(s), epochs, patience, rate)
                out.append((c, s, labels, packed(f["weights"]), sum(a.size for a in f["weights"]), f["best_epoch"], len(f["history"]), f["objective"], f["history"]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FITS.split(", ")])

    return plan.mapInPandas(run, FITS)


def chosen(fits: DataFrame) -> DataFrame:
    """(configuration, objective): the one of least mean objective over its seeds; ties to fewer parameters, then by name."""
    means = fits.where("labels = 'observed'").groupBy("configuration").agg(F.avg("objective").alias("objective"), F.max("parameters").alias("parameters"))
    return means.orderBy("objective", "parameters", "configuration").limit(1)


def ensemble(rows: DataFrame, net: Dense, weights: dict[int, Weights], features: str = "features", shift: float = 0.0, scale: float = 1.0) -> DataFrame:
    """(id, estimates by seed, mean, spread) of rows (id, features), in native units; rows with a null or NaN feature have no mean."""
    seeds = sorted(weights)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = np.array([[np.nan if v is None else v for v in row] for row in batch.column(1).to_pylist()], float).reshape(batch.num_rows, -1)
            each = np.stack([net.run(weights[s], (x,))[0][:, 0] * scale + shift for s in seeds], 1) if batch.num_rows else np.zeros((0, len(seeds)))
            bad = ~np.isfinite(each).all(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(each.tolist(), pa.list_(pa.float64())), pa.array(each.mean(1), mask=bad), pa.array(each.std(1), mask=bad)], names=["id", "estimates", "mean", "spread"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", features).mapInArrow(run, f"id {kind}, estimates array<double>, mean double, spread double")


def reconstruction(rows: DataFrame, net: Dense, weights: dict[int, Weights], properties: list[str], features: str = "features") -> DataFrame:
    """(id, score, residuals by property) of rows (id, features): squared differences from what the networks give back, averaged over seeds."""
    seeds = sorted(weights)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, len(properties))
            residual = np.mean([(x - net.run(weights[s], (x,))[0]) ** 2 for s in seeds], axis=0)
            named = pa.MapArray.from_arrays(pa.array(np.arange(0, residual.size + 1, len(properties)), pa.int32()), pa.array(properties * batch.num_rows), pa.array(residual.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(residual.mean(1)), named], names=["id", "score", "residuals"])

    kind = rows.schema["id"].dataType.simpleString()
    whole = rows.where(F.forall(features, lambda v: v.isNotNull() & ~F.isnan(v)))
    return whole.select("id", features).mapInArrow(run, f"id {kind}, score double, residuals map<string,double>")


def residual_summary(scored: DataFrame, top: int = 10) -> tuple[DataFrame, DataFrame]:
    """((property, n, mean, largest) of residuals, the `top` rows of highest score with their worst property)."""
    each = scored.select("id", F.explode("residuals").alias("property", "residual"))
    by_property = each.groupBy("property").agg(F.count("*").alias("n"), F.avg("residual").alias("mean"), F.max("residual").alias("largest"))
    worst = F.array_max(F.transform(F.map_entries("residuals"), lambda e: F.struct(e["value"].alias("value"), e["key"].alias("key"))))["key"]
    return by_property, scored.orderBy(F.desc("score"), "id").limit(top).select("id", "score", worst.alias("worst"))


def residual_bands(rows: DataFrame, keys: list[str], share: float = 0.9) -> DataFrame:
    """(keys, n, low, high) of residuals (keys, truth, mean): the central `share` on calibration rows, by counted exact quantiles."""
    e = rows.where("truth IS NOT NULL AND mean IS NOT NULL").select(*keys, (F.col("truth") - F.col("mean")).alias("residual"))
    cuts = quantiles(e, keys, "residual", {"low": (1 - share) / 2, "high": (1 + share) / 2})
    counts = e.groupBy(*keys).agg(F.count("*").alias("n"))
    if not keys:
        return counts.join(cuts, F.lit(True))
    same = [counts[k].eqNullSafe(cuts[k]) for k in keys]
    return counts.join(cuts, same).select(*(counts[k] for k in keys), "n", "low", "high")


def normalized_adjacency(nodes: DataFrame, reach: float) -> DataFrame:
    """(target, a, b, weight) of a target's few nodes (target, node, x, y): Gaussian nearness with loops, over the roots of both ends' degrees."""
    other = nodes.select("target", F.col("node").alias("b"), F.col("x").alias("x_2"), F.col("y").alias("y_2"))
    square = F.pow(F.col("x") - F.col("x_2"), 2) + F.pow(F.col("y") - F.col("y_2"), 2)
    near = F.exp(-square / (2 * reach * reach)) + (F.col("a") == F.col("b")).cast("double")
    edges = nodes.select("target", F.col("node").alias("a"), "x", "y").join(other, "target").select("target", "a", "b", near.alias("near"))
    degree = edges.groupBy("target", "a").agg(F.sum("near").alias("own"))
    met = edges.join(degree, ["target", "a"]).join(degree.select("target", F.col("a").alias("b"), F.col("own").alias("other")), ["target", "b"])
    return met.select("target", "a", "b", (F.col("near") / F.sqrt(F.col("own") * F.col("other"))).alias("weight"))
