"""Scaling, variograms across variables, orientation, category grids, calibration and selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from stratalake.operators.ranks import quantiles


def standardized(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """`z` by the mean and population deviation of each group; a constant group has z 0 and is flagged."""
    stats = rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    scaled = rows.join(stats, keys)
    constant = F.col("sd") == 0
    return scaled.withColumn("z", (F.col(value) - F.col("mean")) / F.when(constant, 1.0).otherwise(F.col("sd"))).withColumn("constant", constant).drop("mean", "sd")


def robust_asinh(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """`scaled`: asinh((x - median) / IQR) by group; groups without a spread are left out."""
    q = quantiles(rows, keys, value, {"low": 0.25, "median": 0.5, "high": 0.75}).select(*keys, "median", (F.col("high") - F.col("low")).alias("iqr"))
    return rows.join(q.where("iqr > 0"), keys).withColumn("scaled", F.asinh((F.col(value) - F.col("median")) / F.col("iqr"))).drop("median", "iqr")


def boxed(rows: DataFrame, training: DataFrame, axes: list[str]) -> DataFrame:
    """Coordinates as shares of the training rows' box (a flat axis counts as of length 1), and whether they lie outside."""
    box = training.agg(*(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in axes)).first()
    out, outside = rows, F.lit(False)
    for c in axes:
        low, high = box[f"min_{c}"], box[f"max_{c}"]
        if low is None:
            return rows.where("false").withColumns({**{f"{a}_share": F.lit(0.0) for a in axes}, "outside": F.lit(False)})
        out = out.withColumn(f"{c}_share", (F.col(c) - low) / ((high - low) or 1.0))
        outside = outside | (F.col(c) < low) | (F.col(c) > high)
    return out.withColumn("outside", outside)


def cross_variogram(rows: DataFrame, lag: float, lags: int) -> DataFrame:
    """(bin, pairs, gamma): half the mean product of differences of two values at one place, by lag within a hole."""
    a = rows.where("value IS NOT NULL AND other IS NOT NULL").select("hole", "id", "depth", "value", "other")
    b = a.select("hole", *(F.col(c).alias(f"{c}_2") for c in ("id", "depth", "value", "other")))
    met = a.join(b, "hole").where("id < id_2").withColumn("bin", F.bround(F.abs(F.col("depth") - F.col("depth_2")) / lag).cast("long"))
    product = (F.col("value") - F.col("value_2")) * (F.col("other") - F.col("other_2"))
    return met.where((F.col("bin") >= 1) & (F.col("bin") <= lags)).groupBy("bin").agg(F.count("*").alias("pairs"), (F.avg(product) / 2).alias("gamma"))


def plane_normal(dip: Column, dip_direction: Column) -> tuple[Column, Column, Column]:
    """East, north and up parts of a plane's upward normal."""
    d, a = F.radians(dip), F.radians(dip_direction)
    return F.sin(d) * F.sin(a), F.sin(d) * F.cos(a), F.cos(d)


def orientation_tensor(planes: DataFrame, keys: list[str]) -> DataFrame:
    """Six means of products of the normals of planes (dip, dip_direction)."""
    e, n, u = plane_normal(F.col("dip"), F.col("dip_direction"))
    t = planes.select(*keys, e.alias("e"), n.alias("n"), u.alias("u"))
    pairs = [("e", "e"), ("e", "n"), ("e", "u"), ("n", "n"), ("n", "u"), ("u", "u")]
    return t.groupBy(*keys).agg(F.count("*").alias("planes"), *(F.avg(F.col(a) * F.col(b)).alias(a + b) for a, b in pairs))


def principal_orientation(tensor: DataFrame, least_gap: float = 0.05) -> DataFrame:
    """Eigenvalues of each tensor, falling, and whether the first is far enough from the second to give an orientation."""
    parts = ["ee", "en", "eu", "nn", "nu", "uu"]
    keys = [c for c in tensor.columns if c not in parts]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ee, en, eu, nn, nu, uu = (f[c].to_numpy(float) for c in parts)
            values = np.linalg.eigvalsh(np.stack([ee, en, eu, en, nn, nu, eu, nu, uu], 1).reshape(-1, 3, 3))[:, ::-1]
            yield f[keys].assign(first=values[:, 0], second=values[:, 1], third=values[:, 2], defined=values[:, 0] - values[:, 1] >= least_gap)

    kept = ", ".join(f"`{s.name}` {s.dataType.simpleString()}" for s in tensor.schema if s.name in keys)
    return tensor.mapInPandas(run, f"{kept}, first double, second double, third double, defined boolean")


def variance_calibration(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Scale of the predicted variance, mean and variance of z, and the share within 1.96 deviations."""
    e = F.col("truth") - F.col("estimate")
    z = e / F.sqrt("variance")
    return rows.where("variance > 0").groupBy(*keys).agg(F.count("*").alias("n"), F.avg(e * e / F.col("variance")).alias("scale"), F.avg(z).alias("z_mean"), F.var_pop(z).alias("z_variance"), F.avg((F.abs(z) <= 1.96).cast("double")).alias("coverage"))


def vertical_proportions(cells: DataFrame, categories: list[str], pseudo: float = 2.0, least: int = 1) -> DataFrame:
    """(layer, category, share): counts of a layer with the global shares as `pseudo` further cells.

    A layer of fewer than `least` cells takes the counts of the nearest layer that has them, the upper one on a tie.
    """
    count = [F.count_if(F.col("category") == c).alias(f"n{i}") for i, c in enumerate(categories)]
    layers = cells.groupBy("layer").agg(F.count("*").alias("n"), *count)
    overall = cells.groupBy().agg(*(F.avg((F.col("category") == c).cast("double")).alias(f"g{i}") for i, c in enumerate(categories)))
    own = F.when(F.col("n") >= least, F.struct("layer", "n", *(f"n{i}" for i in range(len(categories)))))
    w = Window.partitionBy(F.lit(0)).orderBy("layer")  # one row a layer of the grid
    found = layers.withColumn("below", F.last(own, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("above", F.first(own, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    lower = F.col("above").isNull() | (F.col("layer") - F.col("below.layer") <= F.col("above.layer") - F.col("layer"))
    found = found.withColumn("used", F.when(lower & F.col("below").isNotNull(), F.col("below")).otherwise(F.col("above"))).crossJoin(overall)  # one row
    shares = F.array(*(F.struct(F.lit(c).alias("category"), ((F.col(f"used.n{i}") + pseudo * F.col(f"g{i}")) / (F.col("used.n") + pseudo)).alias("share")) for i, c in enumerate(categories)))
    return found.select("layer", F.explode(shares).alias("s")).select("layer", "s.*")


def majority(lengths: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """(keys, category, share): the category with over `least` of a cell's length, ties to the lowest; else conflict."""
    by = lengths.groupBy(*keys, "category").agg(F.sum("length").alias("length"))
    best = by.groupBy(*keys).agg(F.sum("length").alias("total"), F.min(F.struct((-F.col("length")).alias("less"), "category")).alias("top"))
    share = -F.col("top.less") / F.col("total")
    return best.select(*keys, F.when(share > least, F.col("top.category")).otherwise("conflict").alias("category"), share.alias("share"))


def category_probabilities(realizations: DataFrame, keys: list[str], categories: list[str]) -> DataFrame:
    """Share of realizations in each category, cell by cell."""
    return realizations.groupBy(*keys).agg(*(F.avg((F.col("category") == c).cast("double")).alias(f"p_{c}") for c in categories))


def connectivity(clusters: DataFrame) -> DataFrame:
    """(realization, category, largest, connected): share of the largest cluster, and the chance that two cells share one."""
    n = F.sum("cells")
    return clusters.groupBy("realization", "category").agg((F.max("cells") / n).alias("largest"), (F.sum(F.col("cells") * F.col("cells")) / (n * n)).alias("connected"))


def persistence(runs: DataFrame, keys: list[str], high: float = 0.9, low: float = 0.1, gap: float = 0.5) -> DataFrame:
    """(keys, persistence): present or absent in all runs, dependent on the prior, or uncertain; runs: (keys, prior, p)."""
    by_prior = runs.groupBy(*keys, "prior").agg(F.min("p").alias("least"), F.max("p").alias("most"), F.avg("p").alias("mean"))
    all_ = by_prior.groupBy(*keys).agg(F.min("least").alias("least"), F.max("most").alias("most"), (F.max("mean") - F.min("mean")).alias("between"))
    kind = F.when(F.col("least") >= high, "present").when(F.col("most") <= low, "absent").when(F.col("between") >= gap, "prior-dependent").otherwise("uncertain")
    return all_.select(*keys, kind.alias("persistence"))


def patterns(cells: DataFrame) -> DataFrame:
    """(code, n): frequencies of 2 x 2 patterns of a binary grid (i, j, on), by joins of neighbouring cells."""
    a = cells.select("i", "j", F.col("on").cast("int").alias("on"))
    at = lambda di, dj, name: a.select((F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.col("on").alias(name))
    met = a.join(at(1, 0, "e"), ["i", "j"]).join(at(0, 1, "s"), ["i", "j"]).join(at(1, 1, "d"), ["i", "j"])
    return met.groupBy((F.col("on") + 2 * F.col("e") + 4 * F.col("s") + 8 * F.col("d")).alias("code")).agg(F.count("*").alias("n"))


def isotonic(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x, fitted, weight): the rising least-squares fit of y on x; equal x are averaged before one group is gathered.

    Groups are as large as their distinct x; round x where that is unbounded.
    """
    means = rows.where("x IS NOT NULL AND y IS NOT NULL").groupBy(*keys, "x").agg(F.avg("y").alias("y"), F.count("*").alias("weight"))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("x")
        pools: list[list[float]] = []  # mean, weight, rows
        for y, w in zip(group["y"].tolist(), group["weight"].tolist()):
            pools.append([y, w, 1])
            while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
                y1, w1, n1 = pools.pop()
                y0, w0, n0 = pools.pop()
                pools.append([(y0 * w0 + y1 * w1) / (w0 + w1), w0 + w1, n0 + n1])
        fitted = np.repeat([p[0] for p in pools], [int(p[2]) for p in pools])
        return group[[*keys, "x"]].assign(fitted=fitted, weight=group["weight"].to_numpy())

    kept = ", ".join(f"`{s.name}` {s.dataType.simpleString()}" for s in means.schema if s.name in keys)
    return means.groupBy(*keys).applyInPandas(fit, f"{kept}, x double, fitted double, weight long")


def chosen_candidates(rows: DataFrame, keys: list[str], least: float = 0.9) -> DataFrame:
    """(keys, candidate, rmse): the smallest error, then objective, then name, among candidates of enough coverage."""
    best = rows.where(F.col("coverage") >= least).groupBy(*keys).agg(F.min(F.struct("rmse", "objective", "candidate")).alias("best"))
    return best.select(*keys, "best.candidate", "best.rmse")


def waterfall(rows: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """(step, name, rows): rows left after each of the filters, which add up; counted in one pass."""
    passed, counts = F.lit(True), []
    for i, (name, keep) in enumerate(steps):
        passed = passed & F.coalesce(keep, F.lit(False))
        counts.append(F.struct(F.lit(i).alias("step"), F.lit(name).alias("name"), F.count_if(passed).alias("rows")))
    return rows.agg(F.array(*counts).alias("counts")).select(F.explode("counts").alias("c")).select("c.*")


def soft_grid(proportions: DataFrame, image: DataFrame) -> DataFrame:
    """(layer, category, probability): layer shares over the training image's shares, made to add up to one by layer."""
    raw = proportions.join(image.select("category", F.col("share").alias("image")), "category").where("image > 0").withColumn("r", F.col("share") / F.col("image"))
    return raw.select("layer", "category", (F.col("r") / F.sum("r").over(Window.partitionBy("layer"))).alias("probability"))


def spacing_median(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Median distance between consecutive positions of a group."""
    w = Window.partitionBy(*keys).orderBy(position)
    return rows.withColumn("step", F.lead(position).over(w) - F.col(position)).where("step IS NOT NULL").groupBy(*keys).agg(F.percentile("step", 0.5).alias("spacing"))
