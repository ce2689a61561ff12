"""Nested fits, kriging over lines, choice by validation and rising fits against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from stratalake.operators import rising, structures as S
from stratalake.operators.modelling import FAMILIES
from stratalake.operators.spatial import DIRECTIONS


def plain_rising(x, y):
    place, inverse, count = np.unique(x, return_inverse=True, return_counts=True)
    blocks = []
    for p, total, w in zip(place, np.bincount(inverse, y), count.astype(float)):
        blocks.append([p, p, total, w])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            low, _, t, v = blocks.pop(-2)
            blocks[-1] = [low, blocks[-1][1], t + blocks[-1][2], v + blocks[-1][3]]
    return [(a, b, t / w, w) for a, b, t, w in blocks]


@pytest.mark.parametrize("shape", ["noise", "falling", "rising", "one low end", "ties"])
def test_rising_fit_in_rounds(spark, shape):
    rng = np.random.default_rng(1)
    x = np.arange(3000.0)
    y = {"noise": np.sqrt(x) + rng.normal(0, 9, 3000), "falling": -x, "rising": x, "one low end": np.where(x < 2999, x, -1e7), "ties": rng.normal(size=3000)}[shape]
    x = np.floor(x / 7) if shape == "ties" else x
    rows = [("a", float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0, 2.0), (None, 0.0, 3.0), ("b", None, 1.0), ("b", 1.0, float("nan"))]
    fit = rising.rising_fit(spark.createDataFrame(rows, "k string, x double, y double").repartition(5), ["k"], stretch=200).collect()
    got = sorted((r.low, r.high, r.value, r.weight) for r in fit if r.k == "a")
    assert np.allclose(got, plain_rising(x, y))
    assert [(r.low, r.high, r.value) for r in fit if r.k is None] == [(0.0, 1.0, 2.5)] and not [r for r in fit if r.k == "b"]


def test_rising_fit_of_one_long_key(spark):
    rows = spark.range(1_000_000).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("x"), (F.sqrt(F.col("id").cast("double")) + F.pmod(F.col("id") * 7919, F.lit(1009))).alias("y"))
    fit = rising.rising_fit(rows, ["k"])
    got = np.array(sorted((r.low, r.high, r.value, r.weight) for r in fit.collect()))
    i = np.arange(1_000_000)
    assert np.allclose(got, plain_rising(i.astype(float), np.sqrt(i) + i * 7919 % 1009))
    assert rising.fitted_points(fit, ["k"]).count() == sum(1 if a == b else 2 for a, b, _, _ in got)
    assert rising.rising_fit(rows.where("false"), ["k"]).count() == 0


def bins(model, names, h=np.arange(1, 19) * 50.0):
    out = []
    for name in names:
        a = np.radians(DIRECTIONS.get(name, 0.0) - model.azimuth)
        gamma = model.nugget + sum(s * FAMILIES[f](h * np.hypot(np.cos(a) / major, np.sin(a) / minor)) for f, s, major, minor in model.steps)
        out += [(name, float(x), 100, float(g)) for x, g in zip(h, gamma)]
    return out


def test_two_structures_and_frames_are_recovered(spark):
    nested = S.Nested(0.2, 0.0, (("spherical", 0.7, 120.0, 120.0), ("spherical", 1.1, 600.0, 600.0)))
    framed = S.Nested(0.1, 45.0, (("spherical", 1.4, 700.0, 250.0),))
    rows = [("n", *r) for r in bins(nested, ["omni"])] + [("f", *r) for r in bins(framed, DIRECTIONS)] + [("few", "omni", 1.0, 5, 1.0)]
    gammas = spark.createDataFrame(rows, "k string, direction string, distance double, pairs long, gamma double")
    fits = S.fit_candidates(gammas, ["k"]).collect()
    found = {(r.k, r.candidate): r for r in fits}
    two = found["n", "spherical+spherical isotropic"]
    assert np.allclose([two.nugget, *(v for s in two.steps for v in (s.sill, s.major))], [0.2, 0.7, 120, 1.1, 600], rtol=0.02) and two.objective < 1e-6
    assert found["n", "spherical isotropic"].objective > 10 * two.objective and found["n", "spherical at 0"].status == "failed"
    best = min((r for r in fits if r.k == "f" and r.status == "fitted" and r.candidate.startswith("spherical at")), key=lambda r: r.objective)
    assert best.azimuth == 45 and np.allclose([best.nugget, best.steps[0].sill, best.steps[0].major, best.steps[0].minor], [0.1, 1.4, 700, 250], rtol=0.02)
    assert found["few", "spherical isotropic"].status == "failed" and found["few", "spherical isotropic"].reason == "1 bins"


def test_nonnegative_and_bounds():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(20, 3))
    x, loss = S.nonnegative(a, a @ [1.0, -2.0, 0.5])
    assert (x >= 0).all() and x[1] == 0 and np.isclose(loss, ((a @ x - a @ [1.0, -2.0, 0.5]) ** 2).sum())
    at, _, ok = S.bounded_fit(lambda v: v - np.array([3.0, -1.0]), np.zeros(2), np.full(2, -0.5), np.full(2, 2.0))
    assert ok and np.allclose(at, [2.0, -0.5])


MODEL = S.Nested(0.1, 30.0, (("spherical", 0.8, 90.0, 50.0), ("exponential", 0.4, 200.0, 150.0)))


def dense(ends, goal, value, q=4):
    t, w = np.polynomial.legendre.leggauss(q)
    t, w = (t + 1) / 2, w / 2
    if q == 1:
        t, w = np.array([0.5]), np.ones(1)

    def cov(a, b):
        total = 0.0
        for i in range(q):
            for j in range(q):
                d = a[:3] + t[i] * (a[3:] - a[:3]) - b[:3] - t[j] * (b[3:] - b[:3])
                along, across = d[0] * np.sin(np.pi / 6) + d[1] * np.cos(np.pi / 6), d[0] * np.cos(np.pi / 6) - d[1] * np.sin(np.pi / 6)
                for f, s, major, minor in MODEL.steps:
                    total += w[i] * w[j] * s * (1 - FAMILIES[f](np.sqrt((along**2 + d[2] ** 2) / major**2 + across**2 / minor**2)))
        return total + MODEL.nugget * (a == b).all()

    n = len(ends)
    system = np.ones((n + 1, n + 1))
    system[n, n] = 0
    system[:n, :n] = [[cov(a, b) for b in ends] for a in ends]
    right = np.array([*(cov(a, goal) for a in ends), 1.0])
    weight = np.linalg.solve(system, right)
    return weight[:n] @ value, cov(goal, goal) - weight @ right


def test_lines_equal_one_dense_system(spark):
    rng = np.random.default_rng(6)
    ends, value = rng.uniform(0, 80, (6, 6)), rng.normal(size=6)
    ends[2, 3:] = ends[2, :3]
    goals = {1: rng.uniform(0, 80, 6), 2: ends[0], 3: np.tile(rng.uniform(0, 80, 3), 2)}
    observations = spark.createDataFrame([(i, *map(float, e)) for i, e in enumerate(ends)] + [(9, None, 0.0, 0.0, 0.0, 0.0, 0.0)], "id long, " + ", ".join(f"{e} double" for e in S.ENDS))
    targets = spark.createDataFrame([(t, *map(float, e)) for t, e in goals.items()], observations.schema)
    near = spark.createDataFrame([(t, i, float(v)) for t in goals for i, v in enumerate(value)] + [(1, 9, 5.0), (2, 3, None)], "target long, id long, value double")
    found = {r.target: r for r in S.line_kriging(near, targets, observations, {"m": MODEL}).collect()}
    for t, goal in goals.items():
        assert np.allclose([found[t].estimate, found[t].variance], dense(ends, goal, value)) and found[t].samples == 6


def test_points_and_choice(spark):
    rng = np.random.default_rng(8)
    xy, value = rng.uniform(0, 100, (5, 2)), rng.normal(size=5)
    near = spark.createDataFrame([(t, 10.0 * t, 40.0, i, *map(float, p), float(v)) for t in (1, 2) for i, (p, v) in enumerate(zip(xy, value))], "target long, tx double, ty double, id long, x double, y double, value double")
    other = S.Nested(0.0, 0.0, (("gaussian", 1.0, 5.0, 5.0),))
    estimates = S.point_kriging(near, {"a": MODEL, "b": other})
    found = {(r.model, r.target): r for r in estimates.collect()}
    ends = np.hstack([xy, np.zeros((5, 1)), xy, np.zeros((5, 1))])
    for t in (1, 2):
        assert np.allclose([found["a", t].estimate, found["a", t].variance], dense(ends, np.array([10.0 * t, 40, 0] * 2), value, 1))
    fits = spark.createDataFrame([("a", "anisotropic", 1.0, "fitted"), ("b", "isotropic", 2.0, "fitted"), ("c", "isotropic", 0.0, "failed")], "candidate string, kind string, objective double, status string")
    truths = spark.createDataFrame([(1, found["a", 1].estimate), (2, found["a", 2].estimate + 0.01), (3, None)], "target long, truth double")
    scored = S.validated(fits, estimates, truths)
    rows = {r.candidate: r for r in scored.collect()}
    assert np.isclose(rows["a"].rmse, 0.01 / np.sqrt(2)) and rows["a"].coverage == 1 and rows["c"].coverage == 0
    assert S.selected(scored).first().candidate == "a" and S.selected(scored, kind="isotropic").first().candidate == "b"
    assert S.selected(scored, least_coverage=1.5).count() == 0
