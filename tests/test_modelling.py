"""Ranks, fits, kriging by indicators, resampling and surfaces against NumPy."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F
from stratalake.operators import matching, modelling as M, ranks


def test_quantiles_of_ties_nulls_and_null_keys(spark):
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(size=301).round(1).tolist(), None: [5.0], "c": rng.integers(0, 3, 500).astype(float).tolist()}
    rows = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [("d", None), ("a", None)], "k string, v double")
    found = {r.k: r for r in ranks.quantiles(rows, ["k"], "v", {"low": 0.1, "mid": 0.5, "high": 0.93}).collect()}
    assert set(found) == set(groups)
    for k, vs in groups.items():
        assert np.allclose([found[k].low, found[k].mid, found[k].high], np.quantile(vs, [0.1, 0.5, 0.93]))
    assert ranks.quantiles(rows.where("false"), ["k"], "v", {"mid": 0.5}).count() == 0


def test_cuts_change_nothing(spark):
    rows = spark.range(3000).select((F.col("id") * 7919 % 997).cast("double").alias("v"))
    one, many = (sorted(map(tuple, ranks.ranked_values(rows, [], "v", parts=p).collect())) for p in (2, 500))
    assert one == many and one[-1][2] == one[-1][3] == 3000


def test_inverse_normal(spark):
    p = [1e-9, 1e-4, 0.02, 0.3, 0.5, 0.9, 0.99, 1 - 1e-7]
    found = [r[0] for r in spark.createDataFrame([(x,) for x in p], "p double").select(ranks.inverse_normal(F.col("p"))).collect()]
    assert np.allclose(found, [NormalDist().inv_cdf(x) for x in p], rtol=2e-9, atol=2e-9)
    assert spark.range(1).select(ranks.inverse_normal(F.lit(0.0)), ranks.inverse_normal(F.lit(1.0))).first() == (None, None)


def test_outermost_cuts_ties_by_id(spark):
    points = spark.createDataFrame([(i, *xy) for i, xy in enumerate([(1.0, 0.0), (-1.0, 0.0), (0.0, 1.0), (0.0, -1.0), (0.0, 0.0)])], "id long, x double, y double")
    assert sorted(r.id for r in matching.outermost(points, 0.41).collect()) == [0, 1, 2]
    assert matching.outermost(points.where("false"), 0.5).count() == 0


def test_fit_finds_the_model(spark):
    h = np.arange(1, 13) * 50.0
    gamma = 0.3 + 1.7 * M.FAMILIES["spherical"](h / 340)
    rows = spark.createDataFrame([("a", float(x), 10 + i, float(g)) for i, (x, g) in enumerate(zip(h, gamma))] + [("short", 1.0, 3, 1.0), ("short", 2.0, 0, None)], "k string, distance double, pairs long, gamma double")
    (found,) = M.fit_variograms(rows, ["k"]).collect()
    assert found.family == "spherical" and np.allclose([found.nugget, found.sill, found.reach], [0.3, 1.7, 340], rtol=0.01)


def test_coregionalization_is_semidefinite_and_fits(spark):
    h, shape = np.arange(1, 9) * 100.0, M.FAMILIES["spherical"](np.arange(1, 9) / 5)
    nugget, sill = np.array([[0.2, 0.1], [0.1, 0.3]]), np.array([[1.0, 0.8], [0.8, 0.64]])
    rows = [("ab"[i], "ab"[j], float(x), 20, float(nugget[i, j] + sill[i, j] * s)) for i, j in ((0, 0), (0, 1), (1, 1)) for x, s in zip(h, shape)]
    found = M.coregionalization(spark.createDataFrame(rows, "a string, b string, distance double, pairs long, gamma double"), [("spherical", 500.0)]).collect()
    for s, wanted in enumerate((nugget, sill)):
        m = {(r.a, r.b): r.sill for r in found if r.structure == s}
        matrix = np.array([[m["a", "a"], m["a", "b"]], [m["a", "b"], m["b", "b"]]])
        assert np.linalg.eigvalsh(matrix).min() > -1e-12 and np.allclose(matrix, wanted, atol=1e-3)


def test_indicator_chances_rise_and_equal_single_systems(spark):
    rng = np.random.default_rng(4)
    xy, value = rng.uniform(0, 100, (6, 2)), rng.uniform(0, 10, 6)
    near = spark.createDataFrame([(t, float(tx), 50.0, i, *map(float, xy[i]), float(value[i])) for t, tx in ((1, 40), (2, 90)) for i in range(6)], "target long, tx double, ty double, id long, x double, y double, value double")
    models = {2.0: (1.0, 80.0, 0.1), 5.0: (0.5, 60.0, 0.0), 8.0: (1.0, 120.0, 0.2)}
    for row in M.indicator_kriging(near, models).collect():
        goal, raw = np.array([40.0 if row.target == 1 else 90.0, 50.0]), []
        for t, (sill, reach, nugget) in sorted(models.items()):
            cov = lambda d: np.where(d == 0, sill + nugget, sill * (1 - 1.5 * np.minimum(d / reach, 1) + 0.5 * np.minimum(d / reach, 1) ** 3))  # noqa: B023, E731
            system = np.ones((7, 7))
            system[:6, :6], system[6, 6] = cov(np.linalg.norm(xy[:, None] - xy, axis=2)), 0
            weights = np.linalg.solve(system, [*cov(np.linalg.norm(xy - goal, axis=1)), 1])[:6]
            raw.append(min(1, max(0, float(weights @ (value <= t)))))
        up, down = np.maximum.accumulate(raw), np.minimum.accumulate(raw[::-1])[::-1]
        assert np.allclose(row.probabilities, (up + down) / 2) and row.probabilities == sorted(row.probabilities)


def test_singular_drift_is_tried_with_more_neighbours(spark):
    points = [(i, i, float(i), 0.0, float(i)) for i in range(4)] + [(10, 10, 1.0, 40.0, 3.0), (11, 11, 3.0, 45.0, 4.0)]
    observed = spark.createDataFrame(points, "id long, hole long, x double, y double, value double")
    target = spark.createDataFrame([(99, 1.4, 0.2), (98, 2.0, 43.0)], "id long, x double, y double")
    found = {r.target: r for r in M.universal_with_retry(target, observed, 1, 3, 10.0, 1.0, 50.0, 0.1).collect()}
    assert found[99].retried and found[99].status == "estimated" and math.isfinite(found[99].estimate)
    assert not found[98].retried and found[98].status == "estimated"


def test_bootstrap_draws_whole_holes(spark):
    rng = np.random.default_rng(7)
    rows = [(int(h), float(a), float(b)) for h, a, b in zip(rng.integers(0, 60, 900), rng.normal(0, 2, 900), rng.normal(0, 1, 900))]
    table = spark.createDataFrame([*rows, (3, None, 1.0)], "hole long, error_a double, error_b double")
    found = {r.replicate: r.difference for r in M.bootstrap_difference(table, 600, seed=5, block=8).collect()}
    again = {r.replicate: r.difference for r in M.bootstrap_difference(table.repartition(7), 600, seed=5, block=8).collect()}
    assert found == pytest.approx(again, rel=1e-12)  # sums may run in another order
    s, n = np.zeros(60), np.zeros(60)
    for h, a, b in rows:
        s[h] += abs(a) - abs(b)
        n[h] += 1
    draws = rng.integers(0, 60, (6000, 60))
    wanted = s[draws].sum(1) / n[draws].sum(1)
    values = np.array(list(found.values()))
    assert len(found) == 600 and abs(values.mean() - wanted.mean()) < 0.2 * wanted.std() and 0.85 < values.std() / wanted.std() < 1.15
    assert M.bootstrap_difference(table.where("false")).count() == 0


def test_surface_is_exact_at_collars(spark):
    collars = spark.createDataFrame([(0.0, 0.0, 10.0), (0.0, 0.0, 20.0), (3.0, 4.0, 40.0), (1.0, None, 5.0)], "x double, y double, z double")
    cells = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 0.0), (3, None, 1.0)], "id long, x double, y double")
    found = dict(map(tuple, M.collar_surface(cells, collars).collect()))
    assert found[1] == 15 and found[3] is None and math.isclose(found[2], (10 / 9 + 20 / 9 + 40 / 16) / (2 / 9 + 1 / 16))
    assert {r.z for r in M.collar_surface(cells, collars.where("false")).collect()} == {None}
    rng = np.random.default_rng(3)
    xyz, at = rng.uniform(0, 100, (90, 3)), rng.uniform(0, 100, (70, 2))
    at[:5] = xyz[:5, :2]
    many = spark.createDataFrame([tuple(map(float, r)) for r in [*xyz, xyz[0] + [0, 0, 4.0]]], "x double, y double, z double")
    places = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(at)], "id long, x double, y double")
    found = dict(map(tuple, M.collar_surface(places, many, block=16).collect()))
    for i, r in enumerate(at):
        d = np.hypot(*(xyz[:, :2] - r).T)
        assert math.isclose(found[i], xyz[i, 2] + 2 * (i == 0) if i < 5 else ((xyz[:, 2] / d**2).sum() + (xyz[0, 2] + 4) / d[0] ** 2) / ((1 / d**2).sum() + 1 / d[0] ** 2), rel_tol=1e-9)


def test_observations_without_values_weigh_nothing(spark):
    from stratalake.operators import spatial

    nan = float("nan")
    points = [(1, 10, 0.0, 0.0, 1.0), (2, 20, 10.0, 0.0, 2.0), (3, 30, 0.0, 10.0, None), (4, 40, 10.0, 10.0, 4.0), (5, 50, 5.0, 5.0, 3.0), (6, 60, 5.0, 4.0, nan), (7, 70, None, 4.0, 9.0)]
    table = spark.createDataFrame(points, "id long, hole long, x double, y double, value double")
    near = spatial.neighbourhoods(table, table, 2, 8, 50.0)
    assert {r.id for r in near.collect()} == {1, 2, 4, 5}
    found = {r.target: r for r in spatial.with_uninformed(table, spatial.kriging(near, 1.0, 50.0, 0.1), near, 1).collect()}
    assert set(found) == set(range(1, 8)) and found[7].status == "uninformed" and found[7].estimate is None
    assert all(math.isfinite(found[i].estimate) for i in range(1, 7))


def test_failed_and_uninformed_targets_stay(spark):
    twice = [(1, 0.0, 0.0, i, 5.0, 5.0, float(i)) for i in (1, 2)] + [(2, 0.0, 0.0, i, 3.0 * i, 1.0, float(i)) for i in (1, 2)]
    near = spark.createDataFrame(twice, "target long, tx double, ty double, id long, x double, y double, value double")
    found = {r.target: r for r in M.indicator_kriging(near, {1.5: (1.0, 20.0, 0.0), 2.5: (1.0, 20.0, 0.0)}).collect()}
    assert (found[1].status, found[1].probabilities, found[2].status, len(found[2].probabilities)) == ("failed", None, "estimated", 2)
    sites = spark.createDataFrame([(1, 1, 0.0, 0.0, 1.0)], "id long, hole long, x double, y double, value double")
    (alone,) = M.universal_with_retry(sites, sites, 1, 3, 10.0, 1.0, 50.0, 0.1).collect()
    assert (alone.target, alone.status, alone.estimate, alone.retried) == (1, "uninformed", None, False)


def test_cokriging_equals_one_dense_system(spark):
    rng = np.random.default_rng(11)
    xy, value, kind = rng.uniform(0, 100, (7, 2)), rng.normal(size=7), [0, 0, 0, 0, 1, 1, 1]
    xy[4] = xy[0]
    rows = [(t, 30.0 + t, 50.0, i, *map(float, xy[i]), float(value[i]), kind[i]) for t in (1, 2) for i in range(7)] + [(3, 1.0, 1.0, 5, *map(float, xy[5]), 1.0, 1)]
    near = spark.createDataFrame(rows, "target long, tx double, ty double, id long, x double, y double, value double, variable int")
    sill, nugget = np.array([[1.0, 0.6], [0.6, 0.9]]), np.array([[0.1, 0.0], [0.0, 0.2]])
    found = {r.target: r for r in M.cokriging(near, [("exponential", 70.0, sill.tolist())], nugget.tolist()).collect()}
    cov = lambda d, a, b: sill[a, b] * np.exp(-3 * d / 70) + nugget[a, b] * (d == 0)
    for t in (1, 2):
        goal, system, right = np.array([30.0 + t, 50.0]), np.zeros((9, 9)), np.zeros(9)
        for i in range(7):
            for j in range(7):
                system[i, j] = cov(np.linalg.norm(xy[i] - xy[j]), kind[i], kind[j])
            system[i, 7 + kind[i]] = system[7 + kind[i], i] = 1
            right[i] = cov(np.linalg.norm(xy[i] - goal), kind[i], 0)
        right[7] = 1
        w = np.linalg.solve(system, right)
        assert (found[t].estimate, found[t].variance) == pytest.approx((w[:7] @ value, 1.1 - w @ right)) and found[t].primary == 4
    assert (found[3].status, found[3].estimate, found[3].primary) == ("failed", None, 0)


def test_variants_differ_in_their_neighbours(spark):
    points = spark.createDataFrame([(i, i % 5, float(i % 4) * 10, float(i // 4) * 10, float(i * i % 7)) for i in range(24)], "id long, hole long, x double, y double, value double")
    found = M.variants(points, points, {"a": {"per_hole": 1, "most": 3}, "b": {"per_hole": 2, "most": 6, "every": 2}}, 10.0, (1.0, 30.0, 0.1)).collect()
    assert {r.samples for r in found if r.variant == "a"} == {3} and {r.samples for r in found if r.variant == "b"} == {6} and len(found) == 48
