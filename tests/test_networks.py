"""Networks: slopes against differences, the optimiser by hand, repeatable seeds, controls, the linear bottleneck against principal axes."""

import numpy as np
import pytest
from stratalake.operators import networks as N


def differences(net, w, x, y):
    out = []
    for i, a in enumerate(w):
        g = np.zeros_like(a)
        for at in np.ndindex(a.shape):
            for sign in (1, -1):
                moved = [b.copy() for b in w]
                moved[i][at] += sign * 1e-6
                g[at] += sign * ((net.run(moved, x)[0] - y) ** 2).mean() / 2e-6
        out.append(g)
    return out


@pytest.mark.parametrize("net", [N.Dense((4, 6, 5, 1)), N.autoencoder(4, 2), N.autoencoder(4, 2, linear=True), N.Graph(3, 5)])
def test_slopes(net):
    rng = np.random.default_rng(1)
    if isinstance(net, N.Graph):
        x = (rng.normal(size=(7, 4, 3)), rng.uniform(size=(7, 4, 4)))
        y = rng.normal(size=(7, 1))
    else:
        x = (rng.normal(size=(7, 4)),)
        y = rng.normal(size=(7, net.widths[-1]))
    w = [a + 0.01 for a in net.start(rng)]
    out, kept = net.run(w, x)
    error = out - y
    for got, wanted in zip(net.slopes(w, x, kept, 2 * error / error.size), differences(net, w, x, y)):
        assert np.allclose(got, wanted, atol=1e-6)


def test_steps_by_hand():
    w = [np.array([2.0])]
    o = N.AdamW(w, rate=0.1, decay=0.01)
    o.step(w, [np.array([0.5])])
    assert np.isclose(w[0][0], 2 * (1 - 0.001) - 0.1 * 0.5 / (0.5 + 1e-8))


def rows(spark, n, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.uniform(-1, 1, (n, 3))
    y = np.sin(2 * x[:, 0]) + x[:, 1] ** 2 + 0.05 * rng.normal(size=n)
    return spark.createDataFrame([(i, i // 20, list(map(float, a)), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, hole long, features array<double>, target double"), x, y


def test_search_controls_and_ensembles(spark):
    table, x, y = rows(spark, 400)
    odd = spark.createDataFrame([(900, 1, [None, 1.0, 1.0], 1.0), (901, 1, [1.0, 1.0, 1.0], None)], table.schema)
    train, check = N.bounded_rows(table.where("id < 300").unionByName(odd)), N.bounded_rows(table.where("id >= 300"))
    assert len(train.y) == 300 and len(N.bounded_rows(table, most=50).y) == 50 and N.bounded_rows(table, most=50).left_out == 350
    nets = {"wide": N.Dense((3, 24, 24, 1)), "flat": N.Dense((3, 1))}
    fits = N.fit_all(spark, nets, train, check, epochs=120, patience=15, rate=5e-3)
    again = {(r.configuration, r.seed): (r.objective, r.weights) for r in N.fit_all(spark, nets, train, check, epochs=120, patience=15, rate=5e-3).collect()}
    held = fits.collect()
    assert len(held) == 6 and all(again[r.configuration, r.seed] == (r.objective, r.weights) for r in held)
    assert all(r.best_epoch <= r.epochs <= min(120, r.best_epoch + 15) and r.history[r.best_epoch - 1] == r.objective == min(r.history) for r in held)
    best = N.chosen(spark.createDataFrame(held, N.FITS)).first()
    assert best.configuration == "wide"
    control = N.fit_all(spark, {"wide": nets["wide"]}, train, check, epochs=60, patience=15, shuffled=5, rate=5e-3).collect()
    plain = N.hole_rmse(train.y.mean() - check.y, check.holes)
    assert best.objective < 0.5 * plain and all(r.labels == "shuffled" and r.objective > 0.85 * plain for r in control)
    weights = {r.seed: N.unpacked(r.weights) for r in held if r.configuration == "wide"}
    found = {r.id: r for r in N.ensemble(table.unionByName(odd), nets["wide"], weights, scale=2.0, shift=1.0).collect()}
    each = np.array([nets["wide"].run(weights[s], (x,))[0][:, 0] * 2 + 1 for s in sorted(weights)]).T
    assert all(np.allclose(found[i].estimates, each[i]) and np.isclose(found[i].mean, each[i].mean()) and np.isclose(found[i].spread, each[i].std()) for i in range(400))
    assert found[900].mean is None


def test_linear_bottleneck_equals_principal_axes(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 5)) @ np.diag([3, 2, 0.5, 0.3, 0.1]) @ np.linalg.qr(rng.normal(size=(5, 5)))[0]
    net, holes = N.autoencoder(5, 2, linear=True), np.arange(300) // 10
    f = N.fit(net, (x,), x, (x,), x, holes, 7, 1500, 1500, rate=5e-3, batch=300)
    middle = x.mean(0)
    axes = np.linalg.svd(x - middle, full_matrices=False)[2][:2]
    best = ((x - middle - (x - middle) @ axes.T @ axes) ** 2).mean(1)
    table = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)] + [(999, [None, 1.0, 1.0, 1.0, 1.0])], "id long, features array<double>")
    scored = N.reconstruction(table, net, {7: f["weights"]}, list("abcde"))
    got = {r.id: r for r in scored.collect()}
    assert 999 not in got and np.isclose(np.mean([r.score for r in got.values()]), best.mean(), rtol=0.02)
    assert np.isclose(got[3].score, np.mean(list(got[3].residuals.values()))) and list(got[3].residuals) == list("abcde")
    by_property, top = N.residual_summary(scored, 3)
    assert {r.property: r.n for r in by_property.collect()} == dict.fromkeys("abcde", 300)
    highest = top.collect()
    assert [r.id for r in highest] == [i for i, _ in sorted(got.items(), key=lambda kv: -kv[1].score)][:3]
    assert all(got[r.id].residuals[r.worst] == max(got[r.id].residuals.values()) for r in highest)
    with pytest.raises(ValueError):
        N.autoencoder(3, 3)


def test_adjacency_and_bands(spark):
    rng = np.random.default_rng(4)
    xy = rng.uniform(0, 10, (5, 2))
    nodes = spark.createDataFrame([(t, i, *map(float, p + t)) for t in (0, 1) for i, p in enumerate(xy)], "target long, node long, x double, y double")
    a = np.exp(-((xy[:, None] - xy) ** 2).sum(2) / (2 * 4.0**2)) + np.eye(5)
    d = a.sum(1)
    for r in N.normalized_adjacency(nodes, 4.0).collect():
        assert np.isclose(r.weight, a[r.a, r.b] / np.sqrt(d[r.a] * d[r.b]))
    (band,) = N.residual_bands(spark.createDataFrame([(float(i), 0.0) for i in range(101)] + [(None, 1.0)], "truth double, mean double"), []).collect()
    assert band.n == 101 and np.allclose([band.low, band.high], [5, 95])
