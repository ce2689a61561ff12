"""All methods for every target: uninformed, prior-only and failed ones have rows."""

from stratalake.operators import methods as M


def test_every_method_has_a_row_for_every_target(spark):
    observed = spark.createDataFrame([(1, 1, 0.0, 0.0, 3.0), (2, 2, 10.0, 0.0, 5.0), (3, 3, 0.0, 10.0, 4.0), (4, 4, 9.0, 9.0, None)], "id long, hole long, x double, y double, value double")
    targets = spark.createDataFrame([(100, 2.0, 2.0), (101, 900.0, 900.0), (102, None, 1.0)], "id long, x double, y double")
    fitted = M.Fitted((1.0, 50.0, 0.1), 2.0, None, ([("spherical", 50.0, [[1.0, 0.3], [0.3, 1.0]])], [[0.1, 0.0], [0.0, 0.1]]), {3.5: (0.25, 50.0, 0.01)}, {"universal-kriging": "flat residuals"})
    other = observed.selectExpr("id + 50 AS id", "hole", "x", "y", "value * 2 AS value", "1 AS variable")
    found = {(r.method, r.target): r for r in M.run_methods(targets, observed, fitted, 2, 8, 50.0, radius=50.0, least=2, secondary=other).collect()}
    assert set(found) == {(m, t) for m in M.METHODS for t in (100, 101, 102)}
    assert found["nearest-neighbour", 100].estimate == 3.0 and found["inverse-distance", 100].samples == 3
    for m in ("nearest-neighbour", "inverse-distance", "ordinary-kriging", "ordinary-cokriging", "multiple-indicator"):
        assert found[m, 100].status == "estimated" and {found[m, t].status for t in (101, 102)} == {"uninformed"} and found[m, 101].estimate is None
    assert 0 <= found["multiple-indicator", 100].probabilities[0] <= 1
    far = found["simple-kriging", 101]
    assert (far.status, far.estimate, far.variance, far.samples) == ("prior-only", 2.0, 1.1, 0) and found["simple-kriging", 100].status == "estimated"
    assert {(found["universal-kriging", t].status, found["universal-kriging", t].reason) for t in (100, 101, 102)} == {("failed", "flat residuals")}
    assert {found["sequential-gaussian", t].status for t in (100, 101, 102)} == {"failed"}
    twice = observed.unionByName(spark.createDataFrame([(9, 9, 0.0, 0.0, 7.0)], observed.schema))
    rows = {r.method: r for r in M.run_methods(targets.where("id = 100"), twice, M.Fitted((1.0, 50.0, 0.0)), 2, 8, 50.0).collect()}
    assert (rows["ordinary-kriging"].status, rows["ordinary-kriging"].reason) == ("failed", "singular system")
    assert rows["simple-kriging"].reason == "no covariance model" and rows["ordinary-cokriging"].reason == "no secondary variables"
