"""Places on arcs, paths from the collar, seeded cuts."""

import math

import pytest
from stratalake.operators import geometry as G, imports, matching


def test_places_on_an_arc_and_below(spark):
    stations = spark.createDataFrame([("a", 0.0, 0.0, -90.0), ("a", 100.0, 0.0, 0.0), ("b", 10.0, 90.0, -45.0), ("o", 0.0, 0.0, -90.0), ("o", 10.0, 0.0, 90.0)], "hole string, md double, azimuth double, dip double")
    depths = spark.createDataFrame([("a", 1, 50.0), ("a", 2, 100.0), ("a", 3, 130.0), ("a", 4, 0.0), ("b", 5, 5.0), ("b", 6, 12.0), ("c", 7, 1.0), ("o", 8, 5.0), ("a", 9, None)], "hole string, id long, md double")
    found = {r.id: r for r in G.positions_at(stations, depths).collect()}
    radius = 100 / (math.pi / 2)
    assert (found[1].y, found[1].z) == pytest.approx((radius * (1 - math.cos(math.pi / 4)), -radius * math.sin(math.pi / 4)))
    assert (found[2].y, found[2].z) == pytest.approx((radius, -radius)) and (found[3].y, found[3].z) == pytest.approx((radius + 30, -radius))
    assert found[3].extended and not found[1].extended and (found[4].x, found[4].y, found[4].z) == (0, 0, 0)
    assert found[5].x is None and found[6].x == pytest.approx(2 * math.sqrt(0.5)) and found[7].x is None and found[8].x is None and found[9].x is None
    assert len(found) == 9


def test_paths_start_at_the_collar(spark):
    readings = spark.createDataFrame([("t", 30.0, 90.0, -60.0), ("t", 60.0, 90.0, -60.0), ("c", 20.0, 0.0, -70.0), ("x", 10.0, 0.0, -60.0), ("x", 10.0, 5.0, -60.0)], "hole string, md double, azimuth double, dip double")
    collars = spark.createDataFrame([("t", None, None, 60.0), ("c", 0.0, -80.0, 40.0), ("d", 180.0, -45.0, 10.0), ("v", None, None, 9.0), ("x", 0.0, -60.0, 50.0)], "hole string, azimuth double, dip double, depth double")
    grouped = imports.station_groups(readings)
    decisions = imports.trajectory_decisions(collars, grouped, readings.selectExpr("hole", "md AS deepest").limit(0), "tangent", "vertical")
    found = sorted((r.hole, r.md, r.azimuth, r.dip) for r in G.full_stations(collars, grouped, decisions).collect())
    assert found == [("c", 0.0, 0.0, -80.0), ("c", 20.0, 0.0, -70.0), ("d", 0.0, 180.0, -45.0), ("t", 0.0, 90.0, -60.0), ("t", 30.0, 90.0, -60.0), ("t", 60.0, 90.0, -60.0), ("v", 0.0, 0.0, -90.0)]


def test_cut_has_exact_sizes(spark):
    ids = spark.range(107).union(spark.range(5)).selectExpr("id")
    shares = {"train": 0.6, "validation": 0.15, "calibration": 0.1, "test": 0.15}
    found = dict(map(tuple, matching.permutation_cut(ids, shares, "s").collect()))
    sizes = [sum(v == name for v in found.values()) for name in shares]
    assert len(found) == 107 and sizes == [64, 16, 11, 16] and found != dict(map(tuple, matching.permutation_cut(ids, shares, "r").collect()))
    assert matching.permutation_cut(ids.where("false"), shares, "s").count() == 0
