"""Composites on the fixtures F23 to F25 of FIXTURES.md, fractional depths and gaps."""

import pytest
from stratalake.operators.intervals import composites


def rows_of(spark, rows, length, least=0.75):
    table = spark.createDataFrame(rows, "hole string, analyte string, from_md double, to_md double, value double")
    return {(r.hole, r.analyte, r.k): r for r in composites(table, length, least).collect()}


def test_fixtures(spark):
    (r,) = rows_of(spark, [("a", "Cu", 0.0, 2.0, 1.0), ("a", "Cu", 2.0, 5.0, 3.0)], 5.0).values()
    assert (r.mean, r.status, r.parents) == (pytest.approx(2.2), "full", 2)
    (r,) = rows_of(spark, [("a", "Cu", 0.0, 1.0, 2.0), ("a", "Cu", 2.0, 3.0, 4.0)], 3.0).values()
    assert (r.mean, r.status) == (None, "insufficient") and r.covered / (r.hi - r.lo) == pytest.approx(2 / 3) and r.numerator / r.covered == 3
    found = rows_of(spark, [("a", "Cu", 0.0, 5.5, 1.0)], 2.0)
    assert [(found["a", "Cu", k].lo, found["a", "Cu", k].hi, found["a", "Cu", k].status) for k in range(3)] == [(0, 2, "full"), (2, 4, "full"), (4, 5.5, "residual")]


def test_fractional_depths_and_small_grades(spark):
    found = rows_of(spark, [("a", "Au", 0.0, 1.6, 0.004), ("a", "Au", 1.6, 2.0, 0.104), ("a", "Au", 2.0, 3.5, 1.0), ("a", "Au", 3.5, 4.0, 3.0)], 2.0)
    assert found["a", "Au", 0].mean == pytest.approx(0.024) and found["a", "Au", 0].numerator == pytest.approx(0.048)
    assert found["a", "Au", 1].mean == pytest.approx(1.5)
    found = rows_of(spark, [("a", "Au", 0.0, 0.7, 1.0)], 0.1)
    assert len(found) == 7 and {r.status for r in found.values()} == {"full"}


def test_gaps_are_insufficient(spark):
    found = rows_of(spark, [("a", "Cu", 0.0, 2.0, 1.0), ("a", "Cu", 4.0, 6.0, 5.0), ("a", "Au", 4.0, 6.0, None), ("b", "Zn", 0.0, 2.0, 1.0)], 2.0, 0.0)
    assert sorted(found) == [("a", "Au", 0), ("a", "Au", 1), ("a", "Au", 2), ("a", "Cu", 0), ("a", "Cu", 1), ("a", "Cu", 2), ("b", "Zn", 0)]
    for key in [("a", "Cu", 1), *(("a", "Au", k) for k in range(3))]:
        r = found[key]
        assert (r.numerator, r.covered, r.parents, r.mean, r.status) == (0, 0, 0, None, "insufficient")
