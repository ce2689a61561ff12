"""Anchored composites, family programs and split schemes against authored truth."""

import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from stratalake.operators import anchored, families as P
from stratalake.plans import catalog

from tests.conftest import SMALL


def supports(spark, rows):
    return spark.createDataFrame([(f"{h}{i}", h, i, float(a), float(b), "interval" if b > a else "point", e, v) for h, i, a, b, e, v in rows], "id string, hole string, sample int, from_md double, to_md double, kind string, analyte string, value double")


def test_composites_start_at_the_first_depth(spark):
    rows = supports(spark, [("a", 1, 3, 4, "Fe", 2.0), ("a", 2, 4, 6, "Fe", 5.0), ("a", 3, 7, 9, "Fe", 3.0), ("a", 4, 3, 4, "Cu", 1.0), ("b", 1, 0, 0.4, "Fe", 1.0), ("b", 2, 0.4, 1.0, "Fe", None)])
    found = {(r.hole, r.length, r.k, r.analyte): r for r in P.anchored_composites(rows, [2.0, 10.0], 0.75).collect()}
    fe = [found["a", 2.0, k, "Fe"] for k in range(3)]
    assert [(r.lo, r.hi, r.covered, r.numerator, r.status) for r in fe] == [(3, 5, 2, 7, "full"), (5, 7, 1, 5, "insufficient"), (7, 9, 2, 6, "full")]
    assert [r["mean"] for r in fe] == [3.5, None, 3.0] and [r.observed for r in fe] == [None, 5.0, None] and [r.parents for r in fe] == [[1, 2], [2], [3]]
    assert sum(r.numerator for r in fe) == 18 == found["a", 10.0, 0, "Fe"].numerator and found["a", 10.0, 0, "Fe"].status == "residual"
    assert found["a", 2.0, 2, "Cu"].parents == [] and found["a", 2.0, 2, "Cu"].status == "insufficient"
    one = found["b", 2.0, 0, "Fe"]
    assert (one.covered, one.status, one.observed) == (pytest.approx(0.4), "insufficient", pytest.approx(1.0))
    assert P.anchored_composites(rows.where("false"), [2.0], 0.75).count() == 0


def test_fixture_lengths(spark):
    long = supports(spark, [("h", 1, 0, 2, "Fe", 1.0), ("h", 2, 2, 5, "Fe", 3.0)])
    (five,) = P.anchored_composites(long, [5.0], 0.75).collect()
    assert (five["mean"], five.status) == (2.2, "full")
    parts = P.anchored_composites(supports(spark, [("h", 1, 0, 5.5, "Fe", 1.0)]), [2.0], 0.5).orderBy("k").collect()
    assert [(r.status, r.lo, r.hi) for r in parts] == [("full", 0, 2), ("full", 2, 4), ("residual", 4, 5.5)]
    (gap,) = P.anchored_composites(supports(spark, [("h", 1, 0, 1, "Fe", 2.0), ("h", 2, 2, 3, "Fe", 4.0)]), [3.0], 0.75).collect()
    assert (gap["mean"], gap.observed, round(gap.covered / 3, 9)) == (None, 3.0, round(2 / 3, 9))


def test_imported_family(spark):
    rows = supports(spark, [("a", 1, 0, 1, "Fe", 2.0), ("a", 2, 1, 2, "Fe", 5.0), ("a", 3, 1, 2, "Fe", 6.0), ("b", 4, 5, 5, "Cu", 1.0), ("b", 5, 0, 1, "Cu", 4.0)])
    collars = spark.createDataFrame([("a", 1.5), ("b", None)], "hole string, depth double")
    out = P.run_family(P.imported_family("demo", ["Fe", "Cu"], (1.0,), 1.0), rows.where("kind = 'interval'"), collars)
    counts = {r.population: (r.members, r.holes) for r in out["counts"].collect()}
    assert counts == {"demo-Fe-native": (3, 1), "demo-Fe-1m": (2, 1), "demo-Cu-native": (1, 1), "demo-Cu-1m": (1, 1)}
    assert [(r.hole, r.ids) for r in out["repeats"].collect()] == [("a", ["a2", "a3"])] and sorted(r.id for r in out["beyond"].collect()) == ["a2", "a3"]
    steps = {r.step: (r.n, r.full) for r in out["waterfall"].collect()}
    assert steps == {"supports": (4, None), "repeated intervals": (1, None), "beyond depth": (2, None), "1 m composites": (3, 3)}
    refused = P.run_family(P.Family("one", populations=(P.Population("x", "estimation", refused="one hole"),)), rows, collars)
    assert [tuple(r) for r in refused["counts"].collect()] == [("x", "estimation", 0, 0, "one hole")]


def test_schemes_of_a_grid(spark):
    grid = spark.createDataFrame([(f"h{i}{j}", 100.0 * i, 100.0 * j) for i in range(5) for j in range(5)], "hole string, x double, y double")
    schemes, why = P.split_schemes(grid, "s", ["h22"])
    assert why is None
    found = {}
    for r in schemes.collect():
        found.setdefault(r.scheme, {})[r.hole] = r.split
    assert all(len(v) == 25 for v in found.values()) and set(found) == {"hole-group", "spatial-margin", "declared"}
    size = lambda s: {k: sum(x == k for x in found[s].values()) for k in ("train", "validation", "calibration", "test", "buffered")}
    assert size("hole-group") == {"train": 15, "validation": 4, "calibration": 2, "test": 4, "buffered": 0}
    corners = {"h00", "h04", "h40", "h44"}
    assert {h for h, s in found["spatial-margin"].items() if s == "test"} == corners and size("spatial-margin")["buffered"] == 12
    assert found["declared"]["h22"] == "test" and size("declared")["test"] == 1
    with pytest.raises(ValueError, match="nowhere"):
        P.split_schemes(grid, "s", ["nowhere"])
    few, why = P.split_schemes(grid.limit(3), "s")
    assert few.count() == 0 and why.startswith("3 holes")
    samples = grid.select(F.concat("hole", F.lit("-1")).alias("id"), "hole")
    rows = P.scheme_membership(schemes, {"samples": samples}).collect()
    assert sum(r.rows for r in rows if r.scheme == "spatial-margin") == 13 and sum(r.rows for r in rows if r.scheme == "declared") == 25
    again = {(r.scheme, r.split): r.digest for r in P.scheme_membership(schemes, {"samples": samples.repartition(5)}).collect()}
    assert again == {(r.scheme, r.split): r.digest for r in rows}


def shuffled(spark, run):
    """Rows that `run` wrote to shuffles."""
    context, group = spark.sparkContext, f"shuffled-{random.random()}"
    context.setJobGroup(group, group)
    try:
        run()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    store, tracker = context._jsc.sc().statusStore(), context.statusTracker()
    return sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds})


#: Rows besides the supports, which each query deals out once: collars; collars and ids; none; holes of a population, three of which each hole may be in.
BESIDE = {"t4_waterfall": ("orders", "lineitem"), "t4_beyond_depth": ("orders",), "t4_populations": (), "t4_population_counts": ("orders",) * 3, "t4_composites": ()}


@pytest.mark.parametrize("name", BESIDE)
def test_supports_are_shuffled_once_and_no_composite(spark, name, monkeypatch):
    """Nothing is kept in the shared folder, and composites, many times as many as samples, pass through no shuffle."""
    monkeypatch.setattr(P, "written", lambda df: pytest.fail("a table is written"))
    n = {t: spark.read.parquet(f"{SMALL}/{t}.parquet").count() for t in ("lineitem", "orders")}
    found = shuffled(spark, lambda: catalog.queries()[name](spark, SMALL).write.format("noop").mode("overwrite").save())
    assert n["lineitem"] <= found <= n["lineitem"] + sum(n[t] for t in BESIDE[name]) + 200


def brute(rows, lengths, least):
    """Every composite compared with every sample, by hole and analyte."""
    found, eps = {}, 1e-9
    for h in {r[0] for r in rows}:
        of = [r for r in rows if r[0] == h]
        first, deep = min(r[2] for r in of), max(r[3] for r in of)
        for analyte in {r[4] for r in of} - {None}:
            for length in lengths:
                for k in range(max(math.ceil((deep - first) / length - eps), 1)):
                    lo, hi = first + k * length, min(first + k * length + length, deep)
                    parts = [(s, v, min(b, hi) - max(a, lo)) for _, s, a, b, e, v in of if e == analyte and v is not None and min(b, hi) - max(a, lo) > eps]
                    covered, numerator = sum(p for *_, p in parts), sum(v * p for _, v, p in parts)
                    enough = covered / (hi - lo) >= least - eps
                    status = "insufficient" if not enough else "residual" if hi - lo < length - eps else "full"
                    found[h, length, k, analyte] = (round(lo, 6), round(hi, 6), round(numerator, 6), round(covered, 6), sorted(s for s, *_ in parts), enough, status)
    return found


def test_composites_of_any_batches(spark, monkeypatch):
    """The same as all pairs where holes lie in several batches, samples overlap, leave gaps, reach over many composites or have no value."""
    draw = random.Random(4)
    rows = []
    for h in ("a", "b", "c", "d", "e"):
        for i in range(1, 41):
            a = draw.choice([0.0, 7.5, round(draw.uniform(0, 60), 2)]) + 3
            rows.append((h, i, a, a + draw.choice([0.01, 1.0, round(draw.uniform(0.1, 4), 2), 45.0]), draw.choice(["Fe", "Cu", "Au", None]), draw.choice([None, round(draw.uniform(0, 9), 2)])))
    table = spark.createDataFrame([(f"{h}{i}", h, i, a, b, "interval", e, v) for h, i, a, b, e, v in rows], supports(spark, []).schema)
    expected = brute(rows, [2.0, 9.5], 0.6)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in (1, 3, 10000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = P.anchored_composites(table.repartition(3), [2.0, 9.5], 0.6).collect()
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        assert len(got) == len(expected)
        for r in got:
            enough = r.status != "insufficient"
            assert (round(r.lo, 6), round(r.hi, 6), round(r.numerator, 6), round(r.covered, 6), r.parents, enough, r.status) == expected[r.hole, r.length, r.k, r.analyte]
            assert (r["mean"] is None) == (not enough) and (r.observed is None) == (enough or not r.parents)


def test_a_hole_is_not_held_whole(monkeypatch):
    """Composites of one long hole come as its samples pass; blocks of any size give the same."""

    def run():
        taken, out = [0], []

        def batches():
            for n in range(50):
                taken[0] += 1
                at = [float(n * 100 + i) for i in range(100)]
                yield pa.RecordBatch.from_pydict({"hole": ["h"] * 100, "analyte": ["Fe"] * 100, "sample": [n * 100 + i for i in range(100)], "from_md": at, "to_md": [a + 1 for a in at], "value": [1.0] * 100, "first": [0.0] * 100, "deep": [5000.0] * 100})

        for b in anchored.passing((10.0, 130.0), 1e-9)(batches()):
            out += [(r["length"], r["k"], r["numerator"], r["covered"], tuple(r["parents"]), taken[0]) for r in b.to_pylist()]
        return out

    got = run()
    assert len(got) == 500 + 39 and len({r[:2] for r in got}) == len(got)
    for length, k, numerator, covered, parents, taken in got:
        end = min((k + 1) * length, 5000)
        assert covered == numerator == len(parents) == end - k * length and parents == tuple(range(int(k * length), int(end)))
        assert taken <= end // 100 + 2
    monkeypatch.setattr(anchored, "BLOCK", 7)
    assert [r[:5] for r in run()] == [r[:5] for r in got]


def test_tables_of_a_family_meet(spark):
    """Tables that read the same supports may be joined and united; ids of several holes are several records beyond depth."""
    rows = supports(spark, [("a", 1, 0, 1, "Fe", 2.0), ("a", 2, 1, 2, "Fe", 5.0), ("b", 3, 0, 4, "Cu", 4.0), ("b", 3, 0, 4, "Fe", None)])
    collars = spark.createDataFrame([("a", 1.5), ("a", 1.7), ("b", 2.0)], "hole string, depth double")
    out = P.run_family(P.imported_family("demo", ["Fe"], (1.0,), 1.0), rows.withColumn("id", F.lit("one")), collars)
    assert sorted(tuple(r) for r in out["beyond"].collect()) == [("one", "a"), ("one", "b")] and out["repeats"].count() == 0
    met = out["populations"].join(out["counts"], "population").join(out["beyond"], "hole")
    assert {(r.population, r.hole, r.members) for r in met.collect()} == {("demo-Fe-native", "a", 2), ("demo-Fe-native", "b", 2), ("demo-Fe-1m", "a", 2)}
    assert {r.step: r.n for r in out["waterfall"].collect()} == {"supports": 1, "repeated intervals": 0, "beyond depth": 2, "1 m composites": 10}
