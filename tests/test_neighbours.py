"""Estimation returns every target, informed or not."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from stratalake.operators import spatial
from stratalake.plans import catalog

from tests.conftest import SMALL


def test_far_and_uninformed_targets(spark):
    observed = spark.createDataFrame([(i, i // 2, float(i), 0.0, float(i)) for i in range(6)] + [(9, 9, 5000.0, 0.0, 9.0)], "id long, hole long, x double, y double, value double")
    near = spatial.neighbourhoods(observed, observed, 2, 3, 10.0)
    found = {r.target: r for r in spatial.with_uninformed(observed, spatial.inverse_distance(near), near, 3).collect()}
    assert len(found) == 7 and found[9].status == "estimated" and (found[9].samples, found[9].holes) == (3, 2)
    near = spatial.neighbourhoods(observed, observed, 2, 3, 10.0, radius=10.0)
    found = {r.target: r for r in spatial.with_uninformed(observed, spatial.inverse_distance(near), near, 3).collect()}
    assert (found[9].status, found[9].samples, found[9].holes, found[9].estimate) == ("uninformed", 0, 0, None) and found[0].status == "estimated"


def test_kriging_returns_all_sites(spark):
    sites = {r.s_suppkey for r in spark.read.parquet(f"{SMALL}/supplier.parquet").select("s_suppkey").collect()}
    assert {r.target for r in catalog.queries()["t9_ordinary_kriging"](spark, SMALL).collect()} == sites


def brute(rows, per_hole, most, radius, other_holes):
    found = {}
    for i, h, x, y, _ in rows:
        near = sorted((round(math.hypot(x - a, y - b), 9), j, k) for j, k, a, b, _ in rows if j != i and not (other_holes and k == h) and (radius is None or math.hypot(x - a, y - b) <= radius))
        kept = []
        for d, j, k in near:
            if sum(k == other for *_, other in kept) < per_hole:
                kept.append((d, j, k))
        found[i] = [(j, d) for d, j, _ in kept[:most]]
    return found


def test_dense_and_sparse_places(spark):
    """Copies at one place, a dense cluster and far points: the same as all pairs, without meeting all pairs."""
    draw = random.Random(5)
    places = [(0.0, 0.0)] * 90 + [(draw.gauss(50, 0.01), draw.gauss(50, 0.01)) for _ in range(150)] + [(draw.uniform(0, 900), draw.uniform(0, 900)) for _ in range(100)] + [(float(i), 7.0) for i in range(40)]
    rows = [(i, draw.randrange(9), x, y, float(i)) for i, (x, y) in enumerate(places)]
    points = spark.createDataFrame(rows, "id long, hole long, x double, y double, value double")
    for per_hole, most, radius, other in ((2, 8, None, False), (2, 8, 100.0, False), (1, 1, 100.0, False), (2, 8, 100.0, True), (1, 3, None, True)):
        found = {i: [] for i, *_ in rows}
        for r in spatial.neighbourhoods(points, points, per_hole, most, 100.0, radius, other_holes=other).collect():
            found[r.target].append((r.nth, r.id, r.distance))
        assert {i: [(j, d) for _, j, d in sorted(v)] for i, v in found.items()} == brute(rows, per_hole, most, radius, other)
    assert spatial._first_of_places(points, 2, 8).where("x = 0 AND y = 0").count() <= 16
    widest = spatial._with_levels(points, points, 2, 8, 100.0 / 2**spatial.DEPTH).where("id >= 90 AND id < 240").agg({"level": "max"}).first()[0]
    assert widest <= spatial.DEPTH - 8  # cells of the cluster


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """3,000 sites, as dense as those of any number of copies: three times the suppliers with shifted keys."""
    folder = tmp_path_factory.mktemp("copies")
    one = spark.read.parquet(f"{os.path.dirname(SMALL)}/sf0.1/supplier.parquet")
    one.crossJoin(spark.range(3).toDF("copy")).withColumn("s_suppkey", F.col("s_suppkey") + F.col("copy") * 1000).drop("copy").write.parquet(f"{folder}/supplier.parquet")
    return str(folder)


def rows_of_joins(spark, first):
    """Rows that each join of the executions from `first` on gave, by its metrics."""
    store = spark._jsparkSession.sharedState().statusStore()
    for i in range(first, store.executionsCount()):
        run = store.executionsList().apply(i).executionId()
        nodes, values = store.planGraph(run).allNodes(), store.executionMetrics(run)
        for node in map(nodes.apply, range(nodes.size())):
            if "Join" in node.name():
                for metric in map(node.metrics().apply, range(node.metrics().size())):
                    if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                        yield int(values.apply(metric.accumulatorId()).replace(",", ""))


#: Queries over the neighbours of all sites, each found to meet all pairs within the first radius in one task.
QUERIES = ["t14_simple_methods", "t10_indicator_kriging", "t13_universal_with_retry", "t14_methods", "t15_variants", "t22_adjacency", "t22_graph_edges", "t9_cokriging", "t9_nearest_all", "t9_ordinary_kriging", "t9_universal_kriging", "t9_simple_kriging"]


@pytest.mark.parametrize("name", QUERIES)
def test_queries_meet_no_pairs_of_all_within_the_radius(spark, copies, name):
    """Some 300 sites lie within 1,500 of a site; a query's joins give a fraction of those pairs."""
    first = spark._jsparkSession.sharedState().statusStore().executionsCount()
    catalog.queries()[name](spark, copies).write.format("noop").mode("overwrite").save()
    assert max(rows_of_joins(spark, first)) < 100 * 3000


def test_rounds_of_several_tasks(spark, monkeypatch):
    """The same as all pairs where targets are dealt to many tasks and some need later rounds."""
    monkeypatch.setattr(spatial, "TARGETS", 32)
    draw = random.Random(6)
    places = [(draw.uniform(0, 300), draw.uniform(0, 300)) for _ in range(200)] + [(draw.uniform(1500, 3000), draw.uniform(0, 3000)) for _ in range(20)] + [(-700.0, -700.0)] * 30
    rows = [(i, draw.randrange(7), x, y, float(i)) for i, (x, y) in enumerate(places)]
    points = spark.createDataFrame(rows, "id long, hole long, x double, y double, value double")
    found = {i: [] for i, *_ in rows}
    for r in spatial.neighbourhoods(points, points, 2, 8, 100.0).collect():
        found[r.target].append((r.nth, r.id, r.distance))
    assert {i: [(j, d) for _, j, d in sorted(v)] for i, v in found.items()} == brute(rows, 2, 8, None, False)


def largest_task(spark, run):
    """The largest peak execution memory of a task of `run`, in bytes."""
    context, group = spark.sparkContext, f"largest-{random.random()}"
    context.setJobGroup(group, group)
    run()
    context.setLocalProperty("spark.jobGroup.id", None)
    store, tracker = context._jsc.sc().statusStore(), context.statusTracker()
    largest = 0
    for stage in {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}:
        tasks = store.taskList(stage, 0, 10000)  # none of a skipped stage
        for task in map(tasks.apply, range(tasks.size())):
            if task.taskMetrics().isDefined():
                largest = max(largest, task.taskMetrics().get().peakExecutionMemory())
    return largest


@pytest.mark.parametrize("name", ["t9_simple_kriging", "t22_graph_edges", "t9_cokriging", "t9_ordinary_kriging"])
def test_largest_task_does_not_grow_with_the_sites(spark, tmp_path, name):
    """Six times the sites take no more memory of a task; sites are as dense at both sizes."""
    one = spark.read.parquet(f"{os.path.dirname(SMALL)}/sf0.1/supplier.parquet")
    held = []
    for copies in (1, 6):
        folder = f"{tmp_path}/{copies}"
        one.crossJoin(spark.range(copies).toDF("copy")).withColumn("s_suppkey", F.col("s_suppkey") + F.col("copy") * 1000).drop("copy").write.parquet(f"{folder}/supplier.parquet")
        held.append(largest_task(spark, lambda: catalog.queries()[name](spark, folder).write.format("noop").mode("overwrite").save()))
    assert 0 < held[1] < 2 * held[0], held
