"""Pairs of boxes against all pairs, pieces cut at cells against fine steps."""

import itertools
import random

import numpy as np
from stratalake.operators import boxes as B, traces as T


def padded(a, b, least):
    m = max(least, *((x[i + 1] - x[i]) / 2 for x in (a, b) for i in (0, 2)))
    return a[0] - m <= b[1] and b[0] - m <= a[1] and a[2] - m <= b[3] and b[2] - m <= a[3]


def test_boxes_of_all_sizes(spark):
    rng = random.Random(1)
    rows = []
    for i in range(120):
        x, y, w, h = rng.uniform(-3e4, 3e4), rng.uniform(-3e4, 3e4), *(rng.choice([0, 10, 900, 5000, 40000]) * rng.random() for _ in range(2))
        rows.append((f"f{i:03d}", x, x + w, y, y + h))
    boxes = spark.createDataFrame(rows, "file string, x0 double, x1 double, y0 double, y1 double")
    met = [(r.file, r.file_2) for r in B.box_pairs(boxes, boxes, least=500.0).collect()]
    assert len(met) == len(set(met)) and set(met) == {(a[0], b[0]) for a, b in itertools.product(rows, rows) if padded(a[1:], b[1:], 500.0)}
    turned = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if not padded(a[1:], b[1:], 500.0) and padded(a[1:], (b[3], b[4], b[1], b[2]), 500.0)}
    assert {(r.file, r.file_2) for r in B.swapped_axes(boxes, least=500.0).collect()} == turned and turned
    assert B.swapped_axes(boxes.where("false")).count() == 0


def test_swapped_file(spark):
    points = [("a", 500000.0, 7000000.0), ("a", 501000.0, 7000500.0), ("b", 7000100.0, 500300.0), ("c", 500100.0, 7000100.0), ("d", None, 1.0), ("d", float("nan"), 1.0)]
    boxes = B.file_boxes(spark.createDataFrame(points, "file string, x double, y double"))
    assert sorted(r.file for r in boxes.collect()) == ["a", "b", "c"]
    assert sorted(map(tuple, B.swapped_axes(boxes).collect())) == [("a", "b"), ("b", "c")]


def test_parts_add_up_and_lie_in_their_cells(spark):
    rng = np.random.default_rng(2)
    ends = rng.uniform(-60, 60, (40, 6))
    ends[0, 3:] = ends[0, :3]
    ends[1] = [0, 0, 0, 30, 30, 30]
    ends[2] = [5, -3, 2, 5, 40, 2]
    ends[3] = [0, 0, 0, 60000, 1, 1]
    rows = [(i, "h", "c", *map(float, e)) for i, e in enumerate(ends)] + [(90, "h", "c", None, 0.0, 0.0, 1.0, 1.0, 1.0)]
    pieces = spark.createDataFrame(rows, "id int, hole string, category string, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    cell, origin = (10.0, 7.0, 3.0), (1.0, 0.0, -2.0)
    parts = T.cut_at_cells(pieces, cell, origin).collect()
    assert {p.id for p in parts} == set(range(1, 40))
    for i in range(1, 40):
        own = [p for p in parts if p.id == i]
        assert np.isclose(sum(p.length for p in own), np.linalg.norm(ends[i, 3:] - ends[i, :3]))
        if i == 3:
            assert len(own) > 5999
            continue
        t = (np.arange(200_000) + 0.5) / 200_000
        at = np.floor((ends[i, :3] + t[:, None] * (ends[i, 3:] - ends[i, :3]) - origin) / cell)
        kinds, counts = np.unique(at, axis=0, return_counts=True)
        step = np.linalg.norm(ends[i, 3:] - ends[i, :3]) / 200_000
        fine = {tuple(map(int, k)): n * step for k, n in zip(kinds, counts)}
        got = {}
        for p in own:
            got[p.ci, p.cj, p.ck] = got.get((p.ci, p.cj, p.ck), 0) + p.length
        assert all(abs(got.get(k, 0) - fine.get(k, 0)) < 4 * step for k in got | fine)


def test_mapped_cells_and_pieces_of_a_path(spark):
    path = spark.createDataFrame([("a", 0.0, 0.0, 0.0, 0.0), ("a", 10.0, 0.0, 0.0, -10.0), ("a", 20.0, 6.0, 0.0, -18.0), ("b", 0.0, 0.0, 0.0, 0.0)], "hole string, md double, x double, y double, z double")
    pieces = T.straight_pieces(path)
    assert sorted((r.hole, r.md) for r in pieces.collect()) == [("a", 0.0), ("a", 10.0)]
    from pyspark.sql import functions as F

    cells = T.mapped_cells(pieces.withColumn("category", F.lit("x")), (4.0, 4.0, 5.0))
    assert np.isclose(sum(r.length for r in cells.collect()), 20.0)
    assert T.mapped_cells(pieces.withColumn("category", F.lit(None).cast("string")), (4.0, 4.0, 5.0)).count() == 0
