"""Strict files, trajectories, fragments, kriging and principal axes against authored truth and NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from stratalake.operators import evaluation as E, imports as I, intervals, spatial
from stratalake.sources.strict import Spec, read_manifest, scan


@pytest.fixture
def file(tmp_path):
    def write(name, text):
        (tmp_path / name).write_text(text, encoding="utf-8")
        return str(tmp_path / name)

    return write


@pytest.mark.parametrize(
    ("text", "code"),
    [("", "HEADER_BLANK"), ("A,,C\n1,2,3\n", "HEADER_BLANK"), ("A,B,A\n1,2,3\n", "HEADER_DUPLICATE"), ("A,X\n1,2\n", "COLUMN_MISSING"), ("A,B\n1,2\n3\n4,5\n", "ROW_RAGGED"), ("A,B\n1,2\n3,4,5\n", "ROW_RAGGED")],
)
def test_refused_files(spark, file, text, code):
    table, findings = scan(spark, Spec(file("a.csv", text), "assay", columns=("A", "B") if "X" in text else ()))
    assert table is None and [f[0] for f in findings] == [code]
    if code == "ROW_RAGGED":
        assert "row 3 " in findings[0][4]


def test_records_are_kept_as_written(spark, file):
    table, findings = scan(spark, Spec(file("a.csv", '﻿Hole;Au;Note\nD1;0,5;"two\nlines"\n\nD2;;"say ""no"""\n'), "assay", delimiter=";"))
    assert not findings and [tuple(r) for r in table.collect()] == [(2, "D1", "0,5", "two\nlines"), (3, "D2", "", 'say "no"')]
    assert [r[0] for r in table.select(I.decimal_number(F.col("Au"), ",")).collect()] == [0.5, None]


def test_manifest(spark, file):
    a, b, c = file("a.csv", "Hole,Cu\nD1,1\n"), file("b.csv", "Hole,Cu\nD1,1\n"), file("c.csv", "Hole,Zn\nD2,7\n")
    tables, findings = read_manifest(spark, [Spec(a, "assay"), Spec(b, "assay"), Spec(c, "assay"), Spec(b, "survey"), Spec(c, "collar", sha256="0" * 64)])
    assert sorted((r.Hole, r.Cu, r.Zn) for r in tables["assay"].collect()) == [("D1", "1", None), ("D2", None, "7")]
    assert tables["survey"].count() == 1 and "collar" not in tables
    assert sorted((r.code, r.severity) for r in findings.collect()) == [("FILE_DUPLICATE", "warning"), ("HASH_MISMATCH", "error")]


def test_a_path_given_twice(spark, file):
    a = file("a.csv", "Hole,Cu\nD1,1\n")
    tables, findings = read_manifest(spark, [Spec(a, "assay"), Spec(a, "assay"), Spec(a, "survey")])
    assert {role: t.count() for role, t in tables.items()} == {"assay": 1, "survey": 1}
    assert [(r.code, r.role) for r in findings.collect()] == [("FILE_DUPLICATE", "assay")]


def test_files_of_one_name_in_two_folders(spark, tmp_path):
    import hashlib

    paths = []
    for folder, text in (("a", "Hole,Cu\nD1,1\n"), ("b", "Hole,Cu\nD2,2\n"), ("c", "Hole,Cu\nD1,1\n")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.csv").write_text(text)
        paths.append((str(tmp_path / folder / "x.csv"), hashlib.sha256(text.encode()).hexdigest()))
    for pinned in (False, True):
        tables, findings = read_manifest(spark, [Spec(p, "assay", sha256=h if pinned else None) for p, h in paths])
        assert sorted((r.Hole, r.Cu) for r in tables["assay"].collect()) == [("D1", "1"), ("D2", "2")]
        assert [(r.code, r.file) for r in findings.collect()] == [("FILE_DUPLICATE", paths[2][0])]


def test_header_details(spark, file):
    _, findings = scan(spark, Spec(file("a.csv", "A, ,A,,B,B\n1,2,3,4,5,6\n"), "assay", columns=("Z",)))
    assert sorted((f[0], f[4]) for f in findings) == [("HEADER_BLANK", "2 | 4"), ("HEADER_DUPLICATE", "A | B")]
    _, findings = scan(spark, Spec(file("b.csv", "A,B\n1,2\n"), "assay", columns=("Z", "A", "Y")))
    assert [(f[0], f[4]) for f in findings] == [("COLUMN_MISSING", "Y | Z")]


def test_trajectories(spark):
    collars = spark.createDataFrame([("vertical", None, None, 100.0), ("collar", 90.0, -60.0, 30.0), ("tangent", None, None, None), ("conflict", 10.0, -50.0, 40.0), ("long", 0.0, -90.0, 30.0)], "hole string, azimuth double, dip double, depth double")
    readings = spark.createDataFrame([("tangent", 5.0, 90.0, -60.0), ("conflict", 0.0, 1.0, -50.0), ("conflict", 0.0, 2.0, -50.0), ("long", 0.0, 1.0, -50.0), ("long", 20.0, 1.0, -50.0), ("long", 20.0, 1.0, -50.0)], "hole string, md double, azimuth double, dip double")
    deepest = spark.createDataFrame([("tangent", 12.0)], "hole string, deepest double")
    stations = I.station_groups(readings)
    assert {(r.hole, r.md): r.finding for r in stations.collect()} == {("tangent", 5.0): None, ("conflict", 0.0): "SURVEY_DEPTH_CONFLICT", ("long", 0.0): None, ("long", 20.0): "RECORD_DUPLICATE"}
    strict = {r.hole: r for r in I.trajectory_decisions(collars, stations, deepest).collect()}
    assert strict["vertical"].blocked and strict["vertical"].codes == "SURVEY_MISSING_UNASSUMED"
    assert strict["tangent"].codes == "SURVEY_START_UNDECLARED" and strict["conflict"].blocked
    assert (strict["collar"].kind, strict["collar"].valid_to, strict["long"].codes) == ("collar-orientation", 30.0, "SURVEY_TRUNCATED")
    free = {r.hole: r for r in I.trajectory_decisions(collars, stations, deepest, "tangent", "vertical").collect()}
    assert (free["vertical"].kind, free["vertical"].valid_to) == ("assumed-vertical", 100.0)
    assert (free["tangent"].start, free["tangent"].valid_to, free["tangent"].codes) == ("tangent", 12.0, "SURVEY_START_EXTENDED,SURVEY_TRUNCATED")


def test_fragments(spark):
    logs = spark.createDataFrame([("h", 0.0, 3.0, "A"), ("h", 3.0, 5.0, "B")], "hole string, from_md double, to_md double, code string")
    samples = spark.createDataFrame([("h", 0.0, 2.0), ("h", 2.0, 5.0), ("h", 2.0, 5.0), ("other", 0.0, 1.0)], "hole string, from_md double, to_md double")
    assert sorted((r.lo, r.hi, r.codes) for r in I.overlay_fragments(samples, logs).collect()) == [(0.0, 2.0, "A"), (2.0, 3.0, "A"), (3.0, 5.0, "B")]


def test_composites(spark):
    def rows(*parts):
        return spark.createDataFrame([("h", a, b, "Cu", v, i) for i, (a, b, v) in enumerate(parts)], "hole string, from_md double, to_md double, analyte string, value double, sample int")

    (r,) = intervals.composites(rows((0.0, 2.0, 1.0), (2.0, 5.0, 3.0)), 5.0, 0.5).collect()
    assert np.isclose(r["mean"], 2.2) and r.status == "full"
    out = sorted(intervals.composites(rows((0.0, 1.0, 2.0), (1.0, 3.0, 5.0), (4.0, 6.0, 3.0)), 2.0, 0.75).collect(), key=lambda r: r.k)
    assert [r["mean"] for r in out] == [3.5, None, 3.0] and np.isclose(sum(r.numerator for r in out), 18)
    (r,) = intervals.composites(rows((0.0, 0.5, 2.0), (0.5, 2.0, 4.0)), 2.0, 0.5).collect()
    assert np.isclose(r["mean"], 3.5)


@pytest.mark.parametrize("kind", ["simple", "ordinary", "universal"])
def test_kriging(spark, kind):
    rng = np.random.default_rng(4)
    rows, truth = [], {}
    for target in range(12):
        n = int(rng.integers(4, 9))
        xy, value, goal = rng.uniform(0, 100, (n, 2)), rng.normal(5, 2, n), rng.uniform(0, 100, 2)
        if target == 0:
            xy[1] = xy[0]  # two samples at one place
        rows += [(target, float(goal[0]), float(goal[1]), i, float(p[0]), float(p[1]), float(v)) for i, (p, v) in enumerate(zip(xy, value))]
        reach = lambda h: np.where(h == 0, 1.2, np.where(h < 80, 1 - 1.5 * h / 80 + 0.5 * (h / 80) ** 3, 0))
        c, c0 = reach(np.linalg.norm(xy[:, None] - xy[None], axis=2)), reach(np.linalg.norm(xy - goal, axis=1))
        drift = {"simple": np.zeros((n, 0)), "ordinary": np.ones((n, 1)), "universal": np.column_stack([np.ones(n), xy])}[kind]
        at = {"simple": np.zeros(0), "ordinary": np.ones(1), "universal": np.append(1, goal)}[kind]
        k = drift.shape[1]
        system = np.block([[c, drift], [drift.T, np.zeros((k, k))]])
        weight = np.linalg.lstsq(system, np.append(c0, at), rcond=None)[0]
        shift = 5.0 if kind == "simple" else 0.0
        truth[target] = (shift + weight[:n] @ (value - shift), 1.2 - weight @ np.append(c0, at))
    table = spark.createDataFrame(rows, "target long, tx double, ty double, id long, x double, y double, value double")
    found = {r.target: r for r in spatial.kriging(table, 1.0, 80.0, 0.2, kind, 5.0).collect()}
    assert found[0].status == "failed" and found[0].estimate is None
    for target, (estimate, variance) in list(truth.items())[1:]:
        assert found[target].status == "estimated" and np.isclose(found[target].estimate, estimate) and np.isclose(found[target].variance, variance)


def test_plane_through_few_points_fails(spark):
    line = spark.createDataFrame([(1, 5.0, 5.0, i, float(i), float(i), 1.0) for i in range(5)], "target long, tx double, ty double, id long, x double, y double, value double")
    (r,) = spatial.kriging(line, 1.0, 80.0, 0.2, "universal").collect()
    assert r.status == "failed"


def test_principal_axes(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4))
    table = spark.createDataFrame(x.tolist() + [[None, 1.0, 1.0, 1.0]], "a double, b double, c double, d double")
    means, axes, variances = E.principal_axes(table, list("abcd"), 2)
    centred = x - x.mean(0)
    _, s, v = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(variances, s[:2] ** 2 / 300) and np.allclose(abs(axes @ v[:2].T), np.eye(2), atol=1e-8)
    left = ((centred - centred @ v[:2].T @ v[:2]) ** 2).mean(1)
    scores = [r[0] for r in table.dropna().select(E.reconstruction_score(list("abcd"), means, axes)).collect()]
    assert np.allclose(scores, left)


def test_live_columns(spark):
    points = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0)], "x double, y double").select(E.knot_basis(F.col("x"), F.col("y"), [(0, 0), (50, 50), (2, 0)], 3.0).alias("basis"))
    assert E.live_columns(points, "basis", 3) == [0, 2]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "realization long, category string, i long, j long, k long")
    assert spatial.grid_components(none).count() == 0
    assert spatial.kriging(spark.createDataFrame([], "target long, tx double, ty double, id long, x double, y double, value double"), 1.0, 1.0, 0.0).count() == 0


def test_orientation_and_rising_fit(spark):
    from stratalake.operators import calibration as C, summaries as S

    rng = np.random.default_rng(6)
    planes = [("a", float(d), float(a)) for d, a in zip(rng.uniform(30, 40, 50), rng.uniform(80, 100, 50))] + [("b", 45.0, 90.0), ("b", 45.0, 270.0)]
    table = spark.createDataFrame(planes, "group string, dip double, dip_direction double")
    found = {r.group: r for r in S.principal_orientation(S.orientation_tensor(table, ["group"])).collect()}
    for name, r in found.items():
        d, a = np.radians(np.array([p[1:] for p in planes if p[0] == name])).T
        normals = np.stack([np.sin(d) * np.sin(a), np.sin(d) * np.cos(a), np.cos(d)], 1)
        assert np.allclose([r.first, r.second, r.third], np.linalg.eigvalsh(normals.T @ normals / len(normals))[::-1], atol=1e-9)
    assert found["a"].defined and not found["b"].defined  # 45 degrees to 090 and to 270 give no orientation
    x = rng.integers(0, 12, 60).astype(float)
    y = x / 4 + rng.normal(size=60)
    rows = spark.createDataFrame([("k", float(a), float(b)) for a, b in zip(x, y)], "key string, x double, y double")
    fit = {r.x: r.fitted for r in S.isotonic(rows, ["key"]).collect()}
    at = sorted(fit)
    mean, weight = np.array([y[x == v].mean() for v in at]), np.array([(x == v).sum() for v in at])
    best = [max(min(np.average(mean[i : j + 1], weights=weight[i : j + 1]) for j in range(k, len(at))) for i in range(k + 1)) for k in range(len(at))]  # the minimax form of the fit
    assert np.allclose([fit[v] for v in at], best)
    points = S.isotonic(rows, ["key"]).select("key", "x", "fitted")
    values = spark.createDataFrame([("k", i, v) for i, v in enumerate([-1.0, 0.25, 3.0, 50.0])] + [("other", 9, 1.0)], "key string, id long, x double")
    got = {r.id: r.estimate for r in C.interpolated(values, points, ["key"]).collect()}
    assert got[9] is None and np.allclose([got[i] for i in range(4)], np.interp([-1.0, 0.25, 3.0, 50.0], at, [fit[v] for v in at]))
