"""Manifests, whole imports and versions against authored truth."""

import copy
import json

import pytest
from stratalake.sources import projects as P, versions as V
from stratalake.sources.manifests import ManifestInvalid, manifest_findings, problems

COLLARS = "HoleID,East,North,RL,Depth,Azimuth,Dip\nDH1,500000,7000000,300,12,0,-90\nDH2,500050,7000000,301,10,90,-60\nDH3,500100,7000050,302,8,,\n"
SURVEYS = "HoleID,Depth,Azimuth,Dip\nDH1,0,0,-90\nDH1,10,0,-88\nDH2,0,90,-60\nDH2,5,91,-59\nDH3,0,10,-70\n"
ASSAYS = "HoleID,SampleID,From,To,Cu_ppm,Au_gpt\nDH1,S1,0,2,100,0.5\nDH1,S2,2,4,<5,1.5\nDH2,S3,0,3,300,NS\nDH2,S4,2,5,400,2\nDH3,S5,0,1,>10000,\nDH3,S6,4,4,1,1\nDH9,S7,0,1,5,5\n"
LOGS = "HoleID,From,To,Lith,Description\nDH1,0,5,SAND,pale\nDH1,5,5,FAULT,\nDH1,5,5,VEIN,quartz\nDH2,0,10,CLAY,\nDH3,6,2,SAND,\n"
ANALYTES = {"Cu_ppm": {"analyte": "Cu", "unit": "ppm", "method": "icp"}, "Au_gpt": {"analyte": "Au", "unit": "g/t"}}
COLUMNS = {
    "collar": {"hole": "HoleID", "x": "East", "y": "North", "z": "RL", "totalDepth": "Depth", "azimuth": "Azimuth", "dip": "Dip"},
    "survey": {"hole": "HoleID", "depth": "Depth", "azimuth": "Azimuth", "dip": "Dip"},
    "assay": {"hole": "HoleID", "sample": "SampleID", "from": "From", "to": "To"},
    "lithology": {"hole": "HoleID", "from": "From", "to": "To", "description": "Description"},
}


def manifest(**changes):
    files = [{"path": "collars.csv", "role": "collar", "columns": COLUMNS["collar"]}, {"path": "surveys.csv", "role": "survey", "columns": COLUMNS["survey"]}]
    files += [{"path": "assays.csv", "role": "assay", "columns": COLUMNS["assay"], "analytes": ANALYTES, "states": {"NS": "not-sampled"}}, {"path": "logs.csv", "role": "lithology", "columns": COLUMNS["lithology"], "codes": ["Lith"]}]
    return {"schema": "drillhole.import/v1", "project": {"id": "demo", "name": "Demo"}, "frame": {"id": "grid", "kind": "projected-metric"}, "namespace": "a", "files": files} | changes


@pytest.fixture
def place(tmp_path):
    def put(m, **texts):
        named = {"collars.csv": COLLARS, "surveys.csv": SURVEYS, "assays.csv": ASSAYS, "logs.csv": LOGS} | {k.replace("_csv", ".csv"): v for k, v in texts.items()}
        for name, text in named.items():
            (tmp_path / name).write_text(text)
        (tmp_path / "manifest.json").write_text(json.dumps(m))
        return str(tmp_path / "manifest.json"), str(tmp_path / "out")

    return put


def codes(report):
    return sorted((r.code, r.hole) for r in report["findings"].collect())


def test_good_and_bad_manifests(spark):
    good = manifest(aliases={"a:DH1": "a:X1"}, exclude=["a:DH2"], compositing={"lengths": [1, 2.5], "minCoverage": 0.5}, orientations=[{"dip": 90, "dipDirection": 0}], methodPriority={"Cu": ["icp"]})
    assert problems(json.dumps(good)) == []
    bad = copy.deepcopy(good)
    bad["project"]["id"] = "Not Good"
    bad["extra"] = 1
    del bad["frame"]["kind"]
    bad["files"][0]["role"] = "collars"
    bad["files"][1]["dialect"] = {"delimiter": ";;", "decimal": "."}
    bad["files"][2]["analytes"]["Cu_ppm"]["unit"] = "oz"
    del bad["files"][3]["columns"]["to"]
    bad["exclude"] = ["DH2", True]
    bad["compositing"]["lengths"] = [0]
    bad["orientations"][0]["dipDirection"] = 360
    bad["aliases"] = []
    rows = [("good", json.dumps(good)), ("bad", json.dumps(bad)), ("nan", '{"a": NaN}'), ("twice", '{"a": 1, "a": 2}'), ("none", None), ("list", "[]")]
    found = {(r.manifest, r.path, r.rule) for r in manifest_findings(spark.createDataFrame(rows, "name string, content string")).collect()}
    assert found == {
        ("bad", "/project/id", "form"), ("bad", "", "unknown"), ("bad", "/frame", "missing"), ("bad", "/files/0/role", "choice"), ("bad", "/files/1/dialect/delimiter", "length"),
        ("bad", "/files/2/analytes/Cu_ppm/unit", "choice"), ("bad", "/files/3/columns", "missing"), ("bad", "/exclude/0", "form"), ("bad", "/exclude/1", "type"),
        ("bad", "/compositing/lengths/0", "bounds"), ("bad", "/orientations/0/dipDirection", "bounds"), ("bad", "/aliases", "type"), ("nan", "", "json"), ("twice", "", "json"), ("none", "", "json"), ("list", "", "type"),
    }


def test_accepted_import(spark, place):
    path, out = place(manifest())
    report = P.run_import(spark, path, out)
    assert report["status"] == "accepted" and report["written"]
    assert codes(report) == [("ASSAY_OVERLAP", "a:DH2"), ("ASSAY_OVERLAP", "a:DH2"), ("INTERVAL_INVALID", "a:DH3"), ("INTERVAL_INVALID", "a:DH3"), ("ORPHAN_ASSAY", "a:DH9"), ("SURVEY_TRUNCATED", "a:DH1"), ("SURVEY_TRUNCATED", "a:DH2"), ("SURVEY_TRUNCATED", "a:DH3")]
    read = lambda name: V.read_current(spark, out, "demo", name)
    assert [r.id for r in read("collars").orderBy("id").collect()] == ["a:DH1", "a:DH2", "a:DH3"]
    assert sorted((r.id, r.from_md, r.to_md) for r in read("supports").collect()) == [("a:DH1/S1", 0, 2), ("a:DH1/S2", 2, 4), ("a:DH2/S3", 0, 3), ("a:DH2/S4", 2, 5), ("a:DH3/S5", 0, 1)]
    states = {r.id: (r.state, r.value, r.limit) for r in read("determinations").collect()}
    assert len(states) == 10 and states["a:DH1/S2:Cu_ppm"] == ("censored-below", None, 5.0) and states["a:DH3/S5:Cu_ppm"] == ("censored-above", None, 10000.0)
    assert states["a:DH2/S3:Au_gpt"][0] == "not-sampled" and states["a:DH3/S5:Au_gpt"][0] == "missing" and states["a:DH1/S1:Au_gpt"] == ("measured", 0.5, None)
    assert sorted(r.row_id for r in read("exclusions").collect()) == [f"a:DH2/S{i}:{c}" for i in (3, 4) for c in ("Au_gpt", "Cu_ppm")]
    assert sorted((r.id, r.kind) for r in read("geology").collect()) == [("a:DH1/L0-5", "interval"), ("a:DH1/L5-5", "event"), ("a:DH1/L5-5#2", "event"), ("a:DH2/L0-10", "interval")]
    assert {r.step: r.n for r in read("waterfall").collect()} == {"files": 4, "rows read": 20, "holes accepted": 3, "samples": 5, "determinations": 10, "controls": 0, "excluded from modeling": 4}
    assert [(r.kind, r.start) for r in read("trajectories").where("id = 'a:DH3'").collect()] == [("measured-stations", "none")]
    first = V.current(spark, out, "demo")
    again = P.run_import(spark, path, out)
    assert not again["written"] and V.current(spark, out, "demo") == first


def test_order_of_files_and_splits_change_nothing(spark, place):
    m = manifest()
    path, out = place(m)
    P.run_import(spark, path, out)
    one = {t: sorted(map(str, V.read_current(spark, out, "demo", t).drop("file", "row").collect())) for t in ("collars", "supports", "determinations", "surveys", "trajectories")}
    lines = ASSAYS.splitlines()
    m["files"] = [{**m["files"][2], "path": "b.csv"}, m["files"][3], {**m["files"][2], "path": "c.csv"}, m["files"][0], m["files"][1]]
    path, out2 = place(m, b_csv="\n".join([lines[0], *lines[:3:-1]]) + "\n", c_csv="\n".join(lines[:4]) + "\n")
    assert P.run_import(spark, path, out2 + "2")["status"] == "accepted"
    assert one == {t: sorted(map(str, V.read_current(spark, out2 + "2", "demo", t).drop("file", "row").collect())) for t in one}


def test_conflicting_collars_and_resolutions(spark, place):
    m = manifest()
    m["files"].append({"path": "more.csv", "role": "collar", "columns": COLUMNS["collar"]})
    more = "HoleID,East,North,RL,Depth,Azimuth,Dip\nDH2,500055,7000000,301,10,90,-60\nDH1,500000,7000000,300,12,0,-90\n"
    path, out = place(m, more_csv=more)
    report = P.run_import(spark, path, out)
    assert report["status"] == "rejected" and report["blocked"] == 1 and V.current(spark, out, "demo") is None
    (conflict,) = report["findings"].where("code = 'COLLAR_CONFLICT'").collect()
    assert conflict.hole == "a:DH2" and conflict.rows == ["collars.csv:3", "more.csv:2"] and "2 assay, 1 lithology, 2 survey" in conflict.message
    assert ("RECORD_DUPLICATE", "a:DH1") in codes(report)
    m["resolutions"] = {"collars": {"a:DH2": "more.csv"}}
    path, out = place(m, more_csv=more)
    report = P.run_import(spark, path, out)
    assert report["status"] == "accepted" and ("COLLAR_CONFLICT_RESOLVED", "a:DH2") in codes(report)
    assert V.read_current(spark, out, "demo", "collars").where("id = 'a:DH2'").first().x == 500055


def test_aliases_namespaces_and_collisions(spark, place):
    m = manifest()
    m["files"] = [{**m["files"][0]}, {**m["files"][0], "path": "b.csv", "namespace": "b"}]
    b = "HoleID,East,North,RL,Depth,Azimuth,Dip\nDH1,500200,7000000,300,5,0,-90\ndh-01,500300,7000000,300,5,0,-90\n"
    path, out = place(m, b_csv=b)
    report = P.run_import(spark, path, out)
    assert ("ID_NORMALIZATION_COLLISION", "b:DH1") in codes(report) and report["status"] == "rejected"  # DH3 has no direction
    m["assumptions"], m["aliases"] = {"missingSurvey": "vertical"}, {"b:dh-01": "a:NEW"}
    path, out = place(m, b_csv=b)
    report = P.run_import(spark, path, out)
    assert report["status"] == "accepted" and ("ALIAS_APPLIED", "a:NEW") in codes(report) and not [c for c, _ in codes(report) if c == "ID_NORMALIZATION_COLLISION"]
    assert sorted(r.id for r in V.read_current(spark, out, "demo", "collars").collect()) == ["a:DH1", "a:DH2", "a:DH3", "a:NEW", "b:DH1"]


def test_pending_rejected_and_excluded(spark, place):
    m = manifest()
    m["files"] = m["files"][1:]
    path, out = place(m)
    report = P.run_import(spark, path, out)
    assert report["status"] == "pending" and [c for c, _ in codes(report)] == ["COLLARS_PENDING"] and V.current(spark, out, "demo") is None
    path, out = place(manifest(), assays_csv=ASSAYS.replace("DH1,S1,0,2,100", "DH1,S1,0,2,oops"))
    report = P.run_import(spark, path, out)
    assert report["status"] == "rejected" and ("NUMBER_INVALID", "a:DH1") in codes(report)
    path, out = place(manifest(exclude=["a:DH1"]), assays_csv=ASSAYS.replace("DH1,S1,0,2,100", "DH1,S1,0,2,oops"))
    report = P.run_import(spark, path, out)
    assert report["status"] == "accepted" and sorted(r.id for r in V.read_current(spark, out, "demo", "collars").collect()) == ["a:DH2", "a:DH3"]
    swapped = COLLARS + "".join(f"N{i},{7000000 + i},{500000 + i},300,5,0,-90\n" for i in range(3))
    m = manifest()
    m["files"].append({"path": "n.csv", "role": "collar", "columns": COLUMNS["collar"]})
    path, out = place(m, n_csv=swapped.replace(COLLARS, COLLARS.splitlines()[0] + "\n"))
    report = P.run_import(spark, path, out)
    assert report["status"] == "rejected" and [r.file for r in report["findings"].where("code = 'AXES_SWAPPED_SUSPECTED'").collect()] == ["n.csv"]
    m["files"][-1]["axisOrder"] = "north-east"
    path, out = place(m, n_csv=swapped.replace(COLLARS, COLLARS.splitlines()[0] + "\n"))
    assert P.run_import(spark, path, out)["status"] == "accepted"


def test_units_dips_decimals_and_controls(spark, place):
    m = manifest()
    m["files"][0] |= {"dialect": {"delimiter": ";", "decimal": ","}, "lengthUnit": "ft", "elevationUnit": "ft", "angles": {"dip": "positive-down"}}
    m["files"][2] |= {"columns": COLUMNS["assay"] | {"sampleType": "Type"}, "controls": {"STD": "standard"}, "repeats": {"REP": "repeat"}}
    collars = "HoleID;East;North;RL;Depth;Azimuth;Dip\nDH1;500000,5;7000000;10;100;361;60\nDH2;500050;7000000;10;10;0;90\nDH3;500100;7000000;10;10;0;90\n"
    assays = "HoleID,SampleID,From,To,Type,Cu_ppm,Au_gpt\nDH1,S1,0,2,,100,1\nDH1,S1,0,2,REP,90,1\n,S9,,,STD,55,1\nDH1,S1,0,2,,100,1\n"
    path, out = place(m, collars_csv=collars, assays_csv=assays)
    report = P.run_import(spark, path, out)
    assert report["status"] == "accepted" and {"UNIT_CONVERTED", "ANGLES_MAPPED", "RECORD_DUPLICATE"} <= {c for c, _ in codes(report)}
    one = V.read_current(spark, out, "demo", "collars").where("id = 'a:DH1'").first()
    assert (one.x, one.azimuth, one.dip) == (500000.5, 1.0, -60.0) and abs(one.z - 3.048) < 1e-12 and abs(one.depth - 30.48) < 1e-12
    results = V.read_current(spark, out, "demo", "determinations")
    assert sorted((r.id, r.role) for r in results.collect()) == [("a:DH1/S1:Au_gpt", "original"), ("a:DH1/S1:Au_gpt#2", "repeat"), ("a:DH1/S1:Cu_ppm", "original"), ("a:DH1/S1:Cu_ppm#2", "repeat")]
    assert [(r.control, r.value) for r in V.read_current(spark, out, "demo", "qc").where("analyte = 'Cu'").collect()] == [("standard", 55.0)]


def test_cancelled_and_killed_imports_leave_the_old_project(spark, place):
    path, out = place(manifest())
    P.run_import(spark, path, out)
    old, held = V.current(spark, out, "demo"), V.read_current(spark, out, "demo", "supports").count()
    path, out = place(manifest(), assays_csv=ASSAYS + "DH1,S8,4,6,1,1\n")
    for after in (0, 1, 3, 5):
        calls = iter(range(100))
        with pytest.raises(V.Cancelled):
            P.run_import(spark, path, out, lambda: next(calls) >= after)  # noqa: B023
        assert V.current(spark, out, "demo") == old

    def killed():
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError, match="killed"):
        V.publish({"t": spark.range(3)}, out, "demo", "v2", killed)
    assert V.current(spark, out, "demo") == old
    assert not V.publish({"t": spark.range(3)}, out, "demo", "v2")  # what the killed run had written is taken up
    assert V.read_current(spark, out, "demo", "t").count() == 3
    report = P.run_import(spark, path, out)
    assert report["written"] and V.read_current(spark, out, "demo", "supports").count() == held + 1


def test_invalid_manifest_reads_nothing(spark, place):
    path, out = place(manifest(namespace="a:b"))
    with pytest.raises(ManifestInvalid, match="/namespace"):
        P.run_import(spark, path, out)
