"""Archives, project files, JSON and arrays on authored files; sinks that write all or nothing."""

import io
import os
import zipfile

import numpy as np
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from stratalake.operators.records import chain_faults
from stratalake.sources import containers as C, sinks


def test_zip_member(spark, tmp_path):
    path = str(tmp_path / "a.zip")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("t.tsv", "hole\tnote\r\nA\tcaf\xe9\r\n\r\nB\t\"two\nlines\"\r\n".encode("cp1252"))
        z.writestr("twice.tsv", b"a\ta\n1\t2\n")
        z.writestr("ragged.tsv", b"a\tb\n1\n")
        z.writestr("empty.tsv", b"")
    assert sorted(map(tuple, C.zip_table(spark, path, "t.tsv").collect())) == [(2, "A", "caf\xe9"), (3, "B", "two\nlines")]
    for member in ("twice.tsv", "empty.tsv"):
        with pytest.raises(ValueError):
            C.zip_table(spark, path, member)
    with pytest.raises(PySparkException, match="ragged"):
        C.zip_table(spark, path, "ragged.tsv").collect()
    with pytest.raises(PySparkException, match="bytes"):
        C.zip_table(spark, _big(tmp_path), "t.tsv", most_bytes=5000).collect()
    with pytest.raises(ValueError, match="bytes"):
        C.zip_table(spark, path, "t.tsv", most_bytes=20)


def _big(folder):
    """An archive far smaller than its member."""
    path = str(folder / "big.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("t.tsv", b"a\n" + b"1\n" * 50_000)
    return path


def test_project_file(spark, tmp_path):
    path = tmp_path / "p.ini"
    path.write_bytes(b"v1.2 \r\nlayers=3\rsamples=9\nlayers=4\nother=1\n  P7=2;name \xe9;{AB}\nSet_1=x=y\nSet_2=z\n" + b"\n" * 6 + b"sets=9\n")
    lines = C.project_lines(spark, str(path)).cache()
    (p,) = C.project_parameters(lines, r"P(\d+)=(\d+);([^;]*);\{(\w+)\}").collect()
    assert (p.line, p.parameter, p["index"], p.name, p.guid) == (6, 7, 2, "name \xe9", "AB")
    (h,) = C.project_header(lines).collect()
    assert (h.version, h.header, h.sets) == ("v1.2", {"layers": "4", "samples": "9"}, ["x=y", "z"])


def test_strict_json(spark, tmp_path):
    good, bad = tmp_path / "a.json", tmp_path / "b.json"
    good.write_text('[{"a": 1.5}, {"a": null}]')
    bad.write_text('[{"a": NaN}]')
    assert sorted((r.a for r in C.strict_json(spark, str(good), "a double").collect()), key=str) == [1.5, None]
    with pytest.raises((PySparkException, Py4JJavaError)):
        C.strict_json(spark, str(bad), "a double").collect()
    with pytest.raises(ValueError, match="bytes"):
        C.strict_json(spark, str(good), "a double", most_bytes=3)


def test_arrays(spark, tmp_path):
    values = np.arange(6, dtype="float32").reshape(2, 3) / 4
    raw = io.BytesIO()
    np.save(raw, values)
    (tmp_path / "x.npy").write_bytes(raw.getvalue())
    rows = sorted(C.arrays(spark, str(tmp_path / "x.npy")).collect(), key=lambda r: r["index"])
    assert [r.value for r in rows] == values.reshape(-1).tolist() and rows[0]["shape"] == [2, 3] and len(rows[0].sha256) == 64


def test_commit_is_whole_or_nothing(spark, tmp_path):
    folder = str(tmp_path / "stage")
    good = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "id long, t string")
    found = {r.table: r for r in sinks.commit({"good": good, "empty": good.where("false")}, folder).collect()}
    assert (found["good"].rows, found["empty"].rows, found["good"].columns) == (3, 0, "id,t")
    assert sinks.table_digest(good.repartition(3))[1] == found["good"].digest != sinks.table_digest(good.distinct())[1]
    assert sinks.verified(spark, folder, "good").count() == 3
    with pytest.raises(FileExistsError):
        sinks.commit({"good": good}, folder)
    broken = good.selectExpr("id", "raise_error('no') AS t")
    with pytest.raises(PySparkException):
        sinks.commit({"good": good, "broken": broken}, str(tmp_path / "other"))
    assert os.listdir(tmp_path) == ["stage"]
    good.limit(1).write.mode("overwrite").parquet(f"{folder}/good")
    with pytest.raises(ValueError, match="changed"):
        sinks.verified(spark, folder, "good")


def test_chain(spark):
    reads = spark.createDataFrame([("train", "features", "x"), ("train", "split", "y"), ("infer", "models", None)], "stage string, source string, digest string")
    outputs = spark.createDataFrame([("features", "x"), ("split", "z")], "source string, digest string")
    assert sorted(map(tuple, chain_faults(reads, outputs).collect())) == [("infer", "models", "absent"), ("train", "split", "changed")]
