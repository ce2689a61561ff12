"""Validation of import manifests: closed keys, types, choices and bounds over nested JSON, as findings with paths."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

FINDINGS = "manifest string, path string, rule string, detail string"
Found = Iterator[tuple[str, str, str]]


class ManifestInvalid(ValueError):
    """The manifest breaks its form; no other file was read."""


class NotJson(ValueError):
    pass


def _kind(value: Any) -> str:
    if value is None:
        return "null"
    return {bool: "boolean", int: "number", float: "number", str: "string", list: "list", dict: "record"}[type(value)]


@dataclass(frozen=True)
class Text:
    """A string of at least `least` and at most `most` characters in which `form` is found."""

    least: int = 0
    most: int | None = None
    form: str | None = None

    def check(self, value: Any, path: str) -> Found:
        if not isinstance(value, str):
            yield path, "type", f"a string is wanted, there is a {_kind(value)}"
        elif len(value) < self.least or (self.most is not None and len(value) > self.most):
            yield path, "length", f"{len(value)} characters"
        elif self.form and not re.search(self.form, value):
            yield path, "form", f"{value[:60]!r} isn't of the form {self.form}"


@dataclass(frozen=True)
class Choice:
    """One of a few values."""

    of: tuple[str, ...]

    def check(self, value: Any, path: str) -> Found:
        if not isinstance(value, str) or value not in self.of:
            yield path, "choice", f"{json.dumps(value)[:60]} is none of {', '.join(self.of)}"


@dataclass(frozen=True)
class Number:
    """A number from `low` (`above`: excluded) to `high` (`below`: excluded)."""

    low: float = -math.inf
    high: float = math.inf
    above: float = -math.inf
    below: float = math.inf

    def check(self, value: Any, path: str) -> Found:
        if _kind(value) != "number":
            yield path, "type", f"a number is wanted, there is a {_kind(value)}"
        elif not (self.low <= value <= self.high and self.above < value < self.below):
            yield path, "bounds", f"{value} is out of bounds"


@dataclass(frozen=True)
class Rows:
    """A list of at least `least` values of one shape."""

    each: Any
    least: int = 0

    def check(self, value: Any, path: str) -> Found:
        if not isinstance(value, list):
            yield path, "type", f"a list is wanted, there is a {_kind(value)}"
            return
        if len(value) < self.least:
            yield path, "length", f"{len(value)} of at least {self.least} entries"
        for i, x in enumerate(value):
            yield from self.each.check(x, f"{path}/{i}")


@dataclass(frozen=True)
class Names:
    """A record whose keys are free and whose values have one shape."""

    each: Any

    def check(self, value: Any, path: str) -> Found:
        if not isinstance(value, dict):
            yield path, "type", f"a record is wanted, there is a {_kind(value)}"
            return
        for k, x in value.items():
            yield from self.each.check(x, f"{path}/{k}")


@dataclass(frozen=True)
class Record:
    """A record of needed and allowed keys and no others."""

    needed: dict[str, Any] = field(default_factory=dict)
    allowed: dict[str, Any] = field(default_factory=dict)

    def check(self, value: Any, path: str) -> Found:
        if not isinstance(value, dict):
            yield path, "type", f"a record is wanted, there is a {_kind(value)}"
            return
        shapes = self.needed | self.allowed
        for k in self.needed:
            if k not in value:
                yield path, "missing", k
        for k, x in value.items():
            if k in shapes:
                yield from shapes[k].check(x, f"{path}/{k}")
            else:
                yield path, "unknown", k


# Fixed values of the manifest's form: its keys, choices and patterns.
HOLE = Text(form="^[^:]+:.+$")
DIALECT = Record({}, {"delimiter": Text(1, 1), "quote": Text(1, 1), "decimal": Choice((".", ",")), "encoding": Choice(("utf-8", "utf-8-sig", "cp1252", "latin-1"))})
ANALYTE = Record({"analyte": Text(1), "unit": Choice(("ppb", "ppm", "g/t", "%", "wt%"))}, {"method": Text(), "lab": Text()})
ANGLES = Record({}, {"dip": Choice(("negative-down", "positive-down", "inclination-from-vertical")), "azimuthReference": Choice(("true", "grid", "magnetic", "unknown")), "instrument": Text()})
FILE = Record(
    {"path": Text(1), "role": Choice(("collar", "survey", "assay", "lithology")), "columns": Names(Text(1))},
    {
        "namespace": Text(form="^[^:]+$"), "dialect": DIALECT, "missing": Rows(Text()), "lengthUnit": Choice(("m", "ft")), "elevationUnit": Choice(("m", "ft")),
        "crs": Text(), "axisOrder": Choice(("east-north", "north-east")), "angles": ANGLES, "analytes": Names(ANALYTE),
        "states": Names(Choice(("missing", "not-sampled", "lost-core", "sentinel"))), "controls": Names(Text()), "repeats": Names(Choice(("repeat", "duplicate"))),
        "codes": Rows(Text()), "sha256": Text(form="^[0-9a-f]{64}$"),
    },
)
MANIFEST = Record(
    {
        "schema": Choice(("drillhole.import/v1",)), "project": Record({"id": Text(form="^[a-z0-9][a-z0-9-]*$"), "name": Text()}),
        "frame": Record({"id": Text(), "kind": Choice(("projected-metric", "local-metric"))}, {"horizontalCrs": Text(), "verticalDatum": Text()}), "files": Rows(FILE, 1),
    },
    {
        "namespace": Text(form="^[^:]+$"), "aliases": Names(HOLE), "resolutions": Record({}, {"collars": Names(Text())}), "exclude": Rows(HOLE),
        "assumptions": Record({}, {"missingSurvey": Choice(("collar-orientation", "vertical")), "surveyStart": Choice(("tangent",))}),
        "methodPriority": Names(Rows(Text())), "holdout": Rows(HOLE),
        "orientations": Rows(Record({"dip": Number(0, 90), "dipDirection": Number(0, below=360)}, {"note": Text()})),
        "compositing": Record({}, {"lengths": Rows(Number(above=0), 1), "minCoverage": Number(0, 1)}),
    },
)
#: Columns that a file of a role must map.
NEEDED = {"collar": ("hole", "x", "y", "z"), "survey": ("hole", "depth", "azimuth", "dip"), "assay": ("hole", "from", "to"), "lithology": ("hole", "from", "to")}


def parsed(text: str) -> Any:
    """Strict JSON: no repeated key, no NaN or infinity."""

    def once(pairs: list[tuple[str, Any]]) -> dict:
        keys = [k for k, _ in pairs]
        if twice := sorted({k for k in keys if keys.count(k) > 1}):
            raise NotJson(f"keys given twice: {', '.join(twice)}")
        return dict(pairs)

    def constant(name: str) -> None:
        raise NotJson(f"{name} is no JSON number")

    try:
        return json.loads(text, object_pairs_hook=once, parse_constant=constant)
    except json.JSONDecodeError as error:
        raise NotJson(str(error)) from error
    except RecursionError as error:
        raise NotJson("nested too deep") from error


def problems(text: str | None, shape: Any = None) -> list[tuple[str, str, str]]:
    """(path, rule, detail) of all that is wrong with one manifest, or with JSON of another shape."""
    try:
        manifest = parsed(text or "")
    except NotJson as error:
        return [("", "json", str(error))]
    found = list((shape or MANIFEST).check(manifest, ""))
    if shape is None and isinstance(manifest, dict) and isinstance(manifest.get("files"), list):
        for i, f in enumerate(manifest["files"]):
            columns = f.get("columns") if isinstance(f, dict) else None
            if isinstance(columns, dict):
                found += [(f"/files/{i}/columns", "missing", k) for k in NEEDED.get(f.get("role"), ()) if k not in columns]
    return found


def manifest_findings(manifests: DataFrame, shape: Any = None) -> DataFrame:
    """(manifest, path, rule, detail) of manifests (name, content), a row a fault; a manifest without faults has none.

    Rules are json, type, missing (a key that is needed), unknown (a key that is not allowed), choice, form, length and
    bounds. Paths name keys and places in lists from the root, which is empty. Null content is no JSON.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = [(name, *p) for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for p in problems(text, shape)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else [()] * 4)], names=["manifest", "path", "rule", "detail"])

    return manifests.select("name", "content").mapInArrow(run, FINDINGS)


def load_manifest(spark: SparkSession, path: str) -> dict:
    """The manifest at a path; raises ManifestInvalid with its faults."""
    text = spark.read.format("binaryFile").load(path).selectExpr("cast(content AS string) AS content").first()["content"]
    if found := problems(text):
        raise ManifestInvalid("; ".join(f"{p or '(root)'}: {rule}: {detail}" for p, rule, detail in found[:10]))
    return parsed(text)
