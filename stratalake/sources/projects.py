"""Import of a project from a manifest: typed tables, findings, a decision, and a version that replaces the old one or none.

Every rule is a filter, a grouping or a join that gives rows of findings (code, severity, file, role, hole, rows,
message). Errors with a hole block that hole and reject the import, errors without one reject it as a whole; without
collars the import is pending.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from stratalake.functions import parsing
from stratalake.operators import boxes, imports, intervals, matching
from stratalake.sources import strict, versions
from stratalake.sources.manifests import load_manifest
from stratalake.storage import written

FINDINGS = "code string, severity string, file string, role string, hole string, rows array<string>, message string"
ROLES = ("collar", "survey", "assay", "lithology")
CONVENTIONS = {"negative-down": "down-negative", "positive-down": "down-positive", "inclination-from-vertical": "from-vertical"}
ENCODINGS = {"utf-8": "UTF-8", "utf-8-sig": "UTF-8", "cp1252": "windows-1252", "latin-1": "ISO-8859-1"}
#: Severity of what stations and trajectories report.
SEVERITY = {"SURVEY_DEPTH_CONFLICT": "error", "SURVEY_START_UNDECLARED": "error", "SURVEY_MISSING_UNASSUMED": "error"}


def finding(code: str | Column, severity: str | Column, message: str | Column, file: Column | None = None, role: str | Column | None = None, hole: Column | None = None, rows: Column | None = None) -> list[Column]:
    def column(x: str | Column | None) -> Column:
        return F.lit(x) if x is None or isinstance(x, str) else x

    named = {"code": code, "severity": severity, "file": file, "role": role, "hole": hole}
    return [*(column(v).cast("string").alias(k) for k, v in named.items()), (F.array().cast("array<string>") if rows is None else rows).alias("rows"), column(message).alias("message")]


def small(spark: SparkSession, found: list[tuple]) -> DataFrame:
    return spark.createDataFrame(found, FINDINGS).coalesce(1)


class Files:
    """Files of a manifest as rows of their roles, keyed and typed, with what is wrong with their values."""

    def __init__(self, spark: SparkSession, manifest: dict, base: str):
        self.spark, self.manifest = spark, manifest
        self.specs = {f["path"]: f for f in manifest["files"]}
        opened = [self._spec(base, f) for f in manifest["files"]]
        names = {s.path: f["path"] for s, f in zip(opened, manifest["files"])}
        self.tables: dict[str, DataFrame] = {}
        self.hashes = strict.hashes(spark, opened)
        found = []
        for one, findings in strict.read_files(spark, opened, self.hashes):
            found += [(code, severity, names[path], role, None, [], detail) for code, severity, path, role, detail in findings]
            if one is not None:
                self.tables[names[one[0].path]] = one[1]
        self.findings = small(spark, found)

    @staticmethod
    def _spec(base: str, f: dict) -> strict.Spec:
        dialect = f.get("dialect", {})
        wanted = {*f["columns"].values(), *f.get("analytes", {}), *f.get("codes", [])}
        reading = json.dumps({k: v for k, v in f.items() if k != "path"}, sort_keys=True)
        return strict.Spec(f"{base}/{f['path']}", f["role"], dialect.get("delimiter", ","), dialect.get("quote", '"'), ENCODINGS[dialect.get("encoding", "utf-8")], tuple(sorted(wanted)), f.get("sha256"), (reading,))

    def of(self, role: str) -> list[tuple[dict, DataFrame]]:
        return [(self.specs[path], table) for path, table in self.tables.items() if self.specs[path]["role"] == role]

    def key(self, f: dict) -> tuple[Column, Column, Column]:
        """(key with aliases applied, id as written, namespace) of a row's hole."""
        raw, namespace = F.trim(F.col(f"`{f['columns']['hole']}`")), F.lit(f.get("namespace", self.manifest.get("namespace", "src")))
        key = parsing.hole_key(namespace, raw)
        aliases = self.manifest.get("aliases", {})
        if aliases:
            key = F.coalesce(F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))[key], key)
        return key, raw, namespace

    @staticmethod
    def number(f: dict, name: str, needed: bool = True) -> tuple[Column, Column]:
        """(value, fault) of a mapped column: a fault is its name and token where it isn't a number, or is needed and missing."""
        column = f["columns"].get(name)
        text = F.trim(F.col(f"`{column}`")) if column else F.lit("")
        absent = text.isin("", *(m.strip() for m in f.get("missing", [""])))
        value = F.when(~absent, imports.decimal_number(text, f.get("dialect", {}).get("decimal", ".")))
        bad = (absent & F.lit(needed)) | (~absent & value.isNull())
        return value, F.when(bad, F.struct(F.lit(column or name).alias("column"), text.alias("token")))

    @staticmethod
    def length(f: dict, value: Column, unit: str = "lengthUnit") -> Column:
        return value * parsing.FOOT if f.get(unit, "m") == "ft" else value

    @staticmethod
    def dip(f: dict, value: Column) -> Column:
        return parsing.dip_below_horizontal(value, CONVENTIONS[f.get("angles", {}).get("dip", "negative-down")])

    def rows(self, role: str, fields: Callable[[dict], tuple[dict[str, Column], list[Column]]], schema: str) -> DataFrame:
        """Written rows (file, row, hole, raw, namespace, the fields, faults) of a role's files; none if it has no file."""
        parts = []
        for order, (f, table) in enumerate(self.of(role)):
            key, raw, namespace = self.key(f)
            named, faults = fields(f)
            kept = F.filter(F.array(*faults), lambda x: x.isNotNull()) if faults else F.array().cast("array<struct<column:string,token:string>>")
            parts.append(table.select(F.lit(f["path"]).alias("file"), F.lit(order).alias("turn"), F.col("_row").cast("long").alias("row"), key.alias("hole"), raw.alias("raw"), namespace.alias("namespace"), *(c.alias(n) for n, c in named.items()), kept.alias("faults")))
        form = f"file string, turn int, row long, hole string, raw string, namespace string, {schema}, faults array<struct<column:string,token:string>>"
        if not parts:
            return self.spark.createDataFrame([], form)
        return written(reduce(DataFrame.unionByName, parts).to(self.spark.createDataFrame([], form).schema))


def _where(file: str = "file", row: str = "row") -> Column:
    return F.concat_ws(":", file, row)


def value_faults(rows: DataFrame, role: str) -> DataFrame:
    fault = rows.select("file", "row", "hole", "raw", F.explode("faults").alias("x"))
    message = F.concat(F.lit("column "), "x.column", F.when(F.col("x.token") == "", ": a needed value is missing").otherwise(F.concat(F.lit(": no number: "), "x.token")))
    return fault.select(*finding("NUMBER_INVALID", "error", message, F.col("file"), role, F.when(F.col("raw") != "", F.col("hole")), F.array(F.col("row").cast("string"))))


def notes(spark: SparkSession, manifest: dict) -> DataFrame:
    """What the manifest itself declares: units converted, angles mapped, aliases applied, holes excluded."""
    found = []
    for f in manifest["files"]:
        if "ft" in (f.get("lengthUnit"), f.get("elevationUnit")):
            found.append(("UNIT_CONVERTED", "info", f["path"], f["role"], None, [], "feet are read as 0.3048 metres"))
        if (dip := f.get("angles", {}).get("dip", "negative-down")) != "negative-down":
            found.append(("ANGLES_MAPPED", "info", f["path"], f["role"], None, [], f"dips are read as {dip}"))
    found += [("ALIAS_APPLIED", "info", None, None, target, [], f"{alias} counts as {target}") for alias, target in manifest.get("aliases", {}).items()]
    found += [("HOLE_EXCLUDED", "info", None, None, hole, [], "left out with all its records") for hole in sorted(set(manifest.get("exclude", [])))]
    return small(spark, found)


def collar_versions(rows: DataFrame, dependents: DataFrame, resolutions: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """One collar a hole and findings: equal records collapse; different ones are a conflict unless the manifest names the file to keep."""
    values = F.struct("x", "y", "z", "depth", "azimuth", "dip")
    named = rows.withColumn("kept", F.lit(False))
    if resolutions:
        wanted = F.create_map(*(F.lit(x) for pair in resolutions.items() for x in pair))[F.col("hole")]
        named = rows.withColumn("kept", F.coalesce(F.col("file") == wanted, F.lit(False)))
    first = Window.partitionBy("hole").orderBy(F.desc("kept"), "turn", "row")
    chosen = named.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth", "faults")
    listed = F.array_sort(F.collect_list(_where()))
    groups = named.groupBy("hole").agg(F.count("*").alias("n"), F.countDistinct(values).alias("versions"), F.max("kept").alias("kept"), listed.alias("rows")).where("n > 1").join(dependents, "hole", "left")
    told = F.concat(F.lit("versions in "), F.array_join("rows", ", "))
    code = F.when(F.col("versions") == 1, "RECORD_DUPLICATE").when(F.col("kept"), "COLLAR_CONFLICT_RESOLVED").otherwise("COLLAR_CONFLICT")
    severity = F.when(F.col("versions") == 1, "warning").when(F.col("kept"), "info").otherwise("error")
    message = F.concat(told, F.when(code == "COLLAR_CONFLICT", F.concat(F.lit("; depending on it: "), F.coalesce("dependents", F.lit("none")))).otherwise(F.lit("")))
    return chosen, groups.select(*finding(code, severity, message, hole=F.col("hole"), role="collar", rows=F.col("rows")))


def orphans(rows: DataFrame, holes: DataFrame, excluded: list[str], role: str) -> tuple[DataFrame, DataFrame]:
    """(rows of known holes, findings of those of none); rows of excluded holes are neither."""
    meant = rows.where(~F.col("hole").isin(excluded)) if excluded else rows
    alone = meant.join(holes, "hole", "left_anti")
    return meant.join(holes, "hole", "left_semi"), alone.select(*finding(f"ORPHAN_{role.upper()}", "warning", "no collar has this hole; the record stands apart", F.col("file"), role, F.col("hole"), F.array(F.col("row").cast("string"))))


def collisions(rows: DataFrame) -> DataFrame:
    """Keys of a namespace that differ in case, punctuation or leading zeros only."""
    keys = rows.select("hole").distinct().select("hole", F.substring_index("hole", ":", 1).alias("namespace"), parsing.plain_id(F.expr("substring(hole, instr(hole, ':') + 1)")).alias("plain"))
    met = keys.groupBy("namespace", "plain").agg(F.array_sort(F.collect_set("hole")).alias("holes")).where(F.size("holes") > 1)
    return met.select(*finding("ID_NORMALIZATION_COLLISION", "warning", F.concat(F.array_join("holes", ", "), F.lit(" look alike and stay apart unless an alias joins them")), hole=F.col("holes")[0]))


class Import:
    """Tables and findings of a manifest's files; see the module."""

    def __init__(self, spark: SparkSession, manifest: dict, base: str, cancelled: Callable[[], bool] = lambda: False):
        self.spark, self.manifest, self.cancelled = spark, manifest, cancelled
        self._tick()
        self.files = Files(spark, manifest, base)
        self._tick()
        self.excluded = sorted(set(manifest.get("exclude", [])))
        self.found = [self.files.findings, notes(spark, manifest)]
        self.tables: dict[str, DataFrame] = {}
        status = self._build()
        self.findings = written(reduce(DataFrame.unionByName, self.found))
        errors = self.findings.where("severity = 'error'")
        if self.excluded:
            errors = errors.where(F.col("hole").isNull() | ~F.col("hole").isin(self.excluded))
        self.status = status or ("accepted" if errors.isEmpty() else "rejected")

    def _tick(self) -> None:
        if self.cancelled():
            raise versions.Cancelled(self.manifest["project"]["id"])

    @staticmethod
    def _whole(found: DataFrame) -> bool:
        """Whether an error concerns no hole alone."""
        return not found.where("severity = 'error' AND hole IS NULL").isEmpty()

    def _build(self) -> str | None:
        """Fills tables and findings; the status where it is settled before all findings are known."""
        if self._whole(self.files.findings):
            return "rejected"
        f = self.files
        raw = {
            "collar": f.rows("collar", self._collar, "x double, y double, z double, depth double, azimuth double, dip double, crs string, reference string"),
            "survey": f.rows("survey", self._survey, "md double, azimuth double, dip double, reference string"),
            "assay": f.rows("assay", self._assay, "sample string, kind string, control string, repeat string, from_md double, to_md double, cells array<struct<column:string,analyte:string,unit:string,method:string,lab:string,token:string,state:string,value:double,limit:double>>"),
            "lithology": f.rows("lithology", self._lithology, "from_md double, to_md double, description string, codes map<string,string>"),
        }
        self._tick()
        everything = reduce(DataFrame.unionByName, (rows.select("hole") for role, rows in raw.items() if role != "assay"), raw["assay"].where("control IS NULL").select("hole"))
        self.found.append(collisions(everything))
        early = [value_faults(raw["collar"], "collar")]
        places = raw["collar"].where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND (dip IS NULL OR dip BETWEEN -90 AND 90)")
        steep = raw["collar"].where("dip IS NOT NULL AND dip NOT BETWEEN -90 AND 90")
        early.append(steep.select(*finding("NUMBER_INVALID", "error", "the dip is beyond the vertical", F.col("file"), "collar", F.col("hole"), F.array(F.col("row").cast("string")))))
        frames = places.select("file", F.coalesce("crs", F.lit(self.manifest["frame"].get("horizontalCrs"))).alias("crs")).distinct()
        spread = frames.groupBy().agg(F.countDistinct(F.coalesce("crs", F.lit(""))).alias("n"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "file", "crs"))), ", ").alias("files")).where("n > 1")
        early.append(spread.select(*finding("CRS_MISMATCH", "error", F.concat(F.lit("collars in several reference systems: "), "files"), role="collar")))
        turned = boxes.swapped_axes(boxes.file_boxes(places))
        early.append(turned.select(*finding("AXES_SWAPPED_SUSPECTED", "error", F.concat(F.lit("meets "), "file", F.lit(" only with its axes exchanged; declare axisOrder")), F.col("file_2"), "collar")))
        early = written(reduce(DataFrame.unionByName, early))
        self.found.append(early)
        if self._whole(early):
            return "rejected"
        if not any(x["role"] == "collar" for x in self.manifest["files"]):
            self.found.append(small(self.spark, [("COLLARS_PENDING", "warning", None, None, None, [], "no file of collars yet; nothing has a place")]))
            return "pending"
        counts = reduce(DataFrame.unionByName, (rows.groupBy("hole").agg(F.count("*").alias("n")).withColumn("role", F.lit(role)) for role, rows in raw.items() if role != "collar"))
        dependents = counts.groupBy("hole").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("role", "n"))), lambda x: F.concat_ws(" ", x["n"], x["role"])), ", ").alias("dependents"))
        chosen, conflicts = collar_versions(places, dependents, self.manifest.get("resolutions", {}).get("collars", {}))
        collars = written(chosen.where(~F.col("hole").isin(self.excluded)) if self.excluded else chosen)
        self.found.append(conflicts)
        self._tables(raw, collars)
        self._tick()
        return None

    def _collar(self, f: dict) -> tuple[dict[str, Column], list[Column]]:
        (x, a), (y, b), (z, c) = (Files.number(f, n) for n in "xyz")
        (depth, d), (azimuth, e), (dip, g) = (Files.number(f, n, False) for n in ("totalDepth", "azimuth", "dip"))
        east, north = imports.axes(x, y, f.get("axisOrder", "east-north"))
        return {
            "x": east, "y": north, "z": Files.length(f, z, "elevationUnit"), "depth": Files.length(f, depth), "azimuth": parsing.wrapped_azimuth(azimuth), "dip": Files.dip(f, dip),
            "crs": F.lit(f.get("crs")).cast("string"), "reference": F.lit(f.get("angles", {}).get("azimuthReference", "unknown")),
        }, [a, b, c, d, e, g]

    def _survey(self, f: dict) -> tuple[dict[str, Column], list[Column]]:
        (md, a), (azimuth, b), (dip, c) = (Files.number(f, n) for n in ("depth", "azimuth", "dip"))
        return {"md": Files.length(f, md), "azimuth": parsing.wrapped_azimuth(azimuth), "dip": Files.dip(f, dip), "reference": F.lit(f.get("angles", {}).get("azimuthReference", "unknown"))}, [a, b, c]

    def _assay(self, f: dict) -> tuple[dict[str, Column], list[Column]]:
        columns = f["columns"]
        sample = F.trim(F.col(f"`{columns['sample']}`")) if "sample" in columns else F.concat(F.lit(f["path"].rpartition("/")[2].rpartition(".")[0] + "-"), F.col("_row"))
        kind = F.trim(F.col(f"`{columns['sampleType']}`")) if "sampleType" in columns else F.lit("")
        named = lambda pairs: F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))[kind] if pairs else F.lit(None).cast("string")
        control = named(f.get("controls", {}))
        (a, fault_a), (b, fault_b) = (Files.number(f, n) for n in ("from", "to"))
        decimal = f.get("dialect", {}).get("decimal", ".")
        cells = []
        for column, m in f.get("analytes", {}).items():
            text = F.trim(F.col(f"`{column}`"))
            states = {k.strip(): v for k, v in f.get("states", {}).items()}
            absent = text.isin("", *(x.strip() for x in f.get("missing", [])))
            limit, value = imports.decimal_number(F.substring(text, 2, 1 << 30), decimal), imports.decimal_number(text, decimal)
            state = F.lit(None).cast("string")
            state = F.when(text.startswith("<") & (limit > 0), "censored-below").when(text.startswith(">") & (limit > 0), "censored-above").when(value.isNotNull(), "measured").otherwise(state)
            state = F.when(absent, "missing").otherwise(state)
            for token, name in states.items():
                state = F.when(text == token, name).otherwise(state)
            told = {"column": F.lit(column), "analyte": F.lit(m["analyte"]), "unit": F.lit(m["unit"]), "method": F.lit(m.get("method")).cast("string"), "lab": F.lit(m.get("lab")).cast("string"), "token": F.col(f"`{column}`")}
            cells.append(F.struct(*(c.alias(n) for n, c in told.items()), state.alias("state"), F.when(state == "measured", value).alias("value"), F.when(state.startswith("censored"), limit).alias("limit")))
        fields = {"sample": sample, "kind": kind, "control": control, "repeat": F.coalesce(named(f.get("repeats", {})), F.lit("original")), "from_md": Files.length(f, a), "to_md": Files.length(f, b), "cells": F.array(*cells)}
        return fields, [F.when(control.isNull(), fault_a), F.when(control.isNull(), fault_b)]

    def _lithology(self, f: dict) -> tuple[dict[str, Column], list[Column]]:
        (a, fault_a), (b, fault_b) = (Files.number(f, n) for n in ("from", "to"))
        told = f["columns"].get("description")
        codes = [x for c in f.get("codes", []) for x in (F.lit(c), imports.code_or_null(F.col(f"`{c}`")))]
        return {"from_md": Files.length(f, a), "to_md": Files.length(f, b), "description": imports.code_or_null(F.col(f"`{told}`")) if told else F.lit(None).cast("string"), "codes": F.create_map(*codes).cast("map<string,string>")}, [fault_a, fault_b]

    def _tables(self, raw: dict[str, DataFrame], collars: DataFrame) -> None:
        holes, out, assumed = collars.select("hole"), self.tables, self.manifest.get("assumptions", {})
        known, alone = orphans(raw["survey"], holes, self.excluded, "survey")
        steep = known.where("md < 0 OR dip NOT BETWEEN -90 AND 90")
        self.found += [alone, value_faults(known, "survey"), steep.select(*finding("NUMBER_INVALID", "error", F.concat_ws(" ", F.lit("depth or dip out of bounds:"), "md", "dip"), F.col("file"), "survey", F.col("hole"), F.array(F.col("row").cast("string"))))]
        stations = imports.station_groups(known.where("md >= 0 AND azimuth IS NOT NULL AND dip BETWEEN -90 AND 90").select("hole", "md", "azimuth", "dip"))
        places = known.groupBy("hole", "md").agg(F.array_sort(F.collect_list(_where())).alias("where"), F.min("reference").alias("reference"))
        reported = stations.where("finding IS NOT NULL").join(places, ["hole", "md"])
        self.found.append(reported.select(*finding(F.col("finding"), F.when(F.col("finding") == "SURVEY_DEPTH_CONFLICT", "error").otherwise("warning"), F.concat_ws(" ", F.lit("stations at"), "md"), role="survey", hole=F.col("hole"), rows=F.col("where"))))
        depths = raw["assay"].where("control IS NULL").select("hole", "to_md").unionByName(raw["lithology"].select("hole", "to_md"))
        deepest = depths.join(holes, "hole", "left_semi").groupBy("hole").agg(F.max("to_md").alias("deepest")).where("deepest IS NOT NULL")
        decided = written(imports.trajectory_decisions(collars, stations, deepest, assumed.get("surveyStart"), assumed.get("missingSurvey")))
        told = decided.select("hole", F.explode(F.split("codes", ",")).alias("code")).where("code <> '' AND code <> 'SURVEY_DEPTH_CONFLICT'")
        severity = F.when(F.col("code").isin([c for c in SEVERITY if SEVERITY[c] == "error"]), "error").otherwise("warning")
        self.found.append(told.select(*finding(F.col("code"), severity, "direction of the hole", hole=F.col("hole"), role="survey")))
        free = decided.where("NOT blocked").select("hole")
        out["collars"] = collars.join(free, "hole").select(F.col("hole").alias("id"), "namespace", F.col("raw").alias("source_id"), "x", "y", "z", "depth", "azimuth", "dip", "reference", "file", "row")
        from_collar = collars.join(decided.where("kind = 'collar-orientation' OR start = 'collar'").select("hole"), "hole", "left_semi").select(F.concat("hole", F.lit("#collar")).alias("id"), "hole", F.lit(0.0).alias("md"), "azimuth", "dip", F.lit("collar").alias("kind"), "reference")
        nth = F.row_number().over(Window.partitionBy("hole").orderBy("md")) - 1
        measured = stations.join(places.select("hole", "md", "reference"), ["hole", "md"]).join(free, "hole", "left_semi").select(F.concat("hole", F.lit("#s"), nth).alias("id"), "hole", "md", "azimuth", "dip", F.lit("measured").alias("kind"), "reference")
        out["surveys"] = from_collar.join(free, "hole", "left_semi").unionByName(measured)
        out["trajectories"] = decided.where("NOT blocked").select(F.col("hole").alias("id"), "kind", "start", "valid_to")
        self._assays(raw["assay"], holes)
        known, alone = orphans(raw["lithology"], holes, self.excluded, "lithology")
        wrong = known.where("from_md < 0 OR to_md < from_md")
        self.found += [alone, value_faults(known, "lithology"), wrong.select(*finding("INTERVAL_INVALID", "warning", F.concat_ws(" ", F.lit("left out:"), "from_md", "to_md"), F.col("file"), "lithology", F.col("hole"), F.array(F.col("row").cast("string"))))]
        logs = known.where("from_md >= 0 AND to_md >= from_md").withColumn("plain", F.concat(F.col("hole"), F.lit("/L"), *(x for c in ("from_md", "to_md") for x in (F.lit("-" if c == "to_md" else ""), F.regexp_replace(F.col(c).cast("string"), "[.]0$", "")))))
        named = matching.numbered(logs.withColumn("listed", F.to_json("codes")), "plain", ["listed", F.coalesce("description", F.lit("")), "file", "row"])
        event = F.col("from_md") == F.col("to_md")
        out["geology"] = named.select(F.col("unique_id").alias("id"), "hole", F.when(event, "event").otherwise("interval").alias("kind"), F.when(~event, F.col("from_md")).alias("from_md"), F.when(~event, F.col("to_md")).alias("to_md"), F.when(event, F.col("from_md")).alias("at_md"), "codes", "description", "file", "row")

    def _assays(self, rows: DataFrame, holes: DataFrame) -> None:
        out = self.tables
        controls = rows.where("control IS NOT NULL").withColumn("plain", F.concat(F.lit("qc-"), "sample"))
        named = matching.numbered(controls, "plain", ["turn", "row"])
        each = named.select("unique_id", F.explode("cells").alias("c"), "file", "row", "hole", "raw", "sample", "control")
        out["qc"] = each.where("c.state IS NOT NULL").select(F.concat_ws(":", "unique_id", "c.column").alias("id"), "sample", "control", "c.analyte", "c.unit", "c.state", "c.value", "c.limit", "c.token")
        known, alone = orphans(rows.where("control IS NULL"), holes, self.excluded, "assay")
        wrong = known.where("from_md < 0 OR to_md <= from_md")
        self.found += [alone, value_faults(known, "assay"), wrong.select(*finding("INTERVAL_INVALID", "warning", F.concat_ws(" ", F.lit("left out:"), "from_md", "to_md"), F.col("file"), "assay", F.col("hole"), F.array(F.col("row").cast("string"))))]
        sound = known.where("from_md >= 0 AND to_md > from_md").withColumn("support", F.concat_ws("/", "hole", "sample"))
        first = Window.partitionBy("support").orderBy("turn", "row")
        sound = sound.withColumns({"nth": F.row_number().over(first), "own_from": F.first("from_md").over(first), "own_to": F.first("to_md").over(first), "own_place": F.first(_where()).over(first)})
        agrees = (F.col("from_md") == F.col("own_from")) & (F.col("to_md") == F.col("own_to"))
        sound = written(sound.withColumn("agrees", agrees))
        self.found.append(sound.where("NOT agrees").select(*finding("SAMPLE_CONFLICT", "error", F.concat(F.lit("another interval than in "), "own_place"), hole=F.col("hole"), role="assay", rows=F.array(_where(), F.col("own_place")))))
        out["supports"] = sound.where("nth = 1").select(F.col("support").alias("id"), "hole", "sample", "from_md", "to_md", "file", "row")
        cells = sound.where("agrees").select("support", "hole", "sample", "from_md", "to_md", "repeat", "turn", "row", "file", "raw", F.explode("cells").alias("c"))
        unread = cells.where("c.state IS NULL").unionByName(each.where("c.state IS NULL").select(F.lit(None).cast("string").alias("support"), "hole", "sample", F.lit(None).cast("double").alias("from_md"), F.lit(None).cast("double").alias("to_md"), F.lit(None).cast("string").alias("repeat"), F.lit(0).alias("turn"), "row", "file", "raw", "c"))
        self.found.append(unread.select(*finding("NUMBER_INVALID", "error", F.concat(F.lit("column "), "c.column", F.lit(": no number: "), "c.token"), F.col("file"), "assay", F.when(F.col("raw") != "", F.col("hole")), F.array(F.col("row").cast("string")))))
        same = Window.partitionBy("support", "c.analyte", "c.method", "c.lab", F.trim("c.token"), "repeat").orderBy("turn", "row", "c.column")
        read = cells.where("c.state IS NOT NULL").withColumn("nth", F.row_number().over(same))
        self.found.append(read.where("nth > 1").select(*finding("RECORD_DUPLICATE", "warning", F.concat(F.lit("the same result again: "), "c.analyte"), hole=F.col("hole"), role="assay", rows=F.array(_where()))))
        kept = read.where("nth = 1").drop("nth").withColumn("plain", F.concat_ws(":", "support", "c.column"))
        results = written(matching.numbered(kept, "plain", ["turn", "row"]).select(F.col("unique_id").alias("id"), "support", "hole", "from_md", "to_md", F.col("repeat").alias("role"), "c.analyte", "c.unit", "c.method", "c.lab", "c.state", "c.value", "c.limit", "c.token"))
        series = results.select("hole", "analyte", F.coalesce("method", F.lit("")).alias("method"), F.col("id").alias("sample"), "from_md", "to_md", "support")
        pairs = intervals.overlapping_pairs(series, ["hole", "analyte", "method"])
        self.found.append(pairs.select(*finding("ASSAY_OVERLAP", "warning", F.concat_ws(" ", "analyte", F.lit("intervals overlap in one series; both are left out of models")), hole=F.col("hole"), role="assay", rows=F.array("sample", "sample_2"))))
        out["exclusions"] = pairs.select(F.explode(F.array("sample", "sample_2")).alias("row_id")).distinct().select(F.lit("determinations").alias("table"), "row_id", F.lit("ASSAY_OVERLAP").alias("reason"))
        out["determinations"] = results
        out["analytes"] = results.groupBy("analyte").agg(F.min_by("unit", "id").alias("unit")).select(F.col("analyte").alias("id"), "unit")

    def accepted_tables(self) -> dict[str, DataFrame]:
        """All tables in the order of their ids, with findings as issues and the counts of each step."""
        self._tick()
        ordered = {name: df.orderBy(*(c for c in ("id", "table", "row_id") if c in df.columns)) for name, df in self.tables.items()}
        read = reduce(DataFrame.unionByName, (t.select("_row") for t in self.files.tables.values()))
        parts = [self.spark.createDataFrame([("files", len(self.manifest["files"]))], "step string, n long"), read.agg(F.lit("rows read").alias("step"), F.count("*").alias("n"))]
        for step, table in (("holes accepted", "collars"), ("samples", "supports"), ("determinations", "determinations"), ("controls", "qc"), ("excluded from modeling", "exclusions")):
            parts.append(self.tables[table].agg(F.lit(step).alias("step"), F.count("*").alias("n")))
        return {**ordered, "issues": self.findings.orderBy("code", "hole", "file", "message"), "waterfall": reduce(DataFrame.unionByName, parts)}


def run_import(spark: SparkSession, manifest_path: str, out: str, cancelled: Callable[[], bool] = lambda: False) -> dict:
    """Read, check and, when accepted, publish a manifest's project under `out`; returns and writes the report.

    The version's name is a hash of the manifest and of its files' bytes, so that the same input is not written twice.
    Rejected and pending imports, cancelled ones and killed ones leave the current version in place.
    """
    manifest = load_manifest(spark, manifest_path)
    project = manifest["project"]["id"]
    done = Import(spark, manifest, manifest_path.rpartition("/")[0], cancelled)
    findings = done.findings
    input_hash = hashlib.sha256(json.dumps([manifest, sorted(done.files.hashes.values())], sort_keys=True).encode()).hexdigest()
    counts = {f"by_{c}": {r[c]: r["n"] for r in findings.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).collect()} for c in ("severity", "code", "file", "role")}
    blocked = findings.where("severity = 'error' AND hole IS NOT NULL").groupBy().agg(F.countDistinct("hole").alias("n")).first()["n"]
    report = {"project": project, "status": done.status, "input": input_hash, "blocked": blocked, "counts": counts}
    if done.status == "accepted":
        report["written"] = versions.publish(done.accepted_tables, out, project, input_hash[:16], cancelled)
    elif cancelled():
        raise versions.Cancelled(project)
    versions.put_text(spark, f"{out}/{project}.report.json", json.dumps(report, sort_keys=True))
    return report | {"findings": findings}
