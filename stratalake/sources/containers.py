"""Members of archives, project files, strict JSON and arrays, read from bytes within declared bounds.

A file that breaks a bound or a rule raises; nothing is repaired and no part of it is returned.
"""

from __future__ import annotations

import csv
import hashlib
import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from stratalake.sources.strict import header_cells, header_findings

CHUNK = 20_000
ENCRYPTED = 1  # bit of a member's flags


def _bounded(spark: SparkSession, path: str, most_bytes: int) -> DataFrame:
    """(path, length, content) of files, after a look at their lengths alone."""
    files = spark.read.format("binaryFile").load(path)
    large = files.where(F.col("length") > most_bytes).select("path").first()
    if large:
        raise ValueError(f"{large['path']} has over {most_bytes} bytes")
    return files.select("path", "length", "content")


def zip_table(spark: SparkSession, path: str, member: str, encoding: str = "cp1252", delimiter: str = "\t", most_bytes: int = 400_000_000) -> DataFrame:
    """The records of one delimited member of an archive, as strings by its header, with `_row`; nothing is written to disk.

    Refused are members that are encrypted or larger than `most_bytes`, headers with blank or repeated names, and
    records of another width than the header's. Blank lines are skipped.
    """

    def records(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for content in batch.column("content"):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as archive:
                    entry = archive.getinfo(member)
                    if entry.file_size > most_bytes:
                        raise ValueError(f"{member} has over {most_bytes} bytes")
                    if entry.flag_bits & ENCRYPTED:
                        raise ValueError(f"{member} is encrypted")
                    with archive.open(entry) as raw, io.TextIOWrapper(raw, encoding=encoding, newline="") as stream:
                        rows, width, numbers = [], None, []
                        for i, row in enumerate((r for r in csv.reader(stream, delimiter=delimiter, strict=True) if r), 1):
                            if width is None:
                                width = len(row)
                            elif len(row) != width:
                                raise ValueError(f"row {i} of {member} has {len(row)} fields, the header {width}")
                            rows.append(row)
                            numbers.append(i)
                            if len(rows) == CHUNK:
                                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(rows, pa.list_(pa.string()))], names=["_row", "cells"])
                                rows, numbers = [], []
                        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(rows, pa.list_(pa.string()))], names=["_row", "cells"])

    rows = _bounded(spark, path, most_bytes).select("content").mapInArrow(records, "_row long, cells array<string>")
    first = rows.where("_row = 1").first()
    if first is None:
        raise ValueError(f"{member} is empty")
    cells = header_cells(spark.createDataFrame([(first["cells"],)], "cells array<string>"))
    if found := header_findings(cells).collect():
        raise ValueError("; ".join(f"{f['code']}: {f['detail']}" for f in found))
    header = [c["name"] for c in cells.orderBy("place").collect()]
    return rows.where("_row > 1").select("_row", *(F.col("cells")[i].alias(h) for i, h in enumerate(header)))


#: Fixed values of the project format: its header keys, read from its first twelve lines.
HEADER_KEYS = ("layers", "samples", "channels", "params", "sets")


def project_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, text) of text files in single-byte western encoding, lines numbered from 1 whatever ends them."""
    text = F.decode("content", "ISO-8859-1")
    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")
    return spark.read.format("binaryFile").load(path).select("path", F.posexplode(lines).alias("line", "text")).withColumn("line", F.col("line") + 1)


def project_parameters(lines: DataFrame, pattern: str) -> DataFrame:
    """(path, line, parameter, index, name, guid) of lines that match a pattern with these four groups from their start."""
    part = lambda i: F.regexp_extract(F.trim("text"), f"^(?:{pattern})", i)
    return lines.where(F.trim("text").rlike(f"^(?:{pattern})")).select("path", "line", part(1).cast("int").alias("parameter"), part(2).cast("int").alias("index"), part(3).alias("name"), part(4).alias("guid"))


def project_header(lines: DataFrame) -> DataFrame:
    """(path, version, header, sets): the first line, header values by key, and the values of Set_ lines in file order."""
    key, value = F.substring_index("text", "=", 1), F.expr("substring(text, instr(text, '=') + 1)")
    entry = F.col("text").contains("=")
    in_header = entry & (F.col("line") <= 12) & key.isin(*HEADER_KEYS)
    is_set = entry & F.col("text").startswith("Set_")
    met = lines.groupBy("path").agg(
        F.max(F.when(F.col("line") == 1, F.trim("text"))).alias("version"),
        F.array_sort(F.collect_list(F.when(in_header, F.struct(key.alias("k"), "line", value.alias("v"))))).alias("h"),
        F.array_sort(F.collect_list(F.when(is_set, F.struct("line", value.alias("v"))))).alias("s"),
    )
    last = F.filter("h", lambda x, i: F.coalesce(F.get("h", i + 1)["k"] != x.k, F.lit(True)))  # of a repeated key, the last
    return met.select("path", "version", F.map_from_entries(F.transform(last, lambda x: F.struct(x.k, x.v))).alias("header"), F.transform("s", lambda x: x.v).alias("sets"))


def strict_json(spark: SparkSession, path: str, schema: str | StructType, most_bytes: int = 80_000_000) -> DataFrame:
    """Records of JSON files by a schema; larger files, malformed ones and NaN or Infinity in place of a number raise."""
    _bounded(spark, path, most_bytes)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").option("allowNonNumericNumbers", False).json(path)


def arrays(spark: SparkSession, path: str, most_bytes: int = 400_000_000) -> DataFrame:
    """(path, sha256, shape, index, value): cells of stored numeric arrays in C order, with the digest of the file's bytes."""

    def cells(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                raw = content.as_py()
                digest, array = hashlib.sha256(raw).hexdigest(), np.load(io.BytesIO(raw), allow_pickle=False)
                flat = array.reshape(-1).astype(float)
                for start in range(0, max(1, flat.size), CHUNK):
                    part = flat[start : start + CHUNK]
                    n = len(part)
                    columns = [pa.array([name] * n), pa.array([digest] * n), pa.array([list(array.shape)] * n, pa.list_(pa.int64())), pa.array(np.arange(start, start + n)), pa.array(part)]
                    yield pa.RecordBatch.from_arrays(columns, names=["path", "sha256", "shape", "index", "value"])

    return _bounded(spark, path, most_bytes).select("path", "content").mapInArrow(cells, "path string, sha256 string, shape array<long>, index long, value double")
