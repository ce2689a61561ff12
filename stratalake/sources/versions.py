"""Versions of a project's tables: each is written whole beside the others, and a pointer names the current one."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratalake.sources import sinks


class Cancelled(RuntimeError):
    """The caller withdrew; the project is as it was."""


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def put_text(spark: SparkSession, name: str, text: str) -> None:
    """Write a small file, replacing one of that name in one step: readers see the old or the new one."""
    beside, fs = _path(spark, f"{name}.{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    target, _ = _path(spark, name)
    kind = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(beside, target, options)


def get_text(spark: SparkSession, name: str) -> str | None:
    path, fs = _path(spark, name)
    if not fs.exists(path):
        return None
    return spark.read.format("binaryFile").load(name).selectExpr("cast(content AS string) AS content").first()["content"]


def current(spark: SparkSession, folder: str, project: str) -> str | None:
    """Folder of the version that a project's pointer names."""
    held = get_text(spark, f"{folder}/{project}/current.json")
    return f"{folder}/{project}/versions/{json.loads(held)['version']}" if held else None


def publish(tables: dict[str, DataFrame] | Callable[[], dict[str, DataFrame]], folder: str, project: str, version: str, cancelled: Callable[[], bool] = lambda: False) -> bool:
    """Make `version` the project's current one; returns whether its tables had to be written.

    A version is named after its input, so one that is there already (of a run that ended before the pointer moved, or an
    earlier import of the same input) is taken as it is. A run that is killed leaves the pointer where it was, and so does
    one that is cancelled, which also deletes what it wrote. Old versions stay for readers that hold them.
    """
    spark = SparkSession.getActiveSession()
    place = f"{folder}/{project}/versions/{version}"
    path, fs = _path(spark, place)
    writes = not fs.exists(path)
    if writes:
        parent = path.getParent()
        fs.mkdirs(parent)
        sinks.commit(tables() if callable(tables) else tables, place)
    if cancelled():
        if writes:
            fs.delete(path, True)
        raise Cancelled(project)
    put_text(spark, f"{folder}/{project}/current.json", json.dumps({"version": version}))
    return writes


def read_current(spark: SparkSession, folder: str, project: str, table: str) -> DataFrame:
    """A table of the current version, its rows checked against the summary."""
    place = current(spark, folder, project)
    if place is None:
        raise FileNotFoundError(f"{project} has no current version")
    return sinks.verified(spark, place, table)
