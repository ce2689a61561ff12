"""Tables of a stage, written together: all of them with their summary, or none."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

SUMMARY = "table string, rows long, columns string, digest string"


def table_digest(df: DataFrame) -> tuple[int, str]:
    """(rows, digest): the digest sums two hashes of each row, so that neither order nor files count; repeated rows do."""
    names = sorted(df.columns)
    hashes = [F.xxhash64(*(F.to_json(F.struct(F.col(f"`{n}`").alias("v"))) for n in names), F.lit(salt)).cast("decimal(38,0)") for salt in (1, 2)] if names else [F.lit(0)] * 2
    row = df.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(h), F.lit(0)).cast("string").alias(f"h{i}") for i, h in enumerate(hashes))).first()
    return row["n"], f"{row['h0']}.{row['h1']}"


def commit(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Write tables as Parquet under `folder`/name and their summary; returns the summary.

    All go to a folder beside it first, which gets its name only when everything is written and read back. A folder that
    exists is refused. What a failed write leaves is deleted; a lost driver leaves only the folder beside.
    """
    if not tables:
        raise ValueError("no tables")
    spark = next(iter(tables.values())).sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path(folder)):
        raise FileExistsError(folder)
    pending = f"{folder.rstrip('/')}.pending-{uuid.uuid4().hex}"
    try:
        rows = []
        for name, df in tables.items():
            df.write.parquet(f"{pending}/{name}")
            n, digest = table_digest(spark.read.schema(df.schema).parquet(f"{pending}/{name}"))
            rows.append((name, n, ",".join(df.columns), digest))
        spark.createDataFrame(rows, SUMMARY).coalesce(1).write.json(f"{pending}/summary")
        if fs.exists(path(folder)) or not fs.rename(path(pending), path(folder)):
            raise FileExistsError(folder)
    except BaseException:
        fs.delete(path(pending), True)
        raise
    return summary(spark, folder)


def summary(spark: SparkSession, folder: str) -> DataFrame:
    """(table, rows, columns, digest) of a committed folder."""
    return spark.read.schema(SUMMARY).json(f"{folder.rstrip('/')}/summary")


def verified(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A committed table, after its rows were counted and hashed again; raises if they differ from its summary."""
    held = summary(spark, folder).where(F.col("table") == name).first()
    if held is None:
        raise ValueError(f"{folder} has no table {name}")
    df = spark.read.parquet(f"{folder.rstrip('/')}/{name}")
    if table_digest(df) != (held["rows"], held["digest"]):
        raise ValueError(f"{folder}/{name} has changed since it was written")
    return df
