"""Tables between the rounds of iterative jobs, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Window, functions as F


def written(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table under spark.checkpoint.dir, which cuts its lineage and outlives executors.

    Where that setting is unset, a temporary folder serves sessions that run in one process; others raise.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="stratalake-tables-")
    path = f"{folder.rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables that `written` made, once what reads them is written too."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def placed_rows(df: DataFrame, *order: str) -> DataFrame:
    """`df` with a column place, its rows' number in the order of the columns `order` from 0: ranges are counted one by one."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    inner = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    held = written(sorted_rows.select("*", F.spark_partition_id().alias("_part"), inner.alias("_inner")))
    sizes = held.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a range
    return held.join(F.broadcast(before), "_part").select(*df.columns, (F.col("_before") + F.col("_inner")).alias("place"))
