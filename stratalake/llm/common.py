"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

#: Bytes of a slice of an Arrow batch, about; a single longer row is a slice of its own.
SLICE = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. A temporary one only where none is set and all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="stratalake-checkpoint-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def materialize(df: DataFrame, **options: str | int) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back, which cuts its lineage. options: of the writer."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.options(**{"compression": "zstd"} | options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def numbered_rows(df: DataFrame, *order: str) -> DataFrame:
    """`df` as a written table, with a column number: the place of each row in the order of the columns `order`, from 0.

    Rows are dealt by ranges of that order and counted range by range; the sums before each range are one row a range.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    low = (1 << 33) - 1  # of monotonically_increasing_id: the place in the partition
    placed = materialize(placed.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(low).alias("_place")))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    out = placed.join(F.broadcast(before), "_part").select(*df.columns, (F.col("_before") + F.col("_place")).alias("number"))
    out.written_at = placed.written_at
    return out


def drop_tables(*tables: DataFrame) -> None:
    """Delete what `materialize` wrote, once all that is made from it is written too."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _row_bytes(column: pa.Array) -> np.ndarray | int:
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if pa.types.is_list(column.type):
        return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) * 8
    return 8


def batches(it: Iterator[pa.RecordBatch], rows: int = 2048, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches of at most `rows` rows and about `size` bytes, so that a task holds few long texts at a time."""
    for batch in it:
        if not batch.num_rows:
            continue
        if batch.num_rows <= rows and batch.nbytes <= size:
            yield batch
            continue
        ends = np.cumsum(sum((_row_bytes(c) for c in batch.columns), np.zeros(batch.num_rows, np.int64)))
        start = 0
        while start < batch.num_rows:
            full = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, "right"))
            stop = min(batch.num_rows, start + rows, max(full, start + 1))
            yield batch.slice(start, stop - start)
            start = stop


def word_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every text, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def release(spark: SparkSession) -> None:
    """Let Spark remove shuffle files of plans that nothing refers to any more, before the next large shuffle."""
    for _ in range(2):  # the second round takes what the first one's finalizers let go
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)  # Spark's cleaner works beside
