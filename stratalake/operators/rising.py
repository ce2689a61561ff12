"""Rising (isotonic) fits without a key in one task: pooled blocks of stretches that meet in rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from stratalake.storage import dropped, written

#: Blocks of a stretch, which one task pools.
STRETCH = 50_000


def _pooled(keys: list[str], kinds: pa.Schema):
    """Pools violators among blocks that come in the order of key and place; a block is (first x, last x, sum, weight)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        current, stack = None, []

        def closed() -> pa.RecordBatch:
            columns = [pa.array([v] * len(stack), kinds.field(k).type) for k, v in zip(keys, current)]
            columns += [pa.array(c, pa.float64()) for c in zip(*stack)] + [pa.array([part] * len(stack), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=[*keys, "low", "high", "total", "weight", "part"])

        for batch in it:
            named = list(zip(*(batch.column(k).to_pylist() for k in keys))) if keys else [()] * batch.num_rows
            for key, *block in zip(named, *(batch.column(c).to_pylist() for c in ("low", "high", "total", "weight"))):
                if key != current:
                    if stack:
                        yield closed()
                    current, stack = key, []
                low, high, total, weight = block
                while stack and stack[-1][2] * weight >= total * stack[-1][3]:
                    before = stack.pop()
                    low, total, weight = before[0], before[2] + total, before[3] + weight
                stack.append((low, high, total, weight))
        if stack:
            yield closed()

    return run


def rising_fit(points: DataFrame, keys: list[str], x: str = "x", y: str = "y", stretch: int = STRETCH) -> DataFrame:
    """(keys, low, high, value, weight): the weighted least squares fit of y that never falls in x, as blocks of equal value.

    Equal x are averaged first. Blocks are dealt by ranges of (keys, x) to tasks of about `stretch` blocks, each pools its
    own, and the rounds go on, with the ranges cut elsewhere, until no two neighbours across a cut fall. Pooling neighbours
    that fall leads to the same fit in whatever order it is done. Rows without x or y, NaN among them, take no part.
    """
    known = points.where(f"{x} IS NOT NULL AND {y} IS NOT NULL AND NOT isnan(cast({x} AS double)) AND NOT isnan(cast({y} AS double))")
    place = F.col(x).cast("double")
    blocks = known.groupBy(*keys, place.alias("low")).agg(F.sum(F.col(y).cast("double")).alias("total"), F.count("*").cast("double").alias("weight")).withColumn("high", F.col("low"))
    blocks = written(blocks.select(*keys, "low", "high", "total", "weight"))
    schema = ", ".join([*(f"`{k}` {points.schema[k].dataType.simpleString()}" for k in keys), "low double, high double, total double, weight double, part long"])
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(points.select(*keys).schema)
    turn = 0
    while True:
        parts = -(-blocks.count() // stretch)
        dealt = blocks.repartitionByRange(parts + (turn % 3 if parts > 1 else 0) or 1, *keys, "low").sortWithinPartitions(*keys, "low")
        pooled = written(dealt.mapInArrow(_pooled(keys, kinds), schema))
        dropped(blocks)
        mean = F.col("total") / F.col("weight")
        ends = pooled.groupBy("part", *keys).agg(F.min("low").alias("first"), F.min_by(mean, "low").alias("begins"), F.max_by(mean, "low").alias("ends"))
        before = F.lag("ends").over(Window.partitionBy(*keys).orderBy("first"))  # a row for each task and key
        if parts <= 1 or ends.select((before >= F.col("begins")).alias("falls")).where("falls").isEmpty():
            return pooled.select(*keys, "low", "high", mean.alias("value"), "weight")
        blocks, turn = pooled, turn + 1


def fitted_points(fit: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x, value): both ends of every block, between which a fit is interpolated."""
    ends = F.explode(F.array_distinct(F.array("low", "high"))).alias("x")
    return fit.select(*keys, ends, "value")
