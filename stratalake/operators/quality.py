"""Keys, conflicts, orphans and selection: checks whose findings are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose key no parent has; null keys are orphans."""
    return child.join(parent.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")


def versions(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row a key: how often it occurs, in how many versions, and whether they agree."""
    found = df.groupBy(*keys).agg(F.count("*").alias("rows"), F.countDistinct(F.to_json(F.struct(*values), {"ignoreNullFields": "false"})).alias("versions"))
    return found.withColumn("finding", F.when(F.col("versions") > 1, "conflict").when(F.col("rows") > 1, "collapsed").otherwise("single"))


def first_of_signature(df: DataFrame, signature: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*signature).orderBy(*order)
    return df.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): where each key of two tables is found."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(1)), right.select(key).distinct().withColumn("r", F.lit(1))
    side = F.when(F.col("r").isNull(), "left only").when(F.col("l").isNull(), "right only").otherwise("both")
    return a.join(b, key, "full_outer").select(key, side.alias("side"))


def select_results(results: DataFrame, keys: list[str]) -> DataFrame:
    """One result a geometry and analyte: the only one, a single reassay, or the best-ranked method if it is alone."""
    smallest = F.min("rank")
    found = results.groupBy(*keys).agg(
        F.count("*").alias("candidates"), F.count_if(F.col("role") == "reassay").alias("reassays"),
        F.min(F.when(F.col("role") == "reassay", F.col("id"))).alias("reassay_id"), smallest.alias("best"), F.min(F.struct("rank", "id")).alias("first"),
    )
    ties = results.join(found.select(*keys, "best"), keys).where("rank = best").groupBy(*keys).agg(F.count("*").alias("ties"))
    all_ = found.join(ties, keys, "left")
    reason = F.when(F.col("candidates") == 1, "single").when(F.col("reassays") == 1, "reassay").when(F.col("ties") == 1, "priority").otherwise("unresolved")
    out = all_.withColumn("reason", reason)
    return out.select(*keys, "candidates", "reason", F.when(F.col("reason") == "reassay", F.col("reassay_id")).when(F.col("reason") != "unresolved", F.col("first.id")).alias("selected"))


def count_by_each(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, rows): counts by each column, in one pass."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("p")
    return df.select(pairs).groupBy("p.column", "p.value").agg(F.count("*").alias("rows"))
