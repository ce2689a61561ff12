"""Stand-ins for drillhole tables over the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

QUERIES: dict = {}
ORACLES: dict = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contiguous sample intervals: an order is a hole, quantities are lengths.

    The hole has its name before the window, so that later steps by hole know that rows are dealt out by it; other names come after, so that no column is sent twice.
    """
    w = Window.partitionBy("hole").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    rows = read(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "hole").withColumns({"to_md": F.sum("l_quantity").over(w), "sample": F.row_number().over(w)})
    return rows.select("hole", (F.col("to_md") - F.col("l_quantity")).alias("from_md"), "to_md", "sample", F.col("l_returnflag").alias("analyte"), F.col("l_linestatus").alias("method"), F.col("l_extendedprice").alias("value"), F.col("l_suppkey").alias("site"))


SAMPLES = """samples AS (SELECT l_orderkey AS hole, sum(l_quantity) OVER w - l_quantity AS from_md, sum(l_quantity) OVER w AS to_md, row_number() OVER w AS sample,
  l_returnflag AS analyte, l_linestatus AS method, l_extendedprice AS value, l_suppkey AS site
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice ROWS UNBOUNDED PRECEDING))"""


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs with overlaps and gaps: line numbers are starts, quantities lengths."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    start = (F.col("l_linenumber") * 20).cast("double")
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("hole"), start.alias("from_md"), (start + F.col("l_quantity")).alias("to_md"), F.row_number().over(w).alias("sample"), F.concat("l_returnflag", "l_linestatus").alias("code"))


LOGS = """logs AS (SELECT l_orderkey AS hole, CAST(l_linenumber * 20 AS DOUBLE) AS from_md, l_linenumber * 20 + l_quantity AS to_md,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS sample, concat(l_returnflag, l_linestatus) AS code FROM lineitem)"""


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"), (F.col("s_nationkey") * 100 + F.col("s_suppkey")).cast("double").alias("y"), F.col("s_nationkey").cast("long").alias("hole"), F.col("s_acctbal").alias("value"))


SITES = "sites AS (SELECT s_suppkey AS id, s_acctbal AS x, CAST(s_nationkey * 100 + s_suppkey AS DOUBLE) AS y, CAST(s_nationkey AS BIGINT) AS hole, s_acctbal AS value FROM supplier)"


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("hole"), (F.row_number().over(w) * 10.0).alias("md"), F.pmod(F.col("event_id") * 7, F.lit(360)).cast("double").alias("azimuth"), (-45.0 - F.pmod(F.col("event_id"), F.lit(45))).alias("dip"))


STATIONS = "stations AS (SELECT user_id AS hole, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 10.0::DOUBLE AS md, CAST((event_id * 7) % 360 AS DOUBLE) AS azimuth, CAST(-45 - event_id % 45 AS DOUBLE) AS dip FROM events)"
